import json
import math

import pytest
from pyspark.sql import functions as F

from quillbit.functions import special, text
from quillbit.functions import symbols as S
from quillbit.operators import adaptive as A
from quillbit.operators import distributions as D
from quillbit.operators import histogram as H
from quillbit.operators import sampling, search
from quillbit.operators import sequential as M
from quillbit.operators.urns import Blending, UrnPPM
from quillbit.plans import score
from quillbit.plans.spec import RANDOM_BYTES, parse
from quillbit.sources import corpus, tables

DOCS = [(1, "abracadabra abracadabra"), (2, "mississippi"), (3, "naïve 😀"), (4, "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def bits(df):
    return {r["doc_id"]: r["bits"] for r in df.collect()}


def expected(model_of, symbols_of):
    out = {}
    for i, t in DOCS:
        model, total = model_of(), 0.0
        for x in symbols_of(t):
            total -= math.log2(model.mass(x))
            model.learn(x)
        out[i] = round(total, 3)
    return out


def points(t):
    return [ord(c) for c in t]


def test_window_crp_matches_the_sequential_model(docs):
    from fractions import Fraction

    got = bits(A.total_bits(A.crp(A.characters(docs), A.uniform_mass(S.SIMPLE_RANGE), 1.0, 0.25)))
    want = expected(lambda: M.CRP(M.Uniform(S.SIMPLE_RANGE), Fraction(1), Fraction(1, 4)), points)
    assert got == pytest.approx(want, abs=2e-3)


def test_window_polya_matches_the_sequential_tree(docs):
    from fractions import Fraction

    got = bits(A.total_bits(A.polya(A.byte_stream(docs), 257)))
    want = expected(lambda: M.PolyaTree(257, *M.even_priors(Fraction(1, 2))), lambda t: list(t.encode()))
    assert got == pytest.approx(want, abs=2e-3)


def test_window_mass_polya_matches_the_sequential_tree(docs):
    got = bits(A.total_bits(A.mass_polya(A.characters(docs.where("doc_id < 3")), 300, A.even_between)))
    want = expected(lambda: M.MassPolyaTree(300, lambda a, b: b - a + 1), lambda t: [c for c in points(t) if c < 300])
    assert got == pytest.approx({k: v for k, v in want.items() if k < 3}, abs=2e-3)


def test_window_blending_matches_the_urns(docs):
    got = bits(A.total_bits(A.blending(A.characters(docs), 2, A.uniform_mass(S.SIMPLE_RANGE), 0.25, 0.5)))
    want = expected(lambda: UrnPPM(M.Uniform(S.SIMPLE_RANGE), 2, Blending(0.25, 0.5)), points)
    assert got == pytest.approx(want, abs=2e-3)
    got = bits(A.total_bits(A.blending(A.characters(docs), 1, A.uniform_mass(S.SIMPLE_RANGE), 0.1, A.by_fanout([0.7, 0.6, 0.5]))))
    want = expected(lambda: UrnPPM(M.Uniform(S.SIMPLE_RANGE), 1, Blending([0.1], [0.7, 0.6, 0.5], "fanout")), points)
    if isinstance(got, dict):
        by_both = expected(lambda: UrnPPM(M.Uniform(S.SIMPLE_RANGE), 1, _Fanout(0.1, [0.7, 0.6, 0.5])), points)
        assert got == pytest.approx(by_both, abs=2e-3)


class _Fanout(Blending):
    """A constant strength with discounts by fan-out."""

    def _pick(self, table, depth, u):
        return table[min(max(u, 1), len(table)) - 1] if isinstance(table, list) else table


def test_one_exchange_for_a_stack_of_windows(docs):
    plan = A.crp(A.characters(docs), A.uniform_mass(S.SIMPLE_RANGE), 1.0, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_random_bytes_base(spark):
    rows = spark.createDataFrame([(0x41,), (0xE9,), (0x20AC,), (0x1F600,), (0x110000,)], "n int")
    total = sum((b - a + 1) * w for a, b, w in RANDOM_BYTES)
    got = [r["m"] for r in rows.select(A.weighted_mass(F.col("n")).alias("m")).collect()]
    assert got == pytest.approx([w / total for _, _, w in RANDOM_BYTES])


def test_scores_and_grid(spark, docs):
    files = docs.select(F.col("doc_id").cast("string").alias("file"), F.encode("text", "UTF-8").alias("content"))
    rows = score.grid(files, ["ppm2_uniform_byte", "ref_bzip2", "nonsense_x"], paranoid=True).collect()
    assert len(rows) == 12
    assert {r["status"] for r in rows if r["algo"] != "nonsense_x"} == {"ok"}
    assert all(r["csize"] is None and r["status"].startswith("ERROR") for r in rows if r["algo"] == "nonsense_x")
    slow = docs.select(score.score_column(F.col("text"), F.lit("ref_lzma"), timeout=0.0).alias("r")).select("r.status").distinct().collect()
    assert [r["status"] for r in slow] == ["timeout"]


def test_trace_adds_up(docs):
    spec = parse("ppm:d=2", "uniform_byte")
    for r in docs.select("text", score.trace_column(F.col("text"), spec).alias("t")).collect():
        ideal = sum(-math.log2((s["hi"] - s["lo"]) / s["total"]) for s in r["t"])
        assert abs(ideal - score.measure(r["text"].encode(), spec)) <= 2


def test_tables(spark, tmp_path):
    wide = spark.createDataFrame([("f1", 100, "50", "inf"), ("f2", 200, "ERROR: x", None)], "File string, Size int, a string, b string")
    got = {(r["file"], r["algo"]): (r["csize"], r["status"]) for r in tables.unpivot_benchmark(wide).collect()}
    assert got == {("f1", "a"): (50.0, "ok"), ("f1", "b"): (None, "inf"), ("f2", "a"): (None, "ERROR: x"), ("f2", "b"): (None, "missing")}
    long = spark.createDataFrame([("f1", 100, "a", 50.0), ("f1", 100, "b", None)], "file string, size long, algo string, csize double")
    groups = spark.createDataFrame([("c", "f1", 0)], "corpus string, file string, ord int")
    row = tables.corpus_json(long, groups).collect()
    assert json.loads(row[0]["json"]) == {"a": [50], "b": ["fail"]}
    assert tables.javascript(row).startswith("var benchmark_results = {")
    assert "4.000" in tables.console(long.where("csize is not null").collect())
    tables.write_csv(tables.pivot_benchmark(long, ["a", "b"]), str(tmp_path / "out"))
    assert tables.read_csv(spark, str(tmp_path / "out")).columns == ["file", "size", "a", "b"]
    assert tables.latex(long.collect(), ["file", "csize"]).count(r"\\") == 3
    assert "digraph" in tables.context_dot([{"ctx": "a", "sym": "b", "n": 1}])


def test_corpus(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_bytes(b"1\n22\nx")
    (tmp_path / "b.bin").write_bytes(b"\x81")
    assert {r["size"] for r in corpus.files(spark, f"file://{tmp_path}", content=False).collect()} == {6, 1}
    assert corpus.files(spark, f"file://{tmp_path}", "*.bin").count() == 1
    rows = spark.createDataFrame([(1, "1\n22\nx"), (2, None), (3, "")], "id int, t string")
    assert [r["item"] for r in corpus.int_items(rows, "t", "id").orderBy("pos").collect()] == [1, 22]
    assert corpus.char_items(rows, "t", "id").count() == 6
    data = spark.createDataFrame([(1, bytearray(b"\x81"))], "id int, b binary")
    assert [r["item"] for r in corpus.bit_items(data, "b", "id").orderBy("pos").collect()] == [1, 0, 0, 0, 0, 0, 0, 1]
    assert [r["item"] for r in corpus.byte_items(data, "b", "id").collect()] == [0x81]
    html = spark.createDataFrame([("<tr><td>a</td></tr><tr><td>long <b>er</b></td></tr>",)], "h string")
    assert html.select(corpus.longest_row_text(F.col("h")).alias("x")).first()["x"] == "long er"
    assert html.select(corpus.element_texts(F.lit("<sen>a</sen><sen k='1'>b</sen>"), "sen").alias("x")).first()["x"] == ["a", "b"]
    cps = corpus.random_code_points(spark, 1000, 0xD700, 0xE100, 1).agg(F.count("*"), F.min("cp"), F.max("cp"), F.sum(F.col("cp").between(0xD800, 0xDFFF).cast("int"))).first()
    assert cps[0] == 1000 and cps[1] >= 0xD700 and cps[2] <= 0xE100 and cps[3] == 0


def test_sampling(spark):
    rows = spark.createDataFrame([(f"s{i}", i) for i in range(1, 11)], "source string, w int")
    hits = {r["source"]: r["hits"] for r in sampling.systematic(rows, "w", ["source"], 11).collect()}
    assert sum(hits.values()) == 11
    assert sampling.proportional_without_replacement(rows, "w", 4, "source").count() == 4
    assert sampling.reservoir_one(rows, "source").count() == sampling.reservoir_one(rows.limit(1), "source").count() == 1
    draws = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("u"))
    got = {r["source"]: r["count"] for r in sampling.categorical(draws, rows, "source", "w").groupBy("source").count().collect()}
    assert got["s10"] == pytest.approx(1000 * 10 / 55, abs=1.5)
    table = D.AliasSampler(["a", "b", "c"], [1, 2, 5])
    seen = [table.draw((i + 0.5) / 8000) for i in range(8000)]
    assert seen.count("c") == pytest.approx(5000, abs=5)


def test_special_functions(spark):
    x = spark.createDataFrame([(0.3,), (1.0,), (7.5,), (120.0,)], "x double")
    for r in x.select("x", special.log_gamma(F.col("x")).alias("g"), special.digamma(F.col("x")).alias("d")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-10, abs=1e-10)
        h = 1e-5
        assert r["d"] == pytest.approx((math.lgamma(r["x"] + h) - math.lgamma(r["x"] - h)) / (2 * h), rel=1e-5, abs=1e-5)
    assert special.bell(5) == 52 and special.stirling_first(5, 2) == 50 and special.stirling_second(5, 2) == 15
    assert special.lambert_w(1.0) == pytest.approx(0.5671432904097838)
    assert math.gamma(special.inverse_gamma(24.0)) == pytest.approx(24.0)
    assert special.fraction(0.4089775, 4096)[1] <= 4096
    row = x.select(text.human_size(F.lit(1536.0)).alias("s"), text.hex_dump(F.lit(b"\x01\xff")).alias("h"), text.canonical_test(F.lit("t:b=1:a=2")).alias("t")).first()
    assert (row["s"], row["h"], row["t"]) == ("1.5 KB", "01 FF", "t:a=2:b=1")


def test_densities_integrate(spark):
    grid = spark.range(1, 20000).select((F.col("id") / 20000.0).alias("x"))
    total = grid.agg((F.sum(F.exp(D.beta(F.col("x"), F.lit(2.0), F.lit(3.5)))) / 20000).alias("t")).first()["t"]
    assert total == pytest.approx(1.0, abs=1e-3)
    ks = spark.range(0, 61).select(F.col("id").cast("double").alias("k"))
    assert ks.agg(F.sum(F.exp(D.binomial(F.col("k"), F.lit(60.0), F.lit(0.4)))).alias("t")).first()["t"] == pytest.approx(1.0)
    row = spark.range(1).select(D.dirichlet_marginal(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("m")).first()
    assert math.exp(row["m"]) == pytest.approx(0.5)
    assert len(D.fake_words(50, 1)) == 50


def test_histograms(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "sym string")
    got = H.totals(H.of_symbols(rows)).first()
    assert (got["total"], got["distinct"], round(got["entropy"], 6)) == (4, 3, 1.5)
    assert {r["n"]: r["bins"] for r in H.inverted(H.of_symbols(rows)).collect()} == {2: 1, 1: 2}
    assert H.extreme_symbols(H.of_symbols(rows), least=True).count() == 2
    lo_hi = [(r["lo"], r["hi"], r["total"]) for r in H.cumulative(H.of_symbols(rows), "sym").orderBy("sym").collect()]
    assert lo_hi == [(0, 2, 4), (2, 3, 4), (3, 4, 4)]
    assert H.totals(H.of_symbols(rows.limit(0))).first()["total"] is None


def test_search(spark):
    point, value, status = search.simplex(lambda x: (x[0] - 0.3) ** 2 + (x[1] + 0.2) ** 2, (0.0, 0.5), tolerance=1e-10)
    assert point == pytest.approx((0.3, -0.2), abs=1e-3)
    x, _ = search.conjugate_gradient(lambda v: (v[0] - 1) ** 2 + 10 * (v[1] - 2) ** 2, lambda v: [2 * (v[0] - 1), 20 * (v[1] - 2)], [0.0, 0.0])
    assert x == pytest.approx([1.0, 2.0], abs=1e-3)
    files = spark.createDataFrame([("abcabcabcabd" * 5,), ("hello hello hello",)], "content string")
    grid = search.contour(spark, files, "uniform_byte", 2, (-0.5, 0.5), (0.0, 1.0), 3)
    rows = {(r["alpha"], r["beta"]): r["efficiency"] for r in grid.collect()}
    assert len(rows) == 9 and rows[(-0.5, 0.0)] == math.inf and rows[(0.0, 0.5)] < 8
    assert value < 1e-6 and status == "ok"


def test_cache_scores_only_what_is_missing(spark, tmp_path):
    from quillbit.plans import cache

    path = f"file://{tmp_path}/cache"
    files = spark.createDataFrame([("f1", "aaaa"), ("f2", "bbbb"), ("f3", "aaaa")], "file string, content string")
    first = cache.complete(files.where("file <> 'f2'"), ["ref_gzip", "bad_name"], path).collect()
    assert len(first) == 4 and cache.stored(spark, path).count() == 2
    todo = cache.missing(cache.work_list(files, ["ref_gzip", "bad_name"]), cache.stored(spark, path))
    assert sorted(r["file"] for r in todo.collect()) == ["f2", "f2"]
    again = cache.missing(cache.work_list(files, ["ref_gzip", "bad_name"]), cache.stored(spark, path), rerun_errors=True)
    assert again.count() == 4
    assert {r["status"] for r in cache.complete(files, ["ref_gzip"], path).collect()} == {"ok"}
    assert cache.renamed(cache.stored(spark, path), "ref_", "x_").where("algo = 'x_gzip'").count() == 2


def test_generators(spark):
    from quillbit.operators import generate

    spec = parse("ppm:d=2", "uniform_byte")
    assert generate.generate(spec, 50, 1) == generate.generate(spec, 50, 1)
    train = list(b"abababababababab")
    assert bytes(generate.friendly(spec, 4, [97, 98, 99], train)) == b"abab"
    assert 99 in generate.adversarial(spec, 3, [97, 98, 99], train)
    rows = generate.entropies(spec, train, [97, 98, 99])
    assert rows[0] == pytest.approx(2.0) and rows[-1] < 1.5
    assert generate.train_then_measure(spec, train, train) < score.measure(bytes(train), spec)
    assert generate.generated(spark, spec, 3, 10).count() == 3
    assert spark.createDataFrame([("abba",)], "t string").select(score.ranks_column(F.col("t")).alias("r")).first()["r"] == [97, 98, 0, 1]
