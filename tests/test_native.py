import pytest

from pyspark.sql import functions as F

from quillbit.operators import counting, generate, native
from quillbit.operators.coder import BitCounter
from quillbit.plans import catalog, score
from quillbit.plans.spec import parse

TEXTS = [b"", b"a", b"abracadabra " * 20, "naïve 😀 ключ κόσμε".encode() * 3, bytes(range(256)), b"\xed\xa0\x80\xc0\xaf\xff\xf4\x90\x80\x80\xe2\x82" * 4, bytes(i * i * 7 % 251 for i in range(1500))]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, bytearray(t)) for i, t in enumerate(TEXTS)] + [(len(TEXTS), None)]
    return spark.createDataFrame(rows, "i int, t binary").repartition(2).cache()


def python_only(monkeypatch):
    """Fails where a model codes symbol by symbol in Python."""
    for name in ("compress", "decompress", "encode_with"):
        monkeypatch.setattr(score, name, None)


def same_as_python(texts, layer, base):
    spec = parse(layer, base)
    packed = native.column(texts["t"], "pack", spec)
    columns = [native.column(texts["t"], "check", spec).alias("c"), packed.alias("p"), native.column(packed, "unpack", spec).alias("u")]
    for r in texts.select("i", *columns).collect():
        text = TEXTS[r["i"]] if r["i"] < len(TEXTS) else b""
        assert bytes(r["p"]) == score.compress(text, spec)
        assert bytes(r["u"]) == text
        assert r["c"]["same"] and r["c"]["bits"] == score.measure(text, spec) and abs(r["c"]["bits"] - r["c"]["ideal"]) <= 3


@pytest.mark.parametrize("layer,base", [("ppm:d=5", "uniform_byte"), ("ppm:d=0", "uniform_byte"), ("ppm:d=3:a=0.1:b=0.4", "uniform_stoken")])
def test_ppm_is_that_of_python(texts, layer, base):
    same_as_python(texts, layer, base)


def test_sizes_need_no_python(texts, monkeypatch):
    python_only(monkeypatch)
    found = score.checked_column(texts["t"], parse("ppm:d=5", "uniform_byte"))
    assert texts.select(found.alias("c")).where("c.same").count() == len(TEXTS) + 1


def test_other_stacks_stay_in_python():
    assert native.arguments(parse("crp:a=1:b=0", "uniform_byte")) is None
    assert native.arguments(parse("ppm:d=2", "categorical_token")) is None


def test_ppm_over_a_tree_is_that_of_python(texts):
    same_as_python(texts, "ppm:d=4:a=0.0001973:b=0.5131823", "polya_stoken_uniform_byte")
    same_as_python(texts, "ppm:d=2", "polya_byte")


@pytest.mark.parametrize("layer,base", [("lzwEscape", "polya_stoken_uniform_byte"), ("lzwEscape", "uniform_byte"), ("lzw", "uniform_byte"), ("none", "lzw_byte")])
def test_lzw_is_that_of_python(texts, layer, base):
    same_as_python(texts, layer, base)


def test_round_trip_needs_no_python(texts, monkeypatch):
    python_only(monkeypatch)
    spec = parse("ppm:d=3", "uniform_stoken")
    back = score.decompress_column(score.compress_column(texts["t"], spec), spec)
    assert texts.where(F.coalesce("t", F.expr("X''")) == back).count() == len(TEXTS) + 1


def test_entropies_are_those_of_python(texts):
    spec, alphabet = parse("ppm:d=1", "uniform_byte"), list(range(32, 127))
    found = texts.where("i < 6 AND i <> 4").select("i", generate.entropies_column(F.col("t"), spec, alphabet).alias("e"))
    assert "Python" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        assert r["e"] == pytest.approx(generate.entropies(spec, list(TEXTS[r["i"]]), alphabet), abs=1e-9)


def test_grid_by_the_kernel_has_the_sizes_of_python(texts):
    files = texts.select(F.col("i").cast("string").alias("file"), F.col("t").alias("content"))
    both = [score.grid(files, ["ref_gzip", "ppm2_uniform_byte", "lzw_uniform_byte"], paranoid=True, replications=2, kernel=k) for k in (True, False)]
    columns = ["file", "size", "algo", "replication", "csize", "status", "bits_per_byte"]
    assert sorted(both[0].select(columns).collect()) == sorted(both[1].select(columns).collect())
    assert both[0].where("wall > 0 AND cpu >= 0 AND memory > 0 AND grown >= 0").count() == 6 * (len(TEXTS) + 1)


@pytest.mark.parametrize("layer,base", [("ppm:d=2", "uniform_byte"), ("ppm:d=2", "polya_stoken_uniform_byte"), ("crp:a=1:b=0.25", "uniform_byte")])
def test_regions_are_those_of_the_trace(texts, layer, base):
    spec = parse(layer, base)
    steps = F.forall("t", lambda s: (s["lo"] >= 0) & (s["lo"] < s["hi"]) & (s["hi"] <= s["total"]))
    found = texts.select(score.regions_column(F.col("t"), spec).alias("r"), score.trace_column(F.col("t"), spec).alias("t"))
    assert found.where((F.col("r.steps") == F.size("t")) & (F.col("r.inside") == steps)).count() == len(TEXTS) + 1


def test_regions_outside_are_noted():
    coder = score.Checking(BitCounter())
    coder.narrow(0, 2, 4)
    assert coder.inside
    coder.narrow(1, 5, 4)
    assert (coder.steps, coder.inside) == (2, False)


def test_coder_trace_needs_no_python(spark, tmp_path):
    rows = [(i, t.decode("utf-8", "replace")) for i, t in enumerate(TEXTS)] + [(len(TEXTS), None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.coder_trace(spark, str(tmp_path))
    assert "Python" not in found._jdf.queryExecution().toString()
    assert sorted(found.collect()) == [(i, len((t or "").encode()), True, True) for i, t in rows]


@pytest.mark.parametrize("layer", ["crp:a=1:b=0", "crp:a=1:b=0.25", "crp:a=0.3:b=0.5", "crp:a=1000000000:b=0.5"])
def test_restaurants_are_those_of_python(texts, layer):
    same_as_python(texts, layer, "uniform_stoken")


def test_a_restaurant_of_many_dishes(spark):
    text, spec = "".join(chr(0x4E00 + i * i * i % 2999) for i in range(5000)), parse("crp:a=1:b=0.5", "uniform_stoken")
    found = spark.createDataFrame([(text,)], "t string").select(native.column(F.col("t"), "check", spec).alias("c"), native.column(F.col("t"), "pack", spec).alias("p")).first()
    assert bytes(found["p"]) == score.compress(text.encode(), spec) and found["c"]["same"]


def test_totals_beyond_the_kernel_stay_in_python():
    assert native.arguments(parse("crp:a=1:b=0", "uniform_stoken")) is not None
    assert native.arguments(parse("crp:a=1:b=0.123456", "uniform_stoken")) is None


def test_size_crp_is_one_exchange_and_a_row_for_each_key(spark, tmp_path):
    rows = [(i, t.decode("utf-8", "replace")) for i, t in enumerate(TEXTS)] + [(2, "cadabra"), (2, "ключ"), (3, "z" * 200), (90, None)]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.size_crp(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    ideal = {r["doc_id"]: (r["n_symbols"], r["bits"]) for r in catalog.bits_crp(spark, str(tmp_path)).collect()}
    assert sorted(found.collect()) == [(i, *ideal[i], True) for i in range(1, len(TEXTS))]
    n = sum(len(t or "") for i, t in rows if i == 2)
    assert ideal[2][0] == n


def test_merged_texts_are_in_the_order_of_streams(spark):
    texts = ["naïve 😀", "abc", "κόσμε und mehr"]
    found = spark.createDataFrame([(texts,), (texts[:1],)], "t array<string>").select(counting.merged(F.col("t")).alias("m")).collect()
    assert [list(map(ord, r["m"])) for r in found] == [counting.Stream([[counting.code_points(x) for x in t]]).sym.tolist() for t in (texts, texts[:1])]
