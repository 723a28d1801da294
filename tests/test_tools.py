"""Tables of masses, kept counts, experiments, the command line, limits of time, and intermediate tables."""

import io
import math
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillbit import cli
from quillbit.operators import coder as C
from quillbit.operators import histogram as H
from quillbit.operators import protocol, sampling, search
from quillbit.operators import sequential as M
from quillbit.operators.discrete import Table
from quillbit.operators.urns import TableIndices, UrnPPM, from_parameters
from quillbit.plans import experiments, persist, score, storage
from quillbit.plans.spec import named, parse, tuned
from quillbit.sources import tables


def through_the_coder(make, symbols):
    """What comes back of symbols coded by a model, and the bits."""
    sink = C.BitBuffer()
    enc, model = C.Encoder(sink), make()
    for x in symbols:
        model.encode(x, enc)
        model.learn(x)
    enc.finish()
    dec, model, out = C.Decoder(bytes(sink)), make(), []
    for _ in symbols:
        out.append(model.decode(dec))
        model.learn(out[-1])
    return out, sink.n


def test_tables():
    t = Table({"a": 1, "b": 2, "c": 1})
    assert t.mass("b") == 0.5 and t.mass("z") == 0 and t.cumulative("b") == (0.25, 0.75)
    assert [t.find(u) for u in (0, 0.25, 0.74, 0.99)] == ["a", "b", "b", "c"]
    assert t.without(["b"]).mass("a") == 0.5 and t.inverted().mass("b") == pytest.approx(0.2)
    assert t.having("z", 0.5).mass("b") == 0.25 and t.having("b", 0).mass("a") == 0.5
    assert t.sample(random.Random(1), ["a", "b"]) == "c" and Table.uniform("xy").mass("x") == 0.5
    for bad in ({}, {"a": 0}, {"a": -1, "b": 3}):
        with pytest.raises(ValueError):
            Table(bad)
    said = list("abacabba" * 5)
    assert through_the_coder(lambda: t, said)[0] == said


def test_models_without_a_coder_get_one():
    rng = random.Random(2)
    symbols = [rng.choice([1, 1, 1, 2, 5]) for _ in range(300)]
    for text in ("t=b:d=2:a=0.1:b=0.5", "t=b:d=2:a=0.5,0.1:b=0.6,0.4", "t=u:d=1:a=0.1:b=0.7,0.5", "t=m:d=1:a=0,0/0.1,0.2:b=0.5,0.4/0.3,0.2", "t=x:d=2", "t=g:d=1:n=3:a=0.1"):
        model = from_parameters(M.Uniform(7), text)
        assert isinstance(model, protocol.Model) and not isinstance(model, protocol.Coded)
        back, bits = through_the_coder(lambda t=text: protocol.coded(from_parameters(M.Uniform(7), t), range(7)), symbols)
        assert back == symbols
        assert abs(bits - from_parameters(M.Uniform(7), text).bits(symbols)) < 3
    assert isinstance(protocol.coded(M.Uniform(7), range(7)), M.Uniform)
    with pytest.warns(UserWarning, match="unknown"):
        from_parameters(M.Uniform(7), "t=b:colour=red")


def test_table_indices():
    rng = random.Random(3)
    seats, n = [], 0
    for _ in range(200):
        seats.append(rng.randrange(min(n + 1, 5)))
        n = max(n, seats[-1] + 1)
    back, bits = through_the_coder(lambda: TableIndices(Fraction(1, 2), Fraction(1, 4)), seats)
    model, ideal = TableIndices(Fraction(1, 2), Fraction(1, 4)), 0.0
    for k in seats:
        ideal -= math.log2(model.mass(k))
        model.learn(k)
    assert back == seats and abs(bits - ideal) < 3


@pytest.mark.parametrize("base", [lambda: M.Uniform(257), lambda: M.PolyaTree(257, *M.even_priors(Fraction(1, 2))), lambda: M.Weighted([(0, 99, 5), (100, 256, 2)])])
@pytest.mark.parametrize("a,b", [(1, 0), (Fraction(1, 4), Fraction(1, 2)), (Fraction(7, 131071), Fraction(65537, 131072))])
def test_the_restaurant_codes_its_masses(base, a, b):
    rng = random.Random(4)
    symbols = [min(int(rng.expovariate(0.05)), 256) for _ in range(400)]

    def make():
        bottom = base()
        model = M.CRP(bottom, Fraction(a), Fraction(b))
        learn = model.learn
        model.learn = lambda x: (learn(x), bottom.learn(x))
        return model

    back, bits = through_the_coder(make, symbols)
    ideal, model = 0.0, make()
    for x in symbols:
        ideal -= math.log2(model.mass(x))
        model.learn(x)
    assert back == symbols and abs(bits - ideal) < 3


def test_kept_counts_go_on(spark, tmp_path):
    data = b"the cat sat on the mat"
    for make in (lambda: M.PPM(M.Uniform(257), 3), lambda: M.CRP(M.Uniform(257), Fraction(1), Fraction(1, 4))):
        model = make()
        for x in data:
            model.learn(x)
        path = str(tmp_path / type(model).__name__)
        persist.counts(spark, model).write.parquet(path)
        again = persist.restore(spark.read.parquet(path), make())
        if isinstance(model, M.PPM):
            model.at = model.root
        for x in b"the hat":
            costs = []
            for m in (model, again):
                coder = C.Encoder(C.BitCounter())
                coder.trace = []
                m.encode(x, coder)
                costs.append(sum(math.log2(t / (hi - lo)) for lo, hi, t in coder.trace))
                m.learn(x)
            assert costs[0] == pytest.approx(costs[1])
    text = tables.context_dot(persist.edges(persist.counts(spark, M.PPM(M.Uniform(3), 1))).collect())
    assert text.startswith("digraph")


def test_tuned_names():
    rows = [{"prior": "uniform_byte", "depth": d, "alpha": 0.1, "beta": 0.4, "mean_efficiency": e} for d, e in ((4, 2.1), (5, 2.0), (6, 2.0))]
    found = tuned(rows, "training")
    assert found["ppm_training_group_opt_uniform_byte"] == found["ppm_training_group_5_uniform_byte"] == "ppm:d=5:a=0.1:b=0.4/uniform_byte"
    every = experiments.algorithms({"training": rows})
    assert {"ppm_training_group_opt_uniform_byte", "ref_gzip", "lzw_polya_token", "none_lzw_byte"} <= set(every)
    for spec in every.values():
        assert spec.startswith("ref_") or "/" in spec or named(spec)


def test_experiments(spark):
    files = spark.createDataFrame([("a", b"abracadabra " * 8), ("b", b"the cat the hat " * 6), ("c", b"")], "file string, content binary")
    small = {"depths": (1, 2), "steps": 3}
    by_depth = experiments.run("optimal_by_depth", spark, files, **small).collect()
    assert [r["depth"] for r in by_depth] == [1, 2] and all(math.isfinite(r["efficiency"]) for r in by_depth)
    best = experiments.run("optimal", spark, files, **small).first()
    assert best["efficiency"] == min(r["efficiency"] for r in by_depth)
    grid = experiments.run("contour_plot", spark, files, depth=2, steps=3).where("efficiency < 1e9").agg(F.min("efficiency")).first()[0]
    assert min(r["efficiency"] for r in by_depth if r["depth"] == 2) <= grid + 1e-9
    steps = experiments.run("grid_steps", spark, files, depth=1, steps=(0, 3)).collect()
    assert {r["steps"] for r in steps} == {0, 3}
    done = experiments.run("benchmark", spark, files, names=["none_lzw_byte", "ref_gzip", "ppm4_uniform_byte"]).collect()
    assert len(done) == 9 and {r["status"] for r in done} == {"ok"}
    used = experiments.run("resources", spark, files, names=["ref_gzip"], replications=3).collect()
    assert {r["measure"] for r in used} == {"wall", "cpu", "memory"}
    assert experiments.run("bases", spark, files.where("file = 'a'")).count() == 11
    with pytest.raises(ValueError, match="no experiment"):
        experiments.run("nothing", spark, files)


def test_gradient_search_of_an_urn():
    data = list(b"abracadabra simsalabim " * 6)
    start = UrnPPM(M.Uniform(257), 2, from_parameters(M.Uniform(257), "t=b:a=0:b=0.5").urn).bits(data)
    found = search.tuned_urn(data, M.Uniform(257), 2)
    assert found["bits"] < start and 0 < found["beta"] < 1 and found["alpha_error"] > 0


def test_one_copy_of_a_text_meets_all_algorithms(spark):
    files = spark.createDataFrame([(f"f{i}", b"text " * 50) for i in range(4)], "file string, content binary")
    plan = score.grid(files, ["ref_gzip", "lzw_uniform_byte", "none_uniform_byte"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange"), "texts are moved before they meet the algorithms"
    assert plan.count("Exchange ") == 1


def test_time_limits_stop():
    began = time.perf_counter()
    slow = score.score(bytes(range(256)) * 4000, "ppm5_uniform_byte", timeout=0.2)
    assert slow[2] == "timeout" and slow[0] is None and time.perf_counter() - began < 3
    assert score.score(b"abc", "ppm5_uniform_byte", True, 20)[2] == "ok"
    assert score.score(None, "ref_gzip", True)[2] == "ok" and score.score(b"", "nothing")[2].startswith("ERROR")


def run_cli(line, data=b""):
    out = io.BytesIO()
    assert cli.run(line.split(), io.BytesIO(data), out) == 0
    return out.getvalue()


def test_command_line(tmp_path):
    data = "naïve 😀 text, naïve text".encode() + b"\xff"
    stack = "--layer ppm:d=3 --base polya_stoken"
    packed = run_cli(f"compress {stack}", data)
    assert run_cli(f"decompress {stack}", packed) == data
    assert -(-int(run_cli(f"measure {stack}", data)) // 8) == len(packed)
    file = tmp_path / "x"
    file.write_bytes(data)
    assert run_cli(f"compress {stack} {file}") == packed
    assert run_cli("tokens --alphabet simple", b"a\xff") == b"UnicodeCharacter(61)\nIllegalByte(FF)\n"
    assert run_cli("tokens --show identity", data) == data
    served = run_cli("serve", f"measure {file}\nmeasure --base nothing {file}\nmeasure {file}\n".encode()).splitlines()
    assert served[0] == served[2] and served[1].startswith(b"error")


def test_ties_and_exclusions(spark):
    hist = spark.createDataFrame([("x", 3), ("y", 3), ("z", 1)], "sym string, n long")
    assert H.extreme_symbols(hist).count() == 2 and H.extreme_symbols(hist, ties="first").first()["sym"] == "x"
    assert H.extreme_symbols(hist, ties="random", seed=1).count() == 1
    draws = spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u"))
    got = {r["sym"]: r["count"] for r in sampling.categorical(draws, hist, "sym", "n", omit=["x"]).groupBy("sym").count().collect()}
    assert got == {"y": 300, "z": 100}
    with pytest.raises(ValueError):
        sampling.categorical(draws, hist, "sym", "n", omit=["x", "y", "z"])


def test_intermediate_tables(spark):
    held = storage.materialise(spark.range(1000).select("id", F.lit("x" * 100).alias("t"), F.array("id").alias("a")), "held")
    assert storage.row_bytes(held) > 1000 * 100 > storage.stored_bytes(held)
    assert "broadcast" in storage.small_side(held)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in storage.small_side(held, limit=50_000)._jdf.queryExecution().logical().toString().lower()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    with storage.smaller_batches(spark):
        assert spark.conf.get(key) == "1000"
    assert spark.conf.get(key, None) == before
    storage.drop(held)
    with pytest.raises(Exception, match="(?i)exist|find"):
        held.count()


def test_specification_of_layers_in_full():
    pack, unpack = score.codec("ppm:d=2:a=0.1:b=0.4/polya_byte")
    assert unpack(pack(b"abcabc")) == b"abcabc" and str(parse("ppm:d=2", "polya_byte")) == "ppm:d=2/polya_byte"
