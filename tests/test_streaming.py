import pytest
from pyspark.sql import functions as F

from quillbit.plans.score import measure
from quillbit.plans.spec import parse
from quillbit.streaming import scorer


def run(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


@pytest.fixture()
def stream(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(1, "a", "abab", "2024-01-01 00:00:00"), (2, "a", "abab", "2024-01-01 00:01:00"), (3, "b", "zz", "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "doc_id int, k string, text string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stateless_scores(stream):
    spec = parse("ppm:d=2", "uniform_byte")
    got = {r["doc_id"]: r["bits"] for r in run(scorer.scored(stream, spec), "scored")}
    assert got == {1: measure(b"abab", spec), 2: measure(b"abab", spec), 3: measure(b"zz", spec)}


def test_windowed_bits(stream):
    got = run(scorer.windowed_bits(stream, parse("none", "uniform_byte"), "at"), "windows", "complete")
    assert sorted(r["documents"] for r in got) == [1, 2]


def test_model_of_a_key_learns_on(stream):
    got = {r["key"]: r for r in run(scorer.keyed_crp(stream, "k"), "keyed")}
    assert got["a"]["documents"] == 2 and got["a"]["symbols"] == 8
    assert got["a"]["bits"] < 4 * 20.1 + 8
