import random

import pytest
from pyspark.sql import functions as F

from quillbit.functions import symbols as S
from quillbit.plans import catalog, fixtures


def spell(tokens):
    names = {"char": "UnicodeCharacter(%X)", "surrogate": "SurrogateCodePoint(%X)", "too_high": "TooHigh(%X)", "illegal": "IllegalByte(%02X)"}
    return " ".join(f"Overlong({t[1]:X}, {t[2]})" if t[0] == "overlong" else names[t[0]] % t[1] for t in tokens)


@pytest.mark.parametrize("data,detailed,simple", fixtures.MALFORMED)
def test_literals(data, detailed, simple):
    raw = bytes.fromhex(data)
    assert spell(S.decode_detailed(raw)) == detailed
    assert spell(S.decode_simple(raw)) == simple
    assert S.encode_tokens(S.decode_detailed(raw)) == raw
    assert S.encode_tokens(S.decode_simple(raw)) == raw


def test_stray_and_impossible_bytes():
    stray = bytes(range(0x80, 0xC0))
    assert [t[0] for t in S.decode_detailed(stray)] == ["illegal"] * 64
    heads = b"".join(bytes([b, 0x20]) for b in range(0xC0, 0xFE))
    assert S.encode_tokens(S.decode_simple(heads)) == heads
    assert [t[0] for t in S.decode_simple(heads)] == ["illegal", "char"] * 62


def test_random_bytes_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.choice((rng.randrange(256), 0xF0, 0xE0, 0x80, 0x41)) for _ in range(rng.randrange(40)))
        assert S.encode_tokens(S.decode_detailed(raw)) == raw
        assert S.encode_tokens(S.decode_simple(raw)) == raw


def test_ranges():
    assert S.SIMPLE_RANGE == 1_114_241
    assert S.DETAILED_RANGE == 2_164_993
    assert S.OVERLONG == 67_712


def test_numbers_are_a_bijection(spark):
    rows = spark.range(S.DETAILED_RANGE).select(F.col("id").cast("int").alias("n")).withColumn("p", S.detailed_parts(F.col("n")))
    wrong = rows.where(~S.detailed_number(F.col("p.kind"), F.col("p.cp"), F.col("p.len")).eqNullSafe(F.col("n")))
    assert wrong.count() == 0
    simple = spark.range(S.SIMPLE_RANGE).select(F.col("id").cast("int").alias("n"))
    kind = S.simple_kind(F.col("n"))
    cp = F.when(kind == "illegal", S.simple_index(F.col("n")) + 0x80).otherwise(S.simple_index(F.col("n")))
    assert simple.where(~S.simple_number(kind, cp).eqNullSafe(F.col("n"))).count() == 0


def test_columns(spark):
    text = "aé€😀\x00z"
    row = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(
        S.code_points(F.col("t")).alias("c"), S.octets(F.col("t")).alias("o")
    ).collect()
    assert row[0]["c"] == [ord(c) for c in text]
    assert row[0]["o"] == list(text.encode())
    assert row[1]["c"] == row[2]["c"] == row[1]["o"] == []
    points = spark.createDataFrame([(ord(c),) for c in text], "cp int")
    for r in points.select("cp", S.utf8_hex(F.col("cp")).alias("h"), S.octet_width(F.col("cp")).alias("w")).collect():
        assert r["h"] == chr(r["cp"]).encode().hex().upper()
        assert r["w"] == len(chr(r["cp"]).encode())


def test_recoding_holds_no_column_of_tokens(spark, tmp_path):
    texts = ["a", "é漢😀", "", None, "\0x" * 50]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["roundtrip_utf8"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(3, 0)]
    assert "recode(" in got._jdf.queryExecution().toString()
    hexes = spark.createDataFrame([(h,) for h, _, _ in fixtures.MALFORMED], "hex string").withColumn("d", F.unhex("hex"))
    assert hexes.select(S.recoded_column(F.col("d")).alias("r"), S.encode_column(S.decode_column(F.col("d"))).alias("e")).where("NOT r <=> e").count() == 0
