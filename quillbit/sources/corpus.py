"""Corpora: files as rows, enumeration and filters, items of a text, and generated texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, glob: str | None = None, content: bool = True) -> DataFrame:
    """(file, size[, content]) of every file below ``path``; without content only names and sizes are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    found = reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("size"), "content")
    return found if content else found.drop("content")


def like_glob(name: Column, pattern: str) -> Column:
    """Whether a name matches a shell pattern of ``*`` and ``?`` (``*`` stops at ``/``)."""
    special = set(".^$+{}[]()|\\")
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in special else c for c in pattern)
    return name.rlike(f"^{body}$")


def any_glob(name: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | like_glob(name, p)
    return out


def include_exclude(rows: DataFrame, name: str, include: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Rows whose name matches an include pattern and no exclude pattern, in order of name."""
    c = F.col(name)
    return rows.where(any_glob(c, include) & ~any_glob(c, exclude or [])).orderBy(name)


def regex_filter(rows: DataFrame, name: str, patterns: list[str], exclude: list[str] | None = None) -> DataFrame:
    """Rows whose name begins like one of ``patterns`` and like none of ``exclude``."""
    keep, drop = F.lit(False), F.lit(False)
    for p in patterns:
        keep = keep | F.col(name).rlike(f"^(?:{p})")
    for p in exclude or []:
        drop = drop | F.col(name).rlike(f"^(?:{p})")
    return rows.where(keep & ~drop).orderBy(name)


def byte_items(rows: DataFrame, data: str, key: str) -> DataFrame:
    """(key, pos, item) for every byte of a BINARY column."""
    digits = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    return rows.select(key, F.posexplode(digits).alias("pos", "h")).select(key, "pos", F.conv("h", 16, 10).cast("int").alias("item"))


def bit_items(rows: DataFrame, data: str, key: str) -> DataFrame:
    """(key, pos, item) for every bit, the highest of a byte first."""
    one = byte_items(rows, data, key)
    bits = F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda s: F.call_function("shiftright", F.col("item"), s).bitwiseAND(1))
    return one.select(key, "pos", F.posexplode(bits).alias("k", "bit")).select(key, (F.col("pos") * 8 + F.col("k")).alias("pos"), F.col("bit").alias("item"))


def char_items(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, pos, item) for every character."""
    return rows.where(F.length(text) > 0).select(key, F.posexplode(F.split(text, "")).alias("pos", "item"))


def line_items(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, pos, item) for every line."""
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "item"))


def int_items(rows: DataFrame, text: str, key: str) -> DataFrame:
    """(key, pos, item) for every line that is an integer."""
    return line_items(rows, text, key).withColumn("item", F.expr("try_cast(trim(item) AS INT)")).where("item is not null")


def longest_row_text(html: Column) -> Column:
    """The longest text of a table row of a page, tags removed."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    texts = F.transform(rows, lambda r: F.trim(F.regexp_replace(F.regexp_replace(r, "<[^>]*>", " "), r"\s+", " ")))
    return F.aggregate(texts, F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best))


def element_texts(xml: Column, tag: str) -> Column:
    """The texts of all elements of one tag."""
    return F.regexp_extract_all(xml, F.lit(f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))


def random_code_points(spark: SparkSession, n: int, start: int, stop: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(pos, cp) of ``n`` code points drawn uniformly from start..stop, surrogates left out."""
    gap = max(0, min(stop, 0xDFFF) - max(start, 0xD800) + 1)
    width = stop - start + 1 - gap
    drawn = spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).select(
        F.col("id").alias("pos"), (F.floor(F.rand(seed) * width).cast("int") + start).alias("at")
    )
    # drawn from a range without the gap, then moved past it
    cp = F.when(F.col("at") >= max(start, 0xD800), F.col("at") + gap).otherwise(F.col("at")) if gap else F.col("at")
    return drawn.select("pos", cp.alias("cp"))


def text_of_code_points(cps: Column) -> Column:
    """A text from an array of code points."""

    @F.pandas_udf("string")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(["".join(map(chr, r)) for r in rows])

    return join(cps)
