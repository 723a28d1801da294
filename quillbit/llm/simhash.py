"""SimHash near-duplicates by multi-index hashing.

A text is lower-cased (A-Z only), cut into words ``[^\\x20\\x09-\\x0D]+`` and
word shingles (repeats included). Every shingle's XXH64 (UTF-8, seed 42) votes on
64 bits; a bit of the fingerprint is set when more than half of the hashes set it.
Texts are linked when their fingerprints differ in at most two bits, and a component is labelled by the smallest ``doc_id`` in it.

Plan. Equal fingerprints collapse first, so a group of copies of any size is one
row. Distinct fingerprints are indexed by two 32-bit segments. If two fingerprints
differ in at most two bits, either the first segments differ in at most one bit or
the second segments are equal, so probing a ball of radius one in the first table
and of radius zero in the second finds every pair; candidates are verified by the
whole distance. Buckets that hold more than ``bucket_cap`` fingerprints (and what
probes them) are not joined: those fingerprints are linked exactly through balls of
radius one over both segments, where sharing a ball point is the same as being at
most two bits apart, so the work stays linear and no pair is lost.

Defined results: null text counts as empty; a text without words has fingerprint
zero and is linked like any other; repeated rows keep one output row each; a null
``doc_id`` is kept and takes part with label null only if its whole component is
null; extra input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.components import connected_components
from quillbit.llm.near import numbered, survivors
from quillbit.plans.storage import materialise, small_side

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Rows of a hash matrix that are unpacked to bits at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash of one text, as a signed integer for Spark's BIGINT."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ends = len(words) - size + 1
    if ends <= 1:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        block = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprint_column(text: F.Column, size: int = 3) -> F.Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return run(text)


def _balls(fp: F.Column, bits: range) -> F.Column:
    """fp and fp with each one of ``bits`` flipped."""
    return F.array(fp, *(fp.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in bits))


def _segments(fp: F.Column) -> list[F.Column]:
    return [F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))]


def hamming_links(fps: DataFrame, bucket_cap: int = 64) -> DataFrame:
    """Links (a, b) whose closure joins exactly the distinct ``fp`` at most two bits apart."""
    first, second = _segments(F.col("fp"))
    table = fps.select(
        "fp", F.posexplode(F.array(first, second)).alias("seg", "val")
    )
    # a pair that differs in one bit of the first segment is found from the side that has a 0 there
    ball = F.array_append(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), F.lit(31)),
                lambda i: F.expr("shiftrightunsigned(fp, 32)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0,
            ),
            lambda i: F.expr("shiftrightunsigned(fp, 32)").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
        ),
        first,
    )
    probes = fps.select("fp", F.lit(0).alias("seg"), F.explode(ball).alias("val")).unionByName(
        fps.select("fp", F.lit(1).alias("seg"), second.alias("val"))
    )
    sizes = table.groupBy("seg", "val").agg(F.count("*").alias("n"))
    crowded = materialise(sizes.where(F.col("n") > bucket_cap).select("seg", "val"), "crowded")
    hot_keys = small_side(crowded)
    cool_probes = probes.join(hot_keys, ["seg", "val"], "left_anti")
    cool_table = table.join(hot_keys, ["seg", "val"], "left_anti")
    pairs = (
        cool_probes.withColumnRenamed("fp", "a")
        .join(cool_table.withColumnRenamed("fp", "b"), ["seg", "val"])
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )
    hot = probes.join(hot_keys, ["seg", "val"], "left_semi").select("fp").distinct()
    points = hot.select("fp", F.explode(_balls(F.col("fp"), range(64))).alias("point"))
    centres = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(centres, "point").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, bucket_cap: int = 64
) -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``."""
    prints = materialise(docs.select(F.col(key).alias("key"), fingerprint_column(F.col(text), size).alias("fp")), "prints")
    groups = materialise(prints.groupBy("fp").agg(F.min("key").alias("low")), "fingerprints")
    links = materialise(hamming_links(groups.select("fp"), bucket_cap), "links")
    parts = connected_components(links)
    labels = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    lows = labels.groupBy("root").agg(F.min("low").alias("component_id"))
    final = materialise(labels.join(lows, "root").select("fp", "component_id"), "components")
    return prints.join(small_side(final), "fp").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component of ``docs``: smallest key, then text digest, then row number."""
    rows, names = numbered(docs)
    prints = materialise(rows.select("__row", fingerprint_column(F.col(names[text])).alias("fp")), "prints")
    groups = materialise(prints.select("fp").distinct(), "fingerprints")
    parts = connected_components(materialise(hamming_links(groups), "links"))
    labels = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"))
    parts = prints.join(small_side(materialise(labels, "labels")), "fp").select("__row", "component")
    return survivors(rows, parts, names[text], names[key]).toDF(*docs.columns)
