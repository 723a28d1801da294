"""Sharding by rendezvous hashing of stable record keys over weighted shards.

A record goes to the shard with the highest score ``-weight / ln(u)``, ``u`` being a
hash of (key, shard) in (0, 1). Only the key and the shard decide, so adding a shard
moves records into it alone, in proportion to its weight, and a record never changes
place because of others. Copies of one text under different keys spread like any
other records.

``slot`` numbers the rows of a shard from 0 without gaps, in the order of key, size
and checksum: rows are ranged over (shard, key, ...) with a tie breaker, so no shard
and no repeated key has to fit one task; each range counts its rows for each shard
and a table of one row for each range and shard holds the offsets.

Defined results: null text has no bytes (size 8, checksum 0); a null key is a key of
its own; repeated rows go to one shard and get slots of their own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbit.plans.storage import materialise

#: Bytes of a record besides its text.
OVERHEAD = 8


def rendezvous(key: F.Column, weights: list[float], seed: int = 6) -> F.Column:
    """The shard of ``key`` as INT; a weight of zero or less takes nothing."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a weight")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            h = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(shard), F.lit(seed)), 11)
            u = (h.cast("double") + 0.5) / float(1 << 53)
            scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def number_rows(df: DataFrame, group: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` with ``slot``: 0, 1, ... within each ``group`` in ``order``; equal rows in any order."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    stored = materialise(keyed, "rows")
    ranged = stored.repartitionByRange(n, group, *order, "__tie").sortWithinPartitions(group, *order, "__tie")
    placed = materialise(ranged.withColumn("__id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__id", 33).alias("__part")
    counts = placed.groupBy(group, part).agg(F.count("*").alias("__n"), F.min("__id").alias("__low"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range and for each group that begins inside one: bounded by partitions plus groups.
    offsets = counts.select(group, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__low")).alias("__shift"))
    joined = placed.withColumn("__part", F.shiftright("__id", 33)).join(F.broadcast(offsets), [group, "__part"])
    return joined.withColumn("slot", F.col("__id") + F.col("__shift")).drop("__part", "__shift", "__id", "__tie")


def assign(docs: DataFrame, text: str = "text", key: str = "doc_id", weights: list[float] | None = None,
           grown_weight: float | None = 1.0) -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard): ``grown_shard`` is the shard with one more of ``grown_weight``."""
    weights = weights or [1.0] * 24
    whole = F.coalesce(F.col(text), F.lit(""))
    grown = rendezvous(F.col(key), [*weights, grown_weight]) if grown_weight else F.lit(None).cast("int")
    return docs.select(
        key,
        (F.octet_length(whole).cast("long") + OVERHEAD).alias("size"),
        F.crc32(whole).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        grown.alias("grown_shard"),
    )


def shard_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", weights: list[float] | None = None) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    placed = number_rows(assign(docs, text, key, weights), "shard", [key, "size", "text_crc32"])
    return placed.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
