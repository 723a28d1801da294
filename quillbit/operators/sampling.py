"""Sorting, top-N, systematic and categorical samples of a corpus."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_top(docs: DataFrame, n: int | Column, group: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``n`` documents of each group whose texts have the least MD5, ranked.

    Only keys and digests are ranked, and rank limits are applied before the shuffle.
    """
    digest = docs.select(group, key, F.md5(text).alias("digest"))
    r = F.row_number().over(Window.partitionBy(group).orderBy("digest", key))
    return digest.withColumn("rank", r).where(F.col("rank") <= n)


def cumulative(rows: DataFrame, weight: str, order: list[str]) -> DataFrame:
    """``cumulative`` of a weight before and with each row, for tables of one row for each group (languages, sources)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(weight).over(w)).withColumn("before", F.col("upto") - F.col(weight))


def systematic(rows: DataFrame, weight: str, order: list[str], draws: int, start: float = 0.5) -> DataFrame:
    """Systematic sample with probability proportional to size: (row, hits) for ``draws`` points one step apart.

    A point falls to the row whose interval of the cumulated weight holds it; how many
    points an interval holds is counted in closed form, so there is no join.
    """
    cum = cumulative(rows, weight, order)
    total = F.sum(weight).over(Window.partitionBy())
    step = total / draws
    # points start*step + i*step; those below x number ceil(x/step - start)
    below = lambda x: F.greatest(F.least(F.ceil(x / F.col("step") - start), F.lit(draws)), F.lit(0))
    hit = cum.withColumn("step", step).withColumn("hits", (below(F.col("upto")) - below(F.col("before"))).cast("int"))
    return hit.where("hits > 0").drop("step", "upto", "before")


def proportional_without_replacement(rows: DataFrame, weight: str, k: int, key: str, seed: int = 0) -> DataFrame:
    """``k`` rows drawn one after the other in proportion to weight: the least ``-ln(u) / weight``."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float((1 << 48) + 1)
    return rows.where(F.col(weight) > 0).withColumn("__e", -F.ln(u) / F.col(weight)).orderBy("__e", key).limit(k).drop("__e")


def language_subset(docs: DataFrame, quota: DataFrame, group: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """For every group of ``quota`` (group, hits) its first ``hits`` documents by MD5."""
    ranked = docs.select(group, key, F.md5(text).alias("digest"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("digest", key)))
    return ranked.join(quota.select(group, "hits"), group).where(F.col("rank") <= F.col("hits"))


def reservoir_one(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """One row, each alike: the least hash of its key."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(1)


def unique_sample(rows: DataFrame, k: int, key: str, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


#: Outcomes that a categorical distribution may have, since all draws carry its table.
MAX_OUTCOMES = 10_000


def categorical(draws: DataFrame, masses: DataFrame, label: str, mass: str, u: str = "u", omit: list | None = None) -> DataFrame:
    """Each draw ``u`` in [0, 1) with the label whose cumulated mass holds it; labels in ``omit`` are never drawn.

    The table of masses is a finite distribution of a checked size; it becomes a literal
    in the plan that every draw searches, so there is no join.
    """
    live = masses.where((F.col(mass) > 0) & ~F.col(label).isin(omit or []))
    rows = live.select(label, F.col(mass).cast("double").alias("m")).orderBy(label).limit(MAX_OUTCOMES + 1).collect()
    if not 0 < len(rows) <= MAX_OUTCOMES:
        raise ValueError(f"a table of 1 to {MAX_OUTCOMES} outcomes with mass is needed")
    whole = math.fsum(r["m"] for r in rows)
    upto = [c / whole for c in itertools.accumulate(r["m"] for r in rows)]
    edges, labels = F.array(*map(F.lit, upto)), F.array(*(F.lit(r[label]) for r in rows))
    at = F.size(F.filter(edges, lambda c: c <= F.col(u))) + 1
    return draws.withColumn(label, F.element_at(labels, F.least(at, F.lit(len(rows)))))
