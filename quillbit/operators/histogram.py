"""Histograms and entropies over symbols and numbers, as (bin, label, count) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_symbols(rows: DataFrame, sym: str = "sym", *keys: str) -> DataFrame:
    """(keys, sym, n)."""
    return rows.groupBy(*keys, sym).agg(F.count("*").alias("n"))


def of_numbers(rows: DataFrame, x: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): ``bins`` bins of one width from ``low`` up to ``high``; what is outside has bin -1."""
    width = (high - low) / bins
    at = F.floor((x - low) / width).cast("int")
    inside = (x >= low) & (x < high)
    return rows.where(x.isNotNull()).groupBy(F.when(inside, at).otherwise(-1).alias("bin")).agg(F.count("*").alias("n"))


def add(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """The histogram of both."""
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))


def merge_bins(hist: DataFrame, label: str, into: Column) -> DataFrame:
    """Bins renamed by ``into`` and summed."""
    return hist.groupBy(into.alias(label)).agg(F.sum("n").alias("n"))


def delete_bin(hist: DataFrame, label: str, value) -> DataFrame:
    return hist.where(~F.col(label).eqNullSafe(F.lit(value)))


def inverted(hist: DataFrame) -> DataFrame:
    """How many bins have each count: (n, bins)."""
    return hist.groupBy("n").agg(F.count("*").alias("bins"))


def totals(hist: DataFrame, *keys: str, base: float = 2.0) -> DataFrame:
    """(keys, total, distinct, entropy): entropy in bits (or to ``base``), from counts alone.

    H = log(N) - sum(n log n) / N, one aggregate over the counts.
    """
    n = F.col("n").cast("double")
    return hist.where("n > 0").groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.count("*").alias("distinct"),
        (F.log(base, F.sum(n)) - F.sum(n * F.log(base, n)) / F.sum(n)).alias("entropy"),
    )


def conditional_entropy(rows: DataFrame, ctx: str, sym: str = "sym") -> DataFrame:
    """(total, entropy) in bits of a symbol given its context."""
    pairs = rows.groupBy(ctx, sym).agg(F.count("*").alias("n"))
    contexts = pairs.groupBy(ctx).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    m = F.col("m").cast("double")
    return contexts.agg(F.sum("m").alias("total"), (F.sum(m * F.log2(m) - F.col("s")) / F.sum(m)).alias("entropy"))


def cumulative(hist: DataFrame, order: str, *keys: str) -> DataFrame:
    """(lo, hi, total) of each symbol in coding order: integer intervals of its mass."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    lo = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hist.withColumn("lo", lo).withColumn("hi", F.col("lo") + F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def extreme_symbols(hist: DataFrame, *keys: str, least: bool = False, ties: str = "all", sym: str = "sym", seed: int = 0) -> DataFrame:
    """The most (or least) frequent symbols: ``all`` of them, the ``first``, or a ``random`` one by a hash of the symbol."""
    from pyspark.sql import Window

    order = F.asc("n") if least else F.desc("n")
    among = {"all": [], "first": [F.col(sym)], "random": [F.xxhash64(sym, F.lit(seed)), F.col(sym)]}[ties]
    return hist.withColumn("r", F.rank().over(Window.partitionBy(*keys).orderBy(order, *among))).where("r = 1").drop("r")
