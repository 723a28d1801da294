"""Reports over result tables (file, size, algo, csize, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def effectiveness(csize: Column, size: Column) -> Column:
    """Bits of output for each byte of input."""
    return csize / size * 8


def mean_effectiveness(long: DataFrame, *keys: str) -> DataFrame:
    """(algo, mean): the mean of the files' ratios, not the ratio of sums."""
    return long.groupBy(*(keys or ("algo",))).agg(F.avg(effectiveness(F.col("csize"), F.col("size"))).alias("mean"))


def group_summary(long: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, algo, mean) for each group, and for ``All``: the files of all groups one after the other."""
    joined = groups.select("grp", "file").join(long, "file")
    ratio = effectiveness(F.col("csize"), F.col("size"))
    both = joined.select(F.explode(F.array("grp", F.lit("All"))).alias("grp"), "algo", ratio.alias("r"))
    return both.groupBy("grp", "algo").agg(F.avg("r").alias("mean"))


def flag_best(long: DataFrame, value: str, *keys: str) -> DataFrame:
    """``best``: whether a row has the least value of its keys, ties all flagged."""
    return long.withColumn("best", F.col(value).eqNullSafe(F.min(value).over(Window.partitionBy(*keys))) & F.col(value).isNotNull())


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def autoscale(rows: DataFrame, value: str) -> DataFrame:
    """(low, high) of the finite values."""
    return rows.where(finite(F.col(value))).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def best_by(rows: DataFrame, value: str, order: list[str], pick: list[str], *keys: str) -> DataFrame:
    """For each key the ``pick`` of the finite row of least value; among equals the first by ``order``."""
    good = rows.where(finite(F.col(value)))
    best = good.groupBy(*keys).agg(F.min_by(F.struct(*pick), F.struct(value, *order)).alias("x"), F.min(value).alias(value))
    return best.select(*keys, *(f"x.{p}" for p in pick if p != value), value)


def mean_and_error(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, mean, error): standard error from the population deviation."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("error"))


def collected(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, values): the values of each key as a sorted list, for the few repetitions of a measurement."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("values"))


def transfer(scores: DataFrame, trained: str = "training", tested: str = "test") -> DataFrame:
    """What tuned parameters lose on other files: (prior, total, by_depth, by_parameters).

    ``scores`` has (prior, fitted_on, depth_from, score): the score on test files with the
    parameters and the depth fitted on either set.
    """

    def at(fitted: str, depth: str) -> Column:
        return F.avg(F.when((F.col("fitted_on") == fitted) & (F.col("depth_from") == depth), F.col("score")))

    both = scores.groupBy("prior").agg(at(trained, trained).alias("tt"), at(tested, trained).alias("mixed"), at(tested, tested).alias("ee"))
    return both.select(
        "prior", (F.col("tt") - F.col("ee")).alias("total"), (F.col("mixed") - F.col("ee")).alias("by_depth"), (F.col("tt") - F.col("mixed")).alias("by_parameters")
    )


def efficiency_by_depth(params: DataFrame, scores: DataFrame) -> DataFrame:
    """(set, prior, depth, mean) of scores of file sets at the parameters of each depth."""
    return params.join(scores, ["prior", "depth"]).groupBy("set", "prior", "depth").agg(F.avg("efficiency").alias("mean"))


def per_cent(csize: Column, size: Column) -> Column:
    return csize / size * 100
