"""Remembered results: a Parquet table of scores, keyed by algorithm and content.

A work list is joined against what is there; only missing (or failed) items are scored,
and the answers are appended. A key may be renamed, dropped or listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbit.plans.score import listed_column
from quillbit.plans.storage import materialise

SCHEMA = "digest string, algo string, size long, csize long, status string, wall double, cpu double, memory long"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All remembered rows; an empty table where nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    return spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)


def work_list(files: DataFrame, algorithms: list[str], content: str = "content", key: str = "file") -> DataFrame:
    names = F.array(*(F.lit(a) for a in algorithms))
    return files.select(F.col(key).alias("file"), F.sha2(content, 256).alias("digest"), F.col(content).alias("content"), F.explode(names).alias("algo"))


def missing(work: DataFrame, known: DataFrame, rerun_errors: bool = False) -> DataFrame:
    """Work items without a remembered answer; with ``rerun_errors`` also those whose answer is no size."""
    have = known.where("status = 'ok'") if rerun_errors else known
    return work.join(have.select("digest", "algo").distinct(), ["digest", "algo"], "left_anti")


def complete(files: DataFrame, algorithms: list[str], path: str, content: str = "content", key: str = "file",
             paranoid: bool = False, rerun_errors: bool = False, timeout: float | None = None) -> DataFrame:
    """(file, algo, size, csize, status) of every work item; what was missing is scored once and remembered."""
    spark = files.sparkSession
    work = work_list(files, algorithms, content, key)
    # keys are compared without texts; one copy of a text meets the list of what is still to do for it
    todo = missing(work.select("digest", "algo").distinct(), stored(spark, path), rerun_errors).groupBy("digest").agg(F.array_sort(F.collect_list("algo")).alias("algos"))
    keyed = files.select(F.sha2(content, 256).alias("digest"), F.col(content).alias("content"))
    copies = keyed.join(materialise(todo, "todo"), "digest").groupBy("digest").agg(F.any_value("content").alias("content"), F.any_value("algos").alias("algos"))
    scored = copies.select("digest", F.octet_length("content").cast("long").alias("size"), F.explode(listed_column(F.col("content"), F.col("algos"), paranoid, timeout)).alias("r"))
    scored = scored.select("digest", "r.algo", "size", "r.csize", "r.status", "r.wall", "r.cpu", "r.memory")
    materialise(scored, "scored").write.mode("append").parquet(path)
    answers = stored(spark, path).groupBy("digest", "algo").agg(
        F.max_by(F.struct("size", "csize", "status"), (F.col("status") == "ok").cast("int")).alias("x")
    )
    return work.drop("content").join(answers, ["digest", "algo"]).select("file", "algo", "x.size", "x.csize", "x.status")


def renamed(known: DataFrame, old: str, new: str) -> DataFrame:
    """Remembered rows with ``old`` replaced by ``new`` in algorithm names."""
    return known.withColumn("algo", F.replace("algo", F.lit(old), F.lit(new)))


def forgotten(known: DataFrame, *algorithms: str) -> DataFrame:
    """Remembered rows without those of some algorithms: what is written back in their place forgets them."""
    return known.where(~F.col("algo").isin(*algorithms))
