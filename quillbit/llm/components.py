"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.plans.storage import drop, materialise, measured


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Each round every node hands its smallest neighbour to its larger ones (large
    star) and then to its smaller ones (small star); links only ever get closer to
    the root, so the table never grows beyond its first size and the number of
    rounds follows the logarithm of the longest path. Only sums reach the driver.
    Nulls and self links are ignored; an empty table gives an empty result.
    """
    edges = links.select("a", "b").where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    edges, before = materialise(edges, "edges"), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        last, edges = edges, materialise(small, "edges", digest=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        now = measured(edges)["rows"], measured(edges)["digest"]
        drop(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("v").distinct().select(F.col("v").alias("u"), "v")
    return edges.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
