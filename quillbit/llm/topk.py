"""Exact top-k inner products by no-random-access aggregation.

Every dimension of a block of candidates is a sorted list; a query reads it from the top
where its weight is positive and from the bottom where it is negative. Lists are read in
step, from one of ``DEPTHS`` to the next. What a query has not read of a candidate lies
between the end of the list and the reading position, which bounds the candidate's score
from below and above. A candidate whose upper bound is under the k-th best lower bound
cannot qualify any more; a query with no more than ``OPEN`` x k candidates left stops
reading while the others go on, and what it has left is resolved by exact integer scores.
The k-th best score of the blocks before is a lower bound from the start, so lower bounds
of single candidates are only needed until a task has met k of them. All bounds of a step
are matrix products of clipped components. Where the weights of a query lie on few lists
it stops early; vectors without any such structure are read nearly to the end, as any
search without random access must.

Queries are read from a stored table in blocks of at most ``BLOCK_BYTES`` and broadcast
one block at a time; each block is a job of its own whose results are stored before its
broadcast is destroyed. Each task keeps the best k of a query, and those are merged.

Components become floor(256 * x), so scores are integers; shorter vectors count as padded
with zeros. Vectors that are null or hold null or non-finite components and rows with a
null id take no part. Ties go to the smaller id; a query never meets its own id; rows
that share an id are candidates each, and as queries pool what they find. Fewer
candidates than k give all of them; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbit.plans.storage import materialise, new_path

SCALE = 256
#: Shares of each list that are read, one after the other.
DEPTHS = (0.0625, 0.125, 0.25, 0.5, 0.75)
#: Candidates, in multiples of k, at which a query stops reading.
OPEN = 4
#: Bytes of queries that are broadcast at a time.
BLOCK_BYTES = 16 << 20
#: Candidates and queries that are compared at a time, and scores that are resolved at a time.
BLOCK, QUERIES, CHUNK = 2048, 512, 1 << 17
#: Scores up to this size are exact in double precision.
EXACT = 1 << 52


def quantised(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v): integer vectors that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v")
    )


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


class Best:
    """The k best (score, id) of each query so far, best first."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), np.iinfo(np.int64).min, dtype=np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.real = np.zeros((queries, k), dtype=bool)

    def part(self, first: int, last: int) -> Best:
        """Some of the queries; what is added to them is added here."""
        out = Best(0, self.k)
        out.score, out.id, out.real = self.score[first:last], self.id[first:last], self.real[first:last]
        return out

    def worst(self) -> np.ndarray:
        return np.where(self.real[:, -1], self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(query)) + 1])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        keep = rank < self.k
        query, score, ids, rank = query[keep], score[keep], ids[keep], rank[keep]
        own = np.unique(query)
        at = np.searchsorted(own, query)
        new = [np.full((len(own), self.k), f, dtype=t) for f, t in ((np.iinfo(np.int64).min, np.int64), (np.iinfo(np.int64).max, np.int64), (False, bool))]
        for table, value in zip(new, (score, ids, True), strict=True):
            table[at, rank] = value
        s, i, r = (np.concatenate([old[own], got], axis=1) for old, got in zip((self.score, self.id, self.real), new, strict=True))
        order = np.lexsort((i, -s, ~r), axis=1)[:, : self.k]
        self.score[own], self.id[own], self.real[own] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best) -> np.ndarray:
    """Bring one block of candidates into ``best``; gives the share of the lists that each query has read."""
    n = len(x)
    both = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).astype(np.float64)
    lists = np.sort(x, axis=0)
    size = float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(x).max(initial=0))
    slack = 0.0 if size < EXACT else size * 1e-12
    alive = q_ids[:, None] != ids[None, :]
    bound, read = best.worst(), np.zeros(len(q))
    reading = np.arange(len(q))
    for depth in DEPTHS:
        at = max(1, min(n, int(n * depth)))
        top, bottom = lists[n - at], lists[at - 1]
        # an unread entry of a list lies between its end and the reading position
        most = np.concatenate([np.maximum(x, top), np.minimum(x, bottom)], axis=1).T.astype(np.float64)
        need = reading[~np.isfinite(bound[reading])]
        if len(need) and n > best.k:
            least = np.concatenate([np.where(x >= top, x, lists[0]), np.where(x <= bottom, x, lists[-1])], axis=1).T.astype(np.float64)
            lower = np.where(q_ids[need, None] != ids[None, :], both[need] @ least, -np.inf)
            early = np.partition(lower, n - best.k, axis=1)[:, n - best.k]
        else:
            need, early = need[:0], np.zeros(0)
        now = bound.copy()
        now[need] = early
        alive[reading] &= both[reading] @ most >= (now[reading] - slack)[:, None]
        read[reading] = at / n
        reading = reading[alive[reading].sum(axis=1) > OPEN * best.k]
        if not len(reading):
            break
    rows, cols = np.nonzero(alive)
    for at in range(0, len(rows), CHUNK):
        r, c = rows[at : at + CHUNK], cols[at : at + CHUNK]
        best.add(r, np.einsum("ij,ij->i", q[r], x[c]), ids[c])
    return read


def top_k(vectors: DataFrame, query_filter: F.Column, k: int = 5, vector: str = "embedding", key: str = "vec_id",
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row that ``query_filter`` picks, against all other rows."""
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors, vector, key), "vectors")
    chosen = materialise(quantised(vectors.where(query_filter), vector, key).groupBy("id", "v").agg(F.count("*").alias("n")), "queries")
    path = new_path(spark, "found")
    kind = "query_id long, vec_id long, score long"
    spark.createDataFrame([], kind).write.parquet(path)
    for held in _blocks(chosen, block_bytes):
        shared = spark.sparkContext.broadcast(held)
        rows.mapInPandas(_search(shared, k), kind).write.mode("append").parquet(path)
        shared.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(kind).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _blocks(chosen: DataFrame, limit: int) -> Iterator[list]:
    """(id, times, vector) of the queries, in blocks of at most ``limit`` bytes (one query at least)."""
    held, size = [], 0
    for r in chosen.toLocalIterator():
        own = 8 * len(r["v"]) + 64
        if held and size + own > limit:
            yield held
            held, size = [], 0
        held.append((r["id"], r["n"], np.array(r["v"], dtype=np.int64)))
        size += own
    if held:
        yield held


def _search(shared, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids = np.array([i for i, _, _ in shared.value], dtype=np.int64)
        width = max((len(v) for _, _, v in shared.value), default=0)
        q = _matrix([v for _, _, v in shared.value], width)
        best = Best(len(q), k)
        for frame in batches:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                x, ids = _matrix(list(part["v"]), width), part["id"].to_numpy(np.int64)
                for first in range(0, len(q), QUERIES):
                    search_block(q[first : first + QUERIES], q_ids[first : first + QUERIES], x, ids, best.part(first, first + QUERIES))
        query, rank = np.nonzero(best.real)
        # a query that several rows ask alike finds each candidate as often
        times = np.minimum([n for _, n, _ in shared.value], k).astype(np.int64)[query]
        found = {"query_id": q_ids[query], "vec_id": best.id[query, rank], "score": best.score[query, rank]}
        yield pd.DataFrame({name: np.repeat(v, times) for name, v in found.items()})

    return run
