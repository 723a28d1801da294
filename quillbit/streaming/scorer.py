"""Streaming scorers: stateless code lengths, windowed means, and a model for each key that goes on learning.

Documents arrive in any order; a document is scored by itself, so the stateless scorer
is the batch expression on a stream. ``KeyedCRP`` keeps counts for each key across
micro-batches: what it has learnt from earlier documents shortens later ones.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillbit.functions import symbols as S
from quillbit.plans.score import measure_column
from quillbit.plans.spec import ModelSpec


def scored(docs: DataFrame, spec: ModelSpec, text: str = "text") -> DataFrame:
    """A stream of documents with ``bits``."""
    return docs.withColumn("bits", measure_column(F.col(text), spec))


def windowed_bits(docs: DataFrame, spec: ModelSpec, time: str, late: str = "10 minutes", width: str = "5 minutes", text: str = "text") -> DataFrame:
    """(start, documents, bits_per_byte) of event-time windows; documents later than ``late`` are left out."""
    rows = scored(docs.withWatermark(time, late), spec, text).withColumn("size", F.octet_length(text))
    found = rows.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("documents"), (F.sum("bits") / F.sum("size")).alias("bits_per_byte"))
    return found.select(F.col("w.start").alias("start"), "documents", "bits_per_byte")


def keyed_crp(docs: DataFrame, key: str, text: str = "text", a: float = 1.0, size: int = S.SIMPLE_RANGE) -> DataFrame:
    """(key, documents, symbols, bits) of each micro-batch under a model that each key keeps.

    State is the table of counts, at most one entry for each symbol of the alphabet in use.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = {int(c): n for c, n in json.loads(state.get[0]).items()} if state.exists else {}
        n, documents, symbols, bits = sum(counts.values()), 0, 0, 0.0
        for frame in frames:
            for value in frame["text"]:
                documents += 1
                for c in map(ord, value or ""):
                    bits -= math.log2((counts.get(c, 0) + a / size) / (n + a))
                    counts[c] = counts.get(c, 0) + 1
                    n += 1
                    symbols += 1
        state.update((json.dumps(counts),))
        yield pd.DataFrame({"key": [str(k[0])], "documents": [documents], "symbols": [symbols], "bits": [bits]})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, documents long, symbols long, bits double", "counts string", "append", GroupStateTimeout.NoTimeout
    )
