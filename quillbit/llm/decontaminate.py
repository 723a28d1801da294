"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z only) and cut into words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (ASCII letters and digits, and everything
beyond ASCII). A benchmark window is ``size`` consecutive words of an item; an item
of fewer words, but not none, is one window. A document word inside any occurrence
of a window is hit; a document is contaminated when it has hits and they are at
least ``share`` of its words.

Plan: the windows are broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark text.
A block keeps for each window a 64-bit hash, its place in the block's words and its item
in sorted arrays (16 bytes a window, and the text itself), so a block of 4 MB takes some
25 MB of a worker. A document is cut into words once; the hashes of its windows are looked
up as an array, first in a bit table, then by binary search, and a hit is verified by
comparing the words. One broadcast lives at a time: the first block is scanned with the
documents, every further block is a job that stores what it finds by text digest and then
destroys its broadcast; what they found is joined to the documents at the end. No
shuffle where the benchmark fits one block.

Defined results: null or blank texts have no words and no hits, and are never
contaminated; items without words match nothing; repeated items with one item_id
count once; extra columns are kept, one named like the added column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.windows import HASHES, rolling
from quillbit.plans.storage import materialise, new_path, small_side

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK_BYTES = 4 << 20
RESULT = "n_words long, spans array<struct<first:long,count:long>>, items array<string>"


def normalise(text: str | None) -> list[str]:
    return WORDS.findall((text or "").translate(LOWER)) if text else []


class NgramSet:
    """The windows of one block of items, by the number of their words."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size, self.names = size, [name for name, _ in items]
        words: list[bytes] = []
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item, (_, text) in enumerate(items):
            own = _bytes(text)
            if own:
                n = min(size, len(own))
                hashes = rolling(HASHES.of(own), n)
                at = np.arange(len(words), len(words) + len(hashes), dtype=np.uint32)
                held.setdefault(n, []).append((hashes, at, np.full(len(at), item, dtype=np.uint32)))
                words += own
        self.text = b"\0".join(words) + b"\0"
        self.offsets = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words], dtype=np.int64)])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in sorted(held.items()):
            hashes, at, item = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, at, item = hashes[order], at[order], item[order]
            bits = np.zeros(1 << max(10, min(24, 4 + len(hashes).bit_length())), dtype=bool)
            bits[hashes & np.uint64(len(bits) - 1)] = True
            self.tables[n] = hashes, at, item, bits

    def window(self, at: int, n: int) -> bytes:
        return self.text[self.offsets[at] : self.offsets[at + n]]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, length) of every occurrence, and the items met."""
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        own = HASHES.of(words) if words and self.tables else None
        for n, (hashes, places, item, bits) in self.tables.items():
            if len(words) < n:
                continue
            seen = rolling(own, n)
            maybe = np.flatnonzero(bits[seen & np.uint64(len(bits) - 1)])
            low, high = np.searchsorted(hashes, seen[maybe], "left"), np.searchsorted(hashes, seen[maybe], "right")
            met = np.flatnonzero(high > low)
            for start, a, b in zip(maybe[met].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
                said = b"\0".join(words[start : start + n]) + b"\0"
                same = {self.names[item[i]] for i in range(a, b) if self.window(int(places[i]), n) == said}
                if same:
                    hits.append((start, n))
                    items |= same
        return hits, items


def _bytes(text: str | None) -> list[bytes]:
    """The words as UTF-8 (lone surrogates kept apart); no word holds the byte zero."""
    return [w.encode("utf-8", "surrogatepass") for w in normalise(text)]


def merge_spans(hits: list[tuple[int, int]]) -> list[dict]:
    """Occurrences as disjoint ascending spans."""
    out: list[list[int]] = []
    for start, n in sorted(hits):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + n)
        else:
            out.append([start, start + n])
    return [{"first": a, "count": b - a} for a, b in out]


def blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of at most ``limit`` characters (a longer item is a block of its own)."""
    held, size = [], 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where(F.col(text).isNotNull())
    for r in rows.toLocalIterator():
        if held and size + len(r["t"]) > limit:
            yield held
            held, size = [], 0
        held.append((r["i"] if r["i"] is not None else "", r["t"]))
        size += len(r["t"])
    yield held


def _scan(shared, text: F.Column) -> F.Column:
    """What one block finds in each text."""

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for texts in batches:
            out = []
            for text in texts:
                words = _bytes(text)
                hits, items = table.find(words)
                out.append((len(words), merge_spans(hits), sorted(items)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return scan(text)


def _merged(first: F.Column, spans: F.Column, items: F.Column) -> F.Column:
    """What the first block found and what the others did (lists of spans and items, or null)."""

    @F.pandas_udf(RESULT)
    def merge(first: pd.DataFrame, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for n, own, met, more, names in zip(first["n_words"], first["spans"], first["items"], spans, items, strict=True):
            hits = [(int(s["first"]), int(s["count"])) for part in (own, *(more if more is not None else ())) for s in part]
            out.append((n, merge_spans(hits), sorted({*met, *(x for part in (names if names is not None else ()) for x in part)})))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return merge(first, spans, items)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = 13, column: str = "__found",
                       item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with struct(n_words, spans, items) in ``column``: word spans hit and items met, for the whole benchmark."""
    spark = docs.sparkSession
    parts = blocks(benchmark, item, item_text, block_bytes)
    first = spark.sparkContext.broadcast(NgramSet(next(parts), size))
    path = None
    for held in parts:
        shared = spark.sparkContext.broadcast(NgramSet(held, size))
        texts = docs.where(F.col(text).isNotNull()).select(F.md5(F.col(text)).alias("digest"), _scan(shared, F.col(text)).alias("f"))
        path = path or new_path(spark, "hits")
        texts.where(F.size("f.items") > 0).select("digest", "f.spans", "f.items").write.mode("append").parquet(path)
        shared.destroy()
    found = docs.withColumn(column, _scan(first, F.col(text)))
    if path is None:
        return found
    hits = spark.read.schema(f"digest string, {RESULT.partition(',')[2]}").parquet(path)
    # copies of a text find the same: one set for each block and digest
    merged = materialise(hits.groupBy("digest").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items")), "hits")
    digest, spans, items = (free_name(found, n) for n in ("__digest", "__spans", "__items"))
    side = small_side(merged).select(F.col("digest").alias(digest), F.col("spans").alias(spans), F.col("items").alias(items))
    joined = found.withColumn(digest, F.md5(F.col(text))).join(side, digest, "left")
    return joined.withColumn(column, _merged(F.col(column), F.col(spans), F.col(items))).select(*found.columns)


def n_hit(found: F.Column) -> F.Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["count"])


def is_contaminated(found: F.Column, inverse_share: int = 20) -> F.Column:
    return (n_hit(found) > 0) & (inverse_share * n_hit(found) >= found["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", action: str = "drop",
                  size: int = 13, inverse_share: int = 20) -> DataFrame:
    """``docs`` without contaminated documents (``drop``) or with the hit spans cut out of them (``spans``).

    Cutting rewrites a contaminated text as the rest of it: from the first character
    of a hit word to the last one of its span; other documents stay as they are.
    """
    column = free_name(docs, "__found")
    found = with_contamination(docs, benchmark, text, size, column)
    if action == "drop":
        return found.where(~is_contaminated(F.col(column), inverse_share)).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans, strict=True)])

    new = F.when(is_contaminated(F.col(column), inverse_share), cut(F.col(text), F.col(column)["spans"])).otherwise(F.col(text))
    return found.withColumn(text, new).select(*docs.columns)


def _without(text: str | None, spans) -> str | None:
    if text is None or not len(spans):
        return text
    at = [m.span() for m in WORDS.finditer(text.translate(LOWER))]
    out, last = [], 0
    for s in spans:
        out.append(text[last : at[s["first"]][0]])
        last = at[s["first"] + s["count"] - 1][1]
    return "".join([*out, text[last:]])
