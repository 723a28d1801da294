"""Substring dedup: remove words that lie in a window of words which also occurs elsewhere.

A window is ``size`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text. Every
word covered by a window whose words also start anywhere else (the same text
included) is removed; windows are judged on the input.

Plan: a count-min prefilter, then exact grouping of what it lets through.

1. Each window is represented by its *anchor*, the smallest hash among its runs of
   ``ANCHOR`` words. Equal windows have equal anchors at different positions, so a
   window that repeats has an anchor value that was selected at least twice; there
   are about a twelfth as many anchors as windows. Every partition builds a sparse
   count-min sketch (two rows, counts saturating at ``HOT``) of its selected anchors;
   sketches are merged segment by segment. The width follows the input
   (eight cells for each expected anchor) up to ``max_cells``; a sketch only ever
   overestimates, so a narrower one passes more windows and never loses any.
2. A second scan emits only windows whose anchor is estimated twice or more. They
   are first grouped within the task, so a passage that occurs a million times
   is sent once by each task, and then exactly, by 128-bit hashes, in buckets. A bucket
   follows the anchor, which keeps the windows of a passage together; where the anchor is
   estimated ``HOT`` times or more it follows the hash of the window, so a phrase that a
   third of all texts have is spread over all buckets. Both choices are functions of the
   window alone, so equal windows always meet. Buckets follow the input's size.
3. Repeated positions return as runs by text digest; the last scan joins them
   (broadcast if their checked size allows, else by a shuffle) and drops the words.

Bounded memory: blobs of at most ``FLUSH`` windows, one bucket at a time. Defined
results: null or blank texts have no words; texts under ``size`` words lose
nothing; repeated rows are copies of each other; extra columns are ignored.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.windows import HASHES, chosen, covered, mix, rolling, runs, slide, split
from quillbit.plans.storage import drop, materialise, small_side, smaller_batches

ANCHOR = 8
ROWS = 2
SALTS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47))
SEGMENT_BITS = 20
FLUSH = 1 << 17
#: Occurrences from which an anchor's windows are dealt by their own hash.
HOT = 32
#: Bytes of text whose windows make a bucket, and whose windows make a task of the exact pass.
BUCKET_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: Texts that are cut at a time.
SLICE = 256


def cells_for(total_bytes: int, max_cells: int) -> int:
    """A power of two of about eight cells for each anchor of ``total_bytes`` of text."""
    want = max(1 << SEGMENT_BITS, total_bytes // 10)
    return min(max_cells, 1 << (want - 1).bit_length())


def _cells(anchors: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(anchors ^ SALTS[row]) & np.uint64(cells - 1)).astype(np.int64)


def _anchors(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor candidates by position, and the anchor of every window. Short windows use shorter runs."""
    piece = min(ANCHOR, size)
    values = rolling(words, piece, 1)
    return values, slide(values, size - piece + 1, np.minimum) if len(words) >= size else values[:0]


SKETCH = pa.schema([("row", pa.int32()), ("segment", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
MERGED = pa.schema([("row", pa.int32()), ("segment", pa.int32()), ("twice", pa.binary()), ("hot", pa.binary())])


def _sketch_rows(anchors: list[np.ndarray], cells: int) -> Iterator[pa.RecordBatch]:
    if not anchors:
        return
    values = np.concatenate(anchors)
    for row in range(ROWS):
        at, count = np.unique(_cells(values, row, cells), return_counts=True)
        segment, offset = at >> SEGMENT_BITS, (at & ((1 << SEGMENT_BITS) - 1)).astype(np.uint32)
        out: list[list] = [[], [], [], []]
        for s, lo, hi in _groups(segment):
            for column, value in zip(out, (row, s, offset[lo:hi].tobytes(), np.minimum(count[lo:hi], HOT).astype(np.uint8).tobytes()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, SKETCH, strict=True)], schema=SKETCH)


def _groups(sorted_values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.concatenate([[0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)]])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if hi > lo:
            yield int(sorted_values[lo]), lo, hi


def _sketch(size: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                values, minima = _anchors(HASHES.of(split(text)), size)
                got = chosen(values, minima, len(values) - len(minima) + 1) if len(minima) else minima
                if len(got):
                    held.append(got)
                    n += len(got)
                if n >= FLUSH:
                    yield from _sketch_rows(held, cells)
                    held, n = [], 0
        yield from _sketch_rows(held, cells)
        _release()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum partition sketches; rows of one segment arrive together. Gives the cells that reach two, and ``HOT``, as bits."""
    now, counts = None, None

    def done():
        bits = [np.packbits(counts >= n).tobytes() for n in (2, HOT)]
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*now, *bits), MERGED, strict=True)], schema=MERGED)

    for batch in batches:
        for row, segment, cells, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (row, segment) != now:
                if now:
                    yield done()
                now, counts = (row, segment), np.zeros(1 << SEGMENT_BITS, dtype=np.uint8)
            at = np.frombuffer(cells, dtype=np.uint32)
            counts[at] = np.minimum(counts[at] + np.frombuffer(more, dtype=np.uint8), HOT)
    if now:
        yield done()


def repeated_cells(docs: DataFrame, size: int, cells: int) -> np.ndarray:
    """Bits of the cells counted twice or more, for each row of the sketch, and of those counted ``HOT`` times in the first."""
    parts = docs.mapInArrow(_sketch(size, cells), "row int, segment int, cells binary, counts binary")
    merged = (
        parts.repartition("row", "segment")
        .sortWithinPartitions("row", "segment")
        .mapInArrow(_merge, "row int, segment int, twice binary, hot binary")
    )
    table = np.zeros((ROWS + 1, cells >> 3), dtype=np.uint8)
    width = 1 << (SEGMENT_BITS - 3)
    stored = materialise(merged, "sketch")
    for r in stored.select("row", "segment", "twice", F.when(F.col("row") == 0, F.col("hot")).alias("hot")).toLocalIterator():
        at = slice(r["segment"] * width, (r["segment"] + 1) * width)
        table[r["row"], at] = np.frombuffer(r["twice"], dtype=np.uint8)
        if r["row"] == 0:
            table[ROWS, at] = np.frombuffer(r["hot"], dtype=np.uint8)
    drop(stored)
    return table


def _bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _estimated_twice(table: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    cells = table.shape[1] << 3
    ok = np.ones(len(anchors), dtype=bool)
    for row in range(ROWS):
        ok &= _bit(table[row], _cells(anchors, row, cells))
    return ok


def _hot(table: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return _bit(table[ROWS], _cells(anchors, 0, table.shape[1] << 3))


FOUND = "bucket int, keys binary, first binary, second binary, many binary, doc binary, pos binary"
FOUND_ARROW = pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("keys", "first", "second", "many", "doc", "pos")])
RUNS_ARROW = pa.schema([("key", pa.binary()), ("runs", pa.binary())])


def _by_key(keys: list[bytes], doc: np.ndarray, pos: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Positions by document index as runs by text digest, equal digests merged."""
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    found: dict[bytes, bytes] = {}
    for d, lo, hi in _groups(doc):
        found.setdefault(keys[d], runs(pos[lo:hi]).tobytes())
    return list(found), list(found.values())


class _Held:
    """Windows that passed the filter, until they are grouped and sent."""

    def __init__(self, buckets: int, table: np.ndarray):
        self.buckets, self.table = buckets, table
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.rows, self.n = [], {}, [], 0

    def add(self, key: bytes, first, second, anchor, pos) -> None:
        if key in self.at:  # a copy of a text held already: its windows are all repeated
            doc = self.at[key]
            self.rows.append((first, second, anchor, pos, np.full(len(pos), doc, dtype=np.uint32)))
        else:
            doc = self.at[key] = len(self.keys)
            self.keys.append(key)
            self.rows.append((first, second, anchor, pos, np.full(len(pos), doc, dtype=np.uint32)))
        self.n += len(pos)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        first, second, anchor, pos, doc = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        own = np.where(_hot(self.table, anchor), first, anchor)
        bucket = (mix(own ^ SALTS[0]) % np.uint64(self.buckets)).astype(np.int32)
        order = np.lexsort((second, first, bucket))
        first, second, pos, doc, bucket = first[order], second[order], pos[order], doc[order], bucket[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (bucket[1:] != bucket[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        if many.any():  # repeated within this task: said at once, and one of each is sent on
            keys, spans = _by_key(self.keys, doc[many], pos[many])
            yield self.batch(bucket=[-1] * len(keys), keys=keys, first=spans)
        first, second, pos, doc, bucket, many = (a[new] for a in (first, second, pos, doc, bucket, many))
        out: dict[str, list] = {n: [] for n in FOUND_ARROW.names}
        for b, lo, hi in _groups(bucket):
            own, local = np.unique(doc[lo:hi], return_inverse=True)
            for name, value in (
                ("bucket", b), ("keys", b"".join(self.keys[d] for d in own.tolist())), ("first", first[lo:hi].tobytes()),
                ("second", second[lo:hi].tobytes()), ("many", many[lo:hi].tobytes()),
                ("doc", local.astype(np.uint32).tobytes()), ("pos", pos[lo:hi].astype(np.uint32).tobytes()),
            ):
                out[name].append(value)
        yield self.batch(**out)
        self.clear()

    @staticmethod
    def batch(**columns) -> pa.RecordBatch:
        n = len(columns["bucket"])
        return pa.RecordBatch.from_arrays([pa.array(columns.get(t.name, [None] * n), t.type) for t in FOUND_ARROW], schema=FOUND_ARROW)


def _candidates(size: int, table, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        held = _Held(buckets, bits)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = HASHES.of(split(text))
                _, minima = _anchors(words, size)
                if not len(minima):
                    continue
                cut = np.concatenate([[0], np.flatnonzero(minima[1:] != minima[:-1]) + 1])
                ok = np.repeat(_estimated_twice(bits, minima[cut]), np.diff(np.append(cut, len(minima))))
                pos = np.flatnonzero(ok)
                if len(pos):
                    held.add(key, rolling(words, size, 0)[pos], rolling(words, size, 1)[pos], minima[pos], pos)
                if held.n >= FLUSH:
                    yield from held.flush()
        yield from held.flush()
        _release()

    return run


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group the windows of one bucket at a time; give the positions of those that occur again."""
    now, rows = None, []

    def done() -> Iterator[pa.RecordBatch]:
        keys, base, parts = [], 0, []
        for k, first, second, many, doc, pos in rows:
            own = [k[i : i + 16] for i in range(0, len(k), 16)]
            parts.append((np.frombuffer(first, np.uint64), np.frombuffer(second, np.uint64), np.frombuffer(many, bool), np.frombuffer(doc, np.uint32).astype(np.int64) + base, np.frombuffer(pos, np.uint32)))
            keys += own
            base += len(own)
        first, second, many, doc, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((second, first))
        first, second, many, doc, pos = first[order], second[order], many[order], doc[order], pos[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        group = np.cumsum(new) - 1
        again = ((np.bincount(group) > 1) | (np.bincount(group, weights=many) > 0))[group] & ~many
        if again.any():
            found, spans = _by_key(keys, doc[again], pos[again])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(spans, pa.binary())], schema=RUNS_ARROW)

    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and rows:
                yield from done()
                rows = []
            now = bucket
            rows.append(row)
    if rows:
        yield from done()
    _release()


def repeated_runs(docs: DataFrame, text: str, size: int, max_cells: int) -> DataFrame:
    """(key, runs): by MD5 of the text, the runs of repeated windows in it."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(whole.alias("text"))
    total = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    table = spark.sparkContext.broadcast(repeated_cells(texts, size, cells_for(total, max_cells)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, total // BUCKET_BYTES)
    keyed = docs.select(F.unhex(F.md5(whole)).alias("key"), whole.alias("text"))
    found = materialise(keyed.mapInArrow(_candidates(size, table, buckets), FOUND), "windows")
    table.destroy()
    near = found.where("bucket < 0").select(F.col("keys").alias("key"), F.col("first").alias("runs"))
    far = found.where("bucket >= 0")
    far = far.repartition(total // TASK_BYTES, "bucket") if total // TASK_BYTES > tasks else far.repartition("bucket")
    far = far.sortWithinPartitions("bucket").mapInArrow(_exact, "key binary, runs binary")
    runs_of = materialise(near.unionByName(far).groupBy("key").agg(F.collect_set("runs").alias("runs")), "runs")
    drop(found)
    return runs_of


def _cut(size: int, schema: pa.Schema):
    """Texts without the words of repeated windows, a slice of a batch at a time."""

    def one(value: str, span: list[bytes] | None) -> tuple[int, int, str]:
        words = split(value)
        n = len(words)
        if span is not None:
            both = np.frombuffer(b"".join(span), dtype=np.uint32).reshape(-1, 2).astype(np.int64)
            gone = covered(both[:, 0], both[:, 1], size, n)
            words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        return n, n - len(words), b" ".join(words).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                keys, texts, spans = batch.slice(at, SLICE).columns
                rows = [one(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)]
                columns = [keys, *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([schema[0].with_type(keys.type), *list(schema)[1:]]))
        _release()

    return run


def _release() -> None:
    """Give memory back to the system: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 35, max_cells: int = 1 << 30
) -> DataFrame:
    """(key, n_words, n_removed, kept): each text without the words of repeated windows."""
    with smaller_batches(docs.sparkSession):
        found = repeated_runs(docs, text, size, max_cells)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("__key"), whole.alias("__text"), F.unhex(F.md5(whole)).alias("key"))
    joined = rows.join(small_side(found), "key", "left").select("__key", "__text", "runs")
    kind = f"`{key}` {docs.select(key).schema[0].dataType.simpleString()}, n_words long, n_removed long, kept string"
    schema = pa.schema([(key, pa.null()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    return joined.mapInArrow(_cut(size, schema), kind)
