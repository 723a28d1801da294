"""Code lengths of whole texts: the masses of ``adaptive`` from running counts in numpy.

The window plan holds a row for every symbol and sorts these rows once for each window;
here a batch of texts is a few arrays. Positions are sorted by what they end with: the
order of n-grams gives the counts of symbols in contexts of n - 1 symbols and, moved on
by one position, those of contexts of n symbols. A text is never cut, and a batch holds
``BATCH`` symbols or one longer text, so memory follows the longest text.

As in the window plan a document is all rows of one key: their symbols are taken in the
order of positions, those of equal positions side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols that are counted at a time: few enough for a processor's cache.
BATCH = 1 << 15


class Stream:
    """Symbols of some documents, one after the other: ``sym``, its document ``doc``, its ``pos``; ``at`` counts within the document."""

    def __init__(self, documents: list[list[np.ndarray]]):
        merged = [_merged(texts) for texts in documents]
        sizes = np.array([len(sym) for sym, _ in merged], dtype=np.int64)
        self.n_docs, self.sizes, self.starts = len(merged), sizes, np.cumsum(sizes) - sizes
        self.sym = np.concatenate([sym for sym, _ in merged] or [np.zeros(0, dtype=np.int64)])
        self.pos = np.concatenate([pos for _, pos in merged] or [np.zeros(0, dtype=np.int64)])
        self.doc = np.repeat(np.arange(len(merged)), sizes)
        self.at = np.arange(len(self.sym)) - np.repeat(self.starts, sizes)

    def __len__(self) -> int:
        return len(self.sym)

    def grams(self, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For n = 0 .. ``most`` the positions that end an n-gram, by n-gram and position, and the number of each one's n-gram."""
        out = [(np.arange(len(self)), self.doc)]
        symbols = last = None
        for n in range(1, most + 1):
            where = np.flatnonzero(self.at >= n - 1)
            keys = (self.doc << 21 | self.sym) if n == 1 else last[where - 1] * np.int64(symbols.max(initial=0) + 1) + symbols[where]
            order, number = _grouped(keys)
            order = where[order]
            last = np.zeros(len(self), dtype=np.int64)
            last[order] = number
            symbols = last if n == 1 else symbols
            out.append((order, number))
        return out

    def contexts(self, gram: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions by the ``k`` symbols before them, from the order of k-grams."""
        order, number = gram
        if not k:
            return gram
        follows = order + 1 < len(self)
        follows[follows] = self.at[order[follows] + 1] > 0
        return order[follows] + 1, number[follows]

    def totals(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` for each document."""
        return np.bincount(self.doc, weights=values, minlength=self.n_docs)


def _merged(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sym = np.concatenate(texts).astype(np.int64) if texts else np.zeros(0, dtype=np.int64)
    pos = np.concatenate([np.arange(len(t)) for t in texts]) if texts else sym
    if len(texts) > 1:
        order = np.argsort(pos, kind="stable")
        sym, pos = sym[order], pos[order]
    return sym, pos


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices by (key, index), and the number of each one's key among the keys that occur."""
    if not len(keys):
        return keys, keys
    bits = len(keys).bit_length()
    if int(keys.max()).bit_length() + bits < 64:
        packed = np.sort(keys << bits | np.arange(len(keys)))
        order, keys = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    return order, np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])


def _earlier(group: tuple[np.ndarray, np.ndarray], events: np.ndarray) -> np.ndarray:
    """How many events lie before each position in its group."""
    order, number = group
    out = np.zeros(len(events), dtype=np.int64)
    if len(order):
        own = events[order].astype(np.int64)
        before = np.cumsum(own) - own
        first = np.concatenate([[True], number[1:] != number[:-1]])
        out[order] = before - before[first][np.cumsum(first) - 1]
    return out


# --- models: the mass of every symbol ------------------------------------------------------


def restaurant(base: float, a: float, b: float):
    """``adaptive.crp``."""

    def mass(s: Stream) -> np.ndarray:
        all_of, own = s.grams(1)
        every = np.ones(len(s), dtype=bool)
        nx, n = _earlier(own, every), _earlier(all_of, every)
        u = _earlier(all_of, nx == 0)
        total = n + a
        return np.where(total == 0, base, (np.where(nx > 0, nx - b, 0.0) + (a + b * u) * base) / np.where(total == 0, 1.0, total))

    return mass


def order_k(k: int, size: int, a: float = 0.5):
    """``adaptive.order_k``."""

    def mass(s: Stream) -> np.ndarray:
        grams, every = s.grams(k + 1), np.ones(len(s), dtype=bool)
        return (_earlier(grams[k + 1], every) + a) / (_earlier(s.contexts(grams[k], k), every) + a * size)

    return mass


def _levels(s: Stream, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(exists, nx, n, u) of the contexts of 0 .. depth symbols; events as in ``adaptive._levels``."""
    grams, out, passed = s.grams(depth + 1), [], None
    for k in range(depth, -1, -1):
        events = s.pos >= k if passed is None else (s.pos == k) | ((s.pos > k) & passed)
        nx = _earlier(grams[k + 1], events)
        passed = events & (nx == 0)
        inside = s.contexts(grams[k], k)
        out.append((s.pos >= k, nx, _earlier(inside, events), _earlier(inside, passed)))
    return out[::-1]


def blending(depth: int, base: float, a, b):
    """``adaptive.blending``; ``a`` and ``b`` are numbers, or functions of the depth and the array u."""
    alpha = a if callable(a) else lambda k, u: float(a)
    beta = b if callable(b) else lambda k, u: float(b)

    def mass(s: Stream) -> np.ndarray:
        out = np.full(len(s), base)
        for k, (exists, nx, n, u) in enumerate(_levels(s, depth)):
            al, be = alpha(k, u), beta(k, u)
            known = exists & (n > 0)
            blended = (np.where(nx > 0, nx - be, 0.0) + (al + u * be) * out) / np.where(known, n + al, 1.0)
            out = np.where(known, blended, out)
        return out

    return mass


def by_depth(values: list[float]):
    return lambda k, u: float(values[min(k, len(values) - 1)])


def by_fanout(values: list[float]):
    table = np.array(values, dtype=np.float64)
    return lambda k, u: table[np.clip(u, 1, len(table)) - 1]


def by_depth_and_fanout(rows: list[list[float]]):
    return lambda k, u: by_fanout(rows[min(k, len(rows) - 1)])(k, u)


def ppmd(depth: int, base: float):
    """``adaptive.ppmd``."""

    def mass(s: Stream) -> np.ndarray:
        out = np.full(len(s), base)
        for exists, nx, n, u in _levels(s, depth):
            twice = np.where(n > 0, 2 * n, 1)
            out = np.where(exists & (n > 0), np.where(nx > 0, (2 * nx - 1) / twice, u / twice * out), out)
        return out

    return mass


def bits(mass: Callable[[Stream], np.ndarray]) -> Callable[[Stream], np.ndarray]:
    """Code lengths of documents from the masses of their symbols."""
    return lambda s: s.totals(-np.log2(mass(s)))


def polya_bits(size: int, a: float = 0.5) -> Callable[[Stream], np.ndarray]:
    """Code lengths under ``adaptive.polya``.

    The masses at a node are ratios of rising factorials, whatever the order of the symbols:
    the final counts of a node tell what all its steps add up to.
    """
    nodes, todo = [], [(0, size - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi > lo:
            mid = lo + (hi - lo + 1) // 2
            nodes.append((lo, mid, hi + 1))
            todo += [(lo, mid - 1), (mid, hi)]
    lo, mid, hi = np.array(nodes).T

    def total(s: Stream) -> np.ndarray:
        most = np.arange(s.sizes.max(initial=0))
        one, both = (np.concatenate([[0.0], np.cumsum(np.log2(most + x))]) for x in (a, 2 * a))
        out = np.zeros(s.n_docs)
        for d, (start, n) in enumerate(zip(s.starts.tolist(), s.sizes.tolist(), strict=True)):
            sums = np.concatenate([[0], np.cumsum(np.bincount(s.sym[start : start + n], minlength=size))])
            left, right = sums[mid] - sums[lo], sums[hi] - sums[mid]
            out[d] = (both[left + right] - one[left] - one[right]).sum()
        return out

    return total


# --- columns -----------------------------------------------------------------------------


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def octets(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def batches(documents: Iterator[list[np.ndarray]], most: int) -> Iterator[Stream]:
    held, n = [], 0
    for texts in documents:
        more = sum(map(len, texts))
        if held and n + more > most:
            yield Stream(held)
            held, n = [], 0
        held.append(texts)
        n += more
    if held:
        yield Stream(held)


def bits_column(texts: Column, symbols: Callable[[str], np.ndarray], model: Callable[[Stream], np.ndarray], batch: int = BATCH) -> Column:
    """struct(n_symbols, bits) of each document, an array of texts."""

    @F.pandas_udf("n_symbols long, bits double")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in series:
            for s in batches(([symbols(t) for t in texts] for texts in values), batch):
                yield pd.DataFrame({"n_symbols": s.sizes, "bits": model(s)})

    return run(texts)


def merged(texts: Column) -> Column:
    """The characters of a document's texts as one text, in the order of ``Stream``."""
    placed = F.transform(texts, lambda t, k: F.transform(F.split(t, ""), lambda c, i: F.struct(i.alias("i"), k.alias("k"), c.alias("c"))))
    return F.when(F.size(texts) == 1, texts[0]).otherwise(F.array_join(F.transform(F.array_sort(F.flatten(placed)), lambda s: s["c"]), ""))


def total_bits(docs: DataFrame, symbols: Callable[[str], np.ndarray], model: Callable[[Stream], np.ndarray], **more: Column) -> DataFrame:
    """(doc_id, n_symbols, bits): code length by document, rounded to 3 places, as ``adaptive.total_bits`` gives it; then
    the columns in ``more``, which are of the array ``texts`` of a document."""
    whole = docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    found = whole.select("doc_id", bits_column(F.col("texts"), symbols, model).alias("b"), *(c.alias(k) for k, c in more.items()))
    return found.select("doc_id", "b.n_symbols", F.round("b.bits", 3).alias("bits"), *more)
