"""Word windows of a text as numpy arrays: hashes of runs of words without a loop over runs."""

from __future__ import annotations

import numpy as np
import xxhash

#: Fixed odd multipliers of the rolling hashes.
BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157))
#: Distinct words whose hashes a worker keeps; it starts anew beyond them, within a long text too.
CACHE = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            both = []
            for factor in (self.base, self.inverse):
                row = np.full(size, factor, dtype=np.uint64)
                row[0] = 1
                both.append(np.multiply.accumulate(row))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


_POWERS = tuple(Powers(b) for b in BASES)


class WordHashes(dict):
    """Word to its XXH64, computed once while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words), dtype=np.uint64)
        for at in range(0, len(words), CACHE):
            part = words[at : at + CACHE]
            out[at : at + len(part)] = np.fromiter(map(self.__getitem__, part), dtype=np.uint64, count=len(part))
            if len(self) > CACHE:
                self.clear()
        return out


#: One for all tasks of a worker: words recur from task to task.
HASHES = WordHashes()


def split(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: what lies between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def rolling(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every run of ``size`` words, by position of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _POWERS[which].get(len(words))
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up, out=prefix[1:])
    return mix((prefix[size:] - prefix[:n]) * down[:n])


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every run of ``width`` values."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span < width:
        step = min(span, width - span)
        values = pick(values[:-step], values[step:])
        span += step
    return values


def chosen(values: np.ndarray, minima: np.ndarray, width: int) -> np.ndarray:
    """Values at the positions that are the minimum of some run, ties included."""
    if not len(minima):
        return values[:0]
    pad = np.zeros(width - 1, dtype=values.dtype)
    best = slide(np.concatenate([pad, minima, pad]), width, np.maximum)
    return values[values == best]


def covered(starts: np.ndarray, counts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window of ``size`` words; windows begin at runs (start, count)."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts - 1 + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def runs(positions: np.ndarray) -> np.ndarray:
    """Sorted positions as rows (first, count) of consecutive ones."""
    if not len(positions):
        return np.zeros((0, 2), dtype=np.uint32)
    cut = np.flatnonzero(np.diff(positions) != 1) + 1
    first = positions[np.concatenate([[0], cut])]
    count = np.diff(np.concatenate([[0], cut, [len(positions)]]))
    return np.stack([first, count], axis=1).astype(np.uint32)
