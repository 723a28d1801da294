"""Probabilistic automata learnt by state merging (the ALERGIA scheme).

Training strings form a prefix tree with counts. States are visited in breadth-first
order; each is merged into the first earlier state whose outgoing and stopping
frequencies do not differ by more than the Hoeffding bound, recursively. What is left
is a deterministic automaton with a probability on every transition and stop.

``learn`` takes a list and its whole prefix tree. For any number of strings the tree is kept
whole for the first ``DEPTH`` characters; places beyond are told apart by the ``LAST`` classes
before them. ``steps`` counts every character and stop of every string at these places, counts
of parts add up, and ``merge`` merges the places as ``learn`` merges nodes: how many places there
are depends on the classes alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping

#: Characters by which the places of long prefix trees are told apart: first ones, and last ones beyond.
DEPTH, LAST = 4, 3
#: The step that ends a string.
STOP = ""
#: Classes of characters and how many characters each one has; other characters are classes of their own.
CLASSES = {"d": 10, "a": 6, "l": 20, "A": 6, "L": 20}
OTHER = 1


def abstract(text: str) -> str:
    """The classes of the characters: digits, a-f, g-z, A-F, G-Z; other characters stand for themselves."""
    return text.translate(_TO_CLASS)


_TO_CLASS = {c: "d" for c in range(48, 58)}
_TO_CLASS |= {c: "a" if c < 103 else "l" for c in range(97, 123)}
_TO_CLASS |= {c: "A" if c < 71 else "L" for c in range(65, 91)}


class Automaton:
    """Transitions with log2 probabilities, after merging."""

    def __init__(self, arcs: list[dict[str, tuple[int, float]]], stops: list[float], floor: float):
        self.arcs, self.stops, self.floor = arcs, stops, floor

    def bits(self, text: str) -> float:
        """log2 likelihood of a string: its path of classes, each character uniform in its class."""
        state, total = 0, 0.0
        for c in abstract(text):
            arc = self.arcs[state].get(c)
            size = math.log2(CLASSES.get(c, OTHER))
            if arc is None:
                total += self.floor - size
                state = 0
            else:
                state, p = arc
                total += p - size
        return total + self.stops[state]


def learn(strings: Iterable[str], alpha: float = 0.01, smoothing: float = 0.5) -> Automaton:
    """Learn an automaton; ``alpha`` is the confidence of the merge test (smaller merges more)."""
    next_: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    ends, total = [0], [0]
    for s in sorted(strings):
        at = 0
        total[0] += 1
        for c in abstract(s):
            count[at][c] = count[at].get(c, 0) + 1
            if c not in next_[at]:
                next_[at][c] = len(next_)
                next_.append({})
                count.append({})
                ends.append(0)
                total.append(0)
            at = next_[at][c]
            total[at] += 1
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        seen = set()
        while todo:
            x, y = todo.pop()
            if (x, y) in seen:
                continue
            seen.add((x, y))
            if differ(ends[x], total[x], ends[y], total[y]):
                return False
            for c in sorted(count[x].keys() | count[y].keys()):
                if differ(count[x].get(c, 0), total[x], count[y].get(c, 0), total[y]):
                    return False
                if c in next_[x] and c in next_[y]:
                    todo.append((next_[x][c], next_[y][c]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            ends[x] += ends[y]
            total[x] += total[y]
            for c, n in count[y].items():
                count[x][c] = count[x].get(c, 0) + n
                if c in next_[x]:
                    todo.append((next_[x][c], next_[y][c]))
                else:
                    next_[x][c] = next_[y][c]

    kept, edge = [0], sorted(next_[0].items())
    parent = [(0, c) for c, _ in edge]
    while parent:
        p, c = parent.pop(0)
        b = next_[p][c]
        if b in kept:
            continue
        for a in kept:
            if compatible(a, b):
                next_[p][c] = a
                fold(a, b)
                break
        else:
            kept.append(b)
        # the frontier is what kept states reach that is not kept yet
        parent = [(k, c) for k in kept for c, t in sorted(next_[k].items()) if t not in kept]
    number = {s: i for i, s in enumerate(kept)}
    symbols = len(CLASSES) + 8
    arcs, stops = [], []
    for s in kept:
        whole = total[s] + smoothing * (symbols + 1)
        arcs.append({c: (number[next_[s][c]], math.log2((n + smoothing) / whole)) for c, n in count[s].items()})
        stops.append(math.log2((ends[s] + smoothing) / whole))
    return Automaton(arcs, stops, math.log2(smoothing / (sum(total) / max(len(kept), 1) + smoothing * (symbols + 1))))


def after(place: str, c: str) -> str:
    """The place that class ``c`` leads to: 0 and the first classes, or 1 and the last ones."""
    if place[0] == "0" and len(place) <= DEPTH:
        return place + c
    return "1" + (place[1:] + c)[-LAST:]


def steps(strings: Iterable[str]) -> Counter[tuple[str, str]]:
    """How often strings go on with a class (or STOP) at a place."""
    out: Counter[tuple[str, str]] = Counter()
    for s in strings:
        classes = abstract(s)
        out.update(("0" + classes[:i], c) for i, c in enumerate(classes[: DEPTH + 1]))
        out.update(("1" + classes[i - LAST : i], classes[i]) for i in range(DEPTH + 1, len(classes)))
        out["0" + classes if len(classes) <= DEPTH else "1" + classes[-LAST:], STOP] += 1
    return out


def merge(counts: Mapping[tuple[str, str], int], alpha: float = 0.01, smoothing: float = 0.5) -> Automaton:
    """The automaton of counted ``steps``."""
    count: dict[str, dict[str, int]] = {"0": {}}
    for (place, c), n in sorted(counts.items()):
        count.setdefault(place, {})[c] = n
    total = {p: sum(own.values()) for p, own in count.items()}
    next_ = {p: {c: after(p, c) for c in own if c != STOP} for p, own in count.items()}
    joined = {p: p for p in count}
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def find(p: str) -> str:
        while joined[p] != p:
            joined[p] = p = joined[joined[p]]
        return p

    def differ(x: str, y: str) -> bool:
        if not total[x] or not total[y]:
            return False
        own, other, allowed = count[x], count[y], bound * (1 / math.sqrt(total[x]) + 1 / math.sqrt(total[y]))
        return any(abs(own.get(c, 0) / total[x] - other.get(c, 0) / total[y]) > allowed for c in own.keys() | other.keys())

    def compatible(a: str, b: str) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if x == y or (x, y) in seen:
                continue
            seen.add((x, y))
            if differ(x, y):
                return False
            todo += [(find(next_[x][c]), find(next_[y][c])) for c in next_[x].keys() & next_[y].keys()]
        return True

    def fold(a: str, b: str) -> None:
        todo = [(a, b)]
        while todo:
            x, y = map(find, todo.pop())
            if x == y:
                continue
            if rank.get(y, len(rank)) < rank.get(x, len(rank)):
                x, y = y, x
            joined[y] = x
            total[x] += total[y]
            for c, n in count[y].items():
                count[x][c] = count[x].get(c, 0) + n
            for c, p in next_[y].items():
                if c in next_[x]:
                    todo.append((next_[x][c], p))
                else:
                    next_[x][c] = p

    # breadth first: each place that kept ones reach joins the first kept one it agrees with, or is kept
    kept, rank, at = ["0"], {"0": 0}, 0
    while at < len(kept):
        for c in sorted(next_[find(kept[at])]):
            b = find(next_[find(kept[at])][c])
            if b in rank:
                continue
            same = next((a for a in kept if find(a) == a and compatible(a, b)), None)
            if same is None:
                rank[b] = len(kept)
                kept.append(b)
            else:
                fold(same, b)
                # what joined may bring kept places new steps
                at = -1
                break
        at += 1
    kept = [k for k in kept if find(k) == k]
    number = {k: i for i, k in enumerate(kept)}
    symbols = len(CLASSES) + 8
    arcs, stops = [], []
    for k in kept:
        whole = total[k] + smoothing * (symbols + 1)
        arcs.append({c: (number[find(p)], math.log2((count[k][c] + smoothing) / whole)) for c, p in next_[k].items()})
        stops.append(math.log2((count[k].get(STOP, 0) + smoothing) / whole))
    return Automaton(arcs, stops, math.log2(smoothing / (sum(total[k] for k in kept) / len(kept) + smoothing * (symbols + 1))))


class Pairs:
    """Letters by the letter before, any case, digits and other characters by class: how words are spelt."""

    def __init__(self, counts: Mapping[tuple[str, str], int], smoothing: float = 0.2):
        self.count: dict[str, int] = {}
        self.total: dict[str, int] = {}
        self.smoothing = smoothing
        for (a, b), n in counts.items():
            self.count[a + b] = self.count.get(a + b, 0) + n
            self.total[a] = self.total.get(a, 0) + n

    @classmethod
    def steps(cls, strings: Iterable[str]) -> Counter[tuple[str, str]]:
        """How often a letter follows another."""
        out: Counter[tuple[str, str]] = Counter()
        for s in strings:
            out.update(cls._steps(s))
        return out

    @staticmethod
    def _steps(text: str) -> Iterable[tuple[str, str]]:
        plain = ["0" if "0" <= c <= "9" else c.lower() for c in text]
        return zip(["^", *plain], [*plain, "$"], strict=True)

    def bits(self, text: str) -> float:
        """log2 likelihood; a digit is one of ten, a letter is capital or not like the one before."""
        total = 0.0
        whole = 40 * self.smoothing
        for a, b in self._steps(text):
            total += math.log2((self.count.get(a + b, 0) + self.smoothing) / (self.total.get(a, 0) + whole))
        total -= math.log2(10) * sum("0" <= c <= "9" for c in text)
        upper = [c.isupper() for c in text if c.isalpha()]
        changes = sum(x != y for x, y in zip(upper, upper[1:], strict=False))
        return total + changes * math.log2(0.05) + (len(upper) - changes) * math.log2(0.95)
