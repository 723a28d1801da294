"""Adaptive models that are coded and learnt symbol by symbol.

A model stack has a base over an integer alphabet and layers above it. ``encode``
narrows the coder by what the model believes of a symbol, ``decode`` finds the symbol,
``learn`` updates. The top model codes every symbol; every layer learns every symbol; the
end mark is coded last and not learnt. ``omit`` holds symbols that cannot occur.
Probabilities are ratios of integers, so decoding repeats coding exactly.
"""

from __future__ import annotations

import math
from fractions import Fraction

from quillbit.operators.coder import DOUBLE_TOTAL, Decoder, Encoder, split

NONE: frozenset[int] = frozenset()
NOTHING: dict[int, int] = {}


class Uniform:
    """Every symbol of ``range(size)`` alike."""

    def __init__(self, size: int):
        self.size = size

    def mass(self, x: int) -> float:
        return 1.0 / self.size

    def encode(self, x: int, coder: Encoder, omit=NONE) -> None:
        at = x - sum(o < x for o in omit)
        coder.narrow(at, at + 1, self.size - len(omit))

    def decode(self, coder: Decoder, omit=NONE) -> int:
        total = self.size - len(omit)
        at = coder.target(total)
        coder.narrow(at, at + 1, total)
        for o in sorted(omit):
            if o <= at:
                at += 1
        return at

    def learn(self, x: int) -> None:
        pass


class Weighted:
    """Fixed integer weights of ranges: (first, last, weight of each symbol)."""

    def __init__(self, ranges: list[tuple[int, int, int]]):
        self.ranges, self.total = ranges, sum((b - a + 1) * w for a, b, w in ranges)

    def weight(self, x: int) -> int:
        return next(w for a, b, w in self.ranges if a <= x <= b)

    def mass(self, x: int) -> float:
        return self.weight(x) / self.total

    def between(self, lo: int, hi: int) -> int:
        """Weight of the symbols lo..hi."""
        return sum((min(b, hi) - max(a, lo) + 1) * w for a, b, w in self.ranges if a <= hi and b >= lo)

    def encode(self, x: int, coder: Encoder, omit=NONE) -> None:
        gone = {o: self.weight(o) for o in omit}
        low = self.between(self.ranges[0][0], x - 1) - sum(w for o, w in gone.items() if o < x)
        coder.narrow(low, low + self.weight(x), self.total - sum(gone.values()))

    def decode(self, coder: Decoder, omit=NONE) -> int:
        total = self.total - sum(self.weight(o) for o in omit)
        target = coder.target(total)
        lo, hi = self.ranges[0][0], self.ranges[-1][1]
        start = lo

        def below(x: int) -> int:
            return self.between(start, x - 1) - sum(self.weight(o) for o in omit if o < x)

        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if below(mid) <= target else (lo, mid - 1)
        while lo in omit:
            lo -= 1
        low = below(lo)
        coder.narrow(low, low + self.weight(lo), total)
        return lo

    def learn(self, x: int) -> None:
        pass


class Split:
    """A node of a Polya tree: pseudo-counts, and by side what was learnt there: occurrences, distinct symbols, and the
    share of the mass that these symbols have."""

    __slots__ = ("a", "b", "gone", "kinds", "level", "n", "unit", "up")

    def __init__(self, prior: tuple[int, int, int], up: tuple[Split, int] | None):
        self.a, self.b, self.unit = prior
        self.n, self.kinds, self.gone = [0, 0], [0, 0], [0.0, 0.0]
        self.up, self.level = up, 0 if up is None else up[0].level + 1

    def weights(self) -> tuple[int, int]:
        return self.a + self.n[0] * self.unit, self.b + self.n[1] * self.unit


class PolyaTree:
    """A binary tree of Beta-Bernoulli nodes over ``range(size)``.

    A node over lo..hi splits before ``lo + (hi - lo + 1) // 2``. ``priors`` gives the
    pseudo-counts (left, right) of a node as integers over a common ``unit``. What is learnt
    waits until something is coded. Layers above leave the base to new symbols, so the
    omitted ones are those that were learnt: their share of each node's mass is kept on the
    nodes, and a new symbol costs one step for each level. Other omissions are summed anew.
    """

    def __init__(self, size: int, priors, unit: int):
        self.size, self.priors, self.unit = size, priors, unit
        self.nodes: dict[tuple[int, int], Split] = {}
        #: By symbol the nodes on its way, with the side taken at each.
        self.ways: dict[int, list[tuple[Split, int]]] = {}
        self.waiting: dict[int, int] = {}
        self.seen: set[int] = set()
        #: Symbols learnt since shares were last summed.
        self.stale: set[int] = set()

    def _prior(self, lo: int, mid: int, hi: int) -> tuple[int, int, int]:
        return (*self.priors(lo, mid, hi), self.unit)

    def _node(self, lo: int, mid: int, hi: int, up: tuple[Split, int] | None) -> Split:
        found = self.nodes.get((lo, hi))
        if found is None:
            found = self.nodes[(lo, hi)] = Split(self._prior(lo, mid, hi), up)
        return found

    def _way(self, x: int) -> list[tuple[Split, int]]:
        way = self.ways.get(x)
        if way is None:
            way, lo, hi, up = [], 0, self.size - 1, None
            while lo < hi:
                mid = lo + (hi - lo + 1) // 2
                side = int(x >= mid)
                up = self._node(lo, mid, hi, up), side
                way.append(up)
                lo, hi = (mid, hi) if side else (lo, mid - 1)
            self.ways[x] = way
        return way

    def _settle(self) -> None:
        """Count what was learnt."""
        for x, n in self.waiting.items():
            new = x not in self.seen
            for node, side in self._way(x):
                node.n[side] += n
                node.kinds[side] += new
            self.seen.add(x)
            self.stale.add(x)
        self.waiting.clear()

    def _share(self, lo: int, mid: int, hi: int, node: Split) -> float:
        """The share of a node's mass that learnt symbols have."""
        if sum(node.kinds) == hi - lo + 1:
            return 1.0
        a, b = node.weights()
        return (a * node.gone[0] + b * node.gone[1]) / (a + b)

    def _sum_shares(self) -> None:
        levels: list[dict[tuple[int, int], tuple[int, Split]]] = []
        for x in self.stale:
            lo, hi = 0, self.size - 1
            for depth, (node, side) in enumerate(self._way(x)):
                if depth == len(levels):
                    levels.append({})
                mid = lo + (hi - lo + 1) // 2
                levels[depth][(lo, hi)] = mid, node
                lo, hi = (mid, hi) if side else (lo, mid - 1)
                if lo == hi:
                    node.gone[side] = 1.0
        for level in reversed(levels):
            for (lo, hi), (mid, node) in level.items():
                if node.up is not None:
                    up, side = node.up
                    up.gone[side] = self._share(lo, mid, hi, node)
        self.stale.clear()

    def mass(self, x: int) -> float:
        self._settle()
        p = 1.0
        for node, side in self._way(x):
            both = node.weights()
            p = p * both[side] / sum(both)
        return p

    def _omitted(self, omit: list[int], lo: int, hi: int, up=None) -> float:
        """The share of the mass of lo..hi that the omitted symbols in it have."""
        if not omit:
            return 0.0
        if len(omit) == hi - lo + 1:
            return 1.0
        mid = lo + (hi - lo + 1) // 2
        node = self._node(lo, mid, hi, up)
        a, b = node.weights()
        left = self._omitted([o for o in omit if o < mid], lo, mid - 1, (node, 0))
        return (a * left + b * self._omitted([o for o in omit if o >= mid], mid, hi, (node, 1))) / (a + b)

    def _step(self, node: Split, sizes: tuple[int, int], kinds, gone) -> tuple[int, int]:
        """(weight of the left side, total) for the coder; a side that is all omitted gets nothing."""
        a, b = node.weights()
        if not kinds[0] and not kinds[1]:
            return a, a + b
        if kinds[0] == sizes[0]:
            return 0, 1
        if kinds[1] == sizes[1]:
            return 1, 1
        x, y = a * (1 - gone[0]), b * (1 - gone[1])
        return split(x / (x + y)), DOUBLE_TOTAL

    def _walk(self, omit, choose) -> int:
        """Go down by ``choose(left, total, mid)``, which tells the side; gives the symbol."""
        self._settle()
        learnt = bool(omit) and omit == self.seen
        if learnt:
            self._sum_shares()
        rest = [] if learnt else sorted(omit)
        lo, hi, up = 0, self.size - 1, None
        while lo < hi:
            mid = lo + (hi - lo + 1) // 2
            node = self._node(lo, mid, hi, up)
            if learnt:
                left, total = self._step(node, (mid - lo, hi - mid + 1), node.kinds, node.gone)
            elif rest:
                parts = [o for o in rest if o < mid], [o for o in rest if o >= mid]
                kinds = tuple(map(len, parts))
                gone = self._omitted(parts[0], lo, mid - 1, (node, 0)), self._omitted(parts[1], mid, hi, (node, 1))
                left, total = self._step(node, (mid - lo, hi - mid + 1), kinds, gone)
            else:
                a, b = node.weights()
                left, total = a, a + b
            side = choose(left, total, mid)
            if rest:
                rest = parts[side]
            up = node, side
            lo, hi = (mid, hi) if side else (lo, mid - 1)
        return lo

    def encode(self, x: int, coder: Encoder, omit=NONE) -> None:
        def choose(left: int, total: int, mid: int) -> int:
            if x < mid:
                if left < total:
                    coder.narrow(0, left, total)
                return 0
            if left:
                coder.narrow(left, total, total)
            return 1

        self._walk(omit, choose)

    def decode(self, coder: Decoder, omit=NONE) -> int:
        def choose(left: int, total: int, mid: int) -> int:
            if left == total or left and coder.target(total) < left:
                if left < total:
                    coder.narrow(0, left, total)
                return 0
            if left:
                coder.narrow(left, total, total)
            return 1

        return self._walk(omit, choose)

    def learn(self, x: int) -> None:
        self.waiting[x] = self.waiting.get(x, 0) + 1


def even_priors(a: Fraction) -> tuple:
    """The same pseudo-count ``a`` on each side."""
    return (lambda lo, mid, hi: (a.numerator, a.numerator)), a.denominator


def mass_priors(between, g: Fraction) -> tuple:
    """Pseudo-counts that sum to about ``g`` at every node, in proportion to ``between(lo, hi)``.

    Masses are scaled to about eight bits: divided by a 256th of the power of two above
    their sum; each side keeps at least 1, and the left one is the rest of the sum.
    """
    cache: dict[tuple[int, int], tuple[int, int]] = {}

    def priors(lo: int, mid: int, hi: int) -> tuple[int, int]:
        found = cache.get((lo, hi))
        if found is None:
            whole, right = between(lo, hi), between(mid, hi)
            scale = max((1 << whole.bit_length()) >> 8, 1)
            y = max(right // scale, 1)
            x = max(whole // scale - y, 1)
            found = cache[(lo, hi)] = (x, y)
        return found

    def scaled(lo: int, mid: int, hi: int) -> tuple[int, int]:
        x, y = priors(lo, mid, hi)
        # x/(x+y) of g against whole counts: over the common unit (x+y) * denominator
        return x * g.numerator, y * g.numerator, (x + y) * g.denominator

    return scaled


class MassPolyaTree(PolyaTree):
    """A Pólya tree whose node priors follow a base mass; the unit differs from node to node."""

    def __init__(self, size: int, between, g: Fraction = Fraction(1, 2)):
        self._scaled = mass_priors(between, g)
        super().__init__(size, None, 1)

    def _prior(self, lo: int, mid: int, hi: int) -> tuple[int, int, int]:
        return self._scaled(lo, mid, hi)


#: Bits of the largest total that a restaurant hands to the coder.
FINEST = 48


def _base_weights(base):
    """Integer weights of a base: its own where it has some, else its masses in units of the coder's."""
    if isinstance(base, Uniform):
        return (lambda x: 1), base.size
    if isinstance(base, Weighted):
        return base.weight, base.total
    return (lambda x: split(base.mass(x))), DOUBLE_TOTAL


class CRP:
    """A Chinese-restaurant layer: strength ``a``, discount ``b``, one table for each dish."""

    def __init__(self, base, a: Fraction, b: Fraction):
        self.base = base
        unit = math.lcm(a.denominator, b.denominator)
        self.a, self.b, self.unit = int(a * unit), int(b * unit), unit
        self.counts: dict[int, int] = {}
        self.n = 0

    def mass(self, x: int) -> float:
        c = self.counts.get(x, 0)
        new = self.a + self.b * len(self.counts)
        total = self.n * self.unit + self.a
        own = c * self.unit - self.b if c else 0
        return (own + new * self.base.mass(x)) / total if total else self.base.mass(x)

    def _weights(self, omit) -> tuple[list[tuple[int, int]], int]:
        """(symbol, weight) of the dishes that may occur, and the weight of all that may: each dish has its table and
        its part of what new tables take from the base, as ``mass`` says; the rest of the base is for new dishes."""
        weight, whole = _base_weights(self.base)
        live = [(s, c) for s, c in self.counts.items() if s not in omit]
        new = self.a + self.b * len(live)
        base = whole - sum(map(weight, omit))
        rows = [(s, (c * self.unit - self.b) * base + new * weight(s)) for s, c in live]
        return rows, (sum(c for _, c in live) * self.unit + self.a) * base

    def _steps(self, omit):
        """(symbol, lo, hi, total) by dish, then for new dishes under None. Totals that would be too fine for the coder
        lose low bits, and every region keeps at least one unit."""
        rows, total = self._weights(omit)
        drop = max(total.bit_length() - FINEST, 0)
        scaled = (total >> drop) + len(rows) + 1 if drop else total
        low = at = 0
        for i, (s, w) in enumerate(rows):
            low += w
            end = (low >> drop) + i + 1 if drop else low
            yield s, at, end, scaled
            at = end
        yield None, at, scaled, scaled

    def encode(self, x: int, coder: Encoder, omit=NONE) -> None:
        if not self.counts:
            self.base.encode(x, coder, omit)
            return
        for s, lo, hi, total in self._steps(omit):
            if s == x or s is None:
                if lo or hi < total:
                    coder.narrow(lo, hi, total)
                break
        if s is None:
            self.base.encode(x, coder, frozenset(omit) | self.counts.keys())

    def decode(self, coder: Decoder, omit=NONE) -> int:
        if not self.counts:
            return self.base.decode(coder, omit)
        target = None
        for s, lo, hi, total in self._steps(omit):
            target = coder.target(total) if target is None else target
            if target < hi:
                break
        if lo or hi < total:
            coder.narrow(lo, hi, total)
        return self.base.decode(coder, frozenset(omit) | self.counts.keys()) if s is None else s

    def learn(self, x: int) -> None:
        self.counts[x] = self.counts.get(x, 0) + 1
        self.n += 1


class Context:
    """A node of the context tree: counts, deeper contexts by symbol, and the shorter context."""

    __slots__ = ("counts", "deeper", "depth", "n", "shorter")

    def __init__(self, shorter: Context | None):
        self.counts: dict[int, int] = {}
        self.deeper: dict[int, Context] = {}
        self.shorter, self.n = shorter, 0
        self.depth = shorter.depth + 1 if shorter else 0


class PPM:
    """Prediction by partial matching with exclusion and one-table counts.

    A symbol has (c - b) of (n + a) in a context, what is new there (a + b k), over the
    children that no longer context has excluded; contexts without any cost nothing. The
    base codes what the root does not have. Learning counts in the deepest context, and
    in each shorter one only while the count there was new.
    """

    def __init__(self, base, depth: int = 5, a: Fraction = Fraction(0), b: Fraction = Fraction(1, 2), special: dict | None = None):
        self.base, self.depth = base, depth
        self.a, self.b, self.unit = self._over(a, b)
        #: For symbols in a set, strengths of their own at contexts that hold them: (symbols, a, b).
        self.special = None
        if special:
            self.special = (frozenset(special["symbols"]), *self._over(special["a"], special["b"]))
        self.root = self.at = Context(None)

    @staticmethod
    def _over(a: Fraction, b: Fraction) -> tuple[int, int, int]:
        unit = math.lcm(a.denominator, b.denominator)
        return int(a * unit), int(b * unit), unit

    def _parts(self, node: Context, excluded) -> tuple[list[tuple[int, int]], int]:
        """(symbol, weight) of the children that are not excluded, and the weight of what is new."""
        a, b, unit = self.a, self.b, self.unit
        if self.special and node.counts.keys() & self.special[0]:
            _, a, b, unit = self.special
        if excluded:
            rows = [(s, c * unit - b) for s, c in node.counts.items() if s not in excluded]
        else:
            rows = [(s, c * unit - b) for s, c in node.counts.items()]
        return rows, a + b * len(rows)

    def _strengths(self, node: Context) -> tuple[int, int, int]:
        if self.special and node.counts.keys() & self.special[0]:
            return self.special[1:]
        return self.a, self.b, self.unit

    def _live(self, node: Context, gone: dict) -> tuple[int, int, int, int]:
        """(weight of the children that ``gone`` has not excluded, of what is new, strengths' b and unit); no child, no weight.

        A deeper context's children are children here too, so sums are those of all less theirs."""
        a, b, unit = self._strengths(node)
        k = len(node.counts) - len(gone)
        n = node.n - sum(map(node.counts.__getitem__, gone)) if gone else node.n
        return n * unit - b * k, a + b * k if k else 0, b, unit

    def encode(self, x: int, coder: Encoder, omit=NONE) -> None:
        if omit:
            self._encode_without(x, coder, omit)
            return
        node, gone = self.at, NOTHING
        while node is not None:
            counts = node.counts
            if len(counts) > len(gone):
                total, new, b, unit = self._live(node, gone)
                count = counts.get(x)
                if count is not None:
                    before = passed = 0
                    for s, c in counts.items():
                        if s == x:
                            break
                        if s not in gone:
                            before += c
                            passed += 1
                    low = before * unit - b * passed
                    coder.narrow(low, low + count * unit - b, total + new)
                    return
                coder.narrow(total, total + new, total + new)
                gone = counts
            node = node.shorter
        self.base.encode(x, coder, gone.keys())

    def _encode_without(self, x: int, coder: Encoder, omit) -> None:
        node, excluded = self.at, omit
        while node is not None:
            counts = node.counts
            rows, new = self._parts(node, excluded)
            if rows:
                total, low = sum(w for _, w in rows), 0
                for s, w in rows:
                    if s == x:
                        coder.narrow(low, low + w, total + new)
                        return
                    low += w
                coder.narrow(total, total + new, total + new)
            excluded = counts.keys() | omit
            node = node.shorter
        self.base.encode(x, coder, excluded)

    def decode(self, coder: Decoder, omit=NONE) -> int:
        node, gone = self.at, NOTHING
        while node is not None:
            counts = node.counts
            if omit:
                rows, new = self._parts(node, gone.keys() | omit)
                total = sum(w for _, w in rows)
            elif len(counts) > len(gone):
                total, new, b, unit = self._live(node, gone)
                rows = [(s, c * unit - b) for s, c in counts.items() if s not in gone]
            else:
                rows = []
            if rows:
                target, low = coder.target(total + new), 0
                if target < total:
                    for s, w in rows:
                        if target < low + w:
                            coder.narrow(low, low + w, total + new)
                            return s
                        low += w
                coder.narrow(total, total + new, total + new)
            if counts:
                gone = counts
            node = node.shorter
        return self.base.decode(coder, gone.keys() | omit if omit else gone.keys())

    def masses(self, alphabet: list[int]) -> dict[int, float]:
        """What the coder would give each symbol, in one walk over the contexts."""
        out: dict[int, float] = {}
        left, excluded, node = 1.0, set(), self.at
        while node is not None:
            if node.counts:
                rows, new = self._parts(node, excluded)
                if rows:
                    total = sum(w for _, w in rows) + new
                    out.update((s, left * w / total) for s, w in rows)
                    left *= new / total
                excluded |= node.counts.keys()
            node = node.shorter
        rest = 1.0 - sum(map(self.base.mass, excluded))
        return {x: out[x] if x in out else left * self.base.mass(x) / rest for x in alphabet}

    def learn(self, x: int) -> None:
        node = self.at
        while node is not None:
            node.n += 1
            count = node.counts[x] = node.counts.get(x, 0) + 1
            if count > 1:
                break
            node = node.shorter
        # the next context: one deeper until the greatest depth, then the shorter one's child
        start = self.at if self.at.depth < self.depth else self.at.shorter
        self.at = self._child(start, x) if self.depth else self.root

    def _child(self, node: Context | None, x: int) -> Context:
        if node is None:
            return self.root
        found = node.deeper.get(x)
        if found is None:
            found = node.deeper[x] = Context(self._child(node.shorter, x))
        return found


class LZW:
    """Dictionary coding; indices are coded uniformly over the dictionary as it is.

    The dictionary begins with the alphabet (``seeded``) or empty. In an empty one index 0
    is an escape, after which the base codes a symbol that has not been escaped before.
    """

    def __init__(self, base: Uniform, seeded: bool = True):
        self.base, self.seeded = base, seeded

    def encode_all(self, symbols: list[int], end: int, coder: Encoder) -> None:
        words: dict[tuple[int, int] | int, int] = {}  # (index of prefix, symbol) to index; singles by symbol
        size = 0
        if self.seeded:
            size = self.base.size
        single = {} if not self.seeded else None
        current = -1
        learn = self.base.learn

        def emit(index: int) -> None:
            if self.seeded:
                coder.narrow(index, index + 1, size)
            else:
                coder.narrow(index + 1, index + 2, size + 1)

        for i, x in enumerate([*symbols, end]):
            if i:
                learn(symbols[i - 1])
            if current >= 0:
                longer = words.get((current, x))
                if longer is not None and x != end:
                    current = longer
                    continue
                emit(current)
                words[(current, x)] = size  # also before the end mark, as a decoder cannot tell
                size += 1
                current = -1
            if self.seeded:
                current = x
            elif x in single:
                current = single[x]
            else:
                if size:
                    coder.narrow(0, 1, size + 1)
                self.base.encode(x, coder, single.keys())
                single[x] = size
                size += 1
                current = -1
        if self.seeded:
            coder.narrow(end, end + 1, size)

    def decode_all(self, end: int, coder: Decoder) -> list[int]:
        """The inverse; a word may be used in the step that follows the one that made it."""
        out: list[int] = []
        words: list[list[int]] = [[i] for i in range(self.base.size)] if self.seeded else []
        single: set[int] = set()
        last: list[int] | None = None
        while True:
            if self.seeded:
                total = len(words) + (last is not None)
                index = coder.target(total)
                coder.narrow(index, index + 1, total)
                word = words[index] if index < len(words) else [*last, last[0]]
                if last is not None and word != [end]:
                    words.append([*last, word[0]])
                if word == [end]:
                    return out
                out += word
                last = word
                continue
            total = len(words) + (last is not None) + 1
            index = coder.target(total) if total > 1 else 0
            if total > 1:
                coder.narrow(index, index + 1, total)
            if index == 0:
                x = self.base.decode(coder, single)
                if x == end:
                    return out
                if last is not None:
                    words.append([*last, x])
                single.add(x)
                self.base.learn(x)
                words.append([x])
                out.append(x)
                last = None
                continue
            word = words[index - 1] if index - 1 < len(words) else [*last, last[0]]
            if last is not None:
                words.append([*last, word[0]])
            for x in word:
                self.base.learn(x)
            out += word
            last = word


class MoveToFront:
    """Symbols as their rank in a list whose last used symbol comes first."""

    def __init__(self, symbols: list[int]):
        self.list = list(symbols)

    def rank(self, x: int) -> int:
        at = self.list.index(x)
        self.list.insert(0, self.list.pop(at))
        return at

    def symbol(self, rank: int) -> int:
        x = self.list.pop(rank)
        self.list.insert(0, x)
        return x


class MTFModel:
    """Codes the rank of a symbol by a model of ranks."""

    def __init__(self, symbols: list[int], ranks):
        self.mtf, self.ranks = MoveToFront(symbols), ranks

    def encode(self, x: int, coder: Encoder, omit=NONE) -> None:
        self.ranks.encode(self.mtf.list.index(x), coder)

    def decode(self, coder: Decoder, omit=NONE) -> int:
        return self.mtf.list[self.ranks.decode(coder)]

    def learn(self, x: int) -> None:
        self.ranks.learn(self.mtf.rank(x))
