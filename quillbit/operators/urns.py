"""Context models with exchangeable urns, and the unbounded-depth sequence memoizer.

``UrnPPM`` keeps one-table counts in contexts of up to ``depth`` symbols and asks an urn
policy how a context mixes with the next shorter one. Masses are doubles: these models
measure and generate; their code length is ``-log2`` of the mass.
"""

from __future__ import annotations

import math
import random
import warnings
from fractions import Fraction

from quillbit.operators.sequential import Context


class Blending:
    """((c - b if seen) + (a + u b) parent) / (n + a); parameters may depend on depth and fan-out.

    ``a`` and ``b`` are numbers, lists by depth (``by="depth"``), lists by fan-out
    (``by="fanout"``) or matrices (``by="both"``); lists are clipped at their end.
    """

    def __init__(self, a=0.0, b=0.5, by: str = ""):
        self.a, self.b, self.by = a, b, by

    def _pick(self, table, depth: int, u: int) -> float:
        if self.by == "depth":
            return table[min(depth, len(table) - 1)]
        if self.by == "fanout":
            return table[min(max(u, 1), len(table)) - 1]
        if self.by == "both":
            row = table[min(depth, len(table) - 1)]
            return row[min(max(u, 1), len(row)) - 1]
        return table

    def mass(self, node: Context, depth: int, x: int, parent: float) -> float:
        n = sum(node.counts.values())
        if not n:
            return parent
        u = len(node.counts)
        a, b = self._pick(self.a, depth, u), self._pick(self.b, depth, u)
        c = node.counts.get(x, 0)
        return ((c - b if c else 0.0) + (a + u * b) * parent) / (n + a)

    def adapt(self, path: list[tuple[Context, int]], x: int, base: float) -> None:
        pass


class Gradient(Blending):
    """A matrix of parameters that steps along the gradient of the log mass before each symbol is learnt."""

    def __init__(self, depth: int, fanout: int, a: float = 0.0, b: float = 0.5, step: float = 0.001):
        super().__init__([[a] * fanout for _ in range(depth + 1)], [[b] * fanout for _ in range(depth + 1)], "both")
        self.step = step

    def adapt(self, path: list[tuple[Context, int]], x: int, base: float) -> None:
        """``path`` runs from the root to the longest context."""
        parents, mass = [], base
        for node, depth in path:
            parents.append(mass)
            mass = self.mass(node, depth, x, mass)
        back, moves = 1.0, []
        for (node, depth), parent in zip(reversed(path), reversed(parents), strict=True):
            n = sum(node.counts.values())
            if not n:
                continue
            u, c = len(node.counts), node.counts.get(x, 0)
            row = min(depth, len(self.a) - 1)
            col = min(u, len(self.a[row])) - 1
            a, b = self.a[row][col], self.b[row][col]
            own = self.mass(node, depth, x, parent)
            moves.append((row, col, back * (parent - own) / (n + a), back * (u * parent - (1 if c else 0)) / (n + a)))
            back *= (a + u * b) / (n + a)
        for row, col, da, db in moves:
            b = min(max(self.b[row][col] + self.step * db / mass, 1e-7), 1.0)
            self.b[row][col] = b
            self.a[row][col] = min(max(self.a[row][col] + self.step * da / mass, -b + 1e-4), 65535.0)


class UrnPPM:
    """Prediction from blended contexts."""

    def __init__(self, base, depth: int = 5, urn: Blending | None = None):
        self.base, self.depth, self.urn = base, depth, urn or Blending()
        self.root = self.at = Context(None)
        self.length = 0

    def _path(self) -> list[tuple[Context, int]]:
        nodes, node = [], self.at
        while node is not None:
            nodes.append(node)
            node = node.shorter
        return [(n, d) for d, n in enumerate(reversed(nodes))]

    def mass(self, x: int) -> float:
        out = self.base.mass(x)
        for node, depth in self._path():
            out = self.urn.mass(node, depth, x, out)
        return out

    def learn(self, x: int) -> None:
        self.urn.adapt(self._path(), x, self.base.mass(x))
        node = self.at
        while node is not None:
            count = node.counts[x] = node.counts.get(x, 0) + 1
            if count > 1:
                break
            node = node.shorter
        self.length += 1
        start = self.at if self.length <= self.depth else self.at.shorter
        self.at = self._child(start, x) if self.depth else self.root

    def _child(self, node: Context | None, x: int) -> Context:
        if node is None:
            return self.root
        found = node.deeper.get(x)
        if found is None:
            found = node.deeper[x] = Context(self._child(node.shorter, x))
        return found

    def bits(self, symbols: list[int]) -> float:
        """Code length of a sequence, learning it."""
        total = 0.0
        for x in symbols:
            total -= math.log2(self.mass(x))
            self.learn(x)
        return total

    def sample(self, n: int, alphabet: list[int], rng: random.Random) -> list[int]:
        """Generate and learn ``n`` symbols."""
        out = []
        for _ in range(n):
            out.append(rng.choices(alphabet, [self.mass(x) for x in alphabet])[0])
            self.learn(out[-1])
        return out


class Exclusion(UrnPPM):
    """As PPM with exclusion, but in doubles: seen (c - b)/(n + a), new (a + u b)/(n + a) over symbols not yet excluded."""

    def __init__(self, base, depth: int = 5, a: float = 0.0, b: float = 0.5):
        super().__init__(base, depth)
        self.a, self.b = a, b

    def mass(self, x: int) -> float:
        out, excluded, node = 1.0, set(), self.at
        while node is not None:
            live = {s: c for s, c in node.counts.items() if s not in excluded}
            if live:
                n, u = sum(live.values()), len(live)
                if x in live:
                    return out * (live[x] - self.b) / (n + self.a)
                out *= (self.a + u * self.b) / (n + self.a)
            excluded |= node.counts.keys()
            node = node.shorter
        left = 1.0 - sum(self.base.mass(s) for s in excluded)
        return out * self.base.mass(x) / left


class SequenceMemoizer:
    """Pitman-Yor over all suffixes: contexts of any length in a compressed suffix tree.

    An edge holds a stretch of the past; a context that ends inside an edge splits it.
    Discounts by depth are multiplied along the depths that an edge skips; strengths are
    zero. Every context keeps one table for each dish.
    """

    class Node:
        __slots__ = ("children", "counts", "depth", "end", "parent")

        def __init__(self, parent, end: int, depth: int):
            self.parent, self.end, self.depth = parent, end, depth
            self.children: dict[int, SequenceMemoizer.Node] = {}
            self.counts: dict[int, int] = {}

    def __init__(self, base, discounts: tuple[float, ...] = (0.62, 0.69, 0.74, 0.80), deeper: float = 0.95):
        self.base, self.discounts, self.deeper = base, discounts, deeper
        self.past: list[int] = []
        self.root = self.Node(None, 0, 0)
        self.at = self.root

    def _discount(self, upper: int, lower: int) -> float:
        """Product of the discounts of depths upper+1..lower; of the root alone for (−1, 0)."""
        out = 1.0
        for d in range(upper + 1, min(lower, len(self.discounts) - 1) + 1):
            out *= self.discounts[d]
        rest = lower - max(upper, len(self.discounts) - 1)
        return out * self.deeper ** max(rest, 0)

    def mass(self, x: int) -> float:
        path, node = [], self.at
        while node is not None:
            path.append(node)
            node = node.parent
        out = self.base.mass(x)
        for node in reversed(path):
            n = sum(node.counts.values())
            if n:
                b = self._discount(node.parent.depth if node.parent else -1, node.depth)
                c = node.counts.get(x, 0)
                out = ((c - b if c else 0.0) + len(node.counts) * b * out) / n
        return out

    def learn(self, x: int) -> None:
        node = self.at
        while node is not None:
            count = node.counts[x] = node.counts.get(x, 0) + 1
            if count > 1:
                break
            node = node.parent
        self.past.append(x)
        self.at = self._insert()

    def _insert(self):
        """The node of the whole past as a context, read backwards from the last symbol."""
        past, node, i = self.past, self.root, len(self.past)
        while True:
            if node.depth == i:
                return node
            key = past[i - 1 - node.depth]
            child = node.children.get(key)
            if child is None:
                child = node.children[key] = self.Node(node, i, i)
                return child
            k = node.depth
            while k < child.depth and k < i and past[i - 1 - k] == past[child.end - 1 - k]:
                k += 1
            if k == child.depth:
                node = child
                continue
            middle = self.Node(node, child.end, k)
            middle.counts = {s: 1 for s in child.counts}  # each dish of the child was new once in the part above
            node.children[key] = middle
            child.parent = middle
            middle.children[past[child.end - 1 - k]] = child
            if k == i:
                return middle
            leaf = middle.children[past[i - 1 - k]] = self.Node(middle, i, i)
            return leaf

    bits = UrnPPM.bits
    sample = UrnPPM.sample


class TableIndices:
    """The Chinese-restaurant process over table indices: an index is a seated table, or the next one."""

    def __init__(self, a: Fraction = Fraction(1), b: Fraction = Fraction(0)):
        unit = math.lcm(a.denominator, b.denominator)
        self.a, self.b, self.unit = int(a * unit), int(b * unit), unit
        self.customers: list[int] = []

    def _weights(self) -> list[int]:
        if not self.customers:
            return [1]
        return [c * self.unit - self.b for c in self.customers] + [self.a + self.b * len(self.customers)]

    def mass(self, k: int) -> float:
        weights = self._weights()
        return weights[k] / sum(weights) if k < len(weights) else 0.0

    def encode(self, k: int, coder, omit=frozenset()) -> None:
        weights = self._weights()
        low = sum(weights[:k])
        if len(weights) > 1:
            coder.narrow(low, low + weights[k], sum(weights))

    def decode(self, coder, omit=frozenset()) -> int:
        weights = self._weights()
        if len(weights) == 1:
            return 0
        target, low = coder.target(sum(weights)), 0
        for k, w in enumerate(weights):
            if target < low + w:
                coder.narrow(low, low + w, sum(weights))
                return k
            low += w
        raise ValueError("no table")

    def learn(self, k: int) -> None:
        if k == len(self.customers):
            self.customers.append(0)
        self.customers[k] += 1


#: Urn of each value of ``t`` in a parameter string: blending by no, fan-out or depth and fan-out parameters, exclusion, gradient.
URNS = {"b": "blending", "u": "fanout", "m": "both", "x": "exclusion", "g": "gradient"}


def from_parameters(base, text: str):
    """A context model from ``t=<urn>:d=<depth>:a=<strength>:b=<discount>``; lists by commas, rows of a matrix by slashes."""
    given = dict(part.split("=", 1) for part in filter(None, text.split(":")))
    unknown = set(given) - {"t", "d", "a", "b", "n", "e"}
    if unknown:
        warnings.warn(f"unknown parameters {sorted(unknown)}", stacklevel=2)
    kind, depth = URNS[given.get("t", "b")], int(given.get("d", "5"))

    def value(key: str, default: str):
        rows = [[float(v) for v in row.split(",")] for row in given.get(key, default).split("/")]
        return rows if kind == "both" else rows[0] if kind == "fanout" or len(rows[0]) > 1 else rows[0][0]

    a, b = value("a", "0"), value("b", "0.5")
    if kind == "exclusion":
        return Exclusion(base, depth, a, b)
    if kind == "gradient":
        return UrnPPM(base, depth, Gradient(depth, int(given.get("n", "4")), a, b, float(given.get("e", "0.001"))))
    by = kind if kind in ("fanout", "both") else "depth" if isinstance(a, list) or isinstance(b, list) else ""
    if by == "depth":
        a, b = (v if isinstance(v, list) else [v] for v in (a, b))
    return UrnPPM(base, depth, Blending(a, b, by))


class SeatingCRP:
    """A Chinese-restaurant process with random tables (strength ``a``, discount ``b``), and table indices as samples."""

    def __init__(self, base, a: float = 1.0, b: float = 0.0, seed: int = 0):
        self.base, self.a, self.b, self.rng = base, a, b, random.Random(seed)
        self.tables: list[tuple[int, int]] = []  # (dish, customers)

    def table_masses(self) -> list[float]:
        """Chance of each table for the next customer, a new one last."""
        n, t = sum(c for _, c in self.tables), len(self.tables)
        if not n:
            return [1.0]
        return [(c - self.b) / (n + self.a) for _, c in self.tables] + [(self.a + self.b * t) / (n + self.a)]

    def mass(self, x: int) -> float:
        m = self.table_masses()
        return sum(p for p, (d, _) in zip(m, self.tables, strict=False) if d == x) + m[-1] * self.base.mass(x)

    def learn(self, x: int) -> None:
        m = self.table_masses()
        at = [i for i, (d, _) in enumerate(self.tables) if d == x]
        weights = [m[i] for i in at] + [m[-1] * self.base.mass(x)]
        pick = self.rng.choices([*at, len(self.tables)], weights)[0]
        if pick == len(self.tables):
            self.tables.append((x, 1))
        else:
            self.tables[pick] = (x, self.tables[pick][1] + 1)
