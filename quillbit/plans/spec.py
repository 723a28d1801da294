"""Model specifications: ``base[:k=v...]`` and layers ``name[:k=v...]``, from text to a stack.

``parse("ppm:d=6:a=0.1", "uniform_byte")`` names the layer and the base of one stack;
``named("crp_polya_stoken")`` reads the short names of a benchmark table. New bases and
layers are added to ``BASES`` and ``LAYERS``.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from fractions import Fraction

from quillbit.functions import symbols as S
from quillbit.operators import sequential as M

#: Largest denominators of exact parameters.
SHORT, LONG = 4096, 0x20000


@dataclass(frozen=True)
class Part:
    name: str
    params: tuple[tuple[str, str], ...] = ()

    def get(self, key: str, default: str) -> str:
        return dict(self.params).get(key, default)

    def __str__(self) -> str:
        return ":".join([self.name, *(f"{k}={v}" for k, v in self.params)])


def parse_part(text: str, known: set[str] | None = None) -> Part:
    """``name:k=v:k=v``; unknown keys are warned of and dropped."""
    name, *rest = text.split(":")
    params = []
    for r in filter(None, rest):
        key, sep, value = r.partition("=")
        if not sep:
            raise ValueError(f"{text!r}: {r!r} is not key=value")
        if known is not None and key not in known:
            warnings.warn(f"{name}: unknown parameter {key}", stacklevel=2)
            continue
        params.append((key, value))
    return Part(name, tuple(params))


def exact(value: str, most: int = SHORT) -> Fraction:
    return Fraction(value).limit_denominator(most)


# Chances of tokens under random bytes, by range, as weights of one token each (fixed values).
RANDOM_BYTES = [(0, 0x7F, 1 << 24), (0x80, 0x7FF, 1 << 16), (0x800, 0xFFFF, 1 << 8), (0x10000, 0x10FFFF, 1), (0x110000, S.SIMPLE_RANGE - 1, 0xDB8000)]

#: Weights of the categories of the detailed alphabet, of 100 (fixed values).
CATEGORY_WEIGHTS = (("char", 90), ("overlong", 5), ("surrogate", 2), ("too_high", 1), ("illegal", 1), ("eof", 1))


class Categorical:
    """A category by its weight, then a token of it uniformly."""

    def __init__(self):
        starts = sorted(S.FIRST.items(), key=lambda kv: kv[1])
        ends = [b for _, b in starts[1:]] + [S.DETAILED_RANGE]
        self.ranges = {k: (a, b) for (k, a), b in zip(starts, ends, strict=True)}

    def _category(self, x: int) -> str:
        return next(k for k, (a, b) in self.ranges.items() if a <= x < b)

    def mass(self, x: int) -> float:
        kind = self._category(x)
        a, b = self.ranges[kind]
        return dict(CATEGORY_WEIGHTS)[kind] / 100 / (b - a)

    def _live(self, omit) -> tuple[list[tuple[str, int]], dict[str, list[int]]]:
        gone: dict[str, list[int]] = {}
        for o in sorted(omit):
            gone.setdefault(self._category(o), []).append(o)
        return [(k, w) for k, w in CATEGORY_WEIGHTS if len(gone.get(k, ())) < self.ranges[k][1] - self.ranges[k][0]], gone

    def encode(self, x: int, coder, omit=M.NONE) -> None:
        live, gone = self._live(omit)
        kind, low = self._category(x), 0
        for k, w in live:
            if k == kind:
                coder.narrow(low, low + w, sum(v for _, v in live))
            low += w
        a, b = self.ranges[kind]
        out = gone.get(kind, [])
        at = x - a - sum(o < x for o in out)
        coder.narrow(at, at + 1, b - a - len(out))

    def decode(self, coder, omit=M.NONE) -> int:
        live, gone = self._live(omit)
        total = sum(v for _, v in live)
        target, low = coder.target(total), 0
        for k, w in live:
            if target < low + w:
                coder.narrow(low, low + w, total)
                break
            low += w
        a, b = self.ranges[k]
        out = gone.get(k, [])
        at = coder.target(b - a - len(out))
        coder.narrow(at, at + 1, b - a - len(out))
        x = a + at
        for o in out:
            if o <= x:
                x += 1
        return x

    def learn(self, x: int) -> None:
        pass


def _polya(size: int, part: Part):
    a = exact(part.get("a", "0.5"))
    return M.PolyaTree(size, *M.even_priors(a))


def _mass_polya(size: int, between, part: Part):
    return M.MassPolyaTree(size, between, exact(part.get("a", "0.5")))


def _count(lo: int, hi: int) -> int:
    return hi - lo + 1


#: Base name to (alphabet, builder from parameters).
BASES: dict[str, tuple[str, Callable]] = {
    "uniform_byte": ("byte", lambda p: M.Uniform(257)),
    "uniform_stoken": ("simple", lambda p: M.Uniform(S.SIMPLE_RANGE)),
    "uniform_token": ("detailed", lambda p: M.Uniform(S.DETAILED_RANGE)),
    "categorical_token": ("detailed", lambda p: Categorical()),
    "polya_byte": ("byte", lambda p: _polya(257, p)),
    "polya_stoken": ("simple", lambda p: _polya(S.SIMPLE_RANGE, p)),
    "polya_token": ("detailed", lambda p: _polya(S.DETAILED_RANGE, p)),
    "polya_stoken_uniform_byte": ("simple", lambda p: _mass_polya(S.SIMPLE_RANGE, M.Weighted(RANDOM_BYTES).between, p)),
    "polya_stoken_uniform_token": ("simple", lambda p: _mass_polya(S.SIMPLE_RANGE, _count, p)),
    "polya_token_uniform_token": ("detailed", lambda p: _mass_polya(S.DETAILED_RANGE, _count, p)),
    "lzw_byte": ("byte", lambda p: M.LZW(M.Uniform(257))),
}

#: Layer name to (known parameters, builder from base and parameters).
LAYERS: dict[str, tuple[set[str], Callable]] = {
    "crp": ({"a", "b"}, lambda base, p: M.CRP(base, exact(p.get("a", "0"), LONG), exact(p.get("b", "0.5"), LONG))),
    "ppm": ({"d", "a", "b"}, lambda base, p: M.PPM(base, int(p.get("d", "5")), exact(p.get("a", "0")), exact(p.get("b", "0.5")))),
    "lzw": (set(), lambda base, p: M.LZW(base)),
    "lzwEscape": (set(), lambda base, p: M.LZW(base, seeded=False)),
}

END = {"byte": S.BYTE_EOF, "simple": S.SIMPLE_RANGE - 1, "detailed": S.DETAILED_RANGE - 1}


@dataclass(frozen=True)
class ModelSpec:
    base: Part
    layers: tuple[Part, ...] = field(default=())

    @property
    def alphabet(self) -> str:
        return BASES[self.base.name][0]

    @property
    def end(self) -> int:
        return END[self.alphabet]

    def build(self) -> list:
        """The stack, base first."""
        stack = [BASES[self.base.name][1](self.base)]
        for layer in self.layers:
            stack.append(LAYERS[layer.name][1](stack[-1], layer))
        return stack

    def __str__(self) -> str:
        return "/".join(map(str, (*self.layers[::-1], self.base)))


def parse(layers: str | list[str], base: str) -> ModelSpec:
    """A specification from layer texts (outermost last) and the text of a base."""
    names = [layers] if isinstance(layers, str) else layers
    found = parse_part(base, {"a"})
    if found.name not in BASES:
        raise ValueError(f"no base {found.name!r}; there are {', '.join(sorted(BASES))}")
    parts = []
    for text in names:
        name = text.split(":")[0]
        if name in ("", "none"):
            continue
        if name not in LAYERS:
            raise ValueError(f"no model {name!r}; there are {', '.join(sorted(LAYERS))}")
        if found.name == "lzw_byte":
            raise ValueError("lzw_byte takes no layer")
        parts.append(parse_part(text, LAYERS[name][0]))
    return ModelSpec(found, tuple(parts))


#: Short names of layers in benchmark tables.
SHORT_NAMES = {"none": "none", "crp": "crp:a=1:b=0", "lzw": "lzwEscape"} | {f"ppm{d}": f"ppm:d={d}" for d in range(10)}


def named(name: str) -> ModelSpec:
    """``<layer>_<base>`` of a benchmark table."""
    layer, _, base = name.partition("_")
    if layer not in SHORT_NAMES or base not in BASES:
        raise ValueError(f"no algorithm {name!r}")
    return parse(SHORT_NAMES[layer], base)


def tuned(best: list, files: str) -> dict[str, str]:
    """Algorithms from tuned parameters: ``ppm_<files>_group_opt_<prior>`` at the best depth and
    ``ppm_<files>_group_<depth>_<prior>`` at each, by name the full specification.

    ``best`` has rows (prior, depth, alpha, beta, mean_efficiency); the least efficiency is the best.
    """
    out: dict[str, str] = {}
    least: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (r["mean_efficiency"], r["depth"])):
        full = f"ppm:d={r['depth']}:a={r['alpha']!r}:b={r['beta']!r}/{r['prior']}"
        out[f"ppm_{files}_group_{r['depth']}_{r['prior']}"] = full
        if r["prior"] not in least:
            least[r["prior"]] = r["mean_efficiency"]
            out[f"ppm_{files}_group_opt_{r['prior']}"] = full
    return out


def grid_names() -> list[str]:
    """All combinations of layers and bases but those that make no sense."""
    out = [f"{a}_{b}" for a in SHORT_NAMES for b in BASES]
    return sorted(n for n in out if not re.match(r"(?!none).*_lzw_byte$", n))
