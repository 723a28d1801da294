"""Finite and continuous distributions: masses and moments as columns, and samplers."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbit.functions.special import digamma, log_beta, log_choose, log_gamma

#: Character sets of uniform distributions, as code point ranges (fixed values).
CHARACTER_SETS = {
    "ascii": (0, 127), "digits": (48, 57), "printable": (32, 126), "first256": (0, 255), "first3000": (0, 2999), "dice": (49, 54),
}


def uniform_character_mass(cp: Column, name: str) -> Column:
    lo, hi = CHARACTER_SETS[name]
    return F.when(cp.between(lo, hi), F.lit(1.0 / (hi - lo + 1))).otherwise(0.0)


def uniform_integer_mass(lo: Column, hi: Column, start: int, end: int) -> Column:
    """Mass of lo..hi under a uniform integer of start..end."""
    return F.greatest(F.least(hi, F.lit(end)) - F.greatest(lo, F.lit(start)) + 1, F.lit(0)) / float(end - start + 1)


def mixture(weights: list[float], masses: list[Column]) -> Column:
    total = sum(weights)
    out = F.lit(0.0)
    for w, m in zip(weights, masses, strict=True):
        out = out + F.lit(w / total) * m
    return out


def responsibilities(weights: list[float], masses: list[Column]) -> Column:
    whole = mixture(weights, masses)
    total = sum(weights)
    return F.array(*(F.lit(w / total) * m / whole for w, m in zip(weights, masses, strict=True)))


# --- log masses and densities, means and variances ---------------------------------------


def binomial(k: Column, n: Column, p: Column) -> Column:
    return log_choose(n, k) + k * F.ln(p) + (n - k) * F.ln(1 - p)


def binomial_moments(n: Column, p: Column) -> Column:
    return F.struct((n * p).alias("mean"), (n * p * (1 - p)).alias("variance"))


def beta(x: Column, a: Column, b: Column) -> Column:
    return (a - 1) * F.ln(x) + (b - 1) * F.ln(1 - x) - log_beta(a, b)


def beta_moments(a: Column, b: Column) -> Column:
    s = a + b
    return F.struct((a / s).alias("mean"), F.when((a > 1) & (b > 1), (a - 1) / (s - 2)).alias("mode"), (a * b / (s * s * (s + 1))).alias("variance"))


def beta_entropy(a: Column, b: Column) -> Column:
    return log_beta(a, b) - (a - 1) * digamma(a) - (b - 1) * digamma(b) + (a + b - 2) * digamma(a + b)


def dirichlet(xs: Column, alphas: Column) -> Column:
    """Log density of an array under an array of strengths."""
    zero = F.lit(0.0)
    total = F.aggregate(alphas, zero, lambda s, a: s + a)
    norm = F.aggregate(F.transform(alphas, log_gamma), zero, lambda s, v: s + v) - log_gamma(total)
    return F.aggregate(F.zip_with(xs, alphas, lambda x, a: (a - 1) * F.ln(x)), zero, lambda s, v: s + v) - norm


def dirichlet_marginal(counts: Column, alphas: Column) -> Column:
    """Log likelihood of a sequence with these counts, masses integrated out."""
    zero = F.lit(0.0)
    total = F.aggregate(alphas, zero, lambda s, a: s + a)
    n = F.aggregate(counts, zero, lambda s, c: s + c)
    parts = F.zip_with(counts, alphas, lambda c, a: log_gamma(a + c) - log_gamma(a))
    return F.aggregate(parts, zero, lambda s, v: s + v) + log_gamma(total) - log_gamma(total + n)


def gamma(x: Column, shape: Column, scale: Column) -> Column:
    return (shape - 1) * F.ln(x) - x / scale - log_gamma(shape) - shape * F.ln(scale)


def gamma_moments(shape: Column, scale: Column) -> Column:
    return F.struct((shape * scale).alias("mean"), F.when(shape >= 1, (shape - 1) * scale).alias("mode"), (shape * scale * scale).alias("variance"))


def gaussian(x: Column, mean: Column, variance: Column) -> Column:
    return -(x - mean) * (x - mean) / (2 * variance) - 0.5 * F.ln(2 * math.pi * variance)


def gaussian_entropy(variance: Column) -> Column:
    return 0.5 * F.ln(2 * math.pi * math.e * variance)


def gaussian_sample(mean: Column, variance: Column, seed: int = 0) -> Column:
    return mean + F.sqrt(variance) * F.randn(seed)


# --- samplers over finite tables -----------------------------------------------------------


class AliasSampler:
    """Draws from a finite table in constant time."""

    def __init__(self, labels: list, masses: list[float]):
        n, total = len(labels), sum(masses)
        self.labels, self.cut, self.other = labels, [1.0] * n, list(range(n))
        scaled = [m * n / total for m in masses]
        small, large = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
        while small and large:
            s, g = small.pop(), large.pop()
            self.cut[s], self.other[s] = scaled[s], g
            scaled[g] -= 1 - scaled[s]
            (small if scaled[g] < 1 else large).append(g)

    def draw(self, u: float):
        at = min(int(u * len(self.labels)), len(self.labels) - 1)
        return self.labels[at if u * len(self.labels) - at < self.cut[at] else self.other[at]]


def alias_column(u: Column, labels: list[str], masses: list[float]) -> Column:
    """A label for every uniform number in [0, 1)."""
    table = AliasSampler(labels, masses)

    @F.pandas_udf("string")
    def draw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([table.draw(v) for v in values])

    return draw(u)


class FixedSequence:
    """Replays a sequence: each next symbol has mass one."""

    def __init__(self, symbols: list[int]):
        self.symbols, self.at = symbols, 0

    def mass(self, x: int) -> float:
        return 1.0 if self.at < len(self.symbols) and self.symbols[self.at] == x else 0.0

    def learn(self, x: int) -> None:
        self.at += 1


class Mapped:
    """A model over other symbols through a bijection."""

    def __init__(self, inner, lower, higher):
        self.inner, self.lower, self.higher = inner, lower, higher

    def mass(self, x) -> float:
        return self.inner.mass(self.lower(x))

    def encode(self, x, coder, omit=frozenset()) -> None:
        self.inner.encode(self.lower(x), coder, frozenset(map(self.lower, omit)))

    def decode(self, coder, omit=frozenset()):
        return self.higher(self.inner.decode(coder, frozenset(map(self.lower, omit))))

    def learn(self, x) -> None:
        self.inner.learn(self.lower(x))


def fake_words(n: int, seed: int = 0, strength: float = 50.0, discount: float = 0.6, letters: str = "etaoinshrdlu") -> list[str]:
    """``n`` words from a Pitman-Yor process whose new words are random strings."""
    rng = random.Random(seed)
    tables: list[list] = []
    out, total = [], 0
    for _ in range(n):
        new = (strength + discount * len(tables)) / (total + strength)
        if rng.random() < new:
            word = "".join(rng.choice(letters) for _ in range(1 + min(int(rng.expovariate(0.3)), 12)))
            tables.append([word, 1])
        else:
            t = rng.choices(tables, [c - discount for _, c in tables])[0]
            t[1] += 1
            word = t[0]
        total += 1
        out.append(word)
    return out


def string_log_mass(text: Column, char_mass: Column, end: float = 0.1) -> Column:
    """Log mass of a string: geometric length, characters independent with ``char_mass`` (a map)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    inside = F.aggregate(chars, F.lit(0.0), lambda s, c: s + F.ln(F.element_at(char_mass, c)) + math.log(1 - end))
    return inside + math.log(end)
