"""Special functions and number helpers: as columns where Spark's expressions suffice, else in numpy or on the driver."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the Lanczos approximation with g = 7 (fixed values).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
EULER = 0.57721566490153286


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0, to about 1e-13 relative."""

    def right(z: Column) -> Column:
        y = z - 1
        series = reduce(lambda s, ic: s + F.lit(ic[1]) / (y + ic[0]), enumerate(LANCZOS[1:], 1), F.lit(LANCZOS[0]))
        t = y + 7.5
        return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(series)

    return F.when(x < 0.5, F.ln(F.lit(math.pi) / F.abs(F.sin(F.lit(math.pi) * x))) - right(1 - x)).otherwise(right(x))


def gamma(x: Column) -> Column:
    return F.exp(log_gamma(x))


def digamma(x: Column) -> Column:
    """The derivative of ln Gamma, for x > 0: shifted up by 8, then the asymptotic series."""
    shift = reduce(lambda s, i: s + F.lit(1.0) / (x + i), range(8), F.lit(0.0))
    z = x + 8
    r = F.lit(1.0) / (z * z)
    series = F.ln(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return series - shift


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def beta(a: Column, b: Column) -> Column:
    return F.exp(log_beta(a, b))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def inverse_logit(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


def log_factorial(n: Column) -> Column:
    return log_gamma(n + 1)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def log_sum_exp(values: Column) -> Column:
    """ln of the sum of exponentials of an array, without overflow; -infinity for an empty one."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.when(F.size(values) == 0, F.lit(float("-inf"))).when(top == float("-inf"), top).otherwise(top + F.ln(total))


def highest_bit(x: Column) -> Column:
    """The highest power of two that is at most x > 0."""
    return F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), F.length(F.bin(x)) - 1).cast("long")


def next_power(x: Column) -> Column:
    """The lowest power of two above x."""
    return F.when(x <= 0, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(x))).cast("long"))


# --- exact, on the driver or in a UDF ---------------------------------------------------


def choose(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


def stirling_first(n: int, k: int) -> int:
    """Unsigned: permutations of n with k cycles."""
    row = [1]
    for m in range(n):
        row = [(row[i - 1] if i else 0) + m * (row[i] if i < len(row) else 0) for i in range(len(row) + 1)]
    return row[k] if k < len(row) else 0


def stirling_second(n: int, k: int) -> int:
    """Partitions of n elements into k blocks."""
    row = [1]
    for _ in range(n):
        row = [(row[i - 1] if i else 0) + i * (row[i] if i < len(row) else 0) for i in range(len(row) + 1)]
    return row[k] if k < len(row) else 0


def bell(n: int) -> int:
    return sum(stirling_second(n, k) for k in range(n + 1))


def central(n: int) -> int:
    """The middle binomial coefficient of 2n."""
    return math.comb(2 * n, n)


def inverse_gamma(y: float) -> float:
    """x > 1.46... with Gamma(x) = y, by bisection on ln Gamma."""
    lo, hi = 1.4616321449683623, 2.0
    want = math.log(y)
    while math.lgamma(hi) < want:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.lgamma(mid) < want else (lo, mid)
    return (lo + hi) / 2


def lambert_w(x: float) -> float:
    """w >= -1 with w exp(w) = x, by Halley steps."""
    if x < -1 / math.e:
        raise ValueError("no real value")
    w = math.log1p(x) if x > -0.3 else -1 + math.sqrt(max(2 * (1 + math.e * x), 0.0))
    for _ in range(100):
        e = math.exp(w)
        f = w * e - x
        step = f / (e * (w + 1) - (w + 2) * f / (2 * w + 2)) if w > -1 else 0.0
        w -= step
        if abs(step) < 1e-15 * (1 + abs(w)):
            break
    return w


def fraction(x: float, most: int = 4096) -> tuple[int, int]:
    """The closest ratio with a denominator of at most ``most``."""
    found = Fraction(x).limit_denominator(most)
    return found.numerator, found.denominator


def entropy(masses: list[float], base: float = math.e) -> float:
    """Entropy of a distribution; masses of zero add nothing."""
    return -sum(p * math.log(p, base) for p in masses if p > 0)
