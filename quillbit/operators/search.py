"""Parameter search: grids as one job, a simplex on the driver, results as tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbit.operators.report import best_by
from quillbit.operators.urns import Blending, UrnPPM
from quillbit.plans.score import measure, raw
from quillbit.plans.spec import parse


def legal(a, b):
    """Whether strength and discount make sense together (numbers or columns)."""
    return (b >= 0) & (b <= 1) & (a + b >= 0.01)


def alpha_beta_grid(spark: SparkSession, a: tuple[float, float], b: tuple[float, float], steps: int) -> DataFrame:
    """(alpha, beta, legal) of a square grid, row by row."""
    at = lambda lo, hi, i: F.lit(lo) + (hi - lo) * i / float(max(steps - 1, 1))
    cells = spark.range(steps * steps)
    i, j = F.floor(F.col("id") / steps), F.col("id") % steps
    grid = cells.select("id", at(*a, i).alias("alpha"), at(*b, j).alias("beta"))
    return grid.withColumn("legal", legal(F.col("alpha"), F.col("beta")))


def score_cells(files: DataFrame, cells: DataFrame, base: str, content: str = "content") -> DataFrame:
    """(depth, alpha, beta, efficiency, status): mean bits for each byte over all files, every cell in one job.

    ``cells`` is (depth, alpha, beta), a table made by the search and as small as its
    grid; its rows go to the files with the function, so a file is moved once and every
    cell is measured where it lies. Files without content say nothing.
    """
    rows = [(int(r["depth"]), float(r["alpha"]), float(r["beta"])) for r in cells.collect()]

    def ratio(data: bytes, d: int, a: float, b: float) -> float | None:
        try:
            return measure(data, parse(f"ppm:d={d}:a={a!r}:b={b!r}", base)) / len(data) if legal(a, b) else None
        except ValueError:  # a discount of one leaves symbols seen once without mass
            return None

    @F.pandas_udf("array<struct<depth:int,alpha:double,beta:double,r:double>>")
    def ratios(contents: pd.Series) -> pd.Series:
        return pd.Series([[{"depth": d, "alpha": a, "beta": b, "r": ratio(raw(c), d, a, b)} for d, a, b in rows] for c in contents])

    work = files.select(F.col(content).alias("content")).where(F.octet_length("content") > 0).repartition(F.xxhash64("content"))
    scored = work.select(F.explode(ratios("content")).alias("c")).select("c.*")
    return scored.groupBy("depth", "alpha", "beta").agg(
        F.when(F.count("r") == F.count("*"), F.avg("r")).alias("efficiency"),
        F.when(F.count("r") == F.count("*"), "ok").otherwise("fail").alias("status"),
    )


def contour(spark: SparkSession, files: DataFrame, base: str, depth: int, a=(0.0, 1.0), b=(0.0, 1.0), steps: int = 5) -> DataFrame:
    """(alpha, beta, efficiency): illegal cells are infinite."""
    grid = alpha_beta_grid(spark, a, b, steps)
    cells = grid.where("legal").select(F.lit(depth).alias("depth"), "alpha", "beta")
    scored = score_cells(files, cells, base)
    return grid.join(scored.select("alpha", "beta", "efficiency"), ["alpha", "beta"], "left").select(
        "id", "alpha", "beta", F.coalesce("efficiency", F.lit(float("inf"))).alias("efficiency")
    )


def simplex(f: Callable[[tuple[float, ...]], float], start: tuple[float, ...], step: float = 0.1, most: int = 100, tolerance: float = 5e-4):
    """Nelder-Mead: (point, value, status). Points outside may be given an infinite value."""
    calls = 0

    def at(x: tuple[float, ...]) -> tuple[float, tuple[float, ...]]:
        nonlocal calls
        calls += 1
        return f(x), x

    n = len(start)
    points = [at(start)] + [at(tuple(v + step * (i == k) for i, v in enumerate(start))) for k in range(n)]
    while calls < most:
        points.sort()
        spread = points[-1][0] - points[0][0]
        if math.isfinite(spread) and spread <= tolerance:
            return points[0][1], points[0][0], "ok"
        worst = points[-1]
        centre = tuple(sum(p[1][i] for p in points[:-1]) / n for i in range(n))
        move = lambda t, c=centre, w=worst: at(tuple(a + t * (a - b) for a, b in zip(c, w[1], strict=True)))
        new = move(1.0)
        if new[0] < points[0][0]:
            far = move(2.0)
            points[-1] = min(new, far)
        elif new[0] < points[-2][0]:
            points[-1] = new
        else:
            near = move(0.5) if new[0] < worst[0] else move(-0.5)
            if near[0] < min(new[0], worst[0]):
                points[-1] = near
            else:
                best = points[0][1]
                points = [points[0]] + [at(tuple((a + b) / 2 for a, b in zip(p[1], best, strict=True))) for p in points[1:]]
    points.sort()
    return points[0][1], points[0][0], "limit"


def optimise(spark: SparkSession, files: DataFrame, base: str, depth: int, start: tuple[float, float] = (0.0, 0.5)) -> dict:
    """The best strength and discount at one depth: each evaluation is a job over all files; answers are remembered."""
    seen: dict[tuple[float, float], float] = {}

    def value(x: tuple[float, ...]) -> float:
        if not legal(*x):
            return math.inf
        if x not in seen:
            cells = spark.createDataFrame([(depth, float(x[0]), float(x[1]))], "depth int, alpha double, beta double")
            seen[x] = score_cells(files, cells, base).first()["efficiency"]
        return seen[x]

    (a, b), best, status = simplex(value, start)
    return {"depth": depth, "alpha": a, "beta": b, "efficiency": best, "status": status}


def grid_then_refine(spark: SparkSession, files: DataFrame, base: str, depth: int, a=(0.0, 1.0), b=(0.0, 1.0), steps: int = 5) -> dict:
    """The best cell of a grid, refined by a simplex from there; the cell itself where that finds nothing better.

    Fewer than two steps begin at strength 0 and discount one half.
    """
    start, least = (0.0, 0.5), math.inf
    if steps > 1:
        found = contour(spark, files, base, depth, a, b, steps)
        best = found.where(F.col("efficiency") < math.inf).orderBy("efficiency", "alpha", "beta").first()
        if best is not None:
            start, least = (best["alpha"], best["beta"]), best["efficiency"]
    out = optimise(spark, files, base, depth, start)
    if out["efficiency"] > least:
        out |= {"alpha": start[0], "beta": start[1], "efficiency": least, "status": "grid"}
    return out


def optima(spark: SparkSession, files: DataFrame, base: str, depths, a=(0.0, 1.0), b=(0.0, 1.0), steps: int = 5) -> DataFrame:
    """(depth, alpha, beta, efficiency, status): the optimum of every depth over all files."""
    rows = [grid_then_refine(spark, files, base, d, a, b, steps) for d in depths]
    return spark.createDataFrame([tuple(r[k] for k in ("depth", "alpha", "beta", "efficiency", "status")) for r in rows], "depth int, alpha double, beta double, efficiency double, status string")


def tuned_urn(data: list[int], base, depth: int, start: tuple[float, float] = (0.0, 0.5), step: float = 1e-4) -> dict:
    """Strength and discount of a blending context model by conjugate gradients on the bits of a sequence, with error bars.

    Parameters are moved as (log(a + b), logit b), so every point is legal; gradients are
    differences, and error bars come from the curvature at the optimum.
    """

    def real(x: list[float]) -> tuple[float, float]:
        b = 1 / (1 + math.exp(-x[1]))
        return math.exp(x[0]) - b, b

    def bits(x: list[float]) -> float:
        return UrnPPM(base, depth, Blending(*real(x))).bits(data)

    def moved(x: list[float], i: int, by: float) -> list[float]:
        return [v + by * (k == i) for k, v in enumerate(x)]

    def gradient(x: list[float]) -> list[float]:
        return [(bits(moved(x, i, step)) - bits(moved(x, i, -step))) / (2 * step) for i in range(2)]

    a, b = start
    point, least = conjugate_gradient(bits, gradient, [math.log(a + b), math.log(b / (1 - b))], most=30, tolerance=1e-6)
    bend = [(bits(moved(point, i, 0.05)) - 2 * least + bits(moved(point, i, -0.05))) / 0.0025 * math.log(2) for i in range(2)]
    a, b = real(point)
    errors = [1 / math.sqrt(c) if c > 0 else math.inf for c in bend]
    return {"alpha": a, "beta": b, "bits": least, "alpha_error": errors[0] * (a + b), "beta_error": errors[1] * b * (1 - b)}


def best_parameters(scored: DataFrame, *keys: str) -> DataFrame:
    """The best (depth, alpha, beta) of each key: least efficiency, first depth among equals."""
    return best_by(scored, "efficiency", ["depth", "alpha", "beta"], ["depth", "alpha", "beta"], *keys)


def zoom(low: float, high: float, share: float = 0.1) -> tuple[float, float]:
    """A range around a range."""
    margin = (high - low) * share
    return low - margin, high + margin


def round_up_to(x: float, m: float) -> float:
    return math.ceil(x / m) * m


def conjugate_gradient(f: Callable, gradient: Callable, start: list[float], most: int = 200, tolerance: float = 1e-8) -> tuple[list[float], float]:
    """Polak-Ribiere steps with a backtracking line search: (point, value)."""
    x, g = list(start), gradient(start)
    d, value = [-v for v in g], f(start)
    for _ in range(most):
        slope = sum(a * b for a, b in zip(g, d, strict=True))
        if slope >= 0:
            d, slope = [-v for v in g], -sum(v * v for v in g)
        if -slope < tolerance:
            break
        t = 1.0
        while t > 1e-14:
            trial = [a + t * b for a, b in zip(x, d, strict=True)]
            new = f(trial)
            if new <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        x, value = trial, new
        h = gradient(x)
        turn = max(0.0, sum(a * (a - b) for a, b in zip(h, g, strict=True)) / max(sum(v * v for v in g), 1e-300))
        d, g = [-a + turn * b for a, b in zip(h, d, strict=True)], h
    return x, value
