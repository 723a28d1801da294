"""Adaptive models as window queries: code lengths without leaving Catalyst.

A symbol stream is a frame (doc_id, pos, sym), ``pos`` from 0. Every probability is a
ratio of running counts, so a model is a few windows partitioned by (doc_id, context)
or (doc_id, context, symbol). Documents are dealt by ``doc_id`` once, before they are
exploded; hash partitioning on it satisfies every window, so a stack of them has one
exchange that moves texts. The result is the ideal code length, ``-log2`` of the mass
of each symbol; the end mark is left out.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbit.functions import symbols as S


def deal(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents by key, once, while they are still one row each."""
    return docs.repartition(key)


def stream(docs: DataFrame, symbols: Column, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, pos, sym) and the columns in ``keep``."""
    return deal(docs, key).select(F.col(key).alias("doc_id"), *(keep or []), F.posexplode(symbols).alias("pos", "sym"))


def characters(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    return stream(docs, S.code_points(F.col(text)), key, keep)


def byte_stream(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    return stream(docs, S.octets(F.col(text)), key, keep)


def _before(*keys: str):
    return Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def running_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """``nx``: earlier occurrences of the symbol; ``n``: earlier symbols; ``u``: earlier distinct symbols (by keys)."""
    keys = keys or ("doc_id",)
    counted = rows.withColumn("nx", F.count("*").over(_before(*keys, "sym")))
    new = F.when(F.col("nx") == 0, 1).otherwise(0)
    return counted.withColumn("n", F.count("*").over(_before(*keys))).withColumn("u", F.coalesce(F.sum(new).over(_before(*keys)), F.lit(0)))


def log2(p: Column) -> Column:
    return F.log2(p)


# --- static bases: mass of a symbol as a column -----------------------------------------


def uniform_mass(size: int) -> Column:
    return F.lit(1.0 / size)


def categorical_mass(number: Column) -> Column:
    """Mass of a detailed token: the weight of its category over the tokens of it."""
    from quillbit.plans.spec import CATEGORY_WEIGHTS

    starts = sorted(S.FIRST.items(), key=lambda kv: kv[1])
    sizes = {k: b - a for (k, a), b in zip(starts, [v for _, v in starts[1:]] + [S.DETAILED_RANGE], strict=True)}
    kind, out = S.detailed_kind(number), F.lit(None).cast("double")
    for name, weight in CATEGORY_WEIGHTS:
        out = F.when(kind == name, F.lit(weight / 100.0 / sizes[name])).otherwise(out)
    return out


def weighted_mass(number: Column) -> Column:
    """Mass of a simple token under uniformly random bytes."""
    from quillbit.plans.spec import RANDOM_BYTES

    total = sum((b - a + 1) * w for a, b, w in RANDOM_BYTES)
    out = F.lit(None).cast("double")
    for a, b, w in RANDOM_BYTES:
        out = F.when((number >= a) & (number <= b), F.lit(w / total)).otherwise(out)
    return out


# --- layers ----------------------------------------------------------------------------


def crp(rows: DataFrame, base: Column, a: float = 0.0, b: float = 0.5) -> DataFrame:
    """Mass under a Chinese-restaurant layer: ((nx - b tx) + (a + b t) base) / (n + a), one table for each dish."""
    counted = running_counts(rows)
    own = F.when(F.col("nx") > 0, F.col("nx") - F.lit(b)).otherwise(F.lit(0.0))
    total = F.col("n") + F.lit(a)
    mass = F.when(total == 0, base).otherwise((own + (F.lit(a) + F.lit(b) * F.col("u")) * base) / total)
    return counted.withColumn("mass", mass)


def polya(rows: DataFrame, size: int, a: float = 0.5) -> DataFrame:
    """Mass under a Pólya tree over ``range(size)`` with pseudo-count ``a`` on each side of every node.

    A level of the tree is one window: symbols share a node when their paths so far are
    equal, and the path is carried along as the bounds of the node.
    """
    out = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(size - 1)).withColumn("mass", F.lit(1.0))
    levels = math.ceil(math.log2(size))
    for _ in range(levels):
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) / 2).cast("int")
        out = out.withColumn("mid", mid).withColumn("right", (F.col("sym") >= F.col("mid")).cast("int"))
        node = _before("doc_id", "lo", "hi")
        out = out.withColumn("at", F.count("*").over(node)).withColumn("ones", F.coalesce(F.sum("right").over(node), F.lit(0)))
        same = F.when(F.col("right") == 1, F.col("ones")).otherwise(F.col("at") - F.col("ones"))
        step = F.when(F.col("hi") > F.col("lo"), (same + a) / (F.col("at") + 2 * a)).otherwise(F.lit(1.0))
        out = out.withColumn("mass", F.col("mass") * step)
        deeper = F.col("hi") > F.col("lo")
        low = F.when(deeper & (F.col("right") == 1), F.col("mid")).otherwise(F.col("lo"))
        high = F.when(deeper & (F.col("right") == 0), F.col("mid") - 1).otherwise(F.col("hi"))
        out = out.withColumns({"lo": low, "hi": high})
    return out.drop("lo", "hi", "mid", "right", "at", "ones")


def mass_polya(rows: DataFrame, size: int, between, a: Fraction = Fraction(1, 2)) -> DataFrame:
    """A Pólya tree whose priors follow a base mass; ``between(lo, hi)`` gives column masses of ranges.

    The priors of a node are computed where they are needed, as integers of about eight
    bits of its two masses, so no table of two million nodes is shipped.
    """
    out = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(size - 1)).withColumn("mass", F.lit(1.0))
    for _ in range(math.ceil(math.log2(size))):
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) / 2).cast("int")
        out = out.withColumn("mid", mid).withColumn("right", (F.col("sym") >= F.col("mid")).cast("int"))
        node = _before("doc_id", "lo", "hi")
        out = out.withColumn("at", F.count("*").over(node)).withColumn("ones", F.coalesce(F.sum("right").over(node), F.lit(0)))
        whole, right = between(F.col("lo"), F.col("hi")), between(F.col("mid"), F.col("hi"))
        scale = F.greatest(F.shiftright(F.pow(F.lit(2.0), F.length(F.bin(whole))).cast("long"), 8), F.lit(1))
        y = F.greatest(F.floor(right / scale), F.lit(1))
        x = F.greatest(F.floor(whole / scale) - y, F.lit(1))
        prior = F.when(F.col("right") == 1, y).otherwise(x) / (x + y) * float(a)
        same = F.when(F.col("right") == 1, F.col("ones")).otherwise(F.col("at") - F.col("ones"))
        deeper = F.col("hi") > F.col("lo")
        out = out.withColumn("mass", F.col("mass") * F.when(deeper, (same + prior) / (F.col("at") + float(a))).otherwise(1.0))
        low = F.when(deeper & (F.col("right") == 1), F.col("mid")).otherwise(F.col("lo"))
        high = F.when(deeper & (F.col("right") == 0), F.col("mid") - 1).otherwise(F.col("hi"))
        out = out.withColumns({"lo": low, "hi": high})
    return out.drop("lo", "hi", "mid", "right", "at", "ones")


def random_bytes_between(lo: Column, hi: Column) -> Column:
    """Weight of a range of simple tokens under uniformly random bytes."""
    from quillbit.plans.spec import RANDOM_BYTES

    total = F.lit(0).cast("long")
    for a, b, w in RANDOM_BYTES:
        total = total + F.greatest(F.least(hi, F.lit(b)) - F.greatest(lo, F.lit(a)) + 1, F.lit(0)).cast("long") * w
    return total


def even_between(lo: Column, hi: Column) -> Column:
    return (hi - lo + 1).cast("long")


def context(k: int) -> Column:
    """The last ``k`` symbols before a position, as text; shorter at the start of a document."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return F.concat_ws(",", *(F.lag("sym", i).over(w).cast("string") for i in range(k, 0, -1)))


def order_k(rows: DataFrame, k: int, size: int, a: float = 0.5) -> DataFrame:
    """Mass with pseudo-count ``a`` for each of ``size`` symbols, in the context of ``k`` symbols."""
    counted = rows.withColumn("ctx", context(k))
    counted = counted.withColumn("nx", F.count("*").over(_before("doc_id", "ctx", "sym"))).withColumn("n", F.count("*").over(_before("doc_id", "ctx")))
    return counted.withColumn("mass", (F.col("nx") + a) / (F.col("n") + a * size))


def _levels(rows: DataFrame, depth: int) -> DataFrame:
    """For contexts of 0..depth symbols: nx, n, u before each position, counting like one-table learning.

    A position is an *event* of its longest context. It is one of a shorter context if it
    was the first of its symbol in the next longer one. All positions read the counts of all
    their contexts, so events weigh 1 and mere readers 0.
    """
    # Cutting the context means dropping its oldest symbol, so a level's key is a suffix of it.
    out = rows.withColumn("depth", F.least(F.col("pos"), F.lit(depth)))
    for k in range(depth, -1, -1):
        out = out.withColumn(f"ctx{k}", context(k) if k else F.lit(""))
        exists = F.col("depth") >= k
        if k == depth:
            event = (F.col("depth") == k).cast("int")
        else:
            above = (F.col("depth") > k) & (F.col(f"e{k + 1}") == 1) & (F.col(f"nx{k + 1}") == 0)
            event = ((F.col("depth") == k) | above).cast("int")
        out = out.withColumn(f"e{k}", event)
        keys = ("doc_id", f"ctx{k}", f"r{k}")
        out = out.withColumn(f"r{k}", exists)
        out = out.withColumn(f"nx{k}", F.coalesce(F.sum(f"e{k}").over(_before(*keys, "sym")), F.lit(0)))
        first = F.when((F.col(f"e{k}") == 1) & (F.col(f"nx{k}") == 0), 1).otherwise(0)
        out = out.withColumn(f"n{k}", F.coalesce(F.sum(f"e{k}").over(_before(*keys)), F.lit(0)))
        out = out.withColumn(f"u{k}", F.coalesce(F.sum(first).over(_before(*keys)), F.lit(0)))
    return out


def blending(rows: DataFrame, depth: int, base: Column, a, b) -> DataFrame:
    """Blending Pitman-Yor over contexts of 0..depth symbols, one table for each dish.

    P_k = ((nx - b if nx > 0) + (a + u b) P_{k-1}) / (n + a); a context without symbols
    passes on its parent's. ``a`` and ``b`` are numbers, or functions of (depth, u column)
    that return columns: depth-dependent, fan-out-dependent or both.
    """
    alpha = a if callable(a) else lambda k, u: F.lit(float(a))
    beta = b if callable(b) else lambda k, u: F.lit(float(b))
    out = _levels(rows, depth)
    mass = base
    for k in range(depth + 1):
        nx, n, u = F.col(f"nx{k}"), F.col(f"n{k}"), F.col(f"u{k}")
        al, be = alpha(k, u), beta(k, u)
        blended = (F.when(nx > 0, nx - be).otherwise(0.0) + (al + u * be) * mass) / (n + al)
        mass = F.when(~F.col(f"r{k}") | (n == 0), mass).otherwise(blended)
    return out.withColumn("mass", mass).select(*rows.columns, "mass")


def by_depth(values: list[float]):
    """A parameter by context depth; the last value goes on."""
    return lambda k, u: F.lit(float(values[min(k, len(values) - 1)]))


def by_fanout(values: list[float]):
    """A parameter by the number of distinct symbols of a context; the last value goes on."""
    table = F.array(*(F.lit(float(v)) for v in values))
    return lambda k, u: F.element_at(table, F.greatest(F.least(u, F.lit(len(values))), F.lit(1)).cast("int"))


def by_depth_and_fanout(rows: list[list[float]]):
    return lambda k, u: by_fanout(rows[min(k, len(rows) - 1)])(k, u)


def ppmd(rows: DataFrame, depth: int, base: Column) -> DataFrame:
    """PPM-D without exclusion: a symbol has (2 c - 1) of 2 n, what is new k of 2 n, then the next shorter context."""
    out = _levels(rows, depth)
    mass = base
    for k in range(depth + 1):
        nx, n, u = F.col(f"nx{k}"), F.col(f"n{k}"), F.col(f"u{k}")
        seen = (2 * nx - 1) / (2 * n)
        mass = F.when(~F.col(f"r{k}") | (n == 0), mass).when(nx > 0, seen).otherwise(u / (2 * n) * mass)
    return out.withColumn("mass", mass).select(*rows.columns, "mass")


def bernoulli(rows: DataFrame, one: Column, a0: float = 0.5, a1: float = 0.5) -> DataFrame:
    """Beta-Bernoulli mass of whether a symbol satisfies ``one``."""
    hit = rows.withColumn("hit", one.cast("int"))
    w = _before("doc_id")
    ones, n = F.coalesce(F.sum("hit").over(w), F.lit(0)), F.count("*").over(w)
    same = F.when(F.col("hit") == 1, ones + a1).otherwise(n - ones + a0)
    return hit.withColumn("mass", same / (n + a0 + a1))


# --- sums ------------------------------------------------------------------------------


def total_bits(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_symbols, bits): code length by document, rounded to 3 places."""
    keys = keys or ("doc_id",)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_symbols"), F.round(F.sum(-log2(F.col("mass"))), 3).alias("bits"))


def bps_curve(rows: DataFrame, every: int) -> DataFrame:
    """Bits for each symbol so far, at every ``every``-th position."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("bits", F.sum(-log2(F.col("mass"))).over(w)).withColumn("n", F.col("pos") + 1)
    return running.where(F.col("n") % every == 0).select("doc_id", F.col("n").cast("long"), F.round(F.col("bits") / F.col("n"), 6).alias("bps"))
