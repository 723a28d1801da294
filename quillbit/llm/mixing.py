"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts are summed to cells (source, language, topic). Raking multiplies the
weights of cells so that the weighted tokens meet the target shares of each marginal
in turn, until no marginal is off its target by more than ``tolerance`` of all tokens; a
warning says how far off it is after ``MOST`` times ``rounds`` rounds, as targets may
contradict each other. Then documents are sampled, each with the probability of
its cell: ``min(1, c * weight)``, with ``c`` chosen so that the expected tokens are
``budget`` of all tokens (cells that reach 1 give all they have). The draw is a hash
of the document's key, so it is the same in every run and on every executor.

``targets`` gives shares by dimension and value, as ``{"source": {"web": 3, "books": 1}}``;
they are normalised over the values that occur, and a value without a share gets nothing.
A dimension without targets gets the observed shares to the power ``temper``,
normalised: rare values gain, frequent ones give way, and nothing is left out.

The documents are read for their cell and their draw; the only shuffle is that of
cell sums. Up to ``MAX_CELLS`` cells (distinct triples) are raked as window sums in one
partition; more are raked by grouping and joining each marginal, spread over the
cluster. Everything is DataFrame expressions.

Topic: documents carry none, so it is a rule on the text; ``topic_of`` tells
numeric, marked-up and plain texts apart by their share of digits and of marks. Callers
that know the topic give its column as ``topic``.

Defined results: null source, language or topic count as ``?``; null text has no tokens,
and cells without tokens keep probability 1; a null key is drawn like key ``?``;
repeated rows are drawn alike; an empty table gives an empty result; extra columns
are kept by ``sample_documents``, whatever their names.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbit.plans.storage import materialise, measured, small_side

WORDS = r"[^\x20\x09-\x0D]+"
DIMENSIONS = ("source", "lang", "topic")
TEMPER, ROUNDS, BUDGET = 0.7, 12, 0.7
#: Share of all tokens that a marginal may be off, how often ``rounds`` rounds are run at most, and cells that one partition rakes.
TOLERANCE, MOST, MAX_CELLS = 1e-7, 8, 100_000
Targets = Mapping[str, Mapping[str, float]]


def topic_of(text: F.Column) -> F.Column:
    """``numeric``: over 1 in 50 characters is a digit; ``marked``: over 1 in 50 is one of #$%&*<>|; else ``plain``."""
    n = F.length(text)
    digits = n - F.length(F.translate(text, "0123456789", ""))
    marks = n - F.length(F.translate(text, "#$%&*<>|", ""))
    return F.when(digits * 50 > n, "numeric").when(marks * 50 > n, "marked").otherwise("plain")


def draw(key: F.Column, seed: str = "mix") -> F.Column:
    """A number in [0, 1) from the key: 48 bits of its MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("?"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def _labels(text: str, source: str, lang: str, topic: str | None) -> list[F.Column]:
    """The cell of a row: (source, lang, topic)."""
    kind = F.coalesce(F.col(topic).cast("string"), F.lit("?")) if topic else topic_of(F.coalesce(F.col(text), F.lit("")))
    return [F.coalesce(F.col(source).cast("string"), F.lit("?")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("?")).alias("lang"), kind.alias("topic")]


def described(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", topic: str | None = None) -> DataFrame:
    """(key, source, lang, topic, n_tokens) for every row."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long")
    return docs.select(F.col(key).alias("key"), *_labels(text, source, lang, topic), n.alias("n_tokens"))


class _Sums:
    """Sums over cells by a dimension or over all: windows in one partition, or grouped and joined."""

    def __init__(self, local: bool):
        self.local = local

    def add(self, cells: DataFrame, by: str | None, name: str, value: F.Column) -> DataFrame:
        if self.local:
            return cells.withColumn(name, F.sum(value).over(Window.partitionBy(by) if by else Window.partitionBy()))
        if by:
            return cells.join(cells.groupBy(by).agg(F.sum(value).alias(name)), by)
        return cells.withColumn(name, F.lit(cells.agg(F.sum(value).alias("s")).first()["s"]))


def _start(cells: DataFrame, sums: _Sums, temper: float, targets: Targets) -> DataFrame:
    """cells with ``total``, the target share of each marginal (``t_*``) and weight 1."""
    out = sums.add(cells, None, "total", F.col("tokens").cast("double")).withColumn("weight", F.lit(1.0))
    for d in DIMENSIONS:
        out = sums.add(out, d, f"o_{d}", F.col("tokens").cast("double"))
        share = F.pow(F.col(f"o_{d}") / F.col("total"), F.lit(float(temper)))
        if d in targets:
            pairs = [F.lit(x) for value, weight in targets[d].items() for x in (str(value), float(weight))]
            share = F.coalesce(F.element_at(F.create_map(*pairs), F.col(d)), F.lit(0.0)) if pairs else F.lit(0.0)
        # normalised over the distinct values: each of its n cells adds an n-th; a value without tokens cannot have a share
        out = sums.add(out, d, f"n_{d}", F.lit(1)).withColumn(f"t_{d}", F.when(F.col(f"o_{d}") > 0, share).otherwise(0.0))
        out = sums.add(out, None, f"s_{d}", F.col(f"t_{d}") / F.col(f"n_{d}"))
        out = out.withColumn(f"t_{d}", F.coalesce(F.col(f"t_{d}") / F.nullif(F.col(f"s_{d}"), F.lit(0.0)), F.lit(0.0)))
    return out.select(*DIMENSIONS, "tokens", "total", "weight", *(f"t_{d}" for d in DIMENSIONS))


def _round(cells: DataFrame, sums: _Sums) -> DataFrame:
    for d in DIMENSIONS:
        out = sums.add(cells, d, "have", F.col("weight") * F.col("tokens"))
        fitted = F.col("weight") * F.col(f"t_{d}") * F.col("total") / F.nullif(F.col("have"), F.lit(0.0))
        cells = out.withColumn("weight", F.coalesce(fitted, F.col("weight"))).drop("have")
    return cells


def deviation(cells: DataFrame) -> float:
    """The largest share of all tokens by which a marginal of the raked cells is off its target."""
    rows = [
        cells.groupBy(d).agg(F.max(F.abs(F.col(f"t_{d}"))).alias("t"), F.sum(F.col("weight") * F.col("tokens")).alias("have"), F.max("total").alias("total"))
        .agg(F.max(F.abs(F.col("have") / F.nullif(F.col("total"), F.lit(0.0)) - F.col("t"))).alias("off"))
        for d in DIMENSIONS
    ]
    worst = rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(F.max("off").alias("off")).first()["off"]
    return worst or 0.0


def raked(cells: DataFrame, rounds: int = ROUNDS, temper: float = TEMPER, budget: float = BUDGET, targets: Targets | None = None,
          tolerance: float = TOLERANCE, max_cells: int = MAX_CELLS) -> DataFrame:
    """cells (source, lang, topic, tokens) with ``weight`` and ``prob``."""
    unknown = set(targets or {}) - set(DIMENSIONS)
    if unknown:
        raise ValueError(f"no such dimension: {sorted(unknown)}")
    cells = materialise(cells, "sums")
    sums = _Sums(measured(cells)["rows"] <= max_cells)
    found = _start(cells.coalesce(1) if sums.local else cells, sums, temper, targets or {})
    for _ in range(MOST):
        for i in range(rounds):
            found = _round(found, sums)
            if not sums.local and i + 1 < rounds:
                found = materialise(found, "raking")
        found = materialise(found, "raking")
        off = deviation(found)
        if off <= tolerance:
            break
    else:
        warnings.warn(f"a marginal of the mix is {off:.2g} of all tokens off its target", stacklevel=2)
    factor = _factor(found.coalesce(1), budget) if sums.local else F.lit(_searched_factor(found, budget))
    prob = F.least(F.lit(1.0), F.coalesce(F.col("factor") * F.col("weight"), F.lit(1.0)))
    out = factor if sums.local else found.withColumn("factor", factor)
    return out.select(*DIMENSIONS, "tokens", "weight", F.when(F.col("tokens") == 0, 1.0).otherwise(prob).alias("prob"))


def _factor(one: DataFrame, budget: float) -> DataFrame:
    """Cells in one partition with the ``factor`` that spends the budget."""
    falling = Window.partitionBy().orderBy(F.desc("weight"), *DIMENSIONS)
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    mass = F.col("weight") * F.col("tokens")
    one = one.withColumn("full", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    one = one.withColumn("rest", F.sum(mass).over(falling.rowsBetween(0, Window.unboundedFollowing)))
    one = one.withColumn("c", (F.lit(budget) * F.col("total") - F.col("full")) / F.nullif(F.col("rest"), F.lit(0.0)))
    # the first cell, by falling weight, that its own factor leaves at 1 or less sets the factor for itself and all after it
    fits = F.when(F.col("c") * F.col("weight") <= 1, F.col("c"))
    return one.withColumn("factor", F.first(fits, ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def _searched_factor(cells: DataFrame, budget: float) -> float | None:
    """The same factor by sums alone: cells that reach 1 leave the others a larger one, until none is added."""
    factor = 0.0
    for _ in range(200):
        full = F.col("weight") * factor >= 1
        r = cells.agg(
            F.max("total").alias("total"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("spent"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight") * F.col("tokens"))).alias("rest"),
        ).first()
        if not r["rest"]:
            return factor or None
        now = (budget * r["total"] - r["spent"]) / r["rest"]
        if now <= factor * (1 + 1e-12):
            break
        factor = now
    return factor


def _plan(rows: DataFrame, **options) -> DataFrame:
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    return small_side(materialise(raked(cells, **options), "cells"))


def mixing_plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", topic: str | None = None,
                **options) -> DataFrame:
    """(key, source, lang, topic, n_tokens, weight, prob, sampled) for every row; options are those of ``raked``."""
    rows = materialise(described(docs, text, key, source, lang, topic), "described")
    joined = rows.join(_plan(rows, **options), list(DIMENSIONS))
    return joined.select(
        F.col("key").alias(key), "source", "lang", "topic", "n_tokens", "weight", "prob", (draw(F.col("key")) < F.col("prob")).alias("sampled")
    )


def sample_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", lang: str = "lang", topic: str | None = None,
                     **options) -> DataFrame:
    """The rows of ``docs`` that the plan samples; options are those of ``raked``."""
    plan = _plan(described(docs, text, key, source, lang, topic), **options)
    tagged = docs.select(*(F.col(f"`{c}`").alias(f"__{c}") for c in docs.columns), *_labels(text, source, lang, topic))
    kept = tagged.join(plan, list(DIMENSIONS)).where(draw(F.col(f"__{key}")) < F.col("prob"))
    return kept.select(*(F.col(f"`__{c}`").alias(c) for c in docs.columns))
