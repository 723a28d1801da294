"""Toxicity scores by non-negative positive-unlabelled learning.

A linear model over words is trained in numpy on the driver from confirmed toxic
texts (positives) and unlabelled ones, which hold toxic texts too. With class prior
``p``, positives P, unlabelled U and the logistic loss ``l``, the risk is
``p R_P(+) + max(0, R_U(-) - p R_P(-))``; when the second part goes below zero its
gradient is reversed, so that it cannot be driven there by fitting the positives.

The sample is bounded: the first ``max_positives`` confirmed and ``max_unlabelled``
other texts in the order of a hash of the key; the prior is the share of confirmed
toxic among *all* labelled training rows. Features are the lower-cased words of a text,
their beginnings of ``PREFIXES`` letters and two marks of style (exclamation marks,
capitals), each present or not; those are kept that are in ``min_texts`` positives and
whose excess there over the unlabelled texts has a likelihood ratio of ``evidence``.
The score is a probability calibrated without negatives: slope and shift of the margin
minimise the same positive-unlabelled risk, for which the logistic loss is convex
(``E_U[softplus(f)] - p E_P[f]``); at its minimum the mean score of unlabelled texts is the
prior. Confirmed rows that are not toxic tell the prior, and stand among the unlabelled.
Scoring runs over every whole text; labels, language, source and key are never inputs.

Sampled keys bring one text each to the driver (the one whose digest is least), cut off at
no length; a key that repeats, however often, is one candidate of the sample.

Defined results: null and empty texts score what the model gives a text without
words; without any confirmed toxic row every score is 0; rows of a null key are scored and never
trained on; a key with several labels is toxic if one says so; repeated rows score alike;
extra columns are kept by ``without_toxic`` and ignored otherwise.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.plans.storage import materialise, small_side

WORD = re.compile(r"[^\W\d_]+")
CAPITAL = re.compile("[A-Z\u00c0-\u00de]")
PREFIXES = (4, 5, 6)
MAX_POSITIVES, MAX_UNLABELLED = 2000, 4000
#: Words whose features a worker remembers.
CACHE = 1 << 17


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in PREFIXES if len(word) > k)]


def style_features(text: str) -> list[str]:
    n = len(text) + 1
    marks = text.count("!")
    out = ["!many"] if marks * 50 > n else ["!some"] if marks * 400 > n else []
    return [*out, "A many"] if len(CAPITAL.findall(text)) * 4 > n else out


def features(text: str | None) -> set[str]:
    text = text or ""
    found = set(style_features(text))
    for w in set(WORD.findall(text.lower())):
        found.update(word_features(w))
    return found


class Model:
    """Weights of features, and the line from margins to probabilities."""

    def __init__(self, weights: dict[str, float], bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift
        self.seen: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def _known(self, word: str) -> tuple[str, ...]:
        if len(self.seen) > CACHE:
            self.seen.clear()
        found = self.seen[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def margin(self, text: str | None) -> float:
        text = text or ""
        seen, met = self.seen, {f for f in style_features(text) if f in self.weights}
        for w in set(WORD.findall(text.lower())):
            known = seen.get(w)
            met.update(self._known(w) if known is None else known)
        return self.bias + sum(self.weights[f] for f in sorted(met))

    def score(self, text: str | None) -> float:
        return float(_sigmoid(self.slope * self.margin(text) + self.shift))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Sparse:
    """Binary rows as index lists."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width = width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.array([c for r in rows for c in r], dtype=np.int64)
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def _ratio(a: int, n: int, b: int, m: int) -> float:
    """Log likelihood ratio of two rates a/n and b/m against their common one."""

    def part(x: int, k: int, p: float) -> float:
        return (x * math.log(x / k / p) if x else 0.0) + ((k - x) * math.log((k - x) / k / (1 - p)) if x < k else 0.0)

    common = (a + b) / (n + m)
    return 2 * (part(a, n, common) + part(b, m, common))


def train(positive: list[str], unlabelled: list[str], prior: float, min_texts: int = 3,
          evidence: float = 20.0, epochs: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Fit by full-batch Adam; deterministic."""
    n, m = len(positive), max(len(unlabelled), 1)
    # Texts are read twice and their features never kept: only what positives repeat is counted elsewhere.
    common = {f: a for f, a in Counter(f for t in positive for f in features(t)).items() if a >= min_texts}
    elsewhere = Counter(f for t in unlabelled for f in features(t) if f in common)
    good = sorted(f for f, a in common.items() if a * m > elsewhere[f] * n and _ratio(a, n, elsewhere[f], m) >= evidence)
    index = {f: i for i, f in enumerate(good)}
    p, u = (Sparse([sorted(index[f] for f in features(t) if f in index) for t in part], len(index)) for part in (positive, unlabelled))
    w, b = np.zeros(len(index)), 0.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for step in range(1, epochs + 1):
        fp, fu = p.dot(w) + b, u.dot(w) + b
        # derivative of log(1+exp(-f)) is -sigmoid(-f); of log(1+exp(f)) is sigmoid(f)
        up, dn, du = -_sigmoid(-fp) / p.n, _sigmoid(fp) / p.n, _sigmoid(fu) / max(u.n, 1)
        negative = np.logaddexp(0, fu).sum() / max(u.n, 1) - prior * np.logaddexp(0, fp).mean()
        if negative >= 0:
            gp, gu = prior * up - prior * dn, du
        else:
            gp, gu = prior * dn, -du
        grad = np.append(p.back(gp) + u.back(gu) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        delta = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - delta[:-1], b - delta[-1]
    model = Model({k: float(w[i]) for k, i in index.items()}, float(b))
    model.slope, model.shift = _calibrated(p.dot(w) + b, u.dot(w) + b, prior)
    return model


def _calibrated(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that minimise E_U[softplus(f)] - prior E_P[f], by damped Newton steps; a weak ridge holds the slope."""
    scale = max(float(np.abs(np.concatenate([fp, fu])).max(initial=0)), 1e-9)
    xu, xp = (np.stack([f / scale, np.ones(len(f))], axis=1) for f in (fu, fp))
    if not len(fu):
        return 1.0, 0.0
    a, ridge, known = np.array([1.0, 0.0]), np.diag([1e-4, 1e-9]), prior * xp.mean(axis=0)

    def risk(a: np.ndarray) -> float:
        return float(np.logaddexp(0, xu @ a).mean() - known @ a + 0.5 * a @ ridge @ a)

    for _ in range(200):
        q = _sigmoid(xu @ a)
        gradient = xu.T @ q / len(xu) - known + ridge @ a
        step = np.linalg.solve((xu * (q * (1 - q))[:, None]).T @ xu / len(xu) + ridge, gradient)
        size = 1.0
        while risk(a - size * step) > risk(a) and size > 1e-6:
            size /= 2
        a = a - size * step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a[0]) / scale, 1e-6), float(a[1])


def fold(key: F.Column) -> F.Column:
    """crc32 of the key as text, modulo 4."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
        held_out: int | None = 2, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Train from the rows of ``labels`` outside fold ``held_out`` (None: all) and a bounded sample of ``docs``."""
    use = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null")
    if held_out is not None:
        use = use.where(fold(F.col("k")) != held_out)
    use = use.groupBy("k").agg(F.max("y").alias("y"))
    stats = use.agg(F.avg("y").alias("prior"), F.count("y").alias("n")).first()
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if held_out is not None:
        texts = texts.where(fold(F.col("k")) != held_out)
    order = F.xxhash64("k", F.lit(8))
    # Keys are sampled before texts are fetched, so no text is shuffled that is not used.
    chosen = (
        use.where("y = 1").orderBy(order).limit(max_positives)
        .unionByName(use.where("y = 0").orderBy(order).limit(max_unlabelled // 2))
    )
    chosen = materialise(chosen, "labelled")
    keys = texts.where("k is not null").join(small_side(chosen).select("k"), "k", "left_anti").select("k", order.alias("h"))
    keys = materialise(_lowest(keys, max_unlabelled // 2), "others")
    picked = materialise(chosen.unionByName(keys.select("k", F.lit(None).cast("int").alias("y"))), "picked")
    # one text for a key: copies of a key would multiply what the driver holds
    one = texts.join(small_side(picked), "k").groupBy("k", "y").agg(F.min_by("t", F.struct(F.md5("t"), "t")).alias("t"))
    rows = one.orderBy("k").select("t", "y").collect()
    positive = [r["t"] for r in rows if r["y"] == 1]
    if not positive:
        return Model({}, -40.0)
    # The unlabelled set stands for the whole corpus: confirmed toxic texts belong to it at their own rate.
    rest = [r["t"] for r in rows if r["y"] != 1]
    prior = min(max(float(stats["prior"] or 0.0), 1e-3), 0.9)
    mixed = positive[: round(prior / (1 - prior) * sum(r["y"] == 0 for r in rows))]
    return train(positive, rest + mixed, prior)


def _lowest(keys: DataFrame, n: int) -> DataFrame:
    """The ``n`` distinct keys (k) of least hash h. A first look at the count tells below which hash they lie, so few are shuffled."""
    size = keys.agg(F.approx_count_distinct("h", 0.05).alias("n")).first()["n"]
    share = 2 * n / max(size, 1)
    few = keys.where(F.col("h") < int(-(1 << 63) + share * (1 << 64))) if share < 0.5 else keys
    return few.select("k", "h").distinct().orderBy("h").limit(n)


def score_column(spark, model: Model, text: F.Column) -> F.Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(text)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``."""
    return docs.where(score_column(docs.sparkSession, model, F.col(text)) < threshold)
