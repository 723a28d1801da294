"""Secret scan: fixed rules, and probabilistic automata for formats the rules do not name.

1. One scan of every whole text finds the spans of the rules (``assign``, ``access``,
   ``hex``) and all *candidates*: maximal runs ``[A-Za-z0-9+/_=-]{12,}``, and of runs that
   meet rule spans what is left of them beside these, if that has 12 characters.
2. Labelled credentials are the distinct values the rules found in all texts, and those of
   ``labelled``: examples of published formats unless the caller gives others. An automaton
   is learnt for each kind (``grammar``: prefix tree, state merging).
   The background is learnt from all distinct candidates, of every shape: an automaton over
   classes, and letter pairs; and an automaton of ``plain_shapes``, common formats that are
   no secrets. Candidates that score as secrets are left out and the background is learnt
   again, up to ``ROUNDS`` times. A candidate is judged by the background of the other half
   (by a hash) of the candidates, so that none speaks for itself.
3. Every candidate and every rule value is scored: log2 likelihood under the best format
   less that under the best background of all that was kept, for each character. A candidate
   becomes a span of kind ``format`` when its score reaches the threshold; rule spans always
   stay. The threshold is ``THRESHOLD``, or more where the scores that candidates have by
   the other half spread further: ``SPREADS`` median deviations above their median.

No value is left out of counts, medians, scores or spans, whatever its length and however
many there are. Executors count steps (``grammar.steps``, ``Pairs.steps``); what reaches the
driver are sums for each place and class, whose number does not grow with the values.
Offsets are code points, ends exclusive; a span of a rule is its whole match. Defined
results: null text counts as empty and has no span; repeated rows are scanned alike;
extra columns are ignored; without any labelled value nothing is added.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.grammar import Automaton, Pairs, learn, merge, steps
from quillbit.plans.storage import materialise, measured

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SHORTEST = 12
THRESHOLD, SPREADS, ROUNDS = 0.5, 4, 4
#: Kind of the candidates among all values.
PLAIN = -1
#: Scores that are sorted on the driver to end the search for a median.
FEW = 1 << 14
SCAN = "spans array<struct<start:int,kind:int,end:int,value:string>>, candidates array<struct<start:int,end:int,value:string>>"


def rule_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) of the rules."""
    out = []
    small = text.lower()
    if any(w in small for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs, less what rule spans cover."""
    taken = sorted((s, e) for s, _, e, _ in spans)
    out, now = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while now < len(taken) and taken[now][1] <= at:
            now += 1
        for s, e in taken[now:]:
            if s >= end:
                break
            if s - at >= SHORTEST:
                out.append((at, s, text[at:s]))
            at = max(at, e)
        if end - at >= SHORTEST:
            out.append((at, end, text[at:end]))
    return out


def _scan_column(text: F.Column) -> F.Column:
    @F.pandas_udf(SCAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for value in texts:
                value = value or ""
                spans = rule_spans(value)
                rows.append((spans, candidates(value, spans)))
            yield pd.DataFrame(
                {
                    "spans": [[dict(zip(("start", "kind", "end", "value"), s, strict=True)) for s in r[0]] for r in rows],
                    "candidates": [[dict(zip(("start", "end", "value"), c, strict=True)) for c in r[1]] for r in rows],
                }
            )

    return scan(text)


def plain_shapes(n: int = 40) -> list[str]:
    """Formats that look like secrets and are none: times, UUIDs, versions, numbered names and paths, long numbers."""
    rng = random.Random(5)

    def number(low: int, high: int) -> str:
        return str(rng.randint(low, high))

    def word(low: int = 3, high: int = 9) -> str:
        return "".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randint(low, high)))

    def digits(k: int, chars: str = "0123456789") -> str:
        return "".join(rng.choice(chars) for _ in range(k))

    hexadecimal = "0123456789abcdef"
    out: list[str] = []
    for _ in range(n):
        day = f"{number(1970, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        out += [
            f"{day}T{rng.randint(0, 23):02}", f"{day}-{rng.randint(0, 23):02}-{rng.randint(0, 59):02}", f"{day.replace('-', '')}{digits(6)}",
            f"{day.replace('-', '/')}/{word()}", f"{word()}-{word()}-{number(1, 2030)}", f"{word()}-{word()}-{word()}-{number(1, 99)}",
            f"{word()}_{word()}_{number(1, 2030)}", f"{word()}/{word()}/{number(1, 9999)}", f"{word(5, 9).capitalize()}{word(5, 9).capitalize()}{number(1, 9)}",
            f"{word()}-v{number(1, 20)}-{number(0, 20)}", f"{word(2, 4).upper()}-{number(1, 9999)}-{digits(8)}", digits(rng.randint(12, 20)),
            f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"+{digits(2)}-{digits(3)}-{digits(7)}", "=" * rng.randint(12, 40), "-" * rng.randint(12, 40), "_" * rng.randint(12, 40),
            "-".join(digits(k, hexadecimal) for k in (8, 4, 4, 4, 12)),
        ]
    return out


def published(n: int = 120) -> list[tuple[int, str]]:
    """(kind, credential): examples of four published shapes, random as real ones are."""
    rng = random.Random(7)
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def draw(chars: str, k: int) -> str:
        return "".join(rng.choice(chars) for _ in range(k))

    every = upper + lower + digit
    out = [(10, draw(every, rng.randint(16, 48))) for _ in range(n)]
    out += [(11, draw(every + "+/", rng.randint(20, 64)) + "=" * rng.randint(0, 2)) for _ in range(n)]
    out += [(12, draw(lower, rng.randint(2, 5)) + rng.choice("_-") + draw(every, rng.randint(20, 48))) for _ in range(n)]
    out += [(13, draw(upper, 4) + draw(upper + "234567", rng.randint(12, 28))) for _ in range(n)]
    return out


class Scorer:
    """Automata of formats against the background."""

    def __init__(self, formats: list[Automaton], background: list, threshold: float):
        self.formats, self.background, self.threshold = formats, background, threshold

    def score(self, value: str) -> float:
        """Bits for each character by which the best format explains ``value`` better than the best background."""
        if not self.formats:
            return -math.inf
        return (max(a.bits(value) for a in self.formats) - max(b.bits(value) for b in self.background)) / max(len(value), 1)


class Plain:
    """What counted candidates tell of the background."""

    def __init__(self, states: Counter | None = None, pairs: Counter | None = None):
        self.states, self.pairs = states or Counter(), pairs or Counter()

    def add(self, values: list[str]) -> None:
        self.states.update(steps(values))
        self.pairs.update(Pairs.steps(values))

    def __add__(self, other: Plain) -> Plain:
        return Plain(self.states + other.states, self.pairs + other.pairs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Plain) and (self.states, self.pairs) == (other.states, other.pairs)

    def models(self) -> list:
        return [Pairs(self.pairs)] + ([merge(self.states)] if self.states else [])


class Judge:
    """Scores of candidates, each by the background of the half that it is not in; what all halves share is scored once."""

    def __init__(self, halves: list[Plain]):
        self.models = [halves[1].models(), halves[0].models()]

    def score(self, half: int, value: str, best: float, shape: float) -> float:
        return (best - max(shape, *(m.bits(value) for m in self.models[half]))) / max(len(value), 1)


def _background(count: Callable[[Judge | None, float], list[Plain]], threshold: float) -> list[Plain]:
    """Both halves of the candidates without what looks like a secret: ``count`` counts those that a judge scores below a limit."""
    whole = now = count(None, 0.0)
    for _ in range(ROUNDS):
        # secrets that no rule names stand among the candidates: what looks like one does not teach what is plain
        again = count(Judge(now), threshold if now != whole else 0.0)
        if again == now:
            break
        now = again
    return now


def _formats(labelled: list[tuple[int, str]], counted: dict[int, Counter]) -> list[Automaton]:
    """An automaton for each kind of (kind, credential) pairs and counted values."""
    groups: dict[int, list[str]] = {}
    for kind, value in labelled:
        groups.setdefault(kind, []).append(value)
    return [merge(counted[k] + steps(groups.get(k, []))) if k in counted else learn(groups[k]) for k in sorted(groups.keys() | counted.keys())]


def train(labelled: list[tuple[int, str]], plain: list[str], threshold: float = THRESHOLD) -> Scorer:
    """Learn from lists of (kind, credential) pairs and of candidates that stand for what is no secret."""
    formats, shapes = _formats(labelled, {}), learn(plain_shapes())
    if not formats:
        return Scorer([], [shapes], threshold)
    parts = [(i % 2, v, max(a.bits(v) for a in formats), shapes.bits(v)) for i, v in enumerate(plain)]

    def count(judge: Judge | None, limit: float) -> list[Plain]:
        out = [Plain(), Plain()]
        for half in (0, 1):
            out[half].add([p[1] for p in parts if p[0] == half and (judge is None or judge.score(*p) < limit)])
        return out

    halves = _background(count, threshold)
    scorer = Scorer(formats, [shapes, *(halves[0] + halves[1]).models()], threshold)
    if parts:
        scores = sorted(Judge(halves).score(*p) for p in parts)
        middle = scores[len(scores) // 2]
        spread = sorted(abs(s - middle) for s in scores)[len(scores) // 2]
        scorer.threshold = max(threshold, middle + SPREADS * spread)
    return scorer


COUNTS = "part int, place string, step string, n long"


def _rows(counts: dict[int, Counter]) -> pd.DataFrame:
    return pd.DataFrame([(k, *at, n) for k, own in counts.items() for at, n in own.items()], columns=["part", "place", "step", "n"])


def _summed(parts: DataFrame) -> dict[int, Counter]:
    """Counts of all tasks by part."""
    out: dict[int, Counter] = {}
    for r in parts.groupBy("part", "place", "step").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["part"], Counter())[r["place"], r["step"]] = r["n"]
    return out


def _middle(numbers: DataFrame, value: F.Column) -> float:
    """The number at half the count in order, exactly: bins around it are narrowed until few numbers are left."""
    rows = numbers.select(value.alias("v"))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    at = n // 2
    while n > FEW and low < high:
        width = (high - low) / 1024
        bins = F.least(F.lit(1023), F.floor((F.col("v") - low) / width)).alias("bin")
        found = rows.where(F.col("v").between(low, high)).groupBy(bins).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for _, n, low, high in sorted(map(tuple, found.collect())):
            if at < n:
                break
            at -= n
    return low if low == high else sorted(r["v"] for r in rows.where(F.col("v").between(low, high)).collect())[at]


def learned(found: DataFrame, labelled: list[tuple[int, str]] | None = None, threshold: float = THRESHOLD) -> Scorer:
    """A scorer from all values of scanned documents and the caller's own credentials."""
    values = found.select(F.explode("spans").alias("s")).select("s.kind", "s.value")
    plain = found.select(F.explode("candidates").alias("c")).select(F.lit(PLAIN).alias("kind"), "c.value")
    values = materialise(values.unionByName(plain).distinct(), "values")

    def count_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, Counter] = {}
        for batch in batches:
            for kind, own in batch.groupby("kind")["value"]:
                counts.setdefault(int(kind), Counter()).update(steps(own))
        yield _rows(counts)

    added = published() if labelled is None else labelled
    formats, shapes = _formats(list(added), _summed(values.where(F.col("kind") != PLAIN).mapInPandas(count_rules, COUNTS))), learn(plain_shapes())
    if not formats:
        return Scorer([], [shapes], threshold)
    spark = found.sparkSession
    fixed = spark.sparkContext.broadcast((formats, shapes))

    def score_fixed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        formats, shapes = fixed.value
        for batch in batches:
            best = [max(a.bits(v) for a in formats) for v in batch["value"]]
            yield batch.assign(best=best, shape=[shapes.bits(v) for v in batch["value"]])

    half = (F.xxhash64("value", F.lit(1)) % 2 != 0).cast("int").alias("half")
    parts = materialise(values.where(F.col("kind") == PLAIN).select(half, "value").mapInPandas(score_fixed, "half int, value string, best double, shape double"), "plain")

    def judged(batch: pd.DataFrame, judge: Judge) -> list[float]:
        return [judge.score(*row) for row in zip(batch["half"], batch["value"], batch["best"], batch["shape"], strict=True)]

    def count(judge: Judge | None, limit: float) -> list[Plain]:
        told = spark.sparkContext.broadcast(judge)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            halves = [Plain(), Plain()]
            for batch in batches:
                if told.value is not None:
                    batch = batch[[s < limit for s in judged(batch, told.value)]]
                for i, own in batch.groupby("half")["value"]:
                    halves[int(i)].add(list(own))
            yield _rows({2 * i + j: c for i, h in enumerate(halves) for j, c in enumerate((h.states, h.pairs))})

        sums = _summed(parts.mapInPandas(run, COUNTS))
        return [Plain(sums.get(0), sums.get(1)), Plain(sums.get(2), sums.get(3))]

    halves = _background(count, threshold)
    scorer = Scorer(formats, [shapes, *(halves[0] + halves[1]).models()], threshold)
    if measured(parts)["rows"]:
        told = spark.sparkContext.broadcast(Judge(halves))

        def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"score": judged(batch, told.value)})

        scores = materialise(parts.mapInPandas(final, "score double"), "scores")
        middle = _middle(scores, F.col("score"))
        scorer.threshold = max(threshold, middle + SPREADS * _middle(scores, F.abs(F.col("score") - middle)))
    return scorer


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", labelled: list[tuple[int, str]] | None = None,
                 threshold: float = THRESHOLD) -> DataFrame:
    """(key, spans): array of struct(start, kind, end, value, score), by start and kind. ``labelled``: (kind, credential) pairs to train on besides."""
    found = materialise(docs.select(F.col(key).alias("key"), _scan_column(F.col(text)).alias("s")).select("key", "s.spans", "s.candidates"), "spans")
    scorer = learned(found, labelled, threshold)
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for values in batches:
            if len(known) > 1 << 16:
                known.clear()
            out = []
            for row in values:
                for v in row:
                    if v not in known:
                        known[v] = model.value.score(v)
                out.append([known[v] for v in row])
            yield pd.Series(out)

    def scored(values: F.Column) -> F.Column:
        return score(F.transform(values, lambda v: v["value"]))

    def span(v: F.Column, kind: F.Column, s: F.Column) -> F.Column:
        return F.struct(v["start"].alias("start"), kind.alias("kind"), v["end"].alias("end"), v["value"].alias("value"), s.alias("score"))

    kept = F.filter(F.zip_with("candidates", "more", lambda c, s: span(c, F.lit(3), s)), lambda c: c["score"] >= scorer.threshold)
    rules = F.zip_with("spans", "own", lambda v, s: span(v, v["kind"], s))
    return (
        found.withColumn("own", scored(F.col("spans"))).withColumn("more", scored(F.col("candidates")))
        .select(F.col("key").alias(key), F.array_sort(F.concat(rules, kept)).alias("spans"))
    )


def span_digest_text(spans: F.Column) -> F.Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
