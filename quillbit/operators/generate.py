"""Texts drawn from models, and what a model expects at each position.

All run in Python over rows, one sequence each: a model has to be asked for the mass of
every symbol of an alphabet at every step.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbit.operators import native
from quillbit.operators.coder import BitCounter, Decoder, Encoder
from quillbit.operators.sequential import PPM
from quillbit.plans.spec import ModelSpec


def generate(spec: ModelSpec, n: int, seed: int = 0, train: list[int] | None = None) -> list[int]:
    """``n`` symbols (fewer if the end mark comes): random bits, decoded by the model."""
    stack = spec.build()
    for x in train or []:
        for m in stack:
            m.learn(x)
    rng = random.Random(seed)
    coder, out = Decoder(iter(lambda: rng.getrandbits(1), None)), []
    while len(out) < n:
        x = stack[-1].decode(coder)
        if x == spec.end:
            break
        out.append(x)
        for m in stack:
            m.learn(x)
    return out


def _extreme(spec: ModelSpec, n: int, alphabet: list[int], pick: Callable, train: list[int] | None) -> list[int]:
    stack, out = spec.build(), []
    for x in train or []:
        for m in stack:
            m.learn(x)
    for _ in range(n):
        bits = costs(alphabet, stack)
        out.append(pick(alphabet, key=lambda x: (bits[x], x)))  # noqa: B023
        for m in stack:
            m.learn(out[-1])
    return out


def friendly(spec: ModelSpec, n: int, alphabet: list[int], train: list[int] | None = None) -> list[int]:
    """At every step the symbol the model thinks most likely."""
    return _extreme(spec, n, alphabet, min, train)


def adversarial(spec: ModelSpec, n: int, alphabet: list[int], train: list[int] | None = None) -> list[int]:
    """At every step the symbol the model thinks least likely."""
    return _extreme(spec, n, alphabet, max, train)


def costs(alphabet: list[int], stack: list) -> dict[int, float]:
    """Bits of every symbol of an alphabet as the model stands; coding does not change it."""
    if hasattr(stack[-1], "masses"):
        return {x: -math.log2(p) if p > 0 else math.inf for x, p in stack[-1].masses(alphabet).items()}
    out = {}
    for x in alphabet:
        coder = Encoder(BitCounter())
        coder.trace = []
        stack[-1].encode(x, coder)
        out[x] = sum(math.log2(t / (b - a)) for a, b, t in coder.trace)
    return out


def entropies(spec: ModelSpec, symbols: list[int], alphabet: list[int]) -> list[float]:
    """Before each symbol the entropy in bits of what the model expects over ``alphabet`` and the end mark."""
    stack, out = spec.build(), []
    for x in symbols:
        masses = [2.0**-c for c in costs([*alphabet, spec.end], stack).values()]
        total = sum(masses)
        out.append(-sum(p / total * math.log2(p / total) for p in masses if p > 0))
        for m in stack:
            m.learn(x)
    return out


def entropies_column(text: Column, spec: ModelSpec, alphabet: list[int]) -> Column:
    """``entropies`` of the bytes of each text; PPM over bytes runs in the JVM (``native``)."""
    if spec.base.name == "uniform_byte" and isinstance(spec.build()[-1], PPM):
        found = native.column(text, "entropies", spec, [*alphabet, spec.end])
        if found is not None:
            return found

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([entropies(spec, list((v or "").encode()), alphabet) for v in values])

    return run(text)


def generated(spark: SparkSession, spec: ModelSpec, rows: int, n: int) -> DataFrame:
    """(id, symbols): ``rows`` sequences of up to ``n`` symbols, one seed each."""

    @F.pandas_udf("array<int>")
    def run(seeds: pd.Series) -> pd.Series:
        return pd.Series([generate(spec, n, int(s)) for s in seeds])

    return spark.range(rows).select("id", run(F.col("id")).alias("symbols"))


def train_then_measure(spec: ModelSpec, training: list[int], symbols: list[int]) -> int:
    """Bits of a sequence after learning another one."""
    stack, sink = spec.build(), BitCounter()
    for x in training:
        for m in stack:
            m.learn(x)
    coder = Encoder(sink)
    for x in symbols:
        stack[-1].encode(x, coder)
        for m in stack:
            m.learn(x)
    stack[-1].encode(spec.end, coder)
    coder.finish()
    return sink.n

