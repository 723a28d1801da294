"""Finite distributions as tables on the driver, and how they are changed."""

from __future__ import annotations

import bisect
import itertools
import random
from collections.abc import Hashable, Iterable, Mapping

from quillbit.operators.coder import Decoder, Encoder
from quillbit.operators.protocol import decode_by_masses, encode_by_masses


class Table:
    """Outcomes with masses; ``weights`` need not sum to one. The order of outcomes is the order of coding."""

    def __init__(self, weights: Mapping[Hashable, float]):
        if not weights or min(weights.values()) < 0 or not sum(weights.values()) > 0:
            raise ValueError("a table needs masses that are not negative and not all zero")
        whole = sum(weights.values())
        self.masses = {x: w / whole for x, w in weights.items()}
        self.upto = list(itertools.accumulate(self.masses.values()))
        self.outcomes = list(self.masses)

    @staticmethod
    def uniform(outcomes: Iterable[Hashable]) -> Table:
        return Table(dict.fromkeys(outcomes, 1.0))

    def mass(self, x: Hashable) -> float:
        return self.masses.get(x, 0.0)

    def cumulative(self, x: Hashable) -> tuple[float, float]:
        """Where the interval of an outcome begins and ends."""
        at = self.outcomes.index(x)
        return self.upto[at - 1] if at else 0.0, self.upto[at]

    def find(self, u: float) -> Hashable:
        """The outcome whose interval holds ``u`` of [0, 1)."""
        return self.outcomes[min(bisect.bisect_right(self.upto, u), len(self.outcomes) - 1)]

    def sample(self, rng: random.Random, omit: Iterable[Hashable] = ()) -> Hashable:
        return (self.without(omit) if omit else self).find(rng.random())

    def without(self, omit: Iterable[Hashable]) -> Table:
        gone = set(omit)
        return Table({x: m for x, m in self.masses.items() if x not in gone})

    def inverted(self) -> Table:
        """Masses in proportion to one over each; outcomes without mass stay without."""
        return Table({x: 1 / m if m else 0.0 for x, m in self.masses.items()})

    def having(self, x: Hashable, mass: float) -> Table:
        """An outcome set to a mass, new or not; the others share the rest in their proportion."""
        rest = 1 - self.mass(x)
        if not 0 <= mass <= 1 or mass < 1 and rest <= 0:
            raise ValueError("no such mass is left")
        scaled = {y: m * (1 - mass) / rest if rest > 0 else 0.0 for y, m in self.masses.items()}
        return Table(scaled | {x: mass})

    def encode(self, x: Hashable, coder: Encoder, omit=frozenset()) -> None:
        encode_by_masses((self.without(omit) if omit else self).masses, x, coder)

    def decode(self, coder: Decoder, omit=frozenset()) -> Hashable:
        return decode_by_masses((self.without(omit) if omit else self).masses, coder)

    def learn(self, x: Hashable) -> None:
        pass
