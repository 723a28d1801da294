"""What a model offers, for those who add one.

``Model`` is asked for masses and learns; ``Coded`` narrows a coder as well. Both are
checked by structure, so a model needs no base class. ``coded`` gives a model that only
has masses a coder over a finite alphabet.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol, runtime_checkable

from quillbit.operators.coder import DOUBLE_TOTAL, Decoder, Encoder, discretise


@runtime_checkable
class Model(Protocol):
    def mass(self, x: int) -> float:
        """The chance of a symbol."""

    def learn(self, x: int) -> None:
        """Take note of a symbol."""


@runtime_checkable
class Coded(Protocol):
    def encode(self, x: int, coder: Encoder, omit=frozenset()) -> None:
        """Narrow the coder by a symbol; symbols in ``omit`` cannot occur."""

    def decode(self, coder: Decoder, omit=frozenset()) -> int:
        """The symbol the coder points to."""

    def learn(self, x: int) -> None:
        """Take note of a symbol."""


def encode_by_masses(masses: dict[int, float], x: int, coder: Encoder, total: int = DOUBLE_TOTAL) -> None:
    """Code one symbol of a finite table by its masses, in the table's order."""
    low = 0
    for symbol, width in zip(masses, discretise(list(masses.values()), total), strict=True):
        if symbol == x:
            coder.narrow(low, low + width, total)
            return
        low += width
    raise ValueError(f"no mass for {x!r}")


def decode_by_masses(masses: dict[int, float], coder: Decoder, total: int = DOUBLE_TOTAL) -> int:
    target, low = coder.target(total), 0
    for symbol, width in zip(masses, discretise(list(masses.values()), total), strict=True):
        if target < low + width:
            coder.narrow(low, low + width, total)
            return symbol
        low += width
    raise ValueError("masses do not reach the target")


class ByMasses:
    """A coder for any model over a finite alphabet, by what it says of every symbol."""

    def __init__(self, model: Model, alphabet: Iterable[int]):
        self.model, self.alphabet = model, list(alphabet)

    def masses(self, omit=frozenset()) -> dict[int, float]:
        live = {x: self.model.mass(x) for x in self.alphabet if x not in omit}
        whole = sum(live.values())
        return {x: m / whole for x, m in live.items()}

    def mass(self, x: int) -> float:
        return self.model.mass(x)

    def encode(self, x: int, coder: Encoder, omit=frozenset()) -> None:
        encode_by_masses(self.masses(omit), x, coder)

    def decode(self, coder: Decoder, omit=frozenset()) -> int:
        return decode_by_masses(self.masses(omit), coder)

    def learn(self, x: int) -> None:
        self.model.learn(x)


def coded(model, alphabet: Iterable[int]) -> Coded:
    """The model itself where it can code, else by its masses."""
    return model if isinstance(model, Coded) else ByMasses(model, alphabet)
