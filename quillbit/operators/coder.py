"""Arithmetic coding with integer intervals, and bits in and out.

A range coder with carries (G. N. N. Martin, Range encoding, 1979; there digits are bytes,
here any run of bits). The state is the low end of the interval within ``BITS`` bits and
its width. Narrowing to (lo, hi, total) gives the last symbol what division leaves over;
then all bits that no longer fit are handed to the sink in one piece, and where the low
end grew past its bits a carry goes back into what the sink has. The decoder keeps only
the distance of the code from the low end. Python integers make every step exact, so
decoding is symmetric.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

BITS = 62
MASK = (1 << BITS) - 1


class BitCounter:
    """Counts bits and keeps none."""

    def __init__(self):
        self.n = 0

    def write(self, value: int, count: int = 1) -> None:
        """Take the ``count`` low bits of ``value``, the highest first."""
        self.n += count

    def carry(self) -> None:
        """Add one to what has been written, as a binary number."""


class BitBuffer(BitCounter):
    """Keeps bits, in pieces that a carry can still change; ``bytes`` pads the last one with zeros."""

    def __init__(self):
        super().__init__()
        self.pieces: list[tuple[int, int]] = []

    def write(self, value: int, count: int = 1) -> None:
        self.n += count
        self.pieces.append((value, count))

    def carry(self) -> None:
        at = len(self.pieces) - 1
        while self.pieces[at][0] + 1 == 1 << self.pieces[at][1]:
            self.pieces[at] = 0, self.pieces[at][1]
            at -= 1
        self.pieces[at] = self.pieces[at][0] + 1, self.pieces[at][1]

    def text(self) -> str:
        return "".join(f"{value:0{count}b}" for value, count in self.pieces)

    def __bytes__(self) -> bytes:
        whole = self.text()
        whole += "0" * (-len(whole) % 8)
        return int(whole, 2).to_bytes(len(whole) // 8, "big") if whole else b""


def bits_of(data: bytes) -> Iterator[int]:
    """Bits of bytes, the highest first."""
    for byte in data:
        for shift in range(7, -1, -1):
            yield byte >> shift & 1


def ascii_bits(text: str) -> Iterator[int]:
    """Bits of a string of 0 and 1; other characters are skipped."""
    return (int(c) for c in text if c in "01")


def constant_bits(bit: int) -> Iterator[int]:
    while True:
        yield bit


def joined_bits(*parts: Iterable[int]) -> Iterator[int]:
    for part in parts:
        yield from part


class Encoder:
    def __init__(self, sink: BitCounter):
        self.sink, self.low, self.width = sink, 0, 1 << BITS
        self.trace: list[tuple[int, int, int]] | None = None

    def narrow(self, lo: int, hi: int, total: int) -> None:
        if self.trace is not None:
            self.trace.append((lo, hi, total))
        if hi <= lo:
            raise ValueError("a symbol without mass cannot be coded")
        unit = self.width // total
        start = unit * lo
        low = self.low + start
        width = self.width - start if hi >= total else unit * (hi - lo)
        if low > MASK:
            self.sink.carry()
            low &= MASK
        spare = BITS - width.bit_length()
        if spare > 0:
            self.sink.write(low >> (BITS - spare), spare)
            low = (low << spare) & MASK
            width <<= spare
        self.low, self.width = low, width

    def finish(self) -> None:
        """Write the fewest bits whose every continuation lies in the interval."""
        for n in range(1, BITS + 1):
            step = 1 << (BITS - n)
            value = -(-self.low // step) * step
            if value + step <= self.low + self.width:
                if value > MASK:
                    self.sink.carry()
                self.sink.write((value & MASK) >> (BITS - n), n)
                return


class Decoder:
    """Reads what an encoder wrote, from bytes or from bits one by one; zeros follow the end."""

    def __init__(self, source: bytes | Iterable[int]):
        self.data, self.at = (source, 0) if isinstance(source, bytes) else (None, 0)
        self.bits = iter(()) if self.data is not None else iter(source)
        self.width, self.offset = 1 << BITS, self._take(BITS)

    def _take(self, n: int) -> int:
        if self.data is None:
            value = 0
            for _ in range(n):
                value = value << 1 | next(self.bits, 0)
            return value
        first, end = self.at >> 3, self.at + n
        last = (end + 7) >> 3
        value = int.from_bytes(self.data[first:last].ljust(last - first, b"\0"), "big")
        self.at = end
        return value >> (last * 8 - end) & ((1 << n) - 1)

    def target(self, total: int) -> int:
        """Where in 0..total-1 the coded value lies."""
        return min(self.offset // (self.width // total), total - 1)

    def narrow(self, lo: int, hi: int, total: int) -> None:
        unit = self.width // total
        start = unit * lo
        self.offset -= start
        self.width = self.width - start if hi >= total else unit * (hi - lo)
        spare = BITS - self.width.bit_length()
        if spare > 0:
            self.offset = self.offset << spare | self._take(spare)
            self.width <<= spare


#: Total of the intervals that stand for probabilities in double precision.
DOUBLE_TOTAL = 1 << 30


def split(p: float) -> int:
    """The share of ``DOUBLE_TOTAL`` of a probability, so that neither side gets nothing."""
    return min(max(int(p * DOUBLE_TOTAL), 1), DOUBLE_TOTAL - 1)


def discretise(masses: list[float], total: int = DOUBLE_TOTAL) -> list[int]:
    """Integer masses of a finite table: floors of at least 1, what is left over or overspent spread in order."""
    out = [max(1, int(m * total)) for m in masses]
    rest = total - sum(out)
    n = len(out)
    if rest > 0:
        each, more = divmod(rest, n)
        out = [m + each + (i < more) for i, m in enumerate(out)]
    while rest < 0:
        for i in range(n):
            if out[i] > 1 and rest < 0:
                out[i] -= 1
                rest += 1
        if all(m == 1 for m in out) and rest < 0:
            raise ValueError("more symbols than units of mass")
    return out
