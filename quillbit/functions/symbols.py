"""Bytes, code points and token alphabets.

Two alphabets cover every byte string. The *simple* one has characters (surrogates
included), illegal bytes 0x80..0xFF and an end mark. The *detailed* one tells
surrogates, overlong forms and too-high code points apart. Each token has a number;
the numbering is a bijection with ``range(SIMPLE_RANGE)`` or ``range(DETAILED_RANGE)``.

Text columns are valid UTF-8, so their symbols are plain expressions; malformed bytes
need the byte decoders below, which run over BINARY columns in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the two alphabets.
UNICODE = 0x110000
SURROGATES = 0x800
SIMPLE_RANGE = UNICODE + 0x80 + 1
CHARACTERS = UNICODE - SURROGATES
OVERLONG = 128 * 3 + 1920 * 2 + 63488 * 1
TOO_HIGH = 0x200000 - UNICODE
DETAILED_RANGE = CHARACTERS + SURROGATES + OVERLONG + TOO_HIGH + 0x80 + 1
BYTE_EOF = 256
#: First number of every kind of the detailed alphabet.
FIRST = {
    "char": 0,
    "surrogate": CHARACTERS,
    "overlong": CHARACTERS + SURROGATES,
    "too_high": CHARACTERS + SURROGATES + OVERLONG,
    "illegal": CHARACTERS + SURROGATES + OVERLONG + TOO_HIGH,
    "eof": DETAILED_RANGE - 1,
}
#: Code points by their correct length in bytes: first, count, longer forms they have.
LENGTHS = ((0, 0x80, 3), (0x80, 0x780, 2), (0x800, 0xF800, 1))


# --- columns over text ---------------------------------------------------------------


def code_points(text: Column) -> Column:
    """The code points of a text as ARRAY<INT>; empty for empty or null text."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c))


def octets(text: Column) -> Column:
    """The UTF-8 bytes of a text as ARRAY<INT>."""
    digits = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return F.transform(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))


def octet_width(cp: Column) -> Column:
    """Bytes that UTF-8 takes for a code point."""
    return F.when(cp < 0x80, 1).when(cp < 0x800, 2).when(cp < 0x10000, 3).otherwise(4)


def character_number(cp: Column) -> Column:
    """The number of a character in the detailed alphabet: surrogates are skipped."""
    return F.when(cp < 0xD800, cp).otherwise(cp - SURROGATES)


def character_of(number: Column) -> Column:
    return F.when(number < 0xD800, number).otherwise(number + SURROGATES)


def utf8_hex(cp: Column) -> Column:
    """UTF-8 of a code point as hexadecimal digits, by shifts and masks."""

    def byte(value: Column) -> Column:
        return F.lpad(F.hex(value), 2, "0")

    def tail(shift: int) -> Column:
        return byte(F.shiftright(cp, shift).bitwiseAND(0x3F).bitwiseOR(0x80))

    return (
        F.when(cp < 0x80, byte(cp))
        .when(cp < 0x800, F.concat(byte(F.shiftright(cp, 6).bitwiseOR(0xC0)), tail(0)))
        .when(cp < 0x10000, F.concat(byte(F.shiftright(cp, 12).bitwiseOR(0xE0)), tail(6), tail(0)))
        .otherwise(F.concat(byte(F.shiftright(cp, 18).bitwiseOR(0xF0)), tail(12), tail(6), tail(0)))
    )


def simple_kind(number: Column) -> Column:
    return F.when(number < UNICODE, "char").when(number < SIMPLE_RANGE - 1, "illegal").otherwise("eof")


def simple_index(number: Column) -> Column:
    """Position within its kind: the code point, the byte less 0x80, or 0."""
    return F.when(number < UNICODE, number).when(number < SIMPLE_RANGE - 1, number - UNICODE).otherwise(F.lit(0))


def simple_number(kind: Column, cp: Column) -> Column:
    """Number from kind and code point (for illegal bytes: the byte)."""
    return F.when(kind == "char", cp).when(kind == "illegal", cp - 0x80 + UNICODE).otherwise(F.lit(SIMPLE_RANGE - 1))


def detailed_kind(number: Column) -> Column:
    names = list(FIRST)
    out = F.when(number < FIRST[names[1]], names[0])
    for name, after in zip(names[1:-1], names[2:], strict=True):
        out = out.when(number < FIRST[after], name)
    return out.otherwise("eof")


def _overlong_base(length: int) -> list[tuple[int, int, int]]:
    """(code point range start, end, offset) of overlong forms of ``length`` bytes."""
    rows, at = [], 0
    for correct, (first, count, forms) in enumerate(LENGTHS, 1):
        k = length - correct - 1
        if 0 <= k < forms:
            rows.append((first, first + count, at + k * count))
        at += forms * count
    return rows


def detailed_number(kind: Column, cp: Column, length: Column) -> Column:
    """Number from kind, code point (for illegal bytes: the byte) and length in bytes (overlong forms)."""
    overlong = F.lit(None).cast("int")
    for n in (2, 3, 4):
        for lo, hi, offset in _overlong_base(n):
            overlong = F.when((length == n) & (cp >= lo) & (cp < hi), cp - lo + offset + FIRST["overlong"]).otherwise(overlong)
    return (
        F.when(kind == "char", character_number(cp))
        .when(kind == "surrogate", cp - 0xD800 + FIRST["surrogate"])
        .when(kind == "overlong", overlong)
        .when(kind == "too_high", cp - UNICODE + FIRST["too_high"])
        .when(kind == "illegal", cp - 0x80 + FIRST["illegal"])
        .otherwise(F.lit(FIRST["eof"]))
    )


def detailed_parts(number: Column) -> Column:
    """struct(kind, cp, len) of a number; len is set for overlong forms only."""
    inner = number - FIRST["overlong"]
    cp, length, at = F.lit(0), F.lit(0), 0
    for correct, (first, count, forms) in enumerate(LENGTHS, 1):
        for k in range(forms):
            here = (inner >= at) & (inner < at + count)
            cp = F.when(here, inner - at + first).otherwise(cp)
            length = F.when(here, F.lit(correct + 1 + k)).otherwise(length)
            at += count
    kind = detailed_kind(number)
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "char", character_of(number))
        .when(kind == "surrogate", number - FIRST["surrogate"] + 0xD800)
        .when(kind == "overlong", cp)
        .when(kind == "too_high", number - FIRST["too_high"] + UNICODE)
        .when(kind == "illegal", number - FIRST["illegal"] + 0x80)
        .cast("int")
        .alias("cp"),
        F.when(kind == "overlong", length).cast("int").alias("len"),
    )


def token_text(kind: Column, cp: Column, length: Column) -> Column:
    """A token as text: characters as U+XXXX, others by name."""
    return (
        F.when(kind == "char", F.format_string("UnicodeCharacter(%X)", cp))
        .when(kind == "surrogate", F.format_string("SurrogateCodePoint(%X)", cp))
        .when(kind == "overlong", F.format_string("Overlong(%X, %d)", cp, length))
        .when(kind == "too_high", F.format_string("TooHigh(%X)", cp))
        .when(kind == "illegal", F.format_string("IllegalByte(%02X)", cp))
        .otherwise(F.lit("EOF"))
    )


def token_name(kind: str, cp: int | None = None, length: int | None = None) -> str:
    """The same for one token on the driver."""
    if kind == "overlong":
        return f"Overlong({cp:X}, {length})"
    form = {"char": "UnicodeCharacter({:X})", "surrogate": "SurrogateCodePoint({:X})", "too_high": "TooHigh({:X})", "illegal": "IllegalByte({:02X})"}
    return form[kind].format(cp) if kind in form else "EOF"


# --- bytes that may be malformed -----------------------------------------------------


def _sequence(data: bytes, at: int) -> tuple[int, int] | None:
    """(code point, length) of the well-formed sequence of 2 to 4 bytes at ``at``, of any range."""
    head = data[at]
    n = 2 if head >> 5 == 0b110 else 3 if head >> 4 == 0b1110 else 4 if head >> 3 == 0b11110 else 0
    if not n or at + n > len(data):
        return None
    cp = head & (0x7F >> n)
    for b in data[at + 1 : at + n]:
        if b >> 6 != 0b10:
            return None
        cp = cp << 6 | b & 0x3F
    return cp, n


def _correct_length(cp: int) -> int:
    return 1 if cp < 0x80 else 2 if cp < 0x800 else 3 if cp < 0x10000 else 4


def decode_detailed(data: bytes) -> list[tuple[str, int, int | None]]:
    """Bytes as (kind, code point or byte, length of an overlong form)."""
    out, at = [], 0
    while at < len(data):
        if data[at] < 0x80:
            out.append(("char", data[at], None))
            at += 1
            continue
        found = _sequence(data, at)
        if not found:
            out.append(("illegal", data[at], None))
            at += 1
            continue
        cp, n = found
        if n != _correct_length(cp):
            out.append(("overlong", cp, n))
        elif cp >= UNICODE:
            out.append(("too_high", cp, None))
        elif 0xD800 <= cp < 0xE000:
            out.append(("surrogate", cp, None))
        else:
            out.append(("char", cp, None))
        at += n
    return out


def decode_simple(data: bytes) -> list[tuple[str, int]]:
    """Bytes as (kind, code point or byte); forms out of range fall apart into illegal bytes."""
    out, at = [], 0
    while at < len(data):
        found = (data[at], 1) if data[at] < 0x80 else _sequence(data, at)
        if found and found[1] == _correct_length(found[0]) and found[0] < UNICODE:
            out.append(("char", found[0]))
            at += found[1]
        else:
            out.append(("illegal", data[at]))
            at += 1
    return out


def encode_code_point(cp: int, length: int | None = None) -> bytes:
    """UTF-8 of a code point in ``length`` bytes (default: the shortest form)."""
    n = length or _correct_length(cp)
    if n == 1:
        return bytes([cp])
    head = (0xF00 >> n) & 0xFF
    tail = [0x80 | cp >> 6 * i & 0x3F for i in range(n - 2, -1, -1)]
    return bytes([head | cp >> 6 * (n - 1), *tail])


def encode_tokens(tokens: list[tuple]) -> bytes:
    """The bytes of simple or detailed tokens."""
    out = bytearray()
    for kind, cp, *rest in tokens:
        if kind == "illegal":
            out.append(cp)
        elif kind != "eof":
            out += encode_code_point(cp, rest[0] if rest and rest[0] else None)
    return bytes(out)


def number_simple(kind: str, cp: int) -> int:
    return cp if kind == "char" else cp - 0x80 + UNICODE if kind == "illegal" else SIMPLE_RANGE - 1


def number_detailed(kind: str, cp: int, length: int | None = None) -> int:
    if kind == "char":
        return cp if cp < 0xD800 else cp - SURROGATES
    if kind == "overlong":
        return next(cp - lo + offset for lo, hi, offset in _overlong_base(length) if lo <= cp < hi) + FIRST["overlong"]
    start = {"surrogate": 0xD800, "too_high": UNICODE, "illegal": 0x80, "eof": cp or 0}[kind]
    return (cp or 0) - start + FIRST[kind]


TOKENS = "array<struct<kind:string,cp:int,len:int>>"


def decode_column(data: Column, detailed: bool = True) -> Column:
    """Tokens of a BINARY column."""

    @F.pandas_udf(TOKENS)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            rows = (decode_detailed(bytes(v or b"")) if detailed else [(k, c, None) for k, c in decode_simple(bytes(v or b""))] for v in values)
            yield pd.Series([[{"kind": k, "cp": c, "len": n} for k, c, n in r] for r in rows])

    return decode(data)


def recoded_column(data: Column) -> Column:
    """The bytes of the tokens of a BINARY column: one text's tokens are held at a time and none leave the worker."""

    @F.pandas_udf("binary")
    def recode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([encode_tokens(decode_detailed(bytes(v or b""))) for v in values], dtype="object")

    return recode(data)


def encode_column(tokens: Column) -> Column:
    """BINARY of a column of tokens."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([encode_tokens([(t["kind"], t["cp"], int(t["len"]) if t["len"] == t["len"] and t["len"] else None) for t in row]) for row in values])

    return encode(tokens)
