"""Fixed inputs of queries and tests."""

from __future__ import annotations

#: First code point that needs so many bytes, and the end of the range.
FIRST_OF = {1: 0, 2: 0x80, 3: 0x800, 4: 0x10000}
END_OF = {1: 0x80, 2: 0x800, 3: 0x10000, 4: 0x200000}
UNICODE, SURROGATES = 0x110000, range(0xD800, 0xE000)


def _form(cp: int, n: int) -> bytes:
    """A code point in ``n`` bytes by the bit pattern of UTF-8, whether that is well-formed or not."""
    if n == 1:
        return bytes([cp])
    payload = [cp >> 6 * i & 0x3F for i in range(n - 1)]
    return bytes([0xFF << (8 - n) & 0xFF | cp >> 6 * (n - 1), *(0x80 | p for p in reversed(payload))])


def _illegal(data: bytes) -> str:
    return " ".join(f"IllegalByte({b:02X})" for b in data)


def boundary_cases() -> list[tuple[str, str, str]]:
    """(hexadecimal bytes, detailed tokens, simple tokens) at the borders of every range of UTF-8, and beside them."""
    out = []
    for n in FIRST_OF:
        for cp in sorted({FIRST_OF[n], FIRST_OF[n] + 1, END_OF[n] - 1, *(c for c in (SURROGATES.start - 1, SURROGATES.start, SURROGATES.stop - 1, SURROGATES.stop) if n == 3), *(c for c in (UNICODE - 1, UNICODE) if n == 4)}):
            form = _form(cp, n)
            if cp in SURROGATES:
                out.append((form, f"SurrogateCodePoint({cp:X})", f"UnicodeCharacter({cp:X})"))
            elif cp >= UNICODE:
                out.append((form, f"TooHigh({cp:X})", _illegal(form)))
            else:
                out.append((form, f"UnicodeCharacter({cp:X})", f"UnicodeCharacter({cp:X})"))
            if n > 1:  # cut short
                out += [(form[:k], _illegal(form[:k]), _illegal(form[:k])) for k in range(1, n)]
                out.append((form[:-1] + b" ", _illegal(form[:-1]) + " UnicodeCharacter(20)", _illegal(form[:-1]) + " UnicodeCharacter(20)"))
        for cp in {0, 0x2F, FIRST_OF[n] - 1} if n > 1 else ():  # longer than needed
            out.append((_form(cp, n), f"Overlong({cp:X}, {n})", _illegal(_form(cp, n))))
    for head in (*range(0x80, 0x84), 0xBF, *range(0xF8, 0x100)):  # never a head
        out.append((bytes([head]), _illegal(bytes([head])), _illegal(bytes([head]))))
    seen: dict[str, tuple[str, str, str]] = {}
    for data, detailed, simple in out:
        seen.setdefault(data.hex().upper(), (data.hex().upper(), detailed, simple))
    return list(seen.values())


MALFORMED = boundary_cases()


#: Tuned PPM parameters: depth, strength, discount, mean bits for each byte (fixed values and made-up neighbours).
PARAMETERS = {
    "byte": [(5, 0.09, 0.41, 2.0301), (6, 0.0953510, 0.4089775, 2.016363), (7, 0.1, 0.4, 2.0211)],
    "token": [(5, 0.0009072, 0.5132845, 1.950732), (6, 0.001, 0.51, 1.950732), (7, 0.002, 0.5, 1.9703)],
}


def tuned_rows() -> list[dict]:
    """The tuned parameters as rows (prior, depth, alpha, beta, mean_efficiency)."""
    names = {"byte": "uniform_byte", "token": "uniform_token"}
    return [dict(zip(("prior", "depth", "alpha", "beta", "mean_efficiency"), (names[n], *row), strict=True)) for n, rows in PARAMETERS.items() for row in rows]
