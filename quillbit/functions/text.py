"""Names, sizes and small notations as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_size(n: Column) -> Column:
    """Bytes with a binary unit and one decimal."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for unit, shift in (("GB", 40), ("MB", 30), ("KB", 20)):
        out = F.when(n < float(1 << shift), F.format_string(f"%.1f {unit}", n / float(1 << (shift - 10)))).otherwise(out)
    return F.when(n < 1024, F.format_string("%.1f B", n.cast("double"))).otherwise(out)


def human_time(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def file_safe(name: Column) -> Column:
    return F.replace(name, F.lit("/"), F.lit("_"))


def canonical_test(name: Column) -> Column:
    """``test:b=1:a=2`` with its settings in order."""
    parts = F.split(name, ":")
    return F.array_join(F.concat(F.slice(parts, 1, 1), F.array_sort(F.slice(parts, 2, F.size(parts)))), ":")


def hex_dump(data: Column) -> Column:
    """Bytes in hexadecimal, parted by spaces."""
    return F.array_join(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1)), " ")


def char_masses(literal: Column) -> Column:
    """``A:0.4,B:0.6`` as MAP<STRING, DOUBLE>."""
    return F.transform_values(F.str_to_map(literal, F.lit(","), F.lit(":")), lambda _, v: v.cast("double"))


def settings(literal: Column) -> Column:
    """``k=v:k=v`` as MAP<STRING, STRING>."""
    return F.str_to_map(literal, F.lit(":"), F.lit("="))
