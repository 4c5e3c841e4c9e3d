"""Scalar transforms of text, numbers and timestamps as plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for booleans.
TRUE_WORDS = ("true", "yes", "1", "y")
FALSE_WORDS = ("false", "no", "0", "n")


def convert(c: Column, source: str, target: str, strict: bool = True) -> Column:
    """Value of another type. ``strict`` raises where a value does not convert, else it is null."""
    numeric = source in ("tinyint", "smallint", "int", "bigint", "float", "double") or source.startswith("decimal")
    if source == target:
        return c
    if target == "boolean":
        word = F.lower(F.trim(c.cast("string")))
        if numeric:
            out = c != 0
        else:
            out = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    elif target == "string":
        out = c.cast("string")
    elif source == "boolean":
        out = c.cast("int").cast(target)
    else:
        out = c.try_cast(target)
    if not strict:
        return out
    failed = F.raise_error(F.concat(F.lit(f"cannot convert to {target}: "), c.cast("string")))
    return F.when(c.isNotNull() & out.isNull(), failed.cast(target)).otherwise(out)


def substring_bytes(c: Column, start: int, length: int) -> Column:
    """Bytes ``start`` to ``start + length``; past the end is an error."""
    past = F.octet_length(c) < start + length
    piece = F.decode(F.substring(F.encode(c, "UTF-8"), start + 1, length), "UTF-8")
    return F.when(past, F.raise_error(F.lit("substring past the end")).cast("string")).otherwise(piece)


TEXT = {
    "upper": lambda c: F.upper(c),
    "lower": lambda c: F.lower(c),
    "trim": lambda c: F.trim(c),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)),
    "substring": substring_bytes,
}


def divide(c: Column, by: float) -> Column:
    if by == 0:
        return F.raise_error(F.lit("division by zero")).cast("double")
    return c / by


NUMBER = {
    "multiply": lambda c, x: c * x,
    "divide": divide,
    "add": lambda c, x: c + x,
    "subtract": lambda c, x: c - x,
    "power": lambda c, x: F.pow(c, F.lit(x)),
    "abs": lambda c: F.abs(c),
    "round": lambda c: F.round(c, 0),  # half away from zero
    "floor": lambda c: F.floor(c).cast("double"),
    "ceil": lambda c: F.ceil(c).cast("double"),
}


def shift_time(c: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    return c + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds).cast("decimal(18,6)"))


TIME = {
    "add_days": lambda c, n: shift_time(c, days=n),
    "add_hours": lambda c, n: shift_time(c, hours=n),
    "add_minutes": lambda c, n: shift_time(c, minutes=n),
    "add_seconds": lambda c, n: shift_time(c, seconds=n),
    "start_of_day": lambda c: F.date_trunc("day", c),
    "end_of_day": lambda c: shift_time(F.date_trunc("day", c), seconds=86_399),
    "format": lambda c, pattern: F.date_format(c, pattern),
}


def signed_log(c: Column, eps: float = 1e-8) -> Column:
    return F.signum(c) * F.log(F.abs(c) + eps)


def scaled_int(c: Column, factor: float) -> Column:
    """Scaled, then truncated towards zero."""
    return (c * factor).cast("bigint")


def clean_text(c: Column) -> Column:
    """Trimmed, without control characters but newline and tab, without a byte-order mark, with \\n line ends."""
    unix = F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n?", "\n")
    return F.trim(F.regexp_replace(unix, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
