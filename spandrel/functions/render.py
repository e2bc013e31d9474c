"""Cells as text, one form a type, whatever the session's settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .semantics import FLOATS, domain


def _float(c: Column) -> Column:
    text = c.cast("string")
    return F.when(F.isnan(c), "NaN").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf").otherwise(F.replace(text, F.lit("E"), F.lit("e")))


def _clock(text: Column) -> Column:
    """A fraction of a second has three, six or nine digits."""
    part = F.regexp_extract(text, r"\.(\d+)$", 1)
    digits = F.ceil(F.length(part) / 3) * 3
    return F.when(part == "", text).otherwise(F.concat(F.regexp_replace(text, r"\.\d+$", "."), F.rpad(part, digits.cast("int"), "0")))


def _timestamp(c: Column) -> Column:
    return _clock(F.replace(c.cast("string"), F.lit(" "), F.lit("T")))


def _utc(c: Column) -> Column:
    """A point in time as UTC, whatever the session's zone."""
    micros = F.unix_micros(c)
    day = F.floor(micros / F.lit(86_400_000_000).cast("decimal(20,0)")).cast("int")
    rest = F.pmod(micros, F.lit(86_400_000_000))
    part = lambda unit, most, digits: F.lpad(F.pmod(F.floor(rest / unit).cast("bigint"), F.lit(most)).cast("string"), digits, "0")
    clock = F.concat(part(3_600_000_000, 24, 2), F.lit(":"), part(60_000_000, 60, 2), F.lit(":"), part(1_000_000, 60, 2))
    fraction = F.lpad(F.pmod(rest, F.lit(1_000_000)).cast("string"), 6, "0")
    fraction = F.when(fraction == "000000", "").when(fraction.endswith("000"), F.concat(F.lit("."), F.left(fraction, F.lit(3)))).otherwise(F.concat(F.lit("."), fraction))
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), clock, fraction)


def _duration(c: Column) -> Column:
    minutes = (F.extract(F.lit("DAY"), c) * 24 + F.extract(F.lit("HOUR"), c)) * 60 + F.extract(F.lit("MINUTE"), c)
    micros = minutes.cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    size = F.abs(micros)
    part = F.pmod(size, F.lit(1_000_000))
    fraction = F.when(part == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(part.cast("string"), 6, "0"), F.lit("0"))))
    return F.concat(F.when(micros < 0, "-").otherwise(""), F.lit("PT"), F.floor(size / 1_000_000).cast("string"), fraction, F.lit("S"))


def rendered(c: Column, t: T.DataType, other: T.DataType | None = None, suffix: bool = True) -> Column:
    """``other``: the type on the other side; floats of two widths are shown as doubles. ``suffix``: name the zone or the kind of interval."""
    kind = domain(t)
    if isinstance(t, FLOATS):
        return _float(c.cast("double") if other is not None and isinstance(other, FLOATS) and type(other) is not type(t) else c)
    if kind == "binary":
        return F.lower(F.hex(c))
    if kind == "timestamp":
        return _timestamp(c)
    if kind == "timestamp with zone":
        shown = _utc(c)
        return F.concat(shown, F.lit("[UTC]")) if suffix else shown
    if kind == "time":
        return _clock(c.cast("string"))
    if kind == "duration":
        return _duration(c)
    if kind == "months":
        shown = c.cast("string")
        return F.concat(shown, F.lit("[YearMonth]")) if suffix else shown
    return c.cast("string")
