"""Scalar functions: wide numbers, decimals, symbols, calendar and world time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOL = "^[a-z][a-z0-9_]*$"
NANOSECONDS_PER_DAY = 86_400_000_000_000


def is_symbol(c: Column) -> Column:
    return F.coalesce(c.rlike(SYMBOL), F.lit(False))


def utf8_length(c: Column) -> Column:
    return F.octet_length(c)


def canonically_equal(kind_a: Column, canon_a: Column, kind_b: Column, canon_b: Column) -> Column:
    """Values are equal if both kind and canonical form are; different kinds never are."""
    return (kind_a == kind_b) & (canon_a == canon_b)


def decimal_canonical(text: Column) -> Column:
    """Plain decimal notation -> canonical text; null if it isn't one.  Zeros at the end of the fraction go, zero has no sign."""
    trimmed = F.trim(text)
    sign, whole, fraction = (F.regexp_extract(trimmed, r"^(-?)(\d+)(?:\.(\d+))?$", k) for k in (1, 2, 3))
    whole = F.regexp_replace(whole, r"^0+(?=\d)", "")
    fraction = F.regexp_replace(fraction, "0+$", "")
    zero = (whole == "0") & (fraction == "")
    out = F.concat(F.when(zero, F.lit("")).otherwise(sign), whole, F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)))
    return F.when(trimmed.rlike(r"^-?\d+(\.\d+)?$"), out)


def decimal_key(canonical: Column, digits: int = 40) -> Column:
    """Text that sorts as canonical decimals do, exactly, for up to ``digits`` digits before and after the point."""
    negative = F.startswith(canonical, F.lit("-"))
    parts = F.split(F.regexp_replace(canonical, "^-", ""), r"\.")
    whole = F.lpad(F.element_at(parts, 1), digits, "0")
    fraction = F.rpad(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), digits, "0")
    plain = F.concat(whole, fraction)
    return F.when(negative, F.concat(F.lit("0"), F.translate(plain, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), plain))


def wide_integer_key(text: Column, digits: int = 40) -> Column:
    """The same for integers beyond 38 digits, such as the extremes of 128 bits."""
    return decimal_key(decimal_canonical(text), digits)


def varint(value: Column) -> Column:
    """Unsigned base-128 encoding of a non-negative long, as hexadecimal text, low group first."""
    groups = F.sequence(F.lit(0), F.lit(8))
    # every group of seven bits up to the last that isn't zero, the first always
    used = F.filter(groups, lambda k: (k == 0) | (F.call_function("shiftrightunsigned", value, (k * 7).cast("int")) > 0))
    encoded = F.transform(used, lambda k: F.lpad(F.hex(F.call_function("shiftrightunsigned", value, (k * 7).cast("int")).bitwiseAND(127) + F.when(k < F.size(used) - 1, 128).otherwise(0)), 2, "0"))
    return F.lower(F.array_join(encoded, ""))


def world_nanoseconds(ticks: Column, per_tick: Column) -> Column:
    """Ticks of a unit in nanoseconds; null if they don't fit."""
    return F.try_multiply(ticks.cast("long"), per_tick.cast("long"))


def add_duration(t: Column, nanoseconds: Column) -> Column:
    return F.try_add(t, nanoseconds)


def compare_on_timeline(timeline_a: Column, a: Column, timeline_b: Column, b: Column) -> Column:
    """-1, 0 or 1 on one timeline; null across timelines, which have no common order."""
    return F.when(timeline_a == timeline_b, F.when(a < b, -1).when(a > b, 1).otherwise(0))


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    return F.datediff(F.make_date(year, month, day), F.lit("1970-01-01").cast("date"))


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def calendar_shift(date: Column, years: int, months: int, days: int) -> Column:
    """Years, then months, each with the day clamped to the month's end, then days."""
    return F.date_add(F.add_months(F.add_months(date, F.lit(12 * years)), F.lit(months)), F.lit(days))


def shift_nanoseconds(t: Column, years: int, months: int, days: int) -> Column:
    """calendar_shift of a world time; the time of day stays."""
    day = F.floor(t / F.lit(NANOSECONDS_PER_DAY).cast("decimal(20,0)")).cast("long")
    rest = t - day * F.lit(NANOSECONDS_PER_DAY)
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    return F.datediff(calendar_shift(date, years, months, days), F.lit("1970-01-01").cast("date")).cast("long") * F.lit(NANOSECONDS_PER_DAY) + rest


def urlsafe(binary: Column) -> Column:
    """Base64 for URLs, without padding and in one line, whatever the length."""
    return F.rtrim(F.translate(F.base64(binary), "+/\r\n", "-_"), F.lit("="))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over columns, each with its length before it; null is told from empty."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *parts), 256)
