"""Printed quantities, times and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.units import COUNT, lookup

# Fractions that print as a glyph when the remainder is within 0.02 of them, tried in this order.
GLYPHS = ((0.125, "⅛"), (0.25, "¼"), (1 / 3, "⅓"), (0.5, "½"), (2 / 3, "⅔"), (0.75, "¾"))
PLURALS = {u: "inches" if u == "inch" else f"{u}es" if u.endswith("ch") else f"{u}s" for u in COUNT if u != "each"}


def half_up(x: Column, places: int = 0) -> Column:
    """Round halves towards positive infinity."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def number_text(x: Column, places: int) -> Column:
    """x with at most so many decimals and no trailing zeros; null for null."""
    text = F.format_string(f"%.{places}f", half_up(x, places))
    return F.when(x.isNotNull(), F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def fmt_qty(qty: Column) -> Column:
    """A quantity as cooks write it: 1½, ⅓, 2, 0.9."""
    whole = F.floor(qty + 1e-9)
    rest = half_up(qty - whole, 3)
    lead = F.when(whole > 0, whole.cast("string")).otherwise("")
    out = F.when(F.abs(rest - GLYPHS[0][0]) <= 0.02, F.concat(lead, F.lit(GLYPHS[0][1])))
    for value, glyph in GLYPHS[1:]:
        out = out.when(F.abs(rest - value) <= 0.02, F.concat(lead, F.lit(glyph)))
    near = half_up(qty)
    return out.when(F.abs(qty - near) < 0.01, near.cast("long").cast("string")).otherwise(number_text(qty, 2))


def fmt_line(qty: Column, unit: Column) -> Column:
    """Quantity and unit: "each" bare, count units in the plural above one, unknown units as they are."""
    plural = F.when((qty > 1) & lookup(PLURALS, unit).isNotNull(), lookup(PLURALS, unit)).otherwise(unit)
    return F.when(unit.isNull() | (unit == "each") | (unit == ""), fmt_qty(qty)).otherwise(F.concat_ws(" ", fmt_qty(qty), plural))


def fmt_time(minutes: Column) -> Column:
    """"45 min", and from two hours on rounded hours; null gives an empty text."""
    text = F.when(minutes >= 120, F.concat(half_up(minutes / 60).cast("long").cast("string"), F.lit(" hr"))).otherwise(F.concat(half_up(minutes.cast("double")).cast("long").cast("string"), F.lit(" min")))
    return F.coalesce(text, F.lit(""))


def _counted(n: Column, one: str, many: str) -> Column:
    return F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many)))


def fmt_keeps(days: Column, months: Column) -> Column:
    """"4 days · 3 months frozen", of which either half may be missing."""
    return F.concat_ws(" · ", _counted(days, "day", "days"), _counted(months, "month frozen", "months frozen"))


def fmt_rating(rating: Column, count: Column) -> Column:
    """"4.8★ (24 reviews)"; without a rating over zero an empty text."""
    stars = F.concat(number_text(rating.cast("double"), 1), F.lit("★"))
    return F.coalesce(F.when(rating > 0, F.concat_ws(" ", stars, F.concat(F.lit("("), _counted(count, "review", "reviews"), F.lit(")")))), F.lit(""))


def fmt_cost(cost: Column) -> Column:
    return F.when(cost == 0, "$0").otherwise(F.format_string("$%.4f", cost.cast("double")))


def fmt_duration(started: Column, finished: Column) -> Column:
    """"42s", "3m 5s", or "In progress"."""
    seconds = F.greatest(F.lit(0), half_up((F.unix_micros(finished) - F.unix_micros(started)) / 1e6)).cast("long")
    long = F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60)
    return F.when(finished.isNull(), "In progress").when(seconds < 60, F.format_string("%ds", seconds)).otherwise(long)


def alias_key(name: Column) -> Column:
    """Trimmed, lower-case, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
