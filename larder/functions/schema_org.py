"""Values as recipe pages publish them: durations, yields, ratings and dates, given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.fmt import half_up

_N = r"(\d+(?:[.,]\d+)?)"
DURATION = rf"(?i)^-?P(?:{_N}Y)?(?:{_N}M)?(?:{_N}W)?(?:{_N}D)?(?:T(?:{_N}H)?(?:{_N}M)?(?:{_N}S)?)?$"
#: Minutes of each part of DURATION; years and months are 365 and 30 days.
PARTS = (365 * 1440, 30 * 1440, 7 * 1440, 1440, 60, 1, 1 / 60)
# Units of time in durations that are written out, and units of yields that say nothing of portions.
HOURS, MINUTES = ("h", "hr", "hrs", "hour", "hours"), ("m", "min", "mins", "minute", "minutes")
MEASURES = (
    "cup", "cups", "gallon", "gallons", "g", "gram", "grams", "kg", "lb", "lbs", "liter", "liters", "litre", "litres", "ml", "ounce", "ounces", "oz",
    "pint", "pints", "pound", "pounds", "quart", "quarts",
)


def _one_of(words: tuple[str, ...]) -> str:
    return "(" + "|".join(sorted(words, key=len, reverse=True)) + r")(?![A-Za-z0-9_])"


PHRASE = r"(?i)(\d+(?:\.\d+)?)\s*" + _one_of(HOURS + MINUTES)
MEASURED = r"(?i)(?<![A-Za-z0-9_])" + _one_of(MEASURES)


def _positive(x: Column) -> Column:
    return F.get(F.filter(F.array(half_up(x).try_cast("int")), lambda n: n > 0), F.lit(0))  # x is worked out once, inside lambdas too


def duration_minutes(text: Column) -> Column:
    """Whole minutes of an ISO duration, a bare number or words such as "1 hour 20 mins"; null for none, and for zero."""
    t = F.trim(text)
    parts = F.split(F.regexp_replace(t, DURATION, ";".join(f"${i + 1}" for i in range(len(PARTS)))), ";")  # matched once for all parts
    # an empty text is not cast: each failed cast costs an exception
    part = lambda x, minutes: F.coalesce(F.when(x != "", F.replace(x, F.lit(","), F.lit(".")).try_cast("double")), F.lit(0.0)) * minutes
    iso = F.aggregate(F.zip_with(parts, F.array(*(F.lit(float(m)) for m in PARTS)), part), F.lit(0.0), lambda a, x: a + x)
    number, unit = F.regexp_extract_all(t, F.lit(PHRASE), 1), F.regexp_extract_all(t, F.lit(PHRASE), 2)
    each = F.zip_with(number, unit, lambda n, u: n.try_cast("double") * F.when(F.lower(u).startswith("h"), 60).otherwise(1))
    words = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return _positive(F.when(t.startswith("-"), None).when(t.rlike(DURATION), iso).when(t.rlike(r"^\d+$"), t.try_cast("double")).otherwise(words))


def servings(text: Column) -> Column:
    """Portions of a yield: the low end of a range, else the first number; null for measured yields and without a number."""
    t = F.trim(text)
    low = F.regexp_extract(t, r"(\d+)\s*(?:-|–|—|to)\s*(\d+)", 1)
    return F.when(t.rlike(MEASURED), None).when(low != "", _positive(low.try_cast("double"))).otherwise(_positive(F.regexp_extract(t, r"(\d+(?:\.\d+)?)", 1).try_cast("double")))


def first_of(values: Column, f) -> Column:
    """The first value that f makes of an array's elements."""
    return F.get(F.array_compact(F.transform(values, f)), F.lit(0))


def number(text: Column) -> Column:
    """The number that a text begins with, thousands separators left out."""
    return F.regexp_extract(F.replace(F.trim(text), F.lit(","), F.lit("")), r"^[+-]?\d*\.?\d+", 0).try_cast("double")


def rating(value: Column, count: Column) -> Column:
    """value over 0 up to 5 and count; null if there is neither, or the count is zero without a value."""
    v, n = number(value), number(count)
    v, n = F.when((v > 0) & (v <= 5), v), F.when(n >= 0, half_up(n).try_cast("int"))
    return F.when(v.isNotNull() | (F.coalesce(n, F.lit(0)) > 0), F.struct(v.cast("float").alias("value"), n.alias("count")))


def published(text: Column) -> Column:
    """A date or time of the years 1990 to 2100 in UTC: ISO, or as in mail headers; else null."""
    return F.get(F.filter(F.transform(F.array(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9}, ", "")), _time), lambda at: F.year(at).between(1990, 2100)), F.lit(0))


def _time(t: Column) -> Column:
    mail = F.regexp_replace(F.regexp_replace(t, r"(?i) (GMT|UT|UTC|Z)$", " +0000"), r"^(\d) ", "0$1 ")
    return F.coalesce(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-"), t)), F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("dd MMM yyyy HH:mm Z")))
