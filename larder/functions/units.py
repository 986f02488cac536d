"""Units of shopping quantities: normal form, dimension and conversion."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Grams or millilitres of a unit; count units stand for themselves.
MASS = {"mg": 0.001, "g": 1.0, "kg": 1000.0, "oz": 28.349523125, "lb": 453.59237}
VOLUME = {"ml": 1.0, "l": 1000.0, "tsp": 4.92892159375, "tbsp": 14.78676478125, "fl oz": 29.5735295625, "cup": 236.5882365, "quart": 946.352946, "gallon": 3785.411784}
COUNT = ("each", "can", "bunch", "stalk", "slice", "head", "inch", "clove", "pint")

# Spellings whose case decides, then spellings in lower case, by unit.
CASED = {"tbsp": ("T", "Tb", "Tbs", "Tbsp"), "tsp": ("t",), "cup": ("C",)}
SPELLINGS = {
    "mg": ("mg", "milligram", "milligrams"),
    "g": ("g", "gr", "gram", "grams", "gramme", "grammes"),
    "kg": ("kg", "kilo", "kilos", "kilogram", "kilograms"),
    "oz": ("oz", "ozs", "ounce", "ounces"),
    "lb": ("lb", "lbs", "pound", "pounds"),
    "ml": ("ml", "milliliter", "milliliters", "millilitre", "millilitres", "cc"),
    "l": ("l", "liter", "liters", "litre", "litres"),
    "tsp": ("tsp", "tsps", "teaspoon", "teaspoons"),
    "tbsp": ("tbsp", "tbsps", "tbs", "tb", "tablespoon", "tablespoons"),
    "fl oz": ("fl oz", "floz", "fluid ounce", "fluid ounces"),
    "cup": ("cup", "cups"),
    "quart": ("quart", "quarts", "qt", "qts"),
    "gallon": ("gallon", "gallons", "gal"),
    "each": ("", "each", "ea", "whole", "piece", "pieces", "pc", "pcs"),
    "can": ("can", "cans", "tin", "tins"),
    "bunch": ("bunch", "bunches"),
    "stalk": ("stalk", "stalks", "rib", "ribs"),
    "slice": ("slice", "slices"),
    "head": ("head", "heads"),
    "inch": ("inch", "inches", '"'),
    "clove": ("clove", "cloves"),
    "pint": ("pint", "pints", "pt"),
}

DIMENSION = {**dict.fromkeys(MASS, "mass"), **dict.fromkeys(VOLUME, "volume"), **dict.fromkeys(COUNT, "count")}
FACTOR = {**MASS, **VOLUME, **dict.fromkeys(COUNT, 1.0)}


def lookup(table: dict, key: Column) -> Column:
    """table[key] as a literal map; null where the key is not there."""
    return F.element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def normalize_unit(unit: Column) -> Column:
    """The unit that a spelling stands for: null is "each", an unknown spelling null. T and t differ."""
    return F.when(unit.isNull(), F.lit("each")).otherwise(_by_spelling(unit, lambda canonical: canonical))


def _by_spelling(unit: Column, value) -> Column:
    """value of the unit that a spelling stands for, looked up in one table by the spelling as it is, else by its normal form; null for unknown ones."""
    trimmed = F.regexp_replace(unit, r"^[\s ﻿]+|[\s ﻿]+$", "")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(trimmed), r"\.+$", ""), r"[\s ]+", " "))
    cased, plain = ({s: value(u) for u, all_of in table.items() for s in all_of} for table in (CASED, SPELLINGS))
    return F.coalesce(lookup(plain | cased, unit), lookup(cased, trimmed), lookup(plain, key))


def dimension(canonical: Column) -> Column:
    return lookup(DIMENSION, canonical)


def convert(qty: Column, unit: Column, to: Column) -> Column:
    """qty of a canonical unit in another: itself for the same unit, null across dimensions or count units."""
    same = (dimension(unit) == dimension(to)) & (dimension(unit) != "count")
    return F.when(unit == to, qty.cast("double")).when(same, qty.cast("double") * lookup(FACTOR, unit) / lookup(FACTOR, to))


def to_base(qty: Column, unit: Column) -> Column:
    """qty and unit in grams, millilitres or the count unit itself; null for unknown spellings."""
    base = {"mass": "g", "volume": "ml"}
    known = lambda u: F.struct(F.lit(FACTOR[u]).alias("factor"), F.lit(base.get(DIMENSION[u], u)).alias("unit"), F.lit(DIMENSION[u]).alias("dimension"))
    found = F.when(qty.isNotNull(), _by_spelling(F.coalesce(unit, F.lit("each")), known))
    made = lambda x: F.struct((qty.cast("double") * x["factor"]).alias("qty"), x["unit"].alias("unit"), x["dimension"].alias("dimension"))
    return F.get(F.transform(F.array_compact(F.array(found)), made), F.lit(0))  # the spelling is looked up once for all three


def dimension_key(unit: Column) -> Column:
    """What may merge: "mass", "volume", "count:<unit>", or "unit:<slug>" for an unknown spelling."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(unit)), "[^a-z0-9]+", "-"), "^$", "unknown")
    known = _by_spelling(unit, lambda canonical: f"count:{canonical}" if DIMENSION[canonical] == "count" else DIMENSION[canonical])
    return F.when(unit.isNull(), "count:each").otherwise(F.coalesce(known, F.concat(F.lit("unit:"), slug)))
