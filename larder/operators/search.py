"""Dish search: a closed filter object becomes predicates, a match count and an order, and relaxes when nothing is found.

Dishes have dish_id, total_minutes, active_minutes, servings, keeps_days, freezer_months, category and tags; lines have
dish_id and name (of the ingredient, null where it is not mapped). Requirements drop nulls, exclusions keep them.
Ingredient questions are one aggregate over the lines per search, joined to the dishes, not a subquery per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.stem import lexemes, query_lexemes
from larder.vocab import CATEGORIES, LIMIT_DEFAULT, LIMIT_MAX, NEUTRAL_SCORE, RELAXATION_ROUNDS, TAGS, WIDEN


@dataclass(frozen=True)
class Filter:
    """What a search asks for; None and empty ask for nothing."""

    max_minutes: int | None = None
    min_minutes: int | None = None
    max_active_minutes: int | None = None
    min_servings: int | None = None
    min_keeps_days: int | None = None
    freezer_only: bool = False
    categories: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    any_tags: tuple[str, ...] = ()
    exclude_categories: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    ingredients: tuple[str, ...] = ()
    any_ingredients: tuple[str, ...] = ()
    exclude_ingredients: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, (list, tuple)):
                words = [v.strip() for v in value]
                if "tags" in f.name or "categories" in f.name:
                    if bad := set(words) - set(TAGS if "tags" in f.name else CATEGORIES):
                        raise ValueError(f"{f.name}: {sorted(bad)}")
                else:
                    words = [v.lower() for v in words]
                    most = 6 if f.name == "terms" else 10
                    if len(words) > most or any(not 0 < len(v) <= 60 for v in words):
                        raise ValueError(f"{f.name}: at most {most} of 1 to 60 characters")
                object.__setattr__(self, f.name, tuple(dict.fromkeys(words)))
            elif value is not None and not isinstance(value, bool) and not 0 < value <= 20160:
                raise ValueError(f"{f.name}: {value}")

    @property
    def empty(self) -> bool:
        return self == Filter()


@dataclass(frozen=True)
class Criterion:
    key: str
    clause: Column = field(compare=False)


def _all_of(tags: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0


def _any_of(tags: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, tags))), F.lit(False))


def criteria(f: Filter, column: str = "lexemes", stem=query_lexemes) -> list[Criterion]:
    """The filter's criteria in a fixed order. Ingredient clauses read the column ingredient_names, see with_names.

    A term matches when it has lexemes and all of them are in the column of lexemes; stem turns a term into lexemes.
    """
    c, out = F.col, []
    for key, clause in (
        ("max_minutes", c("total_minutes") <= f.max_minutes if f.max_minutes is not None else None),
        ("min_minutes", c("total_minutes") >= f.min_minutes if f.min_minutes is not None else None),
        ("max_active_minutes", c("active_minutes") <= f.max_active_minutes if f.max_active_minutes is not None else None),
        ("min_servings", c("servings") >= f.min_servings if f.min_servings is not None else None),
        ("min_keeps_days", c("keeps_days") >= f.min_keeps_days if f.min_keeps_days is not None else None),
        ("freezer_only", c("freezer_months") > 0 if f.freezer_only else None),
        ("categories", c("category").isin(*f.categories) if f.categories else None),
        ("tags", _all_of(f.tags) if f.tags else None),
        ("any_tags", _any_of(f.any_tags) if f.any_tags else None),
        ("exclude_categories", c("category").isNull() | ~c("category").isin(*f.exclude_categories) if f.exclude_categories else None),
        ("exclude_tags", ~_any_of(f.exclude_tags) if f.exclude_tags else None),
        ("ingredients", F.size(F.array_intersect("ingredient_names", F.array(*map(F.lit, f.ingredients)))) == len(f.ingredients) if f.ingredients else None),
        ("any_ingredients", F.arrays_overlap("ingredient_names", F.array(*map(F.lit, f.any_ingredients))) if f.any_ingredients else None),
        ("exclude_ingredients", ~F.arrays_overlap("ingredient_names", F.array(*map(F.lit, f.exclude_ingredients))) if f.exclude_ingredients else None),
    ):
        if clause is not None:
            out.append(Criterion(key, clause))
    for term in f.terms:
        out.append(Criterion(f"term:{term}", _all_lexemes(stem(term), column)))
    return out


def with_lexemes(dishes: DataFrame) -> DataFrame:
    """dishes with lexemes, the stems of title and blurb, which terms are looked up in. Where dishes are stored, store it with them."""
    return dishes.withColumn("lexemes", lexemes(F.concat_ws(" ", "title", "blurb")))


def _all_lexemes(words: Sequence[str], column: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, words)), F.col(column))) == 0 if words else F.lit(False)


def with_names(dishes: DataFrame, lines: DataFrame, f: Filter) -> DataFrame:
    """dishes with ingredient_names: those of the filter's ingredients that are among the dish's lines, in lower case."""
    asked = [*f.ingredients, *f.any_ingredients, *f.exclude_ingredients]
    if not asked:
        return dishes
    name = F.lower("name")
    found = lines.where(name.isin(*asked)).groupBy("dish_id").agg(F.collect_set(name).alias("ingredient_names"))  # the asked names at most
    return dishes.join(found, "dish_id", "left").withColumn("ingredient_names", F.coalesce("ingredient_names", F.array().cast("array<string>")))


def where(found: list[Criterion], terms: str = "all") -> Column:
    """All structured criteria, and all or any of the terms."""
    clauses = [c.clause for c in found if not c.key.startswith("term:")]
    words = [c.clause for c in found if c.key.startswith("term:")]
    if words:
        clauses.append(reduce(and_ if terms == "all" else or_, words))
    return reduce(and_, clauses, F.lit(True))


def match_count(found: list[Criterion]) -> Column:
    """How many criteria a row meets; a null is a miss."""
    return reduce(lambda a, b: a + b, (F.coalesce(c.clause, F.lit(False)).cast("int") for c in found), F.lit(0))


# What is relaxed first; ingredients and exclusions never are.
LADDER = (("min_keeps_days", "freezer_only", "min_servings"), ("any_tags",), ("max_minutes", "min_minutes", "max_active_minutes"), ("tags",), ("categories",))


def relax(f: Filter, rung: Sequence[str]) -> tuple[Filter, list[tuple]]:
    """The filter after one rung, and what was widened or dropped. Times widen by half, everything else goes."""
    changed, told = {}, []
    for name in rung:
        value = getattr(f, name)
        if value in (None, False, ()):
            continue
        if name.startswith("max"):
            changed[name] = math.ceil(value * WIDEN)
        elif name == "min_minutes":
            changed[name] = max(1, math.floor(value / WIDEN))
        else:
            changed[name] = {tuple: (), bool: False}.get(type(value))
        told.append((name, "widened", value, changed[name]) if "minutes" in name else (name, "dropped"))
    return replace(f, **changed), told


def attempts(f: Filter) -> list[tuple[Filter, str, list[tuple]]]:
    """What a search tries one after the other, each wider than the one before: filter, how terms combine, what was relaxed."""
    out = [(f, "all", [])]
    if f.empty:
        return out
    if len(f.terms) > 1:
        out.append((f, "any", []))
    g, told, rounds = f, [], 0
    for rung in LADDER:
        g, now = relax(g, rung)
        if now and rounds < RELAXATION_ROUNDS:
            rounds, told = rounds + 1, told + now
            out.append((g, out[-1][1], told))
    return out


def clamp_limit(limit: int | None) -> int:
    return LIMIT_DEFAULT if limit is None else max(1, min(LIMIT_MAX, int(limit)))


def browse_order() -> list[Column]:
    """Score, date, source rating, id; every key is never null."""
    return [
        F.coalesce("score", F.lit(float(NEUTRAL_SCORE)).cast("float")).desc(),
        F.coalesce("published_at", "first_seen_at").desc(),
        F.coalesce("source_rating", F.lit(0.0)).desc(),
        F.col("dish_id").desc(),
    ]


def ranked(dishes: DataFrame, wanted: list[Criterion], clause: Column, order: list[Column], limit: int | None) -> DataFrame:
    """Rows that meet clause with their match_count, best first (a top-k, not a full sort)."""
    return dishes.where(clause).withColumn("match_count", match_count(wanted)).orderBy(F.col("match_count").desc(), *order).limit(clamp_limit(limit))


@dataclass
class Answer:
    rows: DataFrame
    relaxations: list[tuple]
    terms_union: bool
    filter: Filter  # as it was searched in the end


def search(dishes: DataFrame, lines: DataFrame, f: Filter, order: list[Column] | None = None, limit: int | None = None, stem=query_lexemes) -> Answer:
    """Search, then widen: any term instead of all, then up to two used rungs of the ladder until a dish is found.

    Rows are counted against the filter as it was asked, whatever has been relaxed. An empty filter is not relaxed.
    """
    base, order = with_names(dishes, lines, f), order or browse_order()
    asked = criteria(f, stem=stem)
    for g, terms, told in attempts(f):
        rows = ranked(base, asked, where(criteria(g, stem=stem), terms), order, limit)
        if not rows.isEmpty():
            break
    return Answer(rows, told, terms == "any", g)
