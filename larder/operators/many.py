"""Many searches in one pass: filters as rows, each dish read once, and for each search the dishes of its lowest rung.

The rungs of a search are its attempts, each wider than the one before. A dish that passes one passes all after it, so
the answer to a search is the best of its dishes by (rung, match count, order), as far as their rung is the least of all.
That key merges: a batch of dishes keeps its best few for each search, and one window puts the batches' together.

Within a batch every criterion is a bitmap over the batch's dishes. Criteria are shared by searches, and ingredients and
terms look theirs up in the batch's postings, so a search costs a few ANDs over bitmaps. Searches that ask the same are
answered once. Each MOST that differ are sent to all tasks and take a pass; searches, dishes and lines may be any number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.stem import query_lexemes
from larder.operators.search import Filter, attempts, clamp_limit
from larder.plans.shared import written
from larder.vocab import CATEGORIES, NEUTRAL_SCORE, TAGS

#: Different searches that one pass takes, about.
MOST = 100_000

_FIELDS = tuple(f.name for f in fields(Filter))
_BOUNDS = {"max_minutes": ("total_minutes", np.less_equal), "min_minutes": ("total_minutes", np.greater_equal), "max_active_minutes": ("active_minutes", np.less_equal), "min_servings": ("servings", np.greater_equal), "min_keeps_days": ("keeps_days", np.greater_equal)}
_NUMBERS = ("total_minutes", "active_minutes", "servings", "keeps_days", "freezer_months")
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}


def filter_of(row: dict) -> Filter:
    """A row's filter; null fields ask for nothing."""
    return Filter(**{k: v for k, v in row.items() if k in _FIELDS and v is not None})


def _criteria(f: Filter, stem) -> list[tuple[str, object]]:
    """Kind and value of each criterion, terms last."""
    out = [(n, getattr(f, n)) for n in _FIELDS if n != "terms" and getattr(f, n) not in (None, False, ())]
    return out + [("term", tuple(stem(t))) for t in f.terms]


class Batch:
    """Dishes of a batch, best first, and the bitmaps of criteria over them."""

    def __init__(self, columns: dict[str, pa.Array]):
        self.n = len(columns["dish_id"])
        self.numbers = {c: columns[c].cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in _NUMBERS}
        self.category = columns["category"].to_numpy(zero_copy_only=False)
        self.tags = np.array([sum(_TAG_BIT.get(t, 0) for t in set(ts or ())) for ts in columns["tags"].to_pylist()], np.int64)
        self.postings = {"name": self._postings(columns["names"]), "lexeme": self._postings(columns["lexemes"])}
        self.known: dict[tuple[str, object], np.ndarray] = {}

    @staticmethod
    def _postings(lists: pa.Array) -> dict[str, np.ndarray]:
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        order = np.argsort(codes := coded.indices.to_numpy(), kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        return {w: owner[order[a:b]] for w, a, b in zip(coded.dictionary.to_pylist(), cuts, cuts[1:], strict=False)}

    def holds(self, kind: str, word: str) -> np.ndarray:
        key = (kind, word)
        if key not in self.known:
            bits = np.zeros(self.n, bool)
            bits[self.postings[kind].get(word, [])] = True
            self.known[key] = bits
        return self.known[key]

    def bitmap(self, kind: str, value) -> np.ndarray:
        if (kind, value) not in self.known:
            self.known[kind, value] = self._bitmap(kind, value)
        return self.known[kind, value]

    def _bitmap(self, kind: str, value) -> np.ndarray:
        every = lambda k: reduce(np.logical_and, (self.holds(k, w) for w in value), np.ones(self.n, bool))
        some = lambda k: reduce(np.logical_or, (self.holds(k, w) for w in value), np.zeros(self.n, bool))
        mask = sum(_TAG_BIT[t] for t in value) if "tags" in kind else 0
        if kind in _BOUNDS:
            column, compare = _BOUNDS[kind]
            return compare(self.numbers[column], value)  # a null is not a number, and compares to nothing
        if kind == "freezer_only":
            return self.numbers["freezer_months"] > 0
        if kind in ("categories", "exclude_categories"):
            return np.isin(self.category, value) ^ (kind == "exclude_categories")
        if kind == "tags":
            return self.tags & mask == mask
        if kind in ("any_tags", "exclude_tags"):
            return (self.tags & mask != 0) ^ (kind == "exclude_tags")
        if kind == "term":
            return every("lexeme") if value else np.zeros(self.n, bool)
        return {"ingredients": lambda: every("name"), "any_ingredients": lambda: some("name"), "exclude_ingredients": lambda: ~some("name")}[kind]()

    def passes(self, found: list[tuple[str, object]], terms: str) -> np.ndarray:
        words = [self.bitmap(*c) for c in found if c[0] == "term"]
        bits = [self.bitmap(*c) for c in found if c[0] != "term"]
        if words:
            bits.append(reduce(np.logical_and if terms == "all" else np.logical_or, words))
        return reduce(np.logical_and, bits, np.ones(self.n, bool))


def best_of(batch: Batch, plan: list, limit: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The lowest rung of a search that any of the batch's dishes passes, the best of these, and their match counts."""
    for rung, (found, terms) in enumerate(plan):
        at = np.flatnonzero(batch.passes(found, terms))
        if len(at):
            count = sum((batch.bitmap(*c)[at].astype(np.int32) for c in plan[0][0]), np.zeros(len(at), np.int32))
            first = np.argsort(-count, kind="stable")[:limit]
            return rung, at[first], count[first]
    return 0, np.zeros(0, np.int64), np.zeros(0, np.int32)


def browse_keys() -> list[Column]:
    """What dishes are ordered by, all descending and never null, before dish_id: score, date, source rating."""
    return [F.coalesce("score", F.lit(float(NEUTRAL_SCORE))).cast("double"), F.unix_micros(F.coalesce("published_at", "first_seen_at")).cast("double"), F.coalesce("source_rating", F.lit(0.0)).cast("double")]


def search_many(dishes: DataFrame, lines: DataFrame, searches: DataFrame, limit: int | None = None, keys: list[Column] | None = None, stem=query_lexemes) -> DataFrame:
    """search_id, place (from 1), dish_id, match_count, rung, terms_union and relaxations of the best dishes of every search.

    searches has a distinct search_id and columns named as the fields of Filter, whichever are used. Rows equal those of
    search() for each filter alone, with keys instead of its order. dishes has lexemes where a search has terms.
    relaxations are (field, how, was, to). Searches that nothing passes on any rung have no rows, an empty table of
    dishes or searches gives none. A search_id that comes twice, or an invalid filter, raises ValueError.
    """
    if not searches.groupBy("search_id").count().where("count > 1").isEmpty():
        raise ValueError("each search needs its own search_id")
    fields_ = [c for c in searches.columns if c in _FIELDS]
    asks = F.to_json(F.struct(F.lit(0).alias("x"), *fields_))
    each = written(searches.select(asks.alias("asks"), *fields_).dropDuplicates(["asks"]).withColumn("no", F.monotonically_increasing_id()), "searches")
    passes = max(1, -(-each.count() // MOST))
    turn = F.pmod(F.xxhash64("no"), F.lit(passes))
    found = reduce(DataFrame.union, (_search_each(dishes, lines, each.where(turn == i).drop("asks"), clamp_limit(limit), keys, stem) for i in range(passes)))
    told = found.join(each.select("no", "asks"), "no").drop("no")
    return searches.select("search_id", asks.alias("asks")).join(told, "asks").drop("asks")


def _search_each(dishes: DataFrame, lines: DataFrame, searches: DataFrame, limit: int, keys: list[Column] | None, stem) -> DataFrame:
    """search_many of different searches in one pass, with no instead of search_id."""
    spark = dishes.sparkSession
    tried = {r["no"]: attempts(filter_of(r.asDict())) for r in searches.collect()}
    plans = [(i, [(_criteria(g, stem), terms) for g, terms, _ in t]) for i, t in tried.items()]
    asked = sorted({w for _, plan in plans for k, v in plan[0][0] if "ingredients" in k for w in v})
    stems = sorted({w for _, plan in plans for k, v in plan[0][0] if k == "term" for w in v})
    named = F.broadcast(spark.createDataFrame(pa.table({"name": pa.array(asked, pa.string())})))  # the searches' own names
    names = lines.select("dish_id", F.lower("name").alias("name")).join(named, "name").groupBy("dish_id").agg(F.collect_set("name").alias("names"))
    lexemes = F.col("lexemes") if stems else F.array().cast("array<string>")
    keys = browse_keys() if keys is None else keys
    base = dishes.select("dish_id", *_NUMBERS, "category", "tags", lexemes.alias("lexemes"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    base = base.join(names, "dish_id", "left")
    wanted = spark.sparkContext.broadcast(plans)
    id_type = dishes.schema["dish_id"].dataType.simpleString()
    ordered = [f"k{i}" for i in range(len(keys))]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = wanted.value
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by([*((k, "descending") for k in ordered), ("dish_id", "descending")]).combine_chunks()
            columns = {c: table.column(c).combine_chunks() if table.column(c).num_chunks != 1 else table.column(c).chunk(0) for c in table.column_names}
            held = Batch(columns)
            out = [(i, *best_of(held, plan, limit)) for i, plan in plans]
            sizes = [len(at) for _, _, at, _ in out]
            at = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in out)])
            repeat = lambda j: pa.array(np.repeat(np.arange(len(out)), sizes)) if j is None else pa.array(np.repeat([x[j] for x in out], sizes).astype(np.int32))
            if len(at):
                ids = pa.array([x[0] for x in out], pa.int64()).take(repeat(None))
                kept = [table.column(c).take(pa.array(at)).combine_chunks() for c in ("dish_id", *ordered)]
                yield pa.RecordBatch.from_arrays([ids, repeat(1), pa.array(np.concatenate([x[3] for x in out]).astype(np.int32)), *kept], names=["no", "rung", "match_count", "dish_id", *ordered])

    kinds = {f"k{i}": base.schema[f"k{i}"].dataType.simpleString() for i in range(len(keys))}
    best = base.mapInArrow(match, f"no long, rung int, match_count int, dish_id {id_type}, {', '.join(f'{k} {t}' for k, t in kinds.items())}")
    order = Window.partitionBy("no").orderBy("rung", F.col("match_count").desc(), *(F.col(k).desc() for k in ordered), F.col("dish_id").desc())
    least = F.min("rung").over(Window.partitionBy("no"))
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).withColumn("least", least).where("rung = least")
    told = [(i, rung, terms == "any", [(n, how, *(str(x) for x in values)) if values else (n, how, None, None) for n, how, *values in told]) for i, t in tried.items() for rung, (_, terms, told) in enumerate(t)]
    told = spark.createDataFrame(told, "no long, rung int, terms_union boolean, relaxations array<struct<field:string,how:string,was:string,to:string>>")
    return best.join(F.broadcast(told), ["no", "rung"]).select("no", "place", "dish_id", "match_count", "rung", "terms_union", "relaxations")
