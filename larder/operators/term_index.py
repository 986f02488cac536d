"""A stored index of terms: postings by lexeme in segments of dishes, best dishes first, of which a search reads the first few.

Dishes are ranked once by what every reader's order shares and cut into segments by rank, so each dish of a segment comes
before all of the next. A posting row has a lexeme's dishes of one segment, as places. A search for the first k dishes
reads its lexemes' postings of a few segments, and of twice as many until it has k or all: blocks beyond are skipped.
Postings lie in folders by a hash of the lexeme and are sorted by lexeme and segment, so a scan opens a word's folder and
skips row groups. A posting row holds a segment's number of dishes at most, however frequent a lexeme is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.stem import query_lexemes
from larder.plans.shared import written

#: Dishes of a segment, segments at most, folders of postings, and segments that a search reads first.
SEGMENT, MOST_SEGMENTS, FOLDERS, FIRST = 100_000, 10_000, 64, 4


def static_order() -> list[Column]:
    """The part of the order that is the same for all readers, best last: date, source rating, id; never null."""
    return [F.coalesce("published_at", "first_seen_at"), F.coalesce("source_rating", F.lit(0.0)), F.col("dish_id")]


@dataclass
class TermIndex:
    """ranked: segment, place, dish_id. postings: folder, lexeme, segment, places (ascending). segments: how many there are."""

    ranked: DataFrame
    postings: DataFrame
    segments: int

    def write(self, path: str) -> TermIndex:
        """Store the index and read it from there."""
        self.ranked.repartitionByRange("segment", "place").sortWithinPartitions("segment", "place").write.mode("overwrite").parquet(f"{path}/ranked")
        self.postings.repartition("folder").sortWithinPartitions("folder", "lexeme", "segment").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
        return TermIndex.read(self.ranked.sparkSession, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> TermIndex:
        ranked = spark.read.parquet(f"{path}/ranked")
        last = ranked.agg(F.max("segment")).first()[0]
        return TermIndex(ranked, spark.read.schema("lexeme string, segment int, places array<long>, folder int").parquet(f"{path}/postings"), 0 if last is None else last + 1)


def build(dishes: DataFrame, segment: int = SEGMENT) -> TermIndex:
    """The index of dishes (distinct dish_id, lexemes and the columns of static_order). Dishes without lexemes are in no posting."""
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(static_order())))
    rows = dishes.select("dish_id", "lexemes", key.alias("key"), F.unix_micros(F.coalesce("published_at", "first_seen_at")).alias("at"))
    n = rows.count()
    parts = max(1, min(MOST_SEGMENTS, -(-n // segment)))
    # Cuts by date, which are as even as dates are; a date's dishes are never apart, so a segment is never in the way of the order.
    cuts = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"] if parts > 1 else []
    bounds = sorted(set(cuts or []))
    rows = rows.withColumn("segment", _bounds_above(bounds, F.col("at")) if bounds else F.lit(0))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.col("key").desc())) - 1
    rows = rows.select("dish_id", "lexemes", "segment", (F.col("segment").cast("long") * F.lit(1 << 40) + place).alias("place"))
    rows = written(rows, "ranked")  # ranked once, for postings, places and each search
    words = rows.select("segment", "place", F.explode(F.array_distinct("lexemes")).alias("lexeme"))
    block = F.expr(f"place % {1 << 40} div {segment}")  # more than one where a date has more dishes than a segment
    postings = words.groupBy("lexeme", "segment", block.alias("block")).agg(F.array_sort(F.collect_list("place")).alias("places"))
    return TermIndex(rows.select("segment", "place", "dish_id"), postings.select(folder_of(F.col("lexeme")).alias("folder"), "lexeme", "segment", "places"), len(bounds) + 1 if n else 0)


def _bounds_above(bounds: list[int], at: Column) -> Column:
    """How many of the ascending bounds are at or above each value, by bisection; 0 for null."""

    def each(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        below = np.searchsorted(np.array(bounds, np.int64), values.fillna(0).to_numpy(np.int64))
        return pd.Series(np.where(known, len(bounds) - below, 0).astype(np.int32))

    return F.pandas_udf(each, "int")(at)


def folder_of(lexeme: Column) -> Column:
    return F.pmod(F.hash(lexeme), F.lit(FOLDERS))


def lookup_postings(index: TermIndex, words: list[str], before: int | None = None) -> DataFrame:
    """The postings of words in the segments before `before`; a stored index opens their folders only."""
    here = [F.expr("false")] + [(F.col("folder") == folder_of(F.lit(w))) & (F.col("lexeme") == w) for w in words]
    clause = here[0]
    for c in here[1:]:
        clause = clause | c
    folders = index.postings.sparkSession.range(1).select(F.array(F.lit(-1), *(folder_of(F.lit(w)) for w in words)).alias("f")).first()["f"]
    rows = index.postings.where(F.col("folder").isin(folders) & F.col("lexeme").isin(words) & clause)
    return rows if before is None else rows.where(F.col("segment") < before)


def matches(index: TermIndex, terms: list[str], mode: str = "all", before: int | None = None, stem=query_lexemes) -> DataFrame:
    """segment, place and n_terms of the dishes that all or any of the terms match, in the segments before `before`.

    A term matches where all of its lexemes are; one of stop words only matches nothing, as with search.
    """
    lists = [stem(t) for t in terms]
    words = sorted({w for ws in lists for w in ws})
    if not words or (mode == "all" and not all(lists)):
        words, lists = [], []
    found = lookup_postings(index, words, before).select("segment", "lexeme", F.explode("places").alias("place"))
    held = found.groupBy("segment", "place").agg(F.collect_set("lexeme").alias("has"))  # of the search's own words
    met = sum((F.coalesce((F.size(F.array_intersect("has", F.array(*map(F.lit, ws)))) == len(ws)), F.lit(False)).cast("int") for ws in lists if ws), F.lit(0))
    return held.select("segment", "place", met.alias("n_terms")).where(F.col("n_terms") >= (len(lists) if mode == "all" and lists else 1))


def first_dishes(index: TermIndex, terms: list[str], limit: int, stem=query_lexemes) -> tuple[DataFrame, int]:
    """dish_id and place of the best `limit` dishes that all terms match, and the segments that were read for it."""
    before = min(FIRST, index.segments)
    while True:
        top = matches(index, terms, "all", before, stem).orderBy("place").limit(limit)
        if before >= index.segments or top.count() >= limit:
            ranked = index.ranked.where(F.col("segment") < before)
            return top.join(ranked.select("segment", "place", "dish_id"), ["segment", "place"]).select("dish_id", "place").orderBy("place"), before
        before = min(2 * before, index.segments)
