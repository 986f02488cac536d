"""The index of terms gives what a scan of all dishes gives, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import search, term_index

WORDS = ("green", "curried", "beans", "roasting", "soups", "the", "salads", "rarest")


@pytest.fixture(scope="module")
def dishes(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, (9, 5, 5, 3, 3, 9, 2, 0.02), k=3)) if i % 17 else None, rng.randrange(40), rng.choice((None, 1.0, 4.5))) for i in range(600)]
    made = spark.createDataFrame(rows, "dish_id long, title string, day int, source_rating double").withColumn("blurb", F.lit(None).cast("string"))
    made = made.withColumn("published_at", F.expr("CASE WHEN day % 5 > 0 THEN timestamp_seconds(day * 86400) END")).withColumn("first_seen_at", F.expr("timestamp_seconds(day * 86400 + 7)"))
    return search.with_lexemes(made).withColumn("score", F.lit(None).cast("double")).cache()


@pytest.fixture(scope="module")
def index(dishes, tmp_path_factory):
    return term_index.build(dishes, 20).write(f"file://{tmp_path_factory.mktemp('terms')}")


@pytest.mark.parametrize("terms", [["bean"], ["curry", "green"], ["green beans"], ["the"], ["green", "the"], ["rare"], ["nothing"], ["roast", "soup", "salad"]])
def test_same_rows_as_scan(dishes, index, terms):
    wanted = search.criteria(search.Filter(terms=terms))
    want = [r.dish_id for r in search.ranked(dishes, wanted, search.where(wanted), search.browse_order(), 12).collect()]
    got, read = term_index.first_dishes(index, terms, 12)
    assert [r.dish_id for r in got.collect()] == want
    assert index.segments > 20 and (read < index.segments or len(want) < 12)
    every = {r.dish_id: r.n for r in dishes.where(search.where(wanted, "any")).select("dish_id", search.match_count(wanted).alias("n")).collect()}
    some = term_index.matches(index, terms, "any").join(index.ranked, ["segment", "place"]).collect()
    assert {r.dish_id: r.n_terms for r in some} == every


def test_frequent_words_read_few_segments(dishes, index):
    _, read = term_index.first_dishes(index, ["green"], 5)
    assert read == term_index.FIRST
    plan = term_index.lookup_postings(index, ["green"], 4)._jdf.queryExecution().toString()
    scan = next(x for x in plan.split("\n") if "PartitionFilters" in x and "folder" in x)
    assert "GreaterThan" not in scan and "PushedFilters" in scan and "LessThan(segment,4)" in scan


def test_order_does_not_depend_on_segments(dishes):
    want = None
    for size in (7, 100, 10_000):
        got = [r.dish_id for r in term_index.first_dishes(term_index.build(dishes, size), ["green"], 30)[0].collect()]
        want = want or got
        assert got == want and len(got) == 30


def test_no_dishes(dishes):
    empty = term_index.build(dishes.limit(0))
    assert empty.segments == 0 and term_index.first_dishes(empty, ["green"], 3)[0].count() == 0
