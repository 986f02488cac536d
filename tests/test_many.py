"""A table of filters in one pass against single searches, one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import many, search
from larder.vocab import CATEGORIES, TAGS

WORDS = ("green", "curry", "beans", "roasted", "soup", "the")
FIELDS = "max_minutes int, min_minutes int, max_active_minutes int, min_servings int, min_keeps_days int, freezer_only boolean, " + ", ".join(f"{n} array<string>" for n in ("categories", "tags", "any_tags", "exclude_categories", "exclude_tags", "ingredients", "any_ingredients", "exclude_ingredients", "terms"))


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = random.Random(2)
    maybe = lambda x: None if rng.random() < 0.2 else x
    dishes = [(i, maybe(rng.randint(5, 90)), maybe(rng.randint(5, 40)), maybe(rng.randint(1, 8)), maybe(rng.randint(1, 6)), maybe(rng.randint(0, 3)), maybe(rng.choice(CATEGORIES)), rng.sample(TAGS, rng.randint(0, 5)), maybe(rng.choice((10.0, 50.0, 90.0))), maybe(rng.choice((1.0, 4.5))), " ".join(rng.sample(WORDS, 3))) for i in range(300)]
    dishes = spark.createDataFrame(dishes, "dish_id long, total_minutes int, active_minutes int, servings int, keeps_days int, freezer_months int, category string, tags array<string>, score double, source_rating double, title string")
    dishes = dishes.withColumn("blurb", F.lit(None).cast("string")).withColumn("published_at", F.expr("CASE WHEN dish_id % 3 > 0 THEN timestamp_seconds(dish_id % 5 * 86400) END")).withColumn("first_seen_at", F.expr("timestamp_seconds(86400)"))
    lines = [(i, rng.choice(("Salt", "Peas", "Rice", None, "oil", "Kale"))) for i in range(300) for _ in range(rng.randint(0, 4))]
    return search.with_lexemes(dishes).repartition(5).cache(), spark.createDataFrame(lines, "dish_id long, name string").cache()


def filters(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        row = dict.fromkeys(f.split(" ")[0] for f in FIELDS.split(", "))
        chosen = {
            "max_minutes": rng.randint(1, 60), "min_minutes": rng.randint(1, 90), "max_active_minutes": rng.randint(1, 40), "min_servings": rng.randint(1, 9), "min_keeps_days": rng.randint(1, 7), "freezer_only": True,
            "categories": rng.sample(CATEGORIES, 2), "tags": rng.sample(TAGS, rng.randint(1, 2)), "any_tags": rng.sample(TAGS, 2), "exclude_categories": rng.sample(CATEGORIES, 2), "exclude_tags": rng.sample(TAGS, 3),
            "ingredients": rng.sample(("salt", "peas"), rng.randint(1, 2)), "any_ingredients": rng.sample(("rice", "kale", "gold"), 2), "exclude_ingredients": ["oil"], "terms": rng.sample(WORDS, rng.randint(1, 3)),
        }
        row |= {k: chosen[k] for k in rng.sample(sorted(chosen), rng.randint(0, 5))}
        out.append((i, *row.values()))
    return out


def test_many_equal_single_searches(spark, catalogue):
    dishes, lines = catalogue
    rows = filters(40, 1)
    searches = spark.createDataFrame(rows, f"search_id int, {FIELDS}")
    got = {}
    for r in many.search_many(dishes, lines, searches, limit=7).orderBy("search_id", "place").collect():
        got.setdefault(r.search_id, []).append((r.place, r.dish_id, r.match_count, r.terms_union, [(x.field, x.how) for x in r.relaxations]))
    relaxed = 0
    for r in searches.collect():
        answer = search.search(dishes, lines, many.filter_of(r.asDict()), limit=7)
        told = [x[:2] for x in answer.relaxations]
        want = [(k, x.dish_id, x.match_count, answer.terms_union, told) for k, x in enumerate(answer.rows.collect(), 1)]
        relaxed += bool(told and want)
        assert got.get(r.search_id, []) == want, r
    assert relaxed > 3


def test_answers_do_not_depend_on_batches(spark, catalogue):
    dishes, lines = catalogue
    searches = spark.createDataFrame(filters(2000, 3), f"search_id int, {FIELDS}")
    every = lambda: sorted(map(str, many.search_many(dishes, lines, searches, limit=5).collect()))
    want, name = every(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "17")
        assert every() == want and len(want) > 2000
    finally:
        spark.conf.set(name, before)


def test_odd_searches(spark, catalogue):
    dishes, lines = catalogue
    none = spark.createDataFrame([], f"search_id int, {FIELDS}")
    assert many.search_many(dishes, lines, none).count() == 0
    one = spark.createDataFrame([("a", None), ("b", 1)], "search_id string, min_servings int")
    assert many.search_many(dishes.limit(0), lines, one).count() == 0
    assert {r.search_id: r.n for r in many.search_many(dishes, lines, one).groupBy("search_id").agg(F.count("*").alias("n")).collect()}["a"] == 50
    with pytest.raises(ValueError):
        many.search_many(dishes, lines, spark.createDataFrame([(1,), (1,)], "search_id int"))
    with pytest.raises(ValueError):
        many.search_many(dishes, lines, spark.createDataFrame([(1, -4)], "search_id int, max_minutes int"))


def test_more_searches_than_a_pass_takes(spark, catalogue, monkeypatch):
    dishes, lines = catalogue
    rows = filters(20, 5)
    rows += [(i + 20, *r[1:]) for i, r in enumerate(rows)]  # each twice
    searches = spark.createDataFrame(rows, f"search_id int, {FIELDS}")
    want = sorted(map(str, many.search_many(dishes, lines, searches, limit=5).collect()))
    seen = []
    one = many._search_each
    monkeypatch.setattr(many, "MOST", 6)
    monkeypatch.setattr(many, "_search_each", lambda d, n, s, *rest: seen.append(s.count()) or one(d, n, s, *rest))
    assert sorted(map(str, many.search_many(dishes, lines, searches, limit=5).collect())) == want and len(want) > 40
    assert len(seen) > 1 and sum(seen) == len({r[1:].__repr__() for r in rows})
