import pytest
from pyspark.sql import functions as F

from larder.operators import matcher, rules, scoring, search, state


def test_filter_contract():
    assert search.Filter(tags=["Cheap", "Cheap"]).tags == ("Cheap",) and search.Filter(ingredients=[" Egg "]).ingredients == ("egg",)
    for bad in ({"tags": ["x"]}, {"max_minutes": 0}, {"terms": ["a"] * 0 + ["b" * 61]}, {"ingredients": [str(i) for i in range(11)]}):
        with pytest.raises(ValueError):
            search.Filter(**bad)
    assert search.Filter().empty and not search.Filter(freezer_only=True).empty


def test_relax():
    f = search.Filter(max_minutes=15, min_minutes=10, min_servings=2, freezer_only=True)
    g, told = search.relax(f, search.LADDER[0])
    assert (g.min_servings, g.freezer_only) == (None, False) and len(told) == 2
    g, told = search.relax(f, search.LADDER[2])
    assert (g.max_minutes, g.min_minutes) == (23, 6) and told[0] == ("max_minutes", "widened", 15, 23)


def dishes(spark):
    rows = [(1, 10, None, ["Cheap"]), (2, 40, "Soup", ["Vegan"]), (3, None, None, []), (4, 100, "Soup", [])]
    df = spark.createDataFrame(rows, "dish_id long, total_minutes int, category string, tags array<string>")
    for c, t in (("active_minutes", "int"), ("servings", "int"), ("keeps_days", "int"), ("freezer_months", "int"), ("source_rating", "double"), ("score", "float"), ("published_at", "timestamp")):
        df = df.withColumn(c, F.lit(None).cast(t))
    return df.withColumn("first_seen_at", F.lit("2024-01-01").cast("timestamp"))


def test_search_relaxes_two_used_rungs(spark):
    lines = spark.createDataFrame([], "dish_id long, name string")
    f = search.Filter(max_minutes=7, any_tags=["One pot"], categories=["Breakfast"])
    answer = search.search(dishes(spark), lines, f)
    assert [t[0] for t in answer.relaxations] == ["any_tags", "max_minutes"] and answer.rows.count() == 0
    answer = search.search(dishes(spark), lines, search.Filter(max_minutes=7, any_tags=["One pot"]))
    assert [r.dish_id for r in answer.rows.collect()] == [1]


def test_null_directions(spark):
    ids = lambda c: {r.dish_id for r in dishes(spark).where(c).collect()}
    where = lambda **f: search.where(search.criteria(search.Filter(**f)))
    assert ids(where(max_minutes=50)) == {1, 2} and ids(where(exclude_categories=["Soup"])) == {1, 3}
    assert ids(rules.rule_filter([{"kind": "max_minutes", "value": "50", "enabled": True}])) == {1, 2, 3}


def test_rules(spark):
    schema = "user_id long, rating int, total_minutes int, category string, tags array<string>"
    cooked = [(1, 2, 70, "Soup", ["Cheap"])] * 5 + [(2, 1, 70, "Soup", None)] * 4
    got = {(r.user_id, r.rule_id) for r in rules.derive_rules(rules.observations(spark.createDataFrame(cooked, schema))).collect()}
    assert got == {(1, "max_minutes:60"), (1, "exclude_category:Soup"), (1, "exclude_tag:Cheap")}
    rule = "user_id long, rule_id string, kind string, value string, observations long, median_rating double"
    before = spark.createDataFrame([(1, "a", "k", "v", 5, 2.0, False), (1, "b", "k", "v", 5, 2.0, True), (1, "c", "k", "v", 5, 2.0, False)], rule + ", enabled boolean")
    merged = rules.merge_rules(before, spark.createDataFrame([(1, "a", "k", "v", 6, 1.0), (1, "d", "k", "v", 6, 1.0)], rule))
    assert {(r.rule_id, r.enabled, r.observations) for r in merged.collect()} == {("a", False, 6), ("c", False, 5), ("d", True, 6)}


def test_scoring(spark):
    batches = spark.createDataFrame([(1, 0, 1, 10), (1, 0, 2, 11)], "user_id long, batch int, ref int, dish_id long")
    answers = [(1, 0, 1, 0, 150.0, " good "), (1, 0, 1, 1, 3.0, "late"), (1, 0, 2, 2, 5.0, "  "), (1, 0, 9, 3, 5.0, "unknown")]
    got = scoring.resolve(batches, spark.createDataFrame(answers, "user_id long, batch int, ref int, position int, score double, reason string")).collect()
    assert [(r.dish_id, r.score, r.reason) for r in got] == [(10, 100.0, "good")]


def test_state(spark):
    make = lambda rows: spark.createDataFrame(rows, "k long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(state.upsert(make([(1, "a"), (2, "b")]), make([(2, "c"), (3, "d")]), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(state.insert_ignore(make([(1, "a")]), make([(1, "z"), (2, "c"), (2, "c")]), ["k"])) == [(1, "a"), (2, "c")]
    picks = "user_id long, dish_id long, batches int, saved_at int"
    got = state.save_picks(spark.createDataFrame([(1, 1, 1, 5), (1, 2, 1, 6)], picks), spark.createDataFrame([(1, 1, 3, 9), (1, 2, None, 9), (1, 3, 2, 9)], picks))
    assert rows(got) == [(1, 1, 3, 5), (1, 3, 2, 9)]
    assert rows(state.save_picks(spark.createDataFrame([(1, 1, 1, 5)], picks), spark.createDataFrame([(1, 1, 4, None)], picks))) == [(1, 1, 4, 5)]
    old = spark.createDataFrame([("u0", None, "t", "b", "Soup", "active", 1, 1), ("u1", "h1", "t", "b", "Soup", "active", 1, 1), ("u2", "h2", "t", "b", "Soup", "active", 1, 1)], "source_url string, content_hash string, title string, blurb string, category string, status string, first_seen_at int, last_seen_at int")
    drafts = spark.createDataFrame([("u0", "h0", "T", 2), ("u1", "h1", "t", 2), ("u2", "new", "T", 2), ("u3", "h3", "n", 2)], "source_url string, content_hash string, title string, seen_at int")
    got = {r.source_url: (r.outcome, r.status, r.blurb, r.first_seen_at, r.last_seen_at) for r in state.upsert_dishes(old, drafts).collect()}
    assert got == {"u0": ("updated", "pending", None, 1, 2), "u1": ("unchanged", "active", "b", 1, 2), "u2": ("updated", "pending", None, 1, 2), "u3": ("inserted", "pending", None, 2, 2)}
    codes = state.share_codes(spark.range(1000)).collect()
    assert len({r.share_code for r in codes}) == 1000 and all(len(r.share_code) == 8 and set(r.share_code) <= set(state.ALPHABET) for r in codes)


def test_matcher(spark):
    aliases = spark.createDataFrame([("chicken breast", 1), ("chicken breasts", 1), ("olive oils", 2), ("olive oily", 3)], "alias string, ingredient_id long")
    names = spark.createDataFrame([(n,) for n in ("Chicken  Breast", "chicken breastss", "olive oil", "plutonium")], "name string")
    got = {r.name: (r.ingredient_id, r.how) for r in matcher.match(names, aliases).collect()}
    assert got["Chicken  Breast"] == (1, "exact") and got["chicken breastss"] == (1, "fuzzy") and got["plutonium"] == (None, "none")
    assert got["olive oil"][0] is None
