"""All, any and none by words of 64 dishes, against sets."""

import random

from larder.operators import bitmaps

NAMES = [f"n{i}" for i in range(6)]


def made(spark, rows):
    dishes = spark.createDataFrame([(d,) for d in rows] + [(d,) for d in list(rows)[:3]], "dish_id long")
    lines = spark.createDataFrame([(d, n) for d, names in rows.items() for n in names] + [(999_999, "n0"), (5, None)], "dish_id long, name string")
    return bitmaps.ingredient_words(dishes, lines)


def answers(words, searches):
    return sorted((r.search_id, r.dish_id) for r in bitmaps.dishes_of(bitmaps.lookup(words, searches)).collect())


def want(rows, asked):
    return sorted((s, d) for s, a, o, x in asked for d, names in rows.items() if set(a or []) <= names and (not o or set(o) & names) and not set(x or []) & names)


def test_searches_and_changes(spark):
    pick = random.Random(3)
    some = lambda k: [pick.choice(NAMES) for _ in range(pick.randint(0, k))]
    rows = {d: set(some(4)) for d in [-130, -64, -1, 0, 63, 64, 127, 2**40, *range(200, 300)]}
    asked = [(s, some(2), some(3), some(2)) for s in range(60)] + [(60, None, None, None), (61, ["missing"], None, []), (62, [], ["missing"], None), (63, ["n1", "n1"], [], ["missing"])]
    searches = spark.createDataFrame(asked, "search_id long, ingredients array<string>, any_ingredients array<string>, exclude_ingredients array<string>")
    words = made(spark, rows)
    assert answers(words, searches) == want(rows, asked)
    assert {r.search_id: r.n for r in bitmaps.counts_of(bitmaps.lookup(words, searches)).collect()}[60] == len(rows)
    touched = {d: rows[d] for d in [-1, 64, *range(220, 230)]}
    after = {d: set(some(4)) for d in [-1, 64, *range(220, 226), 7000]}
    words = bitmaps.change(words, made_plain(spark, touched), made_plain(spark, after))
    rows = {d: n for d, n in rows.items() if d not in touched} | after
    assert answers(words, searches) == want(rows, asked)


def made_plain(spark, rows):
    lines = spark.createDataFrame([(d, n) for d, names in rows.items() for n in names], "dish_id long, name string")
    return bitmaps.ingredient_words(spark.createDataFrame([(d,) for d in rows], "dish_id long"), lines)


def test_missing_lists_and_empty_tables(spark):
    rows = {1: {"n1"}, 2: set()}
    words = made_plain(spark, rows)
    one = spark.createDataFrame([(1, ["N1"])], "search_id long, exclude_ingredients array<string>")
    assert answers(words, one) == [(1, 2)]
    assert answers(words.limit(0), one) == [] and answers(words, one.limit(0)) == []


def test_counts_of_equal_searches_and_turns(spark, monkeypatch):
    rows = {d: {NAMES[d % 6], NAMES[d % 4]} for d in range(300)}
    asked = [(s, [f"N{s % 3}", "n1"] if s % 2 else ["n1", f"n{s % 3}"], None, [f"n{s % 4}"] if s % 5 else None) for s in range(90)]
    searches = spark.createDataFrame(asked, "search_id long, ingredients array<string>, any_ingredients array<string>, exclude_ingredients array<string>")
    words = made_plain(spark, rows)
    lower = [(s, [n.lower() for n in a], o, x) for s, a, o, x in asked]
    expected = {}
    for s, _ in want(rows, lower):
        expected[s] = expected.get(s, 0) + 1
    looked = []
    whole = bitmaps._lookup
    monkeypatch.setattr(bitmaps, "SENT", 4)
    monkeypatch.setattr(bitmaps, "_lookup", lambda w, s: looked.append(s.count()) or whole(w, s))
    assert {r.search_id: r.n for r in bitmaps.counts(words, searches).collect()} == expected
    assert sum(looked) < 90 and len(looked) > 1  # equal searches once, in turns
    plan = words.sparkSession.createDataFrame([(1, ["n1"])], "search_id long, ingredients array<string>")
    text = whole(words, plan)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(search_id" not in text  # no row of a search and a word moves
