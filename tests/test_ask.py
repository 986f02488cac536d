"""Whole searches, kept rules and fingerprints."""

import random

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import ask, rule_state, rules, search
from larder.operators.search import Filter


@pytest.fixture(scope="module")
def dishes(spark):
    rows = [(1, "Smoky chickpeas", 40), (2, "Kale soup", 20), (3, "Kale and chickpeas", None)]
    made = spark.createDataFrame(rows, "dish_id long, title string, total_minutes int")
    for c, t in (("blurb", "string"), ("score", "double"), ("source_rating", "double"), ("active_minutes", "int"), ("servings", "int"), ("keeps_days", "int"), ("freezer_months", "int"), ("category", "string"), ("tags", "array<string>")):
        made = made.withColumn(c, F.lit(None).cast(t))
    return search.with_lexemes(made.withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("first_seen_at", F.timestamp_seconds("dish_id"))).cache()


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(1, "chickpea")], "dish_id long, name string")


def ids(reply):
    return [r.dish_id for r in reply.rows.collect()]


RULES = [{"kind": "max_minutes", "value": "30", "enabled": True}, {"kind": "exclude_tag", "value": "Cheap", "enabled": False}]


def test_read_query(dishes, lines):
    seen = []
    reply = ask.ask("something quick", dishes, lines, lambda q, profile: seen.append((q, profile)) or Filter(max_minutes=15, terms=("dinner",)), RULES, "likes soup")
    assert seen == [("something quick", "likes soup")] and ids(reply) == [2]
    assert [n.kind for n in reply.notices] == ["rules-bypassed", "relaxed"] and reply.filter == Filter(max_minutes=23)
    assert "up to 30 min" in reply.sentences()[0] and "23 minutes" in reply.sentences()[1]
    timed = ask.ask("in ten minutes", dishes, lines, lambda q, p: Filter(tags=["10 minutes"]))
    assert timed.repaired == ("10 minutes",) and timed.filter.max_minutes == 15


@pytest.mark.parametrize("reader", [None, lambda q, p: Filter(max_minutes=-1), lambda q, p: 1 / 0, lambda q, p: None])
def test_failing_readers_degrade(dishes, lines, reader):
    reply = ask.ask("Quick smoky kale, please", dishes, lines, reader)
    assert [n.kind for n in reply.notices] == ["degraded", "terms-union"] and ids(reply) == [3, 2, 1]
    assert reply.filter.terms == ("smoky", "kale", "please")


def test_refusals(dishes, lines):
    def spent(query, profile):
        raise ask.BudgetSpent

    assert ask.ask("kale", dishes, lines, spent) is None and ask.ask("kale", dishes, lines, available=False) is None
    with pytest.raises(ValueError):
        ask.ask("  ", dishes, lines)


def test_kept_rules_equal_a_batch(spark):
    rng = random.Random(8)
    schema = "log int, user_id int, rating int, total_minutes int, category string, tags array<string>"
    make = lambda i: (i, rng.randint(1, 4), rng.choice((1, 1, 2, 2, 3, 5)), rng.choice((None, 20, 45, 70, 100)), rng.choice((None, "Soup", "Chicken")), rng.choice((None, [], ["Cheap"], ["Cheap", "Vegan"])))
    held: dict[int, tuple] = {}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    kept, derived = rule_state.histograms(frame([])), rules.derive_rules(rules.observations(frame([])))
    for step in range(4):
        given = [make(100 * step + i) for i in range(25)]
        taken = rng.sample(sorted(held), min(len(held), 8))
        kept, derived = rule_state.update(kept, derived, frame(given), frame(held.pop(i) for i in taken))
        held |= {r[0]: r for r in given}
        kept, derived = (spark.createDataFrame(x.collect(), x.schema) for x in (kept, derived))
        want = rules.derive_rules(rules.observations(frame(held.values())))
        assert sorted(map(str, derived.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert derived.count() > 3 and kept.where("n1 < 0 OR n5 < 0").isEmpty()


def test_fingerprint_column(spark):
    texts = ["", "a", "é", "😀 and more", "x" * 300, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.fingerprint_of(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [None if t is None else text.fingerprint(t) for t in texts]
