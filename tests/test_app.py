"""Cases of the catalogue's rules that SQL does not say."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import stem, text
from larder.operators import aliases, browse, matcher, planner, rules, runs, search, state, wording
from larder.sources import feeds, reddit, structured


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("consigned", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("generate", "generat"), ("relational", "relat"), ("conditional", "condit"), ("hopping", "hop"), ("hoping", "hope"),
        ("falling", "fall"), ("happy", "happi"), ("cries", "cri"), ("ties", "tie"), ("gas", "gas"), ("kiwis", "kiwi"), ("agreed", "agre"), ("luxuriated", "luxuri"), ("controlling", "control"), ("tomatoes", "tomato"), ("berries", "berri"),
        ("skies", "sky"), ("news", "news"), ("inning", "inning"), ("say", "say"), ("boy's", "boy"), ("by", "by"), ("easily", "easili"), ("hopefulness", "hope"), ("formality", "formal"), ("adjustment", "adjust"), ("rolls", "roll"),
    ],
)
def test_stems(word, want):
    assert stem.stem(word) == want


def test_terms_match_stems(spark):
    rows = spark.createDataFrame([(1, "Roasted Tomatoes", "with basil"), (2, "Tomato soup", None), (3, "Rice", "the rice")], "dish_id long, title string, blurb string")
    dishes = search.with_lexemes(rows)
    ids = lambda *terms, mode="all": sorted(r.dish_id for r in dishes.where(search.where(search.criteria(search.Filter(terms=terms)), mode)).collect())
    assert ids("tomato") == [1, 2] and ids("roasting tomatoes") == [1] and ids("the") == [] and ids("tomato", "basil") == [1] and ids("basil", "rice", mode="any") == [1, 3]


def test_repairs():
    fix = lambda **f: wording.repair(search.Filter(**f))
    f, timed = fix(tags=["10 minutes", "Cheap"], any_tags=["Under 20 min"])
    assert timed == ("10 minutes", "Under 20 min") and (f.max_minutes, f.tags, f.any_tags) == (20, ("Cheap",), ())
    assert fix(tags=["10 minutes"], max_minutes=5)[0].max_minutes == 5
    f, _ = fix(any_ingredients=["chicken", "beef"], exclude_ingredients=["chicken"], ingredients=["chicken", "rice"], terms=["Dinner", "smoky"])
    assert (f.ingredients, f.any_ingredients, f.exclude_ingredients, f.terms) == (("rice", "beef"), (), ("chicken",), ("smoky",))
    assert fix(any_tags=["Cheap", "Vegan"])[0].any_tags == ("Cheap", "Vegan")


def test_text_filter():
    assert wording.text_filter("A quick dinner with smoky chickpeas and Kale, kale!").terms == ("smoky", "chickpeas", "kale")
    assert wording.text_filter("with and the").empty and len(wording.text_filter("one two three four five six seven eight nine").terms) == 6


def test_notices_are_told_in_order():
    told = wording.notices(["under 30 minutes"], True, ["a", "b"], [("max_minutes", "widened", 15, 23), ("tags", "dropped")])
    assert [n.kind for n in told] == ["degraded", "rules-bypassed", "terms-union", "relaxed"]
    said = [wording.describe(n) for n in told]
    assert said[1] == "Your rule “under 30 minutes” is off for this search." and said[2].startswith("No dish has “a” and “b” together")
    assert said[3] == "No dish fits the whole search, so these are wider: the time limit is 23 minutes, not 15; tags are not required."
    assert wording.notices([], False, [], []) == [] and text.in_words(["a", "b", "c"]) == "a, b and c"
    rule = {"kind": "exclude_tag", "value": "Cheap", "observations": 1, "median_rating": 2.0}
    assert (wording.describe_rule(rule), wording.short_rule(rule), wording.explain_rule(rule)) == ("No dishes with the tag “Cheap”", "not Cheap", "Median of 1 rating here: 2 of 5")


def test_fingerprint():
    assert text.fingerprint("") == "811c9dc5" and text.fingerprint("a") == "e40c292c" and wording.VOCABULARY.startswith("2-")


def test_rule_values(spark):
    rows = spark.createDataFrame([(1, 10), (2, 40), (3, None)], "dish_id long, total_minutes int").withColumn("category", F.lit(None).cast("string")).withColumn("tags", F.array().cast("array<string>"))
    ids = lambda v: [r.dish_id for r in rows.where(rules.rule_filter([{"kind": "max_minutes", "value": v, "enabled": True}])).collect()]
    assert ids(" 30.5") == [1, 3] and ids("²") == [1, 2, 3] and ids("soon") == [1, 2, 3] and ids("1e1") == [1, 3] and ids("") == [3] and ids("inf") == [1, 2, 3]


def test_share_codes_are_unique(spark, monkeypatch):
    monkeypatch.setattr(state, "_code", lambda h: F.pmod(h, F.lit(700)).cast("string"))
    got = state.share_codes(spark.range(300)).collect()
    assert len({r.share_code for r in got}) == 300 and state.share_codes(spark.range(300)).orderBy("id").collect() == sorted(got)


def test_similar_names_lose_none(spark):
    import random

    rng = random.Random(3)
    words = [" ".join("".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    names = spark.createDataFrame([(w,) for w in words], "name string")
    for t in (0.3, 0.78):
        got = {(r.name, r.alias) for r in matcher.similar_names(names, names.select(F.col("name").alias("alias"), F.lit(1).alias("ingredient_id")), t).collect()}
        assert got == {(a, b) for a in words for b in words if float(np.float32(len(grams(a) & grams(b)) / len(grams(a) | grams(b)))) > t}


def test_handles(spark):
    rows = spark.createDataFrame([("/r-x-ydbw8vzv/",), ("ydbw8vzv",), ("soup-ydbw8vzvv",), ("a-ilouilou",), ("",), (None,)], "h string")
    assert [r[0] for r in rows.select(browse.handle_code(F.col("h"))).collect()] == ["ydbw8vzv", "ydbw8vzv", None, None, None, None]
    assert spark.range(1).select(browse.share_url(F.lit("https://x/"), F.lit("-"), F.lit("c"))).first()[0] == "https://x/r/c"


def test_import_is_idempotent(spark):
    saved = spark.createDataFrame([(1, 1, 2, 5)], "user_id long, dish_id long, batches int, saved_at int")
    checks = spark.createDataFrame([(1, "a")], "user_id long, item_key string")
    local = spark.createDataFrame([(1, 1, 1), (1, 2, 9), (1, 99, 1), (2, 2, 1)], "user_id long, dish_id long, batches int")
    ticks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "user_id long, item_key string")
    dishes = spark.createDataFrame([(1,), (2,)], "dish_id long")
    once = planner.import_state(saved, checks, local, ticks, dishes, 7)
    assert sorted(map(tuple, once.saved.collect())) == [(1, 1, 2, 5), (1, 2, 4, 7), (2, 2, 1, 7)] and sorted(map(tuple, once.checks.collect())) == [(1, "a"), (1, "b")]
    assert sorted(map(tuple, once.counts.collect())) == [(1, 1, 1, 1), (2, 1, 0, 0)]
    again = planner.import_state(once.saved, once.checks, local, ticks, dishes, 8)
    assert sorted(map(tuple, again.saved.collect())) == sorted(map(tuple, once.saved.collect())) and [tuple(r) for r in again.counts.collect()] == [(1, 0, 0, 1)]


def test_mappings_and_repair(spark):
    goods = spark.createDataFrame([(1, "rice", "Pantry"), (2, "olives", "Other")], "ingredient_id long, name string, aisle string")
    known = spark.createDataFrame([("rice", 1), ("olives", 2), ("white rice", 1)], "alias string, ingredient_id long")
    lines = spark.createDataFrame([(1, 0, "1 cup basmati", None), (1, 1, "white rice", None), (1, 2, "ketchup", 2), (1, 3, "kale", None)], "dish_id long, position int, raw_text string, ingredient_id long")
    refs = spark.createDataFrame([(1, 0, "1 cup basmati", "Basmati"), (1, 1, "white rice", "white  rice"), (1, 2, "ketchup", "ketchup"), (1, 3, "kale", "kale")], "dish_id long, position int, raw_text string, parsed_name string")
    decisions = spark.createDataFrame([(0, "basmati", "Rice", "Pantry"), (1, "white rice", "olives", "Other"), (2, "ketchup", "ketchup", "Other"), (3, "basmati", "olives", "Other")], "position int, input_name string, canonical_name string, aisle string")
    got = aliases.apply_mappings(goods, known, lines, refs, decisions)
    assert {r.position: (r.outcome, r.ingredient_id) for r in got.outcomes.collect()} == {0: ("mapped", 1), 1: ("conflict", 1), 2: ("stale", None), 3: ("undecided", None)}
    assert ("basmati", 1) in {tuple(r) for r in got.aliases.collect()} and got.ingredients.count() == 2
    assert [r.alias for r in aliases.contradictions(decisions).collect()] == ["basmati"]
    guard = aliases.guarded(decisions.withColumn("action", F.lit("existing"))).orderBy("position").collect()
    assert [(r.canonical_name, r.action) for r in guard] == [("basmati", "new"), ("white rice", "new"), ("ketchup", "existing"), ("basmati", "new")]
    left, mended, hits = aliases.repair(known, lines, spark.createDataFrame([("Ketchup",), ("white rice",)], "alias string"))
    assert {r.alias for r in left.collect()} == {"rice", "olives"} and [r.position for r in hits.collect()] == [2] and mended.where("ingredient_id is not null").count() == 0


def test_loose_json():
    assert structured.loads('<!-- {"a": "x\ny", "b": "it\\\'s"} -->') == {"a": "x\ny", "b": "it's"}
    assert structured.loads('/* <![CDATA[ */ [1] /* ]]> */') == [1] and structured.loads("{'a'}") is None and structured.loads("NaN") is None and structured.loads('﻿{"a":1}') == {"a": 1}


def test_odd_pages(spark):
    pages = [("https://a.com/1", None), ("https://a.com/2", "<p>x</p>"), ("https://a.com/3", '<script type="application/ld+json">[{"@type":"Recipe","name":"<b>A</b>","recipeIngredient":"salt","recipeYield":{"value":4},"totalTime":["","PT10M"],"image":["/a.jpg",{"@id":"/b.jpg"},"/a.jpg"],"recipeInstructions":"Mix.\\nEat.","aggregateRating":{"ratingValue":0,"ratingCount":0},"author":["X",{"name":"Y"},"X"]}]</script>')]
    got = {r.url[-1]: r for r in structured.dish_pages(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert (got["1"].nodes, got["2"].nodes, got["1"].missing, got["2"].content_hash) == (0, 0, None, None)
    r = got["3"]
    assert (r.title, r.servings, r.total_minutes, r.image_urls, r.author, r.rating) == ("A", 4, 10, ["https://a.com/a.jpg", "https://a.com/b.jpg"], "X, Y", None)
    assert [s.text for s in r.instructions] == ["Mix.", "Eat."] and r.missing == ["active_minutes", "rating", "published_at"]
    assert structured.drafts(structured.dish_pages(spark.createDataFrame(pages, "url string, html string"))).count() == 1


def test_prompt_text():
    page = "<body><header><p>top</p></header><article><h1>T</h1><p>a<p>a</p><ul><li>b<li>c</ul><div class='ad'><p>buy</p></div><p aria-hidden='true'>no</p></article><p>out</p></body>"
    assert structured.prompt_text(page) == "T\na\nb\nc" and structured.prompt_text("just <b>words</b>") == "just words" and structured.prompt_text(None) == ""
    long = "<main>" + "".join(f"<p>{'x' * 9}{i % 10}</p>" for i in range(20)) + "</main>"
    assert structured.prompt_text(long, 100) == "\n".join(f"{'x' * 9}{i}" for i in range(9))


def test_feed_links():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="self" href="/self"/><link rel="alternate" href="/post"/><title>T</title><updated>2024-05-06T00:00:00Z</updated></entry><entry><id>https://a.com/id</id></entry><entry><id>tag:x</id></entry></feed>'
    assert [(i["url"], i["title"]) for i in feeds.xml_items(atom, "https://a.com/feed")] == [("https://a.com/post", "T"), ("https://a.com/id", None)]
    assert feeds.xml_items("<broken", "https://a.com") == [] and feeds.xml_items(None, None) == []
    rss = '<rss><channel><item><guid isPermaLink="false">https://a.com/g</guid></item><item><guid>https://a.com/h</guid></item></channel></rss>'
    assert [i["url"] for i in feeds.xml_items(rss, "https://a.com")] == ["https://a.com/h"]


def test_listing_boundaries(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = spark.createDataFrame([(1, "x", day(5)), (2, None, day(3))], "page int, page_after string, created_at timestamp")
    tell = lambda df, since: tuple(reddit.coverage(df, since).first())
    assert tell(rows, day(4)) == (True, False) and tell(rows, None) == (False, False) and tell(rows.where("page = 1"), day(4)) == (False, True)


def test_runs_never_go_back(spark):
    rows = spark.createDataFrame([(1, "scan", "running", 10, 1, 0.5, 0)], "run_id long, kind string, status string, tokens_in long, tokens_out long, cost double, found long")
    done = runs.finish_runs(rows, spark.createDataFrame([(1, "success", 4, 3, 0.1, 7)], "run_id long, status string, tokens_in long, tokens_out long, cost double, found long"))
    assert tuple(done.select("status", "tokens_in", "tokens_out", "cost", "found").first()) == ("success", 10, 3, 0.5, 7)


def test_upsert_resets_what_was_derived(spark):
    old = spark.createDataFrame([("u", None, "t", "b", 3, 1, "Soup", ["Cheap"], "why", "rejected", 1, 1)], "source_url string, content_hash string, title string, blurb string, keeps_days int, freezer_months int, category string, tags array<string>, rejection_reason string, status string, first_seen_at int, last_seen_at int")
    now = state.upsert_dishes(old, spark.createDataFrame([("u", "h", "T", 2)], "source_url string, content_hash string, title string, seen_at int")).first()
    assert (now.outcome, now.title, now.status, now.blurb, now.keeps_days, now.freezer_months, now.category, now.tags, now.rejection_reason, now.first_seen_at) == ("updated", "T", "pending", None, None, None, None, [], None, 1)
