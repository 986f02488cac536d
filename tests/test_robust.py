"""Legal but hostile input: no page or number ends a job, and no change is applied twice."""

import json

import pytest
from pyspark.sql import functions as F

from larder.functions import lines, schema_org
from larder.operators import state
from larder.sources import structured


def page(**fields):
    node = {"@type": "Recipe", "name": "Soup", "recipeIngredient": ["1 cup peas"], **fields}
    return f'<script type="application/ld+json">{json.dumps(node)}</script>'


HOSTILE = {
    "surrogate": page(name="a \ud800 b", recipeIngredient=["\udfff peas"]),
    "infinite": page().replace('"Soup"', '"Soup", "recipeYield": 1e400, "totalTime": [1e400, 30.5]'),
    "unhashable": page(aggregateRating={"@id": ["q"], "ratingValue": 4}, author={"@id": {"a": 1}, "name": "Ann"}),
    "digits": page(recipeYield="9" * 30, totalTime="9" * 30, prepTime="PT99999999999999999999H", cookTime=f"{'9' * 400} hours", aggregateRating={"ratingValue": "4.5", "ratingCount": "9" * 30}),
    "long number": page().replace('"Soup"', f'"Soup", "recipeYield": {"9" * 400}'),
    "too long": page().replace('"Soup"', f'"Soup", "recipeYield": {"9" * 6000}'),
    "deep": f'<script type="application/ld+json">{"[" * 100_000}</script>',
    "odd types": page(image=[None, 1, {"url": {"url": 3}}], author=[[["A"]], 5, True], recipeInstructions=[1, None, {"text": {"a": 1}}], keywords={"a": 1}, datePublished=7),
    "null": None,
    "empty": "",
}


def test_hostile_pages_give_nulls(spark):
    rows = structured.dish_pages(spark.createDataFrame(list(HOSTILE.items()), "url string, html string"))
    got = {r.url: r for r in rows.collect()}
    assert set(got) == set(HOSTILE)
    assert got["surrogate"].title == "a � b" and got["surrogate"].ingredients == ["� peas"]
    assert got["infinite"].servings is None and got["infinite"].total_minutes == 31
    assert got["unhashable"].rating.value == 4.0 and got["unhashable"].author == "Ann"
    assert (got["digits"].title, got["digits"].servings, got["digits"].total_minutes, got["digits"].prep_minutes) == ("Soup", None, None, None)
    assert got["digits"].rating.value == 4.5 and got["digits"].rating["count"] is None
    assert got["long number"].title == "Soup" and got["long number"].servings is None
    assert got["too long"].malformed == 1 and got["deep"].malformed == 1 and got["null"].blocks == 0
    assert got["odd types"].title == "Soup" and structured.drafts(rows).count() == 6


def test_fallbacks_keep_rows_apart(spark):
    card = "<main><div itemtype='https://schema.org/Recipe'><h2>Ingredients</h2><ul><li>{}</li></ul><h2>Method</h2><p>Cook</p></div></main>"
    pages = [("u", card.format("peas")), ("u", card.format("beans")), (None, card.format("rice")), ("v", page()), ("w", None)]
    got = structured.fallbacks(spark.createDataFrame(pages, "url string, html string")).collect()
    assert sorted((r.url or "", r.page_text.split("\n")[1]) for r in got) == [("", "rice"), ("u", "beans"), ("u", "peas")]


def test_drafts_of_urls_listed_twice(spark):
    found = structured.dish_pages(spark.createDataFrame([("u", page(name=None))], "url string, html string"))
    listed = spark.createDataFrame([("u", "Old", "2020-01-01"), ("u", "New", "2021-01-01")], "url string, title string, at string").select("url", "title", F.to_timestamp("at").alias("published_at"))
    assert [r.title for r in structured.drafts(found, listed).collect()] == ["New"]


@pytest.mark.parametrize(("f", "text", "want"), [(schema_org.duration_minutes, "PT99999999999999999999H", None), (schema_org.duration_minutes, "9" * 30, None), (schema_org.duration_minutes, "1 hour 20 mins", 80), (schema_org.servings, "9" * 30, None), (schema_org.servings, "4-6 portions", 4), (schema_org.servings, "2 cups", None)])
def test_numbers_beyond_int_are_null(spark, f, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x == want


def test_quantities_are_finite(spark):
    made = lines.parse_lines(spark.createDataFrame([("9" * 400 + " cups peas",), ("2 cups peas",)], "raw_text string")).select("parsed.qty").collect()
    assert [r.qty for r in made] == [None, 2.0]
    amount = spark.createDataFrame([("9" * 400,), ("2.5",)], "t string").select(lines._amount(F.col("t")).alias("q")).collect()
    assert [r.q for r in amount] == [None, 2.5]


def test_one_row_a_key(spark):
    old = spark.createDataFrame([("u", "h1", "active", 1, 1, "T")], "source_url string, content_hash string, status string, first_seen_at int, last_seen_at int, title string")
    drafts = spark.createDataFrame([("u", "h1", 5, "T"), ("u", "h2", 7, "T2"), ("n", "a", 3, "A"), ("n", "b", 4, "B"), ("n", "b", 4, "B")], "source_url string, content_hash string, seen_at int, title string")
    got = {r.source_url: (r.outcome, r.content_hash, r.title, r.last_seen_at) for r in state.upsert_dishes(old, drafts).collect()}
    assert got == {"u": ("updated", "h2", "T2", 7), "n": ("inserted", "b", "B", 4)} and state.upsert_dishes(old, drafts).count() == 2
    rows = spark.createDataFrame([(1, "h", "pending"), (2, "g", "pending"), (3, None, "pending")], "dish_id int, content_hash string, status string")
    changes = spark.createDataFrame([(1, "x", "rejected"), (1, "h", "active"), (1, "h", "active"), (2, "x", "active"), (2, "y", "active"), (9, "h", "active")], "dish_id int, expected_hash string, status string")
    done = sorted((r.dish_id, r.status, r.outcome) for r in state.compare_and_set(rows, changes).collect())
    assert done == [(1, "active", "applied"), (2, "pending", "stale"), (3, "pending", "kept")]
    scores = "user_id int, dish_id int, score float, at int"
    new = spark.createDataFrame([(1, 1, 5.0, 2), (1, 1, 9.0, 1), (None, 1, 1.0, 1), (None, 1, 2.0, 1)], scores)
    assert sorted(r.score for r in state.upsert(spark.createDataFrame([], scores), new, ["user_id", "dish_id"], "at").collect()) == [2.0, 5.0]
