"""Rows on which queries or operators once gave something else than their SQL."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F

from larder import queries, queries_text  # noqa: F401  they register themselves
from larder.functions import schema_org, text, units
from larder.functions.urls import origin
from larder.operators import grocery, term_index
from larder.sources import feeds, reddit


def test_posts_of_the_boundary_second(spark, tmp_path):
    rows = [(i * 20 + 15, datetime(2024, 1, 5, 0, 0, 0, micros), i) for i, micros in enumerate((0, 1, 400_001, 999_999))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT event_id, ts::TIMESTAMP AS ts, user_id FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["S9S10F23_posts"]).select("id, permalink, score").fetchall()
    got = queries.QUERIES["S9S10F23_posts"](spark, str(tmp_path)).select("id", "permalink", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3


def test_created_at_keeps_microseconds(spark):
    body = '{"data":{"children":[{"data":{"id":"a","subreddit":"s","permalink":"/x","title":"t","created_utc":1704412800.400001}}]}}'
    page = spark.createDataFrame([(1, body)], "page int, body string")
    assert reddit.posts(page).select(F.unix_micros("created_at")).first()[0] == 1704412800400001


def test_references_without_semicolons(spark, tmp_path):
    pages = [(1, "<p>a &amp; b&amp</p>"), (2, "&amp &ampx; &copy &quot;&#189;&#xbd;&nosuch;&"), (3, None)]
    df = spark.createDataFrame(pages, "page_id long, html string")
    cleaned = lambda closed: [r[0] for r in df.orderBy("page_id").select(text.clean_text(F.col("html"), closed)).collect()]
    assert cleaned(True) == ["a & b&amp", '&amp &ampx; &copy "½½&nosuch;&', ""]
    assert cleaned(False)[:1] == ["a & b&"]  # as browsers, and the reference, read them
    df.where("page_id < 2").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["X15_clean_pages"]).fetchall()
    assert [tuple(r) for r in queries.QUERIES["X15_clean_pages"](spark, str(tmp_path)).select("page_id", "digest").collect()] == want


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_terms_are_ranked_once(spark):
    dishes = spark.range(50).selectExpr("id AS dish_id", "array('a', if(id % 2 = 0, 'b', 'c')) AS lexemes", "timestamp_seconds(id div 3) AS first_seen_at", "cast(NULL AS timestamp) AS published_at", "1.0D AS source_rating")
    index = term_index.build(dishes, 7)
    assert "Window" not in plan_of(index.postings) and "Window" not in plan_of(index.ranked)
    order = [r.dish_id for r in index.ranked.orderBy("place").collect()]
    assert order == list(range(49, -1, -1)) and index.segments > 3
    assert [r[0] for r in spark.createDataFrame([(1,), (2,), (None,), (9,)], "at long").select(term_index._bounds_above([2, 5], F.col("at"))).collect()] == [2, 2, 0, 0]


def test_durations_match_their_pattern_once(spark):
    texts = spark.createDataFrame([("PT1H30M",), ("P1W",), ("1 hour 20 mins",), ("PT0S",), ("pt1,5h",), ("-5",), ("soon",), (None,), ("90",)], "t string")
    df = texts.select(schema_org.duration_minutes(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [90, 10080, 80, None, 90, None, None, None, 90]
    assert plan_of(df).count(schema_org.DURATION) <= 2


def test_spellings_are_looked_up_once(spark):
    rows = spark.createDataFrame([(2.0, "Pounds"), (1.0, "C"), (3.0, None), (3.0, ""), (1.0, "smidgen"), (None, "g"), (2.0, " Tbsp. ")], "q double, u string")
    df = rows.select(units.to_base(F.col("q"), F.col("u")).alias("b"))
    got = [r.b and (round(r.b.qty, 4), r.b.unit, r.b.dimension) for r in df.collect()]
    assert got == [(907.1847, "g", "mass"), (236.5882, "ml", "volume"), (3.0, "each", "count"), (3.0, "each", "count"), None, None, (29.5735, "ml", "volume")]
    assert plan_of(df).count("kilograms") <= 2


def test_threads_are_read_in_one_go(spark):
    threads = spark.createDataFrame([("p", '[{},{"data":{"children":[{"kind":"more"},{"kind":"t1","data":{"id":"a","body":"x","score":1,"replies":{"data":{"children":[{"kind":"t1","data":{"id":"b","body":"y","replies":""}}]}}}}]}}]'), ("q", None), ("r", "[")], "post_id string, body string")
    rows = reddit.comments(threads)
    assert "Union" not in plan_of(rows)
    assert sorted((r.post_id, r.id, r.score, r.path) for r in rows.collect()) == [("p", "a", 1, [1]), ("p", "b", 0, [1, 0])]


def test_titles_of_a_bucket_a_line_each(spark):
    rows = spark.createDataFrame([(1, "k", "i", s, "soup", 1.0, "cup", 1.0, "cup", 1, 1, s, "n", "a", 1.0, False) for s in (2, 1)], "list_id int, key string, identity string, seq int, title string, amount double, canonical string, factor double, unit string, ingredient_id int, pick_order int, position int, display string, aisle string, qty double, optional boolean")
    assert [grocery.buckets(rows, repeated=r).first().titles for r in (True, False)] == [["soup", "soup"], ["soup"]]


def test_links_and_items_without_doubled_work(spark):
    links = spark.createDataFrame([("http://u@www.A.com:80/x",), ("HTTPS://www.x@b.com:443?q",), ("a@b//C/",), ("https://a.com:80#f",)], "u string").select(origin(F.col("u")).alias("o"))
    assert [r.o for r in links.collect()] == ["http://a.com", "https://b.com", "a@b//c", "https://a.com:80"]
    assert plan_of(links).count("([^/?#]+)") <= 2
    xml = "<rss><channel><item><link>/a</link><title>t</title></item><item><link> </link></item></channel></rss>"
    rows = feeds.xml_rows(spark.createDataFrame([("https://a.com/f", xml, 1), ("https://a.com/g", None, 2)], "url string, xml string, n int"))
    assert [tuple(r) for r in rows.select("url", "n", "item_url", "title", "ord").collect()] == [("https://a.com/f", 1, "https://a.com/a", "t", 0)]
    assert "MapInArrow" in plan_of(rows)
