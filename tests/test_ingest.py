from datetime import datetime

import pytest
from pyspark.sql import functions as F

from larder.functions.urls import canonical_url
from larder.operators import runs
from larder.sources.pages import discover
from larder.streaming.ingest import DRAFT, apply_batch, current, ingest

ITEM = "url string, published_at timestamp, title string, ord int"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://www.A.com/x/?b=1&a=2&utm_medium=m#f", "https://a.com/x?a=2&b=1"),
        ("https://a.com/", "https://a.com/"),
        ("http://a.com:80?UTM_Source=x&Ref=y", "https://a.com/"),
        ("https://WWW.a.com:443/b?fbclidX=1&refer=2", "https://a.com/b?refer=2"),
        ("http://a.com:8080/b//", "https://a.com:8080/b"),
        ("https://a.com/X?b=2&b=1&gclid=3", "https://a.com/X?b=2&b=1"),
        ("not a url", "not a url"),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u"))).first()[0] == want


def test_discover(spark):
    day = lambda n: datetime(2024, 1, n)
    feed = spark.createDataFrame([("http://a.com/1", None, None, 0), ("https://www.a.com/1/", day(5), "one", 1), ("https://a.com/2", day(2), "two", 2), ("https://a.com/3", None, None, 3), (None, day(9), "none", 4)], ITEM)
    none = spark.createDataFrame([], ITEM)
    got = discover(feed, none, day(3)).collect()
    assert [(r["url"], r["title"]) for r in got] == [("http://a.com/1", "one"), ("https://a.com/3", None)]
    assert discover(none, feed, None, 2).count() == 2 and discover(none, none).count() == 0


def test_rollup(spark):
    schema = "status string, found int, new int, started_at timestamp, finished_at timestamp"
    status = lambda *s: runs.rollup(spark.createDataFrame([(x, 1, 1, datetime(2024, 1, 1), None) for x in s], schema)).first()["status"]
    assert [status(), status(None), status("running", "error"), status("success", None), status("error", "error"), status("error", "success"), status("success")] == ["idle", "idle", "running", "partial", "error", "partial", "success"]


def test_ingest_once(spark, tmp_path):
    drafts, state, checkpoint = f"{tmp_path}/drafts", f"{tmp_path}/state", f"{tmp_path}/checkpoint"
    put = lambda *rows: spark.createDataFrame(rows, DRAFT).coalesce(1).write.mode("append").parquet(drafts)
    at = lambda n: datetime(2024, 1, n)
    seen = lambda: {r["source_url"]: (r["content_hash"], r["title"], r["status"], r["first_seen_at"].day, r["last_seen_at"].day) for r in current(spark, state).collect()}
    put(("http://a.com/1/", "h1", "one", at(1)), ("https://www.a.com/1", "h2", "one again", at(2)), ("https://a.com/2", "x", "two", at(1)), (None, "y", "none", at(1)))
    ingest(spark, drafts, state, checkpoint).awaitTermination()
    assert seen() == {"https://a.com/1": ("h2", "one again", "pending", 2, 2), "https://a.com/2": ("x", "two", "pending", 1, 1)}
    put(("https://a.com/2", "x", "ignored", at(3)), ("https://a.com/3", "z", "three", at(3)))
    ingest(spark, drafts, state, checkpoint).awaitTermination()
    want = seen()
    assert want["https://a.com/2"] == ("x", "two", "pending", 1, 3) and len(want) == 3
    ingest(spark, drafts, state, checkpoint).awaitTermination()  # nothing new
    again = spark.createDataFrame([("https://a.com/2", "x", "ignored", at(3)), ("https://a.com/3", "z", "three", at(3))], DRAFT)
    apply_batch(again, 1, state)  # the batch comes again
    assert seen() == want
