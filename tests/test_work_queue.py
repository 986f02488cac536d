"""The queue of drafts: retries by time, stale and repeated answers, restarts and lost batches."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from larder.streaming import work_queue

T0 = datetime(2024, 5, 1)
EVENT = "url string, at timestamp, kind string, content_hash string, status string"


def e(url, minute, kind, h, status=None):
    return {"url": url, "at": (T0 + timedelta(minutes=minute)).isoformat(), "kind": kind, "content_hash": h, "status": status}


FILES = [
    [e("a", 0, "draft", "a1"), e("b", 0, "draft", "b1"), e("c", 1, "draft", "c1"), e("c", 1, "answer", "c1", "active"), e(None, 1, "draft", "x"), e("d", 1, "answer", "d1", "active"), e("d", 1, "odd", "d1")],
    [e("a", 10, "answer", "a0", "active"), e("a", 12, "answer", "a1", "rejected"), e("a", 13, "answer", "a1", "active"), e("b", 14, "draft", "b2"), e("c", 15, "draft", "c1"), e("b", 14, "draft", "b2")],
    [e("clock", 90, "draft", "k1"), e("clock", 90, "answer", "k1", "active")],  # b2 was due at 74 and is asked for again
    [e("a", 91, "draft", "a2"), e("b", 92, "answer", "b1", "active")],
    [e("clock", 160, "draft", "k1")],  # b2 is due at 134 for the last time, a2 asked for again
    [e("clock", 161, "draft", "k1"), e("b", 161, "draft", "b2"), e("a", 161, "answer", "a2", "active")],
]


@pytest.fixture
def run(spark, tmp_path):
    work_queue.use_store(spark)
    (tmp_path / "in").mkdir()

    def go(fail_at=None):
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")

        def keep(rows, batch):
            got = [(r.url, r.version, r.content_hash, r.event, r.tries, r.status, r.at.isoformat()) for r in rows.collect()]
            if batch == fail_at:
                raise RuntimeError("lost")
            (tmp_path / f"out-{batch}.json").write_text(json.dumps(got))

        query = work_queue.work(events, wait=timedelta(hours=1), most=2, late="5 minutes").writeStream.trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/checkpoint").foreachBatch(keep).start()
        if fail_at is None:
            assert query.awaitTermination(120)
        else:
            with pytest.raises(Exception, match="lost"):
                query.awaitTermination(120)
        return [tuple(r) for f in sorted(tmp_path.glob("out-*.json"), key=lambda f: int(f.stem[4:])) for r in json.loads(f.read_text())]

    return go


def test_outcomes_over_restarts_and_lost_batches(run, tmp_path):
    for k, rows in enumerate(FILES):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        if k == 1:
            run(fail_at=len(list(tmp_path.glob("out-*.json"))))
        got = run()
    of = lambda url: [(r[1], r[2], r[3], r[4], r[5]) for r in got if r[0] == url]
    assert of("a") == [
        (1, "a1", "task", 1, None), (1, "a0", "stale", 1, "active"), (1, "a1", "applied", 1, "rejected"), (1, "a1", "repeated", 1, "active"),
        (2, "a2", "task", 1, None), (2, "a2", "task", 2, None), (2, "a2", "applied", 2, "active"),
    ]
    assert of("b") == [
        (1, "b1", "task", 1, None), (1, "b1", "superseded", 1, None), (2, "b2", "task", 1, None), (2, "b2", "touched", 1, "pending"), (2, "b2", "task", 2, None),
        (2, "b1", "stale", 2, "active"), (2, "b2", "failed", 2, None), (3, "b2", "task", 1, None),
    ]
    assert of("c") == [(1, "c1", "task", 1, None), (1, "c1", "applied", 1, "active"), (1, "c1", "touched", 1, "active")]
    assert of("d") == [(0, "d1", "stale", 0, "active")] and not of(None)
    ends = Counter((r[0], r[1]) for r in got if r[3] in ("applied", "superseded", "failed"))
    assert max(ends.values()) == 1


def test_a_table_of_events(spark):
    work_queue.use_store(spark)
    rows = [(r["url"], datetime.fromisoformat(r["at"]), r["kind"], r["content_hash"], r["status"]) for f in FILES for r in f]
    got = work_queue.work(spark.createDataFrame(rows, EVENT)).collect()
    assert [(r.version, r.event) for r in got if r.url == "b"] == [(1, "task"), (1, "superseded"), (2, "task"), (2, "touched"), (2, "stale"), (2, "touched")]
    assert work_queue.work(spark.createDataFrame([], EVENT)).isEmpty()


def test_a_table_of_many_events_as_the_state_has_them(spark):
    """Windows give what the stateful processor gives, in whatever order of drafts and answers, and no Python runs."""
    work_queue.use_store(spark)
    rng = random.Random(3)
    rows = [(f"u{rng.randrange(150)}", T0 + timedelta(minutes=rng.randrange(12)), *rng.choice([("draft", rng.choice("xyz"), None), ("answer", rng.choice("xyz"), rng.choice(["active", "rejected"]))])) for _ in range(2500)]
    events = spark.createDataFrame(rows, EVENT)
    want = events.groupBy("url").transformWithState(work_queue.Queue(None, 3), work_queue.OUT, "Append", "None")
    got = work_queue.work(events)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().toString() and "TransformWithState" not in got._jdf.queryExecution().toString()
