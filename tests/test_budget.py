"""Answers to a stream of calls: as one after the other would get them, and the same when a batch runs again."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from larder.streaming import budget

CALL = "call_id long, kind string, at timestamp, cost double"
LIMITS = {"search": 1.0, "scan": 2.5}


def plain(batches):
    spent, out = {}, {}
    for batch in batches:
        for i, kind, at, cost in sorted((c for c in batch if c[1] and c[2]), key=lambda c: (c[2], c[0])):
            day = (kind, at[:10])
            out[i] = kind not in LIMITS or spent.get(day, Decimal(0)) < Decimal(str(LIMITS[kind]))
            if out[i]:
                spent[day] = spent.get(day, Decimal(0)) + max(Decimal(str(cost or 0)), Decimal(0))
        out |= {c[0]: False for c in batch if not c[1] or not c[2]}
    return out, spent


def test_a_stream_of_calls(spark, tmp_path, monkeypatch):
    pick = random.Random(4)
    at = lambda: (datetime(2024, 5, 1) + timedelta(minutes=pick.randint(0, 3000))).isoformat()
    batches = [[(b * 1000 + i, pick.choice(["search", "search", "scan", "free", None]), at() if pick.random() < 0.97 else None, pick.choice([0.01, 0.02, 0.05, 0.1, None, -1.0])) for i in range(90)] for b in range(3)]
    (tmp_path / "in").mkdir()

    def go():
        calls = spark.readStream.schema(CALL).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        return budget.answer(calls, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", LIMITS)

    for b, rows in enumerate(batches):
        (tmp_path / "in" / f"{b}.json").write_text("\n".join(json.dumps(dict(zip(("call_id", "kind", "at", "cost"), r, strict=True))) for r in rows))
        if b == 1:  # the answers are written, what is spent is not
            with monkeypatch.context() as m:
                m.setattr(budget, "add_spent", lambda *_: 1 / 0)
                with pytest.raises(Exception, match="division"):
                    go().awaitTermination(120)
        assert go().awaitTermination(120)
    want, spent = plain(batches)
    got = spark.read.parquet(f"file://{tmp_path}/out/answers").collect()
    assert len(got) == 270 and {r.call_id: r.allowed for r in got} == want and not all(want.values())
    kept = budget.spent_until(spark, f"file://{tmp_path}/out", 3)
    assert {(r.kind, r.day.isoformat()): r.spent for r in kept.collect()} == spent
    day = datetime(2024, 5, 1).date()
    assert [budget.open_on(kept, day, k, LIMITS).first().open for k in ("search", "free")] == [spent["search", "2024-05-01"] < 1, True]
    assert budget.open_on(budget.nothing_spent(spark), day, "search", LIMITS).first().open


def test_no_calls(spark):
    none = spark.createDataFrame([], CALL)
    assert budget.gate(budget.nothing_spent(spark), none).isEmpty() and budget.add_spent(budget.nothing_spent(spark), none.selectExpr("*", "true AS allowed")).isEmpty()
