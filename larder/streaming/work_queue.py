"""Drafts that wait for an answer, as state by URL: asked again when none comes, and answers to what has changed refused.

Events are url, at, kind, content_hash and status: a `draft` was seen with this hash, or an `answer` to the draft with
this hash gives its status. What comes out, in the order in which it happens to a URL:

task        the draft is to be worked on; tries tells how often it was asked for, status is null
touched     the same draft was seen again
applied     the answer fits the draft that waits, which has its status now
superseded  the draft changed before an answer came
failed      nobody answered in `most` tries
stale       an answer to another draft than that of the URL, which changes nothing
repeated    a further answer to a draft that has its outcome

Drafts of a URL are numbered by version; each has one of applied, superseded and failed in the end, and never two.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

OUT = "url string, version long, content_hash string, event string, tries int, status string, at timestamp"
Out = Row("url", "version", "content_hash", "event", "tries", "status", "at")
_STATE = "version long, content_hash string, status string, tries int"
PENDING, FAILED = "pending", "failed"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _order(e: Row) -> tuple:
    """By time; of one time drafts first, so that an answer finds what it answers."""
    return e.at, e.kind != "draft", e.content_hash, e.status or ""


class Queue(StatefulProcessor):
    """wait None: no one is asked twice."""

    def __init__(self, wait: timedelta | None, most: int):
        self.wait, self.most = wait, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def _stop_waiting(self) -> None:
        if self.wait is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def _ask(self, now: datetime, version: int, content_hash: str, tries: int, watermark: int) -> None:
        self.held.update((version, content_hash, PENDING, tries))
        if self.wait is not None:
            self._stop_waiting()
            due = int((now.replace(tzinfo=UTC) if now.tzinfo is None else now).timestamp() * 1000) + int(self.wait.total_seconds() * 1000)
            self.handle.registerTimer(max(due, watermark + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        url = key[0]
        watermark = timerValues.getCurrentWatermarkInMs() if self.wait is not None else 0
        for e in sorted(rows, key=_order):
            version, held, status, tries = self.held.get() if self.held.exists() else (0, None, None, 0)
            if e.kind == "draft":
                if held == e.content_hash and status != FAILED:
                    yield Out(url, version, held, "touched", tries, status, e.at)
                    continue
                if status == PENDING:
                    yield Out(url, version, held, "superseded", tries, None, e.at)
                self._ask(e.at, version + 1, e.content_hash, 1, watermark)
                yield Out(url, version + 1, e.content_hash, "task", 1, None, e.at)
            elif held != e.content_hash:
                yield Out(url, version, e.content_hash, "stale", tries, e.status, e.at)
            elif status != PENDING:
                yield Out(url, version, held, "repeated", tries, e.status, e.at)
            else:
                self._stop_waiting()
                self.held.update((version, held, e.status, tries))
                yield Out(url, version, held, "applied", tries, e.status, e.at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        version, held, status, tries = self.held.get()
        now = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, UTC).replace(tzinfo=None)
        if status != PENDING:
            return
        if tries < self.most:
            self._ask(now, version, held, tries + 1, timerValues.getCurrentWatermarkInMs())
            yield Out(key[0], version, held, "task", tries + 1, None, now)
        else:
            self.held.update((version, held, FAILED, tries))
            yield Out(key[0], version, held, "failed", tries, None, now)

    def close(self) -> None:
        pass


def use_store(spark: SparkSession) -> None:
    """State with timers needs the store that keeps it on disk; set it before a query begins, and for good."""
    spark.streams.active  # noqa: B018  a table's state, too, needs what tells executors where states are, which begins with this
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def of_table(rows: DataFrame) -> DataFrame:
    """What comes out of a table of events, as Queue gives it where no one is asked twice: a URL's events are sorted by Spark, which may spill.

    A URL's hash is that of the draft before, so each draft with another hash begins a version; the first answer of a
    version that fits is applied.
    """
    url = Window.partitionBy("url").orderBy("at", F.col("kind") != "draft", "content_hash", F.coalesce("status", F.lit("")))
    before, until = url.rowsBetween(Window.unboundedPreceding, -1), url.rowsBetween(Window.unboundedPreceding, 0)
    draft = F.col("kind") == "draft"
    held = rows.withColumn("held", F.last(F.when(draft, F.col("content_hash")), ignorenulls=True).over(before))
    same = F.col("held").eqNullSafe(F.col("content_hash"))
    held = held.withColumn("begins", draft & ~same).withColumn("fits", ~draft & same)
    held = held.withColumn("version", F.count_if("begins").over(until)).withColumn("earlier", F.count_if("begins").over(before))
    # What was applied last: to the version in which it was, whose answers come before the draft that begins the next.
    held = held.withColumn("answered", F.last(F.when(F.col("fits"), F.col("earlier")), ignorenulls=True).over(before))
    pending = ~F.col("answered").eqNullSafe(F.col("earlier"))
    first = F.when(F.col("fits") & pending, F.struct(F.col("status"))).alias("first")
    told = held.select("*", pending.alias("pending"), first).withColumn("outcome", F.last("first", ignorenulls=True).over(before))
    out = lambda version, content_hash, event, tries, status: F.struct(version.alias("version"), content_hash.alias("content_hash"), F.lit(event).alias("event"), tries.cast("int").alias("tries"), status.cast("string").alias("status"))
    version, earlier, own, one, status = F.col("version"), F.col("earlier"), F.col("content_hash"), F.lit(1), F.col("status")
    task, superseded = out(version, own, "task", one, F.lit(None)), out(earlier, F.col("held"), "superseded", one, F.lit(None))
    made = (
        F.when(F.col("begins") & F.col("held").isNotNull() & F.col("pending"), F.array(superseded, task)).when(F.col("begins"), F.array(task))
        .when(draft, F.array(out(version, own, "touched", one, F.when(F.col("pending"), F.lit(PENDING)).otherwise(F.col("outcome.status")))))
        .when(~F.col("fits"), F.array(out(version, own, "stale", F.when(F.col("held").isNull(), 0).otherwise(1), status)))
        .when(F.col("pending"), F.array(out(version, own, "applied", one, status))).otherwise(F.array(out(version, own, "repeated", one, status)))
    )
    return told.select("url", F.inline(made), "at").select("url", "version", "content_hash", "event", "tries", "status", "at")


def work(events: DataFrame, wait: timedelta = timedelta(hours=1), most: int = 3, late: str = "10 minutes") -> DataFrame:
    """What comes out of a stream of events, see above; call use_store first.

    Time is that of the events: a task is asked for again when events `wait` later than it have come, and `late` more. An
    event that comes later than that is dropped by the watermark, so an answer lost so is asked for again. Of a table
    instead of a stream everything is known, so nothing is asked for twice, and windows say what the state would. Events without url, at, content_hash or a
    known kind, and answers without a status, are left out. The events of one URL in one micro-batch are sorted in its
    task's memory: the source's options bound them (maxFilesPerTrigger, maxBytesPerTrigger).
    """
    known = (F.col("kind") == "draft") | ((F.col("kind") == "answer") & F.col("status").isNotNull() & ~F.col("status").isin(PENDING, FAILED))
    rows = events.select("url", F.col("at").cast("timestamp").alias("at"), "kind", "content_hash", "status").where(known).where("url IS NOT NULL AND at IS NOT NULL AND content_hash IS NOT NULL")
    if not events.isStreaming:
        return of_table(rows)
    return rows.withWatermark("at", late).groupBy("url").transformWithState(Queue(wait, most), OUT, "Append", "EventTime")
