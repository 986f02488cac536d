"""Runs of scans and searches: their life, what they cost, the latest per source, and one status over all of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.vocab import BUDGET_GATE, DAY_BUDGET

COUNTERS = ("tokens_in", "tokens_out", "cost")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each source by (started_at, run_id); runs without a source count as one source."""
    row = F.struct(*runs.columns)
    return runs.groupBy("source_id").agg(F.max_by(row, F.struct("started_at", "run_id")).alias("r")).select("r.*")


def rollup(latest: DataFrame) -> DataFrame:
    """One row: status over the latest runs, their sums, and the last activity. Sources that never ran make coverage partial.

    latest has status (null where a source never ran), found, new, started_at and finished_at. No rows give idle.
    """
    is_ = lambda *s: F.coalesce(F.col("status").isin(*s), F.lit(False))
    ran = F.count("status")
    status = (
        F.when(F.count_if(is_("running")) > 0, "running").when(ran == 0, "idle").when(ran < F.count("*"), "partial")
        .when(F.count_if(is_("error")) == ran, "error").when(F.count_if(is_("error", "partial")) > 0, "partial").otherwise("success")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return latest.agg(status.alias("status"), total("found"), total("new"), F.max(F.coalesce("finished_at", "started_at")).alias("latest"))


def day_start(at: Column) -> Column:
    """The start of the day of a time; sessions run in UTC."""
    return F.date_trunc("day", at)


def daily_usage(runs: DataFrame) -> DataFrame:
    """kind, day, tokens_in, tokens_out, cost of the runs that started on each day, and open: whether the day's budget of the kind has some left."""
    rows = runs.groupBy("kind", day_start(F.col("started_at")).alias("day")).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))
    budget = F.create_map(*(F.lit(x) for kv in DAY_BUDGET.items() for x in kv))
    return rows.withColumn("open", F.col("cost") < F.element_at(budget, F.col("kind")))


def search_open(usage: DataFrame) -> DataFrame:
    """day and available: searches are offered while the day's cost is under BUDGET_GATE of the budget."""
    return usage.where("kind = 'search'").select("day", (F.col("cost") < BUDGET_GATE * DAY_BUDGET["search"]).alias("available"))


def usage_cost(tokens_in: Column, cached: Column, tokens_out: Column, reported: Column, prices: tuple[float, float, float]) -> Column:
    """What a call cost: as the provider reports it, else by prices a million tokens (in, cached in, out). Cached ones are part of those in."""
    part = F.least(cached, tokens_in)
    estimate = ((tokens_in - part) * prices[0] + part * prices[1] + tokens_out * prices[2]) / 1_000_000
    return F.coalesce(F.when(reported >= 0, reported), estimate)


def record_usage(runs: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """runs with the calls (run_id, kind and COUNTERS) added up, and the calls that name no run of their kind."""
    keys = ["run_id", "kind"]
    added = calls.groupBy(*keys).agg(*(F.sum(c).alias(f"more_{c}") for c in COUNTERS))
    rows = runs.join(added, keys, "left")
    new = {c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in COUNTERS}
    return rows.select(*(new.get(c, F.col(c)) for c in runs.columns)), calls.join(runs.select(keys), keys, "left_anti")


def finish_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """runs after those in done (run_id, status, finished_at, found, new, COUNTERS) ended. Counters never go back: the larger value stays."""
    rows = runs.alias("r").join(done.withColumn("ended", F.lit(True)).alias("d"), "run_id", "left")
    pick = lambda c: F.greatest(f"r.{c}", f"d.{c}") if c in COUNTERS else F.when(F.col("d.ended"), F.col(f"d.{c}")).otherwise(F.col(f"r.{c}"))
    return rows.select("run_id", *((pick(c) if c in done.columns else F.col(f"r.{c}")).alias(c) for c in runs.columns if c != "run_id"))


def begin_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs with those of new (run_id, source_id, kind, started_at) as running, all counts zero; ids that exist are not begun again."""
    zero = [c for c in runs.columns if c in (*COUNTERS, "found", "new", "no_recipe")]
    fixed = {"status": F.lit("running"), "finished_at": F.lit(None)} | {c: F.lit(0) for c in zero}
    fresh = new.join(runs.select("run_id"), "run_id", "left_anti")
    return runs.unionByName(fresh.select(*(fixed.get(c, F.col(c)).cast(runs.schema[c].dataType).alias(c) for c in runs.columns)))


def search_days(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """The one search run of each day with calls (at): started by the day's first, ended by its last, never earlier than it was. runs may hold some."""
    stored = runs.where("kind = 'search'").groupBy(day_start(F.col("started_at")).alias("day")).agg(F.min("started_at").alias("a"), F.max("finished_at").alias("b"))
    called = calls.groupBy(day_start(F.col("at")).alias("day")).agg(F.min("at").alias("c"), F.max("at").alias("d"))
    rows = stored.join(called, "day", "full_outer")
    return rows.select("day", F.coalesce("a", "c").alias("started_at"), F.greatest("b", "d").alias("finished_at"), F.lit("success").alias("status"))


def finish_sources(sources: DataFrame, done: DataFrame) -> DataFrame:
    """sources after scans (source_id, started_at, discovered, retry, feed_etag, feed_last_modified): the boundary moves to the start of a clean scan.

    A scan to be retried forgets the feed's validators and keeps the boundary, so its pages come again; one that
    discovered nothing changes nothing. A truncated listing counts as one to be retried.
    """
    rows = sources.alias("s").join(done.alias("d"), "source_id", "left")
    seen = F.coalesce("d.discovered", F.lit(False))
    clean, again = seen & ~F.col("d.retry"), seen & F.col("d.retry")
    new = {"last_scanned_at": F.when(clean, F.col("d.started_at")).otherwise(F.col("s.last_scanned_at"))}
    for c in ("feed_etag", "feed_last_modified"):
        new[c] = F.when(clean, F.coalesce(f"d.{c}", f"s.{c}")).when(~again, F.col(f"s.{c}"))
    return rows.select("source_id", *(new.get(c, F.col(f"s.{c}")).alias(c) for c in sources.columns if c != "source_id"))


def needs_first_scan(runs: DataFrame) -> DataFrame:
    """One row: wanted, true until a scan has ended as success or partial. Searches don't count."""
    done = (F.col("kind") == "scan") & F.col("status").isin("success", "partial")
    return runs.agg((F.count_if(done) == 0).alias("wanted"))


def merged_summary(*summaries: DataFrame) -> DataFrame:
    """One row of sums over scan summaries (sources, found, new, no_recipe, tokens_in, tokens_out, cost, errors) of several crawlers."""
    rows = summaries[0]
    for s in summaries[1:]:
        rows = rows.unionByName(s)
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows.columns))


def recent_runs(runs: DataFrame, sources: DataFrame, n: int = 24) -> DataFrame:
    """The latest n runs with the name to show: "Search", the source's, or "All sources"."""
    label = F.when(F.col("kind") == "search", "Search").otherwise(F.coalesce("name", F.lit("All sources")))
    top = runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(n)
    return top.join(sources.select("source_id", "name"), "source_id", "left").withColumn("source_name", label).drop("name")


def source_health(enabled: Column, status: Column) -> Column:
    """A word for each source, from its latest run."""
    named = F.when(status == "running", "Scanning").when(status == "success", "Healthy").when(status == "partial", "Needs review").otherwise("Failed")
    return F.when(~enabled, "Disabled").when(status.isNull(), "Awaiting first scan").otherwise(named)


def source_snapshot(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source with its latest run's status, counts, times and health, enabled ones first, then by name."""
    latest = latest_runs(runs.where("source_id IS NOT NULL")).select("source_id", "run_id", "status", "found", "new", "started_at", "finished_at")
    rows = sources.join(latest, "source_id", "left").withColumn("health", source_health(F.col("enabled"), F.col("status")))
    return rows.orderBy(F.col("enabled").desc(), "name")


def ops_snapshot(dishes: DataFrame, sources: DataFrame, runs: DataFrame, at: datetime) -> dict[str, DataFrame]:
    """The state of the works: totals, usage today, roll-up of the enabled sources, sources and recent runs."""
    status = F.col("status")
    totals = dishes.agg(F.count("*").alias("dishes"), *(F.count_if(status == s).alias(s) for s in ("active", "pending", "rejected")))
    totals = totals.join(sources.agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled_sources")))  # two rows of one
    today = runs.where(F.col("started_at") >= day_start(F.lit(at))).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS))
    snapshot = source_snapshot(sources, runs)
    return {"totals": totals, "today": today, "latest": rollup(snapshot.where("enabled")), "sources": snapshot, "recent": recent_runs(runs, sources)}
