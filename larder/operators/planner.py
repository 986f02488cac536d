"""Planner and rating state of many readers at once: each change is a function from tables to their next version."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.grocery import clamp_batches
from larder.vocab import MAX_IMPORT


def planner_state(saved: DataFrame, checks: DataFrame) -> DataFrame:
    """user_id with saved (dish -> batches) and checked (item keys) of each reader that has any."""
    a = saved.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("dish_id").cast("string").alias("k"), "batches")))).alias("saved"))  # one reader's
    b = checks.groupBy("user_id").agg(F.array_sort(F.collect_set("item_key")).alias("checked"))
    rows = a.join(b, "user_id", "full_outer")
    return rows.select("user_id", F.coalesce("saved", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))).alias("saved"), F.coalesce("checked", F.array().cast("array<string>")).alias("checked"))


def existing(ids: DataFrame, dishes: DataFrame) -> DataFrame:
    """The rows whose dish exists."""
    return ids.join(dishes.select("dish_id"), "dish_id", "left_semi")


def set_saved(saved: DataFrame, changes: DataFrame, dishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """saved after changes (user_id, dish_id, batches, saved_at), and each change's outcome: saved, removed or unknown-dish.

    Batches are clamped; an old pick keeps its saved_at; null batches remove a pick, also of a dish that is gone. Of
    several changes to a pick the last by saved_at counts.
    """
    last = changes.groupBy("user_id", "dish_id").agg(F.max_by(F.struct("batches", "saved_at"), F.struct("saved_at", "batches")).alias("c")).select("user_id", "dish_id", "c.*")
    known = dishes.select("dish_id").withColumn("known", F.lit(True))
    told = last.join(known, "dish_id", "left").withColumn("outcome", F.when(F.col("batches").isNull(), "removed").when(F.col("known"), "saved").otherwise("unknown-dish"))
    apply = told.where("outcome != 'unknown-dish'")
    added = apply.where("outcome = 'saved'").select("user_id", "dish_id", clamp_batches(F.col("batches")).alias("batches"), "saved_at")
    before = saved.select("user_id", "dish_id", F.col("saved_at").alias("before"))
    added = added.join(before, ["user_id", "dish_id"], "left").select("user_id", "dish_id", "batches", F.coalesce("before", "saved_at").alias("saved_at"))
    rest = saved.join(apply.select("user_id", "dish_id"), ["user_id", "dish_id"], "left_anti").select("user_id", "dish_id", "batches", "saved_at")
    return rest.union(added), told.select("user_id", "dish_id", "outcome")


def set_checks(checks: DataFrame, changes: DataFrame) -> DataFrame:
    """checks (user_id, item_key) after changes (user_id, item_key, checked): ticking twice is ticking once."""
    off = changes.where("NOT checked").select("user_id", "item_key")
    on = changes.where("checked").select("user_id", "item_key")
    return checks.select("user_id", "item_key").join(off, ["user_id", "item_key"], "left_anti").union(on).distinct()


def clear(rows: DataFrame, users: DataFrame) -> DataFrame:
    """rows without those of the readers in users (user_id): empties their picks or checks."""
    return rows.join(users.select("user_id"), "user_id", "left_anti")


@dataclass
class Imported:
    saved: DataFrame
    checks: DataFrame
    counts: DataFrame


def additions(stored: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """What local has and stored hasn't, by keys, once."""
    return local.dropDuplicates(keys).join(stored.select(keys), keys, "left_anti")


def import_state(saved: DataFrame, checks: DataFrame, local_saved: DataFrame, local_checks: DataFrame, dishes: DataFrame, at=None) -> Imported:
    """State after readers bring what they kept elsewhere: the account wins, nothing is lost, and a second time adds nothing.

    counts has user_id, saved_added, checked_added and skipped (picks of dishes that don't exist). Each reader may bring
    MAX_IMPORT picks and as many checks; one who brings more brings nothing.
    """
    limit = lambda df: df.join(df.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > MAX_IMPORT).select("user_id"), "user_id", "left_anti")
    wanted = additions(saved, limit(local_saved), ["user_id", "dish_id"])
    good = existing(wanted, dishes).select("user_id", "dish_id", clamp_batches(F.col("batches")).alias("batches"), F.lit(at).cast(saved.schema["saved_at"].dataType).alias("saved_at"))
    ticks = additions(checks, limit(local_checks), ["user_id", "item_key"]).select("user_id", "item_key")
    tally = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    counts = tally(wanted, "wanted").join(tally(good, "saved_added"), "user_id", "left").join(tally(ticks, "checked_added"), "user_id", "full_outer").na.fill(0)
    counts = counts.select("user_id", "saved_added", "checked_added", (F.col("wanted") - F.col("saved_added")).alias("skipped"))
    return Imported(saved.select("user_id", "dish_id", "batches", "saved_at").union(good), checks.select("user_id", "item_key").union(ticks), counts)


def add_logs(logs: DataFrame, new: DataFrame, dishes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """logs with the new ones of known dishes, and log_id and outcome of each new one: created or unknown-dish."""
    known = dishes.select("dish_id").withColumn("known", F.lit(True))
    told = new.join(known, "dish_id", "left").select("log_id", F.when(F.col("known"), "created").otherwise("unknown-dish").alias("outcome"))
    return logs.unionByName(existing(new, dishes).select(logs.columns)), told


def delete_logs(logs: DataFrame, asked: DataFrame) -> DataFrame:
    """logs without those asked for (log_id, user_id) by their owners; another's is left alone."""
    return logs.join(asked.select("log_id", "user_id"), ["log_id", "user_id"], "left_anti")
