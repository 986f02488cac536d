"""Readable rules from ratings, and the filter they make."""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.fmt import half_up
from larder.vocab import DISLIKE_MEDIAN, MIN_OBSERVATIONS, TIME_LADDER


def observations(cooked: DataFrame) -> DataFrame:
    """user_id, kind, value and rating of each observation in cooked (user_id, rating, total_minutes, category, tags).

    A cook counts in every time bucket that its minutes exceed, in its category and in each of its tags.
    """
    over = F.transform(F.array(*(F.lit(t) for t in TIME_LADDER)), lambda t: F.when(F.col("total_minutes") > t, F.struct(F.lit("max_minutes").alias("kind"), t.cast("string").alias("value"))))
    category = F.array(F.when(F.col("category").isNotNull(), F.struct(F.lit("exclude_category").alias("kind"), F.col("category").alias("value"))))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.struct(F.lit("exclude_tag").alias("kind"), t.alias("value")))
    return cooked.select("user_id", "rating", F.explode(F.array_compact(F.concat(over, category, tags))).alias("o")).select("user_id", "o.kind", "o.value", "rating")


def cooked(logs: DataFrame, dishes: DataFrame) -> DataFrame:
    """user_id, rating, total_minutes, category and tags of each cook log (user_id, dish_id, rating) of a dish that is there; logs of other dishes, or of none, drop out."""
    return logs.select("user_id", "dish_id", "rating").join(dishes.select("dish_id", "total_minutes", "category", "tags"), "dish_id").drop("dish_id")


def derive_rules(observed: DataFrame) -> DataFrame:
    """Rules with enough observations and a low median: of the time rules the largest bucket, all of the exclusions."""
    return rules_of(observed.groupBy("user_id", "kind", "value").agg(F.count("rating").alias("observations"), F.median("rating").alias("m")))


def rules_of(groups: DataFrame) -> DataFrame:
    """derive_rules of user_id, kind, value, the number of observations and their median m."""
    groups = groups.where((F.col("observations") >= MIN_OBSERVATIONS) & (F.col("m") <= DISLIKE_MEDIAN)).withColumn("median_rating", half_up(F.col("m"), 1)).drop("m")
    times = groups.where("kind = 'max_minutes'").groupBy("user_id", "kind").agg(F.max_by(F.struct("value", "observations", "median_rating"), F.col("value").cast("int")).alias("r")).select("user_id", "kind", "r.*")
    rules = times.unionByName(groups.where("kind != 'max_minutes'"))
    return rules.select("user_id", F.concat_ws(":", "kind", "value").alias("rule_id"), "kind", "value", "observations", "median_rating")


def merge_rules(before: DataFrame, derived: DataFrame) -> DataFrame:
    """Derived rules, disabled where they were disabled, and disabled ones whose evidence is gone."""
    b, d = before.alias("b"), derived.withColumn("enabled", F.lit(True)).alias("d")
    rows = d.join(b, ["user_id", "rule_id"], "full_outer")
    keep = F.col("d.kind").isNotNull() | ~F.col("b.enabled")
    pick = lambda c: F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")).alias(c)
    return rows.where(keep).select("user_id", "rule_id", *(pick(c) for c in ("kind", "value", "observations", "median_rating")), F.coalesce("b.enabled", F.lit(True)).alias("enabled"))


def _minutes(value) -> float | None:
    """The number that a rule's text is; an empty one is zero, and what is none, null."""
    text = str(value).strip()
    try:
        number = float(text) if text else 0.0
    except ValueError:
        return None
    return number if isfinite(number) and "_" not in text else None


def rule_filter(rules: list[dict]) -> Column:
    """What one user's enabled rules let through; an unknown column passes, minutes that are no number are no rule."""
    out = F.lit(True)
    for r in rules:
        if not r["enabled"]:
            continue
        if r["kind"] == "max_minutes":
            if (most := _minutes(r["value"])) is not None:
                out &= F.col("total_minutes").isNull() | (F.col("total_minutes") <= most)
        elif r["kind"] == "exclude_category":
            out &= F.col("category").isNull() | (F.col("category") != r["value"])
        elif r["kind"] == "exclude_tag":
            out &= ~F.coalesce(F.array_contains("tags", r["value"]), F.lit(False))
    return out


RULE = "struct<id:string,kind:string,value:string,enabled:boolean,observations:int,medianRating:double>"
RULE_KINDS = ("max_minutes", "exclude_category", "exclude_tag")


def parse_rules(stored: Column) -> Column:
    """The sound rules of a stored JSON array; each that isn't is left out by itself, and a text that is no array has none."""
    each = F.transform(F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>")), lambda r: F.from_json(r, RULE))
    sound = lambda r: (F.length(r["id"]) > 0) & r["kind"].isin(*RULE_KINDS) & (F.length(r["value"]) > 0) & r["enabled"].isNotNull() & (r["observations"] >= 0) & r["medianRating"].between(0, 5)
    return F.filter(each, lambda r: F.coalesce(sound(r), F.lit(False)))


def preferences(users: DataFrame, stored: DataFrame) -> DataFrame:
    """user_id, rules and profile of each user; stored (user_id, hard_rules, profile) may lack a user, who then has no rules and no profile. A blank profile is none."""
    rows = users.select("user_id").join(stored.select("user_id", "hard_rules", "profile"), "user_id", "left")
    return rows.select("user_id", parse_rules(F.col("hard_rules")).alias("rules"), F.when(F.trim("profile") != "", F.col("profile")).alias("profile"))


def set_rule_enabled(prefs: DataFrame, changes: DataFrame) -> DataFrame:
    """user_id, rules and outcome after switches (user_id, rule_id, enabled), one per user: ok, unknown-rule or kept."""
    rows = prefs.join(changes, "user_id", "left")
    known = F.exists("rules", lambda r: r["id"] == F.col("rule_id"))
    switched = F.transform("rules", lambda r: F.when(r["id"] == F.col("rule_id"), r.withField("enabled", F.col("enabled"))).otherwise(r))
    outcome = F.when(F.col("rule_id").isNull(), "kept").when(known, "ok").otherwise("unknown-rule")
    return rows.select("user_id", F.when(outcome == "ok", switched).otherwise(F.col("rules")).alias("rules"), outcome.alias("outcome"))
