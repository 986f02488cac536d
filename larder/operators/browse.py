"""The pages of the catalogue: the list of dishes, one dish, share links, what needs work, and health."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.rules import rule_filter
from larder.operators.search import browse_order, clamp_limit

#: What a list shows of a dish: never its steps, lines, hashes or validators.
SUMMARY = (
    "dish_id", "slug", "share_code", "title", "blurb", "category", "tags", "total_minutes", "active_minutes", "servings", "keeps_days", "freezer_months",
    "image_path", "image_w", "image_h", "image_source_url", "source_name", "source_url", "author", "source_rating", "source_rating_count", "status",
    "published_at", "first_seen_at", "last_seen_at", "score", "score_reason",
)
CODE = "[0-9a-hjkmnp-tv-z]{8}"


def with_source_and_score(dishes: DataFrame, sources: DataFrame, scores: DataFrame, user_id: int | str | None) -> DataFrame:
    """Dishes of known sources with source_name, and one reader's score and score_reason; without a reader these are null."""
    rows = dishes.join(sources.select("source_id", F.col("name").alias("source_name")), "source_id")
    if user_id is None:
        return rows.withColumn("score", F.lit(None).cast("float")).withColumn("score_reason", F.lit(None).cast("string"))
    own = scores.where(F.col("user_id") == user_id).select("dish_id", "score", F.col("reason").alias("score_reason"))
    return rows.join(own, "dish_id", "left")


def list_dishes(dishes: DataFrame, sources: DataFrame, scores: DataFrame, user_id=None, status: str | None = "active", since: datetime | None = None, rules: Sequence[dict] = (), limit: int | None = None) -> DataFrame:
    """The columns of SUMMARY, best first. status None takes all; since leaves what was seen later; rules hide dishes. A top-k, not a sort."""
    rows = with_source_and_score(dishes, sources, scores, user_id).where(rule_filter(list(rules)))
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if since is not None:
        rows = rows.where(F.col("last_seen_at") > F.lit(since))
    return rows.select(*SUMMARY).orderBy(*browse_order()).limit(clamp_limit(limit))


def dish_detail(dishes: DataFrame, sources: DataFrame, scores: DataFrame, lines: DataFrame, ingredients: DataFrame, wanted: Column, user_id=None, status: str | None = "active") -> DataFrame:
    """SUMMARY, instructions and the ordered lines of the dishes that `wanted` holds for; a dish without lines has an empty list."""
    rows = with_source_and_score(dishes.where(wanted), sources, scores, user_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    own = lines.join(rows.select("dish_id"), "dish_id", "left_semi").join(ingredients.select("ingredient_id", "name", "aisle"), "ingredient_id", "left")
    line = F.struct("position", "raw_text", "ingredient_id", "name", "aisle", "qty", "unit", "note", "optional")
    own = own.groupBy("dish_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # one dish's
    rows = rows.join(own, "dish_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast(own.schema["lines"].dataType)))
    steps = [c for c in ("instructions",) if c in dishes.columns]
    return rows.select(*SUMMARY, *steps, "lines")


def handle(slug: Column, code: Column) -> Column:
    """slug-code, or the code alone where the slug is empty."""
    bare = F.regexp_replace(F.trim(slug), "^-+|-+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", code).otherwise(F.concat(bare, F.lit("-"), code))


def share_path(slug: Column, code: Column) -> Column:
    return F.concat(F.lit("/r/"), handle(slug, code))


def share_url(origin: Column, slug: Column, code: Column) -> Column:
    return F.concat(F.regexp_replace(origin, "/+$", ""), share_path(slug, code))


def handle_code(text: Column) -> Column:
    """The code that a handle ends with; null for what is no handle."""
    bare = F.lower(F.regexp_replace(F.trim(text), "^/+|/+$", ""))
    return F.nullif(F.regexp_extract(bare, f"(?:^|-)({CODE})$", 1), F.lit(""))


def by_handle(dishes: DataFrame, sources: DataFrame, scores: DataFrame, handles: DataFrame, user_id=None) -> DataFrame:
    """handle and SUMMARY of the active dishes that handles (handle) name; others find nothing."""
    asked = handles.select("handle", handle_code(F.col("handle")).alias("share_code")).where("share_code IS NOT NULL")
    rows = with_source_and_score(dishes.where("status = 'active'"), sources, scores, user_id)
    return asked.join(rows, "share_code").select("handle", *SUMMARY)


def vocabulary(dishes: DataFrame, lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """name of each ingredient that an active dish uses, once."""
    used = lines.join(dishes.where("status = 'active'").select("dish_id"), "dish_id", "left_semi").select("ingredient_id").distinct()
    return ingredients.join(used, "ingredient_id", "left_semi").select("name").distinct()


def next_pending(dishes: DataFrame, n: int = 1) -> DataFrame:
    """The pending dishes that were seen first."""
    return dishes.where("status = 'pending'").orderBy("first_seen_at", "dish_id").limit(n)


def unmapped_lines(lines: DataFrame, limit: int) -> DataFrame:
    """Lines without an ingredient by dish and position, 10,000 at most."""
    if not 1 <= limit <= 10_000:
        raise ValueError("limit must be between 1 and 10000")
    return lines.where("ingredient_id IS NULL").select("dish_id", "position", "raw_text").orderBy("dish_id", "position").limit(limit)


def first_names(names: DataFrame, n: int = 40) -> DataFrame:
    """The first n distinct names in order, with place: the next batch to be mapped."""
    return names.select("name").where("name IS NOT NULL").distinct().orderBy("name").limit(n)


def remaining(dishes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: pending dishes and unmapped lines that are left."""
    return dishes.agg(F.count_if(F.col("status") == "pending").alias("pending")).join(lines.agg(F.count_if(F.col("ingredient_id").isNull()).alias("unmapped")))  # two rows of one


def of_category(rows: DataFrame, chip: str) -> DataFrame:
    """The rows of a category; "All" stands for every one, also those without."""
    return rows if chip == "All" else rows.where(F.col("category") == chip)


def arrivals(live: DataFrame, shown: DataFrame) -> DataFrame:
    """What is live and not shown yet, by id and not by time."""
    return live.join(shown.select("dish_id"), "dish_id", "left_anti")


def busiest(lines: DataFrame, n: int) -> DataFrame:
    """The dishes with most lines, and how many."""
    return lines.groupBy("dish_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dish_id").limit(n)


def cook_log_list(logs: DataFrame, dish_id: int | str | None = None, user_id=None) -> DataFrame:
    """Cook logs newest first, of one dish or reader if given."""
    for column, value in (("dish_id", dish_id), ("user_id", user_id)):
        if value is not None:
            logs = logs.where(F.col(column) == value)
    return logs.orderBy(F.col("cooked_at").desc(), F.col("log_id").desc())


def health(dishes: DataFrame, ingredients: DataFrame) -> DataFrame:
    """One row: status (ok once there is an ingredient, else degraded), ingredients and dishes."""
    counts = ingredients.agg(F.count("*").alias("ingredients")).join(dishes.agg(F.count("*").alias("dishes")))  # two rows of one
    return counts.select(F.when(F.col("ingredients") > 0, "ok").otherwise("degraded").alias("status"), "ingredients", "dishes")
