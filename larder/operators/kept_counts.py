"""The vocabulary and the counts of what is left, kept up to date by changes instead of counted anew.

A change is a table of rows with a sign: 1 came, -1 went, so a row that changes has both. How many lines of active dishes
use an ingredient is a join of dishes and lines, and its change is new lines with the dishes as they are after it, and
old lines with the dishes that changed: only touched rows are read but for the join's other side, which Spark filters by
the touched ids. Signs add up in any order and grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def signed(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """The change from the rows `before` to those `after`: columns and sign, the rows that are the same in both left out."""
    rows = before.select(*columns, F.lit(-1).alias("sign")).unionByName(after.select(*columns, F.lit(1).alias("sign")))
    return rows.groupBy(*columns).agg(F.sum("sign").alias("sign")).where("sign != 0")


def _active(dishes: DataFrame) -> DataFrame:
    """dish_id and sign of a change of dishes (dish_id, status, sign), as far as it changes what is active."""
    return dishes.where("status = 'active'").groupBy("dish_id").agg(F.sum("sign").alias("sign")).where("sign != 0")


def uses(dishes: DataFrame, lines: DataFrame) -> DataFrame:
    """ingredient_id and uses, the lines of active dishes (dish_id, status) that name it. Lines without an ingredient have no row."""
    used = lines.where("ingredient_id IS NOT NULL").join(dishes.where("status = 'active'").select("dish_id"), "dish_id")
    return used.groupBy("ingredient_id").agg(F.count("*").alias("uses"))


def change_uses(kept: DataFrame, dishes: DataFrame, lines: DataFrame, dish_changes: DataFrame, line_changes: DataFrame) -> DataFrame:
    """uses after changes of dishes (dish_id, status, sign) and lines (dish_id, ingredient_id, sign); dishes and lines are as before them.

    An ingredient that no line of an active dish is left of has no row. A dish_id stands for one dish.
    """
    active = _active(dish_changes)
    came = line_changes.where("ingredient_id IS NOT NULL").groupBy("dish_id", "ingredient_id").agg(F.sum("sign").alias("n"))
    before = dishes.where("status = 'active'").select("dish_id", F.lit(1).cast("long").alias("sign"))
    after = before.join(came.select("dish_id"), "dish_id", "left_semi").unionByName(active).groupBy("dish_id").agg(F.sum("sign").alias("sign"))
    old = lines.where("ingredient_id IS NOT NULL").select("dish_id", "ingredient_id").join(active, "dish_id").select("ingredient_id", F.col("sign").alias("uses"))
    new = came.join(after, "dish_id").select("ingredient_id", (F.col("n") * F.col("sign")).alias("uses"))
    rows = kept.select("ingredient_id", "uses").unionByName(old).unionByName(new)
    return rows.groupBy("ingredient_id").agg(F.sum("uses").alias("uses")).where("uses != 0")


def vocabulary(kept: DataFrame, ingredients: DataFrame) -> DataFrame:
    """name of each ingredient that is in use, once: browse.vocabulary without a look at dishes or lines."""
    return ingredients.join(kept.where("uses > 0").select("ingredient_id"), "ingredient_id", "left_semi").select("name").distinct()


def left(dishes: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: pending dishes and lines without an ingredient."""
    return change_left(None, dishes.withColumn("sign", F.lit(1)), lines.withColumn("sign", F.lit(1)))


def change_left(kept: DataFrame | None, dish_changes: DataFrame, line_changes: DataFrame) -> DataFrame:
    """pending and unmapped after changes of dishes (status, sign) and lines (ingredient_id, sign); one row, zeros where nothing is there."""
    none = F.lit(0).cast("long")
    rows = dish_changes.where("status = 'pending'").agg(F.sum("sign").alias("pending"), none.alias("unmapped"))
    rows = rows.unionByName(line_changes.where("ingredient_id IS NULL").agg(none.alias("pending"), F.sum("sign").alias("unmapped")))
    if kept is not None:
        rows = rows.unionByName(kept.select("pending", "unmapped"))
    return rows.agg(*(F.coalesce(F.sum(c), none).alias(c) for c in ("pending", "unmapped")))
