"""Rules of integrity as queries: what breaks a rule comes back as rows, so an empty answer is a clean table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.vocab import CATEGORIES, TAGS


def dish_rules() -> dict[str, Column]:
    """Name -> condition that holds for each dish; null counts as holding, as in a CHECK."""
    known = F.array(*map(F.lit, TAGS))
    return {
        "tags_known": F.size(F.array_except("tags", known)) == 0,
        "category_known": F.col("category").isin(*CATEGORIES),
        "rating_range": F.col("source_rating").between(0, 5),
        "minutes_order": F.col("active_minutes") <= F.col("total_minutes"),
    }


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key and rule, a row for each rule that a row breaks; one pass over the table."""
    broken = F.array_compact(F.array(*(F.when(~good, F.lit(name)) for name, good in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many; keys with a null are never equal."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
