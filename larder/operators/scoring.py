"""Scoring feeds: what to score, in batches, and what to keep of the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.vocab import HISTORY, REASON_LENGTH, SCORE_BATCH, SCORE_RANGE, SCORE_RUN


def unscored(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Of the pairs (user_id, dish_id, published_at) those without a score, each user's newest SCORE_RUN, with place."""
    left = pairs.join(scores.select("user_id", "dish_id"), ["user_id", "dish_id"], "left_anti")
    newest = Window.partitionBy("user_id").orderBy(F.col("published_at").desc(), F.col("dish_id").desc())
    return left.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= SCORE_RUN)


def in_batches(rows: DataFrame, size: int = SCORE_BATCH) -> DataFrame:
    """rows with place become batch (from 0) and ref (from 1)."""
    return rows.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("int")).withColumn("ref", ((F.col("place") - 1) % size + 1).cast("int"))


def resolve(batches: DataFrame, answers: DataFrame) -> DataFrame:
    """Scores from answers (user_id, batch, ref, position, score, reason): known refs only, the first answer wins, blank reasons drop."""
    own = answers.withColumn("reason", F.trim("reason")).where("reason != ''").join(batches.select("user_id", "batch", "ref", "dish_id"), ["user_id", "batch", "ref"])
    first = Window.partitionBy("user_id", "batch", "ref").orderBy("position")
    own = own.withColumn("n", F.row_number().over(first)).where("n = 1")
    score = F.greatest(F.lit(float(SCORE_RANGE[0])), F.least(F.lit(float(SCORE_RANGE[1])), F.col("score").cast("double")))
    return own.select("user_id", "dish_id", score.cast("float").alias("score"), F.substring("reason", 1, REASON_LENGTH).alias("reason"))


def recent(logs: DataFrame, n: int = HISTORY) -> DataFrame:
    """Each user's latest n rows by (cooked_at, log_id)."""
    latest = Window.partitionBy("user_id").orderBy(F.col("cooked_at").desc(), F.col("log_id").desc())
    return logs.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= n)
