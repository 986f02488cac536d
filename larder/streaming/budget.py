"""Whether each call is still within its day's budget, answered while calls stream in.

A call is made if what the calls of its kind and day before it cost is under the kind's limit. Costs are not negative, so
once a call is refused all later ones are, and the sum over all calls before tells as much as that over those made:
sums by ranges answer it, and no task has to see a whole day. Batches come one after the other; in a batch, time decides.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.runs import BUDGET_GATE, DAY_BUDGET, day_start
from larder.plans.shared import sum_before

#: What a day's calls of a kind may cost.
LIMITS = {kind: limit * (BUDGET_GATE if kind == "search" else 1) for kind, limit in DAY_BUDGET.items()}
#: Sums are exact, so they don't depend on the order in which they are made.
COST = "decimal(38,9)"
SPENT = f"kind string, day date, spent {COST}, refused long"


def gate(spent: DataFrame, calls: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """calls (call_id, kind, at, cost and more) with allowed; spent (see SPENT) has what calls before these cost.

    A null or negative cost counts as none. A kind without a limit is always allowed; a call without a kind or time never.
    A call_id stands for one call.
    """
    known = F.create_map(*(x for kind, limit in (limits or LIMITS).items() for x in (F.lit(kind), F.lit(limit).cast(COST))))
    cost = F.greatest(F.coalesce(F.col("cost").cast("decimal(18,9)").cast(COST), F.lit(0).cast(COST)), F.lit(0).cast(COST))
    rows = calls.withColumns({"__larder_day": day_start(F.col("at")).cast("date"), "__larder_cost": cost})
    rows = sum_before(rows, ["kind", "__larder_day"], ["at", "call_id", "__larder_cost"], "__larder_cost", "__larder_sum")
    held = spent.select("kind", F.col("day").alias("__larder_day"), F.col("spent").alias("__larder_held"))
    rows = rows.join(held, ["kind", "__larder_day"], "left")
    limit = F.element_at(known, F.col("kind"))
    under = limit.isNull() | (F.coalesce("__larder_held", F.lit(0).cast(COST)) + F.col("__larder_sum") < limit)
    allowed = F.when(F.col("kind").isNull() | F.col("at").isNull(), False).otherwise(under)
    return rows.select(*calls.columns, allowed.alias("allowed"))


def add_spent(spent: DataFrame, answers: DataFrame) -> DataFrame:
    """spent after the calls that were allowed, with the number of those refused."""
    cost = F.greatest(F.coalesce(F.col("cost").cast("decimal(18,9)").cast(COST), F.lit(0).cast(COST)), F.lit(0).cast(COST))
    new = answers.where("kind IS NOT NULL AND at IS NOT NULL").select("kind", day_start(F.col("at")).cast("date").alias("day"), F.when(F.col("allowed"), cost).otherwise(F.lit(0).cast(COST)).alias("spent"), F.when(F.col("allowed"), 0).otherwise(1).cast("long").alias("refused"))
    rows = spent.select("kind", "day", "spent", "refused").unionByName(new)
    return rows.groupBy("kind", "day").agg(F.sum("spent").cast(COST).alias("spent"), F.sum("refused").alias("refused"))


def nothing_spent(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SPENT)


def spent_until(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """What was spent when a batch begins: the state that the batch before it wrote."""
    return nothing_spent(spark) if batch == 0 else spark.read.schema(SPENT).parquet(f"{path}/spent/batch={batch - 1}")


def answer_batch(calls: DataFrame, batch: int, path: str, limits: dict[str, float] | None = None) -> None:
    """Write a batch's answers and what is spent after it. A batch that runs again writes the same in the same place."""
    spark = calls.sparkSession
    spent = spent_until(spark, path, batch)
    gate(spent, calls, limits).write.mode("overwrite").parquet(f"{path}/answers/batch={batch}")
    answers = spark.read.schema(calls.schema.add("allowed", "boolean")).parquet(f"{path}/answers/batch={batch}")
    add_spent(spent, answers).coalesce(1).write.mode("overwrite").parquet(f"{path}/spent/batch={batch}")  # a row a kind and day


def answer(calls: DataFrame, path: str, checkpoint: str, limits: dict[str, float] | None = None) -> StreamingQuery:
    """Answers to a stream of calls, all that is there, under path/answers; state is under path/spent. A path belongs to one checkpoint."""
    return calls.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: answer_batch(rows, batch, path, limits)).start()


def open_on(spent: DataFrame, day: date, kind: str, limits: dict[str, float] | None = None) -> DataFrame:
    """One row, open: whether a call of a kind would be allowed now."""
    limit = (limits or LIMITS).get(kind)
    used = spent.where((F.col("kind") == kind) & (F.col("day") == F.lit(day))).agg(F.coalesce(F.sum("spent"), F.lit(0)).alias("used"))
    return used.select((F.lit(True) if limit is None else F.col("used") < F.lit(limit).cast(COST)).alias("open"))
