"""Tables between the steps of an operator: written to the folder that all executors share, so that no step is planned or done twice."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache, reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@cache
def _test_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="larder-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a master of one machine may do without; it gets a temporary folder."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or _test_dir()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/larder/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: its plan ends there, and lost executors cost what they were doing only."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, column: str) -> DataFrame:
    """rows with k, 1 and on in the order of a column whose values all differ. Each task counts a range; only the ranges' sizes meet in one."""
    parts = written(rows.repartitionByRange(column).withColumn("__larder_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__larder_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sizes = parts.groupBy("__larder_part").count().select("__larder_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__larder_before"))
    place = F.row_number().over(Window.partitionBy("__larder_part").orderBy(column))
    return parts.withColumn("k", place).join(sizes, "__larder_part").withColumn("k", F.col("k") + F.col("__larder_before")).select(*rows.columns, "k")


def sum_before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with name, the sum of value (a decimal, 0 where nothing is) over the rows of the same keys that come before by order.

    Rows are dealt by ranges of keys and order, so the rows of one key are summed by many tasks; only the ranges' sums
    meet, by key. Rows equal in keys and order should be equal in value, else any of them comes first.
    """
    parts = written(rows.repartitionByRange(*keys, *order).withColumn("__larder_part", F.spark_partition_id()), "ranges")
    zero = F.lit(0).cast(parts.schema[value].dataType)
    inside = Window.partitionBy(*keys, "__larder_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__larder_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sums = parts.groupBy(*keys, "__larder_part").agg(F.sum(value).alias("__larder_sum")).select(*keys, "__larder_part", F.sum("__larder_sum").over(before).alias("__larder_before"))
    own = parts.withColumn("__larder_own", F.sum(value).over(inside)).alias("x")
    same = reduce(and_, (F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "__larder_part")))
    return own.join(sums.alias("y"), same).select(*(F.col(f"x.{c}") for c in rows.columns), (F.coalesce("__larder_own", zero) + F.coalesce("__larder_before", zero)).alias(name))
