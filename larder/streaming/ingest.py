"""Incremental ingest: each micro-batch of drafts makes the next version of the dishes, once, also after a failure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.functions.urls import canonical_url
from larder.operators.state import upsert_dishes

STATE = """source_url string, content_hash string, title string, blurb string, keeps_days int, freezer_months int, category string, tags array<string>, rejection_reason string,
 status string, first_seen_at timestamp, last_seen_at timestamp"""
DRAFT = "source_url string, content_hash string, title string, seen_at timestamp"
#: Parts of the state, by a hash of the address; a batch writes those that it touches. Versions of a part that are kept.
PARTS, KEPT = 64, 3


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Each part's complete versions under path, ascending."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    find = lambda pattern: store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}")) or []
    done = {s.getPath().getParent().getName() for s in find("v=*/_SUCCESS")}
    out: dict[int, list[int]] = {}
    for s in find("v=*/part=*"):
        if (v := s.getPath().getParent().getName()) in done:
            out.setdefault(int(s.getPath().getName()[5:]), []).append(int(v[2:]))
    return {k: sorted(v) for k, v in out.items()}


def current(spark: SparkSession, path: str, below: int | None = None, parts: list[int] | None = None) -> DataFrame:
    """The newest version of every part, or of some (below a number, if one is given); none yet gives an empty table."""
    known = {p: [v for v in vs if below is None or v < below] for p, vs in versions(spark, path).items() if parts is None or p in parts}
    paths = [f"{path}/v={vs[-1]}/part={p}" for p, vs in sorted(known.items()) if vs]
    return spark.read.schema(STATE).parquet(*paths) if paths else spark.createDataFrame([], STATE)


def apply_batch(drafts: DataFrame, batch: int, path: str) -> None:
    """Write the touched parts as version `batch`, from those before it. A batch that comes again makes the same version.

    Of several drafts with one canonical URL the latest counts; drafts without a URL or hash take no part. All but the
    last KEPT versions of a part are deleted.
    """
    spark = drafts.sparkSession
    rows = drafts.where("source_url IS NOT NULL AND content_hash IS NOT NULL").withColumn("source_url", canonical_url(F.col("source_url")))
    one = rows.groupBy("source_url").agg(F.max(F.struct("seen_at", "content_hash", "title")).alias("x")).select("source_url", "x.content_hash", "x.title", "x.seen_at")
    part = F.pmod(F.xxhash64("source_url"), F.lit(PARTS)).alias("part")
    touched = [r["part"] for r in one.select(part).distinct().collect()]  # PARTS at most
    made = upsert_dishes(current(spark, path, batch, touched), one).drop("outcome").withColumn("part", part)
    made.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/v={batch}")
    jvm = spark._jvm
    for p, vs in versions(spark, path).items():
        for v in vs[:-KEPT]:
            old = jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/part={p}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def ingest(spark: SparkSession, drafts: str, path: str, checkpoint: str) -> StreamingQuery:
    """Apply all Parquet drafts that have come since the last run, then stop. No watermark: late and undated drafts count, too."""
    stream = spark.readStream.schema(DRAFT).parquet(drafts)
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: apply_batch(rows, batch, path)).start()
