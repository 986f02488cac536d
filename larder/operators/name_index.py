"""The aliases' trigram prefixes, written once and added to as aliases are learned; finds what matcher.similar_names finds.

A posting is one of the first trigrams of an alias, rare ones first, with the alias' trigrams beside it, so that a found
alias is compared without a look elsewhere. Which trigrams are rare is fixed when an index is built: any order that both
sides share loses no pair. Learned aliases become a segment of their own. While the newest segment is at least half as
large as the one before it, both are merged, so there are as many segments as the number of aliases has doublings. When
all become one, the order of trigrams is made anew.

A change writes its segments first and the list of segments last; what a lost change leaves is not read. One writer at a
time. An alias that must go needs a new build.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.matcher import trigrams
from larder.vocab import FUZZY_THRESHOLD

MANIFEST = "segment string, place int, postings long, ranks string, threshold double, version int"
POSTING = "g string, alias string, ingredient_id long, t array<string>"


def _named(aliases: DataFrame) -> DataFrame:
    return aliases.select("alias", F.col("ingredient_id").cast("long").alias("ingredient_id")).distinct().withColumn("t", trigrams(F.col("alias"))).where(F.size("t") > 0)


def _prefixes(rows: DataFrame, keys: list[str], ranks: DataFrame, threshold: float) -> DataFrame:
    """g, keys and t: of n trigrams the first n - ceil(threshold * n) + 1, the rarest first, unranked ones before all."""
    long = rows.select(*keys, "t", F.explode("t").alias("g")).join(ranks, "g", "left")
    first = long.groupBy(*keys).agg(F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g"))).alias("r"))  # one name's
    n = F.size("t")
    size = (n - F.ceil(n * F.lit(threshold) - 1e-9) + 1).cast("int")
    return first.select(F.explode(F.slice("r", F.lit(1), F.least(size, n))).alias("x"), *keys, "t").select("x.g", *keys, "t")


class NameIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _segments(self) -> list:
        rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest")
        return rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("place").collect()  # a row a segment

    def _put(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _commit(self, segments: list[tuple[str, int]], ranks: str, threshold: float, version: int) -> None:
        rows = [(name, k, n, ranks, threshold) for k, (name, n) in enumerate(segments)]
        self.spark.createDataFrame(rows, MANIFEST.rpartition(",")[0]).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/version={version}")

    def _whole(self, named: DataFrame, threshold: float) -> tuple[tuple[str, int], str]:
        """One segment of all aliases, and the ranks it goes by."""
        ranks = self._put(named.select(F.explode("t").alias("g")).groupBy("g").agg(F.count("*").alias("c")), "ranks")
        name = self._put(_prefixes(named, ["alias", "ingredient_id"], self._read(ranks, "g string, c long"), threshold).sortWithinPartitions("g"), "postings")
        return (name, self._read(name, POSTING).count()), ranks

    def build(self, aliases: DataFrame, threshold: float = FUZZY_THRESHOLD, version: int = 0) -> None:
        """Write the index of aliases (alias, ingredient_id). A null or empty alias has no trigram and is never found."""
        segment, ranks = self._whole(_named(aliases), threshold)
        self._commit([segment], ranks, threshold, version)

    def add(self, learned: DataFrame) -> None:
        """The index with more aliases. Those that it has may come again."""
        held = self._segments()
        last, threshold = held[-1], held[-1].threshold
        new = self._put(_prefixes(_named(learned), ["alias", "ingredient_id"], self._read(last.ranks, "g string, c long"), threshold).sortWithinPartitions("g"), "postings")
        segments = [(s.segment, s.postings) for s in held] + [(new, self._read(new, POSTING).count())]
        first = len(segments) - 1
        total = segments[-1][1]
        while first > 0 and 2 * total >= segments[first - 1][1]:
            first -= 1
            total += segments[first][1]
        ranks = last.ranks
        if first < len(segments) - 1:
            merged = self.spark.read.schema(POSTING).parquet(*(f"{self.path}/{name}" for name, _ in segments[first:]))
            if first == 0:
                one, ranks = self._whole(merged.select("alias", "ingredient_id", "t").dropDuplicates(["alias", "ingredient_id"]), threshold)
            else:
                name = self._put(merged.dropDuplicates(["g", "alias", "ingredient_id"]).sortWithinPartitions("g"), "postings")
                one = (name, self._read(name, POSTING).count())
            segments = [*segments[:first], one]
        self._commit(segments, ranks, threshold, last.version + 1)

    def sizes(self) -> list[int]:
        """The postings of each segment, the oldest first."""
        return [s.postings for s in self._segments()]

    def find(self, names: DataFrame) -> DataFrame:
        """name, alias, ingredient_id and similarity of the aliases like each name, as similar_names has them with the index's threshold."""
        held = self._segments()
        threshold = held[-1].threshold
        postings = self.spark.read.schema(POSTING).parquet(*(f"{self.path}/{s.segment}" for s in held)).withColumnRenamed("t", "b")
        asked = names.select("name").distinct().withColumn("t", trigrams(F.col("name"))).where(F.size("t") > 0)
        asked = _prefixes(asked, ["name"], self._read(held[-1].ranks, "g string, c long"), threshold)
        n, m = F.size("t"), F.size("b")
        near = asked.join(postings, "g").where(F.least(n, m) >= F.greatest(n, m) * F.lit(threshold) - 1e-9)
        k = F.size(F.array_intersect("t", "b"))
        near = near.withColumn("similarity", (k / (n + m - k)).cast("float")).where(F.col("similarity").cast("double") > threshold)
        return near.select("name", "alias", "ingredient_id", "similarity").distinct()
