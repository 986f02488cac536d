"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

An item is contained in a text when at least 4/5 of the item's distinct five-word shingles are in it. Items are
partitioned by their number of shingles, and each partition has its own sketch size: of an item with n shingles, of
which `need` must be found, the n - need + 1 with the smallest hashes. A text that holds `need` of n shingles must hold
one of any n - need + 1, so no contained item is missed; the sketch bounds only how many texts are verified. Texts with
fewer shingles than a partition's least need are no candidates in it. Candidates are verified on the exact shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import SHINGLE, SIMILAR, materialize

WHITE = "\t\n\x0b\f\r"


def with_words(df: DataFrame, *keep: str) -> DataFrame:
    """keep, w (the lower-case words of text between white space; null has none) and m, their number."""
    text = F.lower(F.coalesce("text", F.lit("")))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return df.select(*keep, F.array_remove(F.split(text, " "), "").alias("w")).select(*keep, "w", F.size("w").alias("m"))


def shingle_rows(df: DataFrame, *keep: str) -> DataFrame:
    """keep, m and h, a row for the hash of each run of five words; of all words where there are fewer.

    Shifted copies of the words are zipped, so that no expression is interpreted per word. The generator is an outer
    one: before an inner one Spark puts a filter that computes the array once more.
    """
    words = with_words(df, *keep).where("m > 0")
    shifted = [F.slice("w", k + 1, F.col("m")).alias(f"w{k}") for k in range(SHINGLE)]
    runs = F.slice(F.arrays_zip(*shifted), F.lit(1), F.greatest(F.col("m") - (SHINGLE - 1), F.lit(1)))
    rows = words.select(*keep, "m", runs.alias("r")).select(*keep, "m", F.explode_outer("r").alias("x"))
    return rows.select(*keep, "m", F.xxhash64(*(f"x.w{k}" for k in range(SHINGLE))).alias("h"))


def shingle_sets(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """keep and the distinct shingles of text as strings, as column name; null without words."""
    n = F.col("m")
    runs = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.array_join(F.slice("w", i, SHINGLE), " "))
    sets = F.when(n >= SHINGLE, F.array_distinct(runs)).when(n > 0, F.array(F.array_join("w", " ")))
    return with_words(df, *keep).select(*keep, sets.alias(name))


def item_sketches(items: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """item_id, n, need, partition (of sizes n in [2^k, 2^(k+1))) and h, one row for each hash of the item's sketch."""
    a, b = similar
    keyed = items.withColumn("__larder_item", F.struct("item_id", F.xxhash64("text")))  # repeated ids are items of their own
    sets = shingle_rows(keyed, "__larder_item").groupBy("__larder_item").agg(F.array_sort(F.collect_set("h")).alias("h")).withColumn("n", F.size("h"))  # one item's shingles
    sets = sets.withColumn("need", F.ceil(F.col("n") * a / b).cast("int")).withColumn("partition", F.floor(F.log2("n")).cast("int"))
    return sets.select("__larder_item.item_id", "n", "need", "partition", F.explode_outer(F.slice("h", F.lit(1), F.col("n") - F.col("need") + 1)).alias("h"))


def candidates(docs: DataFrame, items: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Distinct doc_id and item_id that share a hash of the item's sketch."""
    sketches = materialize(item_sketches(items, similar), "sketches")
    least = sketches.groupBy("partition").agg(F.min("need").alias("least"))
    # Written tables have sizes that Spark knows: it broadcasts the index only if it is small, and else shuffles.
    index = materialize(sketches.join(least, "partition").select("h", "item_id", "least").distinct(), "index")
    return shingle_rows(docs, "doc_id").join(index, "h").where(F.col("m") >= F.col("least")).select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles (of the item) and containment of each item that a text contains.

    Null and empty texts and items contain nothing and are contained nowhere; a text or item of fewer than five words
    has one shingle, all of them. Texts of one doc_id count together, as do those of one item_id; rows without an id
    are compared as well, under a null id.
    """
    found = materialize(candidates(docs, items, similar), "candidates")
    texts = docs.select("doc_id", "text").join(found, docs["doc_id"].eqNullSafe(found["doc_id"])).select(found["doc_id"], "item_id", "text")
    own = shingle_sets(items.where(F.col("text").isNotNull()), "b", "item_id").withColumnRenamed("item_id", "__larder_item")
    pairs = shingle_sets(texts, "a", "doc_id", "item_id").join(own, F.col("item_id").eqNullSafe(F.col("__larder_item")))
    pairs = pairs.select("doc_id", "item_id", F.size(F.array_intersect("a", "b")).cast("long").alias("n_shared"), F.size("b").cast("long").alias("n_shingles"))
    a, b = similar
    pairs = pairs.where(b * F.col("n_shared") >= a * F.col("n_shingles"))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "n_shingles")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_shared", "x.n_shingles", (F.col("x.n_shared") / F.col("x.n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """docs without the rows whose text contains an item; all columns stay.

    Rows are told apart by (doc_id, text): each goes or stays by its own text, whatever other rows share its id. Null and
    empty texts and items contain and match nothing, so such rows stay; texts of any length are searched whole.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    found = materialize(contained_items(rows, items, similar).select(F.col("doc_id").alias("__larder_row")).distinct(), "contaminated")
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__larder_row"), "left_anti")


_SHINGLES = """SELECT {key}, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN generate_series(1, len(w) - 4)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM {table})"""
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, s FROM ({_SHINGLES.format(key="doc_id", table="documents")})),
i AS (SELECT DISTINCT item_id, s FROM ({_SHINGLES.format(key="item_id", table="benchmark")})),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, k::BIGINT AS n_shared, n::BIGINT AS n_shingles, k::DOUBLE / n AS containment FROM shared JOIN n USING (item_id) WHERE 5 * k >= 4 * n
"""
