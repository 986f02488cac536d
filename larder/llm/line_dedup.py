"""Line dedup by overlapping windows of three consecutive lines.

Every run of three lines of a text is hashed; a window that has come before - in an earlier document by ascending
doc_id, or earlier in the same text - is a later occurrence, and the lines that the later occurrences cover, merged,
are removed. Only window hashes and positions are shuffled: the first occurrence of a window is a partial aggregate,
and the join back to the windows meets one row per repeated window, so a hot window can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def line_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, __larder_t (a hash of the text), pos and a 128-bit hash (h, g) of each window of `size` lines."""
    lines = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("__larder_t"), F.split("text", "\n").alias("l"))
    lines = lines.where(F.size("l") >= size)
    window = lambda i: F.struct((i - 1).alias("pos"), F.array_join(F.slice("l", i, size), "\n").alias("w"))
    windows = lines.select("doc_id", "__larder_t", F.explode_outer(F.transform(F.sequence(F.lit(1), F.size("l") - (size - 1)), window)).alias("x"))
    return windows.select("doc_id", "__larder_t", "x.pos", F.xxhash64("x.w").alias("h"), F.xxhash64(F.lit("second"), "x.w").alias("g"))


def removed_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, __larder_t and removed, the positions of lines (from 0) that later occurrences of windows cover."""
    windows = line_windows(docs, size)  # made twice: that reads less than writing them would
    at = F.struct(F.col("doc_id"), F.col("__larder_t"), F.col("pos"))  # null doc_id is the first
    firsts = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(at).alias("first")).where("n > 1").select("h", "g", "first")
    later = windows.join(firsts, ["h", "g"]).where(at > F.col("first"))
    covered = later.select("doc_id", "__larder_t", F.explode_outer(F.sequence(F.col("pos"), F.col("pos") + (size - 1))).alias("p"))
    return covered.groupBy("doc_id", "__larder_t").agg(F.collect_set("p").alias("removed"))  # lines of one text at most


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs with text without its removed lines, n_lines and n_removed; other columns stay.

    A null text stays null with no lines; an empty text has one empty line; texts of fewer than `size` lines stay. Rows
    of one doc_id are ordered by the hash of their text, and rows that are equal in both get the same answer. When all
    lines go the text is empty.
    """
    gone = removed_lines(docs, size).select(F.col("doc_id").alias("__larder_d"), F.col("__larder_t").alias("__larder_r"), F.col("removed").alias("__larder_removed"))
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    joined = docs.withColumn("__larder_x", F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("__larder_d")) & (F.col("__larder_x") == F.col("__larder_r")), "left")
    lines = F.split("text", "\n")
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__larder_removed")  # by a hash set; in order
    kept = F.get(F.transform(F.array(lines), lambda all_of: F.array_join(F.transform(stays, lambda i: F.get(all_of, i)), "\n")), F.lit(0))
    return joined.select(
        *own,
        F.when(F.col("__larder_removed").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__larder_removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


#: What op9 returns, as DuckDB SQL. Windows are compared by their text.
ORACLE = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, i - 1 AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS i FROM lines WHERE len(l) >= 3)),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) AS v(k)),
parts AS (
  SELECT s.doc_id, s.i, s.line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS i FROM lines) s
  ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.pos),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM parts GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN cut c USING (doc_id)
"""
