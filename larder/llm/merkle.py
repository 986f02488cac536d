"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections, in DataFrame functions only.

A paragraph is a line, its leaves are its blocks of BLOCK code points, and a section is a run of SECTION paragraphs.
Each node is the hash of its children's hashes, so roots are equal when texts are. A fingerprint is a string
"root|section ...|paragraph:leaves ...|leaf ..." with shortened hashes after the root; two of them alone give a
likeness and the branches that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import partitions

BLOCK, SECTION = 64, 16
NODE_HEX, LEAF_HEX = 16, 12


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of column text (null: empty) as column name."""
    tree = df.withColumn("__larder_leaves", F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{BLOCK}}}"), 0), lambda x: F.md5(x))))
    tree = tree.withColumn("__larder_paragraphs", F.transform("__larder_leaves", lambda leaves: F.md5(F.array_join(leaves, " "))))
    runs = F.sequence(F.lit(0), F.floor((F.size("__larder_paragraphs") - 1) / SECTION).cast("int"))
    tree = tree.withColumn("__larder_sections", F.transform(runs, lambda i: F.md5(F.array_join(F.slice("__larder_paragraphs", i * SECTION + 1, F.lit(SECTION)), " "))))
    short = lambda x, n: F.substring(x, 1, n)
    parts = [
        F.sha2(F.array_join("__larder_sections", " "), 256),
        F.array_join(F.transform("__larder_sections", lambda s: short(s, NODE_HEX)), " "),
        F.array_join(F.zip_with("__larder_paragraphs", "__larder_leaves", lambda p, leaves: F.concat(short(p, NODE_HEX), F.lit(":"), F.size(leaves))), " "),
        F.array_join(F.transform(F.flatten("__larder_leaves"), lambda x: short(x, LEAF_HEX)), " "),
    ]
    return tree.withColumn(name, F.concat_ws("|", *parts)).drop("__larder_leaves", "__larder_paragraphs", "__larder_sections")


def _part(fingerprint: Column | str, i: int) -> Column:
    return F.split(F.split_part(fingerprint, F.lit("|"), F.lit(i)), " ")


def likeness(a: str, b: str) -> Column:
    """1 for equal roots, else the Dice coefficient of the two fingerprints' distinct leaves (an empty text has one, empty)."""
    x, y = F.array_distinct(_part(F.col(a), 4)), F.array_distinct(_part(F.col(b), 4))
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def changed_branches(a: str, b: str) -> tuple[Column, Column]:
    """Numbers (from 0) of the sections of b that a lacks, and of the paragraphs within those sections that a lacks."""
    there, own = _part(F.col(a), 2), _part(F.col(b), 2)
    at = lambda own, there: F.filter(F.transform(own, lambda x, i: F.when(~F.array_contains(there, x), i)), lambda i: i.isNotNull())
    sections = at(own, there)
    paragraphs = F.filter(at(_part(F.col(b), 3), _part(F.col(a), 3)), lambda i: F.array_contains(sections, F.floor(i / SECTION).cast("int")))
    return sections, paragraphs


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id and others) with next_<column> of the next document in ascending doc_id; after the last, the first.

    Null doc_id come first; rows of one doc_id are ordered by the hash of their text, then the text. Rows are cut into
    ranges of doc_id at values that are there, and the document at each cut is also sent, as a ghost, to the end of the
    range before it, so that one shuffle and a window within ranges do, and no task sees all rows.
    """
    n = 2 * partitions(docs.sparkSession)
    cuts = [i / n for i in range(1, n)]
    seen = docs.agg(F.percentile_approx("doc_id", cuts, 100 * n).alias("q"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({x for x in seen["q"] or [] if x > seen["low"]})
    cut = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    own = F.size(F.filter(cut, lambda x: x <= F.col("doc_id")))
    range_of = F.when(F.col("doc_id").isNull(), 0).otherwise(own).cast("int")
    first = F.col("doc_id").isNull() if seen["nulls"] else F.col("doc_id") == F.lit(seen["low"]).cast("long")
    ghosts = F.array_compact(F.array(F.when(F.array_contains(cut, F.col("doc_id")), range_of - 1), F.when(first, len(bounds))))
    places = F.concat(F.array(F.struct(range_of.alias("r"), F.lit(False).alias("ghost"))), F.transform(ghosts, lambda r: F.struct(r.cast("int").alias("r"), F.lit(True).alias("ghost"))))
    rows = docs.withColumn("__larder_p", F.explode_outer(places))
    window = Window.partitionBy("__larder_p.r").orderBy("__larder_p.ghost", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    follow = [F.lead(c).over(window).alias(f"next_{c}") for c in columns]
    return rows.select("*", *follow).where(~F.col("__larder_p.ghost")).drop("__larder_p")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document, see with_next. Null texts count as empty; a single document follows itself; an empty table gives no rows.
    """
    rows = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fingerprint")
    rows = with_next(rows, ["text", "fingerprint"]).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = with_fingerprint(rows.drop("text", "next_text"), "edited", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))


def _tree_sql(source: str, text: str) -> str:
    return f"""
  SELECT *, sha256(array_to_string(s, ' ')) || '|' || array_to_string([x[:{NODE_HEX}] FOR x IN s], ' ') || '|' ||
         array_to_string([p[i][:{NODE_HEX}] || ':' || len(l[i]) FOR i IN generate_series(1, len(p))], ' ') || '|' ||
         array_to_string([x[:{LEAF_HEX}] FOR x IN flatten(l)], ' ') AS f
  FROM (SELECT *, [md5(array_to_string(p[i * {SECTION} + 1 : i * {SECTION} + {SECTION}], ' ')) FOR i IN generate_series(0, (len(p) - 1) // {SECTION})] AS s
  FROM (SELECT *, [md5(array_to_string(x, ' ')) FOR x IN l] AS p
  FROM (SELECT *, [[md5(x) FOR x IN regexp_extract_all(y, '(?s).{{1,{BLOCK}}}')] FOR y IN string_split({text}, chr(10))] AS l FROM {source})))"""


def _likeness_sql(a: str, b: str) -> str:
    x, y = (f"list_distinct(string_split(split_part({c}, '|', 4), ' '))" for c in (a, b))
    return f"CASE WHEN {a}[:64] = {b}[:64] THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


ORACLE = f"""
WITH trees AS (SELECT doc_id, t, f FROM ({_tree_sql("(SELECT doc_id, coalesce(text, '') AS t FROM documents)", "t")})),
follow AS (SELECT doc_id, t, f, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(f) OVER w, first_value(f) OVER w) AS nf FROM trees WINDOW w AS (ORDER BY doc_id)),
edits AS (SELECT doc_id, length(t) AS n, f AS own, nf, left(t, length(t) - length(t) // 4) || left(nt, length(t) // 4) AS edited FROM follow)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, own AS fingerprint, f AS edited_fingerprint,
       {_likeness_sql("own", "f")} AS near_edited, {_likeness_sql("own", "nf")} AS near_next
FROM ({_tree_sql("edits", "edited")})
"""
