"""Mutations as pure functions: the new state of a table from its old state and the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.plans.shared import written


def one_each(changes: DataFrame, keys: list[str], *latest: str) -> DataFrame:
    """One row for each key: that with the greatest `latest` columns, then the greatest others in the table's order (null is least)."""
    rest = [*latest, *(c for c in changes.columns if c not in (*keys, *latest))]
    if not rest:
        return changes.distinct()
    return changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__larder_row")).select(*keys, *(F.col(f"__larder_row.{c}").alias(c) for c in rest)).select(changes.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *latest: str) -> DataFrame:
    """new replaces rows of old with its keys; of several new rows with a key one_each decides by `latest`."""
    new = one_each(new, keys, *latest)
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose keys old lacks are added once."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti"))


def replace_children(old: DataFrame, new: DataFrame, parent: list[str], parents: DataFrame | None = None) -> DataFrame:
    """All rows of the parents that new (or parents) names are replaced by those of new."""
    return old.join((new if parents is None else parents).select(parent).distinct(), parent, "left_anti").unionByName(new)


def save_picks(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Batches change, saved_at of a kept pick doesn't; null batches remove the pick. A change need not tell when it was made.

    Of several changes of a pick the one saved last counts, see one_each.
    """
    changes = one_each(changes, ["user_id", "dish_id"], "saved_at")
    rows = old.alias("o").join(changes.withColumn("named", F.lit(True)).alias("c"), ["user_id", "dish_id"], "full_outer")
    named = F.col("c.named").isNotNull()
    rows = rows.where(~named | F.col("c.batches").isNotNull())
    return rows.select("user_id", "dish_id", F.when(named, F.col("c.batches")).otherwise(F.col("o.batches")).alias("batches"), F.coalesce("o.saved_at", "c.saved_at").alias("saved_at"))


def own_column(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Upsert by an owner of one column: the others keep their values; of several values for a key the greatest counts."""
    new = one_each(new.select(key, column), [key])
    rest = [F.col(f"o.{c}").alias(c) for c in old.columns if c not in (key, column)]
    rows = old.alias("o").join(new.select(key, column).alias("n"), key, "full_outer")
    return rows.select(key, F.coalesce(f"n.{column}", f"o.{column}").alias(column), *rest).select(old.columns)


#: Columns that are derived from the content of a dish, which a changed dish loses.
DERIVED = ("blurb", "keeps_days", "freezer_months", "category", "tags", "rejection_reason")


def upsert_dishes(old: DataFrame, drafts: DataFrame) -> DataFrame:
    """State after drafts (source_url, content_hash, seen_at and content columns) with outcome: inserted, unchanged, updated or kept.

    The same hash touches last_seen only; another one replaces the content columns that the drafts have, resets what
    was derived (tags to none, the rest to null) and makes the dish pending. A stored dish may lack a hash. Where the
    children of updated dishes are kept in a table, replace_children takes those whose outcome is inserted or updated.
    Of several drafts of a URL the one seen last counts, see one_each, so there is one row and one outcome a URL.
    """
    drafts = one_each(drafts, ["source_url"], "seen_at")
    rows = old.withColumn("there", F.lit(True)).alias("o").join(drafts.withColumn("came", F.lit(True)).alias("d"), "source_url", "full_outer")
    same = F.col("o.content_hash").eqNullSafe(F.col("d.content_hash"))
    outcome = F.when(F.col("d.came").isNull(), "kept").when(F.col("o.there").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    fresh = outcome.isin("inserted", "updated")
    fixed = {
        "source_url": F.col("source_url"), "content_hash": F.when(fresh, F.col("d.content_hash")).otherwise(F.col("o.content_hash")), "status": F.when(fresh, "pending").otherwise(F.col("o.status")),
        "first_seen_at": F.coalesce("o.first_seen_at", "d.seen_at"), "last_seen_at": F.coalesce("d.seen_at", "o.last_seen_at"),
    }
    kinds, columns = dict(old.dtypes), []
    for c in old.columns:
        reset = F.array().cast(kinds[c]) if c == "tags" else F.lit(None).cast(kinds[c])
        other = F.when(fresh, reset).otherwise(F.col(f"o.{c}")) if c in DERIVED else F.when(fresh, F.col(f"d.{c}")).otherwise(F.col(f"o.{c}")) if c in drafts.columns else F.col(f"o.{c}")
        columns.append(fixed.get(c, other).alias(c))
    return rows.select(*columns, outcome.alias("outcome"))


def touch(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Dishes that were seen again (source_url, seen_at, etag, last_modified): later last_seen_at, and validators where they came; of several sights the last."""
    seen = one_each(seen, ["source_url"], "seen_at")
    rows = old.alias("o").join(seen.alias("s"), "source_url", "left")
    new = {"last_seen_at": F.coalesce("s.seen_at", "o.last_seen_at"), "page_etag": F.coalesce("s.etag", "o.page_etag"), "page_last_modified": F.coalesce("s.last_modified", "o.page_last_modified")}
    return rows.select(*(new.get(c, F.col("source_url") if c == "source_url" else F.col(f"o.{c}")).alias(c) for c in old.columns))


def unchanged_pages(old: DataFrame, seen: DataFrame) -> DataFrame:
    """source_url and outcome of pages that answered "not modified": touched where the dish is stored, else retry, since nothing is held of it."""
    known = old.select("source_url").withColumn("there", F.lit(True))
    return seen.join(known, "source_url", "left").select("source_url", F.when(F.col("there"), "touched").otherwise("retry").alias("outcome"))


def compare_and_set(old: DataFrame, changes: DataFrame) -> DataFrame:
    """Finish pending rows whose hash is still the one that was read; outcome is applied, stale or kept.

    One row and one outcome a dish: of several changes the one that expects the stored hash counts, then the greatest
    status, so a change is never both applied and stale.
    """
    held = changes.join(old.select("dish_id", F.col("content_hash").alias("__larder_hash")), "dish_id")
    fits = F.col("expected_hash").eqNullSafe(F.col("__larder_hash"))
    changes = held.groupBy("dish_id").agg(F.max(F.struct(fits.alias("fits"), "expected_hash", "status")).alias("c")).select("dish_id", "c.expected_hash", "c.status")
    rows = old.alias("o").join(changes.alias("c"), "dish_id", "left")
    asked = F.col("c.expected_hash").isNotNull()
    good = asked & (F.col("o.status") == "pending") & F.col("o.content_hash").eqNullSafe(F.col("c.expected_hash"))
    return rows.select("dish_id", "o.content_hash", F.when(good, F.col("c.status")).otherwise(F.col("o.status")).alias("status"), F.when(good, "applied").when(asked, "stale").otherwise("kept").alias("outcome"))


ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"


def _code(h: Column) -> Column:
    return F.concat(*(F.substring(F.lit(ALPHABET), (F.shiftrightunsigned(h, 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)))


def share_codes(ids: DataFrame, column: str = "id") -> DataFrame:
    """A code of eight characters per id, unique and the same each time: five bits of a hash per character.

    Ids whose codes are the same are told apart by their order: all but the first hash again with a number, until no
    code comes twice. Of n ids about n * n / 2^41 need that, so the rounds are few; each looks only at the ids that are
    still without a code.
    """
    first = F.row_number().over(Window.partitionBy("share_code").orderBy(column)) == 1
    rows = written(ids.select(column).distinct().withColumn("share_code", _code(F.xxhash64(column))).withColumn("own", first), "codes")
    given, turn = rows.where("own").drop("own"), 0
    while not (open_ := rows.where("NOT own").select(column)).isEmpty():
        turn += 1
        again = open_.withColumn("share_code", _code(F.xxhash64(column, F.lit(turn)))).join(given.select("share_code", F.lit(True).alias("held")), "share_code", "left")
        rows = written(again.select(column, "share_code", (F.col("held").isNull() & first).alias("own")), "codes")
        given = given.unionByName(rows.where("own").drop("own"))
    return given.select(column, "share_code")
