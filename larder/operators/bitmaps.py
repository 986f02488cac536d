"""Which dishes use an ingredient, as words of 64 dishes: all, any and none of many searches by AND, OR and ANDNOT.

A row of words has a name, the number of a word (dish_id / 64, rounded down) and the bits of its dishes; the row without a
name has every dish. A name that is in a third of all dishes has a row for each 64 of them, and a search reads the rows of
its own names alone. Ids far from each other cost a row a dish, as lists would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.plans.shared import written

#: Searches that are sent to every task at once; more take a turn for each so many.
SENT = 100_000
LISTS = ("ingredients", "any_ingredients", "exclude_ingredients")


def _word(dish: Column) -> list[Column]:
    return [F.shiftright(dish, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), dish.bitwiseAND(63).cast("int")).alias("bit")]


def ingredient_words(dishes: DataFrame, lines: DataFrame) -> DataFrame:
    """name (lower case; null: every dish), word and bits of dishes (dish_id) and their lines (dish_id, name).

    Lines without a name, and of dishes that are not there, count for nothing; a dish or line that comes twice counts once.
    """
    ids = dishes.select(F.col("dish_id").cast("long").alias("dish_id")).where("dish_id IS NOT NULL")
    named = lines.where("name IS NOT NULL").select(F.col("dish_id").cast("long").alias("dish_id"), F.lower("name").alias("name")).join(ids, "dish_id", "left_semi")
    rows = named.unionByName(ids.withColumn("name", F.lit(None).cast("string")))
    return rows.select("name", *_word(F.col("dish_id"))).groupBy("name", "word").agg(F.bit_or("bit").alias("bits"))


def change(words: DataFrame, taken: DataFrame, given: DataFrame) -> DataFrame:
    """words after the words of some dishes were taken out and others put in: (words ANDNOT taken) OR given, rows without a bit dropped.

    Of a dish that changes, take what it had and give what it has; where both name a bit, it stays.
    """
    parts = [p.select("name", "word", "bits", F.lit(k).alias("k")) for k, p in enumerate((words, taken, given))]
    of = [F.coalesce(F.bit_or(F.when(F.col("k") == k, F.col("bits"))), F.lit(0).cast("long")) for k in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name", "word")
    return rows.agg((of[0].bitwiseAND(F.bitwise_not(of[1])).bitwiseOR(of[2])).alias("bits")).where("bits != 0")


def _asked(searches: DataFrame) -> DataFrame:
    """A row for each name of a search: search_id, name, role (0 all, 1 any, 2 none) and what the search asks for."""
    wanted = {}
    for c in LISTS:
        names = F.transform(F.array_compact(c), F.lower) if c in searches.columns else F.array().cast("array<string>")
        wanted[c] = F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))
    of = lambda names, role: F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(role).alias("role")))
    roles = [of(names, role) for role, names in enumerate(wanted.values())]
    n_all, n_any = F.size(wanted["ingredients"]), F.size(wanted["any_ingredients"])
    live = F.when(n_all + n_any == 0, F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("role")))).otherwise(F.array().cast("array<struct<name:string,role:int>>"))
    rows = searches.select("search_id", F.greatest(n_all, F.lit(1)).alias("n_all"), n_all.alias("named"), n_any.alias("n_any"), F.explode(F.concat(*roles, live)).alias("x"))
    return rows.select("search_id", "n_all", "named", "n_any", "x.name", "x.role")


def lookup(words: DataFrame, searches: DataFrame) -> DataFrame:
    """search_id, word and bits of the dishes that have all `ingredients`, one of `any_ingredients` and none of `exclude_ingredients`.

    Each list may be missing, null or empty, which asks for nothing. The rows of the names that are asked for are dealt by
    word, so a search's rows of a word meet where they are and only the names' own rows move. Searches with a list read
    their names' rows; those that only exclude read those of every dish, which is their answer's size.
    """
    turns = max(1, -(-searches.count() // SENT))
    if turns > 1:
        turn = F.pmod(F.xxhash64("search_id"), F.lit(turns))
        return reduce(DataFrame.unionByName, (_lookup(words, searches.where(turn == i)) for i in range(turns)))
    return _lookup(words, searches)


def _lookup(words: DataFrame, searches: DataFrame) -> DataFrame:
    asked = _asked(searches)
    known = F.broadcast(asked.select(F.col("name").alias("known")).distinct())
    rows = words.join(known, words["name"].eqNullSafe(known["known"]), "left_semi").repartition("word")
    rows = rows.join(F.broadcast(asked), rows["name"].eqNullSafe(asked["name"])).select("search_id", "word", "bits", "n_all", "named", "n_any", "role")
    bits = lambda role: F.when(F.col("role") == role, F.col("bits"))
    rows = rows.groupBy("search_id", "word").agg(
        F.first("n_all").alias("n_all"), F.first("named").alias("named"), F.first("n_any").alias("n_any"), F.count(bits(0)).alias("met"),
        F.bit_and(bits(0)).alias("all"), F.bit_or(bits(1)).alias("any"), F.coalesce(F.bit_or(bits(2)), F.lit(0).cast("long")).alias("none"),
    )
    every = F.lit(-1).cast("long")
    has_all = F.when((F.col("named") == 0) & (F.col("n_any") > 0), every).when(F.col("met") == F.col("n_all"), F.col("all")).otherwise(F.lit(0).cast("long"))
    has_any = F.when(F.col("n_any") == 0, every).otherwise(F.coalesce("any", F.lit(0).cast("long")))
    return rows.select("search_id", "word", has_all.bitwiseAND(has_any).bitwiseAND(F.bitwise_not("none")).alias("bits")).where("bits != 0")


def dishes_of(found: DataFrame) -> DataFrame:
    """search_id and dish_id, a row for each bit."""
    place = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(1) == 1)).alias("i")
    return found.select("search_id", "word", place).select("search_id", (F.col("word") * 64 + F.col("i")).alias("dish_id"))


def counts_of(found: DataFrame) -> DataFrame:
    """search_id and n, the number of its dishes; searches that find none have no row."""
    return found.groupBy("search_id").agg(F.sum(F.bit_count("bits")).alias("n"))


def counts(words: DataFrame, searches: DataFrame) -> DataFrame:
    """counts_of the searches' lookup, with equal searches looked up once."""
    held = [c for c in LISTS if c in searches.columns]
    asks = F.to_json(F.struct(F.lit(0).alias("x"), *(F.array_sort(F.array_distinct(F.transform(c, F.lower))).alias(c) for c in held)))
    rows = searches.select("search_id", asks.alias("asks"), *held)
    each = written(rows.select("asks", *held).dropDuplicates(["asks"]).withColumn("no", F.monotonically_increasing_id()), "searches")
    found = counts_of(lookup(words, each.select(F.col("no").alias("search_id"), *held)))
    told = each.select("asks", "no").join(found, each["no"] == found["search_id"]).select("asks", "n")
    return rows.select("search_id", "asks").join(told, "asks").select("search_id", "n")
