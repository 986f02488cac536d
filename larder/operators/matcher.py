"""Free-text names against known aliases: exactly, then by trigrams, refusing what is ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.fmt import alias_key
from larder.vocab import FUZZY_MARGIN, FUZZY_THRESHOLD


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def similar_names(names: DataFrame, aliases: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """name, alias, ingredient_id, similarity over threshold.

    Of n trigrams, rare ones first, two names whose similarity is t or more share one of the first n - ceil(t * n) + 1
    of each, and their sizes differ by 1 / t at most. Pairs that meet both are compared, as 32-bit floats.
    """
    left = names.select("name").distinct().withColumn("t", trigrams(F.col("name"))).where(F.size("t") > 0)
    right = aliases.select("alias", "ingredient_id").distinct().withColumn("t", trigrams(F.col("alias"))).where(F.size("t") > 0)
    counts = right.select(F.explode("t").alias("g")).groupBy("g").agg(F.count("*").alias("c"))  # as many as there are trigrams

    def prefixes(df: DataFrame, keys: list[str]) -> DataFrame:
        rows = df.select(*keys, F.size("t").alias("n"), F.explode("t").alias("g")).join(counts, "g", "left")
        ranked = rows.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g"))).alias("r"))  # one name's
        size = (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int")
        return ranked.select(*keys, "n", F.explode(F.slice("r", F.lit(1), F.least(size, F.col("n")))).alias("x")).select(*keys, "n", "x.g")

    x, y = prefixes(left, ["name"]), prefixes(right, ["alias", "ingredient_id"]).withColumnRenamed("n", "m")
    near = x.join(y, "g").where(F.least("n", "m") >= F.greatest("n", "m") * F.lit(threshold) - 1e-9).select("name", "alias", "ingredient_id").distinct()
    both = near.join(left, "name").withColumnRenamed("t", "a").join(right.withColumnRenamed("t", "b"), ["alias", "ingredient_id"])
    k = F.size(F.array_intersect("a", "b"))
    both = both.withColumn("similarity", (k / (F.size("a") + F.size("b") - k)).cast("float"))
    return both.where(F.col("similarity").cast("double") > threshold).select("name", "alias", "ingredient_id", "similarity")


def match(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, ingredient_id, how: exact, fuzzy, ambiguous or none. Another ingredient within the margin of the best refuses it."""
    keyed = names.select("name").distinct().withColumn("key", alias_key(F.col("name")))
    exact = keyed.join(aliases.select(F.col("alias").alias("key"), "ingredient_id"), "key").select("name", "ingredient_id", F.lit("exact").alias("how"))
    rest = keyed.join(exact, "name", "left_anti")
    near = similar_names(rest.select(F.col("key").alias("name")).distinct(), aliases)
    best = near.groupBy("name").agg(F.collect_set(F.struct("similarity", "alias", "ingredient_id")).alias("all"))
    top = F.array_min(F.transform("all", lambda x: F.struct((-x["similarity"]).alias("s"), x["alias"].alias("alias"), x["ingredient_id"].alias("i"))))
    best = best.withColumn("t", top).withColumn("rival", F.array_max(F.transform(F.filter("all", lambda x: x["ingredient_id"] != F.col("t.i")), lambda x: x["similarity"])))
    clear = F.col("rival").isNull() | ((-F.col("t.s")).cast("double") - F.col("rival").cast("double") >= FUZZY_MARGIN)
    best = best.select(F.col("name").alias("key"), F.when(clear, F.col("t.i")).alias("ingredient_id"), F.when(clear, "fuzzy").otherwise("ambiguous").alias("how"))
    fuzzy = rest.join(best, "key", "left").select("name", "ingredient_id", F.coalesce("how", F.lit("none")).alias("how"))
    return exact.unionByName(fuzzy)
