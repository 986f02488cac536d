"""Shopping lists: picks x lines x ingredients, merged by what may be added up, with a unit chosen for print.

picks (list_id, dish_id, batches, saved_at), dishes (dish_id, title), lines (dish_id, position, raw_text, ingredient_id,
qty, unit, optional), ingredients (ingredient_id, name, aisle). Everything is keyed by list_id, so many lists are one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.fmt import fmt_line, half_up
from larder.functions.text import nfkd
from larder.functions.units import FACTOR, dimension_key, lookup, normalize_unit
from larder.vocab import AISLES, BATCHES


def slug(text: Column) -> Column:
    """Lower-case words of a raw line joined by dashes, 80 characters at most, "unknown" if nothing is left.

    Accented letters are taken apart, and their marks are dashes: two spellings never share a key by losing letters.
    """
    s = F.regexp_replace(F.regexp_replace(nfkd(F.lower(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, 80), "^$", "unknown")


def identity_key(ingredient_id: Column, raw_text: Column) -> Column:
    """The ingredient's id as it is, or the line's own words."""
    return F.coalesce(ingredient_id.cast("string"), F.concat(F.lit("raw:"), slug(F.when(ingredient_id.isNull(), raw_text))))


def clamp_batches(batches: Column) -> Column:
    return F.greatest(F.lit(BATCHES[0]), F.least(F.lit(BATCHES[1]), half_up(F.coalesce(batches, F.lit(1)).cast("double")))).cast("int")


def pick_order(picks: DataFrame) -> DataFrame:
    """Picks with pick_order, by saved_at then dish_id within a list."""
    return picks.withColumn("pick_order", F.row_number().over(Window.partitionBy("list_id").orderBy("saved_at", "dish_id")))


def list_lines(picks: DataFrame, dishes: DataFrame, lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """The lines of the picked dishes with amount (qty x batches, as double), identity, key and seq. Unknown dishes drop out."""
    rows = pick_order(picks).join(dishes.select("dish_id", "title"), "dish_id").join(lines, "dish_id")
    rows = rows.join(ingredients.select("ingredient_id", "name", "aisle"), "ingredient_id", "left")
    identity = identity_key(F.col("ingredient_id"), F.col("raw_text"))
    key = F.concat_ws(":", identity, F.when(F.col("qty").isNull(), "unspecified").otherwise(dimension_key(F.col("unit"))))
    rows = rows.withColumn("amount", F.col("qty").cast("double") * clamp_batches(F.col("batches"))).withColumn("identity", identity).withColumn("key", key)
    display = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.trim("raw_text"))
    seq = F.row_number().over(Window.partitionBy("list_id").orderBy("pick_order", "position"))  # a list has its picks' lines at most
    rows = rows.withColumn("canonical", normalize_unit(F.col("unit")))
    return rows.withColumn("factor", lookup(FACTOR, F.col("canonical"))).withColumn("display", display).withColumn("seq", seq)


def buckets(rows: DataFrame, repeated: bool = False) -> DataFrame:
    """One row per list and key: what may be added up, in order of contribution, and the titles, each once or, repeated, one a line.

    Name and aisle come from the first mapped line, else the first line.
    """
    first = F.struct(F.col("ingredient_id").isNull(), "pick_order", "position")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"])
    amounts = F.array_sort(F.collect_list(F.when(F.col("qty").isNotNull(), F.struct("seq", "amount", F.col("canonical").alias("unit"), "factor", F.col("unit").alias("raw_unit")))))
    return rows.groupBy("list_id", "key").agg(
        F.min("identity").alias("identity"),
        F.min("seq").alias("ord"),
        F.min_by("display", first).alias("name"),
        F.min_by("aisle", first).alias("aisle"),
        (titles if repeated else F.array_distinct(titles)).alias("titles"),
        amounts.alias("amounts"),
        F.bool_or(F.col("qty").isNull()).alias("approximate"),
        F.bool_and(F.coalesce("optional", F.lit(False))).alias("optional"),
    )


def fold_unspecified(b: DataFrame) -> DataFrame:
    """Buckets without a quantity fold into the earliest quantified bucket of their identity, where there is one."""
    first = F.min(F.when(F.size("amounts") > 0, F.struct("ord", "key"))).over(Window.partitionBy("list_id", "identity"))
    rows = b.withColumn("host", first["key"])
    loose = (F.size("amounts") == 0) & F.col("host").isNotNull()
    rows = rows.withColumn("into", F.when(loose, F.col("host")).otherwise(F.col("key"))).withColumn("loose", loose)
    own = lambda c: F.max(F.when(~F.col("loose"), F.col(c))).alias(c)
    titles = F.transform(F.array_sort(F.collect_list(F.struct("loose", "ord", "titles"))), lambda x: x["titles"])
    return rows.groupBy("list_id", F.col("into").alias("key")).agg(
        own("identity"), own("ord"), own("name"), own("aisle"), F.array_distinct(F.flatten(titles)).alias("titles"), F.max_by("amounts", F.size("amounts")).alias("amounts"),
        F.bool_or(F.col("approximate") | F.col("loose")).alias("approximate"), F.bool_and("optional").alias("optional"),
    )


def choose_unit(b: DataFrame) -> DataFrame:
    """qty and unit for print: among the units used, the smallest total of one or more, else the largest total.

    Ties go to the unit used most, then first. Totals add up in order of contribution. The lines of a bucket share a
    dimension, so each converts to each; a line in the unit asked for is taken as it is.
    """
    index = F.transform("amounts", lambda x, i: F.struct(i.alias("i"), x["unit"].alias("unit")))
    units = F.array_distinct(F.transform(F.filter("amounts", lambda x: x["unit"].isNotNull()), lambda x: F.struct(x["unit"].alias("unit"), x["factor"].alias("factor"))))
    total = lambda u: F.aggregate("amounts", F.lit(0.0), lambda acc, x: acc + F.when(x["unit"] == u["unit"], x["amount"]).otherwise(x["amount"] * x["factor"] / u["factor"]))
    made = F.transform(units, lambda u: F.struct(
        F.size(F.filter("amounts", lambda x: x["unit"] == u["unit"])).alias("n"),
        F.array_min(F.transform(F.filter(index, lambda x: x["unit"] == u["unit"]), lambda x: x["i"])).alias("first"),
        total(u).alias("total"), u["unit"].alias("unit"),
    ))
    rows = b.withColumn("made", F.filter(made, lambda m: m["total"].isNotNull()))
    usable = F.filter("made", lambda m: m["total"] >= 1)
    ranked = lambda arr, sign: F.array_min(F.transform(arr, lambda m: F.struct((m["total"] * sign).alias("t"), (-m["n"]).alias("n"), m["first"], m["total"].alias("total"), m["unit"].alias("unit"))))
    best = F.when(F.size(usable) > 0, ranked(usable, 1.0)).otherwise(ranked(F.col("made"), -1.0))
    raw = F.aggregate("amounts", F.lit(0.0), lambda acc, x: acc + x["amount"])
    rows = rows.withColumn("best", best)
    none = F.size("amounts") == 0
    known = F.col("best").isNotNull()
    return rows.select(
        "list_id", "key", "identity", "ord", "name", "titles", "optional",
        F.coalesce(F.when(F.col("aisle").isin(*AISLES), F.col("aisle")), F.lit(AISLES[-1])).alias("aisle"),
        F.when(none, None).when(known, F.col("best.total")).otherwise(raw).alias("qty"),
        F.when(none, None).when(known, F.col("best.unit")).otherwise(F.get("amounts", F.lit(0))["raw_unit"]).alias("unit"),
        (F.col("approximate") | none).alias("approximate"),
    )


def grocery_list(picks: DataFrame, dishes: DataFrame, lines: DataFrame, ingredients: DataFrame) -> DataFrame:
    """The printable list: list_id, place, key, name, aisle, qty, unit, amount, approximate, optional, titles.

    Aisles in the order of the walk, names without case and accents, equal names in order of contribution.
    """
    items = choose_unit(fold_unspecified(buckets(list_lines(picks, dishes, lines, ingredients))))
    items = items.withColumn("amount", F.when(F.col("qty").isNull(), "").otherwise(fmt_line(F.col("qty"), F.col("unit"))))
    walk = lookup({a: i for i, a in enumerate(AISLES)}, F.col("aisle"))
    order = Window.partitionBy("list_id").orderBy(walk, F.collate("name", "UNICODE_CI_AI"), "ord")
    return items.withColumn("place", F.row_number().over(order)).select("list_id", "place", "key", "name", "aisle", "qty", "unit", "amount", "approximate", "optional", "titles")


def count_items(items: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """list_id, items and ticked: a list's lines, and how many of their keys are among checks (list_id, key)."""
    if checks is None:
        return items.groupBy("list_id").agg(F.count("*").alias("items"), F.lit(0).cast("long").alias("ticked"))
    known = checks.select("list_id", "key").distinct().withColumn("ticked", F.lit(True))
    return items.join(known, ["list_id", "key"], "left").groupBy("list_id").agg(F.count("*").alias("items"), F.count("ticked").alias("ticked"))


def total_servings(picks: DataFrame, dishes: DataFrame) -> DataFrame:
    """list_id and servings of the picks: those of a dish times its batches; a dish without servings adds none."""
    each = F.coalesce("servings", F.lit(0)) * F.col("batches")
    return picks.join(dishes.select("dish_id", "servings"), "dish_id").groupBy("list_id").agg(F.sum(each).alias("servings"))


def list_text(items: DataFrame) -> DataFrame:
    """list_id and text: a heading per aisle, an item per line."""
    line = F.concat_ws("  ", F.concat(F.lit("[ ] "), F.col("name")), F.nullif("amount", F.lit("")))
    aisles = items.groupBy("list_id", "aisle").agg(F.min("place").alias("p"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("t"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("p", F.concat(F.upper("aisle"), F.lit("\n"), F.col("t")).alias("t")))), lambda x: x["t"])
    return aisles.groupBy("list_id").agg(F.array_join(blocks, "\n\n").alias("text"))
