"""Registered queries over the driver's tables: name -> query, and name -> the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import fmt, units
from larder.functions.text import stable_hash
from larder.functions.urls import canonical_url
from larder.operators import bitmaps, checks, grocery, many, matcher, name_index, rule_state, rules, runs, scoring, search
from larder.plans.catalogue import load, view
from larder.plans.shared import scratch
from larder.registry import ORACLE_SQL, QUERIES, query
from larder.sources.pages import dedupe_by_url
from larder.vocab import AISLES, CATEGORIES, MIN_RATED, TAGS


def searched(spark: SparkSession, sf: str, f: search.Filter) -> DataFrame:
    dishes = search.with_names(view(spark, sf, "dishes"), view(spark, sf, "dish_lines"), f)
    found = search.criteria(f)
    return dishes.where(search.where(found)).select("dish_id", search.match_count(found).cast("long").alias("match_count"))


def filter_query(name: str, f: search.Filter, where: str, n: int):
    query(name, f"SELECT dish_id, {n}::BIGINT AS match_count FROM dishes WHERE {where}")(lambda spark, sf: searched(spark, sf, f))


def _names(*names: str) -> str:
    return "SELECT l.name FROM dish_lines l WHERE l.dish_id = dishes.dish_id AND l.name IN (" + ", ".join(f"'{n}'" for n in names) + ")"


S1, S2, S3 = (f"supplier#{i:09d}" for i in (1, 2, 3))
filter_query("F6_requirement_null", search.Filter(max_minutes=30, min_minutes=5, max_active_minutes=20, min_servings=3, min_keeps_days=2, freezer_only=True), "total_minutes <= 30 AND total_minutes >= 5 AND active_minutes <= 20 AND servings >= 3 AND keeps_days >= 2 AND freezer_months > 0", 6)
filter_query("F7_category_inclusion", search.Filter(categories=["Soup", "Breakfast"]), "category IN ('Soup', 'Breakfast')", 1)
filter_query("F8_tags_all", search.Filter(tags=["Cheap", "Vegan"]), "list_has_all(tags, ['Cheap', 'Vegan'])", 1)
filter_query("F9_tags_any", search.Filter(any_tags=["Cheap", "Vegan", "One pot"]), "list_has_any(tags, ['Cheap', 'Vegan', 'One pot'])", 1)
filter_query("F10_exclusion_null", search.Filter(exclude_categories=["Soup", "Chicken"]), "category IS NULL OR category NOT IN ('Soup', 'Chicken')", 1)
filter_query("F11_tags_none", search.Filter(exclude_tags=["Cheap", "Vegan"]), "NOT list_has_any(tags, ['Cheap', 'Vegan'])", 1)
filter_query("J10_any_ingredient", search.Filter(any_ingredients=[S1, S2]), f"EXISTS ({_names(S1, S2)})", 1)
filter_query("J11_no_ingredient", search.Filter(exclude_ingredients=[S1, S2, S3]), f"NOT EXISTS ({_names(S1, S2, S3)})", 1)
filter_query("A9_all_ingredients", search.Filter(ingredients=[S1, S2]), f"(SELECT count(DISTINCT x.name) FROM ({_names(S1, S2)}) x) = 2", 1)


@query("A9J10J11_bitmap_dishes", f"""SELECT 'all' AS search_id, dish_id FROM dishes WHERE (SELECT count(DISTINCT x.name) FROM ({_names(S1, S2)}) x) = 2
  UNION ALL SELECT 'any', dish_id FROM dishes WHERE EXISTS ({_names(S1, S2)}) UNION ALL SELECT 'none', dish_id FROM dishes WHERE NOT EXISTS ({_names(S1, S2, S3)})""")  # fmt: skip
def _(spark, sf):
    asked = [("all", [S1, S2], None, None), ("any", None, [S1, S2], None), ("none", None, None, [S1, S2, S3])]
    searches = spark.createDataFrame(asked, "search_id string, ingredients array<string>, any_ingredients array<string>, exclude_ingredients array<string>")
    return bitmaps.dishes_of(bitmaps.lookup(bitmaps.ingredient_words(view(spark, sf, "dishes"), view(spark, sf, "dish_lines")), searches))


def _baskets(array: str) -> str:
    """A search for each customer: all, any and none of some ingredients, in all combinations, by the customer's number."""
    end = ")" if array == "array(" else "]"
    name = lambda n: f"concat('supplier#', lpad(cast({n} as {'string' if array == 'array(' else 'varchar'}), 9, '0'))"
    some = lambda when, *numbers: f"CASE WHEN {when} THEN {array}{', '.join(map(name, numbers))}{end} END"
    return f"""SELECT c_custkey AS search_id, {some("c_custkey % 2 = 0", "c_custkey % 9 + 1", "c_custkey % 5 + 1")} AS ingredients, {some("c_custkey % 3 = 0", "c_custkey % 7 + 2", "c_custkey % 10 + 3")} AS any_ingredients,
  {some("c_custkey % 5 < 3", "c_custkey % 8 + 1", "c_custkey % 3 + 6")} AS exclude_ingredients FROM """


@query("A9J10J11_bitmap_counts", f"""SELECT search_id, count(*)::BIGINT AS n FROM ({_baskets("[")} customer) s,
  (SELECT dish_id, coalesce(names, []) AS names FROM dishes LEFT JOIN (SELECT dish_id, list(DISTINCT name) AS names FROM dish_lines WHERE name IS NOT NULL GROUP BY 1) USING (dish_id)) d
  WHERE (ingredients IS NULL OR list_has_all(names, ingredients)) AND (any_ingredients IS NULL OR list_has_any(names, any_ingredients)) AND (exclude_ingredients IS NULL OR NOT list_has_any(names, exclude_ingredients)) GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    searches = spark.sql(_baskets("array(") + "{customer}", customer=load(spark, sf, "customer"))
    return bitmaps.counts(bitmaps.ingredient_words(view(spark, sf, "dishes"), view(spark, sf, "dish_lines")), searches)


WIDE = search.Filter(max_minutes=30, min_keeps_days=3, any_tags=["Cheap", "Vegan", "One pot"], exclude_categories=["Soup"], any_ingredients=[S1, S2])
_COUNT = f"""(coalesce(total_minutes <= 30, false)::INT + coalesce(keeps_days >= 3, false)::INT + list_has_any(tags, ['Cheap', 'Vegan', 'One pot'])::INT
  + (category IS NULL OR category <> 'Soup')::INT + (EXISTS ({_names(S1, S2)}))::INT)"""


@query("F14_match_count", f"SELECT dish_id, {_COUNT}::BIGINT AS match_count FROM dishes")
def _(spark, sf):
    dishes = search.with_names(view(spark, sf, "dishes"), view(spark, sf, "dish_lines"), WIDE)
    return dishes.select("dish_id", search.match_count(search.criteria(WIDE)).cast("long").alias("match_count"))


_ORDER = "coalesce(published_at, first_seen_at) DESC, coalesce(source_rating, 0) DESC, dish_id DESC"


@query("O2_search_order", f"SELECT dish_id, row_number() OVER (ORDER BY m DESC, {_ORDER}) AS place, m::BIGINT AS match_count FROM (SELECT *, {_COUNT} AS m FROM dishes WHERE total_minutes <= 30) ORDER BY place LIMIT 50")
def _(spark, sf):
    dishes = search.with_names(view(spark, sf, "dishes"), view(spark, sf, "dish_lines"), WIDE).withColumn("score", F.lit(None).cast("float"))
    top = search.ranked(dishes, search.criteria(WIDE), F.col("total_minutes") <= 30, search.browse_order(), None)
    order = Window.orderBy(F.col("match_count").desc(), *search.browse_order())  # of the top 50 only
    return top.select("dish_id", F.row_number().over(order).cast("long").alias("place"), F.col("match_count").cast("long").alias("match_count"))


TIGHT = search.Filter(max_minutes=9, min_keeps_days=5, freezer_only=True, any_tags=["Slow cooker"], exclude_tags=["Slow cooker"])


_TOLD = "[('min_keeps_days', 'dropped'), ('freezer_only', 'dropped'), ('any_tags', 'dropped')]"
_TIGHT_COUNT = "(coalesce(total_minutes <= 9, false)::INT + coalesce(keeps_days >= 5, false)::INT + coalesce(freezer_months > 0, false)::INT + list_contains(tags, 'Slow cooker')::INT + (NOT list_contains(tags, 'Slow cooker'))::INT)"


@query("X29_relaxation", f"""SELECT dish_id, match_count::INT AS match_count, {_TOLD!r} AS relaxed FROM (SELECT dish_id, {_TIGHT_COUNT} AS match_count, published_at, first_seen_at, source_rating
  FROM dishes WHERE total_minutes <= 9 AND NOT list_contains(tags, 'Slow cooker')) ORDER BY match_count DESC, {_ORDER} LIMIT 50""".replace(repr(_TOLD), "'" + _TOLD.replace("'", "''") + "'"))
def _(spark, sf):
    dishes = view(spark, sf, "dishes").withColumn("score", F.lit(None).cast("float"))
    answer = search.search(dishes, view(spark, sf, "dish_lines"), TIGHT)
    return answer.rows.select("dish_id", "match_count", F.lit(str(answer.relaxations)).alias("relaxed"))


def _searches(array: str) -> str:
    """A search for every customer: a time limit, for most portions, one of two tags, no dish of a category, one of two ingredients."""
    at = lambda values, i: f"{array}{', '.join(repr(v) for v in values)}{']' if array == '[' else ')'}[cast({i} as int)]"
    one = 0 if array != "[" else 1  # Spark's subscripts begin at 0
    name = lambda i: f"concat('supplier#', lpad(cast({i} + 1 as {'string' if array != '[' else 'varchar'}), 9, '0'))"
    many_of = lambda *xs: f"{array}{', '.join(xs)}{']' if array == '[' else ')'}"
    return f"""SELECT c_custkey AS search_id, cast(c_custkey % 40 + 5 as int) AS max_minutes, cast(nullif(c_custkey % 7, 0) as int) AS min_servings, {many_of(at(TAGS, f"c_custkey % 27 + {one}"), at(TAGS, f"c_custkey * 5 % 27 + {one}"))} AS any_tags,
  {many_of(at(CATEGORIES, f"c_custkey % 6 + {one}"))} AS exclude_categories, {many_of(name("c_custkey % 100"), name("c_custkey % 10"))} AS any_ingredients FROM """


@query("X29O2A9_many_searches", f"""SELECT search_id, place, dish_id, match_count, rung, relaxed FROM (
  SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY rung, match_count DESC, {_ORDER}) AS place, min(rung) OVER (PARTITION BY search_id) AS least FROM (
  SELECT *, m + coalesce(p, false)::INT + t + x + i AS match_count, CASE WHEN rung > 0 AND asked AND rung = 2 THEN 2 WHEN rung = 2 THEN 2 WHEN rung = 1 THEN 1 ELSE 0 END AS relaxed FROM (
  SELECT *, CASE WHEN x + i < 2 THEN NULL WHEN m = 1 AND t = 1 AND (p OR NOT asked) THEN 0 WHEN asked AND m = 1 AND t = 1 THEN 1 WHEN NOT asked AND m = 1 THEN 1 WHEN asked AND m = 1 THEN 2 WHEN NOT asked AND w THEN 2 END AS rung FROM (
  SELECT s.search_id, d.*, min_servings IS NOT NULL AS asked, coalesce(total_minutes <= max_minutes, false)::INT AS m, coalesce(total_minutes <= ceil(max_minutes * 1.5), false) AS w, servings >= min_servings AS p,
    list_has_any(tags, any_tags)::INT AS t, (category IS NULL OR NOT list_contains(exclude_categories, category))::INT AS x, coalesce(list_has_any(names, any_ingredients), false)::INT AS i
  FROM ({_searches("[")} customer) s, (SELECT dishes.*, names FROM dishes LEFT JOIN (SELECT dish_id, list(name) AS names FROM dish_lines WHERE name IS NOT NULL GROUP BY 1) USING (dish_id)) d))
  WHERE rung IS NOT NULL)) WHERE rung = least AND place <= 5""")  # fmt: skip
def _(spark, sf):
    searches = spark.sql(_searches("array(") + "{customer}", customer=load(spark, sf, "customer"))
    dishes = view(spark, sf, "dishes").withColumn("score", F.lit(None).cast("float"))
    found = many.search_many(dishes, view(spark, sf, "dish_lines"), searches, limit=5)
    return found.select("search_id", F.col("place").cast("long").alias("place"), "dish_id", "match_count", "rung", F.size("relaxations").alias("relaxed"))


@query("F15_hard_rules", "SELECT dish_id FROM dishes WHERE (total_minutes IS NULL OR total_minutes <= 30) AND (category IS NULL OR category <> 'Soup') AND NOT list_contains(tags, 'Cheap')")
def _(spark, sf):
    rule = lambda kind, value, enabled=True: {"kind": kind, "value": value, "enabled": enabled}
    wanted = [rule("max_minutes", "30"), rule("max_minutes", "soon"), rule("exclude_category", "Soup"), rule("exclude_tag", "Cheap"), rule("exclude_tag", "Vegan", False)]
    return view(spark, sf, "dishes").where(rules.rule_filter(wanted)).select("dish_id")


@query("J1J2_browse_scores", """SELECT o_orderkey AS dish_id, n_name AS source, c_custkey AS user_id, coalesce(score, 50::FLOAT)::DOUBLE AS score,
  row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(score, 50::FLOAT) DESC, o_orderdate DESC, o_orderkey DESC) AS place
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN scores s ON s.user_id = c_custkey AND s.dish_id = o_orderkey""")  # fmt: skip
def _(spark, sf):
    rows = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.col("o_orderkey").alias("dish_id"), F.col("n_name").alias("source"), F.col("c_custkey").alias("user_id"), "o_orderdate")
    rows = rows.join(view(spark, sf, "scores"), ["user_id", "dish_id"], "left")
    score = F.coalesce("score", F.lit(50.0).cast("float"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(score.desc(), F.col("o_orderdate").desc(), F.col("dish_id").desc()))
    return rows.select("dish_id", "source", "user_id", score.cast("double").alias("score"), place.cast("long").alias("place"))


_UNIT = "CASE WHEN unit IS NULL THEN 'each' WHEN unit IN ('T', 'Tbsp.') THEN 'tbsp' WHEN unit = 't' THEN 'tsp' WHEN unit = 'cups' THEN 'cup' WHEN unit = 'smidgen' THEN NULL WHEN unit = 'fluid  ounces' THEN 'fl oz' ELSE unit END"
_DIMENSION = f"CASE WHEN unit = 'smidgen' THEN 'unit:smidgen' WHEN unit IS NULL THEN 'count:each' WHEN unit = 'can' THEN 'count:can' WHEN {_UNIT} IN ('lb', 'oz') THEN 'mass' ELSE 'volume' END"


@query("J5_unit_lookup", f"SELECT {_UNIT} AS canonical, {_DIMENSION} AS dimension, count(*)::BIGINT AS n FROM order_lines GROUP BY ALL")
def _(spark, sf):
    lines = view(spark, sf, "order_lines")
    return lines.groupBy(units.normalize_unit(F.col("unit")).alias("canonical"), units.dimension_key(F.col("unit")).alias("dimension")).agg(F.count("*").alias("n"))


@query("X3_convert", "SELECT l_orderkey, l_linenumber, l_quantity * 453.59237 / 28.349523125 AS oz, l_quantity * 236.5882365 / 4.92892159375 AS tsp, NULL::DOUBLE AS no_can, l_quantity AS same FROM lineitem")
def _(spark, sf):
    q, u = F.col("l_quantity"), F.lit
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", units.convert(q, u("lb"), u("oz")).alias("oz"), units.convert(q, u("cup"), u("tsp")).alias("tsp"), units.convert(q, u("can"), u("oz")).alias("no_can"), units.convert(q, u("can"), u("can")).alias("same"))


_Q = "l_quantity / 7"


@query("X8_fmt_qty", f"""SELECT l_orderkey, l_linenumber, CASE WHEN abs(r - 0.125) <= 0.02 THEN w || '⅛' WHEN abs(r - 0.25) <= 0.02 THEN w || '¼' WHEN abs(r - 1 / 3) <= 0.02 THEN w || '⅓' WHEN abs(r - 0.5) <= 0.02 THEN w || '½'
  WHEN abs(r - 2 / 3) <= 0.02 THEN w || '⅔' WHEN abs(r - 0.75) <= 0.02 THEN w || '¾' WHEN abs(q - floor(q + 0.5)) < 0.01 THEN floor(q + 0.5)::BIGINT::VARCHAR
  ELSE rtrim(rtrim(format('{{:.2f}}', floor(q * 100 + 0.5) / 100), '0'), '.') END AS amount
  FROM (SELECT *, CASE WHEN floor(q + 1e-9) > 0 THEN floor(q + 1e-9)::BIGINT::VARCHAR ELSE '' END AS w, floor((q - floor(q + 1e-9)) * 1000 + 0.5) / 1000 AS r FROM (SELECT l_orderkey, l_linenumber, {_Q} AS q FROM lineitem))""")  # fmt: skip
def _(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fmt.fmt_qty(F.expr(_Q)).alias("amount"))


_LINES = f""", rows AS (
  SELECT p.*, o.title, l.position, l.raw_text, l.ingredient_id, l.qty, l.unit, l.optional, i.name, i.aisle,
    CASE WHEN l.ingredient_id IS NOT NULL THEN l.ingredient_id::VARCHAR ELSE 'raw:' || trim(regexp_replace(replace(replace(lower(l.raw_text), 'â', 'a~'), 'é', 'e~'), '[^a-z0-9]+', '-', 'g'), '-') END AS identity,
    row_number() OVER (PARTITION BY p.list_id ORDER BY pick_order, l.position) AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY saved_at, dish_id) AS pick_order FROM picks) p
  JOIN orders_as_dishes o USING (dish_id) JOIN order_lines l USING (dish_id) LEFT JOIN ingredients i USING (ingredient_id)),
keyed AS (SELECT *, identity || ':' || CASE WHEN qty IS NULL THEN 'unspecified' ELSE {_DIMENSION} END AS key, qty * greatest(1, least(4, batches)) AS amount FROM rows)"""


def _list_lines(spark, sf):
    return grocery.list_lines(*(view(spark, sf, v) for v in ("picks", "orders_as_dishes", "order_lines", "ingredients")))


@query("W1W2_line_sequence", f"{_LINES} SELECT list_id, dish_id, position, seq, key, amount FROM keyed")
def _(spark, sf):
    return _list_lines(spark, sf).select("list_id", "dish_id", "position", F.col("seq").cast("long").alias("seq"), "key", "amount")


@query("A1A4_grocery_buckets", f"""{_LINES} SELECT list_id, key, min(identity) AS identity, min(seq) AS ord,
  (array_agg(coalesce(nullif(trim(name), ''), trim(raw_text)) ORDER BY ingredient_id IS NULL, pick_order, position))[1] AS name,
  (array_agg(aisle ORDER BY ingredient_id IS NULL, pick_order, position))[1] AS aisle,
  string_agg(title, '|' ORDER BY seq) AS titles, count(qty)::BIGINT AS n, round(coalesce(sum(amount), 0), 6) AS amount, bool_or(qty IS NULL) AS approximate, bool_and(optional) AS optional
  FROM keyed GROUP BY list_id, key""")  # fmt: skip
def _(spark, sf):
    b = grocery.buckets(_list_lines(spark, sf), repeated=True)
    total = F.aggregate("amounts", F.lit(0.0), lambda a, x: a + x["amount"])
    return b.select("list_id", "key", "identity", F.col("ord").cast("long").alias("ord"), "name", "aisle", F.array_join("titles", "|").alias("titles"), F.size("amounts").cast("long").alias("n"), F.round(total, 6).alias("amount"), "approximate", "optional")


_FACTORS = "MAP {" + ", ".join(f"'{u}': {f!r}::DOUBLE" for u, f in units.FACTOR.items()) + "}"
_GLYPH = " ".join(f"WHEN abs(r - {v!r}) <= 0.02 THEN w || '{g}'" for v, g in fmt.GLYPHS)
_AISLE_LIST = "[" + ", ".join(f"'{a}'" for a in AISLES) + "]"
_LIST = f"""{_LINES}, used AS (SELECT *, {_UNIT} AS canonical FROM keyed),
bucket AS (SELECT list_id, key, min(identity) AS identity, min(seq) AS ord,
  (array_agg(coalesce(nullif(trim(name), ''), trim(raw_text)) ORDER BY ingredient_id IS NULL, pick_order, position))[1] AS name,
  (array_agg(aisle ORDER BY ingredient_id IS NULL, pick_order, position))[1] AS aisle, list(title ORDER BY seq) AS titles,
  count(qty) AS n, bool_or(qty IS NULL) AS approximate, bool_and(optional) AS optional FROM used GROUP BY list_id, key),
hosts AS (SELECT list_id, identity, arg_min(key, ord) AS host FROM bucket WHERE n > 0 GROUP BY list_id, identity),
moved AS (SELECT b.*, CASE WHEN b.n = 0 AND h.host IS NOT NULL THEN h.host ELSE b.key END AS goes, b.n = 0 AND h.host IS NOT NULL AS loose FROM bucket b LEFT JOIN hosts h USING (list_id, identity)),
titled AS (SELECT list_id, key, string_agg(title, '|' ORDER BY i) AS titles FROM (
  SELECT list_id, key, title, min(i) AS i FROM (SELECT list_id, goes AS key, unnest(titles) AS title, (loose::INT * 1000000 + ord) * 10000 + generate_subscripts(titles, 1) AS i FROM moved) GROUP BY ALL) GROUP BY list_id, key),
folded AS (SELECT list_id, goes AS key, max(identity) FILTER (NOT loose) AS identity, max(ord) FILTER (NOT loose) AS ord, max(name) FILTER (NOT loose) AS name, max(aisle) FILTER (NOT loose) AS aisle, sum(n) AS n,
  bool_or(approximate OR loose) AS approximate, bool_and(optional) AS optional FROM moved GROUP BY list_id, goes),
asked AS (SELECT list_id, key, canonical AS unit, count(*) AS n, min(seq) AS first FROM used WHERE qty IS NOT NULL AND canonical IS NOT NULL GROUP BY ALL),
totals AS (SELECT a.*, (SELECT list_sum(list(CASE WHEN u.canonical = a.unit THEN u.amount ELSE u.amount * {_FACTORS}[u.canonical] / {_FACTORS}[a.unit] END ORDER BY u.seq)) FROM used u WHERE u.list_id = a.list_id AND u.key = a.key AND u.qty IS NOT NULL) AS total FROM asked a),
chosen AS (SELECT list_id, key, unit, total FROM totals QUALIFY row_number() OVER (PARTITION BY list_id, key ORDER BY total < 1, CASE WHEN total >= 1 THEN round(total, 9) ELSE -round(total, 9) END, n DESC, first) = 1),
raws AS (SELECT list_id, key, sum(amount) AS total, arg_min(coalesce(unit, ''), seq) AS unit FROM used WHERE qty IS NOT NULL GROUP BY ALL),
items AS (SELECT f.*, t.titles, coalesce(CASE WHEN list_contains({_AISLE_LIST}, f.aisle) THEN f.aisle END, 'Other') AS shelf, CASE WHEN f.n > 0 THEN coalesce(c.total, r.total) END AS qty, CASE WHEN f.n > 0 THEN coalesce(c.unit, r.unit) END AS unit
  FROM folded f JOIN titled t USING (list_id, key) LEFT JOIN chosen c USING (list_id, key) LEFT JOIN raws r USING (list_id, key))
SELECT list_id, key, name, shelf AS aisle, round(qty, 6) AS qty, unit, approximate OR n = 0 AS approximate, optional, titles,
  row_number() OVER (PARTITION BY list_id ORDER BY list_position({_AISLE_LIST}, shelf), lower(strip_accents(name)), ord) AS place FROM items"""


@query("A17A18_grocery_list", _LIST)
def _(spark, sf):
    items = grocery.grocery_list(*(view(spark, sf, v) for v in ("picks", "orders_as_dishes", "order_lines", "ingredients")))
    return items.drop("amount").withColumn("titles", F.array_join("titles", "|")).withColumn("qty", F.round("qty", 6)).withColumn("place", F.col("place").cast("long"))


@query("O7_aisle_order", "SELECT ingredient_id, coalesce(list_position([" + ", ".join(f"'{a}'" for a in AISLES) + "], aisle) - 1, 10)::BIGINT AS walk FROM ingredients")
def _(spark, sf):
    walk = units.lookup({a: i for i, a in enumerate(AISLES)}, F.col("aisle"))
    return view(spark, sf, "ingredients").select("ingredient_id", F.coalesce(walk, F.lit(len(AISLES))).cast("long").alias("walk"))


_OBSERVED = """, observed AS (
  SELECT user_id, 'max_minutes' AS kind, t::VARCHAR AS value, rating FROM cooked, (VALUES (30), (60), (90)) v(t) WHERE total_minutes > t
  UNION ALL SELECT user_id, 'exclude_category', category, rating FROM cooked WHERE category IS NOT NULL
  UNION ALL SELECT user_id, 'exclude_tag', unnest(tags), rating FROM cooked)"""


@query("A10A11_observations", f"{_OBSERVED} SELECT user_id, kind, value, count(*)::BIGINT AS n, sum(rating)::BIGINT AS total FROM observed GROUP BY ALL")
def _(spark, sf):
    return rules.observations(view(spark, sf, "cooked")).groupBy("user_id", "kind", "value").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))


_DERIVED = f"""{_OBSERVED}, g AS (SELECT user_id, kind, value, count(*)::BIGINT AS observations, median(rating) AS m FROM observed GROUP BY ALL HAVING count(*) >= 5 AND median(rating) <= 2.5)
  SELECT user_id, kind || ':' || value AS rule_id, kind, value, observations, floor(m * 10 + 0.5) / 10 AS median_rating FROM g WHERE kind <> 'max_minutes'
  OR value::INT = (SELECT max(h.value::INT) FROM g h WHERE h.user_id = g.user_id AND h.kind = 'max_minutes')"""


@query("A12A13_derived_rules", _DERIVED)
def _(spark, sf):
    return rules.derive_rules(rules.observations(view(spark, sf, "cooked")))


@query("A12A13_kept_rules", _DERIVED)
def _(spark, sf):
    cooked = view(spark, sf, "cooked")
    old, late = cooked.where("user_id % 3 > 0 OR rating < 4"), cooked.where("user_id % 3 = 0 AND rating >= 4")
    wrong = cooked.where("user_id % 7 = 0").withColumn("rating", F.lit(1))  # cooks that are taken back again
    kept = rule_state.merge(rule_state.histograms(old), rule_state.histograms(wrong))
    return rule_state.update(kept, rule_state.rules_from(kept), late, wrong)[1]


@query("A8_cold_start", f"SELECT user_id, count(DISTINCT dish_id)::BIGINT AS rated FROM (SELECT o_custkey AS user_id, l_partkey AS dish_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY ALL HAVING count(DISTINCT dish_id) >= {MIN_RATED}")
def _(spark, sf):
    rows = load(spark, sf, "orders").join(load(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count_distinct("l_partkey").alias("rated")).where(F.col("rated") >= MIN_RATED)


@query("J7_unnest_tags", "SELECT dish_id, unnest(tags) AS tag FROM dishes")
def _(spark, sf):
    return view(spark, sf, "dishes").select("dish_id", F.explode("tags").alias("tag"))


@query("J8_latest_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(spark, sf):
    latest = load(spark, sf, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return latest.select("user_id", "e.event_id", "e.event_type")


@query("J13W6_unscored_batches", """SELECT user_id, dish_id, ((n - 1) // 20)::BIGINT AS batch, ((n - 1) % 20 + 1)::BIGINT AS ref FROM (
  SELECT o_custkey AS user_id, o_orderkey AS dish_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.user_id = o_custkey AND s.dish_id = o_orderkey)) WHERE n <= 400""")  # fmt: skip
def _(spark, sf):
    pairs = load(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("dish_id"), F.col("o_orderdate").alias("published_at"))
    rows = scoring.in_batches(scoring.unscored(pairs, view(spark, sf, "scores")))
    return rows.select("user_id", "dish_id", F.col("batch").cast("long").alias("batch"), F.col("ref").cast("long").alias("ref"))


@query("O5_recent_cooks", "SELECT user_id, event_id, n AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 50")
def _(spark, sf):
    logs = load(spark, sf, "events").withColumnRenamed("ts", "cooked_at").withColumnRenamed("event_id", "log_id")
    return scoring.recent(logs).select("user_id", F.col("log_id").alias("event_id"), F.col("place").cast("long").alias("place"))


@query("U1_union_users", "SELECT user_id FROM events UNION SELECT o_custkey FROM orders")
def _(spark, sf):
    return load(spark, sf, "events").select("user_id").union(load(spark, sf, "orders").select("o_custkey")).distinct()


@query("A6_status_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O')::BIGINT AS open, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS filled, count(*) FILTER (WHERE o_orderstatus = 'P')::BIGINT AS partial FROM orders")
def _(spark, sf):
    status = F.col("o_orderstatus")
    return load(spark, sf, "orders").agg(F.count_if(status == "O").alias("open"), F.count_if(status == "F").alias("filled"), F.count_if(status == "P").alias("partial"))


@query("I9_budget_window", """SELECT event_type AS kind, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(coalesce(value, 0)), 6) AS spent, count(*)::BIGINT AS calls, coalesce(sum(value), 0) >= 90 AS closed FROM events GROUP BY ALL""")
def _(spark, sf):
    rows = load(spark, sf, "events").groupBy(F.col("event_type").alias("kind"), F.window("ts", "1 day").alias("w"))
    rows = rows.agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("s"), F.count("*").alias("calls"))
    return rows.select("kind", F.col("w.start").cast("timestamp_ntz").alias("day"), F.round("s", 6).alias("spent"), "calls", (F.col("s") >= 90).alias("closed"))


@query("A3_ordered_turns", "SELECT conv_id, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS turns, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def _(spark, sf):
    one = F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("t"))
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "|")
    return load(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"), F.count("*").alias("n"))


@query("A21_missing_profile", "SELECT source, count(*)::BIGINT AS n, count(*) FILTER (WHERE l.doc_id IS NULL)::BIGINT AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def _(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic").isNull()).alias("unlabelled"))


@query("X11_alias_key", "SELECT DISTINCT lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS alias FROM part")
def _(spark, sf):
    return load(spark, sf, "part").select(fmt.alias_key(F.col("p_name")).alias("alias")).distinct()


@query("X16_content_hash", """SELECT doc_id, sha256(concat('{"doc_id":', coalesce(doc_id::VARCHAR, 'null'), ',"lang":', coalesce('"' || nullif(lang, 'de') || '"', 'null'), ',"n_chars":', coalesce(n_chars::VARCHAR, 'null'), ',"source":', coalesce('"' || nullif(source, 'src1') || '"', 'null'), '}')) AS content_hash FROM documents""")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", stable_hash(source=F.nullif("source", F.lit("src1")), lang=F.nullif("lang", F.lit("de")), doc_id=F.col("doc_id"), n_chars=F.col("n_chars")).alias("content_hash"))


_TRIGRAMS = """, grams AS (SELECT name, unnest(list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN generate_series(1, length(w) + 1)] FOR w IN string_split(lower(name), ' ')]))) AS g FROM (SELECT DISTINCT p_name AS name FROM part)),
sizes AS (SELECT name, count(*) AS n FROM grams GROUP BY name)"""


_SIMILAR = f"""WITH {_TRIGRAMS.lstrip(", ")} SELECT a.name AS name, b.name AS alias, round((count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)))::FLOAT::DOUBLE, 6) AS similarity
  FROM grams a JOIN grams b USING (g) JOIN sizes x ON x.name = a.name JOIN sizes y ON y.name = b.name GROUP BY a.name, b.name HAVING (count(*)::DOUBLE / (any_value(x.n) + any_value(y.n) - count(*)))::FLOAT::DOUBLE > 0.3"""


@query("X27_trigram_similarity", _SIMILAR)
def _(spark, sf):
    names = load(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    near = matcher.similar_names(names, names.select(F.col("name").alias("alias"), F.lit(1).alias("ingredient_id")), 0.3)
    return near.select("name", "alias", F.round(F.col("similarity").cast("double"), 6).alias("similarity"))


@query("J15I13_name_index", _SIMILAR)
def _(spark, sf):
    names = load(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    part = lambda where: names.where(where).select(F.col("name").alias("alias"), F.lit(1).alias("ingredient_id"))
    index = name_index.NameIndex(spark, scratch(spark, "names"))
    index.build(part("crc32(name) % 8 > 1"), 0.3)
    index.add(part("crc32(name) % 8 = 1"))
    index.add(part("crc32(name) % 8 < 2"))
    return index.find(names).select("name", "alias", F.round(F.col("similarity").cast("double"), 6).alias("similarity"))


_KEY = "CASE p_partkey % 6 WHEN 0 THEN 'https://example.com/p/' || p_partkey || '?a=' || p_size || '&b=2' WHEN 1 THEN 'https://example.com/' WHEN 2 THEN 'https://example.com:8080/X' WHEN 3 THEN 'no url ' || p_partkey WHEN 4 THEN 'https://example.com/a//b?a=1&a=0&z=' ELSE NULL END"


@query("X13_canonical_url", f"SELECT p_partkey, {_KEY} AS url_key FROM part")
def _(spark, sf):
    shapes = [
        F.concat(F.lit(" HTTP://www.Example.com/p/"), F.col("p_partkey"), F.lit("/?UTM_Source=x&b=2&ref=y&fbclid2=q&a="), F.col("p_size"), F.lit("#top")),
        F.lit("http://EXAMPLE.com:80"), F.lit("https://www.example.com:8080/X/?gclid=1"), F.concat(F.lit("no url "), F.col("p_partkey")), F.lit("https://example.com:443/a//b//?z=&a=1&a=0&mc_eid=5"), F.lit(None).cast("string"),
    ]
    url = F.get(F.array(*shapes), (F.col("p_partkey") % 6).cast("int"))
    return load(spark, sf, "part").select("p_partkey", canonical_url(url).alias("url_key"))


@query("U2_dedupe_by_url", """SELECT 'https://example.com/' || user_id AS url_key, arg_min('http://www.example.com/' || user_id || '/?utm_id=' || event_id, event_id) AS url,
  arg_min(CASE WHEN event_id % 3 > 0 THEN ts END, CASE WHEN event_id % 3 > 0 THEN event_id END) AS published_at, arg_min(CASE WHEN event_id % 5 = 0 THEN event_type END, CASE WHEN event_id % 5 = 0 THEN event_id END) AS title FROM events GROUP BY user_id""")  # fmt: skip
def _(spark, sf):
    url = F.concat(F.lit("http://www.example.com/"), F.col("user_id"), F.lit("/?utm_id="), F.col("event_id"))
    at = F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("timestamp_ntz")).alias("published_at")
    return dedupe_by_url(load(spark, sf, "events").select(url.alias("url"), at, F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("title"), F.col("event_id").alias("ord")))


@query("A15_run_rollup", """WITH latest AS (SELECT event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1),
  named AS (SELECT *, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'partial' ELSE 'success' END AS status FROM latest)
  SELECT CASE WHEN count(*) FILTER (WHERE status = 'error') = count(*) THEN 'error' WHEN count(*) FILTER (WHERE status <> 'success') > 0 THEN 'partial' ELSE 'success' END AS status,
  sum(event_id % 7)::BIGINT AS found, sum(event_id % 3)::BIGINT AS new, max(ts) AS latest FROM named""")  # fmt: skip
def _(spark, sf):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "partial").otherwise("success")
    at, n = F.col("ts").cast("timestamp_ntz"), F.col("event_id")
    rows = load(spark, sf, "events").select(n.alias("run_id"), F.col("user_id").alias("source_id"), status.alias("status"), (n % 7).alias("found"), (n % 3).alias("new"), at.alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    return runs.rollup(runs.latest_runs(rows))


@query("Q1_dish_violations", """SELECT dish_id, unnest(list_filter([CASE WHEN dish_id % 4 = 0 THEN 'tags_known' END, CASE WHEN dish_id % 6 = 0 AND category IS NOT NULL THEN 'category_known' END,
  CASE WHEN source_rating * 2 > 5 THEN 'rating_range' END, CASE WHEN active_minutes * 3 > total_minutes THEN 'minutes_order' END], lambda x: x IS NOT NULL)) AS rule FROM dishes""")  # fmt: skip
def _(spark, sf):
    spoiled = view(spark, sf, "dishes").withColumns({
        "tags": F.when(F.col("dish_id") % 4 == 0, F.array_append("tags", F.lit("Secret"))).otherwise(F.col("tags")), "category": F.when((F.col("dish_id") % 6 == 0) & F.col("category").isNotNull(), "Cake").otherwise(F.col("category")),
        "source_rating": F.col("source_rating") * 2, "active_minutes": F.col("active_minutes") * 3,
    })
    return checks.violations(spoiled, "dish_id", checks.dish_rules())


@query("Q2_repeated_names", "SELECT p_name, count(*)::BIGINT AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1")
def _(spark, sf):
    return checks.repeated(load(spark, sf, "part"), "p_name")
