"""The driver's tables seen as dishes, lines, ingredients, picks and cooks; each view also as DuckDB SQL.

Columns that the tables lack are derived by arithmetic, with nulls on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larder.vocab import AISLES, CATEGORIES, TAGS


def _list(values, array: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"array({quoted})" if array == "array" else f"[{quoted}]"


UNITS = ("lb", "oz", "Tbsp.", "T", "t", "cups", "can", "smidgen", "fluid  ounces")


def _views(spark: bool) -> dict[str, str]:
    array = "array" if spark else "["
    at = lambda values, i: f"element_at({_list(values, array)}, cast({i} as int))" if spark else f"{_list(values, array)}[cast({i} as int)]"
    distinct = "array_distinct" if spark else "list_distinct"
    tags = ", ".join(at(TAGS, f"{i} % 27 + 1") for i in ("p_partkey", "p_partkey * 7", "(p_partkey - p_partkey % 27) / 27"))
    tags = f"{distinct}({'array' if spark else 'list_value'}({tags}))"
    plus = lambda day, n, unit: f"{day} + make_interval(0, 0, 0, 0, cast({n} as int))" if spark else f"{day} + to_hours(cast({n} as int))"
    dish = f"""p_partkey AS dish_id, p_name AS title, nullif(p_size, 7 * (p_size % 10)) AS total_minutes, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 30 END AS active_minutes,
  p_size % 8 + 1 AS servings, nullif(p_size % 6, 0) AS keeps_days, nullif(p_size % 4, 2) AS freezer_months, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE {at(CATEGORIES, "p_partkey % 6 + 1")} END AS category,
  {tags} AS tags, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE {plus("timestamp '2024-01-01 00:00:00'", "p_partkey % 500", "hours")} END AS published_at,
  {plus("timestamp '2024-02-01 00:00:00'", "p_partkey % 400", "hours")} AS first_seen_at, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE cast(p_partkey % 50 as double) / 10 END AS source_rating"""
    text = "string" if spark else "varchar"
    code = "lpad(cast(p_partkey as string), 8, '0')" if spark else "lpad(cast(p_partkey as varchar), 8, '0')"
    day = lambda n: plus("timestamp '2024-03-01 00:00:00'", n, "hours")
    later = lambda at, seconds: f"{at} + make_interval(0, 0, 0, 0, 0, 0, cast({seconds} as decimal(18, 6)))" if spark else f"{at} + to_seconds({seconds})"
    ts = "cast(ts as timestamp)"
    return {
        "dishes": f"SELECT {dish} FROM part",
        "dish_rows": f"""SELECT {dish}, p_partkey % 25 AS source_id, lower(replace(p_name, ' ', '-')) AS slug, {code} AS share_code, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('All about ', p_name) END AS blurb,
  CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'active' END AS status, CASE WHEN p_partkey % 5 = 1 THEN 'no meal' END AS rejection_reason, {day("p_partkey % 300")} AS last_seen_at,
  concat('https://example.com/p/', cast(p_partkey as {text})) AS source_url, sha2(cast(p_partkey as {text}), 256) AS content_hash, cast(NULL as {text}) AS image_path, cast(NULL as int) AS image_w, cast(NULL as int) AS image_h, cast(NULL as {text}) AS image_source_url,
  p_brand AS author, cast(p_size as int) AS source_rating_count FROM part""".replace("sha2(cast(p_partkey as varchar), 256)", "sha256(cast(p_partkey as varchar))"),
        "feed_sources": "SELECT cast(n_nationkey as bigint) AS source_id, n_name AS name, n_nationkey % 4 <> 0 AS enabled, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'tag' END AS feed_etag FROM nation",
        "dish_scores": "SELECT o_custkey AS user_id, o_orderkey % 1000 + 1 AS dish_id, max(cast(o_totalprice % 100 as float)) AS score, max(o_orderpriority) AS reason FROM orders GROUP BY o_custkey, o_orderkey % 1000 + 1",
        "mapped_lines": f"""SELECT l_partkey AS dish_id, (l_linenumber * 1000000 + l_orderkey) * 10000 + l_suppkey AS position, concat('Raw ', cast(l_suppkey as {text})) AS raw_text, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE l_suppkey END AS ingredient_id,
  l_quantity AS qty, 'cup' AS unit, cast(NULL as {text}) AS note, l_returnflag = 'A' AS optional FROM lineitem""",
        "goods": f"SELECT s_suppkey AS ingredient_id, lower(s_name) AS name, {at(AISLES, 's_suppkey % 10 + 1')} AS aisle FROM supplier",
        "cook_logs": f"SELECT event_id AS log_id, user_id, event_id % 40 + 1 AS dish_id, cast(event_id % 5 + 1 as int) AS rating, {ts} AS cooked_at FROM events",
        "scan_runs": f"""SELECT event_id AS run_id, nullif(user_id % 30, 0) AS source_id, CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'scan' END AS kind, {ts} AS started_at,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE {later(ts, "event_id % 400")} END AS finished_at, CASE WHEN event_id % 6 = 0 THEN 'running' WHEN event_id % 5 = 0 THEN 'error' WHEN event_id % 7 = 0 THEN 'partial' ELSE 'success' END AS status,
  event_id % 9 AS found, event_id % 4 AS new, event_id % 3 AS no_recipe, event_id % 1000 AS tokens_in, event_id % 100 AS tokens_out, coalesce(value, 0) / 1000 AS cost FROM events""",
        "saved": "SELECT o_custkey AS user_id, o_orderkey % 1500 + 1 AS dish_id, cast(min(o_orderkey % 6) as int) AS batches, min(o_orderdate) AS saved_at FROM orders GROUP BY o_custkey, o_orderkey % 1500 + 1",
        "local_saved": "SELECT user_id, event_id % 1600 + 1 AS dish_id, max(cast(event_id % 7 as int)) AS batches FROM events GROUP BY user_id, event_id % 1600 + 1",
        "checks": "SELECT DISTINCT user_id, concat('item-', cast(event_id % 50 as string)) AS item_key FROM events WHERE event_type = 'view'".replace("as string", f"as {text}"),
        "local_checks": "SELECT DISTINCT user_id, concat('item-', cast(event_id % 60 as string)) AS item_key FROM events WHERE event_type = 'click'".replace("as string", f"as {text}"),
        "dish_lines": "SELECT l_partkey AS dish_id, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE lower(s_name) END AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
        "scores": "SELECT o_custkey AS user_id, o_orderkey AS dish_id, cast(o_totalprice % 100 as float) AS score FROM orders WHERE o_orderkey % 2 = 0",
        "ingredients": f"SELECT p_partkey AS ingredient_id, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_name END AS name, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE {at(AISLES, 'p_partkey % 10 + 1')} END AS aisle FROM part",
        "picks": "SELECT o_custkey AS list_id, o_orderkey AS dish_id, cast(o_orderkey % 6 as int) AS batches, o_orderdate AS saved_at FROM orders",
        "orders_as_dishes": "SELECT o_orderkey AS dish_id, concat(o_orderpriority, ' ', cast(o_orderkey % 50 as string)) AS title FROM orders",
        "order_lines": f"""SELECT l_orderkey AS dish_id, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS position, concat(CASE WHEN l_partkey % 3 = 0 THEN '  Pâté été ' ELSE '  Raw Line ' END, cast(l_partkey % 40 as string), '!') AS raw_text, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey END AS ingredient_id,
  CASE WHEN l_linenumber = 4 THEN NULL ELSE l_quantity / 8 END AS qty, CASE WHEN l_linenumber = 3 THEN NULL ELSE {at(UNITS, "(l_orderkey + l_linenumber) % 9 + 1")} END AS unit, l_returnflag = 'A' AS optional FROM lineitem""",
        "cooked": f"""SELECT o_custkey AS user_id, cast(o_orderkey % 5 + 1 as int) AS rating, cast(floor(o_totalprice % 120) as int) AS total_minutes, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE {at(CATEGORIES, "o_orderkey % 6 + 1")} END AS category,
  {'array' if spark else 'list_value'}({at(TAGS, "o_orderkey % 4 + 1")}, {at(TAGS, "o_orderkey % 3 + 11")}) AS tags FROM orders""",
    }


SPARK, DUCK = _views(True), _views(False)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over tables that are passed to spark.sql by name."""
    text = SPARK[name]
    tables = {t: load(spark, sf_dir, t) for t in ("part", "lineitem", "supplier", "orders", "nation", "events") if f"FROM {t}" in text or f"JOIN {t}" in text}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **tables)


def duck(body: str) -> str:
    """body after a WITH of the views that it names."""
    used = [n for n in DUCK if re.search(rf"\b{n}\b", body)]
    return ("WITH " + ", ".join(f"{n} AS ({DUCK[n]})" for n in used) + ("," if body.lstrip().startswith(",") else " ") + body.lstrip().removeprefix(",")) if used else body
