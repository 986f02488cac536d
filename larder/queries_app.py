"""Registered queries of the catalogue's pages, planners, ratings, runs, aliases and stored state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators import aliases as al
from larder.operators import browse, kept_counts, matcher, planner, rules, runs, scoring, search, state
from larder.operators.grocery import count_items, total_servings
from larder.plans.catalogue import load, view
from larder.registry import query
from larder.streaming import budget, work_queue

SINCE = datetime(2024, 3, 5)
_BROWSE = "coalesce(score, 50::FLOAT) DESC, coalesce(published_at, first_seen_at) DESC, coalesce(source_rating, 0) DESC, dish_id DESC"


def _views(spark, sf, *names: str) -> list[DataFrame]:
    return [view(spark, sf, n) for n in names]


@query("F1F3F4_dish_list", f"""SELECT dish_id, name AS source_name, share_code, status, array_to_string(list_sort(tags), '|') AS tags, score::DOUBLE AS score, reason AS score_reason, row_number() OVER (ORDER BY {_BROWSE}) AS place
  FROM dish_rows JOIN feed_sources USING (source_id) LEFT JOIN (SELECT * FROM dish_scores WHERE user_id = 7) USING (dish_id)
  WHERE status = 'active' AND last_seen_at > TIMESTAMP '2024-03-05' AND (total_minutes IS NULL OR total_minutes <= 40) ORDER BY place LIMIT 500""")  # fmt: skip
def _(spark, sf):
    rule = {"kind": "max_minutes", "value": " 40.0", "enabled": True}
    top = browse.list_dishes(*_views(spark, sf, "dish_rows", "feed_sources", "dish_scores"), user_id=7, since=SINCE, rules=[rule], limit=9999)
    place = F.row_number().over(Window.orderBy(*search.browse_order()))  # of the top 500 only
    return top.select("dish_id", "source_name", "share_code", "status", F.array_join(F.array_sort("tags"), "|").alias("tags"), F.col("score").cast("double").alias("score"), "score_reason", place.cast("long").alias("place"))


@query("F1J2_signed_out", f"SELECT dish_id, NULL::DOUBLE AS score, row_number() OVER (ORDER BY coalesce(published_at, first_seen_at) DESC, coalesce(source_rating, 0) DESC, dish_id DESC) AS place FROM dish_rows JOIN feed_sources USING (source_id) ORDER BY place LIMIT 50")
def _(spark, sf):
    top = browse.list_dishes(*_views(spark, sf, "dish_rows", "feed_sources", "dish_scores"), status=None)
    place = F.row_number().over(Window.orderBy(*search.browse_order()))  # of the top 50 only
    return top.select("dish_id", F.col("score").cast("double").alias("score"), place.cast("long").alias("place"))


@query("F2J3_dish_detail", """SELECT d.dish_id, s.name AS source_name, d.blurb, coalesce(l.n, 0)::BIGINT AS n, coalesce(l.lines, '') AS lines FROM dish_rows d JOIN feed_sources s USING (source_id) LEFT JOIN (
  SELECT dish_id, count(*) AS n, string_agg(position || ':' || coalesce(name, '-') || ':' || coalesce(aisle, '-'), '|' ORDER BY position) AS lines FROM mapped_lines LEFT JOIN goods USING (ingredient_id) GROUP BY dish_id) l USING (dish_id) WHERE d.status = 'active'""")  # fmt: skip
def _(spark, sf):
    dishes, sources, scores, lines, goods = _views(spark, sf, "dish_rows", "feed_sources", "dish_scores", "mapped_lines", "goods")
    rows = browse.dish_detail(dishes, sources, scores, lines, goods, F.lit(True))
    line = F.transform("lines", lambda x: F.concat_ws(":", x["position"].cast("string"), F.coalesce(x["name"], F.lit("-")), F.coalesce(x["aisle"], F.lit("-"))))
    return rows.select("dish_id", "source_name", "blurb", F.size("lines").cast("long").alias("n"), F.array_join(line, "|").alias("lines"))


@query("F5X18_by_handle", "SELECT '/R/' || upper(slug) || '-' || share_code || '/' AS handle, dish_id, '/r/' || slug || '-' || share_code AS path FROM dish_rows JOIN feed_sources USING (source_id) WHERE status = 'active'")
def _(spark, sf):
    dishes, sources, scores = _views(spark, sf, "dish_rows", "feed_sources", "dish_scores")
    good = dishes.select(F.concat(F.lit("/R/"), F.upper("slug"), F.lit("-"), F.col("share_code"), F.lit("/")).alias("handle"))
    bad = dishes.select(F.concat(F.lit("/r/"), F.col("slug"), F.lit("-lilou123")).alias("handle"))
    found = browse.by_handle(dishes, sources, scores, good.union(bad.distinct()))
    return found.select("handle", "dish_id", browse.share_path(F.col("slug"), F.col("share_code")).alias("path"))


@query("J12A14_vocabulary", "SELECT DISTINCT name FROM goods WHERE EXISTS (SELECT 1 FROM mapped_lines l JOIN dish_rows d USING (dish_id) WHERE d.status = 'active' AND l.ingredient_id = goods.ingredient_id)")
def _(spark, sf):
    return browse.vocabulary(*_views(spark, sf, "dish_rows", "mapped_lines", "goods"))


@query("O4_next_pending", "SELECT dish_id FROM dish_rows WHERE status = 'pending' ORDER BY first_seen_at, dish_id LIMIT 1")
def _(spark, sf):
    return browse.next_pending(view(spark, sf, "dish_rows")).select("dish_id")


@query("O12_unmapped_lines", "SELECT dish_id, position, raw_text FROM mapped_lines WHERE ingredient_id IS NULL ORDER BY dish_id, position LIMIT 10000")
def _(spark, sf):
    return browse.unmapped_lines(view(spark, sf, "mapped_lines"), 10_000)


@query("O12_first_names", "SELECT DISTINCT lower(p_name) AS name FROM part ORDER BY name LIMIT 40")
def _(spark, sf):
    return browse.first_names(load(spark, sf, "part").select(F.lower("p_name").alias("name")))


@query("F20F27_remaining", "SELECT (SELECT count(*) FROM dish_rows WHERE status = 'pending')::BIGINT AS pending, (SELECT count(*) FROM mapped_lines WHERE ingredient_id IS NULL)::BIGINT AS unmapped")
def _(spark, sf):
    return browse.remaining(*_views(spark, sf, "dish_rows", "mapped_lines"))


_STATUS = "CASE WHEN dish_id % 4 = 1 THEN 'pending' WHEN dish_id % 10 = 0 THEN 'active' ELSE status END"
_MAPPED = "CASE WHEN position % 3 = 0 THEN NULL WHEN ingredient_id IS NULL AND position % 3 = 1 THEN dish_id % 50 + 1 ELSE ingredient_id END"


def _followed(spark, sf):
    """Dishes and lines before, and the changes of their status and mapping."""
    dishes, lines = _views(spark, sf, "dish_rows", "mapped_lines")
    dish_changes = kept_counts.signed(dishes, dishes.withColumn("status", F.expr(_STATUS)), ["dish_id", "status"])
    line_changes = kept_counts.signed(lines, lines.withColumn("ingredient_id", F.expr(_MAPPED)), ["dish_id", "ingredient_id"])
    return dishes, lines, dish_changes, line_changes


@query("J12A14_followed_uses", f"""SELECT ingredient_id, count(*)::BIGINT AS uses FROM (SELECT dish_id, {_MAPPED} AS ingredient_id FROM mapped_lines) WHERE ingredient_id IS NOT NULL
  AND dish_id IN (SELECT dish_id FROM dish_rows WHERE {_STATUS} = 'active') GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    dishes, lines, dish_changes, line_changes = _followed(spark, sf)
    return kept_counts.change_uses(kept_counts.uses(dishes, lines), dishes, lines, dish_changes, line_changes)


@query("F20F27_followed_left", f"SELECT (SELECT count(*) FROM dish_rows WHERE {_STATUS} = 'pending')::BIGINT AS pending, (SELECT count(*) FROM mapped_lines WHERE {_MAPPED} IS NULL)::BIGINT AS unmapped")
def _(spark, sf):
    dishes, lines, dish_changes, line_changes = _followed(spark, sf)
    return kept_counts.change_left(kept_counts.left(dishes, lines), dish_changes, line_changes)


@query("F22_category_chip", "SELECT dish_id, 'Soup' AS chip FROM dish_rows WHERE category = 'Soup' UNION ALL SELECT dish_id, 'All' FROM dish_rows")
def _(spark, sf):
    rows = view(spark, sf, "dish_rows")
    return browse.of_category(rows, "Soup").select("dish_id", F.lit("Soup").alias("chip")).union(browse.of_category(rows, "All").select("dish_id", F.lit("All")))


@query("J18I11_arrivals", "SELECT dish_id FROM dish_rows WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM saved s WHERE s.dish_id = dish_rows.dish_id)")
def _(spark, sf):
    return browse.arrivals(view(spark, sf, "dish_rows").where("status = 'active'"), view(spark, sf, "saved")).select("dish_id")


@query("A23_busiest_dishes", "SELECT dish_id, count(*)::BIGINT AS n FROM mapped_lines GROUP BY dish_id ORDER BY n DESC, dish_id LIMIT 20")
def _(spark, sf):
    return browse.busiest(view(spark, sf, "mapped_lines"), 20)


@query("O13_cook_log_list", "SELECT log_id, user_id, rating::BIGINT AS rating, row_number() OVER (ORDER BY cooked_at DESC, log_id DESC) AS place FROM cook_logs WHERE dish_id = 7")
def _(spark, sf):
    rows = browse.cook_log_list(view(spark, sf, "cook_logs"), dish_id=7)
    place = F.row_number().over(Window.orderBy(F.col("cooked_at").desc(), F.col("log_id").desc()))  # one dish's
    return rows.select("log_id", "user_id", F.col("rating").cast("long").alias("rating"), place.cast("long").alias("place"))


@query("S18_health", "SELECT 'ok' AS status, (SELECT count(*) FROM goods)::BIGINT AS ingredients, (SELECT count(*) FROM dish_rows)::BIGINT AS dishes")
def _(spark, sf):
    return browse.health(*_views(spark, sf, "dish_rows", "goods"))


_BATCHES = "greatest(1, least(4, batches))"


@query("F26_planner_state", """SELECT user_id, coalesce(s, '') AS saved, coalesce(c, '') AS checked FROM (SELECT user_id, string_agg(dish_id || '=' || batches, '|' ORDER BY dish_id::VARCHAR) AS s FROM saved GROUP BY user_id)
  FULL JOIN (SELECT user_id, string_agg(item_key, '|' ORDER BY item_key) AS c FROM checks GROUP BY user_id) USING (user_id)""")  # fmt: skip
def _(spark, sf):
    rows = planner.planner_state(*_views(spark, sf, "saved", "checks"))
    saved = F.array_join(F.transform(F.map_entries("saved"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return rows.select("user_id", saved.alias("saved"), F.array_join("checked", "|").alias("checked"))


def _saved_changes(spark, sf) -> DataFrame:
    rows = view(spark, sf, "local_saved")
    return rows.select("user_id", "dish_id", F.nullif("batches", F.lit(3)).alias("batches"), F.lit(datetime(2025, 1, 1)).alias("saved_at"))


@query("K4J19_set_saved", f"""WITH_CHANGES SELECT user_id, dish_id, batches::BIGINT AS batches FROM (
  SELECT user_id, dish_id, batches FROM saved WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.user_id = saved.user_id AND ch.dish_id = saved.dish_id AND (ch.batches IS NULL OR ch.known))
  UNION ALL SELECT user_id, dish_id, {_BATCHES} FROM ch WHERE batches IS NOT NULL AND known)""".replace("WITH_CHANGES", ", ch AS (SELECT user_id, dish_id, nullif(batches, 3) AS batches, dish_id IN (SELECT p_partkey FROM part) AS known FROM local_saved)"))  # fmt: skip
def _(spark, sf):
    now, _ = planner.set_saved(view(spark, sf, "saved"), _saved_changes(spark, sf), view(spark, sf, "dishes"))
    return now.select("user_id", "dish_id", F.col("batches").cast("long").alias("batches"))


@query("K4_saved_outcomes", "SELECT user_id, dish_id, CASE WHEN batches = 3 THEN 'removed' WHEN dish_id IN (SELECT p_partkey FROM part) THEN 'saved' ELSE 'unknown-dish' END AS outcome FROM local_saved")
def _(spark, sf):
    return planner.set_saved(view(spark, sf, "saved"), _saved_changes(spark, sf), view(spark, sf, "dishes"))[1]


@query("K5_grocery_checks", "SELECT user_id, item_key FROM checks WHERE NOT EXISTS (SELECT 1 FROM local_checks l WHERE l.user_id = checks.user_id AND l.item_key = checks.item_key AND l.item_key LIKE '%1') UNION SELECT user_id, item_key FROM local_checks WHERE item_key NOT LIKE '%1'")
def _(spark, sf):
    changes = view(spark, sf, "local_checks").withColumn("checked", ~F.col("item_key").endswith("1"))
    return planner.set_checks(view(spark, sf, "checks"), changes)


@query("K5_clear", "SELECT user_id, item_key FROM checks WHERE user_id NOT IN (SELECT user_id FROM local_saved WHERE batches > 5)")
def _(spark, sf):
    return planner.clear(view(spark, sf, "checks"), view(spark, sf, "local_saved").where("batches > 5"))


def _imported(spark, sf) -> planner.Imported:
    return planner.import_state(*_views(spark, sf, "saved", "checks", "local_saved", "local_checks", "dishes"))


_NEW = """, few AS (SELECT user_id FROM local_saved GROUP BY user_id HAVING count(*) <= 500), add AS (SELECT l.user_id, l.dish_id, greatest(1, least(4, l.batches)) AS batches, l.dish_id IN (SELECT p_partkey FROM part) AS known
  FROM local_saved l SEMI JOIN few USING (user_id) ANTI JOIN saved s ON s.user_id = l.user_id AND s.dish_id = l.dish_id), ticks AS (SELECT l.user_id, l.item_key FROM local_checks l ANTI JOIN checks c ON c.user_id = l.user_id AND c.item_key = l.item_key)"""


@query("K6U5_import_counts", f"""{_NEW} SELECT user_id, coalesce(saved_added, 0)::BIGINT AS saved_added, coalesce(checked_added, 0)::BIGINT AS checked_added, coalesce(skipped, 0)::BIGINT AS skipped
  FROM (SELECT user_id, count(*) FILTER (WHERE known) AS saved_added, count(*) FILTER (WHERE NOT known) AS skipped FROM add GROUP BY user_id) FULL JOIN (SELECT user_id, count(*) AS checked_added FROM ticks GROUP BY user_id) USING (user_id)""")  # fmt: skip
def _(spark, sf):
    return _imported(spark, sf).counts


@query("K6_imported_picks", f"{_NEW} SELECT user_id, dish_id, batches::BIGINT AS batches FROM saved UNION ALL SELECT user_id, dish_id, batches FROM add WHERE known")
def _(spark, sf):
    return _imported(spark, sf).saved.select("user_id", "dish_id", F.col("batches").cast("long").alias("batches"))


@query("K8_add_cook_logs", "SELECT event_id AS log_id, CASE WHEN event_id % 3000 + 1 IN (SELECT p_partkey FROM part) THEN 'created' ELSE 'unknown-dish' END AS outcome FROM events")
def _(spark, sf):
    logs = view(spark, sf, "cook_logs")
    return planner.add_logs(logs, logs.withColumn("dish_id", F.col("log_id") % 3000 + 1), view(spark, sf, "dishes"))[1]


@query("K7_delete_cook_logs", "SELECT log_id, user_id FROM cook_logs WHERE NOT (log_id % 4 = 0 AND user_id % 2 = 0)")
def _(spark, sf):
    logs = view(spark, sf, "cook_logs")
    asked = logs.where("log_id % 4 = 0").select("log_id", (F.col("user_id") + F.col("user_id") % 2 * 1_000_000).alias("user_id"))  # odd readers' by others
    return planner.delete_logs(logs, asked).select("log_id", "user_id")


@query("A19_servings", f"SELECT user_id AS list_id, sum(coalesce(servings, 0) * {_BATCHES})::BIGINT AS servings FROM saved JOIN dishes USING (dish_id) GROUP BY user_id")
def _(spark, sf):
    picks = view(spark, sf, "saved").select(F.col("user_id").alias("list_id"), "dish_id", F.greatest(F.lit(1), F.least(F.lit(4), F.col("batches"))).alias("batches"))
    return total_servings(picks, view(spark, sf, "dishes"))


@query("A24_ticked_items", "SELECT user_id AS list_id, count(*)::BIGINT AS items, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM local_checks l WHERE l.user_id = checks.user_id AND l.item_key = checks.item_key))::BIGINT AS ticked FROM checks GROUP BY user_id")
def _(spark, sf):
    named = lambda v: view(spark, sf, v).select(F.col("user_id").alias("list_id"), F.col("item_key").alias("key"))
    return count_items(named("checks"), named("local_checks"))


_STORED = """SELECT user_id, '[' || string_agg('{"id":"' || event_type || ':' || v || '","kind":"' || CASE event_type WHEN 'view' THEN 'max_minutes' WHEN 'error' THEN 'nonsense' ELSE 'exclude_tag' END || '","value":"' || v || '","enabled":' || (v % 2 = 0) || ',"observations":' || v || ',"medianRating":' || (v % 9) || '}', ',' ORDER BY event_type, v) || ', 7, {"id":3}]' AS hard_rules FROM (SELECT DISTINCT user_id, event_type, event_id % 40 AS v FROM events) GROUP BY user_id"""
_GOOD = "SELECT DISTINCT user_id, event_type || ':' || (event_id % 40) AS id, (event_id % 40) % 2 = 0 AS enabled FROM events WHERE event_type <> 'error' AND (event_id % 40) % 9 <= 5"


def _preferences(spark, sf) -> DataFrame:
    v = F.col("v").cast("string")
    kind = F.when(F.col("event_type") == "view", "max_minutes").when(F.col("event_type") == "error", "nonsense").otherwise("exclude_tag")
    text = F.concat(F.lit('{"id":"'), "event_type", F.lit(":"), v, F.lit('","kind":"'), kind, F.lit('","value":"'), v, F.lit('","enabled":'), (F.col("v") % 2 == 0).cast("string"), F.lit(',"observations":'), v, F.lit(',"medianRating":'), (F.col("v") % 9).cast("string"), F.lit("}"))
    rows = load(spark, sf, "events").select("user_id", "event_type", (F.col("event_id") % 40).alias("v")).distinct()
    stored = rows.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(text), ","), F.lit(', 7, {"id":3}]')).alias("hard_rules")).withColumn("profile", F.when(F.col("user_id") % 2 == 0, "likes soup").otherwise("  "))
    users = load(spark, sf, "events").select("user_id").union(load(spark, sf, "orders").select("o_custkey")).distinct()
    return rules.preferences(users, stored)


@query("F25X36_preferences", f"SELECT u.user_id, coalesce(n, 0)::BIGINT AS n, coalesce(enabled, 0)::BIGINT AS enabled, CASE WHEN u.user_id % 2 = 0 AND u.user_id IN (SELECT user_id FROM events) THEN 'likes soup' END AS profile FROM (SELECT user_id FROM events UNION SELECT o_custkey FROM orders) u LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE enabled) AS enabled FROM ({_GOOD}) GROUP BY user_id) USING (user_id)")
def _(spark, sf):
    prefs = _preferences(spark, sf)
    return prefs.select("user_id", F.size("rules").cast("long").alias("n"), F.size(F.filter("rules", lambda r: r["enabled"])).cast("long").alias("enabled"), "profile")


@query("K22_set_rule", f"""SELECT user_id, CASE WHEN EXISTS (SELECT 1 FROM ({_GOOD}) g WHERE g.user_id = u.user_id AND g.id = 'view:1') THEN 'ok' ELSE 'unknown-rule' END AS outcome,
  (SELECT count(*) FROM ({_GOOD}) g WHERE g.user_id = u.user_id AND (g.enabled OR g.id = 'view:1'))::BIGINT AS enabled FROM (SELECT user_id FROM events UNION SELECT o_custkey FROM orders) u""")  # fmt: skip
def _(spark, sf):
    prefs = _preferences(spark, sf)
    changes = prefs.select("user_id", F.lit("view:1").alias("rule_id"), F.lit(True).alias("enabled"))
    done = rules.set_rule_enabled(prefs, changes)
    return done.select("user_id", "outcome", F.size(F.filter("rules", lambda r: r["enabled"])).cast("long").alias("enabled"))


@query("A7X33_daily_usage", "SELECT kind, date_trunc('day', started_at)::DATE AS day, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost, sum(cost) < max(CASE kind WHEN 'scan' THEN 1.0 ELSE 0.1 END) AS open FROM scan_runs GROUP BY 1, 2")
def _(spark, sf):
    return runs.daily_usage(view(spark, sf, "scan_runs")).select("kind", F.col("day").cast("date").alias("day"), "tokens_in", "tokens_out", F.round("cost", 6).alias("cost"), "open")


@query("I9_search_gate", "SELECT date_trunc('day', started_at)::DATE AS day, sum(cost) < 0.9 * 0.1 AS available FROM scan_runs WHERE kind = 'search' GROUP BY ALL")
def _(spark, sf):
    usage = runs.daily_usage(view(spark, sf, "scan_runs"))
    return runs.search_open(usage).select(F.col("day").cast("date").alias("day"), "available")


@query("I9K12_running_gate", """SELECT run_id, coalesce(sum(cost::DECIMAL(18, 9)) OVER (PARTITION BY kind, date_trunc('day', started_at) ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < CASE kind WHEN 'search' THEN 0.05 ELSE 0.2 END AS allowed FROM scan_runs""")
def _(spark, sf):
    limits = {"search": 0.05, "scan": 0.2}
    calls = view(spark, sf, "scan_runs").select(F.col("run_id").alias("call_id"), "kind", F.col("started_at").alias("at"), "cost")
    spent = budget.nothing_spent(spark)
    early, late = (calls.where(f"hour(at) {op} 12") for op in ("<", ">="))
    first = budget.gate(spent, early, limits)
    second = budget.gate(budget.add_spent(spent, first), late, limits)
    return first.union(second).select(F.col("call_id").alias("run_id"), "allowed")


@query("X34_usage_cost", "SELECT run_id, round(CASE WHEN run_id % 5 = 0 THEN run_id / 1000.0 ELSE ((tokens_in - least(tokens_out * 3, tokens_in)) * 0.5 + least(tokens_out * 3, tokens_in) * 0.1 + tokens_out * 2.0) / 1000000 END, 9)::DOUBLE AS cost FROM scan_runs")
def _(spark, sf):
    reported = F.when(F.col("run_id") % 5 == 0, F.col("run_id") / 1000.0).otherwise(F.lit(-1.0))
    cost = runs.usage_cost(F.col("tokens_in"), F.col("tokens_out") * 3, F.col("tokens_out"), reported, (0.5, 0.1, 2.0))
    return view(spark, sf, "scan_runs").select("run_id", F.round(cost, 9).alias("cost"))


@query("K12_record_usage", "SELECT run_id, (tokens_in + CASE WHEN kind = 'scan' THEN 2 * (run_id % 7) ELSE 0 END)::BIGINT AS tokens_in FROM scan_runs UNION ALL SELECT -run_id, (run_id % 7)::BIGINT FROM (SELECT run_id, unnest([1, 2]) FROM scan_runs WHERE kind = 'search')")
def _(spark, sf):
    rows = view(spark, sf, "scan_runs")
    once = rows.select("run_id", F.lit("scan").alias("kind"), (F.col("run_id") % 7).alias("tokens_in"), F.lit(1).cast("long").alias("tokens_out"), F.lit(0.0).alias("cost"))
    now, refused = runs.record_usage(rows, once.union(once))
    return now.select("run_id", F.col("tokens_in").cast("long").alias("tokens_in")).union(refused.select(-F.col("run_id"), "tokens_in"))


@query("K13K16_run_life", "SELECT run_id, CASE WHEN run_id < 0 THEN 'running' WHEN status = 'running' THEN 'success' ELSE status END AS status, (CASE WHEN run_id < 0 THEN 0 WHEN status = 'running' THEN 5 ELSE found END)::BIGINT AS found, (CASE WHEN run_id < 0 THEN 0 WHEN status = 'running' THEN greatest(tokens_in, 500) ELSE tokens_in END)::BIGINT AS tokens_in FROM (SELECT * FROM scan_runs UNION ALL SELECT * REPLACE (-run_id AS run_id) FROM scan_runs WHERE run_id % 2 = 1)")
def _(spark, sf):
    rows = view(spark, sf, "scan_runs")
    done = rows.where("status = 'running'").select("run_id", F.lit("success").alias("status"), "started_at", F.lit(5).cast("long").alias("found"), F.lit(500).cast("long").alias("tokens_in"))
    begun = runs.begin_runs(runs.finish_runs(rows, done), rows.select(F.when(F.col("run_id") % 2 == 1, -F.col("run_id")).otherwise(F.col("run_id")).alias("run_id"), "source_id", "kind", "started_at"))
    return begun.select("run_id", "status", F.col("found").cast("long").alias("found"), F.col("tokens_in").cast("long").alias("tokens_in"))


@query("K17_search_days", """SELECT coalesce(a.day, b.day)::DATE AS day, epoch_us(coalesce(s, c)) AS started, epoch_us(greatest(f, d)) AS finished FROM (SELECT date_trunc('day', started_at) AS day, min(started_at) AS s, max(finished_at) AS f FROM scan_runs WHERE kind = 'search' GROUP BY 1) a
  FULL JOIN (SELECT date_trunc('day', t) AS day, min(t) AS c, max(t) AS d FROM (SELECT started_at + INTERVAL 20 HOUR AS t FROM scan_runs WHERE kind = 'scan') GROUP BY 1) b ON a.day = b.day""")  # fmt: skip
def _(spark, sf):
    rows = view(spark, sf, "scan_runs")
    calls = rows.where("kind = 'scan'").select((F.col("started_at") + F.expr("INTERVAL 20 HOUR")).alias("at"))
    return runs.search_days(rows, calls).select(F.col("day").cast("date").alias("day"), F.unix_micros("started_at").alias("started"), F.unix_micros("finished_at").alias("finished"))


@query("I4I12_finish_sources", """SELECT source_id, CASE WHEN source_id % 5 = 0 THEN feed_etag WHEN source_id % 5 = 1 THEN NULL ELSE coalesce(CASE WHEN source_id % 2 = 0 THEN 'new' END, feed_etag) END AS feed_etag, CASE WHEN source_id % 5 > 1 THEN 2024 ELSE 2023 END::BIGINT AS scanned FROM feed_sources""")
def _(spark, sf):
    n = F.col("source_id")
    at = lambda y: F.lit(datetime(y, 1, 1))
    sources = view(spark, sf, "feed_sources").withColumn("feed_last_modified", F.lit(None).cast("string")).withColumn("last_scanned_at", at(2023))
    done = sources.where("source_id % 10 != 0").select("source_id", at(2024).alias("started_at"), (n % 5 != 0).alias("discovered"), (n % 5 == 1).alias("retry"), F.when(n % 2 == 0, "new").alias("feed_etag"), F.lit(None).cast("string").alias("feed_last_modified"))
    return runs.finish_sources(sources, done).select("source_id", "feed_etag", F.year("last_scanned_at").cast("long").alias("scanned"))


@query("I15_first_scan", "SELECT count(*) FILTER (WHERE kind = 'scan' AND status IN ('success', 'partial')) = 0 AS wanted FROM scan_runs UNION ALL SELECT true")
def _(spark, sf):
    rows = view(spark, sf, "scan_runs")
    return runs.needs_first_scan(rows).union(runs.needs_first_scan(rows.where("status IN ('running', 'error') OR kind = 'search'")))


@query("A16_merged_summary", "SELECT sum(found)::BIGINT AS found, sum(new)::BIGINT AS new, round(sum(cost), 6) AS cost FROM (SELECT found, new, cost FROM scan_runs WHERE kind = 'scan' UNION ALL SELECT found, new, cost FROM scan_runs WHERE kind = 'search')")
def _(spark, sf):
    rows = view(spark, sf, "scan_runs")
    part = lambda k: rows.where(F.col("kind") == k).select("found", "new", "cost")
    return runs.merged_summary(part("scan"), part("search")).select("found", "new", F.round("cost", 6).alias("cost"))


@query("J9O9_recent_runs", "SELECT run_id, CASE WHEN kind = 'search' THEN 'Search' ELSE coalesce(name, 'All sources') END AS source_name FROM (SELECT * FROM scan_runs ORDER BY started_at DESC, run_id DESC LIMIT 24) LEFT JOIN feed_sources USING (source_id)")
def _(spark, sf):
    return runs.recent_runs(*_views(spark, sf, "scan_runs", "feed_sources")).select("run_id", "source_name")


_LATEST = "SELECT source_id, status, found, started_at, finished_at FROM scan_runs WHERE source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1"


@query("O9X41_source_health", f"""SELECT source_id, row_number() OVER (ORDER BY enabled DESC, name) AS place, CASE WHEN NOT enabled THEN 'Disabled' WHEN status IS NULL THEN 'Awaiting first scan' WHEN status = 'running' THEN 'Scanning' WHEN status = 'success' THEN 'Healthy' WHEN status = 'partial' THEN 'Needs review' ELSE 'Failed' END AS health
  FROM feed_sources LEFT JOIN ({_LATEST}) USING (source_id)""")  # fmt: skip
def _(spark, sf):
    rows = runs.source_snapshot(*_views(spark, sf, "feed_sources", "scan_runs"))
    return rows.select("source_id", F.row_number().over(Window.orderBy(F.col("enabled").desc(), "name")).cast("long").alias("place"), "health")  # as many as sources


@query("A15A6_ops_totals", "SELECT count(*)::BIGINT AS dishes, count(*) FILTER (WHERE status = 'active')::BIGINT AS active, count(*) FILTER (WHERE status = 'pending')::BIGINT AS pending, count(*) FILTER (WHERE status = 'rejected')::BIGINT AS rejected, (SELECT count(*) FROM feed_sources)::BIGINT AS sources, (SELECT count(*) FROM feed_sources WHERE enabled)::BIGINT AS enabled_sources FROM dish_rows")
def _(spark, sf):
    return runs.ops_snapshot(*_views(spark, sf, "dish_rows", "feed_sources", "scan_runs"), at=datetime(2024, 1, 15))["totals"]


@query("A7_ops_today", "SELECT sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost), 6) AS cost FROM scan_runs WHERE started_at >= TIMESTAMP '2024-01-15'")
def _(spark, sf):
    snapshot = runs.ops_snapshot(*_views(spark, sf, "dish_rows", "feed_sources", "scan_runs"), at=datetime(2024, 1, 15, 13, 7))
    return snapshot["today"].select("tokens_in", "tokens_out", F.round("cost", 6).alias("cost"))


_NEXT = "SELECT source_url, CASE WHEN dish_id % 6 = 0 THEN 'changed' WHEN dish_id % 6 = 1 THEN content_hash END AS h FROM dish_rows WHERE dish_id % 6 < 2 UNION ALL SELECT source_url || '/new', 'fresh' FROM dish_rows WHERE dish_id % 6 = 2"


@query("K1I6_upsert_dishes", f"""SELECT source_url, CASE WHEN d.source_url IS NULL THEN 'inserted' WHEN n.source_url IS NULL THEN 'kept' WHEN h IS NOT DISTINCT FROM o_hash THEN 'unchanged' ELSE 'updated' END AS outcome,
  CASE WHEN n.source_url IS NULL OR h IS NOT DISTINCT FROM o_hash THEN status ELSE 'pending' END AS status, CASE WHEN n.source_url IS NULL OR h IS NOT DISTINCT FROM o_hash THEN array_to_string(list_sort(tags), '|') ELSE '' END AS tags, CASE WHEN n.source_url IS NULL OR h IS NOT DISTINCT FROM o_hash THEN keeps_days END::BIGINT AS keeps_days
  FROM (SELECT source_url, status, tags, keeps_days, CASE WHEN dish_id % 4 > 0 THEN content_hash END AS o_hash FROM dish_rows) d FULL JOIN ({_NEXT}) n USING (source_url)""")  # fmt: skip
def _(spark, sf):
    rows = view(spark, sf, "dish_rows")
    old = rows.withColumn("content_hash", F.when(F.col("dish_id") % 4 > 0, F.col("content_hash")))
    k = F.col("dish_id") % 6
    drafts = rows.where("dish_id % 6 < 2").select("source_url", F.when(k == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"), "title", F.col("last_seen_at").alias("seen_at"))
    drafts = drafts.union(rows.where("dish_id % 6 = 2").select(F.concat("source_url", F.lit("/new")), F.lit("fresh"), "title", "last_seen_at"))
    made = state.upsert_dishes(old, drafts)
    return made.select("source_url", "outcome", "status", F.coalesce(F.array_join(F.array_sort("tags"), "|"), F.lit("")).alias("tags"), F.col("keeps_days").cast("long").alias("keeps_days"))


@query("K2I7_touch", "SELECT source_url, CASE WHEN dish_id % 3 = 0 THEN 2025 ELSE 2024 END::BIGINT AS seen, CASE WHEN dish_id % 3 = 0 AND dish_id % 2 = 0 THEN 'e2' ELSE 'e1' END AS etag, NULL AS outcome FROM dish_rows UNION ALL SELECT source_url || CASE WHEN dish_id % 6 = 0 THEN '' ELSE '?' END, NULL, NULL, CASE WHEN dish_id % 6 = 0 THEN 'touched' ELSE 'retry' END FROM dish_rows WHERE dish_id % 3 = 0")
def _(spark, sf):
    old = view(spark, sf, "dish_rows").withColumn("page_etag", F.lit("e1")).withColumn("page_last_modified", F.lit(None).cast("string"))
    seen = old.where("dish_id % 3 = 0").select("source_url", F.lit(datetime(2025, 1, 1)).alias("seen_at"), F.when(F.col("dish_id") % 2 == 0, "e2").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    asked = old.where("dish_id % 3 = 0").select(F.concat("source_url", F.when(F.col("dish_id") % 6 == 0, "").otherwise("?")).alias("source_url"))
    now = state.touch(old, seen).select("source_url", F.year("last_seen_at").cast("long").alias("seen"), F.col("page_etag").alias("etag"), F.lit(None).cast("string").alias("outcome"))
    told = state.unchanged_pages(old, asked)
    return now.union(told.select("source_url", F.lit(None).cast("long"), F.lit(None).cast("string"), "outcome"))


@query("K3_replace_lines", "SELECT dish_id, position FROM mapped_lines WHERE dish_id % 7 <> 0 UNION ALL SELECT dish_id, -position FROM mapped_lines WHERE dish_id % 7 = 0 AND optional")
def _(spark, sf):
    lines = view(spark, sf, "mapped_lines").select("dish_id", "position", "optional")
    new = lines.where("dish_id % 7 = 0 AND optional").withColumn("position", -F.col("position"))
    return state.replace_children(lines, new, ["dish_id"], lines.where("dish_id % 7 = 0").select("dish_id")).select("dish_id", "position")


@query("K9_own_column", "SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(b.m, a.n)::BIGINT AS n, a.total::BIGINT AS total FROM (SELECT user_id, count(*) AS n, sum(event_id) AS total FROM events GROUP BY user_id) a FULL JOIN (SELECT o_custkey AS user_id, -count(*) AS m FROM orders GROUP BY 1) b ON a.user_id = b.user_id")
def _(spark, sf):
    old = load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))
    new = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg((-F.count("*")).alias("n"))
    return state.own_column(old, new, "user_id", "n")


@query("K10_save_scores", "SELECT user_id, dish_id, (CASE WHEN dish_id % 3 = 0 THEN -1 ELSE score END)::DOUBLE AS score FROM dish_scores UNION ALL SELECT user_id, -dish_id, -1 FROM dish_scores WHERE dish_id % 3 = 1")
def _(spark, sf):
    old = view(spark, sf, "dish_scores").select("user_id", "dish_id", F.col("score").cast("double").alias("score"))
    new = old.where("dish_id % 3 < 2 AND dish_id % 3 >= 0").select("user_id", F.when(F.col("dish_id") % 3 == 0, F.col("dish_id")).otherwise(-F.col("dish_id")).alias("dish_id"), F.lit(-1.0).alias("score"))
    return state.upsert(old, new, ["user_id", "dish_id"])


@query("K14I8_compare_and_set", """SELECT dish_id, CASE WHEN status = 'pending' AND dish_id % 2 = 0 THEN 'active' ELSE status END AS status, CASE WHEN dish_id % 3 = 0 THEN 'kept' WHEN status = 'pending' AND dish_id % 2 = 0 THEN 'applied' ELSE 'stale' END AS outcome FROM dish_rows WHERE dish_id % 3 <> 0
  UNION ALL SELECT dish_id, status, 'kept' FROM dish_rows WHERE dish_id % 3 = 0""")  # fmt: skip
def _(spark, sf):
    rows = view(spark, sf, "dish_rows")
    changes = rows.where("dish_id % 3 != 0").select("dish_id", F.when(F.col("dish_id") % 2 == 0, F.col("content_hash")).otherwise("old").alias("expected_hash"), F.lit("active").alias("status"))
    return state.compare_and_set(rows.select("dish_id", "content_hash", "status"), changes).select("dish_id", "status", "outcome")


@query("K14I8I7_queue", """SELECT source_url AS url, version::BIGINT AS version, event FROM dish_rows, LATERAL (VALUES (true, 1, 'task'), (dish_id % 3 = 0, 1, 'applied'), (dish_id % 3 = 1, 1, 'stale'), (dish_id % 4 = 0 AND dish_id % 3 <> 0, 1, 'superseded'),
  (dish_id % 4 = 0, 2, 'task'), (dish_id % 4 = 1, 1, 'touched'), (dish_id % 12 = 0, 2, 'stale'), (dish_id % 12 = 6, 1, 'repeated')) AS t(happens, version, event) WHERE happens""")  # fmt: skip
def _(spark, sf):
    work_queue.use_store(spark)
    rows = view(spark, sf, "dish_rows").select("dish_id", F.col("source_url").alias("url"), "first_seen_at", "content_hash")

    def some(where: str, hours: int, kind: str, content_hash: str, status: str) -> DataFrame:
        return rows.where(where).selectExpr("url", f"first_seen_at + INTERVAL {hours} HOURS AS at", f"'{kind}' AS kind", f"{content_hash} AS content_hash", f"{status} AS status")

    events = some("true", 0, "draft", "content_hash", "cast(NULL AS string)").union(some("dish_id % 3 != 2", 1, "answer", "if(dish_id % 3 = 0, content_hash, 'old')", "'active'"))
    events = events.union(some("dish_id % 4 < 2", 2, "draft", "if(dish_id % 4 = 0, concat('new', content_hash), content_hash)", "cast(NULL AS string)"))
    return work_queue.work(events.union(some("dish_id % 6 = 0", 3, "answer", "content_hash", "'rejected'"))).select("url", "version", "event")


@query("K18_share_codes")
def _(spark, sf):
    return state.share_codes(load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))


_NAMES = "SELECT p_partkey AS n, p_name FROM part"


@query("K11_seed_ingredients", """SELECT coalesce(i.name, s.name) AS name, coalesce(s.aisle, i.aisle) AS aisle, s.unit AS default_unit, i.ingredient_id AS kept_id FROM goods i FULL JOIN (
  SELECT lower(p_name) AS name, arg_max('A' || p_size, p_partkey) AS aisle, arg_max(p_brand, p_partkey) AS unit FROM part GROUP BY 1
  UNION ALL SELECT name, 'Bakery', 'cup' FROM goods WHERE ingredient_id % 2 = 0) s ON s.name = i.name""")  # fmt: skip
def _(spark, sf):
    goods = view(spark, sf, "goods").withColumn("default_unit", F.lit(None).cast("string"))
    seeds = load(spark, sf, "part").select(F.col("p_partkey").alias("position"), F.concat(F.lit("  "), F.upper("p_name")).alias("name"), F.concat(F.lit("A"), "p_size").alias("aisle"), F.col("p_brand").alias("default_unit"))
    seeds = seeds.union(goods.where("ingredient_id % 2 = 0").select("ingredient_id", F.upper("name"), F.lit("Bakery"), F.lit("cup")))
    made, _ = al.seed(goods, goods.select(F.col("name").alias("alias"), "ingredient_id"), seeds)
    return made.join(goods.select("name", F.col("ingredient_id").alias("kept_id")), "name", "left").select("name", "aisle", "default_unit", "kept_id")


@query("K11S11_seed_sources", "SELECT base_url, kind, enabled, delay FROM (SELECT 'u' || source_id AS base_url, CASE WHEN source_id % 2 = 0 THEN 'reddit' ELSE 'blog' END AS kind, CASE WHEN source_id % 2 = 0 AND source_id % 3 > 0 THEN enabled ELSE false END AS enabled, 5::BIGINT AS delay FROM feed_sources) UNION ALL SELECT 'own', 'blog', true, 1")
def _(spark, sf):
    rows = view(spark, sf, "feed_sources")
    kind = F.when(F.col("source_id") % 2 == 0, "reddit").otherwise("blog").alias("kind")
    url = F.concat(F.lit("u"), "source_id").alias("base_url")
    stored = rows.where("source_id % 3 > 0").select(url, kind, "enabled", F.lit(1).cast("long").alias("delay")).union(rows.limit(1).select(F.lit("own"), F.lit("blog"), F.lit(True), F.lit(1).cast("long")))
    return al.seed_sources(stored, rows.select(url, kind, F.lit(False).alias("enabled"), F.lit(5).cast("long").alias("delay")))


def _mapping(spark, sf) -> al.Mapped:
    goods = view(spark, sf, "goods").where("ingredient_id % 2 = 1")
    lines = view(spark, sf, "mapped_lines")
    known = goods.select(F.col("name").alias("alias"), "ingredient_id").union(view(spark, sf, "goods").where("ingredient_id % 14 = 0").select(F.concat(F.lit("raw "), "ingredient_id"), F.lit(1).cast("long")))
    refs = lines.where("dish_id % 2 = 0").select("dish_id", "position", F.when(F.col("dish_id") % 6 == 0, "old").otherwise(F.col("raw_text")).alias("raw_text"), F.upper("raw_text").alias("parsed_name"))
    decisions = view(spark, sf, "goods").select(F.col("ingredient_id").alias("position"), F.concat(F.lit("Raw  "), "ingredient_id").alias("input_name"), F.concat(F.lit("Supplier#"), F.lpad((F.col("ingredient_id") + 3).cast("string"), 9, "0")).alias("canonical_name"), "aisle")
    return al.apply_mappings(goods, known, lines, refs, decisions)


_MAP = """, l AS (SELECT *, substr(raw_text, 5)::BIGINT AS s FROM mapped_lines WHERE dish_id % 2 = 0),
o AS (SELECT dish_id, position, s, CASE WHEN ingredient_id IS NOT NULL OR dish_id % 6 = 0 THEN 'stale' WHEN s % 14 = 0 AND NOT (s + 3 = 1) THEN 'conflict' ELSE 'mapped' END AS outcome FROM l)"""


@query("K15_mapping_outcomes", f"{_MAP} SELECT outcome, count(*)::BIGINT AS n FROM o GROUP BY outcome")
def _(spark, sf):
    return _mapping(spark, sf).outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query("K15_mapped_lines", f"""{_MAP} SELECT DISTINCT m.dish_id, m.position, CASE WHEN m.ingredient_id IS NOT NULL THEN 'had' WHEN o.outcome = 'conflict' THEN 'owner' WHEN o.outcome = 'mapped' THEN 'supplier#' || lpad((o.s + 3)::VARCHAR, 9, '0') ELSE '-' END AS target
  FROM mapped_lines m LEFT JOIN o ON o.dish_id = m.dish_id AND o.position = m.position""")  # fmt: skip
def _(spark, sf):
    made, before = _mapping(spark, sf), view(spark, sf, "mapped_lines").select("dish_id", "position", F.col("ingredient_id").alias("had"))
    told = made.outcomes.select("dish_id", "position", "outcome")
    rows = made.lines.select("dish_id", "position", "ingredient_id").join(before, ["dish_id", "position"]).join(told, ["dish_id", "position"], "left").join(made.ingredients.select("ingredient_id", "name"), "ingredient_id", "left")
    target = F.when(F.col("had").isNotNull(), "had").when(F.col("outcome") == "conflict", "owner").when(F.col("ingredient_id").isNotNull(), F.col("name")).otherwise("-")
    return rows.select("dish_id", "position", target.alias("target")).distinct()


@query("W4J14I13_match_and_learn")
def _(spark, sf):
    part = load(spark, sf, "part")
    names = part.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("name")).distinct()
    found, learned = al.match_and_learn(names, part.groupBy(F.lower("p_name").alias("alias")).agg(F.min("p_partkey").alias("ingredient_id")))
    return found.select("name", "how", "ingredient_id").union(learned.select("alias", F.lit("alias"), "ingredient_id"))


@query("J14W4_exact_matches", "SELECT DISTINCT p_name AS name, 'exact' AS how, i AS ingredient_id FROM part JOIN (SELECT lower(p_name) AS alias, min(p_partkey) AS i FROM part GROUP BY 1) ON lower(p_name) = alias")
def _(spark, sf):
    part = load(spark, sf, "part")
    return matcher.match(part.select(F.col("p_name").alias("name")), part.groupBy(F.lower("p_name").alias("alias")).agg(F.min("p_partkey").alias("ingredient_id"))).select("name", "how", "ingredient_id")


@query("J20W5_resolved_scores", """WITH b AS (SELECT o_custkey AS user_id, o_orderkey AS dish_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders),
r AS (SELECT user_id, (place - 1) // 20 AS batch, (place - 1) % 20 + 1 AS ref, dish_id FROM b WHERE place <= 400),
a AS (SELECT user_id, batch, ref + k AS ref, k * 100 + ref AS position, (dish_id % 300 - 50)::DOUBLE AS score, CASE WHEN dish_id % 4 = 0 THEN ' ' ELSE ' why ' || dish_id || ' ' END AS reason FROM r, (VALUES (0), (1)) v(k))
SELECT user_id, dish_id, greatest(0, least(100, score))::DOUBLE AS score, reason FROM (SELECT a.user_id, r.dish_id, a.score, trim(a.reason) AS reason, row_number() OVER (PARTITION BY a.user_id, a.batch, a.ref ORDER BY position) AS n FROM a JOIN r USING (user_id, batch, ref) WHERE trim(a.reason) <> '') WHERE n = 1""")  # fmt: skip
def _(spark, sf):
    pairs = load(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("dish_id"), F.col("o_orderdate").alias("published_at"))
    none = view(spark, sf, "dish_scores").limit(0)
    batches = scoring.in_batches(scoring.unscored(pairs, none))
    reason = F.when(F.col("dish_id") % 4 == 0, " ").otherwise(F.concat(F.lit(" why "), F.col("dish_id").cast("string"), F.lit(" ")))
    answers = batches.select("user_id", "batch", F.col("ref"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "dish_id", reason.alias("reason"))
    answers = answers.select("user_id", "batch", (F.col("ref") + F.col("k")).alias("ref"), (F.col("k") * 100 + F.col("ref")).alias("position"), (F.col("dish_id") % 300 - 50).cast("double").alias("score"), "reason")
    return scoring.resolve(batches, answers).select("user_id", "dish_id", F.col("score").cast("double").alias("score"), "reason")


@query("U6_merged_rules", """SELECT user_id, rule_id, enabled FROM (SELECT o_custkey AS user_id, 'r' || (o_orderkey % 5) AS rule_id, true AS fresh FROM orders GROUP BY ALL) d FULL JOIN (SELECT o_custkey AS user_id, 'r' || (o_orderkey % 7) AS rule_id, min(o_orderkey) % 2 = 0 AS e FROM orders GROUP BY 1, 2) b USING (user_id, rule_id),
  LATERAL (SELECT coalesce(e, true) AS enabled) WHERE fresh OR NOT e""")  # fmt: skip
def _(spark, sf):
    rows = load(spark, sf, "orders")
    rule = lambda n: F.concat(F.lit("r"), F.col("o_orderkey") % n).alias("rule_id")
    plain = [F.lit("exclude_tag").alias("kind"), F.lit("v").alias("value"), F.lit(5).cast("long").alias("observations"), F.lit(2.0).alias("median_rating")]
    derived = rows.select(F.col("o_custkey").alias("user_id"), rule(5)).distinct().select("user_id", "rule_id", *plain)
    before = rows.groupBy(F.col("o_custkey").alias("user_id"), rule(7)).agg((F.min("o_orderkey") % 2 == 0).alias("enabled")).select("user_id", "rule_id", *plain, "enabled")
    return rules.merge_rules(before, derived).select("user_id", "rule_id", "enabled")


@query("J6_cooked_dishes", """SELECT user_id, kind, value, count(*)::BIGINT AS observations, sum(rating)::BIGINT AS stars FROM (
  SELECT user_id, rating, unnest(list_concat([('max_minutes', t::VARCHAR) FOR t IN [30, 60, 90] IF total_minutes > t], CASE WHEN category IS NULL THEN [] ELSE [('exclude_category', category)] END, [('exclude_tag', t) FOR t IN tags])) AS o
  FROM cook_logs JOIN dish_rows USING (dish_id)) t(user_id, rating, o), (SELECT 1) one, LATERAL (SELECT o[1] AS kind, o[2] AS value) GROUP BY ALL""")
def _(spark, sf):
    seen = rules.observations(rules.cooked(view(spark, sf, "cook_logs"), view(spark, sf, "dish_rows")))
    return seen.groupBy("user_id", "kind", "value").agg(F.count("*").alias("observations"), F.sum("rating").alias("stars"))
