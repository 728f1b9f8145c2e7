"""Window, top-k and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmesh import catalog as fx
from trialmesh.functions.text import url_domain
from trialmesh.operators import ranking as ops, sets
from trialmesh.plans.registry import query

SEQ = ", ".join(fx.SEQ)


@query("first_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def _(t):
    return ops.first_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey",
                             [F.col("o_orderdate"), F.col("o_orderkey")])


@query("latest_per_key", """
SELECT user_id, event_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def _(t):
    return ops.latest_per_key(t.events.select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"])


@query("round_winners", f"""
WITH {fx.RUNS_SQL}
SELECT run_id, round, {SEQ}, score FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, round ORDER BY score DESC, {SEQ}) AS rn FROM runs WHERE status = 'completed' AND score IS NOT NULL)
WHERE rn = 1""")
def _(t):
    return ops.round_winners(fx.runs(t), fx.SEQ).select("run_id", "round", *fx.SEQ, "score")


@query("leaderboard", f"""
WITH {fx.RUNS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC NULLS LAST, {SEQ}) AS rank,
  row_number() OVER (PARTITION BY run_id, round ORDER BY (status = 'completed' AND score IS NOT NULL) DESC, score DESC NULLS LAST, {SEQ}) AS rr FROM runs)
SELECT run_id, round, {SEQ}, status, score, rank, rank = 1 AS is_best,
  CASE WHEN rr = 1 AND status = 'completed' AND score IS NOT NULL THEN 'supported' ELSE 'inconclusive' END AS hypothesis_result FROM r""")
def _(t):
    return ops.leaderboard(fx.runs(t), fx.SEQ).drop("pipeline")


@query("best_so_far", f"""
WITH {fx.RUNS_SQL}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, round ORDER BY score DESC, {SEQ}) AS rn
  FROM runs WHERE score IS NOT NULL) WHERE rn = 1),
r AS (SELECT DISTINCT run_id, round FROM runs),
j AS (SELECT r.run_id, r.round, b.score, b.pipeline, row_number() OVER (PARTITION BY r.run_id, r.round ORDER BY b.score DESC NULLS LAST, b.round) AS rn
  FROM r LEFT JOIN b ON b.run_id = r.run_id AND b.round < r.round)
SELECT run_id, round, score AS best_score, pipeline AS survivor FROM j WHERE rn = 1""")
def _(t):
    return ops.best_so_far(fx.runs(t), fx.SEQ)


@query("last_n_per_key", """
SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
  FROM conversations WHERE role = 'user') WHERE rn <= 4""")
def _(t):
    return ops.last_n_per_key(t.conversations, "conv_id", ["turn"], 4, F.col("role") == "user").select("conv_id", "turn", "text")


@query("transcript", """
SELECT conv_id, CAST(0 AS BIGINT) AS page, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) AS transcript
FROM conversations GROUP BY 1""")
def _(t):
    return ops.transcript(t.conversations)


@query("retain_last", "SELECT event_id AS id, ts FROM events ORDER BY event_id DESC LIMIT 500")
def _(t):
    return ops.retain_last(fx.event_log(t), 500).select("id", "ts")


@query("sample_rows", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0 ORDER BY c_custkey LIMIT 25""")
def _(t):
    rows = t.customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")))
    return ops.sample_rows(rows, 25, drop="c_acctbal", order=["c_custkey"], non_null="c_acctbal")


@query("pick_by_priority", """
SELECT p_partkey, p_name, p_type FROM part WHERE p_size > 10
ORDER BY CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END, p_partkey LIMIT 1""")
def _(t):
    return ops.pick_by_priority(t.part, [F.col("p_type") == "ECONOMY"], F.col("p_size") > 10, ["p_partkey"]).select(
        "p_partkey", "p_name", "p_type")


@query("sample_n", """
SELECT doc_id, lang, source FROM documents ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100""")
def _(t):
    return ops.sample_n(t.documents.select("doc_id", "lang", "source"), "doc_id", 100)


@query("supported_values", """
SELECT lang FROM documents INTERSECT SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z][a-z])/', 1) FROM pages""")
def _(t):
    return sets.supported_values(t.documents.select("lang").distinct(), t.pages.select(
        F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z][a-z])/", 1).alias("lang")).distinct())


@query("union_search_hits", """
WITH h AS (SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN url ELSE '' END AS url FROM pages)
SELECT page_id, url, 'impact' AS query_context FROM h WHERE url <> '' UNION ALL SELECT page_id, url, 'adoption' FROM h WHERE url <> ''
UNION ALL SELECT page_id, url, 'automation' FROM pages""")
def _(t):
    hits = t.pages.select("page_id", F.when(F.col("page_id") % 11 != 0, F.col("url")).otherwise("").alias("url"))
    return sets.union_search_hits([("impact", hits), ("adoption", hits.replace("", None, ["url"])),
                                   ("automation", t.pages.select("page_id", "url"))])


@query("distinct_in_order", """
SELECT tag, min(event_id) AS first_seen FROM (SELECT event_id, CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id || ':' || event_type ELSE '' END AS tag FROM events)
WHERE tag <> '' GROUP BY 1""")
def _(t):
    tag = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), "user_id", F.lit(":"), "event_type")).otherwise("")
    return sets.distinct_in_order(t.events.select("event_id", tag.alias("tag")), "tag", "event_id")


@query("validate_plans", """
WITH e AS (SELECT l_orderkey AS plan_id, l_linenumber <> 7 AND l_tax < 0.08
    AND 1 <= CAST(l_quantity AS INTEGER) * 19 AND CAST(l_quantity AS INTEGER) * 19 <= 900 AND l_suppkey % 6 <> 1 AS good,
  l_returnflag <> 'R' AS metric_ok FROM lineitem)
SELECT plan_id, count(*) AS experiments, bool_and(good) AS experiments_valid, bool_and(metric_ok) AS decision_valid,
  bool_and(good) AND count(*) = 3 AS plan_valid FROM e GROUP BY 1""")
def _(t):
    line = F.col("l_linenumber")
    intents = F.array(*[F.lit(i) for i in sets.ALLOWED_INTENTS[:6]])
    config = F.map_concat(
        F.create_map(F.lit("presets"), F.lit("good_quality"), F.lit("time_limit"), (F.col("l_quantity").cast("int") * 19).cast("string"),
                     F.lit("num_bag_folds"), (F.col("l_suppkey") % 6).cast("string")),
        F.when(F.col("l_tax") >= 0.08, F.create_map(F.lit("gpu_hours"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))
    plans = t.lineitem.select(
        F.col("l_orderkey").alias("plan_id"), F.coalesce(F.try_element_at(intents, line), F.lit("moonshot")).alias("intent"),
        config.alias("config"), F.when(F.col("l_returnflag") == "A", "regression").otherwise("binary_classification").alias("task_type"),
        F.when(F.col("l_returnflag") == "A", "r2").when(F.col("l_returnflag") == "N", "f1").otherwise("g_eval").alias("metric"))
    return sets.validate_plans(plans, 3)


@query("merge_messages", """
WITH m AS (
  SELECT 0 AS s, conv_id, turn, role, CASE WHEN role = 'user' THEN 'x' ELSE 'planner' END AS agent, text AS content, '' AS card_type, '' AS card_data FROM conversations
  UNION ALL SELECT 1, conv_id, turn, role, CASE WHEN role = 'user' THEN 'y' ELSE 'planner' END, CASE WHEN turn % 2 = 0 THEN replace(text, 'e', 'E') ELSE '  ' || text || ' ' END,
    CASE WHEN turn % 3 = 0 THEN 'plan' ELSE '' END, '' FROM conversations
  UNION ALL SELECT 1, conv_id, turn + 100, role, 'planner', text, '', CASE WHEN turn % 2 = 0 THEN '{}' ELSE '' END FROM conversations),
k AS (SELECT *, lower(regexp_replace(trim(content, E' \\t\\r\\n'), '\\s+', ' ', 'g')) AS c, CASE WHEN role = 'user' THEN '' ELSE agent END AS a FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, a, c ORDER BY s, turn) AS i,
  first_value(turn) OVER (PARTITION BY conv_id, role, a, c ORDER BY s, turn) AS first_turn,
  first_value(s) OVER (PARTITION BY conv_id, role, a, c ORDER BY s, turn) AS first_set FROM k),
g AS (SELECT conv_id, role, a, c, list({'s': s, 'turn': turn, 't': card_type <> '', 'd': card_data <> ''} ORDER BY s, turn) AS copies FROM k GROUP BY ALL),
w AS (SELECT conv_id, role, a, c, list_reduce(copies, lambda x, y: CASE WHEN (y.t AND NOT x.t) OR (y.d AND NOT x.d) THEN y ELSE x END) AS win FROM g)
SELECT n.conv_id, first_turn, first_set, n.role, agent, content, card_type, card_data
FROM n JOIN w ON n.conv_id = w.conv_id AND n.role = w.role AND n.a = w.a AND n.c = w.c AND n.s = w.win.s AND n.turn = w.win.turn""")
def _(t):
    user = F.col("role") == "user"
    said = t.conversations
    old = said.select("conv_id", "turn", "role", F.when(user, "x").otherwise("planner").alias("agent"), F.col("text").alias("content"),
                      F.lit("").alias("card_type"), F.lit("").alias("card_data"))
    loud = F.when(F.col("turn") % 2 == 0, F.replace("text", F.lit("e"), F.lit("E"))).otherwise(F.concat(F.lit("  "), "text", F.lit(" ")))
    new = said.select("conv_id", "turn", "role", F.when(user, "y").otherwise("planner").alias("agent"), loud.alias("content"),
                      F.when(F.col("turn") % 3 == 0, "plan").otherwise("").alias("card_type"), F.lit("").alias("card_data"))
    more = said.select("conv_id", (F.col("turn") + 100).alias("turn"), "role", F.lit("planner").alias("agent"), F.col("text").alias("content"),
                       F.lit("").alias("card_type"), F.when(F.col("turn") % 2 == 0, "{}").otherwise("").alias("card_data"))
    return sets.merge_messages(old, new.unionByName(more), ["turn"])
