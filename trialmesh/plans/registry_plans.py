"""Registry queries: filters, projections, joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from trialmesh import catalog as fx
from trialmesh.functions import text as tx
from trialmesh.operators import registry as ops
from trialmesh.plans.registry import query


@query("list_by_scope", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 7
ORDER BY c_custkey DESC""")
def _(t):
    return ops.list_by_scope(t.customer, "c_nationkey", 7, "c_custkey")


PATHS = """paths AS (
  SELECT *, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN 's3://lake/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.csv' ELSE '.pdf' END END,
         '/mnt/data/' || o_orderkey || '.CSV?v=1') AS path FROM orders)"""


@query("registry_projection", f"""
WITH {PATHS}
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS use_case_id, path,
  CASE WHEN path LIKE '%.pdf' THEN 'pdf' ELSE 'csv' END AS data_format,
  CASE WHEN path LIKE '%.pdf' THEN 'unstructured' ELSE 'structured' END AS data_category,
  false AS is_best, o_totalprice AS total_price, o_orderdate AS created_at
FROM paths""")
def _(t):
    return ops.registry_projection(fx.datasets(t))


@query("optional_filters", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'""")
def _(t):
    return ops.optional_filters(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
                                c_nationkey=None, c_mktsegment="BUILDING")


@query("flag_in_set", """
SELECT o_orderkey, o_orderstatus, lower(o_orderstatus) IN ('o', 'p') AS is_active FROM orders""")
def _(t):
    return ops.flag_in_set(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o", "P"], "is_active")


@query("transition_status", """
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O','P') THEN 'failed' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderstatus IN ('O','P') THEN o_orderstatus END AS previous_status,
  CASE WHEN o_orderstatus IN ('O','P') THEN 'worker restarted' END AS error,
  o_orderstatus IN ('F') AS refused
FROM orders""")
def _(t):
    return ops.transition_status(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")),
                                 ["O", "P"], "failed", ["F"], "worker restarted")


@query("memberships", """
SELECT c_custkey % 3 AS user_id, c_nationkey AS organization_id, n_name AS organization_name, c_custkey AS membership_id
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 1 ORDER BY c_custkey DESC""")
def _(t):
    return ops.memberships(fx.projects(t), fx.members(t), 1)


@query("use_cases_with_project", """
SELECT c_nationkey AS project_id, c_custkey AS id, c_name AS name, c_mktsegment AS status, c_acctbal AS balance,
  n_regionkey AS organization_id, n_name AS project_name
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2""")
def _(t):
    return ops.use_cases_with_project(fx.use_cases(t), fx.projects(t), org=2)


ORDER_MEMBERS = "SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0"


def _order_members(t):
    return t.orders.select((F.col("o_orderkey") % 2).alias("user_id"), F.col("o_custkey").alias("organization_id"))


@query("accessible", f"""
SELECT c_custkey AS organization_id, c_name FROM customer WHERE c_custkey IN ({ORDER_MEMBERS})""")
def _(t):
    return ops.accessible(t.customer.select(F.col("c_custkey").alias("organization_id"), "c_name"), _order_members(t), 0)


@query("denied", f"""
SELECT c_custkey AS organization_id, c_name FROM customer WHERE c_custkey NOT IN ({ORDER_MEMBERS})""")
def _(t):
    return ops.denied(t.customer.select(F.col("c_custkey").alias("organization_id"), "c_name"), _order_members(t), 0)


@query("datasets_with_project", """
SELECT o_orderkey AS id, o_custkey AS use_case_id,
  coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 25 AS INTEGER) END, c_nationkey) AS project_id,
  c_name AS use_case_name, n_regionkey AS organization_id, n_name AS project_name, o_orderdate AS created_at
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 25 AS INTEGER) END, c_nationkey)""")
def _(t):
    return ops.datasets_with_project(fx.datasets(t).select("id", "use_case_id", "project_id", "created_at"),
                                     fx.use_cases(t), fx.projects(t))


@query("model_registry", f"""
WITH {PATHS}, r AS (
  SELECT o_orderkey, o_custkey, path, o_orderdate,
    coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 25 AS INTEGER) END, c_nationkey) AS project_id, c_name
  FROM paths JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey AS training_run_id, n_regionkey AS organization_id, project_id, n_name AS project_name,
  o_custkey AS use_case_id, c_name AS use_case_name, o_orderkey AS dataset_id, path AS dataset_path,
  o_orderdate AS created_at, l_linenumber AS rank, l_discount AS metric_value, l_partkey AS part, l_suppkey AS supp,
  l_shipdate AS shipped
FROM r JOIN nation ON n_nationkey = project_id LEFT JOIN lineitem ON l_orderkey = o_orderkey
ORDER BY created_at DESC, rank ASC NULLS LAST""")
def _(t):
    return ops.model_registry(fx.training_runs(t), fx.datasets(t), fx.use_cases(t), fx.projects(t), fx.entries(t))


@query("valid_at", """
SELECT event_id AS token, user_id, ts + INTERVAL 7 DAY AS expires_at, ts AS created_at
FROM events WHERE event_type <> 'error' AND ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00' AND user_id % 7 <> 0""")
def _(t):
    return ops.valid_at(fx.sessions(t), fx.users(t), datetime(2024, 1, 20)).select(
        "token", "user_id", "expires_at", "created_at")


@query("attach_sources", """
WITH s AS (
  SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN '' ELSE 's3://lake/' || l_orderkey END AS s3_path,
    'https://data.example.com/' || l_suppkey AS dataset_url, CAST(l_quantity AS BIGINT) AS row_count,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn
  FROM lineitem)
SELECT p_partkey AS problem_id, p_name, coalesce(s3_path, '') AS s3_path, row_count,
  CASE WHEN coalesce(s3_path, '') = '' THEN dataset_url END AS dataset_url
FROM part LEFT JOIN s ON p_partkey = l_partkey AND rn = 1""")
def _(t):
    sources = t.lineitem.select(
        F.col("l_partkey").alias("problem_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("s3://lake/"), "l_orderkey")).alias("s3_path"),
        F.concat(F.lit("https://data.example.com/"), "l_suppkey").alias("dataset_url"),
        F.col("l_quantity").cast("bigint").alias("row_count"), "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    newest = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")]
    return ops.attach_sources(t.part.select(F.col("p_partkey").alias("problem_id"), "p_name"), sources, "problem_id", newest)


@query("fill_from_lookup", """
SELECT o_orderkey, o_custkey, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, c_mktsegment) AS class,
  coalesce(CASE WHEN o_orderkey % 2 <> 0 THEN CAST(300 AS BIGINT) END, CAST(c_nationkey AS BIGINT)) AS min_rows
FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def _(t):
    wanted = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("class"),
                             F.when(F.col("o_orderkey") % 2 != 0, F.lit(300)).cast("bigint").alias("min_rows"))
    lookup = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("class"),
                               F.col("c_nationkey").cast("bigint").alias("min_rows"))
    return ops.fill_from_lookup(wanted, lookup, "o_custkey", ["class", "min_rows"])


@query("apply_overrides", """
SELECT p_partkey AS problem_id, 'label_column' AS role, CASE WHEN p_partkey % 9 <> 0 THEN p_name END AS inferred_name,
  coalesce(CASE WHEN p_partkey % 4 = 0 THEN p_type END, CASE WHEN p_partkey % 9 <> 0 THEN p_name END, '') AS confirmed_name,
  true AS user_confirmed
FROM part""")
def _(t):
    key = F.col("p_partkey")
    inferred = t.part.select(key.alias("problem_id"), F.lit("label_column").alias("role"),
                             F.when(key % 9 != 0, F.col("p_name")).alias("inferred_name"))
    overrides = t.part.where(key % 4 == 0).select(key.alias("problem_id"), F.lit("label_column").alias("role"),
                                                  F.col("p_type").alias("override"))
    return ops.apply_overrides(inferred, overrides, ["problem_id", "role"])


def _column_requests(t):
    kind, name = F.col("p_partkey") % 5, F.col("p_name")
    asked = (F.when(kind == 0, name).when(kind == 1, F.upper(name)).when(kind == 2, F.replace(name, F.lit(" "), F.lit("_")))
             .when(kind == 3, F.concat(name, F.lit(" id"))).otherwise(F.concat(F.lit("zz "), "p_type")))
    requests = t.part.select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("request_id"), asked.alias("requested"))
    header = t.part.groupBy(F.col("p_brand").alias("dataset")).agg(F.sort_array(F.collect_set("p_name")).alias("header"))
    return requests, header


REQUESTS = """requests AS (
  SELECT p_brand AS dataset, p_partkey AS request_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
    WHEN 2 THEN replace(p_name, ' ', '_') WHEN 3 THEN p_name || ' id' ELSE 'zz ' || p_type END AS requested FROM part),
cols AS (SELECT p_brand AS dataset, p_name AS col FROM part GROUP BY 1, 2)"""


@query("resolve_columns", f"""
WITH {REQUESTS}, m AS (
  SELECT r.*, col, CASE WHEN col = requested THEN 1 WHEN lower(col) = lower(requested) THEN 2
    WHEN regexp_replace(lower(col), '[^a-z0-9]', '', 'g') = regexp_replace(lower(requested), '[^a-z0-9]', '', 'g') THEN 3 END AS tier
  FROM requests r LEFT JOIN cols c USING (dataset)),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier NULLS LAST, col DESC) AS rn FROM m)
SELECT dataset, request_id, requested, CASE WHEN tier IS NOT NULL THEN col END AS resolved,
  CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'casefold' WHEN 3 THEN 'alphanumeric' ELSE 'unresolved' END AS tier
FROM best WHERE rn = 1""")
def _(t):
    return ops.resolve_columns(*_column_requests(t), policy="exact")


@query("suggest_columns", f"""
WITH {REQUESTS}, m AS (
  SELECT r.*, col, CASE WHEN lower(col) = lower(requested) THEN 1
    WHEN contains(lower(col), lower(requested)) OR contains(lower(requested), lower(col)) THEN 2 ELSE 3 END AS tier
  FROM requests r JOIN cols c USING (dataset)),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, col) AS rn FROM m)
SELECT dataset, request_id, requested, col AS resolved, tier <> 1 AS mismatch FROM best WHERE rn = 1""")
def _(t):
    return ops.resolve_columns(*_column_requests(t), policy="suggest")


@query("attach_gt_contents", """
WITH qa AS (SELECT doc_id AS qid, p AS position, doc_id + CASE p WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE -1 END AS gt
  FROM documents, (VALUES (0), (1), (2)) v(p))
SELECT qid, position, gt AS doc_id, text AS contents FROM qa LEFT JOIN documents d ON d.doc_id = gt""")
def _(t):
    key = F.col("doc_id")
    qa = t.documents.select(key.alias("qid"), F.array(key, key + 3, key - 1).alias("retrieval_gt"))
    return ops.attach_gt_contents(qa, t.documents.select("doc_id", F.col("text").alias("contents")))


@query("enrich_with_provenance", """
WITH w AS (SELECT c_custkey, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, n_name,
  'https://data.example.com/nation/' || n_nationkey AS url
  FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON n_nationkey = c_nationkey)
SELECT c_custkey, 'c_name' AS field, c_name AS value, 'uploaded' AS origin, NULL::VARCHAR AS source_url, 1.0::DOUBLE AS confidence FROM w
UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR), 'uploaded', NULL, 1.0 FROM w
UNION ALL SELECT c_custkey, 'nation_name', n_name, 'enriched', url, CASE WHEN n_name IS NULL THEN 0.0 ELSE 0.8 END FROM w""")
def _(t):
    seed = t.customer.select("c_custkey", "c_name", fx.cents("c_acctbal").alias("c_acctbal"))
    side = t.nation.where("n_regionkey <> 3").select(
        F.col("n_nationkey"), F.col("n_name").alias("nation_name"),
        F.concat(F.lit("https://data.example.com/nation/"), "n_nationkey").alias("url"))
    enrichment = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(side, "n_nationkey").drop("n_nationkey")
    return ops.enrich_with_provenance(seed, enrichment, "url", ["c_custkey"])


@query("cascade_delete", """
WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 1), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'region' AS table_name, CAST(r_regionkey AS BIGINT) AS id FROM region WHERE r_regionkey <> 1
UNION ALL SELECT 'nation', n_nationkey FROM n UNION ALL SELECT 'customer', c_custkey FROM c
UNION ALL SELECT 'orders', o_orderkey FROM o""")
def _(t):
    left = ops.cascade_delete(
        [("region", t.region, "r_regionkey", None), ("nation", t.nation, "n_nationkey", "n_regionkey"),
         ("customer", t.customer, "c_custkey", "c_nationkey"), ("orders", t.orders, "o_orderkey", "o_custkey")],
        t.region.where("r_regionkey = 1").select("r_regionkey"))
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    parts = [df.select(F.lit(name).alias("table_name"), F.col(keys[name]).cast("bigint").alias("id")) for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
