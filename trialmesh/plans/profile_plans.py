"""Aggregation queries."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from trialmesh import catalog as fx
from trialmesh.operators import profile as ops
from trialmesh.plans.registry import query, rounded

USAGE_AGG = """
  CAST(coalesce(sum(total_cost), 0) AS DOUBLE) AS spend,
  CAST(coalesce(sum(units) FILTER (WHERE event_type IN ('exa_acu', 'exa_search')), 0) AS BIGINT) AS exa_datasets,
  CAST(coalesce(sum(units) FILTER (WHERE event_type = 'autorag_compute'), 0) AS BIGINT) AS rag_trials,
  CAST(coalesce(sum(units) FILTER (WHERE event_type = 'autogluon_compute'), 0) AS BIGINT) AS training_runs,
  CAST(coalesce(sum(units) FILTER (WHERE event_type = 'deployment_runtime'), 0) AS BIGINT) AS deployment_runtime"""


@query("usage_summary", f"""
WITH {fx.USAGE_SQL}
SELECT organization_id, {USAGE_AGG} FROM usage_events WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1""")
def _(t):
    return ops.usage_summary(fx.usage_events(t), since=datetime(2024, 1, 1))


@query("count_active_children", """
SELECT n_regionkey AS organization_id, count(*) AS use_cases FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_mktsegment <> 'archived' GROUP BY 1""")
def _(t):
    return ops.count_active_children(fx.use_cases(t), fx.projects(t))


@query("usage_vs_limits", f"""
WITH {fx.USAGE_SQL}, u AS (SELECT organization_id, {USAGE_AGG} FROM usage_events GROUP BY 1),
p AS (SELECT *, organization_id * 2 AS use_cases, CASE organization_id WHEN 0 THEN 'free' WHEN 1 THEN 'pro' WHEN 2 THEN 'enterprise' WHEN 3 THEN 'free' ELSE 'pro' END AS plan FROM u),
i AS (SELECT organization_id, plan, unnest([{{'item': 'useCases', 'value': CAST(use_cases AS DOUBLE), 'free': 1, 'pro': 3}},
  {{'item': 'exaDatasets', 'value': CAST(exa_datasets AS DOUBLE), 'free': 0, 'pro': 10}},
  {{'item': 'ragTrials', 'value': CAST(rag_trials AS DOUBLE), 'free': 0, 'pro': 5}},
  {{'item': 'trainingRuns', 'value': CAST(training_runs AS DOUBLE), 'free': 1, 'pro': 10}}]) AS s FROM p),
l AS (SELECT organization_id, plan, s.item AS item, s.value AS value,
  CAST(CASE plan WHEN 'free' THEN s.free WHEN 'pro' THEN s.pro END AS BIGINT) AS "limit" FROM i)
SELECT *, CAST(CASE WHEN "limit" IS NOT NULL THEN least(100, floor(value / greatest("limit", 1) * 100 + 0.5)) END AS BIGINT) AS percent
FROM l""")
def _(t):
    usage = ops.usage_summary(fx.usage_events(t)).withColumn("use_cases", F.col("organization_id") * 2)
    names = F.array(*[F.lit(n) for n in ("free", " Pro ", "ENTERPRISE", "gold", "pro")])
    plans = t.events.select((F.col("user_id") % 5).alias("organization_id")).distinct().withColumn(
        "plan", F.element_at(names, F.col("organization_id").cast("int") + 1))
    return ops.usage_vs_limits(usage, plans)


@query("registry_counts", """
SELECT 'training_runs' AS measure, count(DISTINCT l_orderkey) AS value FROM lineitem
UNION ALL SELECT 'best_models', count(*) FILTER (WHERE l_linenumber = 1) FROM lineitem
UNION ALL SELECT 'completed_runs', count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_orderkey END) FROM lineitem
UNION ALL SELECT 'structured', count(*) FILTER (WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 = 0) FROM orders
UNION ALL SELECT 'unstructured', count(*) FILTER (WHERE o_orderkey % 2 <> 0) FROM orders
UNION ALL SELECT 'active_use_cases', count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) FROM customer
UNION ALL SELECT 'parent_projects', count(DISTINCT c_nationkey) FROM customer""")
def _(t):
    models = t.lineitem.select(F.col("l_orderkey").alias("training_run_id"), (F.col("l_linenumber") == 1).alias("is_best"),
                               F.when(F.col("l_linestatus") == "F", "complete").otherwise("running").alias("status"))
    data = t.orders.select(F.when(F.col("o_orderkey") % 2 == 0, "structured").otherwise("unstructured").alias("data_category"))
    cases = t.customer.select(F.col("c_nationkey").alias("project_id"), F.when(F.col("c_mktsegment") == "BUILDING", "Approved")
                              .when(F.col("c_mktsegment") == "MACHINERY", "DEPLOYED").otherwise("draft").alias("status"))
    return ops.registry_counts(models, data, cases)


@query("profile_shape", f"""
WITH {fx.CUSTOMER_NULLS_SQL}
SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns,
  (count(*) * 2 - count(c_acctbal) - count(c_mktsegment)) / greatest(count(*) * 5, 1) AS missing_cells_ratio FROM cust""")
def _(t):
    return ops.profile_shape(fx.customer_nulls(t))


@query("profile_target", f"""
WITH {fx.CUSTOMER_NULLS_SQL}, c AS (SELECT c_mktsegment AS class, count(*) AS n FROM cust GROUP BY 1),
best AS (SELECT * FROM c WHERE class IS NOT NULL)
SELECT 'c_mktsegment' AS name, 'string' AS dtype, (SELECT count(class) FROM c) AS unique_count,
  (SELECT coalesce(sum(n) FILTER (WHERE class IS NULL), 0) / sum(n) FROM c) AS missing_ratio, class, n,
  (SELECT max(n) / min(n) FROM best) AS imbalance_ratio, 0::BIGINT AS hidden_classes, 0::BIGINT AS hidden_rows FROM best""")
def _(t):
    return ops.profile_target(fx.customer_nulls(t), "c_mktsegment")


@query("profile_features", """
WITH s AS (
  SELECT 'o_orderkey' AS name, 'numeric' AS kind, count(DISTINCT o_orderkey) AS d, count(*) - count(o_orderkey) AS z, count(*) AS n FROM orders
  UNION ALL SELECT 'o_custkey', 'numeric', count(DISTINCT o_custkey), count(*) - count(o_custkey), count(*) FROM orders
  UNION ALL SELECT 'o_totalprice', 'numeric', count(DISTINCT o_totalprice), 0, count(*) FROM orders
  UNION ALL SELECT 'o_orderdate', 'datetime', count(DISTINCT o_orderdate), 0, count(*) FROM orders
  UNION ALL SELECT 'o_orderpriority', 'categorical', count(DISTINCT o_orderpriority), 0, count(*) FROM orders
  UNION ALL SELECT 'sparse', 'categorical', count(DISTINCT CASE WHEN o_orderkey % 10 = 0 THEN 'x' END),
    count(*) FILTER (WHERE o_orderkey % 10 <> 0), count(*) FROM orders)
SELECT name, kind, count(*) OVER (PARTITION BY kind) AS kind_count, d AS n_distinct, d > least(50.0, n * 0.5) AS high_cardinality,
  d <= 1 AS constant, z / n >= 0.8 AS mostly_missing FROM s""")
def _(t):
    return ops.profile_features(t.orders.withColumn("sparse", F.when(F.col("o_orderkey") % 10 == 0, "x")), "o_orderstatus")


@query("column_schema", f"""
WITH {fx.CUSTOMER_NULLS_SQL}
SELECT 'c_custkey' AS name, 'integer' AS data_type, 0.0::DOUBLE AS null_pct, min(CAST(c_custkey AS VARCHAR)) AS sample_value FROM cust
UNION ALL SELECT 'c_name', 'string', 0.0, min(c_name) FROM cust
UNION ALL SELECT 'c_nationkey', 'integer', 0.0, min(CAST(c_nationkey AS VARCHAR)) FROM cust
UNION ALL SELECT 'c_balance', 'number', round((count(*) - count(c_acctbal)) / count(*) * 100, 2), min(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)) FROM cust
UNION ALL SELECT 'c_mktsegment', 'string', round((count(*) - count(c_mktsegment)) / count(*) * 100, 2), min(c_mktsegment) FROM cust""")
def _(t):
    return ops.column_schema(fx.customer_nulls(t).select("c_custkey", "c_name", "c_nationkey",
                                                         fx.cents("c_acctbal").alias("c_balance"), "c_mktsegment"))


@query("class_labels", "SELECT l_suppkey AS label, row_number() OVER (ORDER BY l_suppkey) - 1 AS position FROM lineitem GROUP BY 1")
def _(t):
    return ops.class_labels(t.lineitem, "l_suppkey")


@query("profile_documents", """
SELECT lang AS extension, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, lang IN ('en', 'fr') AS supported
FROM documents GROUP BY 1""")
def _(t):
    files = t.documents.select(F.col("lang").alias("extension"), F.col("n_chars").alias("bytes"))
    return ops.require_supported(ops.profile_documents(files, ["en", "fr"]))


@query("audit_constraints", """
SELECT 'priority_set' AS rule, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS violations FROM orders
UNION ALL SELECT 'status_allowed', count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) FROM orders
UNION ALL SELECT 'price_range', count(*) FILTER (WHERE o_totalprice NOT BETWEEN 1000 AND 300000) FROM orders
UNION ALL SELECT 'one_per_customer_day', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM
  (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
UNION ALL SELECT 'customer_known', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(t):
    orders = t.orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")))
    return ops.audit_constraints(orders, [
        {"rule": "priority_set", "kind": "not_null", "column": "o_orderpriority"},
        {"rule": "status_allowed", "kind": "allowed", "column": "o_orderstatus", "values": ["O", "F"]},
        {"rule": "price_range", "kind": "range", "column": "o_totalprice", "low": 1000, "high": 300000},
        {"rule": "one_per_customer_day", "kind": "unique", "columns": ["o_custkey", "o_orderdate"]},
        {"rule": "customer_known", "kind": "foreign", "column": "o_custkey", "parent": t.customer.where("c_acctbal > 0"),
         "parent_key": "c_custkey"}])


@query("segment_lift", """
WITH s AS (SELECT 'l_linestatus' AS segment, l_linestatus AS value, l_returnflag FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_returnflag FROM lineitem),
g AS (SELECT segment, value, count(*) AS rows, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS a FROM s GROUP BY 1, 2),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS p FROM lineitem),
m AS (SELECT *, rows - a AS b, p - a AS c, n - rows - p + a AS d FROM g, tot)
SELECT segment, value, rows, round(a / rows, 6) AS positive_rate, round(p / n, 6) AS baseline_rate, round((a / rows) / (p / n), 6) AS lift,
  round(n * pow(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)), 6) AS chi_square FROM m""")
def _(t):
    return rounded(ops.segment_lift(t.lineitem, F.col("l_returnflag") == "R", ["l_linestatus", "l_linenumber"]))


@query("pivot_metrics", """
SELECT l_suppkey AS run_id, concat_ws('|', l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_extendedprice AS DECIMAL(18,2))) AS experiment_id,
  l_discount AS roc_auc, CASE WHEN l_returnflag <> 'A' THEN l_quantity / 50 END AS accuracy, NULL::DOUBLE AS balanced_accuracy,
  NULL::DOUBLE AS mcc, l_tax AS f1, NULL::DOUBLE AS precision, CASE WHEN l_returnflag <> 'A' THEN l_tax * 2 END AS recall
FROM lineitem""")
def _(t):
    found = F.col("l_returnflag") != "A"
    evaluation = F.when(found, F.create_map(F.lit("accuracy"), F.col("l_quantity") / 50, F.lit("roc_auc"), F.lit(-1.0)))
    secondary = F.map_filter(F.create_map(F.lit("f1"), F.col("l_tax"), F.lit("recall"), F.when(found, F.col("l_tax") * 2)),
                             lambda k, v: v.isNotNull())
    runs = t.lineitem.select(
        F.col("l_suppkey").alias("run_id"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyyMMdd"),
                    fx.cents("l_extendedprice")).alias("experiment_id"),
        F.lit("roc_auc").alias("primary_metric"), F.col("l_discount").alias("primary_metric_value"),
        evaluation.alias("evaluation"), secondary.alias("secondary_metrics"))
    return ops.pivot_metrics(runs)


@query("round_has_success", f"""
WITH {fx.RUNS_SQL} SELECT run_id, round, bool_or(status = 'completed') AS has_success FROM runs GROUP BY 1, 2""")
def _(t):
    return ops.round_has_success(fx.runs(t))


@query("rag_run_summary", """
SELECT user_id % 5 AS run_id, count(*) AS trials, round(avg(value / 500), 6) AS mean_faithfulness,
  round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100), 6) AS mean_context_recall, round(quantile_cont(value, 0.95), 6) AS p95_latency_ms,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM events GROUP BY 1""")
def _(t):
    trials = t.events.select((F.col("user_id") % 5).alias("run_id"), (F.col("value") / 500).alias("faithfulness"),
                             (F.get_json_object("props", "$.k").cast("double") / 100).alias("context_recall"),
                             F.col("value").alias("latency_ms"), fx.cents("value").alias("cost"))
    return rounded(ops.rag_run_summary(trials))


GATES = {"lineitem": "tabular_multiclass_classification", "orders": "tabular_regression", "events": "time_series_forecasting",
         "documents": "text_classification", "benchmark": "rag_question_answering", "pages": "rag_document_retrieval"}


@query("min_rows_gate", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{k}' AS task, (SELECT count(*) FROM {n}) AS rows, CAST({ops.MIN_ROWS.get(k, 100)} AS BIGINT) AS min_rows"
    for n, k in GATES.items()) + ") SELECT *, CASE WHEN rows >= min_rows THEN 'ready' ELSE 'too small' END AS gate FROM c")
def _(t):
    counts = [getattr(t, n).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(n).alias("table_name"), F.lit(k).alias("task"), "rows") for n, k in GATES.items()]
    return ops.min_rows_gate(reduce(DataFrame.unionByName, counts))


@query("round_summaries", f"""
WITH {fx.RUNS_SQL}, e AS (SELECT run_id, CAST(round AS BIGINT) AS round, concat_ws('|', seq, seq2, strftime(seq3, '%Y%m%d'), CAST(seq4 AS DECIMAL(18,2))) AS experiment_id,
  status, score FROM runs)
SELECT run_id, round, experiment_id, status, score AS primary_metric_value,
  count(*) OVER (PARTITION BY run_id, round) AS experiments FROM e""")
def _(t):
    runs = fx.runs(t).withColumn("round", F.col("round").cast("string")).withColumn(
        "experiment_id", F.concat_ws("|", "seq", "seq2", F.date_format("seq3", "yyyyMMdd"), fx.cents("seq4")))
    return ops.round_summaries(runs.select("run_id", "round", "experiment_id", "status"),
                               runs.where("score is not null").select("run_id", "round", "experiment_id", F.col("score").alias("primary_metric_value")))
