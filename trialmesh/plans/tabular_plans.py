"""Tabular experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmesh import catalog as fx
from trialmesh.operators import tabular as ops
from trialmesh.plans.registry import query, rounded

KEY_SQL = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), CAST(l_extendedprice AS DECIMAL(18,2)))"


@query("split_holdout", f"""
WITH t AS (SELECT {KEY_SQL} AS key, l_returnflag AS label FROM lineitem),
c AS (SELECT label, count(*) AS n FROM t GROUP BY 1), tot AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(ceil(sum(n) / 4) AS BIGINT) AS held FROM c),
q AS (SELECT label, c.n * held // tot.n AS base, c.n * held % tot.n AS rest, held FROM c, tot),
r AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= held - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q)
SELECT key, t.label, CASE WHEN row_number() OVER (PARTITION BY t.label ORDER BY md5('42' || key), key) <= quota THEN 'holdout' ELSE 'train' END AS side
FROM t JOIN r ON r.label = t.label""")
def _(t):
    rows = fx.train_table(t).select("key", F.col("l_returnflag").alias("label"))
    return ops.split_holdout(rows, "label", "multiclass_classification", "key")


@query("bag_folds", f"""
SELECT key, CAST(CAST('0x' || substr(md5('42' || key), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM (SELECT {KEY_SQL} AS key FROM lineitem)""")
def _(t):
    return ops.bag_folds(fx.train_table(t).select("key"), 5, "key")


SCORES = "s AS (SELECT value / 500 AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events)"


@query("calibrate_threshold", f"""
WITH {SCORES}, d AS (SELECT score, sum(label) AS pos, count(*) AS n FROM s GROUP BY 1),
r AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS taken, (SELECT sum(label) FROM s) AS p FROM d)
SELECT score AS threshold, round(2.0 * tp / (2.0 * tp + (taken - tp) + (p - tp)), 10) AS f1 FROM r ORDER BY 2 DESC, 1 LIMIT 1""")
def _(t):
    return ops.calibrate_threshold(fx.binary_scores(t), "label", "f1")


@query("binary_metrics", f"""
WITH s AS (SELECT least(1.0, value / 100) AS score, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label FROM events),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS avg_rank FROM s),
c AS (SELECT CAST(count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND score < 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label = 0 AND score < 0.5) AS DOUBLE) AS tn,
  sum(avg_rank) FILTER (WHERE label = 1) AS ranks,
  -avg(CASE WHEN label = 1 THEN ln(greatest(1e-15, least(1 - 1e-15, score))) ELSE ln(1 - greatest(1e-15, least(1 - 1e-15, score))) END) AS ll FROM r)
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((ranks - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (fp + tn)), 6) AS roc_auc,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
  round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) AS mcc, round(ll, 6) AS log_loss FROM c""")
def _(t):
    scores = t.events.select((F.col("event_type") == "purchase").cast("int").alias("label"), F.least(F.lit(1.0), F.col("value") / 100).alias("score"))
    return rounded(ops.binary_metrics(scores))


@query("multiclass_metrics", """
WITH p AS (SELECT l_returnflag AS l, CASE WHEN l_quantity <= 17 THEN 'A' WHEN l_quantity <= 34 THEN 'N' ELSE 'R' END AS p, l_tax + 0.1 AS prob FROM lineitem),
c AS (SELECT c, count(*) FILTER (WHERE l = c AND p = c) AS tp, count(*) FILTER (WHERE l = c) AS support, count(*) FILTER (WHERE p = c) AS predicted
  FROM p, (SELECT DISTINCT l AS c FROM p) GROUP BY 1)
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(tp / support), 6) AS balanced_accuracy, round(avg(2 * tp / (support + predicted)), 6) AS f1_macro,
  round(sum(tp) / sum(support), 6) AS f1_micro, round(sum(2 * tp / (support + predicted) * support) / sum(support), 6) AS f1_weighted,
  (SELECT round(-avg(ln(prob)), 6) FROM p) AS log_loss FROM c""")
def _(t):
    preds = t.lineitem.select(
        F.col("l_returnflag").alias("label"), (F.col("l_tax") + 0.1).alias("prob"),
        F.when(F.col("l_quantity") <= 17, "A").when(F.col("l_quantity") <= 34, "N").otherwise("R").alias("prediction"))
    return rounded(ops.multiclass_metrics(preds, prob="prob"))


@query("regression_metrics", """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS f FROM lineitem)
SELECT round(sqrt(avg((y - f) * (y - f))), 4) AS root_mean_squared_error, round(avg(abs(y - f)), 4) AS mean_absolute_error,
  round(avg((y - f) * (y - f)), 1) AS mean_squared_error, round(quantile_cont(abs(y - f), 0.5), 4) AS median_absolute_error,
  round(1 - avg((y - f) * (y - f)) / var_pop(y), 6) AS r2, round(avg(abs(y - f) / abs(y)), 6) AS mape FROM p""")
def _(t):
    digits = {"mean_squared_error": 1, "r2": 6, "mape": 6}
    m = ops.regression_metrics(fx.regression_preds(t))
    return m.select(*[F.round(c, digits.get(c, 4)).alias(c) for c in m.columns])


@query("select_winner", f"""
WITH {fx.RUNS_SQL} SELECT run_id, round, {', '.join(fx.SEQ)}, score FROM runs WHERE status = 'completed' AND score IS NOT NULL
ORDER BY score, {', '.join(fx.SEQ)} LIMIT 1""")
def _(t):
    return ops.require_winner(ops.select_winner(fx.runs(t), "root_mean_squared_error", fx.SEQ)).select("run_id", "round", *fx.SEQ, "score")


@query("seasonal_naive", f"""
WITH {fx.DAILY_SQL}, l AS (SELECT item, max(day) AS last FROM series GROUP BY 1),
w AS (SELECT item, CAST(step AS INTEGER) AS step, last + CAST(step AS INTEGER) AS day, last + CAST(step - 7 * ceil(step / 7) AS INTEGER) AS ref FROM l, range(1, 15) r(step))
SELECT w.item, w.day, step, target AS forecast FROM w LEFT JOIN series s ON s.item = w.item AND s.day = w.ref""")
def _(t):
    return ops.seasonal_naive(fx.daily_series(t), "item", "day", "target", 7, 14)


@query("forecast_metrics", f"""
WITH {fx.DAILY_SQL}, h AS (SELECT * FROM series WHERE day < DATE '2024-01-22'), a AS (SELECT * FROM series WHERE day >= DATE '2024-01-22'),
l AS (SELECT item, max(day) AS last FROM h GROUP BY 1),
f AS (SELECT a.item, a.day, a.target AS y, h.target AS f FROM a JOIN l ON l.item = a.item
  JOIN h ON h.item = a.item AND h.day = l.last + CAST((a.day - l.last) - 7 * ceil((a.day - l.last) / 7) AS INTEGER) WHERE a.day - l.last <= 14),
s AS (SELECT x.item, avg(abs(x.target - b.target)) AS scale FROM h x JOIN h b ON b.item = x.item AND b.day = x.day - 7 GROUP BY 1)
SELECT f.item, round(sum(abs(y - f)) / sum(y), 6) AS wql, round(avg(abs(y - f)) / any_value(scale), 6) AS mase, round(sum(abs(y - f)) / sum(y), 6) AS wape,
  round(avg(abs(y - f) / y), 6) AS mape, round(avg(2 * abs(y - f) / (y + f)), 6) AS smape, round(avg((y - f) * (y - f)), 2) AS mse,
  round(sqrt(avg((y - f) * (y - f))), 4) AS rmse FROM f JOIN s ON s.item = f.item GROUP BY 1""")
def _(t):
    series = fx.daily_series(t)
    history = series.where("day < date'2024-01-22'")
    fc = ops.seasonal_naive(history, "item", "day", "target", 7, 14).join(series, ["item", "day"])
    m = ops.forecast_metrics(fc, history, "item", "day", "target", 7)
    digits = {"mse": 2, "rmse": 4}
    return m.select("item", *[F.round(c, digits.get(c, 6)).alias(c) for c in m.columns if c != "item"])


@query("apply_quality_fixes", f"""
WITH {fx.CUSTOMER_NULLS_SQL} SELECT c_custkey, c_mktsegment, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM cust)), 4) AS c_acctbal
FROM cust WHERE c_mktsegment IS NOT NULL""")
def _(t):
    fixed = ops.apply_quality_fixes(fx.customer_nulls(t), {"c_acctbal": "median", "c_mktsegment": "drop"})
    return fixed.select("c_custkey", "c_mktsegment", F.round("c_acctbal", 4).alias("c_acctbal"))
