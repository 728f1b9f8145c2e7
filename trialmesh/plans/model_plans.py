"""Model queries.  Trees and optimisers have no SQL form: rows, sums of probabilities and error bounds are checked."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from trialmesh import catalog as fx
from trialmesh.operators import models as ops
from trialmesh.operators.tabular import split_holdout
from trialmesh.plans.registry import query
from trialmesh.plans.tabular_plans import KEY_SQL
from trialmesh.session import materialize

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_linestatus"]


def _binary(t):
    return fx.train_table(t).select("key", *FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("label"))


def _regression(t):
    return fx.train_table(t).select("key", *[f for f in FEATURES if f != "l_extendedprice"], F.col("l_extendedprice").alias("label"))


def _split(t):
    rows = materialize(split_holdout(_binary(t), "label", ops.BINARY, "key"), "split")
    return rows.where("side = 'train'").drop("side"), rows.where("side = 'holdout'").drop("side")


HELD_OUT = "CAST(ceil(count(*) / 4) AS BIGINT)"
#: How much worse than always predicting the training mean a family may be; five neighbours of pure noise cost a fifth.
SLACK = 1.25


def _family(family, task=ops.BINARY):
    """Fitted on the training side; the holdout side: its rows, whether probabilities add up to 1, and the squared error."""
    def run(t):
        rows = fx.train_table(t).select("key", *FEATURES, F.col("l_returnflag").alias("label"))
        if task == ops.BINARY:
            rows = _binary(t)
        elif task == ops.REGRESSION:
            rows = _regression(t)
        features = [c for c in rows.columns if c not in ("key", "label")]
        sides = materialize(split_holdout(rows, "label", task, "key"), "split")
        train, held = sides.where("side = 'train'"), sides.where("side = 'holdout'")
        model = ops.fit_family(train, features, "label", task, family)
        scored = ops.batch_predict(model, held)
        if task == ops.REGRESSION:
            error, prior = F.avg(F.pow(F.col("prediction") - F.col("label"), 2)), F.var_pop("label")
            return scored.agg(F.count("prediction").alias("rows"), F.lit(True).alias("adds_up"), (error <= SLACK * prior).alias("near_or_below_the_mean"))
        classes = F.array(*[F.lit(c) for c in model.classes])
        own = F.array_position(classes, F.col("label").cast("string")) - 1
        gap = F.aggregate(F.transform("probability", lambda p, i: F.pow(p - F.when(i == own, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x)
        total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
        shares = held.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        shares = shares.agg((1 - F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("prior"))
        found = scored.agg(F.count("prediction").alias("rows"), F.bool_and(F.abs(total - 1) < 1e-6).alias("adds_up"), F.avg(gap).alias("error"))
        return found.join(F.broadcast(shares)).select("rows", "adds_up", (F.col("error") <= SLACK * F.col("prior")).alias("near_or_below_the_mean"))
    return run


FIRST = {"RF": ops.BINARY, "XT": ops.REGRESSION, "GBM": ops.MULTICLASS, "XGB": ops.BINARY, "CAT": ops.REGRESSION,
         "LR": ops.MULTICLASS, "KNN": ops.MULTICLASS, "NN_TORCH": ops.BINARY, "FASTAI": ops.BINARY}
for _name, _first in FIRST.items():
    for _task in (ops.BINARY, ops.MULTICLASS, ops.REGRESSION):
        query(f"fit_family_{_name.lower()}" + ("" if _task == _first else "_" + _task.split("_")[0]),
              f"SELECT {HELD_OUT} AS rows, true AS adds_up, true AS near_or_below_the_mean FROM lineitem")(_family(_name, _task))


@query("weighted_ensemble", f"SELECT {HELD_OUT} AS rows, true AS no_worse_than_its_parts FROM lineitem")
def _(t):
    train, holdout = _split(t)
    rows, names = holdout, []
    for family in ("RF", "LR", "KNN"):
        model = ops.fit_family(train, FEATURES, "label", ops.BINARY, family)
        keep = list(rows.columns)
        rows = model.transform(rows).select(*keep, F.col("probability")[1].alias(family))
        names.append(family)
    rows = ops.materialize(rows.select("key", "label", *names), "ensemble")
    mixed = ops.blend(rows, ops.weighted_ensemble(rows, names, "label"))

    def loss(name):
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(name)))
        return -F.avg(F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    return mixed.agg(F.count("ensemble").alias("rows"), (loss("ensemble") <= F.least(*map(loss, names)) + 1e-9).alias("no_worse_than_its_parts"))


@query("stack_level", f"""
SELECT key, CAST(CAST('0x' || substr(md5('42' || key), 1, 8) AS BIGINT) % 2 AS INTEGER) AS fold, label, true AS oof_lr_is_share, true AS oof_rf_is_share
FROM (SELECT {KEY_SQL} AS key, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)""")
def _(t):
    out = ops.stack_level(_binary(t), FEATURES, "label", ops.BINARY, ["LR", "RF"], "key", 2)
    return out.select("key", "fold", "label", F.col("oof_LR").between(0, 1).alias("oof_lr_is_share"), F.col("oof_RF").between(0, 1).alias("oof_rf_is_share"))


@query("bagged", f"SELECT {HELD_OUT} AS rows, true AS near_or_below_the_mean FROM lineitem")
def _(t):
    train, holdout = _split(t)
    scored = ops.bagged(train, holdout, FEATURES, "label", ops.BINARY, "GBM", "key", 3)
    error = F.avg(F.pow(F.col("score") - F.col("label"), 2))
    return scored.agg(F.count("score").alias("rows"), (error <= SLACK * F.var_pop("label")).alias("near_or_below_the_mean"))


@query("batch_predict", f"SELECT count(*) AS records, {HELD_OUT} AS held_out, true AS near_or_below_the_mean FROM lineitem")
def _(t):
    """Fitted on the training side, applied to all records; the holdout side is predicted better than by its mean."""
    sides = materialize(split_holdout(_regression(t), "label", ops.REGRESSION, "key"), "split")
    features = [c for c in sides.columns if c not in ("key", "label", "side")]
    model = ops.fit_family(sides.where("side = 'train'"), features, "label", ops.REGRESSION, "LR")
    scored = ops.batch_predict(model, sides)
    held = F.col("side") == "holdout"
    error = F.avg(F.when(held, F.pow(F.col("prediction") - F.col("label"), 2)))
    return scored.agg(F.count(F.lit(1)).alias("records"), F.count_if(held).alias("held_out"),
                      (error < SLACK * F.var_pop(F.when(held, F.col("label")))).alias("near_or_below_the_mean"))


@query("run_rounds", """
SELECT round, 'r' || round || '_exp' || e AS experiment_id, CAST((round - 1) * 3 + e - 1 AS INTEGER) AS seq,
  ['fast_baseline', 'balanced_ensemble', 'deployable_simple', 'quality_search', 'imbalance_aware'][((round - 1) * 3 + e - 1) % 5 + 1] AS intent,
  'completed' AS status, 'roc_auc' AS primary_metric, true AS score_is_share, true AS has_validation, CAST(NULL AS VARCHAR) AS error_summary
FROM (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS round), (SELECT unnest([1, 2, 3]) AS e) WHERE EXISTS (SELECT 1 FROM lineitem)""")
def _(t):
    log = ops.run_rounds(_binary(t), FEATURES, "label", ops.BINARY, "roc_auc", "key")
    return log.select("round", "experiment_id", "seq", "intent", "status", "primary_metric", F.col("score").between(0.4, 1).alias("score_is_share"),
                      F.map_contains_key("secondary_metrics", "validation_loss").alias("has_validation"), "error_summary")


@query("feature_importance", f"""
SELECT {len(FEATURES)}::BIGINT AS features, 1.0::DOUBLE AS total, true AS ranks_follow FROM lineitem HAVING count(*) > 0""")
def _(t):
    train, _holdout = _split(t)
    found = ops.feature_importance(ops.fit_family(train, FEATURES, "label", ops.BINARY, "RF"))
    ranks = F.array_sort(F.collect_list(F.struct("rank", (-F.col("importance")).alias("i"))))  # a row per feature
    return found.agg(F.count_distinct("feature").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
                     (F.transform(ranks, lambda r: r["i"]) == F.array_sort(F.transform(ranks, lambda r: r["i"]))).alias("ranks_follow"))


#: Features and factors of a label that they determine; a feature's importance is then twice its variance times the factor squared.
DETERMINES = {"l_quantity": 2.0, "l_discount": 100.0, "l_tax": 50.0}


@query("permutation_importance", f"""
SELECT feature, CAST(row_number() OVER (ORDER BY worth DESC) AS INTEGER) AS rank, true AS near_closed_form
FROM ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {x * x} * var_pop({c}) AS worth FROM lineitem" for c, x in DETERMINES.items())}) WHERE worth IS NOT NULL""")
def _(t):
    """A linear model of a determined label: which features count, and whether by as much as the closed form says."""
    rows = fx.train_table(t).select("key", *DETERMINES).withColumn("label", sum((F.col(c) * x for c, x in DETERMINES.items()), F.lit(0.0)))
    model = ops.fit_family(rows, list(DETERMINES), "label", ops.REGRESSION, "LR")
    spread = rows.agg(*[(F.var_pop(c) * (2 * x * x)).alias(c) for c, x in DETERMINES.items()])
    spread = spread.select(F.explode(F.create_map(*[y for c in DETERMINES for y in (F.lit(c), F.col(c))])).alias("feature", "expected"))  # a row per feature
    found = ops.permutation_importance(model, rows, "label", "key").join(F.broadcast(spread), "feature")
    return found.select("feature", "rank", (F.col("importance") / F.col("expected")).between(0.8, 1.2).alias("near_closed_form"))


@query("text_classifier", """
SELECT d.doc_id, l.quality IS NOT NULL AS labelled, true AS probability_is_valid FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(t):
    """Learned from three quarters of the labelled documents, applied to all documents."""
    labelled = fx.text_train(t)
    model = ops.text_classifier(labelled.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "text", "label")
    scored = model.transform(t.documents.select("doc_id", "text"))
    known = labelled.select("doc_id", F.lit(True).alias("known"))
    return scored.join(known, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("labelled"),
                                                       F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, x: a + x).between(0.999999, 1.000001).alias("probability_is_valid"))
