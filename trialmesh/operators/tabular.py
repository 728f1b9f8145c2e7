"""Splits, folds, metrics, thresholds, forecasts and fixes for tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialmesh.operators.ranking import better_first
from trialmesh.scale import exact_percentile, running_totals
from trialmesh.session import broadcast_if_small, materialize

BUCKET_ROWS = 100_000


def split_holdout(df: DataFrame, label: str, task: str, key: str, seed: int = 42, frac: float = 0.25,
                  whole_below: int = 8) -> DataFrame:
    """Add ``side`` (train / holdout): ``ceil(frac · n)`` rows held out, in md5 order of the key.

    Stratified for a classification with more than one class when every class (null is
    one) has two rows and both sides can hold all classes; quotas by largest remainder.
    A table of fewer than ``whole_below`` rows has every row on both sides; 0 asks for the plain split
    at every size.  Rows are counted per class and hash prefix; only rows with the prefix at the quota's
    edge are sorted, so the table itself is never shuffled.  The counts per class and prefix are written first (eager).
    """
    classify = task in ("binary_classification", "multiclass_classification")
    total = df.count()
    if total < whole_below:
        return df.withColumn("side", F.explode(F.array(F.lit("train"), F.lit("holdout"))))
    digits = 1
    while digits < 6 and total / 16 ** digits > BUCKET_ROWS:
        digits += 1
    digest = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, digits)).withColumn(
        "_c", F.col(label).cast("string") if classify else F.lit("all"))
    per = materialize(rows.groupBy("_c", "_b").agg(F.count(F.lit(1)).alias("n")), "buckets")
    facts = per.groupBy("_c").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    held = -(-total * int(round(frac * 10_000)) // 10_000)
    if not (classify and facts["k"] > 1 and facts["least"] >= 2 and held >= facts["k"] and total - held >= facts["k"]):
        rows = rows.withColumn("_c", F.lit("all"))
        per = per.groupBy(F.lit("all").alias("_c"), "_b").agg(F.sum("n").alias("n"))
    sizes = per.groupBy("_c").agg(F.sum("n").alias("n"))
    share, rest = F.expr(f"n * {held} div {total}"), F.expr(f"n * {held} % {total}")
    spare = F.row_number().over(W.orderBy(rest.desc(), F.col("_c").asc_nulls_last()))
    given = F.sum("_q").over(W.partitionBy())
    quota = sizes.withColumn("_q", share).withColumn("_p", spare).select(
        "_c", (F.col("_q") + F.when(F.col("_p") <= F.lit(held) - given, 1).otherwise(0)).alias("_quota"))
    upto = F.sum("n").over(W.partitionBy("_c").orderBy("_b"))
    steps = per.withColumn("_upto", upto).alias("s").join(quota.alias("q"), F.col("s._c").eqNullSafe(F.col("q._c")))
    edge = steps.where("_upto >= _quota and _upto - n < _quota").select(
        F.col("s._c").alias("_ec"), F.col("_b").alias("_edge"), (F.col("_quota") - F.col("_upto") + F.col("n")).alias("_take"))
    # a row per class: shuffled by class, all rows of one would meet in one task
    edge = broadcast_if_small(materialize(edge, "edges"))
    marked = rows.join(edge, F.col("_c").eqNullSafe(F.col("_ec")), "left")
    at_edge = F.coalesce(F.col("_b") == F.col("_edge"), F.lit(False))
    place = F.row_number().over(W.partitionBy("_c", "_b").orderBy("_h", key))
    near = marked.where(at_edge).withColumn("side", F.when(place <= F.col("_take"), "holdout").otherwise("train"))
    far = marked.where(~at_edge).withColumn("side", F.when(F.col("_b") < F.col("_edge"), "holdout").otherwise("train"))
    return far.unionByName(near).select(*df.columns, "side")


def bag_folds(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """Add a fold number 0…k-1 from the key's hash; ``k`` is 0 (one fold) or at least 2."""
    if k == 1 or k < 0:
        raise ValueError("folds must be 0 or at least 2")
    digest = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    fold = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % max(k, 1)
    return df.withColumn("fold", fold.cast("int"))


def _score_counts(preds: DataFrame, label: str, score: str) -> DataFrame:
    return preds.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))


def _confusion_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    tp, fp, fn, tn = (c.cast("double") for c in (tp, fp, fn, tn))
    zero = F.lit(0.0)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), zero)

    recall, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "balanced_accuracy": (recall + spec) / 2,
        "mcc": ratio(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
    }


def calibrate_threshold(scores: DataFrame, label: str, metric: str, score: str = "score", **scale) -> DataFrame:
    """The threshold (predict 1 at or above it) with the best metric; ties go to the lowest.

    Scores are reduced to distinct values; totals from the top down come from the
    balanced running sums, so neither one group nor one task holds all scores.
    """
    counts = _score_counts(scores, label, score)
    totals = counts.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    above = running_totals(counts, [], -F.col("score"), [], {"tp": F.col("pos"), "taken": F.col("n")}, **scale)
    rows = above.join(F.broadcast(totals))
    fp = F.col("taken") - F.col("tp")
    fn = F.col("all_pos") - F.col("tp")
    value = _confusion_metrics(F.col("tp"), fp, fn, F.col("all_n") - F.col("taken") - fn)[metric]
    return rows.select(F.col("score").alias("threshold"), F.round(value, 10).alias(metric)).orderBy(
        F.col(metric).desc(), "threshold").limit(1)


def binary_metrics(preds: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5, **scale) -> DataFrame:
    """Metrics of a binary scorer in one row; AUC from average ranks of distinct scores."""
    counts = _score_counts(preds, label, score)
    neg = F.col("n") - F.col("pos")
    below = running_totals(counts, [], F.col("score"), [], {"neg_upto": neg}, **scale)
    pairs = F.sum(F.col("pos") * (F.col("neg_upto") - neg).cast("double") + F.col("pos") * neg * 0.5)
    hit = F.col("score") >= threshold
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score")))
    one = below.agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, neg).otherwise(0)).alias("tn"),
        pairs.alias("pairs"), F.sum(F.col("pos") * F.ln(p) + neg * F.ln(1 - p)).alias("ll"))
    m = _confusion_metrics(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    n_pos, n_neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return one.select(
        *[m[k].alias(k) for k in ("accuracy", "precision", "recall", "f1")],
        F.try_divide(F.col("pairs"), n_pos.cast("double") * n_neg).alias("roc_auc"),
        m["balanced_accuracy"].alias("balanced_accuracy"), m["mcc"].alias("mcc"), (-F.col("ll") / (n_pos + n_neg)).alias("log_loss"))


def multiclass_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction", prob: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, f1 (macro, micro, weighted) and, given the true class's probability, log loss."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(prob))) if prob else F.lit(None).cast("double")
    confusion = preds.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.ln(p)).alias("ll"))
    sides = confusion.select("n", "ll", F.inline(F.array(
        F.struct(F.col("l").alias("c"), F.lit(1).alias("is_label"), (F.col("l") == F.col("p")).cast("int").alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).alias("is_label"), F.lit(0).alias("hit")))))
    per = sides.groupBy("c").agg(
        F.sum(F.col("n") * F.col("hit")).alias("tp"), F.sum(F.col("n") * F.col("is_label")).alias("support"),
        F.sum(F.col("n") * (1 - F.col("is_label"))).alias("predicted"), F.sum(F.col("ll") * F.col("is_label")).alias("ll"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    total = F.sum("support")
    out = per.agg((F.sum("tp") / total).alias("accuracy"), F.avg(recall).alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"),
                  (F.sum("tp") / total).alias("f1_micro"), (F.sum(f1 * F.col("support")) / total).alias("f1_weighted"),
                  (-F.sum("ll") / total).alias("log_loss"))
    return out if prob else out.drop("log_loss")


def regression_metrics(preds: DataFrame, label: str = "label", prediction: str = "prediction", **scale) -> DataFrame:
    """RMSE, MAE, MSE, exact median absolute error, R² and MAPE in one row."""
    y, f = F.col(label).cast("double"), F.col(prediction).cast("double")
    err = preds.select(y.alias("y"), (y - f).alias("e"), F.abs(y - f).alias("a"))
    one = err.agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg("a").alias("mae"), F.var_pop("y").alias("v"),
                  F.avg(F.try_divide(F.col("a"), F.abs("y"))).alias("mape"))
    middle = exact_percentile(err.select("a"), [], "a", 0.5, "median_absolute_error", **scale)
    return one.join(F.broadcast(middle)).select(
        F.sqrt("mse").alias("root_mean_squared_error"), F.col("mae").alias("mean_absolute_error"),
        F.col("mse").alias("mean_squared_error"), "median_absolute_error",
        (1 - F.try_divide(F.col("mse"), F.col("v"))).alias("r2"), "mape")


def select_winner(runs: DataFrame, metric: str, seq: Sequence[str]) -> DataFrame:
    """Best completed, scored run overall (top-1); first submitted wins a tie."""
    scored = runs.where((F.col("status") == "completed") & F.col("score").isNotNull())
    return scored.orderBy(better_first("score", metric), *seq).limit(1)


def require_winner(winner: DataFrame) -> DataFrame:
    """Check (eagerly, one row) that there is a winner."""
    if winner.limit(1).count() == 0:
        raise ValueError("no successful experiment to select a winner from")
    return winner


def seasonal_naive(df: DataFrame, item: str, ts: str, target: str, period: int, horizon: int) -> DataFrame:
    """Forecast each of the next ``horizon`` days by the value of the same season in the last cycle seen."""
    last = df.groupBy(item).agg(F.max(ts).alias("_last"))
    ahead = last.select(item, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    back = F.col("step") - period * F.ceil(F.col("step") / period).cast("int")
    wanted = ahead.select(item, "step", F.date_add("_last", F.col("step")).alias(ts), F.date_add("_last", back).alias("_ref"))
    known = df.select(item, F.col(ts).alias("_ref"), F.col(target).alias("forecast"))
    return wanted.join(known, [item, "_ref"], "left").select(item, ts, "step", "forecast")


def forecast_metrics(fc: DataFrame, history: DataFrame, item: str, ts: str, target: str, period: int,
                     quantiles: dict[float, str] | None = None) -> DataFrame:
    """Per series: WQL, MASE, WAPE, MAPE, sMAPE, MSE and RMSE.

    ``fc`` holds ``target`` and ``forecast``; ``quantiles`` maps levels to forecast columns
    (default: the point forecast as the median).  MASE is scaled by the seasonal naive error of ``history``.
    """
    levels = quantiles or {0.5: "forecast"}
    y, f = F.col(target), F.col("forecast")
    e = F.abs(y - f)
    losses = [2 * F.greatest(q * (y - F.col(c)), (q - 1) * (y - F.col(c))) for q, c in levels.items()]
    per = fc.groupBy(item).agg(
        F.sum(reduce(lambda a, b: a + b, losses) / len(levels)).alias("ql"), F.sum(e).alias("ae"), F.sum(F.abs(y)).alias("ay"),
        F.avg(e).alias("mae"), F.avg(F.try_divide(e, F.abs(y))).alias("mape"),
        F.avg(F.try_divide(2 * e, F.abs(y) + F.abs(f))).alias("smape"), F.avg((y - f) * (y - f)).alias("mse"))
    past = history.select(item, F.date_add(ts, period).alias(ts), F.col(target).alias("_before"))
    scale = history.join(past, [item, ts]).groupBy(item).agg(F.avg(F.abs(F.col(target) - F.col("_before"))).alias("_scale"))
    return per.join(scale, item, "left").select(
        item, F.try_divide("ql", "ay").alias("wql"), F.try_divide("mae", "_scale").alias("mase"),
        F.try_divide("ae", "ay").alias("wape"), "mape", "smape", "mse", F.sqrt("mse").alias("rmse"))


def apply_quality_fixes(df: DataFrame, fixes: dict[str, str], **scale) -> DataFrame:
    """Per column ``median`` (fill by the exact median) or ``drop`` (remove rows without a value).

    Medians are taken before any row is dropped.
    """
    unknown = set(fixes.values()) - {"median", "drop"}
    if unknown:
        raise ValueError(f"unknown fixes {sorted(unknown)}")
    out = df
    for column in [c for c, how in fixes.items() if how == "median"]:
        middle = exact_percentile(df.select(F.col(column).cast("double").alias(column)), [], column, 0.5, "_m", **scale)
        out = out.join(F.broadcast(middle)).withColumn(column, F.coalesce(column, "_m")).drop("_m")
    return out.na.drop(subset=[c for c, how in fixes.items() if how == "drop"]) if "drop" in fixes.values() else out
