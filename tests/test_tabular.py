import math
import random

import pytest
from pyspark.sql import functions as F

from trialmesh.operators import models as md, tabular as tb


def table(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, c = rng.random(), rng.choice(["a", "b", None])
        y = int(x + (0.3 if c == "a" else 0) + rng.gauss(0, 0.1) > 0.6)
        rows.append((f"k{i}", x, rng.random(), c, y, ["lo", "mid", "hi"][min(2, int(x * 3))], 3 * x + 1))
    return spark.createDataFrame(rows, "key string, x double, z double, c string, y int, k string, t double")


def sides(df, label, task):
    return tb.split_holdout(df, label, task, "key")


def test_split_sizes_and_strata(spark):
    df = table(spark, 403)
    out = sides(df, "k", "multiclass_classification")
    assert out.count() == 403 and out.where("side = 'holdout'").count() == math.ceil(403 / 4)
    n = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    held = {r["k"]: r["count"] for r in out.where("side = 'holdout'").groupBy("k").count().collect()}
    assert all(abs(held[k] - n[k] * 101 / 403) < 1 for k in n)
    assert set(map(tuple, out.collect())) == set(map(tuple, sides(df, "k", "multiclass_classification").collect()))


def test_split_edges(spark):
    tiny = table(spark, 7)
    assert sides(tiny, "y", "binary_classification").groupBy("side").count().collect()[0]["count"] == 7
    lone = table(spark, 40).withColumn("y", F.when(F.col("key") == "k3", 9).otherwise(F.lit(1)))
    assert sides(lone, "y", "binary_classification").where("side = 'holdout'").count() == 10
    nulls = table(spark, 40).withColumn("y", F.when(F.col("x") > 0.5, 1))
    out = sides(nulls, "y", "binary_classification")
    assert out.count() == 40 and out.where("side = 'holdout'").count() == 10
    assert sides(table(spark, 41), "t", "regression").where("side = 'holdout'").count() == 11


@pytest.mark.parametrize("n, train, holdout", [(0, 0, 0), (1, 1, 1), (7, 7, 7), (8, 6, 2)])
def test_split_of_few_rows(spark, n, train, holdout):
    for label, task in (("y", "binary_classification"), ("t", "regression")):
        out = sides(table(spark, 8).where(F.substring("key", 2, 9).cast("int") < n), label, task)
        assert {r["side"]: r["count"] for r in out.groupBy("side").count().collect()} == {k: v for k, v in (("train", train), ("holdout", holdout)) if v}


def test_split_of_few_rows_plain(spark):
    out = tb.split_holdout(table(spark, 7).withColumn("y", F.lit(None).cast("int")), "y", "binary_classification", "key", whole_below=0)
    assert {r["side"]: r["count"] for r in out.groupBy("side").count().collect()} == {"train": 5, "holdout": 2}


def test_split_does_not_shuffle_rows_by_class(spark):
    """With two classes such a shuffle ends in two tasks; the planner's own threshold must not decide about it."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sides(table(spark, 403), "y", "binary_classification")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_split_many_buckets(spark, monkeypatch):
    df = table(spark, 300)
    one = {r["key"]: r["side"] for r in sides(df, "k", "multiclass_classification").collect()}
    monkeypatch.setattr(tb, "BUCKET_ROWS", 1)
    assert one == {r["key"]: r["side"] for r in sides(df, "k", "multiclass_classification").collect()}


def test_folds(spark):
    folds = tb.bag_folds(table(spark, 200), 4, "key")
    assert {r["fold"] for r in folds.select("fold").distinct().collect()} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        tb.bag_folds(folds, 1, "key")


def scores(spark, n=400):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "label int, score double")


def test_binary_metrics(spark):
    rows, df = scores(spark)
    m = tb.binary_metrics(df, cells=8).first()
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert m["roc_auc"] == pytest.approx(auc)
    tp, fp = sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg)
    assert m["precision"] == pytest.approx(tp / (tp + fp)) and m["recall"] == pytest.approx(tp / len(pos))


@pytest.mark.parametrize("metric", ["f1", "accuracy", "mcc"])
def test_threshold(spark, metric):
    rows, df = scores(spark)
    got = tb.calibrate_threshold(df, "label", metric, cells=8).first()

    def value(t):
        tp = sum(y and s >= t for y, s in rows); fp = sum((not y) and s >= t for y, s in rows)
        fn = sum(y and s < t for y, s in rows); tn = len(rows) - tp - fp - fn
        if metric == "f1":
            return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0
        if metric == "accuracy":
            return (tp + tn) / len(rows)
        d = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        return (tp * tn - fp * fn) / d if d else 0

    best = max(round(value(t), 10) for _, t in rows)
    assert got[metric] == pytest.approx(best)
    assert got["threshold"] == min(t for _, t in rows if round(value(t), 10) == best)


@pytest.mark.parametrize("family", ["RF", "GBM", "LR", "KNN", "NN_TORCH"])
def test_families_learn(spark, family):
    df = table(spark, 400)
    model = md.fit_family(df, ["x", "z", "c"], "y", md.BINARY, family)
    out = md.batch_predict(model, df)
    assert out.count() == 400
    right = out.where(F.col("prediction").cast("int") == F.col("y")).count()
    assert right > 320, (family, right)
    assert out.where((F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-6).count() == 0


def test_multiclass_and_regression(spark):
    df = table(spark, 400)
    for family in ("GBM", "KNN", "RF"):
        out = md.fit_family(df, ["x", "z"], "k", md.MULTICLASS, family).transform(df)
        assert out.where("prediction = k").count() > 340, family
    for family in ("RF", "XGB", "LR", "KNN", "XT", "NN_TORCH"):
        out = md.fit_family(df, ["x", "z"], "t", md.REGRESSION, family).transform(df)
        assert tb.regression_metrics(out, "t").first()["r2"] > 0.8, family


def test_importance_ensemble_and_stack(spark):
    df = table(spark, 300)
    ranked = md.feature_importance(md.fit_family(df, ["x", "z", "c"], "y", md.BINARY, "RF")).orderBy("rank").collect()
    assert ranked[0]["feature"] == "x" and sum(r["importance"] for r in ranked) == pytest.approx(1.0)
    preds = df.select("key", "y", F.col("x").alias("good"), F.col("z").alias("noise"))
    weights = md.weighted_ensemble(preds, ["noise", "good"], "y")
    assert weights["good"] > weights["noise"] and sum(weights.values()) == pytest.approx(1.0)
    oof = md.stack_level(df, ["x", "z"], "y", md.BINARY, ["LR"], "key", 2)
    assert oof.count() == 300 and oof.where("oof_LR is null").count() == 0


def test_rounds(spark):
    df = table(spark, 300)
    log = md.run_rounds(df, ["x", "z", "c"], "y", md.BINARY, "roc_auc", "key", 2, 2).collect()
    assert len(log) == 4 and all(r["status"] == "completed" and r["score"] > 0.7 for r in log), log
    assert [r["experiment_id"] for r in log][:2] == ["r1_exp1", "r1_exp2"]
    broken = md.run_rounds(df, ["x"], "y", md.BINARY, "no_such_metric", "key", 3, 2).collect()
    assert len(broken) == 2 and all(r["status"] == "failed" for r in broken)


def test_forecast_and_fixes(spark):
    days = spark.sql("select 'a' item, date_add(date'2024-01-01', cast(id as int)) day, cast(id % 7 as double) target from range(28)")
    fc = tb.seasonal_naive(days, "item", "day", "target", 7, 10).orderBy("step").collect()
    assert [r["forecast"] for r in fc] == [float(i % 7) for i in range(28, 38)]
    holes = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, 8.0, "c")], "i int, v double, c string")
    fixed = {r["i"]: r["v"] for r in tb.apply_quality_fixes(holes, {"v": "median", "c": "drop"}).collect()}
    assert fixed == {1: 1.0, 2: 3.0, 4: 8.0}
    with pytest.raises(ValueError):
        tb.apply_quality_fixes(holes, {"v": "guess"})


@pytest.mark.parametrize("task, label", [("binary_classification", "y"), ("multiclass_classification", "k"), ("regression", "t")])
def test_neighbours_equal_brute_force(spark, task, label):
    """Distances over numbers, a hashed text and a boolean feature; rows that differ in these alone get their own votes."""
    import numpy as np
    df = table(spark, 700).withColumn("b", F.col("z") > 0.5).withColumn("x", F.when(F.col("key") != "k9", F.col("x")))
    train, held, features = df.where("CAST(substring(key, 2) AS INT) < 500"), df.where("CAST(substring(key, 2) AS INT) >= 480"), ["x", "c", "b"]
    model = md.fit_family(train, features, label, task, "KNN")
    stage = model.stages[0]
    vec = lambda rows: {r["_in"]["key"]: (np.array(r["vec"]), r["_in"][label]) for r in stage.vectors(md._typed(rows, features)).collect()}
    known, asked = vec(train), vec(held)
    x = np.array([v for v, _ in known.values()])
    assert np.isclose(np.std(x[[k != "k9" for k in known], 0]), 1, atol=0.05) and x.shape[1] == 1 + 2 * md.HASHED_SLOTS
    got = md.batch_predict(model, held).collect()
    assert len(got) == 220
    for r in got:
        far = sorted((round(float(np.sqrt(((v - asked[r["key"]][0]) ** 2).sum())), 9), y) for v, y in known.values())
        near = [y for _, y in far[:5]]
        assert far[4][0] < far[5][0]
        if task == "regression":
            assert r["prediction"] == pytest.approx(np.mean(near))
        else:
            assert list(r["probability"]) == pytest.approx([np.mean([str(y) == c for y in near]) for c in model.classes])


def test_training_rows_of_spark_ml_come_in_bounded_parts(spark, monkeypatch):
    """What a task of a fit holds must not grow with the table."""
    monkeypatch.setattr(md, "TASK_ROWS", 50)
    df = table(spark, 400).coalesce(1)
    sizes, seen = [], md._spread
    monkeypatch.setattr(md, "_spread", lambda rows: sizes.append(seen(rows).rdd.glom().map(len).collect()) or seen(rows))
    md.fit_family(df, ["x", "z", "c"], "y", md.BINARY, "LR")
    assert len(sizes) == 1 and sum(sizes[0]) == 400 and max(sizes[0]) <= 60


def test_vectors_of_neighbours_are_made_once(spark, monkeypatch):
    """The index reads its rows several times; they must not be hashed and put together anew each time."""
    plans, seen = [], md.build_regions
    monkeypatch.setattr(md, "build_regions", lambda rows, k: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or seen(rows, k))
    md.fit_family(table(spark, 100), ["x", "c"], "y", md.BINARY, "KNN")
    assert len(plans) == 1 and "FileScan parquet" in plans[0] and "UDF" not in plans[0] and "f_x" not in plans[0]
