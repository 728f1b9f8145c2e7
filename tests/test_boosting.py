"""Boosted trees against plain loops over small rows, and importances by permutation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmesh.operators import models as md
from trialmesh.operators.boosting import Boosted


def rows_of(spark, n, seed=1):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        x, z, c = draw.random(), draw.random(), draw.choice("abcdefgh")
        y = (x > 0.5) != (c in "abc")
        rows.append((f"k{i}", None if i % 11 == 0 else x, z if i % 7 else float("nan"), c if i % 13 else None, int(y), "high" if x > 0.7 else "low" if x < 0.3 else "mid", 3 * x + z + (c in "ab")))
    return spark.createDataFrame(rows, "key string, x double, z double, c string, y int, k string, t double").repartition(5)


def brute_trees(rows, edges, rounds, depth, rate, l2, symmetric):
    """Predictions of boosted trees for the squared error, found by trying every split of every node."""
    known = lambda v: v is not None and not math.isnan(v)
    bins = [[1 + sum(e < v for e in edges[c]) if known(v) else 0 for c, v in zip(sorted(edges), r[:-1], strict=True)] for r in rows]
    y = [r[-1] for r in rows]
    score = [sum(y) / len(y)] * len(y)
    options = [(f, cut, miss) for f in range(len(edges)) for cut in range(33) for miss in (False, True)]
    for _ in range(rounds):
        groups = [list(range(len(y)))]
        worth = lambda g: sum(score[i] - y[i] for i in g) ** 2 / (len(g) + l2)

        def sides(group, split):
            f, cut, miss = split
            left = [i for i in group if (miss if bins[i][f] == 0 else bins[i][f] <= cut)]
            return left, [i for i in group if i not in set(left)]

        def gain(group, split):
            left, right = sides(group, split)
            return round(worth(left) + worth(right) - worth(group), 9) if left and right else 0.0
        for _ in range(depth):
            after, common = [], max(options, key=lambda o: sum(gain(g, o) for g in groups)) if symmetric else None
            for group in groups:
                split = common or max(options, key=lambda o: gain(group, o))
                after += sides(group, split) if symmetric or gain(group, split) > 0 else (group, [])
            groups = after
        change = {i: -rate * sum(score[j] - y[j] for j in g) / (len(g) + l2) for g in groups for i in g}
        score = [s + change[i] for i, s in enumerate(score)]
    return score


@pytest.mark.parametrize("symmetric", [False, True])
def test_trees_equal_plain_loops(spark, symmetric):
    df = rows_of(spark, 90)
    params = {"maxIter": 2, "maxDepth": 2, "stepSize": 0.5, "l2": 1.0, "patience": 0, "symmetric": symmetric}
    model = md.fit_family(df, ["x", "z"], "t", md.REGRESSION, "XGB", params)
    got = {r["key"]: r["prediction"] for r in model.transform(df).collect()}
    rows = df.collect()
    want = brute_trees([(r["x"], r["z"], r["t"]) for r in rows], model.stages[0].edges, 2, 2, 0.5, 1.0, symmetric)
    assert len(got) == 90 and all(got[r["key"]] == pytest.approx(w, abs=1e-9) for r, w in zip(rows, want, strict=True))


def test_ordered_statistics_do_not_see_their_own_label(spark):
    df = rows_of(spark, 200).withColumn("_label", F.col("y").cast("double")).select("_label", F.coalesce("c", F.lit("<missing>")).alias("f_c"), F.col("z").alias("f_z"))
    model = Boosted(["c", "z"], ["c"], 2, True)
    model.priors = [0.5]
    rows = model._learn_statistics(df, 7).withColumn("at", F.xxhash64("f_c", "f_z", "_label", F.lit(7))).collect()
    total, count = {}, {}
    for r in sorted(rows, key=lambda r: r["at"]):
        c = r["f_c"]
        assert r["s_c_0"] == pytest.approx((total.get(c, 0.0) + 0.5) / (count.get(c, 0) + 1))
        total[c], count[c] = total.get(c, 0.0) + r["_label"], count.get(c, 0) + 1
    kept = {r["f_c"]: r["s_c_0"] for r in model.statistics["c"].collect()}
    assert kept == pytest.approx({c: (total[c] + 0.5) / (count[c] + 1) for c in total})


@pytest.mark.parametrize("family", ["GBM", "CAT"])
def test_classes_text_and_unknown_values(spark, family):
    df = rows_of(spark, 600)
    model = md.fit_family(df, ["x", "z", "c"], "y", md.BINARY, family)
    out = model.transform(df)
    assert out.where(F.col("prediction").cast("int") == F.col("y")).count() > 480
    many = md.fit_family(df, ["x", "z"], "k", md.MULTICLASS, family, {"maxIter": 5}).transform(df)
    assert many.where("prediction = k").count() > 480 and many.where("abs(aggregate(probability, 0D, (a, p) -> a + p) - 1) > 1e-9").count() == 0
    shares = {r["feature"]: r["importance"] for r in md.feature_importance(model).collect()}
    assert sum(shares.values()) == pytest.approx(1.0) and shares["z"] < min(shares["x"], shares["c"])
    odd = spark.createDataFrame([("new", None, None, "never seen"), ("none", None, None, None)], "key string, x double, z double, c string")
    assert {len(r["probability"]) for r in model.transform(odd).collect()} == {2} and model.transform(odd.where("false")).count() == 0
    with pytest.raises(ValueError):
        md.fit_family(df.where("false"), ["x"], "t", md.REGRESSION, family)


def test_stops_early_on_noise_and_on_time(spark):
    noise = rows_of(spark, 300).withColumn("y", (F.xxhash64("key") % 2 == 0).cast("int"))
    stopped = md.fit_family(noise, ["x", "z"], "y", md.BINARY, "XGB", {"maxIter": 12, "patience": 2, "stepSize": 1.0}).stages[0]
    assert len(stopped.trees) < 12 and len(stopped.trees) == max(1, stopped.losses.index(min(stopped.losses)))
    assert len(md.fit_family(noise, ["x"], "y", md.BINARY, "GBM", {"seconds": 0}).stages[0].trees) == 1


def test_permuted_features_lose_what_they_tell(spark):
    df = rows_of(spark, 400)
    for family, label, task in (("LR", "t", md.REGRESSION), ("KNN", "k", md.MULTICLASS)):
        model = md.fit_family(df.where("x is not null and not isnan(z)"), ["x", "z"], label, task, family)
        ranked = md.permutation_importance(model, df.where("x is not null and not isnan(z)"), label, "key").orderBy("rank").collect()
        assert [r["feature"] for r in ranked] == ["x", "z"] and ranked[0]["importance"] > 2 * abs(ranked[1]["importance"])
    same = md.permutation_importance(model, df.where("x is not null and not isnan(z)"), "k", "key").collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, ranked))
    constant = df.where("x is not null").withColumn("z", F.lit(1.0))
    still = md.permutation_importance(md.fit_family(constant, ["x", "z"], "t", md.REGRESSION, "LR"), constant, "t", "key")
    assert still.where("feature = 'z'").first()["importance"] == pytest.approx(0.0, abs=1e-12)
    assert md.permutation_importance(model, df.where("false"), "k", "key").count() == 0


def test_values_move_along_one_order_cut_into_ranges(spark, monkeypatch):
    df = rows_of(spark, 300).where("x is not null and not isnan(z)").select("key", "x", "z", "t")
    model = md.fit_family(df, ["x", "z"], "t", md.REGRESSION, "LR")
    rows = sorted(df.withColumn("at", F.xxhash64(F.lit(42), "key")).collect(), key=lambda r: r["at"] % (1 << 64))
    copies = [(None, r["t"], r["x"], r["z"]) for r in rows]
    for before, r in zip([rows[-1], *rows], rows):
        copies += [("x", r["t"], before["x"], r["z"]), ("z", r["t"], r["x"], before["z"])]
    scored = model.transform(spark.createDataFrame(copies, "changed string, t double, x double, z double"))
    loss = {r["changed"]: r["loss"] for r in scored.groupBy("changed").agg(F.avg(F.pow(F.col("prediction") - F.col("t"), 2)).alias("loss")).collect()}
    for size in (100_000, 5):
        monkeypatch.setattr(md, "RANGE_ROWS", size)
        got = {r["feature"]: r["importance"] for r in md.permutation_importance(model, df, "t", "key").collect()}
        assert got == {c: pytest.approx(loss[c] - loss[None], abs=1e-9) for c in ("x", "z")}


def test_models_fitted_together_share_their_passes(spark, monkeypatch):
    """Folds of several families take as many passes as the longest of them, and are what they are alone."""
    from trialmesh.operators import boosting, random_trees
    draw = np.random.default_rng(3)
    rows = [(i, i % 2, float(draw.normal()), float(draw.integers(0, 5)), "abc"[draw.integers(0, 3)]) for i in range(240)]
    df = spark.createDataFrame([(i, f, x, z, c, int(x + z * 0.3 + (c == "a") > 0.8)) for i, f, x, z, c in rows], "i long, fold long, x double, z double, c string, y int").coalesce(1)
    params = {"GBM": {"maxIter": 2, "maxDepth": 3}, "CAT": {"maxIter": 2, "maxDepth": 2}, "XT": {"numTrees": 3, "maxDepth": 3}}
    jobs = [(df.where(F.col("fold") != i), family, params[family]) for family in params for i in (0, 1)]
    passes = {"boosted": 0, "random": 0}
    for module, name, kind in ((boosting, "_level_sums", "boosted"), (random_trees, "_pass", "random")):
        seen = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, seen=seen, kind=kind: passes.__setitem__(kind, passes[kind] + 1) or seen(*a))
    together = md.fit_together(jobs, ["x", "z", "c"], "y", md.BINARY)
    assert [m.family for m in together] == ["GBM", "GBM", "CAT", "CAT", "XT", "XT"]
    assert passes == {"boosted": 6, "random": 6}
    for (train, family, options), model in zip(jobs, together, strict=True):
        alone = md.fit_family(train, ["x", "z", "c"], "y", md.BINARY, family, options)
        got, want = ({r["i"]: r["probability"] for r in m.transform(df).select("i", "probability").collect()} for m in (model, alone))
        assert len(got) == 240 and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_scores_of_many_models_are_written_in_short_plans(spark):
    """A round whose models were all chained in one plan did not finish planning."""
    draw = np.random.default_rng(4)
    df = spark.createDataFrame([(str(i), int(x > 0), x) for i, x in enumerate(draw.normal(size=120).tolist())], "key string, y int, x double").coalesce(1)
    split = df.selectExpr("*", "CASE WHEN key % 3 = 0 THEN 'validation' WHEN key % 3 = 1 THEN 'holdout' ELSE 'fit' END AS side")
    scores = md._Scores(split, ["x"], "y", md.BINARY, "key", {f: {"maxIter": 1, "maxDepth": 1} for f in ("GBM", "CAT")})
    scores.add([("GBM", 0), ("no such family", 0), ("CAT", 2), ("GBM", 2)])
    assert set(scores.known) == {("GBM", 0), ("CAT", 2), ("GBM", 2)} and set(scores.failed) == {("no such family", 0)}
    assert scores.rows(["CAT", "GBM"], 2).where("CAT IS NOT NULL AND GBM IS NOT NULL").count() == 80
    with pytest.raises(ValueError):
        scores.rows(["no such family"], 0)


def test_weights_leave_out_rows_without_a_value(spark):
    rows = [(1, 0.9, 0.2), (0, 0.1, None), (1, 0.8, 0.9), (None, 0.0, 1.0), (0, 0.3, 0.4), (1, None, 0.6), (0, float("nan"), 0.5)]
    df = spark.createDataFrame(rows, "y int, a double, b double")

    def loss(used):
        q = [1 - 1e-15 if np.isnan(p) else min(max(p, 1e-15), 1 - 1e-15) for _, p in used]
        return -np.mean([y * np.log(p) + (1 - y) * np.log(1 - p) for (y, _), p in zip(used, q, strict=True)])
    taken, best, weights = {"a": 0, "b": 0}, None, None
    for step in range(1, 5):
        found = {}
        for m in taken:
            now = taken | {m: taken[m] + 1}
            used = [(y, sum(n * v for n, v in ((now["a"], a), (now["b"], b)) if n) / step) for y, a, b in rows if y is not None and not (now["a"] and a is None) and not (now["b"] and b is None)]
            found[m] = round(loss(used), 12)
        pick = min(taken, key=lambda m: (found[m], m))
        taken[pick] += 1
        if best is None or found[pick] < best:
            best, weights = found[pick], {m: n / step for m, n in taken.items()}
    assert md.weighted_ensemble(df, ["a", "b"], "y", steps=4) == weights
