"""Extremely randomised trees and the network against plain loops, and on labels that a line cannot follow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_boosting import rows_of
from trialmesh.operators import models as md, network as nw
from trialmesh.operators.random_trees import CODES


def walk(tree, row, coded):
    """The leaf of one row, and the rows' places on the way, step by step."""
    at, way = 0, []
    for level in range(int(math.log2(len(tree["leaf"])))):
        node = (1 << level) - 1 + at
        way.append(node)
        f, v = int(tree["feature"][node]), row[max(int(tree["feature"][node]), 0)]
        if f < 0:
            left = True
        elif coded[f]:
            left = bool(int(tree["mask"][node]) >> int(v) & 1)
        else:
            left = bool(tree["missing"][node]) if not math.isfinite(v) else v <= tree["cut"][node]
        at = 2 * at + (not left)
    return at, way


@pytest.mark.parametrize("label,task", [("t", md.REGRESSION), ("y", md.BINARY), ("k", md.MULTICLASS)])
def test_leaves_hold_what_their_rows_say_and_cuts_lie_between_values(spark, label, task):
    df = rows_of(spark, 120)
    model = md.fit_family(df, ["x", "z", "c"], label, task, "XT", {"numTrees": 3, "maxDepth": 4, "min_rows": 3})
    forest = model.stages[0]
    rows = md._typed(df.withColumn("_label", F.col(label)), ["x", "z", "c"]).select("_in.key", "_label", forest._values().alias("v")).collect()
    want = {r["key"]: 0.0 for r in rows}
    for tree in forest.trees:
        found, passed = {}, {}
        for r in rows:
            leaf, way = walk(tree, r["v"], forest.coded)
            found.setdefault(leaf, []).append(r)
            for node in way:
                passed.setdefault(node, []).append(r["v"])
        for node, values in passed.items():
            f = int(tree["feature"][node])
            known = [v[f] for v in values if math.isfinite(v[f])] if f >= 0 and not forest.coded[f] else []
            assert not known or min(known) <= tree["cut"][node] < max(known)
        for leaf, own in found.items():
            if task == md.REGRESSION:
                value = [sum(r["_label"] for r in own) / len(own)]
            else:
                value = [sum(str(r["_label"]) == c for r in own) / len(own) for c in model.classes]
            assert tree["leaf"][leaf] == pytest.approx(value, abs=1e-9)
            for r in own:
                want[r["key"]] = want[r["key"]] + tree["leaf"][leaf] / 3
    out = {r["key"]: r["prediction"] if task == md.REGRESSION else r["probability"] for r in model.transform(df).collect()}
    assert len(out) == 120 and all(np.allclose(out[k], w, atol=1e-9) for k, w in want.items())
    assert sum(forest.importances().values()) == pytest.approx(1.0)


def test_trees_do_not_depend_on_partitions_or_groups(spark, monkeypatch):
    df = rows_of(spark, 100)
    fit = lambda d: md.fit_family(d, ["x", "c"], "t", md.REGRESSION, "XT", {"numTrees": 4, "maxDepth": 3}).stages[0]
    first, again = fit(df), fit(df.repartition(2, "z"))
    monkeypatch.setattr("trialmesh.operators.random_trees.CELLS", 1)  # a group per tree
    apart = fit(df)
    for other in (again, apart):
        assert all(np.allclose(a["leaf"], b["leaf"]) and np.array_equal(a["feature"], b["feature"]) for a, b in zip(first.trees, other.trees, strict=True))
    assert CODES == 32


def test_gradients_equal_differences_of_the_loss():
    random = np.random.default_rng(5)
    x, codes = random.normal(size=(30, 2)), random.integers(0, nw.CODES, (30, 2))
    for classes, y in ((0, random.normal(size=30)), (3, random.integers(0, 3, 30).astype(float))):
        weights = nw.Network(["a", "b", "c", "d"], ["c", "d"], classes, 5, 1).weights
        got, at = nw._backward(weights, y, x, codes, classes), 0
        assert got[-1] == 30
        for w in weights.values():
            for place in random.integers(0, w.size, 12):
                old, losses = w.flat[place], []
                for step in (1e-6, -1e-6):
                    w.flat[place] = old + step
                    losses.append(nw._backward(weights, y, x, codes, classes)[-2])
                w.flat[place] = old
                assert got[at + place] == pytest.approx((losses[0] - losses[1]) / 2e-6, abs=1e-4)
            at += w.size


def test_summed_gradients_equal_one_pass_over_all_rows(spark):
    df = rows_of(spark, 150)
    model = md.fit_family(df, ["x", "z", "c"], "t", md.REGRESSION, "NN_TORCH", {"maxIter": 1, "batches": 1, "stepSize": 0.0}).stages[0]
    table = md._typed(df.withColumn("_label", F.col("t")), ["x", "z", "c"]).select(((F.col("_label") - model.target[0]) / model.target[1]).alias("y"), *model._inputs())
    gradient, loss, n = model._gradient(table)
    rows = table.collect()
    want = nw._backward(model.weights, np.array([r["y"] for r in rows]), np.array([r["x"] for r in rows]), np.array([r["codes"] for r in rows]), 0)
    assert n == 150 and loss == pytest.approx(want[-2]) and model.losses == pytest.approx([loss / n])
    assert np.allclose(np.concatenate([g.ravel() for g in gradient.values()]), want[:-2])


@pytest.mark.parametrize("family", ["XT", "NN_TORCH"])
def test_labels_no_line_can_follow(spark, family):
    df = rows_of(spark, 600)
    out = md.fit_family(df, ["x", "z", "c"], "y", md.BINARY, family).transform(df)  # x > 0.5, turned around for some c
    assert out.where(F.col("prediction").cast("int") == F.col("y")).count() > 450
    number = md.fit_family(df, ["x", "z", "c"], "t", md.REGRESSION, family)
    error, prior = number.transform(df).where("x is not null and not isnan(z)").agg(F.avg(F.pow(F.col("prediction") - F.col("t"), 2)), F.var_pop("t")).first()
    assert error < 0.3 * prior
    odd = spark.createDataFrame([("new", None, float("inf"), "never seen"), ("none", None, None, None)], "key string, x double, z double, c string")
    assert all(math.isfinite(r["prediction"]) for r in number.transform(odd).collect()) and number.transform(odd.where("false")).count() == 0
    one = md.fit_family(df.where("y = 1").limit(3), ["z"], "t", md.REGRESSION, family)  # fewer rows than shares or cuts
    assert one.transform(df).where("prediction is null").count() == 0
    with pytest.raises(ValueError):
        md.fit_family(df.where("false"), ["x"], "t", md.REGRESSION, family)
