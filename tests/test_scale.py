"""Ranks and totals must not depend on how groups are cut into cells."""

import decimal
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window as W, functions as F

from trialmesh.scale import exact_percentile, rank_rows, running_totals, top_rows

@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(3000):
        group = "hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}"
        score = None if rng.random() < 0.05 else rng.choice([0.1, 0.1, 0.1, 0.5, round(rng.random(), 3), -1.0])
        out.append((group, score, i, rng.randrange(10)))
    return out

def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, s double, i bigint, v bigint")

@pytest.mark.parametrize("cells", [2, 8, 37])
def test_rank_rows_cells_equal_sort(spark, rows, cells):
    got = {r["i"]: r["rank"] for r in rank_rows(frame(spark, rows), ["g"], -F.col("s"), ["i"], cells=cells).collect()}
    groups = defaultdict(list)
    for g, s, i, _ in rows:
        groups[g].append((s is None, -(s or 0), i))
    want = {i: n for members in groups.values() for n, (_, _, i) in enumerate(sorted(members), 1)}
    assert got == want

def test_cells_split_a_hot_value(spark):
    df = spark.range(4000).select(F.lit("one").alias("g"), F.lit(0.5).alias("s"), F.col("id").alias("i"))
    ranked = rank_rows(df, ["g"], F.col("s"), ["i"], cells=16)
    assert ranked.where(F.col("rank") != F.col("i") + 1).count() == 0
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "_sub" in plan

def test_global_totals_equal_a_plain_window(spark, rows):
    df = frame(spark, rows)
    got = {(r["i"]): r["t"] for r in running_totals(df, [], F.col("s"), ["i"], {"t": F.col("v")}, cells=8).collect()}
    plain = F.sum("v").over(W.orderBy(F.col("s").asc_nulls_last(), "i").rowsBetween(W.unboundedPreceding, 0))
    assert got == {r["i"]: r["t"] for r in df.select("i", plain.alias("t")).collect()}

HUGE = 2 ** 53
KEYS = {
    "double": [float("nan"), float("inf"), float("-inf"), None, -0.0, 0.0, 1.5, 1e308, -1e-300],
    "float": [float("nan"), float("inf"), float("-inf"), None, 0.25, 3.0],
    "bigint": [HUGE + i for i in range(9)] + [None, -HUGE - 1, -HUGE, 2 ** 63 - 1, -2 ** 63, 0],
    "decimal(38,18)": [decimal.Decimal(f"9007199254740993.{i:018d}") for i in range(5)] + [None, decimal.Decimal("-0.000000000000000001")],
}

@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("hot", [False, True])
def test_every_value_ranks_as_in_a_plain_window(spark, kind, hot):
    rng = random.Random(kind)
    values = KEYS[kind]
    data = [(rng.choice("ab"), values[0] if hot and rng.random() < 0.7 else rng.choice(values), HUGE + i if rng.random() < 0.9 else -i) for i in range(900)]
    df = spark.createDataFrame(data, f"g string, s {kind}, i bigint").repartition(3)
    plain = df.select("i", F.row_number().over(W.partitionBy("g").orderBy(F.col("s").asc_nulls_last(), "i")).alias("n"))
    want = {r["i"]: r["n"] for r in plain.collect()}
    for cells in (8, 37, 200):
        assert {r["i"]: r["rank"] for r in rank_rows(df, ["g"], F.col("s"), ["i"], cells=cells).collect()} == want, cells

@pytest.mark.parametrize("value", [float("nan"), float("inf"), None])
def test_one_odd_value_alone(spark, value):
    df = spark.createDataFrame([("a", value, i) for i in range(50)], "g string, s double, i bigint")
    assert {r["i"]: r["rank"] for r in rank_rows(df, ["g"], F.col("s"), ["i"], cells=8).collect()} == {i: i + 1 for i in range(50)}

@pytest.mark.parametrize("q", [0.25, 0.5, 0.99])
def test_percentile_of_odd_values(spark, q):
    values = [float("nan")] * 3 + [float("inf")] * 4 + [float("-inf")] * 2 + [1.0, 2.0, None, 5.0]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    got = exact_percentile(df, [], "s", q, "p", cells=8).first()["p"]
    want = df.agg(F.percentile("s", F.lit(q))).first()[0]
    assert got == want or (math.isnan(got) and math.isnan(want))

@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile(spark, rows, q):
    df = frame(spark, rows)
    got = {r["g"]: r["p"] for r in exact_percentile(df, ["g"], "s", q, "p", cells=8).collect()}
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.percentile("s", F.lit(q)).alias("p")).collect()}
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)

def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, s double, i bigint, v bigint")
    assert rank_rows(df, ["g"], F.col("s"), ["i"]).count() == 0

def test_top_rows_limits_before_the_shuffle(spark, rows):
    df = top_rows(frame(spark, rows), ["g"], [F.col("s").desc(), F.col("i")], 2)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.groupBy("g").count().where("count > 2").count() == 0
