"""Running totals and ranks that stay balanced when one group holds most rows.

A plain ``Window.partitionBy(group)`` sorts each group in one task.  Here each
group is cut into *cells* along its sort key; cell totals are summed on a small
aggregate and added as an offset to the totals inside each cell, so the largest
sort is about one cell, whatever the group sizes are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F


_FRACTIONS = ("float", "double")


def _finite(column: str, kind: str) -> Column:
    """The value where it is finite, else null."""
    value = F.col(column)
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value) if kind in _FRACTIONS else value


def _cut(df: DataFrame, column: str, edges: list, out: str) -> DataFrame:
    """Add ``out``: how many of the increasing ``edges`` are at most the value, compared as doubles; null for null and NaN.

    The cast to double never turns an order around, so cells are ranges of the typed value too.
    """
    splits = [float("-inf"), *sorted({float(e) + 0.0 for e in edges} or {0.0}), float("inf")]
    df = df.withColumn("_double", F.col(column).cast("double") + 0.0)  # -0.0 and 0.0 are equal
    cut = Bucketizer(splits=splits, inputCol="_double", outputCol=out, handleInvalid="keep").transform(df)
    return cut.withColumn(out, F.when(F.col("_double").isNotNull() & ~F.isnan("_double"), F.col(out).cast("int"))).drop("_double")


def _cells(df: DataFrame, cells: int, edges: list, tie_edges: list) -> DataFrame:
    """Add ``_cell`` / ``_sub``, whose order is that of ``_key`` (nulls last) and of ``_tie`` (nulls first).

    In ascending order stand -Infinity, the finite values, Infinity, NaN and null; each of the four is a cell of its
    own.  A finite value that is an edge is a cell between the ranges beside it.  Such a cell holds one value only, so
    its rows may be cut again along the tie: a value that fills several quantiles into as many parts, one of the four
    others into ``cells`` parts.
    """
    kind = dict(df.dtypes)["_key"]
    distinct = {float(e): e for e in sorted(edges)}
    typed, counts = list(distinct.values()), [sum(float(e) == d for e in edges) for d in distinct]
    df = _cut(df, "_key", typed, "_bucket")
    bucket, key = F.col("_bucket"), F.col("_key")
    edge = F.get(F.array(*[F.lit(e).cast(kind) for e in typed]), bucket - 1) if typed else F.lit(None).cast(kind)
    beside = F.when(key < edge, 0).when(key == edge, 1).otherwise(2)
    inner, parts = 3 * bucket + F.when(bucket > 0, beside).otherwise(2), F.lit(1)
    if typed:
        parts = F.when((bucket > 0) & (key == edge), F.get(F.array(*map(F.lit, counts)), bucket - 1)).otherwise(1)
    cell, top = inner, 3 * len(typed) + 3
    if kind in _FRACTIONS:
        special = key.isNull() | F.isnan(key) | (F.abs(key) == float("inf"))
        cell = F.when(key == float("-inf"), -1).when(key == float("inf"), top).when(F.isnan(key), top + 1).otherwise(inner)
    else:
        special = key.isNull()
    df = df.withColumn("_cell", F.when(key.isNull(), top + 2).otherwise(cell).cast("int")).withColumn(
        "_parts", F.when(special, cells).otherwise(parts))
    df = _cut(df, "_tie", tie_edges, "_tb")
    width = len({float(e) for e in tie_edges}) + 2
    sub = F.when(F.col("_tie").isNull(), -1).when(F.col("_tb").isNull(), F.col("_parts")).otherwise(F.floor(F.col("_tb") * F.col("_parts") / width))
    return df.withColumn("_sub", sub.cast("int")).drop("_bucket", "_parts", "_tb")


def running_totals(df: DataFrame, groups: Sequence[str], key: Column, ties: Sequence[Column | str],
                   totals: dict[str, Column], cells: int | None = None) -> DataFrame:
    """Add inclusive running totals per group, ordered by ``key`` ascending (nulls last), then ``ties``.

    Rows are ordered by the values as they are; the casts to double only choose the cells.  ``key`` and the first tie
    must be numeric (NaN and infinities included), and the order must be total.  The number of cells
    (default: the shuffle partitions, at least 8) changes the plan, never the result.  One eager job reads the quantiles.
    """
    cells = cells or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ties = [F.col(t) if isinstance(t, str) else t for t in ties]
    base = df.withColumn("_key", key).withColumn("_tie", ties[0] if ties else F.lit(0))
    for name, value in totals.items():
        base = base.withColumn(f"_v_{name}", value)
    kinds, share = dict(base.dtypes), [i / cells for i in range(1, cells)]
    row = base.agg(*[F.percentile_approx(_finite(c, kinds[c]), share, cells * 20).alias(c) for c in ("_key", "_tie")]).first()
    columns = [F.col(c) for c in df.columns if c not in totals]
    order = [F.col("_key").asc_nulls_last(), *ties]
    base = _cells(base, cells, row["_key"] or [], row["_tie"] or [])
    at = [*groups, "_cell", "_sub"]
    before = W.partitionBy(*groups).orderBy("_cell", "_sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = base.groupBy(*at).agg(*[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in totals])
    offsets = offsets.select(*at, *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals])
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in at]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    joined = base.alias("l").join(offsets.alias("r"), condition).select(
        "l.*", *[F.col(f"r._o_{n}").alias(f"_o_{n}") for n in totals])
    inside = W.partitionBy(*at).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return joined.select(*columns, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in totals])


def rank_rows(df: DataFrame, groups: Sequence[str], key: Column, ties: Sequence[Column | str],
              out: str = "rank", cells: int | None = None) -> DataFrame:
    """``row_number`` per group over ``key`` ascending, nulls last, then ``ties``."""
    return running_totals(df, groups, key, ties, {out: F.lit(1).cast("bigint")}, cells)


def exact_percentile(df: DataFrame, groups: Sequence[str], value: str, q: float, out: str,
                     cells: int | None = None) -> DataFrame:
    """Exact interpolated percentile per group, nulls ignored.

    Counts per distinct value, running counts, then the two values around the wanted
    position: no task has to hold a whole group, unlike the built-in aggregate.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_value")).agg(
        F.count(F.lit(1)).alias("_n"))
    upto = running_totals(counts, groups, F.col("_value"), [], {"_upto": F.col("_n")}, cells)
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    both = upto.join(sizes, list(groups)) if groups else upto.join(F.broadcast(sizes))
    at = (F.col("_all") - 1) * F.lit(float(q))
    ends = both.groupBy(*groups).agg(
        F.min(F.when(F.col("_upto") > F.floor(at), F.col("_value"))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_value"))).alias("_hi"),
        F.first(at - F.floor(at)).alias("_frac"))
    exact = (F.col("_lo") == F.col("_hi")) | (F.col("_frac") == 0)
    between = F.when(F.col("_lo").cast("double") == float("-inf"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    return ends.select(*groups, F.when(exact, F.col("_lo")).otherwise(between).alias(out))


def top_rows(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int = 1,
             out: str | None = None) -> DataFrame:
    """First ``n`` rows per group.

    The filter on ``row_number`` lets Spark keep only ``n`` rows per group and task
    before the shuffle, so a hot group costs ``n`` rows per map task, not its size.
    """
    name = out or "_rn"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col(name) <= n)
    return ranked if out else ranked.drop(name)
