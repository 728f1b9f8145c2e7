"""Inverted-file index over vectors: cells around centres, probed from the nearest on, exact by the triangle inequality.

Centres are fitted on a bounded sample; every vector is assigned to the nearest one and stored with its cell, and a
cell's radius is the largest distance to its centre.  A query first reads its nearest cells.  What it finds there bounds
the distance of its k-th neighbour, and a cell whose centre is farther away than that bound and the radius together
cannot hold a nearer one.  All other cells are read in the second round, so results are exact; how many cells are
skipped depends on how far the vectors form groups.  With a ``share`` of the vectors to read there is no second round.

Vectors of few dimensions go by regions instead (``build_regions``): half spaces cut one after the other, so that a query
finds the regions within its bound by walking down the cuts, and inside a region by the boxes of small blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.scale import top_rows
from trialmesh.session import materialize, scratch

register_pickle_by_value(sys.modules[__name__])
SAMPLE, MOST_CELLS, BLOCK_ROWS, QUERY_ROWS = 20_000, 1024, 20_000, 2048
REGION_ROWS, MOST_REGIONS, REGION_QUERIES, SMALL_BLOCK, SMALL_GROUP = 50_000, 4096, 50_000, 256, 4096
SLICE_ROWS, MOST_PARTITIONS, MOST_PAIRS, PAIR_ROWS = 100_000, 4000, 1 << 20, 1 << 16


@dataclass
class CellIndex:
    """``table``: key, vec, payload, cell; per cell its centre, number of vectors and radius."""

    table: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray


def _matrix(column) -> np.ndarray:
    values = column.tolist()
    if values and isinstance(values[0], bytes):
        return np.frombuffer(b"".join(values), "float64").reshape(len(values), -1)
    return np.asarray(values, dtype="float64")


def _far(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices, up to the rounding of sums of squares."""
    return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * q @ v.T, 0.0))


def fit_centres(sample: np.ndarray, cells: int, seed: int = 42, rounds: int = 10) -> np.ndarray:
    """Means of ``cells`` groups of the sample, moved ``rounds`` times from rows drawn by the seed."""
    found = np.unique(sample, axis=0)
    found = found[np.random.default_rng(seed).permutation(len(found))[:cells]]
    for _ in range(rounds):
        near = np.concatenate([_far(sample[i:i + 4096], found).argmin(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(found))[:, None]
        found = np.where(n > 0, sums / np.maximum(n, 1), found)
    return found


def build_index(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> CellIndex | None:
    """Index of ``vectors`` (key long, vec array<double>, payload double); None for an empty table.  Eager.

    About ``sample`` rows, chosen by the hash of the key, are read to the driver to fit the centres (the stated
    bound); all rows are assigned, in Arrow batches, and written.  ``cells`` is by default the root of the rows,
    ``MOST_CELLS`` at most.  Null vectors are left out.
    """
    rows = vectors.where("vec IS NOT NULL").select("key", "vec", "payload")
    total = rows.count()
    if not total:
        return None
    some = rows if total <= sample else rows.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 30)) < sample / total * (1 << 30))
    picked = _matrix(some.select("vec").limit(2 * sample).toPandas()["vec"])
    if not len(picked):
        picked = _matrix(rows.select("vec").limit(1).toPandas()["vec"])
    centres = fit_centres(picked, cells or max(1, min(MOST_CELLS, round(total ** 0.5))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = _matrix(batch["vec"])
                near = _far(v, centres).argmin(axis=1)
                yield batch.assign(cell=near.astype("int32"), away=np.sqrt(((v - centres[near]) ** 2).sum(axis=1)))
    table = materialize(rows.mapInPandas(assign, "key long, vec array<double>, payload double, cell int, away double"), "cells")
    sizes, radii = np.zeros(len(centres), "int64"), np.zeros(len(centres))
    for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # MOST_CELLS rows at most
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    return CellIndex(table, centres, sizes, radii)


def _nearest(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block of vectors for each query of a block, equal ones at the edge by key."""
    qids, found = [], [(np.empty(0, "int64"), np.empty(0), np.empty(0))]
    if len(left) and len(right):
        v, keys, payload = _matrix(right["vec"]), right["key"].to_numpy(), right["payload"].to_numpy(dtype="float64")
        for at in range(0, len(left), 256):
            q = _matrix(left["vec"].iloc[at:at + 256])
            rough = _far(q, v)
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(v) > k else np.full(len(q), np.inf)
            for i, qid in enumerate(left["qid"].iloc[at:at + 256]):
                near = np.flatnonzero(rough[i] <= edge[i] + 1e-6 * (1 + np.abs(q[i]).max()))  # rounding never decides
                far = np.round(np.sqrt(((v[near] - q[i]) ** 2).sum(axis=1)), 9)
                order = np.lexsort((keys[near], far))[:k]
                qids += [qid] * len(order)
                found.append((keys[near[order]], payload[near[order]], far[order]))
    return pd.DataFrame({"qid": qids} | {name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("key", "payload", "distance"))})


def _probed(queries: DataFrame, index: CellIndex, cells: Column | str, k: int) -> DataFrame:
    """The nearest rows that queries (qid, vec, and the list ``cells``) find in their cells.

    Cells meet queries in blocks: a large cell is cut by the hash of its keys, and the queries of a much wanted one by
    theirs, so a group is bounded in rows on both sides.
    """
    asked = queries.select("qid", "vec", F.explode(cells).alias("cell"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("qparts"))
    sizes = queries.sparkSession.createDataFrame([(i, int(-(-n // BLOCK_ROWS))) for i, n in enumerate(index.sizes.tolist()) if n], "cell int, parts int")
    blocks = F.broadcast(wanted.join(F.broadcast(sizes), "cell"))  # a row per cell
    left = asked.join(blocks, "cell").withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = index.table.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn(
        "qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    block = F.concat_ws("/", "cell", "part", "qpart").alias("block")
    left, right = left.select(block, "qid", "vec"), right.select(block, "key", "vec", "payload")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(
        lambda a, b: _nearest(a, b, k), "qid long, key long, payload double, distance double")


def search(index: CellIndex | None, queries: DataFrame, k: int, share: float | None = None) -> DataFrame:
    """qid, key, payload, distance, rank of the ``k`` nearest rows of each query (qid long, vec array<double>).

    Exact without ``share``, also in ties, which go by key.  With ``share`` each query reads its nearest cells until
    they hold that part of the vectors, at least ``k`` of them.  Null vectors find nothing.  Eager: the first round's
    result is written, because it bounds the second.
    """
    spark, kind = queries.sparkSession, "qid long, key long, payload double, distance double, rank int"
    if index is None:
        return spark.createDataFrame([], kind)
    rows, total = queries.where("vec IS NOT NULL").select("qid", "vec"), int(index.sizes.sum())
    least = max(k, int(np.ceil(total * share))) if share is not None else min(total, max(4 * k, total // max(1, len(index.sizes))))
    centres, sizes, radii = index.centres, index.sizes, index.radii

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                order = np.argsort(_far(_matrix(batch["vec"]), centres), axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
                yield batch.assign(cells=[o[:n].tolist() for o, n in zip(order, enough, strict=True)])
    planned = rows.mapInPandas(first, "qid long, vec array<double>, cells array<int>")
    order = [F.col("distance"), F.col("key"), F.col("payload")]
    near = top_rows(_probed(planned, index, "cells", k), ["qid"], order, k, "rank")
    if share is not None:
        return near.select("qid", "key", "payload", "distance", "rank")
    near = materialize(near, "near")
    bounds = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    bounds = bounds.select("qid", F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far, bound = _far(_matrix(batch["vec"]), centres), batch["bound"].to_numpy()[:, None]
                reach = (far - radii <= bound + 1e-6 * (1 + far)) & (sizes > 0)
                cells = [sorted(set(np.flatnonzero(r).tolist()) - set(c)) for r, c in zip(reach, batch["cells"], strict=True)]
                yield pd.DataFrame({"qid": batch["qid"], "vec": batch["vec"], "cells": cells})
    rest = planned.join(bounds, "qid").mapInPandas(others, "qid long, vec array<double>, cells array<int>").where("size(cells) > 0")
    found = _probed(rest, index, "cells", k).unionByName(near.select("qid", "key", "payload", "distance"))
    return top_rows(found, ["qid"], order, k, "rank").select("qid", "key", "payload", "distance", "rank")


@dataclass
class RegionIndex:
    """``table``: key, vec (compact, as bytes), payload, cell; the tree of cuts (dim, value, left, right) or places of
    regions; vectors per region; the smallest and largest value by dimension."""

    table: DataFrame
    tree: tuple
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def compact(self, v: np.ndarray) -> np.ndarray:
        """The dimensions in which the indexed vectors differ, and one for the distance along all others: distances stay."""
        differ = self.high > self.low
        beside = np.sqrt(((v[:, ~differ] - self.low[~differ]) ** 2).sum(axis=1))
        return np.ascontiguousarray(np.column_stack([v[:, differ], beside]))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Arrow batches put together to some ``SLICE_ROWS`` rows, and the matrix of their vectors (lists, or bytes)."""
    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(kept).combine_chunks()
        vec = table.column("vec").chunk(0)
        if pa.types.is_binary(vec.type):
            return table, np.frombuffer(b"".join(vec.to_pylist()), "float64").reshape(len(vec), -1)
        return table, vec.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False).reshape(len(vec), -1)
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= SLICE_ROWS:
                yield joined()
                kept = []
    if kept:
        yield joined()


def _binary(v: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * v.shape[1]), len(v), [None, pa.py_buffer(np.ascontiguousarray(v).tobytes())])
    return fixed.cast(pa.binary())


def _cut_regions(sample: np.ndarray, regions: int) -> tuple[tuple, int]:
    """Cuts the sample at the middle of its widest dimension until it is in about ``regions`` parts."""
    count = 0

    def cut(rows: np.ndarray, parts: int) -> tuple:
        nonlocal count
        if parts > 1 and len(rows) > 1:
            dim = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            ordered = np.unique(rows[:, dim])
            if len(ordered) > 1:
                value = min(max(float(np.median(rows[:, dim])), ordered[0]), ordered[-2])
                below = rows[:, dim] <= value
                share = min(max(round(parts * below.mean()), 1), parts - 1)
                return dim, value, cut(rows[below], share), cut(rows[~below], parts - share)
        count += 1
        return (count - 1,)
    return cut(sample, regions), count


def _walk(tree: tuple, v: np.ndarray, bound: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Rows and region: of each row its own, or with ``bound`` every one that is not farther away than that."""
    def own(node: tuple, rows: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        if len(node) == 1:
            yield rows, node[0]
            return
        right = v[rows, node[0]] > node[1]
        for side, kept in ((node[2], rows[~right]), (node[3], rows[right])):
            if len(kept):
                yield from own(side, kept)

    def down(node: tuple, rows: np.ndarray, far: np.ndarray, gaps: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int]]:
        if len(node) == 1:
            yield rows, node[0]
            return
        dim, value, below, above = node
        right = v[rows, dim] > value
        gap = np.abs(v[rows, dim] - value)
        old = gaps.get(dim, np.zeros(len(rows)))
        for side, inside in ((below, ~right), (above, right)):
            now = np.where(inside, old, gap)
            reached = far - old ** 2 + now ** 2
            kept = reached <= bound[rows] ** 2
            if kept.any():
                yield from down(side, rows[kept], reached[kept], {d: g[kept] for d, g in gaps.items()} | {dim: now[kept]})
    if len(v):
        every = np.arange(len(v))
        yield from own(tree, every) if bound is None else down(tree, every, np.zeros(len(v)), {})


def _own_cells(tree: tuple, v: np.ndarray) -> np.ndarray:
    cell = np.zeros(len(v), "int32")
    for at, region in _walk(tree, v):
        cell[at] = region
    return cell


def build_regions(vectors: DataFrame, k: int) -> RegionIndex | None:
    """Index of ``vectors`` (key long, vec array<double>, payload double) for searches of up to ``k`` rows; None for an empty table.  Eager.

    Of equal vectors only the ``k`` rows of smallest key can be among the ``k`` nearest of any query, so no more are
    kept.  The cuts come from a sample of about 20 vectors a region by their hash, ``40 * MOST_REGIONS`` at most
    (the stated bound); all rows are assigned, without the dimensions in which none differ, and written.
    """
    rows = vectors.where("vec IS NOT NULL").select("key", "vec", "payload")

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(v.shape[1])), pa.array(v.min(axis=0)), pa.array(v.max(axis=0)),
                                              pa.array(np.full(v.shape[1], len(v)))], ["dim", "low", "high", "n"])
    limits = rows.select("vec").mapInArrow(extent, "dim long, low double, high double, n long").groupBy("dim").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("dim").collect()  # a row per dimension
    if not limits:
        return None
    index, total = RegionIndex(vectors, (0,), np.zeros(1), np.array([r["low"] for r in limits]), np.array([r["high"] for r in limits])), limits[0]["n"]
    regions = max(1, min(MOST_REGIONS, -(-total // REGION_ROWS)))
    wanted = 20 * regions
    some = rows if total <= wanted else rows.where(F.pmod(F.xxhash64("vec", F.lit(3)), F.lit(1 << 30)) < wanted / total * (1 << 30))
    picked = some.select("vec").distinct().limit(2 * wanted).toPandas()["vec"]
    if len(picked):
        index.tree, regions = _cut_regions(index.compact(_matrix(picked)), regions)
    else:
        regions = 1

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, v in _slices(batches):
            v = compact(v)
            yield pa.RecordBatch.from_arrays([table["key"].chunk(0), _binary(v), table["payload"].chunk(0), pa.array(_own_cells(tree, v))], ["key", "vec", "payload", "cell"])
    tree, compact = index.tree, RegionIndex(None, index.tree, index.sizes, index.low, index.high).compact
    placed = rows.mapInArrow(assign, "key long, vec binary, payload double, cell int").withColumn("_h", F.xxhash64("vec"))
    apart = top_rows(placed, ["_h", "vec"], [F.col("key"), F.col("payload")], k)  # a number first: sorted without looking into the bytes
    index.table, index.sizes = materialize(apart.drop("_h"), "regions"), np.zeros(regions, "int64")
    for r in index.table.groupBy("cell").count().collect():  # MOST_REGIONS rows at most
        index.sizes[r["cell"]] = r["count"]
    return index


def _small_blocks(v: np.ndarray, most: int) -> tuple[tuple, list[np.ndarray]]:
    """Places of the rows in blocks of at most ``most``, cut at the middle of the widest dimension, and the tree of the cuts."""
    found: list[np.ndarray] = []

    def cut(rows: np.ndarray) -> tuple:
        if len(rows) <= most:
            found.append(rows)
            return (len(found) - 1,)
        part = v[rows]
        dim = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, dim], len(rows) // 2)
        below, above = order[:len(rows) // 2], order[len(rows) // 2:]
        return dim, float(part[below, dim].max()), cut(rows[below]), cut(rows[above])  # rows at the value may lie on both sides
    return cut(np.arange(len(v))), found


def _nearest_by_boxes(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """What ``_nearest`` gives, of the rows not farther than the ``bound`` of a query that has one.

    Rows lie in small blocks, found down the tree of their cuts.  A block meets all queries that reach it at once.  A query
    without a bound takes its k-th distance from its own block and those within half of what it finds there; then
    every query reads the blocks whose boxes lie within its bound.
    """
    found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0), np.empty(0))]
    if len(left) and len(right):
        every = _matrix(right["vec"])
        tree, blocks = _small_blocks(every, max(SMALL_BLOCK, 2 * k))
        order, ends = np.concatenate(blocks), np.cumsum([len(b) for b in blocks])
        starts = ends - [len(b) for b in blocks]
        v, keys, payload = every[order], right["key"].to_numpy()[order], right["payload"].to_numpy(dtype="float64")[order]
        low, high = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
        asked, qids = _matrix(left["vec"]), left["qid"].to_numpy()
        edge = left["bound"].to_numpy(dtype="float64").copy() if "bound" in left else np.full(len(left), np.inf)

        def reached(bound: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
            """Some queries, a block whose box is not farther than their bound, and their distances to its rows."""
            for rows, block in _walk(tree, asked, bound):
                part = asked[rows]
                away = (np.maximum(np.maximum(low[block] - part, part - high[block]), 0.0) ** 2).sum(axis=1)
                yield from compared(rows[away <= bound[rows] ** 2], block)

        def compared(rows: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
            for first in range(0, len(rows), SMALL_GROUP):
                some = rows[first:first + SMALL_GROUP]
                yield some, block, _far(asked[some], v[starts[block]:ends[block]])

        def nearest(pairs: list[tuple]) -> list[tuple]:
            """The first ``k`` of each query among the pairs so far."""
            i, near, far = (np.concatenate([p[n] for p in pairs]) for n in range(3))
            sort = np.lexsort((payload[near], keys[near], far, i))
            i, near, far = i[sort], near[sort], far[sort]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            return [(i[kept], near[kept], far[kept])]
        free = np.flatnonzero(~np.isfinite(edge))
        if len(free):
            best, own = np.full((len(asked), k), np.inf), np.full(len(asked), -1)
            for at, block in _walk(tree, asked[free]):
                own[free[at]] = block
                for rows, _, far in compared(free[at], block):
                    best[rows] = _smallest(best[rows], far)
            half = best.max(axis=1) / 2
            known = np.flatnonzero(np.isfinite(half))  # blocks of fewer than k rows are all there is
            if len(known):
                bound = np.full(len(asked), np.nan)  # no block is within it
                bound[known] = half[known]
                for rows, block, far in reached(bound):
                    new = own[rows] != block
                    best[rows[new]] = _smallest(best[rows[new]], far[new])
            edge[free] = best[free].max(axis=1)
        edge = edge + 1e-6 * (1 + np.abs(asked).max(axis=1))  # rounding never decides
        pairs, held = [], 0
        for rows, block, far in reached(edge):
            i, j = np.nonzero(far <= edge[rows][:, None])
            i, near = rows[i], starts[block] + j
            far = [np.sqrt(((v[near[n:n + PAIR_ROWS]] - asked[i[n:n + PAIR_ROWS]]) ** 2).sum(axis=1)) for n in range(0, len(i), PAIR_ROWS)]
            if far:
                pairs.append((i, near, np.round(np.concatenate(far), 9)))
                held += len(i)
            if held > MOST_PAIRS:
                pairs = nearest(pairs)
                held = 0
        if pairs:
            (i, near, far), = nearest(pairs)
            found.append((qids[i], keys[near], payload[near], far))
    return pd.DataFrame({name: np.concatenate([f[i] for f in found]) for i, name in enumerate(("qid", "key", "payload", "distance"))})


def _smallest(best: np.ndarray, far: np.ndarray) -> np.ndarray:
    """As many of the smallest values of each row of both as the first has columns."""
    both = np.hstack([best, far])
    return np.partition(both, best.shape[1] - 1, axis=1)[:, :best.shape[1]]


def _met(asked: DataFrame, index: RegionIndex, k: int) -> DataFrame:
    """What queries (qid, vec, cell, perhaps bound) find in the regions named, in blocks bounded in rows on both sides.

    Regions are spread over as many partitions as there are blocks: their work is large against their bytes.
    """
    parts = [max(1, -(-n // (REGION_ROWS * 4))) for n in index.sizes.tolist()]
    sizes = asked.sparkSession.createDataFrame([(i, p) for i, (p, n) in enumerate(zip(parts, index.sizes, strict=True)) if n], "cell int, parts int")
    wanted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / REGION_QUERIES).cast("int").alias("qparts"))
    blocks, at = F.broadcast(wanted.join(F.broadcast(sizes), "cell")), ["cell", "part", "qpart"]  # a row per cell
    left = asked.join(blocks, "cell").withColumn("qpart", F.pmod(F.xxhash64("qid"), F.col("qparts"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = index.table.join(blocks, "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn(
        "qpart", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)))
    left, right = left.select(*at, *asked.columns[:2], *asked.columns[3:]), right.select(*at, "key", "vec", "payload")
    left = left.withColumn("qpart", F.col("qpart").cast("int"))
    n = max(1, min(MOST_PARTITIONS, sum(parts)))
    return left.repartition(n, *at).groupBy(*at).cogroup(right.repartition(n, *at).groupBy(*at)).applyInPandas(
        lambda a, b: _nearest_by_boxes(a, b, k), "qid long, key long, payload double, distance double")


def search_regions(index: RegionIndex | None, queries: DataFrame, k: int) -> DataFrame:
    """qid, key, payload, distance, rank of the ``k`` nearest rows of each query (qid long, vec array<double>), as ``search`` gives them.

    ``k`` is at most that of the index.  Exact, also in ties, which go by key.  Eager: the queries with their regions are
    written, and what each finds in its own, because that bounds the second round, which returns no row beyond the bound.
    """
    spark, kind = queries.sparkSession, "qid long, key long, payload double, distance double, rank int"
    if index is None:
        return spark.createDataFrame([], kind)
    tree, sizes, compact = index.tree, index.sizes, RegionIndex(None, index.tree, index.sizes, index.low, index.high).compact

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, v in _slices(batches):
            v = compact(v)
            yield pa.RecordBatch.from_arrays([table["qid"].chunk(0), _binary(v), pa.array(_own_cells(tree, v))], ["qid", "vec", "cell"])
    asked = materialize(queries.where("vec IS NOT NULL").select("qid", "vec").mapInArrow(first, "qid long, vec binary, cell int"), "asked")
    order = [F.col("distance"), F.col("key"), F.col("payload")]
    near = _met(asked, index, k)
    if index.sizes.max() > REGION_ROWS * 4:  # a region in parts
        near = top_rows(near, ["qid"], order, k)
    near = materialize(near, "near")
    bounds = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d"))
    bounds = bounds.select("qid", F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> pa.RecordBatch:
            at, cells = np.concatenate([r for r, _ in held]), np.concatenate([np.full(len(r), c, "int32") for r, c in held])
            return pa.RecordBatch.from_arrays([pa.array(qid[at]), _binary(v[at]), pa.array(cells), pa.array(bound[at])], ["qid", "vec", "cell", "bound"])
        for table, v in _slices(batches):
            qid, own, bound = np.asarray(table["qid"]), np.asarray(table["cell"]), np.asarray(table["bound"])
            bound, held, n = bound + 1e-6 * (1 + bound), [], 0
            for rows, region in _walk(tree, v, bound):
                rows = rows[own[rows] != region] if sizes[region] else rows[:0]
                if len(rows):
                    held.append((rows, region))
                    n += len(rows)
                if n >= SLICE_ROWS:
                    yield flat()
                    held, n = [], 0
            if held:
                yield flat()
    rest = asked.join(bounds, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).select("qid", "vec", "cell", "bound")
    rest = materialize(rest.mapInArrow(others, "qid long, vec binary, cell int, bound double"), "rest")
    found = _met(rest, index, k).unionByName(near)
    return top_rows(found, ["qid"], order, k, "rank").select("qid", "key", "payload", "distance", "rank")
