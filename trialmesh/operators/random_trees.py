"""Extremely randomised trees: every node draws its cuts at random and keeps the best of them.

All rows go to every tree.  A node draws some features; a number is cut at a random place between the smallest and
largest value its rows have, hashed text is dealt to the two sides by a random half of 32 codes, and missing values (NaN
and the infinities among them) go to a random side.  The best cut is that with the least squared error, or Gini impurity.

A level takes two passes over the rows for all trees of a group: one for the ranges, one for the sums on both sides.
Tasks add up per (tree, node, draw), Spark adds those up, and the driver gets them, a number of rows that does not
depend on that of the table; groups are as large as ``CELLS`` sums allow.  Forests fitted together, each on rows of its
own, take their levels in the same passes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Generator, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.operators.blocks import block_arrays, to_blocks
from trialmesh.session import new_path, remove_path

register_pickle_by_value(sys.modules[__name__])

CODES, CELLS, CHUNK, AT_ONCE = 32, 2_000_000, 4096, 4
BLOCK = {"y": "float64", "x": "float64"}
CUT = ("feature", "cut", "mask", "missing")


class RandomTrees:
    """A fitted forest; ``transform`` adds ``_pred`` (a number) or ``probability`` (an array by class)."""

    def __init__(self, features: list[str], text: list[str], classes: int):
        self.features, self.text, self.classes = features, text, classes
        self.stats = max(classes, 1) + (0 if classes else 2)  # counts by class, or count, sum and squares of the label
        self.coded = np.array([c in text for c in features])
        self.trees: list[dict[str, np.ndarray]] = []
        self.gain = np.zeros(len(features))

    def _values(self) -> Column:
        """All features as numbers; text as its code."""
        def value(c: str) -> Column:
            if c in self.text:
                return F.pmod(F.xxhash64(f"f_{c}"), F.lit(CODES)).cast("double")
            return F.coalesce(F.col(f"f_{c}"), F.lit(float("nan")))
        return F.array(*[value(c) for c in self.features])

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], text: list[str], classes: int, params: dict) -> "RandomTrees":
        """Fit on ``f_<feature>`` columns and ``_label`` (a number, or the place of the class); eager."""
        return cls.fit_all([(rows, features, text, classes, params)])[0]

    @classmethod
    def fit_all(cls, jobs: Sequence[tuple[DataFrame, list[str], list[str], int, dict]]) -> list["RandomTrees"]:
        """A forest for each of the arguments of :meth:`fit`, the same as alone, whose levels take the same passes; eager."""
        spark = jobs[0][0].sparkSession
        paths = [new_path(spark, "values") for _ in jobs]

        def prepare(i: int) -> "RandomTrees":
            rows, features, text, classes, _params = jobs[i]
            model = cls(features, text, classes)
            # labels are summed around their mean, so that the squares lose no digits
            n, mean = rows.agg(F.count(F.lit(1)), F.avg("_label")).first()
            if not n:
                raise ValueError("no rows with a label")
            model.middle = 0.0 if classes else float(mean)
            blocks = to_blocks(rows.select(F.col("_label").alias("y"), model._values().alias("x")), BLOCK)
            blocks.withColumn("model", F.lit(i)).write.parquet(paths[i])
            return model
        try:
            with ThreadPoolExecutor(min(AT_ONCE, len(jobs))) as pool:
                models = list(pool.map(prepare, range(len(jobs))))
            table = spark.read.schema(", ".join(f"{name} binary" for name in BLOCK) + ", model int").parquet(*paths)
            growing = {i: model._grow(jobs[i][4]) for i, model in enumerate(models)}
            asked = {i: first for i, g in growing.items() if (first := next(g, None))}
            while asked:
                for i, found in _pass(table, asked).items():
                    try:
                        asked[i] = growing[i].send(found)
                    except StopIteration:
                        del asked[i]
        finally:
            for path in paths:
                remove_path(spark, path)
        return models

    def _grow(self, params: dict) -> Generator[tuple, np.ndarray, None]:
        """Yields what ``_pass`` has to add up, group by group of the trees, and takes what it finds."""
        depth, trees, classes = int(params.get("maxDepth", 8)), int(params.get("numTrees", 20)), self.classes
        least, draws, width = int(params.get("min_rows", 1)), int(params.get("draws", 0)), len(self.features)
        draws = min(width, draws or max(1, round(width ** 0.5) if classes else width))
        at_once = max(1, CELLS // ((1 << depth) * draws * 2 * self.stats))
        for first in range(0, trees, at_once):
            numbers = range(first, min(first + at_once, trees))
            self.trees += yield from self._grow_group(numbers, depth, draws, least, int(params.get("seed", 42)))

    def _grow_group(self, numbers: range, depth: int, draws: int, least: int, seed: int) -> Generator[tuple, np.ndarray, list[dict[str, np.ndarray]]]:
        width = len(self.features)
        trees = [{"feature": np.zeros(0, np.int64), "cut": np.zeros(0), "mask": np.zeros(0, np.int64), "missing": np.zeros(0, bool)} for _ in numbers]
        leaves = None
        for level in range(depth):
            nodes = 1 << level
            random = [np.random.default_rng([seed, number, level]) for number in numbers]
            feature = np.stack([r.permuted(np.tile(np.arange(width), (nodes, 1)), axis=1)[:, :draws] for r in random])  # tree, node, draw
            share = np.stack([r.random((nodes, draws)) for r in random])
            mask = np.stack([r.integers(1, (1 << CODES) - 1, (nodes, draws)) for r in random])
            missing = np.stack([r.random((nodes, draws)) < 0.5 for r in random])
            low, high = yield self._ranges(trees, feature, level)
            with np.errstate(invalid="ignore"):
                cut = low + share * (high - low)  # NaN where no value is known
            drawn = {"feature": feature, "cut": cut, "mask": mask, "missing": missing}
            sides = yield self._sums(trees, drawn, level)  # tree, node, draw, side, statistic
            whole = sides.sum(axis=3)
            count = lambda s: s.sum(axis=-1) if self.classes else s[..., 0]
            gain = np.round(self._impurity(whole) - self._impurity(sides).sum(axis=3), 9)
            gain = np.where((count(sides) >= least).all(axis=3), gain, 0.0)
            best = gain.argmax(axis=2)
            t, v = np.ogrid[:len(trees), :nodes]
            found = gain[t, v, best] > 0
            leaves = np.where(found[..., None, None], sides[t, v, best], np.stack([whole[:, :, 0], np.zeros_like(whole[:, :, 0])], axis=2))
            for i, tree in enumerate(trees):
                tree["feature"] = np.append(tree["feature"], np.where(found, feature[t, v, best], -1)[i])
                for name in CUT[1:]:
                    tree[name] = np.append(tree[name], drawn[name][t, v, best][i])
            np.add.at(self.gain, feature[t, v, best][found], gain[t, v, best][found])
        for i, tree in enumerate(trees):
            sums = leaves[i].reshape(-1, self.stats)
            total = np.maximum(sums.sum(axis=1, keepdims=True) if self.classes else sums[:, :1], 1)
            tree["leaf"] = sums / total if self.classes else sums[:, 1:2] / total + self.middle
        return trees

    def _impurity(self, sums: np.ndarray) -> np.ndarray:
        """Squared error around the mean, or rows times their Gini impurity."""
        if self.classes:
            n = sums.sum(axis=-1)
            return n - (sums ** 2).sum(axis=-1) / np.maximum(n, 1)
        return sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1)

    def _ranges(self, trees: list[dict], feature: np.ndarray, level: int) -> tuple:
        """A request for the smallest and largest known value by (tree, node, draw); NaN where there is none."""
        shape, place, coded, width = feature.shape, _places(trees, level, self.coded), self.coded, len(self.features)

        def add(total: np.ndarray, _y: np.ndarray, x: np.ndarray) -> None:
            low, high = total.reshape(2, -1)
            node = place(x)
            for t in range(shape[0]):
                for d in range(shape[2]):
                    f = feature[t, node[t], d]
                    value, at = x[np.arange(len(x)), f], (t * shape[1] + node[t]) * shape[2] + d
                    known = np.isfinite(value) & ~coded[f]
                    np.minimum.at(low, at[known], value[known])
                    np.minimum.at(high, at[known], -value[known])
        return "ranges", (2, *shape), width, add

    def _sums(self, trees: list[dict], drawn: dict, level: int) -> tuple:
        """A request for statistics of the label by (tree, node, draw, side)."""
        place, coded, stats, classes, middle = _places(trees, level, self.coded), self.coded, self.stats, self.classes, self.middle
        shape, width = drawn["feature"].shape, len(self.features)

        def add(total: np.ndarray, y: np.ndarray, x: np.ndarray) -> None:
            total = total.reshape(shape[0], -1)
            node, left = place(x), _sides(x, coded)
            for t in range(shape[0]):
                for d in range(shape[2]):
                    right = ~left([drawn[name][t, :, d] for name in CUT], node[t])
                    at = ((node[t] * shape[2] + d) * 2 + right) * stats
                    if classes:
                        total[t] += np.bincount(at + y.astype(np.int64), minlength=total.shape[1])
                    else:
                        for i, part in enumerate((None, y - middle, (y - middle) ** 2)):
                            total[t] += np.bincount(at + i, part, total.shape[1])
        return "sums", (*shape, 2, stats), width, add

    def transform(self, df: DataFrame) -> DataFrame:
        trees, coded, classes = self.trees, self.coded, self.classes
        place = _places(trees, int(np.log2(len(trees[0]["leaf"]))), coded)

        @F.arrow_udf("array<double>")
        def scored(values: pa.Array) -> pa.Array:
            x, found = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(coded)), [np.zeros((0, trees[0]["leaf"].shape[1]))]
            for start in range(0, len(x), CHUNK):
                node = place(x[start:start + CHUNK])
                found.append(sum(tree["leaf"][node[t]] for t, tree in enumerate(trees)) / len(trees))
            found = np.concatenate(found)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
        out = scored(self._values())
        return df.withColumn("probability", out) if classes else df.withColumn("_pred", out[0])

    def importances(self) -> dict[str, float]:
        """Shares of the gain of all cuts, by feature."""
        total = float(self.gain.sum())
        return {c: float(g) / total if total else 0.0 for c, g in zip(self.features, self.gain, strict=True)}


def _pass(table: DataFrame, asked: dict[int, tuple]) -> dict[int, np.ndarray]:
    """What the forests ask for: of those that ask for the same kind, as many in one pass as ``CELLS`` sums allow."""
    found = {}
    for kind, low in (("ranges", np.inf), ("sums", 0.0)):
        left = {i: request for i, request in asked.items() if request[0] == kind}
        while left:
            own, size = {}, 0
            for i in list(left):
                _, shape, width, add = left[i]
                if own and size + np.prod(shape) > CELLS:
                    break
                own[i], size = (shape, width, add, size), size + int(np.prod(shape))
                del left[i]

            def sums(batches: Iterator[pa.RecordBatch], own: dict = own, low: float = low) -> Iterator[pa.RecordBatch]:
                totals = {i: np.full(shape, low) for i, (shape, _, _, _) in own.items()}
                for batch in batches:
                    numbers = batch.column(len(BLOCK)).to_numpy()
                    for row in range(batch.num_rows):
                        i = int(numbers[row])
                        for y, x in _chunks([batch.slice(row, 1)], own[i][1]):
                            own[i][2](totals[i], y, x)
                for i, (_, _, _, first) in own.items():
                    flat = totals[i].ravel()
                    cells = np.flatnonzero(flat != low)
                    yield pa.RecordBatch.from_arrays([pa.array(first + cells, pa.int64()), pa.array(flat[cells])], ["cell", "total"])
            together = F.min if kind == "ranges" else F.sum
            rows = table.where(F.col("model").isin(list(own))).mapInArrow(sums, "cell long, total double").groupBy("cell").agg(together("total").alias("total")).toPandas()
            flat = np.full(size, low)
            flat[rows["cell"].to_numpy()] = rows["total"].to_numpy()
            for i, (shape, _, _, first) in own.items():
                found[i] = flat[first:first + int(np.prod(shape))].reshape(shape)
                if kind == "ranges":
                    found[i] = np.where(np.isinf(found[i]), np.nan, found[i]) * np.array([1.0, -1.0]).reshape(2, 1, 1, 1)
    return found


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Labels and values of at most ``CHUNK`` rows."""
    for y, x in block_arrays(batches, BLOCK):
        x = x.reshape(width, len(y))
        for start in range(0, len(y), CHUNK):
            yield y[start:start + CHUNK], np.ascontiguousarray(x[:, start:start + CHUNK].T)


def _sides(x: np.ndarray, coded: np.ndarray) -> Callable[[Sequence[np.ndarray], np.ndarray], np.ndarray]:
    """Tells whether each row goes left at the cut of its node, given the cuts by node; a node without one sends all rows there."""
    flat, start, whole = x.ravel(), np.arange(len(x)) * x.shape[1], bool(np.isfinite(x).all())

    def left(cuts: Sequence[np.ndarray], node: np.ndarray) -> np.ndarray:
        feature, cut, mask, missing = cuts
        f = np.maximum(feature, 0)[node]
        value = flat[start + f]
        below = value <= cut[node]
        if not whole:
            below = np.where(np.isfinite(value), below, missing[node])
        at = np.flatnonzero(coded[f])
        if len(at):
            code = np.where(np.isfinite(value[at]), value[at], 0).astype(np.int64)
            below[at] = (mask[node[at]] >> code) & 1 == 1
        return below | (feature < 0)[node]
    return left


def _places(trees: list[dict], depth: int, coded: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Finds the node of level ``depth`` of every row in every tree; nodes lie level by level."""
    def place(x: np.ndarray) -> np.ndarray:
        at, left = np.zeros((len(trees), len(x)), dtype=np.int64), _sides(x, coded)
        for t, tree in enumerate(trees):
            for level in range(depth):
                own = slice((1 << level) - 1, (2 << level) - 1)
                at[t] = 2 * at[t] + ~left([tree[name][own] for name in CUT], at[t])
        return at
    return place
