"""Boosted trees of second order, grown level by level from histograms that Spark sums.

Numbers are cut at quantile edges into at most 31 bins and one for missing values, whose side every split learns.  Text
goes by 32 hashed codes, one against the rest.  Symmetric trees use one split per level, and take text as ordered target
statistics: the mean label of the rows of the same value that come earlier in a hashed permutation, so no row sees its
own label; rows to predict get the mean over all training rows.  Many classes are boosted together by softmax.

A level is one pass: tasks add gradients and hessians per (class, node, feature, bin), Spark adds those sums up, and
the driver gets them, a number of rows that does not depend on that of the table.  Models fitted together, each on rows
of its own, take their levels in the same passes, as many as ``CELLS`` sums allow.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Generator, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.operators.blocks import block_arrays, to_blocks
from trialmesh.scale import running_totals
from trialmesh.session import materialize, new_path, remove_path, scratch

register_pickle_by_value(sys.modules[__name__])

EDGES, BINS, CELLS, AT_ONCE = 31, 33, 2_000_000, 4
BLOCK = {"y": "float64", "held": "bool", "bins": "uint8"}


def _bin(value: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for a missing value, else one more than the edges below it."""
    return np.where(np.isnan(value), 0, 1 + np.searchsorted(edges, value, "left"))


class Boosted:
    """A fitted ensemble; ``transform`` adds ``_pred`` (a number) or ``probability`` (an array by class)."""

    def __init__(self, features: list[str], text: list[str], classes: int, symmetric: bool):
        self.features, self.text, self.classes, self.symmetric = features, text, classes, symmetric
        self.width = max(1, classes if classes > 2 else 1)  # scores that are boosted side by side
        self.trees, self.base, self.edges, self.statistics, self.names, self.ordered = [], [], {}, {}, [], []
        self.gain: dict[str, float] = {}
        self.losses: list[float] = []

    # ---- features

    def _targets(self) -> list[Column]:
        """The labels whose means stand for a text value: the number, or shares of classes."""
        y = F.col("_label")
        return [y] if self.width == 1 else [(y == i).cast("double") for i in range(self.classes)]

    def _smoothed(self, total: Column, n: Column, i: int) -> Column:
        return (total + F.lit(self.priors[i])) / (n + 1)

    def _learn_statistics(self, rows: DataFrame, seed: int) -> DataFrame:
        """Add the ordered statistics of the text features, and keep those over all rows for prediction."""
        place = F.xxhash64(*[f"f_{c}" for c in self.features], "_label", F.lit(seed))
        for c in self.text:
            names = [f"s_{c}_{i}" for i in range(len(self._targets()))]
            totals = dict(zip(names, self._targets(), strict=True)) | {f"s_{c}_n": F.lit(1.0)}
            every = rows.groupBy(f"f_{c}").agg(*[F.sum(v).alias(k) for k, v in totals.items()])
            self.statistics[c] = materialize(every.select(f"f_{c}", *[self._smoothed(F.col(k), F.col(f"s_{c}_n"), i).alias(k) for i, k in enumerate(names)]), "statistics")
            rows = running_totals(rows, [f"f_{c}"], place, [], totals)
            own = [self._smoothed(F.col(k) - v, F.col(f"s_{c}_n") - 1, i).alias(k) for i, (k, v) in enumerate(zip(names, self._targets(), strict=True))]
            rows = rows.select(*[x for x in rows.columns if x not in totals], *own)
        return rows

    def _join_statistics(self, rows: DataFrame) -> DataFrame:
        for c, table in self.statistics.items():
            rows = rows.join(table, f"f_{c}", "left")
            for i in range(len(table.columns) - 1):
                rows = rows.withColumn(f"s_{c}_{i}", F.coalesce(f"s_{c}_{i}", F.lit(self.priors[i])))
        return rows

    def _values(self) -> Column:
        """All features as numbers, NaN if missing; text as its code."""
        return F.array(*[F.coalesce(F.col(column).cast("double"), F.lit(float("nan"))) if ordered else F.pmod(F.xxhash64(column), F.lit(BINS - 1)).cast("double")
                         for column, ordered in zip(self.columns, self.ordered, strict=True)])

    def _bins(self) -> Callable[[np.ndarray], np.ndarray]:
        """Bins of values, both as (feature, row)."""
        edges = [np.array(self.edges[column], dtype=float) if ordered else None for column, ordered in zip(self.columns, self.ordered, strict=True)]
        return lambda values: np.stack([x.astype(int) if e is None else _bin(x, e) for x, e in zip(values, edges, strict=True)]).astype("uint8")

    # ---- fitting

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], text: list[str], classes: int, params: dict) -> "Boosted":
        """Fit on ``f_<feature>`` columns and ``_label`` (a number, or the place of the class); eager.

        ``patience`` > 0 keeps a tenth of the rows, chosen by hash, out of the trees, and stops when their loss has not
        fallen for so many trees; the trees after the best are left out.  ``seconds`` stops before a further tree.
        """
        return cls.fit_all([(rows, features, text, classes, params)])[0]

    @classmethod
    def fit_all(cls, jobs: Sequence[tuple[DataFrame, list[str], list[str], int, dict]]) -> list["Boosted"]:
        """A model for each of the arguments of :meth:`fit`, the same as alone, whose levels take the same passes; eager."""
        spark = jobs[0][0].sparkSession
        paths = [new_path(spark, "bins") for _ in jobs]

        def prepare(i: int) -> "Boosted":
            rows, features, text, classes, params = jobs[i]
            model = cls(features, text, classes, bool(params.get("symmetric")))
            model._write_bins(rows, params, paths[i], i)
            return model
        try:
            with ThreadPoolExecutor(min(AT_ONCE, len(jobs))) as pool:
                models = list(pool.map(prepare, range(len(jobs))))
            table = spark.read.schema(", ".join(f"{name} binary" for name in BLOCK) + ", model int").parquet(*paths)
            growing = {i: model._grow(jobs[i][4]) for i, model in enumerate(models)}
            asked = {i: first for i, g in growing.items() if (first := next(g, None))}
            while asked:
                for i, found in _level_sums(table, {i: (models[i], *request) for i, request in asked.items()}).items():
                    try:
                        asked[i] = growing[i].send(found)
                    except StopIteration:
                        del asked[i]
        finally:
            for path in paths:
                remove_path(spark, path)
        return models

    def _write_bins(self, rows: DataFrame, params: dict, path: str, number: int) -> None:
        """Learn priors, statistics and edges, and write the binned rows as blocks that bear the model's number."""
        numbers, seed, patience = [c for c in self.features if c not in self.text], int(params.get("seed", 42)), int(params.get("patience", 0))
        row = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(f"p{i}") for i, t in enumerate(self._targets())]).first()
        if not row["n"]:
            raise ValueError("no rows with a label")
        self.priors = [float(row[f"p{i}"]) for i in range(len(self._targets()))]
        self.base = [p if not self.classes else float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))) if self.width == 1 else float(np.log(max(p, 1e-6))) for p in self.priors]
        if self.classes:
            self.base = [min(max(b, -12.0), 12.0) for b in self.base]
        self.names, self.columns, self.ordered = list(numbers), [f"f_{c}" for c in numbers], [True] * len(numbers)
        if self.symmetric:
            rows = self._learn_statistics(rows, seed)
            for c in self.text:
                own = [f"s_{c}_{i}" for i in range(len(self._targets()))]
                self.names, self.columns, self.ordered = self.names + [c] * len(own), self.columns + own, self.ordered + [True] * len(own)
        else:
            self.names, self.columns, self.ordered = self.names + self.text, self.columns + [f"f_{c}" for c in self.text], self.ordered + [False] * len(self.text)
        kept = F.pmod(F.xxhash64(*[f"f_{c}" for c in self.features], "_label", F.lit(seed + 1)), F.lit(10)) == 0
        held = kept if patience else F.lit(False)
        # statistics are learned before the edges, which need them: written once, read by both steps
        with scratch(rows.select("_label", held.alias("held"), *dict.fromkeys(self.columns)), "features") as rows:
            numeric = [c for c, o in zip(self.columns, self.ordered, strict=True) if o]
            cuts = rows.approxQuantile(numeric, [i / (EDGES + 1) for i in range(1, EDGES + 1)], 0.002) if numeric else []
            self.edges = {c: sorted(set(e)) for c, e in zip(numeric, cuts, strict=True)}
            blocks = to_blocks(rows.select(F.col("_label").alias("y"), "held", self._values().alias("bins")), BLOCK, {"bins": self._bins()})
            blocks.withColumn("model", F.lit(number)).write.parquet(path)

    def _grow(self, params: dict) -> Generator[tuple[list[dict], int], tuple[np.ndarray, float | None], None]:
        """Yields the trees begun and the level to sum up, and takes what ``_level_sums`` finds."""
        depth, l2, least, patience = int(params.get("maxDepth", 4)), float(params.get("l2", 1.0)), float(params.get("min_weight", 1.0)), int(params.get("patience", 0))
        rate, gamma, until = float(params.get("stepSize", 0.1)), float(params.get("gamma", 0.0)), params.get("seconds")
        started, best, waited = time.monotonic(), 0, 0
        for _ in range(int(params.get("maxIter", 10))):
            if until is not None and self.trees and time.monotonic() - started > until:
                break
            growing = [{"feature": [], "cut": [], "missing": [], "leaf": None} for _ in range(self.width)]
            for level in range(depth):
                sums, loss = yield growing, level
                if level == 0 and patience and loss is not None:
                    self.losses.append(loss)
                    if loss < self.losses[best] or best == len(self.losses) - 1:
                        best, waited = len(self.losses) - 1, 0
                    else:
                        waited += 1
                    if waited >= patience:
                        self.trees = self.trees[:max(best, 1)]
                        return
                for k in range(self.width):
                    self._split(growing[k], sums[k], l2, least, gamma, rate, level == depth - 1)
            self.trees.append([{name: np.array(v) for name, v in tree.items()} for tree in growing])

    def _adder(self, growing: list[dict], level: int) -> tuple[tuple, Callable]:
        """The shape of the sums of a level, by (score, node, feature, bin), and what adds a block of rows to them."""
        shape = (self.width, 1 << level, len(self.names), BINS, 2)
        margins, ordered, classes = self._margins(), np.array(self.ordered), self.classes
        partial = [{name: np.array(v) for name, v in tree.items() if name != "leaf"} for tree in growing]

        def add(total: np.ndarray, y: np.ndarray, held: np.ndarray, columns: np.ndarray) -> tuple[float, int]:
            """Gradients and hessians go to ``total``; the loss of the rows held out and their number come back."""
            columns = columns.reshape(shape[2], len(y))
            score = margins(columns)
            if not classes:
                g, h = score - y[:, None], np.ones_like(score)
                loss = g[:, 0] ** 2
            elif shape[0] == 1:
                p = 1 / (1 + np.exp(-score))
                g, h = p - y[:, None], np.maximum(p * (1 - p), 1e-12)
                loss = np.logaddexp(0, np.where(y > 0, -score[:, 0], score[:, 0]))
            else:
                top = score.max(axis=1, keepdims=True)
                log_sum = top + np.log(np.exp(score - top).sum(axis=1, keepdims=True))
                p = np.exp(score - log_sum)
                own = np.arange(shape[0])[None, :] == y[:, None]
                g, h = p - own, np.maximum(p * (1 - p), 1e-12)
                loss = -(score - log_sum)[own]
            lost, held_rows = float(loss[held].sum()), int(held.sum())
            if held_rows:
                columns, g, h = columns[:, ~held], g[~held], h[~held]
            for k in range(shape[0]):
                first = _nodes(columns, partial[k], level, ordered) * BINS
                for f in range(shape[2]):
                    at = first + columns[f]
                    for j, part in enumerate((g, h)):
                        total[k, :, f, :, j] += np.bincount(at, part[:, k], shape[1] * BINS).reshape(shape[1], BINS)
            return lost, held_rows
        return shape, add

    def _split(self, tree: dict, sums: np.ndarray, l2: float, least: float, gamma: float, rate: float, last: bool) -> None:
        """Add the splits of a level, each node's best or one for all of them, and after the last level the leaves."""
        nodes, width = sums.shape[:2]
        left = np.zeros((nodes, width, BINS, 2, 2))  # node, feature, cut, missing on the left, (g, h)
        number, code = np.flatnonzero(self.ordered), np.flatnonzero(~np.array(self.ordered))
        missing_right, missing_left = left[..., 0, :], left[..., 1, :]
        running = np.cumsum(sums[:, number, 1:], axis=2)
        missing_right[:, number, 1:], missing_left[:, number, 1:] = running, running + sums[:, number, :1]
        missing_left[:, number, 0] = sums[:, number, 0]
        missing_right[:, code] = sums[:, code]
        whole = sums[:, 0].sum(axis=1)
        right = whole[:, None, None, None] - left
        worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
        fits = (left[..., 1] >= least) & (right[..., 1] >= least)
        gain = np.round(np.where(fits, worth(left) + worth(right) - worth(whole)[:, None, None, None], 0.0), 9)
        if self.symmetric:
            gain = np.broadcast_to(gain.sum(axis=0, keepdims=True), gain.shape)
        flat = gain.reshape(nodes, -1)
        pick, leaves = flat.argmax(axis=1), []
        for node in range(nodes):
            f, cut, missing = np.unravel_index(pick[node], gain.shape[1:])
            found = flat[node, pick[node]] > gamma
            tree["feature"].append(int(f) if found else -1)
            tree["cut"].append(int(cut))
            tree["missing"].append(bool(missing))
            if found:
                self.gain[self.names[f]] = self.gain.get(self.names[f], 0.0) + float(flat[node, pick[node]]) / (nodes if self.symmetric else 1)
            for g, h in (left[node, f, cut, missing], right[node, f, cut, missing]) if found else (whole[node], (0.0, 0.0)):
                leaves.append(-rate * g / (h + l2) if h + l2 > 0 else 0.0)
        if last:
            tree["leaf"] = leaves

    # ---- use

    def _margins(self):
        trees, base, ordered = self.trees, np.array(self.base), np.array(self.ordered)

        def margins(columns: np.ndarray) -> np.ndarray:
            score = np.tile(base, (columns.shape[1], 1))
            for group in trees:
                for k, tree in enumerate(group):
                    score[:, k] += tree["leaf"][_nodes(columns, tree, int(np.log2(len(tree["leaf"]))), ordered)]
            return score
        return margins

    def transform(self, df: DataFrame) -> DataFrame:
        margins, classes, width, features, binned = self._margins(), self.classes, self.width, len(self.names), self._bins()

        @F.arrow_udf("array<double>")
        def scored(values: pa.Array) -> pa.Array:
            score = margins(np.ascontiguousarray(binned(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), features).T)))
            if classes and width == 1:
                p = 1 / (1 + np.exp(-score))
                score = np.hstack([1 - p, p]) if classes == 2 else np.ones_like(p)
            elif classes:
                p = np.exp(score - score.max(axis=1, keepdims=True))
                score = p / p.sum(axis=1, keepdims=True)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1) * score.shape[1], pa.int32()), pa.array(score.ravel()))
        rows = self._join_statistics(df)
        out = scored(self._values())
        return rows.withColumn("probability", out) if classes else rows.withColumn("_pred", out[0])

    def importances(self) -> dict[str, float]:
        """Shares of the gain of all splits, by feature."""
        total = sum(self.gain.values())
        return {c: self.gain.get(c, 0.0) / total if total else 0.0 for c in self.features}


def _level_sums(table: DataFrame, asked: dict[int, tuple[Boosted, list[dict], int]]) -> dict[int, tuple[np.ndarray, float | None]]:
    """Of each model its gradients and hessians by (score, node, feature, bin) of a level, and the mean loss of the rows held out."""
    found, left = {}, dict(asked)
    while left:
        own, size = {}, 0
        for i in list(left):
            shape, add = left[i][0]._adder(*left[i][1:])
            if own and size + np.prod(shape[:-1]) > CELLS:
                break
            own[i], size = (shape, add, size), size + int(np.prod(shape[:-1]))
            del left[i]

        def sums(batches: Iterator[pa.RecordBatch], own: dict = own) -> Iterator[pa.RecordBatch]:
            totals, lost = {i: np.zeros(shape) for i, (shape, _, _) in own.items()}, {i: np.zeros(2) for i in own}
            for batch in batches:
                numbers = batch.column(len(BLOCK)).to_numpy()
                for row, arrays in enumerate(block_arrays([batch], BLOCK)):
                    i = int(numbers[row])
                    lost[i] += own[i][1](totals[i], *arrays)
            for i, (_, _, first) in own.items():
                flat = totals[i].reshape(-1, 2)
                cells = np.flatnonzero(flat[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(first + cells, -1 - i), pa.int64()), pa.array(np.append(flat[cells, 0], lost[i][0])),
                                                  pa.array(np.append(flat[cells, 1], lost[i][1]))], ["cell", "g", "h"])
        rows = table.where(F.col("model").isin(list(own))).mapInArrow(sums, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        flat, held = np.zeros((size, 2)), {-1 - int(c): (g, n) for c, g, n in rows[rows["cell"] < 0].itertuples(index=False)}
        rows = rows[rows["cell"] >= 0]
        flat[rows["cell"].to_numpy()] = rows[["g", "h"]].to_numpy()
        for i, (shape, _, first) in own.items():
            loss, n = held.get(i, (0.0, 0.0))
            found[i] = flat[first:first + int(np.prod(shape[:-1]))].reshape(shape), float(loss) / float(n) if n else None
    return found


def _nodes(columns: np.ndarray, tree: dict, depth: int, ordered: np.ndarray) -> np.ndarray:
    """The place of every row among the nodes of level ``depth``; nodes lie level by level, children beside each other.

    ``columns`` holds the bins by feature.  A level is a table of the side by (node, bin), read once a row.
    """
    at, value = np.zeros(columns.shape[1], dtype=np.intp), np.arange(BINS)
    for level in range(depth):
        own = slice((1 << level) - 1, (2 << level) - 1)
        feature, cut, missing = tree["feature"][own], tree["cut"][own, None], tree["missing"][own, None]
        f = np.maximum(feature, 0)
        below = np.where(ordered[f][:, None], np.where(value == 0, missing, value <= cut), value == cut) | (feature < 0)[:, None]
        used = np.unique(f)
        seen = columns[used[0]]
        for other in used[1:]:
            seen = np.where((f == other)[at], columns[other], seen)
        at = 2 * at + (~below).ravel().astype(np.intp)[at * BINS + seen]
    return at
