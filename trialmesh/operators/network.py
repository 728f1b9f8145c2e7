"""A network with one hidden layer, fitted by gradients that Spark sums.

Numbers are standardised (missing ones at the mean), hashed text goes through embeddings of its own.  Every step takes
one seeded share of the rows, written apart so that it alone is read; tasks add the gradients of their rows, Spark adds
those of the tasks, and the driver moves the weights, whose number does not depend on that of the rows (Adam).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.session import new_path, remove_path

register_pickle_by_value(sys.modules[__name__])

CODES, PLACES, CHUNK = 64, 4, 4096


class Network:
    """Embeddings, a hidden layer of rectified sums, and one output per class or one number."""

    def __init__(self, features: list[str], text: list[str], classes: int, hidden: int, seed: int):
        self.text, self.numbers = text, [c for c in features if c not in text]
        self.classes, self.outputs = classes, classes or 1
        width = len(self.numbers) + PLACES * len(text)
        random = np.random.default_rng(seed)
        self.weights = {
            "embedding": random.normal(0, 0.5, (len(text), CODES, PLACES)),
            "inner": random.normal(0, (2 / max(width, 1)) ** 0.5, (width, hidden)), "inner_bias": np.zeros(hidden),
            "outer": random.normal(0, (1 / hidden) ** 0.5, (hidden, self.outputs)), "outer_bias": np.zeros(self.outputs)}
        self.losses: list[float] = []

    def _inputs(self) -> list[Column]:
        """Standardised numbers and text codes as arrays."""
        def number(c: str, mean: float, spread: float) -> Column:
            value = F.col(f"f_{c}")
            known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
            return F.when(known, (value - mean) / spread).otherwise(0.0)
        x = [number(c, m, s) for c, (m, s) in zip(self.numbers, self.scale, strict=True)]
        codes = [F.pmod(F.xxhash64(f"f_{c}"), F.lit(CODES)).cast("int") for c in self.text]
        return [F.array(*x).cast("array<double>").alias("x"), F.array(*codes).cast("array<int>").alias("codes")]

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], text: list[str], classes: int, params: dict) -> "Network":
        """Fit on ``f_<feature>`` columns and ``_label`` (a number, or the place of the class); eager.

        ``maxIter`` steps go in turn through ``batches`` shares of the rows, dealt by a seeded hash.
        """
        seed, steps = int(params.get("seed", 42)), int(params.get("maxIter", 60))
        batches, rate, l2 = max(1, int(params.get("batches", 4))), float(params.get("stepSize", 0.05)), float(params.get("l2", 1e-4))
        model = cls(features, text, classes, int(params.get("hidden", 16)), seed)
        known = [F.when(~F.isnan(f"f_{c}") & (F.abs(f"f_{c}") != float("inf")), F.col(f"f_{c}")) for c in model.numbers] + [F.col("_label")]
        row = rows.agg(F.count(F.lit(1)).alias("n"), *[g(k).alias(f"{name}{i}") for i, k in enumerate(known) for name, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if not row["n"]:
            raise ValueError("no rows with a label")
        scale = [(float(row[f"m{i}"] or 0.0), float(row[f"s{i}"] or 1.0)) for i in range(len(known))]
        model.scale, model.target = scale[:-1], (0.0, 1.0) if classes else scale[-1]
        share = F.pmod(F.xxhash64(*[f"f_{c}" for c in features], "_label", F.lit(seed)), F.lit(batches))
        spark, path = rows.sparkSession, new_path(rows.sparkSession, "shares")
        y = (F.col("_label") - model.target[0]) / model.target[1]
        try:
            rows.select(y.cast("double").alias("y"), *model._inputs(), share.cast("int").alias("share")).write.partitionBy("share").parquet(path)
            table = spark.read.schema("y double, x array<double>, codes array<int>, share int").parquet(path)
            first, second = ({k: np.zeros_like(w) for k, w in model.weights.items()} for _ in range(2))
            moved = 0
            for step in range(steps):
                gradient, loss, n = model._gradient(table.where(F.col("share") == step % batches))
                if not n:
                    continue  # a small table may leave shares empty
                moved += 1
                model.losses.append(loss / n)
                for k, w in model.weights.items():
                    g = gradient[k] / n + (l2 * w if "bias" not in k else 0.0)
                    first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                    w -= rate * (first[k] / (1 - 0.9 ** moved)) / (np.sqrt(second[k] / (1 - 0.999 ** moved)) + 1e-8)
        finally:
            remove_path(spark, path)
        return model

    def _gradient(self, table: DataFrame) -> tuple[dict[str, np.ndarray], float, int]:
        """Sums over all rows of a share: gradients by weight, loss, and rows."""
        weights, classes = self.weights, self.classes
        size = sum(w.size for w in weights.values())

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 2)
            for batch in batches:
                for start in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(start, CHUNK)
                    x, codes = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for i in (1, 2))
                    total += _backward(weights, part.column(0).to_numpy(zero_copy_only=False), x, codes, classes)
            places = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total[places])], ["place", "total"])
        rows = table.select("y", "x", "codes").mapInArrow(add, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).toPandas()
        total, gradient, at = np.zeros(size + 2), {}, 0
        total[rows["place"].to_numpy()] = rows["total"].to_numpy()
        for k, w in weights.items():
            gradient[k], at = total[at:at + w.size].reshape(w.shape), at + w.size
        return gradient, float(total[-2]), int(round(total[-1]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``_pred`` (a number) or ``probability`` (an array by class)."""
        weights, classes, (mean, spread) = self.weights, self.classes, self.target

        @F.pandas_udf("array<double>")
        def scored(rows: pd.DataFrame) -> pd.Series:
            found = []
            for start in range(0, len(rows), CHUNK):
                part = rows.iloc[start:start + CHUNK]
                x, codes = (np.array(part[c].tolist(), dtype=t).reshape(len(part), -1) for c, t in (("x", float), ("codes", np.int64)))
                out = _forward(weights, x, codes)[-1]
                found += list(_shares(out) if classes else out * spread + mean)
            return pd.Series(found, dtype=object)
        out = scored(F.struct(*self._inputs()))
        return df.withColumn("probability", out) if classes else df.withColumn("_pred", out[0])


def _shares(out: np.ndarray) -> np.ndarray:
    p = np.exp(out - out.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _forward(weights: dict, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs with embeddings, the hidden layer, the outputs."""
    places = [weights["embedding"][i, codes[:, i]] for i in range(codes.shape[1])]
    inputs = np.hstack([x.reshape(len(x), -1), *places])
    hidden = np.maximum(inputs @ weights["inner"] + weights["inner_bias"], 0)
    return inputs, hidden, hidden @ weights["outer"] + weights["outer_bias"]


def _backward(weights: dict, y: np.ndarray, x: np.ndarray, codes: np.ndarray, classes: int) -> np.ndarray:
    """Gradients in the order of the weights, loss and rows, summed over the rows given."""
    inputs, hidden, out = _forward(weights, x, codes)
    if classes:
        p, own = _shares(out), np.arange(classes)[None, :] == y[:, None]
        delta, loss = p - own, -np.log(np.maximum(p[own], 1e-300)).sum()
    else:
        delta = out - y[:, None]
        loss = (delta ** 2).sum() / 2
    back = (delta @ weights["outer"].T) * (hidden > 0)
    to_inputs, embedding = back @ weights["inner"].T, np.zeros_like(weights["embedding"])
    for i in range(codes.shape[1]):
        first = x.shape[1] + i * PLACES
        np.add.at(embedding[i], codes[:, i], to_inputs[:, first:first + PLACES])
    parts = (embedding, inputs.T @ back, back.sum(axis=0), hidden.T @ delta, delta.sum(axis=0))
    return np.concatenate([*[p.ravel() for p in parts], [loss, len(y)]])
