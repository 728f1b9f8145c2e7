"""Quality classifier: ridge regression over random Fourier features of document statistics, calibrated isotonically."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.llm.common import in_fold, likely, map_slices, remove, slices, small_batches, store, trim, whole_text

FEATURES, FOLDS, SUMS = 256, 2, 16
_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_PLAIN = np.array([ord(c) for c in ".,;:'\"()-"])


def statistics(text: str) -> list[float]:
    """Statistics of a whole text, all finite; an empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    if not data.strip():
        return [0.0] * 18
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines, size = data.split(), data.split(b"\n"), len(data)
    upper, lower, digits = int(seen[_UPPER].sum()), int(seen[_LOWER].sum()), int(seen[_DIGIT].sum())
    marks, plain, wide = int(seen[_MARKS].sum()), int(seen[_PLAIN].sum()), int(seen[128:].sum())
    full = [line for line in lines if line.strip()]
    ends = int(seen[46] + seen[33] + seen[63])
    letters = upper + lower + wide
    return [
        np.log1p(len(words)), np.log1p(size / len(words)), upper / max(1, upper + lower), digits / size, (marks - plain) / size, plain / size,
        wide / size, letters / size, len(set(words)) / len(words), len(set(full)) / len(full), np.log1p(size / len(lines)),
        np.log1p(len(words) / (1 + ends)), min(1.0, int(seen[33]) / len(words)), min(1.0, int(seen[124]) / len(words)),
        min(1.0, int(seen[_MARKS].max()) / len(words)), len(zlib.compress(data, 1)) / size,
        max(map(len, words)) / size, sum(word[-1:] in b".,;:!?" for word in words) / len(words)]


def _measured(docs: DataFrame) -> DataFrame:
    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([statistics(t) for t in batch.column(1).to_pylist()])
        ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))], ["doc_id", "x"])
    return map_slices(docs.select("doc_id", whole_text().alias("text")), ["doc_id", "text"], measured, "doc_id long, x array<double>")


class Features:
    """Random Fourier features of standardised statistics, whose products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, width: float, count: int = FEATURES):
        draw = np.random.default_rng(11)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.turns = draw.normal(size=(len(mean), count)) / width
        self.shift = draw.uniform(0, 2 * np.pi, count)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        waves = np.sqrt(2 / len(self.shift)) * np.cos(scaled @ self.turns + self.shift)
        return np.column_stack((waves, np.ones(len(x))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing values closest to ``means``: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for weight, mean in zip(weights, means, strict=True):
        blocks.append([weight, mean, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, m, n = blocks.pop()
            last = blocks[-1]
            blocks[-1] = [last[0] + w, (last[0] * last[1] + w * m) / (last[0] + w), last[2] + n]
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


class Model:
    """Calibrated scores of rows of statistics."""

    def __init__(self, features: Features, weights: np.ndarray, at: np.ndarray, level: np.ndarray):
        self.features, self.weights, self.at, self.level = features, weights, at, level

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.at, self.level), 0.0, 1.0)

    def column(self, text: Column) -> Column:
        """The score of a text column; null counts as empty."""
        model = self

        def scored(texts: pa.Array) -> pa.Array:
            rows = [statistics(t) for part in slices(pa.record_batch([texts], ["text"])) for t in part.column(0).to_pylist()]
            trim()
            return pa.array(model(np.array(rows).reshape(len(texts), -1)))
        scored.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(scored, "double")(F.coalesce(text, F.lit("")))


def taught(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = 200_000) -> DataFrame:
    """doc_id, y of the rows to learn from: labelled, outside the held-out fold, at most about ``max_train`` of them.

    Beyond that number they are chosen by the hash of their ids (the stated bound).
    """
    known = labels.where(F.col(label).isNotNull() & ~in_fold()).select("doc_id", F.col(label).cast("double").alias("y"))
    total = docs.select("doc_id").join(known, "doc_id").count()
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < max_train / total * (1 << 30)) if total > max_train else known


def fit(stats: DataFrame, known: DataFrame, width: float = 3.0, ridge: float = 1e-3, steps: int = 400) -> Model | None:
    """The model of statistics (doc_id, x) and the labels of some of them (doc_id, y); None where nothing is labelled.

    Each of ``SUMS`` tasks adds up its part of the normal equations, once per half of the training rows; the ridge
    solution of all parts scores the documents, and those of the halves score the other half, whose labels calibrate
    the scores isotonically over ``steps`` steps of the raw score.
    """
    spark = stats.sparkSession
    train, path = store(stats.join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("half")).repartition(SUMS), "labelled")
    if train.isEmpty():
        remove(spark, path)
        return None
    places = range(len(statistics("")))
    row = train.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in places for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    features = Features(np.array([row[f"m{i}"] for i in places]), np.array([row[f"s{i}"] for i in places]), width)
    empty = lambda: np.zeros((FEATURES + 1, FEATURES + 2))

    def summed(batches):
        parts = [empty() for _ in range(FOLDS)]
        for batch in batches:
            z, y, half = features(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for i in range(FOLDS):
                own = z[half == i]
                parts[i] += own.T @ np.column_stack((own, y[half == i]))
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["half", "sums"])
    sums = [empty() for _ in range(FOLDS)]
    for r in train.mapInArrow(summed, "half int, sums binary").collect():  # SUMS rows a half, whatever the input's size
        sums[r["half"]] += np.frombuffer(r["sums"]).reshape(FEATURES + 1, FEATURES + 2)

    def solve(part: np.ndarray) -> np.ndarray:
        penalty = ridge * max(part[-1, -2], 1.0) / FEATURES * np.eye(FEATURES + 1)
        penalty[-1, -1] = 1e-9
        return np.linalg.lstsq(part[:, :-1] + penalty, part[:, -1], rcond=None)[0]
    whole = solve(sum(sums))
    others = [solve(sum(sums) - own) for own in sums]

    def judged(batches):
        for batch in batches:
            z, half = features(_matrix(batch.column(0))), batch.column(2).to_numpy()
            raw = np.choose(half, [z @ w for w in others])
            step = np.clip(np.round(raw * steps), -steps, 2 * steps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], ["step", "y"])
    bins = train.mapInArrow(judged, "step int, y double").groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("step").collect()
    level = isotonic(np.array([r["n"] for r in bins], float), np.array([r["y"] for r in bins]))
    remove(spark, path)
    return Model(features, whole, np.array([r["step"] for r in bins]) / steps, level)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, prior: float = 1.0, label: str = "quality", max_train: int = 200_000,
                  **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every row: how likely its label is 1, and whether the score reaches ``threshold``.

    Inputs of a score are statistics of the whole text only.  Null or empty text has zero statistics and is scored
    like any other.  A row repeated in ``docs`` is scored each time; a label repeated in ``labels`` counts each time.
    Null labels and null ids teach nothing.  Without any labelled row every score is ``prior``.  Other columns are
    not used.  Eager: statistics are written to the shared folder and removed when the scores are written.
    """
    stats, used = store(_measured(docs), "statistics")
    model = fit(stats, taught(stats, labels, label, max_train), **options)

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = model(_matrix(batch.column(1))) if model else np.full(batch.num_rows, float(prior))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])
    found = map_slices(stats, ["doc_id", "x"], scored, "doc_id long, score double")
    result, _ = store(found.select("doc_id", in_fold().alias("held_out"), "score"), "scores")
    remove(docs.sparkSession, used)
    return result.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, label: str = "quality", max_train: int = 200_000, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, columns as they are; all rows where nothing is labelled.

    Only rows that teach are measured to learn from; then every row is measured once, where it is scored.  Null or
    empty texts are scored like others, repeated rows each time.
    """
    known = taught(docs, labels, label, max_train)
    stats, used = store(_measured(likely(docs.select("doc_id", "text"), known)), "statistics")
    model = fit(stats, known, **options)
    remove(docs.sparkSession, used)
    small_batches(docs.sparkSession)
    return docs.where(model.column(F.col("text")) >= threshold) if model else docs
