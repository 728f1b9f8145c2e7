"""Model families, ensembles, bagging and the round loop, on Spark ML.

Families stand in for the named libraries: RF is a random forest, XT extremely randomised trees (``random_trees``), GBM
and XGB boosted trees of second order, CAT the same with symmetric trees and ordered target statistics (``boosting``), LR
a linear model, KNN a vote of the nearest rows, NN_TORCH / FASTAI a network with embeddings (``network``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, HashingTF, IDF, Imputer, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from trialmesh.operators.blocks import block_arrays, to_blocks
from trialmesh.operators.boosting import Boosted
from trialmesh.operators.network import Network
from trialmesh.operators.random_trees import RandomTrees
from trialmesh.operators.vector_index import build_regions, search_regions
from trialmesh.operators.tabular import bag_folds, binary_metrics, calibrate_threshold, multiclass_metrics, regression_metrics, split_holdout
from trialmesh.scale import top_rows
from trialmesh.session import materialize, scratch

register_pickle_by_value(sys.modules[__name__])

HASHED_SLOTS, RANGE_ROWS, TASK_ROWS, FITS_AT_ONCE = 16, 100_000, 200_000, 4
SCORED = {"y": "float64", "p": "float64", "known": "bool"}
BINARY, MULTICLASS, REGRESSION = "binary_classification", "multiclass_classification", "regression"

# The five experiment templates of a round, used in turn.
TEMPLATES = (
    {"intent": "fast_baseline", "ensemble": True, "calibrate": False, "families": ("GBM", "RF")},
    {"intent": "balanced_ensemble", "ensemble": True, "calibrate": True, "families": ("GBM", "CAT", "RF", "XT")},
    {"intent": "deployable_simple", "ensemble": False, "calibrate": True, "families": ("GBM", "RF")},
    {"intent": "quality_search", "ensemble": True, "calibrate": True, "families": ("GBM", "CAT", "XGB", "RF", "XT")},
    {"intent": "imbalance_aware", "ensemble": True, "calibrate": True, "families": ("GBM", "RF", "XT")},
)


@dataclass
class Fitted:
    """A fitted family: ``transform`` adds ``prediction`` and, for classes, ``probability`` (array by class)."""

    family: str
    task: str
    features: list[str]
    classes: list[str]
    stages: list = field(repr=False)
    slots: list[tuple[str, int]] = field(default_factory=list, repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        keep = list(df.columns)
        out = _typed(df, self.features)
        for stage in self.stages:
            out = stage.transform(out)
        if self.task == REGRESSION:
            return out.select(*[F.col(f"_in.{c}").alias(c) for c in keep], F.col("_pred").alias("prediction"))
        if "probability" in out.columns:
            votes = isinstance(out.schema["probability"].dataType, T.ArrayType)
            prob = F.col("probability") if votes else vector_to_array("probability")
        else:
            raw = vector_to_array("rawPrediction")
            weight = F.transform(raw, lambda x: 1 / (1 + F.exp(-x)))
            prob = F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(1e-12), lambda a, b: a + b))
        names = F.array(*[F.lit(c) for c in self.classes])
        best = F.array_position(prob, F.array_max(prob)).cast("int")
        return out.select(*[F.col(f"_in.{c}").alias(c) for c in keep], F.element_at(names, best).alias("prediction"),
                          prob.alias("probability"))


def _kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in features if isinstance(types[c], (T.StringType, T.BooleanType))]
    return [c for c in features if c not in text], text


def _typed(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Input row kept in ``_in``; features as double (dates as days) or text."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def value(c: str) -> Column:
        if isinstance(types[c], (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("double")
        if isinstance(types[c], (T.StringType, T.BooleanType)):
            return F.coalesce(F.col(c).cast("string"), F.lit("<missing>"))
        return F.col(c).cast("double")

    return df.select(F.struct(*df.columns).alias("_in"), *[value(c).alias(f"f_{c}") for c in features],
                     *[c for c in ("_label",) if c in df.columns])


def _feature_stages(df: DataFrame, features: Sequence[str]) -> tuple[list, list[tuple[str, int]]]:
    """Imputer for numbers; text hashed per column, so no dictionary of values passes through the driver."""
    numbers, text = _kinds(df, features)
    stages, inputs, slots = [], [], []
    if numbers:
        stages.append(Imputer(inputCols=[f"f_{c}" for c in numbers], outputCols=[f"n_{c}" for c in numbers], strategy="mean"))
        inputs += [f"n_{c}" for c in numbers]
        slots += [(c, 1) for c in numbers]
    for c in text:
        stages.append(FeatureHasher(inputCols=[f"f_{c}"], outputCol=f"h_{c}", numFeatures=HASHED_SLOTS))
        inputs.append(f"h_{c}")
        slots.append((c, HASHED_SLOTS))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="_x", handleInvalid="keep"))
    return stages, slots


class Neighbours:
    """The ``k`` nearest training rows vote, each alike; for a regression their mean counts.

    Distance is Euclidean over numbers divided by their spread (missing ones at the mean) and over the slots of hashed
    text and boolean features, where two values in different slots are one apart.  Rows are found through the
    index by regions, exactly; of equally far ones those of the smaller hash count.
    """

    def __init__(self, prepared, scale: list[float], index, classes: list[str], k: int, regression: bool):
        self.prepared, self.scale, self.index, self.classes, self.k, self.regression = prepared, scale, index, classes, k, regression

    def vectors(self, df: DataFrame) -> DataFrame:
        scale = F.array(*[F.lit(x) for x in self.scale])
        return self.prepared.transform(df).withColumn("vec", F.zip_with(vector_to_array("_x"), scale, lambda x, s: x * s))

    @classmethod
    def fit(cls, df: DataFrame, source: DataFrame, features: Sequence[str], classes: list[str], k: int, regression: bool) -> "Neighbours":
        stages, slots = _feature_stages(source, features)
        prepared = Pipeline(stages=stages).fit(df)
        numbers = [c for c, width in slots if width == 1]
        spread = df.agg(*[F.stddev_pop(f"f_{c}").alias(f"s{i}") for i, c in enumerate(numbers)]).first() if numbers else []
        scale = [1.0 / s if s else 1.0 for s in spread] + [0.5 ** 0.5] * sum(width for _, width in slots if width > 1)
        model = cls(prepared, scale, None, classes, k, regression)
        rows = model.vectors(df).select(F.xxhash64("vec", "_label").alias("key"), "vec", F.col("_label").alias("payload"))
        with scratch(rows, "vectors") as rows:  # made once: the index reads them several times
            model.index = build_regions(rows, k)
        return model

    def transform(self, df: DataFrame) -> DataFrame:
        rows = materialize(self.vectors(df).withColumn("_row", F.monotonically_increasing_id()).select("_row", "_in", "vec"), "asked")
        found = search_regions(self.index, rows.select(F.col("_row").alias("qid"), "vec"), self.k).withColumnRenamed("qid", "_row")
        if self.regression:
            return rows.join(found.groupBy("_row").agg(F.avg("payload").alias("_pred")), "_row", "left")
        votes = [(F.count_if(F.col("payload") == i) / F.count(F.lit(1))) for i in range(len(self.classes))]
        return rows.join(found.groupBy("_row").agg(F.array(*votes).alias("probability")), "_row", "left")


# Default parameters per family.
FAMILY_PARAMS = {
    "RF": {"numTrees": 20, "maxDepth": 6, "seed": 42}, "XT": {"numTrees": 20, "maxDepth": 8, "min_rows": 5, "seed": 43},
    "GBM": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.2, "l2": 0.1, "seed": 42}, "XGB": {"maxIter": 10, "maxDepth": 5, "stepSize": 0.3, "l2": 1.0, "patience": 3, "seed": 43},
    "CAT": {"maxIter": 10, "maxDepth": 4, "stepSize": 0.2, "l2": 3.0, "symmetric": True, "seed": 44}, "LR": {"maxIter": 50, "regParam": 0.01},
    "KNN": {"k": 5}, "NN_TORCH": {"maxIter": 60, "hidden": 16, "seed": 42}, "FASTAI": {"maxIter": 40, "hidden": 32, "seed": 43},
}


def _estimator(family: str, task: str, params: dict):
    io = {"featuresCol": "_x", "labelCol": "_label", "predictionCol": "_pred"}
    if family == "RF":
        return RandomForestRegressor(**io, **params) if task == REGRESSION else RandomForestClassifier(**io, **params)
    if family == "LR":
        return LinearRegression(**io, **params) if task == REGRESSION else LogisticRegression(**io, **params)
    raise ValueError(f"unknown family {family!r}")


def _classes(train: DataFrame, label: str, task: str) -> list[str]:
    """Sorted class names; a label with more values than a classifier can hold is an error."""
    if task == REGRESSION:
        return []
    rows = train.select(F.col(label).cast("string").alias("c")).where("c is not null").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 classes")
    return sorted(r["c"] for r in rows)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows in parts of at most about ``TASK_ROWS``: Spark ML keeps each part as objects, many times its bytes on disk."""
    parts = -(-rows.count() // TASK_ROWS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def fit_family(train: DataFrame, features: Sequence[str], label: str, task: str, family: str, params: dict | None = None) -> Fitted:
    """Fit one family (eager); KNN writes its training rows as an index, and the rows it is asked about."""
    return fit_together([(train, family, params)], features, label, task)[0]


#: Families whose models, fitted together, take their levels in the same passes.
SHARED = {"GBM": Boosted, "XGB": Boosted, "CAT": Boosted, "XT": RandomTrees}


def fit_together(jobs: Sequence[tuple[DataFrame, str, dict | None]], features: Sequence[str], label: str, task: str) -> list[Fitted]:
    """A model for each (training rows, family, parameters), the same as fitted alone (eager).

    Boosted trees share their passes, so do randomised trees; these and each of the others are fitted side by side.
    """
    def begin(job: tuple[DataFrame, str, dict | None]) -> tuple[list[str], DataFrame, dict]:
        train, family, params = job
        classes = _classes(train, label, task)
        if task == REGRESSION:
            target = F.col(label).cast("double")
        else:
            target = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1).cast("double")
        rows = _typed(train.where(F.col(label).isNotNull()).withColumn("_label", target), features)
        return classes, rows.drop("_in"), {**FAMILY_PARAMS.get(family, {}), **(params or {})}

    def fit(places: list[int]) -> list[Fitted]:
        train, family, _ = jobs[places[0]]
        begun = [begin(jobs[i]) for i in places]
        if family in SHARED:
            text = _kinds(train, features)[1]
            models = SHARED[family].fit_all([(rows, list(features), text, len(classes), options) for classes, rows, options in begun])
            return [Fitted(jobs[i][1], task, list(features), classes, [model]) for i, (classes, _, _), model in zip(places, begun, models, strict=True)]
        (classes, rows, options), = begun
        if family == "KNN":
            return [Fitted(family, task, list(features), classes, [Neighbours.fit(rows, train, features, classes, options["k"], task == REGRESSION)])]
        if family in ("NN_TORCH", "FASTAI"):
            return [Fitted(family, task, list(features), classes, [Network.fit(rows, list(features), _kinds(train, features)[1], len(classes), options)])]
        stages, slots = _feature_stages(train, features)
        estimator = _estimator(family, task, options)
        model = Pipeline(stages=[*stages, estimator]).fit(_spread(rows))
        return [Fitted(family, task, list(features), classes, [model], slots)]

    groups: dict = {}
    for i, (_, family, _) in enumerate(jobs):
        groups.setdefault(SHARED.get(family, i), []).append(i)
    if len(groups) == 1:
        return fit(list(range(len(jobs))))
    with ThreadPoolExecutor(min(FITS_AT_ONCE, len(groups))) as pool:
        found = dict(zip((i for places in groups.values() for i in places), (m for models in pool.map(fit, groups.values()) for m in models), strict=True))
    return [found[i] for i in range(len(jobs))]


def batch_predict(model: Fitted, df: DataFrame) -> DataFrame:
    """Predictions for all records (``df.count()`` of the result is the record count)."""
    return model.transform(df)


def feature_importance(model: Fitted) -> DataFrame:
    """(feature, importance, rank); the slots of a hashed feature are added up."""
    from pyspark.sql import SparkSession
    rows = []
    if hasattr(model.stages[0], "importances"):
        rows = list(model.stages[0].importances().items())
    else:
        last = getattr(model.stages[0], "stages", [None])[-1]
        if not hasattr(last, "featureImportances"):
            raise ValueError(f"{model.family} has no importances of its own; see permutation_importance")
        values, at = last.featureImportances.toArray(), 0
        for name, width in model.slots:
            rows.append((name, float(values[at:at + width].sum())))
            at += width
    rows.sort(key=lambda r: (-r[1], r[0]))
    return SparkSession.active().createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(rows)], "feature string, importance double, rank int")


def permutation_importance(model: Fitted, holdout: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """(feature, importance, rank) of any family: how much the loss grows when the values of a feature change rows.

    All features' values move one place along one order of all rows by a seeded hash, the last to the first; a changed
    copy takes those of one feature.  The loss is the squared error, for classes the negative logarithm of the own
    class's probability, at least 1e-15; a label that the model does not know counts as that.  All copies are scored in
    one pass.  ``key`` names the rows, once each; rows without a label are left out (eager).

    Label, features and hash of the rows are written and shuffled once, whatever the number of features: the order is
    cut into ranges of the hash, and the last row of a range is handed to the next one beside the shuffle.
    """
    columns = list(dict.fromkeys([label, *model.features]))
    spread = holdout.where(F.col(label).isNotNull()).select(*columns, F.xxhash64(F.lit(seed), F.col(key)).alias("_at"))
    with scratch(spread, "holdout") as rows:
        bits = max(3, (rows.count() // RANGE_ROWS).bit_length())
        rows = rows.withColumn("_range", F.shiftrightunsigned("_at", 64 - bits))
        order = ["_at", *columns]  # rows alike in all of them may change places
        ends = F.broadcast(rows.groupBy("_range").agg(F.max("_at").alias("_at")))  # a row per range
        last = top_rows(rows.join(ends, ["_range", "_at"]), ["_range"], [F.col(c).desc() for c in order])
        before = F.coalesce(F.lag("_last").over(W.orderBy("_range")), F.first("_last").over(W.orderBy(F.col("_range").desc())))
        given = last.select("_range", F.struct(*columns).alias("_last")).select("_range", before.alias("_given"))
        along = W.partitionBy("_range").orderBy(*order)
        moved = rows.withColumn("_first", F.row_number().over(along) == 1).withColumn("_before", F.lag(F.struct(*columns)).over(along))
        moved = moved.join(F.broadcast(given), "_range").withColumn("_before", F.when(F.col("_first"), F.col("_given")).otherwise(F.col("_before")))
        every = moved.withColumn("_changed", F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, model.features))))
        every = every.select("_changed", *[F.when(F.col("_changed") == c, F.col("_before")[c]).otherwise(F.col(c)).alias(c) for c in columns])
        scored = model.transform(every)
        if model.task == REGRESSION:
            loss = F.pow(F.col("prediction") - F.col(label).cast("double"), 2)
        else:
            names = F.array(*[F.lit(c) for c in model.classes])
            own = F.get("probability", F.array_position(names, F.col(label).cast("string")).cast("int") - 1)
            loss = -F.ln(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(1e-15)))
        means = {r["_changed"]: r["loss"] for r in scored.groupBy("_changed").agg(F.avg(loss).alias("loss")).collect()}  # a row per feature
    found = sorted(((f, float(means[f] - means[None])) for f in model.features if f in means), key=lambda r: (-r[1], r[0]))
    return holdout.sparkSession.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(found)], "feature string, importance double, rank int")


def weighted_ensemble(preds: DataFrame, models: Sequence[str], label: str, metric: str = "log_loss", steps: int = 10) -> dict[str, float]:
    """Weights by greedy forward selection with replacement on holdout predictions (eager).

    ``preds`` has one numeric column per model; its values are written once as blocks.  Each step scores all candidate
    additions in one pass over them; only one number per model comes back.
    """
    if metric not in ("root_mean_squared_error", "log_loss", "accuracy"):
        raise ValueError(f"metric {metric!r} cannot be selected on")

    def loss(y: np.ndarray, p: np.ndarray) -> float:
        """Sum over rows; NaN counts as larger than every number, as in Spark."""
        if metric == "root_mean_squared_error":
            return float(((y - p) * (y - p)).sum())
        if metric == "accuracy":
            return float((((p >= 0.5) | np.isnan(p)) != y).sum())
        q = np.where(np.isnan(p), 1 - 1e-15, np.clip(p, 1e-15, 1 - 1e-15))
        return -float((y * np.log(q) + (1 - y) * np.log(1 - q)).sum())

    def losses(table: DataFrame, taken: list[int], step: int) -> list[float | None]:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(taken), 2))
            for y, p, known in block_arrays(batches, SCORED):
                p, known = p.reshape(len(taken), len(y)), known.reshape(len(taken), len(y))
                base, whole = np.zeros(len(y)), np.ones(len(y), dtype=bool)
                for n, own, there in zip(taken, p, known, strict=True):
                    if n:
                        base, whole = base + own * n, whole & there
                for i in range(len(taken)):
                    used = whole & known[i]
                    total[i] += loss(y[used], ((base + p[i]) / step)[used]), used.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(taken))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["model", "loss", "n"])
        mean = F.try_divide(F.sum("loss"), F.sum("n"))
        mean = F.round(F.sqrt(mean) if metric == "root_mean_squared_error" else mean, 12)
        found = dict(table.mapInArrow(add, "model long, loss double, n double").groupBy("model").agg(mean).collect())  # a row per model
        return [found.get(i) for i in range(len(taken))]

    models, y = list(models), F.col(label).cast("double")
    values = F.array(*[F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for m in models])
    known = F.array(*[F.col(m).isNotNull() for m in models])
    taken, best_loss, best = [0] * len(models), None, [0] * len(models)
    with scratch(to_blocks(preds.where(y.isNotNull()).select(y.alias("y"), values.alias("p"), known.alias("known")), SCORED), "scored") as table:
        for step in range(1, steps + 1):
            found = losses(table, taken, step)
            pick = min(range(len(models)), key=lambda i: (found[i], i))
            taken[pick] += 1
            if best_loss is None or found[pick] < best_loss:
                best_loss, best = found[pick], list(taken)
    total = sum(best)
    return {m: n / total for m, n in zip(models, best, strict=True)}


def blend(preds: DataFrame, weights: dict[str, float], out: str = "ensemble") -> DataFrame:
    return preds.withColumn(out, sum((F.col(m) * w for m, w in weights.items() if w), F.lit(0.0)))


def _main_score(model: Fitted) -> Column:
    """What ensembles average: the positive class's probability, or the prediction."""
    return F.col("prediction").cast("double") if model.task == REGRESSION else F.col("probability")[len(model.classes) - 1]


def stack_level(train: DataFrame, features: Sequence[str], label: str, task: str, families: Sequence[str], key: str, k: int = 2,
                params: dict | None = None) -> DataFrame:
    """Out-of-fold predictions of each family as new columns ``oof_<family>`` (eager fits).

    Each row is scored by models that did not see its fold.  Binary and regression tasks.
    """
    folds = materialize(bag_folds(train, k, key), "folds")
    columns = [*train.columns, "fold"]
    out = folds
    for family in families:
        parts = []
        for i in range(k):
            model = fit_family(folds.where(F.col("fold") != i), features, label, task, family, (params or {}).get(family))
            scored = model.transform(out.where(F.col("fold") == i))
            parts.append(scored.select(*columns, *[c for c in out.columns if c.startswith("oof_")], _main_score(model).alias(f"oof_{family}")))
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.unionByName(p)
        out = materialize(merged, "oof")
    return out


def bagged(train: DataFrame, df: DataFrame, features: Sequence[str], label: str, task: str, family: str, key: str, k: int,
           params: dict | None = None) -> DataFrame:
    """``df`` scored by the mean of ``k`` models, each fitted without one fold (eager fits)."""
    folds = bag_folds(train, k, key)
    out, names = df, []
    for i in range(max(k, 1)):
        part = folds.where(F.col("fold") != i) if k else folds
        model = fit_family(part, features, label, task, family, params)
        columns = list(out.columns)
        out = model.transform(out).select(*columns, _main_score(model).alias(f"_bag{i}"))
        names.append(f"_bag{i}")
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    return out.withColumn("score", mean).drop(*names)


def _evaluate(preds: DataFrame, label: str, task: str, threshold: float) -> dict:
    if task == REGRESSION:
        table = regression_metrics(preds, label, "score")
    elif task == BINARY:
        table = binary_metrics(preds, label, "score", threshold)
    else:
        table = multiclass_metrics(preds, label, "prediction")
    return {k: v for k, v in table.first().asDict().items() if v is not None}


class _Scores:
    """Validation and holdout rows beside what each family, bagged or not, gives for them; fitted once."""

    def __init__(self, split: DataFrame, features: Sequence[str], label: str, task: str, key: str, params: dict):
        self.fitting, self.table = split.where("side = 'fit'").drop("side"), split.where("side <> 'fit'")
        self.features, self.label, self.task, self.key, self.params = list(features), label, task, key, params
        self.classes, self.known, self.failed = _classes(self.fitting, label, task), {}, {}

    def add(self, wanted: Sequence[tuple[str, int]]) -> None:
        """Fit the (family, number of folds) that are not there yet, all together; if that fails, one by one, and keep the errors."""
        new = [w for w in dict.fromkeys(wanted) if w not in self.known and w not in self.failed]
        for group in [new] + ([[w] for w in new] if len(new) > 1 else []):
            group = [w for w in group if w not in self.known]
            try:
                if group:
                    self._add(group)
            except Exception as error:
                self.failed |= dict.fromkeys(group, error)
        self.failed = {w: error for w, error in self.failed.items() if w not in self.known}

    def _add(self, new: Sequence[tuple[str, int]]) -> None:
        jobs, owner = [], []
        for family, folds in new:
            train = bag_folds(self.fitting, folds, self.key) if folds else self.fitting
            for i in range(max(folds, 1)):
                jobs.append((train.where(F.col("fold") != i).drop("fold") if folds else train, family, self.params.get(family)))
                owner.append((family, folds))
        models: dict = {}
        for own, model in zip(owner, fit_together(jobs, self.features, self.label, self.task), strict=True):
            models.setdefault(own, []).append(model)
        for own, bags in models.items():  # written one after the other: plans of many models at once take long to make
            out, columns, name = self.table, self.table.columns, f"_score_{own[0]}_{own[1]}"
            for i, model in enumerate(bags):
                value = F.col("probability") if self.task == MULTICLASS else _main_score(model)
                out = model.transform(out).select(*out.columns, value.alias(f"_bag{i}"))
            score = _mean([F.col(f"_bag{i}") for i in range(len(bags))], self.task)
            self.table = materialize(out.select(*columns, score.alias(name)), "scores")
            self.known[own] = name

    def rows(self, families: Sequence[str], folds: int) -> DataFrame:
        """side, key, label, and a column per family: a number, or an array by class."""
        for family in families:
            if (family, folds) in self.failed:
                raise self.failed[family, folds]
        return self.table.select("side", self.key, self.label, *[F.col(self.known[f, folds]).alias(f) for f in families])


def _mean(columns: list[Column], task: str, weights: Sequence[float] | None = None) -> Column:
    """Weighted mean of scores: numbers, or arrays by class."""
    weights = list(weights) if weights else [1 / len(columns)] * len(columns)
    parts = [F.transform(c, lambda x, w=w: x * w) if task == MULTICLASS else c * w for c, w in zip(columns, weights, strict=True) if w]
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda a, b: a + b) if task == MULTICLASS else total + part
    return total


def run_rounds(df: DataFrame, features: Sequence[str], label: str, task: str, metric: str, key: str, max_rounds: int = 3,
               per_round: int = 3, params: dict | None = None, parallel: int = 2, families: Sequence[str] | None = None,
               bag_folds: int = 3) -> DataFrame:
    """Rounds of experiments on one split; returns the log, one row per experiment (eager).

    Rows are split into fit, validation and holdout.  Families are fitted on the first; ensemble weights, the best
    single family and the threshold are chosen on the second; the holdout only gives the scores of the log.
    Experiments take the templates in turn, and ids count inside their round; when the templates are used up they
    come back with families bagged over ``bag_folds`` folds, then one fold more.  ``families`` restricts the
    templates; one that is left without a family fails.  Each family is fitted once per number of folds.
    Stops after ``max_rounds`` or a round without success.  A binary label must be 0/1.
    """
    spark = df.sparkSession
    outer = materialize(split_holdout(df.select(*{*features, label, key}), label, task, key), "split")
    inner = split_holdout(outer.where("side = 'train'").drop("side"), label, task, key)
    named = inner.withColumn("side", F.when(F.col("side") == "train", "fit").otherwise("validation"))
    split = materialize(named.unionByName(outer.where("side = 'holdout'")), "split")
    scores = _Scores(split, features, label, task, key, params or {})

    def loss(rows: DataFrame, score: Column) -> float:
        """Loss on the validation rows by which families are compared."""
        picked = rows.where("side = 'validation'").select(F.col(label).alias("_y"), score.alias("_p"))
        if task == MULTICLASS:
            names = F.array(*[F.lit(c) for c in scores.classes])
            own = F.get("_p", F.array_position(names, F.col("_y").cast("string")).cast("int") - 1)
            return picked.agg(-F.avg(F.ln(F.greatest(own, F.lit(1e-15))))).first()[0]
        y, p = F.col("_y").cast("double"), F.col("_p")
        if task == REGRESSION:
            return picked.agg(F.avg((y - p) * (y - p))).first()[0]
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
        return picked.agg(-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).first()[0]

    def wanted(at: int) -> tuple[dict, list[str], int]:
        """Template, its families, and their number of bag folds."""
        plan, cycle = TEMPLATES[at % len(TEMPLATES)], at // len(TEMPLATES)
        return plan, [f for f in plan["families"] if families is None or f in families], bag_folds + cycle - 1 if cycle else 0

    def experiment(number: int, index: int, at: int) -> tuple:
        plan, own, folds = wanted(at)
        head = (number, f"r{number}_exp{index + 1}", at, plan["intent"])
        try:
            if not own:
                raise ValueError(f"no family of {plan['families']} is among {tuple(families)}")
            rows = scores.rows(own, folds)
            if plan["ensemble"] and task != MULTICLASS:
                weights = weighted_ensemble(rows.where("side = 'validation'"), own, label, "root_mean_squared_error" if task == REGRESSION else "log_loss")
            elif plan["ensemble"]:
                weights = {f: 1 / len(own) for f in own}
            else:
                weights = {min(own, key=lambda f: (loss(rows, F.col(f)), own.index(f))): 1.0}
            mixed = rows.withColumn("score", _mean([F.col(f) for f in weights], task, list(weights.values())))
            threshold = 0.5
            if plan["calibrate"] and task == BINARY:
                threshold = calibrate_threshold(mixed.where("side = 'validation'"), label, "f1").first()["threshold"]
            held = mixed.where("side = 'holdout'")
            if task == MULTICLASS:
                names = F.array(*[F.lit(c) for c in scores.classes])
                held = held.withColumn("prediction", F.element_at(names, F.array_position("score", F.array_max("score")).cast("int")))
            values = _evaluate(held, label, task, threshold)
            second = {k: float(v) for k, v in values.items() if k != metric} | {"validation_loss": float(loss(mixed, F.col("score")))}
            return (*head, "completed", metric, float(values[metric]), second, None)
        except Exception as error:  # a failed experiment is a result of the round
            return (*head, "failed", metric, None, {}, str(error))

    log: list[tuple] = []
    for number in range(1, max_rounds + 1):
        places = range((number - 1) * per_round, number * per_round)
        scores.add([(f, folds) for at in places for _, own, folds in [wanted(at)] for f in own])
        with ThreadPoolExecutor(parallel) as pool:
            results = list(pool.map(lambda at: experiment(number, at % per_round, at), places))
        log += results
        if not any(r[4] == "completed" for r in results):
            break
    return spark.createDataFrame(log, """round int, experiment_id string, seq int, intent string, status string, primary_metric string,
        score double, secondary_metrics map<string,double>, error_summary string""")


def text_classifier(df: DataFrame, text: str, label: str, buckets: int = 1 << 14) -> Pipeline:
    """Fitted pipeline from text to a 0/1 label: hashed words, idf, logistic regression (eager)."""
    stages = [Tokenizer(inputCol=text, outputCol="_words"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=buckets),
              IDF(inputCol="_tf", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, maxIter=20, regParam=0.05)]
    return Pipeline(stages=stages).fit(df)
