"""Usage summaries, registry counts, table profiles and quality rules."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from trialmesh.scale import exact_percentile
from trialmesh.session import materialize

# Limits per plan; None means unlimited.
PLAN_LIMITS = {
    "free": {"useCases": 1, "exaDatasets": 0, "ragTrials": 0, "trainingRuns": 1},
    "pro": {"useCases": 3, "exaDatasets": 10, "ragTrials": 5, "trainingRuns": 10},
    "enterprise": {"useCases": None, "exaDatasets": None, "ragTrials": None, "trainingRuns": None},
}

# Least rows (or question-answer pairs) a task type needs.
MIN_ROWS = {
    "tabular_binary_classification": 300, "tabular_multiclass_classification": 500, "tabular_regression": 300,
    "time_series_forecasting": 200, "text_classification": 200, "image_classification": 100, "ner": 100,
    "rag_question_answering": 30,
}

COLUMNS_PER_PASS = 20


def usage_columns() -> list[Column]:
    """Spend and units by kind, each a conditional sum with nothing counted as 0."""
    def units(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("event_type").isin(*kinds), F.col("units"))), F.lit(0)).cast("bigint")

    return [
        F.coalesce(F.sum("total_cost"), F.lit(0)).cast("double").alias("spend"),
        units("exa_acu", "exa_search").alias("exa_datasets"), units("autorag_compute").alias("rag_trials"),
        units("autogluon_compute").alias("training_runs"), units("deployment_runtime").alias("deployment_runtime")]


def usage_summary(events: DataFrame, scope=None, since: datetime | None = None) -> DataFrame:
    """One row of usage since a moment; per scope when no single scope is given."""
    if since is not None:
        events = events.where(F.col("created_at") >= F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz"))
    if scope is None:
        return events.groupBy("organization_id").agg(*usage_columns())
    return events.where(F.col("organization_id") == F.lit(scope)).agg(*usage_columns())


def count_active_children(use_cases: DataFrame, projects: DataFrame, org=None) -> DataFrame:
    """Use cases that are not archived, per organisation."""
    scope = projects.select(F.col("id").alias("project_id"), "organization_id")
    if org is not None:
        scope = scope.where(F.col("organization_id") == F.lit(org))
    live = use_cases.where(F.col("status") != "archived").select("project_id")
    return live.join(scope, "project_id").groupBy("organization_id").agg(F.count(F.lit(1)).alias("use_cases"))


def usage_vs_limits(usage: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per scope and metered item: value, plan limit (null = unlimited), capped percent."""
    name = F.lower(F.trim("plan"))
    known = F.when(name.isin(*PLAN_LIMITS), name).otherwise("free")
    limits = F.create_map(*[
        part for plan, items in PLAN_LIMITS.items() for item, limit in items.items() if limit is not None
        for part in (F.lit(f"{plan}:{item}"), F.lit(limit).cast("bigint"))])
    rows = usage.join(plans, "organization_id").withColumn("plan", F.coalesce(known, F.lit("free")))
    items = {"useCases": "use_cases", "exaDatasets": "exa_datasets", "ragTrials": "rag_trials", "trainingRuns": "training_runs"}
    cells = F.array(*[F.struct(F.lit(k).alias("item"), F.col(c).cast("double").alias("value")) for k, c in items.items()])
    rows = rows.select("organization_id", "plan", F.inline(cells))
    limit = F.try_element_at(limits, F.concat_ws(":", "plan", "item"))
    share = F.floor(F.col("value") / F.greatest(limit, F.lit(1)) * 100 + 0.5)
    return rows.withColumn("limit", limit).withColumn(
        "percent", F.when(F.col("limit").isNotNull(), F.least(F.lit(100), share)).cast("bigint"))


def registry_counts(models: DataFrame, datasets: DataFrame, use_cases: DataFrame) -> DataFrame:
    """Header counts of the registry pages, as (measure, value) rows."""
    def rows(df: DataFrame, **measures: Column) -> DataFrame:
        one = df.agg(*[c.cast("bigint").alias(n) for n, c in measures.items()])
        return one.unpivot([], list(measures), "measure", "value")

    active = F.lower("status").isin("approved", "training", "deployed")
    parts = [
        rows(models, training_runs=F.countDistinct("training_run_id"), best_models=F.count_if(F.col("is_best")),
             completed_runs=F.countDistinct(F.when(F.col("status") == "complete", F.col("training_run_id")))),
        rows(datasets, structured=F.count_if(F.col("data_category") == "structured"),
             unstructured=F.count_if(F.col("data_category") == "unstructured")),
        rows(use_cases, active_use_cases=F.count_if(active), parent_projects=F.countDistinct("project_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def profile_shape(df: DataFrame) -> DataFrame:
    """Rows, columns and share of missing cells."""
    missing = [F.sum(F.col(c).isNull().cast("bigint")) for c in df.columns]
    width = len(df.columns)
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(reduce(lambda a, b: a + b, missing), F.lit(0)).alias("missing"))
    return one.select(
        "rows", F.lit(width).cast("bigint").alias("columns"),
        (F.col("missing") / F.greatest(F.col("rows") * width, F.lit(1))).alias("missing_cells_ratio"))


def profile_target(df: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """One row per class with the target's type, cardinality, missing ratio and imbalance.

    Imbalance is the largest over the smallest count of the classes shown.  With ``top`` only the most frequent
    classes are shown; ``hidden_classes`` and ``hidden_rows`` say what is left out.  The class table is
    pre-aggregated and read once more for the totals.
    """
    dtype = dict(df.dtypes)[target]
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.count("class").alias("unique_count"),
        (F.coalesce(F.sum(F.when(F.col("class").isNull(), F.col("n"))), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("missing_ratio"),
        F.coalesce(F.sum(F.when(F.col("class").isNotNull(), F.col("n"))), F.lit(0)).alias("_present"))
    best = counts.where("class is not null")
    best = best.orderBy(F.col("n").desc(), "class").limit(top) if top is not None else best
    spread = best.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"), F.count(F.lit(1)).alias("_shown"), F.sum("n").alias("_rows"))
    return best.join(F.broadcast(totals)).join(F.broadcast(spread)).select(
        F.lit(target).alias("name"), F.lit(dtype).alias("dtype"), "unique_count", "missing_ratio", "class", "n",
        "imbalance_ratio", (F.col("unique_count") - F.col("_shown")).alias("hidden_classes"), (F.col("_present") - F.col("_rows")).alias("hidden_rows"))


def _column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, kind, n_distinct, n_null, sample) per column.

    Values are counted per (column, value) first, so a constant or null-heavy column
    leaves the map side as one row per task.  Columns go in batches to bound the row
    multiplication of one scan.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def kind(name: str) -> str:
        t = kinds[name]
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return "integer"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return "datetime"
        return "string"

    batches = [list(columns[i:i + COLUMNS_PER_PASS]) for i in range(0, len(columns), COLUMNS_PER_PASS)]
    parts = []
    for batch in batches:
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kind(c)).alias("kind"),
                                   F.col(c).cast("string").alias("v")) for c in batch])
        parts.append(df.select(F.inline(cells)))
    values = reduce(DataFrame.unionByName, parts).groupBy("name", "kind", "v").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("name", "kind").agg(
        F.count("v").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.sum("n").alias("rows"), F.min("v").alias("sample_value"))


def profile_features(df: DataFrame, target: str) -> DataFrame:
    """One row per feature: kind and the high-cardinality / constant / mostly-missing flags.

    ``kind_count`` repeats how many features share the kind (numeric, datetime, categorical).
    """
    features = [c for c in df.columns if c != target]
    stats = _column_stats(df, features)
    group = (F.when(F.col("kind").isin("integer", "number"), "numeric").when(F.col("kind") == "datetime", "datetime")
             .otherwise("categorical"))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tally = {"numeric": 0, "datetime": 0, "categorical": 0}
    for c in features:
        t = kinds[c]
        numeric = isinstance(t, T.NumericType)
        dated = isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))
        tally["numeric" if numeric else "datetime" if dated else "categorical"] += 1
    how_many = F.create_map(*[x for k, n in tally.items() for x in (F.lit(k), F.lit(n).cast("bigint"))])
    rows = F.greatest(F.col("rows"), F.lit(1))
    return stats.withColumn("kind", group).select(
        "name", "kind", F.element_at(how_many, F.col("kind")).alias("kind_count"), "n_distinct",
        (F.col("n_distinct") > F.least(F.lit(50.0), rows * 0.5)).alias("high_cardinality"),
        (F.col("n_distinct") <= 1).alias("constant"), (F.col("n_null") / rows >= 0.8).alias("mostly_missing"))


def column_schema(df: DataFrame) -> DataFrame:
    """One row per column: logical type, percent null and the smallest value as a sample."""
    stats = _column_stats(df, df.columns)
    return stats.select("name", F.col("kind").alias("data_type"),
                        F.round(F.col("n_null") / F.greatest(F.col("rows"), F.lit(1)) * 100, 2).alias("null_pct"), "sample_value")


def class_labels(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels with their positions from 0 in ascending order: (label, position), one row each.

    Labels are dealt out by ranges and written once (eager); counts per range give where its positions begin, so a
    column of ids does not meet in one task.
    """
    distinct = df.select(F.col(label).alias("label")).where("label is not null").distinct()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = distinct.repartitionByRange(tasks, "label").sortWithinPartitions("label").select(
        "label", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at"))
    placed = materialize(placed, "labels")
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select("_part", before.alias("_begin"))
    return placed.join(begins, "_part").select("label", (F.col("_begin") + F.col("_at")).alias("position"))


def profile_documents(files: DataFrame, supported: Sequence[str]) -> DataFrame:
    """File count and bytes per extension, with whether a parser handles it; none handled is an error."""
    if not supported:
        raise ValueError("no supported extensions given")
    per = files.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("bigint").alias("bytes"))
    return per.withColumn("supported", F.col("extension").isin(list(supported)))


def require_supported(profile: DataFrame) -> DataFrame:
    """Check (eagerly, on the small profile) that at least one extension can be parsed."""
    if profile.where("supported").limit(1).count() == 0:
        raise ValueError("no supported document types found")
    return profile


def audit_constraints(df: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """Violations per rule.

    Rules: ``{"rule", "kind", "column" | "columns", ...}`` with kind ``not_null``,
    ``allowed`` (values), ``range`` (low, high), ``unique`` and ``foreign`` (parent, parent_key).
    All row-wise rules share one scan.
    """
    def violation(rule: dict) -> Column | None:
        if rule["kind"] == "not_null":
            return F.col(rule["column"]).isNull()
        if rule["kind"] == "allowed":
            return ~F.col(rule["column"]).isin(list(rule["values"]))
        if rule["kind"] == "range":
            return ~F.col(rule["column"]).between(rule["low"], rule["high"])
        return None

    plain = {r["rule"]: violation(r) for r in rules if violation(r) is not None}
    parts = []
    if plain:
        one = df.agg(*[F.count_if(v).alias(n) for n, v in plain.items()])
        parts.append(one.unpivot([], list(plain), "rule", "violations"))
    for rule in rules:
        name = F.lit(rule["rule"]).alias("rule")
        if rule["kind"] == "unique":
            extra = df.groupBy(*rule["columns"]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            parts.append(extra.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations")).select(name, "violations"))
        elif rule["kind"] == "foreign":
            parent = rule["parent"].select(F.col(rule["parent_key"]).alias(rule["column"]))
            orphan = df.where(F.col(rule["column"]).isNotNull()).join(parent, rule["column"], "left_anti")
            parts.append(orphan.agg(F.count(F.lit(1)).alias("violations")).select(name, "violations"))
        elif rule["rule"] not in plain:
            raise ValueError(f"unknown rule kind {rule['kind']!r}")
    return reduce(DataFrame.unionByName, parts)


def segment_lift(df: DataFrame, label: Column, segments: Sequence[str]) -> DataFrame:
    """Positive rate per segment value against the whole table: lift and 2×2 chi-square.

    Each row counts once per segment column, pre-aggregated by (segment, value); the
    one-row totals are the only broadcast side.
    """
    marked = df.withColumn("_y", label.cast("int"))
    cells = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(s).cast("string").alias("value")) for s in segments])
    per = marked.select("_y", F.inline(cells)).groupBy("segment", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_y").cast("bigint").alias("positives"))
    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").cast("bigint").alias("p"))
    both = per.join(F.broadcast(totals))
    a, b = F.col("positives").cast("double"), (F.col("rows") - F.col("positives")).cast("double")
    c, d = (F.col("p") - F.col("positives")).cast("double"), (F.col("n") - F.col("rows") - F.col("p") + F.col("positives")).cast("double")
    rate, base = F.col("positives") / F.col("rows"), F.col("p") / F.col("n")
    margin = (a + b) * (c + d) * (a + c) * (b + d)
    return both.select(
        "segment", "value", "rows", rate.alias("positive_rate"), base.alias("baseline_rate"),
        F.try_divide(rate, base).alias("lift"),
        F.coalesce(F.try_divide(F.col("n") * F.pow(a * d - b * c, F.lit(2)), margin), F.lit(0.0)).alias("chi_square"))


# Column order of the metrics in reports.
METRIC_ORDER = ("roc_auc", "accuracy", "balanced_accuracy", "mcc", "f1", "precision", "recall")


def pivot_metrics(runs: DataFrame, metric_order: Sequence[str] = METRIC_ORDER) -> DataFrame:
    """One row per experiment, one column per metric.

    ``runs``: run_id, experiment_id, primary_metric, primary_metric_value and the maps
    ``evaluation`` and ``secondary_metrics``; looked up in that order.  The column list
    is fixed, so no shuffle is needed.
    """
    def value(name: str) -> Column:
        own = F.when(F.col("primary_metric") == name, F.col("primary_metric_value"))
        other = F.coalesce(F.try_element_at("evaluation", F.lit(name)), F.try_element_at("secondary_metrics", F.lit(name)))
        return F.when(F.col("primary_metric") == name, own).otherwise(other).alias(name)

    return runs.select("run_id", "experiment_id", *[value(m) for m in metric_order])


def round_has_success(runs: DataFrame) -> DataFrame:
    """Whether any experiment of a round completed."""
    return runs.groupBy("run_id", "round").agg(F.bool_or(F.col("status") == "completed").alias("has_success"))


def rag_run_summary(trials: DataFrame) -> DataFrame:
    """Trials, mean scores, exact 95th percentile latency and cost per run."""
    sums = trials.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("trials"), F.avg("faithfulness").alias("mean_faithfulness"),
        F.avg("context_recall").alias("mean_context_recall"), F.sum("cost").cast("double").alias("cost"))
    return sums.join(exact_percentile(trials, ["run_id"], "latency_ms", 0.95, "p95_latency_ms"), "run_id", "left")


def min_rows_gate(counts: DataFrame, minimum: dict[str, int] | None = None) -> DataFrame:
    """(table, task, rows) → whether the task's minimum is reached; unknown tasks need 100 rows."""
    need = F.create_map(*[x for k, v in (minimum or MIN_ROWS).items() for x in (F.lit(k), F.lit(v).cast("bigint"))])
    least = F.coalesce(F.try_element_at(need, F.col("task")), F.lit(100))
    return counts.withColumn("min_rows", least.cast("bigint")).withColumn(
        "gate", F.when(F.col("rows") >= least, "ready").otherwise("too small"))


def round_summaries(statuses: DataFrame, metrics: DataFrame) -> DataFrame:
    """Experiments of each round with status and score, rounds in numeric order.

    One row per experiment with the round's experiment count, rather than one nested
    list per round: a round with very many experiments then stays spread over tasks.
    """
    keys = ["run_id", "round", "experiment_id"]
    rows = statuses.join(metrics, keys, "left").withColumn("round", F.col("round").cast("bigint"))
    sizes = statuses.groupBy("run_id", F.col("round").cast("bigint").alias("round")).agg(F.count(F.lit(1)).alias("experiments"))
    return rows.join(sizes, ["run_id", "round"]).orderBy("run_id", "round", "experiment_id")
