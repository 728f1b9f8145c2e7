"""Set operations over values, hits, plans and messages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# What a plan may contain.
ALLOWED_INTENTS = ("fast_baseline", "quality_search", "balanced_ensemble", "deployable_simple", "imbalance_aware",
                   "threshold_tuning", "regression_quality", "multiclass_quality")
ALLOWED_CONFIG = ("presets", "time_limit", "fit_weighted_ensemble", "calibrate_decision_threshold",
                  "included_model_families", "infer_limit", "num_bag_folds", "num_stack_levels", "save_bag_folds")
SUPPORTED_METRICS = {
    "binary_classification": ("f1", "recall", "precision", "roc_auc", "accuracy"),
    "multiclass_classification": ("accuracy", "f1_macro", "balanced_accuracy"),
    "regression": ("root_mean_squared_error", "mean_absolute_error", "r2"),
}


def supported_values(found: DataFrame, runnable: DataFrame) -> DataFrame:
    """Values present on both sides."""
    return found.intersect(runnable)


def union_search_hits(batches: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """All hits with the query they came from; hits without a url are dropped."""
    tagged = [df.where(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("query_context", F.lit(tag))
              for tag, df in batches]
    return reduce(DataFrame.unionByName, tagged)


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each non-empty value once, with the position it was first seen at."""
    return df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(value).agg(F.min(order).alias("first_seen"))


def validate_plans(plans: DataFrame, expected: int) -> DataFrame:
    """Whether each round plan is valid.

    ``plans``: one row per experiment with plan_id, task_type, metric, intent and
    ``config`` (map of text).  A plan needs ``expected`` experiments, known intents,
    known config keys, a time limit of 1…900 and a fold count other than 1.
    """
    keys = F.array(*[F.lit(k) for k in ALLOWED_CONFIG])
    limit = F.coalesce(F.try_element_at("config", F.lit("time_limit")).try_cast("int"), F.lit(300))
    folds = F.coalesce(F.try_element_at("config", F.lit("num_bag_folds")).try_cast("int"), F.lit(0))
    metric_ok = reduce(lambda a, b: a | b, [
        (F.col("task_type") == task) & F.col("metric").isin(*names) for task, names in SUPPORTED_METRICS.items()])
    good = (F.col("intent").isin(*ALLOWED_INTENTS) & (F.size(F.array_except(F.map_keys("config"), keys)) == 0)
            & limit.between(1, 900) & (folds != 1))
    checks = plans.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("experiments"), F.bool_and(F.coalesce(good, F.lit(False))).alias("experiments_valid"),
        F.bool_and(F.coalesce(metric_ok, F.lit(False))).alias("decision_valid"))
    return checks.withColumn("plan_valid", F.col("experiments_valid") & (F.col("experiments") == expected))


def merge_messages(existing: DataFrame, incoming: DataFrame, position: Sequence[str]) -> DataFrame:
    """Union of two message sets without duplicates, keeping first positions.

    A message repeats another when role, agent (not for users) and normalised content
    agree.  Scanning in order, a copy replaces the kept message when it brings a card
    type or card data the kept one lacks.  The outcome has a closed form: the first copy
    with both; else, when copies with only a type and only data take turns, the first of
    the last run; else the first copy.  Each part is an aggregate of positions per key, so
    a message repeated very often is never gathered.
    Keys hold a hash of the content, so long messages are not shuffled as keys.
    """
    both = existing.withColumn("_set", F.lit(0)).unionByName(incoming.withColumn("_set", F.lit(1)))
    content = F.lower(F.regexp_replace(F.trim(F.coalesce("content", F.lit("")), F.lit(" \t\r\n")), r"\s+", " "))
    agent = F.when(F.col("role") == "user", F.lit("")).otherwise(F.coalesce("agent", F.lit("")))
    keys = ["conv_id", "role", "_agent", "_content"]
    place = F.struct("_set", *position)

    def has(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    rows = both.withColumn("_agent", agent).withColumn("_content", F.md5(content)).withColumn("_at", place).withColumn(
        "_t", has("card_type")).withColumn("_d", has("card_data"))
    lean = rows.select(*keys, "_at", "_t", "_d")

    both_set, only_t, only_d = F.col("_t") & F.col("_d"), F.col("_t") & ~F.col("_d"), F.col("_d") & ~F.col("_t")
    facts = lean.groupBy(*keys).agg(
        F.min("_at").alias("_first"), F.min(F.when(both_set, F.col("_at"))).alias("_full"),
        F.min(F.when(only_t | only_d, F.col("_at"))).alias("_some"),
        F.max(F.when(only_t, F.col("_at"))).alias("_last_t"), F.max(F.when(only_d, F.col("_at"))).alias("_last_d"))
    turns = facts.where("_full is null and _last_t is not null and _last_d is not null").select(
        *keys, (F.col("_last_t") > F.col("_last_d")).alias("_ends_t"), F.least("_last_t", "_last_d").alias("_bound"))
    tail = lean.where("_t or _d").join(turns, keys).where((F.col("_t") == F.col("_ends_t")) & (F.col("_at") > F.col("_bound"))).groupBy(
        *keys).agg(F.min("_at").alias("_tail"))
    final = facts.join(tail, keys, "left").select(*keys, "_first", F.coalesce("_full", "_tail", "_some", "_first").alias("_at"))
    kept = rows.join(final, [*keys, "_at"])
    return kept.select("conv_id", *[F.col(f"_first.{c}").alias(f"first_{c}") for c in position],
                       F.col("_first._set").alias("first_set"), "role", "agent", "content", "card_type", "card_data")
