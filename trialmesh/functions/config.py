"""Column functions over settings, payloads, plans and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.functions.text import _c

# Retrieval choices and the bounds of their settings.
PIPELINES = ("semantic_only", "lexical_bm25", "hybrid_rrf")
EXPANSIONS = ("none", "multi_query_expansion", "hyde", "query_decompose")
RERANKERS = ("pass_reranker", "rankgpt")


def clamp_config(df: DataFrame) -> DataFrame:
    """Retrieval settings forced into their ranges, unknown choices replaced by the default."""
    def bound(value: Column, low, high) -> Column:
        return F.greatest(F.lit(low), F.least(value, F.lit(high)))

    def choice(name: str, allowed: Sequence[str]) -> Column:
        return F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(allowed[0]).alias(name)

    top = bound(F.coalesce("top_k", F.lit(3)).cast("int"), 1, 10)
    final = F.coalesce(F.col("final_top_k").cast("int"), F.least(top, F.lit(5)))
    own = {"top_k", "final_top_k", "filter_threshold", "temperature", "pipeline_type", "query_expansion_method", "reranker_type"}
    return df.select(
        *[c for c in df.columns if c not in own], top.alias("top_k"),
        F.greatest(F.lit(1), F.least(F.lit(8), final, top)).alias("final_top_k"),
        bound(F.coalesce("filter_threshold", F.lit(0.2)).cast("double"), 0.05, 0.45).alias("filter_threshold"),
        bound(F.coalesce("temperature", F.lit(0.0)).cast("double"), 0.0, 0.3).alias("temperature"),
        choice("pipeline_type", PIPELINES), choice("query_expansion_method", EXPANSIONS), choice("reranker_type", RERANKERS))


def period_start(ts: str | Column) -> Column:
    """First instant of the month."""
    return F.trunc(_c(ts).cast("date"), "month").cast("timestamp_ntz")


def run_key(ts: str | Column, ident: str | Column) -> Column:
    """``run_<stamp>_<8 hex>``; the hex comes from the id, so it repeats."""
    return F.concat(F.lit("run_"), F.date_format(_c(ts), "yyyyMMdd_HHmmss"), F.lit("_"),
                    F.left(F.md5(_c(ident).cast("string")), F.lit(8)))


def storage_key(session: Column, slug: Column, file: Column) -> Column:
    return F.concat_ws("/", session, slug, file)


def session_key(user: Column, workspace: Column, use_case: Column) -> Column:
    return F.concat_ws("_", user, workspace, use_case)


def decode_payload(payload: str | Column, fields: Column) -> Column:
    """JSON text of an entry: the fields without payload, the payload when valid, else ``{"raw": …}``."""
    text = _c(payload)
    return (F.when(text.isNull() | (text == ""), F.to_json(fields))
            .when(F.try_parse_json(text).isNotNull(), text)
            .otherwise(F.to_json(F.struct(text.alias("raw")))))


def coerce_value(col: str | Column) -> Column:
    """Struct of int, double, text and the type that applied; the other fields are null."""
    text = _c(col)
    whole = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    real = F.when(text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(text).try_cast("double"))
    kind = F.when(whole.isNotNull(), "int").when(real.isNotNull(), "double").when(text.isNotNull(), "text")
    return F.struct(whole.alias("as_int"), F.when(whole.isNull(), real).alias("as_double"),
                    F.when(whole.isNull() & real.isNull(), text).alias("as_text"), kind.alias("kind"))


def merge_settings(existing: str | Column, updates: str | Column, allowed: Sequence[str], keep_blank: bool) -> Column:
    """Map of the allowed keys: the trimmed update, else the stored value, else empty.

    ``keep_blank=False`` (secrets) ignores blank updates; ``True`` (config) lets them clear a value.
    """
    def value(key: str) -> Column:
        new = F.trim(F.try_element_at(_c(updates), F.lit(key)))
        old = F.coalesce(F.try_element_at(_c(existing), F.lit(key)), F.lit(""))
        if keep_blank:
            return F.when(F.array_contains(F.map_keys(_c(updates)), key), F.coalesce(new, F.lit(""))).otherwise(old)
        return F.coalesce(F.nullif(new, F.lit("")), old)

    return F.create_map(*[x for k in allowed for x in (F.lit(k), value(k))])


def configured(settings: Column) -> Column:
    return F.forall(F.map_values(settings), lambda v: v != "")


def answers_to_text(payload: str | Column) -> Column:
    """Answers (object, list or text) as lines; else the confirmation, approval or choice; else empty."""
    doc = F.try_parse_json(_c(payload))
    shape = F.schema_of_variant(F.try_variant_get(doc, "$.answers", "variant"))
    raw = F.get_json_object(_c(payload), "$.answers")

    def spoken(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        text = F.try_variant_get(v, "$", "string")
        return F.when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None").otherwise(text)

    listed = F.from_json(raw, "array<variant>")
    keyed = F.map_values(F.from_json(raw, "map<string,variant>"))
    said = (F.when(shape.startswith("OBJECT"), F.array_join(F.transform(keyed, spoken), "\n"))
            .when(shape.startswith("ARRAY"), F.array_join(F.transform(listed, spoken), "\n")).otherwise(raw))

    def flag(path: str, yes: str, no: str) -> Column:
        v = F.get_json_object(_c(payload), path)
        return F.when(v == "true", yes).when(v.isNotNull(), no)

    choice = F.concat(F.lit("Choice: "), F.get_json_object(_c(payload), "$.choice"))
    return F.coalesce(said, flag("$.confirmed", "Confirmed.", "Not confirmed."),
                      flag("$.approved", "Approved.", "Not approved."), choice, F.lit(""))


def secondary_metrics(metrics: str | Column, primary: str | Column) -> Column:
    """The metric map without its primary entry and without missing values."""
    return F.map_filter(_c(metrics), lambda k, v: (k != _c(primary)) & v.isNotNull())


# Words in a goal, the metric, prompt style and result counts they lead to.
GOAL_WORDS = {
    "hallucination": ("hallucination", "hallucinations", "hallucinate", "made up", "make up", "unsupported", "faithful",
                      "grounded", "trust", "factual", "cite", "citations"),
    "coverage": ("recall", "coverage", "broad", "find", "missing", "miss", "complete", "comprehensive"),
    "precision": ("precision", "noise", "focused", "exact", "irrelevant", "distracting"),
    "generation": ("answer", "generation", "rouge", "quality", "concise", "readable", "clarity"),
    "judge": ("coherence", "consistency", "fluency", "relevance", "llm judge", "llm-as-judge"),
}
GOAL_OUTCOMES = (
    (("hallucination", "coverage"), ("retrieval_f1", "strict_grounding", (3, 4, 5))),
    (("hallucination",), ("retrieval_precision", "strict_grounding", (2, 3, 4))),
    (("coverage",), ("retrieval_recall", "evidence_first", (4, 5, 7))),
    (("precision",), ("retrieval_precision", "strict_grounding", (2, 3, 4))),
    (("generation",), ("rouge", "grounded_concise", (3, 4, 5))),
    (("judge",), ("g_eval", "strict_grounding", (2, 3, 4))),
    ((), ("retrieval_f1", "grounded_concise", (3, 5))),
)
JUDGE_WORDS = {
    "coherence": ("readable", "clarity", "clear", "flow", "coherent", "coherence"),
    "fluency": ("fluent", "fluency", "natural", "polished"),
    "all": ("overall", "balanced", "quality", "judge", "g-eval", "geval"),
}


def _mentions(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def goal_to_metric(goal: str | Column) -> Column:
    """Struct of primary metric, prompt style, result counts and judge dimensions for a goal text."""
    text = F.lower(_c(goal))
    picked = None
    for needs, (metric, style, tops) in reversed(GOAL_OUTCOMES):
        row = F.struct(F.lit(metric).alias("primary_metric"), F.lit(style).alias("prompt_style"),
                       F.array(*[F.lit(k) for k in tops]).alias("top_k"))
        if not needs:
            picked = row
            continue
        rule = _mentions(text, GOAL_WORDS[needs[0]])
        for other in needs[1:]:
            rule = rule & _mentions(text, GOAL_WORDS[other])
        picked = F.when(rule, row).otherwise(picked)
    some = F.concat(F.array(F.lit("consistency"), F.lit("relevance")), *[
        F.when(_mentions(text, JUDGE_WORDS[d]), F.array(F.lit(d))).otherwise(F.array().cast("array<string>"))
        for d in ("coherence", "fluency")])
    every = F.array(*[F.lit(d) for d in ("coherence", "consistency", "fluency", "relevance")])
    dims = F.when(_mentions(text, JUDGE_WORDS["all"]), every).otherwise(F.array_distinct(some))
    return F.struct(picked["primary_metric"].alias("primary_metric"), picked["prompt_style"].alias("prompt_style"),
                    picked["top_k"].alias("top_k"), dims.alias("judge_dimensions"))


# Candidate metrics per task, the first is the primary one.
TASK_METRICS = {
    "regression": ("root_mean_squared_error", "mean_absolute_error", "r2"),
    "multiclass_classification": ("accuracy", "f1_macro", "balanced_accuracy"),
    "binary_classification": ("roc_auc", "precision", "recall"),
}
RECALL_WORDS = ("recall", "miss", "churn")


def infer_task(dtype: str | Column, unique_count: str | Column) -> Column:
    """Numeric with more than 20 values: regression; up to 2 values: binary; else multiclass."""
    numeric = _c(dtype).rlike("^(int|float|bigint|double|smallint|tinyint|decimal)")
    return (F.when(numeric & (_c(unique_count) > 20), "regression").when(_c(unique_count) <= 2, "binary_classification")
            .otherwise("multiclass_classification"))


def metric_candidates(task: Column, kpi: str | Column) -> Column:
    """Metric names for a task; a binary task that must not miss positives leads with f1."""
    names = {k: F.array(*[F.lit(m) for m in v]) for k, v in TASK_METRICS.items()}
    wary = F.array(F.lit("f1"), *[F.lit(m) for m in TASK_METRICS["binary_classification"][1:]])
    return (F.when(task == "regression", names["regression"]).when(task == "multiclass_classification", names["multiclass_classification"])
            .when(_mentions(F.lower(_c(kpi)), RECALL_WORDS), wary).otherwise(names["binary_classification"]))


REQUEST_SCHEMA = """
business_problem string, domain string, constraint_summary string, max_experiment_per_round int, num_round int,
ml_problems array<struct<id string, name string, description string, category string, engine string,
  autogluon_task_type string, hypothesis_evidence array<string>, business_kpis array<string>,
  inferred_columns map<string,struct<inferred_name string, type string, reason string>>,
  dataset struct<description string, target_column struct<inferred_name string, type string, reason string>,
    source struct<s3_path string, row_count bigint>>>>"""


def flatten_request(df: DataFrame, column: str = "request") -> DataFrame:
    """One row per sub-problem of a request: nested target and source, joined KPIs and the route.

    The target is the stated one, else the inferred column in role ``label_column``,
    ``target_column`` or the first role listed; the other roles become ``extra_columns``.
    """
    parsed = df.withColumn("_r", F.from_json(column, REQUEST_SCHEMA))
    rows = parsed.select(*[c for c in df.columns if c != column], "_r", F.posexplode("_r.ml_problems").alias("position", "p"))
    roles = F.coalesce("p.inferred_columns", F.create_map().cast("map<string,struct<inferred_name:string,type:string,reason:string>>"))
    names = F.map_keys(roles)
    role = (F.when(F.array_contains(names, "label_column"), "label_column")
            .when(F.array_contains(names, "target_column"), "target_column").otherwise(F.try_element_at(names, F.lit(1))))
    extra = F.map_filter(roles, lambda k, v: k != role)
    category, engine = (F.lower(F.coalesce(f"p.{c}", F.lit(""))) for c in ("category", "engine"))
    route = (F.when((category == "traditional") & (engine == "autogluon"), "tabular")
             .when((category == "genai") & (engine == "autorag"), "retrieval").otherwise("skipped"))
    return rows.select(
        *[c for c in df.columns if c != column], "position", F.col("p.id").alias("problem_id"), F.col("p.name").alias("name"),
        F.coalesce("p.dataset.target_column.inferred_name", F.try_element_at(roles, role)["inferred_name"]).alias("target"),
        F.array_join(F.transform(F.map_entries(extra), lambda e: F.concat_ws("=", e["key"], e["value"]["inferred_name"])), ",").alias("extra_columns"),
        F.col("p.dataset.source.s3_path").alias("s3_path"), F.col("p.dataset.source.row_count").alias("row_count"),
        F.array_join(F.coalesce("p.business_kpis", F.array().cast("array<string>")), "; ").alias("business_kpi"), route.alias("route"),
        F.when(route == "skipped", F.concat(F.lit("Unsupported category/engine: "), category, F.lit("/"), engine)).alias("reason"))
