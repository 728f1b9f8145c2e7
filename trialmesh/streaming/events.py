"""The append-only result log, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialmesh.functions.config import secondary_metrics
from trialmesh.operators.profile import usage_columns
from trialmesh.operators.ranking import latest_per_key
from trialmesh.scale import rank_rows, top_rows

WATERMARK = "7 days"
ROUTING = ("session_id", "run_id", "designer", "round", "experiment_id", "event_type")
LOG_SCHEMA = "id bigint, fields map<string,string>, payload string"


def _envelope(df: DataFrame) -> DataFrame:
    routing = [c for c in ROUTING if c in df.columns]
    fields = F.map_filter(F.create_map(*[x for c in routing for x in (F.lit(c), F.col(c).cast("string"))]),
                          lambda k, v: v.isNotNull())
    body = [c for c in df.columns if c != "id"]
    return df.select("id", fields.alias("fields"), F.to_json(F.struct(*body)).alias("payload"))


def publish_events(df: DataFrame, path: str, checkpoint: str | None = None) -> str:
    """Append entries (id, routing fields as text without nulls, body as JSON) to the log; returns the path.

    A streaming frame needs ``checkpoint`` and is drained up to the data present now.
    """
    rows = _envelope(df)
    if df.isStreaming:
        rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
            "append").trigger(availableNow=True).start().awaitTermination()
    else:
        rows.write.mode("append").parquet(path)
    return path


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def poll_events(log: DataFrame, after: int, count: int, session: str) -> DataFrame:
    """Next ``count`` entries after a cursor, then only the session's; plus one row with the new cursor.

    The cursor also moves over entries of other sessions.
    """
    page = log.where(F.col("id") > after).orderBy("id").limit(count).select("id", "session_id", "payload")
    mine = page.where(F.col("session_id") == session).select(F.lit("event").alias("kind"), "id", "payload")
    cursor = page.agg(F.coalesce(F.max("id"), F.lit(after)).cast("bigint").alias("id")).select(
        F.lit("cursor").alias("kind"), "id", F.lit(None).cast("string").alias("payload"))
    return mine.unionByName(cursor)


PAYLOAD_SCHEMA = """session_id string, run_id string, designer string, round string, experiment_id string, event_type string,
problem_id string, config map<string,string>, metrics map<string,string>"""


def normalize_results(log: DataFrame) -> DataFrame:
    """Experiment rows of a log (id, payload): engine, problem, round, intent, metric and secondary metrics."""
    p = log.select("id", F.from_json("payload", PAYLOAD_SCHEMA).alias("p")).where("p.experiment_id is not null")

    def first_known(key: str, default: str) -> Column:
        return F.coalesce(F.try_element_at("p.config", F.lit(key)), F.try_element_at("p.metrics", F.lit(key)), F.lit(default))

    said = F.lower(F.coalesce("p.designer", F.lit("")))
    engine = F.when(said.contains("autorag"), "autorag").when(said.contains("autogluon"), "autogluon").otherwise("other")
    from_run = F.regexp_extract("p.run_id", r"(?:^|_)(prob_[0-9]+)(?:_|$)", 1)
    metric = F.coalesce(F.try_element_at("p.metrics", F.lit("primary_metric")),
                        F.try_element_at("p.config", F.lit("primary_metric")), F.lit("primary_metric"))
    value = F.coalesce(F.try_element_at("p.metrics", F.lit("primary_metric_value")), F.try_element_at("p.metrics", metric))
    as_map = lambda key: F.from_json(F.try_element_at("p.metrics", F.lit(key)), "map<string,double>")
    rows = p.select(
        "id", F.col("p.session_id").alias("session_id"), F.col("p.run_id").alias("run_id"), engine.alias("engine"),
        F.coalesce("p.problem_id", F.nullif(from_run, F.lit("")), F.lit("problem")).alias("problem_id"),
        F.coalesce("p.round", F.lit("N/A")).alias("round"), F.col("p.experiment_id").alias("experiment_id"),
        first_known("intent", "N/A").alias("intent"), metric.alias("primary_metric"),
        value.try_cast("double").alias("primary_metric_value"), as_map("secondary_metrics").alias("_sec"), as_map("evaluation").alias("_eval"))
    rest = F.coalesce("_sec", secondary_metrics("_eval", "primary_metric"), F.create_map().cast("map<string,double>"))
    return rows.withColumn("secondary_metrics", F.to_json(rest)).drop("_sec", "_eval")


def stream_results(spark: SparkSession, path: str, session: str | None, out: str, checkpoint: str,
                   schema: str = "id bigint, payload string") -> DataFrame:
    """Continuous form of :func:`normalize_results`: consumes the log files under ``path`` once each."""
    log = spark.readStream.schema(schema).parquet(path)
    rows = normalize_results(log)
    if session is not None:
        rows = rows.where(F.col("session_id") == session)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def dedupe_events(df: DataFrame, id_col: str, time_col: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """Each id once: the first by ``order`` (default: the time column).

    A stream keeps the first that arrives, and forgets ids once they are older than the watermark.
    """
    if df.isStreaming:
        return df.withWatermark(time_col, WATERMARK).dropDuplicatesWithinWatermark([id_col])
    return top_rows(df, [id_col], [F.col(c).asc_nulls_last() for c in order or [time_col]])


def run_completion(events: DataFrame, statuses: DataFrame) -> DataFrame:
    """Per session: whether an end event arrived, and the step the progress bar stands at."""
    engine = F.lower(F.coalesce("designer", F.lit(""))).contains("autogluon")
    seen = events.groupBy("session_id").agg(
        F.bool_or(F.coalesce(F.col("event_type") == "end", F.lit(False))).alias("complete"),
        F.bool_or(engine).alias("_engine"))
    status = F.col("status")
    step = (F.when(status == "completed", 2).when(status == "failed", 0).when(F.col("complete") | F.col("_engine"), 2)
            .when(status.isin("queued", "running"), 1).otherwise(0))
    return seen.join(statuses, "session_id", "left").select("session_id", "complete", step.alias("step_index"))


def merge_state(updates: DataFrame, key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Fold partial updates: per key and field the newest value that is not missing."""
    return updates.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields], F.max(order).alias(order))


def expire_keys(df: DataFrame, key: str, written: str, at: datetime, ttl_days: int = 7, tie: Sequence[str] = ()) -> DataFrame:
    """Last write per key, gone ``ttl_days`` after it; a new write restarts the clock."""
    moment = F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    newest = latest_per_key(df.where(F.col(written) <= moment), key, [written, *tie])
    return newest.where(F.col(written) + F.make_dt_interval(days=F.lit(ttl_days)) > moment)


def run_progress(heartbeats: DataFrame, limit: float = 300.0, total: int = 5) -> DataFrame:
    """Newest heartbeat per experiment: remaining seconds, percent done, terminal flag."""
    now = latest_per_key(heartbeats, "experiment_id", ["seq"])
    done = F.col("status").isin("completed", "failed") if "status" in heartbeats.columns else F.col("completed") >= total
    return now.select(
        "experiment_id", "seq", F.round("elapsed", 3).alias("elapsed_seconds"),
        F.greatest(F.lit(0.0), F.lit(limit) - F.col("elapsed")).alias("remaining_seconds"), "completed",
        F.round(F.col("completed") / total * 100, 1).alias("progress_percent"), done.alias("is_terminal"))


def usage_by_month(events: DataFrame) -> DataFrame:
    """Usage per organisation and month.  On a stream this keeps one state row per pair; use update or complete mode."""
    if events.isStreaming:
        events = events.withWatermark("created_at", WATERMARK)
    month = F.date_format("created_at", "yyyy-MM")
    return events.groupBy("organization_id", month.alias("month")).agg(*usage_columns())


def append_state(updates: DataFrame, key: str, order: str, item: str, scalars: Sequence[str], page_size: int = 1000) -> DataFrame:
    """Per key the items in order and the newest scalars.

    Items come in pages of ``page_size`` order values, so a very long list is several rows.
    """
    page = F.floor(F.col(order) / page_size).cast("bigint")
    lists = updates.groupBy(key, page.alias("page")).agg(F.sort_array(F.collect_list(F.struct(order, item))).alias("_l"))
    last = updates.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars])
    return lists.join(last, key).select(key, "page", F.col(f"_l.{item}").alias("items"), *scalars)


def stream_append_state(updates: DataFrame, key: str, order: str, item: str, scalars: Sequence[str], folder: str, checkpoint: str,
                        page_size: int = 1000) -> DataFrame:
    """Streaming :func:`append_state`; returns the pages after all input that is there, also when nothing is new.

    A micro-batch only adds its rows to the log below ``folder``, in a folder named after the batch that a retry
    overwrites; lists are put in ``order`` when they are read, so an item that arrives late stands where it belongs
    and no task holds more than a page of a key.
    """
    spark = updates.sparkSession
    rows = updates.select(key, order, item, *scalars)

    def add(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
    log = spark.read.schema(rows.schema).option("recursiveFileLookup", True)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return append_state(log.parquet(folder) if there else spark.createDataFrame([], rows.schema), key, order, item, scalars, page_size)


def join_completed(completions: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Completion events with the stored output they name; null when it is missing.  Works stream–static."""
    return completions.join(outputs, key, "left")


def stream_join_completed(completions: DataFrame, outputs: DataFrame, key: str, done: str, stored: str, within: str, late: str,
                          out: str, checkpoint: str) -> DataFrame:
    """Completion events with the outputs of the same key stored up to ``within`` after them, both as streams.

    ``done`` and ``stored`` are the times; columns other than the key have names of their own.  Rows wait in the
    state until the watermark (the older of both streams' newest times less ``late``) is past their last match.
    An event without output comes with nulls once no output can follow; until then it is not in the result.
    """
    left = completions.withWatermark(done, late).alias("c")
    right = outputs.withColumnRenamed(key, f"_{key}").withWatermark(stored, late)
    bound = (F.col(f"c.{key}") == F.col(f"_{key}")) & (F.col(stored) >= F.col(done)) & (F.col(stored) <= F.col(done) + F.expr(f"INTERVAL {within}"))
    joined = left.join(right, bound, "left_outer").drop(f"_{key}")
    joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    return completions.sparkSession.read.schema(joined.schema).parquet(out)


# Fixed value: run id of results that belong to every scope.
EVERYWHERE = "autogluon"


def scope_and_group(results: DataFrame, run_id: str, everywhere: str = EVERYWHERE) -> DataFrame:
    """Results of a run (its id, ids that extend it, and those of ``everywhere``), placed in their engine and round.

    One row per result with its position in the group and the engine's newest round;
    groups stay spread over tasks instead of becoming one list each.
    """
    mine = results.where(F.col("run_id").isin(run_id, everywhere) | F.col("run_id").startswith(run_id + "_"))
    number = F.coalesce(F.col("round").try_cast("int"), F.lit(0))
    newest = mine.groupBy("engine").agg(F.max(number).alias("latest_round"))
    placed = rank_rows(mine, ["engine", "round"], F.col("id"), ["id"], "position")
    return placed.join(newest, "engine")
