"""Readers and writers: tables, folders of documents, status files, leaderboards, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trialmesh.operators.registry import ACTIVE_STATUSES
from trialmesh.scale import top_rows

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# Columns of a leaderboard file, in order.
LEADERBOARD_COLUMNS = ("round", "experiment_id", "status", "primary_metric", "primary_metric_value", "secondary_metrics",
                       "holdout_metrics_path", "model_path", "model_manifest_path", "error_summary")


def read_csv_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
                   required: Sequence[str] = (), multi_line: bool = True) -> DataFrame:
    """CSV with a header; names are trimmed and freed of a byte-order mark.

    A quote inside a quoted field is doubled.  With ``multi_line`` a quoted field may hold line breaks, and a file is
    read by one task; files without such fields are split over tasks with ``multi_line`` false.
    Pass ``schema`` when it is known: inference reads the data once more.
    """
    reader = spark.read.options(header=True, encoding="UTF-8", quote='"', escape='"', multiLine=multi_line)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    df = df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])
    if not df.columns:
        raise ValueError(f"dataset is empty: {path}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} not found, available: {df.columns}")
    return df


def read_records_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON files that hold one record or a list of records."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_read_parquet(df: DataFrame, path: str) -> DataFrame:
    """Persist as parquet (nested columns kept) and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """File inventory: name, lower-case extension, bytes.  Contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("name"), F.col("length").alias("bytes"), "path").where(~F.col("name").startswith("."))
    if found.limit(1).count() == 0:
        raise FileNotFoundError(f"no files under {path}")
    return found.select("name", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("extension"), "bytes")


def scan_status_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """One status document per run folder; broken ones are skipped, a missing run id is the folder name.

    A pattern that ends in ``*`` is read from the folder above, which holds the same files: Spark lists its tree in
    tasks, while the paths of a pattern are found and looked at one by one on the driver.
    """
    pattern, conf = pattern.rstrip("/").removesuffix("/*") or "/", spark.conf
    schema = "run_id string, status string, error string, _corrupt_record string"
    before = conf.get(LISTING)
    try:  # a task a folder, as many as the setting allows, costs more than the listing
        conf.set(LISTING, str(min(int(before), 8 * spark.sparkContext.defaultParallelism)))
        docs = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
                .option("recursiveFileLookup", True).json(pattern).select("*", F.col("_metadata.file_path").alias("file")))
    finally:
        conf.set(LISTING, before)
    folder = F.url_decode(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    return docs.where("_corrupt_record is null").select(
        F.coalesce(F.nullif("run_id", F.lit("")), folder).alias("run_id"), F.col("status"), F.col("error"),
        F.coalesce(F.col("status").isin(*ACTIVE_STATUSES), F.lit(False)).alias("is_active"))


def write_leaderboard(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Write the fixed leaderboard columns as CSV (maps as JSON text) or JSON; returns the path.

    ``read_csv_table`` gives the same values back, quotes and line breaks in texts included.
    """
    have = dict(df.dtypes)

    def column(name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("string").alias(name)
        if fmt == "csv" and have[name].startswith(("map", "struct", "array")):
            return F.to_json(name).alias(name)
        return F.col(name)

    rows = df.select(*[column(c) for c in LEADERBOARD_COLUMNS])
    if fmt == "csv":
        rows.write.mode("overwrite").options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], insert_only: bool = False, order: str | None = None) -> DataFrame:
    """Insert or overwrite by key; ``insert_only`` leaves existing rows alone.

    A key that the source repeats counts once: the row with the largest ``order``, or any of them without it.
    """
    source = top_rows(source, list(keys), [F.col(order).desc_nulls_last()]) if order else source.dropDuplicates(list(keys))
    if insert_only:
        return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))
    return target.join(source.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def upsert_by_name(target: DataFrame, source: DataFrame, scope_key: str, name_col: str, order: str,
                   status: str = "approved") -> DataFrame:
    """Update by trimmed, case-free name within a scope, else insert; the last of equal source names wins.

    Updated rows keep id and stored name.  When several stored names are equal, the
    lowest id is updated.  New ids come from scope and name, so a retry gives the same id.
    Only the first row of each stored name is joined; spare ones and nameless ones are passed on beside the join.
    """
    fields = [c for c in source.columns if c not in (scope_key, name_col, order)]
    norm = F.lower(F.trim(F.col(name_col)))
    incoming = top_rows(source.withColumn("_norm", norm), [scope_key, "_norm"], [F.col(order).desc()])
    incoming = incoming.select(scope_key, "_norm", F.trim(name_col).alias("_name"), *[F.col(c).alias(f"_{c}") for c in fields],
                               F.lit(True).alias("_new"))
    stored = target.withColumn("_norm", F.lower(F.col(name_col)))
    first = top_rows(stored.where("_norm IS NOT NULL"), [scope_key, "_norm"], [F.col("id")]).select("id", F.lit(True).alias("_first"))
    stored = stored.join(first, "id", "left")
    spare = stored.where("_first IS NULL").select(*target.columns).withColumn("id", F.col("id").cast("string"))
    both = stored.where("_first").join(incoming, [scope_key, "_norm"], "full")
    touched = F.col("_new").isNotNull()
    fresh = F.md5(F.concat_ws("|", F.col(scope_key).cast("string"), "_norm"))
    out = {
        "id": F.coalesce(F.col("id").cast("string"), fresh), scope_key: F.col(scope_key),
        name_col: F.coalesce(F.col(name_col), F.col("_name")),
        "status": F.when(touched, F.lit(status)).otherwise(F.col("status")),
        **{c: F.when(touched, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields},
    }
    return both.select(*[out[c].alias(c) if c in out else F.col(c) for c in target.columns]).unionByName(spare)
