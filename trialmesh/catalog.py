"""The input tables and the roles they play (registry, runs, event log, text sets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class Tables:
    """Parquet tables of one scale-factor folder, read on first use."""

    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

    heavy = {"documents": "doc_id", "pages": "page_id"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, name: str, key: str) -> DataFrame:
        """A table whose rows need heavy work each.

        Stored in fewer splits than there are cores, it is spread by key first.  A large
        table has more splits than cores and is read as it is.
        """
        df = self.spark.read.parquet(self.path(name))
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

    def stream(self, name: str) -> DataFrame:
        """The table as a stream of files, whether it is one file or a folder of them."""
        reader = self.spark.readStream.schema(getattr(self, name).schema).option("maxBytesPerTrigger", 1 << 30)
        one_file = any(f.endswith(f"/{name}.parquet") for f in getattr(self, name).inputFiles()[:1])
        if one_file:
            return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return reader.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in Tables.names:
            raise AttributeError(name)
        df = self.spread(name, Tables.heavy[name]) if name in Tables.heavy else self.spark.read.parquet(self.path(name))
        self.__dict__[name] = df
        return df


def cents(col: str | Column) -> Column:
    """Money as a decimal, so sums do not depend on the order of addition."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(18,2)")


# --- registry -----------------------------------------------------------------

def projects(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("organization_id"),
                           F.col("n_name").alias("name"))


def members(t: Tables) -> DataFrame:
    """Customers as members of the organisation their nation names."""
    return t.customer.select((F.col("c_custkey") % 3).alias("user_id"), F.col("c_nationkey").alias("organization_id"),
                             F.col("c_custkey").alias("membership_id"))


def use_cases(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"),
                             F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"),
                             F.col("c_acctbal").alias("balance"))


def datasets(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("id"), F.col("o_custkey").alias("use_case_id"),
        F.when(key % 3 != 0, (key % 25).cast("int")).alias("project_id"),
        F.when(key % 4 != 0, F.concat(F.lit("s3://lake/"), key, F.when(key % 2 == 0, ".csv").otherwise(".pdf"))).alias("s3_path"),
        F.concat(F.lit("/mnt/data/"), key, F.lit(".CSV?v=1")).alias("storage_uri"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("total_price"),
        F.col("o_orderstatus").alias("status"))


def training_runs(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.orders.select(key.alias("id"), key.alias("dataset_id"), F.col("o_custkey").alias("use_case_id"),
                           F.lit(None).cast("int").alias("project_id"), F.col("o_orderdate").alias("created_at"),
                           F.col("o_orderstatus").alias("status"))


def entries(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("training_run_id"), F.col("l_linenumber").alias("rank"),
        F.col("l_discount").alias("metric_value"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), F.col("l_shipdate").alias("shipped"))


# --- usage and events ---------------------------------------------------------

# Event kinds of the usage ledger, by kind in the events table.
USAGE_KINDS = {"click": "exa_search", "view": "exa_acu", "purchase": "autogluon_compute",
               "signup": "autorag_compute", "error": "deployment_runtime"}


def usage_events(t: Tables) -> DataFrame:
    kind = F.lit(None).cast("string")
    for source, target in USAGE_KINDS.items():
        kind = F.when(F.col("event_type") == source, target).otherwise(kind)
    return t.events.select(
        (F.col("user_id") % 5).alias("organization_id"), kind.alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("units"), cents("value").alias("total_cost"),
        F.col("ts").alias("created_at"))


USAGE_SQL = """usage_events AS (
  SELECT user_id % 5 AS organization_id,
         CASE event_type WHEN 'click' THEN 'exa_search' WHEN 'view' THEN 'exa_acu' WHEN 'purchase' THEN 'autogluon_compute'
              WHEN 'signup' THEN 'autorag_compute' WHEN 'error' THEN 'deployment_runtime' END AS event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS units, CAST(value AS DECIMAL(18,2)) AS total_cost,
         ts AS created_at
  FROM events)"""


def sessions(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("token"), F.col("user_id"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("revoked_at"), F.col("ts").alias("created_at"))


def users(t: Tables) -> DataFrame:
    return t.events.select("user_id").distinct().withColumn("active", F.col("user_id") % 7 != 0)


def event_log(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("event_type") == "error", "end").otherwise(F.col("event_type")).alias("event_type"),
        F.col("props").alias("payload"), F.col("value"), F.col("ts"))


def result_bodies(t: Tables) -> DataFrame:
    """Events as published experiment results (nested config and metrics)."""
    key, kind = F.col("event_id"), F.col("event_type")
    end = kind == "error"
    double = lambda c: c.cast("double")
    metrics = F.struct(
        F.when(key % 3 != 0, F.lit("f1")).alias("primary_metric"),
        F.when(key % 2 == 0, double(F.col("value"))).alias("primary_metric_value"), double(F.col("value") * 2).alias("f1"),
        F.when(key % 5 == 0, F.struct(double(F.col("value")).alias("recall"))).alias("secondary_metrics"),
        F.when(key % 5 == 1, F.struct(F.lit(0.5).alias("f1"), F.lit(0.25).alias("mcc"))).alias("evaluation"))
    return t.events.select(
        key.alias("id"), F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.lit("run_"), F.col("user_id") % 5, F.when(key % 4 != 0, F.concat(F.lit("_prob_"), F.col("user_id") % 3)).otherwise("")).alias("run_id"),
        F.when(kind == "click", "AutoGluon tabular").when(kind == "view", "autorag").alias("designer"),
        F.when(~end, (key % 4).cast("int") + 1).alias("round"), F.when(~end, F.concat(F.lit("exp_"), key)).alias("experiment_id"),
        F.when(end, "end").alias("event_type"),
        F.when(kind == "view", F.struct(F.lit("fast_baseline").alias("intent"))).alias("config"), metrics.alias("metrics"))


RESULTS_SQL = """results AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id,
    'run_' || (user_id % 5) || CASE WHEN event_id % 4 <> 0 THEN '_prob_' || (user_id % 3) ELSE '' END AS run_id,
    CASE event_type WHEN 'click' THEN 'autogluon' WHEN 'view' THEN 'autorag' ELSE 'other' END AS engine,
    CASE WHEN event_id % 4 <> 0 THEN 'prob_' || (user_id % 3) ELSE 'problem' END AS problem_id,
    CAST(event_id % 4 + 1 AS VARCHAR) AS round, 'exp_' || event_id AS experiment_id,
    CASE WHEN event_type = 'view' THEN 'fast_baseline' ELSE 'N/A' END AS intent,
    CASE WHEN event_id % 3 <> 0 THEN 'f1' ELSE 'primary_metric' END AS primary_metric,
    CASE WHEN event_id % 2 = 0 THEN value WHEN event_id % 3 <> 0 THEN value * 2 END AS primary_metric_value,
    event_id % 5 AS kind
  FROM events WHERE event_type <> 'error')"""


def heartbeats(t: Tables) -> DataFrame:
    return t.events.select(F.col("user_id").alias("experiment_id"), F.col("event_id").alias("seq"),
                           F.col("value").alias("elapsed"), (F.col("event_id") % 6).alias("completed"))


# --- experiment runs ----------------------------------------------------------

def runs(t: Tables) -> DataFrame:
    """Line items as experiments: run, round, a total submission order, status and score."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").alias("round"),
        F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("seq2"), F.col("l_shipdate").alias("seq3"),
        F.col("l_extendedprice").alias("seq4"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"),
        F.when(F.col("l_quantity") >= 5, F.col("l_discount")).alias("score"),
        F.col("l_linestatus").alias("pipeline"))


SEQ = ["seq", "seq2", "seq3", "seq4"]
RUNS_SQL = """runs AS (
  SELECT l_suppkey AS run_id, l_linenumber AS round, l_orderkey AS seq, l_partkey AS seq2, l_shipdate AS seq3,
         l_extendedprice AS seq4, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END AS status,
         CASE WHEN l_quantity >= 5 THEN l_discount END AS score, l_linestatus AS pipeline
  FROM lineitem)"""


def customer_nulls(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(key, "c_name", "c_nationkey", F.when(key % 10 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                             F.when(key % 17 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))


CUSTOMER_NULLS_SQL = """cust AS (
  SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"""


def binary_scores(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), (F.col("event_type") == "purchase").cast("int").alias("label"),
                           (F.col("value") / 500).alias("score"))


def multiclass_preds(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_returnflag").alias("label"),
        F.when(F.col("l_quantity") <= 17, "A").when(F.col("l_quantity") <= 34, "N").otherwise("R").alias("prediction"))


def regression_preds(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))


def train_table(t: Tables) -> DataFrame:
    return t.spread("lineitem", "l_orderkey").withColumn(
        "key", F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").cast("string"),
                           cents("l_extendedprice")))


def text_train(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select("doc_id", "text", F.col("quality").alias("label"))


def daily_series(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("item"), F.to_date("ts").alias("day")).agg(
        F.sum(cents("value")).cast("double").alias("target"))


DAILY_SQL = """series AS (
  SELECT event_type AS item, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS target
  FROM events GROUP BY 1, 2)"""


# --- text sets ----------------------------------------------------------------

def text_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def answer_pairs(t: Tables) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    said = t.conversations
    user = said.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    reply = said.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                    F.col("text").alias("candidate"))
    return user.join(reply, ["conv_id", "turn"])
