"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmesh import catalog as fx
from trialmesh.functions import config as cf, text as tx
from trialmesh.plans.registry import query


@query("slugify", """
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(s)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'architecture') AS slug,
  coalesce(nullif(trim(regexp_replace(lower(trim(s)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'dataset') AS dashed
FROM (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN ' (!) ' ELSE ' ' || p_name || ' (' || p_brand || ')/' || p_type END AS s FROM part)""")
def _(t):
    text = F.when(F.col("p_partkey") % 13 == 0, " (!) ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")/"), "p_type"))
    return t.part.select("p_partkey", tx.slugify(text).alias("slug"), tx.slugify(text, "-", "dataset").alias("dashed"))


@query("normalize_name", "SELECT p_partkey, regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9]', '', 'g') AS name FROM part")
def _(t):
    return t.part.select("p_partkey", tx.normalize_name(F.concat_ws("_", "p_name", "p_brand")).alias("name"))


@query("data_format", """
WITH u AS (SELECT page_id, split_part(url, '?', 1) || CASE page_id % 4 WHEN 0 THEN '.CSV?v=2' WHEN 1 THEN '.pdf' WHEN 2 THEN '.csv.gz' ELSE '' END AS path FROM pages)
SELECT page_id, path, CASE page_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' END AS format,
  CASE page_id % 4 WHEN 0 THEN 'structured' WHEN 1 THEN 'unstructured' END AS category FROM u""")
def _(t):
    ends = F.when(F.col("page_id") % 4 == 0, ".CSV?v=2").when(F.col("page_id") % 4 == 1, ".pdf").when(F.col("page_id") % 4 == 2, ".csv.gz").otherwise("")
    rows = t.pages.select("page_id", F.concat(F.split_part("url", F.lit("?"), F.lit(1)), ends).alias("path"))
    return rows.withColumn("format", tx.data_format("path")).withColumn("category", tx.data_category("format"))


@query("mask_secret", """
WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN substr(c_name, 1, 8) ELSE '' END AS secret FROM customer)
SELECT c_custkey, CASE WHEN secret = '' THEN NULL WHEN length(secret) <= 8 THEN '••••' ELSE left(secret, 4) || '••••' || right(secret, 4) END AS masked FROM s""")
def _(t):
    kind = F.col("c_custkey") % 3
    secret = F.when(kind == 0, F.col("c_name")).when(kind == 1, F.substring("c_name", 1, 8)).otherwise("")
    return t.customer.select("c_custkey", tx.mask_secret(secret).alias("masked"))


@query("normalize_email", """
WITH a AS (SELECT c_custkey, '  ' || replace(c_name, '#', CASE c_custkey % 3 WHEN 0 THEN '@' WHEN 1 THEN '@Mail.' ELSE ' @' END) || '.COM ' AS address FROM customer)
SELECT c_custkey, lower(trim(address)) AS email, regexp_matches(lower(trim(address)), '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS valid FROM a""")
def _(t):
    kind = F.col("c_custkey") % 3
    address = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.when(kind == 0, "@").when(kind == 1, "@Mail.").otherwise(" @")), F.lit(".COM "))
    return t.customer.select("c_custkey", tx.normalize_email(address).alias("email"), tx.is_email(address).alias("valid"))


@query("url_domain", """
SELECT page_id, replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'www.', '') AS domain FROM pages""")
def _(t):
    return t.pages.select("page_id", tx.url_domain("url").alias("domain"))


@query("object_location", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'lake' || p_size END AS bucket,
  CASE p_partkey % 4 WHEN 3 THEN NULL ELSE 'raw/' || p_partkey || '/' || p_name END AS object_key FROM part""")
def _(t):
    kind, tail = F.col("p_partkey") % 4, F.concat(F.lit("raw/"), "p_partkey", F.lit("/"), "p_name")
    bucket = F.concat(F.lit("lake"), "p_size")
    uri = (F.when(kind == 0, F.concat(F.lit("s3://"), bucket, F.lit("/"), tail))
           .when(kind == 1, F.concat(F.lit("https://"), bucket, F.lit(".s3.amazonaws.com/"), tail, F.lit("?versionId=1")))
           .when(kind == 2, F.concat(F.lit("http://"), bucket, F.lit(".s3.eu-west-1.amazonaws.com//"), tail))
           .otherwise(F.concat(F.lit("https://example.com/"), tail)))
    return t.part.select("p_partkey", tx.object_bucket(uri).alias("bucket"), tx.object_key(uri).alias("object_key"))


@query("normalize_hits", """
SELECT CASE WHEN page_id % 5 <> 0 THEN 'Page ' || page_id ELSE 'Untitled dataset' END AS title, url,
  substr(CASE WHEN page_id % 3 = 0 THEN 'snippet of ' || url ELSE html END, 1, 500) AS description,
  replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'www.', '') AS domain
FROM pages WHERE page_id % 7 <> 0""")
def _(t):
    key = F.col("page_id")
    hits = t.pages.select(
        F.when(key % 5 != 0, F.concat(F.lit("Page "), key)).alias("title"), F.when(key % 7 != 0, F.col("url")).otherwise("").alias("url"),
        F.when(key % 3 != 0, F.col("html")).otherwise("").alias("text"),
        F.when(key % 3 == 0, F.concat(F.lit("snippet of "), "url")).alias("snippet"), F.lit(None).cast("string").alias("summary"))
    return tx.normalize_hits(hits)


LABELS = {"roc_auc": "ROC AUC", "f1": "F1", "log_loss": "Log Loss", "g_eval": "G-Eval", "f1_macro": "F1 Macro",
          "top5acc": "Top5Acc", "root_mean_squared_error": "Root Mean Squared Error"}


@query("format_metric", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_quantity >= 5 THEN l_discount * l_quantity * l_quantity / 800 END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN v IS NULL THEN 'N/A' ELSE printf('%.4f', v) END AS formatted,
  CASE WHEN v IS NULL THEN 'N/A' WHEN abs(v) >= 100 THEN printf('%.2f', v + CASE WHEN abs(v * 8) % 2 = 1 THEN 1e-4 ELSE 0 END)
    ELSE regexp_replace(regexp_replace(printf('%.4f', v + CASE WHEN abs(v * 32) % 2 = 1 THEN 1e-6 ELSE 0 END), '0+$', ''), '\\.$', '') END AS display,
  CASE l_linenumber """ + " ".join(f"WHEN {i + 1} THEN '{v}'" for i, v in enumerate(LABELS.values())) + """ END AS label FROM v""")
def _(t):
    value = F.when(F.col("l_quantity") >= 5, F.col("l_discount") * F.col("l_quantity") * F.col("l_quantity") / 800)
    name = F.element_at(F.array(*[F.lit(k) for k in LABELS]), F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", tx.format_metric(value).alias("formatted"),
                             tx.display_value(value).alias("display"), tx.metric_label(name).alias("label"))


@query("clamp_config", """
WITH c AS (SELECT *, greatest(1, least(CAST(l_quantity AS INTEGER) - 10, 10)) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, k AS top_k,
  greatest(1, least(8, CASE WHEN l_returnflag <> 'R' THEN l_linenumber * 2 ELSE least(k, 5) END, k)) AS final_top_k,
  greatest(0.05, least(l_discount * 6, 0.45)) AS filter_threshold, greatest(0.0, least(l_tax * 5, 0.3)) AS temperature,
  CASE l_linenumber WHEN 2 THEN 'lexical_bm25' WHEN 3 THEN 'hybrid_rrf' ELSE 'semantic_only' END AS pipeline_type,
  CASE l_linenumber WHEN 1 THEN 'hyde' WHEN 2 THEN 'query_decompose' ELSE 'none' END AS query_expansion_method,
  CASE l_returnflag WHEN 'A' THEN 'rankgpt' ELSE 'pass_reranker' END AS reranker_type FROM c""")
def _(t):
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    return cf.clamp_config(t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", (F.col("l_quantity").cast("int") - 10).alias("top_k"),
        F.when(flag != "R", line * 2).alias("final_top_k"), (F.col("l_discount") * 6).alias("filter_threshold"), (F.col("l_tax") * 5).alias("temperature"),
        F.when(line == 1, "semantic_only").when(line == 2, "lexical_bm25").when(line == 3, "hybrid_rrf").otherwise("graph").alias("pipeline_type"),
        F.when(line == 1, "hyde").when(line == 2, "query_decompose").when(line == 3, "guess").alias("query_expansion_method"),
        F.when(flag == "A", "rankgpt").when(flag == "N", "colbert").alias("reranker_type")))


@query("improvement_pct", """
WITH v AS (SELECT *, least(100.0, greatest(0.0, l_quantity * 3 - 20)) AS b, least(100.0, greatest(0.0, l_quantity * 2 * (1 - l_discount))) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CAST(CASE WHEN b > 0 THEN floor((b - a) / b * 100 + 0.5) ELSE 0 END AS BIGINT) AS improvement FROM v""")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                             tx.improvement_pct(q * 3 - 20, q * 2 * (1 - F.col("l_discount"))).alias("improvement"))


@query("period_start", "SELECT event_id, date_trunc('month', ts) AS period FROM (SELECT event_id, ts + to_days(CAST(event_id % 90 AS INTEGER)) AS ts FROM events)")
def _(t):
    moved = F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 90).cast("int"))
    return t.events.select("event_id", cf.period_start(moved).alias("period"))


@query("run_key", """
SELECT event_id, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || left(md5(CAST(event_id AS VARCHAR)), 8) AS run_key,
  user_id || '/' || event_type || '/data.csv' AS storage_key, user_id || '_' || (user_id % 5) || '_' || event_id AS session_key FROM events""")
def _(t):
    return t.events.select("event_id", cf.run_key("ts", "event_id").alias("run_key"),
                           cf.storage_key(F.col("user_id").cast("string"), tx.slugify("event_type", "-", "dataset"), F.lit("data.csv")).alias("storage_key"),
                           cf.session_key(F.col("user_id").cast("string"), (F.col("user_id") % 5).cast("string"), F.col("event_id").cast("string")).alias("session_key"))


@query("decode_payload", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"id":' || event_id || ',"event_type":"' || event_type || '"}'
  WHEN 1 THEN props ELSE '{"raw":"not json ' || user_id || '"}' END AS decoded FROM events""")
def _(t):
    kind = F.col("event_id") % 3
    payload = F.when(kind == 1, F.col("props")).when(kind == 2, F.concat(F.lit("not json "), "user_id"))
    return t.events.select("event_id", cf.decode_payload(payload, F.struct(F.col("event_id").alias("id"), "event_type")).alias("decoded"))


@query("coerce_value", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN user_id END AS as_int, CASE event_id % 4 WHEN 1 THEN value END AS as_double,
  CASE WHEN event_id % 4 IN (2, 3) THEN event_type || user_id END AS as_text,
  CASE event_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'double' ELSE 'text' END AS kind FROM events""")
def _(t):
    kind = F.col("event_id") % 4
    raw = (F.when(kind == 0, F.concat(F.lit(" "), "user_id")).when(kind == 1, F.col("value").cast("decimal(18,2)").cast("string"))
           .otherwise(F.concat("event_type", "user_id")))
    return t.events.select("event_id", cf.coerce_value(raw).alias("c")).select("event_id", "c.*")


@query("merge_settings", """
WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END AS old_region, c_name AS old_model,
  CASE c_custkey % 4 WHEN 0 THEN 'eu-' || c_nationkey WHEN 1 THEN '' END AS new_region, c_custkey % 4 <= 1 AS given FROM customer)
SELECT c_custkey, CASE WHEN given THEN new_region ELSE old_region END AS config_region, old_model AS config_model,
  CASE WHEN given AND new_region <> '' THEN new_region ELSE old_region END AS secret_region,
  (CASE WHEN given AND new_region <> '' THEN new_region ELSE old_region END) <> '' AS configured FROM m""")
def _(t):
    key = F.col("c_custkey")
    stored = F.create_map(F.lit("region"), F.when(key % 3 == 0, F.col("c_mktsegment")).otherwise(""), F.lit("model"), F.col("c_name"))
    new = (F.when(key % 4 == 0, F.create_map(F.lit("region"), F.concat(F.lit(" eu-"), "c_nationkey"), F.lit("color"), F.lit("red")))
           .when(key % 4 == 1, F.create_map(F.lit("region"), F.lit("  "))).otherwise(F.create_map().cast("map<string,string>")))
    rows = t.customer.select("c_custkey", stored.alias("stored"), new.alias("new"))
    rows = rows.withColumn("config", cf.merge_settings("stored", "new", ["region", "model"], True)).withColumn(
        "secret", cf.merge_settings("stored", "new", ["region", "model"], False))
    return rows.select("c_custkey", F.col("config.region").alias("config_region"), F.col("config.model").alias("config_model"),
                       F.col("secret.region").alias("secret_region"), cf.configured(F.col("secret")).alias("configured"))


@query("split_sentences", r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, regexp_replace(s, '\.$', '') || '.' AS sentence FROM (
  SELECT doc_id, unnest(list) AS s, generate_subscripts(list, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\.\s+'), lambda x: trim(x, E' \t\r\n')), lambda x: length(x) > 15) AS list
    FROM documents))""")
def _(t):
    return t.documents.select("doc_id", F.posexplode(tx.split_sentences("text")).alias("position", "sentence"))


@query("text_tokens", """
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS position, CASE WHEN i < n THEN w || ' ' ELSE w END AS token FROM (
  SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (
    SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations))""")
def _(t):
    return tx.text_tokens(t.conversations.select("conv_id", "turn", "text"), "text")


@query("answers_to_text", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority || chr(10) || o_custkey || chr(10) || 'True'
  WHEN 1 THEN o_orderstatus || chr(10) || o_custkey WHEN 2 THEN o_orderpriority
  WHEN 3 THEN CASE WHEN o_orderstatus = 'O' THEN 'Confirmed.' ELSE 'Not confirmed.' END
  WHEN 4 THEN CASE WHEN o_orderstatus = 'O' THEN 'Approved.' ELSE 'Not approved.' END
  WHEN 5 THEN 'Choice: ' || o_orderpriority ELSE '' END AS message FROM orders""")
def _(t):
    kind, yes = F.col("o_orderkey") % 7, F.when(F.col("o_orderstatus") == "O", "true").otherwise("false")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    doc = (F.when(kind == 0, F.concat(F.lit('{"answers":{"9":'), text("o_orderpriority"), F.lit(',"10":'), "o_custkey", F.lit(',"2":true}}')))
           .when(kind == 1, F.concat(F.lit('{"answers":['), text("o_orderstatus"), F.lit(","), "o_custkey", F.lit("]}")))
           .when(kind == 2, F.concat(F.lit('{"answers":'), text("o_orderpriority"), F.lit("}")))
           .when(kind == 3, F.concat(F.lit('{"confirmed":'), yes, F.lit("}"))).when(kind == 4, F.concat(F.lit('{"approved":'), yes, F.lit("}")))
           .when(kind == 5, F.concat(F.lit('{"choice":'), text("o_orderpriority"), F.lit("}"))).otherwise("{}"))
    return t.orders.select("o_orderkey", cf.answers_to_text(doc).alias("message"))


@query("secondary_metrics", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'f1' AS metric, l_tax AS value FROM lineitem WHERE l_returnflag <> 'A'
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'roc_auc', l_discount FROM lineitem WHERE l_returnflag = 'A'
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, 'recall', l_quantity / 50 FROM lineitem WHERE l_quantity >= 5""")
def _(t):
    metrics = F.create_map(F.lit("f1"), F.col("l_tax"), F.lit("roc_auc"), F.col("l_discount"),
                           F.lit("recall"), F.when(F.col("l_quantity") >= 5, F.col("l_quantity") / 50))
    primary = F.when(F.col("l_returnflag") == "A", "f1").otherwise("roc_auc")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    rows = t.lineitem.select(*keys, metrics.alias("m"), primary.alias("p"))
    return rows.select(*keys, F.explode(cf.secondary_metrics("m", "p")).alias("metric", "value"))


GOALS = (("Stop hallucinations but keep broad coverage", "retrieval_f1", "strict_grounding", "3,4,5", "consistency,relevance"),
         ("Only faithful text", "retrieval_precision", "strict_grounding", "2,3,4", "consistency,relevance"),
         ("Nothing missing, clear and polished", "retrieval_recall", "evidence_first", "4,5,7", "consistency,relevance,coherence,fluency"),
         ("Less noise", "retrieval_precision", "strict_grounding", "2,3,4", "consistency,relevance"),
         ("Good answer quality", "rouge", "grounded_concise", "3,4,5", "coherence,consistency,fluency,relevance"),
         ("LLM judge on fluency", "g_eval", "strict_grounding", "2,3,4", "coherence,consistency,fluency,relevance"),
         ("Cheap and fast", "retrieval_f1", "grounded_concise", "3,5", "consistency,relevance"))


@query("goal_to_metric", "SELECT o_orderkey, " + ", ".join(
    "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{g[k]}'" for i, g in enumerate(GOALS)) + f" END AS {n}"
    for k, n in ((1, "primary_metric"), (2, "prompt_style"), (3, "top_k"), (4, "judge_dimensions"))) + " FROM orders")
def _(t):
    goal = F.concat(F.element_at(F.array(*[F.lit(g[0]) for g in GOALS]), (F.col("o_orderkey") % 7).cast("int") + 1), F.lit(" for "), "o_orderpriority")
    rows = t.orders.select("o_orderkey", cf.goal_to_metric(goal).alias("g"))
    return rows.select("o_orderkey", "g.primary_metric", "g.prompt_style", F.array_join("g.top_k", ",").alias("top_k"),
                       F.array_join("g.judge_dimensions", ",").alias("judge_dimensions"))


@query("infer_task_and_metric", """
WITH p AS (SELECT p_brand, 'bigint' AS dtype, count(DISTINCT p_size) AS n, 'reduce churn' AS kpi FROM part GROUP BY 1
  UNION ALL SELECT p_brand, 'string', count(DISTINCT p_type), 'grow' FROM part GROUP BY 1
  UNION ALL SELECT p_brand, 'double', count(DISTINCT p_size % 2), 'Miss fewer' FROM part GROUP BY 1
  UNION ALL SELECT p_brand, 'boolean', count(DISTINCT p_size % 2), 'grow' FROM part GROUP BY 1),
q AS (SELECT *, CASE WHEN dtype IN ('bigint', 'double') AND n > 20 THEN 'regression' WHEN n <= 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task FROM p)
SELECT p_brand, dtype, n AS unique_count, kpi, task, CASE task WHEN 'regression' THEN 'root_mean_squared_error,mean_absolute_error,r2'
  WHEN 'multiclass_classification' THEN 'accuracy,f1_macro,balanced_accuracy' ELSE CASE WHEN kpi = 'grow' THEN 'roc_auc' ELSE 'f1' END || ',precision,recall' END AS metrics FROM q""")
def _(t):
    columns = [("bigint", F.col("p_size"), "reduce churn"), ("string", F.col("p_type"), "grow"),
               ("double", F.col("p_size") % 2, "Miss fewer"), ("boolean", F.col("p_size") % 2, "grow")]
    wide = t.part.groupBy("p_brand").agg(*[F.countDistinct(c).alias(f"n{i}") for i, (_, c, _k) in enumerate(columns)])
    rows = wide.select("p_brand", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dtype"), F.col(f"n{i}").alias("unique_count"), F.lit(k).alias("kpi")) for i, (d, _, k) in enumerate(columns)])))
    task = cf.infer_task("dtype", "unique_count")
    return rows.withColumn("task", task).withColumn("metrics", F.array_join(cf.metric_candidates(F.col("task"), "kpi"), ","))


@query("flatten_request", """
WITH r AS (SELECT p_partkey, unnest([0, 1, 2]) AS position, p_name, p_type, p_size FROM part)
SELECT p_partkey AS request_id, CAST(position AS INTEGER) AS position, 'prob_' || position AS problem_id, p_name AS name,
  CASE position WHEN 0 THEN p_type WHEN 1 THEN 'day' END AS target, CASE position WHEN 0 THEN 'item_id_column=sku' WHEN 1 THEN 'b_column=qty' ELSE '' END AS extra_columns,
  CASE WHEN position <> 2 THEN 's3://lake/' || p_partkey END AS s3_path, CASE WHEN position <> 2 THEN CAST(p_size AS BIGINT) END AS row_count,
  CASE position WHEN 0 THEN 'margin; ' || p_type ELSE '' END AS business_kpi,
  CASE position WHEN 0 THEN 'tabular' WHEN 1 THEN 'retrieval' ELSE 'skipped' END AS route,
  CASE position WHEN 2 THEN 'Unsupported category/engine: vision/autogluon' END AS reason FROM r""")
def _(t):
    name = lambda v: F.struct(v.alias("inferred_name"))
    source = F.struct(F.struct(F.concat(F.lit("s3://lake/"), "p_partkey").alias("s3_path"), F.col("p_size").alias("row_count")).alias("source"))

    def problem(i, category, engine, **more):
        parts = [F.lit(f"prob_{i}").alias("id"), F.col("p_name").alias("name"), F.lit(category).alias("category"), F.lit(engine).alias("engine")]
        return F.to_json(F.struct(*parts, *[v.alias(k) for k, v in more.items()]))

    problems = [
        problem(0, "Traditional", "AutoGluon", business_kpis=F.array(F.lit("margin"), F.col("p_type")), dataset=source,
                inferred_columns=F.create_map(F.lit("item_id_column"), name(F.lit("sku")), F.lit("label_column"), name(F.col("p_type")))),
        problem(1, "genai", "autorag", dataset=source, inferred_columns=F.create_map(F.lit("a_column"), name(F.lit("day")), F.lit("b_column"), name(F.lit("qty")))),
        problem(2, "vision", "autogluon")]
    request = F.concat(F.lit('{"business_problem":"sell more","ml_problems":['), F.concat_ws(",", *problems), F.lit("]}"))
    return cf.flatten_request(t.part.select(F.col("p_partkey").alias("request_id"), request.alias("request")))


@query("roi_signal", r"""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' up by ' || (doc_id % 90) || ' % at once' WHEN 1 THEN text || ' saves 2.5 – 4 hours' WHEN 2 THEN text ELSE '' END AS roi FROM documents)
SELECT doc_id, CASE WHEN roi = '' THEN '—' WHEN regexp_matches(roi, '[0-9]+\s*%') THEN regexp_extract(roi, '([0-9]+)\s*%', 1) || '%'
  WHEN regexp_matches(roi, '[0-9.]+\s*[–-]\s*[0-9.]+\s*h') THEN regexp_extract(roi, '([0-9.]+\s*[–-]\s*[0-9.]+)\s*h', 1) || 'h' ELSE 'Estimated' END AS signal FROM d""")
def _(t):
    kind = F.col("doc_id") % 4
    roi = (F.when(kind == 0, F.concat("text", F.lit(" up by "), F.col("doc_id") % 90, F.lit(" % at once")))
           .when(kind == 1, F.concat("text", F.lit(" saves 2.5 – 4 hours"))).when(kind == 2, F.col("text")).otherwise(""))
    return t.documents.select("doc_id", tx.roi_signal(roi).alias("signal"))
