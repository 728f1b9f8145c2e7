"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmesh import catalog as fx
from trialmesh.operators import retrieval as ops
from trialmesh.operators.rag_rounds import chunk_plan, run_rag_rounds
from trialmesh.operators.vector_index import build_index, search
from trialmesh.plans.registry import query, rounded
from trialmesh.session import materialize


def _corpus(t):
    return t.documents.select("doc_id", F.col("text").alias("contents"))


TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
PARTS_SQL = r"""list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"""
BM25_SQL = f"""
d AS (SELECT doc_id, {TERMS.format('text')} AS ts FROM documents), size AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM d) GROUP BY ALL),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({TERMS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
idf AS (SELECT term, ln(1 + ((SELECT n FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1),
s AS (SELECT qid, doc_id, round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT avgdl FROM size)))), 9) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term) GROUP BY 1, 2),
lexical AS (SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10)"""


def _bm25(t, **more):
    return ops.bm25_topk(fx.text_queries(t), _corpus(t), 10, **more)


@query("bm25_topk", f"WITH {BM25_SQL} SELECT qid, doc_id, round(score, 6) AS score, rank FROM lexical")
def _(t):
    return rounded(_bm25(t))


@query("bm25_topk_stemmed")
def _(t):
    return rounded(_bm25(t, stem=True))


def _label_centres(t):
    """The mean vector of each label, as queries."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = cells.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(F.col("label").alias("qid"), F.col("v.x").alias("embedding"))


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


VECTOR_SQL = """
e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY 1, 2), cn AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY 1),
dots AS (SELECT c.label AS qid, e.vec_id, sum(c.x * e.x) AS d FROM c JOIN e ON e.i = c.i GROUP BY 1, 2),
vs AS (SELECT qid, dots.vec_id AS doc_id, round(d / cn.n / vn.n, 9) AS score FROM dots JOIN cn ON cn.label = qid JOIN vn ON vn.vec_id = dots.vec_id),
semantic AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 10)"""


@query("vector_topk", f"WITH {VECTOR_SQL} SELECT qid, doc_id, round(score, 6) AS score, rank FROM semantic")
def _(t):
    return rounded(ops.vector_topk(_label_centres(t), _vectors(t), 10))


def _row_queries(t):
    """Every row whose id is divisible by 20, as queries."""
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@query("vector_topk_rows", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_cosine_similarity(q.x, v.x), 9) AS score FROM e q, e v WHERE q.vec_id % 20 = 0)
SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY s.score DESC, doc_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s.score DESC, doc_id) <= 10""")
def _(t):
    return rounded(ops.vector_topk(_row_queries(t), _vectors(t), 10))


@query("vector_index_rows", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x FROM e),
s AS (SELECT q.vec_id AS qid, v.vec_id AS key, round(list_distance(q.x, v.x), 9) AS distance FROM u q, u v WHERE q.vec_id % 20 = 0)
SELECT qid, key, round(distance, 5) AS distance, CAST(row_number() OVER (PARTITION BY qid ORDER BY s.distance, key) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s.distance, key) <= 10""")
def _(t):
    """The inverted-file index over vectors of length one, where the nearest are those of the largest cosine."""
    x = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    rows = t.embeddings.select(F.col("vec_id").cast("long").alias("key"), F.transform(x, lambda v: v / norm).alias("vec"), F.lit(0.0).alias("payload"))
    found = search(build_index(rows), rows.where("key % 20 = 0").withColumnRenamed("key", "qid"), 10)
    return rounded(found.drop("payload"), 5)


def _found_of_exact(exact, found):
    """qid, scores_are_exact, recall: what the approximate lists hold of the exact ones."""
    both = exact.select("qid", "doc_id", F.col("score").alias("exact")).join(found.select("qid", "doc_id", "score"), ["qid", "doc_id"], "left")
    same = F.coalesce(F.bool_and(F.abs(F.col("exact") - F.col("score")) < 1e-8), F.lit(False))  # over the found ones; none found is not exact
    return both.groupBy("qid").agg(same.alias("scores_are_exact"), (F.count("score") / F.count("exact")).alias("recall"))


@query("vector_topk_lsh_rows")
def _(t):
    """The neighbours that the approximate search finds, each with the recall of its query against the exact list."""
    found = ops.vector_topk(_row_queries(t), _vectors(t), 10, method="lsh")
    recall = _found_of_exact(ops.vector_topk(_row_queries(t), _vectors(t), 10), found).select("qid", "recall")
    return rounded(found.join(recall, "qid"))


@query("vector_topk_lsh", "SELECT label AS qid, true AS scores_are_exact, true AS recall_reached FROM embeddings GROUP BY 1")
def _(t):
    """For the mean of a label and for each of its rows whose id is divisible by 20: the neighbours that the approximate
    search finds have the exact scores, and at least nine tenths of the exact list are found.  The neighbours themselves
    are the rows of ``vector_topk_lsh_rows``."""
    means = _label_centres(t).select(F.concat(F.lit("mean "), "qid").alias("qid"), F.col("qid").alias("label"), "embedding")
    rows = t.embeddings.where("vec_id % 20 = 0").select(F.concat(F.lit("row "), "vec_id").alias("qid"), "label", F.col("embedding").cast("array<double>"))
    asked = means.unionByName(rows)
    each = _found_of_exact(ops.vector_topk(asked, _vectors(t), 10), ops.vector_topk(asked, _vectors(t), 10, method="lsh"))
    return each.join(asked.select("qid", "label"), "qid").groupBy(F.col("label").alias("qid")).agg(
        F.bool_and("scores_are_exact").alias("scores_are_exact"), F.bool_and(F.col("recall") >= 0.9).alias("recall_reached"))


@query("hash_vectors", f"SELECT doc_id, 256 AS dims, CASE WHEN len({TERMS.format('text')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS squared_norm FROM documents")
def _(t):
    vectors, _model = ops.hash_vectors(_corpus(t))
    return vectors.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared_norm"))


@query("rrf_fuse", f"""
WITH {BM25_SQL}, {VECTOR_SQL},
u AS (SELECT CAST(qid AS BIGINT) AS qid, doc_id, rank FROM lexical UNION ALL SELECT CAST(qid AS BIGINT), doc_id, rank FROM semantic),
g AS (SELECT k, qid, doc_id, round(sum(1.0 / (k + rank)), 12) AS score FROM u, (SELECT CAST(unnest(range(10, 81)) AS INTEGER) AS k) GROUP BY 1, 2, 3)
SELECT k, qid, doc_id, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY k, qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 5""")
def _(t):
    """A lexical and a vector list of the same query numbers, fused with every constant of the search range."""
    lexical = _bm25(t).select(F.col("qid").cast("bigint").alias("qid"), "doc_id", "rank")
    semantic = ops.vector_topk(_label_centres(t), _vectors(t), 10).select(F.col("qid").cast("bigint").alias("qid"), "doc_id", "rank")
    return rounded(ops.rrf_fuse([lexical, semantic], range(10, 81), 5), 9)


@query("expand_queries", f"""
WITH {BM25_SQL}, plain AS (SELECT item_id AS qid, CAST(0 AS INTEGER) AS part, text AS query FROM benchmark),
top AS (SELECT qid, doc_id, rank FROM lexical WHERE rank <= 3), dt AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT qid, term, sum(tf) AS tf FROM top JOIN tf USING (doc_id) GROUP BY 1, 2),
w AS (SELECT qid, term, round(qt.tf * ln(((SELECT count(DISTINCT doc_id) FROM tf) + 1) / (df + 0.5)), 9) AS w FROM qt JOIN dt USING (term)),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY w DESC, term) AS place FROM w QUALIFY place <= 5)
SELECT *, 'none' AS method FROM plain UNION ALL SELECT *, 'multi_query_expansion' FROM plain UNION ALL SELECT *, 'hyde' FROM plain
UNION ALL SELECT qid, 1, string_agg(term, ' ' ORDER BY place), 'multi_query_expansion' FROM h GROUP BY qid
UNION ALL SELECT qid, 1, text, 'hyde' FROM top JOIN documents USING (doc_id) WHERE rank = 1
UNION ALL SELECT item_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER), unnest(p), 'query_decompose' FROM (SELECT item_id, {PARTS_SQL} AS p FROM benchmark)""")
def _(t):
    asked, corpus = fx.text_queries(t), _corpus(t)
    methods = ("none", "multi_query_expansion", "hyde", "query_decompose")
    parts = [ops.expand_queries(asked, corpus, m).withColumn("method", F.lit(m)) for m in methods]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("decompose_queries", f"""
SELECT item_id AS qid, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS part, unnest(p) AS query FROM (SELECT item_id, {PARTS_SQL} AS p FROM benchmark)""")
def _(t):
    return ops.expand_queries(fx.text_queries(t), _corpus(t), "query_decompose")


QRELS_SQL = "qrels AS (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("qrels_by_containment", f"WITH {QRELS_SQL} SELECT * FROM qrels")
def _(t):
    return ops.qrels_by_containment(fx.text_queries(t), t.documents.select("doc_id", "text"))


METRIC_SQL = f"""
WITH {BM25_SQL}, {QRELS_SQL}, gt AS (SELECT qid, count(*) AS n FROM qrels GROUP BY 1),
h AS (SELECT l.qid, count(*) AS n, count(r.doc_id) AS ok FROM lexical l LEFT JOIN qrels r ON r.qid = l.qid AND r.doc_id = l.doc_id GROUP BY 1),
m AS (SELECT gt.qid, coalesce(ok, 0) / gt.n AS recall, coalesce(ok / h.n, 0) AS precision FROM gt LEFT JOIN h ON h.qid = gt.qid)"""


def _qrels(t):
    return ops.qrels_by_containment(fx.text_queries(t), t.documents.select("doc_id", "text"))


@query("retrieval_metrics", METRIC_SQL + """
SELECT round(avg(recall), 6) AS retrieval_recall, round(avg(precision), 6) AS retrieval_precision,
  round(avg(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END), 6) AS retrieval_f1 FROM m""")
def _(t):
    return rounded(ops.retrieval_metrics(_bm25(t), _qrels(t)))


PROMPT_SQL = "'Answer strictly from the retrieved passages. Do not infer beyond the text. If the retrieved passages do not contain the answer, say \"I don''t know.\"' || chr(10) || chr(10) || 'Question:' || chr(10)"


@query("make_prompts", f"""
WITH {BM25_SQL}
SELECT qid, {PROMPT_SQL} || any_value(b.text) || chr(10) || chr(10) || 'Retrieved passages:' || chr(10) || string_agg(d.text, chr(10) || chr(10) ORDER BY rank)
  || chr(10) || chr(10) || 'Answer:' || chr(10) AS prompt
FROM lexical JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = qid GROUP BY 1""")
def _(t):
    hits = _bm25(t).join(_corpus(t), "doc_id").join(fx.text_queries(t), "qid")
    return ops.make_prompts(hits, "strict_grounding")


@query("extract_answers", f"""
WITH {BM25_SQL}, p AS (SELECT qid, rank, b.text AS query, list_filter(string_split(regexp_replace(d.text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS ss
  FROM lexical JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = qid),
r AS (SELECT qid, rank, query, generate_subscripts(ss, 1) AS pos, unnest(ss) AS sentence FROM p),
o AS (SELECT *, len(list_intersect(list_distinct({TERMS.format('sentence')}), list_distinct({TERMS.format('query')}))) AS overlap FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, pos) AS rn FROM o)
SELECT qid, CASE WHEN overlap > 0 THEN trim(sentence) ELSE 'I don''t know.' END AS answer FROM w WHERE rn = 1""")
def _(t):
    return ops.extract_answers(_bm25(t).join(_corpus(t), "doc_id").join(fx.text_queries(t), "qid"))


@query("synthesize_qa", f"""
WITH d AS (SELECT doc_id, text, {TERMS.format('text')} AS ts FROM documents), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM d) GROUP BY 1),
s AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS sentence FROM (SELECT doc_id, {PARTS_SQL} AS p FROM documents ORDER BY md5('42' || doc_id), doc_id LIMIT 24)),
t AS (SELECT doc_id, pos, sentence, unnest(list_distinct({TERMS.format('sentence')})) AS term FROM s),
nd AS (SELECT count(*) AS n FROM documents), w AS (SELECT t.*, ln(n / df) AS idf FROM t JOIN df USING (term), nd),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY -round(idf, 9), term) AS place FROM w),
g AS (SELECT doc_id, pos, sentence, round(sum(idf), 9) AS weight, string_agg(term, ' ' ORDER BY place) FILTER (WHERE place <= 8) AS query FROM i GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, pos) AS rn FROM g)
SELECT md5('q' || doc_id) AS qid, query, doc_id, trim(sentence) AS generation_gt FROM b WHERE rn = 1""")
def _(t):
    qa = ops.synthesize_qa(_corpus(t), 24)
    return qa.select("qid", "query", F.element_at("retrieval_gt", 1).alias("doc_id"), "generation_gt")


@query("drop_dont_know", """
SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' I DON''T KNOW.' WHEN turn % 5 = 1 THEN 'We do not know yet' ELSE text END AS answer FROM conversations
WHERE turn % 3 <> 0 AND turn % 5 <> 1""")
def _(t):
    turn = F.col("turn")
    said = F.when(turn % 3 == 0, F.concat("text", F.lit(" I DON'T KNOW."))).when(turn % 5 == 1, "We do not know yet").otherwise(F.col("text"))
    return ops.drop_dont_know(t.conversations.select("conv_id", "turn", said.alias("answer")), "answer")


PAIR_SQL = f"""
p AS (SELECT u.conv_id, u.turn, {TERMS.format('u.text')} AS r, {TERMS.format('a.text')} AS c FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def _rouge_sql(n):
    gram = lambda side: f"SELECT conv_id, turn, array_to_string({side}[i : i + {n - 1}], ' ') AS g, count(*) AS n FROM (SELECT *, unnest(range(1, len({side}) - {n - 1} + 1)) AS i FROM p) GROUP BY 1, 2, 3"
    return f"""c{n} AS ({gram('c')}), r{n} AS ({gram('r')}),
m{n} AS (SELECT conv_id, turn, sum(least(c{n}.n, r{n}.n)) AS m FROM c{n} JOIN r{n} USING (conv_id, turn, g) GROUP BY 1, 2)"""


@query("rouge", f"""
WITH {PAIR_SQL}, {_rouge_sql(1)}, {_rouge_sql(2)}
SELECT p.conv_id, p.turn, round(coalesce(2.0 * m1.m / (len(c) + len(r)), 0), 6) AS rouge1,
  round(coalesce(2.0 * m2.m / (greatest(len(c) - 1, 0) + greatest(len(r) - 1, 0)), 0), 6) AS rouge2
FROM p LEFT JOIN m1 USING (conv_id, turn) LEFT JOIN m2 USING (conv_id, turn)""")
def _(t):
    return rounded(ops.rouge(fx.answer_pairs(t), ["conv_id", "turn"], ["rouge1", "rouge2"]))


@query("rouge_l")
def _(t):
    return rounded(ops.rouge(fx.answer_pairs(t), ["conv_id", "turn"], ["rougeL"]))


STRATEGY_SQL = """
s AS (SELECT 's' || l_suppkey AS module, unnest(['recall', 'cost', 'tax']) AS metric, unnest([l_discount, l_quantity, l_tax]) AS value FROM lineitem),
per AS (SELECT module, metric, avg(value) AS v FROM s GROUP BY 1, 2)"""


def _strategy_scores(t):
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("decimal(18,2)").alias("value"))
                      for n, c in (("recall", "l_discount"), ("cost", "l_quantity"), ("tax", "l_tax"))])
    rows = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("module"), F.inline(cells))
    return rows.withColumn("value", F.col("value").cast("double"))


@query("select_strategy", f"WITH {STRATEGY_SQL} SELECT module, round(avg(v), 6) AS score FROM per GROUP BY 1 ORDER BY avg(v) DESC, module LIMIT 1")
def _(t):
    return rounded(ops.select_strategy(_strategy_scores(t)))


@query("select_strategy_normalized", f"""
WITH {STRATEGY_SQL}, span AS (SELECT metric, min(v) AS lo, max(v) AS hi FROM per GROUP BY 1),
n AS (SELECT module, avg((v - lo) / (hi - lo)) AS score FROM per JOIN span USING (metric) GROUP BY 1)
SELECT module, round(score, 6) AS score FROM n ORDER BY n.score DESC, module LIMIT 1""")
def _(t):
    return rounded(ops.select_strategy(_strategy_scores(t), "normalize_mean"))


@query("flatten_node_metrics", """
WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS ln, concat_ws('|', l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_discount, l_tax, l_quantity, l_returnflag = 'R' AS is_best FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, ln ORDER BY is_best DESC, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn FROM s WHERE ln <= 6),
u AS (SELECT run_id, ln, 'retrieval_f1' AS metric, 0 AS col, CASE WHEN ln < 5 THEN l_discount END AS value FROM b WHERE rn = 1
  UNION ALL SELECT run_id, ln, 'retrieval_f1', 1, CASE WHEN ln < 4 AND l_quantity > 10 THEN l_tax END FROM b WHERE rn = 1
  UNION ALL SELECT run_id, ln, 'rouge', 2, CASE WHEN ln >= 5 THEN l_quantity / 50 END FROM b WHERE rn = 1)
SELECT run_id, metric, arg_max(value, ln * 10 + col) AS value FROM u WHERE value IS NOT NULL GROUP BY 1, 2""")
def _(t):
    line = F.col("l_linenumber")
    nodes = F.array(*[F.lit(n) for n in ops.NODE_ORDER], F.lit("unknown"))
    seq = F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return ops.flatten_node_metrics(t.lineitem.select(
        F.col("l_orderkey").alias("run_id"), F.element_at(nodes, line).alias("node"), seq.alias("seq"), (F.col("l_returnflag") == "R").alias("is_best"),
        F.when(line < 5, F.col("l_discount")).alias("retrieval_f1"), F.when((line < 4) & (F.col("l_quantity") > 10), F.col("l_tax")).alias("semantic_retrieval_f1"),
        F.when(line >= 5, F.col("l_quantity") / 50).alias("generator_rouge"), F.lit("x").alias("module")))


HITS = ", ".join("(" + " + ".join(f"CAST(contains(low, '{w.lower()}') AS INTEGER)" for w in ws) + ")" for ws in ops.TAXONOMY.values())
NAMES = ", ".join(f"'{n}'" for n in ops.TAXONOMY)


@query("route_problem", f"""
WITH l AS (SELECT doc_id, lower(text) AS low FROM documents), s AS (SELECT doc_id, [{HITS}] AS s FROM l)
SELECT doc_id, CAST(list_max(s) AS INTEGER) AS hits, CASE WHEN list_max(s) > 0 THEN [{NAMES}][list_position(s, list_max(s))] END AS problem_type FROM s""")
def _(t):
    return ops.route_problem(t.documents.select("doc_id", "text")).drop("text")


@query("chunk_plan", """
WITH d AS (SELECT doc_id, text LIKE '%a%' AS has, lower(coalesce(CASE doc_id % 4 WHEN 0 THEN 'Many TABLES of ' || lang WHEN 1 THEN 'a Diagram' WHEN 2 THEN text END, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN v THEN 'recursive' ELSE 'token' END AS method, CASE WHEN v THEN 1200 ELSE 1024 END AS size, CASE WHEN v THEN 200 ELSE 128 END AS overlap, true AS add_file_name
FROM (SELECT doc_id, contains(t, 'table') OR contains(t, 'image') OR contains(t, 'figure') OR contains(t, 'diagram') AS v FROM d)""")
def _(t):
    described = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Many TABLES of "), "lang")).when(F.col("doc_id") % 4 == 1, "a Diagram").when(F.col("doc_id") % 4 == 2, F.col("text"))
    return t.documents.select("doc_id", chunk_plan(described).alias("p")).select("doc_id", "p.*")


@query("run_rag_rounds", """
SELECT CAST(n AS INTEGER) AS rounds, CAST(3 * n AS BIGINT) AS experiments, true AS all_differ, true AS all_scored, true AS best_is_maximum
FROM (SELECT 3 AS n FROM documents HAVING count(*) > 0)""")
def _(t):
    log = run_rag_rounds(t.documents.select("doc_id", "text"), "Stop hallucinations but keep broad coverage")
    setups = F.count_distinct("pipeline", "top_k", "fusion_k", "query_expansion", "prompt_style")
    best = F.max_by("score", F.struct("score", -F.col("seq")))
    return log.agg(F.max("round").alias("rounds"), F.count(F.lit(1)).alias("experiments"), (setups == F.count(F.lit(1))).alias("all_differ"),
                   F.bool_and((F.col("status") == "completed") & F.col("score").between(0, 1)).alias("all_scored"), (best == F.max("score")).alias("best_is_maximum"))
