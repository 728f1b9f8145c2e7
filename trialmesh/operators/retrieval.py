"""Lexical and vector search, fusion, prompts, answers and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from trialmesh.functions import python_text as pt
from trialmesh.functions.text import terms, words
from trialmesh.operators.chunking import sentences
from trialmesh.operators.ranking import sample_n
from trialmesh.scale import top_rows
from trialmesh.session import broadcast_if_small, fits, materialize

MAX_BROADCAST_QUERIES = 4096
MAX_QUERY_TERMS = 1_000_000
BLOCK_ROWS = 20_000
#: Documents of an index that are counted or scored at once, and most products of a term and its queries held at once.
INDEX_ROWS, SCORE_CELLS, PRODUCTS, BATCH_BYTES = 1024, 1 << 20, 1 << 21, 8 << 20
#: With 6 bits and one flip, 8 tables find 4 to 10 of 10 neighbours of a query in the embeddings tables; these find 9 at least.
LSH_TABLES = 20

# Phrases of an answer that gives none, and the answer given instead of one.
DONT_KNOW = ("i don't know", "i do not know", "don't know", "do not know")
NO_ANSWER = "I don't know."

# Prompt templates.
PROMPTS = {
    "evidence_first": (
        "First identify the most relevant retrieved evidence, then answer concisely. "
        "Use only the retrieved passages. If the answer is not present, say \"I don't know.\"\n\n"
        "Question:\n{query}\n\nRetrieved passages:\n{retrieved_contents}\n\nAnswer:\n"),
    "strict_grounding": (
        "Answer strictly from the retrieved passages. Do not infer beyond the text. "
        "If the retrieved passages do not contain the answer, say \"I don't know.\"\n\n"
        "Question:\n{query}\n\nRetrieved passages:\n{retrieved_contents}\n\nAnswer:\n"),
    "grounded_concise": (
        "Use only the retrieved passages to answer the question in a concise way. "
        "If the answer is not present, say \"I don't know.\"\n\n"
        "Question:\n{query}\n\nRetrieved passages:\n{retrieved_contents}\n\nAnswer:\n"),
}

# Node order of a retrieval run, and the metric names its columns may end in.
NODE_ORDER = ("query_expansion", "semantic_retrieval", "lexical_retrieval", "hybrid_retrieval", "prompt_maker", "generator")
RUN_METRICS = ("retrieval_recall", "retrieval_precision", "retrieval_f1", "rouge", "g_eval")

# Problem types in order of preference, with the words that point to them.
TAXONOMY = {
    "tabular_binary_classification": ("churn", "fraud", "predict whether", "yes or no", "at risk", "convert", "default", "binary", "will", "is likely to"),
    "tabular_multiclass_classification": ("categorise", "classify", "routing", "intent", "type of", "category", "segment into", "which bucket", "multi-class", "three or more"),
    "tabular_regression": ("how much", "predict value", "revenue", "price", "score", "ltv", "amount", "estimate", "continuous", "numeric outcome"),
    "time_series_forecasting": ("forecast", "time series", "weekly", "monthly", "daily", "trend", "seasonal", "future demand", "predict next N", "horizon"),
    "text_classification": ("text", "sentiment", "nlp", "review", "classify text", "message", "email classification", "natural language"),
    "image_classification": ("image", "photo", "visual", "camera", "defect", "picture", "scan", "computer vision"),
    "ner": ("entity extraction", "ner", "named entity", "extract", "information extraction", "structured from text"),
    "rag_question_answering": ("support deflection", "answer questions", "knowledge base", "faq", "chatbot", "policy questions", "documentation assistant", "automate answers"),
    "rag_document_retrieval": ("search", "find documents", "semantic search", "retrieve", "lookup", "knowledge discovery", "similarity search"),
}


# --- lexical ------------------------------------------------------------------

def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of a token array: sort, then lengths of equal runs, all inside the row."""
    def runs(s: Column) -> Column:
        n = F.size(s)
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        ends = F.filter(at, lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda p, j: F.struct(
            F.get(s, p - 1).alias("term"), (p - F.coalesce(F.get(e, j - 1), F.lit(0))).alias("tf"))))[0]

    return F.transform(F.array(F.array_sort(tokens)), runs)[0]


def postings(corpus: DataFrame, key: str = "doc_id", text: str = "contents") -> DataFrame:
    """(doc_id, dl, term, tf).  Counted inside each row, so no token is shuffled."""
    rows = corpus.select(F.col(key).alias("doc_id"), terms(text).alias("_t"))
    return rows.select("doc_id", F.size("_t").alias("dl"), F.inline(term_counts(F.col("_t"))))


@F.pandas_udf(T.StringType())
def stem_terms(column: pd.Series) -> pd.Series:
    return column.map(pt.porter_stem)


def stemmed(index: DataFrame) -> DataFrame:
    """Postings by stem.  The stemmer runs on the distinct terms; counts of one document are added up."""
    vocabulary = index.select("term").distinct().withColumn("stem", stem_terms("term"))
    return index.join(vocabulary, "term").groupBy("doc_id", "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def _by_document(index: DataFrame) -> bool:
    return isinstance(index.schema["term"].dataType, T.ArrayType)


def _term_lists(ids: pa.Array, dl: pa.Array, flat: pa.Array, sizes: np.ndarray, tf: np.ndarray | None, stems: dict | None) -> pa.RecordBatch:
    """Rows of a document index from the terms of some documents; a term that comes again has its counts added up."""
    coded = flat.dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    if stems is not None:
        for word in names.to_pylist():
            if word not in stems:
                stems[word] = pt.porter_stem(word)
        found = pa.array([stems[word] for word in names.to_pylist()], names.type).dictionary_encode()
        codes, names = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)[codes], found.dictionary
    width = max(1, len(names))
    pairs = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * width + codes
    if tf is None:
        pairs, counts = np.unique(pairs, return_counts=True)
    else:
        pairs, at = np.unique(pairs, return_inverse=True)
        counts = np.bincount(at, tf, len(pairs))
    ends = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1, dtype=np.int64) * width), pa.int32())
    term = pa.ListArray.from_arrays(ends, names.take(pa.array(pairs % width, pa.int64())))
    return pa.RecordBatch.from_arrays([ids, dl, term, pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32)))], ["doc_id", "dl", "term", "tf"])


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def document_index(corpus: DataFrame, key: str = "doc_id", text: str = "contents") -> DataFrame:
    """(doc_id, dl, term, tf): a row per document, its distinct terms and their counts as lists.

    The same counts as :func:`postings`, taken in Arrow batches.  A document lies in one row, so a search scores it
    where it lies and moves no posting; one without a term keeps its row, with empty lists.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, INDEX_ROWS):
                part = batch.slice(start, INDEX_ROWS)
                lists = part.column(1)
                yield _term_lists(part.column(0), pc.list_value_length(lists), lists.flatten(), _lengths(lists), None, None)
    rows = corpus.select(F.col(key).alias("doc_id"), terms(text).alias("_t"))
    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, dl int, term array<string>, tf array<int>")


def stem_documents(index: DataFrame) -> DataFrame:
    """A document index by stem.  A task stems a word once; counts of one document are added up in its row."""
    def stem(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, INDEX_ROWS):
                if len(stems) > MAX_QUERY_TERMS:
                    stems.clear()
                part = batch.slice(start, INDEX_ROWS)
                lists, tf = part.column(2), part.column(3).flatten().to_numpy(zero_copy_only=False)
                yield _term_lists(part.column(0), part.column(1), lists.flatten(), _lengths(lists), tf, stems)
    return index.select("doc_id", "dl", "term", "tf").mapInArrow(stem, index.schema)


def document_frequencies(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, df): in how many rows of a document index each term of ``wanted`` occurs; one that occurs in none is missing."""
    if not fits(wanted, MAX_QUERY_TERMS):
        return index.select(F.explode("term").alias("term")).join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    names = pa.array([r["term"] for r in wanted.select("term").collect()], pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), dtype=np.int64)
        for batch in batches:
            at = pc.index_in(batch.column(0).flatten(), names).drop_null().to_numpy(zero_copy_only=False)
            total += np.bincount(at, minlength=len(names))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(seen, pa.int64())), pa.array(total[seen])], ["term", "df"])
    return index.select("term").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _stems_asked(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """A document index by stem, cut to the stems of ``asked``; documents without one keep their row, and all their length.

    A task stems a word once, and forgets all words when it has seen ``MAX_QUERY_TERMS``.
    """
    names = pa.array(sorted(r["term"] for r in asked.select("term").distinct().collect()), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, known = {name: i for i, name in enumerate(names.to_pylist())}, {}
        width = max(1, len(places))
        for batch in batches:
            for start in range(0, batch.num_rows, INDEX_ROWS):
                part = batch.slice(start, INDEX_ROWS)
                sizes, coded = _lengths(part.column(2)), part.column(2).flatten().dictionary_encode()
                if len(known) > MAX_QUERY_TERMS:
                    known.clear()
                words = coded.dictionary.to_pylist()
                for word in words:
                    if word not in known:
                        known[word] = places.get(pt.porter_stem(word), -1)
                at = np.array([known[word] for word in words], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
                wanted = at >= 0
                pairs, tf = np.unique((np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * width + at)[wanted], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1, dtype=np.int64) * width), pa.int32())
                term = pa.ListArray.from_arrays(ends, names.take(pa.array(pairs % width, pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), term, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], ["doc_id", "dl", "term", "tf"])
    rows = corpus.select("doc_id", terms("contents").alias("_t")).select("doc_id", F.size("_t").alias("dl"), "_t")
    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, dl int, term array<string>, tf array<int>")


def _bm25_stemmed(asked: DataFrame, corpus: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """Top-k documents by BM25 over stems: texts are read once, no posting moves; only ids are counted (eager).

    Rows that share an id, or have none, are one document: those of one length have their counts added up, and the
    scores of several lengths are summed.  Only their postings are grouped.
    """
    spark, name = corpus.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:  # long texts come in small batches
        spark.conf.set(name, str(BATCH_BYTES))
        index = materialize(_stems_asked(corpus, asked), "stems")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    size, names = corpus_size(index), asked.select("term").distinct()
    many = materialize(index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_many")), "many")
    if many.limit(1).count() == 0:
        return _bm25_documents(asked, index, size, document_frequencies(index, names), k, k1, b)
    same = F.col("doc_id").eqNullSafe(F.col("_many"))
    many = broadcast_if_small(many)
    single, shared = index.join(many, same, "left_anti"), index.join(many, same, "left_semi")
    hits = shared.select("doc_id", "dl", F.inline(F.arrays_zip("term", "tf"))).groupBy("doc_id", "dl", "term").agg(F.sum("tf").alias("tf"))
    hits = materialize(hits, "hits")
    df = document_frequencies(single, names).unionByName(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    df = materialize(df.groupBy("term").agg(F.sum("df").alias("df")), "df")
    found = _bm25_documents(asked, single, size, df, k, k1, b).select("qid", "doc_id", "score")
    return _best(found.unionByName(_score_postings(hits, df, asked, size, k1, b, F.broadcast).select("qid", "doc_id", "score")), k)


def _score_postings(hits: DataFrame, df: DataFrame, asked: DataFrame, size: DataFrame, k1: float, b: float, small) -> DataFrame:
    """doc_id, qid, score by BM25 of postings (doc_id, dl, term, tf), moved once by document; ``small`` marks tables by query term."""
    idf = df.join(F.broadcast(size)).select("term", "avgdl", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weights = small(asked.join(small(idf), "term").select("qid", "term", "avgdl", (F.col("idf") * F.col("qtf")).alias("w")))
    tf = F.col("tf").cast("double")
    part = F.col("w") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    placed = hits.repartition("doc_id").join(weights, "term")
    return placed.groupBy("doc_id", "qid").agg(F.round(F.sum(part), 9).alias("score"))


def _bm25_documents(asked: DataFrame, index: DataFrame, size: DataFrame, df: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """Top-k documents by BM25 over a document index: the weights of the terms travel, each document is scored in its task."""
    kinds = asked.schema["qid"].dataType, index.schema["doc_id"].dataType
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    held = asked.join(df, "term").join(F.broadcast(size)).select("qid", "term", "avgdl", (idf * F.col("qtf")).alias("w")).toPandas()  # at most MAX_QUERY_TERMS rows
    schema = T.StructType([T.StructField("qid", kinds[0]), T.StructField("doc_id", kinds[1]), T.StructField("score", T.DoubleType())])
    if held.empty:
        return asked.sparkSession.createDataFrame([], schema.add("rank", T.IntegerType()))
    codes, names = pd.factorize(held["term"])
    query, qids = pd.factorize(held["qid"])
    order, avgdl = np.argsort(codes, kind="stable"), float(held["avgdl"].iloc[0])
    weight, query = held["w"].to_numpy()[order], query[order]  # the queries of a term lie together
    width = np.bincount(codes, minlength=len(names))
    first, names = np.cumsum(width) - width, pa.array(names.tolist(), pa.string())
    qids, n_q, rows = pa.array(qids.tolist(), to_arrow_type(kinds[0])), len(qids), max(1, min(INDEX_ROWS, SCORE_CELLS // len(qids)))

    def block(ids: pa.Array, dl: np.ndarray, at: np.ndarray, sizes: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        known = at >= 0
        doc, at, tf = np.repeat(np.arange(len(dl)), sizes)[known], at[known], tf[known].astype(float)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / avgdl))
        many = width[at]
        ends = np.cumsum(many)
        scores, seen = np.zeros(n_q * len(dl)), np.zeros(n_q * len(dl), dtype=bool)
        cuts = np.searchsorted(ends, np.arange(PRODUCTS, ends[-1], PRODUCTS)) if len(ends) else []
        for own in np.split(np.arange(len(at)), cuts):
            n = many[own]
            posting = np.repeat(own, n)
            place = first[at[posting]] + np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n)
            cell = query[place] * len(dl) + doc[posting]
            scores += np.bincount(cell, weight[place] * part[posting], len(scores))
            seen[cell] = True
        scores, seen = np.round(scores, 9).reshape(n_q, -1), seen.reshape(n_q, -1)
        texts, found, docs = ids.to_numpy(zero_copy_only=False), [], []
        for i in range(n_q):
            near = np.flatnonzero(seen[i])
            if len(near) > k:
                near = near[scores[i, near] >= np.partition(scores[i, near], len(near) - k)[len(near) - k]]
            near = near[np.lexsort((texts[near], -scores[i, near]))][:k]
            found.append(np.full(len(near), i))
            docs.append(near)
        found, docs = np.concatenate(found), np.concatenate(docs)
        return pa.RecordBatch.from_arrays([qids.take(pa.array(found)), ids.take(pa.array(docs)), pa.array(scores[found, docs])], ["qid", "doc_id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, dl = _lengths(batch.column(2)), pc.fill_null(batch.column(1), 0).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(batch.column(2).flatten(), names), -1).to_numpy(zero_copy_only=False)
            tf, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
            for i in range(0, batch.num_rows, rows):
                j = min(i + rows, batch.num_rows)
                own = slice(ends[i], ends[j])
                yield block(batch.column(0).slice(i, j - i), dl[i:j], at[own], sizes[i:j], tf[own])
    return _best(index.select("doc_id", "dl", "term", "tf").mapInArrow(scan, schema), k)


def corpus_size(index: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """One row: number of documents and their mean length (empty documents count when ``corpus`` is given, or in a document index)."""
    if _by_document(index):
        return index.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    if corpus is not None:
        return corpus.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(terms("contents"))).alias("avgdl"))
    per = index.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    return per.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def _asked_terms(queries: DataFrame, stem: bool) -> DataFrame:
    """(qid, term, qtf) of the queries."""
    asked = queries.select("qid", F.inline(term_counts(terms("query")))).withColumnRenamed("tf", "qtf")
    return asked.withColumn("term", stem_terms("term")).groupBy("qid", "term").agg(F.sum("qtf").alias("qtf")) if stem else asked


def bm25_topk(queries: DataFrame, corpus: DataFrame | None, k: int, stem: bool = False, k1: float = 1.5, b: float = 0.75,
              index: DataFrame | None = None, size: DataFrame | None = None, index_stemmed: bool = False) -> DataFrame:
    """Top-k documents per query by BM25: qid, doc_id, score, rank; ties by doc id.

    ``queries``: qid, query.  ``corpus``: doc_id, contents; ``index`` (from :func:`postings`)
    and ``size`` may be passed when they are already written.  Postings are cut to the
    query terms first and written once, unless ``index`` is a stored table.  They move once, by document; scoring a document against all
    queries then happens where it lies, and only ``k`` rows per query and task move again.
    With ``stem`` the stemmer runs on distinct terms only, and without ``index`` a corpus is counted as a document index
    cut to the query stems, so that no posting moves; ``index_stemmed`` says that
    ``index`` already went through :func:`stemmed`.  ``index`` may also be a :func:`document_index`, stemmed by
    :func:`stem_documents`; then no posting moves at all.
    """
    if index is not None and _by_document(index):
        index = stem_documents(index) if stem and not index_stemmed else index
        size = corpus_size(index) if size is None else size
        asked = _asked_terms(queries, stem)
        if fits(asked, MAX_QUERY_TERMS):
            return _bm25_documents(asked, index, size, document_frequencies(index, asked.select("term").distinct()), k, k1, b)
        index, index_stemmed = index.select("doc_id", "dl", F.inline(F.arrays_zip("term", "tf"))), True
    stored = index is not None
    if stem and not stored and size is None:
        asked = _asked_terms(queries, stem)
        if fits(asked, MAX_QUERY_TERMS):
            return _bm25_stemmed(asked, corpus, k, k1, b)
    index = index if stored else postings(corpus)
    size = corpus_size(index, corpus) if size is None else size
    asked = _asked_terms(queries, stem)
    small = F.broadcast if fits(asked, MAX_QUERY_TERMS) else (lambda df: df)
    if stem and not index_stemmed:
        vocabulary = index.select("term").distinct().withColumn("stem", stem_terms("term"))
        wanted = vocabulary.join(small(asked.select(F.col("term").alias("stem")).distinct()), "stem")
        hits = index.join(wanted, "term").groupBy("doc_id", "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    else:
        hits = index.join(small(asked.select("term").distinct()), "term").select("doc_id", "dl", "term", "tf")
    if not stored:
        hits = materialize(hits, "hits")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = _score_postings(hits, df, asked, size, k1, b, small)
    return top_rows(scored, ["qid"], [F.col("score").desc(), F.col("doc_id")], k, "rank").select("qid", "doc_id", "score", "rank")


# --- vectors ------------------------------------------------------------------

def hash_vectors(corpus: DataFrame, key: str = "doc_id", text: str = "contents", dims: int = 256, model=None, index: DataFrame | None = None):
    """(vectors, model): texts as normalised hashed tf-idf vectors; pass ``model`` to embed queries alike.

    ``index``: the :func:`document_index` of the corpus, if it is written, spares cutting the texts into terms again;
    the hashed counts are then written too, so that fitting and use hash them once.
    """
    rows = corpus.select(F.col(key), terms(text).alias("_terms"))
    if index is not None:
        again = F.transform(F.arrays_zip("term", "tf"), lambda x: F.array_repeat(x["term"], x["tf"]))
        rows = index.select(F.col("doc_id").alias(key), F.flatten(again).alias("_terms"))
    hashing, weigh, normalise = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims), IDF(inputCol="_tf", outputCol="_w"), Normalizer(inputCol="_w", outputCol="_v")
    if model is None and index is not None:
        counts = materialize(hashing.transform(rows).select(key, "_tf"), "counts")
        fitted = weigh.fit(counts)
        return normalise.transform(fitted.transform(counts)).select(key, vector_to_array("_v").alias("embedding")), PipelineModel([hashing, fitted, normalise])
    if model is None:
        model = Pipeline(stages=[hashing, weigh, normalise]).fit(rows)
    return model.transform(rows).select(key, vector_to_array("_v").alias("embedding")), model


def _unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norm == 0, 1.0, norm)


def _block_topk(qids, q: np.ndarray, ids, v: np.ndarray, k: int) -> pd.DataFrame:
    """Top-k of one block of vectors for each query of a block; ties at the edge by id."""
    q, v, ids = _unit(q), _unit(v).T, np.asarray(ids)
    at, docs, found = [], [], []
    for i in range(len(qids)):
        if i % 256 == 0:  # not all queries at once: the scores of a batch stay small
            scores = np.round(q[i:i + 256] @ v, 9)
        row = scores[i % 256]
        edge = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
        near = np.flatnonzero(row >= edge)
        near = near[np.lexsort((ids[near], -row[near]))][:k]
        at += [qids[i]] * len(near)
        docs.append(ids[near])
        found.append(row[near])
    return pd.DataFrame({"qid": at, "doc_id": np.concatenate(docs), "score": np.concatenate(found)}) if docs else pd.DataFrame({"qid": [], "doc_id": [], "score": []})


def _best(parts: DataFrame, k: int) -> DataFrame:
    return top_rows(parts, ["qid"], [F.col("score").desc(), F.col("doc_id")], k, "rank").select("qid", "doc_id", "score", "rank")


def _by_value(fn):
    from pyspark.cloudpickle import register_pickle_by_value
    import sys
    register_pickle_by_value(sys.modules[fn.__module__])
    return fn


_by_value(_block_topk)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, method: str = "exact", max_queries: int = MAX_BROADCAST_QUERIES,
                block_rows: int = BLOCK_ROWS, tables: int = LSH_TABLES, bits: int = 6) -> DataFrame:
    """Cosine top-k: qid, doc_id, score, rank.  ``queries``: qid, embedding; ``vectors``: doc_id, embedding.

    ``exact``: up to ``max_queries`` queries go to every task as one matrix, each Arrow
    batch of vectors is one matrix product and leaves only ``k`` rows per query.  More
    queries than that meet the vectors in blocks of bounded size.  ``lsh`` compares only
    vectors that share a sign pattern with the query, or all but one sign of it, in one of
    the ``tables``; a crowded pattern is cut into blocks, never dropped.
    """
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["doc_id"]
    schema = f"qid {kinds[0]}, doc_id {kinds[1]}, score double"
    if method == "exact" and fits(queries, max_queries):
        held = queries.select("qid", "embedding").toPandas()
        if held.empty:
            return queries.sparkSession.createDataFrame([], schema + ", rank int")
        qids, matrix = held["qid"].tolist(), np.asarray(held["embedding"].tolist(), dtype="float64")

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    v = np.asarray(batch["embedding"].tolist(), dtype="float64")
                    yield _block_topk(qids, matrix, batch["doc_id"].to_numpy(), v, k)

        return _best(vectors.select("doc_id", "embedding").mapInPandas(scan, schema), k)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "doc_id": [], "score": []})
        q, v = (np.asarray(x["embedding"].tolist(), dtype="float64") for x in (left, right))
        return _block_topk(left["qid"].tolist(), q, right["doc_id"].to_numpy(), v, k)

    if method == "exact":
        n_q = -(-queries.count() // max_queries)
        n_v = -(-vectors.count() // block_rows) or 1
        q = queries.withColumn("qb", (F.xxhash64("qid") % n_q + n_q) % n_q).withColumn("vb", F.explode(F.lit(list(range(n_v))).cast("array<bigint>")))
        v = vectors.withColumn("vb", (F.xxhash64("doc_id") % n_v + n_v) % n_v).withColumn("qb", F.explode(F.lit(list(range(n_q))).cast("array<bigint>")))
        parts = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(meet, schema)
        return _best(parts, k)
    if method != "lsh":
        raise ValueError(f"unknown method {method!r}")
    width = len(vectors.select("embedding").first()["embedding"])
    planes = np.random.default_rng(42).standard_normal((width, tables * bits))
    weights = 1 << np.arange(bits, dtype="int64")

    def signs(df: DataFrame, key: str, flips: Sequence[int]) -> DataFrame:
        def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                on = np.asarray(batch["embedding"].tolist(), dtype="float64").reshape(len(batch), width) @ planes > 0
                codes = on.reshape(len(batch), tables, bits) @ weights
                yield batch.assign(cells=[[f"{t}:{c ^ flip}" for t, c in enumerate(row) for flip in flips] for row in codes])

        kinds = dict(df.dtypes)
        coded = df.select(key, "embedding").mapInPandas(code, f"{key} {kinds[key]}, embedding {kinds['embedding']}, cells array<string>")
        return coded.select(key, "embedding", F.explode("cells").alias("cell"))

    v, q = signs(vectors, "doc_id", [0]), signs(queries, "qid", [0, *weights.tolist()])
    parts_of = v.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    q = q.join(parts_of, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).withColumn(
        "qpart", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // max_queries)))))
    v = v.join(parts_of, "cell").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts").cast("bigint")))
    v = v.join(q.select("cell", "part", "qpart").distinct(), ["cell", "part"])
    at = ["cell", "part", "qpart"]
    left, right = (df.select(key, "embedding", F.concat_ws("/", *at).alias("block")) for df, key in ((q, "qid"), (v, "doc_id")))
    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(meet, schema)
    return _best(found.distinct(), k)


def rrf_fuse(lists: Sequence[DataFrame], k: int | Sequence[int] = 60, top: int = 5) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, doc_id, rank): Σ 1 / (k + rank), for each ``k`` asked."""
    ks = [k] if isinstance(k, int) else list(k)
    every = reduce(DataFrame.unionByName, [df.select("qid", "doc_id", "rank") for df in lists])
    grid = every.withColumn("k", F.explode(F.lit(ks)))
    scores = grid.groupBy("k", "qid", "doc_id").agg(F.round(F.sum(1.0 / (F.col("k") + F.col("rank"))), 12).alias("score"))
    return top_rows(scores, ["k", "qid"], [F.col("score").desc(), F.col("doc_id")], top, "rank")


def expansion_documents(queries: DataFrame, corpus: DataFrame, n_docs: int = 3, **search) -> DataFrame:
    """qid, doc_id, rank, contents of the documents that expansions draw on; written, so that no join moves the corpus."""
    top = materialize(bm25_topk(queries, corpus, n_docs, **search).select("qid", "doc_id", "rank"), "top")
    return materialize(corpus.select("doc_id", "contents").join(top, "doc_id").select("qid", "doc_id", "rank", "contents"), "found")


def expand_queries(queries: DataFrame, corpus: DataFrame, method: str = "none", n_docs: int = 3, n_terms: int = 5,
                   found: DataFrame | None = None, **search) -> DataFrame:
    """Queries after expansion: qid, part, query.  ``found``: the :func:`expansion_documents`, when they are already there.

    ``multi_query_expansion`` adds the heaviest terms of the top documents as a second
    query, ``hyde`` adds the top document as a pseudo answer, ``query_decompose`` gives
    one row per sentence.
    """
    plain = queries.select("qid", F.lit(0).alias("part"), "query")
    if method == "none":
        return plain
    if method == "query_decompose":
        return queries.select("qid", F.posexplode(sentences("query")).alias("part", "query"))
    if found is None:
        top = bm25_topk(queries, corpus, n_docs, **search)
        found = top.join(corpus.select("doc_id", "contents"), "doc_id")
    if method == "hyde":
        best = found.where("rank = 1")
        return plain.unionByName(best.select("qid", F.lit(1).alias("part"), F.col("contents").alias("query")))
    if method != "multi_query_expansion":
        raise ValueError(f"unknown expansion {method!r}")
    tf = found.select("qid", F.inline(term_counts(terms("contents")))).groupBy("qid", "term").agg(F.sum("tf").alias("tf"))
    index = search.get("index")
    index = postings(corpus) if index is None else index
    if _by_document(index):
        size = index.agg(F.count_if(F.col("dl") > 0).alias("n"))
        df = document_frequencies(index, tf.select("term").distinct())
    else:
        size = index.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("n"))
        df = index.join(tf.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("tf") * F.ln((F.col("n") + 1) / (F.col("df") + 0.5))
    heavy = top_rows(tf.join(df, "term").join(F.broadcast(size)).withColumn("w", F.round(weight, 9)), ["qid"],
                     [F.col("w").desc(), F.col("term")], n_terms, "place")
    extra = heavy.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("t"))
    return plain.unionByName(extra.select("qid", F.lit(1).alias("part"), F.concat_ws(" ", F.col("t.term")).alias("query")))


# --- questions, prompts and answers -------------------------------------------

def synthesize_qa(corpus: DataFrame, n: int = 24, seed: int = 42, n_terms: int = 8, index: DataFrame | None = None) -> DataFrame:
    """Question-answer pairs from ``n`` sampled chunks: qid, query, retrieval_gt, generation_gt.

    The answer is the sentence with the highest summed idf, the question its rarest
    terms, the ground truth the chunk itself.  ``index``: the :func:`document_index` of the corpus, if it is written.
    """
    picked = sample_n(corpus.select("doc_id", "contents"), "doc_id", n, seed)
    picked = picked if index is None else materialize(picked, "picked")
    parts = picked.select("doc_id", F.posexplode(sentences("contents")).alias("pos", "sentence"))
    words_of = parts.select("doc_id", "pos", "sentence", F.explode(F.array_distinct(terms("sentence"))).alias("term"))
    total = corpus.agg(F.count(F.lit(1)).alias("n"))
    if index is None:
        seen = corpus.select(F.explode(F.array_distinct(terms("contents"))).alias("term"))
        df = seen.join(words_of.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    else:
        df = document_frequencies(index, words_of.select("term").distinct())
    scored = words_of.join(df, "term").join(F.broadcast(total)).withColumn("idf", F.ln(F.col("n") / F.col("df")))
    per = scored.groupBy("doc_id", "pos", "sentence").agg(
        F.round(F.sum("idf"), 9).alias("weight"),
        F.slice(F.sort_array(F.collect_list(F.struct((-F.round("idf", 9)).alias("w"), "term"))), 1, n_terms).alias("t"))
    best = top_rows(per, ["doc_id"], [F.col("weight").desc(), F.col("pos")])
    return best.select(F.md5(F.concat(F.lit("q"), F.col("doc_id").cast("string"))).alias("qid"), F.concat_ws(" ", F.col("t.term")).alias("query"),
                       F.array("doc_id").alias("retrieval_gt"), F.trim("sentence").alias("generation_gt"))


def drop_dont_know(qa: DataFrame, answer: str = "generation_gt") -> DataFrame:
    """Without the rows whose answer says it does not know."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    knows = F.lit(True)
    for phrase in DONT_KNOW:
        knows = knows & ~text.contains(phrase)
    return qa.where(knows)


def make_prompts(hits: DataFrame, style: str = "grounded_concise") -> DataFrame:
    """One prompt per query with its passages in rank order (top-k hits, so a bounded list)."""
    template = PROMPTS.get(style, PROMPTS["grounded_concise"])
    rows = hits.groupBy("qid", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "contents"))).alias("p"))
    passages = F.array_join(F.col("p.contents"), "\n\n")
    before, rest = template.split("{query}")
    middle, after = rest.split("{retrieved_contents}")
    return rows.select("qid", F.concat(F.lit(before), "query", F.lit(middle), passages, F.lit(after)).alias("prompt"))


def extract_answers(hits: DataFrame) -> DataFrame:
    """The retrieved sentence that shares most terms with the question, else that nothing is known."""
    asked = F.array_distinct(terms("query"))
    rows = hits.select("qid", "rank", asked.alias("_q"), F.posexplode(sentences("contents")).alias("pos", "sentence"))
    overlap = F.size(F.array_intersect(F.array_distinct(terms("sentence")), "_q"))
    best = top_rows(rows.withColumn("overlap", overlap), ["qid"], [F.col("overlap").desc(), F.col("rank"), F.col("pos")])
    every = hits.select("qid").distinct()
    return every.join(best, "qid", "left").select(
        "qid", F.when(F.col("overlap") > 0, F.trim("sentence")).otherwise(NO_ANSWER).alias("answer"))


# --- metrics ------------------------------------------------------------------

def retrieval_scores(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Recall, precision and f1 per query with ground truth; no hits give 0."""
    right = qrels.select("qid", "doc_id").distinct()
    got = hits.select("qid", "doc_id").distinct()
    wanted = right.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gt"))
    found = got.join(right.withColumn("_r", F.lit(1)), ["qid", "doc_id"], "left").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count("_r").alias("n_right"))
    rows = wanted.join(found, "qid", "left").na.fill(0, ["n_hits", "n_right"])
    recall = F.col("n_right") / F.col("n_gt")
    precision = F.coalesce(F.try_divide("n_right", "n_hits"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * recall * precision, recall + precision), F.lit(0.0))
    return rows.select("qid", recall.alias("retrieval_recall"), precision.alias("retrieval_precision"), f1.alias("retrieval_f1"))


def retrieval_metrics(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean over queries of :func:`retrieval_scores`."""
    names = ("retrieval_recall", "retrieval_precision", "retrieval_f1")
    return retrieval_scores(hits, qrels).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def qrels_by_containment(items: DataFrame, docs: DataFrame, anchor: int = 6) -> DataFrame:
    """(qid, doc_id) of documents whose text contains the item's text, without comparing all pairs.

    An inner run of the item's words must occur as whole words in any document that
    contains the item; documents are joined on the hash of that run and the text is then compared.
    ``items``: qid, query.  ``docs``: doc_id, text.  Items of fewer than three words have
    no inner word and are not supported.
    """
    w = words("query")
    usable = items.select("qid", "query", w.alias("_w"))
    span = F.when(F.size("_w") >= anchor + 2, F.lit(anchor)).otherwise(F.lit(1))
    keyed = usable.where(F.size("_w") >= 3).select("qid", "query", span.alias("n"), F.xxhash64(F.slice("_w", F.lit(2), span)).alias("gram"))
    spans = sorted(r["n"] for r in keyed.select("n").distinct().collect())
    if items.where(F.size(w) < 3).limit(1).count():
        raise ValueError("items need at least three words")
    rows = docs.select("doc_id", "text", words("text").alias("_w"))

    def runs(n: int) -> Column:
        at = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("_w", i, n)).alias("gram")))

    found = rows.select("doc_id", F.inline(F.flatten(F.array(*[runs(n) for n in spans])))).join(keyed, ["n", "gram"])
    candidates = found.select("qid", "query", "doc_id").distinct()
    return candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "query")).select("qid", "doc_id")


def _ngrams(tokens: Column, n: int) -> Column:
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


@F.pandas_udf(T.IntegerType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([pt.lcs_length(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


def rouge(pairs: DataFrame, key: Sequence[str], kinds: Sequence[str] = ("rouge1", "rouge2", "rougeL")) -> DataFrame:
    """F measures per candidate, the best over its references.

    ``pairs``: the key columns, ``candidate`` and ``reference``, one row per reference.
    N-gram overlap and the subsequence are computed inside the row.
    """
    rows = pairs.select(*key, terms("candidate").alias("_c"), terms("reference").alias("_r"))

    def f_measure(match: Column, a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(2.0 * match, a + b), F.lit(0.0))

    def overlap(n: int) -> Column:
        c = term_counts(_ngrams(F.col("_c"), n))
        r = F.map_from_entries(term_counts(_ngrams(F.col("_r"), n)))
        shared = F.transform(F.array(r), lambda m: F.aggregate(c, F.lit(0), lambda acc, e: acc + F.least(
            e["tf"], F.coalesce(F.try_element_at(m, e["term"]), F.lit(0)))))[0]
        size = lambda x: F.greatest(F.size(x) - (n - 1), F.lit(0))
        return f_measure(shared, size("_c"), size("_r"))

    values = {"rouge1": lambda: overlap(1), "rouge2": lambda: overlap(2),
              "rougeL": lambda: f_measure(_lcs("_c", "_r"), F.size("_c"), F.size("_r"))}
    scored = rows.select(*key, *[values[k]().alias(k) for k in kinds])
    return scored.groupBy(*key).agg(*[F.max(k).alias(k) for k in kinds])


# --- choosing -----------------------------------------------------------------

def select_strategy(scores: DataFrame, how: str = "mean") -> DataFrame:
    """The module with the best mean metric, or the best mean of min-max normalised metrics.

    ``scores``: module, metric, value.
    """
    per = scores.groupBy("module", "metric").agg(F.avg("value").alias("v"))
    if how == "normalize_mean":
        span = per.groupBy("metric").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        per = per.join(span, "metric").withColumn("v", F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)))
    elif how != "mean":
        raise ValueError(f"unknown strategy {how!r}")
    means = per.groupBy("module").agg(F.round(F.avg("v"), 9).alias("score"))
    return means.orderBy(F.col("score").desc(), "module").limit(1)


def flatten_node_metrics(summaries: DataFrame) -> DataFrame:
    """(run_id, metric, value): per node its best row (else the first), metric names cut to the
    known suffix, a later node overriding an earlier one.

    ``summaries``: run_id, node, seq, is_best and metric columns.
    """
    def canonical(name: str) -> str | None:
        return next((m for m in reversed(RUN_METRICS) if name == m or name.endswith("_" + m)), None)

    columns = [(c, canonical(c)) for c in summaries.columns if canonical(c)]
    best = top_rows(summaries.where(F.col("node").isin(*NODE_ORDER)), ["run_id", "node"],
                    [F.coalesce("is_best", F.lit(False)).desc(), F.col("seq")])
    place = F.array_position(F.array(*[F.lit(n) for n in NODE_ORDER]), F.col("node"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("at"), F.col(c).cast("double").alias("value")) for i, (c, m) in enumerate(columns)])
    rows = best.select("run_id", place.alias("place"), F.inline(cells)).where("value is not null")
    return rows.groupBy("run_id", "metric").agg(F.max_by("value", F.struct("place", "at")).alias("value"))


def route_problem(texts: DataFrame, text: str = "text", taxonomy: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Problem type with most keyword hits per text, ties by taxonomy order; null when no word occurs."""
    types = taxonomy or TAXONOMY
    low = F.lower(F.col(text))
    scores = [sum((low.contains(k.lower()).cast("int") for k in ks), F.lit(0)) for ks in types.values()]
    rows = texts.withColumn("_s", F.array(*scores))
    best = F.array_max("_s")
    names = F.array(*[F.lit(n) for n in types])
    return rows.withColumn("hits", best).withColumn(
        "problem_type", F.when(best > 0, F.element_at(names, F.array_position("_s", best).cast("int")))).drop("_s")
