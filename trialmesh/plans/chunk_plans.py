"""Parsing, chunking and user-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialmesh.operators import chunking as ops, udfs
from trialmesh.plans.registry import query

DOCS = "documents"


def _docs(t):
    return t.documents.select("doc_id", "text")


@query("parse_documents")
def _(t):
    return ops.parse_documents(t.pages, "html", "html", "url")


WORDS = r"list_filter(regexp_split_to_array(text, '[ \t\r\n\f]+'), lambda x: x <> '')"
TOKEN_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), n AS (SELECT *, len(ws) AS n FROM w WHERE len(ws) > 0),
i AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 512) / 448)) AS BIGINT) + 1)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(ws[i * 448 + 1 : i * 448 + 512], ' ') AS contents FROM i"""


@query("chunk_token", TOKEN_SQL)
def _(t):
    return ops.chunk_token(_docs(t), 512, 64)


@query("chunk_character", """
WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
i AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((n - 1200) / 1050)) AS BIGINT) + 1)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, substr(text, i * 1050 + 1, 1200) AS contents FROM i""")
def _(t):
    return ops.chunk_character(_docs(t), 1200, 150)


@query("chunk_recursive")
def _(t):
    return ops.chunk_recursive(_docs(t), 1200, 150)


@query("chunk_sentence")
def _(t):
    return ops.chunk_sentence(_docs(t), 512, 64)


@query("chunk_simple", "SELECT doc_id, CAST(0 AS INTEGER) AS chunk_index, text AS contents FROM documents")
def _(t):
    return ops.chunk_simple(_docs(t))


SENTENCES = r"list_filter(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')"


@query("chunk_sentence_window", f"""
WITH s AS (SELECT doc_id, {SENTENCES.format('text')} AS ss FROM documents), i AS (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_index, ss[i] AS contents, array_to_string(ss[greatest(1, i - 3) : i + 3], ' ') AS "window" FROM i""")
def _(t):
    return ops.chunk_sentence_window(_docs(t), 3)


@query("build_corpus", """
SELECT md5('docs/' || source || '/' || doc_id || '.txt' || '#0') AS doc_id, 'file_name: ' || doc_id || '.txt' || chr(10) || ' contents: ' || text AS contents,
  'docs/' || source || '/' || doc_id || '.txt' AS path FROM documents""")
def _(t):
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    corpus = ops.build_corpus(ops.chunk_simple(t.documents.select(path.alias("path"), "text")), add_file_name=True)
    return corpus.select("doc_id", "contents", F.col("metadata.path").alias("path"))


@query("map_batches", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_text, upper(lang) AS tag FROM documents")
def _(t):
    return udfs.map_batches(t.documents.select("doc_id", "text", "lang"), lambda b: b.assign(
        n_text=b["text"].str.len().astype("int64"), tag=b["lang"].str.upper())[["doc_id", "n_text", "tag"]], "doc_id bigint, n_text bigint, tag string")


@query("filter_rows", "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars > 1000")
def _(t):
    long = udfs.filter_rows(t.documents.select("doc_id", "lang", "n_chars"), F.col("n_chars") > 1000)
    return udfs.filter_rows(long, lambda s, wanted: s.isin(wanted), ("lang",), wanted=["en", "de"])


@query("chunk_udtf", TOKEN_SQL)
def _(t):
    return udfs.chunk_udtf(_docs(t), "doc_id", "token", 512, 64)


@query("chunk_table", f"SELECT k.*, d.lang, d.source FROM ({TOKEN_SQL}) k JOIN documents d USING (doc_id)")
def _(t):
    """The table function that takes a whole table and keeps its columns."""
    return udfs.chunk_table(t.documents.select("lang", "doc_id", "text", "source"), "token", 512, 64).drop("text")
