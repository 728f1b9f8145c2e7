"""Parsing and chunking of documents into a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.functions import python_text as pt
from trialmesh.functions.text import words


def parse_documents(df: DataFrame, fmt: str, content: str = "content", path: str = "path") -> DataFrame:
    """``doc_id``, ``text``, ``path`` and ``part`` of raw contents in one format of the parser catalogue."""
    if fmt not in pt.PARSERS:
        raise ValueError(f"no parser for {fmt!r}, have {sorted(pt.PARSERS)}")
    parser = pt.PARSERS[fmt]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [parser(c) if c is not None else [] for c in batch["content"]]
            out = pd.DataFrame({"path": batch["path"], "text": parts, "part": [list(range(len(p))) for p in parts]})
            yield out.explode(["text", "part"]).dropna(subset=["text"]).astype({"part": "int32"})

    rows = df.select(F.col(path).cast("string").alias("path"), F.col(content).alias("content"))
    parsed = rows.mapInPandas(run, "path string, text string, part int")
    return parsed.select(F.md5(F.concat_ws("#", "path", "part")).alias("doc_id"), "text", "path", "part")


def _starts(length: Column, size: int, overlap: int) -> Column:
    """Window numbers 0…n-1 that cover ``length`` units."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((length - size) / step)).cast("int")
    return F.when(length > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def chunk_token(df: DataFrame, size: int = 512, overlap: int = 64, text: str = "text") -> DataFrame:
    """Windows of ``size`` whitespace words, each starting ``size - overlap`` after the one before."""
    step = size - overlap
    rows = df.withColumn("_w", words(text))
    pieces = F.transform(_starts(F.size("_w"), size, overlap), lambda i: F.array_join(F.slice("_w", i * step + 1, size), " "))
    return rows.select(*[c for c in df.columns if c != text], F.posexplode(pieces).alias("chunk_index", "contents"))


def chunk_character(df: DataFrame, size: int = 1200, overlap: int = 150, text: str = "text") -> DataFrame:
    """Fixed character windows."""
    step = size - overlap
    pieces = F.transform(_starts(F.char_length(text), size, overlap), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(pieces).alias("chunk_index", "contents"))


def _chunk_python(df: DataFrame, name: str, size: int, overlap: int, text: str) -> DataFrame:
    cut = pt.CHUNKERS[name]
    keep = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["contents"] = [cut(t, size, overlap) if t else [] for t in batch.pop(text)]
            batch["chunk_index"] = [list(range(len(c))) for c in batch["contents"]]
            yield batch.explode(["contents", "chunk_index"]).dropna(subset=["contents"]).astype({"chunk_index": "int32"})[
                [*keep, "chunk_index", "contents"]]

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "chunk_index int", "contents string"])
    return df.mapInPandas(run, schema)


def chunk_recursive(df: DataFrame, size: int = 1200, overlap: int = 150, text: str = "text") -> DataFrame:
    """Cut by paragraph, line, space, then character until pieces fit; merge them up to ``size`` characters."""
    return _chunk_python(df, "recursive", size, overlap, text)


def chunk_sentence(df: DataFrame, size: int = 512, overlap: int = 64, text: str = "text") -> DataFrame:
    """Whole sentences packed up to ``size`` words."""
    return _chunk_python(df, "sentence", size, overlap, text)


def chunk_simple(df: DataFrame, text: str = "text") -> DataFrame:
    """One chunk per document."""
    return df.select(*[c for c in df.columns if c != text], F.lit(0).alias("chunk_index"), F.col(text).alias("contents"))


def sentences(text: str | Column) -> Column:
    """Sentences of a text: cut after . ! or ? followed by white space; blanks dropped."""
    c = F.col(text) if isinstance(text, str) else text
    marked = F.regexp_replace(c, r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def chunk_sentence_window(df: DataFrame, w: int = 3, text: str = "text") -> DataFrame:
    """Each sentence with ``w`` neighbours on both sides as its window; made inside the row, no shuffle."""
    rows = df.withColumn("_s", sentences(text))
    pieces = F.transform("_s", lambda s, i: F.struct(s.alias("contents"), F.array_join(
        F.slice("_s", F.greatest(F.lit(1), i + 1 - w), F.least(i, F.lit(w)) + w + 1), " ").alias("window")))
    flat = rows.select(*[c for c in df.columns if c != text], F.posexplode(pieces).alias("chunk_index", "_p"))
    return flat.select(*[c for c in flat.columns if c != "_p"], F.col("_p.contents").alias("contents"), F.col("_p.window").alias("window"))


def build_corpus(chunks: DataFrame, path: str = "path", add_file_name: bool = False) -> DataFrame:
    """``doc_id`` (md5 of path and index), ``contents`` (optionally led by the file name) and ``metadata``."""
    p = F.col(path).cast("string")
    name = F.element_at(F.split(p, "/"), -1)
    body = F.concat(F.lit("file_name: "), name, F.lit("\n contents: "), "contents") if add_file_name else F.col("contents")
    return chunks.select(
        F.md5(F.concat_ws("#", p, F.col("chunk_index").cast("string"))).alias("doc_id"), body.alias("contents"),
        F.create_map(F.lit("path"), p, F.lit("chunk_index"), F.col("chunk_index").cast("string")).alias("metadata"))
