"""The corpus pipeline: its stages in order, each reading what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialmesh.llm import byte_bpe, decontaminate, line_dedup, minhash, quality
from trialmesh.llm.common import bit_map, marked, remove, store, table
from trialmesh.llm.queries import split_pattern, vocabulary


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.7); columns as they are.

    Null and empty texts are scored like others, repeated rows and ids each time, null ids too; an empty table stays
    empty, and without any labelled row everything is accepted.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more documents share; n_chars is counted anew.

    Null text becomes empty; rows that repeat a doc_id are one document and each keeps its own lines, rows without
    doc_id lose nothing and count nowhere; an empty table stays empty.
    """
    found = line_dedup.dedup_lines(docs).select(*docs.columns)
    return found.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; rows without doc_id stay.

    Rows that repeat a doc_id stay or go together; empty texts are no duplicates; an empty table stays empty.  Only
    rows that a bit map of the ids to drop finds are shuffled for the join, the others pass on where they lie.
    """
    drop = minhash.near_duplicates(docs, size=5, percent=80).where("NOT kept").select("doc_id").distinct()
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("_row"))
    tested = marked(rows, bit_map(drop, F.col("doc_id")), F.col("doc_id"), "_some")
    left = tested.where("_some").join(drop, "doc_id", "left_anti")
    return tested.where("NOT _some").select("_row.*").unionByName(left.select("_row.*"))


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; columns as they are.

    Null and empty texts hold no item and stay, as do rows without doc_id; repeated rows are searched each time; an
    empty table stays empty, and an empty benchmark drops nothing.
    """
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, the text decoded from them, and the digests of both.

    Null and empty texts have no ids; repeated rows and null ids have a row each; an empty table gives no rows.
    """
    return byte_bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), contents=True)


STAGES = [("quality", quality_filter), ("line_dedup", line_filter), ("near_duplicates", near_duplicate_filter),
          ("decontamination", benchmark_filter), ("byte_bpe", encode)]

#: Several stages run code that SQL cannot express; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage returns for the documents of ``sf_dir``; stages are written below the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = store(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
