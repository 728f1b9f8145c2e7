"""User functions over batches and rows, and the chunkers as an SQL table function."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from trialmesh.functions import python_text as pt


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user function to every record batch."""
    def run(batches):
        for batch in batches:
            yield fn(batch)
    return df.mapInPandas(run, schema)


def filter_rows(df: DataFrame, predicate: Column | Callable[..., pd.Series], columns: tuple[str, ...] = (), **options) -> DataFrame:
    """Keep rows that pass: a column predicate, or a function of pandas series (with options) returning booleans."""
    if isinstance(predicate, Column):
        return df.where(predicate)
    if not columns:
        raise ValueError("name the columns the predicate reads")

    @F.pandas_udf(T.BooleanType())
    def passes(rows: pd.DataFrame) -> pd.Series:
        return predicate(*[rows[c] for c in columns], **options).astype(bool)

    return df.where(passes(F.struct(*columns)))


def register_chunk_udtf(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make ``SELECT … FROM t, LATERAL chunk_text(text, 'token', 512, 64)`` available; rows travel in Arrow batches."""
    chunkers = pt.CHUNKERS

    @F.udtf(returnType="chunk_index int, contents string", useArrow=True)
    class ChunkText:
        def eval(self, text: str, method: str, size: int, overlap: int):
            if method not in chunkers:
                raise ValueError(f"unknown chunker {method!r}, have {sorted(chunkers)}")
            for i, piece in enumerate(chunkers[method](text, size, overlap) if text else []):
                yield i, piece

    spark.udtf.register(name, ChunkText)


def chunk_udtf(df: DataFrame, key: str, method: str, size: int, overlap: int, text: str = "text") -> DataFrame:
    """A chunker chosen by name, through the SQL table function."""
    spark = df.sparkSession
    register_chunk_udtf(spark)
    return spark.sql(
        "SELECT d.key, c.chunk_index, c.contents FROM {docs} d, LATERAL chunk_text(d.text, :method, :size, :overlap) c",
        args={"method": method, "size": size, "overlap": overlap},
        docs=df.select(F.col(key).alias("key"), F.col(text).alias("text"))).withColumnRenamed("key", key)


def register_chunk_table(spark: SparkSession, name: str = "chunk_table") -> None:
    """Make ``SELECT * FROM chunk_table(TABLE(docs), 'token', 512, 64, 'text')`` available.

    The result has all columns of the table, whatever they are, then ``chunk_index`` and ``contents``; its schema and
    the arguments are checked when the query is planned.  A row without text has no chunks.  Rows stay where they lie;
    with ``PARTITION BY`` they are brought together first.
    """
    chunkers = pt.CHUNKERS

    @dataclass
    class Plan(AnalyzeResult):
        at: int = 0

    class ChunkTable:
        def __init__(self, plan: Plan):
            self.at = plan.at

        @staticmethod
        def analyze(rows: AnalyzeArgument, method: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table: TABLE(name)")
            if method.value not in chunkers:
                raise ValueError(f"unknown chunker {method.value!r}, have {sorted(chunkers)}")
            names = rows.dataType.names
            if text.value not in names or not isinstance(rows.dataType[text.value].dataType, T.StringType):
                raise ValueError(f"no text column {text.value!r} among {names}")
            taken = {"chunk_index", "contents"} & set(names)
            if taken:
                raise ValueError(f"the table has {sorted(taken)} already")
            schema = T.StructType([*rows.dataType.fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("contents", T.StringType())])
            return Plan(schema, at=names.index(text.value))

        def eval(self, row: T.Row, method: str, size: int, overlap: int, text: str):
            for i, piece in enumerate(chunkers[method](row[self.at], size, overlap) if row[self.at] else []):
                yield (*row, i, piece)

    spark.udtf.register(name, F.udtf(ChunkTable))


def chunk_table(df: DataFrame, method: str, size: int, overlap: int, text: str = "text") -> DataFrame:
    """A chunker chosen by name, through the SQL function over a whole table; all columns are kept."""
    spark = df.sparkSession
    register_chunk_table(spark)
    return spark.sql("SELECT * FROM chunk_table(TABLE(SELECT * FROM {docs}), :method, :size, :overlap, :text)",
                     args={"method": method, "size": size, "overlap": overlap, "text": text}, docs=df)
