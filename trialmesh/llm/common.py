"""Helpers shared by the corpus operators: tables, work tables and plain word hashing inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialmesh.session import new_path


SLICE, SLICE_BYTES, BATCH_BYTES = 200, 1 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; one stored in fewer splits than there are cores is dealt out first."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` below the shared folder; the table read back, and its path for ``remove``."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete work tables whose consumers are done, through the file system that holds them."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
                rows: int = SLICE) -> DataFrame:
    """``fn`` over slices of the Arrow batches of ``columns`` of ``df``: what it holds at a time is ``rows`` rows."""
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield fn(batch.slice(start, rows))
    return df.select(*columns).mapInArrow(each, schema)


def trim() -> None:
    """Give memory that is free inside this Python worker back to the system; the worker lives on beside the JVM."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def release() -> None:
    """``trim`` at the end of a task, after what it dropped has been collected."""
    import gc
    gc.collect()
    trim()


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most ``BATCH_BYTES``: they are copied several times on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("bB")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, rows: int = SLICE, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of strings; at least one row each."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(total), 0
    while start < batch.num_rows:
        past = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right"))
        end = min(max(past, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_slices(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str,
               rows: int = SLICE, size: int = SLICE_BYTES, done: Callable[[], object] | None = None) -> DataFrame:
    """``map_batches`` with slices that are bounded in bytes as well, and memory given back after every batch.

    ``done`` drops what ``fn`` keeps; it is called when the task ends.
    """
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, rows, size):
                    yield fn(part)
                trim()
        finally:
            if done:
                done()
            release()
    small_batches(df.sparkSession)
    return df.select(*columns).mapInArrow(each, schema)


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def in_fold(key: str = "doc_id") -> Column:
    """Whether a row belongs to the held-out fold: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def dealt_anew(df: DataFrame, column: str) -> DataFrame:
    """``df`` in another order of partitions than its grouping left it.

    A join that reuses the partitioning of a grouping cannot be split where the other side has a hot key; after this
    both sides get a shuffle of their own for the join, and adaptive execution splits it.
    """
    return df.repartition(column)


def bit_map(rows: DataFrame, key: Column, bits: int = 24) -> DataFrame:
    """Bits of the keys' places, 64 to a row: (_word, _bits), at most ``2 ** (bits - 6)`` rows whatever the input's size."""
    return rows.select(F.pmod(F.xxhash64(key), F.lit(1 << bits)).alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")).alias("_bits"))


def marked(rows: DataFrame, found: DataFrame, key: Column, out: str, bits: int = 24) -> DataFrame:
    """``rows`` with the boolean ``out``: false only where no row of the bit map had this key. The map is broadcast."""
    placed = rows.withColumn("_p", F.pmod(F.xxhash64(key), F.lit(1 << bits))).withColumn("_word", F.shiftright("_p", 6))
    return placed.join(F.broadcast(found), "_word", "left").withColumn(
        out, F.coalesce(F.expr("shiftright(_bits, CAST(_p & 63 AS INT)) & 1 = 1"), F.lit(False))).drop("_p", "_word", "_bits")


def likely(docs: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in column ``doc_id`` of ``ids``, and a few more; no text moves.

    Ids set bits of a map of ``2 ** bits`` places, 64 to a row, so what is broadcast is at most 2 ** 18 rows of two
    longs whatever the input's size.  With very many ids the map fills up and more rows pass.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    marked = ids.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")).alias("_bits"))
    placed = docs.withColumn("_p", place)
    held = placed.join(F.broadcast(marked), F.shiftright(F.col("_p"), 6) == F.col("_word"))
    return held.where(F.expr("shiftright(_bits, CAST(_p & 63 AS INT)) & 1 = 1")).select(*docs.columns)
