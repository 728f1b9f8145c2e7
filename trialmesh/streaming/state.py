"""State by key in Spark's own state store: newest fields of a key, and keys that go when nothing writes them.

Both run with ``transformWithState``: the store keeps versions, restores them after a failure and grows with the keys,
not with the rows; the tables returned read it through the ``statestore`` source, so nothing is stored twice.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The store that ``transformWithState`` needs, for the queries that start inside the block."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _drain(rows: DataFrame, checkpoint: str, sink: str, mode: str, path: str | None = None) -> None:
    writer = rows.writeStream.format(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.option("path", path) if path else writer
    with _rocks(rows.sparkSession):
        writer.trigger(availableNow=True).start().awaitTermination()


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The table of a state variable as the last finished batch left it: ``key`` and ``value``, each a struct."""
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


class _Newest(StatefulProcessor):
    """Per field the value of the highest order number that is not missing."""

    def __init__(self, fields: int):
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        each = "".join(f", v{i} string, at{i} bigint" for i in range(self.fields))
        self.kept = handle.getValueState("newest", "latest bigint" + each)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = list(self.kept.get() or [None] * (1 + 2 * self.fields))
        for frame in rows:
            order = frame["order_"].to_numpy()
            if not len(order):
                continue
            found[0] = int(order.max()) if found[0] is None else max(found[0], int(order.max()))
            for i in range(self.fields):
                known = np.flatnonzero(frame[f"v{i}"].notna().to_numpy())
                if len(known):
                    place = known[order[known].argmax()]
                    if found[2 + 2 * i] is None or order[place] > found[2 + 2 * i]:
                        found[1 + 2 * i], found[2 + 2 * i] = str(frame[f"v{i}"].iloc[place]), int(order[place])
        if found[0] is not None:
            self.kept.update(tuple(found))
        return iter(())

    def close(self) -> None:
        pass


def stream_state(updates: DataFrame, key: str, order: str, fields: Sequence[str], checkpoint: str) -> DataFrame:
    """Streaming ``merge_state``: per key and field the newest value that is not missing, after all input that is there.

    ``order`` is a whole number; rows without one are left out.  Fields are of atomic types and travel as text.  Late
    rows find their place because every field keeps the number it came with.  Restarts go on from ``checkpoint``.
    """
    types = dict(updates.dtypes)
    if types[order] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{order} is no whole number")
    rows = updates.where(F.col(order).isNotNull()).select(F.col(key).alias("key_"), F.col(order).cast("bigint").alias("order_"),
                                                          *[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(fields)])
    kept = rows.groupBy("key_").transformWithStateInPandas(_Newest(len(fields)), outputStructType=f"key_ {types[key]}", outputMode="Update", timeMode="None")
    _drain(kept, checkpoint, "noop", "update")
    return _state(updates.sparkSession, checkpoint, "newest").select(
        F.col("key.key_").alias(key), *[F.col(f"value.v{i}").cast(types[c]).alias(c) for i, c in enumerate(fields)],
        F.col("value.latest").cast(types[order]).alias(order))


class _Expiring(StatefulProcessor):
    """The last write of a key and a timer that ends it; what a timer ends is the output."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("alive", "written bigint, item bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.kept.get()
        last = tuple(before) if before else None
        for frame in rows:
            for pair in zip(frame["written_"].tolist(), frame["item_"].tolist(), strict=True):
                last = pair if last is None else max(last, pair)
        if last is not None and (before is None or last != tuple(before)):
            if before:
                self.handle.deleteTimer(self._end(before[0]))
            self.handle.registerTimer(self._end(last[0]))
            self.kept.update(last)
        return iter(())

    def _end(self, written: int) -> int:
        """Milliseconds of the watermark at which a key written then is over."""
        return -(-(written + self.ttl) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.kept.get()
        if last and self._end(last[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
            yield pd.DataFrame({"key_": [key[0]], "written_": [last[0]], "item_": [last[1]]})

    def close(self) -> None:
        pass


def stream_expire_keys(writes: DataFrame, key: str, written: str, item: str, checkpoint: str, expired: str,
                       ttl: timedelta = timedelta(days=7), late: timedelta = timedelta(hours=1)) -> DataFrame:
    """Last write of every key and whether it is ``alive``, after all input that is there.

    A timer in event time ends a key ``ttl`` after its last write, once the watermark (the newest time less ``late``)
    is there; a write before that starts the clock anew, one after it starts the key again.  Ended keys go from the
    state and are appended to the table at ``expired``: that is also how a run whose heartbeat stops is noticed.
    ``item`` is a whole number that says what was written, the larger one for writes at the same moment.
    Rows without time or item are left out; rows older than the watermark count only for keys they do not start.
    """
    types, spark = dict(writes.dtypes), writes.sparkSession
    moment = F.col(written).cast("timestamp")
    rows = writes.where(F.col(written).isNotNull() & F.col(item).isNotNull()).select(
        F.col(key).alias("key_"), moment.alias("time_"), F.unix_micros(moment).alias("written_"), F.col(item).cast("bigint").alias("item_"))
    ended = rows.withWatermark("time_", f"{int(late.total_seconds() * 1000)} milliseconds").groupBy("key_").transformWithStateInPandas(
        _Expiring(int(ttl / timedelta(microseconds=1))), outputStructType=f"key_ {types[key]}, written_ bigint, item_ bigint",
        outputMode="Append", timeMode="EventTime")
    _drain(ended, checkpoint, "parquet", "append", expired)
    alive = _state(spark, checkpoint, "alive").select("key.key_", F.col("value.written").alias("written_"), F.col("value.item").alias("item_"), F.lit(True).alias("alive"))
    gone = spark.read.schema(f"key_ {types[key]}, written_ bigint, item_ bigint").parquet(expired)
    last = alive.unionByName(gone.withColumn("alive", F.lit(False))).groupBy("key_").agg(F.max(F.struct("written_", "item_", "alive")).alias("_l"))
    return last.select(F.col("key_").alias(key), F.col("_l.item_").cast(types[item]).alias(item),
                       F.timestamp_micros("_l.written_").cast(types[written]).alias(written), "_l.alive")
