"""Tables kept as blocks of numpy arrays, for passes that read all rows again and again in Python.

Handing a row to Python costs more than adding it up there.  A block is one row that holds the values of some
thousand rows as bytes, so that a pass hands over few large values.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame

register_pickle_by_value(sys.modules[__name__])


def to_blocks(df: DataFrame, kinds: dict[str, str], change: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> DataFrame:
    """A row per Arrow batch of ``df``: of each column its numbers (numpy types ``kinds``), of lists place after place.

    ``change`` names columns whose numbers, of lists as (place, row), go through a function first.
    """
    changes = change or {}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = []
                for name, kind in kinds.items():
                    column = batch.column(name)
                    if pa.types.is_list(column.type):
                        values = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T
                    else:
                        values = column.to_numpy(zero_copy_only=False)
                    values = changes[name](values) if name in changes else values
                    found.append(pa.array([np.ascontiguousarray(values, dtype=kind).tobytes()], pa.binary()))
                yield pa.RecordBatch.from_arrays(found, list(kinds))
    return df.select(*kinds).mapInArrow(pack, ", ".join(f"{name} binary" for name in kinds))


def block_arrays(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> Iterator[list[np.ndarray]]:
    """The columns of each block: the first as it is, one array a row, others as (place, row) if they were lists."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = [np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(kinds.values())]
            yield [v if len(v) == len(values[0]) else v.reshape(-1, len(values[0])) for v in values]
