"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.sources.scratch import durable

#: Rows, and bytes of strings, that a task works on at once.
SLICE, BYTES = 1000, 8 << 20

__all__ = ["arrow_map", "column", "durable", "free_name", "long_array", "ranges", "rename", "slices", "text_bytes", "with_row_id"]


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a unique long per row. Stable as long as df is a table scan, or any plan with fixed partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def column(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def ranges(lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """lo[k], lo[k]+1, ... (sizes[k] of them), for all k in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - sizes), sizes)


def rename(df: DataFrame, **columns: str) -> DataFrame:
    """Selects only the given columns under new names, so that no other column of the input can clash."""
    return df.select(*(column(old).alias(new) for new, old in columns.items()))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null becomes empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


def slices(batch: pa.RecordBatch, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE rows and, beyond the first row, so many bytes of strings, so that what is made of long texts stays small."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if any(test(c.type) for test in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right"))
        to = min(at + SLICE, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def arrow_map(df: DataFrame, schema: T.StructType | str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """mapInArrow for work that takes one of ``slices`` at a time. The work sees the columns under names of no meaning, so that any names of df will do."""

    def run(batches):
        for batch in batches:
            yield from map(work, slices(batch))

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)


def long_array(values: list[int]) -> Column:
    """One array literal of longs, however many."""
    return F.from_json(F.lit(str(list(map(int, values)))), "array<bigint>")
