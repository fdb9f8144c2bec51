"""JSON lines with the place of each record: its file, its line, and a number without gaps over all files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.sources.scratch import durable

#: Splits of files up to which their counts (some hundred bytes each) are broadcast.
BROADCAST_SPLITS = 50_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, ordinal, value) of the lines of text files: line from 1 in its file, ordinal from 0 over the lines that are not blank, files in order of name.

    A task numbers the lines of each split of a file that it reads; sums over the splits before, of which there is one row
    each, make these the numbers of the file and of all files. Blank lines count as lines, but are left out.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    def work(batches):
        at, line, record = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
            code = files.indices.to_numpy(zero_copy_only=False)
            full = np.fromiter((bool(v.strip()) for v in batch.column(0).to_pylist()), bool, n)
            lines, records = np.empty(n, np.int64), np.empty(n, np.int64)
            edges = np.append(np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(starts) != 0))), n)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                split = (files.dictionary[code[lo]].as_py(), starts[lo])
                if split != at:
                    at, line, record = split, 0, 0
                lines[lo:hi] = line + np.arange(hi - lo)
                records[lo:hi] = record + np.cumsum(full[lo:hi]) - full[lo:hi]
                line, record = line + int(hi - lo), record + int(full[lo:hi].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines), pa.array(records), pa.array(full)], ["value", "file", "start", "line", "record", "full"])

    # Written out, so that the counts and the rows come from the same splits.
    held = durable(read.mapInArrow(work, "value string, file string, start long, line long, record long, full boolean"), "lines")
    splits = held.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.count_if("full").alias("records"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # Over files: their totals, one row a file, so that the one task which adds them up holds very little.
    totals = splits.groupBy("file").agg(F.sum("records").alias("records"))
    above = totals.select("file", F.coalesce(F.sum("records").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    offsets = splits.withColumns({"lines_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "records_before": F.coalesce(F.sum("records").over(before), F.lit(0))}).drop("n", "records").join(above, "file")
    offsets = durable(offsets, "splits")
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_SPLITS else offsets
    return held.where("full").join(small, ["file", "start"]).select("file", (F.col("lines_before") + F.col("line") + 1).alias("line"), (F.col("above") + F.col("records_before") + F.col("record")).alias("ordinal"), "value")


def numbered_records(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """(file, line, ordinal, columns of schema) of the JSON objects in text files. A line that is no object of this type is an error with its file and line, or, unless strict, left out (its number stays)."""
    lines = numbered_lines(spark, path)
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    wrong = F.col("r._corrupt").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    if strict:
        if bad := parsed.where(wrong).select("file", "line").orderBy("file", "line").limit(5).collect():
            raise ValueError("no JSON object of the type: " + ", ".join(f"{r['file'].rpartition('/')[2]}:{r['line']}" for r in bad))
    return parsed.where(~wrong).select("file", "line", "ordinal", "r.*").drop("_corrupt")
