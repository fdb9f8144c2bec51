"""Incremental ingestion (an extension): new corpus records as a stream, chunked and merged into a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadmill.operators.corpus import naive_chunks
from threadmill.sources.scratch import durable
from threadmill.sources.store import KeyedStore


def chunk_stream(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """Reads JSON records as they come and merges their chunks into a ``KeyedStore``, a version for each batch that brings any.

    A batch rewrites the buckets of its chunks only. One that is run again after a failure merges the same rows again, which changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = naive_chunks(batch).select(F.concat_ws(":", F.lit("doc"), "source_id", F.lit("naive"), "chunk_no").alias("chunk_id"), "text").dropDuplicates(["chunk_id"])
        KeyedStore(batch.sparkSession, store, "chunk_id").upsert(durable(new, "batch"), ("text",))

    records = spark.readStream.schema(schema).json(source)
    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) of event-time windows; works on streams, where rows later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
