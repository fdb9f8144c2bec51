"""Intermediate tables in the shared scratch folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if all tasks run in this process, else an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if folder := spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadmill-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame, label: str, **options) -> DataFrame:
    """Writes df to the scratch folder and reads it back: its lineage is cut, and a lost executor costs nothing. options: of the writer."""
    path = f"{scratch(df.sparkSession)}/threadmill-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``durable`` has written in this process and ``clear`` has not deleted."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Deletes what ``durable`` wrote in this process, but for the first ``since`` and the last ``keep`` tables, and says how many tables that were. Tables that read them are void then."""
    gone = _written[since : len(_written) - keep]
    _written[since : len(_written) - keep] = []
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)
