"""Sources and sinks: JSON lines with a fixed schema, logs, and a keyed chunk table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Record types, for reading: never inferred, since empty arrays and columns of nulls would infer wrongly.
COMMENT = "array<struct<github_id bigint, body string, author_association string, user_login string, created_at string, updated_at string, html_url string>>".replace(" bigint", ":bigint").replace(" string", ":string")
RAW_ISSUE = "github_id bigint, number bigint, title string, body string, labels array<string>, fetched_for_label string, fetched_for_github_label string, state string, created_at string, closed_at string, updated_at string, html_url string"
ISSUE_WITH_COMMENTS = f"{RAW_ISSUE}, label string, comments {COMMENT}"
MAPPED_ISSUE = "github_id bigint, number bigint, html_url string, created_at string, closed_at string, fetched_for_label string, fetched_for_github_label string, label string, label_id int, text string"
CORPUS_RECORD = "source_type string, source_id string, text string, title string, url string, area string, tags array<string>, version string, github_issue_id bigint, github_comment_id bigint, created_at string, closed_at string"
CHUNK = "level string, text string, metadata struct<chunk_id:string, parent_id:string, source_type:string, source_id:string, title:string, url:string, section_path:array<string>, area:string, tags:array<string>, version:string, github_issue_id:bigint, github_comment_id:bigint, created_at:string, closed_at:string>"
PREDICTION = "issue_id string, number bigint, html_url string, created_at string, model string, prompt_sha256 string, true_label string, predicted_label string, confidence double, reason string, error string, latency_ms double, usage struct<input_tokens:bigint, output_tokens:bigint, total_tokens:bigint>"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "strict") -> DataFrame:
    """JSON lines. strict: a line that is no object of this type fails the job; report: such lines are kept whole in
    _corrupt_record; tolerant: they are left out, and a path that does not exist is an empty table. Blank lines are skipped."""
    if mode == "tolerant" and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("mode", {"strict": "FAILFAST", "report": "PERMISSIVE", "tolerant": "DROPMALFORMED"}[mode])
    return reader.schema(f"{schema}, _corrupt_record string" if mode == "report" else schema).json(path)


def read_object(spark: SparkSession, path: str) -> dict[str, Any]:
    """A file of one JSON object, through Spark's reader; anything else is an error. It is meant for control data."""
    found = spark.read.text(path, wholetext=True).collect()
    value = json.loads(found[0][0]) if len(found) == 1 else None
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold one JSON object")
    return value


def write_report(spark: SparkSession, report: dict[str, Any], path: str) -> None:
    """A small report as indented JSON in one file of a folder, keys in order of name."""
    spark.createDataFrame([(json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Numbers rows in the order of their files and lines; gaps between tasks."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_jsonl(df: DataFrame, path: str, sorted_keys: bool = True, mode: str = "overwrite") -> None:
    """JSON lines, nulls included, one file per task. Keys in order of name unless sorted_keys is off."""
    df.select(*(sorted(df.columns) if sorted_keys else df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, sorted_keys=False, mode="append")


def require_exact_columns(df: DataFrame, schema: str) -> DataFrame:
    """df, if it has the columns of the contract and no other; else an error."""
    wanted, have = set(T._parse_datatype_string(schema).fieldNames()), set(df.columns)
    if wanted != have:
        raise ValueError(f"missing columns: {sorted(wanted - have)}, unknown columns: {sorted(have - wanted)}")
    return df


def allowed(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose column holds a value outside a closed set."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id", updated: tuple[str, ...] = ("text", "embedding")) -> DataFrame:
    """old with new merged in by key: of a known key only the updated columns change (also to null); unknown keys are inserted whole."""
    a, b = old.alias("a"), new.alias("b")
    known, given = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    columns = [F.coalesce(f"a.{key}", f"b.{key}").alias(c) if c == key else (F.when(given, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in updated else F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))).alias(c) for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*columns)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, byte_len) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_len"))


def create_chunk_table(spark: SparkSession, name: str = "rag_chunks") -> None:
    """The chunk store, partitioned by level so that a search of children reads nothing else."""
    spark.sql(f"""
        create table if not exists {name} (chunk_id string, text string, section_path array<string>, tags array<string>, parent_id string, source_type string,
            source_id string, title string, url string, area string, version string, github_issue_id bigint, github_comment_id bigint,
            created_at timestamp, closed_at timestamp, embedding array<float>, level string) using parquet partitioned by (level)""")
