"""Batch runs of a classifier that answers one prompt at a time, such as a model behind a service.

A run calls the classifier in the tasks, for the rows that no earlier attempt has a good answer for. What goes wrong
with one row becomes an error in that row; errors that pass are tried again first; a fatal one (a rejected key, say) ends the
run. Each slice of a run is an attempt: a folder of its own under the run's store, which counts from the moment
at which Spark marks the whole of it as written. So a run that was killed is resumed by running it again: attempts
that were not finished are not read, and of those that were no row is asked again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators.dataset import LABELS, latest_per_key
from threadmill.operators.evaluation import is_success, llm_run_metrics, parse_prediction

#: Rows that a task hands on at once.
ROWS = 64
UNREADABLE = "the answer holds no prediction"
_CALLED = "raw string, error string, fatal boolean, tries int, latency_ms double, input_tokens long, output_tokens long"
_KEPT = "true_label string, predicted_label string, confidence double, reason string, raw string, error string, tries int, latency_ms double, input_tokens long, output_tokens long, model string, prompt_sha256 string, attempt int, fatal boolean"


class FatalCallError(RuntimeError):
    """An error that every further call would meet too."""


class PassingCallError(RuntimeError):
    """An error that may be gone at the next try."""


def called(prompts: DataFrame, classify: Callable[[str], tuple[str, int, int]], tries: int = 3, wait: float = 0.0) -> DataFrame:
    """prompts(key, prompt, true_label) with what classify(prompt) -> (answer, input tokens, output tokens) came to.

    A ``PassingCallError`` is tried again, ``tries`` times in all, after ``wait`` seconds and then twice as long each time. A task that meets a
    ``FatalCallError`` makes a last row of it and calls no more.
    """
    key = prompts.schema["key"].dataType.simpleString()

    def one(prompt):
        began, answer, error, fatal, n = time.perf_counter(), (None, None, None), None, False, 0
        while n < tries:
            n += 1
            try:
                answer, error = classify(prompt), None
                break
            except FatalCallError as e:
                error, fatal = str(e) or "fatal", True
                break
            except PassingCallError as e:
                error = str(e) or "passing"
                if n < tries:
                    time.sleep(wait * 2 ** (n - 1))
            except Exception as e:  # whatever it is, it is this row's error
                error = str(e) or type(e).__name__
                break
        return answer[0], error, fatal, n, (time.perf_counter() - began) * 1000, answer[1], answer[2]

    def work(batches):
        ended = False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, found = batch.slice(at, ROWS), []
                for prompt in [] if ended else part.column(1).to_pylist():
                    found.append(one(prompt))
                    if ended := found[-1][2]:
                        break
                columns = list(zip(*found, strict=True)) or [()] * 7
                kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
                own = part.slice(0, len(found))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["key", "true_label", *(c.split()[0] for c in _CALLED.split(", "))])

    return prompts.select("key", "prompt", "true_label").mapInArrow(work, f"key {key}, true_label string, {_CALLED}")


def _attempts(spark: SparkSession, store: str) -> tuple[list[str], int]:
    """(folders of finished attempts in order, number of the next attempt)."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(store).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(n for s in (fs.listStatus(at(store)) if fs.exists(at(store)) else []) if (n := s.getPath().getName()).startswith("attempt-"))
    done = [f"{store}/{n}" for n in names if fs.exists(at(f"{store}/{n}/_SUCCESS"))]
    return done, int(names[-1].rpartition("-")[2]) + 1 if names else 0


def log(spark: SparkSession, store: str, key: str = "issue_id", key_type: str = "long") -> DataFrame:
    """All rows of all finished attempts."""
    done, schema = _attempts(spark, store)[0], f"{key} {key_type}, {_KEPT}"
    rows = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return rows.where(~F.col("fatal")).drop("fatal")


def results(examples: DataFrame, store: str, key: str = "issue_id", labels=LABELS) -> DataFrame:
    """The last row of each of the examples in the log of a run; examples that were not asked yet have none."""
    rows = log(examples.sparkSession, store, key, examples.schema[key].dataType.simpleString())
    return latest_per_key(rows, key, "attempt").drop("first_at").join(examples.select(key).distinct(), key, "left_semi")


def run(
    examples: DataFrame, store: str, classify: Callable[[str], tuple[str, int, int]], prompt: Column, model: str, template: str = "",
    resume: bool = True, slices: int = 1, tries: int = 3, wait: float = 0.0, key: str = "issue_id", label: str = "label", labels=LABELS,
) -> dict[str, int]:
    """Asks for the examples and says how many rows were selected, asked for and skipped as completed; ``results`` has the rows.

    Without resume all are asked for again, and the new rows stand before the old ones. The examples are taken in so many slices by a
    hash of the key, each one an attempt, so a run that is killed has lost the answers of one slice at most. Keys
    are not null and each asks once. After a fatal error the rows that were answered stay, and the error is raised.
    """
    spark, kind = examples.sparkSession, examples.schema[key].dataType.simpleString()
    asked = examples.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(prompt.alias("prompt"), F.col(label).alias("true_label"))).alias("x")).select(F.col(key).alias("key"), "x.*")
    selected, skipped, requested = asked.count(), 0, 0
    if resume:
        done = latest_per_key(log(spark, store, key, kind), key, "attempt").where(is_success("predicted_label", "error", labels)).select(F.col(key).alias("key"))
        asked, skipped = asked.join(done, "key", "left_anti"), asked.join(done, "key", "left_semi").count()
    for k in range(slices):
        number = _attempts(spark, store)[1]
        found = called(asked.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == k), classify, tries, wait)
        said = found.withColumn("p", parse_prediction("raw", labels))
        rows = said.select(
            F.col("key").alias(key), "true_label", F.col("p.label").alias("predicted_label"), F.col("p.confidence").alias("confidence"), F.col("p.reason").alias("reason"), "raw",
            F.coalesce("error", F.when(F.col("p").isNull(), UNREADABLE)).alias("error"), "tries", "latency_ms", "input_tokens", "output_tokens",
            F.lit(model).alias("model"), F.sha2(F.lit(template), 256).alias("prompt_sha256"), F.lit(number).alias("attempt"), "fatal",
        )
        rows.write.parquet(f"{store}/attempt-{number:06d}")
        written = spark.read.schema(rows.schema).parquet(f"{store}/attempt-{number:06d}")
        r = written.agg(F.count_if(~F.col("fatal")).alias("n"), F.max(F.when(F.col("fatal"), F.col("error"))).alias("fatal")).first()
        requested += r["n"]
        if r["fatal"]:
            raise FatalCallError(r["fatal"])
    return {"selected_examples": selected, "requested_this_run": requested, "resume_skipped_completed": skipped}


def metrics(examples: DataFrame, store: str, key: str = "issue_id", labels=LABELS, input_price: float | None = None, output_price: float | None = None) -> DataFrame:
    """``llm_run_metrics`` of the last rows of the examples."""
    return llm_run_metrics(results(examples, store, key, labels), labels, input_price, output_price)
