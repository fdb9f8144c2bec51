import json
import os

import pytest

from threadmill.sources import tables as tb
from threadmill.sources.store import KeyedStore
from threadmill.streaming import ingest


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1, "tags": []}\n\n{"a": 2, "b": "é"}\n')
    rows = tb.with_ordinal(tb.read_jsonl(spark, path, "a long, b string, tags array<string>")).orderBy("ordinal").collect()
    assert [(r["a"], r["b"], r["tags"]) for r in rows] == [(1, None, []), (2, "é", None)]
    with open(path, "a") as f:
        f.write("[1, 2]\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        tb.read_jsonl(spark, path, "a long").collect()
    assert [r["_corrupt_record"] for r in tb.read_jsonl(spark, path, "a long, b string", "report").collect() if r["_corrupt_record"]][-1] == "{broken"
    assert tb.read_jsonl(spark, path, "a long, b string", "tolerant").where("a is not null").count() == 2
    assert tb.read_jsonl(spark, str(tmp_path / "none"), "a long", "tolerant").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x")], "b int, c string, a string")
    tb.write_jsonl(df, str(tmp_path / "out"))
    part = next(f for f in os.listdir(tmp_path / "out") if f.startswith("part") and os.path.getsize(tmp_path / "out" / f))
    line = (tmp_path / "out" / part).read_text()
    assert line == '{"a":"x","b":1,"c":null}\n' and json.loads(line)
    for _ in range(2):
        tb.append_log(df, str(tmp_path / "log"))
    assert tb.read_jsonl(spark, str(tmp_path / "log"), "a string, b int, c string").count() == 2
    digest = tb.file_digests(spark, str(tmp_path / "out" / part)).first()
    import hashlib

    assert digest["sha256"] == hashlib.sha256(line.encode()).hexdigest() and digest["byte_len"] == len(line)


def test_contract_and_upsert(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert tb.require_exact_columns(df, "a int, b string") is df
    with pytest.raises(ValueError, match="unknown"):
        tb.require_exact_columns(df, "a int")
    assert tb.allowed(df, "b", ("y",)).count() == 1
    old = spark.createDataFrame([("1", "t1", [1.0], None), ("2", "t2", [2.0], "m2")], "chunk_id string, text string, embedding array<double>, title string")
    new = spark.createDataFrame([("1", "n1", None, "new"), ("3", "t3", [3.0], "m3")], old.schema)
    assert sorted(tuple(r) for r in tb.upsert(old, new).collect()) == [("1", "n1", None, None), ("2", "t2", [2.0], "m2"), ("3", "t3", [3.0], "m3")]


def test_chunk_table(spark):
    tb.create_chunk_table(spark, "chunk_store_test")
    assert spark.table("chunk_store_test").columns[-1] == "level"
    spark.sql("drop table chunk_store_test")


def test_stream_of_records(spark, tmp_path):
    source, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    os.makedirs(source)
    schema = "source_id string, text string"
    for n, rows in enumerate([[("a", "one two"), ("b", "three")], [("a", "new text"), ("c", "four")]]):
        with open(f"{source}/{n}.json", "w") as f:
            f.writelines(json.dumps({"source_id": s, "text": t}) + "\n" for s, t in rows)
        ingest.chunk_stream(spark, source, schema, store, state).awaitTermination()
    held = KeyedStore(spark, store, "chunk_id")
    assert held.version() == 1
    assert {r["chunk_id"]: r["text"] for r in held.read().collect()} == {"doc:a:naive:0": "new text", "doc:b:naive:0": "three", "doc:c:naive:0": "four"}


def test_scratch_tables(spark):
    from threadmill.sources import scratch

    out = scratch.durable(spark.range(5), "test")
    assert out.count() == 5
    assert scratch.clear(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.exist|no such"):
        spark.read.parquet(out.inputFiles()[0]).count()


def test_scratch_tables_are_deleted_but_for_those_to_keep(spark):
    from threadmill.sources import scratch

    start = scratch.written()
    a, b, c = (scratch.durable(spark.range(n), "test") for n in (3, 4, 5))
    assert scratch.clear(spark, start, 1) == 2
    assert c.count() == 5 and scratch.written() == start + 1
    for gone in (a, b):
        with pytest.raises(Exception):  # noqa: B017
            gone.collect()
