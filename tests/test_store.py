import random

import pytest
from pyspark.sql import functions as F

from threadmill.sources.store import KeyedStore

SCHEMA = "id long, text string, note string"


def rows(df):
    return {r["id"]: (r["text"], r["note"]) for r in df.collect()}


def test_upserts_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    store, expected = KeyedStore(spark, str(tmp_path / "s"), "id", buckets=8), {}
    assert store.version() == -1
    with pytest.raises(ValueError, match="no version"):
        store.read()
    for turn in range(5):
        ids = rng.sample(range(300), 120 if turn == 0 else rng.choice([1, 3, 40]))
        new = [(i, rng.choice([None, f"t{turn}"]), f"n{turn}") for i in ids]
        for i, text, note in new:
            expected[i] = (text, expected[i][1] if i in expected else note)
        store.upsert(spark.createDataFrame(new, SCHEMA), ("text",))
        assert rows(store.read()) == expected
        assert KeyedStore(spark, str(tmp_path / "s"), "id").buckets == 8
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 999)], "id long")
    assert rows(store.lookup(asked)) == {i: v for i, v in expected.items() if i in (1, 2, 3)}
    assert store.upsert(spark.createDataFrame([], SCHEMA), ("text",)) == 0 and store.version() == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "id", buckets=16)
    store.upsert(spark.range(1000).select("id", F.lit("a").alias("text"), F.lit("b").alias("note")), ("text",))
    before = store._manifest()["folders"]
    assert len(before) == 16
    assert store.upsert(spark.createDataFrame([(5, "new", "x")], SCHEMA), ("text",)) == 1
    after = store._manifest()["folders"]
    assert sum(after[b] != before[b] for b in before) == 1
    changed = next(b for b in before if after[b] != before[b])
    assert {f.split("/__bucket=")[1].split("/")[0] for f in store.lookup(spark.createDataFrame([(5,)], "id long")).inputFiles() if "__bucket" in f} == {changed}
    assert rows(store.read(0))[5] == ("a", "b") and rows(store.read())[5] == ("new", "b") and store.read().count() == 1000
    assert store.vacuum() == 1
    assert store.read().count() == 1000


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "id", buckets=4)
    store.upsert(spark.createDataFrame([(i, "old", "n") for i in range(50)], SCHEMA), ("text",))
    bad = spark.range(50).select("id", F.when(F.col("id") < 40, "new").otherwise(F.raise_error(F.lit("broken"))).alias("text"), F.lit("n").alias("note"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(bad, ("text",))
    assert store.version() == 0 and set(rows(store.read()).values()) == {("old", "n")}
    other = KeyedStore(spark, str(tmp_path / "s"), "id")
    manifest = other._manifest()
    store.upsert(spark.createDataFrame([(1, "first", "n")], SCHEMA), ("text",))
    with pytest.raises(RuntimeError, match="written by another"):
        other._write(spark.createDataFrame([(1, "second", "n")], SCHEMA), [other.buckets - 1], manifest, 1)
    assert rows(store.read())[1] == ("first", "n")
