import random

from pyspark.sql import functions as F

from threadmill.operators import dataset, ranks


def test_values_equal_those_of_sorted_groups(spark):
    rng = random.Random(3)
    groups = {
        "wide": [rng.randrange(-(2**61), 2**61) for _ in range(3000)], "ties": [rng.randrange(5) for _ in range(1000)], "one": [7], "equal": [-4] * 50, "times": [1_700_000_000_000_000 + rng.randrange(10**14) for _ in range(5000)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("wide", None), (None, 3), ("empty", None)]
    rng.shuffle(rows)
    wanted = [(g, k) for g, vs in groups.items() for k in {0, len(vs) // 20, len(vs) // 2, len(vs) - 1}] + [("one", 1), ("one", -1), ("empty", 0), ("gone", 0)]
    out = ranks.value_at(spark.createDataFrame(rows, "g string, v long"), spark.createDataFrame(wanted, "g string, rank long"), ["g"], "v").collect()
    assert {(r["g"], r["rank"]): r["v"] for r in out} == {(g, k): sorted(groups[g])[k] for g, k in wanted if g in groups and 0 <= k < len(groups[g])}
    assert len(out) == len(wanted) - 4


def test_a_histogram_is_all_that_a_task_gets(spark):
    """A million different times under one label."""
    rows = spark.range(1_000_000).select(F.lit("x").alias("g"), (F.col("id") * 7919 % 1_000_003 * 1_000_000).alias("v"))
    state = spark.createDataFrame([("x", 10, 0, 1_000_002_000_000, 1_000_002_000_000 // ranks.BUCKETS + 1)], "g string, rank long, lo long, hi long, step long")
    assert ranks.histogram(rows, state, ["g"], "v").count() <= ranks.BUCKETS
    top = ranks.value_at(rows, spark.createDataFrame([("x", 999_999), ("x", 0)], "g string, rank long"), ["g"], "v")
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("z")).first()
    assert {r["rank"]: r["v"] for r in top.collect()} == {0: ends["a"], 999_999: ends["z"]}


def test_one_label_is_cut_at_its_rank(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("bug").alias("label"), F.timestamp_micros(F.col("id") * 1_234_567 % 200_003).alias("created_at"), F.col("id").alias("ordinal"))
    out = dataset.temporal_test(rows)
    assert out.columns == [*rows.columns, "is_test"]
    assert out.where("is_test").count() == n // 5
    assert dataset.boundary_violations(out).count() == 0
