"""Order statistics of groups of any size: the value at a rank, without sorting a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.sources.scratch import durable

#: Buckets of a histogram, and groups up to which their intervals (some dozens of bytes each) are broadcast.
BUCKETS, BROADCAST_GROUPS = 4096, 100_000


def histogram(rows: DataFrame, state: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, rank, bucket, c): how many values of a group fall into each part of the interval in which its rank lies; at most BUCKETS rows a group and rank."""
    inside = rows.join(state, by).where(F.col(value).between(F.col("lo"), F.col("hi")))
    return inside.groupBy(*by, "rank", F.expr(f"({value} - lo) div step").alias("bucket")).agg(F.count(F.lit(1)).alias("c"))


def value_at(rows: DataFrame, wanted: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, rank, value) for wanted(by, rank): the value, a whole number, that stands at this rank, from 0, when the group is sorted.

    The interval in which the value lies is cut into BUCKETS parts, the values in each part are counted, and the part that holds the
    rank is the next interval: at most six rounds, four for microseconds of twenty years. A round counts in the tasks before it
    shuffles, so a group that holds all rows is as good as many; no task ever gets more than one histogram of a group. A group's
    values span less than 2^63. Null values are not ranked. Ranks outside a group, and groups without values or a name, have no row.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*by, value)
    bounds = rows.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n"))
    state = wanted.select(*by, "rank").join(bounds, by).where("rank between 0 and n - 1").select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"))
    state = durable(state, "intervals")
    while True:
        r = state.agg(F.count_if(F.col("lo") < F.col("hi")).alias("open"), F.count(F.lit(1)).alias("n")).first()
        if not r["open"]:
            return state.select(*by, "rank", F.col("lo").alias(value))
        stepped = state.withColumn("step", F.expr(f"(hi - lo) div {BUCKETS} + 1"))
        counted = histogram(rows, F.broadcast(stepped) if r["n"] <= BROADCAST_GROUPS else stepped, by, value)
        run = Window.partitionBy(*by, "rank").orderBy("bucket")
        joined = counted.withColumn("upto", F.sum("c").over(run)).join(stepped, [*by, "rank"])
        holds = joined.where((F.col("below") + F.col("upto") > F.col("rank")) & (F.col("below") + F.col("upto") - F.col("c") <= F.col("rank")))
        low = F.col("lo") + F.col("bucket") * F.col("step")
        high = F.when(F.col("hi") - low < F.col("step"), F.col("hi")).otherwise(low + F.col("step") - 1)
        state = durable(holds.select(*by, "rank", low.alias("lo"), high.alias("hi"), (F.col("below") + F.col("upto") - F.col("c")).alias("below")), "intervals")
