"""Digests of whole tables that do not depend on the order of rows or on partitions, and what differs between two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a digest, and the two seeds of a row's hashes.
BUCKETS, SEEDS = 4096, (42, 4711)


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digest(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, first, second): a multiset digest of each bucket of keys, the sums of two hashes of each row.

    Sums are combined in the tasks, so no row is shuffled, and they are exact, so repeated rows count as often as they occur. The columns are
    hashed in order of name; null and empty differ.
    """
    columns = [F.struct(F.col(c).isNull(), F.col(c)) for c in sorted(rows.columns)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")) for seed in SEEDS]
    return rows.groupBy(bucket(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *(s.alias(name) for s, name in zip(sums, ("first", "second"), strict=True)))


def whole(digests: DataFrame) -> DataFrame:
    """(n, digest): one row for the table, with a SHA-256 of its sums; equal for equal multisets of rows."""
    total = digests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).alias(c) for c in ("first", "second")))
    return total.select("n", F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n", "first", "second"))), 256).alias("digest"))


def changes(old: DataFrame, new: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, change) of the keys whose rows differ: added, removed or changed. Rows of one key count as a multiset.

    The digests, a row a bucket, say which buckets differ; only rows of these are hashed one by one and compared by key. Null is a key like any other.
    """
    a, b = digest(old, key, buckets).alias("a"), digest(new, key, buckets).alias("b")
    same = (F.col("a.n") == F.col("b.n")) & (F.col("a.first") == F.col("b.first")) & (F.col("a.second") == F.col("b.second"))
    differ = a.join(b, F.col("a.bucket") == F.col("b.bucket"), "full").where(~F.coalesce(same, F.lit(False))).select(F.coalesce("a.bucket", "b.bucket").alias("__bucket"))

    def by_key(rows, sign):
        columns = [F.struct(F.col(c).isNull(), F.col(c)) for c in sorted(rows.columns)]
        near = rows.withColumn("__bucket", bucket(key, buckets)).join(F.broadcast(differ), "__bucket", "left_semi")  # no more rows than there are buckets
        return near.select(F.col(key), F.lit(sign).alias("side"), *(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)").alias(name) for seed, name in zip(SEEDS, ("first", "second"), strict=True)))

    both = by_key(old, -1).unionByName(by_key(new, 1)).groupBy(key).agg(
        F.count_if(F.col("side") < 0).alias("before"), F.count_if(F.col("side") > 0).alias("after"), *(F.sum(F.col("side") * F.col(c)).alias(c) for c in ("first", "second"))
    )
    moved = both.where((F.col("before") != F.col("after")) | (F.col("first") != 0) | (F.col("second") != 0))
    return moved.select(key, F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").otherwise("changed").alias("change"))
