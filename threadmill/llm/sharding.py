"""Contiguous shards of near equal bytes from global prefix sums.

Texts are put in the order of their MD5, so that equal texts stand side by side and the order is even over
``BUCKETS`` ranges however skewed the table is. Each range yields one total; the running sum of these totals
gives each range its global start, and a window inside the range gives each text its own. The axis of bytes is
then cut at equal targets: a text goes to the shard in which its middle byte falls, so a shard is a contiguous
stretch of the order and copies of one text are never parted. A text whose copies alone hold a shard's share
gets a shard to itself, and the targets of the others are drawn anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.tools import durable, long_array, rename

#: Ranges of the MD5 order of texts (three hex digits), and of the MD5 order of ids (two) in which a shard's rows are numbered.
BUCKETS, PARTS = 4096, 256


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1. Null texts count as empty and form a group of their own; null ids are
    carried along; repeated rows each get their own slot. An empty table gives no rows. Only id and text are
    read, so other columns cannot clash. What reaches the driver: one total per range, at most ``shards``
    oversized texts, one cut per shard, and one count per shard and part.
    """
    text = F.col("text")
    rows = durable(
        rename(docs, id=id_col, text=text_col).select(
            "id",
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key"),
        ),
        "shard-rows",
    )
    bucket = F.coalesce(F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), F.lit(0))
    groups = durable(rows.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("bucket", bucket), "shard-groups")
    totals = {r["bucket"]: r["bytes"] for r in groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes")).collect()}
    whole = sum(totals.values())
    large = sorted((r["key"], r["bytes"], r["bucket"]) for r in groups.where(F.col("bytes") * shards >= whole).collect()) if whole else []
    for _, size, at in large:
        totals[at] -= size
    rest, open_shards = sum(totals.values()), shards - len(large)
    starts, at = [], 0
    for b in range(BUCKETS):
        starts.append(at)
        at += totals.get(b, 0)
    cuts: list[tuple[int, str]] = []
    own = [k for k, _, _ in large]
    if rest:
        before = Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        middle = F.get(long_array(starts), F.col("bucket")) + F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.expr("bytes div 2")
        placed = groups.where(~F.col("key").isin(own)) if own else groups
        placed = placed.withColumn("shard", F.least(F.lit(open_shards - 1), F.floor(middle * open_shards / F.lit(rest))))
        cuts = sorted((int(r["shard"]), r["key"]) for r in placed.groupBy("shard").agg(F.min("key").alias("key")).collect())
    shard = F.lit(None).cast("int")
    for k, first in cuts:
        shard = F.when(F.col("key") >= first, F.lit(k)).otherwise(shard)
    for k, key in enumerate(own):
        shard = F.when(F.col("key") == key, F.lit(open_shards + k)).otherwise(shard)
    place = F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit(""))
    part = F.coalesce(F.conv(F.substring("place", 1, 2), 16, 10).cast("int"), F.lit(0))
    dealt = rows.withColumn("shard", shard).withColumn("place", place).withColumn("part", part)
    counts = {(r["shard"], r["part"]): r["count"] for r in dealt.groupBy("shard", "part").count().collect()}
    offsets = []
    for s in range(shards):
        n = 0
        for p in range(PARTS):
            offsets.append(n)
            n += counts.get((s, p), 0)
    order = Window.partitionBy("shard", "part").orderBy("place", "id", "key")
    slot = F.get(long_array(offsets), F.col("shard") * PARTS + F.col("part")) + F.row_number().over(order) - 1
    return dealt.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
