"""Greedy choices that depend on what was chosen before, in parallel rounds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.sources.scratch import durable

#: Pairs that are left over to one task, which takes them in order.
REST = 100_000


def distinct_pairs(rows: DataFrame, first_key: str, second_key: str, order: str, rest: int = REST) -> DataFrame:
    """(a, b, at) of the rows that are kept when rows are taken in order and each is kept whose two keys are both new among the rows kept before.

    Rows are edges between keys, so this is the matching that is first in order, found in rounds: an edge that comes first at both its ends is
    kept whatever else happens, and the edges that share an end with it go. In each round the first edge of either key is an
    aggregate, so a key of very many rows is combined before it is shuffled, and the edges that both ends name meet by all of
    their columns. In a random order the rounds are about as many as the logarithm of the edges; chains in which each edge waits for the one before could take
    many, so when no more than ``rest`` edges are left one task takes them in order. Null is a key like any other. Of rows with
    equal keys only the first matters; order should be unique, and equal places go by the keys.
    """
    edges = rows.groupBy(F.col(first_key).alias("a"), F.col(second_key).alias("b")).agg(F.min(order).alias("at"))
    edges, kept = durable(edges, "edges"), None
    same = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))
    edges = edges.select("a", "b", "at", same("a").alias("ka"), same("b").alias("kb"))
    while (left := edges.count()) > rest:
        place = F.struct("at", "ka", "kb", "a", "b")
        by_a = edges.groupBy("ka").agg(F.min(place).alias("e")).select("e.*")
        by_b = edges.groupBy("kb").agg(F.min(place).alias("e")).select("e.at", "e.ka", "e.kb")
        both = durable(by_a.join(by_b, ["at", "ka", "kb"], "left_semi"), "kept")
        kept = both if kept is None else kept.unionByName(both)
        edges = durable(edges.join(both.select("ka"), "ka", "left_anti").join(both.select("kb"), "kb", "left_anti"), "edges")
    if left:
        last = _in_order(edges)
        kept = last if kept is None else kept.unionByName(last)
    return edges.select("a", "b", "at") if kept is None else kept.select("a", "b", "at")


def _in_order(edges: DataFrame) -> DataFrame:
    """The choice among few edges, by one scan of them in order."""

    def work(batches):
        firsts, seconds = set(), set()
        for batch in batches:
            keep = []
            for a, b in zip(*(map(repr, batch.column(c).to_pylist()) for c in ("ka", "kb")), strict=True):
                keep.append(a not in firsts and b not in seconds)
                if keep[-1]:
                    firsts.add(a)
                    seconds.add(b)
            yield batch.filter(pa.array(keep))

    return edges.select("at", "ka", "kb", "a", "b").coalesce(1).sortWithinPartitions("at", "ka", "kb").mapInArrow(work, edges.select("at", "ka", "kb", "a", "b").schema)


def numbered(rows: DataFrame, order: str, name: str, most: int) -> DataFrame:
    """The first ``most`` rows in order, numbered from 0 under a name. The limit comes first, so no more rows than these are in one task."""
    return rows.orderBy(order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(order)) - 1)
