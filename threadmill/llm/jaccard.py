"""Which candidate pairs of texts have sets of shingles with a Jaccard similarity of a bound or more, exactly.

Candidates that are connected meet in a task, where the overlap of all their pairs is counted in full, and only pairs
that reach the bound become links. A group of more than ``TILE`` sets is cut into chunks, and of two chunks the
sets that have a candidate in the other one meet. Equal sets are one node from the start, so exact copies cost nothing.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.graph import components, local_components
from threadmill.llm.tools import arrow_map, durable, ranges, text_bytes

#: Sets of one side of a tile.
TILE = 256
_STEPS = [0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 | 1 for k in range(64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes, hashed again."""
    z = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles; a text shorter than a shingle is one, no words are none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(t, 42) for t in tokens), np.uint64, len(tokens))
    n = len(tokens) - shingle + 1
    total = np.zeros(n, np.uint64)
    for k in range(shingle):
        total = mixed(total + hashes[k : k + n] * np.uint64(_STEPS[k % 64]))
    return np.unique(total)


def node(found: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def similar(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of sets whose Jaccard similarity is percent / 100 or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    names, places = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    holders = rows[np.argsort(places, kind="stable")]  # of each name in turn
    many = np.bincount(places, minlength=len(names))
    starts = np.cumsum(many) - many
    left, right = [], []
    at = 0
    for i, n in enumerate(sizes):
        own = places[at : at + n]
        at += n
        common = np.bincount(holders[ranges(starts[own], many[own])], minlength=len(sets))
        j = np.flatnonzero(common * (100 + percent) >= percent * (n + sizes))
        j = j[j > i]
        left.append(np.full(len(j), i))
        right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if sets else (np.zeros(0, int), np.zeros(0, int))


def _members(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, x, y, node): the tiles in which a node is compared."""
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / TILE).alias("chunks"))
    placed = durable(groups.join(sizes, "root").withColumn("chunk", F.expr("pmod(xxhash64(node), chunks)")), "placed")
    small = placed.where("chunks = 1").select("root", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "node")
    large = placed.where("chunks > 1").select("root", "chunk", "node")
    ends = edges.join(large.withColumnRenamed("node", "a"), "a").join(large.select(F.col("node").alias("b"), F.col("chunk").alias("other")), "b")
    listed = ends.select("root", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), F.explode(F.array("a", "b")).alias("node"))
    return small.union(listed.distinct())


def verified(edges: DataFrame, units: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that have a link: edges(a, b) are candidates, units(uid, rid) names a row of texts(rid, text) for each node."""
    members = durable(_members(edges, components(edges)), "members")
    one = durable(units.join(members.select(F.col("node").alias("uid")).distinct(), "uid"), "compared")

    def whole(batch):
        sets = [shingles(t, shingle) for t in text_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    def compared(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, tile in groupby(rows(), lambda r: r[:3]):
            tile = list(tile)
            i, j = similar([np.frombuffer(r[4], np.uint64) for r in tile], percent)
            if len(i):
                nodes = np.array([r[3] for r in tile], np.int64)
                labels = local_components(len(tile), i, j)
                linked = labels != np.arange(len(tile))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[labels[linked]])], ["a", "b"])

    sets = arrow_map(texts.join(one, "rid").select(F.col("uid").alias("node"), "text"), "node long, shingles binary", whole)
    tiles = members.join(sets, "node").select("root", "x", "y", "node", "shingles").repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    return components(tiles.mapInArrow(compared, "a long, b long"))
