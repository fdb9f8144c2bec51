"""Exact cosine search over a stored partition of vectors into cells, most of which a search can leave unread.

Each vector stands in the cell of its nearest centre, and the store is sorted by cell and by the distance ``far`` from the centre.
Distances are those of unit vectors, sqrt(2 - 2 cosine), so the triangle inequality holds: a vector within r of a query q
has a ``far`` within r of q's own distance from the centre. A search first finds r, the distance of the k-th best vector of a
query's nearest cells; then it compares the query only with rows whose ``far`` allows r. Cells that no query
needs are filtered in the scan, by the row groups' bounds of ``cell``. What a search leaves out cannot be among the k best, so
results are those of comparing everything, ties included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.operators.retrieval import ranked
from threadmill.sources.scratch import durable

#: Most cells, vectors a cell and bytes of them that the centres are fitted on, and rounds of the fit. All vectors are indexed.
MOST, SAMPLE, SAMPLE_BYTES, ROUNDS = 2048, 16, 64 << 20, 5
#: Bytes of query vectors sent to the tasks at once, rows of a cell that are tested together, and scores that a task holds at once.
QUERY_BYTES, ROWS, SCORES = 32 << 20, 512, 4 << 20
#: Scores are ranked rounded to six decimals, so cosines a little below the k-th best may tie with it.
SLACK = 2e-6


def units(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, cosine) of the nearest centre of each row, in slices of bounded size."""
    step = max(1, SCORES // len(centres))
    parts = [x[at : at + step] @ centres.T for at in range(0, max(len(x), 1), step)]
    return np.concatenate([p.argmax(1) for p in parts]), np.concatenate([p.max(1) for p in parts])


def fit(x: np.ndarray, cells: int) -> np.ndarray:
    """At most so many unit centres of unit rows x, by spherical k-means from the first different rows. Without rows: none."""
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:cells]]
    for _ in range(ROUNDS if len(centres) else 0):
        own, _ = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = np.linalg.norm(sums, axis=1) > 1e-9
        centres = np.where(full[:, None], units(sums), centres)
    return centres


def build(vectors: DataFrame, path: str) -> None:
    """Writes vectors(chunk_id, ordinal, vector) to a new store: ``path``/rows with cell and far, ``path``/cells with the cells' centres and sizes.

    There are about as many cells as the root of the number of vectors, at most ``MOST``. Centres come from the vectors with the smallest hashes
    of chunk_id, ``SAMPLE`` a cell. Null vectors are left out; vectors of zeros have a cell of their own, the
    last one; all must be finite and of one length. Equal vectors by the million are one cell, but lie in as many files as their bytes need.
    ``cells`` is written last: a store without it is incomplete, and ``search`` fails on it.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vector is not null").select(F.col("chunk_id").cast("string"), F.col("ordinal").cast("long"), F.col("vector").cast("array<double>"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = size["width"] or 0
    cells = int(min(MOST, np.ceil(np.sqrt(size["n"]))))
    sample = min(SAMPLE * cells, SAMPLE_BYTES // max(8 * width, 1))
    drawn = rows.where(F.exists("vector", lambda x: x != 0)).select(F.xxhash64("chunk_id").alias("h"), "vector").orderBy("h", "vector").limit(sample).toArrow()
    x = np.array(drawn["vector"].combine_chunks().flatten()).reshape(-1, width) if drawn.num_rows else np.zeros((0, width))
    centres = fit(units(x), cells)
    zeros = len(centres)
    sent = spark.sparkContext.broadcast(centres)  # MOST vectors at most

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = units(np.stack(batch.column(2).to_numpy(zero_copy_only=False)))
            cell, far = np.full(len(v), zeros), np.zeros(len(v))
            some = v.any(1)
            if some.any():
                cell[some], cosine = _nearest(v[some], sent.value)
                far[some] = distance(cosine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["chunk_id", "ordinal", "vector", "cell", "far"])

    placed = rows.mapInArrow(work, "chunk_id string, ordinal long, vector array<double>, cell int, far double")
    placed.repartitionByRange("cell", "far", "ordinal").sortWithinPartitions("cell", "far").write.parquet(f"{path}/rows")
    sent.destroy()
    numbered = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate([*centres, np.zeros(width)])], "cell int, centre array<double>")
    spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(F.broadcast(numbered), "cell", "right").coalesce(1).write.parquet(f"{path}/cells")


def _near_cells(q: np.ndarray, centres: np.ndarray, n: np.ndarray, k: int) -> dict[int, np.ndarray]:
    """The queries that look into a cell first: each into its nearest cells until they hold k rows, so into k of them at most."""
    picks: dict[int, list[int]] = {}
    filled = np.flatnonzero(n)
    for at in range(0, len(q), max(1, SCORES // max(len(filled), 1))):
        far = distance(q[at : at + max(1, SCORES // max(len(filled), 1))] @ centres[filled].T)
        for i, row in enumerate(far, at):
            order = np.argsort(row, kind="stable")[:k]
            for c in filled[order[: int(np.searchsorted(np.cumsum(n[filled[order]]), k)) + 1]]:
                picks.setdefault(int(c), []).append(i)
    return {c: np.array(i) for c, i in picks.items()}


def _compare(rows: DataFrame, kind: str, k: int, sent, compared: Accumulator | None) -> DataFrame:
    """(query_id, chunk_id, ordinal, score): each task's k best of the rows that sent's picks, or its radii, let each query see."""

    def work(batches):
        ids, q, centres, picks, radius = sent.value
        best = {}
        cell, apart = -1, None
        for batch in batches:
            names, ordinals, numbers, far = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3, 4))
            edges = np.unique(np.concatenate([np.flatnonzero(np.diff(numbers, prepend=-1)), np.arange(0, len(numbers), ROWS), [len(numbers)]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                c = int(numbers[lo])
                if picks is not None:
                    asking = picks.get(c, np.zeros(0, int))
                else:
                    if c != cell:
                        cell, apart = c, distance(q @ centres[c])
                    asking = np.flatnonzero((apart - far[lo:hi].max() <= radius) & (far[lo:hi].min() - apart <= radius))
                if not len(asking):
                    continue
                if compared is not None:
                    compared.add(len(asking) * (hi - lo))
                v = units(np.stack(batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)))
                for at in range(0, len(asking), SCORES // ROWS):
                    for i, s in zip(asking[at : at + SCORES // ROWS].tolist(), q[asking[at : at + SCORES // ROWS]] @ v.T, strict=True):
                        own = s, ordinals[lo:hi], names[lo:hi]
                        s, o, n = (np.concatenate(x) for x in zip(best[i], own, strict=True)) if i in best else own
                        top = np.lexsort((o, -np.round(s, 6)))[:k]
                        best[i] = s[top], o[top], n[top]
        for i, (s, o, n) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(s)), pa.array(n, pa.string()), pa.array(o, pa.int64()), pa.array(s, pa.float64())], ["query_id", "chunk_id", "ordinal", "score"])

    return rows.select("chunk_id", "ordinal", "vector", "cell", "far").mapInArrow(work, f"query_id {kind}, chunk_id string, ordinal long, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, compared: Accumulator | None = None) -> DataFrame:
    """ranked(query_id, chunk_id, ordinal, score): the k vectors of a store of highest cosine with each of queries(query_id, vector).

    Equal to comparing every query with every vector. Queries go to the tasks in blocks of ``QUERY_BYTES``; each block reads the store for its radii,
    where only its nearest cells are looked into, and for its results. Null vectors ask nothing, vectors of zeros have cosine 0 with
    all; query_id must be unique. An empty store gives no rows. compared counts the pairs that were multiplied.
    """
    rows, kind = spark.read.parquet(f"{path}/rows"), queries.schema["query_id"].dataType.simpleString()
    cells = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    n = cells["n"].fill_null(0).to_numpy()
    centres = np.stack(cells["centre"].to_numpy())
    asked = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>"))
    size = asked.agg(F.max(F.size("vector") * 8).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks, out = int((size["b"] or 0) * size["n"] // QUERY_BYTES + 1), None
    for block in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).toArrow()
        if not part.num_rows or not n.any():
            continue
        ids, q = part["query_id"].to_pylist(), units(np.array(part["vector"].combine_chunks().flatten()).reshape(part.num_rows, -1))
        picks = _near_cells(q, centres, n, k)
        sent = spark.sparkContext.broadcast((ids, q, centres, picks, None))
        first = ranked(_compare(rows.where(F.col("cell").isin(list(picks))), kind, k, sent, compared), k).where(F.col("rank") == k - 1).select("query_id", "score").toArrow()
        sent.destroy()
        place, radius = {name: i for i, name in enumerate(ids)}, np.full(len(ids), np.inf)
        for name, score in zip(first["query_id"].to_pylist(), first["score"].to_pylist(), strict=True):
            radius[place[name]] = distance(np.array(score - SLACK)) + 1e-6
        radius[~q.any(1)] = np.inf
        reach = np.array([0 if c is None else c for c in cells["radius"].to_pylist()])
        needed = [int(c) for c in np.flatnonzero(n) if (distance(q @ centres[c]) - reach[c] <= radius).any()]
        sent = spark.sparkContext.broadcast((ids, q, centres, None, radius))
        found = durable(_compare(rows.where(F.col("cell").isin(needed)), kind, k, sent, compared), "cosine")
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id string, ordinal long, score double, rank int")
    return ranked(out, k)
