"""The partitioned cosine search against comparing every pair."""

import numpy as np
import pytest

from threadmill.operators import cells, retrieval

SCHEMA = "chunk_id string, ordinal long, vector array<double>"


def table(spark, vectors):
    return spark.createDataFrame([(f"c{i}", i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], SCHEMA)


def asked(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], "query_id long, vector array<double>")


def rows(found):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6) + 0.0) for r in found.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((12, 24))
    v = middles[rng.integers(0, 12, 1200)] + 0.15 * rng.standard_normal((1200, 24))
    return np.concatenate([v, np.repeat(v[:1], 500, 0), np.zeros((20, 24)), -v[:40]])


def test_equals_all_pairs_and_compares_few(spark, tmp_path, clustered):
    known, queries = table(spark, [*clustered, None]), asked(spark, [*clustered[::29], np.zeros(24), None])
    cells.build(known, str(tmp_path / "s"))
    compared = spark.sparkContext.accumulator(0)
    found = rows(cells.search(spark, str(tmp_path / "s"), queries, 10, compared))
    assert found == rows(retrieval.dense_top(queries, known, 10, normalize=True))
    assert len(found) == 10 * (len(clustered[::29]) + 1)
    assert compared.value < 0.5 * len(clustered) * len(clustered[::29])


def test_vectors_without_clusters(spark, tmp_path):
    v = np.random.default_rng(4).standard_normal((300, 8))
    known, queries = table(spark, v), asked(spark, v[:40])
    cells.build(known, str(tmp_path / "s"))
    for k in (1, 7, 299, 500):
        assert rows(cells.search(spark, str(tmp_path / f"s"), queries, k)) == rows(retrieval.dense_top(queries, known, k, normalize=True))


def test_queries_in_blocks(spark, tmp_path, clustered, monkeypatch):
    monkeypatch.setattr(cells, "QUERY_BYTES", 24 * 8 * 10)
    monkeypatch.setattr(cells, "SCORES", 1024)
    known, queries = table(spark, clustered), asked(spark, clustered[::60])
    cells.build(known, str(tmp_path / "s"))
    assert rows(cells.search(spark, str(tmp_path / "s"), queries, 5)) == rows(retrieval.dense_top(queries, known, 5, normalize=True))


def test_only_zeros_and_nothing(spark, tmp_path):
    cells.build(table(spark, [np.zeros(3)] * 4), str(tmp_path / "z"))
    assert [r[2] for r in rows(cells.search(spark, str(tmp_path / "z"), asked(spark, [[1, 0, 0]]), 2))] == ["c0", "c1"]
    cells.build(table(spark, [None, None]), str(tmp_path / "e"))
    assert not rows(cells.search(spark, str(tmp_path / "e"), asked(spark, [[1, 0, 0]]), 2))


def test_a_store_is_complete_only_with_its_cells(spark, tmp_path, clustered):
    import shutil

    cells.build(table(spark, clustered[:50]), str(tmp_path / "s"))
    shutil.move(tmp_path / "s" / "cells", tmp_path / "moved")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        cells.search(spark, str(tmp_path / "s"), asked(spark, clustered[:2]), 2)
