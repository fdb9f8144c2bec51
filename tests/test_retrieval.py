import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.operators import retrieval as rt
from threadmill.plans import adapters as ad

TEXTS = ["alpha beta gamma", "beta beta delta", "epsilon the zeta", "the the alpha", "", "gamma delta epsilon beta"]


@pytest.fixture
def chunks(spark):
    rng = np.random.default_rng(0)
    rows = [(f"c{i}", i, f"p{i % 3}" if i % 2 else None, t, rng.standard_normal(4).tolist()) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "chunk_id string, ordinal long, parent_id string, text string, vector array<double>")


def plain_bm25(query):
    docs = [Counter(t.split()) for t in TEXTS]
    n, mean = len(docs), sum(d.total() for d in docs) / len(docs)
    df = Counter(w for d in docs for w in d)
    idf = {w: math.log(n - k + 0.5) - math.log(k + 0.5) for w, k in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * average if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d[w] * 2.5 / (d[w] + 1.5 * (0.25 + 0.75 * d.total() / mean)) for w in query.split()) for d in docs]


def test_bm25(spark, chunks):
    queries = spark.createDataFrame([(1, "beta the beta nope"), (2, "nothing here"), (3, "zeta alpha")], "query_id long, query string")
    found = defaultdict(dict)
    for r in rt.Sparse(queries, chunks).top(1000).collect():
        found[r["query_id"]][r["ordinal"]] = r["score"]
    for q, text in ((1, "beta the beta nope"), (3, "zeta alpha")):
        for i, s in enumerate(plain_bm25(text)):
            assert found[q].get(i, 0) == pytest.approx(s)
    assert 2 not in found
    padded = rt.ranked(rt.padded(rt.Sparse(queries, chunks).top(1000), queries, chunks, 4), 4)
    assert [r["ordinal"] for r in padded.where("query_id = 2").orderBy("rank").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("limit", [1 << 25, 40])
def test_dense_in_blocks_of_queries(spark, monkeypatch, limit):
    monkeypatch.setattr(rt, "QUERY_BYTES", limit)
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (200, 5)).astype(float)  # many equal scores
    q = rng.integers(-3, 4, (7, 5)).astype(float)
    known = spark.createDataFrame([(f"c{i}", i, x.tolist()) for i, x in enumerate(v)] + [("none", 999, None)], "chunk_id string, ordinal long, vector array<double>").repartition(5)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    for normalize in (False, True):
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if normalize else x for x in (q, v))
        out = defaultdict(list)
        for r in rt.dense_top(asked, known, 6, normalize).orderBy("query_id", "rank").collect():
            out[r["query_id"]].append(r["ordinal"])
        for i, s in enumerate(np.round(a @ b.T, 6)):
            assert out[i] == np.lexsort((np.arange(200), -s))[:6].tolist()


def test_hybrid_and_sweep(spark, chunks):
    queries = spark.createDataFrame([(1, "beta the", [1.0, 0.0, 0.5, 0.0])], "query_id long, query string, vector array<double>")
    got = {r["chunk_id"]: r for r in rt.hybrid_candidates(queries, chunks).collect()}
    assert len(got) == 6
    dense = {r["chunk_id"]: float(np.dot([1, 0, 0.5, 0], r["vector"])) for r in chunks.collect()}
    sparse = dict(zip(got and [f"c{i}" for i in range(6)], plain_bm25("beta the"), strict=True))
    scale = lambda d, k: (d[k] - min(d.values())) / (max(d.values()) - min(d.values()))
    for k, r in got.items():
        assert (r["dense_norm"], r["sparse_norm"]) == (pytest.approx(scale(dense, k)), pytest.approx(scale(sparse, k)))
    swept = rt.weight_sweep(rt.hybrid_candidates(queries, chunks), ((0.0, 1.0), (1.0, 0.0))).where("rank = 0").collect()
    assert {r["dense_weight"]: r["chunk_id"] for r in swept} == {0.0: max(sparse, key=sparse.get), 1.0: max(dense, key=dense.get)}
    flat = rt.hybrid_candidates(queries.withColumn("query", F.lit("nope")), chunks.withColumn("vector", F.array(*[F.lit(0.0)] * 4)))
    assert {(r["dense_norm"], r["sparse_norm"]) for r in flat.collect()} == {(0.0, 0.0)}
    assert rt.pipeline_weight(0.0) == 0.5


def test_fusion_rerank_context_and_metrics(spark, chunks):
    results = spark.createDataFrame([(1, "c0", 0, 0, 0.5), (1, "c1", 1, 1, 0.4), (1, "c0", 0, 0, 0.9), (1, "c5", 5, 2, 0.9)], "query_id long, chunk_id string, ordinal long, rank int, score double")
    assert [(r["chunk_id"], r["score"]) for r in rt.fuse(results).orderBy("rank").collect()] == [("c0", 0.9), ("c5", 0.9), ("c1", 0.4)]
    queries = spark.createDataFrame([(1, "Beta DELTA delta"), (2, "x")], "query_id long, query string")
    one = spark.createDataFrame([(1, "c0", 0, 0, 9.0), (1, "c1", 1, 1, 8.0), (1, "c5", 5, 2, 7.0), (1, "gone", 7, 3, 6.0)], results.schema)
    ranked = rt.rerank(one, queries, chunks)
    assert [(r["chunk_id"], r["score"]) for r in ranked.orderBy("rank").collect()] == [("c1", 2.0), ("c5", 2.0), ("c0", 1.0), ("gone", 0.0)]
    assert rt.rerank(one, queries, chunks, k=2).count() == 2
    contexts = rt.context_parents(ranked, chunks)
    assert contexts.first()["context_parent_ids"] == ["p1", "p2", "c0", "gone"]
    texts = spark.createDataFrame([("p2", "two"), ("p1", "one")], "chunk_id string, text string")
    assert rt.build_context(contexts, texts).first()["context"] == "one\n\n---\n\ntwo"
    truth = spark.createDataFrame([(1, "c5"), (1, "c0")], "query_id long, chunk_id string")
    judged = {r["query_id"]: (r["hit"], r["reciprocal_rank"]) for r in rt.hits(ranked, truth, queries).collect()}
    assert judged == {1: (1.0, 0.5), 2: (0.0, 0.0)}
    m = rt.retrieval_metrics(rt.hits(ranked, truth, queries)).first()
    assert (m["hit_at_5"], m["mrr_at_10"], m["num_examples"]) == (0.5, 0.25, 2)


def test_variants_find_a_chunk_by_its_own_text(spark, chunks):
    queries = spark.createDataFrame([(i, TEXTS[i]) for i in (0, 2, 5)], "query_id long, query string")
    truth = spark.createDataFrame([(i, f"c{i}") for i in (0, 2, 5)], "query_id long, chunk_id string")
    for config in rt.LADDER:
        m = rt.retrieval_metrics(rt.hits(rt.run_variant(config, queries, chunks.drop("vector")), truth, queries)).first()
        assert m["hit_at_5"] == 1.0, config
    exact = rt.run_variant({"hybrid": False}, queries, chunks.drop("vector"), embed=rt.mock_embed)
    assert {r["query_id"]: r["chunk_id"] for r in exact.where("rank = 0").collect()} == {0: "c0", 2: "c2", 5: "c5"}


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>").select(rt.unit("a").alias("a"), rt.unit("b").alias("b"), rt.encode_vector("a").alias("t"), rt.cosine("a", "a").alias("c")).first()
    assert (r["a"], r["b"], r["t"], r["c"]) == ([0.6, 0.8], [0.0, 0.0], "[3.00000000,4.00000000]", pytest.approx(1.0))
    random.seed(0)
    assert math.isclose(sum(x * x for x in rt.mock_vector("text")), 1.0, rel_tol=1e-5)


@pytest.mark.parametrize("cells", [1, 40, 1000])
def test_any_number_of_cells_gives_the_same_ranking(spark, monkeypatch, cells):
    rng = random.Random(cells)
    text = lambda: " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(0, 20)))
    queries = spark.createDataFrame([(i, text(), [rng.random() for _ in range(4)]) for i in range(30)], "query_id long, query string, vector array<double>")
    chunks = spark.createDataFrame([(f"c{i}", i, text(), [rng.random() for _ in range(4)]) for i in range(150)], "chunk_id string, ordinal long, text string, vector array<double>").repartition(3)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())
    expected = rows(rt.dense_top(queries, chunks, 5)), rows(rt.bm25_top(queries, chunks, 5))
    monkeypatch.setattr(rt, "CELLS", cells)
    assert (rows(rt.dense_top(queries, chunks, 5)), rows(rt.bm25_top(queries, chunks, 5))) == expected


def test_encoding_rounds_the_exact_value_and_ties_to_even(spark):
    values = [2.0**-9, -3 * 2.0**-9, 0.123456785, 5e-9, -0.0, None]
    r = spark.createDataFrame([(values,), ([],), (None,)], "v array<double>").select(rt.encode_vector("v").alias("t")).collect()
    assert [x["t"] for x in r] == ["[0.00195312,-0.00585938,0.12345678,0.00000001,-0.00000000]", "[]", None]


@pytest.mark.parametrize("text", ["Kelvin \u212a, \u0130stanbul, don't; A1-b2 \u00c5\u00e9z zz", "", " \u3000", "ABC abc" * 50])
def test_tokens_and_letters_of_python_are_those_of_columns(spark, text):
    low = text.lower()
    assert [t.decode() for t in rt.tokens(text)] == spark.createDataFrame([(text,)], "t string").select(tx.search_tokens("t").alias("t")).first()["t"]
    r = spark.createDataFrame([(text,), (None,)], "t string").select(rt.letter_vector("t").alias("a"), ad.length_vector("t").alias("b")).collect()
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) if any(v) else x for x in v]
    sizes = [len(w) for w in re.findall("[a-z]+", low)]
    assert r[0]["a"] == unit([low.count(c) for c in "abcdefghijklmnopqrstuvwxyz"]) and r[1]["a"] is None
    assert r[0]["b"] == unit([sizes.count(k) for k in range(1, 17)]) and r[1]["b"] is None


def test_variants_share_what_they_have_in_common(spark, monkeypatch):
    counted, asked = [], []
    statistics, top = rt.statistics, rt.Sparse._top
    monkeypatch.setattr(rt, "statistics", lambda chunks: counted.append(1) or statistics(chunks))
    monkeypatch.setattr(rt.Sparse, "_top", lambda self, k: asked.append(k) or top(self, k))
    queries = spark.createDataFrame([(0, "alpha beta"), (1, "gamma delta")], "query_id long, query string")
    chunks = spark.createDataFrame([(f"c{i}", i, f"p{i}", t) for i, t in enumerate(TEXTS)], "chunk_id string, ordinal long, parent_id string, text string")
    searches = rt.Searches(queries, chunks)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())
    for embed in (rt.letter_vector, ad.length_vector):
        for config in rt.LADDER:
            assert rows(rt.run_variant(config, queries, chunks, embed, searches=searches)) == rows(rt.run_variant(config, queries, chunks, embed))
    alone = 2 * sum(bool(x.get("hybrid")) for x in rt.LADDER)
    assert (len(counted), len(asked)) == (alone + 1, alone + 2)  # with rewrites and without
