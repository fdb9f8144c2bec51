"""Variants from question to judged answer on literal tables."""

import pytest
from pyspark.sql import functions as F

from threadmill.operators import evaluation, retrieval, variants


@pytest.fixture(scope="module")
def world(spark):
    chunks = spark.createDataFrame([("a:0", 0, "a", "apples grow on trees"), ("a:1", 1, "a", "pears too"), ("b:0", 2, "b", "zinc is a metal"), ("c:0", 3, None, "rain falls")], "chunk_id string, ordinal long, parent_id string, text string")
    texts = spark.createDataFrame([("a", "all of fruit"), ("b", "all of zinc"), ("c:0", "rain falls")], "chunk_id string, text string")
    queries = spark.createDataFrame([(1, "zinc metal"), (2, "qqq")], "query_id long, query string")
    truth = spark.createDataFrame([(1, "b:0")], "query_id long, chunk_id string")
    return queries, {"parent_child": chunks, "naive_fixed": chunks}, texts, {"parent_child": truth, "naive_fixed": truth}


def test_groups_and_names():
    specs = variants.ladder("x") + variants.embedding_comparison({"y": 0, "x": 0}) + variants.weight_sweep("x")
    assert [s["name"] for s in specs[5:]] == ["hybrid_x", "hybrid_y", "hybrid_dense0.25_sparse0.75", "hybrid_dense0.5_sparse0.5", "hybrid_dense0.75_sparse0.25"]
    assert [s["group"] for s in specs] == ["ladder"] * 5 + ["embedding_comparison"] * 2 + ["weight_sweep"] * 3


def test_answers_and_report(world):
    queries, chunks, texts, truth = world
    judge = lambda p: evaluation.mock_verdict(F.when(p["retrieved_context"].contains("zinc") & p["generated_answer"].startswith("S:"), "x"))
    specs = variants.embedding_comparison({"letters": 0}) + variants.ladder("letters")[3:4]
    rows = variants.evaluate(specs, queries, chunks, texts, truth, {"letters": retrieval.letter_vector}, lambda q, c: F.concat(F.lit("S: "), q, F.substring(c, 1, 5)), judge)
    first = {r["query_id"]: r for r in rows.where("position = 0").collect()}
    assert first[1]["chunk_ids"][0] == "b:0" and first[1]["context_parent_ids"][0] == "b" and first[1]["truth_ids"] == ["b:0"]
    assert (first[1]["hit"], first[1]["reciprocal_rank"], first[2]["hit"], first[2]["truth_ids"]) == (1.0, 1.0, 0.0, [])
    assert first[1]["answer"] == "S: zinc metalall o"
    found = {r["name"]: r for r in variants.report(rows).collect()}
    assert set(found) == {"hybrid_letters", "parent_child_hybrid_rerank"}
    assert (found["hybrid_letters"]["hit_at_5"], found["hybrid_letters"]["num_examples"]) == (0.5, 2)
    assert found["hybrid_letters"]["faithfulness"] == 5.0 and found["hybrid_letters"]["pass_rate"] == 1.0


def test_a_bad_reply_fails_and_no_judge_gives_no_scores(world):
    queries, chunks, texts, truth = world
    spec = [{"name": "dense", "group": "ladder", "embedding": "letters", "chunking": "naive_fixed"}]
    models = {"letters": retrieval.letter_vector}
    bad = variants.report(variants.evaluate(spec, queries, chunks, texts, truth, models, lambda q, c: q, lambda p: F.lit("no json"))).first()
    assert bad["overall"] == 1.0 and bad["pass_rate"] == 0.0
    none = variants.report(variants.evaluate(spec, queries, chunks, texts, truth, models)).first()
    assert none["overall"] is None and none["pass_rate"] is None and none["num_examples"] == 2


def test_no_questions_and_no_chunks(world):
    queries, chunks, texts, truth = world
    spec, models = variants.embedding_comparison({"letters": 0}), {"letters": retrieval.letter_vector}
    judge = lambda p: evaluation.mock_verdict(p["retrieved_context"])
    assert not variants.evaluate(spec, queries.limit(0), chunks, texts, truth, models, lambda q, c: c, judge).collect()
    rows = variants.evaluate(spec, queries, {k: v.where("false") for k, v in chunks.items()}, texts, truth, models, lambda q, c: c, judge).collect()
    assert [(r["hit"], r["chunk_ids"], r["answer"], r["verdict"]["overall"]) for r in rows] == [(0.0, [], "", 2)] * 2
