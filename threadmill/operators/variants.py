"""Evaluation of retrieval variants from question to judged answer, for several groups of variants at once.

A variant is a dict with ``name``, ``group`` and the settings of ``retrieval.run_variant``; ``embedding`` names its embedder. Models are
parameters: embedders, a scorer and rewrites as in ``run_variant``, ``generate(question, context)`` and ``judge(payload)``, each from
columns to a column, so that a model is a pandas UDF and an offline stand-in a plain expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.operators import evaluation, retrieval
from threadmill.sources.scratch import durable

# The groups of a report.
GROUPS = ("ladder", "embedding_comparison", "weight_sweep")


def ladder(embedding: str) -> list[dict]:
    return [{**config, "group": GROUPS[0], "embedding": embedding} for config in retrieval.LADDER]


def embedding_comparison(embeddings, chunking: str = "parent_child") -> list[dict]:
    """The hybrid search with equal weights for each embedder, in the order of their names."""
    return [{"name": f"hybrid_{e}", "group": GROUPS[1], "embedding": e, "chunking": chunking, "hybrid": True, "dense_weight": 0.5, "sparse_weight": 0.5} for e in sorted(embeddings)]


def weight_sweep(embedding: str, weights=retrieval.WEIGHTS, chunking: str = "parent_child") -> list[dict]:
    return [{"name": f"hybrid_dense{d}_sparse{s}", "group": GROUPS[2], "embedding": embedding, "chunking": chunking, "hybrid": True, "dense_weight": d, "sparse_weight": s} for d, s in weights]


def answered(config: dict, queries: DataFrame, chunks: DataFrame, texts: DataFrame, truth: DataFrame, embed: Callable, generate: Callable | None = None, judge: Callable | None = None, **models) -> DataFrame:
    """(query_id, hit, reciprocal_rank, chunk_ids, context_parent_ids, truth_ids, answer, verdict) of one variant, a row a query.

    chunk_ids are the chunks that make the context; without any found, lists are empty and the context is. The judge gets
    struct(question, retrieved_context, generated_answer, ideal_answer, ground_truth_chunk_ids, retrieved_chunk_ids), its reply is
    read by ``evaluation.parse_judge``. Without generate or judge there is no answer and no verdict. queries may have ideal_answer.
    """
    found = durable(retrieval.run_variant(config, queries, chunks, embed, **models), "variant")
    judged = retrieval.hits(found, truth, queries)
    in_order = lambda rows: F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(rows)
    listed = found.groupBy("query_id").agg(in_order("retrieved_ids"))  # HYBRID_TOP chunks a query at most
    true = truth.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("truth_ids"))
    parents = retrieval.context_parents(found, chunks)
    rows = judged.join(listed, "query_id", "left").join(parents, "query_id", "left").join(true, "query_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("retrieved_ids", "context_parent_ids", "truth_ids")})
    shown = ["query_id", "hit", "reciprocal_rank", F.slice("retrieved_ids", 1, retrieval.CONTEXT_CHUNKS).alias("chunk_ids"), "context_parent_ids", "truth_ids"]
    if generate is None or judge is None:
        verdict = evaluation.parse_judge(F.lit(None).cast("string"))
        return rows.select(*shown, F.lit(None).cast("string").alias("answer"), F.when(F.lit(False), verdict).alias("verdict"))
    asked = queries if "ideal_answer" in queries.columns else queries.withColumn("ideal_answer", F.lit(None).cast("string"))
    contexts = retrieval.build_context(rows.select("query_id", "context_parent_ids"), texts)
    rows = rows.join(asked.select("query_id", "query", "ideal_answer"), "query_id").join(contexts, "query_id").withColumn("answer", generate(F.col("query"), F.col("context")))
    payload = F.struct(F.col("query").alias("question"), F.col("context").alias("retrieved_context"), F.col("answer").alias("generated_answer"), "ideal_answer", F.col("truth_ids").alias("ground_truth_chunk_ids"), F.col("retrieved_ids").alias("retrieved_chunk_ids"))
    return rows.select(*shown, "answer", evaluation.parse_judge(judge(payload)).alias("verdict"))


def evaluate(specs: list[dict], queries: DataFrame, chunks: dict[str, DataFrame], texts: DataFrame, truth: dict[str, DataFrame], embedders: dict[str, Callable], generate: Callable | None = None, judge: Callable | None = None, **models) -> DataFrame:
    """``answered`` of all variants, under group, position (in specs) and name, written out.

    chunks and truth have a table for each kind of chunking. Names of variants must be unique within a group.
    """
    out, searches = None, retrieval.Searches(queries, chunks)
    for position, config in enumerate(specs):
        kind = config["chunking"]
        rows = durable(answered(config, queries, chunks[kind], texts, truth[kind], embedders[config["embedding"]], generate, judge, searches=searches, **models), "answered")
        rows = rows.select(F.lit(config["group"]).alias("group"), F.lit(position).alias("position"), F.lit(config["name"]).alias("name"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def report(rows: DataFrame) -> DataFrame:
    """(group, position, name, hit_at_5, mrr_at_10, num_examples, the six mean scores, pass_rate): a row a variant; scores are null where nothing was judged."""
    means = [F.avg(F.col(f"verdict.{d}")).alias(d) for d in evaluation.DIMENSIONS]
    return rows.groupBy("group", "position", "name").agg(F.avg("hit").alias("hit_at_5"), F.avg("reciprocal_rank").alias("mrr_at_10"), F.count(F.lit(1)).alias("num_examples"), *means, F.avg(F.col("verdict.pass").cast("int")).alias("pass_rate"))
