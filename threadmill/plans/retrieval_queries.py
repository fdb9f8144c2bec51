"""Queries on retrieval and its evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.operators import cells, corpus, evaluation, retrieval, variants
from threadmill.plans import adapters as ad
from threadmill.plans.adapters import BM25_SQL, CHUNKS_SQL, HYBRID_SQL, LENGTHS_SQL, QUERIES_SQL, TRUTH_SQL, hybrid_sql, read
from threadmill.sources.scratch import durable, scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- vectors --------------------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), "vector")
    return queries, e.select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("ordinal"), "label", "vector")


_DENSE = """dense as (select q.vec_id as query_id, q.label as query_label, c.vec_id, c.label, list_dot_product(q.embedding::double[], c.embedding::double[]) as score
    from embeddings q, embeddings c where q.vec_id % 20 = 0 qualify row_number() over (partition by q.vec_id order by round(score, 6) desc, c.vec_id) <= 30),
dense_ranked as (select *, (row_number() over (partition by query_id order by round(score, 6) desc, vec_id) - 1)::int as rank from dense)"""


@query(f"with {_DENSE} select query_id, vec_id, rank, round(score, 5) as score from dense_ranked")
def dense_topk(spark, sf_dir):
    found = retrieval.dense_top(*_vectors(spark, sf_dir), retrieval.HYBRID_TOP)
    return found.select("query_id", F.col("ordinal").alias("vec_id"), "rank", F.round("score", 5).alias("score"))


@query(f"""with {_DENSE}, first as (select query_id, min(rank) filter (where label = query_label and vec_id <> query_id) as f from dense_ranked group by query_id)
    select query_id, case when f < 5 then 1.0 else 0.0 end::double as hit, case when f < 10 then 1.0 / (f + 1) else 0.0 end::double as reciprocal_rank from first""")
def dense_hit_mrr(spark, sf_dir):
    queries, known = _vectors(spark, sf_dir)
    found = retrieval.dense_top(queries, known, retrieval.HYBRID_TOP)
    true = found.join(known.select("chunk_id", "label"), "chunk_id").join(queries.select("query_id", "query_label"), "query_id").where("label = query_label and ordinal <> query_id")
    return retrieval.hits(found, true, queries)


@query("""select q.vec_id as query_id, c.vec_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 5) as score from embeddings q, embeddings c where q.vec_id % 20 = 0 and c.label < 5
    qualify row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) desc, c.vec_id) <= 10""")
def cosine_search(spark, sf_dir):
    """The store's search: cosine over the rows of one level that have a vector."""
    e = read(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    known = e.where("label < 5").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))
    return retrieval.dense_top(queries, known, 10, normalize=True).select("query_id", F.col("ordinal").alias("vec_id"), F.round("score", 5).alias("score"))


@query("""select q.vec_id as query_id, c.vec_id, (row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 6) desc, c.vec_id) - 1)::int as rank, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 5) as score
    from embeddings q, embeddings c where q.vec_id % 20 = 0 qualify rank < 10""")
def cosine_cells(spark, sf_dir):
    """The store's search over all rows by way of a stored partition into cells."""
    queries, known = _vectors(spark, sf_dir)
    path = f"{scratch(spark)}/threadmill-cells-{uuid.uuid4().hex}"
    cells.build(known, path)
    return cells.search(spark, path, queries, 10).select("query_id", F.col("ordinal").alias("vec_id"), "rank", F.round("score", 5).alias("score"))


@query("select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::double)), ',') || ']' as encoded from embeddings")
def vector_encoding(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", retrieval.encode_vector("embedding").alias("encoded"))


# --- text -----------------------------------------------------------------------------------------------------------


def _base(spark, sf_dir):
    """(questions, chunks), the chunks written out, as several steps read them."""
    known = durable(ad.chunks(spark, sf_dir).withColumn("vector", retrieval.letter_vector("text")), "chunks")
    asked = ad.questions(spark, sf_dir).withColumn("vector", retrieval.letter_vector("query"))
    return asked, known


def _candidates(spark, sf_dir):
    asked, known = _base(spark, sf_dir)
    return asked, known, retrieval.hybrid_candidates(asked, known)


def _hybrid(spark, sf_dir):
    asked, known, found = _candidates(spark, sf_dir)
    return asked, known, retrieval.hybrid_top(found)


@query(f"with {CHUNKS_SQL}, {QUERIES_SQL}, {BM25_SQL} select (select n from sizes) as chunks, round((select mean from sizes), 6) as mean_size, count(*) as terms, sum(df)::bigint as postings, round(avg(idf), 6) as mean_idf, count_if(raw < 0)::bigint as floored from dfs join idfs using (term, df)")
def bm25_stats(spark, sf_dir):
    counted = retrieval.statistics(ad.chunks(spark, sf_dir))
    n, mean = retrieval.corpus_size(counted)
    weights = retrieval.term_weights(retrieval.document_frequencies(counted), n)
    return weights.agg(F.lit(n).cast("long").alias("chunks"), F.round(F.lit(mean), 6).alias("mean_size"), F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.round(F.avg("idf"), 6).alias("mean_idf"), F.count_if(F.col("df") > F.lit(n / 2)).alias("floored"))


@query(f"with {CHUNKS_SQL}, {QUERIES_SQL}, {BM25_SQL} select query_id, chunk_id, (row_number() over (partition by query_id order by round(score, 6) desc, ordinal) - 1)::int as rank, round(score, 4) as score from sparse qualify rank < 10")
def bm25_topk(spark, sf_dir):
    found = retrieval.bm25_top(ad.questions(spark, sf_dir), durable(ad.chunks(spark, sf_dir), "chunks"), 10)
    return found.select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query(f"with {HYBRID_SQL}, {hybrid_sql(k=10)} select query_id, chunk_id, rank::int as rank, round(score, 4) as score from hybrid")
def hybrid_topk(spark, sf_dir):
    _, _, found = _candidates(spark, sf_dir)
    return retrieval.hybrid_top(found, k=10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


_SWEEP = f"""with {HYBRID_SQL}, {TRUTH_SQL}, w as (select * from (values (0.25::double, 0.75::double), (0.5, 0.5), (0.75, 0.25)) t(dense_weight, sparse_weight)),
    swept as (select dense_weight, query_id, chunk_id, row_number() over (partition by dense_weight, query_id order by round(dense_weight * dense_norm + sparse_weight * sparse_norm, 6) desc, ordinal) - 1 as rank from candidates, w),
    firsts as (select w.dense_weight, q.query_id, min(rank) filter (where t.chunk_id is not null and rank < 30) as f from w cross join queries q left join swept s on s.dense_weight = w.dense_weight and s.query_id = q.query_id left join truth t on t.query_id = s.query_id and t.chunk_id = s.chunk_id group by all)
    select dense_weight, round(avg(case when f < 5 then 1.0 else 0.0 end), 6)::double as hit_at_5, round(avg(case when f < 10 then 1.0 / (f + 1) else 0.0 end), 6)::double as mrr_at_10, count(*) as num_examples from firsts group by dense_weight"""


@query(_SWEEP)
def weight_sweep(spark, sf_dir):
    asked, known, found = _candidates(spark, sf_dir)
    swept = retrieval.weight_sweep(durable(found, "candidates"))
    judged = retrieval.hits(swept, ad.truth(spark, sf_dir, known), asked, by=("dense_weight",))
    return retrieval.retrieval_metrics(judged, ("dense_weight",)).select("dense_weight", F.round("hit_at_5", 6).alias("hit_at_5"), F.round("mrr_at_10", 6).alias("mrr_at_10"), "num_examples")


_HALVES = f"""{CHUNKS_SQL}, halves as (select item_id as of, n, text as query from benchmark, (values (0)) v(n)
        union all select item_id, 1, array_to_string(w[1:len(w) // 2], ' ') from (select item_id, {ad.words_sql('text')} as w from benchmark)
        union all select item_id, 2, array_to_string(w[len(w) // 2 + 1:], ' ') from (select item_id, {ad.words_sql('text')} as w from benchmark)),
    queries as (select of * 10 + n as query_id, query from halves), {BM25_SQL},
    per as (select *, query_id // 10 as of from sparse qualify row_number() over (partition by query_id order by round(score, 6) desc, ordinal) <= 30),
    normed as (select of, chunk_id, case when max(score) over w - min(score) over w <= 0 then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as score from per window w as (partition by query_id)),
    fused as (select of as query_id, chunk_id, max(score) as score from normed group by all)"""


@query(f"with {_HALVES} select query_id, chunk_id, (row_number() over (partition by query_id order by round(score, 6) desc, chunk_id) - 1)::int as rank, round(score, 4) as score from fused qualify rank < 30")
def multiquery_fuse(spark, sf_dir):
    """Fusion of three phrasings: the question, its first half and its second half, ranked by BM25 and brought to 0..1 each."""
    w = tx.words("query")
    half = F.expr("size(w) div 2").cast("int")
    q = ad.questions(spark, sf_dir).withColumn("w", w)
    parts = F.array(F.col("query"), F.array_join(F.slice("w", F.lit(1), half), " "), F.array_join(F.slice("w", half + 1, F.size("w")), " "))
    each = q.select("query_id", F.posexplode(parts).alias("n", "query")).select((F.col("query_id") * 10 + F.col("n")).alias("query_id"), "query")
    top = retrieval.bm25_top(each, durable(ad.chunks(spark, sf_dir), "chunks"), 30)
    from pyspark.sql import Window

    one = Window.partitionBy("query_id")
    span = F.max("score").over(one) - F.min("score").over(one)
    normed = top.withColumn("score", F.when(span <= 0, 0.0).otherwise((F.col("score") - F.min("score").over(one)) / F.nullif(span, F.lit(0.0)))).withColumn("query_id", F.expr("query_id div 10"))
    return retrieval.fuse(normed).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


_RERANKED = f"""{hybrid_sql()}, common as (select h.query_id, h.chunk_id, h.rank as before, len(list_intersect(list_distinct({ad.words_sql('lower(q.query)')}), list_distinct({ad.words_sql('lower(c.text)')})))::double as score from hybrid h join queries q using (query_id) join chunks c using (chunk_id)),
    reranked as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, before) - 1 as rank from common qualify rank < 10)"""


@query(f"with {HYBRID_SQL}, {_RERANKED} select query_id, chunk_id, rank::int as rank, score from reranked")
def rerank_overlap(spark, sf_dir):
    asked, known, found = _hybrid(spark, sf_dir)
    return retrieval.rerank(durable(found, "hybrid"), asked, known).select("query_id", "chunk_id", "rank", "score")


_CONTEXT = f"with {HYBRID_SQL}, {hybrid_sql()}, p as (select query_id, parent_id, min(rank) as first_rank from hybrid join chunks using (chunk_id) where rank < 5 group by all)"


@query(f"{_CONTEXT} select query_id, string_agg(parent_id, ',' order by first_rank) as parents from p group by query_id")
def context_parents(spark, sf_dir):
    _, known, found = _hybrid(spark, sf_dir)
    return retrieval.context_parents(durable(found, "hybrid"), known).select("query_id", F.array_join("context_parent_ids", ",").alias("parents"))


@query(f"{_CONTEXT} select query_id, md5(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by first_rank)) as digest from p join (select 'doc:' || doc_id as parent_id, text from documents) using (parent_id) group by query_id")
def context_text(spark, sf_dir):
    _, known, found = _hybrid(spark, sf_dir)
    texts = ad.documents(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    return retrieval.build_context(retrieval.context_parents(durable(found, "hybrid"), known), texts).select("query_id", F.md5("context").alias("digest"))


_FIRSTS = f"with {HYBRID_SQL}, {hybrid_sql()}, {TRUTH_SQL}, firsts as (select q.query_id, min(rank) filter (where t.chunk_id is not null) as f from queries q left join hybrid h on h.query_id = q.query_id left join truth t on t.query_id = h.query_id and t.chunk_id = h.chunk_id group by all)"
_METRICS = "round(avg(case when f < 5 then 1.0 else 0.0 end), 6)::double as hit_at_5, round(avg(case when f < 10 then 1.0 / (f + 1) else 0.0 end), 6)::double as mrr_at_10"


@query(f"{_FIRSTS} select {_METRICS}, count(*) as num_examples from firsts")
def retrieval_eval(spark, sf_dir):
    asked, known, found = _hybrid(spark, sf_dir)
    m = retrieval.retrieval_metrics(retrieval.hits(durable(found, "hybrid"), ad.truth(spark, sf_dir, known), asked))
    return m.select(F.round("hit_at_5", 6).alias("hit_at_5"), F.round("mrr_at_10", 6).alias("mrr_at_10"), "num_examples")


@query(f"{_FIRSTS}, m as (select {_METRICS} from firsts) select metric, actual, threshold::double as threshold, coalesce(actual >= threshold, false) as passed from (select 'hit_at_5' as metric, hit_at_5 as actual, 0.3 as threshold from m union all select 'mrr_at_10', mrr_at_10, 0.18 from m union all select 'faithfulness', null, 4.0)")
def eval_gate(spark, sf_dir):
    m = retrieval_eval(spark, sf_dir).select(F.explode(F.array(F.struct(F.lit("hit_at_5").alias("metric"), F.col("hit_at_5").alias("value")), F.struct(F.lit("mrr_at_10").alias("metric"), F.col("mrr_at_10").alias("value")))).alias("m")).select("m.*")
    return evaluation.threshold_checks(m, {"hit_at_5": 0.3, "mrr_at_10": 0.18, "faithfulness": 4.0, "required": True})


def _ladder(spark, sf_dir):
    """(variant number, its results) over two sets of chunks: windows of 400 words, and the children of parent and child chunks."""
    docs = ad.documents(spark, sf_dir)
    records = docs.select(F.lit("docs").alias("source_type"), F.col("doc_id").cast("string").alias("source_id"), "text", F.lit(None).cast("long").alias("github_issue_id"), F.lit(None).cast("long").alias("github_comment_id"))
    number = F.col("source_id").cast("long") * 1_000_000 + F.col("parent_index") * 1000 + F.col("child_index")
    children = corpus.parent_child_chunks(records).where("level = 'child'").select("chunk_id", number.alias("ordinal"), "parent_id", "text")
    return ad.questions(spark, sf_dir), {"naive_fixed": durable(ad.chunks(spark, sf_dir), "naive"), "parent_child": durable(children, "children")}


@query()
def variant_ladder(spark, sf_dir):
    """All five variants over the questions, each over the chunks that its configuration names."""
    asked, known = _ladder(spark, sf_dir)
    truth, out, searches = {k: durable(ad.truth(spark, sf_dir, v), "truth") for k, v in known.items()}, None, retrieval.Searches(asked, known)
    for n, config in enumerate(retrieval.LADDER):
        found = durable(retrieval.run_variant(config, asked, known, searches=searches), "variant")
        m = retrieval.retrieval_metrics(retrieval.hits(found, truth[config["chunking"]], asked)).withColumns({"position": F.lit(n), "name": F.lit(config["name"])})
        out = m if out is None else out.unionByName(m)
    return out.select("position", "name", "hit_at_5", "mrr_at_10", "num_examples")


def _judge(payload):
    """A stand-in that needs no service: scores by how many of the question's words the context and the answer hold."""
    words = lambda x: F.array_distinct(tx.words(F.lower(x)))
    asked = words(payload["question"])
    score = lambda x: 1 + F.floor(4 * F.size(F.array_intersect(asked, words(x))) / F.greatest(F.size(asked), F.lit(1)))
    context, answer = score(payload["retrieved_context"]), score(payload["generated_answer"])
    given = {"faithfulness": context, "answer_relevancy": answer, "context_usefulness": context, "completeness": answer, "refusal_quality": F.lit(5), "overall": F.least(context, answer)}
    return F.to_json(F.struct(*(v.alias(k) for k, v in given.items()), (context >= 4).alias("pass"), F.array().cast("array<string>").alias("failure_reasons")))


def _compared(spark, sf_dir):
    """A row an embedder and question: the hybrid search with each of two embedders, answered and judged."""
    known = durable(ad.chunks(spark, sf_dir), "chunks")
    truth = durable(ad.truth(spark, sf_dir, known), "truth")
    texts = ad.documents(spark, sf_dir).select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    specs = variants.embedding_comparison(ad.EMBEDDERS, "naive_fixed")
    return variants.evaluate(specs, ad.questions(spark, sf_dir), {"naive_fixed": known}, texts, {"naive_fixed": truth}, ad.EMBEDDERS, lambda question, context: evaluation.mock_answer(context), _judge)


_COMMON = f"""{hybrid_sql()}, {TRUTH_SQL}, firsts as (select q.query_id, min(rank) filter (where t.chunk_id is not null) as f from queries q left join hybrid h on h.query_id = q.query_id left join truth t on t.query_id = h.query_id and t.chunk_id = h.chunk_id group by all),
    places as (select query_id, parent_id, min(rank) as first_rank from hybrid join chunks using (chunk_id) where rank < 5 group by all),
    contexts as (select query_id, string_agg(parent_id, ',' order by first_rank) as parents, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by first_rank) as context from places join (select 'doc:' || doc_id as parent_id, text from documents) using (parent_id) group by query_id),
    shown as (select query_id, string_agg(chunk_id, ',' order by rank) filter (where rank < 5) as chunk_ids from hybrid group by query_id),
    true_ids as (select query_id, string_agg(chunk_id, ',' order by chunk_id) as truth_ids from truth group by query_id),
    answers as (select q.query_id, f, coalesce(chunk_ids, '') as chunk_ids, coalesce(parents, '') as parents, coalesce(truth_ids, '') as truth_ids, list_distinct({ad.words_sql('lower(query)')}) as asked,
        list_distinct({ad.words_sql("lower(coalesce(context, ''))")}) as held, list_distinct({ad.words_sql("lower('Based on the retrieved context: ' || left(coalesce(context, ''), 200))")}) as said
        from queries q join firsts using (query_id) left join contexts using (query_id) left join shown using (query_id) left join true_ids using (query_id)),
    scored as (select *, 1 + (4 * len(list_intersect(asked, held))) // greatest(len(asked), 1) as c, 1 + (4 * len(list_intersect(asked, said))) // greatest(len(asked), 1) as a from answers)"""


def _both(select: str) -> str:
    return " union all ".join(f"(with {base}, {_COMMON} select {n} as position, 'hybrid_{name}' as name, {select})" for n, (name, base) in enumerate((("lengths", LENGTHS_SQL), ("letters", HYBRID_SQL))))


@query(_both(f"{_METRICS}, count(*) as num_examples, round(avg(c), 6) as faithfulness, round(avg(a), 6) as answer_relevancy, round(avg(least(a, c)), 6) as overall, round(avg((c >= 4)::int), 6) as pass_rate from scored"))
def embedding_comparison(spark, sf_dir):
    """Two embedders under the same hybrid search, by retrieval and by judged answers."""
    found = variants.report(_compared(spark, sf_dir))
    return found.select("position", "name", "num_examples", *(F.round(c, 6).alias(c) for c in ("hit_at_5", "mrr_at_10", "faithfulness", "answer_relevancy", "overall", "pass_rate")))


@query(_both("query_id, chunk_ids, parents, truth_ids, c as faithfulness, a as answer_relevancy, c >= 4 as passed from scored"))
def variant_answers(spark, sf_dir):
    """What each variant found for each question, the parents of its context, the true chunks, and the verdict."""
    listed = lambda c: F.array_join(c, ",")
    return _compared(spark, sf_dir).select("position", "name", "query_id", listed("chunk_ids").alias("chunk_ids"), listed("context_parent_ids").alias("parents"), listed("truth_ids").alias("truth_ids"), F.col("verdict.faithfulness").cast("long").alias("faithfulness"), F.col("verdict.answer_relevancy").cast("long").alias("answer_relevancy"), F.col("verdict.pass").alias("passed"))


def entry(spark, sf_dir):
    return hybrid_topk(spark, sf_dir).where(F.col("rank") < 5)
