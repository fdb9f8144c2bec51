"""Exact retrieval: dense, BM25 and hybrid top-k, fusion, reranking, context, and their evaluation.

Tables: queries(query_id, query, vector), chunks(chunk_id, ordinal, parent_id, text, vector), ranked(query_id, rank,
chunk_id, ..., score) with ranks from 0. Scores are ranked rounded to six decimals, then by ordinal, so that the order in
which floats are added never decides.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.sources.scratch import durable

# BM25 constants, and the cut-offs of the stages of retrieval.
K1, B, FLOOR = 1.5, 0.75, 0.25
DENSE_TOP, SPARSE_TOP, HYBRID_TOP, RERANK_TOP, CONTEXT_CHUNKS = 20, 20, 30, 10, 5
HIT_AT, RECIPROCAL_AT = 5, 10
WEIGHTS = ((0.25, 0.75), (0.5, 0.5), (0.75, 0.25))
#: Bytes of query vectors and terms of queries that are sent to the tasks at once, and chunks that a task scores at once.
QUERY_BYTES, TERMS, CHUNKS = 32 << 20, 500_000, 512
#: Scores, and parts of scores, that a task holds at once, whatever the number of queries.
CELLS = 4 << 20


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = tx.col(a), tx.col(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column | str) -> Column:
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))
    return tx.let(F.transform(tx.col(v), lambda x: x.cast("double")), lambda v: tx.let(F.sqrt(dot(v, v)), lambda n: scaled(v, n)))


def counted_vector(text: Column | str, count: Callable[[bytes], np.ndarray]) -> Column:
    """The unit vector of what count finds in the lower-case UTF-8 of a text; null stays null."""

    @F.arrow_udf("array<double>")
    def counts(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else count(t.lower().encode()).tolist() for t in texts.to_pylist()], pa.list_(pa.float64()))

    return unit(counts(tx.col(text)))


def letter_vector(text: Column | str) -> Column:
    """The unit vector of a-z counts: a stand-in for an embedding that any engine can compute. It has no meaning."""
    return counted_vector(text, lambda low: np.bincount(np.frombuffer(low, np.uint8), minlength=256)[97:123])


def ranked(scored: DataFrame, k: int, order: list[Column] | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first k rows of each query with rank from 0: by rounded score, then ordinal. The limit reaches below the shuffle."""
    order = order or [F.desc(F.round("score", 6)), F.asc("ordinal")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return scored.withColumn("rank", rank).where(F.col("rank") < k)


def dense_top(queries: DataFrame, chunks: DataFrame, k: int, normalize: bool = False) -> DataFrame:
    """ranked(query_id, chunk_id, ordinal, score): the k chunks of highest dot product (cosine if normalize) with each query.

    Queries go to the tasks in blocks of bounded size. A task multiplies each batch of chunks with a block and passes on
    its own k best for each query, so the shuffle carries k rows a query and task, whatever the number of chunks.
    Chunks without a vector are left out.
    """
    out = None
    spark = chunks.sparkSession
    size = queries.select((F.max(F.size("vector")) * 8).alias("b"), F.count(F.lit(1)).alias("n")).first()
    blocks = int((size["b"] or 0) * size["n"] // QUERY_BYTES + 1)
    for block in range(blocks):
        rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select("query_id", "vector").where("vector is not null").collect()
        if not rows:
            continue
        matrix = np.array([r["vector"] for r in rows], float)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300) if normalize else matrix
        sent = spark.sparkContext.broadcast(([r["query_id"] for r in rows], matrix))

        def work(batches, sent=sent):
            ids, q = sent.value
            best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))] * len(ids)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.stack(batch.column(2).to_numpy(zero_copy_only=False)).astype(float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) if normalize else v
                names, ordinals, step = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), max(1, CELLS // batch.num_rows)
                for at in range(0, len(ids), step):
                    for i, s in enumerate(q[at : at + step] @ v.T, at):
                        near = np.flatnonzero(s >= np.partition(s, -k)[-k] - 1e-6) if len(s) > k else np.arange(len(s))
                        s, o, n = (np.concatenate(x) for x in zip(best[i], (s[near], ordinals[near], names[near]), strict=True))
                        top = np.lexsort((o, -np.round(s, 6)))[:k]
                        best[i] = s[top], o[top], n[top]
            for name, (s, o, n) in zip(ids, best, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(n, pa.string()), pa.array(o, pa.int64()), pa.array(s, pa.float64())], ["query_id", "chunk_id", "ordinal", "score"])

        kind = queries.schema["query_id"].dataType.simpleString()
        part = chunks.select(F.col("chunk_id").cast("string"), F.col("ordinal").cast("long"), "vector").where("vector is not null").mapInArrow(work, f"query_id {kind}, chunk_id string, ordinal long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, ordinal long, score double, rank int")
    return ranked(out, k)


# --- BM25 -----------------------------------------------------------------------------------------------------------

#: Bytes of the search tokens, in lower case, as themselves, all others as blanks.
_TOKEN_BYTES = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """``tx.search_tokens`` of one text."""
    return (text or "").lower().encode().translate(_TOKEN_BYTES).split()


def statistics(chunks: DataFrame) -> DataFrame:
    """(term, n, size), written out: how many chunks hold each term, and in the row without a term how many chunks and how many tokens there are.

    A task adds the chunks of a batch up, so a frequent term is a row a batch and not a row a chunk.
    """

    def work(batches):
        for batch in batches:
            found, size = Counter(), 0
            for text in batch.column(0).to_pylist():
                words = tokens(text)
                size += len(words)
                found.update(set(words))
            terms, n = [None, *(t.decode() for t in found)], [batch.num_rows, *found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array([size] + [0] * len(found), pa.int64())], ["term", "n", "size"])

    return durable(chunks.select("text").mapInArrow(work, "term string, n long, size long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "statistics")


def corpus_size(counted: DataFrame) -> tuple[int, float]:
    """(chunks, their mean number of tokens) of ``statistics``."""
    r = counted.where("term is null").first()
    return (r["n"], r["size"] / r["n"]) if r and r["n"] else (0, 0.0)


def document_frequencies(counted: DataFrame) -> DataFrame:
    """(term, df) of ``statistics``."""
    return counted.where("term is not null").select("term", F.col("n").alias("df"))


def term_weights(frequencies: DataFrame, n: int) -> DataFrame:
    """(term, df, idf): Okapi idf over the whole vocabulary, negative ones replaced by a quarter of the mean idf."""
    df = frequencies.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    return df.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): repeated words of a query count as often as they occur."""
    return queries.select("query_id", F.explode(tx.search_tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


class Sparse:
    """BM25 of some queries over some chunks: terms and statistics are found once, then whole rankings or single pairs are scored.

    The terms of the queries go to the tasks in blocks of at most ``TERMS``, so what is broadcast is bounded, and no posting
    is shuffled: a task scores its own chunks and passes on its k best for each query.
    """

    def __init__(self, queries: DataFrame, chunks: DataFrame, counted: DataFrame | None = None):
        """counted: the ``statistics`` of the chunks, where they are known."""
        self.chunks, self.kind, self._tops = chunks, queries.schema["query_id"].dataType.simpleString(), {}
        counted = statistics(chunks) if counted is None else counted
        self.n, mean = corpus_size(counted)
        self.mean = mean or 1.0
        weights = term_weights(document_frequencies(counted), self.n)
        self.terms = durable(query_terms(queries).join(weights, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "query-terms")

    def _blocks(self):
        """(query ids, places of terms, (query, weight) of each term's queries) of each block of queries."""
        blocks = int(self.terms.count() // TERMS + 1)
        for block in range(blocks):
            rows = (self.terms if blocks == 1 else self.terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).collect()
            ids = list(dict.fromkeys(r["query_id"] for r in rows))
            number = {q: i for i, q in enumerate(ids)}
            by_term: dict[str, list[tuple[int, float]]] = defaultdict(list)
            for r in rows:
                by_term[r["term"]].append((number[r["query_id"]], r["weight"]))
            if rows:
                yield ids, {t.encode(): k for k, t in enumerate(by_term)}, list(by_term.values())

    def top(self, k: int) -> DataFrame:
        """(query_id, chunk_id, ordinal, score) of each query's k best chunks among those that share a term with it, and maybe some more; found once for each k."""
        if k not in self._tops:
            self._tops[k] = self._top(k)
        return self._tops[k]

    def _top(self, k: int) -> DataFrame:
        spark, mean, out = self.chunks.sparkSession, self.mean, None
        for content in self._blocks():
            sent = spark.sparkContext.broadcast(content)

            def work(batches, sent=sent):
                ids, places, asked = sent.value
                sizes = np.array([len(x) for x in asked])
                first = np.cumsum(sizes) - sizes
                query, weight = (np.array([y[c] for x in asked for y in x]) for c in (0, 1))
                best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, object))] * len(ids)
                worst = np.full(len(ids), -np.inf)  # of the k best so far
                step = max(1, min(CHUNKS, CELLS // len(ids)))
                for batch in batches:
                    for at in range(0, batch.num_rows, step):
                        names, ordinals, texts = (batch.column(c).slice(at, step).to_pylist() for c in range(3))
                        found = [tokens(t) for t in texts]
                        asked_for = [[places[t] for t in x if t in places] for x in found]
                        codes = np.fromiter(chain.from_iterable(asked_for), np.int64)
                        if not len(codes):
                            continue
                        norms = K1 * (1 - B + B * np.array([len(x) for x in found]) / mean)
                        cells, tf = np.unique(np.repeat(np.arange(len(texts)), [len(x) for x in asked_for]) * len(asked) + codes, return_counts=True)
                        chunk, term = np.divmod(cells, len(asked))
                        norm = norms[chunk]
                        part, many = tf * (K1 + 1) / (tf + norm), sizes[term]
                        scores, shared = np.zeros(len(ids) * len(texts)), np.zeros(len(ids) * len(texts), bool)
                        edges = [*np.unique(np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), CELLS))).tolist(), len(many)]
                        for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # no more than CELLS parts, and those of one posting, at once
                            own = np.arange(many[lo:hi].sum()) + np.repeat(first[term[lo:hi]] - (np.cumsum(many[lo:hi]) - many[lo:hi]), many[lo:hi])
                            cell = query[own] * len(texts) + np.repeat(chunk[lo:hi], many[lo:hi])
                            np.add.at(scores, cell, weight[own] * np.repeat(part[lo:hi], many[lo:hi]))
                            shared[cell] = True
                        scores, shared = scores.reshape(len(ids), -1), shared.reshape(len(ids), -1)
                        names, ordinals = np.array(names, object), np.array(ordinals)
                        near_best = shared & (scores >= worst[:, None] - 1e-6)  # ranks go by rounded scores
                        for i in np.flatnonzero(near_best.any(1)):
                            near = np.flatnonzero(near_best[i])
                            s, o, n = (np.concatenate(x) for x in zip(best[i], (scores[i, near], ordinals[near], names[near]), strict=True))
                            if len(s) > k:
                                keep = np.lexsort((o, -np.round(s, 6)))[:k]
                                s, o, n = s[keep], o[keep], n[keep]
                            best[i] = s, o, n
                            worst[i] = s.min() if len(s) >= k else -np.inf
                for name, (s, o, n) in zip(ids, best, strict=True):
                    if len(s):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(s)), pa.array(n, pa.string()), pa.array(o, pa.int64()), pa.array(s, pa.float64())], ["query_id", "chunk_id", "ordinal", "score"])

            rows = self.chunks.select(F.col("chunk_id").cast("string"), F.col("ordinal").cast("long"), "text")
            part = durable(rows.mapInArrow(work, f"query_id {self.kind}, chunk_id string, ordinal long, score double"), "sparse")
            sent.destroy()
            out = part if out is None else out.unionByName(part)
        return spark.createDataFrame([], f"query_id {self.kind}, chunk_id string, ordinal long, score double") if out is None else out

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """pairs(query_id, text, ...) with the column sparse, a pair's score; meant for a few rows a query."""
        counts = F.transform(F.array_distinct("__tokens"), lambda t: F.struct(t.alias("term"), F.size(F.filter("__tokens", lambda x: x == t)).cast("double").alias("tf")))
        wanted = self.terms.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("__weights"))
        tokens = pairs.withColumn("__tokens", tx.search_tokens(F.coalesce("text", F.lit("")))).join(wanted, "query_id", "left")
        kept = tokens.withColumn("__size", F.size("__tokens")).withColumn("__tokens", F.filter("__tokens", lambda t: F.coalesce(F.map_contains_key("__weights", t), F.lit(False))))
        norm = K1 * (1 - B + B * F.col("__size") / F.lit(self.mean))
        score = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.element_at("__weights", c["term"]) * c["tf"] * (K1 + 1) / (c["tf"] + norm))
        return kept.withColumn("sparse", F.coalesce(score, F.lit(0.0))).drop("__tokens", "__weights", "__size")


def bm25_top(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """ranked(query_id, chunk_id, ordinal, score): each query's k best chunks among those that share a term with it."""
    return ranked(Sparse(queries, chunks).top(k), k)


def padded(scored: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """scored with the first k chunks by ordinal added at score 0 where a query did not score them: with them, k best are k best of all chunks."""
    first = chunks.select(F.col("chunk_id").cast("string"), F.col("ordinal").cast("long")).orderBy("ordinal").limit(k)
    zero = queries.select("query_id").crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))  # k rows a query
    return scored.unionByName(zero).groupBy("query_id", "chunk_id", "ordinal").agg(F.max("score").alias("score"))


# --- hybrid ---------------------------------------------------------------------------------------------------------


def hybrid_candidates(queries: DataFrame, chunks: DataFrame, model: Sparse | None = None) -> DataFrame:
    """(query_id, chunk_id, ordinal, dense, sparse, dense_norm, sparse_norm): the 20 best of either kind with both scores, each brought to 0..1 over a query's candidates.

    Equal scores all become 0. Candidates are at most 40 a query; their scores are taken from their own texts and vectors.
    model: the ``Sparse`` of the queries over chunks of the same texts, where there is one.
    """
    model = model or Sparse(queries, chunks)
    by_sparse = ranked(padded(model.top(SPARSE_TOP), queries, chunks, SPARSE_TOP), SPARSE_TOP).select("query_id", "chunk_id", "ordinal")
    by_dense = dense_top(queries, chunks, DENSE_TOP).select("query_id", "chunk_id", "ordinal")
    pool = durable(by_sparse.union(by_dense).distinct(), "pool")
    known = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text", F.col("vector").alias("v"))
    pool = model.pairs(pool.join(known, "chunk_id")).join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    pool = pool.select("query_id", "chunk_id", "ordinal", F.coalesce(dot("q", "v"), F.lit(0.0)).alias("dense"), "sparse")
    one = Window.partitionBy("query_id")
    norm = lambda c: F.when(F.max(c).over(one) - F.min(c).over(one) <= 0, F.lit(0.0)).otherwise((F.col(c) - F.min(c).over(one)) / F.nullif(F.max(c).over(one) - F.min(c).over(one), F.lit(0.0)))
    return pool.withColumns({"dense_norm": norm("dense"), "sparse_norm": norm("sparse")})


def hybrid_top(candidates: DataFrame, dense_weight: float = 0.5, sparse_weight: float = 0.5, k: int = HYBRID_TOP) -> DataFrame:
    return ranked(candidates.withColumn("score", dense_weight * F.col("dense_norm") + sparse_weight * F.col("sparse_norm")), k)


def pipeline_weight(weight: float | None) -> float:
    """In a configured pipeline a weight of nought counts as not set."""
    return weight or 0.5


def weight_sweep(candidates: DataFrame, weights=WEIGHTS, k: int = HYBRID_TOP) -> DataFrame:
    """hybrid_top for several pairs of weights in one plan, under dense_weight and sparse_weight."""
    pairs = F.explode(F.array(*(F.struct(F.lit(float(d)).alias("dense_weight"), F.lit(float(s)).alias("sparse_weight")) for d, s in weights)))
    scored = candidates.withColumn("w", pairs).select("*", "w.*").drop("w").withColumn("score", F.col("dense_weight") * F.col("dense_norm") + F.col("sparse_weight") * F.col("sparse_norm"))
    return ranked(scored, k, by=("query_id", "dense_weight", "sparse_weight"))


def fuse(results: DataFrame, k: int = HYBRID_TOP) -> DataFrame:
    """One result for each query_id from those of its variants: a chunk's best score, ties by chunk_id."""
    best = results.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min("ordinal").alias("ordinal"))
    return ranked(best, k, [F.desc(F.round("score", 6)), F.asc("chunk_id")])


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """How many different lower-case words of the query the text has: the offline scorer."""
    return F.size(F.array_intersect(tx.words(F.lower(tx.col(query))), tx.words(F.lower(tx.col(text))))).cast("double")


def rerank(results: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, k: int = RERANK_TOP) -> DataFrame:
    """The k best of results by scorer(query, text), of equal ones by their rank before. Chunks without a text count as empty.

    scorer may be a pandas UDF around a model.
    """
    joined = results.join(queries.select("query_id", "query"), "query_id").join(texts.select(F.col("chunk_id").cast("string"), "text"), "chunk_id", "left")
    scored = joined.withColumns({"before": F.col("rank"), "score": scorer(F.col("query"), F.coalesce("text", F.lit("")))}).drop("rank", "query", "text")
    return ranked(scored, k, [F.desc("score"), F.asc("before")]).drop("before")


def context_parents(results: DataFrame, parents: DataFrame, chunks: int = CONTEXT_CHUNKS) -> DataFrame:
    """(query_id, context_parent_ids): the different parents of the first chunks in their order; a chunk without a parent stands for itself."""
    first = results.where(F.col("rank") < chunks).join(parents.select(F.col("chunk_id").cast("string"), "parent_id"), "chunk_id", "left")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("parent_id", "chunk_id").alias("p"))))
    return first.groupBy("query_id").agg(F.array_distinct(F.transform(listed, lambda x: x["p"])).alias("context_parent_ids"))


def build_context(contexts: DataFrame, texts: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """(query_id, context): the texts of a query's parents, in order, of those that have one."""
    each = contexts.select("query_id", F.posexplode("context_parent_ids").alias("pos", "chunk_id")).join(texts.select(F.col("chunk_id").cast("string"), "text"), "chunk_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), separator)
    return contexts.select("query_id").join(each.groupBy("query_id").agg(joined.alias("context")), "query_id", "left").na.fill("", ["context"])


def hits(results: DataFrame, truth: DataFrame, queries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, hit, reciprocal_rank) for every query: whether a true chunk is among the first five, and one over the first one's place among ten."""
    found = results.join(truth.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id")).distinct(), ["query_id", "chunk_id"])
    best = found.groupBy(*by, "query_id").agg(F.min("rank").alias("first"))
    base = results.select(*by).distinct().crossJoin(F.broadcast(queries.select("query_id"))) if by else queries.select("query_id")  # variants x queries
    joined = base.join(best, [*by, "query_id"], "left")
    return joined.select(*by, "query_id", F.coalesce((F.col("first") < HIT_AT).cast("double"), F.lit(0.0)).alias("hit"), F.coalesce(F.when(F.col("first") < RECIPROCAL_AT, 1.0 / (F.col("first") + 1)), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_metrics(judged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return judged.groupBy(*by).agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit_at_5"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr_at_10"), F.count(F.lit(1)).alias("num_examples"))


# The variants that an evaluation compares.
LADDER = (
    {"name": "naive_dense", "chunking": "naive_fixed"},
    {"name": "parent_child_dense", "chunking": "parent_child"},
    {"name": "parent_child_hybrid", "chunking": "parent_child", "hybrid": True},
    {"name": "parent_child_hybrid_rerank", "chunking": "parent_child", "hybrid": True, "rerank": True},
    {"name": "parent_child_hybrid_rerank_multiquery", "chunking": "parent_child", "hybrid": True, "rerank": True, "multi_query": 3},
)


def mock_rewrites(query: Column | str, n: int) -> Column:
    return F.array(*(F.concat(tx.col(query), F.lit(f" variant {i}")) for i in range(n)))


class Searches:
    """What variants of searches for the same questions have in common, each part found once: chunks with vectors, statistics of terms, rankings.

    chunks(chunk_id, ordinal, parent_id, text), or a table for each kind of chunking. embed and rewrite are told apart by identity.
    """

    def __init__(self, queries: DataFrame, chunks: DataFrame | dict[str, DataFrame]):
        self.queries, self.chunks, self._found = queries.select("query_id", "query"), chunks, {}

    def _once(self, key: tuple, make: Callable):
        if key not in self._found:
            self._found[key] = make()
        return self._found[key]

    def of_kind(self, kind: str | None) -> DataFrame:
        return self.chunks[kind] if isinstance(self.chunks, dict) else self.chunks

    def known(self, kind: str | None, embed: Callable) -> DataFrame:
        return self._once(("known", kind, embed), lambda: durable(self.of_kind(kind).withColumn("vector", embed(F.col("text"))), "known"))

    def asked(self, n: int, rewrite: Callable) -> DataFrame:
        """(of, query_id, query): each question with n rewrites under ids of their own."""

        def make():
            variants = tx.expand_queries("query", rewrite(F.col("query"), n)) if n else F.array("query")
            each = self.queries.select(F.col("query_id").alias("of"), F.posexplode(variants).alias("n", "query"))
            return durable(each.select("of", F.concat_ws("#", F.col("of").cast("string"), "n").alias("query_id"), "query"), "asked")  # rewrites may come from a model

        return self._once(("asked", n, rewrite if n else None), make)

    def dense(self, kind: str | None, embed: Callable, n: int, rewrite: Callable) -> DataFrame:
        return dense_top(self.asked(n, rewrite).withColumn("vector", embed(F.col("query"))), self.known(kind, embed), HYBRID_TOP)

    def candidates(self, kind: str | None, embed: Callable, n: int, rewrite: Callable) -> DataFrame:
        """``hybrid_candidates``; embedders share the sparse ranking."""
        asked, known = self.asked(n, rewrite), self.known(kind, embed)

        def sparse():
            return Sparse(asked, known, self._once(("statistics", kind), lambda: statistics(known)))

        model = self._once(("sparse", kind, n, rewrite if n else None), sparse)
        return self._once(("candidates", kind, embed, n, rewrite if n else None), lambda: durable(hybrid_candidates(asked.withColumn("vector", embed(F.col("query"))), known, model), "candidates"))


def run_variant(config: dict, queries: DataFrame, chunks: DataFrame | dict[str, DataFrame], embed: Callable[[Column], Column] = letter_vector, rewrite: Callable[[Column, int], Column] = mock_rewrites, scorer=overlap_score, searches: Searches | None = None) -> DataFrame:
    """ranked results of one variant for all queries(query_id, query) at once.

    chunks(chunk_id, ordinal, parent_id, text), or a table for each kind of chunking, of which config names one. Variants over the same
    queries and chunks share their common parts where they are given the same searches.
    """
    searches, kind, n = searches or Searches(queries, chunks), config.get("chunking"), config.get("multi_query") or 0
    if config.get("hybrid"):
        results = hybrid_top(searches.candidates(kind, embed, n, rewrite), pipeline_weight(config.get("dense_weight")), pipeline_weight(config.get("sparse_weight")))
    else:
        results = searches.dense(kind, embed, n, rewrite)
    results = results.join(searches.asked(n, rewrite).select("query_id", "of"), "query_id").drop("query_id").withColumnRenamed("of", "query_id")
    results = fuse(results) if n else results
    return rerank(results, queries, searches.of_kind(kind), scorer, config.get("rerank_top_k") or RERANK_TOP) if config.get("rerank") else results


def snapshots(results: DataFrame, most: int = 50) -> DataFrame:
    """(query_id, chunk_ids): the ranked chunks of the first ``most`` queries by id, for a look at single answers."""
    first = results.select("query_id").distinct().orderBy("query_id").limit(most)
    listed = F.array_sort(F.collect_list(F.struct("rank", "chunk_id")))
    return results.join(F.broadcast(first), "query_id").groupBy("query_id").agg(F.transform(listed, lambda x: x["chunk_id"]).alias("chunk_ids"))


def mock_vector(text: str, size: int = 16) -> list[float]:
    """A unit vector drawn from a generator seeded by the text: the offline stand-in for an embedding model."""
    import hashlib

    v = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest(), "big") % 2**32).standard_normal(size).astype(np.float32)
    return (v / (float(np.linalg.norm(v)) or 1.0)).tolist()


def mock_embed(text: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(mock_vector), "array<float>")(tx.col(text))


def encode_vector(v: Column | str) -> Column:
    """A vector as text with eight decimals, each rounded from the exact binary value, ties to even, as C and Python do; Java's formatter rounds the shortest decimals half up."""

    @F.arrow_udf("string")
    def encoded(vectors: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "[" + ",".join(["%.8f" % y for y in x if y is not None]) + "]" for x in vectors.to_pylist()], pa.string())

    return encoded(tx.col(v).cast("array<double>"))
