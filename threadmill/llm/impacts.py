"""Exact ranked search over impact-ordered postings, score at a time.

``index`` writes an inverted index once. A row of it is a shard: some documents, and the postings of each of their
terms, grouped by exact impact (an integer of the term's frequency and the document's size) from the highest impact
down. Impacts take the mean size from all documents, so shards are alike.

``search`` sends queries to the tasks in blocks of at most ``QUERY_TERMS`` terms. For a query, a shard's groups
are taken in descending order of what they add, weight times impact, and added to the documents' sums. After
each round the next group of each term says what a document can still gain. When a document that has not
been seen cannot reach the k-th best sum any more, reading stops; documents whose sum and gain still reach it are the
candidates, and their scores are completed from postings in the order of documents. A shard whose best groups together
stay below what the query has reached elsewhere is not opened at all: every eighth shard is searched first for that.
Each task passes on k rows a query, and a window merges them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.llm.tools import durable, ranges, rename, slices, text_bytes

#: Postings and documents of a shard, shards of a file, query terms that are sent at once, and postings of a query's first round.
POSTINGS, DOCS, FILE, QUERY_TERMS, ROUND = 1 << 16, 1 << 14, 64, 2_000_000, 2048
#: Bytes of texts that are counted at once.
TEXTS = 1 << 21
#: One shard in so many is searched first.
FIRST = 8
#: Postings are bytes, so that they pass through Spark as they are: 32-bit impacts of the groups, their 16-bit sizes and the 16-bit numbers of their documents, lower bytes first.
INDEX = "turn int, total long, ids array<bigint>, terms array<bigint>, dfs array<int>, groups array<int>, impacts binary, sizes binary, docs binary"
POSTING = {"impacts": "<i4", "sizes": "<i2", "docs": "<i2"}
#: Terms are the maximal matches of this, with A to Z in lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def words(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_FOLD).split()


def _named(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t) - (1 << 63) for t in terms), np.int64, len(terms))


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often, ...) of all terms of some texts, in the order of texts, and each text's size. Terms are their 64-bit hashes."""
    found = [words(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    encoded = pa.array([w for ws in found for w in ws], pa.binary()).dictionary_encode()
    names = _named(encoded.dictionary.to_pylist())
    cell = np.repeat(np.arange(len(found)), sizes) * max(len(names), 1) + encoded.indices.to_numpy(zero_copy_only=False)
    cell, tf = np.unique(cell, return_counts=True)
    return cell // max(len(names), 1), names[cell % max(len(names), 1)], tf, sizes


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), kind))


def _shard(turn: int, total: int, words_: int, names: list[int | None], doc: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """A row of INDEX of documents 0, 1, ... with their postings."""
    norm = np.array([12 * (75 + 25 * int(n) * total // words_) for n in sizes], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + norm[doc])
    terms, at, dfs = np.unique(term, return_inverse=True, return_counts=True)
    shown = np.array([n is not None for n in names])[doc]  # rows without an id count, but are not found
    doc, at, impact = doc[shown], at[shown], impact[shown]
    order = np.lexsort((doc, -impact, at))
    doc, at, impact = doc[order], at[order], impact[order]
    first = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(impact) != 0))[: len(at)])
    columns = [np.array([n or 0 for n in names]), terms, dfs, np.bincount(at[first], minlength=len(terms))]
    lists = [_lists([c], kind) for c, kind in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)]
    postings = zip((impact[first], np.diff(np.append(first, len(at))), doc), POSTING.values(), strict=True)
    lists += [pa.array([c.astype(kind).tobytes()], pa.binary()) for c, kind in postings]
    return pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([total], pa.int64()), *lists], [c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs by shards (``INDEX``), written out, for any number of searches.

    Null texts have no terms. Rows with a null id are part of the statistics and are never found; repeated rows have each their place.
    """
    rows = rename(docs, id=id_col, text=text_col)

    def count(batches):
        for batch in batches:
            sizes = [len(words(t)) for part in slices(batch, TEXTS) for t in text_bytes(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["docs", "words"])

    found = rows.select("text").mapInArrow(count, "docs long, words long").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    total, words_ = found["docs"] or 0, found["words"] or 1

    def work(batches):
        held, size, turn = [], 0, 0

        def shard():
            starts = np.cumsum([0] + [len(n) for n, *_ in held])
            doc = np.concatenate([d + s for (_, d, *_), s in zip(held, starts, strict=False)])
            parts = [np.concatenate([h[k] for h in held]) for k in (2, 3, 4)]
            return _shard(turn % FIRST, total, words_, [n for h in held for n in h[0]], doc, *parts)

        for batch in batches:
            for part in slices(batch, TEXTS):
                names, (doc, term, tf, sizes) = part.column(0).to_pylist(), counted(text_bytes(part.column(1)))
                edges = np.searchsorted(doc, np.arange(len(names) + 1))
                at = 0
                while at < len(names):  # as many documents as the shard still takes, one at least if it is empty
                    to = int(np.searchsorted(edges, edges[at] + max(POSTINGS - size, 0), "right")) - 1
                    to = min(len(names), at + DOCS - sum(len(h[0]) for h in held), max(to, at + (not held)))
                    if to > at:
                        own = slice(edges[at], edges[to])
                        held.append((names[at:to], doc[own] - at, term[own], tf[own], sizes[at:to]))
                        size += edges[to] - edges[at]
                    if to < len(names):
                        yield shard()
                        held, size, turn = [], 0, turn + 1
                    at = to
        if held:
            yield shard()

    return durable(rows.mapInArrow(work, INDEX), "impacts", maxRecordsPerFile=FILE)


class Shard:
    """A shard's postings of the terms of a vocabulary."""

    def __init__(self, row: dict[str, np.ndarray], vocabulary: np.ndarray):
        self.ids, self.docs, self.impacts, self.sizes = row["ids"], row["docs"], row["impacts"].astype(np.int64), row["sizes"].astype(np.int64)
        terms = row["terms"]
        at = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
        has = terms[at] == vocabulary if len(terms) else np.zeros(len(vocabulary), bool)
        ends = np.append(0, np.cumsum(row["groups"], dtype=np.int64))
        self.first = np.where(has, ends[at], 0)  # group of each term
        self.groups = np.where(has, ends[at + 1] - ends[at], 0) if len(terms) else np.zeros(len(vocabulary), np.int64)
        self.starts = np.append(0, np.cumsum(self.sizes))  # of the groups' postings
        self.most = np.zeros(len(vocabulary), np.int64)
        self.most[self.groups > 0] = self.impacts[self.first[self.groups > 0]]
        self._keys = None

    def _lookup(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Impacts of documents doc for terms term of the vocabulary, 0 where a document lacks the term. Postings are sorted by document when first asked for."""
        if self._keys is None:
            known = np.flatnonzero(self.groups)
            group = ranges(self.first[known], self.groups[known])
            size = self.sizes[group]
            key = np.repeat(np.repeat(known, self.groups[known]), size) * len(self.ids) + self.docs[ranges(self.starts[group], size)]
            order = np.argsort(key)
            self._keys, self._values = np.append(key[order], np.iinfo(np.int64).max), np.append(np.repeat(self.impacts[group], size)[order], 0)
        key = term * len(self.ids) + doc
        at = np.searchsorted(self._keys, key)
        return np.where(self._keys[at] == key, self._values[at], 0)

    def top(self, term: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of those that can be among the k best of a query, if these need a score of least; all with a score above 0."""
        term, weight = term[self.groups[term] > 0], weight[self.groups[term] > 0]
        group, owner = ranges(self.first[term], self.groups[term]), np.repeat(np.arange(len(term)), self.groups[term])
        adds = self.impacts[group] * weight[owner]
        order = np.argsort(-adds, kind="stable")
        group, owner, adds = group[order], owner[order], adds[order]
        upto = np.cumsum(self.sizes[group])
        sums = np.zeros(len(self.ids), np.int64)
        at, goal = 0, ROUND
        while at < len(group):
            to = min(len(group), int(np.searchsorted(upto, goal)) + 1)
            size = self.sizes[group[at:to]]
            np.add.at(sums, self.docs[ranges(self.starts[group[at:to]], size)], np.repeat(adds[at:to], size))
            at, goal = to, goal * 2
            if at == len(group):
                break
            left = np.zeros(len(term), np.int64)
            np.maximum.at(left, owner[at:], adds[at:])
            gain = int(left.sum())
            bound = max(least, int(np.partition(sums, -k)[-k]) if len(sums) > k else 0, 1)
            if gain < bound:
                doc = np.flatnonzero((sums > 0) & (sums + gain >= bound))
                exact = (self._lookup(np.repeat(term, len(doc)), np.tile(doc, len(term))).reshape(len(term), -1) * weight[:, None]).sum(0)
                return doc, exact
        doc = np.flatnonzero(sums >= max(least, 1))
        return doc, sums[doc]


def _rows(batch: pa.RecordBatch):
    """The rows of a batch of INDEX, from ids on, as arrays."""
    columns = {n: (batch.column(n).values.to_numpy(), batch.column(n).offsets.to_numpy()) for n in ("ids", "terms", "groups")}
    for k in range(batch.num_rows):
        row = {n: values[ends[k] : ends[k + 1]] for n, (values, ends) in columns.items()}
        yield row | {n: np.frombuffer(batch.column(n)[k].as_buffer(), kind) for n, kind in POSTING.items()}


def _frequencies(shards: DataFrame, sent) -> DataFrame:
    """(term, df) of the terms of the vocabulary that was sent."""

    def work(batches):
        vocabulary = sent.value
        n = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            terms, dfs = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            at = np.searchsorted(vocabulary, terms)
            known = np.append(vocabulary, 0)[at] == terms
            known &= at < len(vocabulary)
            np.add.at(n, at[known], dfs[known])
        some = np.flatnonzero(n[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary[some]), pa.array(n[some])], ["term", "n"])

    return shards.select("terms", "dfs").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _searched(shards: DataFrame, sent, least, k: int) -> DataFrame:
    """(query, doc_id, score): the k best of each task for each query that was sent, by its number."""

    def work(batches):
        vocabulary, ends, term, weight = sent.value
        query = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        reach = least.value.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row, vocabulary)
                bound = np.zeros(len(reach), np.int64)
                np.add.at(bound, query, weight * shard.most[term])
                for q in np.flatnonzero((bound >= reach) & (bound > 0)).tolist():
                    own = slice(ends[q], ends[q + 1])
                    doc, score = shard.top(term[own], weight[own], k, int(reach[q]))
                    ids, scores = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    ids, scores = np.concatenate((ids, shard.ids[doc])), np.concatenate((scores, score))
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = ids[order], scores[order]
                    if len(order) == k:
                        reach[q] = max(reach[q], int(scores[order[-1]]))
        if best:
            query = np.repeat(np.fromiter(best, np.int64, len(best)), [len(ids) for ids, _ in best.values()])
            yield pa.RecordBatch.from_arrays([pa.array(query), *(pa.array(np.concatenate([b[k] for b in best.values()])) for k in (0, 1))], ["query", "doc_id", "score"])

    return shards.mapInArrow(work, "query long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def search(queries: DataFrame, shards: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank from 1, doc_id, score): the k best documents of shards (of ``index``) for each row of queries.

    A score is the sum, over the query's terms with their repeats, of the term's weight and the posting's impact, in
    64-bit integers; only scores above 0 are found, equal ones go by document id. Queries without terms or without an
    id have no result; of rows with one id and different texts the shortest text asks, of these the first in order.
    An empty table or index gives an empty result.
    """
    spark = shards.sparkSession
    one = rename(queries, id=id_col, text=text_col).where("id is not null and text is not null").groupBy("id").agg(F.min(F.struct(F.length("text"), "text")).alias("q"))
    lower = "".join(map(chr, range(97, 123)))
    asked = F.explode(F.regexp_extract_all(F.translate("q.text", lower.upper(), lower), F.lit(TERM), F.lit(0)))
    asked = durable(one.select("id", asked.alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n")), "asked")
    first = shards.select("total").first()
    parts = int(asked.count() // QUERY_TERMS + 1)
    out = None
    for part in range(parts) if first else ():
        rows = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)).toArrow()  # QUERY_TERMS rows, give or take the chance of the hash
        if not rows.num_rows:
            continue
        words_, term = np.unique(_named([w.encode() for w in rows["word"].to_pylist()]), return_inverse=True)
        vocabulary = spark.sparkContext.broadcast(words_)
        df = _frequencies(shards, vocabulary).toArrow()
        counts = dict(zip(df["term"].to_pylist(), df["df"].to_pylist(), strict=True))
        weights = np.array([math.floor(1000 * math.log((2 * first["total"] + 2) / (2 * counts.get(t, 0) + 1))) for t in words_.tolist()], np.int64)
        ids, query = np.unique(rows["id"].to_numpy(), return_inverse=True)
        order = np.argsort(query, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(query, minlength=len(ids))))
        sent = spark.sparkContext.broadcast((words_, ends, term[order], weights[term[order]] * rows["n"].to_numpy()[order]))
        nothing = spark.sparkContext.broadcast(np.zeros(len(ids), np.int64))
        early = durable(_best(_searched(shards.where("turn = 0"), sent, nothing, k), k), "first-found")
        least = np.zeros(len(ids), np.int64)
        reached = early.where(F.col("rank") == k).select("query", "score").toArrow()  # a row a query at most
        least[reached["query"].to_numpy()] = reached["score"].to_numpy()
        known = spark.sparkContext.broadcast(least)
        late = _searched(shards.where("turn <> 0"), sent, known, k)
        names = spark.createDataFrame(pa.table({"query": np.arange(len(ids)), "id": ids}))
        found = _best(early.select("query", "doc_id", "score").union(late), k).join(names, "query")
        found = durable(found.select(F.col("id").alias(id_col), "rank", "doc_id", "score"), "found")
        for held in (vocabulary, sent, nothing, known):
            held.destroy()
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], f"{id_col} long, rank int, doc_id long, score long") if out is None else out
