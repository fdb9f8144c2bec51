"""Finds benchmark items in training documents: rare n-gram seeds, then Smith-Waterman alignment.

The word n-grams of the items are looked up in every document, which gives places only. A rare n-gram seeds its item: one in at most
``COMMON`` times as many documents as the item's rarest n-gram that occurs at all. A common one seeds it too where the words around it
are so many of the item's that an alignment can still reach the score; so a stock phrase by itself seeds nothing, and
no leak is lost however often it was copied and however few documents hold another part of the item. Documents with a seed are read once
more: around its hits a window as wide as the item on either side is aligned with the item word by word. The score is
the alignment's share of the item's own, so it reaches 1 for a verbatim copy and falls by one and a half words' worth
for each word exchanged. A copy counts when it has a share of ``SCORE``, or is as long in itself as ``PASSAGE`` words.

The items are sent to the tasks in blocks of at most ``BLOCK`` characters, so what is broadcast stays bounded
however many items there are; each block is one pass over the documents.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.tools import arrow_map, column, durable, free_name, rename, with_row_id

GRAM, COMMON, SCORE, PASSAGE, BLOCK = 4, 100, 0.5, 50, 16 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")
_BLANK = bytes(c if c > 127 or chr(c).isalnum() or c == 95 else 32 for c in range(256))
_OTHER = re.compile(rb"[\xc2\xca-\xff]|\xc3[\x97\xb7]")  # outside ASCII and the Latin letters


def words(text: str | None) -> list[bytes]:
    """The words (\\w+) of a text in lower case, as UTF-8. Texts in Latin letters take a short cut to the same result."""
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    if _OTHER.search(data):
        return [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())]
    return data.translate(_BLANK).split()


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local alignment's score and the place in the window where it ends."""
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    slide = np.arange(len(window) + 1) * -GAP
    for w in item:
        score = np.maximum(row[:-1] + np.where(window == w, MATCH, MISMATCH), row[1:] + GAP)
        row = np.concatenate(([0], np.maximum(score, 0)))
        row = np.maximum.accumulate(row + slide) - slide  # gaps in the item
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def share(item: list[bytes], window: list[bytes], least: float = 0.0) -> tuple[float, int, int]:
    """(share of the item's own score, first and end word of the aligned stretch of the window); zeros where the share cannot reach least."""
    if not item:
        return 0.0, 0, 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
    a, b = np.array([codes[w] for w in item]), np.array([codes.get(w, -1) for w in window], np.int64)
    common = np.minimum(np.bincount(a, minlength=len(codes)), np.bincount(b[b >= 0], minlength=len(codes))).sum()
    if MATCH * common < least * MATCH * len(item):  # no alignment can match more words
        return 0.0, 0, 0
    score, end = align(a, b)
    _, back = align(a[::-1], b[:end][::-1])
    return score / (MATCH * len(item)), end - back, end


def needed(least: float, size: int) -> float:
    """The share that counts of an item of so many words."""
    return min(least, PASSAGE / size)


class Items:
    """A block of items with their n-grams (the whole item where it is shorter), as integers of its own vocabulary."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.words = [words(t) for _, t in rows]
        self.ids = [i for i, _ in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for x in self.words for w in x}))}
        self.by_size: dict[int, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, x in enumerate(self.words):
            n = min(GRAM, len(x))
            codes = [self.vocabulary[w] for w in x]
            for at in range(len(x) - n + 1 if n else 0):
                self.by_size[n][tuple(codes[at : at + n])].append((k, at))
        self.by_size = {n: dict(g) for n, g in self.by_size.items()}
        self.counts = [np.unique([self.vocabulary[w] for w in x], return_counts=True) for x in self.words]
        self.marks = {n: np.zeros(1 << 20, bool) for n in self.by_size}  # hashes that occur, for a first look
        for n, grams in self.by_size.items():
            self.marks[n][self._hash(np.array(list(grams)).T)] = True

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(44)).astype(np.int64)

    def common(self, item: int, codes: np.ndarray) -> int:
        """How many of the item's words a stretch of text holds, in any order; no alignment matches more."""
        own, many = self.counts[item]
        at = np.minimum(np.searchsorted(own, codes), len(own) - 1)
        return int(np.minimum(np.bincount(at[own[at] == codes], minlength=len(own)), many).sum())

    def hits(self, codes: np.ndarray) -> list[tuple[int, int, int, tuple]]:
        """(item, place in the item, place in the text, n-gram) of the n-grams of the items that a text has; codes: -1 for other words."""
        found = []
        for n, grams in self.by_size.items():
            size = len(codes) - n + 1
            if size <= 0:
                continue
            columns = [codes[k : k + size] for k in range(n)]
            at = np.flatnonzero(np.minimum.reduce(columns) >= 0)
            at = at[self.marks[n][self._hash([c[at] for c in columns])]]
            for p in at.tolist():
                gram = tuple(codes[p : p + n].tolist())
                found += [(item, q, p, gram) for item, q in grams.get(gram, ())]
        return found


_built: dict[str, Items] = {}


def _items(key: str, sent) -> Items:
    """The block's Items, built once in each worker; only the latest block is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(sent.value)
    return _built[key]


def _stretches(text: str | None, items: Items, least: float):
    """(item, seeds, first, end, whether its words can reach least) of the stretches of a text's words that may hold an item, one for each run of hits."""
    if not text:
        return
    tokens = words(text)
    codes = np.fromiter(map(items.vocabulary.get, tokens, repeat(-1)), np.int64, len(tokens))
    by_item = defaultdict(list)
    for item, q, p, gram in items.hits(codes):
        by_item[item].append((p - q, p, gram))
    for item, hits in by_item.items():
        size = len(items.words[item])
        hits.sort(key=lambda h: h[1])
        start = 0
        for k in range(1, len(hits) + 1):  # hits of one stretch are at most an item apart
            if k == len(hits) or hits[k][1] - hits[k - 1][1] > size:
                lo, hi = max(0, hits[start][1] - size), hits[k - 1][1] + 2 * size
                yield item, sorted({h[2] for h in hits[start:k]}), lo, hi, items.common(item, codes[lo:hi]) >= needed(least, size) * size
                start = k


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = size // BLOCK + 1
    return [benchmark.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) for k in range(n)] if n > 1 else [benchmark]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, item_id, score, first_word, end_word, item_words) of each row of docs and each item found in it with a score of at least ``least``, or PASSAGE words' worth.

    rid numbers the rows of docs, which must be a table scan or another plan with fixed partitions. Null and empty texts hold nothing and null and wordless items are in nothing;
    null ids are carried along. Repeated documents are found each by itself; items with equal texts are found
    together; two rows of benchmark that share an id and a text give one result. The best of a document's
    windows counts, and of equal ones the first. An item longer than the document can still be found by its share.
    """
    spark = docs.sparkSession
    number = free_name(docs, "rid")
    named = rename(with_row_id(docs, number), rid=number, id=id_col, text=text_col)
    bench = rename(benchmark, item=item_col, text=text_col).where("text is not null").distinct()
    out = None
    for block in _blocks(bench):
        rows = sorted(((r["item"], r["text"]) for r in block.collect()), key=lambda r: (r[0] is None, r[0], r[1]))
        sent = spark.sparkContext.broadcast(rows)
        key = uuid.uuid4().hex

        def look(batch, sent=sent, key=key):
            items = _items(key, sent)
            found = [(rid, item, [" ".join(map(str, g)) for g in grams], *rest) for rid, text in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True) for item, grams, *rest in _stretches(text, items, least)]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rid", "item", "seeds", "lo", "hi", "possible"])

        hits = durable(arrow_map(named.select("rid", "text"), "rid long, item long, seeds array<string>, lo long, hi long, possible boolean", look), "hits")
        seeds = hits.select("rid", "item", F.explode("seeds").alias("seed")).distinct().groupBy("item", "seed").count()
        rarest = seeds.groupBy("item").agg(F.min("count").alias("least"))
        rare = seeds.join(rarest, "item").where(F.col("count") <= F.col("least") * COMMON).groupBy("item").agg(F.collect_set("seed").alias("rare"))
        seeded = hits.join(F.broadcast(rare), "item").where(F.col("possible") | F.arrays_overlap("seeds", "rare"))  # no more than the block's own n-grams
        seeded = durable(seeded.groupBy("rid").agg(F.collect_list(F.struct("item", "lo", "hi")).alias("places")), "seeded")

        def judge(batch, sent=sent, key=key):
            items = _items(key, sent)
            found = []
            for rid, name, text, places in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                tokens = words(text)
                for place in places:
                    item, lo = place["item"], place["lo"]
                    size = len(items.words[item])
                    need = needed(least, size)
                    score, first, end = share(items.words[item], tokens[lo : place["hi"]], need)
                    if score >= need:
                        found.append((rid, name, items.ids[item], score, lo + first, lo + end, size))
            columns = list(zip(*found, strict=True)) if found else [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["rid", "doc_id", "item_id", "score", "first_word", "end_word", "item_words"])

        joined = named.join(seeded, "rid").select("rid", "id", "text", "places")
        part = arrow_map(joined, "rid long, doc_id long, item_id long, score double, first_word long, end_word long, item_words long", judge)
        best = F.max(F.struct("score", (-F.col("first_word")).alias("first"), "end_word", "item_words")).alias("best")
        part = part.groupBy("rid", "doc_id", "item_id").agg(best)
        part = durable(part.select("rid", "doc_id", "item_id", "best.score", (-F.col("best.first")).alias("first_word"), "best.end_word", "best.item_words"), "found")
        sent.destroy()
        out = part if out is None else out.union(part)
    # Items of one id with different texts may stand in different blocks.
    best = F.max(F.struct("score", (-F.col("first_word")).alias("first"), "end_word", "item_words")).alias("best")
    out = out.groupBy("rid", "doc_id", "item_id").agg(best)
    return out.select("rid", "doc_id", "item_id", "best.score", (-F.col("best.first")).alias("first_word"), "best.end_word", "best.item_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in which ``leaks`` finds an item of at least GRAM words; all columns stay.

    Shorter items are reported by ``leaks``, but as they are common phrases they part no document from the corpus.
    """
    rid = free_name(docs, "rid")
    found = leaks(docs, benchmark, least, id_col, item_col, text_col).where(F.col("item_words") >= GRAM).select(F.col("rid").alias(rid)).distinct()
    return with_row_id(docs, rid).join(durable(found, "leaks"), rid, "left_anti").select(*map(column, docs.columns))
