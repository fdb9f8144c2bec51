"""Deletes later copies of repeated line runs, found by distributed prefix doubling.

Every line gets a 128-bit id and starts one suffix of the corpus's line sequence; a suffix ends with its
document. Round k knows the suffixes whose first 2^k lines occur more than once, each with the name of those
lines: all suffixes with one name are one interval of the suffix array whose longest common prefix is at least
2^k. Round k + 1 joins a suffix with the one 2^k lines on; the pair of names is the name of 2^(k+1) lines, and
names that occur once leave, so the table shrinks fast. The rounds end when no suffix has a longer repeat that
matters.

A run counts when it has at least ``min_words`` words. From each line on, and up to each line, the shortest run
that long is looked up as two names of one power of two that cover it; the suffixes that share them form the
interval with a common prefix of at least that run. In each interval the first run stays and the lines of all
others go. Every line of a maximal repeated run lies in such a shortest run within it, so together they are
exactly the maximal runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.text import let
from threadmill.llm.tools import arrow_map, column, durable, free_name, rename, text_bytes, with_row_id

_HALF = (1 << 63) - 1


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(rid, id, pos, a, b, ahead, behind) per line of docs; ahead and behind: lines of the shortest run from here on or up to here, 0 if there is none."""

    def work(batch):
        rids, ids, at, a, b, ahead, behind = ([] for _ in range(7))
        for rid, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
            lines = text.split(b"\n")
            words = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines])))
            n, here = len(lines), np.arange(len(lines))
            to = np.searchsorted(words, words[:-1] + min_words, "left")  # first boundary with enough words
            since = np.searchsorted(words, words[1:] - min_words, "right") - 1  # last boundary with enough words
            rids.append(np.full(n, rid))
            ids += [name] * n
            at.append(here)
            digests = [xxhash.xxh3_128_intdigest(x) for x in lines]
            a.append(np.array([d >> 64 for d in digests], np.uint64).view(np.int64))
            b.append(np.array([d & (1 << 64) - 1 for d in digests], np.uint64).view(np.int64))
            ahead.append(np.where(to <= n, to - here, 0))
            behind.append(np.where(since >= 0, here + 1 - since, 0))
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(rids), pa.int64()), pa.array(ids, pa.int64()), *(pa.array(join(x), pa.int64()) for x in (at, a, b, ahead, behind))], ["rid", "id", "pos", "a", "b", "ahead", "behind"])

    # A short batch, because lines are many times more than rows.
    return arrow_map(docs, "rid long, id long, pos long, a long, b long, ahead long, behind long", work)


def _repeated(names: DataFrame) -> DataFrame:
    """The rows of names whose (a, b) occurs more than once."""
    # Written out, so that the join may broadcast the names where they are few, and else split a frequent one.
    twice = durable(names.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"), "names")
    return names.join(twice, ["a", "b"], "left_semi")


def doubling(lines: DataFrame, longest: int) -> list[DataFrame]:
    """For k = 0, 1, ...: (rid, pos, a, b) of the suffixes whose first 2^k lines are repeated, up to 2^k <= longest or the last that has any."""
    levels = [durable(_repeated(lines.select("rid", "pos", "a", "b")), "suffixes")]
    while 2 << (len(levels) - 1) <= longest:
        k = len(levels) - 1
        after = levels[k].select("rid", (F.col("pos") - (1 << k)).alias("pos"), F.col("a").alias("c"), F.col("b").alias("d"))
        pairs = levels[k].join(after, ["rid", "pos"]).select("rid", "pos", F.xxhash64("a", "b", "c", "d").alias("e"), F.xxhash64(F.lit(k), "d", "c", "b", "a").alias("b")).withColumnRenamed("e", "a")
        levels.append(durable(_repeated(pairs), "suffixes"))
        if levels[-1].isEmpty():
            return levels[:-1]
    return levels


def later_copies(docs: DataFrame, min_words: int) -> DataFrame:
    """(rid, runs): the maximal runs of lines to delete, as sorted disjoint (start, end) pairs, for the rows of docs(rid, id, text) that have any."""
    lines = durable(_lines(docs, min_words), "lines")
    runs = lines.select("rid", "id", F.explode(F.expr("array(named_struct('pos', pos, 'n', ahead), named_struct('pos', pos + 1 - behind, 'n', behind))")).alias("r")).select("rid", "id", "r.*").where("n > 0").distinct()
    longest = runs.agg(F.max("n")).first()[0] or 0
    found = None
    for k, level in enumerate(doubling(lines, longest)):
        of = runs.where(F.col("n").between(1 << k, (2 << k) - 1))
        tail = level.select("rid", F.col("pos").alias("tail"), F.col("a").alias("c"), F.col("b").alias("d"))
        both = of.join(level, ["rid", "pos"]).withColumn("tail", F.col("pos") + F.col("n") - (1 << k)).join(tail, ["rid", "tail"])
        both = both.select("rid", "id", "pos", "n", F.xxhash64("a", "b", "c", "d").alias("a"), F.xxhash64("n", "d", "c", "b", "a").alias("b"))
        found = both if found is None else found.union(both)
    found = durable(found, "runs")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "rid", "pos")
    first = durable(found.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "first")
    later = found.withColumn("place", place).join(first, ["a", "b"]).where("place > first").select("rid", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end")).distinct()
    # A document's runs, merged where they touch: an island begins beyond the end of all runs before.
    before = Window.partitionBy("rid").orderBy("start", "end")
    upto = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", (F.col("start") > F.coalesce(upto, F.lit(-1))).cast("long")).withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _cut(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with the text cut, and the name of one column more: a struct of lines, removed, runs and before."""
    rid, name, runs = free_name(docs, "rid"), free_name(docs, "cut"), free_name(docs, "runs")
    numbered = with_row_id(docs, rid)
    found = later_copies(rename(numbered, rid=rid, id=id_col, text=text_col), min_words).select(F.col("rid").alias(rid), F.col("runs").alias(runs))
    text, gone = column(text_col), F.coalesce(column(runs), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)"))
    removed = F.aggregate(gone, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    before = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    facts = F.struct(F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).alias("lines"), removed.alias("removed"), gone.alias("runs"), before.alias("before"))
    # What stays lies between the end of a run and the start of the next.
    between = lambda lines: F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform(column(runs), lambda r: r["end"])), F.concat(F.transform(column(runs), lambda r: r["start"]), F.array(F.size(lines).cast("long"))),
        lambda a, b: F.slice(lines, a.cast("int") + 1, (b - a).cast("int")),
    )
    kept = F.when(column(runs).isNull(), text).otherwise(let(F.split(text, "\n", -1), lambda lines: F.array_join(F.flatten(between(lines)), "\n")))
    columns = [kept.alias(text_col) if c == text_col else column(c) for c in docs.columns]
    return numbered.join(found, rid, "left").select(*columns, F.when(text.isNull(), facts.withField("lines", F.lit(0))).otherwise(facts).alias(name)), name


def line_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies of repeated runs of at least min_words words deleted from the text, and four columns more.

    Columns ``__lines``, ``__removed`` (counts of lines), ``__runs`` (array of (start, end) lines, end exclusive) and
    ``__before`` (whether the text had any word) follow the columns of docs, and replace those of these names. "First" is by
    id, nulls last, then by row, then by line. A run that overlaps its own earlier copy is a copy, so periodic text keeps
    one period. Lines end at LF; blank lines are lines without words. Null text stays null and has no lines to delete;
    repeated rows are copies of the first of them. A text whose every line goes becomes empty. An empty table gives no rows.
    docs must be a table scan or another plan with fixed partitions.
    """
    out, name = _cut(docs, min_words, id_col, text_col)
    added = ["lines", "removed", "runs", "before"]
    return out.select(*(column(c) for c in docs.columns if c not in [f"__{a}" for a in added]), *(column(name)[a].alias(f"__{a}") for a in added))


def dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line_dedup with the columns of docs alone, all of them, without the documents of which no word is left. Texts that had none stay."""
    out, name = _cut(docs, min_words, id_col, text_col)
    gone = column(name)["before"] & ~column(text_col).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~gone).select(*map(column, docs.columns))
