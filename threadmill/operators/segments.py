"""Sections, blocks and packed chunks of texts, as windows over lines and blocks.

A text is one row a line; running sums over its lines say in which section and block a line is. Blocks are packed
greedily without going through them one by one: prefix sums of their tokens give, for each block at which a chunk may begin,
where it ends and where the next one begins, both as range frames over the sums, and only the pointers that start at
the first block are followed. All windows of a text are over its number, so its rows are shuffled once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions import text as tx

FENCE = "```"
#: Bytes of text that a task holds as lines, and the least number of tasks.
SHARE, LEAST_SHARES = 8 << 20, 8


def shares(size: int | None) -> int:
    """Over how many tasks texts of so many bytes are dealt, so that a task's share does not grow with the table."""
    return max(LEAST_SHARES, (size or 0) // SHARE)


def _dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    return rows.repartition(parts, *keys) if parts else rows


def _lines(text: Column) -> Column:
    return F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")


def _joined(name: str) -> Column:
    """The lines of a group, in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", name))), lambda x: x[name]), "\n")


def sections(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """(rid, p, section_path, body) of texts(rid, text), rid unique: from each heading line to the next, p from 0 in order.

    A heading is number signs, white space and a title; its path are the titles of the headings above it, each of a higher level
    than all that follow it, and its own. What precedes the first heading has no path. Blank sections are left out.
    Fences make no difference: a heading in code is a heading. parts: over how many tasks texts are dealt, if not Spark's number.
    """
    level = F.length(F.regexp_extract("line", f"^(#+){tx.SPACE}", 1))
    by_line = Window.partitionBy("rid").orderBy("pos")
    lines = _dealt(texts, parts, "rid").select("rid", _lines(F.col("text"))).withColumn("level", level)
    lines = lines.withColumn("sec", F.count(F.when(F.col("level") > 0, 1)).over(by_line))
    head = F.max(F.when(F.col("level") > 0, F.struct("level", tx.strip(F.expr("substring(line, level + 1)")).alias("title"))))
    found = lines.groupBy("rid", "sec").agg(tx.strip(_joined("line")).alias("body"), head.alias("head"))
    # The stack of headings is a fold, over the few lines that are headings.
    heads = found.where("head is not null").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("sec", "head.level", "head.title"))).alias("heads"))
    none = F.from_json(F.lit('{"above": [], "paths": []}'), "above array<struct<sec:bigint,level:int,title:string>>, paths array<struct<sec:bigint,path:array<string>>>")

    def step(state, h):
        above = F.concat(F.filter(state["above"], lambda a: a["level"] < h["level"]), F.array(h))
        return tx.let(above, lambda above: F.struct(above.alias("above"), F.concat(state["paths"], F.array(F.struct(h["sec"].alias("sec"), F.transform(above, lambda a: a["title"]).alias("path")))).alias("paths")))

    paths = heads.select("rid", F.explode(F.aggregate("heads", none, step)["paths"]).alias("x")).select("rid", "x.sec", "x.path")
    kept = _dealt(_dealt(found.where("body <> ''"), parts, "rid", "sec").join(_dealt(paths, parts, "rid", "sec"), ["rid", "sec"], "left"), parts, "rid")
    number = F.row_number().over(Window.partitionBy("rid").orderBy("sec")) - 1
    return kept.select("rid", number.alias("p"), F.coalesce("path", F.array().cast("array<string>")).alias("section_path"), "body")


def blocks(units: DataFrame, parts: int | None = None) -> DataFrame:
    """(rid, p, block, text) of units(rid, p, body): paragraphs, and fenced code as one block each, fences included; an open fence ends with the text."""
    by_line = Window.partitionBy("rid", "p").orderBy("pos")
    lines = _dealt(units.select("rid", "p", "body"), parts, "rid", "p").select("rid", "p", _lines(F.col("body"))).withColumn("bare", tx.strip("line"))
    lines = lines.withColumn("fence", F.startswith("bare", F.lit(FENCE)))
    before = F.count(F.when(F.col("fence"), 1)).over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("fenced", before % 2 == 1)
    closed = F.coalesce(F.lag(F.col("fence") & F.col("fenced")).over(by_line), F.lit(False))
    opens = closed | ~F.col("fenced") & (F.col("fence") | (F.col("bare") == ""))
    lines = lines.withColumn("block", F.count(F.when(opens, 1)).over(by_line))
    kept = lines.where(F.col("fenced") | (F.col("bare") != "")).groupBy("rid", "p", "block").agg(F.regexp_replace(_joined("line"), r"^\n+|\n+$", "").alias("text"))
    return kept.where(tx.strip("text") != "")


def pieces(segment: str, most: int, count: Callable[[str], int]) -> Iterator[str]:
    """A segment that is too long, in windows of words: each ends with the word with which it has ``most`` tokens, found by bisection."""
    words, start = segment.split(), 0
    while start < len(words):
        end = start + 1 + bisect_left(range(start + 1, len(words)), most, key=lambda j: count(" ".join(words[start:j])))
        yield " ".join(words[start:end])
        start = end


def sized(most: int, count: Callable[[str], int] | None) -> Callable[[Column], Column]:
    """From a block to an array of struct(text, n): the block with its tokens, or its pieces. count runs in the workers; None: words, in columns."""
    if count is not None:
        kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))

        @F.arrow_udf(kind)
        def cut(texts: pa.Array) -> pa.Array:
            found = [[(t, n)] if (n := count(t)) <= most else [(x, count(x)) for x in pieces(t, most, count)] for t in texts.to_pylist()]
            return pa.array([[{"text": t, "n": n} for t, n in x] for x in found], pa.list_(pa.struct([("text", pa.string()), ("n", pa.int64())])))

        return cut

    def cut(text: Column) -> Column:
        def windows(words):
            starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / most).cast("int"))
            part = lambda k: F.slice(words, k * most + 1, most)
            return F.when(F.size(words) <= most, F.array(F.struct(text.alias("text"), F.size(words).cast("long").alias("n")))).otherwise(
                F.transform(starts, lambda k: F.struct(F.array_join(part(k), " ").alias("text"), F.size(part(k)).cast("long").alias("n")))
            )

        return tx.let(tx.words(text), windows)

    return cut


def packed(found: DataFrame, most: int, overlap: int, joiner: str = "\n\n", count: Callable[[str], int] | None = None) -> DataFrame:
    """(rid, p, c, text): blocks(rid, p, block, text) packed into chunks of at most ``most`` tokens, c from 0 in order.

    A chunk takes blocks while they fit. The next one opens with the last blocks of the one before: always the very last, then more
    while they stay within ``overlap`` in all; and without them when the next block would not fit behind them. Blocks of
    more than ``most`` tokens are cut up first.
    """
    unit = Window.partitionBy("rid", "p")
    first = F.row_number().over(unit.orderBy("block")) == 1
    # Each unit has a row before its first segment, so that a row stands for the border behind it.
    border = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n")))
    parts = sized(most, count)(F.col("text"))
    rows = found.withColumn("parts", parts).withColumn("first", first).select("rid", "p", "block", F.posexplode(F.when(F.col("first"), F.concat(border, "parts")).otherwise(F.col("parts"))).alias("k", "s"))
    in_order = unit.orderBy("block", "k")
    rows = rows.select("rid", "p", "s.text", (F.row_number().over(in_order) - 1).alias("i"), F.sum("s.n").over(in_order).alias("upto"))
    here, by_place, by_sum = F.struct("i", "upto"), unit.orderBy("i"), unit.orderBy("upto")
    tail = F.least(F.lag(here).over(by_place), F.min(here).over(by_sum.rangeBetween(-max(overlap, 0), 0)))
    rows = rows.withColumns({"tail": tail, "ahead": F.lead("upto").over(by_place)})
    behind = F.struct("i", "tail", "ahead")  # a piece by a counter of its own may be longer than most, and is a chunk nonetheless
    rows = rows.withColumn("end", F.greatest(F.lead(behind).over(by_place), F.max(behind).over(by_sum.rangeBetween(0, most))))
    whole = F.lit(overlap <= 0) | (F.col("end.tail.i") <= F.col("i")) | (F.col("end.ahead") - F.col("end.tail.upto") > most)
    following = F.when(F.col("end.ahead").isNotNull(), F.when(whole, F.col("end.i")).otherwise(F.col("end.tail.i")))
    cells = F.array_sort(F.collect_list(F.struct("i", F.col("end.i").alias("end"), following.alias("next"), "text")))
    units = rows.groupBy("rid", "p").agg(cells.alias("cells"))
    follow = lambda starts, cell: F.when((F.element_at(starts, -1) == cell["i"]) & cell["next"].isNotNull(), F.concat(starts, F.array(cell["next"]))).otherwise(starts)
    units = units.withColumn("starts", F.aggregate("cells", F.array(F.lit(0)), follow)).withColumn("texts", F.transform("cells", lambda x: x["text"]))
    text = F.array_join(F.expr("slice(texts, b + 2, cells[b].end - b)"), joiner)
    return units.select("rid", "p", "cells", "texts", F.posexplode("starts").alias("c", "b")).select("rid", "p", "c", text.alias("text"))
