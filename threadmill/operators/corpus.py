"""Corpus records from issue threads and documents, and their chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions import text as tx
from threadmill.operators import greedy, segments
from threadmill.sources.scratch import durable

MIN_COMMENT_CHARS = 20
#: Tokens of a child chunk and of the overlap of neighbours, words of a fixed-size chunk.
CHILD_TOKENS, OVERLAP_TOKENS, NAIVE_TOKENS = 500, 64, 400
#: Texts that a task holds as strings of Python at once, whatever the size of a batch.
AT_ONCE = 256
CHUNK_SCHEMA = "source_id string, level string, chunk_id string, parent_id string, parent_index int, child_index int, section_path array<string>, text string"


def issue_records(issues: DataFrame, holdout: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One record for the body of each held-out issue and one for each substantial comment of a maintainer.

    issues(github_id, title, body, label, html_url, created_at, closed_at, comments, ordinal); holdout(github_id). The
    first row of a repeated id counts. Comments shorter than 20 characters, or without an id, are left out.
    """
    first = issues.where("github_id is not null").groupBy("github_id").agg(F.min_by(F.struct(*issues.columns), ordinal).alias("row")).select("row.*")
    held = first.join(holdout.select("github_id").where("github_id is not null").distinct(), "github_id", "left_semi")
    title, body = F.coalesce(tx.strip("title"), F.lit("")), F.coalesce(tx.strip("body"), F.lit(""))
    whole = F.when(title != "", tx.strip(F.concat(title, F.lit("\n\n"), body))).otherwise(body)
    own = F.struct(F.lit(0).cast("long").alias("comment_id"), whole.alias("text"), F.col("html_url").alias("url"), F.col("created_at").alias("at"))
    fit = F.filter("comments", lambda c: tx.is_maintainer(c["author_association"]) & (F.length(tx.strip(c["body"])) >= MIN_COMMENT_CHARS) & c["github_id"].isNotNull())
    rest = F.transform(fit, lambda c: F.struct(c["github_id"].cast("long").alias("comment_id"), tx.strip(c["body"]).alias("text"), F.coalesce(c["html_url"], F.col("html_url")).alias("url"), c["created_at"].alias("at")))
    out = held.select("*", F.explode(F.concat(F.array(own), F.coalesce(rest, F.array().cast("array<struct<comment_id:bigint,text:string,url:string,at:string>>")))).alias("r"))
    issue = F.col("github_id").cast("string")
    source = F.when(F.col("r.comment_id") == 0, F.concat(F.lit("issue:"), issue)).otherwise(F.concat(F.lit("issue:"), issue, F.lit(":comment:"), F.col("r.comment_id").cast("string")))
    return out.select(
        F.lit("issue").alias("source_type"), source.alias("source_id"), F.col("r.text").alias("text"), F.nullif(title, F.lit("")).alias("title"), F.col("r.url").alias("url"),
        F.when(F.col("label").isNotNull(), F.array("label")).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.col("github_id").alias("github_issue_id"), F.col("r.comment_id").alias("github_comment_id"), F.col("r.at").alias("created_at"), "closed_at",
    )


def comment_objects(rows: DataFrame, key: str, record: str) -> DataFrame:
    """(key, path, place, body, author_association) of all objects in a JSON column that have both as strings, at any depth.

    The path has keys by dots and [] for the items of lists; place, the numbers of the items and (by name) of the keys on the way,
    puts a record's objects in order. The records are variants, and a round opens all objects and lists of one depth
    at once, with what they hold as the rows of the next, so there are as many rounds as the deepest record has levels. Null
    records, and texts that are no JSON or repeat a key, hold nothing.
    """
    spark = rows.sparkSession
    shape = F.schema_of_variant("v")
    start = rows.select(key, F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), F.try_parse_json(record).alias("v"))
    level, found = durable(start.where(shape.startswith("OBJECT") | shape.startswith("ARRAY")), "level"), None
    while not level.isEmpty():
        body, by = F.try_variant_get("v", "$.body", "variant"), F.try_variant_get("v", "$.author_association", "variant")
        fit = level.where(shape.startswith("OBJECT") & (F.schema_of_variant(body) == "STRING") & (F.schema_of_variant(by) == "STRING"))
        here = fit.select(key, "path", "place", body.cast("string").alias("body"), by.cast("string").alias("author_association"))
        found = here if found is None else found.unionByName(here)
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(level[key], level["path"], level["place"], F.col("pos"), F.col("key").alias("name"), F.col("value").alias("v"))
        path = F.when(F.col("name").isNull(), F.concat("path", F.lit("[]"))).when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws(".", "path", "name"))
        inner = inner.where(shape.startswith("OBJECT") | shape.startswith("ARRAY"))
        level = durable(inner.select(key, path.alias("path"), F.concat("place", F.array("pos")).alias("place"), "v"), "level")
    return spark.createDataFrame([], f"{key} {rows.schema[key].dataType.simpleString()}, path string, place array<int>, body string, author_association string") if found is None else found


def chunk_sets(records: DataFrame, most: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS, words: int = NAIVE_TOKENS, count: Callable[[str], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(parents with children, fixed windows) of the same records."""
    return parent_child_chunks(records, most, overlap, count), naive_chunks(records, words)


def naive_chunks(records: DataFrame, words: int = NAIVE_TOKENS, source: str = "source_id") -> DataFrame:
    """(source_id, chunk_no, text) of windows of so many words; texts without words give none."""

    def work(batches):
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            rows, numbers, texts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                split = (text or "").split()  # white space as in tx.words
                for k, at in enumerate(range(0, len(split), words)):
                    rows.append(i)
                    numbers.append(k)
                    texts.append(" ".join(split[at : at + words]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["source_id", "chunk_no", "text"])

    kept = records.select(F.col(source).alias("source_id"), "text")
    return kept.mapInArrow(work, f"source_id {kept.schema['source_id'].dataType.simpleString()}, chunk_no long, text string")


def parent_child_chunks(records: DataFrame, most: int = CHILD_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] | None = None) -> DataFrame:
    """CHUNK_SCHEMA rows of records(source_type, source_id, text, github_issue_id, github_comment_id): parents, and their children packed from their blocks.

    The parents of a document are its sections, an issue record is one parent. count says how many tokens a text has, if
    not its words count; it runs in the workers and may be a model's tokenizer. Null texts are empty. An issue record
    without its ids is an error.
    """
    issue, comment = F.col("github_issue_id").cast("string"), F.col("github_comment_id").cast("string")
    of_issue = F.when(issue.isNotNull() & comment.isNotNull(), F.concat(F.lit("issue:"), issue, F.lit(":comment:"), comment)).otherwise(F.raise_error(F.concat(F.lit("issue record without ids: "), F.col("source_id").cast("string"))))
    docs = F.col("source_type") == "docs"
    named = records.select(
        F.monotonically_increasing_id().alias("rid"), docs.alias("docs"), F.col("source_id").cast("string").alias("source_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.when(docs, F.concat(F.lit("doc:"), F.col("source_id").cast("string"))).otherwise(of_issue).alias("name"),
    )
    named = durable(named, "records")  # numbers that stay, whatever task is run again
    whole = named.where("not docs").select("rid", F.lit(0).alias("p"), F.array().cast("array<string>").alias("section_path"), F.col("text").alias("body"))
    parts = segments.shares(named.agg(F.sum(F.octet_length("text"))).first()[0])
    units = segments.sections(named.where("docs").select("rid", "text"), parts).unionByName(whole)
    units = durable(named.drop("text").repartition(parts, "rid").join(units.repartition(parts, "rid"), "rid").withColumn("parent", F.concat("name", F.lit(":parent:"), F.col("p").cast("string"))), "parents")
    children = segments.packed(segments.blocks(units, parts), most, overlap, count=count)
    parents = units.select("source_id", F.lit("parent").alias("level"), F.col("parent").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.col("p").alias("parent_index"), F.lit(None).cast("int").alias("child_index"), "section_path", F.col("body").alias("text"))
    stem = F.concat(F.when(F.col("docs"), F.col("parent")).otherwise(F.col("name")), F.lit(":child:"), F.col("c").cast("string"))
    below = children.join(units.drop("body").repartition(parts, "rid", "p"), ["rid", "p"]).select("source_id", F.lit("child").alias("level"), stem.alias("chunk_id"), F.col("parent").alias("parent_id"), F.col("p").alias("parent_index"), F.col("c").alias("child_index"), "section_path", "text")
    return parents.unionByName(below)


def level_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("level") == "parent").alias("parents"), F.count_if(F.col("level") == "child").alias("children"))


def orphans(chunks: DataFrame) -> DataFrame:
    """Children whose parent is not there as a parent."""
    parents = chunks.where("level = 'parent'").select(F.col("chunk_id").alias("parent_id"))
    return chunks.where("level = 'child' and parent_id is not null").join(parents, "parent_id", "left_anti")


# reStructuredText underline characters, and directives whose body is code or is left out.
ADORNMENTS = set("=-~^\"#*+`':.")
CODE_DIRECTIVES = {"code-block", "code", "sourcecode", "parsed-literal"}
DROPPED_DIRECTIVES = {"toctree", "image", "figure", "raw", "only", "include", "literalinclude", "contents", "highlight", "tabs", "tab-set", "list-table", "csv-table", "graphviz", "mermaid", "index"}

_INLINE = [(re.compile(p), r.replace("$", "\\")) for p, r in tx.INLINE]


def _plain(line: str) -> str:
    for pattern, stays in _INLINE:
        line = pattern.sub(stays, line)
    return line.rstrip()


class _Lines:
    """The lines of a document with what each says by itself: its depth (blank lines have none, so they end nothing), and its kind."""

    def __init__(self, text: str):
        self.raw = text.splitlines()
        self.bare = [x.strip() for x in self.raw]
        self.depth = np.array([len(x) - len(x.lstrip()) if b else 1 << 30 for x, b in zip(self.raw, self.bare, strict=True)], np.int64)

    def end(self, start: int, least: int) -> int:
        """The first line from start on that is less deep."""
        shallow = np.flatnonzero(self.depth[start:] < least)
        return start + int(shallow[0]) if len(shallow) else len(self.raw)

    def content(self, start: int, end: int) -> list[str]:
        """The lines of a block without outer blank lines and the depth that all have."""
        full = [i for i in range(start, end) if self.bare[i]]
        cut = min((int(self.depth[i]) for i in full), default=0)
        return [self.raw[i][cut:] if self.bare[i] else "" for i in range(full[0], full[-1] + 1)] if full else []

    def is_markup(self, i: int) -> bool:
        return self.bare[i] == ".." or self.bare[i][:2] == ".." and self.bare[i][2:3].isspace()

    def directive(self, i: int) -> str:
        """The name of the directive that a markup line opens, else nothing: comments and targets have none."""
        name, colons, _ = self.bare[i][2:].strip().partition("::")
        return name.lower() if colons and name and all(c.isalnum() or c in "_+-" for c in name) else ""

    def is_option(self, i: int) -> bool:
        head, colon, _ = self.bare[i][1:].partition(":")
        return self.bare[i][:1] == ":" and bool(colon and head) and all(c.isalnum() or c in "_.+-" for c in head)

    def underline(self, i: int) -> str:
        """The character that underlines line i as a title, else nothing."""
        below = self.bare[i + 1] if i + 1 < len(self.bare) else ""
        fits = below and below[0] in ADORNMENTS and below == below[0] * len(below) and len(below) >= max(3, len(self.bare[i]) - 3)
        return below[0] if fits and not self.bare[i].endswith("::") else ""

    def blocks(self) -> Iterator[tuple[str, int, int, str]]:
        """(kind, first line, end, detail) of the document's blocks in their order; together they are all its lines."""
        i, n = 0, len(self.raw)
        while i < n:
            kind, end, detail = "text", i + 1, ""
            if not self.bare[i]:
                kind = "blank"
            elif self.is_markup(i):
                kind, detail = "markup", self.directive(i)
                deeper = int(self.depth[i]) + 1
                end = self.end(i + 1, deeper)
            elif detail := self.underline(i):
                kind, end = "title", i + 2
            elif self.bare[i].endswith("::"):
                kind, end = "literal", self.end(i + 1, 1)
            yield kind, i, end, detail
            i = end


def _fenced(block: list[str]) -> list[str]:
    return ["```", *block, "```"] if block else []


def normalize_rst(text: str) -> str:
    """reStructuredText as plain text with ``#`` headings, whose levels go by the first use of each underline character.

    The document is cut into blocks first, and then each kind of block has its rule: directives of code and literal
    blocks are fenced, dropped directives and other markup (comments, targets) go, other directives keep their plain body.
    """
    lines, levels = _Lines(text), {}

    def directive(start: int, end: int, name: str) -> list[str]:
        first = start + 1
        while first < end and lines.is_option(first):
            first += 1
        body = [] if not name or name in DROPPED_DIRECTIVES and name not in CODE_DIRECTIVES else lines.content(first, end)
        return _fenced(body) if name in CODE_DIRECTIVES else [_plain(x) for x in body]

    def title(start: int, end: int, character: str) -> list[str]:
        return ["#" * levels.setdefault(character, len(levels) + 1) + " " + _plain(lines.bare[start])]

    def literal(start: int, end: int, _: str) -> list[str]:
        lead = _plain(lines.bare[start][:-2].rstrip())
        return ([lead + ":"] if lead else []) + _fenced(lines.content(start + 1, end))

    rules = {"blank": lambda *_: [""], "markup": directive, "title": title, "literal": literal, "text": lambda start, *_: [_plain(lines.raw[start].rstrip())]}
    whole = "\n".join(x for kind, *block in lines.blocks() for x in rules[kind](*block))
    return re.sub("\n\n\n+", "\n\n", whole).strip() + "\n"


def normalized(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, each with ``normalize_rst`` of a column behind it, so that a task holds few texts as strings of Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            piece = batch.slice(at, AT_ONCE)
            texts = pa.array([None if x is None else normalize_rst(x) for x in piece.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*piece.columns, texts], [*piece.schema.names, "text"])


def normalize_docs(docs: DataFrame, rst: str = "rst") -> DataFrame:
    """docs with text, the normalized rst column; null stays null."""
    kept = docs.drop("text") if rst != "text" else docs.withColumnRenamed("text", "__rst")
    column = kept.columns.index("__rst" if rst == "text" else rst)
    return kept.mapInArrow(lambda batches: normalized(batches, column), T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])).drop("__rst")


def doc_records(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Corpus records of manifest(source_id, url, title, version, area, path) with files(path, rst), in the order of source_id."""
    joined = normalize_docs(manifest.join(files, "path"))
    return joined.select(F.lit("docs").alias("source_type"), "source_id", "text", "title", "url", "area", "version", F.lit(None).cast("long").alias("github_issue_id"), F.lit(None).cast("long").alias("github_comment_id")).orderBy("source_id")


def manifest_entries(files: DataFrame) -> DataFrame:
    """(path, sha256, byte_len) of files(path, rst)."""
    data = F.encode("rst", "UTF-8")
    return files.select("path", F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("byte_len"))


# --- golden questions -----------------------------------------------------------------------------------------------

GOLDEN_MIX = {"issue_only": 8, "docs_only": 5, "mixed": 12}
ANSWER_CHARS, QUOTE_CHARS, LEAST_ANSWER = 1200, 160, 80


def distinct_units(units: DataFrame, first_key: str, second_key: str, most: int, order: str = "chunk_id") -> DataFrame:
    """The first ``most`` units in order whose keys are both new among the units that were kept before.

    Whole rows are kept, with unit_no from 0. What is kept depends on what was kept: see ``greedy.distinct_pairs``.
    """
    kept = greedy.distinct_pairs(units, first_key, second_key, order)
    chosen = greedy.numbered(kept.select(F.col("at").alias(order)), order, "unit_no", most)
    return units.join(chosen, order)


def section_units(chunks: DataFrame) -> DataFrame:
    """Parents of at least 80 characters with the sorted ids of their children."""
    children = chunks.where("level = 'child' and parent_id is not null").groupBy("parent_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("child_ids"))
    parents = chunks.where((F.col("level") == "parent") & (F.length("text") >= LEAST_ANSWER)).drop("parent_id")
    return parents.join(children, parents["chunk_id"] == children["parent_id"]).drop("parent_id")


def golden_draft(chunks: DataFrame, project: str, mix: dict[str, int] = GOLDEN_MIX) -> DataFrame:
    """(question, ideal_answer, source_type, difficulty, tags, parent_ids, child_ids) of draft questions.

    chunks need source_type, source_id, title, tags, section_path, github_issue_id and github_comment_id. Documents serve
    the mixed questions in turn. Raises when there are too few units.
    """
    units = section_units(chunks)
    n_issue, n_docs, n_mixed = mix["issue_only"], mix["docs_only"], mix["mixed"]
    issues = units.where("source_type = 'issue' and coalesce(github_comment_id, 0) <> 0").withColumn("key", F.coalesce(tx.strip("title"), F.lit("")))
    docs = units.where("source_type = 'docs' and size(section_path) > 0").withColumn("key", F.element_at("section_path", -1))
    issues = distinct_units(issues, "github_issue_id", "key", n_issue + n_mixed).cache()
    docs = distinct_units(docs, "source_id", "key", max(n_docs, n_mixed)).cache()
    have, n = issues.count(), docs.count()
    if have < n_issue + n_mixed or n < max(n_docs, 1):
        raise ValueError("too few units for the golden questions")
    asked = F.when(F.col("key") != "", F.col("key")).otherwise(F.concat(F.lit("How do maintainers resolve issue "), F.col("github_issue_id").cast("string"), F.lit("?")))
    columns = ["kind", "unit_no", "question", "ideal_answer", "tags", "parent_ids", "child_ids"]
    one = issues.where(F.col("unit_no") < n_issue).select(F.lit("issue_only").alias("kind"), "unit_no", asked.alias("question"), tx.trim_at_space("text", ANSWER_CHARS).alias("ideal_answer"), "tags", F.array("chunk_id").alias("parent_ids"), "child_ids")
    two = docs.where(F.col("unit_no") < n_docs).select(F.lit("docs_only").alias("kind"), "unit_no", F.concat(F.lit(f"What do the {project} docs say about "), F.col("key"), F.lit("?")).alias("question"), tx.trim_at_space("text", ANSWER_CHARS).alias("ideal_answer"), "tags", F.array("chunk_id").alias("parent_ids"), "child_ids")
    left = issues.where((F.col("unit_no") >= n_issue) & (F.col("unit_no") < n_issue + n_mixed)).select((F.col("unit_no") - n_issue).alias("unit_no"), asked.alias("question"), tx.trim_at_space("text", ANSWER_CHARS // 2).alias("x"), F.col("tags").alias("xt"), F.col("chunk_id").alias("xp"), F.col("child_ids").alias("xc"))
    right = docs.select(F.col("unit_no").alias("doc_no"), tx.trim_at_space("text", ANSWER_CHARS // 2).alias("y"), F.col("tags").alias("yt"), F.col("chunk_id").alias("yp"), F.col("child_ids").alias("yc"))
    mixed = left.join(F.broadcast(right), F.col("unit_no") % n == F.col("doc_no")).select(F.lit("mixed").alias("kind"), "unit_no", "question", F.concat("x", F.lit("\n\n"), "y").alias("ideal_answer"), F.array_sort(F.array_union("xt", "yt")).alias("tags"), F.array("xp", "yp").alias("parent_ids"), F.concat("xc", "yc").alias("child_ids"))
    return one.unionByName(two).unionByName(mixed).withColumn("difficulty", tx.difficulty("unit_no")).select(*columns, "difficulty")


def golden_errors(examples: DataFrame, chunk_ids: DataFrame, mix: dict[str, int] = GOLDEN_MIX, reviewed: bool = False) -> DataFrame:
    """(position, rule, message) for all that is wrong with examples(position, question, ideal_answer, kind, source_count, parent_ids, child_ids, human_reviewed), in order.

    Rules about the whole set have position -1. chunk_ids(chunk_id) are the ids that exist.
    """
    size = sum(mix.values())
    whole = examples.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("kind") == k).alias(k) for k in mix))
    wrong = [F.when(F.col("n") != size, F.struct(F.lit(0).alias("rule"), F.concat(F.lit(f"expected {size} examples, found "), F.col("n").cast("string")).alias("message")))]
    wrong += [F.when(F.col(k) != n, F.struct(F.lit(i + 1).alias("rule"), F.concat(F.lit(f"distribution for {k}: expected {n}, found "), F.col(k).cast("string")).alias("message"))) for i, (k, n) in enumerate(mix.items())]
    of_set = whole.select(F.lit(-1).cast("long").alias("position"), F.explode(F.filter(F.array(*wrong), lambda x: x.isNotNull())).alias("e")).select("position", "e.*")
    say = lambda rule, message: F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"))
    tests = [
        F.when(tx.strip("question") == "", say(10, "empty question")),
        F.when(F.length(tx.strip("ideal_answer")) < LEAST_ANSWER, say(11, "ideal_answer too short to be grounded")),
        F.when(F.col("source_count") == 0, say(12, "no ground_truth_sources")),
        F.when(F.size("child_ids") == 0, say(13, "no ground_truth_child_chunk_ids")),
        F.when(~F.col("human_reviewed"), say(16, "not human_reviewed (freeze gate)")) if reviewed else F.lit(None).cast("struct<rule:int,message:string>"),
    ]
    of_row = examples.select("position", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("e")).select("position", "e.*")
    known = chunk_ids.select(F.col("chunk_id").alias("id")).distinct()
    unknown = examples.select("position", F.explode(F.concat("parent_ids", "child_ids")).alias("id")).join(known, "id", "left_anti").select("position", F.lit(14).alias("rule"), F.concat(F.lit("unknown chunk id: "), "id").alias("message"))
    earlier = examples.groupBy("question").agg(F.min("position").alias("first"))
    again = examples.join(earlier, "question").where("position > first").select("position", F.lit(15).alias("rule"), F.concat(F.lit("duplicate question: "), F.substring("question", 1, 60)).alias("message"))
    return of_set.union(of_row).union(unknown).union(again).orderBy("position", "rule", "message")
