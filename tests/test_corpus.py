import json
import random

import pyarrow as pa
import pytest

from tests import plain_chunks as plain
from threadmill.functions import text as tx
from threadmill.operators import corpus as c
from threadmill.operators import segments


def split_blocks(spark, text):
    out = segments.blocks(spark.createDataFrame([(1, 0, text)], "rid long, p int, body string")).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["block"])]


def split_sections(spark, text):
    out = segments.sections(spark.createDataFrame([(1, text)], "rid long, text string")).collect()
    return [(r["section_path"], r["body"]) for r in sorted(out, key=lambda r: r["p"])]


def pack(spark, segments_, most, overlap, joiner):
    rows = [(1, 0, k, s) for k, s in enumerate(segments_)]
    out = segments.packed(spark.createDataFrame(rows, "rid long, p int, block long, text string"), most, overlap, joiner).collect()
    return [r["text"] for r in sorted(out, key=lambda r: r["c"])]


def test_blocks_and_sections(spark):
    text = "intro\n\n```\ncode\n\nmore\n```\ntail\n \nlast\n```\nopen"
    assert split_blocks(spark, text) == plain.split_blocks(text) == ["intro", "```\ncode\n\nmore\n```", "tail", "last", "```\nopen"]
    doc = "pre\n# A\na\n## B\nb\n### C\nc\n## D\n\n# E\ne"
    assert split_sections(spark, doc) == plain.split_sections(doc) == [([], "pre"), (["A"], "# A\na"), (["A", "B"], "## B\nb"), (["A", "B", "C"], "### C\nc"), (["A", "D"], "## D"), (["E"], "# E\ne")]


def plain_pack(segments, most, overlap):
    """Word counts, chunk by chunk, from the rule."""
    parts = []
    for s in segments:
        w = s.split()
        parts += [" ".join(w[i : i + most]) for i in range(0, len(w), most)] if len(w) > most else [s]
    chunks, here = [], []
    n = lambda x: sum(len(s.split()) for s in x)
    for p in parts:
        if here and n(here) + n([p]) > most:
            chunks.append(here)
            k = len(here)
            while overlap > 0 and k > 0 and (k == len(here) or n(here[k:]) < overlap and n(here[k - 1 :]) <= overlap):
                k -= 1
            here = here[k:] if overlap > 0 and n(here[k:]) + n([p]) <= most else []
        here = here + [p]
    return [" ".join(x) for x in chunks + [here] if x]


@pytest.mark.parametrize(("most", "overlap"), [(10, 5), (10, 0), (20, 64), (7, 3)])
def test_packing(spark, most, overlap):
    rows, expected = [], {}
    for seed in range(60):
        rng = random.Random(seed)
        found = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([0, 1, 3, 5, 12, 27]))) for _ in range(15)]
        found = [s for s in found if s]
        expected[seed] = plain_pack(found, most, overlap)
        assert expected[seed] == plain.pack(found, most, overlap, " ")
        rows += [(seed, 0, k, s) for k, s in enumerate(found)]
    out = segments.packed(spark.createDataFrame(rows, "rid long, p int, block long, text string"), most, overlap, " ").collect()
    got = {seed: [r["text"] for r in sorted((r for r in out if r["rid"] == seed), key=lambda r: r["c"])] for seed in expected}
    assert got == expected


def thirds(text):
    """A counter of tokens that is no word count: it counts parts of three letters."""
    return sum((len(w) + 2) // 3 for w in text.split())


@pytest.mark.parametrize(("most", "overlap", "count"), [(500, 64, None), (12, 4, None), (12, 0, None), (9, 20, thirds)])
def test_chunks_equal_those_of_one_text_after_the_other(spark, most, overlap, count):
    rng = random.Random(most + overlap)
    line = lambda: rng.choice(["", "", " ", "```", "``` py", "  ```", "# H", "## Sub head", "### \t third", "#no", "####", "text of a line", "word " * rng.randrange(1, 30), "\u00a0", "ünï cödé"])
    records = [(rng.choice(["docs", "issue"]), f"s{i}", "\n".join(line() for _ in range(rng.randrange(0, 40))), i, i + 1) for i in range(150)]
    records += [("docs", "null", None, None, None), ("docs", "empty", "", 1, 1), ("issue", "none", None, 5, 6), ("docs", "twice", "# A\nx", 0, 0), ("docs", "twice", "# A\nx", 0, 0), ("docs", "long", "w " * 5000 + "\n\n" + "# T\n" + "v " * 700, 0, 0)]
    df = spark.createDataFrame(records, "source_type string, source_id string, text string, github_issue_id long, github_comment_id long").repartition(3)
    out = c.parent_child_chunks(df, most, overlap, count)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) == c.CHUNK_SCHEMA
    expected = [x for kind, source, text, issue, comment in records for x in plain.chunk_record(kind, source, text or "", issue, comment, most, overlap, count or plain.count_tokens)]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    with pytest.raises(Exception, match="issue record without ids: s"):
        c.parent_child_chunks(spark.createDataFrame([("issue", "s", "x", None, 1)], df.schema)).collect()


def test_middle_segment_is_in_both(spark):
    a, b, d = ("a " * 5).strip(), ("b " * 5).strip(), ("d " * 5).strip()
    assert pack(spark, [a, b, d], 10, 5, "\n\n") == [f"{a}\n\n{b}", f"{b}\n\n{d}"]


RST = """Title
=====

Text with ``code`` and :ref:`link <x>`.

.. note:: ignored
   :opt: 1

   Kept *body*.

.. code-block:: python

   x = 1

     y = 2

.. toctree::

   a
   b

.. _target:

Sub
---
Example::

    block

.. comment
   more of it
Other
=====
End
"""


def test_rst():
    assert c.normalize_rst(RST) == "# Title\n\nText with code and link.\n\nKept body.\n```\nx = 1\n\n  y = 2\n```\n## Sub\nExample:\n```\nblock\n```\n# Other\nEnd\n"
    assert c.normalize_rst("") == "\n"


def test_records_and_chunks(spark):
    long = "word " * 30
    comment = lambda i, b, a: (i, b, a, "at", None)
    issues = spark.createDataFrame(
        [(2, " T ", "body", "bug", "u", "c", "d", [comment(9, long, "MEMBER"), comment(8, long, "none"), comment(7, "short", "OWNER"), comment(None, long, "OWNER")], 0), (3, None, None, None, "u", "c", "d", None, 1), (2, "again", "x", "bug", "u", "c", "d", None, 5)],
        "github_id long, title string, body string, label string, html_url string, created_at string, closed_at string, comments array<struct<github_id:bigint,body:string,author_association:string,created_at:string,html_url:string>>, ordinal long",
    )
    records = c.issue_records(issues, spark.createDataFrame([(2,), (3,), (99,)], "github_id long"))
    found = {r["source_id"]: r for r in records.collect()}
    assert set(found) == {"issue:2", "issue:2:comment:9", "issue:3"}
    assert found["issue:2"]["text"] == "T\n\nbody" and found["issue:2"]["tags"] == ["bug"] and found["issue:3"]["title"] is None
    chunks = c.parent_child_chunks(records).collect()
    assert {r["chunk_id"] for r in chunks} == {"issue:2:comment:0:parent:0", "issue:2:comment:0:child:0", "issue:2:comment:9:parent:0", "issue:2:comment:9:child:0", "issue:3:comment:0:parent:0"}
    assert c.orphans(c.parent_child_chunks(records)).count() == 0
    naive = c.naive_chunks(spark.createDataFrame([("d", " ".join(map(str, range(25)))), ("e", " ")], "source_id string, text string"), 10).collect()
    assert [(r["chunk_no"], len(r["text"].split())) for r in sorted(naive, key=lambda r: r["chunk_no"])] == [(0, 10), (1, 10), (2, 5)]


def test_distinct_units_depend_on_what_was_kept(spark):
    rng = random.Random(4)
    rows = [(f"c{i:03d}", rng.choice("abcdefgh") if rng.random() > 0.1 else None, rng.choice("uvwxyz")) for i in range(60)]
    seen_a, seen_b, kept = set(), set(), []
    for r in rows:
        if r[1] not in seen_a and r[2] not in seen_b and len(kept) < 4:
            seen_a.add(r[1]), seen_b.add(r[2])
            kept.append(r[0])
    out = c.distinct_units(spark.createDataFrame(rows, "chunk_id string, a string, b string"), "a", "b", 4)
    assert [r["chunk_id"] for r in out.orderBy("unit_no").collect()] == kept


def test_golden_questions(spark):
    text = "some words of an answer " * 5
    rows = []
    for i in range(20):
        rows.append((f"issue:{i:02d}:comment:1:parent:0", "parent", None, "issue", f"issue:{i}", f"title {i}", ["b"], [], i, 1, text))
        rows.append((f"issue:{i:02d}:comment:1:child:0", "child", f"issue:{i:02d}:comment:1:parent:0", "issue", f"issue:{i}", f"title {i}", ["b"], [], i, 1, text))
    for i in range(6):
        rows.append((f"doc:{i}:parent:0", "parent", None, "docs", f"d{i}", "t", ["a"], [f"S{i}"], None, None, text))
        rows.append((f"doc:{i}:parent:0:child:0", "child", f"doc:{i}:parent:0", "docs", f"d{i}", "t", ["a"], [f"S{i}"], None, None, text))
    chunks = spark.createDataFrame(rows, "chunk_id string, level string, parent_id string, source_type string, source_id string, title string, tags array<string>, section_path array<string>, github_issue_id long, github_comment_id long, text string")
    out = c.golden_draft(chunks, "project").collect()
    kinds = [r["kind"] for r in out]
    assert (kinds.count("issue_only"), kinds.count("docs_only"), kinds.count("mixed")) == (8, 5, 12)
    assert {tuple(r["tags"]) for r in out if r["kind"] == "mixed"} == {("a", "b")}
    examples = [(i, r["question"], r["ideal_answer"], r["kind"], 1, r["parent_ids"], r["child_ids"], False) for i, r in enumerate(out)]
    schema = "position long, question string, ideal_answer string, kind string, source_count int, parent_ids array<string>, child_ids array<string>, human_reviewed boolean"
    known = chunks.select("chunk_id")
    assert c.golden_errors(spark.createDataFrame(examples, schema), known).count() == 0
    bad = [(*examples[0][:5], ["nope"], [], False), *examples[1:], (25, examples[1][1], "short", "mixed", 0, [], ["x"], True)]
    messages = [(r["position"], r["message"]) for r in c.golden_errors(spark.createDataFrame(bad, schema), known, reviewed=True).collect()]
    assert messages[:2] == [(-1, "expected 25 examples, found 26"), (-1, "distribution for mixed: expected 12, found 13")]
    assert (0, "unknown chunk id: nope") in messages and (25, f"duplicate question: {examples[1][1]}") in messages and (0, "no ground_truth_child_chunk_ids") in messages


def plain_objects(value, path=""):
    if isinstance(value, dict):
        if isinstance(value.get("body"), str) and isinstance(value.get("author_association"), str):
            yield path, value["body"], value["author_association"]
        for key in sorted(value):
            yield from plain_objects(value[key], f"{path}.{key}" if path else key)
    elif isinstance(value, list):
        for inner in value:
            yield from plain_objects(inner, f"{path}[]")


def nested(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, 1, 2.5, True, "text", "", "5"])
    if kind < 0.55:
        return [nested(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: nested(rng, depth - 1) if rng.random() < 0.5 else rng.choice(["x", "y", 3]) for k in rng.sample(["body", "author_association", "comments", "a b", "z"], rng.randrange(6))}


def test_comment_objects(spark):
    rng = random.Random(6)
    record = {"body": "b", "author_association": "NONE", "comments": [{"body": "c", "author_association": "OWNER", "x": {"y": [{"body": "d", "author_association": "MEMBER"}]}}, {"body": 1, "author_association": "OWNER"}, {"body": "no"}]}
    records = [record, [[record]], "just text", *(nested(rng, 6) for _ in range(200))]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(1000, None), (1001, "broken"), (1002, "[]"), (1003, "{}")]
    out = c.comment_objects(spark.createDataFrame(rows, "id int, j string"), "id", "j").collect()
    found = {}
    for r in sorted(out, key=lambda r: (r["id"], r["place"])):
        found.setdefault(r["id"], []).append((r["path"], r["body"], r["author_association"]))
    assert found == {i: f for i, r in enumerate(records) if (f := list(plain_objects(r)))}
    assert found[0] == [("", "b", "NONE"), ("comments[]", "c", "OWNER"), ("comments[].x.y[]", "d", "MEMBER")]
    assert c.comment_objects(spark.createDataFrame([], "id int, j string"), "id", "j").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pieces_by_any_counter(seed):
    rng = random.Random(seed)
    words = ["x" * rng.randrange(1, 9) for _ in range(60)]
    count = lambda t: sum((len(w) + 2) // 3 for w in t.split())
    expected, here = [], []
    for w in words:
        here.append(w)
        if count(" ".join(here)) >= 7:
            expected.append(" ".join(here))
            here = []
    assert list(segments.pieces(" ".join(words), 7, count)) == expected + ([" ".join(here)] if here else [])


@pytest.mark.parametrize(("rst", "plain"), [
    ("A\n~~~\nx\n\nB\n===\n\nC\n~~~", "# A\nx\n\n## B\n\n# C\n"), ("::\n\n  code\n   more\n\nend", "```\ncode\n more\n```\nend\n"), (".. image:: x\n   :alt: y\n\n   caption\ntext", "text\n"),
    ("..\n   comment\n\ntext", "text\n"), ("a\n\n\n\n\nb", "a\n\nb\n"), ("Long title here\n--\n", "Long title here\n--\n"), ("  .. code::\n     :x: 1\n\n     y\n\n  z", "```\ny\n```\n  z\n"), ("x\n..y\n", "x\n..y\n"), (".. |sub| replace:: z\nq", "q\n"),
])
def test_rst_rules(rst, plain):
    assert c.normalize_rst(rst) == plain


def test_a_task_normalizes_few_texts_at_once():
    texts = ["a *b*", None, "Title\n====="] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["n", "rst"])
    out = list(c.normalized([batch], 1))
    assert max(b.num_rows for b in out) <= c.AT_ONCE and out[0].schema.names == ["n", "rst", "text"]
    assert [x for b in out for x in b.column(2).to_pylist()] == [None if t is None else c.normalize_rst(t) for t in texts]
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(len(texts)))


def test_larger_tables_are_cut_by_more_tasks(spark, monkeypatch):
    from threadmill.operators import segments

    rows = [("docs", f"d{i}", f"intro {i}\n# A\n\none two\n```\ncode\n```\n## B\n" + "word " * (i * 7), None, None) for i in range(60)]
    records = spark.createDataFrame(rows, "source_type string, source_id string, text string, github_issue_id long, github_comment_id long")
    read = lambda: sorted(map(tuple, c.parent_child_chunks(records, 50, 10).select("chunk_id", "parent_id", "level", "text").collect()), key=repr)
    expected = read()
    monkeypatch.setattr(segments, "SHARE", 500)
    asked = []
    monkeypatch.setattr(segments, "_dealt", lambda rows, parts, *keys: asked.append(parts) or rows.repartition(parts, *keys))
    assert read() == expected
    assert set(asked) == {sum(len(r[2].encode()) for r in rows) // 500}


def test_words_of_python_are_words_of_columns(spark):
    text = " a ".join(map(chr, [*range(0x800), *range(0x1600, 0x1900), *range(0x2000, 0x2100), 0x3000, 0xFEFF]))
    df = spark.createDataFrame([("d", text), ("e", None), ("f", " \x85\u3000")], "source_id string, text string")
    assert df.select(tx.words("text").alias("w")).first()["w"] == text.split()
    assert [(r["source_id"], r["chunk_no"]) for r in c.naive_chunks(df, 1000).collect()] == [("d", i) for i in range((len(text.split()) + 999) // 1000)]
