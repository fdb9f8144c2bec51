import re

import pytest
from pyspark.sql import functions as F

from threadmill.functions import text as tx


@pytest.fixture
def run(spark):
    def one(make, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
        return df.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]

    return one


TEXTS = ["", " ", "a", "Hello, wörld it's well-known _x 12", " no break space\x1fend\x85", "a\r\nb\r\rc\n\n\n\nd\t\te  f ", "don't 'quoted' --dash-- a-b", "日本語 テキスト", "é é"]


@pytest.mark.parametrize("text", TEXTS)
def test_words_as_python_counts_them(run, text):
    assert run(tx.count_tokens, text) == len(text.split())
    assert run(tx.words, text) == text.split()
    assert run(tx.strip, text) == text.strip()
    assert run(tx.collapse, text) == " ".join(text.split())
    assert run(tx.count_words, text) == len(re.findall(r"\b\w+\b", text))
    assert run(tx.count_words_joined, text) == len(re.findall(r"\b[\w'-]+\b", text))
    assert run(tx.search_tokens, text) == re.findall("[a-z0-9]+", text.lower())


def test_normalize_and_clean(run):
    assert run(tx.normalize_text, "a\t\tb  c\r\n\r\n\r\n\r\nd ") == "a b c\n\nd"
    assert run(tx.clean_text, " T ", "x <!-- a\nb --> y\r\n\r\n\r\nz") == "T\n\nx y\n\nz"
    assert run(tx.clean_text, " ", "<!-- only -->") is None
    assert run(tx.clean_text, None, None) is None
    assert run(tx.normalize_label, "  Kind:  BUG\t") == "kind: bug"


def test_previews(run):
    assert run(lambda t: tx.preview(t, 10), "abc defg hij") == "abc def..."
    assert run(lambda t: tx.preview(t, 11), "abc def  ghi jk") == "abc def ..."
    assert run(lambda t: tx.preview_trimmed(t, 11), "abc def  ghi jk") == "abc def..."
    assert run(lambda t: tx.trim_at_space(t, 9), " abc defghi") == "abc ..."
    assert run(lambda t: tx.trim_at_space(t, 4), "abcdefghi") == "abcd ..."
    assert run(lambda t: tx.trim_at_space(t, 20), " abc ") == "abc"
    assert run(lambda t: tx.cap_for_prompt(t, 100), "x" * 101) == "x" * 20 + "\n\n[Issue text truncated for classification.]"
    assert run(tx.first_80, "a  b" * 60) == " ".join(("a  b" * 60).split())[:80]


def test_titles_scores_and_predicates(run):
    body = "Crash: it fails\nmore\n \n\nsecond error\n\nthird"
    assert run(tx.title_line, body) == "Crash: it fails"
    assert run(tx.opening, body) == "Crash: it fails\nmore\n\nsecond error"
    assert run(lambda t: tx.signal_score(F.lit("bug"), t, F.lit("bug: Crash")), "an Error") == 8 + 8 + 20 + 3
    assert [run(tx.is_structured, t) for t in ("```", "x\n - y", "x\n 2) y", "-y", "2.y", "plain")] == [True, True, True, False, False, False]
    assert [run(tx.is_maintainer, t) for t in ("member", "Collaborator", "NONE", None)] == [True, True, False, False]
    assert run(lambda t: tx.is_maintainer(t, tx.HOLDOUT_MAINTAINERS), "COLLABORATOR") is False
    assert run(tx.timestamp, "2025-01-01T00:00:00") is None
    assert run(tx.timestamp, "2025-01-01T00:00:00Z") is not None


def test_rewrites(run):
    assert run(lambda t: tx.parse_rewrites(t, 3), '1. "one"\n- two\n\n3) one\n  * \'three\'\nfour') == ["one", "two", "three"]
    assert run(lambda q: tx.expand_queries(q, F.array(F.lit("a"), q, F.lit(""), F.lit("a"))), "q") == ["q", "a"]
    assert run(lambda t: tx.fill_prompt(t, n=3, question=F.lit("why {n}?")), "{n} for {question}") == "3 for why {n}?"


def test_ids_and_inline_markup(run):
    assert run(lambda s: tx.doc_child_id(s, F.lit(1), F.lit(2)), "d") == "doc:d:parent:1:child:2"
    assert run(lambda s: tx.issue_child_id(s, F.lit(0), F.lit(2)), "7") == "issue:7:comment:0:child:2"
    assert run(tx.is_child_id, "doc:d:naive:2") is False
    assert run(tx.clean_inline, "see :ref:`text <t>` and `l <u>`_ ``lit`` `i` **b** *e* |s| ") == "see text and l lit i b e s"
