import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from threadmill.llm import quality


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by the definition."""
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    many = Counter(windows)
    inside = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def failed(c):
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


NO_LABELS = "doc_id long, quality int"
TEXTS = ["", None, " \n\t", "one", "a b c d e f g h i j", "a b c d e " * 3, "x " * 40, "é ü ö " * 6, "l1\nl2\n\nl1\n l1\nl1", "# $ % & | < > *", "a\rb\x0bc\x0cd", "w " + " ".join(map(str, range(30_000))) * 2, "a b c d a b c d a"]


def test_counts_equal_the_definition(table):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab c\n#\té") for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    rows = [*enumerate(texts), (3, "one"), (None, "a b c d e f g h i j k")]
    docs = table([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, levels string")
    out = quality.judge(docs, table([], NO_LABELS), F.col("lang")).collect()
    expected = sorted(((i is None, i, *counts(t), failed(counts(t)), not failed(counts(t))) for i, t in rows), key=repr)
    assert sorted(((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out), key=repr) == expected
    assert quality.judge(table([], "doc_id long, text string, lang string"), table([], NO_LABELS), F.col("lang")).count() == 0


def test_tail_is_the_sum_of_the_binomial_distribution():
    for n in (1, 5, 80, 1000):
        for p in (0.001, 0.05, 0.5):
            for k in {0, 1, n // 20, n // 2, n - 1, n}:
                exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(k, n) + 1))
                assert quality.lower_tail(k, n, p) == pytest.approx(exact, rel=1e-9, abs=1e-12)
    assert 0.4 < quality.lower_tail(50_000_000, 1_000_000_000, 0.05) < 0.6


def corpus(rng, n, stratum, base, noise):
    """(id, text, stratum), good: good texts have few symbols, bad ones many, and noise of the good ones have many too."""
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.85
        dirty = not good or rng.random() < noise
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(40)]
        rows.append((base + i, " ".join(w + "###" if dirty and rng.random() < 0.7 else w for w in words), stratum))
        if rng.random() < 0.5:
            labels.append((base + i, int(good)))
    return rows, labels


def test_cutoffs_catch_the_bad_and_keep_the_good(table):
    rng = random.Random(11)
    (a, la), (b, lb), (c, lc), (d, _) = corpus(rng, 1500, "x", 0, 0.0), corpus(rng, 1500, "y", 10_000, 0.2), corpus(rng, 60, "z", 20_000, 0.0), corpus(rng, 200, None, 30_000, 0.0)
    labels = la + lb + lc
    docs = table([*a, *b, *c, *d], "doc_id long, text string, lang string")
    marks = table([*labels, labels[0], (None, 1), (5, None)], NO_LABELS)
    out = {r.doc_id: r for r in quality.judge(docs, marks, F.col("lang")).collect()}
    good = {i for i, q in labels if q}
    bad = {i for i, q in labels if not q}
    for i, r in out.items():
        assert r.kept == (not r.base_failed and r.failed_rules == "")
    assert all(out[i].kept for i in good if i < 10_000)
    assert sum(not out[i].kept for i in bad if i < 10_000) > 0.9 * sum(i < 10_000 for i in bad)
    # y: so many good texts look bad that no cutoff which finds them is safe; z and the null stratum: too few labels.
    y = [i for i in good if 10_000 <= i < 20_000]
    assert sum(not out[i].kept for i in y) <= quality.RISK * len(y)
    assert all(out[i].chosen == 0 for i in out if i >= 20_000)


def test_risk_holds_over_many_draws(table, monkeypatch):
    """Strata in which a share above RISK of the good texts is as bad as the bad ones: they are cut in no more than LEVEL of all draws."""
    rng = random.Random(2)
    rows, labels, n = [], [], 60
    for s in range(n):
        r, x = corpus(rng, 400, f"s{s}", s * 1000, 0.07)
        rows, labels = rows + r, labels + x
    docs, marks = table(rows, "doc_id long, text string, lang string"), table(labels, NO_LABELS)
    measured = quality.measure(docs, F.col("lang"))
    found = quality.select(measured, marks, level=0.05 * n).collect()  # each stratum by itself at 0.05
    assert len(found) == n
    wrong = 0
    for r in found:
        if r.chosen:
            cut = [c[r.chosen - 1] for c in r.cuts]
            own = [m.levels for m in measured.where(F.col("stratum") == r.stratum).collect()]
            rejected = sum(any(x > c for x, c in zip(levels, cut, strict=True)) for levels in own) / len(own)
            wrong += rejected > 0.15 + 0.05 * 0.85
    assert wrong <= 8  # 3 are expected
    assert all(r.p_value <= 0.05 for r in found if r.chosen)


def test_equal_texts_count_once(table):
    rng = random.Random(8)
    rows, labels = corpus(rng, 80, "x", 0, 0.0)
    copies = [(1000 + i, "one and the same text of more words than ten are here", "x") for i in range(2000)]
    marks = labels + [(i, 1) for i, _, _ in copies[:1000]]
    docs = table(rows + copies, "doc_id long, text string, lang string")
    found = quality.select(quality.measure(docs, F.col("lang")), table(marks, NO_LABELS)).first()
    assert found.chosen == 0  # a thousand copies are no thousand labels
