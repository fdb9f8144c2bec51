import random

import numpy as np
import pytest

from threadmill.llm import decontaminate as dc
from tests.llm.conftest import TINY


def plain_alignment(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1][j] + dc.GAP, h[i][j - 1] + dc.GAP)
            best = max(best, h[i][j])
    return best


@pytest.mark.parametrize("seed", range(5))
def test_alignment_equals_the_plain_table(seed):
    rng = random.Random(seed)
    for _ in range(30):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 15))]
        b = [rng.randrange(6) for _ in range(rng.randrange(0, 30))]
        assert dc.align(np.array(a), np.array(b, np.int64))[0] == plain_alignment(a, b)


def test_words_short_cut():
    for t in ["", None, "Ünı×a÷b ¿Qué? don't", "“x” 日本。語 _a1 K", "Plain, ascii - text_1 2.5", "Straße ÀÉ œuvre"]:
        assert [w.decode() for w in dc.words(t)] == dc._WORD.findall((t or "").lower())


def plain(docs, items):
    """Every document against every item over its whole length."""
    out = {}
    for i, t in docs:
        for k, x in items:
            item, text = dc.words(x), dc.words(t)
            if item and (s := plain_alignment(item, text) / (dc.MATCH * len(item))) >= dc.SCORE:
                out[i, k] = round(s, 9)
    return out


def edited(text, rng, share):
    w = text.split()
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = rng.choice(["quite", "other", "words"])
    return " ".join(w)


def test_copies_equal_brute_force(table):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 40)))) for k in range(12)] + [(50, "too short"), (51, None), (52, "!!")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, edited(items[rng.randrange(12)][1], rng, rng.choice([0, 0.05, 0.1])))
        docs.append((i, ". ".join(parts)))
    found = {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in dc.leaks(table(docs), table(items, "item_id long, text string")).collect()}
    assert found == plain(docs, items)
    kept = {r["doc_id"] for r in dc.decontaminate(table(docs), table(items, "item_id long, text string")).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in found}


def test_items_in_blocks(table, monkeypatch):
    items = [(k, " ".join(f"x{k}y{j}" for j in range(12))) for k in range(9)]
    docs = [(i, "before " + items[i][1] + " after") for i in range(9)] + [(20, "before and after")]
    monkeypatch.setattr(dc, "BLOCK", 120)
    found = sorted((r["doc_id"], r["item_id"], r["first_word"], r["end_word"]) for r in dc.leaks(table(docs), table(items, "item_id long, text string")).collect())
    assert found == [(i, i, 1, 13) for i in range(9)]


def test_a_common_leak_keeps_its_seeds(table):
    item = " ".join(f"word{i}" for i in range(20))
    docs = [(i, f"start{i} {item} end{i}") for i in range(300)] + [(400 + i, f"clean text number {i}") for i in range(50)]
    assert {r["doc_id"] for r in dc.leaks(table(docs), table([(1, item)], "item_id long, text string")).collect()} == set(range(300))


@pytest.mark.parametrize("partial", [150, 1000])
def test_one_full_copy_hides_no_partial_ones(table, partial):
    """A whole copy has n-grams that no other document has, and all the others only such as are far more frequent."""
    words = [f"word{i}" for i in range(30)]
    docs = [(0, " ".join(words))] + [(1 + i, f"start{i} {' '.join(words[:25])} end{i}") for i in range(partial)] + [(5000 + i, f"a stock {' '.join(words[3:7])} phrase {i}") for i in range(200)]
    found = {r["doc_id"]: r["score"] for r in dc.leaks(table(docs), table([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert set(found) == set(range(partial + 1))
    assert found[0] == 1 and found[1] == pytest.approx(25 / 30)


def test_unequal_copies_by_the_hundred_equal_brute_force(table, monkeypatch):
    monkeypatch.setattr(dc, "COMMON", 1)
    rng = random.Random(9)
    items = [(k, " ".join(f"i{k}w{rng.randrange(25)}" for _ in range(rng.randrange(12, 30)))) for k in range(3)]
    docs = []
    for i in range(150):
        w = edited(items[i % 3][1], rng, rng.choice([0, 0.04, 0.1])).split()
        cut = rng.randrange(len(w) // 2)
        docs.append((i, " ".join(["before"] * 3 + w[cut : cut + rng.randrange(6, len(w) + 1)] + ["after"] * 3)))
    found = {(r["doc_id"], r["item_id"]) for r in dc.leaks(table(docs), table(items, "item_id long, text string")).collect()}
    grams = lambda t: {tuple(t[k : k + dc.GRAM]) for k in range(len(t) - dc.GRAM + 1)}
    seeded = {(i, k) for i, t in docs for k, x in items if grams(dc.words(t)) & grams(dc.words(x))}
    assert found == set(plain(docs, items)) & seeded


def test_edge_cases(table):
    item = "one two three four five six"
    rows = [(1, None), (2, ""), (None, item), (3, item), (3, item), (4, "x " * 50_000 + item)]
    docs = table([(*r, "z", 0) for r in rows], "doc_id long, text string, score string, rid int")
    bench = table([(7, item), (7, item), (None, "nothing of this is there at all")], "item_id long, text string")
    found = sorted((r["doc_id"] or -1, r["item_id"]) for r in dc.leaks(docs, bench).collect())
    assert found == [(-1, 7), (3, 7), (3, 7), (4, 7)]
    assert dc.decontaminate(docs, bench).columns == docs.columns
    assert dc.decontaminate(docs, bench).count() == 2
    assert dc.leaks(table([]), bench).count() == 0
    assert dc.leaks(docs, table([], "item_id long, text string")).count() == 0


def test_long_passages_of_longer_items_and_short_items(table):
    long = [f"w{i}" for i in range(300)]
    docs = [(1, "x y " + " ".join(long[40:100]) + " z"), (2, "x y " + " ".join(long[40:80]) + " z"), (3, "once upon a time")]
    bench = table([(1, " ".join(long)), (2, "upon a")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in dc.leaks(table(docs), bench).collect()} == {(1, 1), (3, 2)}
    assert {r["doc_id"] for r in dc.decontaminate(table(docs), bench).collect()} == {2, 3}


def test_verbatim_copies_in_documents(spark):
    docs, bench = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, bench).collect()}
    there = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in bench.collect() if b["text"] in d["text"]}
    assert there and there <= found
