import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import TINY
from threadmill.llm import impacts


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def plain(rows, queries, k):
    """The definition, document by document."""
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(c.total() for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = {}
    for q, text in queries:
        found = []
        for i, c in docs:
            m = 75 + 25 * c.total() * n // length
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, x in Counter(terms(text)).items() if w in c)
            if s > 0 and i is not None:
                found.append((-s, i))
        if found and q is not None:
            out[q] = sorted(found)[:k]
    return out


def got(frame, key="item_id"):
    out = defaultdict(list)
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out[r[key]].append((-r["score"], r["doc_id"]))
        assert r["rank"] == len(out[r[key]])
    return dict(out)


def made(rng, n, most):
    return [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, most))) for _ in range(n)]


@pytest.mark.parametrize("sent", [2_000_000, 300])
def test_benchmark_items(spark, monkeypatch, sent):
    monkeypatch.setattr(impacts, "QUERY_TERMS", sent)
    docs, items = spark.read.parquet(f"{TINY}/documents.parquet"), spark.read.parquet(f"{TINY}/benchmark.parquet")
    found = got(impacts.search(items, impacts.index(docs), 20))
    assert found == plain(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect(), 20)


@pytest.mark.parametrize(("postings", "documents"), [(1 << 18, 1 << 14), (300, 1 << 14), (1 << 18, 20), (5, 3)])
def test_shards_of_any_size(spark, table, monkeypatch, postings, documents):
    monkeypatch.setattr(impacts, "POSTINGS", postings)
    monkeypatch.setattr(impacts, "DOCS", documents)
    rng = random.Random(3)
    texts = made(rng, 700, 30)
    rows = list(enumerate(texts + texts[:90]))  # copies tie
    shards = impacts.index(table(rows).coalesce(1))
    assert shards.count() >= len(rows) / documents
    assert sorted(i for r in shards.collect() for i in r["ids"]) == [i for i, _ in rows]
    asked = [(100 + k, t) for k, t in enumerate(made(rng, 25, 40))]
    assert got(impacts.search(table(asked, "item_id long, text string"), shards, 7)) == plain(rows, asked, 7)


@pytest.mark.parametrize("first_round", [1, 16, 1 << 20])
def test_groups_are_exact_impacts_from_the_highest_down(monkeypatch, first_round):
    monkeypatch.setattr(impacts, "ROUND", first_round)
    rng = random.Random(first_round)
    texts = made(rng, 400, 80)
    doc, term, tf, sizes = impacts.counted([t.encode() for t in texts])
    total, length = int((sizes > 0).sum()), int(sizes.sum())
    batch = impacts._shard(0, total, length, list(range(len(texts))), doc, term, tf, sizes)
    row = next(impacts._rows(batch))
    at = 0
    for g in row["groups"]:
        own = row["impacts"][at : at + g]
        assert (np.diff(own) < 0).all()
        at += g
    names = {w: int(impacts._named([w.encode()])[0]) for t in texts for w in terms(t)}
    vocabulary = np.array(sorted(names.values()))
    shard = impacts.Shard(row, vocabulary)
    frequency = Counter(w for t in texts for w in set(terms(t)))
    rows, early = list(enumerate(texts)), 0
    for q, text in enumerate(texts[:60]):
        asked = Counter(terms(text))
        if not asked:
            continue
        expected = plain(rows, [(q, text)], 5).get(q, [])
        term = np.searchsorted(vocabulary, [names[w] for w in asked])
        weight = np.array([n * math.floor(1000 * math.log((2 * total + 2) / (2 * frequency[w] + 1))) for w, n in asked.items()])
        for least in {0, -expected[-1][0] if len(expected) == 5 else 0}:
            docs, scores = shard.top(term, weight, 5, least)
            assert sorted(zip((-scores).tolist(), docs.tolist(), strict=True))[:5] == expected
            early += len(docs) < len(plain(rows, [(q, text)], 1000)[q])
    assert early or first_round == 1 << 20  # reading stopped before all groups were read


def test_edge_cases(table):
    long = " ".join(f"w{i}" for i in range(90_000))
    rows = [(0, "alpha beta"), (0, "alpha beta"), (1, None), (2, ""), (3, "ÄÖ ünı \x00 beta_Beta"), (4, "... !"), (None, "alpha alpha"), (5, long), (6, "w5 W7")]
    docs = table([(*r, "x", 1) for r in rows], "doc_id long, text string, terms string, n int")
    asked = [(1, "Alpha ALPHA beta"), (2, None), (3, ""), (4, "nowhere"), (5, "w5 w7 w89999"), (None, "alpha"), (6, "ünı ÄÖ"), (6, "ünı ÄÖ"), (7, "äö")]
    items = table([(*r, 0) for r in asked], "item_id long, text string, rank int")
    assert got(impacts.search(items, impacts.index(docs), 3)) == plain(rows, asked, 3)
    empty, nothing = table([]), table([], "item_id long, text string")
    assert impacts.search(items, impacts.index(empty)).count() == 0
    assert impacts.search(nothing, impacts.index(docs)).count() == 0
    assert impacts.search(items, impacts.index(table([(1, "..."), (2, None)]))).count() == 0
