import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from threadmill.llm import packing
from tests.llm.conftest import TINY


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


TEXTS = ["", " ", "Hello, world. Hello... WORLD!", "H̱x Ünı İstanbul ΣΑΣ. Ὀδυσσεύς, ’.", "a.b., (c).. \"q\",. don't it's 12.5, 3,", "a <|endoftext|> b", "é<|endoftext|>\u0301a<|startoftext|><|endoftext|>", "A<|ENDOFTEXT|>b <|Endoftext|> <|endoftext|", "don't<|endoftext|>.Can't,<|startoftext|>", "<|endoftext|>. 😀, é., \x1f\x85x y", "word " * 300 + "x" * 5000]


def test_ids_equal_the_tokenizer(tokenizer):
    own = packing.Encoder("word_bpe_49k.json")
    for _ in range(2):
        for t in TEXTS:
            assert own.encode(t.encode(), 2).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def cost(at, price, path, limit):
    total = 0
    for a, b in zip(path[:-1], path[1:], strict=True):
        n = at[b] - at[a]
        assert 0 < n <= limit
        total += price[b] + packing.SEQUENCE + (0 if n & (n - 1) == 0 else limit - n)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_the_cheapest(seed):
    rng = random.Random(seed)
    limit = 64
    steps = [rng.choice([1, 2, 3, 7, 16, 30, 60]) for _ in range(40)]
    at = np.concatenate(([0], np.cumsum(steps)))
    price = np.array([rng.choice([0, 8, 64]) for _ in at])
    best = [0.0] + [float("inf")] * (len(at) - 1)
    for i in range(1, len(at)):
        for j in range(i):
            n = at[i] - at[j]
            if n <= limit:
                best[i] = min(best[i], best[j] + price[i] + packing.SEQUENCE + (0 if n & (n - 1) == 0 else limit - n))
    assert cost(at, price, packing.cuts(at, price, limit), limit) == best[-1]


def check(rows, expected, limit):
    """Every id in one piece, sequences gapless and not too long; returns padding as a share of ids."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(expected)
    for name, ids in expected.items():
        at = 0
        for r in sorted(pieces[name], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids)
    pad = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limit and own[0]["padded_length"] == (at if at & (at - 1) == 0 else limit)
        pad += own[0]["padded_length"] - at
    return pad / max(1, sum(len(x) for x in expected.values()))


def test_documents(spark, tokenizer):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    expected = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert check(packing.pack(docs).collect(), expected, 4096) < 0.005


def test_edge_cases(table, tokenizer, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (91, "one. " * 20_000)]
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    docs = table([(*r, 5) for r in rows], "doc_id long, text string, start long")
    assert check(packing.pack(docs, limit=256).collect(), expected, 256) < 0.05
    assert packing.pack(table([])).count() == 0
    twice = packing.pack(table([(None, "x y"), (None, "x y"), (3, "z")])).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in twice) == [(-1, 3), (-1, 3), (3, 2)]


def test_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 2000)
    ends = np.zeros(10, bool)
    ends[7] = True
    rng = np.random.default_rng(1)
    docs = [(k, np.append(rng.integers(3, 9, int(rng.integers(0, 120))), 2).astype(np.uint32)) for k in range(200)]
    rows = [dict(zip(packing.PIECE, r, strict=True)) for r in packing.pack_stream(iter(docs), ends, 64)]
    assert check(rows, {k: x.tolist() for k, x in docs}, 64) < 0.1
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order)
