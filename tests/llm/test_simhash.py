import random

import numpy as np
import pytest
import xxhash

from threadmill.llm import graph, simhash
from tests.llm.conftest import TINY


def plain_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("budget", [0, 1, 4, 7])
def test_trie_links_equal_brute_force(budget):
    rng = random.Random(budget)
    keys = [rng.getrandbits(64) for _ in range(300)]
    for k in list(keys):
        for _ in range(rng.randrange(4)):
            x = k
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            keys.append(x)
    keys = np.array(sorted(keys + keys[:3]), np.uint64)
    found = set()
    for i, j in simhash.trie_links(keys, np.array([0]), np.array([len(keys)]), 0, budget):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert found == {(i, j) for j in range(len(keys)) for i in range(j) if int(keys[i] ^ keys[j]).bit_count() <= budget}


@pytest.mark.parametrize("rows", [100, 1 << 24, 1 << 32])
def test_agreeing_keys_lose_no_pair(spark, rows):
    """Whichever 4 bits differ, a key agrees in its first bits, and every key is the word with its bits in another order."""
    rng = random.Random(2)
    pairs = [(w, w ^ sum(1 << b for b in rng.sample(range(64), 4))) for w in (rng.getrandbits(64) for _ in range(200))]
    keys = simhash.agreeing("w", 4, rows)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a long, b long")
    columns = [f"{key.replace('w', side)} as {side}{n}" for side in "ab" for n, (key, _) in enumerate(keys)]
    for r, (a, b) in zip(table.selectExpr("a", *columns).drop("a").collect(), pairs, strict=True):
        found = [(r[f"a{n}"] % 2**64, r[f"b{n}"] % 2**64) for n in range(len(keys))]
        assert all((x ^ y).bit_count() == 4 and x.bit_count() == a.bit_count() for x, y in found)
        assert any(x >> (64 - depth) == y >> (64 - depth) for (x, y), (_, depth) in zip(found, keys, strict=True))


def test_windows_are_stretches_of_the_fingerprint(spark):
    rng = random.Random(3)
    words = [rng.getrandbits(64) for _ in range(simhash.WORDS)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    row = spark.createDataFrame([tuple(map(signed, words))], ", ".join(f"w{k} long" for k in range(simhash.WORDS))).selectExpr(*(f"{key} as k{n}" for n, (key, _) in enumerate(simhash.windows()))).first()
    bits = "".join(f"{w:064b}" for w in words)
    assert [f"{v % 2**64:064b}" for v in row] == [((bits + bits)[at : at + simhash.KEY]).ljust(64, "0") for at in range(0, len(bits), simhash.STEP)]


def test_tries_of_an_even_table_do_not_grow_with_it():
    for rows in (0, 1, 1 << 22, (1 << 22) + (1 << 10), 10**8, 10**10, 10**12):
        assert rows >> simhash.agreed(rows) <= simhash.TILE, rows
    assert [simhash.agreed(r) for r in (0, 5 << 20, 9 << 20, 10**10)] == [10, 11, 12, 22]
    assert [len(simhash.windows(a)) for a in (10, 11, 22)] == [29, 36, 210]
    assert simhash.KEY + simhash.agreed(10**12) - simhash.AGREE <= 64


@pytest.mark.parametrize("agree", [10, 14, 18])
def test_more_agreeing_bits_lose_no_more_pairs(spark, agree):
    """Pairs of fingerprints as texts of similarity 0.8 have them: each bit differs with probability 0.1515."""
    rng, words, pairs = np.random.default_rng(agree), simhash.lengths(agree), 600
    one = rng.integers(0, 2, (pairs, 64 * words), np.uint8)
    two = one ^ (rng.random(one.shape) < 0.1515)
    prints = np.packbits(np.stack([one, two], 1).reshape(2 * pairs, -1), axis=1).view(">i8").astype(np.int64)
    units = spark.createDataFrame([(i, *p) for i, p in enumerate(prints.tolist())], "uid long, " + ", ".join(f"w{k} long" for k in range(words)))
    close = {i for i in range(pairs) if int((one[i, :128] != two[i, :128]).sum()) <= simhash.APART}
    found = simhash.links(units, simhash.windows(agree), simhash.BUDGET, ("w0", "w1"), simhash.APART).distinct().collect()
    joined = {r["a"] // 2 for r in found if r["a"] // 2 == r["b"] // 2 and r["a"] != r["b"]}
    assert joined <= close and len(joined) >= 0.96 * pairs, len(joined) / pairs


def test_a_table_that_asks_for_more_agreeing_bits(table, monkeypatch):
    """The whole operator with longer fingerprints finds the same classes as with the usual ones."""
    rng = random.Random(8)
    texts = []
    for i in range(40):
        base = [f"t{i}w{rng.randrange(1000)}" for _ in range(300)]
        for change in (None, 20, 250):
            words = list(base)
            if change is not None:
                words[change] = "new"
            texts.append(" ".join(words))
    docs = table(list(enumerate(texts)))
    classes = lambda: {r["id"]: r["root"] for r in simhash.similar_texts(docs).collect()}
    usual = classes()
    monkeypatch.setattr(simhash, "agreed", lambda rows: 13)
    longer = classes()
    assert len(set(usual.values())) == 40 and usual == longer


def test_local_components_take_links_in_parts():
    a, b = np.array([5, 4, 7]), np.array([4, 3, 8])
    once = graph.local_components(9, a, b)
    twice = graph.local_components(9, a[1:], b[1:], graph.local_components(9, a[:1], b[:1]))
    assert once.tolist() == twice.tolist() == [0, 1, 2, 3, 3, 3, 6, 7, 7]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(200, 260)]
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in [7, *range(200, 260)]} == {7}


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    roots = plain_components(prints, 4)
    least = {}
    for r, c in zip(rows, roots, strict=True):
        least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    found = {r["id"]: (r["w0"] % 2**64, r["component_id"]) for r in simhash.classes(docs).collect()}
    assert found == {r["doc_id"]: (p, least[c]) for r, p, c in zip(rows, prints, roots, strict=True)}


def test_edge_cases(table):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(3, None), (2, ""), (None, " \t\n"), (7, "one"), (7, "one"), (5, "ONE"), (9, long), (8, long + " tail"), (None, "Two words")]
    docs = table([(*r, "x", 1) for r in rows], "doc_id long, text string, rid string, `w0.x` int")
    found = sorted((-1 if r["id"] is None else r["id"], -1 if r["component_id"] is None else r["component_id"]) for r in simhash.classes(docs).collect())
    assert found == [(-1, -1), (-1, 2), (2, 2), (3, 2), (5, 5), (7, 5), (7, 5), (8, 8), (9, 8)]
    kept = simhash.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 5, 8]


def test_hot_tries_are_tiled(table, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        words = list(base)
        words[rng.randrange(400)] = "new"
        texts.append(" ".join(words))
    prints = [plain_fingerprint(t) for t in texts]
    assert len(set(prints)) > 10
    found = {r["id"]: r["component_id"] for r in simhash.classes(table(list(enumerate(texts)))).collect()}
    assert found == dict(enumerate(plain_components(prints, 4)))


def test_empty(table):
    assert simhash.classes(table([])).count() == 0
    assert simhash.dedup(table([])).count() == 0
