import zlib
from collections import defaultdict

import pytest

from threadmill.llm import sharding
from tests.llm.conftest import TINY


def check(rows, texts, shards=8):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for r in by.values():
        assert sorted(x["slot"] for x in r) == list(range(len(r)))
    assert set(by) <= set(range(shards))
    return {k: sum(x["size"] for x in v) for k, v in by.items()}


def test_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.shard_by_bytes(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    where = {}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert where.setdefault(data, r["shard"]) == r["shard"]
    sizes = check(rows, texts)
    groups = defaultdict(int)
    for t in texts.values():
        groups[t] += len(t.encode()) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(groups.values())


def test_edge_cases(table):
    rows = [(1, None), (None, "ä"), (3, ""), (3, ""), (4, "x" * 100_000), *((i, "same") for i in range(10, 40)), (5, None)]
    docs = table([(*r, "k", 0) for r in rows], "doc_id long, text string, key string, shard int")
    got = sharding.shard_by_bytes(docs).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    check(got, None)
    assert len({r["shard"] for r in got if r["size"] == 5 and r["doc_id"] >= 10}) == 1
    assert len([r for r in got if r["shard"] == next(x["shard"] for x in got if x["size"] == 100_001)]) == 1


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(None, None)]])
def test_tiny(table, rows):
    assert sharding.shard_by_bytes(table(rows)).count() == len(rows)
