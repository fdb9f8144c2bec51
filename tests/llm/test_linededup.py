import random
from collections import defaultdict

import pytest

from threadmill.llm import linededup
from tests.llm.conftest import TINY


def plain(rows, least):
    """Lines to delete per row: those of every run of enough words that also starts at an earlier place."""
    lines = [(t.split("\n") if t is not None else []) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0, r))
    seen, gone = set(), defaultdict(set)
    for r in order:
        for a in range(len(lines[r])):
            n = 0
            for b in range(a, len(lines[r])):
                n += len(lines[r][b].encode().split())
                if n >= least:
                    key = tuple(lines[r][a : b + 1])
                    if key in seen:
                        gone[r] |= set(range(a, b + 1))
                    seen.add(key)
    return ["\n".join(x for i, x in enumerate(own) if i not in gone[r]) if rows[r][1] is not None else None for r, own in enumerate(lines)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(table, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))) for _ in range(12)]
    rows = []
    for i in range(40):
        own = [rng.choice(pool) for _ in range(rng.randrange(1, 14))]
        if rows and rng.random() < 0.5:
            own += rng.choice(rows)[1].split("\n")[: rng.randrange(1, 9)]
        rows.append((i, "\n".join(own)))
    docs = table(rows)
    found = {r["doc_id"]: r["text"] for r in linededup.line_dedup(docs, 8).collect()}
    assert found == {i: t for (i, _), t in zip(rows, plain(rows, 8), strict=True)}


def test_documents(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    out = linededup.line_dedup(docs).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: t for (i, _), t in zip(rows, plain(rows, 50), strict=True)}
    assert any(r["__removed"] for r in out)
    for r in out:
        assert r["__removed"] == sum(x["end"] - x["start"] for x in r["__runs"])


def test_edge_cases(table):
    run = " ".join(f"w{i}" for i in range(30)) + "\n" + " ".join(f"v{i}" for i in range(30))
    long = "\n".join(f"line {i} of many" for i in range(5000))
    rows = [(5, run), (2, "own line\n" + run + "\nlast"), (2, "own line\n" + run + "\nlast"), (None, run), (7, None), (8, ""), (9, "\n\n"), (10, long), (11, long + "\nmore")]
    docs = table([(i, t, "keep", 1, 2) for i, t in rows], "doc_id long, text string, pos string, a int, runs int")
    found = linededup.dedup(docs)
    assert found.columns == docs.columns
    # The repeated row 2 has no word of its own lines beyond the run, but "own line" and "last" are too short to go alone.
    texts = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"]) for r in found.collect() if r["text"] is not None)
    assert texts == sorted([(2, "own line\n" + run + "\nlast"), (8, ""), (9, "\n\n"), (10, long), (11, "more")])
    assert linededup.line_dedup(table([])).count() == 0


def test_periodic_text_keeps_one_period(table):
    period = ["a b c d e", "f g h i j"]
    out = linededup.line_dedup(table([(1, "\n".join(period * 10))]), 10).collect()
    assert out[0]["text"] == "\n".join(period)
