import random

import pytest

from threadmill.operators import greedy


def plain(rows):
    first, second, kept = set(), set(), []
    for at, a, b in sorted(rows):
        if a not in first and b not in second:
            first.add(a), second.add(b)
            kept.append((at, a, b))
    return kept


def some(rng, n, a, b):
    rows = [(i, rng.choice(["", "null", None, *(f"a{int(rng.paretovariate(0.8)) % a}" for _ in range(5))]), rng.randrange(b) if rng.random() > 0.05 else None) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rest", [0, 20, 100_000])
@pytest.mark.parametrize(("n", "a", "b"), [(300, 40, 60), (2000, 900, 900), (1, 3, 3)])
def test_pairs_equal_the_scan(spark, rest, n, a, b):
    rows = some(random.Random(n + rest), n, a, b)
    out = greedy.distinct_pairs(spark.createDataFrame(rows, "at long, x string, y int"), "x", "y", "at", rest).collect()
    assert sorted((r["at"], r["a"], r["b"]) for r in out) == plain(rows)


def test_chains_and_hot_keys(spark):
    chain = [(i, f"k{(i + 1) // 2}", i // 2) for i in range(60)]  # each edge shares a key with the one before
    hot = [(100 + i, "hot", 1000 + i) for i in range(3000)] + [(5000 + i, f"c{i}", 1000 + i) for i in range(0, 3000, 2)]
    df = spark.createDataFrame(chain + hot, "at long, x string, y int")
    expected = plain(chain + hot)
    for rest in (0, 100_000):
        assert sorted((r["at"], r["a"], r["b"]) for r in greedy.distinct_pairs(df, "x", "y", "at", rest).collect()) == expected
    assert greedy.distinct_pairs(df.where("at < 0"), "x", "y", "at").count() == 0
