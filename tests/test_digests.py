import random
from collections import Counter

from threadmill.operators import digests

SCHEMA = "id long, a string, b double"


def plain(old, new):
    out = {}
    for k in {r[0] for r in old + new}:
        x, y = Counter(r for r in old if r[0] == k), Counter(r for r in new if r[0] == k)
        if x != y:
            out[k] = "changed" if x and y else "removed" if x else "added"
    return out


def test_changes_equal_the_comparison_of_multisets(spark):
    rng = random.Random(3)
    old = [(i if i % 50 else None, rng.choice([None, "", "x", "y"]), rng.choice([None, 0.0, 1.5])) for i in range(400)]
    old += old[:60]
    new = [r for r in old if rng.random() > 0.03] + [(1000 + i, "n", None) for i in range(5)]
    new = [(r[0], "" if r[1] is None and rng.random() < 0.1 else r[1], r[2]) for r in new] + old[:3]
    rng.shuffle(new)
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    for buckets in (1, 64, 4096):
        assert {r["id"]: r["change"] for r in digests.changes(a, b, "id", buckets).collect()} == plain(old, new)
    assert digests.changes(a, a.repartition(7), "id").count() == 0
    assert digests.changes(a.limit(0), a.limit(0), "id").count() == 0


def test_digest_of_a_table(spark):
    rows = [(i, str(i), float(i)) for i in range(500)] * 2
    one = digests.whole(digests.digest(spark.createDataFrame(rows, SCHEMA), "id")).first()
    random.Random(1).shuffle(rows)
    other = spark.createDataFrame(rows, SCHEMA).repartition(5).select("b", "id", "a")
    assert digests.whole(digests.digest(other, "id", 8)).first() == one and one["n"] == 1000
    assert digests.whole(digests.digest(spark.createDataFrame(rows[1:], SCHEMA), "id")).first()["digest"] != one["digest"]
    assert digests.whole(digests.digest(other.limit(0), "id")).first()["n"] == 0
