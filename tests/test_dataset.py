import json
import random

import pytest
from pyspark.sql import functions as F

from threadmill.operators import dataset as ds

ISSUE = "github_id long, title string, body string, labels array<string>, fetched_for_label string, fetched_for_github_label string, closed_at string"


def test_mapping_decisions(spark):
    at = "2025-01-01T00:00:00Z"
    rows = [
        (1, "t", "b", ["Kind:Bug", "kind:feature"], None, None, at), (2, "t", "b", ["kind:documentation", "kind:bug"], "question", None, at), (3, "t", "b", ["pending-response", "kind:bug"], "question", "Pending-Response", at),
        (4, "t", "b", ["x"], None, None, at), (5, " ", "<!-- -->", ["kind:bug"], None, None, at), (6, "t", "b", ["kind:bug"], None, None, None), (7, "t", "b", ["kind:bug"], "nope", None, at),
        (8, "t", "b", ["kind:bug"], "bug", "kind:feature", at), (9, "t", "b", None, "bug", "kind:bug", at), (10, "t", "b", ["kind:bug"], "", "", at),
    ]
    out = ds.map_issues(spark.createDataFrame(rows, ISSUE))
    found = {r["github_id"]: (r["label"], r["label_id"], r["reason"], r["conflict"]) for r in out.collect()}
    assert found[1] == ("bug", 0, None, True)
    assert found[2][2] == "missing_fetched_github_label" and found[3][:3] == ("question", 3, None)
    assert [found[i][2] for i in range(4, 10)] == ["unmapped_labels", "empty_title_and_body", "missing_closed_at", "invalid_fetched_for_label", "invalid_fetched_for_github_label", "missing_fetched_github_label"]
    assert found[10][0] == "bug"
    counts = {r["reason"]: r["n"] for r in ds.skip_counts(out).collect()}
    assert counts["multi_label_conflicts_resolved"] == 1 and counts["missing_fetched_github_label"] == 2
    assert [tuple(r) for r in ds.unmatched_labels(out, "github_id").collect()][:2] == [("kind:bug", 3), ("kind:documentation", 1)]
    assert {r["label"]: r["missing"] for r in ds.shortfalls(ds.class_counts(out.where("label is not null"))).collect()} == {"bug": 498, "feature": 500, "docs": 500, "question": 499}


def test_quality(spark):
    rows = [(1, "a proper text of more than five words", "bug"), (2, "short", "bug"), (3, "!!! ??? ... --- ,,, ;;; :::", None), (4, None, "docs"), (5, " Delete ", "docs")]
    out = ds.quality(spark.createDataFrame(rows, "id long, text string, label string"))
    assert {r["id"]: r["dropped"] for r in out.collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}
    assert {r["label"]: (r["kept"], r["dropped"]) for r in ds.drops_by_class(out).collect()} == {"bug": (1, 1), "(missing)": (0, 1), "docs": (0, 2)}


@pytest.mark.parametrize("n", [1, 2, 5, 11, 30])
def test_percentiles_round_half_to_even(spark, n):
    rng = random.Random(n)
    values = [rng.randrange(10) for _ in range(n)]
    r = ds.distribution(spark.createDataFrame([(v,) for v in values], "v long"), "v").first()
    at = lambda p: sorted(values)[round((n - 1) * p / 100)]
    assert [r[k] for k in ("min", "p5", "p25", "median", "p75", "p95", "max")] == [min(values), at(5), at(25), at(50), at(75), at(95), max(values)]


def plain_test(rows):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    cutoff = rows[len(rows) - max(1, round(0.2 * len(rows)))][1]
    return {r[0] for r in rows if r[1] >= cutoff}


@pytest.mark.parametrize("seed", range(3))
def test_temporal_split_keeps_equal_times_together(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"2025-01-{rng.randrange(1, 20):02d}", rng.choice("ab")) for i in range(70)]
    df = spark.createDataFrame(rows, "ordinal long, created_at string, label string")
    out = ds.temporal_test(df)
    expected = set().union(*(plain_test([r for r in rows if r[2] == k]) for k in "ab"))
    assert {r["ordinal"] for r in out.where("is_test").collect()} == expected
    ds.ensure_empty(ds.boundary_violations(out), "boundary")
    split = ds.train_validation(out.where("not is_test"), key="ordinal")
    for k in "ab":
        m = sum(r[2] == k and r[0] not in expected for r in rows)
        assert split.where((F.col("label") == k) & (F.col("split") == "validation")).count() == max(1, min(m - 1, round(0.25 * m)))
    with pytest.raises(ValueError, match="labels"):
        ds.ensure_empty(ds.missing_labels(split, ("a", "b", "c"), splits=("train",)), "labels")


def test_samples_and_checks(spark):
    rows = spark.createDataFrame([(i, "k" + str(i % 3), i * 10) for i in range(9)], "ordinal long, key string, v long")
    assert {(r["key"], r["v"], r["first_at"]) for r in ds.latest_per_key(rows, "key", "ordinal").collect()} == {("k0", 60, 0), ("k1", 70, 1), ("k2", 80, 2)}
    assert {(r["key"], r["v"]) for r in ds.first_per_key(rows, "key", "ordinal").collect()} == {("k0", 0), ("k1", 10), ("k2", 20)}
    assert ds.first_n_per_class(rows, 2, ["ordinal"], "key").count() == 6
    assert [r["ordinal"] for r in ds.without(rows, [rows.where("v < 50"), rows.where("v > 70")], "ordinal").orderBy("ordinal").collect()] == [5, 6, 7]
    assert ds.overlaps({"a": rows.where("ordinal < 3"), "b": rows.where("ordinal = 2")}, "ordinal").first()["places"] == "a,b"
    assert ds.repeated_keys(rows, "key").count() == 3
    assert ds.require_columns(spark.createDataFrame([(1, None), (2, "x")], "a long, b string"), ["a", "b"]).first()["missing"] == "b"
    with pytest.raises(ValueError):
        ds.require_columns(rows, ["nope"])
    with pytest.raises(ValueError):
        ds.golden(spark.createDataFrame([("bug", "text", 1, 1)], "label string, text string, number long, ordinal long"))


def test_holdout(spark):
    long, best = "word " * 90, "- step\n" + "word " * 90
    raw = spark.createDataFrame(
        [("1", [(long, "member")], 0), ("2", [(best, "CONTRIBUTOR")], 1), ("3", [(long, "COLLABORATOR")], 2), ("4", [("few words", "OWNER")], 3), ("1", [(long, "contributor")], 9), ("5", [(long, "OWNER")], 4)],
        "issue_id string, comments array<struct<body:string,author_association:string>>, ordinal long",
    )
    mapped = spark.createDataFrame([(str(i), i) for i in range(1, 6)], "issue_id string, number long")
    out = ds.holdout(mapped, raw, spark.createDataFrame([("5",)], "issue_id string"))
    assert [(r["issue_id"], r["score"]) for r in out.collect()] == [("2", 591), ("1", 90)]
    with pytest.raises(ValueError):
        ds.holdout(mapped, raw, mapped.select("issue_id"), least=1)


def test_labels_as_objects_and_mapping_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("kind:bug",), (None,)]), (2, None)], "id int, labels array<struct<name:string>>")
    assert {r["id"]: r["n"] for r in rows.select("id", ds.labels_of(rows).alias("n")).collect()} == {1: ["kind:bug"], 2: None}
    text = spark.createDataFrame([('["a", {"name": "b"}, 1, {"name": null}]',), (None,), ("{}",)], "labels string")
    assert [r["n"] for r in text.select(ds.labels_of(text).alias("n")).collect()] == [["a", "b"], [], []]
    good = {"bug": ["Kind:Bug "], "feature": {"github_labels": ["f"]}, "docs": ["d"], "question": ["q"]}
    for name, value in {"good": good, "twice": {**good, "docs": ["kind:bug"]}, "blank": {**good, "docs": [" "]}, "list": [1], "less": {"bug": ["x"]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    assert ds.load_mapping(spark, str(tmp_path / "good.json")) == {"bug": ("kind:bug",), "feature": ("f",), "docs": ("d",), "question": ("q",)}
    for name in ("twice", "blank", "list", "less"):
        with pytest.raises(ValueError):
            ds.load_mapping(spark, str(tmp_path / f"{name}.json"))


def test_labelled_split_and_prefixes(spark):
    rows = spark.createDataFrame([("bug", 0, "a  b", "doc:1"), ("docs", 2, "c", "provider:2")], "label string, label_id int, text string, source_id string")
    assert [r["text"] for r in ds.labelled_split(rows).orderBy("label").collect()] == ["a b", "c"]
    with pytest.raises(ValueError):
        ds.labelled_split(rows.withColumn("label_id", F.lit(1)))
    assert [r["source_id"] for r in ds.forbidden_prefixes(rows, ("provider:", "x")).collect()] == ["provider:2"]


def test_splits_are_described_as_they_are_written(spark, tmp_path):
    rows = [(i, "bug" if i % 3 else "docs", f"2024-01-{i % 28 + 1:02d}", "test" if i % 5 == 0 else "train") for i in range(200)]
    df = spark.createDataFrame(rows, "issue_id long, label string, created_at string, split string")
    out = ds.write_splits(df, str(tmp_path / "a"), labels=("bug", "docs"), splits=("train", "test", "none")).collect()
    found = {(r["split"], r["label"]): (r["n"], r["first_at"], r["last_at"]) for r in out}
    for s in ("train", "test", "none"):
        for k in ("bug", "docs"):
            own = [r[2] for r in rows if (r[1], r[3]) == (k, s)]
            assert found[s, k] == (len(own), min(own, default=None), max(own, default=None))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 200
    assert sum(r["share"] for r in out) == pytest.approx(1)
    again = ds.write_splits(df.repartition(7), str(tmp_path / "b"), labels=("bug", "docs"), splits=("train", "test", "none")).collect()
    assert [r["digest"] for r in again] == [r["digest"] for r in out]
    other = ds.write_splits(df.where("issue_id <> 1"), str(tmp_path / "c"), labels=("bug", "docs"), splits=("train", "test", "none")).collect()
    assert {r["split"] for r, x in zip(out, other, strict=True) if r["digest"] != x["digest"]} == {"train"}
    with pytest.raises(ValueError, match="unknown split or label"):
        ds.write_splits(df, str(tmp_path / "d"), labels=("bug",), splits=("train", "test"))
