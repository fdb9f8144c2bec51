import json
import os

import pytest
from pyspark.sql import functions as F

from threadmill.operators import runs

LABELS = ("bug", "docs")


def answer(label="bug"):
    return json.dumps({"label": label, "confidence": 0.5, "reason": "why"}), 10, 2


def examples(spark, n):
    return spark.range(n).select(F.col("id").alias("issue_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("bug").alias("label")).repartition(3)


def noting(folder, classify):
    """classify, with a file for each call, so that calls in other processes can be counted."""

    def call(prompt):
        k = prompt.split()[-1]
        open(os.path.join(folder, f"{k}-{len([f for f in os.listdir(folder) if f.startswith(k + '-')])}"), "w").close()
        return classify(int(k))

    return call


def calls(folder):
    found = {}
    for f in os.listdir(folder):
        found[int(f.split("-")[0])] = found.get(int(f.split("-")[0]), 0) + 1
    return found


def test_completed_rows_are_not_asked_again(spark, tmp_path):
    store, notes = str(tmp_path / "store"), tmp_path / "notes"
    notes.mkdir()
    run = lambda n, **k: runs.run(examples(spark, n), store, noting(notes, lambda i: answer()), F.col("text"), "m", labels=LABELS, **k)
    assert run(1) == {"selected_examples": 1, "requested_this_run": 1, "resume_skipped_completed": 0}
    assert run(2) == {"selected_examples": 2, "requested_this_run": 1, "resume_skipped_completed": 1}
    assert calls(notes) == {0: 1, 1: 1}
    rows = {r["issue_id"]: r for r in runs.results(examples(spark, 3), store, labels=LABELS).collect()}
    assert set(rows) == {0, 1} and rows[0]["attempt"] == 0 and rows[1]["attempt"] == 1 and rows[1]["model"] == "m"
    assert runs.metrics(examples(spark, 2), store, labels=LABELS).first()["attempted"] == 2
    assert run(2, resume=False)["requested_this_run"] == 2
    assert {r["attempt"] for r in runs.results(examples(spark, 2), store, labels=LABELS).collect()} == {2}


def test_errors_are_rows_and_passing_ones_are_tried_again(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()

    def classify(i):
        if i == 1:
            raise ValueError("refused")
        if i == 2 or i == 3 and calls(notes)[3] < 3:
            raise runs.PassingCallError("busy")
        return answer("other") if i == 4 else answer()

    store = str(tmp_path / "store")
    assert runs.run(examples(spark, 6), store, noting(notes, classify), F.col("text"), "m", tries=3, labels=LABELS)["requested_this_run"] == 6
    rows = {r["issue_id"]: (r["predicted_label"], r["error"], r["tries"]) for r in runs.results(examples(spark, 6), store, labels=LABELS).collect()}
    assert rows == {0: ("bug", None, 1), 1: (None, "refused", 1), 2: (None, "busy", 3), 3: ("bug", None, 3), 4: (None, runs.UNREADABLE, 1), 5: ("bug", None, 1)}
    assert runs.run(examples(spark, 6), store, noting(notes, lambda i: answer()), F.col("text"), "m", labels=LABELS) == {"selected_examples": 6, "requested_this_run": 3, "resume_skipped_completed": 3}
    assert all(r["error"] is None for r in runs.results(examples(spark, 6), store, labels=LABELS).collect())
    assert runs.log(spark, store).count() == 9


def test_a_fatal_error_ends_the_run_and_keeps_what_was_answered(spark, tmp_path):
    store, notes = str(tmp_path / "store"), tmp_path / "notes"
    notes.mkdir()

    def classify(i):
        if len(os.listdir(notes)) > 8:
            raise runs.FatalCallError("key rejected")
        return answer()

    with pytest.raises(runs.FatalCallError, match="key rejected"):
        runs.run(examples(spark, 200).coalesce(1), store, noting(notes, classify), F.col("text"), "m", labels=LABELS)
    asked = calls(notes)
    kept = runs.results(examples(spark, 200), store, labels=LABELS).collect()
    assert len(kept) == 8 and all(r["error"] is None for r in kept)
    assert len(asked) < 8 + 20  # each task stops at its first fatal error
    out = runs.run(examples(spark, 200), store, lambda p: answer(), F.col("text"), "m", labels=LABELS)
    assert out == {"selected_examples": 200, "requested_this_run": 192, "resume_skipped_completed": 8}


def test_a_killed_run_neither_loses_nor_repeats_rows(spark, tmp_path):
    store, notes = str(tmp_path / "store"), tmp_path / "notes"
    notes.mkdir()
    part = {r["issue_id"]: r["k"] for r in examples(spark, 60).select("issue_id", F.pmod(F.xxhash64("issue_id"), F.lit(4)).alias("k")).collect()}
    assert set(part.values()) == {0, 1, 2, 3}

    def classify(i):
        if part[i] == 2:
            os._exit(1)  # the worker is gone in the middle of the third slice
        return answer()

    with pytest.raises(Exception):  # noqa: B017
        runs.run(examples(spark, 60), store, noting(notes, classify), F.col("text"), "m", slices=4, labels=LABELS)
    before = calls(notes)
    assert {i for i in before if part[i] < 2} == {i for i in part if part[i] < 2}
    assert {r["issue_id"] for r in runs.log(spark, store).collect()} == {i for i in part if part[i] < 2}
    out = runs.run(examples(spark, 60), store, noting(notes, lambda i: answer()), F.col("text"), "m", slices=4, labels=LABELS)
    assert out["resume_skipped_completed"] == sum(k < 2 for k in part.values())
    rows = [r["issue_id"] for r in runs.log(spark, store).collect()]
    assert sorted(rows) == list(range(60))
    assert all(n == 1 for i, n in calls(notes).items() if part[i] < 2)


def test_no_examples(spark, tmp_path):
    none = examples(spark, 3).where("issue_id < 0")
    assert runs.run(none, str(tmp_path / "s"), lambda p: answer(), F.col("text"), "m", labels=LABELS)["requested_this_run"] == 0
    assert runs.results(none, str(tmp_path / "other"), labels=LABELS).count() == 0
