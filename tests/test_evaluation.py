import json
import math
import time

import pytest
from pyspark.sql import functions as F

from threadmill.operators import evaluation as ev
from threadmill.operators import models


def test_confusion_and_f1(spark):
    rows = spark.createDataFrame([("bug", "bug"), ("bug", "feature"), ("docs", "docs"), ("question", "bug")], "truth string, predicted string")
    m = ev.confusion(rows)
    assert m.count() == 16
    s = ev.summary(m).first()
    assert (s["accuracy"], s["macro_f1"]) == (0.5, 0.375)
    assert {r["label"]: r["f1"] for r in ev.per_class(m).collect()} == {"bug": 0.5, "docs": 1.0, "feature": 0.0, "question": 0.0}
    e = {r["label"]: r for r in ev.error_summary(rows).collect()}
    assert e["bug"]["error_rate"] == 0.5 and e["bug"]["predicted_as_feature"] == 1 and e["feature"]["error_rate"] == 0.0
    assert ev.summary(ev.confusion(rows.limit(0))).first()["accuracy"] == 0.0


def test_softmax_and_error_rows(spark):
    rows = spark.createDataFrame([(1, "question", "a  text", [5.0, 1.0, 1.0, 4.0]), (2, "bug", "x", [2.0, 2.0, 0.0, 0.0])], "id long, label string, text string, logits array<double>")
    out = ev.error_rows(rows).collect()
    assert [(r["id"], r["predicted_label"], r["text_preview"]) for r in out] == [(1, "bug", "a text")]
    assert out[0]["confidence"] == pytest.approx(math.e**5 / (math.e**5 + 2 * math.e + math.e**4))


GOOD = {d: 4 for d in ev.DIMENSIONS} | {"pass": True}
VERDICTS = [
    (json.dumps(GOOD), True), ("```json\n" + json.dumps(GOOD) + "\n```", True), (json.dumps(GOOD | {"failure_reasons": []}), True), (json.dumps(GOOD | {"failure_reasons": ["ignores_question"]}), True), ("```\n" + json.dumps(GOOD), True),
    ("no json", False), ("[1]", False), (json.dumps(GOOD | {"overall": 6}), False), (json.dumps(GOOD | {"overall": 4.0}), False), (json.dumps(GOOD | {"overall": True}), False), (json.dumps({k: v for k, v in GOOD.items() if k != "overall"}), False),
    (json.dumps(GOOD | {"pass": "true"}), False), (json.dumps(GOOD | {"failure_reasons": ["other"]}), False), (json.dumps(GOOD | {"failure_reasons": "ignores_question"}), False), (json.dumps(GOOD | {"failure_reasons": None}), False), ("", False),
]


def test_verdicts_fail_closed(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(VERDICTS)], "id long, raw string").select("id", ev.parse_judge("raw").alias("verdict"))
    for r in df.collect():
        ok = VERDICTS[r["id"]][1]
        assert r["verdict"]["pass"] is ok and all(r["verdict"][d] == (4 if ok else 1) for d in ev.DIMENSIONS), VERDICTS[r["id"]]
    m = ev.judge_means(df).first()
    assert m["num_examples"] == len(VERDICTS) and m["pass_rate"] == pytest.approx(5 / len(VERDICTS))
    assert ev.judge_means(df.limit(0)).first()["overall"] == 0.0
    mock = spark.range(1).select(ev.parse_judge(ev.mock_verdict(F.lit("c"))).alias("a"), ev.parse_judge(ev.mock_verdict(F.lit(""))).alias("b")).first()
    assert (mock["a"]["overall"], mock["a"]["pass"], mock["b"]["overall"], mock["b"]["pass"]) == (5, True, 2, False)


ANSWERS = [
    ('{"label": "bug", "confidence": 0.5, "reason": " why  so "}', ("bug", 0.5, "why so")), ('Sure: {"label": "docs", "confidence": 1, "reason": "r"} ok', ("docs", 1.0, "r")), ('{"label": "bugs", "confidence": 0.5, "reason": "r"}', None),
    ('{"label": "bug", "confidence": true, "reason": "r"}', None), ('{"label": "bug", "confidence": "0.5", "reason": "r"}', None), ('{"label": "bug", "confidence": 1.5, "reason": "r"}', None), ('{"label": "bug", "confidence": 0.5, "reason": " "}', None),
    ('[{"label": "bug"}]', None), ("} {", None), ("", None), (None, None),
]


def test_answers(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(ANSWERS)], "id long, a string").select("id", ev.parse_prediction("a").alias("p"))
    assert {r["id"]: tuple(r["p"]) if r["p"] else None for r in df.collect()} == {i: p for i, (_, p) in enumerate(ANSWERS)}


def test_run_metrics_and_cache(spark):
    rows = spark.createDataFrame([("a", "bug", "bug", None, 10.0, 10, 2, 0), ("b", "docs", "bug", "", 20.0, 10, 2, 1), ("c", "docs", None, "boom", None, 5, 1, 2)], "issue_id string, true_label string, predicted_label string, error string, latency_ms double, input_tokens long, output_tokens long, ordinal long")
    m = ev.llm_run_metrics(rows, input_price=1.0, output_price=5.0).first()
    assert (m["successful"], m["failed"], m["accuracy"], m["total_tokens"], m["average_latency_ms"]) == (2, 1, 0.5, 30, 15.0)
    assert m["cost_usd"] == pytest.approx(0.00005)
    assert ev.llm_run_metrics(rows.where("ordinal = 2")).first()["accuracy"] is None
    assert ev.llm_run_metrics(rows).first()["cost_usd"] is None
    dataset = rows.select("issue_id")
    found, why = ev.cached_predictions(dataset, rows)
    assert found is None and "2/3" in why
    found, why = ev.cached_predictions(dataset.where("issue_id <> 'c'"), rows)
    assert why == "" and {r["issue_id"]: r["cached_label"] for r in found.collect()} == {"a": "bug", "b": "bug"}


def test_entities(spark):
    raw = [("B-PER", None, 1.7, "w", 0, 3), ("PER", "x", -1.0, "w", 0, 3), ("PER", None, 0.5, "w", 0, 3), (None, "I-ORG", 0.2, "word", 3, 4), ("LOC", None, 0.1, "w", 5, 5), ("LOC", None, 0.1, "w", 2, 99), (None, None, 0.1, "w", 0, 1), ("LOC", None, 0.1, " ", 3, 4)]
    df = spark.createDataFrame([("Ann in", raw)], "text string, e array<struct<entity_group:string,entity:string,score:double,word:string,start:int,end:int>>")
    out = df.select(ev.entities("e", "text").alias("e")).first()["e"]
    assert [(x["text"], x["type"], x["start"], x["end"], x["confidence"]) for x in out] == [("Ann", "PER", 0, 3, 1.0), ("word", "ORG", 3, 4, 0.2)]
    assert len(df.select(ev.entities("e", "text", 1).alias("e")).first()["e"]) == 1


def test_gates(spark):
    metrics = spark.createDataFrame([("accuracy", 0.6), ("macro_f1", 0.4)], "metric string, value double")
    checks = ev.threshold_checks(metrics, {"accuracy": 0.5, "macro_f1": 0.45, "required": True, "absent": 0.1})
    assert {r["metric"]: r["passed"] for r in checks.collect()} == {"accuracy": True, "macro_f1": False, "absent": False}
    assert ev.gate(checks).first()["status"] == "fail"
    assert tuple(ev.gate(checks, required=False).first()) == (False, True, "optional_fail")
    assert (ev.skipped(True), ev.skipped(False)) == (("fail", False), ("skipped", True))
    best = spark.createDataFrame([(0, 0.3), (1, 0.5), (2, 0.5)], "position int, hit_at_5 double")
    assert ev.best_variant(best).first()["position"] == 1


def plain_select(rows):
    best = rows[0]
    for new in rows[1:]:
        for f in ("macro_f1", "question_f1"):
            if abs(new[f] - best[f]) > 0.005:
                best = new if new[f] > best[f] else best
                break
        else:
            cost = lambda r: (r["ms_per_example"], r["epochs"], r["max_length"])
            best = new if cost(new) < cost(best) else best
    return best["name"]


def test_selection(spark):
    import random

    schema = "ordinal int, name string, macro_f1 double, question_f1 double, ms_per_example double, epochs int, max_length int"
    for seed in range(8):
        rng = random.Random(seed)
        rows = [(i, f"n{i}", round(0.7 + rng.randrange(5) * 0.003, 4), round(0.5 + rng.randrange(5) * 0.003, 4), float(rng.randrange(3)), rng.randrange(2), 128) for i in range(6)]
        df = spark.createDataFrame(rows, schema)
        assert ev.select_experiment(df).first()["name"] == plain_select([r.asDict() for r in df.orderBy("ordinal").collect()])
    rows = spark.createDataFrame([("a", 0.7, 5.0), ("b", 0.8, 9.0), ("c", 0.8, None)], "name string, macro_f1 double, latency_ms_per_example double")
    assert ev.deployment_choice(rows).first()["name"] == "b" and ev.deployment_choice(rows, "a").first()["name"] == "a"


def test_requests(spark):
    rows = spark.createDataFrame([("ok", 50), (" ", 5), (None, None)], "text string, max_length int")
    assert [len(r["errors"]) for r in ev.request_errors(rows, bounds={"max_length": (10, 512)}).collect()] == [0, 2, 1]


def test_classifier_learns(spark):
    rows = [(i, f"crash error stack number {i}", "bug") for i in range(20)] + [(i, f"please add support number {i}", "feature") for i in range(20, 40)]
    df = spark.createDataFrame(rows, "id long, text string, label string")
    model = models.train(df, vocabulary=100, rounds=30)
    out = model.predict(df).collect()
    assert all(r["predicted"] == r["label"] for r in out)
    assert model.idf.min() >= 1.0


def test_model_gates(spark):
    said = [("a", x, x) for x in ("bug", "docs", "feature", "question")] + [("b", "bug", "docs"), ("b", "bug", "bug")]
    rows = spark.createDataFrame(said, "model string, truth string, predicted string")
    wanted = {"a": {"accuracy": 0.9, "macro_f1": 0.9}, "b": {"accuracy": 0.9, "macro_f1": 0.9, "required": False}, "c": {"accuracy": 0.5}, "d": {"accuracy": 0.5, "required": False}}
    out = {r["model"]: (r["status"], r["gate_passed"], r["accuracy"]) for r in ev.model_gates(rows, wanted).collect()}
    assert out == {"a": ("pass", True, 1.0), "b": ("optional_fail", True, 0.5), "c": ("fail", False, None), "d": ("skipped", True, None)}


def test_comparison(spark):
    rows = spark.createDataFrame([("x", 0.5, 0.4, 1.0, 2_161_404, 370, None), ("y", 0.6, 0.6, 2.0, None, 40, "balanced"), ("z", None, None, None, None, 0, "full")], "name string, accuracy double, macro_f1 double, latency_ms_per_example double, size_bytes long, num_examples long, sampling_mode string")
    out = [(r["name"], r["rank"], r["size_mb"], r["scope"]) for r in ev.comparison(rows).orderBy("rank").collect()]
    assert out == [("y", 1, None, "balanced sample of 40 rows"), ("x", 2, 2.16, "all 370 rows"), ("z", 3, None, "all 0 rows")]


def test_many_entities_of_a_text_take_no_square_of_time(spark):
    words = [f"W{i}" for i in range(3000)]
    text = " ".join(words)
    raw = F.transform(F.array(*[F.split(F.lit(text), " ")] * 2), lambda a: F.transform(a, lambda w, i: F.struct(F.lit("B-PER").alias("entity_group"), F.lit(None).cast("string").alias("entity"), F.lit(0.5).alias("score"), w.alias("word"), i.alias("start"), (i + 1).alias("end"))))
    started = time.monotonic()
    out = spark.range(1).select(ev.entities(F.flatten(raw), F.lit(text), 5000).alias("e")).first()["e"]
    assert [(x["start"], x["end"]) for x in out] == [(i, i + 1) for i in range(len(words))]
    assert time.monotonic() - started < 30  # each pair compared, and cleaned again for it, takes minutes


@pytest.mark.parametrize("texts", [1, 500])
def test_terms_are_counted_as_spark_counts_them(spark, monkeypatch, texts):
    from pyspark.ml.feature import CountVectorizer

    monkeypatch.setattr(models, "TEXTS", texts)
    rows = spark.createDataFrame([("Red apple, red pear",), ("a red apple x",), ("",), ("pear \u00e9t\u00e9 pear pear",)], "text string")
    found = {r["term"]: (r["n"], r["df"]) for r in models.term_counts(rows, "text").collect()}
    assert found["red"] == (3, 2) and found["red apple"] == (2, 2) and found["pear"] == (4, 2) and found["pear pear"] == (1, 1)
    terms = models._terms(rows, "text")
    assert {t for t, (_, df) in found.items() if df >= 2} == set(CountVectorizer(inputCol="__terms", outputCol="c", minDF=2).fit(terms).vocabulary)


def test_training_keeps_no_words_of_all_texts(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    held, cache = [], DataFrame.cache
    monkeypatch.setattr(DataFrame, "cache", lambda self: held.append(self.columns) or cache(self))
    models.train(spark.createDataFrame([("crash stack", "bug"), ("crash dump", "bug"), ("add this", "feature"), ("add that", "feature")], "text string, label string"), vocabulary=10, rounds=5)
    assert held == [["features", "__y", "weight"]]
