"""Classification metrics, parsing of model answers, gates and selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.operators.dataset import LABELS


def confusion(rows: DataFrame, labels=LABELS, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(truth, predicted, n) for all pairs of labels, zeros included."""
    grid = rows.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    counts = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(grid).join(counts, ["truth", "predicted"], "left").na.fill(0, ["n"])


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion table; what is undefined is 0."""
    sums = matrix.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("right")),
    )).alias("x")).groupBy("x.label").agg(F.sum("x.actual").alias("support"), F.sum("x.said").alias("said"), F.sum("x.right").alias("right"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return sums.select("label", "support", share(F.col("right"), F.col("said")).alias("precision"), share(F.col("right"), F.col("support")).alias("recall"), share(2.0 * F.col("right"), F.col("said") + F.col("support")).alias("f1"))


def summary(matrix: DataFrame) -> DataFrame:
    """(accuracy, macro_f1, n): macro_f1 is the plain mean over all labels, also those that do not occur."""
    right = matrix.agg(F.coalesce(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n"))) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("accuracy"), F.sum("n").alias("n"))
    return right.join(F.broadcast(per_class(matrix).agg(F.avg("f1").alias("macro_f1")))).select("accuracy", "macro_f1", "n")


def softmax(logits: Column | str) -> Column:
    logits = tx.col(logits)
    powers = tx.let(F.array_max(logits).cast("double"), lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)))
    return tx.let(powers, lambda p: tx.let(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(p, lambda x: x / total)))


def argmax(values: Column | str) -> Column:
    """The place, from 0, of the first largest."""
    return (F.array_position(tx.col(values), F.array_max(tx.col(values))) - 1).cast("int")


def error_rows(rows: DataFrame, labels=LABELS, logits: str = "logits") -> DataFrame:
    """The misclassified of rows(label, text, logits): with predicted_label, confidence, probabilities and text_preview."""
    names = F.array(*map(F.lit, labels))
    out = rows.withColumn("probabilities", softmax(logits))
    out = out.withColumns({"predicted_label": F.get(names, argmax("probabilities")), "confidence": F.array_max("probabilities"), "text_preview": tx.preview_trimmed("text")})
    return out.where(F.col("predicted_label") != F.col("label")).withColumn("probabilities", F.map_from_arrays(names, F.col("probabilities")))


def error_summary(rows: DataFrame, labels=LABELS, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """(label, total, error_count, error_rate, predicted_as_<label>...); error_rate is 0 where there is no row."""
    matrix = confusion(rows, labels, truth, predicted)
    wrong = F.sum(F.when(F.col("truth") != F.col("predicted"), F.col("n")).otherwise(0))
    return matrix.groupBy(F.col("truth").alias("label")).agg(
        F.sum("n").alias("total"), wrong.alias("error_count"), F.coalesce(wrong / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("error_rate"),
        *(F.sum(F.when((F.col("predicted") == k) & (F.col("truth") != k), F.col("n")).otherwise(0)).alias(f"predicted_as_{k}") for k in labels),
    )


# --- answers of models ----------------------------------------------------------------------------------------------


def json_object(text: Column | str) -> Column:
    """The JSON object in a text, as a variant: the whole text, else what lies between its first { and last }; null if neither is an object."""

    def pick(bare):
        start, end = F.instr(bare, "{"), F.length(bare) - F.instr(F.reverse(bare), "}") + 1
        inner = F.when((start > 0) & (F.instr(bare, "}") > 0) & (end > start), F.substring(bare, start, end - start + 1))
        return F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))

    return tx.let(tx.let(tx.strip(text), pick), lambda out: F.when(F.schema_of_variant(out).startswith("OBJECT"), out))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _number(value: Column) -> Column:
    return _kind(value).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")


def _field(obj: Column, name: str) -> Column:
    return F.try_variant_get(obj, f"$.{name}", "variant")


def parse_prediction(text: Column | str, labels=LABELS) -> Column:
    """struct(label, confidence, reason) of a model's answer; null unless the label is known, the confidence a number from 0 to 1 and the reason not blank."""

    def read(obj):
        label, confidence, reason = (_field(obj, n) for n in ("label", "confidence", "reason"))
        value = F.try_variant_get(obj, "$.confidence", "double")
        said, why = F.try_variant_get(obj, "$.label", "string"), F.try_variant_get(obj, "$.reason", "string")
        ok = (_kind(label) == "STRING") & said.isin(*labels) & _number(confidence) & value.between(0.0, 1.0) & (_kind(reason) == "STRING") & (tx.strip(why) != "")
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(said.alias("label"), value.alias("confidence"), tx.preview(why, 240).alias("reason")))

    return tx.let(json_object(text), read)


# What a judge scores, and the reasons that it may give.
DIMENSIONS = ("faithfulness", "answer_relevancy", "context_usefulness", "completeness", "refusal_quality", "overall")
FAILURE_REASONS = ("unsupported_claims", "context_contradiction", "ungrounded_generic", "confident_when_insufficient", "ignores_question", "relies_on_unretrieved")


def parse_judge(raw: Column | str, reasons: tuple[str, ...] = FAILURE_REASONS) -> Column:
    """struct(six scores, pass): whole scores from 1 to 5, a boolean pass and only known failure reasons; anything else is all ones and a fail."""
    score = lambda obj, d: F.try_variant_get(obj, f"$.{d}", "bigint")

    def verdict(obj):
        tests = [(_kind(_field(obj, d)) == "BIGINT") & score(obj, d).between(1, 5) for d in DIMENSIONS]
        given = _field(obj, "failure_reasons")
        known = F.size(F.array_except(F.try_variant_get(obj, "$.failure_reasons", "array<string>"), F.array(*map(F.lit, reasons)))) == 0
        tests += [_kind(_field(obj, "pass")) == "BOOLEAN", F.when(given.isNull(), True).otherwise((_kind(given) == "ARRAY<VOID>") | (_kind(given) == "ARRAY<STRING>") & known)]
        ok = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
        return tx.let(ok, lambda ok: F.struct(*(F.when(ok, score(obj, d)).otherwise(1).cast("int").alias(d) for d in DIMENSIONS), F.when(ok, F.try_variant_get(obj, "$.pass", "boolean")).otherwise(False).alias("pass")))

    def unfenced(bare):
        inside = F.regexp_replace(F.regexp_replace(bare, r"\A```[^\n]*(?:\n|\z)", ""), r"(?:^|\n)[ \t]*```[ \t]*\z", "")
        return F.try_parse_json(tx.strip(F.when(bare.startswith("```"), inside).otherwise(bare)))

    return tx.let(tx.let(tx.let(tx.strip(raw), unfenced), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)), verdict)


def judge_means(verdicts: DataFrame, column: str = "verdict") -> DataFrame:
    return verdicts.agg(*(F.coalesce(F.avg(f"{column}.{d}"), F.lit(0.0)).alias(d) for d in DIMENSIONS), F.coalesce(F.avg(F.col(f"{column}.pass").cast("int")), F.lit(0.0)).alias("pass_rate"), F.count(F.lit(1)).alias("num_examples"))


def mock_verdict(context: Column | str) -> Column:
    score = F.when(F.coalesce(tx.col(context), F.lit("")) != "", 5).otherwise(2)
    return F.to_json(F.struct(*((F.lit(5) if d == "refusal_quality" else score).alias(d) for d in DIMENSIONS), (score == 5).alias("pass"), F.array().cast("array<string>").alias("failure_reasons"), F.lit("mock verdict").alias("short_rationale")))


def mock_answer(context: Column | str) -> Column:
    return F.concat(F.lit("Based on the retrieved context: "), F.substring(tx.col(context), 1, 200))


def is_success(predicted: Column | str, error: Column | str, labels=LABELS) -> Column:
    return F.coalesce(tx.col(predicted).isin(*labels), F.lit(False)) & (F.coalesce(tx.col(error), F.lit("")) == "")


def cost_usd(input_tokens: Column, output_tokens: Column, input_price: float | None, output_price: float | None) -> Column:
    """Null when either price per million is not known."""
    return (input_tokens / 1_000_000.0) * F.lit(input_price).cast("double") + (output_tokens / 1_000_000.0) * F.lit(output_price).cast("double")


def llm_run_metrics(rows: DataFrame, labels=LABELS, input_price: float | None = None, output_price: float | None = None) -> DataFrame:
    """One row over prediction logs(true_label, predicted_label, error, latency_ms, input_tokens, output_tokens). Accuracy and F1 are over successes, null without any."""
    done = rows.withColumn("ok", is_success("predicted_label", "error", labels))
    total = done.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"), F.avg("latency_ms").alias("average_latency_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    quality = summary(confusion(done.where("ok"), labels, "true_label", "predicted_label")).select(F.when(F.col("n") > 0, F.col("accuracy")).alias("accuracy"), F.when(F.col("n") > 0, F.col("macro_f1")).alias("macro_f1"))
    return total.join(F.broadcast(quality)).withColumns({"total_tokens": F.col("input_tokens") + F.col("output_tokens"), "cost_usd": cost_usd(F.col("input_tokens"), F.col("output_tokens"), input_price, output_price)})


def cached_predictions(dataset: DataFrame, cache: DataFrame, ordinal: str = "ordinal", labels=LABELS) -> tuple[DataFrame | None, str]:
    """dataset with the last successful cached prediction of each issue_id; None and the reason if any is missing."""
    last = cache.where(is_success("predicted_label", "error", labels)).groupBy("issue_id").agg(F.max_by("predicted_label", ordinal).alias("cached_label"))
    joined = dataset.join(last, "issue_id", "left")
    r = joined.agg(F.count(F.lit(1)).alias("n"), F.count("cached_label").alias("have")).first()
    return (joined, "") if r["n"] == r["have"] else (None, f"cached predictions cover {r['have']}/{r['n']} examples")


# --- entities -------------------------------------------------------------------------------------------------------


def entities(raw: Column | str, source: Column | str, most: int = 100) -> Column:
    """Clean entities of an array of raw ones (entity_group, entity, score, word, start, end) over the text that they came from.

    Type without B- or I-, places within the text, the text at the place (the given word if that is blank), confidence within 0..1;
    repeats out, in the order of start and type, at most so many.
    """
    source = tx.col(source)
    kind = lambda e: F.coalesce(F.nullif(e["entity_group"], F.lit("")), e["entity"])
    placed = F.filter(tx.col(raw), lambda e: kind(e).isNotNull() & (e["start"] >= 0) & (e["end"] > e["start"]) & (e["end"] <= F.length(source)))
    clean = F.transform(placed, lambda e: F.struct(
        e["start"].alias("start"), F.regexp_replace(F.regexp_replace(kind(e), "^B-", ""), "^I-", "").alias("type"), e["end"].alias("end"),
        F.coalesce(F.nullif(tx.strip(F.substring(source, e["start"] + 1, e["end"] - e["start"])), F.lit("")), tx.strip(F.coalesce(e["word"], F.lit("")))).alias("text"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["score"], F.lit(0.0)))).alias("confidence"),
    ))
    fields = lambda e, i, *names: F.struct(*(i.alias("i") if c == "i" else e[c].alias(c) for c in names))
    key = ("start", "type", "end", "text")
    numbered = F.sort_array(F.transform(F.filter(clean, lambda e: e["text"] != ""), lambda e, i: fields(e, i, *key, "i", "confidence")))
    # Sorted, repeats are neighbours. An expression that a lambda names is evaluated for each element, so the array is bound first.
    same = lambda e, before: F.coalesce(reduce(lambda a, c: a & (e[c] == before[c]), key[1:], e["start"] == before["start"]), F.lit(False))
    first = tx.let(numbered, lambda rows: F.filter(rows, lambda e, j: (j == 0) | ~same(e, F.get(rows, j - 1))))
    in_order = F.sort_array(F.transform(first, lambda e: fields(e, e["i"], "start", "type", "i", "end", "text", "confidence")))
    return F.transform(F.slice(in_order, 1, most), lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"), e["start"].alias("start"), e["end"].alias("end"), e["confidence"].alias("confidence")))


def entity_counts(found: DataFrame, cleaned: str = "entities", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., type, n) of the entities in a column as made by ``entities``, in the order of type."""
    return found.select(*by, F.explode(cleaned).alias("e")).groupBy(*by, F.col("e.type").alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, "type")


# --- gates and selection --------------------------------------------------------------------------------------------


def threshold_checks(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, actual, threshold, passed) of metrics(metric, value); a metric that is missing does not pass."""
    wanted = metrics.sparkSession.createDataFrame([(k, float(v)) for k, v in thresholds.items() if k != "required" and isinstance(v, int | float)], "metric string, threshold double")
    return wanted.join(metrics, "metric", "left").select("metric", F.col("value").alias("actual"), "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed"))


def gate(checks: DataFrame, required: bool = True) -> DataFrame:
    """(metrics_passed, gate_passed, status): a model that is not required may fail without closing the gate."""
    passed = F.coalesce(F.bool_and("passed"), F.lit(True))
    return checks.agg(passed.alias("metrics_passed")).select("metrics_passed", (F.col("metrics_passed") | F.lit(not required)).alias("gate_passed"), F.when(F.col("metrics_passed"), "pass").when(F.lit(required), "fail").otherwise("optional_fail").alias("status"))


def skipped(required: bool) -> tuple[str, bool]:
    """Status and gate of a model that could not be judged."""
    return ("fail", False) if required else ("skipped", True)


def model_gates(predictions: DataFrame, thresholds: dict[str, dict[str, float]], labels=LABELS) -> DataFrame:
    """(model, accuracy, macro_f1, n, status, gate_passed) for each model of thresholds, from predictions(model, truth, predicted).

    A model's thresholds name accuracy and macro_f1, and whether it is required (it is unless they say not). A model without
    predictions was not judged: failed if it is required, else skipped.
    """
    spark, out = predictions.sparkSession, None
    for name, wanted in thresholds.items():
        required = bool(wanted.get("required", True))
        one = summary(confusion(predictions.where(F.col("model") == name), labels))
        metrics = one.where("n > 0").select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1")))).alias("m")).select("m.*")
        judged = gate(threshold_checks(metrics, wanted), required)
        status, passed = skipped(required)
        row = one.join(F.broadcast(judged)).select(
            F.lit(name).alias("model"), F.when(F.col("n") > 0, F.col("accuracy")).alias("accuracy"), F.when(F.col("n") > 0, F.col("macro_f1")).alias("macro_f1"), "n",
            F.when(F.col("n") > 0, F.col("status")).otherwise(status).alias("status"), F.when(F.col("n") > 0, F.col("gate_passed")).otherwise(F.lit(passed)).alias("gate_passed"),
        )
        out = row if out is None else out.unionByName(row)
    return spark.createDataFrame([], "model string, accuracy double, macro_f1 double, n long, status string, gate_passed boolean") if out is None else out


def comparison(reports: DataFrame, sampled: str = "sampling_mode") -> DataFrame:
    """reports(name, accuracy, macro_f1, latency_ms_per_example, size_bytes, num_examples, sampling_mode) as rows to be read side by side.

    Added are rank (by macro_f1, then accuracy, then name; models without results last), size_mb, and the scope of the evaluation in words.
    """
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("macro_f1"), F.desc_nulls_last("accuracy"), "name"))  # a handful of models
    scope = F.when(F.coalesce(F.col(sampled), F.lit("full")) == "full", F.concat(F.lit("all "), F.col("num_examples").cast("string"), F.lit(" rows"))).otherwise(F.concat(F.col(sampled), F.lit(" sample of "), F.col("num_examples").cast("string"), F.lit(" rows")))
    return reports.withColumns({"rank": rank, "size_mb": F.round(F.col("size_bytes") / 1e6, 2), "scope": scope})


def best_variant(reports: DataFrame, order: str = "position") -> DataFrame:
    """The row with the highest hit_at_5, of equal ones the first."""
    return reports.orderBy(F.desc("hit_at_5"), F.asc(order)).limit(1)


DEAD_BAND = 0.005


def select_experiment(candidates: DataFrame, order: str = "ordinal", band: float = DEAD_BAND) -> DataFrame:
    """The winner of candidates(ordinal, name, macro_f1, question_f1, ms_per_example, epochs, max_length), each against the best so far in turn.

    A lead within the dead band is no lead, so the outcome depends on the order: it is a fold, over an array of what is a handful of rows.
    """
    fields = ["macro_f1", "question_f1", "ms_per_example", "epochs", "max_length", "name"]
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    ahead = lambda a, b, f: a[f] > b[f] + band
    cheaper = lambda a, b: F.struct(a["ms_per_example"], a["epochs"], a["max_length"]) < F.struct(b["ms_per_example"], b["epochs"], b["max_length"])

    def better(new, old):
        return F.when(ahead(new, old, "macro_f1"), True).when(ahead(old, new, "macro_f1"), False).when(ahead(new, old, "question_f1"), True).when(ahead(old, new, "question_f1"), False).otherwise(cheaper(new, old))

    pick = F.aggregate("rows", F.get(F.col("rows"), F.lit(0)), lambda best, new: F.when(better(new, best), new).otherwise(best))
    return candidates.groupBy().agg(rows.alias("rows")).where(F.size("rows") > 0).select(pick.alias("best")).select("best.*")


def deployment_choice(rows: DataFrame, preferred: str = "classical_ml") -> DataFrame:
    """The preferred model if it is there, else the highest macro_f1, then the lowest latency."""
    return rows.orderBy(F.desc(F.col("name") == preferred), F.desc(F.coalesce("macro_f1", F.lit(0.0))), F.coalesce("latency_ms_per_example", F.lit(float("inf"))), "name").limit(1)


def request_errors(rows: DataFrame, text: str = "text", most_chars: int = 200_000, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """rows with ``errors``: blank or overlong texts, and columns out of their bounds (nulls take the default and are fine)."""
    tests = [F.when(F.coalesce(tx.strip(text), F.lit("")) == "", F.lit("text is blank")), F.when(F.length(text) > most_chars, F.lit("text is too long"))]
    tests += [F.when(~F.col(c).between(lo, hi), F.lit(f"{c} must be from {lo} to {hi}")) for c, (lo, hi) in (bounds or {}).items()]
    return rows.withColumn("errors", F.filter(F.array(*tests), lambda e: e.isNotNull()))
