"""Queries on classification metrics, model answers, entities and selection."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.operators import dataset, evaluation, models, runs
from threadmill.plans.adapters import documents, read, words_sql
from threadmill.plans.text_queries import _QUALITY
from threadmill.sources.scratch import scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAIR = ("bad", "good", "other")


def _predictions(spark, sf_dir):
    """The quality filter's verdict against the label; a third class that does not occur is in the matrix too."""
    d = dataset.quality(documents(spark, sf_dir)).join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("word_count") < 100, "bad").otherwise("good").alias("predicted"))


_PAIRS = f"{_QUALITY}, pairs as (select doc_id, case when quality = 1 then 'good' else 'bad' end as truth, case when word_count < 100 then 'bad' else 'good' end as predicted from judged join labels using (doc_id)), names as (select * from (values ('bad'), ('good'), ('other')) n(label))"
_MATRIX = f"{_PAIRS}, matrix as (select t.label as truth, p.label as predicted, count(x.doc_id) as n from names t cross join names p left join pairs x on x.truth = t.label and x.predicted = p.label group by all)"


@query(f"with {_MATRIX} select * from matrix")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_predictions(spark, sf_dir), PAIR)


_CLASSES = f"{_MATRIX}, classes as (select label, sum(case when truth = label then n else 0 end)::bigint as support, sum(case when predicted = label then n else 0 end) as said, sum(case when truth = label and predicted = label then n else 0 end) as r from matrix, names group by label)"


@query(f"with {_CLASSES} select label, support, case when said = 0 then 0 else r / said end::double as precision, case when support = 0 then 0 else r / support end::double as recall, case when said + support = 0 then 0 else 2.0 * r / (said + support) end::double as f1 from classes")
def classification_report(spark, sf_dir):
    return evaluation.per_class(evaluation.confusion(_predictions(spark, sf_dir), PAIR))


@query(f"with {_CLASSES} select round(sum(r) / sum(support), 9)::double as accuracy, round(avg(case when said + support = 0 then 0 else 2.0 * r / (said + support) end), 9)::double as macro_f1, sum(support)::bigint as n from classes")
def classification_summary(spark, sf_dir):
    return evaluation.summary(evaluation.confusion(_predictions(spark, sf_dir), PAIR)).select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"), "n")


@query(f"""with {_MATRIX} select truth as label, sum(n)::bigint as total, sum(case when truth <> predicted then n else 0 end)::bigint as error_count, round(case when sum(n) = 0 then 0 else sum(case when truth <> predicted then n else 0 end) / sum(n) end, 9)::double as error_rate,
    sum(case when predicted = 'bad' and truth <> 'bad' then n else 0 end)::bigint as predicted_as_bad, sum(case when predicted = 'good' and truth <> 'good' then n else 0 end)::bigint as predicted_as_good, sum(case when predicted = 'other' and truth <> 'other' then n else 0 end)::bigint as predicted_as_other from matrix group by truth""")
def error_summary(spark, sf_dir):
    return evaluation.error_summary(_predictions(spark, sf_dir), PAIR).withColumn("error_rate", F.round("error_rate", 9))


_SOFT = """soft as (select vec_id, label, list_transform(embedding[1:4], lambda x: exp(x::double - list_max(embedding[1:4])::double)) as e from embeddings),
probs as (select vec_id, label, list_transform(e, lambda x: x / list_sum(e)) as p from soft)"""


@query(f"with {_SOFT} select vec_id, (list_position(p, list_max(p)) - 1)::int as predicted, round(p[1], 6) as p0, round(p[2], 6) as p1, round(p[3], 6) as p2, round(p[4], 6) as p3 from probs")
def softmax_argmax(spark, sf_dir):
    p = evaluation.softmax(F.slice("embedding", 1, 4))
    out = read(spark, sf_dir, "embeddings").select("vec_id", p.alias("p"))
    return out.select("vec_id", evaluation.argmax("p").alias("predicted"), *(F.round(F.get("p", F.lit(i)), 6).alias(f"p{i}") for i in range(4)))


@query(f"with {_SOFT} select vec_id, ['bug', 'feature', 'docs', 'question'][list_position(p, list_max(p))] as predicted_label, round(list_max(p), 6) as confidence, 'row ' || vec_id as text_preview from probs where list_position(p, list_max(p)) - 1 <> label % 4")
def error_rows(spark, sf_dir):
    names = F.array(*map(F.lit, dataset.LABELS))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.get(names, F.col("label") % 4).alias("label"), F.concat(F.lit("row  "), F.col("vec_id").cast("string")).alias("text"), F.slice("embedding", 1, 4).alias("logits"))
    return evaluation.error_rows(rows).select("vec_id", "predicted_label", F.round("confidence", 6).alias("confidence"), "text_preview")


# Verdicts made of events: valid ones, fenced ones, and each way in which one can be wrong.
def _verdict(k, n):
    score = F.expr("cast(event_id % 5 + 1 as string)")
    body = F.concat(*(x for d in evaluation.DIMENSIONS for x in (F.lit(f'"{d}": '), F.when((k == 3) & F.lit(d == "overall"), "6").when((k == 4) & F.lit(d == "overall"), "true").when((k == 5) & F.lit(d == "overall"), "4.0").otherwise(score), F.lit(", "))))
    ending = F.when(k == 6, F.lit('"pass": "yes"')).when(k == 7, F.lit('"pass": true, "failure_reasons": ["no such reason"]')).when(k == 8, F.lit('"pass": true, "failure_reasons": ["ignores_question"]')).otherwise(F.lit('"pass": true'))
    whole = F.concat(F.lit("{"), body, ending, F.lit("}"))
    return F.when(k == 0, F.lit("no verdict")).when(k == 1, F.lit("[1, 2]")).when(k == 2, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)


_DIM = ", ".join(f"round(avg(case when k in (2, 8, 9) then event_id % 5 + 1 else 1 end), 9)::double as {d}" for d in evaluation.DIMENSIONS)


@query(f"select {_DIM}, round(avg(case when k in (2, 8, 9) then 1.0 else 0.0 end), 9)::double as pass_rate, count(*) as num_examples from (select event_id, event_id % 10 as k from events)")
def judge_aggregate(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", evaluation.parse_judge(_verdict(F.col("event_id") % 10, None)).alias("verdict"))
    m = evaluation.judge_means(rows)
    return m.select(*(F.round(d, 9).alias(d) for d in (*evaluation.DIMENSIONS, "pass_rate")), "num_examples")


_TYPES = "['bug', 'feature', 'docs', 'question']"
_RUN = f"run as (select event_id, {_TYPES}[(event_id % 4 + 1)::int] as true_label, {_TYPES}[((event_id // 3) % 4 + 1)::int] as predicted_label, case when event_id % 13 = 0 then 'timeout' else '' end as error, case when event_id % 17 = 0 then null else value end as latency_ms, event_id % 100 as input_tokens, event_id % 7 as output_tokens from events)"


@query(f"""with {_RUN}, ok as (select * from run where error = ''), names as (select unnest({_TYPES}) as label), per as (select label, count_if(true_label = label) as t, count_if(predicted_label = label) as s, count_if(true_label = label and predicted_label = label) as r from ok, names group by label)
    select count(*) as attempted, count_if(error = '')::bigint as successful, count_if(error <> '')::bigint as failed, round(avg(latency_ms), 6) as average_latency_ms, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(input_tokens + output_tokens)::bigint as total_tokens,
    round((select avg(case when true_label = predicted_label then 1.0 else 0.0 end) from ok), 9)::double as accuracy, round((select avg(case when s + t = 0 then 0 else 2.0 * r / (s + t) end) from per), 9)::double as macro_f1, round(sum(input_tokens) / 1000000.0 * 1 + sum(output_tokens) / 1000000.0 * 5, 9)::double as cost_usd from run""")
def llm_run_metrics(spark, sf_dir):
    names = F.array(*map(F.lit, dataset.LABELS))
    at = lambda k: F.get(names, (k % 4).cast("int"))
    rows = read(spark, sf_dir, "events").select(
        at(F.col("event_id")).alias("true_label"), at(F.expr("event_id div 3")).alias("predicted_label"), F.when(F.col("event_id") % 13 == 0, "timeout").otherwise("").alias("error"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("latency_ms"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"),
    )
    m = evaluation.llm_run_metrics(rows, input_price=1.0, output_price=5.0)
    return m.select("attempted", "successful", "failed", F.round("average_latency_ms", 6).alias("average_latency_ms"), "input_tokens", "output_tokens", "total_tokens", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"), F.round("cost_usd", 9).alias("cost_usd"))


@query("""select event_id, case when event_id % 4 in (0, 1) then (props->>'$.k')::bigint end as k, event_id % 4 = 1 as predicted_ok from events""")
def json_extract(spark, sf_dir):
    """Objects alone, in prose, cut short, and no object at all; and whether the same text is a valid prediction."""
    props, k = F.col("props"), F.col("event_id") % 4
    wrapped = F.concat(F.lit('Sure! {"label": "bug", "confidence": 0.5, "reason": "r", "k": '), F.get_json_object(props, "$.k"), F.lit("} Done."))
    text = F.when(k == 0, props).when(k == 1, wrapped).when(k == 2, F.concat(F.lit("["), props, F.lit("]"))).otherwise(F.concat(F.lit("broken {"), props))
    found = F.when(k == 2, F.lit(None).cast("variant")).otherwise(evaluation.json_object(text))
    rows = read(spark, sf_dir, "events")
    return rows.select("event_id", F.try_variant_get(found, "$.k", "bigint").alias("k"), evaluation.parse_prediction(text).isNotNull().alias("predicted_ok"))


_CAPS = "[A-Z][a-z]+"


@query(f"""with found as (select conv_id, turn, len(list_distinct(regexp_extract_all(text, '{_CAPS}')))::bigint as n from conversations) select conv_id, turn, least(n, 100) as entities from found""")
def entity_postprocess(spark, sf_dir):
    """Capitalised words as raw entities, each given twice, placed at their first occurrence."""
    c = read(spark, sf_dir, "conversations")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(_CAPS), F.lit(0)))
    raw = F.transform(F.concat(words, words), lambda w: F.struct(F.lit("B-MISC").alias("entity_group"), F.lit(None).cast("string").alias("entity"), F.lit(1.5).alias("score"), w.alias("word"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    placed = F.transform(raw, lambda e: F.struct(e["entity_group"].alias("entity_group"), e["entity"].alias("entity"), e["score"].alias("score"), e["word"].alias("word"), (F.instr(F.col("text"), e["word"]) - 1).alias("start"), (F.instr(F.col("text"), e["word"]) - 1 + F.length(e["word"])).alias("end")))
    return c.select("conv_id", "turn", F.size(evaluation.entities(placed, "text")).cast("long").alias("entities"))


@query(f"""with found as (select conv_id, least(len(list_distinct(regexp_extract_all(text, '{_CAPS}'))), 100) as n from conversations) select conv_id, 'MISC' as type, sum(n)::bigint as n from found group by conv_id having sum(n) > 0""")
def entity_type_counts(spark, sf_dir):
    """Entities of a conversation by type, all of one type here."""
    c = read(spark, sf_dir, "conversations")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(_CAPS), F.lit(0)))
    raw = F.transform(words, lambda w: F.struct(F.lit("I-MISC").alias("entity_group"), F.lit(None).cast("string").alias("entity"), F.lit(0.5).alias("score"), w.alias("word"), (F.instr(F.col("text"), w) - 1).alias("start"), (F.instr(F.col("text"), w) - 1 + F.length(w)).alias("end")))
    return evaluation.entity_counts(c.select("conv_id", evaluation.entities(raw, "text").alias("entities")), by=("conv_id",))


_LIMITS = (300, 20, 50, 100, 60, 150)


@query(f"""with recursive sized as (select len({words_sql('text')}) as n, quality = 1 as good from documents join labels using (doc_id)),
    counts as (select k, t, count_if(good and n >= t) as gg, count_if(good and n < t) as gb, count_if(not good and n >= t) as bg, count_if(not good and n < t) as bb from sized, (select unnest(range({len(_LIMITS)})) as k, unnest({list(_LIMITS)}) as t) group by k, t),
    scored as (select k, t, coalesce(2.0 * bb / nullif(2 * bb + gb + bg, 0), 0)::double as question_f1, coalesce(2.0 * gg / nullif(2 * gg + gb + bg, 0), 0)::double as good_f1 from counts),
    candidates as materialized (select k as ordinal, 'least_' || t as name, (question_f1 + good_f1) / 2 as macro_f1, question_f1, (t % 7)::double as ms, k % 3 as epochs, t as size from scored),
    walk as (select * from candidates where ordinal = 0 union all select c.ordinal, pick.name, pick.macro_f1, pick.question_f1, pick.ms, pick.epochs, pick.size from
        (select c.ordinal, case when c.macro_f1 > w.macro_f1 + 0.005 then c when w.macro_f1 > c.macro_f1 + 0.005 then w when c.question_f1 > w.question_f1 + 0.005 then c when w.question_f1 > c.question_f1 + 0.005 then w
            when (c.ms, c.epochs, c.size) < (w.ms, w.epochs, w.size) then c else w end as pick from walk w join candidates c on c.ordinal = w.ordinal + 1) c)
    select c.ordinal::int as ordinal, w.name, round(w.macro_f1, 9) as macro_f1 from walk w join candidates c using (name) where w.ordinal = {len(_LIMITS) - 1}""")
def experiment_select(spark, sf_dir):
    """Least sizes of a good text as candidates, each against the best so far: within the dead band the F1 of bad texts decides, then what is cheaper."""
    d = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").select(F.coalesce(tx.count_tokens("text"), F.lit(0)).alias("n"), (F.col("quality") == 1).alias("good"))
    limits = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(_LIMITS))))
    count = lambda good, long: F.count_if((F.col("good") == good) & ((F.col("n") >= F.col("t")) == long))
    counts = d.select("n", "good", limits.alias("x")).select("n", "good", "x.*").groupBy("k", "t").agg(count(True, True).alias("gg"), count(True, False).alias("gb"), count(False, True).alias("bg"), count(False, False).alias("bb"))
    f1 = lambda hit: F.coalesce(2.0 * F.col(hit) / F.nullif(2 * F.col(hit) + F.col("gb") + F.col("bg"), F.lit(0)), F.lit(0.0))
    table = counts.select(
        F.col("k").alias("ordinal"), F.concat(F.lit("least_"), F.col("t").cast("string")).alias("name"), ((f1("bb") + f1("gg")) / 2).alias("macro_f1"), f1("bb").alias("question_f1"),
        (F.col("t") % 7).cast("double").alias("ms_per_example"), (F.col("k") % 3).alias("epochs"), F.col("t").alias("max_length"),
    )
    return evaluation.select_experiment(table).select("ordinal", "name", F.round("macro_f1", 9).alias("macro_f1"))


@query()
def tfidf_logreg(spark, sf_dir):
    """Quality learned from every document whose id is not divisible by 5 and measured on the others."""
    rows = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    model = models.train(rows.where("doc_id % 5 <> 0"), vocabulary=5000, rounds=20)
    judged = model.predict(rows.where("doc_id % 5 = 0"))
    return evaluation.per_class(evaluation.confusion(judged, ("bad", "good"), "label", "predicted"))


_PROMPT = "Is the text good or bad?\n\n"


def _stand_in():
    """A classifier that needs no service: the number of characters decides what it says and how it fails. A passing error comes at every other call for a text."""
    waiting = set()

    def classify(prompt):
        n = len(prompt) - len(_PROMPT)
        if n % 13 == 0:
            raise ValueError("refused")
        if n % 11 == 0 and prompt not in waiting:
            waiting.add(prompt)
            raise runs.PassingCallError("busy")
        waiting.discard(prompt)
        return "no idea" if n % 17 == 0 else json.dumps({"label": "good" if n % 2 else "bad", "confidence": 0.5, "reason": "its size"}), n // 4, 12

    return classify


def _run(spark, sf_dir):
    """The labelled documents, and the store of a run over half of them that was then resumed over all."""
    d = documents(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("issue_id"), "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    store, prompt = f"{scratch(spark)}/run-{uuid.uuid4().hex}", F.concat(F.lit(_PROMPT), F.coalesce("text", F.lit("")))
    for part in (d.where("issue_id % 2 = 0"), d):
        runs.run(part, store, _stand_in(), prompt, "stand-in", _PROMPT, labels=PAIR)
    return d, store


_RUN = """asked as (select doc_id, case when quality = 1 then 'good' else 'bad' end as true_label, length(coalesce(text, '')) as n from documents join labels using (doc_id)),
answers as (select doc_id, true_label, n, case when n % 13 = 0 then 'refused' when n % 17 = 0 then 'the answer holds no prediction' end as error, case when n % 13 <> 0 then n // 4 end as input_tokens, case when n % 13 <> 0 then 12 end as output_tokens,
    case when n % 13 <> 0 and n % 17 <> 0 then case when n % 2 = 1 then 'good' else 'bad' end end as predicted_label, case when n % 13 <> 0 and n % 11 = 0 then 2 else 1 end as tries from asked)"""


@query(f"with {_RUN} select doc_id as issue_id, true_label, predicted_label, error, tries::int as tries, input_tokens::bigint as input_tokens, case when doc_id % 2 = 0 and error is null then 0 else 1 end::int as attempt from answers")
def classifier_run(spark, sf_dir):
    """The last row of each document: those that failed at first were asked again, those that were answered were not."""
    d, store = _run(spark, sf_dir)
    return runs.results(d, store, labels=PAIR).select("issue_id", "true_label", "predicted_label", "error", "tries", "input_tokens", "attempt")


@query(f"""with {_RUN}, ok as (select * from answers where error is null), f as (select l as label, count_if(true_label = l and predicted_label = l) as r, count_if(true_label = l) + count_if(predicted_label = l) as m from ok, (values ('bad'), ('good'), ('other')) t(l) group by l)
    select count(*) as attempted, count_if(error is null)::bigint as successful, count_if(error is not null)::bigint as failed, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
        (select avg((true_label = predicted_label)::int) from ok) as accuracy, (select avg(case when m > 0 then 2.0 * r / m else 0 end) from f) as macro_f1 from answers""")
def classifier_run_metrics(spark, sf_dir):
    d, store = _run(spark, sf_dir)
    return runs.metrics(d, store, labels=PAIR).select("attempted", "successful", "failed", "input_tokens", "output_tokens", "accuracy", "macro_f1")
