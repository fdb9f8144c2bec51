"""Queries on text functions, quality and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.operators import dataset
from threadmill.plans import adapters as ad
from threadmill.plans.adapters import NSP, SP, collapse_sql, documents, read, strip_sql, tidy_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(rf"""select doc_id, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::bigint as words_a,
    len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_''-]*'))::bigint as words_b, len(regexp_extract_all(text, '{NSP}+'))::bigint as words_c from documents""")
def word_counts(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.count_words("text").cast("long").alias("words_a"), tx.count_words_joined("text").cast("long").alias("words_b"), tx.count_tokens("text").cast("long").alias("words_c"))


@query("select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::bigint as tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::bigint as terms from documents")
def token_counts(spark, sf_dir):
    t = tx.search_tokens("text")
    return documents(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("terms"))


@query(f"select doc_id, length({tidy_sql('text')})::bigint as chars, md5({tidy_sql('text')}) as digest from documents")
def normalize_text(spark, sf_dir):
    t = tx.normalize_text("text")
    return documents(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


_CLEAN = tidy_sql(f"regexp_replace(concat_ws(chr(10) || chr(10), nullif({strip_sql('url')}, ''), nullif({strip_sql('html')}, '')), '(?s)<!--.*?-->', ' ', 'g')")


@query(f"select page_id, length({_CLEAN})::bigint as chars, md5(nullif({_CLEAN}, '')) as digest from pages")
def clean_text(spark, sf_dir):
    t = tx.clean_text("url", "html")
    return read(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


@query(f"select label, count(*) as n from (select {collapse_sql('lower(p_type)')} as label from part) group by label")
def label_normalize(spark, sf_dir):
    return read(spark, sf_dir, "part").select(tx.normalize_label("p_type").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


_FLAT = collapse_sql("text")
_CUT = f"{strip_sql('text')}[1:160]"


@query(f"""select doc_id, flat[1:80] as first_80, case when length(flat) <= 500 then flat else flat[1:497] || '...' end as preview,
    case when length(flat) <= 500 then flat else regexp_replace(flat[1:497], '{SP}+$', '') || '...' end as preview_trimmed,
    case when length(bare) <= 160 then bare else regexp_replace(case when instr(cut, ' ') > 1 then cut[1:length(cut) - instr(reverse(cut), ' ')] else cut end, '{SP}+$', '') || ' ...' end as trimmed,
    md5(case when length(bare) <= 12000 then bare else bare[1:11920] || chr(10) || chr(10) || '[Issue text truncated for classification.]' end) as prompt_digest
    from (select doc_id, {_FLAT} as flat, {strip_sql('text')} as bare, {_CUT} as cut from documents)""")
def previews(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", tx.first_80("text").alias("first_80"), tx.preview("text").alias("preview"), tx.preview_trimmed("text").alias("preview_trimmed"),
        tx.trim_at_space("text", 160).alias("trimmed"), F.md5(tx.cap_for_prompt("text")).alias("prompt_digest"),
    )


_QUALITY = rf"""quality as (select doc_id, lang, length(bare)::bigint as char_count, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'))::bigint as word_count,
    bare <> '' and not regexp_matches(bare, '[A-Za-z0-9]') as only_punct, bare from (select *, {strip_sql('text')} as bare from documents)),
judged as (select *, char_count < 20 or word_count < 5 or only_punct or lower(bare) in ('.', '.' || chr(10) || chr(10) || '.', '..', 'n/a', 'na', 'test', 'delete') as dropped from quality)"""


@query(f"with {_QUALITY} select doc_id, char_count, word_count, only_punct, dropped from judged")
def quality_flags(spark, sf_dir):
    return dataset.quality(documents(spark, sf_dir)).select("doc_id", "char_count", "word_count", "only_punct", "dropped")


@query(f"with {_QUALITY} select coalesce(lang, '(missing)') as label, count_if(not dropped)::bigint as kept, count_if(dropped)::bigint as dropped from judged group by 1")
def quality_drop_by_class(spark, sf_dir):
    return dataset.drops_by_class(dataset.quality(documents(spark, sf_dir)), "lang")


_RANK = {"p5": 5, "p25": 25, "median": 50, "p75": 75, "p95": 95}
_AT = ", ".join(f"v[round_even((len(v) - 1) * {p} / 100.0, 0)::bigint + 1] as {k}" for k, p in _RANK.items())


@query(f"with {_QUALITY}, v as (select lang, list_sort(list(char_count)) as v from judged group by lang) select lang, len(v)::bigint as n, v[1] as min, {_AT}, v[-1] as max from v")
def length_distribution(spark, sf_dir):
    return dataset.distribution(dataset.quality(documents(spark, sf_dir)), "char_count", ["lang"])


# Issues made of documents: every third one was fetched for a label, and labels come from language and source.
MAPPING = {"bug": ("en", "src1"), "feature": ("fr", "src2"), "docs": ("de",), "question": ("es", "src3")}
_ISSUES = """issues as (select doc_id, [' ' || upper(lang), source] as labels, text as body,
    case doc_id % 6 when 0 then 'bug' when 3 then 'nonsense' end as fetched, case when doc_id % 12 = 0 then 'src1' end as fetched_source,
    case when doc_id % 10 = 0 then null else '2025-01-01T00:00:00Z' end as closed_at from documents),
mapping as (select * from (values ('bug', 0, 'en'), ('bug', 0, 'src1'), ('feature', 1, 'fr'), ('feature', 1, 'src2'), ('docs', 2, 'de'), ('question', 3, 'es'), ('question', 3, 'src3')) m(target, label_id, source_label)),
own as (select doc_id, trim(lower(unnest(labels))) as label from issues),
matched as (select doc_id, min(label_id) as label_id, count(distinct target) as targets from own join mapping on label = source_label group by doc_id),
reasons as (select i.doc_id, m.label_id, m.targets, fetched,
    case when closed_at is null then 'missing_closed_at' when fetched = 'nonsense' then 'invalid_fetched_for_label'
        when fetched = 'bug' and fetched_source is not null and not exists (select 1 from own o where o.doc_id = i.doc_id and o.label = fetched_source) then 'missing_fetched_github_label'
        when fetched = 'bug' and fetched_source is null and not exists (select 1 from own o where o.doc_id = i.doc_id and o.label in ('en', 'src1')) then 'missing_fetched_github_label'
        when fetched is null and m.label_id is null then 'unmapped_labels' when trim(coalesce(body, '')) = '' then 'empty_title_and_body' end as reason
    from issues i left join matched m using (doc_id)),
mapped as (select doc_id, reason, case when reason is null then coalesce(fetched, ['bug', 'feature', 'docs', 'question'][label_id + 1]) end as label,
    reason is null and fetched is null and targets > 1 as conflict from reasons)"""


def _issues(spark, sf_dir):
    d = documents(spark, sf_dir)
    return dataset.map_issues(d.select(
        "doc_id", F.array(F.concat(F.lit(" "), F.upper("lang")), F.col("source")).alias("labels"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"),
        F.when(F.col("doc_id") % 6 == 0, "bug").when(F.col("doc_id") % 6 == 3, "nonsense").alias("fetched_for_label"), F.when(F.col("doc_id") % 12 == 0, "src1").alias("fetched_for_github_label"),
        F.when(F.col("doc_id") % 10 != 0, "2025-01-01T00:00:00Z").alias("closed_at"),
    ), MAPPING)


@query(f"with {_ISSUES} select doc_id, label, reason, conflict from mapped")
def label_priority_map(spark, sf_dir):
    return _issues(spark, sf_dir).select("doc_id", "label", "reason", "conflict")


@query(f"with {_ISSUES} select reason, count(*) as n from (select reason from mapped where reason is not null union all select 'multi_label_conflicts_resolved' from mapped where conflict) group by reason")
def skip_reasons(spark, sf_dir):
    return dataset.skip_counts(_issues(spark, sf_dir))


@query(f"with {_ISSUES} select label, 500::bigint as target, n as usable, 500 - n as missing from (select k.label, count(m.label) as n from (values ('bug'), ('feature'), ('docs'), ('question')) k(label) left join mapped m using (label) group by k.label) where n < 500")
def class_shortfalls(spark, sf_dir):
    return dataset.shortfalls(dataset.class_counts(_issues(spark, sf_dir)))


@query(f"with {_ISSUES} select label, count(*) as n from own join mapped using (doc_id) where reason is not null and reason not in ('missing_closed_at', 'empty_title_and_body') group by own.label".replace("select label, count", "select own.label, count"))
def label_histogram(spark, sf_dir):
    return dataset.unmatched_labels(_issues(spark, sf_dir), "doc_id")


@query("select doc_id, coalesce(regexp_matches(text, '(?m)^[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]*([-*]|\\p{Nd}+[.)])[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]+') or contains(text, '```'), false) as structured, doc_id % 5 in (1, 2) as maintainer, 'doc:' || doc_id || ':parent:0:child:1' as child_id from documents")
def scalar_predicates(spark, sf_dir):
    role = F.element_at(F.array(*map(F.lit, ("none", "Member", "owner", "NONE", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.coalesce(tx.is_structured("text"), F.lit(False)).alias("structured"), tx.is_maintainer(role).alias("maintainer"), tx.doc_child_id("doc_id", F.lit(0), F.lit(1)).alias("child_id"))


@query(f"select item_id, md5(text || chr(31) || array_to_string(list_transform(range(3), lambda i: {strip_sql('text')} || ' variant ' || i), chr(31))) as digest from benchmark")
def query_expansion(spark, sf_dir):
    q = F.col("text")
    raw = F.concat_ws("\n", *(F.concat(F.lit(f"{i + 1}. \""), F.regexp_replace(tx.strip(q), "\n", "\x1e"), F.lit(f" variant {i}\"")) for i in range(3)), F.lit(""), F.lit("- "))
    rewrites = F.transform(tx.parse_rewrites(raw, 3), lambda r: F.regexp_replace(r, "\x1e", "\n"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(tx.expand_queries(q, rewrites), "\x1f")).alias("digest"))
