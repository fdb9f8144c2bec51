"""Queries on samples, carve-outs, splits, corpora and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadmill.functions import text as tx
from threadmill.operators import corpus, dataset, digests
from threadmill.plans import adapters as ad
from threadmill.plans.adapters import CHUNKS_SQL, LANGS, SP, documents, read, strip_sql, words_sql
from threadmill.sources import lines, store, tables
from threadmill.sources.scratch import scratch

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_QUOTAS = {"en": 7, "de": 6, "fr": 7, "es": 5}
_CUES = {"en": ("the", "tion", "ing"), "de": ("ung", "heit"), "fr": ("eau", "eux"), "es": ("mente", "ción")}
_SIGNAL = " ".join(
    f"when '{k}' then " + " + ".join(f"(case when contains(title, '{c}') then 8 else 0 end) + (case when contains(opening, '{c}') then 3 else 0 end)" for c in v) for k, v in _CUES.items()
)


@query(rf"""with parts as (select doc_id, lang, {strip_sql("split_part(text, chr(10), 1)")} as title0,
        array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\n{SP}*\n'), lambda p: {strip_sql('p')} <> '')[1:2], lambda p: {strip_sql('p')}), chr(10) || chr(10)) as opening0 from documents),
    scored as (select doc_id, lang, len(regexp_extract_all(opening0, '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_''-]*'))::bigint as opening_words, lower(title0) as title, lower(opening0) as opening from parts),
    final as (select doc_id, lang as label, (case lang {_SIGNAL} end + case when starts_with(title, lang || ':') or starts_with(title, lang || ' -') then 20 else 0 end + greatest(0, 220 - opening_words))::bigint as score, opening_words from scored)
    select label, doc_id, score, opening_words from final qualify row_number() over (partition by label order by score desc, opening_words, doc_id) <= case label when 'en' then 7 when 'de' then 6 when 'fr' then 7 else 5 end""")
def signal_score_topn(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("lang").alias("label"), "text", F.col("doc_id").alias("number"), F.col("doc_id").alias("ordinal"))
    return dataset.golden(rows, _QUOTAS, strict=False, cues=_CUES).select("label", "doc_id", "score", "opening_words")


def _threads(spark, sf_dir):
    """Issue threads: turn 0 is the body, what the assistant says is a maintainer's comment."""
    c = read(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "assistant", F.when(F.col("turn") % 4 == 1, "MEMBER").otherwise("contributor")).otherwise("NONE")
    return c.select("conv_id", "turn", "text", role.alias("association"))


_THREADS = "threads as (select conv_id, turn, text, case when role = 'assistant' then case when turn % 4 = 1 then 'MEMBER' else 'contributor' end else 'NONE' end as association from conversations)"
_B = r"[\p{L}\p{N}_][\p{L}\p{N}_''-]*"


@query(rf"""with {_THREADS}, scored as (select conv_id, max(len(regexp_extract_all(text, '{_B}')) + case when contains(text, '```') or regexp_matches(text, '(?m)^{SP}*([-*]|\p{{Nd}}+[.)]){SP}+') then 500 else 0 end
        + case when association = 'MEMBER' then 50 else 0 end)::bigint as score from threads where upper(association) in ('MEMBER', 'OWNER', 'CONTRIBUTOR') and len(regexp_extract_all(text, '{_B}')) >= 80 and conv_id % 7 <> 0 group by conv_id)
    select conv_id as issue_id, score from scored order by score desc, conv_id desc limit 100""")
def holdout_topk(spark, sf_dir):
    threads = _threads(spark, sf_dir)
    raw = threads.groupBy(F.col("conv_id").alias("issue_id")).agg(F.collect_list(F.struct(F.col("text").alias("body"), F.col("association").alias("author_association"))).alias("comments"), F.max("conv_id").alias("ordinal"))
    mapped = threads.select(F.col("conv_id").alias("issue_id"), F.col("conv_id").alias("number")).distinct()
    return dataset.holdout(mapped, raw, mapped.where("issue_id % 7 = 0").select("issue_id")).select("issue_id", "score")


@query("select doc_id from documents where doc_id % 7 <> 0 and doc_id % 11 <> 0")
def carve_out_pool(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id")
    return dataset.without(d, [d.where("doc_id % 7 = 0"), d.where("doc_id % 11 = 0")], "doc_id")


@query("with t as (select doc_id, 'golden' as place from documents where doc_id % 7 = 0 union all select doc_id, 'holdout' from documents where doc_id % 11 = 0) select doc_id, count(*) as n, string_agg(distinct place, ',' order by place) as places from t group by doc_id having count(*) > 1")
def disjointness_violations(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id")
    return dataset.overlaps({"golden": d.where("doc_id % 7 = 0"), "holdout": d.where("doc_id % 11 = 0")}, "doc_id")


@query("select lang, doc_id, row_number() over (partition by lang order by doc_id)::int as rank from documents qualify rank <= 25")
def balanced_sample(spark, sf_dir):
    return dataset.first_n_per_class(documents(spark, sf_dir).select("lang", "doc_id"), 25, [F.asc("doc_id")], "lang")


@query("select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, min(event_id) as first_at from events where user_id is not null group by user_id")
def latest_per_key(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return dataset.latest_per_key(e, "user_id", "event_id").select("user_id", "event_id", "event_type", "first_at")


@query("select user_id, min(event_id) as event_id, arg_min(event_type, event_id) as event_type from events where user_id is not null group by user_id")
def first_per_key(spark, sf_dir):
    return dataset.first_per_key(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("""with done as (select user_id from events qualify row_number() over (partition by user_id order by event_id desc) = 1 and event_type <> 'error')
    select e.user_id, count(*) as n from events e where e.user_id not in (select user_id from done) group by e.user_id""")
def resume_pending(spark, sf_dir):
    """What is still to do: keys whose last row is no success (an anti join)."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    done = dataset.latest_per_key(e, "user_id", "event_id").where("event_type <> 'error'").select("user_id")
    return e.join(done, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def _split_events(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), F.col("ts").alias("created_at"))
    return dataset.temporal_test(e, ordinal="event_id")


_TEMPORAL = """ranked as (select event_id, event_type as label, ts as created_at, row_number() over (partition by event_type order by ts, event_id) as rn, count(*) over (partition by event_type) as n from events),
cuts as (select label, max(created_at) filter (where rn = n - greatest(1, round_even(0.2 * n, 0)::bigint) + 1) as cutoff, any_value(n) as n from ranked group by label),
split as (select r.event_id, r.label, r.created_at, r.created_at >= c.cutoff as is_test from ranked r join cuts c using (label))"""


@query(f"with {_TEMPORAL} select label, is_test, count(*) as n from split group by all")
def temporal_split_counts(spark, sf_dir):
    return _split_events(spark, sf_dir).groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_TEMPORAL} select label, is_test, epoch_us(min(created_at)) as first_us, epoch_us(max(created_at)) as last_us, count(*) as n from split group by all")
def temporal_bounds(spark, sf_dir):
    out = dataset.time_bounds(_split_events(spark, sf_dir), ["label", "is_test"])
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("label", "is_test", us("first_at").alias("first_us"), us("last_at").alias("last_us"), "n")


@query(f"""with {_TEMPORAL}, planted as (select label, created_at, is_test <> (event_id % 997 = 5 and label in ('click', 'error')) as is_test from split)
    select label, epoch_us(max(created_at) filter (where not is_test)) as last_train_us, epoch_us(min(created_at) filter (where is_test)) as first_test_us from planted group by label having last_train_us >= first_test_us""")
def temporal_violations(spark, sf_dir):
    """Some rows of two labels are on the wrong side of the cut."""
    wrong = (F.col("event_id") % 997 == 5) & F.col("label").isin("click", "error")
    found = dataset.boundary_violations(_split_events(spark, sf_dir).withColumn("is_test", F.col("is_test") != wrong))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("label", us("last_train").alias("last_train_us"), us("first_test").alias("first_test_us"))


@query(f"""with recursive edges as (select a, b, min(doc_id) as pos from (select doc_id, w[1] as a, w[2] as b from (select doc_id, {words_sql('text')} as w from documents)) group by a, b),
    ordered as materialized (select a, b, pos, row_number() over (order by pos) as i from edges),
    walk as (select 0::bigint as i, []::varchar[] as seen_a, []::varchar[] as seen_b, null::bigint as pos
        union all select o.i, case when fresh then list_append(seen_a, coalesce(a, '')) else seen_a end, case when fresh then list_append(seen_b, coalesce(b, '')) else seen_b end, case when fresh then o.pos end
        from (select w.seen_a, w.seen_b, o.*, not list_contains(seen_a, coalesce(a, '')) and not list_contains(seen_b, coalesce(b, '')) as fresh from walk w join ordered o on o.i = w.i + 1) o)
    select pos as doc_id, (row_number() over (order by pos) - 1)::int as unit_no from walk where pos is not null""")
def greedy_distinct(spark, sf_dir):
    """Documents in order, each kept if both its first and its second word are new among the documents kept before."""
    w = documents(spark, sf_dir).withColumn("w", tx.words("text"))
    units = w.select("doc_id", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
    return corpus.distinct_units(units, "a", "b", 100_000, "doc_id").select("doc_id", "unit_no")


@query(f"""with {_TEMPORAL}, s as (select label, case when is_test then 'test' else 'older' end as split, count(*) as n, min(created_at) as a, max(created_at) as z from split group by all),
    pairs as (select split, label from (values ('older'), ('test')) x(split), (select distinct event_type as label from events) union all values ('older', 'none'), ('test', 'none'))
    select split, label, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / (select count(*) from events), 9) as share, epoch_us(a) as first_us, epoch_us(z) as last_us from pairs left join s using (split, label)""")
def split_metadata(spark, sf_dir):
    """What is in the splits that were written; a label that does not occur is there too."""
    rows = _split_events(spark, sf_dir).withColumn("split", F.when(F.col("is_test"), "test").otherwise("older")).drop("is_test")
    labels = ("click", "error", "none", "purchase", "signup", "view")
    out = dataset.write_splits(rows, f"{scratch(spark)}/splits-{uuid.uuid4().hex}", labels=labels, splits=("older", "test"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("split", "label", "n", F.round("share", 9).alias("share"), us("first_at").alias("first_us"), us("last_at").alias("last_us"))


@query(f"""with {_TEMPORAL}, m as (select label, count(*) as m from split where not is_test group by label), v as (select label, m, case when m > 1 then greatest(1, least(m - 1, round_even(0.25 * m, 0)::bigint)) else 0 end as val from m)
    select label, 'validation' as split, val::bigint as n from v where val > 0 union all select label, 'train', (m - val)::bigint from v""")
def train_val_counts(spark, sf_dir):
    older = _split_events(spark, sf_dir).where("not is_test")
    return dataset.train_validation(older, key="event_id").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def _corpus(spark, sf_dir):
    threads = _threads(spark, sf_dir)
    comment = F.struct(F.col("turn").cast("long").alias("github_id"), F.col("text").alias("body"), F.col("association").alias("author_association"), F.lit("x").alias("created_at"), F.lit(None).cast("string").alias("html_url"))
    issues = threads.groupBy(F.col("conv_id").alias("github_id")).agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("body"), F.sort_array(F.collect_list(F.when(F.col("turn") > 0, comment))).alias("comments"))
    issues = issues.withColumns({"title": F.concat(F.lit("thread "), F.col("github_id").cast("string")), "label": F.lit("bug"), "html_url": F.lit("u"), "created_at": F.lit("x"), "closed_at": F.lit("y"), "ordinal": F.col("github_id")})
    return corpus.issue_records(issues, issues.where("github_id % 3 = 0").select("github_id"))


_CORPUS = f"""{_THREADS}, records as (
    select 'issue:' || conv_id as source_id, conv_id as github_issue_id, 0::bigint as github_comment_id, {strip_sql("'thread ' || conv_id || chr(10) || chr(10) || coalesce(max(case when turn = 0 then " + strip_sql('text') + " end), '')")} as text from threads where conv_id % 3 = 0 group by conv_id
    union all select 'issue:' || conv_id || ':comment:' || turn, conv_id, turn::bigint, {strip_sql('text')} from threads where conv_id % 3 = 0 and turn > 0 and upper(association) in ('MEMBER', 'OWNER', 'CONTRIBUTOR', 'COLLABORATOR') and length({strip_sql('text')}) >= 20)"""


@query(f"with {_CORPUS} select source_id, github_issue_id, github_comment_id, md5(text) as digest from records")
def issue_corpus(spark, sf_dir):
    return _corpus(spark, sf_dir).select("source_id", "github_issue_id", "github_comment_id", F.md5("text").alias("digest"))


@query("select count(*) as issues, sum(n)::bigint as comments, count_if(n > 0)::bigint as with_comments from (select conv_id, count_if(turn > 0) as n from conversations group by conv_id)")
def thread_stats(spark, sf_dir):
    per = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("turn") > 0).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("issues"), F.sum("n").alias("comments"), F.count_if(F.col("n") > 0).alias("with_comments"))


@query(f"with {CHUNKS_SQL} select chunk_id, doc_id, chunk_no::bigint as chunk_no, length(text)::bigint as chars, md5(text) as digest from chunks")
def naive_chunks(spark, sf_dir):
    return ad.chunks(spark, sf_dir).select("chunk_id", "doc_id", "chunk_no", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def _records(spark, sf_dir):
    """Documents with headings, fences and blank lines at some of their lines."""
    d = documents(spark, sf_dir)
    mark = lambda x, i: F.when(i % 7 == 2, F.concat(F.repeat(F.lit("#"), i % 3 + 1), F.lit(" "), F.substring(x, 1, 20))).when(i % 5 == 3, F.lit("```")).when(i % 11 == 9, F.lit(" ")).otherwise(x)
    text = F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n")
    return d.select(F.lit("docs").alias("source_type"), F.col("doc_id").cast("string").alias("source_id"), text.alias("text"), F.lit(None).cast("long").alias("github_issue_id"), F.lit(None).cast("long").alias("github_comment_id"))


_MARKED = """marked as (select doc_id::varchar as source_id, 'doc:' || doc_id as name, array_to_string([case when (i - 1) % 7 = 2 then repeat('#', (i - 1) % 3 + 1) || ' ' || ls[i][1:20] when (i - 1) % 5 = 3 then '```' when (i - 1) % 11 = 9 then ' ' else ls[i] end for i in range(1, len(ls) + 1)], chr(10)) as text
    from (select doc_id, string_split(text, chr(10)) as ls from documents))"""
_SECTIONS = f"""lines as (select source_id, name, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from marked),
leveled as (select *, length(regexp_extract(line, '^(#+){SP}', 1)) as level from lines),
counted as (select *, count(*) filter (level > 0) over (partition by source_id order by pos) as sec from leveled),
heads as materialized (select source_id, sec, level, {strip_sql('substr(line, level + 1)')} as title from counted where level > 0),
above as (select i.source_id, i.sec, list(j.title order by j.sec) as section_path from heads i join heads j on j.source_id = i.source_id and (j.sec = i.sec or j.sec < i.sec and j.level < i.level
    and not exists (select 1 from heads k where k.source_id = i.source_id and k.sec > j.sec and k.sec < i.sec and k.level <= j.level)) group by i.source_id, i.sec),
bodies as (select source_id, name, sec, {strip_sql("string_agg(line, chr(10) order by pos)")} as body from counted group by source_id, name, sec),
units as materialized (select source_id, name, row_number() over (partition by source_id order by sec) - 1 as p, coalesce(section_path, []::varchar[]) as section_path, body, name || ':parent:' || (row_number() over (partition by source_id order by sec) - 1) as parent, null::varchar as stem
    from bodies left join above using (source_id, sec) where body <> '')"""
# Blocks are packed one after the other here: a walk over the blocks of all units at once, one block a step.
_PACKED = f"""body_lines as (select source_id, p, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from units),
fences as (select *, starts_with({strip_sql('line')}, '```') as fence, {strip_sql('line')} = '' as blank from body_lines),
parity as (select *, coalesce(count(*) filter (fence) over (partition by source_id, p order by pos rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as fenced from fences),
opened as (select *, coalesce(lag(fence and fenced) over (partition by source_id, p order by pos), false) or not fenced and (fence or blank) as opens from parity),
blocked as (select *, count(*) filter (opens) over (partition by source_id, p order by pos) as block from opened),
blocks as (select source_id, p, block, regexp_replace(string_agg(line, chr(10) order by pos), '^\n+|\n+$', '', 'g') as text from blocked where fenced or not blank group by source_id, p, block),
worded as (select *, {words_sql('text')} as w from blocks where {strip_sql('text')} <> ''),
pieces as (select source_id, p, block, case when len(w) <= 500 then 0 else k end as k, case when len(w) <= 500 then text else array_to_string(w[k * 500 + 1 : k * 500 + 500], ' ') end as text, case when len(w) <= 500 then len(w) else least(500, len(w) - k * 500) end as n
    from (select *, unnest(range((len(w) + 499) // 500)) as k from worded)),
listed as materialized (select source_id, p, list(text order by block, k) as texts, list(n order by block, k) as ns from pieces group by source_id, p),
sums as materialized (select source_id, p, texts, len(ns) as n, [list_sum(ns[1:i]) for i in range(0, len(ns) + 1)] as q from (select source_id, p, texts, ns from listed)),
walk as (select source_id, p, 1 as i, 0::bigint as b, null::bigint as closed from sums
    union all select source_id, p, i + 1, case when fits then b when t <= b or coalesce(q[i + 2], 0) - coalesce(q[t + 1], 0) > 500 then i else t end, case when not fits then b end
    from (select w.*, s.q, coalesce(s.q[w.i + 2], 0) - coalesce(s.q[w.b + 1], 0) <= 500 as fits, least(w.i - 1, len([x for x in s.q[1 : w.i] if s.q[w.i + 1] - coalesce(x, 0) > 64])) as t from walk w join sums s using (source_id, p) where w.i < s.n)),
ends as (select source_id, p, closed as b, i - 1 as e from walk where closed is not null union all select source_id, p, w.b, w.i from walk w join sums s using (source_id, p) where w.i = s.n),
children as (select source_id, p, row_number() over (partition by source_id, p order by b) - 1 as c, array_to_string(texts[b + 1 : e], chr(10) || chr(10)) as text from ends join sums using (source_id, p)),
chunk_rows as (select source_id, 'parent' as level, parent as chunk_id, null::varchar as parent_id, section_path, body as text from units
    union all select source_id, 'child', coalesce(stem, parent) || ':child:' || c, parent, section_path, text from children join units using (source_id, p))"""


@query(f"with recursive {_MARKED}, {_SECTIONS}, {_PACKED} select source_id, level, chunk_id, parent_id, array_to_string(section_path, '/') as section_path, md5(text) as digest from chunk_rows")
def parent_child_chunks(spark, sf_dir):
    return corpus.parent_child_chunks(_records(spark, sf_dir)).select("source_id", "level", "chunk_id", "parent_id", F.array_join("section_path", "/").alias("section_path"), F.md5("text").alias("digest"))


@query(f"""with recursive {_CORPUS}, units as materialized (select source_id, 0::bigint as p, []::varchar[] as section_path, text as body, 'issue:' || github_issue_id || ':comment:' || github_comment_id || ':parent:0' as parent, 'issue:' || github_issue_id || ':comment:' || github_comment_id as stem from records), {_PACKED}
    select source_id, level, chunk_id, parent_id, md5(text) as digest from chunk_rows""")
def issue_chunks(spark, sf_dir):
    return corpus.parent_child_chunks(_corpus(spark, sf_dir)).select("source_id", "level", "chunk_id", "parent_id", F.md5("text").alias("digest"))


@query(f"with recursive {_MARKED}, {_SECTIONS}, {_PACKED} select count(*) as chunks, (count(*) filter (level = 'parent'))::bigint as parents, (count(*) filter (level = 'child'))::bigint as children from chunk_rows")
def chunk_level_counts(spark, sf_dir):
    return corpus.level_counts(corpus.parent_child_chunks(_records(spark, sf_dir)))


@query(f"with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) select doc_id, pos::bigint as pos, md5({strip_sql('line')}) as digest from l where {strip_sql('line')} <> ''")
def line_sections(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("bare", tx.strip("line"))
    return lines.where("bare <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("bare").alias("digest"))


@query(f"with {CHUNKS_SQL} select chunk_id, parent_id from chunks where doc_id % 5 = 0")
def orphan_chunks(spark, sf_dir):
    children = ad.chunks(spark, sf_dir).select("chunk_id", "parent_id", F.lit("child").alias("level"), "doc_id")
    parents = children.where("doc_id % 5 <> 0").select(F.col("parent_id").alias("chunk_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("parent").alias("level"), "doc_id").distinct()
    return corpus.orphans(children.unionByName(parents)).select("chunk_id", "parent_id")


@query("""with o as (select vec_id, label, case when vec_id % 2 = 0 then 'old' end as note from embeddings where vec_id % 3 <> 0), n as (select vec_id, case when vec_id % 5 = 0 then null else label + 100 end as label, 'new' as note from embeddings where vec_id % 2 = 0)
    select coalesce(o.vec_id, n.vec_id) as vec_id, case when n.vec_id is not null then n.label else o.label end as label, case when o.vec_id is not null then o.note else n.note end as note from o full join n on o.vec_id = n.vec_id""")
def upsert(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    old = e.where("vec_id % 3 <> 0").select("vec_id", "label", F.when(F.col("vec_id") % 2 == 0, "old").alias("note"))
    new = e.where("vec_id % 2 = 0").select("vec_id", F.when(F.col("vec_id") % 5 != 0, F.col("label") + 100).alias("label"), F.lit("new").alias("note"))
    return tables.upsert(old, new, "vec_id", ("label",))


@query("select vec_id, case when vec_id % 50 = 7 then label + 100 else label end as label, case when vec_id % 50 = 7 and vec_id % 3 = 0 then 'new' else 'old' end as note, true as few from embeddings where vec_id % 3 <> 0 or vec_id % 50 = 7")
def keyed_store(spark, sf_dir):
    """A store in 64 buckets and one upsert of the rows of one place in fifty; few: no more buckets were written than keys came."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    held = store.KeyedStore(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}", "vec_id")
    held.upsert(e.where("vec_id % 3 <> 0").withColumn("note", F.lit("old")), ("label",))
    new = e.where("vec_id % 50 = 7").select("vec_id", (F.col("label") + 100).alias("label"), F.lit("new").alias("note"))
    written = held.upsert(new, ("label",))
    return held.read().withColumn("few", F.lit(written <= new.count()))


_NESTED = """nested as (select event_id, '{"body": "' || event_type || '", "author_association": "NONE", "comments": [{"body": "first", "author_association": "OWNER", "x": {"y": [{"body": "deep", "author_association": "MEMBER", "props": ' || props || '}, 7]}}, {"body": '
    || event_id || ', "author_association": "OWNER"}], "extra": ' || case when event_id % 3 = 0 then '[[{"author_association": "X", "body": "' || user_id || '"}]]' else props end || '}' as record from events)"""


@query(rf"""with {_NESTED}, tree as (select event_id, t.fullkey, t.value from nested, json_tree(record::json) t where t.type = 'OBJECT')
    select event_id, regexp_replace(regexp_replace(regexp_replace(fullkey, '\[\d+\]', '[]', 'g'), '^\$\.?', ''), '"', '', 'g') as path, value ->> '$.body' as body, value ->> '$.author_association' as author_association
    from tree where json_type(value, '$.body') = 'VARCHAR' and json_type(value, '$.author_association') = 'VARCHAR'""")
def comment_objects(spark, sf_dir):
    """Objects with a text and its author's standing, in records that are nested by four levels and more."""
    e = read(spark, sf_dir, "events")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    extra = F.when(F.col("event_id") % 3 == 0, text('[[{"author_association": "X", "body": "', F.col("user_id").cast("string"), '"}]]')).otherwise(F.col("props"))
    record = text('{"body": "', F.col("event_type"), '", "author_association": "NONE", "comments": [{"body": "first", "author_association": "OWNER", "x": {"y": [{"body": "deep", "author_association": "MEMBER", "props": ', F.col("props"), '}, 7]}}, {"body": ',
        F.col("event_id").cast("string"), ', "author_association": "OWNER"}], "extra": ', extra, "}")
    return corpus.comment_objects(e.select("event_id", record.alias("record")), "event_id", "record").drop("place")


@query("select doc_id, sha256(text) as sha256, strlen(text)::bigint as byte_len from documents")
def content_manifest(spark, sf_dir):
    out = corpus.manifest_entries(documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("rst")))
    return out.select(F.col("path").alias("doc_id"), "sha256", "byte_len")


@query()
def rst_normalize(spark, sf_dir):
    heads = F.concat(tx.title_line("text"), F.lit("\n"), F.expr("repeat('=', length(text))"), F.lit("\n\n"), F.col("text"))
    out = corpus.normalize_docs(documents(spark, sf_dir).select("doc_id", heads.alias("rst")))
    return out.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query("select event_type, date_trunc('hour', ts) as start, count(*) as n from events group by all")
def windowed_counts(spark, sf_dir):
    """An extension: event-time windows, here over a table that is not a stream."""
    from threadmill.streaming.ingest import windowed_counts as windows

    return windows(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


_ITEMS = """items as (select event_id, case event_id % 5 when 0 then '["a", {"name": "' || event_type || '"}, 3, null, {"id": 1}]' when 1 then '{"pull_request": null, "labels": ["b"]}' when 2 then '[]' when 3 then 'no json' else '[{"name": "x"}, "y", {"name": 5}]' end as item, event_type from events)"""


def _items(spark, sf_dir):
    e, kind = read(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_id") % 5
    item = F.when(kind == 0, F.concat(F.lit('["a", {"name": "'), "event_type", F.lit('"}, 3, null, {"id": 1}]'))).when(kind == 1, '{"pull_request": null, "labels": ["b"]}').when(kind == 2, "[]").when(kind == 3, "no json").otherwise('[{"name": "x"}, "y", {"name": 5}]')
    return e.withColumn("item", item)


@query(f"with {_ITEMS} select event_id, case event_id % 5 when 0 then 'a,' || event_type when 4 then 'x,y' else '' end as names, event_id % 5 = 1 as pull_request from items")
def raw_items(spark, sf_dir):
    """Label names in mixed JSON arrays, and items that are pull requests because the key is there."""
    return _items(spark, sf_dir).select("event_id", F.array_join(dataset.label_items("item"), ",").alias("names"), dataset.is_pull_request("item").alias("pull_request"))


@query("select event_id, user_id, (row_number() over (order by user_id nulls first, event_id) - 1)::bigint as place from events qualify place < 100")
def stable_order(spark, sf_dir):
    """A sort by one column that leaves equal ones in their order: here the first hundred of it."""
    from pyspark.sql import Window

    ordered = dataset.by_closing(read(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id").limit(100)
    return ordered.withColumn("place", F.row_number().over(Window.orderBy("user_id", "event_id")).cast("long") - 1)


@query("""with r as (select event_id, event_type, list_position(['view', 'click', 'purchase', 'error'], event_type) - 1 as place from events)
    select case when place is null then 'unknown label' when event_id % 7 = 0 then 'label_id does not agree with label' else 'empty text' end as problem, count(*) as n from r where place is null or event_id % 7 = 0 or event_id % 11 = 0 group by all""")
def split_problems(spark, sf_dir):
    """Planted faults of a labelled split: labels out of the list, ids of other labels, blank texts."""
    labels = ("view", "click", "purchase", "error")
    place = F.create_map(*(x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))))[F.col("event_type")]
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), (place + (F.col("event_id") % 7 == 0).cast("int")).alias("label_id"), F.when(F.col("event_id") % 11 == 0, " \t\n").otherwise("text").alias("text"))
    return dataset.label_id_mismatches(rows, labels).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id as path, case when doc_id % 10 = 0 then null when doc_id % 10 = 1 then 'x' else sha256(text) end as recorded from documents where doc_id % 10 < 2 order by 1")
def digest_mismatches(spark, sf_dir):
    """Recorded digests of which some are missing and some are wrong."""
    found = corpus.manifest_entries(documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.col("text").alias("rst")))
    recorded = found.where("path % 10 > 0").select("path", F.when(F.col("path") % 10 == 1, "x").otherwise(F.col("sha256")).alias("sha256"))
    return dataset.digest_mismatches(found, recorded).select("path", "recorded")


#: Bytes of texts in a file.
_FILE_BYTES = 32 << 20


@query("select doc_id, (row_number() over (order by doc_id) - 1)::bigint as ordinal, lang from documents")
def numbered_lines(spark, sf_dir):
    """Documents written as JSON lines in several files and read back: a number without gaps over all of them."""
    path, rows = f"{scratch(spark)}/lines-{uuid.uuid4().hex}", documents(spark, sf_dir).select("doc_id", "lang", "text")
    files = max(5, (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _FILE_BYTES)  # so that a task's share stays as it is when the table grows
    tables.write_jsonl(rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id"), path)
    return lines.numbered_records(spark, path, "doc_id bigint, lang string").select("doc_id", "ordinal", "lang")


@query("""select doc_id, 'changed' as change from documents where doc_id % 97 = 3 and doc_id % 101 <> 5 union all select doc_id, 'removed' from documents where doc_id % 101 = 5
    union all select doc_id + 1000000000, 'added' from documents where doc_id % 103 = 7""")
def table_changes(spark, sf_dir):
    """Planted changes between two versions of the documents, found by the buckets whose digests differ."""
    d = documents(spark, sf_dir)
    edited = d.where("doc_id % 101 <> 5").withColumn("text", F.when(F.col("doc_id") % 97 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return digests.changes(d, edited.unionByName(d.where("doc_id % 103 = 7").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)), "doc_id")
