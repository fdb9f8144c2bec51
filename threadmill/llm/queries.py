"""The queries of the training-data operators over the driver's tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from threadmill.llm import decontaminate, htmltext, impacts, infill, langid, linededup, packing, quality, search, secretscan, sharding, simhash, urlfilter


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_secret_scan(spark, sf_dir):
    return secretscan.digest(secretscan.scan(_read(spark, sf_dir, "documents")))


def op3_simhash_near_dedup(spark, sf_dir):
    found = simhash.classes(_read(spark, sf_dir, "documents"), shingle=4, budget=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark, sf_dir):
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("rid")


def op5_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_html_extraction(spark, sf_dir):
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op7_url_filter(spark, sf_dir):
    return urlfilter.judge(_read(spark, sf_dir, "pages"))


def op8_line_dedup(spark, sf_dir):
    out = linededup.line_dedup(_read(spark, sf_dir, "documents"))
    runs = F.array_join(F.transform("__runs", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.col("__removed").alias("n_removed"), runs.alias("runs"), "text")


def op9_bm25_search(spark, sf_dir):
    """Every document whose id is divisible by 20, as a whole, asked against all documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return search.search(search.term_vectors(docs.where("doc_id % 20 = 0")), search.index(docs), 10)


def op10_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), shards=8)


def op11_impact_search(spark, sf_dir):
    """The 20 best documents of all for each benchmark item."""
    return impacts.search(_read(spark, sf_dir, "benchmark"), impacts.index(_read(spark, sf_dir, "documents")), 20)


def op12_fill_in_middle(spark, sf_dir):
    out = infill.fill_in_middle(_read(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_quality_rules(spark, sf_dir):
    """Languages are the strata, the quality of labels the holdout."""
    out = quality.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), F.col("lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "severity", "chosen", "failed_rules")


def queries():
    found = (op1_packing, op2_secret_scan, op3_simhash_near_dedup, op4_decontamination, op5_language_id, op6_html_extraction, op7_url_filter, op8_line_dedup, op9_bm25_search, op10_sharding)
    found = {f.__name__: f for f in (*found, op11_impact_search, op12_fill_in_middle, op13_quality_rules)}
    return found | {"pipeline": corpus_pipeline.run}


#: Every shortest run of 50 words from a line on or up to a line, of which all but the first with its content goes.
OP8_SQL = r"""
with w as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
p as (select doc_id, unnest(ls) as line, unnest(list_transform(ls, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) as n, generate_subscripts(ls, 1) as pos from w),
c as (select doc_id, pos, sum(n) over (partition by doc_id order by pos) - n as since, sum(n) over (partition by doc_id order by pos) as upto from p),
pairs as (select a.doc_id, a.pos as s, b.pos as e from c a join c b on a.doc_id = b.doc_id and b.pos >= a.pos and b.upto - a.since >= 50),
runs as (select doc_id, s, min(e) as e from pairs group by doc_id, s union select doc_id, max(s), e from pairs group by doc_id, e),
later as (select doc_id, s, e from (select r.*, array_to_string(ls[s:e], chr(10)) as content from runs r join w using (doc_id)) qualify row_number() over (partition by content order by doc_id, s) > 1),
gone as (select distinct p.doc_id, p.pos from p join later l on p.doc_id = l.doc_id and p.pos between l.s and l.e),
islands as (select doc_id, min(pos) - 1 as a, max(pos) as b from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as island from gone) group by doc_id, island),
listed as (select doc_id, sum(b - a)::bigint as n, string_agg(a || ':' || b, ',' order by a) as runs from islands group by doc_id),
kept as (select p.doc_id, string_agg(line, chr(10) order by pos) as text from p anti join gone g on p.doc_id = g.doc_id and p.pos = g.pos group by p.doc_id)
select w.doc_id, coalesce(len(ls), 0)::bigint as n_lines, coalesce(l.n, 0)::bigint as n_removed, coalesce(l.runs, '') as runs,
    case when l.n is null then w.text else coalesce(k.text, '') end as text
from w left join listed l using (doc_id) left join kept k using (doc_id)"""


#: The CRC goes byte by byte through a table made by its polynomial.
OP10_SQL = """
with crc_table as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from (select unnest(range(256)) as i)),
data as (select doc_id, coalesce(strlen(text), 0) + 1 as size, coalesce(md5(text), '') as key, hex(encode(coalesce(text, ''))) as h from documents),
rows as (select doc_id, size, key, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) as crc from data, crc_table),
groups as (select key, sum(size)::bigint as bytes from rows group by key),
large as (select key, row_number() over (order by key) - 1 as k from groups where bytes * 8 >= (select sum(bytes) from groups)),
rest as (select key, bytes, sum(bytes) over (order by key) - bytes as start from groups anti join large using (key)),
shards as (select key, least(7 - (select count(*) from large), ((start + bytes // 2) * (8 - (select count(*) from large))) // (select sum(bytes) from rest)) as shard from rest
    union all select key, 8 - (select count(*) from large) + k from large)
select doc_id, size::bigint as size, crc::bigint as text_crc32, 'bytes' as law, shard::int as shard,
    row_number() over (partition by shard order by md5(doc_id::varchar), doc_id, key) - 1 as slot, null::int as grown_shard
from rows join shards using (key)"""


_TERMS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{impacts.TERM}')"
OP11_SQL = f"""
with sizes as (select doc_id, {_TERMS} as terms from documents),
docs as (select doc_id, len(terms) as n from sizes where len(terms) > 0),
total as (select count(*) as n_docs, sum(n)::bigint as n_words from docs),
postings as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from sizes) group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::bigint as w from postings, total group by term, n_docs),
asked as (select item_id, term, count(*) as qtf from (select item_id, unnest({_TERMS}) as term from benchmark) group by item_id, term),
found as (select item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::bigint as score
    from asked join weights using (term) join postings using (term) join docs using (doc_id), total group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from found where score > 0
qualify rank <= 20"""


OP12_SQL = """
with cut as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as ts, sha256('1:' || coalesce(doc_id::varchar, '')) as d from documents),
draw as (select *, len(ts) as n, [('0x' || d[8 * k + 1 : 8 * k + 8])::bigint for k in range(4)] as h from cut),
part as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as p, greatest(h[1] % (n + 1), h[2] % (n + 1)) as q,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end as form from draw),
text3 as (select *, array_to_string(ts[1:p], '') as a, array_to_string(ts[p + 1 : q], '') as b, array_to_string(ts[q + 1 :], '') as c from part)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(a) end as prefix_chars, case when form <> 'plain' then length(b) end as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256, sha256(t) as restored_sha256
from text3"""


OP13_SQL = rf"""
with base as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t from documents),
split as (select *, regexp_extract_all(t, '[^ 	-
]+') as ws from base),
windows as (select doc_id, unnest([array_to_string(ws[i : i + 4], ' ') for i in range(1, greatest(len(ws) - 3, 1))]) as g, unnest(range(1, greatest(len(ws) - 3, 1))) as i from split),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, g) > 1),
repeats as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from twice) group by doc_id),
lines as (select doc_id, count(*) as n, count(*) - count(distinct line) as copies from (select doc_id, unnest(string_split(t, chr(10))) as line from base) where regexp_matches(line, '[^ 	-
]') group by doc_id),
counts as (select doc_id, stratum, t, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(l.copies, 0) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words, coalesce(l.n, 0) as n_lines, len(regexp_extract_all(t, '[!-/:-@\[-`{{-~]')) as n_marks, len(regexp_extract_all(t, '[A-Z]')) as n_capitals
    from split left join lines l using (doc_id) left join repeats r using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    [1000 * n_symbols // greatest(word_chars, 1), 1000 * n_marks // greatest(word_chars, 1), 1000 * n_capitals // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1), least(1000, 20 * word_chars // greatest(n_words, 1))] as levels from counts),
each as (select doc_id, stratum, t, base_failed, unnest(levels) as level, unnest({list(quality.RULES)}) as rule, unnest(range(6)) as r from judged),
marks as (select doc_id, max(quality) = 1 as good from labels group by doc_id),
scale as (select stratum, r, level, count(*) as n from each anti join marks using (doc_id) where not base_failed group by stratum, r, level),
above as (select stratum, r, level, sum(n) over (partition by stratum, r order by level desc) - n as above, sum(n) over (partition by stratum, r) as total from scale),
cuts as (select stratum, r, k, min(level) as cut from above, (select unnest({list(quality.TAILS)}) as tail, unnest(range(1, {len(quality.TAILS) + 1})) as k) where above * 100000 <= total * tail group by stratum, r, k),
grade as (select doc_id, stratum, t, base_failed, coalesce(min(k) filter (level > cut), {len(quality.TAILS) + 1}) as sev from each left join cuts using (stratum, r) group by doc_id, stratum, t, base_failed),
held as (select stratum, t, max(good) as good, min(sev) as sev from grade join marks using (doc_id) where not base_failed and stratum in (select stratum from cuts) group by stratum, t),
tails as (select stratum, k, count(*) filter (good) as n, count(*) filter (good and sev <= k) as x, count(*) filter (not good and sev <= k) as bad from held, range(1, {len(quality.TAILS) + 1}) as ks(k) group by stratum, k),
tested as (select *, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK})) for i in range(x + 1)]) <= {quality.LEVEL} / (select count(distinct stratum) from cuts) as safe from tails where n > 0),
chosen as (select stratum, arg_max(k, (bad - x) * 1000 - k) as chosen from (select *, bool_and(safe) over (partition by stratum order by k) as upto from tested) where upto and bad > x group by stratum),
failed as (select doc_id, string_agg(rule, ',' order by each.r) as rules from each join chosen using (stratum) join cuts on cuts.stratum = each.stratum and cuts.r = each.r and cuts.k = chosen where level > cut group by doc_id)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, j.base_failed,
    not j.base_failed and g.sev > coalesce(chosen, 0) as kept, j.stratum, g.sev::int as severity, coalesce(chosen, 0)::int as chosen, coalesce(rules, '') as failed_rules
from judged j join grade g using (doc_id) left join chosen c on c.stratum = j.stratum left join failed using (doc_id)"""


def oracle_sql():
    found = {"op8_line_dedup": OP8_SQL, "op10_sharding": OP10_SQL, "op11_impact_search": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_quality_rules": OP13_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
