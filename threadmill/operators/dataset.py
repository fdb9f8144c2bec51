"""Building a labelled dataset: label mapping, quality, samples, carve-outs, temporal splits and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.functions import text as tx
from threadmill.operators import ranks
from threadmill.sources.tables import read_object

# The order of labels in reports and in carve-outs, and the source label of each.
LABELS = ("bug", "feature", "docs", "question")
CARVE_LABELS = ("bug", "docs", "feature", "question")
SOURCE_LABELS = {"bug": ("kind:bug",), "feature": ("kind:feature",), "docs": ("kind:documentation",), "question": ("pending-response",)}
# What is too short to keep, and whole texts that are junk.
MIN_CHARS, MIN_WORDS = 20, 5
JUNK = (".", ".\n\n.", "..", "n/a", "na", "test", "delete")
# Sizes of the reserves and of the splits.
GOLDEN_QUOTAS = {"bug": 7, "docs": 6, "feature": 7, "question": 5}
HOLDOUT_LEAST, HOLDOUT_MOST, HOLDOUT_WORDS = 50, 100, 80
CLASS_TARGET, TEST_SHARE, VALIDATION_SHARE = 500, 0.2, 0.25


# --- labels ---------------------------------------------------------------------------------------------------------


def label_names(labels: Column | str) -> Column:
    """The names in an array of strings; nulls are left out."""
    return F.filter(tx.col(labels), lambda x: x.isNotNull())


def label_objects(labels: Column | str) -> Column:
    """The names in an array of structs with a name; nulls and structs without a name are left out."""
    return label_names(F.transform(tx.col(labels), lambda x: x["name"]))


def label_items(labels_json: Column | str) -> Column:
    """The names in a JSON array whose items are strings or objects with a name, in any mixture; items of other kinds are left out.

    Null, and JSON that is no array, have no names.
    """
    items = F.try_parse_json(tx.col(labels_json)).try_cast("array<variant>")
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit(""))
    named = lambda v: F.try_variant_get(v, "$.name", "variant")
    name = lambda v: F.when(kind(v) == "STRING", v.try_cast("string")).when(kind(v).startswith("OBJECT") & (kind(named(v)) == "STRING"), named(v).try_cast("string"))
    return F.coalesce(label_names(F.transform(items, name)), F.array().cast("array<string>"))


def labels_of(rows: DataFrame, labels: str = "labels") -> Column:
    """The label names of a column, whether it holds strings, objects or JSON."""
    kind = rows.schema[labels].dataType
    if isinstance(kind, T.StringType):
        return label_items(labels)
    return label_objects(labels) if isinstance(kind.elementType, T.StructType) else label_names(labels)


def is_pull_request(item_json: Column | str) -> Column:
    """Whether a raw JSON item has the key pull_request, even if its value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(tx.col(item_json)), "pull_request"), F.lit(False))


def load_mapping(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """A label mapping from a JSON object of lists (a list is also taken from under ``github_labels``).

    Fails unless it is an object with the targets of LABELS and no others, each a list of names that are not blank, and no name
    stands twice after normalization. The order of targets is that of LABELS, their priority.
    """
    raw = read_object(spark, path)
    if set(raw) != set(LABELS):
        raise ValueError(f"targets must be {sorted(LABELS)}, found {sorted(raw)}")
    seen: set[str] = set()
    out = {}
    for target in LABELS:
        names = raw[target].get("github_labels") if isinstance(raw[target], dict) else raw[target]
        if not isinstance(names, list) or not names or not all(isinstance(n, str) and n.strip() for n in names):
            raise ValueError(f"{target} must have a list of names")
        plain = tuple(n.strip().lower() for n in names)
        if len(set(plain)) < len(plain) or seen & set(plain):
            raise ValueError(f"a name of {target} stands twice")
        seen |= set(plain)
        out[target] = plain
    return out


def mapping_table(spark: SparkSession, mapping: dict[str, tuple[str, ...]] = SOURCE_LABELS) -> DataFrame:
    """(target, label_id, source_label), label_id also being the priority. As long as the mapping, so it may be broadcast."""
    rows = [(t, i, s) for i, (t, sources) in enumerate(mapping.items()) for s in sources]
    return spark.createDataFrame(rows, "target string, label_id int, source_label string")


def map_issues(issues: DataFrame, mapping: dict[str, tuple[str, ...]] = SOURCE_LABELS) -> DataFrame:
    """issues with label, label_id, text, conflict and reason appended.

    reason is null for rows that are kept, else the first of: missing_closed_at, invalid_fetched_for_label,
    invalid_fetched_for_github_label, missing_fetched_github_label, unmapped_labels, empty_title_and_body. A
    row that was fetched for a label keeps it if its own labels bear it out; else the first target in
    priority order that one of its labels maps to. conflict: the labels of a kept row map to several.
    """
    own = F.coalesce(F.transform(labels_of(issues), tx.normalize_label), F.array().cast("array<string>"))
    targets = {t: F.array(*map(F.lit, s)) for t, s in mapping.items()}
    matched = F.filter(F.array(*(F.when(F.arrays_overlap(own, s), F.lit(t)) for t, s in targets.items())), lambda t: t.isNotNull())
    fetched, source = F.nullif(F.col("fetched_for_label"), F.lit("")), F.nullif(F.col("fetched_for_github_label"), F.lit(""))
    of_fetched = F.create_map(*(x for t, s in targets.items() for x in (F.lit(t), s)))[fetched]
    wanted = tx.normalize_label(source)
    reason = (
        F.when(tx.timestamp("closed_at", zone_required=False).isNull(), "missing_closed_at")
        .when(fetched.isNotNull() & ~fetched.isin(*mapping), "invalid_fetched_for_label")
        .when(fetched.isNotNull() & source.isNotNull() & ~F.array_contains(of_fetched, wanted), "invalid_fetched_for_github_label")
        .when(fetched.isNotNull() & source.isNotNull() & ~F.array_contains(own, wanted), "missing_fetched_github_label")
        .when(fetched.isNotNull() & source.isNull() & ~F.arrays_overlap(own, of_fetched), "missing_fetched_github_label")
        .when(fetched.isNull() & (F.size(matched) == 0), "unmapped_labels")
        .when(F.col("text").isNull(), "empty_title_and_body")
    )
    label = F.coalesce(fetched, F.get(matched, F.lit(0)))
    ids = F.create_map(*(x for i, t in enumerate(mapping) for x in (F.lit(t), F.lit(i))))
    out = issues.withColumn("text", tx.clean_text("title", "body")).withColumn("reason", reason)
    kept = F.col("reason").isNull()
    return out.withColumns({"label": F.when(kept, label), "label_id": F.when(kept, ids[label]), "conflict": kept & fetched.isNull() & (F.size(matched) > 1)})


def skip_counts(mapped: DataFrame) -> DataFrame:
    """(reason, n) in the order of reason; resolved conflicts are counted too, though their rows stay."""
    reasons = F.explode(F.filter(F.array(F.col("reason"), F.when(F.col("conflict"), F.lit("multi_label_conflicts_resolved"))), lambda r: r.isNotNull()))
    return mapped.select(reasons.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


def unmatched_labels(mapped: DataFrame, order: Column | str) -> DataFrame:
    """(label, n) of the labels of rows that map to nothing, most frequent first, of equals the one seen first."""
    missed = mapped.where(F.col("reason").isNotNull() & ~F.col("reason").isin("missing_closed_at", "empty_title_and_body"))
    names = F.coalesce(F.transform(labels_of(mapped), tx.normalize_label), F.array().cast("array<string>"))
    names = F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("(no labels)")))
    seen = missed.select(tx.col(order).alias("at"), F.posexplode(names).alias("pos", "label"))
    counts = seen.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "pos")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").select("label", "n")


def class_counts(rows: DataFrame, labels=LABELS, label: str = "label") -> DataFrame:
    """(label_order, label, n) for each of labels in their order, with zeros."""
    table = rows.sparkSession.createDataFrame(list(enumerate(labels)), "label_order int, label string")
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(table).join(counts, "label", "left").select("label_order", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shortfalls(counts: DataFrame, target: int = CLASS_TARGET) -> DataFrame:
    return counts.where(F.col("n") < target).select("label", F.lit(target).cast("long").alias("target"), F.col("n").alias("usable"), (target - F.col("n")).alias("missing"))


# --- quality --------------------------------------------------------------------------------------------------------


def quality(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with char_count (of the stripped text), word_count, only_punct and dropped appended. Null text counts as empty."""
    bare = tx.strip(F.coalesce(F.col(text), F.lit("")))
    out = rows.withColumns({"char_count": F.length(bare).cast("long"), "word_count": tx.count_words(F.coalesce(F.col(text), F.lit(""))).cast("long"), "only_punct": (bare != "") & ~tx.has_alnum(bare)})
    return out.withColumn("dropped", (F.col("char_count") < MIN_CHARS) | (F.col("word_count") < MIN_WORDS) | F.col("only_punct") | F.lower(bare).isin(*JUNK))


def drops_by_class(judged: DataFrame, label: str = "label") -> DataFrame:
    """(label, kept, dropped); rows without a label stand under (missing)."""
    return judged.groupBy(F.coalesce(F.col(label), F.lit("(missing)")).alias("label")).agg(F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("dropped"))


PERCENTS = {"p5": 5, "p25": 25, "median": 50, "p75": 75, "p95": 95}


def distribution(rows: DataFrame, value: str, by: list[str] | None = None, percents: dict[str, int] = PERCENTS) -> DataFrame:
    """Per group: n, min, percentiles, max by nearest rank, the rank (n - 1) p / 100 rounded half to even.

    Rows are counted by value first, so a group never gathers more rows than it has different values, and a running sum
    over values finds the ranks; no group's values are collected.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*by).orderBy("v")
    ranked = counts.withColumns({"upto": F.sum("c").over(run), "n": F.sum("c").over(Window.partitionBy(*by))})
    at = lambda p: F.min(F.when(F.col("upto") > F.bround((F.col("n") - 1) * p / 100.0).cast("long"), F.col("v")))
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.min("v").alias("min"), *(at(p).alias(name) for name, p in percents.items()), F.max("v").alias("max"))


# --- samples and carve-outs -----------------------------------------------------------------------------------------


def first_n_per_class(rows: DataFrame, n: int | Column, order: list, label: str = "label") -> DataFrame:
    """The first n rows of each class in the given total order. The row limit reaches below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, and first_at, where the key came up first. Columns that clash are in the struct ``row``."""
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("row"), F.min(order).alias("first_at"))
    return found.select("row.*", "first_at")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def golden(rows: DataFrame, quotas: dict[str, int] = GOLDEN_QUOTAS, ordinal: str = "ordinal", strict: bool = True, cues=tx.CUES) -> DataFrame:
    """The clearest rows of each label, as many as its quota: by signal plus shortness, then fewer words, then lower number.

    rows(label, text, number, ordinal). Raises if strict and a label has too few.
    """
    opening = tx.opening("text")
    scored = rows.where(F.col("text").isNotNull() & F.col("label").isin(*quotas)).withColumn("opening_words", tx.count_words_joined(opening).cast("long"))
    scored = scored.withColumn("score", (tx.signal_score("label", opening, tx.title_line("text"), cues) + F.greatest(F.lit(0), 220 - F.col("opening_words"))).cast("long"))
    quota = F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv))[F.col("label")]
    chosen = first_n_per_class(scored, quota, [F.desc("score"), F.asc("opening_words"), F.coalesce(F.col("number"), F.lit(0)).asc(), F.asc(ordinal)])
    if strict:
        found = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if short := {k: n for k, n in quotas.items() if found.get(k, 0) < n}:
            raise ValueError(f"not enough rows for the golden set: {short}")
    return chosen


def best_comment_score(comments: Column | str) -> Column:
    """The best comment of an array of (body, author_association): words, 500 more if structured, 50 more of a member or owner; null if none has 80 words."""
    fit = F.filter(tx.col(comments), lambda c: tx.is_maintainer(c["author_association"], tx.HOLDOUT_MAINTAINERS) & c["body"].isNotNull() & (tx.count_words_joined(c["body"]) >= HOLDOUT_WORDS))
    return F.array_max(F.transform(fit, lambda c: (tx.count_words_joined(c["body"]) + F.when(tx.is_structured(c["body"]), 500).otherwise(0) + F.when(F.upper(c["author_association"]).isin("MEMBER", "OWNER"), 50).otherwise(0)).cast("long")))


def holdout(mapped: DataFrame, raw: DataFrame, excluded: DataFrame, most: int = HOLDOUT_MOST, least: int = 0, ordinal: str = "ordinal") -> DataFrame:
    """The issues with the best maintainer comments: mapped(issue_id, number) with raw(issue_id, comments, ordinal), the last raw row of an id, without excluded(issue_id)."""
    last = raw.groupBy("issue_id").agg(F.max_by(best_comment_score("comments"), ordinal).alias("score"))
    scored = mapped.join(excluded, "issue_id", "left_anti").join(last, "issue_id").where("score is not null")
    out = scored.orderBy(F.desc("score"), F.desc(F.coalesce(F.col("number"), F.lit(0))), "issue_id").limit(most)
    if least and out.count() < least:
        raise ValueError(f"fewer than {least} holdout candidates")
    return out


def without(pool: DataFrame, reserves: list[DataFrame], key: str = "issue_id") -> DataFrame:
    """The pool without the keys of any reserve."""
    ids = None
    for r in reserves:
        ids = r.select(key) if ids is None else ids.unionByName(r.select(key))
    return pool if ids is None else pool.join(ids.distinct(), key, "left_anti")


def overlaps(named: dict[str, DataFrame], key: str = "issue_id") -> DataFrame:
    """(key, n, places) of keys that occur more than once in the named tables, in one or in several of them."""
    tagged = None
    for name, rows in named.items():
        part = rows.select(key, F.lit(name).alias("place"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("place")), ",").alias("places")).where("n > 1")


# --- splits ---------------------------------------------------------------------------------------------------------


def temporal_test(rows: DataFrame, at: str = "created_at", ordinal: str = "ordinal", label: str = "label", share: float = TEST_SHARE) -> DataFrame:
    """rows with is_test: per label the newest share, from the time of row n - round(share n) on, so that equal times stay together.

    The cut is the time at a rank, found by ``ranks.value_at``, so a label is never sorted, and no task gets all of its times.
    """
    named = rows.select(F.col(label).alias("label"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("label is not null")
    sizes = named.where("us is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    target = F.greatest(F.lit(1).cast("long"), F.bround(F.col("n") * share).cast("long"))
    cuts = ranks.value_at(named, sizes.select("label", (F.col("n") - target).alias("rank")), ["label"], "us").select(F.col("label").alias("__label"), F.col("us").alias("__cut"))
    small = F.broadcast(cuts) if cuts.count() <= ranks.BROADCAST_GROUPS else cuts
    joined = rows.join(small, F.col(label) == F.col("__label")).withColumn("is_test", F.unix_micros(F.col(at).cast("timestamp")) >= F.col("__cut"))
    return joined.drop("__label", "__cut")


def train_validation(rows: DataFrame, seed: int = 42, key: str = "issue_id", label: str = "label", share: float = VALIDATION_SHARE) -> DataFrame:
    """rows with split (train or validation): per label round(share n) rows, at least 1 and at most n - 1, by a seeded hash of the key.

    Which rows these are is our own choice of a deterministic shuffle; their number is what the rule fixes.
    """
    # Ranks within 1024 parts of the hash's range, offset by the counts of the parts before, so no label is one task.
    h = F.xxhash64(F.lit(seed), F.col(label), F.col(key))
    parted = rows.withColumns({"__h": h, "__part": F.shiftrightunsigned(h, 54)})
    counts = parted.groupBy(label, "__part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__before": F.coalesce(F.sum("c").over(before), F.lit(0)), "__n": F.sum("c").over(Window.partitionBy(label))}).drop("c")
    rank = F.row_number().over(Window.partitionBy(label, "__part").orderBy("__h", key)) + F.col("__before")
    size = F.when(F.col("__n") > 1, F.greatest(F.lit(1).cast("long"), F.least(F.col("__n") - 1, F.bround(F.col("__n") * share).cast("long")))).otherwise(0)
    joined = parted.join(counts, [label, "__part"])
    return joined.withColumn("split", F.when(rank <= size, "validation").otherwise("train")).drop("__h", "__part", "__before", "__n")


def time_bounds(rows: DataFrame, by: list[str], at: str = "created_at") -> DataFrame:
    return rows.groupBy(*by).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"))


def boundary_violations(rows: DataFrame, label: str = "label", at: str = "created_at") -> DataFrame:
    """Labels of which a row outside the test part is not older than all of the test part; rows need is_test."""
    found = rows.groupBy(label).agg(F.max(F.when(~F.col("is_test"), F.col(at))).alias("last_train"), F.min(F.when(F.col("is_test"), F.col(at))).alias("first_test"))
    return found.where("last_train >= first_test")


def missing_labels(rows: DataFrame, labels=LABELS, split: str = "split", splits=("train", "validation", "test")) -> DataFrame:
    """(split, label) pairs without a row."""
    wanted = rows.sparkSession.createDataFrame([(s, k) for s in splits for k in labels], f"{split} string, label string")
    return wanted.join(rows.select(split, "label").distinct(), [split, "label"], "left_anti")


def write_splits(rows: DataFrame, path: str, at: str = "created_at", label: str = "label", split: str = "split", labels=LABELS, splits=("train", "validation", "test")) -> DataFrame:
    """Writes rows(label, at, split, ...) by split and returns (split, label, n, share, first_at, last_at, digest): what is written there.

    One aggregate over the written files has all counts, bounds and digests, so rows is computed once, however much work it is. (Observed
    metrics would save the second scan, but a session that holds an ``Observation`` cannot send fitted spark.ml models to its tasks any more.) share
    is of all rows; the digest of a split, a sum of row hashes, does not depend on order or partitions and stands with each of its
    labels. Rows of another split or label are an error.
    """
    wanted = [(s, k) for s in splits for k in labels]
    parts = [(F.col(split) == s) & (F.col(label) == k) for s, k in wanted]
    metrics = [F.count(F.lit(1)).alias("n")]
    for i, part in enumerate(parts):
        metrics += [F.count_if(part).alias(f"n{i}"), F.min(F.when(part, F.col(at))).alias(f"first{i}"), F.max(F.when(part, F.col(at))).alias(f"last{i}")]
    columns = [F.struct(F.col(c).isNull(), F.col(c)) for c in sorted(rows.columns)]
    metrics += [F.sum(F.when(F.col(split) == s, F.xxhash64(*columns).cast("decimal(20,0)"))).alias(f"digest_{j}") for j, s in enumerate(splits)]
    rows.write.mode("overwrite").partitionBy(split).parquet(path)
    m = rows.sparkSession.read.schema(rows.schema).parquet(path).agg(*metrics).first()
    if (known := sum(m[f"n{i}"] for i in range(len(wanted)))) != m["n"]:
        raise ValueError(f"{m['n'] - known} rows of an unknown split or label")
    kind = rows.schema[at].dataType.simpleString()
    out = [(s, k, m[f"n{i}"], m[f"n{i}"] / m["n"] if m["n"] else 0.0, m[f"first{i}"], m[f"last{i}"], str(m[f"digest_{splits.index(s)}"] or 0)) for i, (s, k) in enumerate(wanted)]
    return rows.sparkSession.createDataFrame(out, f"split string, label string, n long, share double, first_at {kind}, last_at {kind}, digest string")


def require_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which a required column is null; a column that is not there at all is an error."""
    if absent := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {absent}")
    gone = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    return rows.withColumn("missing", F.array_join(gone, ",")).where("missing <> ''")


def label_id_mismatches(rows: DataFrame, labels=LABELS, label: str = "label", label_id: str = "label_id", text: str = "text") -> DataFrame:
    """rows with ``problem`` whose label is unknown, whose label_id is not its label's place, or whose text is empty once normalized."""
    place = F.create_map(*(x for i, k in enumerate(labels) for x in (F.lit(k), F.lit(i))))[F.col(label)]
    empty = tx.normalize_text(F.coalesce(F.col(text), F.lit(""))) == ""
    problem = F.when(place.isNull(), "unknown label").when(~F.col(label_id).eqNullSafe(place), "label_id does not agree with label").when(empty, "empty text")
    return rows.withColumn("problem", problem).where("problem is not null")


def labelled_split(rows: DataFrame, text: str = "text", **columns: str) -> DataFrame:
    """A whole split with its texts normalized; fails with some of the rows if any breaks a rule of ``label_id_mismatches``."""
    ensure_empty(label_id_mismatches(rows, text=text, **columns), "rows of the split")
    return rows.withColumn(text, tx.normalize_text(text))


def by_closing(rows: DataFrame, at: str = "closed_at", ordinal: str = "ordinal") -> DataFrame:
    """rows in the order in which they were closed, equal times in their order before."""
    return rows.orderBy(at, ordinal)


def forbidden_prefixes(rows: DataFrame, prefixes: tuple[str, ...], key: str = "source_id") -> DataFrame:
    """Rows whose key begins with one of the prefixes that a corpus must not have."""
    return rows.where(F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col(key), p)))


def digest_mismatches(found: DataFrame, recorded: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, found, recorded) of what does not have its recorded digest; null stands for what is missing on either side."""
    a, b = found.select(key, F.col(digest).alias("found")), recorded.select(key, F.col(digest).alias("recorded"))
    return a.join(b, key, "full").where(~F.col("found").eqNullSafe(F.col("recorded")))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ensure_empty(violations: DataFrame, what: str) -> None:
    """Fails the job, with a few of the rows, unless there are none."""
    if found := violations.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")
