"""Quality rules whose cutoffs keep to a limit of false rejections.

``measure`` counts words, symbols, repeated lines and windows of each text, and turns them into levels from 0 to 1000 (per
mille, a higher one is worse) of the rules in ``RULES``. ``select`` chooses the cutoffs of each stratum:

1. The documents without a label give the scale: for each tail in ``TAILS`` the lowest level of each rule that at most
   this share of them is above. A tail is thus one cutoff a rule, and a wider tail is nowhere more lenient.
2. The labelled documents are the holdout, each text once. Tails are tested from the narrowest on: how probable are so few
   rejected good documents if more than ``RISK`` of the good ones were rejected? That is a sum of the binomial
   distribution, exact for every size. The first tail that is not below ``LEVEL``, divided by the number of strata
   (Bonferroni), ends the sequence, so within a stratum no further correction is due: with probability 1 - LEVEL no stratum's
   cutoffs reject more than RISK of its good documents.
3. Every tail before the end is safe at once, so one may choose among them: the one with the most rejected bad documents,
   less the rejected good ones; the narrowest of equals; none where this gains nothing.

All that is kept of the corpus are counts by stratum, rule and level, whatever its size. Too few labels in a stratum, or none,
certify nothing, and then the rules reject nothing there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.tools import column, durable, rename, slices, text_bytes

#: Shares of a hundred thousand documents beyond the cutoffs, from the most lenient to the strictest.
TAILS = (10, 20, 50, 100, 200, 500, 1000, 1500, 2000, 3000, 4000, 5000, 7000, 10000, 13000, 16000, 20000, 25000, 30000)
#: Share of good documents that may be rejected, and the probability that this is exceeded in any stratum.
RISK, LEVEL = 0.05, 0.05
#: Least words, and most hundredths of words in repeated windows of WINDOW words, of any document that is kept.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
RULES = ("symbols", "marks", "capitals", "repeated_lines", "repeated_words", "long_words")
#: Strata up to which their cutoffs (half a kilobyte each) are broadcast.
BROADCAST_STRATA = 10_000

_SYMBOLS = b"#*$%&|<>"
_SPACE_OR_INNER = bytes([32, *range(9, 14), *range(128, 192)])
_NOT_MARK = bytes(c for c in range(256) if c > 126 or c < 33 or chr(c).isalnum())
_NOT_CAPITAL = bytes(c for c in range(256) if not 65 <= c <= 90)
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals")


def repeated(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each list of words, how many stand in a window of consecutive words that the list holds twice or more.

    Words and windows are numbered by sorting: a window of five by the numbers of its halves. There are no hashes, so none collide.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), sizes)
    if not len(text):
        return np.zeros(len(texts), np.int64)
    join = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a
    name = join(text, words.indices.to_numpy(zero_copy_only=False).astype(np.int64))  # so that equal names are of one text
    names, width = name, 1
    while width * 2 <= window:
        names, width = join(names[:-width], names[width:]), width * 2
    for k in range(width, window):
        names = join(names[: len(name) - k], name[k:])
    names = names[: max(0, len(name) - window + 1)]
    inside = text[: len(names)] == text[len(text) - len(names) :]  # windows that do not pass from one text to the next
    at = np.flatnonzero(inside)
    twice = at[np.bincount(names[at], minlength=1)[names[at]] > 1]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=len(texts))


def _counted(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """_COUNTS without n_repeat_words."""
    seen, lines, copies = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            copies += line in seen
            seen.add(line)
    chars, left = len(text.translate(None, _SPACE_OR_INNER)), len(text.translate(None, _SYMBOLS))
    return len(words), chars, len(text) - left, copies, lines, len(text.translate(None, _NOT_MARK)), len(text.translate(None, _NOT_CAPITAL))


def measure(docs: DataFrame, stratum: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stratum, digest of the text, _COUNTS, base_failed, levels of RULES) per row of docs. Null texts have no words; a null stratum is the stratum ``""``."""
    rows = docs.select(column(id_col).alias("id"), F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), column(text_col).alias("text"))
    first = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields[:2]]

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                texts = text_bytes(part.column(2))
                words = [t.split() for t in texts]
                found = np.array([_counted(t, w) for t, w in zip(texts, words, strict=True)], np.int64).T
                columns = [*found[:4], repeated(words), *found[4:]]
                digests = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), digests, *map(pa.array, columns)], ["id", "stratum", "digest", *_COUNTS])

    schema = ", ".join(f"{n} {t}" for n, t in [*first, ("digest", "binary"), *((c, "long") for c in _COUNTS)])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    share = lambda a, b: F.floor(F.lit(1000) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    levels = F.array(
        share("n_symbols", "word_chars"), share("n_marks", "word_chars"), share("n_capitals", "word_chars"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), F.floor(F.lit(20) * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
    )
    return rows.mapInArrow(work, schema).withColumn("base_failed", failed).withColumn("levels", F.transform(levels, lambda x: F.least(x, F.lit(1000)).cast("int")))


def lower_tail(k: int, n: int, p: float) -> float:
    """The probability of at most k of n, each with probability p: the regularised incomplete beta function of 1 - p with n - k and k + 1, as a continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), k + 1.0, 1.0 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, p)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    keep = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1 / keep(1 - (a + b) * x / (a + 1))
    value, m = d, 0
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / keep(1 + even * d), keep(1 + even / c)
        value *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / keep(1 + odd * d), keep(1 + odd / c)
        value *= d * c
        if abs(d * c - 1) < 1e-14:
            front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
            return math.exp(front) * value / a


@F.arrow_udf(T.DoubleType())
def _tail(k: pa.Array, n: pa.Array, p: pa.Array) -> pa.Array:
    return pa.array([lower_tail(*x) for x in zip(k.to_pylist(), n.to_pylist(), p.to_pylist(), strict=True)], pa.float64())


def cutoffs(measured: DataFrame) -> DataFrame:
    """(stratum, cuts): for each rule the cutoffs of TAILS, by the levels of measured."""
    each = measured.where("not base_failed").select("stratum", F.posexplode("levels").alias("rule", "level")).groupBy("stratum", "rule", "level").agg(F.count(F.lit(1)).alias("n"))
    rule = Window.partitionBy("stratum", "rule")
    above = F.sum("n").over(rule.orderBy(F.desc("level"))) - F.col("n")
    each = each.withColumn("above", above).withColumn("total", F.sum("n").over(rule))
    tails = [F.min(F.when(F.col("above") * 100_000 <= F.col("total") * t, F.col("level"))) for t in TAILS]
    by_rule = each.groupBy("stratum", "rule").agg(F.array(*tails).alias("cut"))
    return by_rule.groupBy("stratum").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "cut"))), lambda r: r["cut"]).alias("cuts"))


def severity(levels: Column, cuts: Column) -> Column:
    """The number of the narrowest tail, from 1, whose cutoffs a document with these levels exceeds; one more than there are if none, or if there are no cutoffs."""
    within = F.zip_with(levels, cuts, lambda level, cut: F.size(F.filter(cut, lambda c: c >= level)))
    return F.coalesce(F.array_min(within), F.lit(len(TAILS))) + 1


def select(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id", good_col: str = "quality") -> DataFrame:
    """(stratum, cuts, good, false_rejections, bound, chosen) of every stratum that has cutoffs: the chosen tail by number, 0 for none, and what the holdout says of it.

    labels may hold an id more than once: it is good if one of its rows is. Null ids and null labels are no labels.
    """
    marks = rename(labels, id=id_col, good=good_col).where("id is not null and good is not null").groupBy("id").agg((F.max("good") == 1).alias("good"))
    held = measured.where("not base_failed").join(marks, "id", "left")
    cuts = durable(cutoffs(held.where("good is null")), "cuts")
    strata = cuts.count()
    small = F.broadcast(cuts) if strata <= BROADCAST_STRATA else cuts
    graded = held.where("good is not null").join(small, "stratum").select("stratum", "digest", "good", severity(F.col("levels"), F.col("cuts")).alias("at"))
    once = graded.groupBy("stratum", "digest").agg(F.max("good").alias("good"), F.min("at").alias("at"))  # equal texts are graded alike
    numbers = range(1, len(TAILS) + 1)
    count = lambda good, k: F.count(F.when((F.col("good") == good) & (F.col("at") <= k), 1))
    both = once.groupBy("stratum").agg(F.count(F.when(F.col("good"), 1)).alias("n"), F.array(*(F.struct(count(True, k).alias("good"), count(False, k).alias("bad")) for k in numbers)).alias("tails"))
    tested = both.select("stratum", "n", F.posexplode("tails").alias("k", "r")).where("n > 0").select("stratum", "n", (F.col("k") + 1).alias("k"), "r.good", "r.bad")
    tested = tested.withColumn("p", _tail("good", "n", F.lit(risk)))
    safe = F.min(F.col("p") <= level / max(strata, 1)).over(Window.partitionBy("stratum").orderBy("k"))
    gain = F.col("bad") - F.col("good")
    tested = tested.withColumn("safe", safe & (gain > 0))
    best = tested.where("safe").groupBy("stratum").agg(F.max_by(F.struct("n", "good", "p", "k"), F.struct(gain, -F.col("k"))).alias("b"))
    chosen = cuts.join(best, "stratum", "left").select("stratum", "cuts", F.col("b.n").alias("good"), F.col("b.good").alias("false_rejections"), F.col("b.p").alias("p_value"), F.coalesce("b.k", F.lit(0)).alias("chosen"))
    return durable(chosen, "chosen")


def judge(docs: DataFrame, labels: DataFrame, stratum: Column, risk: float = RISK, level: float = LEVEL, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality") -> DataFrame:
    """(doc_id, stratum, _COUNTS, base_failed, severity, chosen, failed_rules, kept) per row of docs.

    A row is kept if it passes the base rule (LEAST_WORDS words, no more than MOST_REPEATED hundredths of them in repeated windows) and
    the rules with the cutoffs that ``select`` chose for its stratum; failed_rules names those of RULES that it fails.
    Null and empty texts fail the base rule. Rows with a null id have no label and are judged like any; repeated rows
    are judged alike. labels needs ``id_col`` and good_col (1: good). Other columns, whatever their names, are left out.
    """
    measured = durable(measure(docs, stratum, id_col, text_col), "measured")
    found = select(measured, labels, risk, level, id_col, good_col)
    small = F.broadcast(found) if found.count() <= BROADCAST_STRATA else found
    judged = measured.join(small.select("stratum", "cuts", "chosen"), "stratum", "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))
    over = F.transform(F.arrays_zip("levels", "cuts"), lambda r: (F.col("chosen") > 0) & (r["levels"] > F.get(r["cuts"], F.col("chosen") - 1)))
    names = F.array(*map(F.lit, RULES))
    failed = F.coalesce(F.array_join(F.filter(F.zip_with(names, over, lambda n, o: F.when(o, n)), lambda n: n.isNotNull()), ","), F.lit(""))
    at = severity(F.col("levels"), F.col("cuts"))
    return judged.select(F.col("id").alias("doc_id"), "stratum", *_COUNTS, "base_failed", at.alias("severity"), "chosen", failed.alias("failed_rules"), (~F.col("base_failed") & (at > F.col("chosen"))).alias("kept"))
