"""Secrets in text: three fixed shapes, and tokens that pass a battery of randomness tests.

DataFrame functions only. The places of a pattern's matches come from the text between them: ``split`` gives the
gaps and ``regexp_extract_all`` the matches, and running sums of their lengths are the starts, in code points.

The battery looks at tokens of at least 16 characters of the base64 alphabets that are not plain words (letters
in lower case but for the first). A token's encoding is the smallest alphabet that holds it. Against even use of that alphabet stand three tests,
each as a standard score: chi-squared of the character counts (cube-root normal form), Wald-Wolfowitz runs of
low and high characters, and lag-one serial correlation of the character values. The token's score is the
largest of the three in size: near 0 for what a generator draws, large for words and for what people make up.

How large still counts is set by control of the false-discovery rate in each length class: long words of the same
corpus, which are no secrets, go through the same tests (as characters of a-z) and show how scores fall without
secrets (``cuts``). Only a histogram, ``BINS`` scores by the length classes, reaches the driver for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.text import let
from threadmill.llm.tools import durable, rename

# The shapes of secrets that are always reported, with the least length of the tested part.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of 24 is found as a whole, so shorter runs need no second look
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
WORD = "abcdefghijklmnopqrstuvwxyz"
#: Upper ends of the length classes but the last, bins of a score, bins in one unit of it, rate of false discoveries.
LENGTHS, BINS, PER_UNIT, RATE = (19, 23, 31, 47, 79), 64, 8, 0.05
#: The largest of three standard scores of drawn tokens is below this in 99 of 100 cases.
UNKNOWN = 2.9


def _scan(values: Column, start: Column) -> Column:
    """start, start + values[0], start + values[0] + values[1], ... as many as there are values."""
    first = F.struct(start.cast("int").alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, first, step, lambda acc: acc["out"])


def running(values: Column) -> Column:
    """The sums of the values before each, in blocks as many as they are long, so that long arrays are not copied for each value."""

    def in_blocks(v):
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
        sums = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, _scan(sums(bs), F.lit(0)), _scan)))

    return let(values, in_blocks)


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, token>> of the leftmost non-overlapping matches; start in code points."""

    def found(tokens):
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(tokens))
        lengths = F.zip_with(gaps, tokens, lambda g, t: F.struct(F.length(g).alias("g"), (F.length(g) + F.length(t)).alias("n")))
        starts = let(lengths, lambda x: F.zip_with(x, running(F.transform(x, lambda y: y["n"])), lambda y, at: y["g"] + at))
        return F.zip_with(starts, tokens, lambda at, t: F.struct(at.alias("start"), t.alias("token")))

    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), let(tokens, found)).otherwise(F.expr("cast(array() as array<struct<start: int, token: string>>)"))


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["token"])).alias("end")))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def battery(token: Column, alphabet: Column) -> Column:
    """The largest of the three test scores of a token over an alphabet."""
    zero, add = F.lit(0.0), lambda a, v: a + v
    pairs = lambda x: F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("x"), F.slice(x, F.lit(2), F.size(x) - 1).alias("y"))

    def tests(values, size):
        n, df = F.size(values).cast("double"), size - 1
        squares = F.aggregate(F.array_distinct(values), zero, lambda a, v: a + F.pow(F.size(F.filter(values, lambda x: x == v)), F.lit(2)))
        chi = squares * size / n - n
        uniform = (F.pow(F.greatest(chi, zero) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

        def runs(high):
            def score(ups, turns):
                mean = 2 * ups * (n - ups) / n + 1
                spread = (mean - 1) * (mean - 2) / (n - 1)
                return F.when((ups < 1) | (ups > n - 1), F.sqrt(n)).otherwise((turns - mean) / F.sqrt(F.greatest(spread, F.lit(0.25))))

            turns = F.aggregate(pairs(high), F.lit(1.0), lambda a, p: a + (p["x"] != p["y"]).cast("double"))
            return let(F.aggregate(high, zero, add), lambda ups: let(turns, lambda t: score(ups, t)))

        def serial(around):
            total, lagged = F.aggregate(around, zero, lambda a, v: a + v * v), F.aggregate(pairs(around), zero, lambda a, p: a + p["x"] * p["y"])
            return let(total, lambda t: F.when(t <= 0, F.sqrt(n)).otherwise((lagged / t + 1 / n) * F.sqrt(n)))

        middle = F.aggregate(values, zero, add) / n
        return F.greatest(
            F.abs(uniform), F.abs(let(F.transform(values, lambda v: (v > (size + 1) / 2).cast("double")), runs)),
            F.abs(let(let(middle, lambda m: F.transform(values, lambda v: v - m)), serial)),
        )

    values = lambda a: F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(a, c).cast("double"))
    return let(alphabet, lambda a: let(F.length(a).cast("double"), lambda size: let(values(a), lambda v: tests(v, size))))


def _length_class(n: Column) -> Column:
    return reduce(lambda out, k: F.when(n <= LENGTHS[k], F.lit(k)).otherwise(out), reversed(range(len(LENGTHS))), F.lit(len(LENGTHS)))


def _scored(found: Column, alphabet) -> Column:
    """array<struct<start, token, class, bin>>"""
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), m["token"].alias("token"), _length_class(F.length(m["token"])).alias("class"),
        F.least(F.lit(BINS - 1), F.floor(battery(F.rtrim(m["token"], F.lit("=")), alphabet(m["token"])) * PER_UNIT)).cast("int").alias("bin"),
    ))


def _encoding(token: Column) -> Column:
    out = F.lit(ALPHABETS[-1])
    for alphabet in reversed(ALPHABETS[:-1]):
        out = F.when(F.rtrim(F.translate(F.rtrim(token, F.lit("=")), alphabet, "")) == "", F.lit(alphabet)).otherwise(out)
    return out


def cuts(histogram: list[tuple[int, int, int, int]]) -> dict[int, int]:
    """From (length class, bin, tokens, words): the highest bin of each class at which at most RATE of the tokens are false.

    With W and T the shares of words and tokens up to a bin, a share p W / T of these tokens is false, where p, the
    share of tokens that are no secrets, is what lies above the words' median, against the words that do. A
    class is judged by the words of its own length and shorter, since long ones are few; a class without any is cut where
    the tests leave out one of a hundred drawn tokens (``UNKNOWN``). The last bin, which holds all higher scores, is never taken.
    """
    out = {}
    for k in range(len(LENGTHS) + 1):
        tokens, words = [0] * BINS, [0] * BINS
        for c, b, t, w in histogram:
            tokens[b] += t * (c == k)
            words[b] += w * (c <= k)
        n, m = sum(tokens), sum(words)
        if not n:
            continue
        if not m:
            out[k] = int(UNKNOWN * PER_UNIT)
            continue
        below = lambda x, b: sum(x[: b + 1])
        median = next(b for b in range(BINS) if 2 * below(words, b) >= m)
        above = max(m - below(words, median), 1)
        false = min(1.0, (n - below(tokens, median) + 1) / n * m / above)
        fit = [b for b in range(BINS - 1) if tokens[b] and false * (below(words, b) + 1) / (m + 1) <= RATE * below(tokens, b) / n]
        if fit:
            out[k] = max(fit)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, spans (array of struct(start, kind, end), kind an index of KINDS, in the order of start and kind).

    Null text counts as empty and has no spans. Null ids are carried along and repeated rows each give a row;
    spans of two kinds may overlap, those of one kind cannot. An empty table gives no rows. Texts are scanned
    whole. Columns other than id and text are not read.
    """
    named = rename(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    found = named.select(
        "id",
        F.filter(places(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["token"], ASSIGN, 1)) >= 6).alias("assign"),
        F.filter(places(text, ACCESS), lambda m: F.length(m["token"]) >= 20).alias("access"),
        places(text, HEX).alias("hex"),
        places(text, TOKEN).alias("tokens"),
    )
    mixed = F.filter("tokens", lambda m: ~m["token"].rlike("^[A-Za-z]?[a-z]+$"))
    words = F.filter("tokens", lambda m: m["token"].rlike("^[A-Za-z]?[a-z]+$"))
    found = durable(found.select(
        "id", "assign", "access", "hex", _scored(mixed, _encoding).alias("tokens"),
        _scored(F.transform(words, lambda m: F.struct(m["start"].alias("start"), F.lower(m["token"]).alias("token"))), lambda t: F.lit(WORD)).alias("words"),
    ), "secrets")
    counted = found.select(F.explode(F.concat(
        F.transform("tokens", lambda m: F.struct(m["class"].alias("class"), m["bin"].alias("bin"), F.lit(1).alias("token"), F.lit(0).alias("word"))),
        F.transform("words", lambda m: F.struct(m["class"].alias("class"), m["bin"].alias("bin"), F.lit(0).alias("token"), F.lit(1).alias("word"))),
    )).alias("m")).groupBy("m.class", "m.bin").agg(F.sum("m.token").alias("tokens"), F.sum("m.word").alias("words"))
    cut = cuts([tuple(r) for r in counted.collect()])  # at most BINS x classes rows
    limit = lambda c: reduce(lambda out, k: F.when(c == k, F.lit(cut[k])).otherwise(out), cut, F.lit(-1))
    random = F.filter("tokens", lambda m: m["bin"] <= limit(m["class"]))
    spans = F.array_sort(F.concat(_spans(F.col("assign"), 0), _spans(F.col("access"), 1), _spans(F.col("hex"), 2), _spans(random, 3)))
    return found.select(F.col("id").alias(id_col), spans.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The counts of the fixed shapes, a hash of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scanned.select(*(c for c in scanned.columns if c != "spans"), *map(count, range(3)), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count(3))
