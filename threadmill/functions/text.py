"""Text functions as Column expressions.

Regular expressions spell their character classes out, because Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII by default
and its Unicode mode also takes combining marks for word characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def strip_end(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"{SPACE}+$", "")


def collapse(text: Column | str) -> Column:
    """Each stretch of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(text), f"{SPACE}+", " "))


def normalize_label(label: Column | str) -> Column:
    return collapse(F.lower(col(label)))


def words(text: Column | str) -> Column:
    """The stretches between white space."""
    return F.regexp_extract_all(col(text), F.lit(f"{NOT_SPACE}+"), F.lit(0))


def count_words(text: Column | str) -> Column:
    """Unicode letters, digits and underscores in a row count as a word."""
    return F.regexp_count(col(text), F.lit(f"{WORD}+"))


def count_words_joined(text: Column | str) -> Column:
    """Words in which apostrophes and hyphens may stand."""
    return F.regexp_count(col(text), F.lit(rf"{WORD}[\p{{L}}\p{{N}}_'-]*"))


def count_tokens(text: Column | str) -> Column:
    """The token count where no model is at hand: stretches between white space."""
    return F.regexp_count(col(text), F.lit(f"{NOT_SPACE}+"))


def search_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def has_alnum(text: Column | str) -> Column:
    return col(text).rlike("[A-Za-z0-9]")


def _tidy(text: Column) -> Column:
    """Line ends as LF, blanks and tabs as one blank, at most one blank line in a row, nothing at the ends."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def normalize_text(text: Column | str) -> Column:
    return _tidy(col(text))


def clean_text(title: Column | str | None, body: Column | str | None) -> Column:
    """Title and body with a blank line between, HTML comments as a blank, tidied; null when nothing is left."""
    parts = [F.nullif(strip(p), F.lit("")) for p in (title, body) if p is not None]
    text = F.regexp_replace(F.concat_ws("\n\n", *parts), r"(?s)<!--.*?-->", " ")
    return F.nullif(_tidy(text), F.lit(""))


def first_80(text: Column | str) -> Column:
    return F.substring(collapse(text), 1, 80)


def preview(text: Column | str, limit: int = 500) -> Column:
    """Collapsed text; when too long, cut hard and ended by three dots."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def preview_trimmed(text: Column | str, limit: int = 500) -> Column:
    """As ``preview``, but without white space before the dots."""
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(strip_end(F.substring(flat, 1, limit - 3)), F.lit("...")))


def trim_at_space(text: Column | str, limit: int) -> Column:
    """Cut before the last blank within limit, ended by a blank and three dots."""
    whole = strip(text)
    cut = F.substring(whole, 1, limit)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")  # its place from 0, or the length of cut if there is none
    shorter = F.when((F.instr(cut, " ") > 0) & (last > 0), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(strip_end(shorter), F.lit(" ...")))


def cap_for_prompt(text: Column | str, limit: int = 12_000) -> Column:
    whole = strip(text)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.substring(whole, 1, limit - 80), F.lit("\n\n[Issue text truncated for classification.]")))


def title_line(text: Column | str) -> Column:
    return strip(F.get(F.split(col(text), "\n", -1), F.lit(0)))


def opening(text: Column | str) -> Column:
    """The first two paragraphs that are not blank."""
    parts = F.filter(F.split(col(text), rf"\n{SPACE}*\n", -1), lambda p: strip(p) != "")
    return F.array_join(F.transform(F.slice(parts, 1, 2), strip), "\n\n")


# Words whose presence speaks for a label, and the points that they give in a title and in an opening.
CUES = {
    "bug": ("bug", "crash", "fail", "failure", "error", "exception", "broken", "regression"),
    "docs": ("doc", "documentation", "readme", "typo", "example", "guide", "link"),
    "feature": ("feature", "add", "support", "allow", "improve", "request", "proposal", "new"),
    "question": ("?", "how", "what", "why", "can i", "could", "help", "question"),
}
TITLE_POINTS, OPENING_POINTS, PREFIX_POINTS = 8, 3, 20


def signal_score(label: Column | str, text: Column | str, title: Column | str, cues: dict[str, tuple[str, ...]] = CUES) -> Column:
    """Points for the cues of the row's own label; each cue counts once in the title and once in the text."""
    text, title, label = F.lower(col(text)), F.lower(col(title)), col(label)
    own = F.create_map(*(x for k, v in cues.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[label]
    points = F.aggregate(own, F.lit(0), lambda n, c: n + F.when(F.contains(title, c), TITLE_POINTS).otherwise(0) + F.when(F.contains(text, c), OPENING_POINTS).otherwise(0))
    return points + F.when(title.startswith(F.concat(label, F.lit(":"))) | title.startswith(F.concat(label, F.lit(" -"))), PREFIX_POINTS).otherwise(0)


def is_structured(body: Column | str) -> Column:
    """Holds a code fence, a bulleted line or a numbered line."""
    body = col(body)
    return F.contains(body, F.lit("```")) | body.rlike(rf"(?m)^{SPACE}*[-*]{SPACE}+") | body.rlike(rf"(?m)^{SPACE}*\p{{Nd}}+[.)]{SPACE}+")


# The authors who count as maintainers, for the corpus and for the choice of holdout issues.
CORPUS_MAINTAINERS = ("MEMBER", "OWNER", "CONTRIBUTOR", "COLLABORATOR")
HOLDOUT_MAINTAINERS = ("MEMBER", "OWNER", "CONTRIBUTOR")


def is_maintainer(association: Column | str, among: tuple[str, ...] = CORPUS_MAINTAINERS) -> Column:
    return F.coalesce(F.upper(col(association)).isin(*among), F.lit(False))


def issue_id(github_id: Column | str, number: Column | str) -> Column:
    return F.coalesce(col(github_id), col(number)).cast("string")


def timestamp(text: Column | str, zone_required: bool = True) -> Column:
    """An ISO timestamp, or null if it does not parse or lacks a zone that is required."""
    text = col(text)
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    parsed = F.try_to_timestamp(text)
    return F.when(zoned, parsed) if zone_required else parsed


def doc_parent_id(source, parent) -> Column:
    return F.concat_ws(":", F.lit("doc"), col(source).cast("string"), F.lit("parent"), col(parent).cast("string"))


def doc_child_id(source, parent, child) -> Column:
    return F.concat_ws(":", F.lit("doc"), col(source).cast("string"), F.lit("parent"), col(parent).cast("string"), F.lit("child"), col(child).cast("string"))


def doc_naive_id(source, index) -> Column:
    return F.concat_ws(":", F.lit("doc"), col(source).cast("string"), F.lit("naive"), col(index).cast("string"))


def issue_parent_id(issue, comment, parent) -> Column:
    return F.concat_ws(":", F.lit("issue"), col(issue).cast("string"), F.lit("comment"), col(comment).cast("string"), F.lit("parent"), col(parent).cast("string"))


def issue_child_id(issue, comment, child) -> Column:
    return F.concat_ws(":", F.lit("issue"), col(issue).cast("string"), F.lit("comment"), col(comment).cast("string"), F.lit("child"), col(child).cast("string"))


def issue_naive_id(issue, comment, index) -> Column:
    return F.concat_ws(":", F.lit("issue"), col(issue).cast("string"), F.lit("comment"), col(comment).cast("string"), F.lit("naive"), col(index).cast("string"))


def is_child_id(chunk_id) -> Column:
    return F.contains(col(chunk_id), F.lit(":child:"))


# reStructuredText inline markup and what stays of it, in the order in which it is taken off.
INLINE = (
    (r":[\w.+-]+:`([^`<]*?)(?:\s*<[^>]*>)?`", "$1"),
    (r"`([^`<]*?)\s*<[^>]*>`__?", "$1"),
    (r"``([^`]+)``", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"\|([^|]+)\|", "$1"),
)


def clean_inline(text: Column | str) -> Column:
    return strip_end(reduce(lambda t, rule: F.regexp_replace(t, f"(?U){rule[0]}", rule[1]), INLINE, col(text)))


def parse_rewrites(raw: Column | str, n: int) -> Column:
    """The first n different lines that are left when numbers, bullets and quotes are taken off."""
    lines = F.split(F.regexp_replace(col(raw), r"\r\n?", "\n"), "\n", -1)
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(strip(F.regexp_replace(strip(x), rf"^(?:\p{{Nd}}+[.)]|[-*•]){SPACE}*", "")), "^[\"']+|[\"']+$", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: x != "")), 1, n)


def expand_queries(query: Column | str, rewrites: Column | str) -> Column:
    """The query first, then the rewrites that differ from it and from each other."""
    return F.array_distinct(F.concat(F.array(col(query)), F.filter(col(rewrites), lambda x: x.isNotNull() & (x != ""))))


def fill_prompt(template: Column | str, **values: Column | str) -> Column:
    """Literal replacement of {name}."""
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), kv[1].cast("string") if isinstance(kv[1], Column) else F.lit(str(kv[1]))), values.items(), col(template))


def with_query_instruction(text: Column | str, model: str) -> Column:
    """The prefix that one embedding model wants before queries."""
    return F.concat(F.lit("Represent this sentence for searching relevant passages: "), col(text)) if model == "bge-small" else col(text)


def difficulty(index: Column | str) -> Column:
    return F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (col(index) % 3 + 1).cast("int"))
