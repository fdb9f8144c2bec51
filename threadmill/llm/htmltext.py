"""Main text of web pages: marked articles, and page differencing where none is marked.

Pages are dealt out by range of (host, path), so that neighbours in the order of URLs meet in one task; the pages
that a range needs from others are sent along. Of the nearest pages before and after it on its host whose lines
are not the same (copies say nothing of the template), each page is paired with the one that shares the longer
start of its path, the lines of the two are aligned by their longest common subsequence, and what both share is
the site's template. Shared lines
are deleted from everything that the page does not itself mark as its article: an article's own lines stay even
when another page repeats them, since copies of articles are common and are not template. In a page that marks
an article, all else is template. A page's header goes; a header inside an article holds that article's headings
and stays, unless its class, id or role names something that goes.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.tools import arrow_map, durable, rename, with_row_id

# Element names and words of class, id and role by which pages mark their parts.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg".split())
DROPPED = set("nav header footer aside form head menu dialog button select".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
NAMED = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored "
    "promo promotion banner notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search form "
    "comment comments reply replies discussion disqus share sharing social related recommended pagination pager widget toolbar skip".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
READERS = set("comment comments reply replies discussion disqus".split())
CONTENT = set("content article post entry story main".split())

#: Pairs of equal lines of two pages up to which they are gone through one by one.
MATCHES = 200_000

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z0-9]+")


def _zone(tag: str, attributes: str, around: str = "") -> str:
    """drop, article, main, content or nothing: what an element says of its contents. A header inside an article is that article's own."""
    marks, roles = set(), set()
    if attributes:
        for name, value in _MARK.findall(attributes):
            (roles if name.lower() == "role" else marks).update(_WORD.findall(value.lower()))
    if tag in ("html", "body"):
        return ""
    if tag in DROPPED and not (tag == "header" and around == "article") or roles & ROLES or (marks & READERS if tag in ("article", "main") else marks & NAMED) or re.search(r"\shidden(?=[\s=/]|$)", attributes):
        return "drop"
    if tag == "article" or "article" in roles:
        return "article"
    if tag == "main" or "main" in roles:
        return "main"
    return "content" if marks & CONTENT and tag in ("div", "section", "td") else ""


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page in their order, without dropped ones; zone: article, main, content or empty."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    part: list[str] = []
    rank = {"": 0, "content": 1, "main": 2, "article": 3, "drop": 4}

    def close():
        if part:
            zone = stack[-1][1] if stack else ""
            if zone != "drop" and (text := _SPACE.sub(" ", html.unescape("".join(part))).strip()):
                out.append((zone, text))
            part.clear()

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            part.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            part.append(" ")
        if tag not in BLOCK and tag not in DROPPED:
            zone = "" if m[1] or tag in VOID or not m[3] else _zone(tag, m[3])
            if zone != "drop" and not any(t == tag for t, _ in stack):
                continue
            if not m[1]:  # a marked inline element, or one of its name inside it
                close()
                stack.append((tag, max(zone, stack[-1][1] if stack else "", key=rank.get)))
                continue
        close()
        if not m[1] and stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "li"):
            stack.pop()  # its end tag was left out
        if tag in VOID or tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") and not m[3]:
            if m[1] and stack and stack[-1][0] == tag:
                stack.pop()
            continue
        if m[1]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
        else:
            if tag == "body":
                stack = [s for s in stack if s[0] != "head"]
            around = stack[-1][1] if stack else ""
            stack.append((tag, max(_zone(tag, m[3], around), around, key=rank.get)))
    if at < len(page):
        part.append(page[at:])
    close()
    return out


def _sparse(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence: a longest strictly increasing run of matching places."""
    places = defaultdict(list)
    for j, x in enumerate(b):
        places[x].append(j)
    tails: list[int] = []
    nodes: list[tuple] = []  # (place in a, the node before)
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    found, node = set(), nodes[-1] if nodes else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of b and the first 0, 1, ... lines of a, with the lines of a as bits of one number."""
    matches: dict = defaultdict(int)
    for i, x in enumerate(a):
        matches[x] |= 1 << i
    every = (1 << len(a)) - 1
    v = every
    for x in b:
        u = v & matches.get(x, 0)
        v = ((v + u) | (v - u)) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b.

    Equal starts and ends are taken off first. What is left goes by its matching places if these are few (``MATCHES``); else b
    is halved where its halves have the longest subsequences with two parts of a, so memory stays in proportion to the lines.
    """
    found: set[int] = set()
    tasks = [(0, len(a), 0, len(b))]
    while tasks:
        a0, a1, b0, b1 = tasks.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.add(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.add(a1)
        if a0 == a1 or b0 == b1:
            continue
        x, y = a[a0:a1], b[b0:b1]
        many = Counter(y)
        if b1 - b0 == 1 or sum(many[t] for t in x) <= MATCHES:
            found |= {a0 + i for i in _sparse(x, y)}
            continue
        half = (b1 - b0) // 2
        cut = int(np.argmax(_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]))
        tasks += [(a0, a0 + cut, b0, b0 + half), (a0 + cut, a1, b0 + half, b1)]
    return found


def main_text(own: list[tuple[str, str]], shared: set[int]) -> str:
    """The blocks of the page's strongest zone; without a zone, all that no neighbour shares."""
    for zone in ("article", "main", "content"):
        if any(z == zone for z, _ in own):
            return "\n".join(t for z, t in own if z == zone)
    return "\n".join(t for i, (_, t) in enumerate(own) if i not in shared)


def _alike(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def host_and_path(url):
    """The host (ASCII letters in lower case) and path of a url column; null or no ``://``: both empty."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(own: list[tuple[str, str]]) -> bytes:
    return hashlib.md5("\n".join(t for _, t in own).encode("utf-8", "surrogatepass")).digest()


def _edges(light: DataFrame) -> tuple[list, list[tuple[int, int, int]]]:
    """(last key of each range, [(range, side, row)]): the rows of other ranges that a range's first and last pages need."""
    row = F.struct("host", "path", "page_id", "tie", "rid", "digest")
    ends = durable(light.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last")), "ends")
    both = light.join(F.broadcast(ends), "part")
    second = both.where("host = first.host and digest <> first.digest").groupBy("part").agg(F.min(row).alias("second"))
    late = both.where("host = last.host and digest <> last.digest").groupBy("part").agg(F.max(row).alias("late"))
    found = ends.join(second, "part", "left").join(late, "part", "left").orderBy("part").collect()
    edges = []
    for side, own, near, far in ((-1, "first", "last", "late"), (1, "last", "first", "second")):
        for k, r in enumerate(found):
            j = k + side
            while 0 <= j < len(found) and found[j][near]["host"] == r[own]["host"]:
                if hit := next((x for x in (found[j][near], found[j][far]) if x and x["digest"] != r[own]["digest"]), None):
                    edges.append((k, side, hit["rid"]))
                    break
                if found[j]["first"]["host"] != found[j]["last"]["host"]:
                    break
                j += side
    return [r["last"] for r in found], edges


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) per row of pages. n_shared: lines that the page shares with its neighbour.

    Null or empty html gives an empty text. Pages without a host are neighbours of each other; a page that is alone on
    its host, or has only copies of itself there, has no neighbour and shares nothing. Results do not depend on how
    pages are dealt out. Null ids and urls are carried along. No text is cut.
    """
    spark = pages.sparkSession
    named = rename(with_row_id(pages, "__rid"), page_id=id_col, url=url_col, html=html_col, rid="__rid")
    host, path = host_and_path(F.col("url"))
    named = named.withColumns({"host": host, "path": path, "tie": F.xxhash64("html", "url")})

    def digests(batch):
        marks = [_digest(blocks(h or "")) for h in batch.column(5).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(marks, pa.binary())], ["host", "path", "page_id", "tie", "rid", "digest"])

    keys = named.select("host", "path", F.col("page_id").cast("long").alias("page_id"), "tie", "rid", "html")
    light = arrow_map(keys, "host string, path string, page_id long, tie long, rid long, digest binary", digests)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that ranges are not merged by the size of their keys
    light = durable(light.repartitionByRange(parts, "host", "path", "page_id").withColumn("part", F.spark_partition_id()), "light")
    bounds, edges = _edges(light)
    key = "struct<host:string,path:string,page_id:bigint>"
    limits = spark.createDataFrame([([(b["host"], b["path"], b["page_id"]) for b in bounds[:-1]],)], f"limits array<{key}>")
    place = F.expr(f"cast(size(filter(limits, x -> x < cast(struct(host, path, page_id) as {key}))) as int)")
    columns = ["page_id", "url", "html", "host", "path", "tie"]
    own = named.crossJoin(F.broadcast(limits)).select(*columns, place.alias("part"), F.lit(0).alias("side"))
    sent_along = named.join(F.broadcast(spark.createDataFrame(edges, "part int, side int, rid long")), "rid").select(*columns, "part", "side")
    near = own.union(sent_along).repartitionByRange("part").sortWithinPartitions("part", "side", "host", "path", "page_id", "tie").drop("tie")

    def work(batches):
        def rows():
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = blocks(row[2] or "")
                    yield row[0], row[1], row[3], row[4], row[5], row[6], own, [t for _, t in own]

        def judged(before, here, after):
            ends = [x for x in (before, after) if x and x[2] == here[2] and x[4] == here[4]]
            twin = max(ends, key=lambda x: _alike(x[3], here[3]), default=None)
            shared = common_lines(here[7], twin[7]) if twin else set()
            text = main_text(here[6], shared)
            return here[0], here[1], text, len(text), len(shared)

        def sent(found):
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["page_id", "url", "text", "n_chars", "n_shared"])

        def results():
            before, run = None, []  # run: neighbours of one host and range with the same lines
            for after in rows():
                if run and (after[2], after[4], after[7]) == (run[0][2], run[0][4], run[0][7]):
                    same = run[-1][6] if after[6] == run[-1][6] else after[6]
                    run.append((*after[:6], same, run[0][7]))
                    continue
                yield from (judged(before, here, after) for here in run if not here[5])
                before, run = run[-1] if run else None, [after]
            yield from (judged(before, here, None) for here in run if not here[5])

        found = []
        for result in results():
            found.append(result)
            if len(found) == 1000:
                yield sent(found)
                found = []
        yield sent(found)

    return near.mapInArrow(work, "page_id long, url string, text string, n_chars long, n_shared long")
