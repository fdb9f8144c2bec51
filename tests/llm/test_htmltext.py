import random

import pytest

from threadmill.llm import htmltext
from tests.llm.conftest import TINY

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x>y">Menu</a></li></ul></nav><!-- ad --><div class="cookie-notice">We use cookies<p>really</div>
<div class="ad">Buy</div><aside>Side</aside><article class="post"><h1>Title &amp; more</h1><p><b>First   line
 wraps<br><p>Second &eacute;&nbsp;x &lt;b&gt; a < b</p><div class="ad">Inner ad</div><form><input name=q>Search</form>
<p class="note">Third</p><ul><li>one<li class=x>two</ul><section id="comments"><p>A reader says</p></section></article>
<section class="comments"><article>Reader</article></section><footer>&copy; Us</footer></body></html>"""


def test_article():
    assert htmltext.main_text(htmltext.blocks(PAGE), set()) == "Title & more\nFirst line wraps\nSecond é x <b> a < b\nThird\none\ntwo"


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<script>x", ""), ("<!-- open", ""), ("<p>a<script>if (a<b) '</p>'</script>b</p>", "ab"), ("a<br>b", "a b"),
    ("<main><p>x</p></main><p>y</p>", "x"), ("<div id=content><p>x</p></div><p>y</p>", "x"), ("<div><span class='ad'>no <span>no</span></span>yes</div>", "yes"), ("<p title=\"a>b\">x</p>", "x"), ("</div><p>x</p></div>y", "x\ny"),
    ("<header><h1>site</h1></header><article><header><h1>h</h1><nav>menu</nav></header><p>x</p><footer>f</footer></article>", "h\nx"), ("<article><header class=banner>b</header><p>x</p></article>", "x"),
    ("<main><header><h1>site</h1></header><p>x</p></main>", "x"), ("<header><article><p>teaser</p></article></header><p>x</p>", "x"), ("<article><p hidden>h</p><p>x</p></article>", "x"), ("<ARTICLE><P>x</P></ARTICLE><FOOTER>y</FOOTER>", "x"),
])
def test_small_pages(page, text):
    assert htmltext.main_text(htmltext.blocks(page), set()) == text


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("matches", [0, 5, 200_000])
def test_common_lines_are_a_longest_subsequence(monkeypatch, matches):
    monkeypatch.setattr(htmltext, "MATCHES", matches)
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        found = htmltext.common_lines(a, b)
        assert len(found) == plain_lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in sorted(found))


def test_common_lines_of_many_equal_ones():
    a, b = ["x"] + ["cell"] * 20_000 + ["y"] + ["cell"] * 100, ["z"] + ["cell"] * 20_000 + ["w"] + ["cell"] * 50
    assert len(htmltext.common_lines(a, b)) == 20_050


def test_differencing_without_marked_articles(table):
    rows = [(i, f"http://h{i % 2}.org/a/{i}", f"<div>Our site</div><p>Body {i} one</p><div>Menu line</div><p>Body {i} two</p><div>All rights</div>") for i in range(40)]
    out = htmltext.extract(table(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"Body {i} one\nBody {i} two" for i in range(40)}


def unmarked(*lines):
    return "".join(f"<p>{x}</p>" for x in ("Our site", *lines, "All rights"))


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_copies_and_range_edges(spark, table, partitions):
    """Copies are not each other's template, and pages at the edge of a range still have their neighbours."""
    rows = [(i, f"http://h.org/a/{i:03}", unmarked(f"Body {i // 9}")) for i in range(54)]
    rows += [(100 + i, f"http://only.copies/{i}", unmarked("Alone")) for i in range(20)]
    rows += [(3, "http://h.org/a/003", unmarked("Body 0"))]
    docs = table(rows, "page_id long, url string, html string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = htmltext.extract(docs).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(out) == len(rows)
    assert {r["page_id"]: r["text"] for r in out} == {i: f"Body {i // 9}" if i < 100 else "Our site\nAlone\nAll rights" for i, _, _ in rows}


def test_edge_cases(table):
    rows = [(1, None, None), (None, "http://a.b/", "<p>x</p>"), (2, "no host", ""), (3, "http://a.b/c", "<article>" + "<p>long</p>" * 20_000 + "</article>"), (4, "http://q.r/", "<p>x"), (4, "http://q.r/", "<p>x")]
    docs = table([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, path int")
    out = sorted(((r["page_id"] or -1), r["url"], r["n_chars"]) for r in htmltext.extract(docs).collect() if r["page_id"] not in (4,))
    assert out == [(-1, "http://a.b/", 1), (1, None, 0), (2, "no host", 0), (3, "http://a.b/c", 5 * 20_000 - 1)]
    assert htmltext.extract(table([], "page_id long, url string, html string")).count() == 0


def test_pages(spark):
    pages = spark.read.parquet(f"{TINY}/pages.parquet")
    out = {r["page_id"]: r for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inside = r["html"].split("<article>")[1].split("</article>")[0]
        assert out[r["page_id"]]["text"] == htmltext.main_text(htmltext.blocks(f"<article>{inside}</article>"), set())
        assert out[r["page_id"]]["n_chars"] == len(out[r["page_id"]]["text"])
