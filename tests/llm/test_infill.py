import hashlib
import random
import re

from pyspark.sql import functions as F

from threadmill.llm import infill


def plain(i, text):
    """(n, form, prefix, middle, output) by the definition."""
    text, name = text or "", "" if i is None else str(i)
    found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    p, q = sorted((h[0] % (len(found) + 1), h[1] % (len(found) + 1)))
    a, b, c = "".join(found[:p]), "".join(found[p:q]), "".join(found[q:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(found), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(found), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(found), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


TEXTS = ["", None, "a", "ab cd", "é", "日本語 text", "a<P>b", "<", "<<S", "S><M", "a\n\nb\x00c", "😀😀 x😀y", "ABC" * 50_000 + "é1" * 50_000, "word " * 30_000, " ", " a", "x" * 70_000]


def test_rows_equal_the_definition_and_come_back(table):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abZ éß日😀<PSM> .\n") for _ in range(rng.randrange(0, 60))) for _ in range(600)]
    rows = [*enumerate(texts), (3, "ab cd"), (None, "no name here"), (None, None)]
    docs = table([(*r, "x", "y") for r in rows], "doc_id long, text string, cut string, form string")
    out = infill.fill_in_middle(docs)
    found = out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted(((i, t or "", *plain(i, t)) for i, t in rows), key=key)
    assert all(r.back == r.text for r in found)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(table([])).count() == 0


def test_ranked_bits():
    rng = random.Random(1)
    for width in (1, 2, 3, 63, 64, 65, 1000):
        mask = rng.getrandbits(width) | 1
        places = [k for k in range(width) if mask >> k & 1]
        assert [infill.ranked(mask, width, r) for r in range(len(places))] == places


def test_borders_are_those_of_the_tokens():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("abXZ 1é日😀\n") for _ in range(rng.randrange(0, 40)))
        starts, points = infill.borders(text.encode())
        assert starts.bit_count() == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))
        assert points.bit_count() == len(text)
