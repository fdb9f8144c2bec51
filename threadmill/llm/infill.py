"""Fill-in-the-middle: texts are cut at two token borders, and their parts are written in another order.

A token is a run of ASCII letters or any other one code point. A text's bytes become big integers with a bit a byte:
``bytes.translate`` gives the digits of a class mask (letters, inner bytes of code points), and shifted boolean operations
leave the bits where tokens begin. ``bit_count`` gives their number, and a border is found by halving the integer again
and again, on the side that holds the bit of the wanted rank. Only the lengths of the parts leave Python; cutting and
joining are column expressions.
"""

from __future__ import annotations

from string import ascii_letters

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.tools import rename

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rewritten, and of a hundred of these so many begin with their suffix.
REWRITTEN, SUFFIX_FIRST = 90, 20

_LETTER = bytes(49 if c < 128 and chr(c) in ascii_letters else 48 for c in range(256))
_INNER = bytes(49 if 128 <= c < 192 else 48 for c in range(256))


def borders(data: bytes) -> tuple[int, int]:
    """(mask of the bytes at which a token begins, mask of those at which a code point does); bit k is byte k."""
    if not data:
        return 0, 0
    turned = data[::-1]
    letters, inner = int(turned.translate(_LETTER), 2), int(turned.translate(_INNER), 2)
    points = inner ^ ((1 << len(data)) - 1)
    return points & ~(letters & (letters << 1)), points


def ranked(mask: int, width: int, rank: int) -> int:
    """The place of the set bit of this rank, counted from 0, in a mask of width bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            mask, width = low, half
        else:
            mask, width, at, rank = mask >> half, width - half, at + half, rank - n
    return at


def cut(data: bytes, a: int, b: int) -> tuple[int, int, int]:
    """(tokens, code points of the prefix, code points of the middle) for the draws a and b."""
    starts, points = borders(data)
    n = starts.bit_count()
    upto = []
    for rank in sorted((a % (n + 1), b % (n + 1))):
        place = len(data) if rank == n else ranked(starts, len(data), rank)
        upto.append((points & ((1 << place) - 1)).bit_count())
    return n, upto[0], upto[1] - upto[0]


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("n", "prefix", "middle")]))
def _cut(data: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    found = [cut(x.as_py() or b"", h1, h2) for x, h1, h2 in zip(data, a.to_pylist(), b.to_pylist(), strict=True)]
    columns = list(zip(*found, strict=True)) or [()] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "prefix", "middle"])


def draws(name: Column, seed: int = 1) -> list[Column]:
    """Four unsigned integers of 32 bits for each name, which seed and name alone decide."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) per row of docs.

    Prefix and middle end after so many of the n tokens as two draws by (seed, id) say. form is ``psm`` or ``spm`` by the
    order of the parts in output, or ``plain``, where output is the text and the lengths are null: for empty texts, for
    those that hold a marker themselves, and for REWRITTEN's rest. Null texts are empty ones. Null ids draw as
    empty names do; rows that repeat an id draw alike. Other columns of docs, whatever their names, are left out.
    """
    rows = rename(docs, id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= REWRITTEN)
    form = F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    rows = rows.select("id", "text", form.alias("form"), _cut(F.col("text").cast("binary"), h1, h2).alias("cut"))
    p, m = F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), p), F.substring("text", p + 1, m), F.substring("text", p + m + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    rewritten = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias("doc_id"), "text", F.col("cut.n").alias("n"), "form",
        F.when(rewritten, F.col("cut.prefix")).alias("prefix_chars"), F.when(rewritten, F.col("cut.middle")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` wrote as output. The parts hold no marker, and a marker's signs do not overlap, so the parts are what stands between markers."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # of which the first is empty
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
