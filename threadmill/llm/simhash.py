"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint holds one or several words of 64 bits: a bit is 1 where over half of its shingles'
hashes have it set. A key is a stretch of fingerprint bits; fingerprints that agree in the key's first bits stand in one
trie. Such a trie is joined with itself by traversing pairs of nodes together from the root pair down: a pair's
children that differ in the next bit use up one bit of the budget, and a pair is pruned when the budget is exceeded.
The tries of a task are sorted arrays, their nodes are ranges of them, and a whole level of pairs is handled in one
vector operation. Only what connects a trie's links leaves the task, so copies by the thousand never become all
their pairs. ``graph.components`` joins the edges up.

Two sets of keys are in use. ``agreeing`` loses nothing: words that differ in at most ``budget`` bits agree wholly in some
of their blocks, and as the table grows more blocks are put in front, so that tries stay small. ``windows`` is for
similarity of texts (``dedup``), where fingerprints of similar texts differ in many bits: short stretches of a long fingerprint,
of which a similar pair most likely agrees in one but for the budget. Sets of few shingles have rough fingerprints, so similar ones
among them meet by their lowest shingles as well, of which they share one at least. What is found is decided by the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm import jaccard
from threadmill.llm.graph import components, local_components
from threadmill.llm.tools import arrow_map, column, durable, free_name, ranges, rename, text_bytes, with_row_id

_STEP = 0x9E3779B97F4A7C15
#: Cells that are compared bit by bit, of a pair of nodes and at once.
LEAF, CELLS = 256, 1 << 19
#: Rows of a task that are held at once, the size from which a trie counts as hot and is cut into tiles, and the usual size that tries are to stay under.
HELD, TILE, USUAL = 100_000, 4096, 1024
#: Of ``dedup``: words of a fingerprint, bits of a key and of them those that must agree, the budget for the others, bits
#: from one key to the next, and how many of the first 128 bits may differ. Pairs of similarity 0.8 are found in 98 of 100 cases.
#: The first three are those of tables of up to ``TILE << AGREE`` texts; for larger ones see ``agreed``.
WORDS, KEY, AGREE, BUDGET, STEP, APART = 8, 32, 10, 4, 18, 30
#: So many times as many keys make up for one more bit that must agree: a bit of texts of similarity 0.8 differs with probability 0.15.
GROWTH = 1.18
#: Sets of up to so many shingles meet by their lowest shingles too.
FEW = 32


def majority(hashes: np.ndarray, words: int = 1) -> list[int]:
    """The fingerprint words of some hashes: the first from the hashes themselves, each further one from another hash of them."""
    ones = np.zeros((words, 8, 8), np.int64)
    for at in range(0, len(hashes), 1 << 14):  # in parts, so that a very long text takes no more memory
        part = np.repeat(hashes[None, at : at + (1 << 14)], words, 0)
        if words > 1:
            part[1:] = jaccard.mixed(part[1:] + (np.arange(1, words, dtype=np.uint64) * np.uint64(_STEP))[:, None])
        edges = np.arange(0, part.shape[1], 255)  # as many as an octet can count
        for bit in range(8):
            counted = np.add.reduceat((part >> np.uint64(bit)) & np.uint64(0x0101010101010101), edges, axis=1)
            ones[:, :, bit] += counted.astype("<u8").view(np.uint8).reshape(words, -1, 8).sum(1, dtype=np.int64)
    packed = np.packbits(ones.ravel() * 2 > len(hashes), bitorder="little").tobytes()
    return [int.from_bytes(packed[8 * w : 8 * w + 8], "little") for w in range(words)]


def fingerprint(text: bytes, shingle: int, words: int = 1) -> list[int]:
    """The unsigned fingerprint words of a UTF-8 text; no words in the text: zero."""
    tokens = text.lower().split()
    if not tokens:
        return [0] * words
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(joined[a:b], 42) for a, b in zip(starts[: len(tokens) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)),
            np.uint64, len(tokens) - shingle + 1,
        )
    return majority(hashes, words)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(rid, id, w0, w1, ...) per row of docs, the words as signed longs. rid numbers the rows of docs. Null text: no words."""
    named = [f"w{k}" for k in range(words)]

    def work(batch):
        found = np.array([fingerprint(t, shingle, words) for t in text_bytes(batch.column(2))], np.uint64).reshape(-1, words)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, k].view(np.int64)) for k in range(words))], ["rid", "id", *named])

    return arrow_map(rename(with_row_id(docs, free_name(docs, "rid")), rid=free_name(docs, "rid"), id=id_col, text=text_col), "rid long, id long, " + ", ".join(f"{w} long" for w in named), work)


def _leaf_links(keys, alo, ahi, blo, bhi, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compares the fingerprints of small node pairs one by one, at most about CELLS at a time."""
    total = np.cumsum((ahi - alo) * (bhi - blo))
    pair = 0
    while pair < len(alo):
        upto = max(pair + 1, int(np.searchsorted(total, (total[pair - 1] if pair else 0) + CELLS, "right")))
        a, b, c, d = alo[pair:upto], ahi[pair:upto], blo[pair:upto], bhi[pair:upto]
        pair = upto
        rows = ranges(a, b - a)  # each fingerprint of the first node with the range of the second
        own = np.repeat(a == c, b - a)
        lo, hi = np.repeat(c, b - a), np.repeat(d, b - a)
        lo = np.maximum(lo, np.where(own, rows + 1, 0))
        sizes = np.maximum(hi - lo, 0)
        many = np.cumsum(sizes)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + CELLS, "right")))
            i, j = np.repeat(rows[at:to], sizes[at:to]), ranges(lo[at:to], sizes[at:to])
            close = np.bitwise_count(keys[i] ^ keys[j]) <= budget
            yield i[close], j[close]
            at = to


def trie_links(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of sorted keys at most budget bits apart, within the tries keys[lo:hi], whose keys agree in the first depth bits."""
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, spent = stack.pop()
        if len(alo) > CELLS // 2:  # depth first in parts, so that memory stays bounded
            half = len(alo) // 2
            stack += [(depth, *(x[half:] for x in (alo, ahi, blo, bhi, spent))), (depth, *(x[:half] for x in (alo, ahi, blo, bhi, spent)))]
            continue
        leaf = ((ahi - alo) * (bhi - blo) <= LEAF) | (depth == 64)
        if leaf.any():
            yield from _leaf_links(keys, alo[leaf], ahi[leaf], blo[leaf], bhi[leaf], budget)
            alo, ahi, blo, bhi, spent = (x[~leaf] for x in (alo, ahi, blo, bhi, spent))
        if not len(alo):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((keys >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        c = ones[depth]
        am, bm, own = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo]), alo == blo
        down = [(alo, am, blo, bm, spent, None), (am, ahi, bm, bhi, spent, None), (alo, am, bm, bhi, spent + 1, None), (am, ahi, blo, bm, spent + 1, ~own)]
        parts = []
        for pa_lo, pa_hi, pb_lo, pb_hi, cost, only in down:
            keep = (pa_hi > pa_lo) & (pb_hi > pb_lo) & (cost <= budget) & ~((pa_lo == pb_lo) & (pa_hi - pa_lo < 2))
            keep = keep if only is None else keep & only
            parts.append([x[keep] for x in (pa_lo, pa_hi, pb_lo, pb_hi, cost)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _edges(trie: np.ndarray, keys: np.ndarray, ids: np.ndarray, others: list[np.ndarray], depth: np.ndarray, budget: int, total: int | None):
    """Edges that connect the links of some tries, and where total is given, of each row the link with the fewest bits too; rows are sorted by trie and key."""
    starts = np.flatnonzero(np.concatenate(([True], (trie[1:] != trie[:-1]))))
    ends = np.append(starts[1:], len(trie))
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)  # by id, so that the tries of all keys take the same rows for their centres
    place[order] = np.arange(len(ids))
    ids, labels, nearest = ids[order], None, np.full(len(keys), 1 << 62)
    for bits in np.unique(depth):
        of = (depth[starts] == bits) & (ends - starts > 1)
        for i, j in trie_links(keys, starts[of], ends[of], int(bits), budget):
            i, j = place[i], place[j]
            if total is not None and len(i):
                apart = sum(np.bitwise_count(w[order[i]] ^ w[order[j]]).astype(np.int64) for w in others)
                i, j, apart = (x[apart <= total] for x in (i, j, apart))
                np.minimum.at(nearest, i, apart << 32 | j)
                np.minimum.at(nearest, j, apart << 32 | i)
            if len(i):
                labels = local_components(len(keys), i, j, labels)
    if labels is None:
        return ids[:0], ids[:0]
    linked, near = labels != np.arange(len(labels)), nearest < 1 << 62
    return np.concatenate((ids[linked], ids[near])), np.concatenate((ids[labels[linked]], ids[nearest[near] & 0xFFFFFFFF]))


def _arranged(runs: list[tuple[str, int, int]]) -> str:
    """SQL of a 64-bit key that has runs (word, first bit, bits) side by side from its highest bit on, and zeros after them."""
    parts, at = [], 0
    for word, first, bits in runs:
        run = f"shiftrightunsigned({word} << {first}, {64 - bits})"
        parts.append(f"({run} << {64 - at - bits})")
        at += bits
    return " | ".join(parts)


def agreeing(word: str, budget: int, rows: int) -> list[tuple[str, int]]:
    """(key, depth): whichever bits of a word differ, at most budget of them, one of the keys agrees in its first depth bits.

    Of budget + r blocks r agree. r is the least for which an even table of so many rows has tries of at most ``USUAL`` rows.
    """
    for r in range(1, 5):
        n = budget + r
        cuts = [64 * k // n for k in range(n + 1)]
        sizes = [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if rows >> sum(sorted(sizes)[:r]) <= USUAL:
            break
    keys = []
    for front in combinations(range(n), r):
        order = [*front, *(k for k in range(n) if k not in front)]
        keys.append((_arranged([(word, cuts[k], sizes[k]) for k in order]), sum(sizes[k] for k in front)))
    return keys


def agreed(rows: int) -> int:
    """How many bits of a stretch must agree so that an even table of so many texts has tries of at most ``TILE``."""
    return next(bits for bits in range(AGREE, 64) if rows >> bits <= TILE)


def lengths(agree: int) -> int:
    """Words of a fingerprint whose stretches find as many pairs with so many bits that must agree as those of ``WORDS`` words with ``AGREE``."""
    return ceil(WORDS * GROWTH ** (agree - AGREE))


def windows(agree: int = AGREE) -> list[tuple[str, int]]:
    """(key, depth): stretches of KEY bits, or more by what agree is above AGREE, STEP bits apart, the last of them going on with the first word.

    With the table, both the bits that must agree and the number of stretches grow: a table of twice the size has 1.18 times as many keys,
    and its tries stay as they are.
    """
    keys, size, words = [], KEY + agree - AGREE, lengths(agree)
    for at in range(0, 64 * words, STEP):
        word, first = divmod(at, 64)
        here = min(size, 64 - first)
        runs = [(f"w{word}", first, here)] + ([(f"w{(word + 1) % words}", 0, size - here)] if here < size else [])
        keys.append((_arranged(runs), agree))
    return keys


def links(units: DataFrame, keys: list[tuple[str, int]], budget: int, checked: tuple[str, ...] = (), total: int | None = None) -> DataFrame:
    """(a, b): edges that connect all units(uid, w0, ...) of which a key is at most budget bits apart and, if total is given, the checked words total bits at most."""
    numbers = ", ".join(f"named_struct('trie', {n}, 'depth', {depth}, 'key', {key})" for n, (key, depth) in enumerate(keys))
    rows = units.select("uid", *checked, F.explode(F.expr(f"array({numbers})")).alias("t")).select("uid", *checked, "t.*")
    rows = rows.withColumn("prefix", F.expr("shiftrightunsigned(key, 64 - depth)"))
    # A hot trie is cut into chunks of about TILE rows, and each pair of chunks becomes a tile of its own. There are
    # fewer than rows / TILE such tries, most often none at all.
    hot = rows.groupBy("trie", "prefix").count().where(F.col("count") > TILE).select("trie", "prefix", F.ceil(F.col("count") / TILE).cast("int").alias("chunks"))
    cut = rows.join(hot, ["trie", "prefix"], "left").withColumn("chunk", F.expr("pmod(xxhash64(uid), coalesce(chunks, 1))"))
    cut = cut.withColumn("tile", F.explode(F.expr("transform(sequence(0L, coalesce(chunks, 1) - 1L), x -> least(x, chunk) * 1000000 + greatest(x, chunk))")))
    cut = cut.select("trie", "prefix", "tile", "depth", "key", "uid", *checked).repartition("trie", "prefix", "tile").sortWithinPartitions("trie", "prefix", "tile")

    def work(batches):
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            a = {c: table[c].to_numpy() for c in table.column_names}
            own = a["key"].view(np.uint64)
            new = np.concatenate(([True], (a["trie"][1:] != a["trie"][:-1]) | (a["prefix"][1:] != a["prefix"][:-1]) | (a["tile"][1:] != a["tile"][:-1]))) if len(own) else np.zeros(0, bool)
            number = np.cumsum(new)
            order = np.lexsort((own, number))
            x, y = _edges(number[order], own[order], a["uid"][order], [a[c][order].view(np.uint64) for c in checked], a["depth"][order], budget, total)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                last = tuple(table[c][-1].as_py() for c in ("trie", "prefix", "tile"))
                same = (table["trie"].to_numpy() == last[0]) & (table["prefix"].to_numpy() == last[1]) & (table["tile"].to_numpy() == last[2])
                first = int(np.argmax(same))
                if first:
                    yield done(table.slice(0, first))
                    held = table.slice(first).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks())

    return cut.mapInArrow(work, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """(rid, id, w0, root, component_id) per row of docs: root numbers the class, component_id is the smallest id in it.

    Null and blank texts have fingerprint zero and are linked like any other. Null ids never become the
    component_id of a class that has another; repeated rows belong to one class. Texts shorter than a shingle
    count as one shingle. An empty table gives no rows. Columns other than id and text are not read.
    """
    rows = durable(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    units = durable(rows.groupBy("w0").agg(F.min("rid").alias("uid"), F.min("id").alias("least")), "units")
    roots = components(links(units, agreeing("w0", budget, units.count()), budget))
    units = units.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    units = durable(units, "classes")
    least = units.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(units.join(least, "root").select("w0", "root", "component_id"), "w0").select("rid", "id", "w0", "root", "component_id")


def lowest(found: np.ndarray, percent: int) -> list[int]:
    """The lowest shingles of a sorted set, so many that any set of this similarity shares one of its own lowest: all but the shared ones, and one. Large sets: none."""
    n = len(found)
    return found[: n + n * percent // -100 + 1].view(np.int64).tolist() if n <= FEW else []


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(rid, id, root) per row of docs: rows of one root are connected by pairs of texts of similarity percent / 100 or more.

    Similarity is that of the sets of shingles (Jaccard). Tries over ``windows`` of the sets' fingerprints find the candidates, and of
    sets of few shingles a common one among their ``lowest``; the sets decide. rid numbers the rows of docs, which must be a table scan or another plan with fixed partitions. Null and
    blank texts are equal to each other and like no other text; equal sets are one unit from the start.
    """
    texts = rename(with_row_id(docs, free_name(docs, "rid")), rid=free_name(docs, "rid"), id=id_col, text=text_col)
    agree = agreed(texts.count())
    words = [f"w{k}" for k in range(lengths(agree))]

    def named(batch):
        sets = [jaccard.shingles(t, shingle) for t in text_bytes(batch.column(2))]
        prints = np.array([majority(x, len(words)) for x in sets], np.uint64).reshape(-1, len(words))
        nodes = pa.array([jaccard.node(x) for x in sets], pa.int64())
        heads = pa.array([lowest(x, percent) for x in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, *(pa.array(prints[:, k].view(np.int64)) for k in range(len(words))), heads], ["rid", "id", "uid", *words, "heads"])

    rows = durable(arrow_map(texts, "rid long, id long, uid long, " + ", ".join(f"{w} long" for w in words) + ", heads array<bigint>", named), "fingerprints")
    units = durable(rows.groupBy("uid").agg(F.min("rid").alias("rid"), *(F.first(w).alias(w) for w in [*words, "heads"])), "units")
    heads = units.select("uid", F.explode("heads").alias("head"))
    stars = heads.join(heads.groupBy("head").agg(F.min("uid").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1"), "head")
    near = links(units, windows(agree), BUDGET, ("w0", "w1"), APART).union(stars.where("uid <> centre").select("uid", "centre"))
    edges = durable(near.distinct(), "candidates")
    roots = jaccard.verified(edges, units.select("uid", "rid"), texts.select("rid", "text"), shingle, percent)
    return rows.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("rid", "id", F.coalesce("root", "uid").alias("root"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each class of ``similar_texts``: the one with the smallest id, nulls last, and of these the first row.

    All columns of docs are kept. docs must be a table scan or another plan with fixed partitions. Of null and blank texts
    one row stays; an empty table gives no rows.
    """
    found = similar_texts(docs, id_col, text_col, shingle, percent)
    rid = free_name(docs, "rid")
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "rid")).alias("k")).select(F.col("k.rid").alias(rid))
    return with_row_id(docs, rid).join(keep, rid, "left_semi").select(*map(column, docs.columns))
