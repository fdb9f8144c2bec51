"""Packing documents into training sequences by order-preserving dynamic programming.

Documents keep their order. Their ids form one stream per task, which may be cut after any document (free),
after any sentence, and, inside long sentences, every ``STRIDE`` ids. A sequence of ``limit`` ids or of a power
of two of them needs no padding; any other is padded to ``limit``. The cuts minimise padding plus the price of
each cut plus a small price per sequence. For a boundary e and earlier boundaries s within ``limit``,

    cost(e) = price(e) + SEQUENCE + min(cost(s) + limit - (e - s), cost(s') where e - s' is a power of two)

and as ``cost(s) + s`` does not depend on e, the first minimum is the head of a monotone queue. A task holds
``BLOCK`` ids at a time: it settles all but the last few sequences of the best path and takes the rest into the
next block, so memory is bounded by a block and the longest document. Nothing is shuffled.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from threadmill.llm.tools import rename, slices, text_bytes

#: Prices in ids of padding, the stride of cuts in a long sentence, ids in a block, and sequences that stay open.
SENTENCE, INSIDE, SEQUENCE, STRIDE, BLOCK, OPEN = 8, 64, 32, 256, 1 << 18, 4
#: Words whose ids a task remembers.
WORDS = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]


def _plain(word: str) -> bool:
    """Whether the tokenizer's own preparation leaves a word as it is, and as one stretch: letters, composed, in lower case."""
    return word.isalpha() and word == word.lower() and unicodedata.is_normalized("NFC", word)


class Words(dict):
    """Codes of words, given out in the order in which they are first asked for."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class Encoder:
    """Ids of whole texts. No token of this tokenizer spans white space, so each word is encoded once and remembered.

    Two facts of the tokenizer save most of the work on words that occur once. It lowers letters itself, and lowering
    ASCII letters first changes nothing unless a combining mark (UTF-8 from CC or CD on) follows one. And stops and
    commas that end a word after a letter or digit are a token stretch of their own, so the word without them is encoded.
    The tokenizer's special tokens are found in a text as they are written, before anything else, and part it.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(file if os.path.isabs(file) else public_tokenizers.path(file))
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.tokenizer.encode_special_tokens = True  # what is a special token only in lower case is none
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>") and t[:-4] and set(t[:-4]) <= set(".!?")]
        # The same merges without preparation, which words of letters in lower case do not need.
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.ends_sentence = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_sentence[ends] = True
        self.forget()

    def forget(self):
        self.codes = Words()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self):
        """Finds the ids of the words that got their codes since the last call."""
        whole, split = [], []
        for word in self.codes.new:  # grows on the way
            core = word.rstrip(b".,")
            if core and len(core) < len(word) and (core[-1:].isalnum() or core[-1] > 127 and core.decode()[-1].isalpha()):
                split.append((self.codes[word], self.codes[core], self.codes[word[len(core) :]]))
            else:
                whole.append(word)
        known = len(self.codes)
        while known > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        letters, rest = [], []
        for word in whole:
            (letters if word.isalpha() and word.islower() or not word.isascii() and _plain(word.decode()) else rest).append(word)
        if letters:  # each is one stretch, whose last token alone ends a word, so many are encoded as one text
            ids = np.array(self.letters.encode_batch_fast([b" ".join(letters).decode()], add_special_tokens=False)[0].ids, np.uint32)
            self._store([self.codes[w] for w in letters], ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0))
        if rest:
            new = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)]
            self._store([self.codes[w] for w in rest], np.array([i for x in new for i in x], np.uint32), np.fromiter(map(len, new), np.int64, len(new)))
        if split:
            word, *parts = np.array(split).T
            self._store(word, self._ids_of(np.stack(parts, 1).ravel()), self.lengths[parts[0]] + self.lengths[parts[1]])
        self.codes.new = []

    def _store(self, codes, ids: np.ndarray, lengths: np.ndarray):
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[codes] = self.used + np.cumsum(lengths) - lengths
        self.lengths[codes] = lengths
        self.used += len(ids)

    def _ids_of(self, codes: np.ndarray) -> np.ndarray:
        """The ids of words, one after the other."""
        starts, lengths = self.starts[codes], self.lengths[codes]
        total = np.cumsum(lengths)
        return self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)]

    def encode(self, text: bytes, end: int) -> np.ndarray:
        if len(self.codes) > WORDS:
            self.forget()
        parts = self.specials.split(text) if self.specials and any(t in text for t in self.special) else [text]
        found = [np.array([self.special[p]], np.uint32) if k % 2 else self._plain_ids(p) for k, p in enumerate(parts)]
        return np.concatenate((*found, [np.uint32(end)]))

    def _plain_ids(self, text: bytes) -> np.ndarray:
        words = (text if b"\xcc" in text or b"\xcd" in text else text.lower()).split()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            self._learn()
        return self._ids_of(codes)


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def boundaries(lengths: list[int], ids: np.ndarray, ends_sentence: np.ndarray, limit: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream of documents may be cut, from 0 to its end, and the price of each cut."""
    documents = np.cumsum(lengths)
    sentences = np.flatnonzero(ends_sentence[ids]) + 1
    mark = np.zeros(len(ids) + 1, bool)
    mark[0] = mark[documents] = mark[sentences] = True
    at = np.flatnonzero(mark)
    gaps = np.diff(at)
    long = gaps > STRIDE
    inside = [np.arange(a + STRIDE, a + g, STRIDE) for a, g in zip(at[:-1][long], gaps[long], strict=True)]
    if last:  # so that the tail of the stream can be made of powers of two
        inside.append(np.arange(len(ids) - 64, max(0, len(ids) - limit), -64))
        inside.append(np.array([len(ids) - (1 << k) for k in range(limit.bit_length()) if 1 << k < len(ids)], np.int64))
    for more in inside:
        mark[more] = True
    price = np.full(len(mark), INSIDE)
    price[sentences] = SENTENCE
    price[documents] = 0
    at = np.flatnonzero(mark)
    return at, price[at]


def cuts(at: np.ndarray, price: np.ndarray, limit: int) -> list[int]:
    """Indices of the boundaries at which the cheapest windows begin and end, first and last included."""
    powers = [np.zeros(0, np.int64)] * 2
    for k in range(limit.bit_length()):
        found = np.searchsorted(at, at - (1 << k))
        ok = np.flatnonzero((at >= 1 << k) & (at[np.minimum(found, len(at) - 1)] == at - (1 << k)))
        powers = [np.concatenate((powers[0], ok)), np.concatenate((powers[1], found[ok]))]
    order = np.argsort(powers[0], kind="stable")
    to, whence = powers[0][order].tolist(), powers[1][order].tolist()
    to.append(len(at))
    places, prices = at.tolist(), (price + SEQUENCE).tolist()
    cost, back, queue, p = [0] * len(places), [0] * len(places), deque([(0, 0)]), 0
    for i in range(1, len(places)):
        here = places[i]
        while places[queue[0][1]] < here - limit:
            queue.popleft()
        best, j = queue[0]
        best += limit - here
        while to[p] == i:
            if cost[whence[p]] < best:
                best, j = cost[whence[p]], whence[p]
            p += 1
        best += prices[i]
        cost[i], back[i] = best, j
        ahead = best + here
        while queue and queue[-1][0] >= ahead:
            queue.pop()
        queue.append((ahead, i))
    path = [len(places) - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def padded(length: int, limit: int) -> int:
    return length if length & (length - 1) == 0 else limit


def pack_stream(documents: Iterator[tuple[int | None, np.ndarray]], ends_sentence: np.ndarray, limit: int, first_sequence: int = 0) -> Iterator[tuple]:
    """PIECE rows for documents (id, ids), in their order."""
    open_: list[tuple[int | None, int, int, np.ndarray]] = []  # id, ids of the document, start, ids still to place
    held, sequence = 0, first_sequence

    def settle(last: bool):
        nonlocal open_, held, sequence
        ids = np.concatenate([x[3] for x in open_])
        at, price = boundaries([len(x[3]) for x in open_], ids, ends_sentence, limit, last)
        path = at[cuts(at, price, limit)].tolist()
        path = path if last else path[: -OPEN]
        queue, k, used = open_, 0, 0
        for a, b in zip(path[:-1], path[1:], strict=True):
            offset = 0
            while offset < b - a:
                name, size, start, rest = queue[k]
                piece = rest[used : used + b - a - offset]
                yield name, start + used, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), size, sequence, offset, padded(b - a, limit)
                offset += len(piece)
                used += len(piece)
                if used == len(rest):
                    k, used = k + 1, 0
            sequence += 1
        open_ = [(n, s, st + used, r[used:]) if not i else (n, s, st, r) for i, (n, s, st, r) in enumerate(queue[k:])]
        held = sum(len(x[3]) for x in open_)

    for name, ids in documents:
        open_.append((name, len(ids), 0, ids))
        held += len(ids)
        if held >= BLOCK:
            yield from settle(False)
    if open_:
        yield from settle(True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 4096, end: int = 2) -> DataFrame:
    """PIECE rows: which ids of which document stand where in which sequence.

    Null text counts as empty: the document is its end id alone. Null ids are carried along, repeated rows are
    packed as often as they occur, texts of any length are cut. Each partition of docs numbers its sequences
    from its own number times 2^32. An empty table gives no rows. Only id and text are read.
    """

    def work(batches):
        own = encoder(tokenizer)

        def documents():
            for batch in batches:
                for part in slices(batch):
                    for name, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                        yield name, own.encode(text, end)

        rows = []
        for row in pack_stream(documents(), own.ends_sentence, limit, TaskContext.get().partitionId() << 32):
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], PIECE)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], PIECE)

    return rename(docs, doc_id=id_col, text=text_col).mapInArrow(work, SCHEMA)
