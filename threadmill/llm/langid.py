"""Language identification by the nearest of several centroids per language.

A text is the vector of its letter n-grams (one to ``GRAM`` characters, lower case, everything but letters
seen as one blank), hashed into ``SIZE`` columns, with sublinear counts, inverse document frequency and unit length. The
vectors of a sample of labelled texts are clustered per language (spherical k-means); a text gets the language
of the centroid with the highest cosine. A text that is farther from its centroid than nearly all the sample, for
its own number of n-grams, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.tools import arrow_map, rename, text_bytes

GRAM, SIZE = 3, 1 << 13
#: Bounds of the fit: labelled texts per language and in all, centroids per language and in all, rounds of k-means. A text sends
#: at most 6 * SIZE bytes to the driver, so all of them 500 MB, however long they are.
SAMPLE, SAMPLED, CENTROIDS, CENTRES, ROUNDS = 400, 10_000, 4, 2000, 8
#: A text is rejected when its cosine is under this share of the sample's lowest hundredth for texts as long, or so low at all.
REJECT, LEAST_COSINE = 0.5, 0.05
_CHUNK = 1 << 20
_letters = np.zeros(0, bool)


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """(columns, counts, whether there is a letter) of a whole UTF-8 text."""
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter(codes)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0), False
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each stretch without letters one blank stays
    codes = np.where(letter, codes, 0)[keep].astype(np.uint64)
    codes = np.concatenate(([0], codes, [0][: int(codes[-1] != 0)])).astype(np.uint64)
    total = np.zeros(SIZE, np.int64)
    for at in range(0, len(codes), _CHUNK):
        part = codes[at : at + _CHUNK + GRAM - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, GRAM + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            h = (h[:size] * np.uint64(0x100000001B3)) ^ (part[n - 1 :] + np.uint64(n))
            mixed = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
            own = mixed[: min(size, _CHUNK)]
            total += np.bincount(own.astype(np.int64), minlength=SIZE)
    columns = np.flatnonzero(total)
    return columns, total[columns].astype(float), True


@dataclass
class Model:
    labels: list[str]
    of: np.ndarray  # label index of each centroid
    centroids: np.ndarray  # SIZE x centroids
    idf: np.ndarray
    floor: np.ndarray  # lowest usual cosine by bit length of the number of n-grams

    def vector(self, columns: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = (1 + np.log(n)) * self.idf[columns]
        return v / (np.sqrt(v @ v) or 1.0)

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """(language, cosine, whether it is rejected)."""
        columns, n, letters = counts(text)
        if not letters or not self.labels:
            return "und", 0.0, True
        cosine = self.vector(columns, n) @ self.centroids[columns]
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.labels[self.of[best]], score, bool(score < max(LEAST_COSINE, REJECT * self.floor[int(n.sum()).bit_length()]))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit rows: spherical k-means from farthest-first seeds, so it has no randomness."""
    seeds = [int(np.argmax(x @ x.sum(0)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from at most SAMPLE texts of each language and SAMPLED in all, those whose (id, text) have the smallest hashes.

    Null labels and texts without letters teach nothing; rows with a null id or an id of others teach like any; of rows that
    agree in id and text one counts. With many languages each has fewer texts and centroids; more than
    CENTRES languages are an error. What reaches the driver is the sample's sparse vectors, two bytes a column and four a count.
    """
    named = rename(labelled, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null").withColumn("h", F.xxhash64("id", "text"))
    # Sketches of the number of different rows of a language: with hashes below a bound that about four times the sample has, no frequent language meets in one task.
    sizes = named.groupBy("lang").agg(F.approx_count_distinct("h").alias("rows"))
    languages = sizes.count()
    if languages > CENTRES:
        raise ValueError(f"{languages} languages, but the model has room for {CENTRES}")
    most, centroids = min(SAMPLE, SAMPLED // max(languages, 1)), min(CENTROIDS, CENTRES // max(languages, 1))
    drawn = F.shiftrightunsigned("h", 33) < F.lit(4.0 * most) / F.col("rows") * (1 << 31)
    near = named.select("h", "lang").join(F.broadcast(sizes), "lang").where(drawn).select("h", "lang").distinct()
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= most).select("h", "lang")

    def work(batch):
        found = [counts(t) for t in text_bytes(batch.column(1))]
        columns, n = [f[0].astype("<u2").tobytes() for f in found], [f[1].astype("<u4").tobytes() for f in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns, pa.binary()), pa.array(n, pa.binary())], ["lang", "columns", "n"])

    texts = named.join(F.broadcast(chosen), ["h", "lang"], "left_semi").dropDuplicates(["h", "lang"])
    sent = arrow_map(texts.select("lang", "text"), "lang string, columns binary, n binary", work).where("octet_length(columns) > 0")
    rows = [(r["lang"], np.frombuffer(r["columns"], "<u2"), np.frombuffer(r["n"], "<u4")) for r in sent.collect()]
    labels = sorted({lang for lang, _, _ in rows})
    df = np.zeros(SIZE)
    for _, columns, _ in rows:
        df[columns] += 1
    model = Model(labels, np.zeros(0, np.int64), np.zeros((SIZE, 0)), np.log((1 + len(rows)) / (1 + df)) + 1, np.zeros(65))
    parts, of, seen = [], [], []
    for k, label in enumerate(labels):
        own = [r[1:] for r in rows if r[0] == label]
        x = np.zeros((len(own), SIZE))
        for i, (columns, n) in enumerate(own):
            x[i, columns] = model.vector(columns, n)
        c = _kmeans(x, centroids)
        parts.append(c)
        of += [k] * len(c)
        seen += list(zip((int(n.sum()).bit_length() for _, n in own), (x @ c.T).max(1), strict=True))
    if parts:
        model.centroids, model.of = np.concatenate(parts).T.copy(), np.array(of)
        for bits in range(65):  # texts without equals of their length have the floor of the next shorter ones
            cosines = [c for b, c in seen if b == bits]
            model.floor[bits] = np.quantile(cosines, 0.01) if len(cosines) >= 5 else (model.floor[bits - 1] if bits else 0.0)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (``und`` for null texts and texts without a letter), score (cosine, 0 to 1) and rejected appended.

    und is always rejected. Empty tables give no rows; rows are judged one by one, so ties, repeated rows and
    nulls in other columns don't matter. Columns of docs that have these names are replaced (``known`` keeps them).
    """
    added = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*added)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x CENTRES doubles at most
    names, at = docs.columns, docs.columns.index(text_col)

    def work(batch):
        found = [sent.value.predict(t) for t in text_bytes(batch.column(at))]
        labels, scores, out = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], [*names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return arrow_map(docs, schema, work)


def known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that ``predict`` would not reject, with the columns of docs, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)

    def work(batch):
        kept = batch.filter(pa.array([not sent.value.predict(t)[2] for t in text_bytes(batch.column(at))], pa.bool_()))
        return pa.RecordBatch.from_arrays(kept.columns, names)

    return arrow_map(docs, docs.schema, work)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
