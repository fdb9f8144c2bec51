import random
import zlib

import numpy as np
import pytest

from threadmill.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out())
    for r in docs.select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    model = langid.fit(docs.where("not held_out"))
    out = langid.predict(docs, model).where("held_out").select("lang", "lang_pred", "score", "rejected").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["rejected"] for r in out) <= 0.01 * len(out)


def test_counts_do_not_depend_on_chunks(monkeypatch):
    text = ("Ünı abc, 12 déf!  " * 500).encode()
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_CHUNK", 97)
    parts = langid.counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_edge_cases(table, spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(8)] + [(10 + i, "der hund und die katze sind nicht da", "de") for i in range(8)]
    rows += [(None, "the dog", None), (30, None, "en"), (31, "", "en"), (32, " 12 !? ", "de"), (33, "the mat " * 50_000, None)]
    docs = table([(*r, "s", 1.5) for r in rows], "doc_id long, text string, lang string, score string, n double")
    model = langid.fit(docs)
    assert model.labels == ["de", "en"]
    out = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [out[i]["lang_pred"] for i in (None, 0, 10, 30, 31, 32, 33)] == ["en", "en", "de", "und", "und", "und", "en"]
    assert out[30]["rejected"] and out[32]["score"] == 0.0 and not out[0]["rejected"]
    none = langid.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    for text in ("чужой текст на другом языке, которого здесь нет", "日本語の文章です"):
        assert model.predict(text.encode())[2]
    assert not model.predict(b"the")[2]


def made(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_rows_without_an_id_or_with_one_id_teach(table):
    rng = random.Random(1)
    rows = [(None, made(rng, "abcde", 20), "xx") for _ in range(8)] + [(7, made(rng, "klmno", 20), "yy") for _ in range(3000)] + [(7, "only one text", "zz")] * 3000
    model = langid.fit(table(rows, "doc_id long, text string, lang string"))
    assert model.labels == ["xx", "yy", "zz"]
    assert model.predict(made(rng, "abcde", 20).encode())[0] == "xx" and model.predict(made(rng, "klmno", 20).encode())[0] == "yy"


def test_many_languages(table, monkeypatch):
    rng = random.Random(2)
    letters = [[chr(0x4E00 + 30 * k + j) for j in range(12)] for k in range(300)]
    rows = [(k * 10 + j, made(rng, letters[k], 12), f"l{k:03}") for k in range(300) for j in range(4)]
    docs = table(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.labels) == 300
    assert sum(model.predict(made(rng, letters[k], 12).encode())[0] == f"l{k:03}" for k in range(300)) >= 295
    monkeypatch.setattr(langid, "CENTRES", 299)
    with pytest.raises(ValueError):
        langid.fit(docs)


def test_predictions_equal_the_nearest_centroid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    for r in docs.collect():
        low = "".join(c if c.isalpha() else "\0" for c in r["text"].lower())
        low = "\0" + "\0".join(x for x in low.split("\0") if x)
        low += "\0"
        total = np.zeros(langid.SIZE)
        for n in range(1, 4):
            for at in range(len(low) - n + 1):
                h = 0
                for k, c in enumerate(low[at : at + n], 1):
                    h = (h * 0x100000001B3 % 2**64) ^ (ord(c) + k)
                total[h * 0x9E3779B97F4A7C15 % 2**64 >> 51] += 1
        v = np.where(total > 0, (1 + np.log(np.maximum(total, 1))) * model.idf, 0)
        cosines = v @ model.centroids / np.linalg.norm(v)
        label, score, _ = model.predict(r["text"].encode())
        assert label == model.labels[model.of[int(np.argmax(cosines))]]
        assert score == pytest.approx(cosines.max(), abs=1e-9)


def test_known_keeps_every_column(table):
    docs = table([(1, "the cat and the dog", 42.0, "a"), (2, None, 1.0, "b"), (3, "12", 2.0, "c")], "doc_id long, text string, score double, `lang.pred` string").selectExpr("*", "'en' as lang")
    kept = langid.known(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(1, "the cat and the dog", 42.0, "a", "en")]


def test_the_sample_in_all_is_bounded(table, monkeypatch):
    """Each language has its share of the texts in all, and the vectors that are sent equal those that are counted."""
    rng = random.Random(3)
    rows = [(k * 100 + j, made(rng, letters, 30), f"l{k}") for k, letters in enumerate(("abcdef", "klmnop", "uvwxyz")) for j in range(60)]
    docs = table(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLED", 30)
    model = langid.fit(docs)
    seen = np.exp(model.idf - 1)  # (1 + texts) / (1 + texts with the n-gram)
    assert seen.max() == pytest.approx(31)
    assert sum(model.predict(text.encode())[0] == lang for _, text, lang in rows) >= 0.98 * len(rows)
    monkeypatch.setattr(langid, "SAMPLED", 10_000)
    model = langid.fit(docs)
    df = np.zeros(langid.SIZE)
    for _, text, _ in rows:
        df[langid.counts(text.encode())[0]] += 1
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + df)) + 1)
