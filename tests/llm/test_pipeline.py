import corpus_pipeline
from threadmill.llm import packing, queries
from tests.llm.conftest import TINY


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, TINY).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        kept = {r["doc_id"] for r in docs.collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids)
        ids = kept
    stepwise = {(r["doc_id"], r["start"], r["ids_crc32"], r["length"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, TINY).collect()}
    whole = corpus_pipeline.run(spark, TINY)
    assert whole.columns == packing.PIECE
    sums = lambda rows: {k: sum(n for d, _, _, n in rows if d == k) for k in {r[0] for r in rows}}
    found = {(r["doc_id"], r["start"], r["ids_crc32"], r["length"]) for r in whole.collect()}
    assert sums(found) == sums(stepwise)


def test_stages_keep_columns_and_take_any_rows(spark, table):
    text = "the cat and the dog sat on the mat by the old mill "
    rows = [(1, text, "en", 1.0), (1, text, "en", 1.0), (None, "over the hill and far away from here", "en", 2.0), (5, None, None, 3.0), (6, "", "en", 4.0), (7, "word " * 60_000, "en", 5.0), (8, " \n ", None, 6.0)]
    schema = "doc_id long, text string, lang string, score double"
    docs = table(rows, schema).selectExpr("*", "1 as rid", "'x' as `a.b`", "2 as `__runs`", "3 as cut", "4 as node", "5 as `we``ird`", "6 as source")
    empty = table([], schema)
    expected = {"language": [-1, 1, 1, 7], "lines": [-1, 1, 1, 5, 6, 7, 8], "near_duplicates": [-1, 1, 5, 7], "benchmark": [-1, 1, 1, 5, 6, 7, 8]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in found) == expected[name], name
        assert all((r["rid"], r["a.b"], r["__runs"], r["cut"], r["node"], r["we`ird"]) == (1, "x", 2, 3, 4, 5) for r in found)
        assert {r["score"] for r in found} <= {r[3] for r in rows}
        assert stage(spark, empty, TINY).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert sum(r["length"] for r in pieces.where("doc_id = 1").collect()) == 2 * (13 + 1)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, TINY).count() == 0


def test_every_query_is_there():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
