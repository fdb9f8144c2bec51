"""From raw documents to packed sequences: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs, which are the rows that the stage before kept.
docs is a table scan with doc_id, text and lang; all its columns stay, whatever their names, in all stages but the last,
which returns pieces. Rows with a null id are kept and judged like any. Null texts go in the first stage, as do texts
without a letter; to the other stages alone a null text is an empty one, which they keep (near-duplicates: one of them).
Texts are worked on whole, however long. Of equal rows the first one stays. An empty table gives an empty table.
"""

from threadmill.llm import decontaminate, langid, linededup, packing, simhash
from threadmill.llm.tools import durable
from threadmill.sources import scratch


def language(spark, docs, sf_dir):
    """Documents whose language is known; null texts, texts without a letter and far outliers go. Labels of the input train it."""
    return langid.known(docs, langid.fit(docs))


def lines(spark, docs, sf_dir):
    """Documents without later copies of line runs of 50 words or more; documents of which nothing is left go."""
    return linededup.dedup(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8 or more), the one with the smallest id."""
    return simhash.dedup(docs)


def benchmark(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark, docs, sf_dir):
    """The pieces of the documents in padded training sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("sequences", sequences)]

#: Model fits, fingerprints and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = scratch.written()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        scratch.clear(spark, start, 1)  # what the stages so far have written but for the last one's result
    return STAGES[-1][1](spark, docs, sf_dir)
