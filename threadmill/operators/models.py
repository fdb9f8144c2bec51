"""The text classifier: TF-IDF of words and word pairs with logistic regression, in spark.ml."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Size of the vocabulary, the documents that a term must be in, rounds of the fit.
VOCABULARY, LEAST_DOCUMENTS, ROUNDS = 50_000, 2, 1000
#: Texts whose terms a task adds up at once.
TEXTS = 500


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with weight: n / (classes x rows of the class)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    weights = counts.join(F.broadcast(whole)).select(label, (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))
    return rows.join(F.broadcast(weights), label)  # one row a class


def _words(rows: DataFrame, text: str) -> DataFrame:
    """rows with words of two characters or more in lower case."""
    return RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"(?U)\b\w\w+\b", gaps=False).transform(rows)


def _terms(rows: DataFrame, text: str) -> DataFrame:
    """rows with terms: words, and pairs of neighbours."""
    pairs = NGram(inputCol="__words", outputCol="__pairs", n=2).transform(_words(rows, text))
    return pairs.withColumn("__terms", F.concat("__words", "__pairs")).drop("__words", "__pairs")


def term_counts(rows: DataFrame, text: str) -> DataFrame:
    """(term, n, df): how often a term occurs and in how many texts. A task adds some texts up, so a frequent term is a row for these and not a row a text."""

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                n, df = Counter(), Counter()
                for words in batch.column(0).slice(at, TEXTS).to_pylist():
                    words = words.split()
                    terms = [*words, *(f"{a} {b}" for a, b in pairwise(words))]
                    n.update(terms)
                    df.update(set(terms))
                yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["term", "n", "df"])

    joined = _words(rows, text).select(F.array_join("__words", " ").alias("words"))
    return joined.mapInArrow(work, "term string, n long, df long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _weigh(idf):
    """Counts as unit vectors of (1 + ln count) idf; idf is as long as the vocabulary, which is bounded."""

    def weigh(v):
        w = (1 + np.log(v.values)) * idf.value[v.indices]
        return Vectors.sparse(v.size, v.indices, w / (np.linalg.norm(w) or 1.0))

    return F.udf(weigh, VectorUDT())


@dataclass
class Classifier:
    labels: list[str]
    vectorizer: CountVectorizerModel
    idf: np.ndarray
    model: LogisticRegressionModel
    text: str = "text"

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with predicted (a label) and confidence. Null texts count as empty."""
        spark = rows.sparkSession
        filled = rows.withColumn("__text", F.coalesce(F.col(self.text), F.lit("")))
        counted = self.vectorizer.transform(_terms(filled, "__text"))
        scored = self.model.transform(counted.withColumn("features", _weigh(spark.sparkContext.broadcast(self.idf))("__counts")))
        names = F.array(*map(F.lit, self.labels))
        return scored.select(*rows.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted"), F.array_max(vector_to_array("probability")).alias("confidence"))


def train(rows: DataFrame, text: str = "text", label: str = "label", vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> Classifier:
    """Learns from rows(text, label): balanced weights, idf ln((1 + n) / (1 + df)) + 1, an L2 penalty of one over the summed weights."""
    weighted = class_weights(rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()), label).withColumnRenamed(text, "__text")
    classes = sorted(weighted.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect(), key=lambda r: r[0])
    labels, n, whole = [r[0] for r in classes], sum(r["n"] for r in classes), sum(r["w"] for r in classes)
    index = F.create_map(*(F.lit(x) for kv in ((k, float(i)) for i, k in enumerate(labels)) for x in kv))
    terms = _terms(weighted, "__text").withColumn("__y", index[F.col(label)]).select("__terms", "__y", "weight")
    kept = term_counts(weighted, "__text").where(F.col("df") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "term").limit(vocabulary).collect()
    vectorizer = CountVectorizerModel.from_vocabulary([r["term"] for r in kept], "__terms", "__counts")
    idf = np.log((1 + n) / (1 + np.array([r["df"] for r in kept]))) + 1
    features = vectorizer.transform(terms).withColumn("features", _weigh(rows.sparkSession.sparkContext.broadcast(idf))("__counts")).select("features", "__y", "weight").cache()
    model = LogisticRegression(labelCol="__y", weightCol="weight", regParam=1.0 / whole, standardization=False, maxIter=rounds).fit(features)
    features.unpersist()
    return Classifier(labels, vectorizer, idf, model)
