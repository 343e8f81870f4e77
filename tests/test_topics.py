"""Topic terms and their pairs read each text once."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievestone.operators import ranking, report


def test_texts_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    texts = ["alpha beta gamma alpha", "alpha beta delta", "gamma delta", None, "", "alpha beta gamma delta epsilon", "epsilon gamma"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d long, t string").repartition(2).withColumn("t", counted.asNondeterministic()("t"))
    terms = report.top_terms(docs, "t", 20)
    assert {(r["term"], r["doc_frequency"], r["total_occurrences"]) for r in terms.collect()} == {("alpha", 3, 4), ("beta", 3, 3), ("gamma", 4, 4), ("delta", 3, 3), ("epsilon", 2, 2)}
    assert seen.value <= len(texts)
    seen.value = 0
    pairs = report.term_pairs(docs, "d", "t", terms, 0.4)
    got = {(r["a"], r["b"], r["jaccard"]) for r in pairs.collect()}
    assert got == {("alpha", "beta", 1.0), ("alpha", "delta", 0.5), ("beta", "delta", 0.5), ("alpha", "gamma", 0.4), ("beta", "gamma", 0.4), ("delta", "gamma", 0.4), ("epsilon", "gamma", 0.5)}
    assert seen.value <= len(texts)
    clusters = {r["term"]: r["leader"] for r in ranking.leader_clusters(terms.select("term"), pairs, "term").collect()}
    assert clusters == {"alpha": "alpha", "beta": "alpha", "delta": "alpha", "gamma": "alpha", "epsilon": "epsilon"}
