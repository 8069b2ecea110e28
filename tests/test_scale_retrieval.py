"""Plans of the sparse indexes: what must not be sorted or moved again."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankweave.operators import postings, retrieval

MENTIONS = "model string, disease string, CUI string, UMLS_name string, semantic_type_name string"
ROWS = [
    ("m", "d1", "a", "x", "t2"), ("m", "d1", "a", "w", "t1"), ("m", "d1", "b", None, "t"), ("m", "d2", "a", "z", None),
    ("m", None, "a", "q", "t0"), ("n", "d1", "a", "y", "t"), ("n", "d2", "b", "y", "t"), ("n", "d2", "b", "y", "t"),
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_not_sorted(spark):
    mentions = spark.createDataFrame(ROWS, MENTIONS)
    for index in (retrieval.bm25_index(mentions), retrieval.tfidf(mentions)):
        plan = _plan(index)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "InMemory" not in plan
    names = {(r.model, r.CUI): (r.UMLS_name, r.semantic_type_name, r.df) for r in retrieval.bm25_index(mentions).collect()}
    assert names == {("m", "a"): ("w", "t1", 2), ("m", "b"): (None, "t", 1), ("n", "a"): ("y", "t", 1), ("n", "b"): ("y", "t", 1)}


def test_few_query_concepts_are_sent_to_the_postings(spark, monkeypatch):
    rows = spark.createDataFrame([("m", f"d{i % 50}", f"c{i % 7}", float(1 + i % 11), 0) for i in range(350)], "model string, disease string, CUI string, bm25 double, block int")
    rows = rows.groupBy("model", "disease", "CUI").agg(F.max("bm25").alias("bm25"))
    queries = spark.createDataFrame([("s", "p", "c1"), ("s", "p", "c2")], "dataset string, patient_id string, CUI string")
    asked = retrieval.asked_postings(rows, queries)
    assert "BroadcastHashJoin" in _plan(asked) and {r.CUI for r in asked.collect()} == {"c1", "c2"}
    small = sorted(map(tuple, postings.match_blocks(queries, postings.posting_blocks(rows), k=3).collect()))
    monkeypatch.setattr(retrieval, "SENT", 1)
    monkeypatch.setattr(postings, "asked_postings", retrieval.asked_postings)
    assert sorted(map(tuple, postings.match_blocks(queries, postings.posting_blocks(rows), k=3).collect())) == small
    assert sorted(map(tuple, retrieval.bm25_match(queries, rows, k=3).collect())) == small
