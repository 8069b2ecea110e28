"""The sparse indexes read their mentions once; what several steps read is kept."""

from __future__ import annotations

import os
import re

from rankweave.operators import postings, retrieval
from rankweave.session import stage
from rankweave.streaming import index_upkeep

MENTIONS = "model string, disease string, CUI string, UMLS_name string, semantic_type_name string"
ROWS = [
    ("m", "d1", "a", "x", "t2"), ("m", "d1", "a", "w", "t1"), ("m", "d1", "b", None, "t"), ("m", "d2", "a", "z", None), ("m", "d3", "c", "v", "t"),
    ("m", None, "a", "q", "t0"), (None, "d1", "a", "q", "t0"), ("n", "d1", "a", "y", "t"), ("n", "d2", "b", "y", "t"), ("n", "d2", "b", "y", "t"),
]
QUERIES = "dataset string, patient_id string, CUI string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _read_again(df):
    return [line for line in _plan(df).splitlines() if "ExistingRDD" in line or "LocalTableScan" in line]


def test_bm25_index_reads_the_mentions_once(spark):
    index = retrieval.bm25_index(spark.createDataFrame(ROWS, MENTIONS), store=stage)
    assert not _read_again(index)
    rows = {(r.model, r.disease, r.CUI): (r.UMLS_name, r.semantic_type_name, r.tf, r.df) for r in index.collect()}
    assert rows == {
        ("m", "d1", "a"): ("w", "t1", 2, 2), ("m", "d1", "b"): (None, "t", 1, 1), ("m", "d2", "a"): ("w", "t1", 1, 2), ("m", "d3", "c"): ("v", "t", 1, 1),
        ("n", "d1", "a"): ("y", "t", 1, 1), ("n", "d2", "b"): ("y", "t", 2, 1)}


def test_dealt_mentions_are_not_moved_for_their_terms(spark):
    dealt = spark.createDataFrame(ROWS, MENTIONS).repartition("model", "disease")
    terms = retrieval.term_table(dealt, lengths=True)
    assert len(re.findall(r"\bExchange\b", _plan(terms))) == 1
    assert {(r.disease, r.CUI, r.tf, r.doc_len) for r in terms.filter("model = 'm'").collect()} == {
        ("d1", "a", 2, 3), ("d1", "b", 1, 3), ("d2", "a", 1, 1), ("d3", "c", 1, 1)}


def test_tfidf_reads_the_mentions_once(spark):
    mentions = spark.createDataFrame(ROWS, MENTIONS)
    rows = retrieval.tfidf(mentions, store=stage)
    assert not _read_again(rows)
    assert sorted(map(str, rows.collect())) == sorted(map(str, retrieval.tfidf(mentions).collect()))


def test_matching_keeps_the_postings_it_asks_for(spark):
    index = retrieval.bm25_index(spark.createDataFrame(ROWS, MENTIONS))
    queries = spark.createDataFrame([("s", "p", "a"), ("s", "p", "c")], QUERIES)
    ranked = retrieval.bm25_match(queries, index)
    assert re.search(r"InMemoryTableScan \[[^\]]*bm25#", _plan(ranked))
    assert [(r.disease, r.shared_cui_count) for r in ranked.filter("model = 'm'").orderBy("rank").collect()] == [("d3", 1), ("d2", 1), ("d1", 1)]


def test_matching_blocks_keeps_the_postings_it_asks_for(spark):
    index = retrieval.bm25_index(spark.createDataFrame(ROWS, MENTIONS))
    queries = spark.createDataFrame([("s", "p", "a"), ("s", "p", "c")], QUERIES)
    ranked = postings.match_blocks(queries, postings.posting_blocks(index))
    assert re.search(r"InMemoryTableScan \[[^\]]*bm25#", _plan(ranked))
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, retrieval.bm25_match(queries, index).collect()))


def test_a_batch_stores_its_terms_once(spark, tmp_path):
    mentions = spark.createDataFrame(ROWS, MENTIONS)
    path = f"file://{tmp_path}/index"
    index_upkeep.add_batch(mentions.filter("disease <> 'd2'"), path, "a")
    index_upkeep.add_batch(mentions, path, "b")
    assert {n for n in os.listdir(tmp_path / "index" / "b") if not n.startswith(".")} == {"terms", "concepts", "diseases", "_done"}
    grown = index_upkeep.read_index(spark, path)
    assert "SortMergeJoin" not in _plan(grown)
    whole = retrieval.bm25_index(mentions).select(grown.columns)
    key = lambda df: sorted((str(tuple(r)[:7]), round(r.bm25, 9)) for r in df.collect())
    assert key(grown) == key(whole)
