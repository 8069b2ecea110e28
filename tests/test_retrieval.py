import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.operators import retrieval as r
from rankweave.plans.registry import REGISTRY


def mention_rows(rows):
    return [(m, d, c, f"name {c}", "Finding") for m, d, c in rows]


SCHEMA = "model string, disease string, CUI string, UMLS_name string, semantic_type_name string"


def test_bm25_index_by_hand(spark):
    rows = [("a", "d1", "x"), ("a", "d1", "x"), ("a", "d1", "y"), ("a", "d2", "x"), ("b", "d1", "z")]
    got = {(i["model"], i["disease"], i["CUI"]): i for i in r.bm25_index(spark.createDataFrame(mention_rows(rows), SCHEMA)).collect()}
    assert len(got) == 4
    idf = math.log(3 / 2.5)
    item = got[("a", "d1", "x")]
    assert (item["tf"], item["df"]) == (2, 2)
    assert item["bm25"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))
    assert got[("b", "d1", "z")]["idf"] == pytest.approx(math.log(2 / 1.5))


def test_bm25_falls_with_document_length(spark):
    rows = [("a", "short", "x"), ("a", "long", "x")] + [("a", "long", f"f{i}") for i in range(20)] + [("a", "other", "q")]
    got = {(i["disease"], i["CUI"]): i["bm25"] for i in r.bm25_index(spark.createDataFrame(mention_rows(rows), SCHEMA)).collect()}
    assert got[("short", "x")] > got[("long", "x")]


def test_null_keys_are_dropped(spark):
    rows = [("a", "d1", "x"), ("a", None, "x"), (None, "d1", "x"), ("a", "d1", None)]
    assert r.bm25_index(spark.createDataFrame(mention_rows(rows), SCHEMA)).count() == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_pruned_matching_equals_direct(spark, seed):
    """A hot concept sits in every disease; rare ones decide.  Pruning must not change a row."""
    rng = random.Random(seed)
    rows = []
    for d in range(300):
        rows += [("a", f"d{d}", "hot")] * rng.randint(1, 3)
        rows += [("a", f"d{d}", f"w{rng.randint(0, 5)}") for _ in range(4)]
        rows += [("a", f"d{d}", f"r{rng.randint(0, 150)}") for _ in range(4)]
    index = r.bm25_index(spark.createDataFrame(mention_rows(rows), SCHEMA)).cache()
    queries = [("p", str(q), c) for q in range(40) for c in {"hot", f"w{q % 6}", f"r{rng.randint(0, 150)}", f"r{rng.randint(0, 150)}", "none"}]
    queries += [("p", "only hot", "hot"), ("p", "nothing", "none")]
    queries = spark.createDataFrame(queries, "dataset string, patient_id string, CUI string")
    key = lambda df: sorted(tuple(x) for x in df.collect())
    pairs = queries.join(index, "CUI").groupBy(*r.QUERY, "disease").agg(
        F.round(F.sum("bm25"), r.SCORE_DIGITS).alias("bm25_sum"), F.count("*").alias("shared_cui_count"))
    direct = key(r._top_k(pairs, 5))
    assert key(r.bm25_match(queries, index, k=5)) == direct
    assert key(r.bm25_match(queries, index, k=5, seed_rows=20)) == direct
    assert sum(1 for x in direct if x[2] == "only hot") == 5 and not any(x[2] == "nothing" for x in direct)


def test_query_concepts_and_ties(spark):
    patients = spark.createDataFrame([("p", "1", "x, y ,x,,"), ("p", "2", "")], "dataset string, patient_id string, phenotype_umls_cuis string")
    queries = r.query_concepts(patients)
    assert sorted(q["CUI"] for q in queries.collect()) == ["x", "y"]
    index = spark.createDataFrame([("m", "b", "x", 1.0, "X"), ("m", "a", "x", 1.0, "X"), ("m", "c", "y", 0.5, "Y"), ("m", "c", "x", 0.5, "X")],
                                  "model string, disease string, CUI string, bm25 double, UMLS_name string")
    ranked = r.bm25_match(queries, index)
    assert [x["disease"] for x in ranked.orderBy("rank").collect()] == ["c", "a", "b"]
    names = {x["disease"]: x["matched_cuis"] for x in r.matched_concepts(ranked, queries, index).collect()}
    assert names == {"c": "x | y", "a": "x", "b": "x"}


def test_attach_categories(spark):
    ranked = spark.createDataFrame([("Gout ",), ("x",)], "disease string")
    cats = spark.createDataFrame([("GOUT", 3, "a;b;c")], "rare_disease_name string, num_true_classifications int, final_classification_string string")
    got = {x["disease"]: x["num_true_classifications"] for x in r.attach_categories(ranked, cats).collect()}
    assert got == {"Gout ": 3, "x": None}


def test_dense_rank_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(37, 5)), rng.normal(size=(53, 5))
    queries = spark.createDataFrame([("m", "p", str(i), [float(x) for x in v]) for i, v in enumerate(q)] + [("m", "p", "none", None)],
                                    "model string, dataset string, patient_id string, vector array<double>")
    cands = spark.createDataFrame([("m", f"c{i:02d}", [float(x) for x in v]) for i, v in enumerate(c)], "model string, disease string, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(c).T, 4)
    want = set()
    for i in range(len(q)):
        for rank, j in enumerate(sorted(range(len(c)), key=lambda j: (-scores[i, j], f"c{j:02d}"))[:7], 1):
            want.add((str(i), f"c{j:02d}", rank))
    # tiny buckets force several cells on both sides
    got = r.dense_rank(queries, cands, k=7, query_bucket=10, candidate_bucket=8)
    assert {(x["patient_id"], x["disease"], x["rank"]) for x in got.collect()} == want
    assert r.dense_rank(queries, cands, k=60).count() == 37 * 53
    assert r.dense_rank(queries, cands, k=60, min_score=0.0).filter(F.col("score") <= 0).count() == 0


def test_dense_rank_rejects_non_finite(spark):
    queries = spark.createDataFrame([("m", "p", "1", [float("nan"), 1.0])], "model string, dataset string, patient_id string, vector array<double>")
    cands = spark.createDataFrame([("m", "c", [1.0, 0.0])], "model string, disease string, vector array<double>")
    with pytest.raises(Exception, match="non-finite"):
        r.dense_rank(queries, cands, k=3).collect()


def test_tfidf_and_slices(spark):
    rows = [("a", "d1", "x"), ("a", "d1", "x"), ("a", "d2", "y"), ("a", "d2", "x")]
    got = {(i["disease"], i["CUI"]): i["tfidf"] for i in r.tfidf(spark.createDataFrame(mention_rows(rows), SCHEMA)).collect()}
    assert got[("d1", "x")] == 0.0 and got[("d2", "y")] == pytest.approx(math.log(2))
    ranked = spark.createDataFrame([(i,) for i in range(1, 11)], "rank int")
    assert {x["k"]: x["count"] for x in r.topk_slices(ranked).groupBy("k").count().collect()} == {1: 1, 3: 3, 5: 5}


def test_the_name_of_the_pruned_plan_stays(spark):
    assert REGISTRY["bm25_match_pruned"].sql == REGISTRY["bm25_match"].sql
    rows = [sorted(map(tuple, REGISTRY[n].plan(spark, "/root/testdata/sf0.001").collect())) for n in ("bm25_match", "bm25_match_pruned")]
    assert rows[0] and rows[0] == rows[1]
