import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankweave.operators import fusion as f

RANKED = "model string, dataset string, patient_id string, disease string, rank int"


def ranked(spark, rows):
    return spark.createDataFrame([("m", "p", "1", d, r) for d, r in rows], RANKED)


def test_rrf_by_hand(spark):
    dense = ranked(spark, [("Gout", 1), ("Flu", 2), ("Lupus", 3)])
    sparse = ranked(spark, [("gout ", 2), ("Asthma", 1)])
    rows = {r["disease_norm"]: r for r in f.rrf_fuse(dense, sparse).collect()}
    assert rows["gout"]["rrf_score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-12) and rows["gout"]["disease"] == "Gout"
    # Asthma (sparse rank 1) beats Flu (dense rank 2)
    assert [rows[d]["final_rank"] for d in ("gout", "asthma", "flu", "lupus")] == [1, 2, 3, 4]
    assert rows["asthma"]["dense_rank"] is None
    assert f.rrf_fuse(dense, sparse, top=2).count() == 2


def test_rrf_tie_prefers_dense_and_score_is_symmetric(spark):
    a, b = ranked(spark, [("x", 1)]), ranked(spark, [("y", 1)])
    fused = {r["disease"]: r["final_rank"] for r in f.rrf_fuse(a, b).collect()}
    assert fused == {"x": 1, "y": 2}
    score = lambda d, s: {r["disease"]: r["rrf_score"] for r in f.rrf_fuse(d, s).collect()}
    assert score(a, b) == score(b, a)


def test_attach_truth(spark):
    fused = f.rrf_fuse(ranked(spark, [("x", 1)]), ranked(spark, [("x", 1)]))
    truth = spark.createDataFrame([("p", "1", "X")], "dataset string, patient_id string, rare_disease_name string")
    cats = spark.createDataFrame([("x", 4, "c")], "rare_disease_name string, num_true_classifications int, final_classification_string string")
    row = f.attach_truth(fused, truth, cats).first()
    assert (row["rare_disease_name"], row["num_true_classifications"]) == ("X", 4)


def gate_brute_force(rows, priority):
    """Pandas Spearman over the union of candidates, per patient."""
    out = {}
    df = pd.DataFrame(rows, columns=["model", "dataset", "patient_id", "disease", "rank"])
    for key, part in df.groupby(["dataset", "patient_id"]):
        universe = sorted(set(part["disease"]))
        vectors = {}
        for model, own in part.groupby("model"):
            ranks = dict(zip(own["disease"], own["rank"]))
            vectors[model] = pd.Series([ranks.get(d, len(own) + 1) for d in universe]).rank()
        sums = {}
        for m in vectors:
            total = 0.0
            for o in vectors:
                if o != m and vectors[m].std() > 0 and vectors[o].std() > 0:
                    total += vectors[m].corr(vectors[o])
            sums[m] = round(total, 9)
        out[key] = min(sums, key=lambda m: (-sums[m], priority.index(m)))
    return out


def test_consensus_gate_equals_brute_force(spark):
    rng = random.Random(5)
    priority = ["c", "a", "b", "d"]
    rows = []
    for patient in range(30):
        for model in priority:
            names = rng.sample("pqrstuv", rng.randint(1, 4))
            rows += [(model, "s", str(patient), n, i + 1) for i, n in enumerate(names)]
    rows += [(m, "s", "same", "p", 1) for m in priority]  # one candidate: every correlation is undefined
    gated = f.consensus_gate(spark.createDataFrame(rows, RANKED), priority)
    got = {(r["dataset"], r["patient_id"]): r["gated_model"] for r in gated.collect()}
    assert got == gate_brute_force(rows, priority) and got[("s", "same")] == "c"
    assert sum(r["count"] for r in f.gate_counts(gated).collect()) == 31


def test_rerank_column_and_function(spark):
    pairs = ranked(spark, [("x", 1), ("y", 2), ("z", 3)]).withColumn("no", F.lit(0.0)).withColumn(
        "yes", F.when(F.col("disease") == "z", 2.0).otherwise(0.0))
    out = {r["disease"]: r for r in f.rerank(pairs, f.yes_probability(F.col("no"), F.col("yes"))).collect()}
    assert [out[d]["rerank_position"] for d in "zxy"] == [1, 2, 3]
    assert out["z"]["score"] == 0.8808 and out["z"]["original_rank"] == 3

    def scorer(batches):
        for pdf in batches:
            yield pdf.assign(score=pdf["rank"] / 10.0)[["model", "dataset", "patient_id", "disease", "rank", "score"]]

    schema = RANKED + ", score double"
    top = f.rerank(ranked(spark, [("x", 1), ("y", 2)]), scorer, k=1, schema=schema).collect()
    assert [r["disease"] for r in top] == ["y"]


def test_rerank_input(spark):
    fused = f.rrf_fuse(ranked(spark, [("X-1", 1), ("Y", 2), ("Z", 3)]), ranked(spark, [("Y", 1)]))
    cols = "disease_name string, clinical_presentation_section string, diagnostic_evaluation_section string, subtype_variant_section string, management_therapy_section string"
    sections = spark.createDataFrame([("x 1", "c", None, "", None), ("y", None, " ", None, None)], cols)
    cases = spark.createDataFrame([("p", "1", "text")], "dataset string, patient_id string, case_data string")
    records = f.rerank_input(fused, sections, cases, k=10)
    row = records.first()
    assert [d["disease"] for d in row["diseases"]] == ["Y", "X-1", "Z"] and row["case_data"] == "text"
    stats = f.rerank_input_stats(records).first()
    assert (stats["n_top_diseases"], stats["n_knowledge_found"], stats["n_knowledge_missing"], stats["n_diseases_with_nonempty_sections"]) == (3, 2, 1, 1)


def test_combine_and_override(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, 5)], "k int, w int")
    rows = [tuple(r) for r in f.combine([a, b], ["w", "k", "v"]).orderBy("k").collect()]
    assert rows == [(None, 1, "x"), (5, 2, None)]
    new = spark.createDataFrame([(1, "z"), (9, "q")], "k int, v string")
    assert [tuple(r) for r in f.override(a, new, ["k"]).collect()] == [(1, "z")]
