import datetime as dt

from pyspark.sql import functions as F

from rankweave.operators import evaluation as e
from rankweave.operators import outcomes as o

FUSED = "model string, dataset string, patient_id string, disease string, final_rank int, rare_disease_name string"
ROWS = [
    ("m", "PubMed", "1", "Gout", 1, "gout"), ("m", "PubMed", "1", "Flu", 2, "gout"),
    ("m", "hms", "2", "Flu", 1, "Gout"), ("m", "hms", "2", "Gout", 2, "Gout"),
    ("m", "hms", "3", "Flu", 1, "Lupus"),
]


def fused(spark):
    return spark.createDataFrame(ROWS, FUSED)


def test_accuracy_and_recall(spark):
    acc = {(r["topk"], r["group"]): (r["total"], r["hits"], r["accuracy"]) for r in e.accuracy_at_k(fused(spark)).collect()}
    assert acc[("top1", "all")] == (3, 1, 0.3333) and acc[("top3", "non_pubmed")] == (2, 1, 0.5) and acc[("top1", "pubmed")] == (1, 1, 1.0)
    for group in ("all", "pubmed", "non_pubmed"):
        assert acc[("top1", group)][1] <= acc[("top3", group)][1] <= acc[("top5", group)][1]
    totals = spark.createDataFrame([("all", 10), ("pubmed", 4), ("non_pubmed", 6)], "cohort string, total long")
    rec = {(r["cohort"], r["k"]): r["recall"] for r in e.recall_at_k(fused(spark), totals, rank_col="final_rank").collect()}
    assert rec[("all", 1)] == 0.1 and rec[("all", 5)] == 0.2
    sliced = e.metric_slice(e.accuracy_at_k(fused(spark)), "all", ("top1", "top5")).collect()
    assert [r["topk"] for r in sliced] == ["top1", "top5"]


def test_truth_rank_and_mrr(spark):
    ranks = e.truth_rank(fused(spark))
    assert {r["patient_id"]: r["ground_truth_disease_rank"] for r in ranks.collect()} == {"1": 1, "2": 2, "3": 11}
    assert e.mrr(ranks).first()["mrr"] == 0.5


def test_match_rate_counts_patients_without_ranking(spark):
    patients = spark.createDataFrame([("PubMed", "1"), ("hms", "2"), ("hms", "3"), ("hms", "4")], "dataset string, patient_id string")
    rates = e.match_rate(fused(spark), patients, ks=(1, 3), rank_col="final_rank")
    got = {(r["dataset"], r["k"]): (r["total_pts"], r["matched_pts"], r["match_rate"]) for r in rates.collect()}
    assert got[("hms", 3)] == (3, 1, 0.3333) and got[("hms", 1)] == (3, 0, 0.0)
    assert {r["k"]: r["match_rate"] for r in e.pooled_match_rate(rates).collect()} == {1: 0.25, 3: 0.5}


def test_complexity_buckets(spark):
    rows = [(*r[:4], r[4], r[5], n) for r, n in zip(ROWS, (8, 8, 9, 9, 13))]
    rates = e.rate_by_complexity(spark.createDataFrame(rows, FUSED + ", num_true_classifications int"), ks=(5,), rank_col="final_rank")
    got = {r["classification_group"]: (r["matched_sum"], r["total_sum"]) for r in e.recall_by_bucket(rates).collect()}
    assert got == {"8": (1, 1), "9+": (1, 2)}


def test_eval_detail_status(spark):
    truth = spark.createDataFrame([("PubMed", "1", "Gout"), ("PubMed", "1", "Flu"), ("hms", "2", "Lupus")], "dataset string, patient_id string, rare_disease_name string")
    detail = e.eval_detail(fused(spark).drop("rare_disease_name"), truth)
    rows = {r["patient_id"]: r for r in detail.collect()}
    assert rows["1"]["status"] == "matched" and rows["1"]["rare_disease_name"] == "Flu | Gout" and rows["1"]["matched_rank"] == 1
    assert rows["2"]["status"] == "not_found_in_top10" and rows["2"]["hit_top5"] == 0 and rows["2"]["top10_predicted_diseases"] == "Flu | Gout"
    assert rows["3"]["status"] == "no_truth_record" and rows["3"]["hit_top1"] is None
    summary = e.eval_summary(detail).first()
    assert (summary["n_output_patients"], summary["n_evaluable_with_truth"], summary["n_no_truth_record"], summary["recall_at_1"]) == (3, 2, 1, 0.5)


def test_transitions(spark):
    schema = "model string, dataset string, patient_id string, ground_truth_disease_rank int"
    base = spark.createDataFrame([("m", "pubmed", "1", 1), ("m", "pubmed", "2", 1), ("m", "hms", "3", 4), ("m", "hms", "4", 4), ("m", "pubmed", "5", 3)], schema)
    new = spark.createDataFrame([("m", "pubmed", "1", 1), ("m", "pubmed", "2", 2), ("m", "hms", "3", 1), ("m", "hms", "4", 4)], schema)
    out = o.rank_transition(base, new)
    got = {r["patient_id"]: (r["kb_vs_base"], r["top1_transition"]) for r in out.collect()}
    assert got == {"1": ("same", "stable_top1"), "2": ("worse", "lost_top1"), "3": ("better", "gained_top1"), "4": ("same", "never_top1"), "5": ("worse", "never_top1")}
    s = o.outcome_summary(out).first()
    assert s["better_n"] + s["worse_n"] + s["same_n"] == s["total"] == 5 and s["top1_worse_pct"] == 50.0
    rows = {r["cohort"]: r for r in o.transition_by_cohort(out).collect()}
    assert set(rows) == {"all", "pubmed"}  # non_pubmed has no base top-1 case
    assert rows["all"]["top1_same_pct"] == 50.0 and rows["all"]["non_top1_better_pct"] == 33.3
    promo = {r["cohort"]: r["promotion_rate"] for r in o.promotion_rate(out).collect()}
    assert promo == {"all": 0.3333, "pubmed": 0.0, "non_pubmed": 0.5}


def test_all_members_agree(spark):
    rows = [("a", "1", "Gout", "same"), ("b", "1", "Gout", "same"), ("a", "2", "Gout", "same"), ("b", "2", "Gout", "worse"), ("b", "1", "Gout", "same")]
    df = spark.createDataFrame([(m, "p", *x) for m, *x in rows], "model string, dataset string, patient_id string, correct_disease string, kb_vs_base string")
    other = df.withColumn("dataset", F.when(F.col("model") == "a", "q").otherwise("p"))  # two data sets may share a patient_id
    assert o.all_members_agree(other, "same", 2).count() == 0
    assert [tuple(r) for r in o.all_members_agree(df, "same", 2).collect()] == [("Gout", 1)]


def test_top1_by_score(spark):
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    truth = spark.createDataFrame(
        [(1, 10, "Gout", "Admission note", "H&P", d1), (1, 11, "Gout", "Admission note", "H&P", d2), (1, 12, "Gout", "Other", "H&P", d2), (1, 10, "Gout", "Admission note", "H&P", d1)],
        "person_id long, row_index int, disease_name string, note_type_name string, note_title string, note_date date")
    pred = spark.createDataFrame([(1, 10, "flu", 0.9), (1, 11, "GOUT", 0.9), (1, 12, "gout", 1.0)], "patient_id long, row_index int, disease string, match_score double")
    best = e.top1_by_score(pred, truth)
    row = best.collect()
    assert len(row) == 1 and row[0]["row_index"] == 11 and row[0]["is_hit"]
    assert [tuple(r) for r in e.top1_counts(best).collect()] == [("Admission note", 1, 1)]


def test_score_operators(spark):
    rows = [("s", 1, True, 0.05), ("s", 2, True, 1.0), ("s", 3, False, 0.95), ("t", 4, True, 0.3)]
    df = spark.createDataFrame(rows, "source string, person_id int, is_hit boolean, match_score double")
    hist = {(r["is_hit"], r["score_bin"]): r["n"] for r in e.score_histogram(df).collect()}
    assert hist == {(True, 0.0): 1, (True, 1.0): 1, (False, 0.9): 1, (True, 0.3): 1}
    wide = {r["is_hit"]: r for r in e.histogram_table(e.score_histogram(df), [0.0, 0.3, 0.9, 1.0]).collect()}
    assert wide[False]["bin_0.9"] == 1 and wide[False]["bin_1.0"] == 0 and wide[True]["bin_0.3"] == 1
    share = {r["source"]: (r["hit_share"], r["miss_share"], r["total"]) for r in e.hit_share_by_disease(df, "source").collect()}
    assert share == {"s": (0.6667, 0.3333, 3), "t": (1.0, 0.0, 1)}
    both = e.overlap_scores(df, df.filter("person_id <> 2"), ["person_id"]).collect()
    assert {r["source"]: (r["n"], r["median_score_a"]) for r in both} == {"s": (1, 0.05), "t": (1, 0.3)}


def test_relations(spark):
    rows = [("a", "b", "etiologic"), ("a", "c", "etiological"), ("a", "d", "other"), ("a", "b", "etiologic")]
    df = spark.createDataFrame(rows, "disease_1 string, disease_2 string, relation_type string")
    got = {r["relation_type"]: (r["case_count"], r["percentage"]) for r in e.relation_distribution(df, {"merged": ("etiologic", "etiological")}).collect()}
    assert got == {"merged": (3, 75.0), "other": (1, 25.0)}
    assert e.relation_pairs(df, "etiologic").count() == 1


def test_rate_by_complexity_equals_distinct_counts(spark):
    import random

    draw = random.Random(3)
    rows = [
        (draw.choice(["m", "n"]), draw.choice(["PubMed", "hms", None]), draw.choice(["1", "2", "3", None]), draw.choice(["Gout", "Flu", "flu", None]),
         draw.choice([1, 2, 3, 4, 5, 9, None]), draw.choice(["gout", "FLU", None]), draw.choice([1, 2]))
        for _ in range(150)
    ]
    table = spark.createDataFrame(rows, FUSED.replace("final_rank", "rank") + ", num_true_classifications int")
    want = set()
    for k in (1, 3, 5):
        for cell in {(r[1], r[0], r[6]) for r in rows if r[4] and r[4] <= k}:
            mine = [r for r in rows if (r[1], r[0], r[6]) == cell and r[4] and r[4] <= k]
            patients = {r[2] for r in mine} - {None}
            matched = {r[2] for r in mine if r[3] and r[5] and r[3].lower() == r[5].lower()} - {None}
            rate = round(len(matched) / len(patients), 4) if patients else None
            want.add((cell[0], cell[1], k, cell[2], len(patients), len({r[3] for r in mine} - {None}), len(matched), rate))
    assert {tuple(r) for r in e.rate_by_complexity(table).collect()} == want
    plan = e.rate_by_complexity(table)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
