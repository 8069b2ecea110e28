"""Rows that the table bindings never make: empty cohorts, gaps in ranks, nulls in keys, long lists, other JSON layouts."""

import datetime as dt

import pytest

from rankweave.operators import concepts, evaluation, fusion, telemetry, weekly

RANKED = "model string, dataset string, patient_id string, disease string, rank int, rare_disease_name string"


@pytest.fixture
def only_pubmed(spark):
    return spark.createDataFrame([("a", "pubmed", "1", "Gout", 1, "gout"), ("a", "pubmed", "2", "Flu", 1, "Gout")], RANKED)


def test_cohorts_without_a_ranking_have_rows(spark, only_pubmed):
    totals = spark.createDataFrame([("all", 3), ("pubmed", 2), ("non_pubmed", 1)], "cohort string, total long")
    got = {r["cohort"]: (r["hits"], r["recall"]) for r in evaluation.recall_at_k(only_pubmed, totals, ks=(1,)).collect()}
    assert got == {"all": (1, 0.3333), "pubmed": (1, 0.5), "non_pubmed": (0, 0.0)}
    got = {r["group"]: (r["total"], r["hits"], r["accuracy"]) for r in evaluation.accuracy_at_k(only_pubmed, ks=(1,), rank_col="rank").collect()}
    assert got == {"all": (2, 1, 0.5), "pubmed": (2, 1, 0.5), "non_pubmed": (0, 0, 0.0)}


def test_data_sets_without_a_ranking_count(spark, only_pubmed):
    patients = spark.createDataFrame([("pubmed", "1"), ("pubmed", "2"), ("hms", "3")], "dataset string, patient_id string")
    rates = evaluation.match_rate(only_pubmed, patients, ks=(1,))
    assert {r["dataset"]: (r["total_pts"], r["matched_pts"]) for r in rates.collect()} == {"pubmed": (2, 1), "hms": (1, 0)}
    assert evaluation.pooled_match_rate(rates).first()["match_rate"] == 0.3333


def test_details_end_at_ten(spark):
    rows = [("a", "p", "1", f"d{i:02d}", i) for i in range(1, 15)]
    fused = spark.createDataFrame(rows, "model string, dataset string, patient_id string, disease string, final_rank int")
    truth = spark.createDataFrame([("p", "1", "d13")], "dataset string, patient_id string, rare_disease_name string")
    row = evaluation.eval_detail(fused, truth).first()
    assert row["n_predictions"] == 10 and row["status"] == "not_found_in_top10" and row["matched_rank"] is None
    assert row["top10_predicted_diseases"].split(" | ")[-1] == "d10"


def test_overall_recall(spark):
    rates = spark.createDataFrame([(1, 2, 4), (1, 1, 6), (3, 5, 10)], "k int, matched_pts long, total_pts long")
    assert sorted(tuple(r) for r in evaluation.overall_recall(rates).collect()) == [(1, 3, 10, 0.3), (3, 5, 10, 0.5)]


def test_a_missing_candidate_comes_after_all(spark):
    """Ranks with gaps: model c lists x at 9, so its missing y comes at 10 and not at 2."""
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 2), ("c", "x", 9)]
    ranked = spark.createDataFrame([(m, "p", "1", d, r) for m, d, r in rows], "model string, dataset string, patient_id string, disease string, rank int")
    got = fusion.consensus_gate(ranked, ["c", "a", "b"]).collect()
    assert {r["gated_model"] for r in got} == {"c"} and got[0]["consensus"] == 2.0


def test_null_symptoms_end_no_job(spark):
    rows = [(1, "cough", dt.datetime(2024, 1, 1), 1, "mild"), (1, None, dt.datetime(2024, 1, 1), 2, None), (1, "fever", dt.datetime(2024, 1, 9), 3, None)]
    notes = spark.createDataFrame(rows, "person_id long, umls_name string, note_date timestamp, note_id long, severity string")
    deduped = weekly.weekly_dedupe(notes)
    assert sorted(r["umls_name"] for r in deduped.collect()) == ["cough", "fever"]
    raw = notes.selectExpr("person_id", "umls_name", "note_date AS week_start", "severity")
    grid = weekly.weekly_grid(raw)
    assert grid.count() == 4
    pairs = spark.createDataFrame([("cough", "fever")], "symptom_1 string, symptom_2 string")
    broken = grid.unionByName(grid.limit(1).withColumn("umls_name", weekly.F.lit(None).cast("string")))
    assert weekly.pair_states(broken, pairs).first()["joint_state"] == "1_2"


@pytest.mark.parametrize("layout, text, want", [
    ("input_output", '{"input_tokens": 5, "output_tokens": 7, "output_tokens_details": {"reasoning_tokens": 3}}', (5, 7)),
    ("prompt_completion", '{"prompt_tokens": 5, "completion_tokens": 7, "total_tokens": 12}', (5, 7)),
    ("server_tools", '{"input_tokens": 5, "output_tokens": "n/a", "server_tool_use": {"web_search_requests": 2}}', (5, None)),
    ("metadata", '{"prompt_token_count": 5, "candidates_token_count": 7, "thoughts_token_count": 3}', (5, 10)),
    ("metadata", '{"prompt_token_count": 5}', (5, None)),
    ("metadata", "{oops", (None, None)),
])
def test_usage_layouts(spark, layout, text, want):
    row = telemetry.token_usage(spark.createDataFrame([("m", text)], "model string, usage string"), layout).first()
    assert (row["input_tokens"], row["output_tokens"]) == want


def test_two_sections_of_a_disease_are_both_kept(spark):
    table = lambda c, *texts: spark.createDataFrame([("Gout", t) for t in texts], f"disease_name string, {c} string")
    a, b, c, d = concepts.SECTION_COLUMNS
    row = concepts.assemble_sections(table(a, "two", "one", "one"), table(b, "x"), table(c), table(d, None)).first()
    assert (row[a], row[b], row[c], row[d]) == ("one\ntwo", "x", None, None)
