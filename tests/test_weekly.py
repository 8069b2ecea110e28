import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators import cohort as c
from rankweave.operators import weekly as w

NOTE = "person_id long, note_id long, note_date timestamp_ntz, umls_name string, severity string"
MON = dt.datetime(2024, 1, 1)


def day(n, hour=0):
    return MON + dt.timedelta(days=n, hours=hour)


def test_weekly_dedupe(spark):
    rows = [(1, 1, day(0), "cough", "unknown"), (1, 2, day(6), "cough", "Mild"), (1, 3, day(6, 1), "cough", None),
            (1, 4, day(7), "cough", None), (2, 5, day(0), "cough", "mild")]
    cohort = spark.createDataFrame([(1,), (1,)], "person_id long")
    got = sorted((r["week_start"], r["severity"]) for r in w.weekly_dedupe(spark.createDataFrame(rows, NOTE), cohort).collect())
    assert got == [(day(0), "mild"), (day(7), "unknown")]


def weekly_rows(spark, rows):
    return spark.createDataFrame(rows, "person_id long, umls_name string, week_start timestamp_ntz, severity string")


def test_grid_and_label(spark):
    weekly = weekly_rows(spark, [(1, "a", day(0), "mild"), (1, "b", day(7), "unknown"), (2, "a", day(0), "mild")])
    grid = w.weekly_grid(weekly)
    got = {(r["person_id"], r["week_start"], r["umls_name"]): (r["code"], r["severity"]) for r in grid.collect()}
    assert len(got) == 2 * 2 + 1 and got[(1, day(0), "b")] == (2, "unknown") and got[(1, day(0), "a")] == (1, "mild")
    dx = spark.createDataFrame([(1, day(7)), (1, day(30))], "person_id long, dx_date timestamp_ntz")
    labels = {(r["person_id"], r["week_start"]): r["before_after_dx"] for r in w.label_before_after(grid, dx).collect()}
    assert labels == {(1, day(0)): "before", (1, day(7)): "after", (2, day(0)): "after"}


def random_weekly(seed, persons=25, symptoms="abcde"):
    rng = random.Random(seed)
    rows = []
    for p in range(persons):
        for week in rng.sample(range(12), rng.randint(1, 6)):
            for s in rng.sample(symptoms, rng.randint(1, 3)):
                rows.append((p, s, day(7 * week), rng.choice(["mild", "severe", "unknown"])))
    return rows


def test_cooccurrence_equals_brute_force(spark):
    rows = random_weekly(1)
    weeks = {}
    for p, s, t, _ in rows:
        weeks.setdefault((p, t), set()).add(s)
    got = {(r["symptom_1"], r["symptom_2"]): r for r in w.pair_cooccurrence(weekly_rows(spark, rows)).collect()}
    for a in "abcde":
        for b in "abcde":
            both = [k for k, s in weeks.items() if a < b and a in s and b in s]
            assert ((a, b) in got) == bool(both)
            if both:
                total = sum(a in s for s in weeks.values())
                row = got[(a, b)]
                assert (row["count"], row["distinct_person_count"], row["symptom_1_total"]) == (len(both), len({k[0] for k in both}), total)
    assert w.supported_pairs(w.pair_cooccurrence(weekly_rows(spark, rows)), 1, 2.0).count() == 0


def loop_states(grid, pairs):
    """One pair at a time, plain Python."""
    out = set()
    persons = {g[0] for g in grid}
    for s1, s2 in pairs:
        for p in persons:
            own = [g for g in grid if g[0] == p]
            weeks = sorted({g[1] for g in own})
            index = {t: i for i, t in enumerate(weeks)}
            mine = [g for g in own if g[2] in (s1, s2)]
            state = {}
            for t in sorted({g[1] for g in mine}):
                code = {g[2]: g[3] for g in mine if g[1] == t}
                state[t] = f"{code.get(s1, 0)}_{code.get(s2, 0)}"
            ts = sorted(state)
            for t, nxt in zip(ts, ts[1:]):
                sev = {g[2]: g[4] for g in mine if g[1] == t}
                others = tuple(sorted(g[2] for g in own if index[g[1]] == index[t] + 1 and g[3] == 1 and g[2] not in (s1, s2)))
                out.add((p, index[t], s1, s2, state[t], state[nxt], sev.get(s1), sev.get(s2), others))
    return out


def test_pair_states_equal_the_loop(spark):
    rows = {(r[0], r[1], r[2]): r for r in random_weekly(2)}.values()
    rows = list(rows) + [(99, "a", day(0), "mild"), (99, "a", day(70), "mild")]  # one symptom only, gap of ten weeks
    weekly = weekly_rows(spark, rows)
    grid = w.weekly_grid(weekly)
    pairs = [("a", "b"), ("b", "d"), ("c", "e")]
    got = {
        (r["person_id"], r["week_index"], r["symptom_1"], r["symptom_2"], r["joint_state"], r["next_state"], r["severity_1"],
         r["severity_2"], tuple(r["other_symptoms_in_next_week"]))
        for r in w.pair_states(grid, spark.createDataFrame(pairs, "symptom_1 string, symptom_2 string")).collect()
    }
    plain = [(g["person_id"], g["week_start"], g["umls_name"], g["code"], g["severity"]) for g in grid.collect()]
    assert got == loop_states(plain, pairs)
    assert (99, 0, "a", "b", "1_0", "1_0", "mild", None, ()) in got


def test_importance_weights_totals(spark):
    case = weekly_rows(spark, [(1, "a", day(0), "x"), (1, "a", day(7), "x"), (2, "a", day(0), "x")])
    control = weekly_rows(spark, [(3, "b", day(0), "x")])
    imp = w.log_ratio_importance(case, control)
    got = {r["umls_name"]: (r["freq_case"], r["freq_ctrl"], r["importance_score"]) for r in imp.collect()}
    assert got == {"a": (2, 0, pytest.approx(math.log2(7 / 5))), "b": (0, 1, pytest.approx(math.log2(5 / 6)))}
    weights = w.patient_weights(case, imp)
    assert {r["person_id"]: r["umls_weight"] for r in weights.collect()}[1] == pytest.approx(math.log2(7 / 5) * math.log(3), abs=1e-8)
    states = spark.createDataFrame([(1, "a", "b|c"), (1, "a", "d")], "person_id long, symptom_1 string, symptom_2 string")
    total = w.patient_total_weight(states, weights).first()
    assert total["total_symptom_weight"] == pytest.approx(math.log2(7 / 5) * math.log(3), abs=1e-6)


def test_tfidf_importance_keeps_one_row_per_name(spark):
    index = spark.createDataFrame([("d", "C1", "n", 1.0), ("d", "C2", "n", 3.0), ("e", "C1", "n", 9.0)], "disease string, CUI string, UMLS_name string, tfidf double")
    assert [tuple(r) for r in w.tfidf_importance(index, "d").collect()] == [("n", 3.0)]


def test_pair_features(spark):
    weekly = weekly_rows(spark, [(1, "a", day(0), "mild"), (1, "b", day(0), "mild"), (1, "a", day(7), "severe"), (1, "b", day(7), "mild"), (1, "a", day(14), "mild")])
    grid = w.weekly_grid(weekly)
    states = w.pair_states(grid, spark.createDataFrame([("a", "b")], "symptom_1 string, symptom_2 string"))
    weights = spark.createDataFrame([(1, "a", 1.5), (1, "b", 0.5)], "person_id long, umls_name string, umls_weight double")
    row = w.pair_features(states, weights, grid).first()
    assert (row["pair_week_distinct"], row["worsen_count"], row["pair_final_weight"]) == (2, 1, 2.0)
    person = w.person_features(w.pair_features(states, weights, grid)).first()
    assert person["normalized_weight"] == pytest.approx(2 / 3, abs=1e-8)


def test_counts_and_density(spark):
    rows = [("m", "case", 1, 10, "x"), ("m", "case", 1, 10, "x"), ("m", "case", 1, 11, "y"), ("m", "case", 2, 12, "x"), ("m", "control", 3, 13, "x")]
    notes = spark.createDataFrame(rows, "model string, group string, person_id long, note_id long, CUI string")
    row = c.case_control_table(c.cohort_counts(notes)).first()
    assert (row["case_total_concepts"], row["case_total_persons"], row["case_total_notes"], row["diff_total_notes"]) == (3, 2, 3, 2)
    dens = c.density_per_patient(notes).first()
    assert (dens["case_mean_density"], dens["case_std_density"], dens["control_persons"]) == (1.25, 0.25, 1)
    only = c.case_control_table(c.cohort_counts(notes.filter("group = 'case'"))).first()
    assert only["control_total_notes"] == 0 and only["control_concepts_per_note"] is None


def test_demographics(spark):
    d = dt.date(2024, 1, 1)
    pairs = spark.createDataFrame([(1, 2, d, d, "F", "A", 50.0, 60.0), (1, 3, d, d, "F", "A", 50.0, 70.0)],
        "case_id long, control_id long, case_dx_date date, control_dx_date date, gender string, race string, case_onset_age double, control_onset_age double")
    got = {(r["group"], r["attribute"], r["value"]): r["measure"] for r in c.demographics(c.person_table(pairs)).collect()}
    assert got[("case", "gender", "F")] == 1.0 and got[("control", "onset_age", "mean")] == 65.0 and got[("case", "onset_age", "std")] is None


def test_state_counts_and_symptoms(spark):
    rows = spark.createDataFrame([("case", 1, "1_1"), ("case", 1, "1_1"), ("control", 2, "1_2")], "group string, person_id long, joint_state string")
    assert [tuple(r) for r in w.state_counts(rows, "joint_state", "1_1").collect()] == [("case", 2, 1)]
    weekly = weekly_rows(spark, [(1, "a", day(0), ""), (1, "b", day(0), ""), (1, "a", day(7), "")]).withColumn("group", F.lit("case"))
    row = w.symptoms_per_week(weekly).first()
    assert (row["person_weeks"], row["mean_symptoms"], row["median_symptoms"]) == (2, 1.5, 1)
