"""Counts of notes by the sets of their concepts."""

from __future__ import annotations

from rankweave.operators import cohort


def test_counts_without_a_row_per_note_and_model(spark):
    rows = [("case", 1, 10, "a"), ("case", 1, 10, "a"), ("case", 1, 10, "b"), ("case", 1, None, "b"), ("case", 2, 11, "c"), ("control", 3, 10, "a"),
            ("control", 3, 12, None), ("control", 4, 13, "d"), (None, 5, 14, "a")]
    notes = spark.createDataFrame(rows, '`group` string, person_id long, note_id long, CUI string')
    sets = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", "c"), ("y", "a"), ("z", "q")], "model string, CUI string")
    joined = notes.join(sets.distinct(), "CUI")
    want = sorted(map(str, cohort.cohort_counts(joined).collect()))
    counts = cohort.cohort_counts(notes, sets)
    assert sorted(map(str, counts.collect())) == want and len(want) == 6
    # models meet the kinds of notes only: no aggregate has a model and a note in its keys
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate [" in line and "model#" in line and "note_id#" in line for line in plan.splitlines())
