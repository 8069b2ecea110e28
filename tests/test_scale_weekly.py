"""Weekly states in partitions by person whose number follows the rows."""

from __future__ import annotations

import datetime as dt
import random

from rankweave.functions import spans
from rankweave.operators import weekly as w
from rankweave.plans import bindings

PAIR = "symptom_1 string, symptom_2 string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def weekly_rows(spark, persons=20):
    rng = random.Random(5)
    rows = [
        (p, s, day(7 * week), rng.choice(["mild", "severe", "unknown"]))
        for p in range(persons) for week in rng.sample(range(10), rng.randint(1, 6)) for s in rng.sample("abcde", rng.randint(1, 3))
    ]
    return spark.createDataFrame(rows, "person_id long, umls_name string, week_start timestamp_ntz, severity string")


def test_states_of_sent_pairs_equal_those_of_joined_ones(spark, monkeypatch):
    rows = [(r[0], r[2], r[1], 1 + (r[0] + len(r[3])) % 2, r[3]) for r in weekly_rows(spark).collect()]  # not every symptom in every week
    rows += [(None, day(0), "a", 1, "mild"), (None, day(7), "a", 1, "mild"), (50, day(0), "e", 1, None), (50, day(7), None, 1, "mild"),
             (51, None, "a", 1, "mild"), (51, day(0), "b", 2, "mild")]
    grid = spark.createDataFrame(rows, "person_id long, week_start timestamp_ntz, umls_name string, code int, severity string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "d"), ("c", "c"), ("a", None), (None, "a"), ("e", "q"), ("x", "y")], PAIR)
    sent = sorted(map(str, w.pair_states(grid, pairs).collect()))
    monkeypatch.setattr(spans, "SENT", -1)
    assert sorted(map(str, w.pair_states(grid, pairs).collect())) == sent and len(sent) == len(set(sent)) > 100


def test_states_of_persons_in_one_place_need_no_shuffle(spark):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")  # as for pairs whose size Spark does not know
    try:
        dealt = weekly_rows(spark, 60).repartition(6, "person_id").persist()
        states = w.pair_states(w.weekly_grid(dealt), spark.createDataFrame([("a", "b"), ("b", "d"), ("c", "e")], PAIR))
        assert states.collect()
        plan = states._jdf.queryExecution().executedPlan().toString()
        dealt.unpersist()
    finally:
        spark.conf.set(threshold, before)
    plan = plan[plan.index("Final Plan"):plan.index("Initial Plan")]
    # symptoms are not dealt out, and the one sorted join is that of the grid
    assert "hashpartitioning(umls_name" not in plan and plan.count("SortMergeJoin") == 1


def test_partitions_follow_the_rows(spark, tmp_path):
    note = "person_id long, note_id long, note_date timestamp_ntz, umls_name string, severity string"
    rows = [(i % 7, i, day(i % 30), "ab"[i % 2], ("mild", "unknown", None)[i % 3]) for i in range(300)] + [(None, 1, day(0), "a", "mild"), (1, 2, None, "a", "x")]
    notes = spark.createDataFrame(rows, note)
    notes.write.parquet(f"{tmp_path}/notes.parquet")
    least = spark.sparkContext.defaultParallelism
    assert [bindings.parts(spark, tmp_path, "notes", n) for n in (10, 50, 1000)] == [31, 7, least]
    dealt = w.weekly_dedupe(notes, parts=31)
    assert dealt.rdd.getNumPartitions() == 31
    assert sorted(map(str, dealt.collect())) == sorted(map(str, w.weekly_dedupe(notes).collect()))
    kept = w.dealt_by_person(dealt, 9)
    assert kept.rdd.getNumPartitions() == 9 and kept.count() == dealt.count()
    kept.unpersist()
