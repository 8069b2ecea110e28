"""Weekly symptom states: dedupe, grid, co-occurrence, pair states, importance and patient weights.

Every operator first reduces notes to distinct (person, week, symptom) rows with map-side combining.  After that a
person holds at most one row per calendar week and symptom, however many notes the person has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.spans import few

UNKNOWN = "unknown"


def weekly_dedupe(notes: DataFrame, cohort: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One row per (person, symptom, Monday of the week): known severity first, then the newest note.

    A note without a person, a symptom name or a date belongs to no week and is left out.

    ``cohort`` (person_id) restricts the persons.  The choice is an aggregate over a struct, not a window, so a hot
    person is combined before the shuffle.  That sorts the notes of a task; with ``parts`` they are dealt into so many
    partitions first, by person, symptom and week, and sorted once, so a task holds no more notes as they grow.
    """
    rows = notes if cohort is None else notes.join(cohort.select("person_id"), "person_id", "left_semi")
    rows = rows.dropna(subset=["person_id", "umls_name", "note_date"])
    severity = F.coalesce(F.lower("severity"), F.lit(UNKNOWN))
    order = F.struct((severity != UNKNOWN).cast("int"), F.col("note_date"), F.col("note_id"))
    week = F.date_trunc("week", "note_date").cast("timestamp_ntz")
    rows = rows if parts is None else rows.repartition(parts, "person_id", "umls_name", week)
    return rows.groupBy("person_id", "umls_name", week.alias("week_start")).agg(F.max_by(severity, order).alias("severity"))


def dealt_by_person(weekly: DataFrame, parts: int) -> DataFrame:
    """The weekly table in so many partitions by person, kept: what is counted per person needs no other shuffle.

    A number given here is not merged by Spark, which would go by shuffled bytes: weekly rows pack well there, and all
    that a task makes from them (grid, states) is many times larger.
    """
    return weekly.repartition(parts, "person_id").persist()


def weekly_grid(weekly: DataFrame) -> DataFrame:
    """Every (person, observed week, symptom of that person): code 1 present, 2 another symptom that week, 0 none.

    Only weeks with some symptom are observed, so 0 does not occur here; a missing severity is 'unknown'.  A
    person-week is one row with a map of its symptoms, joined once with the person's symptom set; both are bounded by
    the number of different symptoms.
    """
    per_week = weekly.filter(F.col("umls_name").isNotNull()).groupBy("person_id", "week_start").agg(
        F.map_from_entries(F.collect_list(F.struct("umls_name", "severity"))).alias("present")
    )
    per_person = (
        per_week.select("person_id", F.explode(F.map_keys("present")).alias("umls_name"))
        .groupBy("person_id")
        .agg(F.collect_set("umls_name").alias("symptoms"))
    )
    grid = per_week.join(per_person, "person_id").select(
        "person_id", "week_start", "present", F.explode("symptoms").alias("umls_name")
    )
    here = F.map_contains_key("present", F.col("umls_name"))
    return grid.select(
        "person_id",
        "umls_name",
        "week_start",
        F.when(here, 1).otherwise(2).alias("code"),
        F.coalesce(F.element_at("present", F.col("umls_name")), F.lit(UNKNOWN)).alias("severity"),
    )


def label_before_after(grid: DataFrame, dx: DataFrame) -> DataFrame:
    """``before`` when the week starts before the person's diagnosis date, else ``after`` (also without a date).

    ``dx``: person_id, dx_date; the earliest date of a person counts.
    """
    first = dx.groupBy("person_id").agg(F.min("dx_date").alias("dx_date"))
    before = F.col("week_start") < F.col("dx_date")
    return (
        grid.join(first, "person_id", "left")
        .withColumn("before_after_dx", F.when(before, "before").otherwise("after"))
        .drop("dx_date")
    )


def pair_cooccurrence(weekly: DataFrame) -> DataFrame:
    """Symptom pairs (symptom_1 < symptom_2) of the same person-week: weeks, persons, rate over symptom_1's weeks.

    A person's weeks with the same symptom set are counted first and expanded once; the expansion streams into
    map-side combining and is never stored.
    """
    days = weekly.select("person_id", "week_start", "umls_name").distinct()
    sets = days.groupBy("person_id", "week_start").agg(F.array_sort(F.collect_set("umls_name")).alias("s"))
    kinds = sets.groupBy("person_id", "s").agg(F.count("*").alias("weeks"))
    first = kinds.select("person_id", "weeks", "s", F.posexplode("s").alias("i", "symptom_1"))
    pairs = first.select(
        "person_id", "weeks", "symptom_1", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("symptom_2")
    )
    per_person = pairs.groupBy("symptom_1", "symptom_2", "person_id").agg(F.sum("weeks").alias("weeks"))
    counts = per_person.groupBy("symptom_1", "symptom_2").agg(
        F.sum("weeks").alias("count"), F.count("*").alias("distinct_person_count")
    )
    totals = kinds.select("weeks", F.explode("s").alias("symptom_1")).groupBy("symptom_1").agg(
        F.sum("weeks").alias("symptom_1_total")
    )
    return counts.join(totals, "symptom_1").withColumn(
        "cooccurrence_rate", F.round(F.col("count") / F.col("symptom_1_total"), 6)
    )


def supported_pairs(cooccurrence: DataFrame, min_persons: int = 10, min_rate: float | None = None) -> DataFrame:
    """Pairs seen in at least ``min_persons`` persons and, when given, with at least ``min_rate``."""
    kept = cooccurrence.filter(F.col("distinct_person_count") >= min_persons)
    kept = kept if min_rate is None else kept.filter(F.col("cooccurrence_rate") >= min_rate)
    return kept.select("symptom_1", "symptom_2")


def pair_states(grid: DataFrame, pairs: DataFrame) -> DataFrame:
    """States of every supported pair for every person with at least one of its symptoms, for all pairs in one plan.

    ``grid`` is the complete grid of :func:`weekly_grid` (optionally the weeks before the diagnosis).  Per pair and
    observed week: ``joint_state`` = code of symptom_1 and symptom_2 (0 when the person never has it), the state of
    the person's next observed week (the last week is dropped), both severities, and the other symptoms present in
    that next week, plain and with severity.

    A person-week is one row with a map from symptom to (code, severity).  The next week comes from one ``lead`` per
    person instead of a join per pair.  Pairs are sent to the person-weeks; only too many of them are joined on the
    person.
    """
    grid = grid.filter(F.col("person_id").isNotNull() & F.col("umls_name").isNotNull())
    per_week = grid.groupBy("person_id", "week_start").agg(
        F.map_from_entries(F.collect_list(F.struct("umls_name", F.struct("code", "severity")))).alias("cur")
    )
    person = Window.partitionBy("person_id")
    order = person.orderBy("week_start")
    weeks = per_week.withColumn("week_index", (F.row_number().over(order) - 1).cast("int")).withColumn(
        "nxt", F.lead("cur").over(order)
    )
    pairs = pairs.select("symptom_1", "symptom_2").distinct()
    if few(pairs):
        # the weeks of a complete grid have the same symptoms, so the set holds one list
        own = F.collect_set(F.array_sort(F.map_keys("cur"))).over(person)
        rows = weeks.withColumn("own", F.array_distinct(F.flatten(own))).filter(F.col("nxt").isNotNull())
        ends = [pairs.select(F.col(f"symptom_{i}").alias("end"), F.lit(i == 1).alias("first"), "symptom_1", "symptom_2") for i in (1, 2)]
        by_end = ends[0].unionByName(ends[1]).groupBy("end").agg(
            F.collect_list(F.struct("first", "symptom_1", "symptom_2")).alias("pairs")
        )
        # a pair with both symptoms in a person is taken at its first one
        new = F.filter("pairs", lambda p: p["first"] | ~F.coalesce(F.array_contains("own", p["symptom_1"]), F.lit(False)))
        rows = (
            rows.withColumn("end", F.explode("own"))
            .join(F.broadcast(by_end), "end")
            .withColumn("pair", F.explode(new))
            .select("person_id", "week_index", "week_start", "cur", "nxt", "pair.symptom_1", "pair.symptom_2")
        )
    else:
        symptoms = grid.select("person_id", "umls_name").distinct()
        with_first = symptoms.join(pairs, symptoms["umls_name"] == pairs["symptom_1"])
        with_second = symptoms.join(pairs, symptoms["umls_name"] == pairs["symptom_2"])
        columns = ["person_id", "symptom_1", "symptom_2"]
        wanted = with_first.select(*columns).unionByName(with_second.select(*columns)).distinct()
        rows = weeks.filter(F.col("nxt").isNotNull()).join(wanted, "person_id")

    def code(week: str, symptom: str) -> Column:
        return F.coalesce(F.element_at(F.col(week), F.col(symptom))["code"], F.lit(0))

    def state(week: str) -> Column:
        return F.concat_ws("_", code(week, "symptom_1"), code(week, "symptom_2"))

    others = F.filter(
        F.map_entries("nxt"),
        lambda e: (e["value"]["code"] == 1) & (e["key"] != F.col("symptom_1")) & (e["key"] != F.col("symptom_2")),
    )
    named = F.transform(others, lambda e: e["key"])
    graded = F.transform(others, lambda e: F.concat_ws(":", e["key"], e["value"]["severity"]))
    return rows.select(
        "person_id",
        "week_index",
        "week_start",
        "symptom_1",
        "symptom_2",
        state("cur").alias("joint_state"),
        state("nxt").alias("next_state"),
        F.element_at("cur", F.col("symptom_1"))["severity"].alias("severity_1"),
        F.element_at("cur", F.col("symptom_2"))["severity"].alias("severity_2"),
        F.array_sort(named).alias("other_symptoms_in_next_week"),
        F.array_sort(graded).alias("other_symptoms_with_severity"),
    )


def log_ratio_importance(case: DataFrame, control: DataFrame, smooth: float = 5.0) -> DataFrame:
    """Per symptom: persons in each group and ``log2((case + s) / (control + s))``; absent = 0.

    Both groups are one union with a conditional distinct count, so there is no outer join.
    """
    both = case.select("person_id", "umls_name", F.lit(True).alias("is_case")).unionByName(
        control.select("person_id", "umls_name", F.lit(False).alias("is_case"))
    )
    persons = both.distinct().groupBy("umls_name").agg(
        F.count_if("is_case").alias("freq_case"), F.count_if(~F.col("is_case")).alias("freq_ctrl")
    )
    ratio = (F.col("freq_case") + smooth) / (F.col("freq_ctrl") + smooth)
    return persons.withColumn("importance_score", F.round(F.log2(ratio), 9))


def tfidf_importance(index: DataFrame, disease: str) -> DataFrame:
    """Importance per concept name from the TF-IDF rows of one disease: the largest value of a name."""
    return index.filter(F.col("disease") == disease).groupBy(F.col("UMLS_name").alias("umls_name")).agg(
        F.max("tfidf").alias("importance_score")
    )


def patient_weights(weekly: DataFrame, importance: DataFrame) -> DataFrame:
    """Weeks per (person, symptom) and weight = importance * ln(1 + weeks); null without an importance."""
    freq = weekly.groupBy("person_id", "umls_name").agg(F.count_distinct("week_start").alias("freq_within_patient"))
    scores = importance.select("umls_name", "importance_score")
    return freq.join(scores, "umls_name", "left").select(
        "person_id",
        "umls_name",
        "freq_within_patient",
        "importance_score",
        F.round(F.col("importance_score") * F.log1p("freq_within_patient"), 9).alias("umls_weight"),
    )


def patient_total_weight(states: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of the weights of the distinct symptoms that occur in a person's pairs, each symptom once."""
    ends = states.select("person_id", F.explode(F.array("symptom_1", "symptom_2")).alias("umls_name")).distinct()
    joined = ends.join(weights.select("person_id", "umls_name", "umls_weight"), ["person_id", "umls_name"], "left")
    return joined.groupBy("person_id").agg(F.round(F.sum("umls_weight"), 6).alias("total_symptom_weight"))


def severity_rank(c: Column, scale: Sequence[str] = ("mild", "moderate", "severe")) -> Column:
    """Position on the severity scale, 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in scale]), c), F.lit(0))


def pair_features(states: DataFrame, weights: DataFrame, grid: DataFrame) -> DataFrame:
    """Per (person, pair) with state '1_1': pair weight w1 + w2, distinct active weeks, worsening episodes.

    An episode worsens when the severity of either symptom in the person's next observed week is above this week's
    (scale mild < moderate < severe, anything else below mild).
    """
    order = Window.partitionBy("person_id", "umls_name").orderBy("week_start")
    ranked = grid.withColumn("r", severity_rank(F.col("severity")))
    worse = ranked.withColumn("worse", (F.lead("r").over(order) > F.col("r")).cast("int")).select(
        "person_id", "week_start", "umls_name", F.coalesce("worse", F.lit(0)).alias("worse")
    )
    active = states.filter(F.col("joint_state") == "1_1").select("person_id", "week_start", "symptom_1", "symptom_2")
    for end in ("1", "2"):
        side = worse.select("person_id", "week_start", F.col("umls_name").alias(f"symptom_{end}"), F.col("worse").alias(f"worse_{end}"))
        active = active.join(side, ["person_id", "week_start", f"symptom_{end}"], "left")
    feats = active.groupBy("person_id", "symptom_1", "symptom_2").agg(
        F.count_distinct("week_start").alias("pair_week_distinct"),
        F.count_if((F.col("worse_1") == 1) | (F.col("worse_2") == 1)).alias("worsen_count"),
    )
    for end in ("1", "2"):
        side = weights.select("person_id", F.col("umls_name").alias(f"symptom_{end}"), F.col("umls_weight").alias(f"w{end}"))
        feats = feats.join(side, ["person_id", f"symptom_{end}"], "left")
    return feats.select(
        "person_id",
        "symptom_1",
        "symptom_2",
        "pair_week_distinct",
        "worsen_count",
        F.round(F.col("w1") + F.col("w2"), 6).alias("pair_final_weight"),
    )


def person_features(features: DataFrame) -> DataFrame:
    """Sums per person and normalised weight = pair weight / (active weeks + 1)."""
    sums = features.groupBy("person_id").agg(
        F.sum("pair_week_distinct").alias("pair_week_distinct"),
        F.sum("worsen_count").alias("worsen_count"),
        F.round(F.sum("pair_final_weight"), 6).alias("pair_final_weight"),
    )
    return sums.withColumn(
        "normalized_weight", F.round(F.col("pair_final_weight") / (F.col("pair_week_distinct") + 1), 9)
    )


def state_counts(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Rows and persons with ``column == value`` per group."""
    return rows.filter(F.col(column) == value).groupBy("group").agg(
        F.count("*").alias("n_rows"), F.count_distinct("person_id").alias("n_persons")
    )


def symptoms_per_week(weekly: DataFrame) -> DataFrame:
    """Distinct symptoms per person-week: mean and median per group."""
    per_week = weekly.groupBy("group", "person_id", "week_start").agg(F.count_distinct("umls_name").alias("n"))
    return per_week.groupBy("group").agg(
        F.count("*").alias("person_weeks"),
        F.round(F.avg("n"), 6).alias("mean_symptoms"),
        F.percentile_approx("n", 0.5, 10000).alias("median_symptoms"),
    )
