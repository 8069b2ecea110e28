"""Case / control summaries of note mentions and demographics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = ("case", "control")


def cohort_counts(notes: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Per (model, group): distinct note-concept pairs, persons, notes.

    Deduplicated in two steps of one distinct each, so no group is counted by a single task.

    With ``sets`` (model, CUI) the notes have no model yet, and each counts for all models whose set holds its concept.  The
    notes are then not multiplied by the models: notes and persons are counted by the set of their concepts first,
    and only each different set meets the models.
    """
    if sets is not None:
        return _counts_by_sets(notes, sets.select("model", "CUI").distinct())
    pairs = notes.groupBy("model", "group", "person_id", "note_id", "CUI").agg(F.lit(1).alias("one"))
    per_note = pairs.groupBy("model", "group", "person_id", "note_id").agg(F.count("*").alias("concepts"))
    per_person = per_note.groupBy("model", "group", "person_id").agg(
        F.sum("concepts").alias("concepts"), F.count("*").alias("notes")
    )
    return per_person.groupBy("model", "group").agg(
        F.sum("concepts").alias("total_concepts"), F.count("*").alias("total_persons"), F.sum("notes").alias("total_notes")
    )


def _counts_by_sets(notes: DataFrame, sets: DataFrame) -> DataFrame:
    known = notes.filter(F.col("CUI").isNotNull())  # no set holds a null
    found = F.array_sort(F.collect_set("CUI")).alias("held")
    per_note = known.groupBy("group", "person_id", "note_id").agg(found)
    note_kinds = per_note.groupBy("group", "held").agg(F.count("*").alias("notes"))
    per_person = known.select("group", "person_id", "CUI").distinct().groupBy("group", "person_id").agg(found)
    person_kinds = per_person.groupBy("group", "held").agg(F.count("*").alias("persons"))
    kinds = note_kinds.select("group", "held", "notes", F.lit(0).cast("long").alias("persons")).unionByName(
        person_kinds.select("group", "held", F.lit(0).cast("long").alias("notes"), "persons"))
    kinds = kinds.groupBy("group", "held").agg(F.sum("notes").alias("notes"), F.sum("persons").alias("persons"))
    # one row per kind and model, with how many of the kind's concepts the model has
    met = kinds.withColumn("CUI", F.explode("held")).join(sets, "CUI").groupBy("model", "group", "held", "notes", "persons").agg(F.count("*").alias("shared"))
    return met.groupBy("model", "group").agg(
        F.sum(F.col("shared") * F.col("notes")).alias("total_concepts"), F.sum("persons").alias("total_persons"), F.sum("notes").alias("total_notes"))


def case_control_table(counts: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Counts as case / control columns with differences and concepts per note."""
    measures = ("total_concepts", "total_persons", "total_notes")
    wide = counts.groupBy("model").pivot("group", list(groups)).agg(*[F.first(m).alias(m) for m in measures])
    a, b = groups
    return wide.select(
        "model",
        *[F.coalesce(f"{g}_{m}", F.lit(0)).alias(f"{g}_{m}") for g in groups for m in measures],
        *[(F.coalesce(f"{a}_{m}", F.lit(0)) - F.coalesce(f"{b}_{m}", F.lit(0))).alias(f"diff_{m}") for m in measures],
        *[
            F.round(F.try_divide(f"{g}_total_concepts", f"{g}_total_notes"), 4).alias(f"{g}_concepts_per_note")
            for g in groups
        ],
    )


def density_per_patient(notes: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Mentions per distinct note of each person; per (model, group) mean and population deviation, as columns."""
    per_note = notes.groupBy("model", "group", "person_id", "note_id").agg(F.count("*").alias("mentions"))
    per_person = per_note.groupBy("model", "group", "person_id").agg(
        (F.sum("mentions") / F.count("*")).alias("density")
    )
    stats = per_person.groupBy("model", "group").agg(
        F.round(F.avg("density"), 3).alias("mean_density"),
        F.round(F.stddev_pop("density"), 3).alias("std_density"),
        F.count("*").alias("persons"),
    )
    measures = ("mean_density", "std_density", "persons")
    return stats.groupBy("model").pivot("group", list(groups)).agg(*[F.first(m).alias(m) for m in measures])


def demographics(persons: DataFrame) -> DataFrame:
    """Long table per group: persons by gender and race, mean and deviation of the onset age.

    ``persons``: group, person_id, gender, race, onset_age; one row per person.
    """
    cats = persons.select(
        "group",
        F.explode(
            F.array(
                F.struct(F.lit("gender").alias("attribute"), F.col("gender").alias("value")),
                F.struct(F.lit("race").alias("attribute"), F.col("race").alias("value")),
            )
        ).alias("a"),
    )
    counted = cats.groupBy("group", F.col("a.attribute").alias("attribute"), F.col("a.value").alias("value")).agg(
        F.count("*").cast("double").alias("measure")
    )
    ages = persons.groupBy("group").agg(F.avg("onset_age").alias("m"), F.stddev("onset_age").alias("s"))
    long_ages = ages.select(
        "group", F.lit("onset_age").alias("attribute"), F.expr("stack(2, 'mean', m, 'std', s) AS (value, measure)")
    )
    return counted.unionByName(long_ages).withColumn("measure", F.round("measure", 4))


def person_table(pairs: DataFrame) -> DataFrame:
    """Case / control pairs to one row per (group, person): dates, gender, race, onset age."""
    rows = pairs.select(
        F.explode(
            F.array(
                F.struct(
                    F.lit("case").alias("group"), F.col("case_id").alias("person_id"), F.col("case_dx_date").alias("dx_date"),
                    "gender", "race", F.col("case_onset_age").alias("onset_age"),
                ),
                F.struct(
                    F.lit("control").alias("group"), F.col("control_id").alias("person_id"),
                    F.col("control_dx_date").alias("dx_date"),
                    "gender", "race", F.col("control_onset_age").alias("onset_age"),
                ),
            )
        ).alias("p")
    ).select("p.*")
    return rows.groupBy("group", "person_id").agg(
        *[F.min(c).alias(c) for c in ("dx_date", "gender", "race", "onset_age")]
    )
