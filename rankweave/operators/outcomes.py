"""Rank transitions between two rankings and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.operators.evaluation import cohorts
from rankweave.operators.retrieval import QUERY


def rank_transition(base: DataFrame, new: DataFrame, miss: int = 11) -> DataFrame:
    """Compares the truth ranks of two rankings (model, dataset, patient_id, ground_truth_disease_rank).

    ``kb_vs_base``: better / worse / same.  ``top1_transition``: stable_top1 / lost_top1 / gained_top1 /
    never_top1.  A patient missing on one side has rank ``miss`` there.
    """
    rank = "ground_truth_disease_rank"
    both = base.select(*QUERY, F.col(rank).alias("b")).join(new.select(*QUERY, F.col(rank).alias("n")), QUERY, "outer")
    b, n = F.coalesce("b", F.lit(miss)), F.coalesce("n", F.lit(miss))
    return both.select(
        *QUERY,
        b.alias("base_rank_nokb"),
        n.alias("kb_rank"),
        F.when(n < b, "better").when(n > b, "worse").otherwise("same").alias("kb_vs_base"),
        F.when((b == 1) & (n == 1), "stable_top1")
        .when(b == 1, "lost_top1")
        .when(n == 1, "gained_top1")
        .otherwise("never_top1")
        .alias("top1_transition"),
    )


def _share(part: str, total: str, digits: int = 1) -> Column:
    return F.round(F.try_divide(F.col(part) * 100.0, F.col(total)), digits).alias(part.replace("_n", "_pct"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Per model: better / worse / same counts and percents, overall and split by base top-1 status."""
    top1 = F.col("base_rank_nokb") == 1
    aggs = [F.count("*").alias("total"), F.count_if(top1).alias("top1_total"), F.count_if(~top1).alias("rest_total")]
    for kind in ("better", "worse", "same"):
        is_kind = F.col("kb_vs_base") == kind
        aggs += [
            F.count_if(is_kind).alias(f"{kind}_n"),
            F.count_if(is_kind & top1).alias(f"top1_{kind}_n"),
            F.count_if(is_kind & ~top1).alias(f"rest_{kind}_n"),
        ]
    counted = outcomes.groupBy("model").agg(*aggs)
    shares = [
        _share(f"{prefix}{kind}_n", total, 2)
        for prefix, total in (("", "total"), ("top1_", "top1_total"), ("rest_", "rest_total"))
        for kind in ("better", "worse", "same")
    ]
    return counted.select("*", *shares)


def transition_by_cohort(outcomes: DataFrame) -> DataFrame:
    """Per (cohort, model): percent of base top-1 cases kept or lost, of the others better / worse / same.

    One aggregate with conditional counts; cohorts and models without both populations are left out.
    """
    top1 = F.col("base_rank_nokb") == 1
    better, worse = F.col("kb_vs_base") == "better", F.col("kb_vs_base") == "worse"
    counted = (
        outcomes.withColumn("cohort", F.explode(cohorts(F.col("dataset"))))
        .groupBy("cohort", "model")
        .agg(
            F.count_if(top1).alias("top1_total"),
            F.count_if(top1 & (F.col("top1_transition") == "stable_top1")).alias("top1_same_n"),
            F.count_if(top1 & (F.col("top1_transition") == "lost_top1")).alias("top1_worse_n"),
            F.count_if(~top1).alias("non_top1_total"),
            F.count_if(~top1 & better).alias("non_top1_better_n"),
            F.count_if(~top1 & worse).alias("non_top1_worse_n"),
            F.count_if(~top1 & (F.col("kb_vs_base") == "same")).alias("non_top1_same_n"),
        )
        .filter((F.col("top1_total") > 0) & (F.col("non_top1_total") > 0))
    )
    return counted.select(
        "cohort",
        "model",
        _share("top1_same_n", "top1_total"),
        _share("top1_worse_n", "top1_total"),
        _share("non_top1_better_n", "non_top1_total"),
        _share("non_top1_worse_n", "non_top1_total"),
        _share("non_top1_same_n", "non_top1_total"),
    )


def promotion_rate(outcomes: DataFrame) -> DataFrame:
    """Share of base non-top-1 cases that reach rank 1, per (cohort, model)."""
    return (
        outcomes.filter(F.col("base_rank_nokb") != 1)
        .withColumn("cohort", F.explode(cohorts(F.col("dataset"))))
        .groupBy("cohort", "model")
        .agg(F.count("*").alias("non_top1_total"), F.count_if(F.col("kb_rank") == 1).alias("promoted"))
        .withColumn("promotion_rate", F.round(F.col("promoted") / F.col("non_top1_total"), 4))
    )


def all_members_agree(
    outcomes: DataFrame, status: str, n: int, status_col: str = "kb_vs_base", keys: Sequence[str] = ("dataset", "patient_id")
) -> DataFrame:
    """(keys, disease) for which ``n`` distinct models share a status, counted per disease."""
    agreed = (
        outcomes.filter(F.col(status_col) == status)
        .groupBy(*keys, "correct_disease")
        .agg(F.count_distinct("model").alias("num_models"))
        .filter(F.col("num_models") == n)
    )
    return agreed.groupBy("correct_disease").agg(F.count("*").alias("n_cases"))


def rename_models(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Display names of the models."""
    return df.replace(names, subset=["model"])
