"""Fusion, consensus gating, reranking and the nested rerank input."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import norm_name
from rankweave.operators.concepts import SECTION_COLUMNS
from rankweave.operators.retrieval import QUERY


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (model, dataset, patient_id, disease, rank).

    ``score = 1/(k + dense_rank) + 1/(k + sparse_rank)``, a missing side counts 0.  Order: score descending, rows
    with a dense rank first, dense rank, sparse rank (nulls last), name.  The display name is the dense one.
    The full outer join is one union and one aggregate, keyed by patient and normalised disease name; a name that
    occurs twice in a list counts with its best rank.
    """
    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.select(
            *QUERY,
            F.lower(F.trim("disease")).alias("disease_norm"),
            F.col("rank").alias(own),
            F.lit(None).cast("int").alias(other),
            F.struct(F.lit(0 if own == "dense_rank" else 1).alias("o"), "rank", F.col("disease").alias("d")).alias("name"),
        )

    merged = (
        side(dense, "dense_rank", "sparse_rank")
        .unionByName(side(sparse, "sparse_rank", "dense_rank"))
        .groupBy(*QUERY, "disease_norm")
        .agg(
            F.min("dense_rank").alias("dense_rank"),
            F.min("sparse_rank").alias("sparse_rank"),
            F.min("name").alias("name"),
        )
    )
    part = lambda c: F.coalesce(1.0 / (F.col(c) + k), F.lit(0.0))
    order = Window.partitionBy(*QUERY).orderBy(
        F.col("rrf_score").desc(),
        F.col("dense_rank").isNull().cast("int"),
        F.col("dense_rank").asc_nulls_last(),
        F.col("sparse_rank").asc_nulls_last(),
        "disease_norm",
    )
    fused = (
        merged.withColumn("rrf_score", F.round(part("dense_rank") + part("sparse_rank"), 12))
        .withColumn("final_rank", F.row_number().over(order))
        .select(
            *QUERY, "disease_norm", F.col("name.d").alias("disease"), "dense_rank", "sparse_rank", "rrf_score", "final_rank"
        )
    )
    return fused if top is None else fused.filter(F.col("final_rank") <= top)


def attach_truth(fused: DataFrame, truth: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Adds rare_disease_name of the patient and, when given, its category columns."""
    out = fused.join(truth.select("dataset", "patient_id", "rare_disease_name").distinct(), ["dataset", "patient_id"], "left")
    if categories is None:
        return out
    from rankweave.operators.retrieval import attach_categories

    return attach_categories(out, categories, "rare_disease_name")


def consensus_gate(rankings: DataFrame, priority: Sequence[str]) -> DataFrame:
    """Per (dataset, patient) the rows of the model whose ranking agrees most with the other models' rankings.

    Agreement is the sum of Spearman correlations with every other model over the union of candidates; a candidate a
    model does not list comes after all: one more than the larger of the union's size and the model's last rank.  An undefined correlation counts 0, ties go to the model first in
    ``priority``.

    Spearman is the mean product of standardised average ranks, so the sum over the other models is a product with
    the candidate's total over all models minus the own value: no pair of models is ever joined.
    """
    patient = ["dataset", "patient_id"]
    rows = rankings.withColumn("cand", F.lower(F.trim("disease")))
    listed = rows.groupBy(*patient, "model", "cand").agg(F.min("rank").alias("rank"))
    last = listed.groupBy(*patient, "model").agg(F.max("rank").alias("last_rank"))
    universe = listed.select(*patient, "cand").distinct()
    full = (
        universe.join(last, patient)
        .join(listed, [*patient, "model", "cand"], "left")
        .withColumn("n_cands", F.count("*").over(Window.partitionBy(*patient, "model")))
        .withColumn("r", F.coalesce("rank", F.greatest("n_cands", "last_rank") + 1))
    )
    per_model = Window.partitionBy(*patient, "model")
    ties = F.count("*").over(Window.partitionBy(*patient, "model", "r"))
    average = F.rank().over(per_model.orderBy("r")) + (ties - 1) / 2.0
    spread = F.col("sd")
    standard = (
        full.withColumn("ar", average)
        .withColumn("sd", F.stddev_pop("ar").over(per_model))
        .withColumn("mean", F.avg("ar").over(per_model))
        .withColumn("z", F.when(spread > 1e-12, (F.col("ar") - F.col("mean")) / spread).otherwise(0.0))
    )
    total = F.sum("z").over(Window.partitionBy(*patient, "cand"))
    scores = (
        standard.withColumn("others", total - F.col("z"))
        .groupBy(*patient, "model")
        .agg(F.round(F.sum(F.col("z") * F.col("others")) / F.count("*"), 9).alias("consensus"))
    )
    names = F.array(*[F.lit(m) for m in priority])
    place = F.array_position(names, F.col("model"))
    place = F.when(place == 0, F.lit(len(priority) + 1)).otherwise(place)
    # largest consensus, then first in the priority list, then name: one aggregate, no window
    best = scores.groupBy(*patient).agg(
        F.max_by(F.struct("model", "consensus"), F.struct(F.col("consensus"), -place)).alias("w")
    )
    picked = best.select(*patient, F.col("w.model").alias("model"), F.col("w.consensus").alias("consensus"))
    return rows.join(picked, [*patient, "model"]).select(
        *patient, "rank", "disease", F.col("model").alias("gated_model"), "consensus"
    )


def gate_counts(gated: DataFrame) -> DataFrame:
    """Patients per picked model."""
    return gated.select("dataset", "patient_id", "gated_model").distinct().groupBy("gated_model").count()


def yes_probability(no_logit: Column, yes_logit: Column) -> Column:
    """Softmax probability of 'yes' over the two logits."""
    return 1.0 / (1.0 + F.exp(no_logit - yes_logit))


def rerank(
    pairs: DataFrame,
    scorer: Column | Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    k: int | None = None,
    schema: str | None = None,
) -> DataFrame:
    """New position per query by a score rounded to 4, descending; ties keep the former rank, then the name.

    ``pairs``: model, dataset, patient_id, disease, rank (+ what the scorer needs).  ``scorer`` is a column
    expression (for logits: :func:`yes_probability`) or a ``mapInPandas`` function that adds ``score``; the latter
    needs its output ``schema``.
    """
    scored = pairs.mapInPandas(scorer, schema) if callable(scorer) else pairs.withColumn("score", scorer)
    scored = scored.withColumn("score", F.round("score", 4))
    window = Window.partitionBy(*QUERY).orderBy(F.col("score").desc(), "rank", "disease")
    out = scored.withColumn("rerank_position", F.row_number().over(window))
    out = out if k is None else out.filter(F.col("rerank_position") <= k)
    return out.withColumnRenamed("rank", "original_rank")


def rerank_input(
    fused: DataFrame, sections: DataFrame, cases: DataFrame, k: int = 10, columns: Sequence[str] = SECTION_COLUMNS
) -> DataFrame:
    """One nested record per (model, dataset, patient): case text and the ordered array of its top ``k`` candidates.

    Candidates carry the four sections of the knowledge row with the same normalised name (empty strings when there
    is none) and ``knowledge_found``.  The collected array holds at most ``k`` entries.
    """
    known = sections.groupBy(norm_name(F.col("disease_name")).alias("_key")).agg(
        *[F.max(c).alias(c) for c in columns], F.lit(1).alias("knowledge_found")
    )
    top = fused.filter(F.col("final_rank") <= k).withColumn("_key", norm_name(F.col("disease")))
    filled = top.join(known, "_key", "left").select(
        *QUERY,
        F.struct(
            F.col("final_rank").alias("rank"),
            F.col("disease"),
            *[F.coalesce(c, F.lit("")).alias(c) for c in columns],
            F.coalesce("knowledge_found", F.lit(0)).alias("knowledge_found"),
        ).alias("d"),
    )
    nested = filled.groupBy(*QUERY).agg(F.sort_array(F.collect_list("d")).alias("diseases"))
    text = F.coalesce("case_data", F.lit(""))
    return nested.join(cases.select("dataset", "patient_id", "case_data"), ["dataset", "patient_id"], "left").select(
        *QUERY, text.alias("case_data"), "diseases"
    )


def rerank_input_stats(records: DataFrame, columns: Sequence[str] = SECTION_COLUMNS) -> DataFrame:
    """Per record: case text, candidates, knowledge rows found and missing, candidates with any section text."""
    def filled(d: Column) -> Column:
        return reduce(lambda a, b: a | b, [F.trim(d[c]) != "" for c in columns])

    n = F.size("diseases")
    found = F.size(F.filter("diseases", lambda d: d["knowledge_found"] == 1))
    return records.select(
        *QUERY,
        (F.trim("case_data") != "").cast("int").alias("has_case_data"),
        F.length("case_data").alias("case_data_length"),
        n.alias("n_top_diseases"),
        found.alias("n_knowledge_found"),
        (n - found).alias("n_knowledge_missing"),
        F.size(F.filter("diseases", filled)).alias("n_diseases_with_nonempty_sections"),
    )


def combine(frames: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """Union by name; missing columns become null; fixed order when ``columns`` is given."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*columns) if columns else out


def override(df: DataFrame, overrides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Named columns replaced for given keys by the non-null values of an override table (one row per key)."""
    keys = list(keys)
    changed = [c for c in overrides.columns if c not in keys]
    new = overrides.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in changed])
    out = df.join(new, keys, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in df.columns])
