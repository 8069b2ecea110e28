"""Evaluation of rankings: recall, accuracy, truth rank, rates by complexity, details, score distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.text import norm_name
from rankweave.operators.retrieval import QUERY
from rankweave.operators.vocabulary import NOTE_PAIRS


def cohorts(dataset: Column, main: str = "pubmed") -> Column:
    """Array of the cohorts a row belongs to: 'all' and either the main data set or its complement."""
    return F.array(F.lit("all"), F.when(F.lower(dataset) == main, main).otherwise(f"non_{main}"))


def _hit(predicted: str, truth: str) -> Column:
    return F.lower(predicted) == F.lower(truth)


def patient_hits(ranked: DataFrame, ks: Sequence[int], rank_col: str, predicted: str, truth: str) -> DataFrame:
    """Per (model, dataset, patient, k): 1 when the truth is among the first k.  One aggregate for all k.

    A patient whose ranking holds no row within k counts as present with 0.
    """
    best = F.min(F.when(_hit(predicted, truth), F.col(rank_col)))
    return (
        ranked.groupBy(*QUERY)
        .agg(best.alias("best"))
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
        .withColumn("hit", F.coalesce((F.col("best") <= F.col("k")).cast("int"), F.lit(0)))
    )


def recall_at_k(
    ranked: DataFrame,
    totals: DataFrame,
    ks: Sequence[int] = (1, 3, 5),
    rank_col: str = "rank",
    predicted: str = "disease",
    truth: str = "rare_disease_name",
) -> DataFrame:
    """Hits over a given number of patients per cohort (``totals``: cohort, total), rounded to 4.

    Every model has a row for every cohort of ``totals`` and every k; without a ranking there its hits are 0.
    """
    hits = _cohort_hits(patient_hits(ranked, ks, rank_col, predicted, truth)).drop("total")
    return hits.join(totals, "cohort").select(
        "model", "cohort", "k", "total", "hits", F.round(F.col("hits") / F.col("total"), 4).alias("recall")
    )


def _cohort_hits(hits: DataFrame, main: str = "pubmed") -> DataFrame:
    """(model, k, cohort, total, hits): all three cohorts for every model, also those without a patient, in one aggregate."""
    members = {"all": F.lit(True), main: F.lower("dataset") == main}
    members[f"non_{main}"] = ~F.coalesce(members[main], F.lit(False))
    counted = hits.groupBy("model", "k").agg(F.array(*[
        F.struct(F.lit(name).alias("cohort"), F.count_if(own).alias("total"), F.count_if(own & (F.col("hit") == 1)).alias("hits"))
        for name, own in members.items()]).alias("_c"))
    return counted.select("model", "k", F.inline("_c"))


def cohort_totals(patients: DataFrame) -> DataFrame:
    """Distinct patients per cohort."""
    rows = patients.select("dataset", "patient_id").distinct()
    return (
        rows.withColumn("cohort", F.explode(cohorts(F.col("dataset")))).groupBy("cohort").agg(F.count("*").alias("total"))
    )


def accuracy_at_k(
    ranked: DataFrame,
    ks: Sequence[int] = (1, 3, 5),
    rank_col: str = "final_rank",
    predicted: str = "disease",
    truth: str = "rare_disease_name",
) -> DataFrame:
    """The same hits over the ranked patients of the cohort; 0.0 for a cohort without any."""
    return (
        _cohort_hits(patient_hits(ranked, ks, rank_col, predicted, truth))
        .select("model", F.concat(F.lit("top"), F.col("k")).alias("topk"), F.col("cohort").alias("group"), "total", "hits")
        .withColumn("accuracy", F.coalesce(F.round(F.try_divide("hits", "total"), 4), F.lit(0.0)))
    )


def truth_rank(
    ranked: DataFrame,
    miss: int = 11,
    rank_col: str = "final_rank",
    predicted: str = "disease",
    truth: str = "rare_disease_name",
) -> DataFrame:
    """Smallest rank of the true disease per (model, dataset, patient), ``miss`` when absent."""
    best = F.min(F.when(_hit(predicted, truth), F.col(rank_col)))
    return ranked.groupBy(*QUERY).agg(F.coalesce(best, F.lit(miss)).alias("ground_truth_disease_rank"))


def mrr(truth_ranks: DataFrame, miss: int = 11) -> DataFrame:
    """Mean reciprocal rank per model; a miss counts 0."""
    rank = F.col("ground_truth_disease_rank")
    return truth_ranks.groupBy("model").agg(
        F.count("*").alias("patients"),
        F.round(F.avg(F.when(rank >= miss, 0.0).otherwise(1.0 / rank)), 6).alias("mrr"),
    )


def match_rate(
    ranked: DataFrame, patients: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), rank_col: str = "rank",
    predicted: str = "disease", truth: str = "rare_disease_name",
) -> DataFrame:
    """Distinct matched patients over all patients of the data set, per (dataset, model, k).

    Every model has a row for every data set of ``patients``, with 0 matched where it ranks nobody.
    """
    totals = patients.groupBy("dataset").agg(F.count_distinct("patient_id").alias("total_pts"))
    every = totals.agg(F.collect_list(F.struct("dataset", "total_pts"))).scalar()  # one entry per data set
    matched = (
        patient_hits(ranked, ks, rank_col, predicted, truth)
        .groupBy("dataset", "model", "k")
        .agg(F.sum("hit").alias("n"))
        .groupBy("model", "k")
        .agg(F.map_from_entries(F.collect_list(F.struct("dataset", "n"))).alias("_found"))
    )
    hit = F.coalesce(F.element_at("_found", F.col("dataset")), F.lit(0))
    return matched.withColumn("_every", every).select("model", "k", "_found", F.inline("_every")).select(
        "dataset", "model", "k", "total_pts", hit.alias("matched_pts"), F.round(hit / F.col("total_pts"), 4).alias("match_rate"),
    )


def pooled_match_rate(rates: DataFrame) -> DataFrame:
    """Sum of matched over sum of patients, per (model, k)."""
    return rates.groupBy("model", "k").agg(
        F.sum("matched_pts").alias("matched_pts"),
        F.sum("total_pts").alias("total_pts"),
        F.round(F.sum("matched_pts") / F.sum("total_pts"), 4).alias("match_rate"),
    )


def rate_by_complexity(
    ranked: DataFrame, ks: Sequence[int] = (1, 3, 5), rank_col: str = "rank", predicted: str = "disease",
    truth: str = "rare_disease_name",
) -> DataFrame:
    """Per (dataset, model, k, number of classes): patients, candidate diseases, matched patients and their rate.

    Each patient and each disease of a cell is brought to its best ranks first, so all k are counted at once and nothing
    is counted as distinct.
    """
    cell = ["dataset", "model", "num_true_classifications"]
    rank, hit_rank = F.col(rank_col), F.when(_hit(predicted, truth), F.col(rank_col))
    pairs = ranked.filter(rank <= max(ks)).groupBy(*cell, "patient_id", F.col(predicted).alias("_disease")).agg(
        F.min(rank).alias("first"), F.min(hit_rank).alias("first_hit"))
    one = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    each = pairs.withColumn("_of", F.explode(F.array(one("patient", "patient_id"), one("disease", "_disease"))))
    best = each.groupBy(*cell, F.col("_of.kind").alias("kind"), F.col("_of.name").alias("name")).agg(
        F.min("first").alias("first"), F.min("first_hit").alias("first_hit"))

    def counts(k: int) -> Column:
        within, named = F.col("first") <= k, F.col("name").isNotNull()
        patient = named & (F.col("kind") == "patient")
        return F.struct(
            F.lit(k).alias("k"), F.bool_or(within).alias("any"), F.count_if(patient & within).alias("total_pts"),
            F.count_if(named & (F.col("kind") == "disease") & within).alias("total_diseases"),
            F.count_if(patient & (F.col("first_hit") <= k)).alias("matched_pts"))

    cells = best.groupBy(*cell).agg(F.array(*[counts(k) for k in ks]).alias("_k")).select(*cell, F.inline("_k")).filter("any")
    return cells.select(
        "dataset", "model", "k", "num_true_classifications", "total_pts", "total_diseases", "matched_pts",
        F.round(F.try_divide("matched_pts", "total_pts"), 4).alias("match_rate"))


def recall_by_bucket(rates: DataFrame, max_bucket: int = 9) -> DataFrame:
    """Pooled recall per (model, k, bucket of classes); from ``max_bucket`` on one bucket such as '9+'."""
    n = F.col("num_true_classifications")
    bucket = F.when(n >= max_bucket, f"{max_bucket}+").otherwise(n.cast("string"))
    return rates.groupBy("model", "k", bucket.alias("classification_group")).agg(
        F.sum("matched_pts").alias("matched_sum"),
        F.sum("total_pts").alias("total_sum"),
        F.round(F.sum("matched_pts") / F.sum("total_pts"), 4).alias("recall"),
    )


def overall_recall(rates: DataFrame) -> DataFrame:
    """Average over all models and buckets per k: matched over all patients, the line beside the buckets."""
    return rates.groupBy("k").agg(
        F.sum("matched_pts").alias("matched_sum"),
        F.sum("total_pts").alias("total_sum"),
        F.round(F.try_divide(F.sum("matched_pts"), F.sum("total_pts")), 4).alias("overall_recall"),
    )


def eval_detail(fused: DataFrame, truth: DataFrame, rank_col: str = "final_rank", top: int = 10) -> DataFrame:
    """Per (model, dataset, patient): best matched rank and name, hits at 1/3/5, predictions, status, of the first ``top`` ranks.

    ``truth`` may hold several diseases per patient.  Names are compared by their normalised form.
    """
    names = (
        truth.groupBy("dataset", "patient_id")
        .agg(F.array_sort(F.collect_set("rare_disease_name")).alias("names"))
        .select(
            "dataset",
            "patient_id",
            F.array_join("names", " | ").alias("rare_disease_name"),
            F.transform("names", lambda n: norm_name(n)).alias("_norms"),
        )
    )
    rows = fused.filter(F.col(rank_col) <= top).join(names, ["dataset", "patient_id"], "left")
    hit = F.array_contains("_norms", norm_name(F.col("disease")))
    best = F.min(F.when(hit, F.struct(F.col(rank_col).alias("r"), F.col("disease").alias("d"))))
    per_patient = rows.groupBy(*QUERY).agg(
        F.max("rare_disease_name").alias("rare_disease_name"),
        best.alias("best"),
        F.count("*").cast("int").alias("n_predictions"),
        F.sort_array(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col("disease").alias("d")))).alias("list"),
    )
    known = F.col("rare_disease_name").isNotNull()
    rank = F.col("best.r")
    flag = lambda k: F.when(known, F.coalesce((rank <= k).cast("int"), F.lit(0)))
    return per_patient.select(
        *QUERY,
        "rare_disease_name",
        rank.alias("matched_rank"),
        F.col("best.d").alias("matched_predicted_disease"),
        flag(1).alias("hit_top1"),
        flag(3).alias("hit_top3"),
        flag(5).alias("hit_top5"),
        "n_predictions",
        F.array_join(F.transform("list", lambda x: x["d"]), " | ").alias("top10_predicted_diseases"),
        F.when(~known, "no_truth_record").when(rank.isNull(), "not_found_in_top10").otherwise("matched").alias("status"),
    )


def eval_summary(detail: DataFrame) -> DataFrame:
    """Means over the patients with truth, per model."""
    with_truth = F.count_if(F.col("status") != "no_truth_record")
    aggs = [F.sum(f"hit_top{k}").alias(f"top{k}_hits") for k in (1, 3, 5)]
    aggs += [F.round(F.avg(f"hit_top{k}"), 6).alias(f"recall_at_{k}") for k in (1, 3, 5)]
    return detail.groupBy("model").agg(
        F.count("*").alias("n_output_patients"),
        with_truth.alias("n_evaluable_with_truth"),
        F.count_if(F.col("status") == "no_truth_record").alias("n_no_truth_record"),
        *aggs,
    )


def top1_by_score(
    predictions: DataFrame, truth: DataFrame, note_pairs: Sequence[tuple[str, str]] = NOTE_PAIRS
) -> DataFrame:
    """Best prediction per (person, true disease): score desc, note date desc, row index asc, with a hit flag.

    ``truth`` rows are kept when their (type, title) pair is listed, one per (person, row, disease).  The best row is
    an aggregate over a struct, so a person with very many notes is combined before the shuffle.
    """
    wanted = [F.struct(F.lit(t), F.lit(h)) for t, h in note_pairs]
    notes = (
        truth.filter(F.struct("note_type_name", "note_title").isin(wanted))
        .groupBy("person_id", "row_index", F.col("disease_name").alias("true_disease_name"))
        .agg(F.max(F.struct("note_date", "note_type_name", "note_title")).alias("n"))
        .select("person_id", "row_index", "true_disease_name", "n.*")
    )
    scored = predictions.select(
        F.col("patient_id").alias("person_id"), "row_index", "disease", "match_score"
    ).join(notes, ["person_id", "row_index"])
    hit = _hit("disease", "true_disease_name")
    order = F.struct("match_score", "note_date", -F.col("row_index"), F.col("disease"))
    row = F.struct("row_index", "disease", "match_score", "note_date", "note_type_name", "note_title", hit.alias("is_hit"))
    return (
        scored.groupBy("person_id", "true_disease_name")
        .agg(F.max_by(row, order).alias("b"))
        .select("person_id", "true_disease_name", "b.*")
    )


def top1_counts(best: DataFrame) -> DataFrame:
    """Rows and hits per note type."""
    return best.groupBy("note_type_name").agg(F.count("*").alias("total"), F.count_if("is_hit").alias("hits"))


def score_histogram(scores: DataFrame, width: float = 0.1) -> DataFrame:
    """Rows per (is_hit, bin), bin = lower edge of the score's interval."""
    steps = round(1 / width)
    return scores.groupBy("is_hit", (F.floor(F.col("match_score") * steps) / steps).alias("score_bin")).agg(
        F.count("*").alias("n")
    )


def histogram_table(histogram: DataFrame, bins: Sequence[float]) -> DataFrame:
    """Bins as columns (named like 'bin_0.1'), missing = 0."""
    named = histogram.withColumn("bin", F.concat(F.lit("bin_"), F.round("score_bin", 3).cast("string")))
    return named.groupBy("is_hit").pivot("bin", [f"bin_{b}" for b in bins]).agg(F.sum("n")).na.fill(0)


def score_stats(scores: DataFrame) -> DataFrame:
    """Count, mean, sample deviation and median of the score per hit flag."""
    return scores.groupBy("is_hit").agg(
        F.count("*").alias("n"),
        F.round(F.avg("match_score"), 9).alias("mean_score"),
        F.round(F.stddev("match_score"), 9).alias("std_score"),
        F.percentile_approx("match_score", 0.5, 10000).alias("median_score"),
    )


def hit_share_by_disease(best: DataFrame, disease: str = "true_disease_name", person: str = "person_id") -> DataFrame:
    """Persons per disease with hit and miss, shares of the disease total; 0 where absent."""
    counted = best.groupBy(disease).agg(
        F.count_distinct(F.when(F.col("is_hit"), F.col(person))).alias("hit_count"),
        F.count_distinct(F.when(~F.col("is_hit"), F.col(person))).alias("miss_count"),
    )
    total = F.col("hit_count") + F.col("miss_count")
    return counted.select(
        disease,
        "hit_count",
        "miss_count",
        F.round(F.col("hit_count") / total, 4).alias("hit_share"),
        F.round(F.col("miss_count") / total, 4).alias("miss_share"),
        total.alias("total"),
    )


def overlap_scores(a: DataFrame, b: DataFrame, keys: Sequence[str], by: str = "source") -> DataFrame:
    """Rows hit by both scorers: count, mean, deviation and exact median of each score, per source.

    Scores are taken at 4 digits, so the exact median's buffer holds at most 10001 distinct values per source.
    """
    keys = list(keys)
    left = a.filter("is_hit").select(by, *keys, F.round("match_score", 4).alias("score_a"))
    right = b.filter("is_hit").select(by, *keys, F.round("match_score", 4).alias("score_b"))
    aggs = [F.count("*").alias("n")]
    for s in ("score_a", "score_b"):
        aggs += [
            F.round(F.avg(s), 9).alias(f"mean_{s}"),
            F.round(F.stddev(s), 9).alias(f"std_{s}"),
            F.round(F.percentile(s, 0.5), 9).alias(f"median_{s}"),
        ]
    return left.join(right, [by, *keys]).groupBy(by).agg(*aggs)


def relation_distribution(rows: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """Relation labels with synonyms merged: count and percent of all rows.

    The total is a window over the aggregated labels only.
    """
    label = F.col("relation_type")
    merged = label
    for name, same in synonyms.items():
        merged = F.when(label.isin(list(same)), name).otherwise(merged)
    counts = rows.groupBy(merged.alias("relation_type")).agg(F.count("*").alias("case_count"))
    share = F.col("case_count") * 100.0 / F.sum("case_count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percentage", F.round(share, 6))


def relation_pairs(rows: DataFrame, relation: str) -> DataFrame:
    """Distinct disease pairs of one relation."""
    return rows.filter(F.col("relation_type") == relation).select("disease_1", "disease_2").distinct()


def metric_slice(metrics: DataFrame, cohort: str = "all", topk: Sequence[str] = ("top1", "top3", "top5")) -> DataFrame:
    """Rows of one cohort and the listed k, ordered by k and model."""
    return metrics.filter((F.col("group") == cohort) & F.col("topk").isin(list(topk))).orderBy("topk", "model")
