"""Sparse and dense retrieval: BM25 and TF-IDF indexes, BM25 matching, cosine ranking, top-k slices."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.blocks import cell_top_k
from rankweave.functions.text import split_trim

# Scores are rounded to this many digits before they are ranked, so that ties do not depend on summation order.
SCORE_DIGITS = 6


Store = Callable[[DataFrame], DataFrame]  # stores a table and returns what was stored
SENT = 500_000  # concepts of queries that are sent to the postings; more of them meet the postings by a shuffle


def _variants(mentions: DataFrame, spelled: Sequence[str] = ("UMLS_name", "semantic_type_name")) -> DataFrame:
    """Mentions counted per (model, disease, CUI) and ``spelled`` (name and type), combined map-side.

    This is the only pass over the mentions: all branches below read this one shuffle, which Spark finds equal in them
    as long as each of them reads ``n``.
    """
    keys = ["model", "disease", "CUI"]
    known = F.col("model").isNotNull() & F.col("disease").isNotNull() & F.col("CUI").isNotNull()
    return mentions.filter(known).groupBy(*keys, *spelled).agg(F.count("*").alias("n"))


def _term_table(variants: DataFrame) -> DataFrame:
    """tf per (model, disease, CUI), clustered by disease: a disease has at most one row per concept."""
    return variants.repartition("model", "disease").groupBy("model", "disease", "CUI").agg(F.sum("n").alias("tf"))


def _lengths(terms: DataFrame) -> DataFrame:
    return terms.groupBy("model", "disease").agg(F.sum("tf").alias("doc_len"))


def _concepts(variants: DataFrame, terms: DataFrame) -> DataFrame:
    """df, and one display name and type (the smallest of each that the variants have), per (model, CUI)."""
    df = terms.groupBy("model", "CUI").agg(F.count("tf").alias("df"))  # reads tf, like the other branches
    # the different spellings first, by hashing and map-side: string minima over all rows would sort them
    spelled = [c for c in variants.columns if c not in ("model", "disease", "CUI", "n")]
    spellings = variants.filter("n > 0").select("model", "CUI", *spelled).distinct()
    names = spellings.groupBy("model", "CUI").agg(*[F.min(c).alias(c) for c in spelled])
    return looked_up(df, names, ["model", "CUI"])


def term_table(mentions: DataFrame, spelled: Sequence[str] = ("UMLS_name", "semantic_type_name"), lengths: bool = False) -> DataFrame:
    """tf and the smallest of each of ``spelled`` per (model, disease, CUI); with ``lengths`` also doc_len, by the same sort.

    Mentions that are dealt by (model, disease) are not moved for it.  String minima sort their rows: the hash in front decides
    most comparisons without reading the keys, and leaves the terms disease by disease, which the next shuffle packs well.
    """
    keys = ["model", "disease", "CUI"]
    known = F.col("model").isNotNull() & F.col("disease").isNotNull() & F.col("CUI").isNotNull()
    smallest = [F.min(c).alias(c) for c in spelled]
    terms = mentions.filter(known).groupBy(F.xxhash64("model", "disease").alias("_doc"), *keys).agg(F.count(F.lit(1)).alias("tf"), *smallest)
    if lengths:
        terms = terms.withColumn("doc_len", F.sum("tf").over(Window.partitionBy("_doc", "model", "disease")))
    return terms.drop("_doc")


def concept_table(terms: DataFrame, spelled: Sequence[str] = ("UMLS_name", "semantic_type_name")) -> DataFrame:
    """df, and one name and type (the smallest of each), per (model, CUI) of a :func:`term_table`; combined map-side.

    A hash in front decides almost every comparison of the sort that string minima need.
    """
    counts = [F.count(F.lit(1)).alias("df"), *[F.min(c).alias(c) for c in spelled]]
    return terms.groupBy(F.xxhash64("model", "CUI").alias("_concept"), "model", "CUI").agg(*counts).drop("_concept")


def looked_up(terms: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Each term with its one row of ``small``, which is hashed by partition, so that the many terms are not sorted."""
    return terms.join(small.hint("shuffle_hash"), keys)


def bm25_index(mentions: DataFrame, k1: float = 1.5, b: float = 0.75, store: Store | None = None) -> DataFrame:
    """BM25 weight of every (model, disease, CUI).

    ``idf = ln((N + 1) / (df + 0.5))``, ``bm25 = idf * tf*(k1+1) / (tf + k1*(1 - b + b*doc_len/avg_doc_len))`` with
    N and avg_doc_len per model.  Document length, df and the model totals are aggregates of one term table, joined
    by key.  One name per concept: the smallest within the model.

    With ``store`` (such as :func:`rankweave.session.stage`) the term table is stored when the plan is built: the mentions are
    read once, and of the terms only what the caller reads is moved, once, to the concepts.
    """
    if store:
        terms = store(term_table(mentions, lengths=True))
        lengths = terms.select("model", "disease", "doc_len").distinct()
        with_lengths, concepts = terms.select("model", "disease", "CUI", "tf", "doc_len"), concept_table(terms)
    else:
        variants = _variants(mentions)
        terms = _term_table(variants)
        lengths = _lengths(terms)
        with_lengths, concepts = looked_up(terms, lengths, ["model", "disease"]), _concepts(variants, terms)
    totals = lengths.groupBy("model").agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_doc_len"))
    joined = looked_up(with_lengths, concepts, ["model", "CUI"]).join(F.broadcast(totals), "model")  # one row per model
    return weighted(joined, k1, b)


def weighted(joined: DataFrame, k1: float, b: float) -> DataFrame:
    """The index columns from tf, df, doc_len, n_docs and avg_doc_len."""
    idf = F.log((F.col("n_docs") + 1) / (F.col("df") + 0.5))
    tf = F.col("tf")
    norm = tf + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_doc_len"))
    return joined.select(
        "model",
        "disease",
        "semantic_type_name",
        "CUI",
        "UMLS_name",
        "tf",
        "df",
        idf.alias("idf"),
        (idf * tf * (k1 + 1) / norm).alias("bm25"),
    )


def tfidf(mentions: DataFrame, store: Store | None = None) -> DataFrame:
    """``tf * ln(N / df)`` per (model, disease, CUI), N = diseases of the model; ``store`` as for :func:`bm25_index`."""
    spelled = ["UMLS_name"]
    if store:
        terms = store(term_table(mentions, spelled))
        totals = terms.select("model", "disease").distinct().groupBy("model").agg(F.count("*").alias("n_docs"))
        terms, concepts = terms.select("model", "disease", "CUI", "tf"), concept_table(terms, spelled)
    else:
        variants = _variants(mentions, spelled)
        terms = _term_table(variants)
        totals = _lengths(terms).groupBy("model").agg(F.count("doc_len").alias("n_docs"))  # reads n, like the other branches
        concepts = _concepts(variants, terms)
    return (
        looked_up(terms, concepts, ["model", "CUI"])
        .join(F.broadcast(totals), "model")
        .select(
            "model", "disease", "CUI", "UMLS_name", (F.col("tf") * F.log(F.col("n_docs") / F.col("df"))).alias("tfidf")
        )
    )


def query_concepts(patients: DataFrame, list_col: str = "phenotype_umls_cuis", sep: str = ",") -> DataFrame:
    """Distinct (dataset, patient_id, CUI) of the comma list."""
    return (
        patients.select("dataset", "patient_id", F.explode(split_trim(F.col(list_col), sep)).alias("CUI"))
        .filter(F.col("CUI") != "")
        .distinct()
    )


QUERY = ["model", "dataset", "patient_id"]


def asked_postings(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """The postings of concepts that some query has.  A small job counts these concepts: few are sent to the postings, which
    then do not move."""
    asked = queries.select("CUI").distinct()
    few = asked.limit(SENT + 1).count() <= SENT
    return postings.join(F.broadcast(asked) if few else asked, "CUI", "left_semi")


def _rank_order(score: Column | None = None) -> list[Column]:
    return [(score if score is not None else F.col("bm25_sum")).desc(), F.col("shared_cui_count").desc(), F.col("disease").asc()]


def bm25_match(
    queries: DataFrame,
    index: DataFrame,
    k: int = 10,
    seed_rows: int = 200,
) -> DataFrame:
    """Top ``k`` diseases per (model, dataset, patient) by ``bm25_sum desc, shared_cui_count desc, disease``.

    ``queries``: dataset, patient_id, CUI (see :func:`query_concepts`); ``index``: a :func:`bm25_index`, which is read once.

    A frequent concept sits in a large share of the diseases, so joining it pairs nearly every patient with nearly
    every disease.  The exact top k is found without these pairs:

    1. each query's terms are ordered by their largest weight; the strongest terms covering ``seed_rows`` index
       rows are scored, and the k-th best partial score is a lower bound for the final k-th score;
    2. the weakest terms whose weights cannot add up to that bound cannot bring in a disease on their own; only
       the other terms are joined to find candidates;
    3. candidates that cannot reach the bound even with all weak terms are dropped, the rest get the weak terms'
       weights by an equi join on (model, disease, CUI).

    A query without a usable bound (fewer than k scored diseases) keeps all its terms in step 2, so results never
    depend on the pruning.  The bound needs positive weights, which this idf gives for every df <= N.
    """
    # only the postings of concepts that some query has matter; they are kept, since several branches read them
    postings = asked_postings(index.select("model", "disease", "CUI", "bm25"), queries).persist(StorageLevel.MEMORY_AND_DISK)
    stats = postings.groupBy("model", "CUI").agg(F.count("*").alias("rows"), F.max("bm25").alias("best"))
    # the query terms with their statistics, and with the bound below, are small and read by several branches
    terms = queries.join(stats, "CUI").persist(StorageLevel.MEMORY_AND_DISK)

    # 1. lower bound from the strongest terms
    strongest = Window.partitionBy(*QUERY).orderBy(F.col("best").desc(), "CUI")
    before = strongest.rowsBetween(Window.unboundedPreceding, -1)
    onwards = strongest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ordered = terms.withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn(
        "tail", F.sum("best").over(onwards)
    )
    seeds = ordered.filter(F.col("rows_before") < seed_rows).select(*QUERY, "CUI")
    partial = seeds.join(postings, ["model", "CUI"]).groupBy(*QUERY, "disease").agg(F.sum("bm25").alias("partial"))
    kth = F.row_number().over(Window.partitionBy(*QUERY).orderBy(F.col("partial").desc(), "disease"))
    bound = (
        partial.withColumn("n", kth)
        .filter(F.col("n") <= k)
        .groupBy(*QUERY)
        .agg(F.when(F.count("*") >= k, F.min("partial")).alias("bound"))
    )

    # 2. strong terms find the candidates (the margin covers rounding)
    margin = 10.0 ** (1 - SCORE_DIGITS)
    is_strong = F.col("bound").isNull() | (F.col("tail") >= F.col("bound") - margin)
    planned = ordered.join(bound, QUERY, "left").withColumn("strong", is_strong).persist(StorageLevel.MEMORY_AND_DISK)
    strong = planned.filter("strong").select(*QUERY, "CUI", "bound")
    weak = planned.filter(~F.col("strong"))
    weak_best = weak.groupBy(*QUERY).agg(F.sum("best").alias("weak_best"))
    found = (
        strong.join(postings, ["model", "CUI"])
        .groupBy(*QUERY, "disease")
        .agg(
            F.sum("bm25").alias("strong_score"),
            F.count("*").alias("strong_count"),
            F.max("bound").alias("bound"),
        )
    )

    # 3. drop hopeless candidates, complete the others
    reachable = F.col("strong_score") + F.coalesce("weak_best", F.lit(0.0)) >= F.col("bound") - margin
    kept = found.join(weak_best, QUERY, "left").filter(F.col("bound").isNull() | reachable)
    scored = (
        kept.select(*QUERY, "disease", "strong_score", "strong_count").join(weak.select(*QUERY, "CUI"), QUERY, "left")
        .join(postings, ["model", "disease", "CUI"], "left")
        .groupBy(*QUERY, "disease", "strong_score", "strong_count")
        .agg(F.coalesce(F.sum("bm25"), F.lit(0.0)).alias("weak_score"), F.count("bm25").alias("weak_count"))
        .select(
            *QUERY,
            "disease",
            F.round(F.col("strong_score") + F.col("weak_score"), SCORE_DIGITS).alias("bm25_sum"),
            (F.col("strong_count") + F.col("weak_count")).alias("shared_cui_count"),
        )
    )
    return _top_k(scored, k)


def _top_k(scored: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy(*QUERY).orderBy(*_rank_order())
    return (
        scored.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .select(*QUERY, "disease", "shared_cui_count", "bm25_sum", "rank")
    )


def matched_concepts(ranked: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """Ranked rows with the sorted matched concepts and names as ' | ' lists (bounded by the query's concepts)."""
    hits = (
        ranked.select(*QUERY, "disease")
        .join(queries, ["dataset", "patient_id"])
        .join(index.select("model", "disease", "CUI", "UMLS_name"), ["model", "disease", "CUI"])
        .groupBy(*QUERY, "disease")
        .agg(
            F.array_join(F.array_sort(F.collect_set("CUI")), " | ").alias("matched_cuis"),
            F.array_join(F.array_sort(F.collect_set("UMLS_name")), " | ").alias("matched_names"),
        )
    )
    return ranked.join(hits, [*QUERY, "disease"], "left")


def attach_categories(ranked: DataFrame, categories: DataFrame, name_col: str = "disease") -> DataFrame:
    """Left join of the disease category rows on the lower-case trimmed name."""
    rows = categories.groupBy(F.lower(F.trim("rare_disease_name")).alias("_name")).agg(
        F.max("num_true_classifications").alias("num_true_classifications"),
        F.max("final_classification_string").alias("final_classification_string"),
    )
    return ranked.withColumn("_name", F.lower(F.trim(name_col))).join(rows, "_name", "left").drop("_name")


def dense_rank(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    min_score: float | None = None,
    query_bucket: int = 4096,
    candidate_bucket: int = 2048,
) -> DataFrame:
    """The first ``k`` candidates per query by cosine (rounded to 4) descending, ties by candidate.

    ``queries``: model, dataset, patient_id, vector; ``candidates``: model, disease, vector.  A null vector (empty
    text) yields no rows; a non-finite value fails the job.
    """
    left = queries.filter(F.col("vector").isNotNull()).select(*QUERY, "vector")
    right = candidates.filter(F.col("vector").isNotNull()).select(
        "model", F.col("disease").alias("candidate"), "vector"
    )
    scored = cell_top_k(left, right, QUERY, ["model"], k, query_bucket, candidate_bucket)
    if min_score is not None:
        scored = scored.filter(F.col("score") > min_score)
    window = Window.partitionBy(*QUERY).orderBy(F.col("score").desc(), "candidate")
    ranked = scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("candidate", "disease")


def topk_slices(ranked: DataFrame, ks: Sequence[int] = (1, 3, 5), rank_col: str = "rank") -> DataFrame:
    """Rows with rank <= k for each k, with k as a column; one pass."""
    return ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col(rank_col) <= F.col("k"))
