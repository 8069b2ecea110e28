"""Every operator as a query over the driver tables, each with its DuckDB counterpart where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.spans import distinct_runs
from rankweave.functions.text import clean_markdown, first_nonempty, norm_id, norm_name, remove_links
from rankweave.operators import citations as cite
from rankweave.operators import cohort, concepts, context, evaluation, fusion, linking, outcomes, postings, quantiles, readability, retrieval, telemetry, weekly
from rankweave.operators.vocabulary import BLOCKED_NAMES, SYMPTOM_TYPES, TARGET_TYPES, TERMINOLOGIES
from rankweave.plans import bindings as b
from rankweave.plans.ctes import COHORT, N_TYPES, NOT_NEGATED, Q, TITLE_LIST, TYPE_LIST, quoted, sql
from rankweave.session import remember_staged, stage, staging_dir
from rankweave.sources import readers, tables
from rankweave.sources.schema import standardize
from rankweave.streaming import index_upkeep
from rankweave.streaming.files import append_files
from rankweave.streaming.incremental import append_new as append_rows
from rankweave.streaming.incremental import new_rows

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    unit: str
    plan: Plan
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(unit: str, body: str | None = None) -> Callable[[Plan], Plan]:
    """Registers a plan under its function name; ``unit`` is its id in the operator inventory."""

    def register(plan: Plan) -> Plan:
        REGISTRY[plan.__name__] = Query(unit, plan, sql(body) if body else None)
        return plan

    return register


# ---------------------------------------------------------------- concepts


def _kept(spark: SparkSession, sf: str, clustered: bool = False) -> DataFrame:
    return concepts.concept_filter(b.mentions(spark, sf, clustered))


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return concepts.grouped_concepts(b.mentions(spark, sf))


@query("K1", "SELECT model, disease, chunk_index, UMLS_name, CUI, similarity, semantic_type_name FROM kept")
def concept_filter(spark, sf):
    return _kept(spark, sf)


EXTRA_BLOCKED = ("with", "avec", "para", "nicht")


@query(
    "K2",
    f"""SELECT model, semantic_type_name, count(DISTINCT UMLS_name) AS total FROM mentions
    WHERE semantic_type_name IN ({quoted(SYMPTOM_TYPES)}) AND similarity >= 0.85
    AND UMLS_name NOT IN ({quoted((*BLOCKED_NAMES, *EXTRA_BLOCKED))}) GROUP BY ALL""",
)
def blocklist_filter(spark, sf):
    kept = concepts.blocklist_filter(b.mentions(spark, sf), min_sim=0.85, blocked_names=(*BLOCKED_NAMES, *EXTRA_BLOCKED))
    return concepts.names_per_type(kept)


@query("K3", "SELECT model, CUI, person_id, count(*) AS n FROM context GROUP BY ALL")
def context_filter(spark, sf):
    kept = concepts.context_filter(b.notes(spark, sf), b.model_concepts(spark, sf))
    return kept.groupBy("model", "CUI", "person_id").agg(F.count("*").alias("n"))


def _flagged(spark, sf):
    return context.context_flags(concepts.tag_concepts(b.docs(spark, sf, clustered=True), b.dictionary(spark, sf), longest=2), b.TEXT_RULES)


@query("K3", "SELECT model, disease, CUI, start_char, end_char, context_flag FROM ctx_flagged")
def context_flags(spark, sf):
    return _flagged(spark, sf).select("model", "disease", "CUI", "start_char", "end_char", "context_flag")


@query(
    "K3",
    """SELECT c.model, CUI, count(*) AS mentions, count(DISTINCT disease) AS diseases FROM ctx_flagged f
    JOIN (SELECT DISTINCT 'w' || length(term) AS model, 'C_' || term AS CUI FROM terms WHERE NOT contains(term, ' ')) c USING (CUI)
    WHERE NOT regexp_matches(context_flag, 'FAMILY|NEGATED_EXISTENCE|HISTORICAL|HYPOTHETICAL') GROUP BY c.model, CUI""",
)
def flagged_context_filter(spark, sf):
    """The context filter acts on the flags found; the concept sets are the dictionary's words by length."""
    sets = b.dictionary(spark, sf).filter(~F.col("term").contains(" ")).select(F.concat(F.lit("w"), F.length("term")).alias("model"), "CUI")
    kept = concepts.context_filter(_flagged(spark, sf).drop("model"), sets)
    return kept.groupBy("model", "CUI").agg(F.count("*").alias("mentions"), F.count_distinct("disease").alias("diseases"))


@query(
    "K4",
    """SELECT group_name, model, count(DISTINCT CUI) AS distinct_cuis, count(DISTINCT disease) AS distinct_diseases
    FROM grouped GROUP BY ALL""",
)
def semantic_group_coverage(spark, sf):
    return concepts.semantic_group_coverage(_grouped(spark, sf))


@query(
    "K5",
    "SELECT semantic_type, " + ", ".join(
        f"count(DISTINCT CASE WHEN model = '{m}' THEN CUI END) AS {m}" for m in b.LANGS) + " FROM typed GROUP BY ALL",
)
def type_matrix(spark, sf):
    return concepts.type_matrix(b.mentions(spark, sf), b.LANGS)


@query(
    "K6",
    """SELECT model, group_name, count(*) AS n_diseases, round(avg(n), 6) AS mean_cuis, round(stddev(n), 6) AS std_cuis
    FROM (SELECT model, group_name, disease, count(DISTINCT CUI) AS n FROM grouped GROUP BY ALL) GROUP BY ALL""",
)
def concepts_per_disease(spark, sf):
    return concepts.concepts_per_disease(_grouped(spark, sf))


def _jaccard(spark, sf):
    return concepts.pairwise_jaccard(_grouped(spark, sf), "model", "CUI", "group_name")


@query("K7", "SELECT group_name, set_1, set_2, shared, round(jaccard, 6) AS jaccard FROM jac")
def pairwise_jaccard(spark, sf):
    return _jaccard(spark, sf).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "K7",
    """SELECT group_name, round(avg(jaccard), 6) AS mean_jaccard, round(stddev(jaccard), 6) AS std_jaccard
    FROM jac WHERE set_1 <> set_2 GROUP BY ALL""",
)
def jaccard_summary(spark, sf):
    return concepts.jaccard_summary(_jaccard(spark, sf), "group_name")


@query("K7", "SELECT set_1, set_2, round(avg(jaccard), 6) AS mean_jaccard FROM jac WHERE set_1 < set_2 GROUP BY ALL")
def jaccard_pair_means(spark, sf):
    return concepts.jaccard_pair_means(_jaccard(spark, sf))


@query(
    "K8",
    """SELECT members, count(*) AS n_items FROM (SELECT CUI, string_agg(DISTINCT model, ' | ' ORDER BY model) AS members
    FROM kept GROUP BY CUI) GROUP BY ALL""",
)
def membership_overlap(spark, sf):
    sets = concepts.membership_overlap(_kept(spark, sf), ["CUI"], "model")
    return sets.withColumn("members", F.array_join("members", " | "))


def _vocabulary(column: str) -> str:
    return f"[{quoted((*TERMINOLOGIES, 'MTH', 'NCI'))}][least(CAST(substr({column}, 7) AS INTEGER), 12)]"


@query(
    "K9",
    f"""SELECT 'C' || p_size AS CUI, p_type AS CODE, {_vocabulary('p_brand')} AS SAB, 'PT' AS TTY, min(p_name) AS CUI_Name FROM part
    WHERE p_size > 10 AND {_vocabulary('p_brand')} IN ({quoted(TERMINOLOGIES)}) GROUP BY ALL""",
)
def terminology_map(spark, sf):
    sabs = F.array(*[F.lit(s) for s in (*TERMINOLOGIES, "MTH", "NCI")])
    raw = b.table(spark, sf, "part").select(
        F.concat(F.lit("C"), F.col("p_size")).alias("_c0"),
        F.element_at(sabs, F.least(F.substring("p_brand", 7, 3).cast("int"), F.lit(12))).alias("_c11"),
        F.when(F.col("p_size") > 10, "PT").otherwise("SY").alias("_c12"),
        F.col("p_type").alias("_c13"),
        F.col("p_name").alias("_c14"),
    )
    return concepts.terminology_map(raw)


def _sections(spark, sf):
    return concepts.assemble_sections(*b.section_tables(spark, sf))


@query("K10", "SELECT * FROM sections")
def assemble_sections(spark, sf):
    return _sections(spark, sf)


@query(
    "K11",
    r"""SELECT disease_name, regexp_replace(disease_name || chr(10) || '### Clinical Presentation:' || chr(10)
    || coalesce(clinical_presentation_section, '') || chr(10) || '### Diagnostic Evaluation:' || chr(10)
    || coalesce(diagnostic_evaluation_section, '') || chr(10) || '### Subtype Variant:' || chr(10)
    || coalesce(subtype_variant_section, '') || chr(10) || '### Management Therapy:' || chr(10)
    || coalesce(management_therapy_section, ''), '^\s+|\s+$', '', 'g') AS document FROM sections""",
)
def build_document(spark, sf):
    return concepts.build_document(_sections(spark, sf))


@query(
    "K12",
    rf"""SELECT model, disease, CAST(i AS INTEGER) AS section_no, {TITLE_LIST}[i] AS title,
    regexp_replace(array_to_string(CASE WHEN i = 10 THEN ls[10:] ELSE ls[i:i] END, chr(10)), '^\s+|\s+$', '', 'g') AS body
    FROM (SELECT *, unnest(range(1, least(len(ls), 10) + 1)) AS i FROM summary_lines)""",
)
def extract_sections(spark, sf):
    return readability.extract_sections(b.summaries(spark, sf))


_TAGGED = """lang AS model, CAST(g.doc_id AS VARCHAR) AS disease, 'C_' || replace(g.term, ' ', '_') AS CUI,
    CASE WHEN contains(g.term, ' ') THEN 'Finding' ELSE 'Sign or Symptom' END AS semantic_type_name, start_char, end_char,
    CAST(1 AS DOUBLE) AS similarity"""
_TAG_COLUMNS = ("model", "disease", "CUI", "semantic_type_name", "start_char", "end_char", "similarity")


@query("K13", f"SELECT {_TAGGED}, g.term AS matched_text FROM grams g JOIN terms USING (term)")
def tag_concepts(spark, sf):
    tagged = concepts.tag_concepts(b.docs(spark, sf), b.dictionary(spark, sf))
    term = F.regexp_replace(F.lower("matched_text"), r"[\s-]+", " ").alias("matched_text")
    return tagged.select(*_TAG_COLUMNS, term)


@query(
    "K13",
    f"""SELECT {_TAGGED}, substr(sentence, start_char - sentence_start + 1, end_char - start_char) AS matched_text,
    g.term AS UMLS_name, s.sentence_no, s.sentence_start, s.sentence_end, s.sentence, s.chunk_index FROM grams g JOIN terms USING (term)
    JOIN chunked s ON s.doc_id = g.doc_id AND g.start_char >= s.sentence_start AND g.start_char < s.sentence_end""",
)
def tag_concepts_with_sentence(spark, sf):
    return concepts.tag_concepts(b.docs(spark, sf), b.dictionary(spark, sf)).select(
        *_TAG_COLUMNS, "matched_text", "UMLS_name", "sentence_no", "sentence_start", "sentence_end", "sentence", "chunk_index")


def _spelling(name):
    return F.regexp_replace(F.lower("matched_text"), r"[\s-]+", " ").alias(name)


@query("K13", "SELECT spelling, term, round(similarity, 6) AS similarity FROM term_links")
def similar_terms(spark, sf):
    return linking.similar_terms(distinct_runs(b.docs(spark, sf), 2), b.dictionary(spark, sf)).withColumn("similarity", F.round("similarity", 6))


_LINKED = "model, disease, CUI, UMLS_name, semantic_type_name, start_char, end_char, spelling, round(similarity, 6) AS similarity"


def _linked(spark, sf):
    return linking.link_concepts(b.docs(spark, sf, clustered=True), b.dictionary(spark, sf), longest=2)


@query("K13", f"SELECT {_LINKED} FROM linked")
def link_concepts(spark, sf):
    return _linked(spark, sf).select(
        "model", "disease", "CUI", "UMLS_name", "semantic_type_name", "start_char", "end_char", _spelling("spelling"),
        F.round("similarity", 6).alias("similarity"))


@query(
    "K1",
    f"""SELECT model, CUI, spelling, count(*) AS mentions, round(min(similarity), 6) AS least_similarity FROM linked
    WHERE similarity >= 0.9 AND semantic_type_name IN ({quoted(TARGET_TYPES)}) AND {NOT_NEGATED} GROUP BY ALL""",
)
def linked_concept_filter(spark, sf):
    """The threshold of the concept filter acts on the similarities of the links."""
    kept = concepts.concept_filter(_linked(spark, sf), min_sim=0.9).select("model", "CUI", _spelling("spelling"), "similarity")
    return kept.groupBy("model", "CUI", "spelling").agg(F.count("*").alias("mentions"), F.round(F.min("similarity"), 6).alias("least_similarity"))


@query(
    "K14",
    """SELECT lang AS model, CAST(doc_id AS VARCHAR) AS disease, chunk_index, min(sentence_start) AS start_char,
    max(sentence_end) AS end_char, count(*) AS n_sentences, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
    FROM chunked JOIN documents USING (doc_id) GROUP BY doc_id, lang, chunk_index""",
)
def chunk_sentences(spark, sf):
    return concepts.chunk_sentences(b.docs(spark, sf), ["model", "disease"])


@query(
    "K15",
    """SELECT s_suppkey, string_agg(coalesce(n_name, t), '| ' ORDER BY i) AS semantic_type_name
    FROM (SELECT s_suppkey, unnest([CAST(s_nationkey AS VARCHAR), 'X' || CAST(s_suppkey AS VARCHAR), CAST(s_nationkey // 2 AS VARCHAR)]) AS t,
    unnest([1, 2, 3]) AS i FROM supplier) LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = t GROUP BY s_suppkey""",
)
def label_types(spark, sf):
    key = F.col("s_nationkey")
    ids = F.array(key.cast("string"), F.concat(F.lit("X"), F.col("s_suppkey")), F.expr("s_nationkey div 2").cast("string"))
    rows = b.table(spark, sf, "supplier").select("s_suppkey", ids.alias("semantic_type"))
    names = b.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("TUI"), F.col("n_name").alias("Type_name"))
    return concepts.label_types(rows, names).drop("semantic_type")


@query(
    "K16",
    """WITH names AS (SELECT p_name AS rare_disease_name FROM part UNION SELECT n_name FROM nation UNION SELECT p_type FROM part),
    ovr AS (SELECT DISTINCT p_name AS rare_disease_name, 'override' AS code FROM part WHERE p_retailprice > 1080),
    base AS (SELECT p_name AS rare_disease_name, p_brand AS code FROM part)
    SELECT DISTINCT rare_disease_name, code FROM names JOIN
    (SELECT * FROM base WHERE rare_disease_name NOT IN (SELECT rare_disease_name FROM ovr) UNION SELECT * FROM ovr) USING (rare_disease_name)""",
)
def disease_universe(spark, sf):
    part = b.table(spark, sf, "part")
    names = (
        part.select(F.col("p_name").alias("rare_disease_name"))
        .union(b.table(spark, sf, "nation").select("n_name"))
        .union(part.select("p_type"))
    )
    base = part.select(F.col("p_name").alias("rare_disease_name"), F.col("p_brand").alias("code"))
    over = part.filter(F.col("p_retailprice") > 1080).select(
        F.col("p_name").alias("rare_disease_name"), F.lit("override").alias("code")
    )
    return concepts.disease_universe(names, base, over)


@query("K17", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS patient_id FROM orders")
def assign_ids(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return concepts.assign_ids(rows, ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query(
    "K18",
    r"""SELECT dataset, count(*) AS patients, round(avg(n), 6) AS mean_concepts, round(stddev(n), 6) AS std_concepts,
    CAST(quantile_disc(n, 0.5) AS INTEGER) AS median_concepts FROM (SELECT unnest([dataset, 'overall']) AS dataset, n FROM (
    SELECT CASE WHEN length(text) > 200 THEN 'pubmed' ELSE 'hms' END AS dataset, len(regexp_extract_all(lower(text), '\p{L}+')) AS n
    FROM benchmark)) GROUP BY ALL""",
)
def concept_count_stats(spark, sf):
    return concepts.concept_count_stats(b.text_patients(spark, sf))


# ---------------------------------------------------------------- retrieval and fusion


def _text_index(spark, sf):
    return retrieval.bm25_index(_kept(spark, sf, clustered=True), store=stage)


@query("R1", "SELECT model, disease, CUI, UMLS_name, semantic_type_name, tf, df, round(idf, 6) AS idf, round(bm25, 6) AS bm25 FROM text_index")
def bm25_index(spark, sf):
    index = _text_index(spark, sf)
    return index.withColumn("idf", F.round("idf", 6)).withColumn("bm25", F.round("bm25", 6))


@query("R2", f"SELECT {Q}, disease, shared_cui_count, bm25_sum, rank FROM text_ranked")
def bm25_match(spark, sf):
    return retrieval.bm25_match(retrieval.query_concepts(b.text_patients(spark, sf)), _text_index(spark, sf))


@query("R2", f"SELECT {Q}, disease, shared_cui_count, bm25_sum, rank FROM text_ranked")
def bm25_match_pruned(spark, sf):
    return bm25_match(spark, sf)


@query(
    "R2",
    f"""SELECT {Q}, disease, shared_cui_count, bm25_sum, rank, num_true_classifications, final_classification_string
    FROM sparse LEFT JOIN categories ON lower(trim(disease)) = lower(trim(categories.rare_disease_name))""",
)
def bm25_match_categories(spark, sf):
    return retrieval.attach_categories(_sparse(spark, sf), b.categories(spark, sf))


@query(
    "R2",
    f"""SELECT r.*, m.matched_cuis, m.matched_names FROM sparse r LEFT JOIN (
    SELECT s.model, s.dataset, s.patient_id, s.disease, string_agg(DISTINCT i.CUI, ' | ' ORDER BY i.CUI) AS matched_cuis,
    string_agg(DISTINCT i.UMLS_name, ' | ' ORDER BY i.UMLS_name) AS matched_names
    FROM sparse s JOIN (SELECT DISTINCT dataset, patient_id, CUI FROM active) q USING (dataset, patient_id)
    JOIN pos_index i ON i.model = s.model AND i.disease = s.disease AND i.CUI = q.CUI GROUP BY ALL) m USING ({Q}, disease)""",
)
def matched_concepts(spark, sf):
    index = retrieval.bm25_index(b.position_mentions(spark, sf)).persist()
    queries = b.position_queries(spark, sf)
    return retrieval.matched_concepts(retrieval.bm25_match(queries, index, k=5), queries, index)


@query("R2", f"SELECT {Q}, disease, shared_cui_count, bm25_sum, rank FROM text_ranked")
def bm25_match_blocks(spark, sf):
    """The index is stored as blocks of postings, then matched."""
    stored = stage(postings.posting_blocks(_text_index(spark, sf)))
    return postings.match_blocks(retrieval.query_concepts(b.text_patients(spark, sf)), stored)


@query("R1", "SELECT model, disease, CUI, UMLS_name, semantic_type_name, tf, df, round(idf, 6) AS idf, round(bm25, 6) AS bm25 FROM text_index")
def bm25_index_upkeep(spark, sf):
    """Three batches of diseases, one after the other; the third changes the weights of the first."""
    path = remember_staged(f"{staging_dir(spark)}/index-{uuid.uuid4().hex}")
    mentions = _kept(spark, sf, clustered=True)
    for i in range(3):
        index_upkeep.add_batch(mentions.filter(F.pmod(F.xxhash64("disease"), F.lit(3)) == i), path, f"batch-{i}")
    return index_upkeep.read_index(spark, path).withColumn("idf", F.round("idf", 6)).withColumn("bm25", F.round("bm25", 6))


def _dense(spark, sf):
    return retrieval.dense_rank(b.vectors(spark, sf), b.centroids(spark, sf), k=5)


def _sparse(spark, sf):
    index = retrieval.bm25_index(b.position_mentions(spark, sf)).persist()
    return retrieval.bm25_match(b.position_queries(spark, sf), index, k=5)


def _fused(spark, sf):
    return fusion.rrf_fuse(_dense(spark, sf), _sparse(spark, sf))


def _with_truth(ranked, spark, sf):
    return fusion.attach_truth(ranked, b.truth(spark, sf), b.categories(spark, sf))


@query("R3", f"SELECT {Q}, disease, score, rank FROM dense")
def dense_rank(spark, sf):
    return _dense(spark, sf)


@query(
    "R4",
    f"""SELECT {Q}, disease_norm, disease, dense_rank, sparse_rank, rrf_score, final_rank, rare_disease_name,
    num_true_classifications, final_classification_string FROM fused_truth""",
)
def rrf_fuse(spark, sf):
    return _with_truth(_fused(spark, sf), spark, sf)


@query(
    "R5",
    """SELECT d.dataset, d.patient_id, d.rank, d.disease, d.model AS gated_model, p.consensus FROM dense d
    JOIN picked p USING (dataset, patient_id, model)""",
)
def consensus_gate(spark, sf):
    return fusion.consensus_gate(_dense(spark, sf), b.MODELS)


@query("R5", "SELECT model AS gated_model, count(*) AS count FROM picked GROUP BY ALL")
def gate_counts(spark, sf):
    return fusion.gate_counts(fusion.consensus_gate(_dense(spark, sf), b.MODELS))


@query(
    "R6",
    f"""SELECT *, CAST(row_number() OVER (PARTITION BY {Q} ORDER BY score DESC, original_rank, disease) AS INTEGER) AS rerank_position
    FROM reranked""",
)
def rerank(spark, sf):
    pairs = _fused(spark, sf).select(
        *retrieval.QUERY, "disease", F.col("final_rank").alias("rank"),
        (F.col("final_rank") / 10.0).alias("no_logit"), (F.col("rrf_score") * 100).alias("yes_logit"),
    )
    scored = fusion.rerank(pairs, fusion.yes_probability(F.col("no_logit"), F.col("yes_logit")))
    return scored.drop("no_logit", "yes_logit")


def _rerank_records(spark, sf):
    part = b.table(spark, sf, "part")
    knowledge = part.groupBy(F.concat(F.lit("Disease "), F.col("p_size") % 8).alias("disease_name")).agg(
        F.max("p_name").alias("clinical_presentation_section"),
        F.max("p_brand").alias("diagnostic_evaluation_section"),
        F.max("p_type").alias("subtype_variant_section"),
        F.max(F.when(F.col("p_retailprice") > 900, F.col("p_name"))).alias("management_therapy_section"),
    )
    texts = b.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("patient_id"), F.col("text").alias("case_data"))
    cases = b.truth(spark, sf).select("dataset", "patient_id").join(texts, "patient_id", "left")
    return fusion.rerank_input(_fused(spark, sf), knowledge, cases)


@query("R7")
def rerank_input(spark, sf):
    return _rerank_records(spark, sf).withColumn("diseases", F.to_json("diseases"))


@query(
    "R7",
    f"""SELECT {Q}, CASE WHEN trim(coalesce(case_data, '')) <> '' THEN 1 ELSE 0 END AS has_case_data,
    CAST(length(coalesce(case_data, '')) AS INTEGER) AS case_data_length, CAST(count(*) AS INTEGER) AS n_top_diseases,
    CAST(count(disease_name) AS INTEGER) AS n_knowledge_found, CAST(count(*) - count(disease_name) AS INTEGER) AS n_knowledge_missing,
    CAST(count(coalesce(a, b, c, d)) AS INTEGER) AS n_diseases_with_nonempty_sections
    FROM fused f LEFT JOIN knowledge ON disease_name = disease LEFT JOIN cases USING (dataset, patient_id)
    WHERE final_rank <= 10 GROUP BY {Q}, case_data""",
)
def rerank_input_stats(spark, sf):
    return fusion.rerank_input_stats(_rerank_records(spark, sf))


@query(
    "R8",
    """SELECT model, disease, CUI, min(UMLS_name) OVER (PARTITION BY model, CUI) AS UMLS_name, round(tf * ln(n / df), 6) AS tfidf FROM (
    SELECT model, disease, CUI, min(UMLS_name) AS UMLS_name, count(*) AS tf FROM kept GROUP BY ALL)
    JOIN (SELECT model, CUI, count(DISTINCT disease) AS df FROM kept GROUP BY ALL) USING (model, CUI)
    JOIN (SELECT model, count(DISTINCT disease) AS n FROM kept GROUP BY ALL) USING (model)""",
)
def tfidf(spark, sf):
    return retrieval.tfidf(_kept(spark, sf, clustered=True), store=stage).withColumn("tfidf", F.round("tfidf", 6))


@query(
    "R9",
    f"""SELECT {Q}, disease, rank, score, CAST(NULL AS DOUBLE) AS bm25_sum, 'dense' AS side FROM dense
    UNION ALL SELECT {Q}, disease, rank, NULL, bm25_sum, 'sparse' FROM sparse""",
)
def combine(spark, sf):
    frames = [_dense(spark, sf).withColumn("side", F.lit("dense")), _sparse(spark, sf).withColumn("side", F.lit("sparse"))]
    return fusion.combine(frames, [*retrieval.QUERY, "disease", "rank", "score", "bm25_sum", "side"])


@query(
    "R10",
    f"""SELECT {Q}, disease, rank, CASE WHEN o.doc_id IS NOT NULL THEN 'Disease 0' ELSE rare_disease_name END AS rare_disease_name
    FROM dense_truth LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) o ON patient_id = CAST(o.doc_id AS VARCHAR)""",
)
def override(spark, sf):
    changed = b.table(spark, sf, "labels").filter(F.col("quality") == 0).select(
        F.col("doc_id").cast("string").alias("patient_id"), F.lit("Disease 0").alias("rare_disease_name")
    ).distinct()
    rows = fusion.attach_truth(_dense(spark, sf), b.truth(spark, sf))
    return fusion.override(rows, changed, ["patient_id"]).select(*retrieval.QUERY, "disease", "rank", "rare_disease_name")


@query("R11", f"SELECT {Q}, disease, score, rank, k FROM dense, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k")
def topk_slices(spark, sf):
    return retrieval.topk_slices(_dense(spark, sf))


# ---------------------------------------------------------------- evaluation


def _fused_truth(spark, sf):
    return _with_truth(_fused(spark, sf), spark, sf)


def _dense_truth(spark, sf):
    return _with_truth(_dense(spark, sf), spark, sf)


@query(
    "E1",
    f"""SELECT model, cohort, k, t.total, CAST(coalesce(sum(hit), 0) AS BIGINT) AS hits, round(coalesce(sum(hit), 0) / max(t.total), 4) AS recall
    FROM model_grid JOIN (SELECT cohort, count(*) AS total FROM (SELECT *, {COHORT} AS cohort FROM truth) GROUP BY ALL) t USING (cohort)
    LEFT JOIN (SELECT *, {COHORT} AS cohort FROM dense_hits) USING (model, cohort, k) GROUP BY ALL""",
)
def recall_at_k(spark, sf):
    return evaluation.recall_at_k(_dense_truth(spark, sf), evaluation.cohort_totals(b.truth(spark, sf)))


@query("E2", "SELECT * FROM accuracy")
def accuracy_at_k(spark, sf):
    return evaluation.accuracy_at_k(_fused_truth(spark, sf))


@query("E3", "SELECT * FROM fused_rank")
def truth_rank(spark, sf):
    return evaluation.truth_rank(_fused_truth(spark, sf))


@query(
    "E3",
    """SELECT model, count(*) AS patients, round(avg(CASE WHEN ground_truth_disease_rank >= 11 THEN 0 ELSE 1.0::DOUBLE / ground_truth_disease_rank END), 6) AS mrr
    FROM fused_rank GROUP BY ALL""",
)
def mrr(spark, sf):
    return evaluation.mrr(evaluation.truth_rank(_fused_truth(spark, sf)))


def _rates(spark, sf):
    return evaluation.match_rate(_dense_truth(spark, sf), b.truth(spark, sf), ks=(1, 3, 5))


@query("E4", "SELECT * FROM rates")
def match_rate(spark, sf):
    return _rates(spark, sf)


@query(
    "E4",
    """SELECT model, k, CAST(sum(matched_pts) AS BIGINT) AS matched_pts, CAST(sum(total_pts) AS BIGINT) AS total_pts,
    round(sum(matched_pts) / sum(total_pts), 4) AS match_rate FROM rates GROUP BY ALL""",
)
def pooled_match_rate(spark, sf):
    return evaluation.pooled_match_rate(_rates(spark, sf))


@query("E5", "SELECT *, round(matched_pts / total_pts, 4) AS match_rate FROM complexity")
def rate_by_complexity(spark, sf):
    return evaluation.rate_by_complexity(_dense_truth(spark, sf))


@query(
    "E5",
    """SELECT model, k, CASE WHEN num_true_classifications >= 9 THEN '9+' ELSE CAST(num_true_classifications AS VARCHAR) END AS classification_group,
    CAST(sum(matched_pts) AS BIGINT) AS matched_sum, CAST(sum(total_pts) AS BIGINT) AS total_sum,
    round(sum(matched_pts) / sum(total_pts), 4) AS recall FROM complexity GROUP BY ALL""",
)
def recall_by_bucket(spark, sf):
    return evaluation.recall_by_bucket(evaluation.rate_by_complexity(_dense_truth(spark, sf)))


@query(
    "E5",
    """SELECT k, CAST(sum(matched_pts) AS BIGINT) AS matched_sum, CAST(sum(total_pts) AS BIGINT) AS total_sum,
    round(sum(matched_pts) / sum(total_pts), 4) AS overall_recall FROM complexity GROUP BY ALL""",
)
def overall_recall(spark, sf):
    return evaluation.overall_recall(evaluation.rate_by_complexity(_dense_truth(spark, sf)))


def _detail(spark, sf):
    return evaluation.eval_detail(_fused(spark, sf), b.truth(spark, sf))


@query(
    "E6",
    f"""SELECT {Q}, rare_disease_name, matched_rank, matched_predicted_disease, hit_top1, hit_top3, hit_top5, n_predictions,
    top10_predicted_diseases, status FROM details""",
)
def eval_detail(spark, sf):
    return _detail(spark, sf)


@query(
    "E6",
    """SELECT model, count(*) AS n_output_patients, count(*) AS n_evaluable_with_truth, CAST(0 AS BIGINT) AS n_no_truth_record,
    CAST(sum(hit_top1) AS BIGINT) AS top1_hits, CAST(sum(hit_top3) AS BIGINT) AS top3_hits, CAST(sum(hit_top5) AS BIGINT) AS top5_hits,
    round(avg(hit_top1), 6) AS recall_at_1, round(avg(hit_top3), 6) AS recall_at_3, round(avg(hit_top5), 6) AS recall_at_5
    FROM details GROUP BY ALL""",
)
def eval_summary(spark, sf):
    return evaluation.eval_summary(_detail(spark, sf))


def _outcomes(spark, sf):
    dense = _dense(spark, sf).persist()  # read by both rankings
    base = evaluation.truth_rank(_with_truth(dense, spark, sf), rank_col="rank")
    new = evaluation.truth_rank(_with_truth(fusion.rrf_fuse(dense, _sparse(spark, sf)), spark, sf))
    return outcomes.rank_transition(base, new)


@query("E7b", f"SELECT {Q}, b AS base_rank_nokb, n AS kb_rank, kb_vs_base, top1_transition FROM outcomes")
def rank_transition(spark, sf):
    return _outcomes(spark, sf)


def _outcome_counts() -> str:
    counts, shares = [], []
    for prefix, cond, total in (("", "TRUE", "total"), ("top1_", "b = 1", "top1_total"), ("rest_", "b <> 1", "rest_total")):
        counts.append(f"count(*) FILTER (WHERE {cond}) AS {total}")
        for kind in ("better", "worse", "same"):
            counts.append(f"count(*) FILTER (WHERE {cond} AND kb_vs_base = '{kind}') AS {prefix}{kind}_n")
            shares.append(f"round({prefix}{kind}_n * 100.0::DOUBLE / nullif({total}, 0), 2) AS {prefix}{kind}_pct")
    return f"SELECT *, {', '.join(shares)} FROM (SELECT model, {', '.join(counts)} FROM outcomes GROUP BY model)"


@query("E7", _outcome_counts())
def outcome_summary(spark, sf):
    return outcomes.outcome_summary(_outcomes(spark, sf))


def _transition_sql() -> str:
    share = "round(count(*) FILTER (WHERE {c} AND {x}) * 100.0::DOUBLE / count(*) FILTER (WHERE {c}), 1) AS {n}"
    parts = [
        share.format(c="b = 1", x="top1_transition = 'stable_top1'", n="top1_same_pct"),
        share.format(c="b = 1", x="top1_transition = 'lost_top1'", n="top1_worse_pct"),
        *[share.format(c="b <> 1", x=f"kb_vs_base = '{k}'", n=f"non_top1_{k}_pct") for k in ("better", "worse", "same")],
    ]
    return f"""SELECT cohort, model, {', '.join(parts)} FROM outcomes_cohort GROUP BY ALL
    HAVING count(*) FILTER (WHERE b = 1) > 0 AND count(*) FILTER (WHERE b <> 1) > 0"""


@query("E8", _transition_sql())
def transition_by_cohort(spark, sf):
    return outcomes.transition_by_cohort(_outcomes(spark, sf))


@query(
    "E9",
    """SELECT cohort, model, count(*) AS non_top1_total, count(*) FILTER (WHERE n = 1) AS promoted,
    round(count(*) FILTER (WHERE n = 1) / count(*), 4) AS promotion_rate FROM outcomes_cohort WHERE b <> 1 GROUP BY ALL""",
)
def promotion_rate(spark, sf):
    return outcomes.promotion_rate(_outcomes(spark, sf))


@query(
    "E10",
    """SELECT correct_disease, count(*) AS n_cases FROM (SELECT dataset, patient_id, rare_disease_name AS correct_disease
    FROM outcomes JOIN truth USING (dataset, patient_id) WHERE kb_vs_base = 'same' GROUP BY ALL HAVING count(DISTINCT model) = 3)
    GROUP BY ALL""",
)
def all_members_agree(spark, sf):
    rows = _outcomes(spark, sf).join(
        b.truth(spark, sf).withColumnRenamed("rare_disease_name", "correct_disease"), ["dataset", "patient_id"]
    )
    return outcomes.all_members_agree(rows, "same", 3)


def _scored_notes(spark, sf):
    events = b.table(spark, sf, "events")
    band = b.severity_band(F.col("value"))
    kind = F.when(band == "unknown", "Outpatient note").when(band == "mild", "Inpatient note").when(
        band == "moderate", "Discharge summary").otherwise("Nursing note")
    title = F.when(band.isin("unknown", "mild"), "Progress Notes").when(band == "moderate", "Discharge Summary").otherwise("Plan")
    truth = events.select(
        F.col("user_id").alias("person_id"), F.col("event_id").alias("row_index"), F.col("event_type").alias("disease_name"),
        kind.alias("note_type_name"), title.alias("note_title"), F.col("ts").alias("note_date"),
    )
    k = F.get_json_object("props", "$.k").cast("int")
    predicted = events.select(
        F.col("user_id").alias("patient_id"), F.col("event_id").alias("row_index"),
        F.when(k > 40, F.col("event_type")).otherwise("view").alias("disease"),
        F.round(F.least(F.col("value"), F.lit(100.0)) / 100, 4).alias("match_score"),
    )
    return evaluation.top1_by_score(predicted, truth)


TOP1_SQL = f"""SELECT person_id, true_disease_name, row_index, disease, match_score, note_date, note_type_name, note_title,
    disease = true_disease_name AS is_hit FROM (SELECT user_id AS person_id, event_type AS true_disease_name, event_id AS row_index,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) > 40 THEN event_type ELSE 'view' END AS disease,
    round(least(value, 100) / 100, 4) AS match_score, ts AS note_date,
    CASE WHEN value < 20 THEN 'Outpatient note' WHEN value < 60 THEN 'Inpatient note' ELSE 'Discharge summary' END AS note_type_name,
    CASE WHEN value < 60 THEN 'Progress Notes' ELSE 'Discharge Summary' END AS note_title FROM events WHERE value < 120)
    QUALIFY row_number() OVER (PARTITION BY person_id, true_disease_name ORDER BY match_score DESC, note_date DESC, row_index) = 1"""


@query("E11", TOP1_SQL)
def top1_by_score(spark, sf):
    return _scored_notes(spark, sf)


@query("E11", f"SELECT note_type_name, count(*) AS total, count(*) FILTER (WHERE is_hit) AS hits FROM ({TOP1_SQL}) GROUP BY ALL")
def top1_counts(spark, sf):
    return evaluation.top1_counts(_scored_notes(spark, sf))


def _label_scores(spark, sf, hit, scale):
    rows = b.table(spark, sf, "labels").join(b.table(spark, sf, "documents").drop("text"), "doc_id")
    return rows.select(
        "doc_id", "source", hit.alias("is_hit"),
        F.round(F.least(F.col("n_chars") / float(scale), F.lit(1.0)), 4).alias("match_score"),
    )


def _quality(spark, sf):
    return _label_scores(spark, sf, F.col("quality") == 1, 4099)


def _label_sql(hit: str, scale: int) -> str:
    return f"""SELECT doc_id, source, {hit} AS is_hit, round(least(n_chars / {scale}.0::DOUBLE, 1), 4) AS match_score
    FROM labels JOIN documents USING (doc_id)"""


QUALITY_SQL = _label_sql("quality = 1", 4099)


@query("E12", f"SELECT is_hit, floor(match_score * 10) / 10 AS score_bin, count(*) AS n FROM ({QUALITY_SQL}) GROUP BY ALL")
def score_histogram(spark, sf):
    return evaluation.score_histogram(_quality(spark, sf))


BINS = [i / 10 for i in range(11)]


@query(
    "E12",
    "SELECT is_hit, " + ", ".join(
        f"count(*) FILTER (WHERE floor(match_score * 10) = {i}) AS \"bin_{x}\"" for i, x in enumerate(BINS)
    ) + f" FROM ({QUALITY_SQL}) GROUP BY ALL",
)
def histogram_table(spark, sf):
    return evaluation.histogram_table(evaluation.score_histogram(_quality(spark, sf)), BINS)


@query(
    "E12",
    f"""SELECT is_hit, count(*) AS n, round(avg(match_score), 9) AS mean_score, round(stddev(match_score), 9) AS std_score,
    quantile_disc(match_score, 0.5) AS median_score FROM ({QUALITY_SQL}) GROUP BY ALL""",
)
def score_stats(spark, sf):
    return evaluation.score_stats(_quality(spark, sf))


@query(
    "E14",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(x, 0.25), 9) AS q1, round(quantile_cont(x, 0.5), 9) AS median,
    round(quantile_cont(x, 0.99), 9) AS p99, max(x) AS most FROM (SELECT *, CAST(l_extendedprice AS DOUBLE) / l_quantity AS x FROM lineitem) GROUP BY ALL""",
)
def exact_quantiles(spark, sf):
    rows = b.table(spark, sf, "lineitem").withColumn("x", F.col("l_extendedprice").cast("double") / F.col("l_quantity"))
    found = quantiles.exact_quantiles(rows, ["l_returnflag", "l_linestatus"], "x", {"q1": 0.25, "median": 0.5, "p99": 0.99, "most": 1.0})
    return found.withColumns({c: F.round(c, 9) for c in ("q1", "median", "p99")})


@query(
    "E13",
    f"""SELECT source, count(DISTINCT doc_id) FILTER (WHERE is_hit) AS hit_count, count(DISTINCT doc_id) FILTER (WHERE NOT is_hit) AS miss_count,
    round(hit_count / (hit_count + miss_count), 4) AS hit_share, round(miss_count / (hit_count + miss_count), 4) AS miss_share,
    hit_count + miss_count AS total FROM ({QUALITY_SQL}) GROUP BY ALL""",
)
def hit_share_by_disease(spark, sf):
    return evaluation.hit_share_by_disease(_quality(spark, sf), "source", "doc_id")


@query(
    "E14",
    f"""SELECT source, count(*) AS n, round(avg(a), 9) AS mean_score_a, round(stddev(a), 9) AS std_score_a,
    round(quantile_cont(a, 0.5), 9) AS median_score_a, round(avg(b), 9) AS mean_score_b, round(stddev(b), 9) AS std_score_b,
    round(quantile_cont(b, 0.5), 9) AS median_score_b FROM (
    SELECT x.source, x.match_score AS a, y.match_score AS b FROM ({QUALITY_SQL}) x JOIN ({_label_sql('toxic = 0', 9011)}) y
    USING (doc_id) WHERE x.is_hit AND y.is_hit) GROUP BY ALL""",
)
def overlap_scores(spark, sf):
    other = _label_scores(spark, sf, F.col("toxic") == 0, 9011)
    return evaluation.overlap_scores(_quality(spark, sf), other, ["doc_id"])


SYNONYMS = {"low or unset": ("5-LOW", "4-NOT SPECIFIED")}


def _relations(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("disease_1"), F.col("o_custkey").alias("disease_2"), F.col("o_orderpriority").alias("relation_type")
    )


@query(
    "E15",
    """SELECT relation_type, count(*) AS case_count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage FROM (
    SELECT CASE WHEN o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') THEN 'low or unset' ELSE o_orderpriority END AS relation_type
    FROM orders) GROUP BY relation_type""",
)
def relation_distribution(spark, sf):
    return evaluation.relation_distribution(_relations(spark, sf), SYNONYMS)


@query("E15", "SELECT DISTINCT o_orderstatus AS disease_1, o_custkey AS disease_2 FROM orders WHERE o_orderpriority = '1-URGENT'")
def relation_pairs(spark, sf):
    return evaluation.relation_pairs(_relations(spark, sf), "1-URGENT")


@query("E16", """SELECT * FROM accuracy WHERE "group" = 'all' AND topk IN ('top1', 'top3') ORDER BY topk, model""")
def metric_slice(spark, sf):
    return evaluation.metric_slice(evaluation.accuracy_at_k(_fused_truth(spark, sf)), "all", ("top1", "top3"))


# ---------------------------------------------------------------- weekly states and cohorts


def _weekly(spark, sf):
    return weekly.weekly_dedupe(b.notes(spark, sf), b.persons(spark, sf))


def _weekly_stored(spark, sf):
    """The weekly table, kept for plans that read it several times."""
    return weekly.dealt_by_person(_weekly(spark, sf), b.parts(spark, sf, "events"))


def _order_weekly_stored(spark, sf, symptom):
    parts = b.parts(spark, sf, "lineitem")
    return weekly.dealt_by_person(weekly.weekly_dedupe(b.order_notes(spark, sf, symptom), parts=parts), parts)


def _before(rows, spark, sf):
    grid = weekly.label_before_after(weekly.weekly_grid(rows), b.persons(spark, sf))
    return grid.filter(F.col("before_after_dx") == "before")


def _supported(rows):
    """The supported pairs, kept: they are counted before they are sent."""
    return weekly.supported_pairs(weekly.pair_cooccurrence(rows)).persist()


def _states(rows, spark, sf):
    return weekly.pair_states(_before(rows, spark, sf), _supported(rows))


def _importance(rows, spark, sf):
    grouped = rows.join(b.persons(spark, sf), "person_id")
    is_case = F.col("group") == "case"
    return weekly.log_ratio_importance(grouped.filter(is_case), grouped.filter(~is_case))


def _weights(rows, spark, sf):
    return weekly.patient_weights(rows, _importance(rows, spark, sf))


@query("T1", "SELECT person_id, umls_name, week_start, severity FROM weekly")
def weekly_dedupe(spark, sf):
    return _weekly(spark, sf)


@query("T2", "SELECT person_id, umls_name, week_start, code, severity FROM grid")
def weekly_grid(spark, sf):
    return weekly.weekly_grid(_weekly(spark, sf))


@query("T3", "SELECT person_id, umls_name, week_start, code, severity, before_after_dx FROM labelled")
def label_before_after(spark, sf):
    return weekly.label_before_after(weekly.weekly_grid(_weekly(spark, sf)), b.persons(spark, sf))


@query("T4", "SELECT * FROM cooc")
def pair_cooccurrence(spark, sf):
    return weekly.pair_cooccurrence(_weekly(spark, sf))


@query(
    "T4",
    """WITH wk AS (SELECT DISTINCT o_custkey AS p, date_trunc('week', o_orderdate) AS w, p_brand AS s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
    SELECT co.*, t.n AS symptom_1_total, round("count" / t.n, 6) AS cooccurrence_rate FROM (
    SELECT x.s AS symptom_1, y.s AS symptom_2, count(*) AS "count", count(DISTINCT x.p) AS distinct_person_count
    FROM wk x JOIN wk y ON x.p = y.p AND x.w = y.w AND x.s < y.s GROUP BY ALL) co
    JOIN (SELECT s AS symptom_1, count(*) AS n FROM wk GROUP BY ALL) t USING (symptom_1)""",
)
def pair_cooccurrence_orders(spark, sf):
    return weekly.pair_cooccurrence(_order_weekly_stored(spark, sf, "p_brand"))


@query(
    "T5",
    """SELECT s.person_id, s.week_index, s.week_start, s.symptom_1, s.symptom_2, joint_state, next_state, severity_1, severity_2,
    coalesce(string_agg(g.umls_name, ',' ORDER BY g.umls_name), '') AS other_symptoms_in_next_week,
    coalesce(string_agg(g.umls_name || ':' || g.severity, ',' ORDER BY g.umls_name), '') AS other_symptoms_with_severity
    FROM states s JOIN widx n ON n.person_id = s.person_id AND n.week_index = s.week_index + 1
    LEFT JOIN gb g ON g.person_id = n.person_id AND g.week_start = n.week_start AND g.code = 1
      AND g.umls_name <> s.symptom_1 AND g.umls_name <> s.symptom_2 GROUP BY ALL""",
)
def pair_states(spark, sf):
    rows = _states(_weekly_stored(spark, sf), spark, sf)
    for c in ("other_symptoms_in_next_week", "other_symptoms_with_severity"):
        rows = rows.withColumn(c, F.array_join(c, ","))
    return rows


@query(
    "T5",
    """WITH wk AS (SELECT DISTINCT o_custkey AS p, date_trunc('week', o_orderdate) AS w, p_type AS s
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    wi AS (SELECT p, w, row_number() OVER (PARTITION BY p ORDER BY w) AS i FROM (SELECT DISTINCT p, w FROM wk)),
    pairs AS (SELECT x.s AS s1, y.s AS s2 FROM wk x JOIN wk y ON x.p = y.p AND x.w = y.w AND x.s < y.s GROUP BY ALL HAVING count(DISTINCT x.p) >= 10),
    pp AS (SELECT DISTINCT p, s1, s2 FROM wk JOIN pairs ON s = s1 OR s = s2),
    ps AS (SELECT DISTINCT p, s FROM wk),
    st AS (SELECT pp.p, s1, s2, i,
      (CASE WHEN a.s IS NOT NULL THEN '1' WHEN pa.s IS NOT NULL THEN '2' ELSE '0' END) || '_'
      || (CASE WHEN b.s IS NOT NULL THEN '1' WHEN pb.s IS NOT NULL THEN '2' ELSE '0' END) AS joint_state
      FROM pp JOIN wi ON wi.p = pp.p LEFT JOIN wk a ON a.p = pp.p AND a.w = wi.w AND a.s = s1 LEFT JOIN wk b ON b.p = pp.p AND b.w = wi.w AND b.s = s2
      LEFT JOIN ps pa ON pa.p = pp.p AND pa.s = s1 LEFT JOIN ps pb ON pb.p = pp.p AND pb.s = s2)
    SELECT s1 AS symptom_1, s2 AS symptom_2, joint_state, next_state, count(*) AS n, count(DISTINCT p) AS n_persons
    FROM (SELECT *, lead(joint_state) OVER (PARTITION BY p, s1, s2 ORDER BY i) AS next_state FROM st)
    WHERE next_state IS NOT NULL GROUP BY ALL""",
)
def pair_transitions_orders(spark, sf):
    rows = _order_weekly_stored(spark, sf, "p_type")
    states = weekly.pair_states(weekly.weekly_grid(rows), _supported(rows))
    return states.groupBy("symptom_1", "symptom_2", "joint_state", "next_state").agg(
        F.count("*").alias("n"), F.count_distinct("person_id").alias("n_persons")
    )


@query("T6", "SELECT * FROM importance_score")
def log_ratio_importance(spark, sf):
    return _importance(_weekly_stored(spark, sf), spark, sf)


@query("T7", "SELECT * FROM weights")
def patient_weights(spark, sf):
    return _weights(_weekly_stored(spark, sf), spark, sf)


@query(
    "T7",
    """SELECT UMLS_name AS umls_name, max(round(tf * ln(n / df), 6)) AS importance_score FROM (
    SELECT model, disease, CUI, min(UMLS_name) AS UMLS_name, count(*) AS tf FROM active GROUP BY ALL)
    JOIN (SELECT model, CUI, count(DISTINCT disease) AS df FROM active GROUP BY ALL) USING (model, CUI)
    JOIN (SELECT model, count(DISTINCT disease) AS n FROM active GROUP BY ALL) USING (model)
    WHERE disease = 'Disease 0' GROUP BY ALL""",
)
def tfidf_importance(spark, sf):
    index = retrieval.tfidf(b.position_mentions(spark, sf)).withColumn("tfidf", F.round("tfidf", 6))
    return weekly.tfidf_importance(index, "Disease 0")


@query(
    "T8",
    """SELECT person_id, round(sum(umls_weight), 6) AS total_symptom_weight FROM (
    SELECT person_id, symptom_1 AS umls_name FROM states UNION SELECT person_id, symptom_2 FROM states)
    LEFT JOIN weights USING (person_id, umls_name) GROUP BY ALL""",
)
def patient_total_weight(spark, sf):
    rows = _weekly_stored(spark, sf)
    return weekly.patient_total_weight(_states(rows, spark, sf), _weights(rows, spark, sf))


FEATURES_SQL = """SELECT person_id, symptom_1, symptom_2, count(DISTINCT week_start) AS pair_week_distinct,
    count(*) FILTER (WHERE w1.worse OR w2.worse) AS worsen_count, round(x.umls_weight + y.umls_weight, 6) AS pair_final_weight
    FROM states s
    LEFT JOIN (SELECT person_id, week_start, umls_name AS symptom_1, lead(r) OVER (PARTITION BY person_id, umls_name ORDER BY week_start) > r AS worse
      FROM (SELECT *, coalesce(list_position(['mild', 'moderate', 'severe'], severity), 0) AS r FROM gb)) w1 USING (person_id, week_start, symptom_1)
    LEFT JOIN (SELECT person_id, week_start, umls_name AS symptom_2, lead(r) OVER (PARTITION BY person_id, umls_name ORDER BY week_start) > r AS worse
      FROM (SELECT *, coalesce(list_position(['mild', 'moderate', 'severe'], severity), 0) AS r FROM gb)) w2 USING (person_id, week_start, symptom_2)
    LEFT JOIN (SELECT person_id, umls_name AS symptom_1, umls_weight FROM weights) x USING (person_id, symptom_1)
    LEFT JOIN (SELECT person_id, umls_name AS symptom_2, umls_weight FROM weights) y USING (person_id, symptom_2)
    WHERE joint_state = '1_1' GROUP BY person_id, symptom_1, symptom_2, x.umls_weight, y.umls_weight"""


def _features(spark, sf):
    rows = _weekly_stored(spark, sf)
    return weekly.pair_features(_states(rows, spark, sf), _weights(rows, spark, sf), _before(rows, spark, sf))


@query("T9", FEATURES_SQL)
def pair_features(spark, sf):
    return _features(spark, sf)


@query(
    "T9",
    f"""SELECT *, round(pair_final_weight / (pair_week_distinct + 1), 9) AS normalized_weight FROM (
    SELECT person_id, CAST(sum(pair_week_distinct) AS BIGINT) AS pair_week_distinct, CAST(sum(worsen_count) AS BIGINT) AS worsen_count,
    round(sum(pair_final_weight), 6) AS pair_final_weight FROM ({FEATURES_SQL}) GROUP BY person_id)""",
)
def person_features(spark, sf):
    return weekly.person_features(_features(spark, sf))


def _grouped_notes(spark, sf):
    kept = concepts.context_filter(b.notes(spark, sf), b.model_concepts(spark, sf))
    return kept.join(b.persons(spark, sf).select("person_id", "group"), "person_id")


COUNTS_SQL = """SELECT model, "group", count(DISTINCT (note_id, CUI)) AS total_concepts, count(DISTINCT person_id) AS total_persons,
    count(DISTINCT note_id) AS total_notes FROM group_context GROUP BY ALL"""


NOTE_PAIR = ("person_id", "note_id", "CUI")


def _cohort_counts(spark, sf):
    """The concept sets of the models meet the notes inside the count, which needs no row per note and model."""
    kept = concepts.context_filter(b.notes(spark, sf), None, once=NOTE_PAIR)
    grouped = kept.join(b.persons(spark, sf).select("person_id", "group"), "person_id")
    return cohort.cohort_counts(grouped, b.model_concepts(spark, sf))


@query("T10", COUNTS_SQL)
def cohort_counts(spark, sf):
    return _cohort_counts(spark, sf)


def _case_control_sql() -> str:
    parts = ["model"]
    for g in cohort.GROUPS:
        for m in ("total_concepts", "total_persons", "total_notes"):
            parts.append(f"coalesce(max({m}) FILTER (WHERE \"group\" = '{g}'), 0) AS {g}_{m}")
    for m in ("total_concepts", "total_persons", "total_notes"):
        parts.append(f"case_{m} - control_{m} AS diff_{m}")
    for g in cohort.GROUPS:
        parts.append(f"round({g}_total_concepts / nullif({g}_total_notes, 0), 4) AS {g}_concepts_per_note")
    return f"SELECT {', '.join(parts)} FROM ({COUNTS_SQL}) GROUP BY model"


@query("T10", _case_control_sql())
def case_control_table(spark, sf):
    return cohort.case_control_table(_cohort_counts(spark, sf))


@query(
    "T11",
    "SELECT model, " + ", ".join(
        f"""round(avg(d) FILTER (WHERE "group" = '{g}'), 3) AS {g}_mean_density, round(stddev_pop(d) FILTER (WHERE "group" = '{g}'), 3) AS {g}_std_density,
        nullif(count(d) FILTER (WHERE "group" = '{g}'), 0) AS {g}_persons""" for g in cohort.GROUPS
    ) + """ FROM (SELECT model, "group", person_id, count(*) / count(DISTINCT note_id) AS d FROM group_context GROUP BY ALL) GROUP BY model""",
)
def density_per_patient(spark, sf):
    return cohort.density_per_patient(_grouped_notes(spark, sf))


def _pairs(spark, sf):
    """Order rows as case / control pairs: customers of one order status against the next customer number."""
    orders = b.table(spark, sf, "orders")
    return orders.select(
        F.col("o_custkey").alias("case_id"), (F.col("o_custkey") + 100000000).alias("control_id"),
        F.col("o_orderdate").alias("case_dx_date"), F.col("o_orderdate").alias("control_dx_date"),
        F.col("o_orderstatus").alias("gender"), F.col("o_orderpriority").alias("race"),
        F.round(F.col("o_totalprice") / 10000, 2).alias("case_onset_age"), F.round(F.col("o_totalprice") / 9000, 2).alias("control_onset_age"),
    )


@query(
    "T12",
    """WITH p AS (SELECT 'case' AS g, o_custkey AS id, min(o_orderstatus) AS gender, min(o_orderpriority) AS race, min(round(o_totalprice / 10000, 2)) AS age
      FROM orders GROUP BY o_custkey
      UNION ALL SELECT 'control', o_custkey + 100000000, min(o_orderstatus), min(o_orderpriority), min(round(o_totalprice / 9000, 2)) FROM orders GROUP BY o_custkey)
    SELECT g AS "group", 'gender' AS attribute, gender AS value, CAST(count(*) AS DOUBLE) AS measure FROM p GROUP BY ALL
    UNION ALL SELECT g, 'race', race, CAST(count(*) AS DOUBLE) FROM p GROUP BY ALL
    UNION ALL SELECT g, 'onset_age', 'mean', round(avg(age), 4) FROM p GROUP BY ALL
    UNION ALL SELECT g, 'onset_age', 'std', round(stddev(age), 4) FROM p GROUP BY ALL""",
)
def demographics(spark, sf):
    return cohort.demographics(cohort.person_table(_pairs(spark, sf)))


@query(
    "T13",
    """SELECT "group", count(*) AS n_rows, count(DISTINCT person_id) AS n_persons FROM states JOIN persons USING (person_id)
    WHERE joint_state = '1_1' GROUP BY ALL""",
)
def state_counts(spark, sf):
    rows = _states(_weekly_stored(spark, sf), spark, sf).join(b.persons(spark, sf).select("person_id", "group"), "person_id")
    return weekly.state_counts(rows, "joint_state", "1_1")


@query(
    "T14",
    """SELECT "group", count(*) AS person_weeks, round(avg(n), 6) AS mean_symptoms, quantile_disc(n, 0.5) AS median_symptoms FROM (
    SELECT "group", person_id, week_start, count(DISTINCT umls_name) AS n FROM weekly JOIN persons USING (person_id) GROUP BY ALL) GROUP BY ALL""",
)
def symptoms_per_week(spark, sf):
    return weekly.symptoms_per_week(_weekly(spark, sf).join(b.persons(spark, sf).select("person_id", "group"), "person_id"))


# ---------------------------------------------------------------- telemetry


@query(
    "L1",
    """SELECT model, round(avg(value), 2) AS avg_total_running_time, round(stddev_pop(value), 2) AS std_total_running_time,
    round(quantile_disc(value, 0.25), 2) AS q1_total_running_time, round(quantile_disc(value, 0.5), 2) AS median_total_running_time,
    round(quantile_disc(value, 0.75), 2) AS q3_total_running_time,
    round(quantile_disc(value, 0.75) - quantile_disc(value, 0.25), 2) AS iqr_total_running_time, count(*) AS record_count
    FROM usage GROUP BY ALL""",
)
def runtime_stats(spark, sf):
    return telemetry.runtime_stats(b.usage(spark, sf))


PATHS = {
    "input": "input_tokens",
    "output": "output_tokens",
    "cached": "input_tokens_details.cached_tokens",
    "reasoning": "output_tokens_details.reasoning_tokens",
}


def _token_values(spark, sf):
    return telemetry.token_values(b.usage(spark, sf), "usage", PATHS)


@query(
    "L2",
    """SELECT model, metric, count(*) AS n, round(avg(value), 2) AS avg_value, round(stddev(value), 2) AS std_value,
    quantile_disc(value, 0.25) AS q1_value, quantile_disc(value, 0.5) AS median_value, quantile_disc(value, 0.75) AS q3_value,
    quantile_disc(value, 0.75) - quantile_disc(value, 0.25) AS iqr_value FROM token_values GROUP BY ALL""",
)
def token_stats(spark, sf):
    return telemetry.token_stats(_token_values(spark, sf))


@query(
    "L2",
    """SELECT model, round(avg(value) FILTER (WHERE metric = 'reasoning') / avg(value) FILTER (WHERE metric = 'output'), 4) AS reasoning_share,
    round(avg(value) FILTER (WHERE metric = 'cached') / avg(value) FILTER (WHERE metric = 'input'), 4) AS cached_share FROM token_values GROUP BY ALL""",
)
def token_ratios(spark, sf):
    ratios = {"reasoning_share": ("reasoning", "output"), "cached_share": ("cached", "input")}
    return telemetry.token_ratios(_token_values(spark, sf), ratios)


# --- fixed values: prices per million tokens; flat for two models, tiered at 200000 input tokens for the others ---
PRICES = [
    ("click", None, 3.0, 3.0, 15.0, 15.0),
    ("view", None, 3.0, 3.0, 15.0, 15.0),
    ("error", 200000, 1.25, 2.5, 10.0, 15.0),
    ("signup", 200000, 1.25, 2.5, 10.0, 15.0),
]


def _cost_sql(layout: str) -> str:
    """Cost over the numbers that the binding of this layout writes; purchases have no price."""
    out = "CASE WHEN value >= 1 THEN floor(value * 10) END"
    out = f"CASE WHEN value >= 1 THEN floor(value * 10) ELSE 0 END + floor(value * 3)" if layout == "metadata" else out
    flat = "model IN ('click', 'view')"
    return f"""SELECT *, round(input_cost + output_cost, 6) AS total_cost FROM (SELECT model,
    round(sum(CASE WHEN model = 'purchase' THEN NULL WHEN {flat} THEN k * 3000 * 3.0::DOUBLE WHEN k * 3000 > 200000 THEN k * 3000 * 2.5::DOUBLE ELSE k * 3000 * 1.25::DOUBLE END / 1e6), 6) AS input_cost,
    round(sum(CASE WHEN model = 'purchase' THEN NULL WHEN {flat} OR k * 3000 > 200000 THEN ({out}) * 15.0::DOUBLE ELSE ({out}) * 10.0::DOUBLE END / 1e6), 6) AS output_cost,
    count(*) FILTER (model = 'purchase') AS n_unpriced FROM usage GROUP BY model)"""


def _cost(spark, sf, layout):
    schema = "model string, threshold long, input_low double, input_high double, output_low double, output_high double"
    usage = telemetry.token_usage(b.usage_json(spark, sf, layout), layout)
    return telemetry.token_cost(usage, spark.createDataFrame(PRICES, schema))


@query("L3", _cost_sql("input_output"))
def token_cost(spark, sf):
    return _cost(spark, sf, "input_output")


@query("L3", _cost_sql("prompt_completion"))
def token_cost_prompt(spark, sf):
    return _cost(spark, sf, "prompt_completion")


@query("L3", _cost_sql("server_tools"))
def token_cost_server_tools(spark, sf):
    return _cost(spark, sf, "server_tools")


@query("L3", _cost_sql("metadata"))
def token_cost_metadata(spark, sf):
    return _cost(spark, sf, "metadata")


def _citations(spark, sf):
    return cite.markdown_citations(b.page_markdown(spark, sf))


@query("L4", "SELECT disease_name, label, url, domain FROM citations")
def markdown_citations(spark, sf):
    return _citations(spark, sf)


@query("L4", r"""SELECT disease_name, label, host || href AS url, regexp_extract(host || href, 'https?://([^/]+)', 1) AS domain FROM links""")
def grounding_citations(spark, sf):
    return cite.grounding_citations(b.page_json(spark, sf))


@query(
    "L4",
    r"""SELECT DISTINCT disease_name, label, host || href AS url, regexp_extract(host || href, 'https?://([^/]+)', 1) AS domain,
    'web_search_result' AS type FROM links WHERE label <> ''""",
)
def triple_citations(spark, sf):
    return cite.triple_citations(b.page_json(spark, sf))


@query("L5", "SELECT disease_name, count(*) AS citation_count FROM citations GROUP BY ALL")
def citations_per_disease(spark, sf):
    return cite.citations_per_disease(_citations(spark, sf))


@query(
    "L5",
    """SELECT CAST(sum(c) AS BIGINT) AS total_citations, round(avg(c), 2) AS avg_citations, round(stddev(c), 2) AS std_citations, count(*) AS n_diseases
    FROM (SELECT disease_name, count(*) AS c FROM citations GROUP BY ALL)""",
)
def citation_stats(spark, sf):
    return cite.citation_stats(_citations(spark, sf))


@query("L5", "SELECT CAST(doc_id AS VARCHAR) AS disease_name FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT disease_name FROM citations)")
def diseases_without_citations(spark, sf):
    return cite.diseases_without_citations(b.docs(spark, sf).withColumnRenamed("disease", "disease_name"), _citations(spark, sf))


@query("L6", "SELECT * FROM top10")
def top_sites(spark, sf):
    return cite.top_sites(_citations(spark, sf))


@query(
    "L6",
    """SELECT category, count(DISTINCT disease_name) AS unique_disease_count,
    round(count(url) * 100.0::DOUBLE / (SELECT count(url) FROM citations), 2) AS citation_percentage
    FROM citations JOIN top10 ON website = domain GROUP BY category""",
)
def site_category_summary(spark, sf):
    return cite.site_category_summary(_citations(spark, sf))


def _queries(spark, sf):
    rows = b.search_responses(spark, sf)
    named = lambda m: rows.withColumn("model", F.lit(m))
    blocks = telemetry.extract_queries(named("blocks"), "blocks", "content")
    events = telemetry.extract_queries(named("events"), "events", "output", distinct=True)
    grounding = telemetry.extract_queries(named("grounding"), "grounding", "candidates")
    return blocks.unionByName(events).unionByName(grounding)


@query("L7", "SELECT model, disease_name, query FROM queries")
def extract_queries(spark, sf):
    return _queries(spark, sf)


@query(
    "L8",
    """SELECT model, round(avg(n), 2) AS avg_query_count, round(stddev(n), 2) AS std_query_count, quantile_disc(n, 0.25) AS q1_query_count,
    quantile_disc(n, 0.5) AS median_query_count, quantile_disc(n, 0.75) AS q3_query_count,
    quantile_disc(n, 0.75) - quantile_disc(n, 0.25) AS iqr_query_count, min(n) AS min_query_count, max(n) AS max_query_count,
    count(*) AS num_diseases_with_queries FROM (SELECT model, disease_name, count(*) AS n FROM queries GROUP BY ALL) GROUP BY ALL""",
)
def query_count_summary(spark, sf):
    return telemetry.query_count_summary(_queries(spark, sf))


@query(
    "L9",
    r"""SELECT role AS model, conv_id || '-' || turn AS disease_name, conv_id || '-' || turn AS id,
    CASE WHEN role = 'assistant' THEN nullif(string_agg(query, chr(10) ORDER BY i), '') ELSE text END AS disease_text FROM (
    SELECT role, conv_id, turn, text, i, nullif(trim(ps[i]), '') AS query FROM (
    SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, regexp_split_to_array(text, '[.\n]+') AS ps FROM conversations)))
    GROUP BY role, conv_id, turn, text""",
)
def flatten_responses(spark, sf):
    return telemetry.flatten_responses(b.raw_responses(spark, sf), ["id"])


@query("L9")
def flatten_response_content(spark, sf):
    return telemetry.flatten_responses(b.raw_responses(spark, sf), ["id", "content", "output", "choices"])


@query("L10", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def append_new(spark, sf):
    done = b.table(spark, sf, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("p_partkey"))
    return new_rows(b.table(spark, sf, "part").select("p_partkey"), done, ["p_partkey"])


@query(
    "L10",
    """SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS amount, p_name AS name, NULL AS supplier FROM part
    UNION ALL SELECT s_suppkey + 1000000000000, CAST(s_acctbal AS DOUBLE), NULL, s_name FROM supplier""",
)
def append_schema_change(spark, sf):
    """Suppliers appended to parts: one column is new, one is missing, one has a wider type; appended twice, they stay once."""
    database = f"rankweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{remember_staged(f'{staging_dir(spark)}/rankweave/{database}')}'")
    parts = b.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("int").alias("amount"), F.col("p_name").alias("name"))
    suppliers = b.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1000000000000).alias("id"), F.col("s_acctbal").cast("double").alias("amount"), F.col("s_name").alias("supplier"))
    for rows in (parts, suppliers, suppliers):
        stored = append_rows(rows, f"{database}.items", ["id"])
    return stored


@query("L10", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def append_files_stream(spark, sf):
    """Orders come as files in two portions that overlap in status 'O'; each portion is one run of the stream."""
    home = remember_staged(f"{staging_dir(spark)}/rankweave/{uuid.uuid4().hex}")
    database = f"rankweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{home}/tables'")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING"
    for portion in ("o_orderstatus <> 'F'", "o_orderstatus <> 'P'"):
        orders.filter(portion).write.mode("append").json(f"{home}/files")
        stored = append_files(spark, f"{home}/files", schema, f"{database}.orders", ["o_orderkey"], f"{home}/taken")
    return stored


@query(
    "R2",
    f"""SELECT r.*, m.matched_cuis FROM sparse r LEFT JOIN (
    SELECT s.model, s.dataset, s.patient_id, s.disease, string_agg(DISTINCT i.CUI, ' | ' ORDER BY i.CUI) AS matched_cuis
    FROM sparse s JOIN (SELECT DISTINCT dataset, patient_id, CUI FROM active) q USING (dataset, patient_id)
    JOIN pos_index i ON i.model = s.model AND i.disease = s.disease AND i.CUI = q.CUI GROUP BY ALL) m USING ({Q}, disease)""",
)
def matched_concepts_bucketed(spark, sf):
    """The index is stored once, bucketed by its key: matching and the look-up of names both read that table."""
    database = f"rankweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{remember_staged(f'{staging_dir(spark)}/rankweave/{database}')}'")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = tables.save_bucketed(retrieval.bm25_index(b.position_mentions(spark, sf)), f"{database}.bm25", ["model", "disease", "CUI"], parts)
    queries = b.position_queries(spark, sf)
    return retrieval.matched_concepts(retrieval.bm25_match(queries, index, k=5), queries, index).drop("matched_names")


@query(
    "L11",
    "SELECT o_orderpriority, " + ", ".join(
        f"""count(*) FILTER (WHERE o_orderstatus = '{s}') AS "{s}_orders",
        coalesce(round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2), 0) AS "{s}_value\"""" for s in "FOP"
    ) + " FROM orders GROUP BY ALL",
)
def category_pivot(spark, sf):
    rows = b.table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("value")
    )
    return telemetry.category_pivot(rows, "o_orderpriority", "o_orderstatus", ["orders", "value"], ["F", "O", "P"])


# ---------------------------------------------------------------- text rules and ingest


@query(
    "Q1",
    r"""SELECT disease_name, trim(regexp_replace(regexp_replace(disease_text, '\*\*.*?\*\*', '', 'g'), '#+', '', 'g'), ' ') AS cleaned,
    regexp_replace(regexp_replace(regexp_replace(disease_text, '\[([^\]]+)\]\(https?://[^)]+\)', '\1', 'g'), 'https?://\S+', '', 'g'),
    '\(\s*[\w.\-]+\.[a-z]{2,}(?:[,\s]\s*[\w.\-]+\.[a-z]{2,})*,?\s*\)', '', 'g') AS without_links FROM markdown""",
)
def clean_text(spark, sf):
    text = F.col("disease_text")
    return b.page_markdown(spark, sf).select(
        "disease_name", clean_markdown(text).alias("cleaned"), remove_links(text).alias("without_links")
    )


def _smog(spark, sf):
    return readability.smog(b.docs(spark, sf))


SMOG_SQL = r"""SELECT *, CASE WHEN sentences < 3 THEN 0 ELSE round(1.043::DOUBLE * sqrt(30.0::DOUBLE * polysyllables / sentences) + 3.1291::DOUBLE, 2) END AS smog FROM (
    SELECT lang AS model, CAST(doc_id AS VARCHAR) AS disease,
    CAST(len(list_filter(regexp_split_to_array(text, '[.!?\n]+'), lambda s: regexp_matches(s, '[\p{L}\p{N}]'))) AS INTEGER) AS sentences,
    CAST(len(list_filter(regexp_extract_all(lower(text), '\p{L}+'), lambda w: len(regexp_extract_all(w, '[aeiouyàâäáéèêëíìîïóòôöúùûü]+')) >= 3)) AS INTEGER) AS polysyllables
    FROM documents)"""


@query("Q2", SMOG_SQL)
def smog(spark, sf):
    return _smog(spark, sf).drop("text")


@query(
    "Q2",
    f"SELECT model, count(*) AS texts, round(avg(smog), 6) AS mean_smog, round(stddev(smog), 6) AS std_smog FROM ({SMOG_SQL}) GROUP BY ALL",
)
def smog_by_model(spark, sf):
    return readability.smog_by_model(_smog(spark, sf))


@query(
    "X1",
    """SELECT CAST(o_custkey AS VARCHAR) AS patient_id, o_orderstatus AS dataset, min_by(o_totalprice, (o_totalprice, o_orderpriority)) AS score,
    min_by(o_orderpriority, (o_totalprice, o_orderpriority)) AS disease FROM orders GROUP BY ALL""",
)
def standardize_columns(spark, sf):
    raw = b.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("PatientID"), F.concat(F.lit(" "), "o_orderstatus").alias("data_set"),
        F.col("o_orderpriority").alias("predicted_disease"), F.col("o_totalprice").cast("string").alias("Match_Score"),
    )
    aliases = {
        "patient_id": ("PatientID", "pid"), "dataset": ("data_set",), "disease": ("predicted_disease",), "score": ("match_score",),
    }
    return standardize(raw, aliases, ["patient_id", "dataset", "score"], {"score": "double"}, ["patient_id", "dataset"], ["score"])


def _order_lines(spark, sf):
    """(good, bad) of a folder of order lines into which lines of customers were put; ``file`` becomes the folder's ``dataset``."""
    path = remember_staged(f"{staging_dir(spark)}/rankweave/lines/{uuid.uuid4().hex}")
    line = lambda *cols: F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("line")
    orders = b.table(spark, sf, "orders").select(line("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), F.lit("orders").alias("dataset"))
    customers = b.table(spark, sf, "customer").select(line("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), F.lit("customer").alias("dataset"))
    orders.unionByName(customers).write.partitionBy("dataset").text(path)
    lines = readers.read_lines(spark, path)
    lines = lines.select(F.regexp_extract("file", "dataset=([^/]+)/", 1).alias("dataset"), "line")
    return readers.split_bad_lines(lines, "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderstatus STRING")


@query(
    "X1",
    """SELECT 'orders' AS dataset, o_orderkey, o_custkey, o_totalprice, o_orderstatus, NULL AS bad_line FROM orders
    UNION ALL SELECT 'customer', NULL, NULL, NULL, NULL, concat_ws(',', c_custkey, c_name, c_acctbal, c_mktsegment) FROM customer""",
)
def bad_lines_apart(spark, sf):
    good, bad = _order_lines(spark, sf)
    return good.unionByName(bad.withColumnRenamed("line", "bad_line"), allowMissingColumns=True)


@query(
    "X3",
    """SELECT 'csv' AS model, 'orders' AS dataset, count(*) AS n_items, count(*) AS n_saved, CAST(0 AS BIGINT) AS n_skipped,
    CAST(0 AS BIGINT) AS n_failed, count(*) AS total_rows FROM orders
    UNION ALL SELECT 'csv', 'customer', count(*), 0, 0, count(*), 0 FROM customer""",
)
def bad_lines_status(spark, sf):
    good, bad = _order_lines(spark, sf)
    item = lambda rows, n, error: rows.select(F.lit("csv").alias("model"), "dataset", F.lit(n).alias("n_rows"), error.cast("string").alias("error"))
    return telemetry.status_summary(item(good, 1, F.lit(None)).unionByName(item(bad, 0, F.lit("does not fit the schema"))))


@query("X2", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def save_and_load(spark, sf):
    rows = b.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    name = f"rankweave_orders_{uuid.uuid4().hex}"  # two runs at once keep out of each other's way
    tables.save(rows, name, ["o_orderstatus"], path=f"{staging_dir(spark)}/rankweave/tables/{name}")
    return tables.load(spark, name)


@query(
    "X3",
    """SELECT lang AS model, source AS dataset, count(*) AS n_items, count(*) FILTER (WHERE n_chars >= 60 AND n_lines > 1) AS n_saved,
    count(*) FILTER (WHERE n_chars >= 60 AND n_lines <= 1) AS n_skipped, count(*) FILTER (WHERE n_chars < 60) AS n_failed,
    CAST(sum(n_lines - 1) AS BIGINT) AS total_rows FROM (SELECT *, len(string_split(text, chr(10))) AS n_lines FROM documents) GROUP BY ALL""",
)
def status_summary(spark, sf):
    log = b.table(spark, sf, "documents").select(
        F.col("lang").alias("model"), F.col("source").alias("dataset"), F.col("doc_id").alias("patient_id"),
        (F.size(F.split("text", "\n")) - 1).alias("n_rows"), F.when(F.col("n_chars") < 60, "too short").alias("error"),
    )
    return telemetry.status_summary(log)


@query(
    "X4",
    r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS name_key, CAST(n_chars AS VARCHAR) AS id_key,
    CASE WHEN lang = 'en' THEN source ELSE lang END AS label FROM documents""",
)
def normalized_keys(spark, sf):
    rows = b.table(spark, sf, "documents")
    blank = F.when(F.col("lang") != "en", F.col("lang")).otherwise(" ")
    return rows.select(
        "doc_id", norm_name(F.col("text")).alias("name_key"), norm_id(F.col("n_chars").cast("double").cast("decimal(18,1)")).alias("id_key"),
        first_nonempty([blank, F.col("source")]).alias("label"),
    )
