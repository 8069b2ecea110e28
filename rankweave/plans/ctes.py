"""Named common table expressions of the DuckDB counterparts, and a composer that includes only what a body uses."""

from __future__ import annotations

import re

from rankweave.operators.vocabulary import SEMANTIC_GROUPS, TARGET_TYPES
from rankweave.plans.bindings import HREF, TEXT_RULES, TITLES, TYPES


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


TYPE_LIST = f"[{quoted(TYPES)}]"
N_TYPES = len(TYPES)
NOT_NEGATED = "NOT (lower(UMLS_name) LIKE 'not %' OR lower(UMLS_name) LIKE 'no %' OR lower(UMLS_name) LIKE 'without %')"
GROUP_CASE = "CASE " + " ".join(
    f"WHEN semantic_type IN ({quoted(types)}) THEN {quoted([name])}" for name, types in SEMANTIC_GROUPS.items()
) + " END"
Q = "model, dataset, patient_id"
SEVERITY = "CASE WHEN value < 20 THEN 'unknown' WHEN value < 60 THEN 'mild' WHEN value < 120 THEN 'moderate' ELSE 'severe' END"
COHORT = "unnest(['all', CASE WHEN lower(dataset) = 'pubmed' THEN 'pubmed' ELSE 'non_pubmed' END])"


def ranked(name: str, k: int) -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY {Q} ORDER BY bm25_sum DESC, shared_cui_count DESC, disease) AS INTEGER) AS rank
    FROM {name} QUALIFY rank <= {k}"""


def index_sql(mentions: str) -> str:
    return f"""SELECT t.model, t.disease, d.semantic_type_name, t.CUI, d.UMLS_name, t.tf, d.df,
        ln((n.n_docs + 1) / (d.df + 0.5)) AS idf,
        ln((n.n_docs + 1) / (d.df + 0.5)) * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * l.doc_len / n.avg_doc_len)) AS bm25
    FROM (SELECT model, disease, CUI, count(*) AS tf FROM {mentions} GROUP BY ALL) t
    JOIN (SELECT model, disease, count(*) AS doc_len FROM {mentions} GROUP BY ALL) l USING (model, disease)
    JOIN (SELECT model, CUI, count(DISTINCT disease) AS df, min(UMLS_name) AS UMLS_name, min(semantic_type_name) AS semantic_type_name
          FROM {mentions} GROUP BY ALL) d USING (model, CUI)
    JOIN (SELECT model, count(*) AS n_docs, avg(c) AS avg_doc_len
          FROM (SELECT model, disease, count(*) AS c FROM {mentions} GROUP BY ALL) GROUP BY model) n USING (model)"""


CTES: dict[str, str] = {
    # --- text
    "doc_words": r"SELECT doc_id, lang, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents",
    "mentions": f"""SELECT lang AS model, CAST(doc_id AS VARCHAR) AS disease, CAST((i - 1) // 512 AS INTEGER) AS chunk_index,
        CASE WHEN i > 1 AND ws[i - 1] IN ('no', 'not', 'without') THEN ws[i - 1] || ' ' || ws[i] ELSE ws[i] END AS UMLS_name,
        'C_' || ws[i] AS CUI, round(1 - 0.6 / length(ws[i]), 4) AS similarity,
        {TYPE_LIST}[least(length(ws[i]), {N_TYPES})]
          || CASE WHEN regexp_matches(ws[i], '[aeiou]$') THEN '| ' || {TYPE_LIST}[least(length(ws[i]) + 7, {N_TYPES})] ELSE '' END
          AS semantic_type_name
    FROM (SELECT doc_id, lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM doc_words)""",
    "kept": rf"""SELECT * FROM mentions WHERE similarity >= 0.8 AND {NOT_NEGATED}
        AND list_has_any(regexp_split_to_array(semantic_type_name, '\|\s*'), [{quoted(TARGET_TYPES)}])""",
    "typed": rf"""SELECT model, disease, CUI, unnest(regexp_split_to_array(semantic_type_name, '\|\s*')) AS semantic_type
        FROM mentions WHERE similarity >= 0.8 AND {NOT_NEGATED}""",
    "grouped": f"""SELECT DISTINCT model, group_name, CUI, disease FROM (SELECT *, {GROUP_CASE} AS group_name FROM typed)
        WHERE group_name IS NOT NULL""",
    "jac": """SELECT a.group_name, a.model AS set_1, b.model AS set_2, coalesce(i.n, 0) AS shared,
        CAST(coalesce(i.n, 0) AS DOUBLE) / (a.n + b.n - coalesce(i.n, 0)) AS jaccard
    FROM (SELECT group_name, model, count(DISTINCT CUI) AS n FROM grouped GROUP BY ALL) a
    JOIN (SELECT group_name, model, count(DISTINCT CUI) AS n FROM grouped GROUP BY ALL) b USING (group_name)
    LEFT JOIN (SELECT x.group_name, x.model AS m1, y.model AS m2, count(*) AS n
        FROM (SELECT DISTINCT group_name, model, CUI FROM grouped) x JOIN (SELECT DISTINCT group_name, model, CUI FROM grouped) y
        USING (group_name, CUI) GROUP BY ALL) i ON i.group_name = a.group_name AND i.m1 = a.model AND i.m2 = b.model""",
    "text_index": index_sql("kept"),
    "text_queries": r"""SELECT DISTINCT CASE WHEN length(text) > 200 THEN 'pubmed' ELSE 'hms' END AS dataset,
        CAST(item_id AS VARCHAR) AS patient_id, 'C_' || unnest(regexp_extract_all(lower(text), '\p{L}+')) AS CUI FROM benchmark""",
    "text_scores": f"""SELECT model, dataset, patient_id, disease, round(sum(bm25), 6) AS bm25_sum, count(*) AS shared_cui_count
        FROM text_queries JOIN text_index USING (CUI) GROUP BY ALL""",
    "text_ranked": ranked("text_scores", 10),
    "bench_words": r"SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM benchmark",
    "terms": """SELECT DISTINCT term FROM (SELECT unnest(ws) AS term FROM bench_words
        UNION ALL SELECT ws[i] || ' ' || ws[i + 1] FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM bench_words))""",
    "pieces": r"""SELECT doc_id, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i
        FROM (SELECT doc_id, lang, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS ps FROM documents)""",
    "spans": r"""SELECT doc_id, lang, i, piece, regexp_matches(piece, '^[\p{L}\p{N}]') AS is_word,
        CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS e,
        sum(CASE WHEN regexp_matches(piece, '[.!?\n]') OR NOT (regexp_matches(piece, '^[\p{L}\p{N}]') OR regexp_matches(piece, '^[\s-]+$'))
        THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM pieces""",
    "raw_sentences": r"""SELECT doc_id, i, raw, CAST(sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) - length(raw) AS pos
        FROM (SELECT doc_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS ps FROM documents))""",
    "sentence_rows": r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sentence_no, sentence,
        CAST(pos + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS INTEGER) AS sentence_start,
        CAST(pos + length(raw) - length(regexp_replace(raw, '^\s+', '')) + length(sentence) AS INTEGER) AS sentence_end,
        len(regexp_split_to_array(sentence, '\s+')) AS n_tokens
        FROM (SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS sentence FROM raw_sentences) WHERE sentence <> ''""",
    "packed": """SELECT doc_id, list_reduce(list_prepend({'used': 0, 'firsts': []::INTEGER[], 'no': -1, 'n': 0},
          list({'used': 0, 'firsts': []::INTEGER[], 'no': sentence_no, 'n': CAST(n_tokens AS INTEGER)} ORDER BY sentence_no)),
        lambda a, s: CASE WHEN a.used > 0 AND a.used + s.n > 512
          THEN {'used': s.n, 'firsts': list_append(a.firsts, s.no), 'no': s.no, 'n': s.n}
          ELSE {'used': a.used + s.n, 'firsts': a.firsts, 'no': s.no, 'n': s.n} END).firsts AS firsts FROM sentence_rows GROUP BY doc_id""",
    "chunked": """SELECT *, CAST(len(list_filter(firsts, lambda f: f <= sentence_no)) AS INTEGER) AS chunk_index
        FROM sentence_rows JOIN packed USING (doc_id)""",
    "tokens": """SELECT *, lead(piece) OVER (PARTITION BY doc_id, s ORDER BY i) AS next_piece,
        lead(e) OVER (PARTITION BY doc_id, s ORDER BY i) AS next_e FROM spans WHERE is_word""",
    "grams": """SELECT doc_id, lang, lower(piece) AS term, CAST(e - length(piece) AS INTEGER) AS start_char, e AS end_char FROM tokens
        UNION ALL SELECT doc_id, lang, lower(piece || ' ' || next_piece), CAST(e - length(piece) AS INTEGER), next_e FROM tokens
        WHERE next_piece IS NOT NULL""",
    "spelling_grams": """SELECT term, list_distinct(list_transform(range(1, length(term) + 1), lambda i: substr(' ' || term || ' ', i, 3))) AS gs
        FROM (SELECT DISTINCT term FROM grams)""",
    "term_grams": """SELECT term, list_distinct(list_transform(range(1, length(term) + 1), lambda i: substr(' ' || term || ' ', i, 3))) AS gs
        FROM (SELECT DISTINCT term FROM terms)""",
    "term_links": """SELECT spelling, term, similarity FROM (
        SELECT spelling, term, count(*) / sqrt(any_value(n) * any_value(n_2)) AS similarity
        FROM (SELECT term AS spelling, len(gs) AS n, unnest(gs) AS g FROM spelling_grams)
        JOIN (SELECT term, len(gs) AS n_2, unnest(gs) AS g FROM term_grams) USING (g) GROUP BY spelling, term) WHERE similarity >= 0.8""",
    "linked": """SELECT lang AS model, CAST(doc_id AS VARCHAR) AS disease, 'C_' || replace(l.term, ' ', '_') AS CUI, l.term AS UMLS_name,
        CASE WHEN contains(l.term, ' ') THEN 'Finding' ELSE 'Sign or Symptom' END AS semantic_type_name, start_char, end_char,
        g.term AS spelling, similarity FROM grams g JOIN term_links l ON g.term = l.spelling""",
    # --- context of mentions: scopes from the definition, joined by their bounds
    "ctx_words": r"""SELECT doc_id, sentence_no, n, i, pos, pos + length(head) AS e, lower(head) AS w,
        regexp_matches(piece, '^[\p{L}\p{N}]+[\s-]+$') AS goes_on FROM (
        SELECT *, regexp_extract(piece, '^[\p{L}\p{N}]+') AS head,
          CAST(sum(length(piece)) OVER (PARTITION BY doc_id, sentence_no ORDER BY i) AS INTEGER) - length(piece) AS pos FROM (
        SELECT doc_id, sentence_no, length(sentence) AS n, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
        SELECT *, regexp_extract_all(sentence, '[\p{L}\p{N}]+[^\p{L}\p{N}]*|[^\p{L}\p{N}]+') AS ps FROM sentence_rows)))""",
    "ctx_runs": """SELECT a.doc_id, a.sentence_no, a.n, a.i AS i, a.i AS j, a.pos AS start, a.e AS fin, a.w AS term FROM ctx_words a WHERE a.w <> ''
        UNION ALL SELECT a.doc_id, a.sentence_no, a.n, a.i, b.i, a.pos, b.e, a.w || ' ' || b.w FROM ctx_words a JOIN ctx_words b
          ON b.doc_id = a.doc_id AND b.sentence_no = a.sentence_no AND b.i = a.i + 1 WHERE a.w <> '' AND a.goes_on
        UNION ALL SELECT a.doc_id, a.sentence_no, a.n, a.i, c.i, a.pos, c.e, a.w || ' ' || b.w || ' ' || c.w FROM ctx_words a JOIN ctx_words b
          ON b.doc_id = a.doc_id AND b.sentence_no = a.sentence_no AND b.i = a.i + 1 JOIN ctx_words c
          ON c.doc_id = a.doc_id AND c.sentence_no = a.sentence_no AND c.i = a.i + 2 WHERE a.w <> '' AND a.goes_on AND b.goes_on""",
    "ctx_marks": f"""SELECT * FROM ctx_runs JOIN (VALUES {", ".join(f"('{t}', {quoted([f]) if f else 'NULL'}, '{k}')" for t, f, k in TEXT_RULES)})
        AS rules(term, flag, kind) USING (term)""",
    "ctx_kept": """SELECT * FROM ctx_marks m WHERE kind <> 'pseudo' AND NOT EXISTS (SELECT 1 FROM ctx_marks o WHERE o.doc_id = m.doc_id
        AND o.sentence_no = m.sentence_no AND o.start <= m.start AND o.fin >= m.fin AND o.fin - o.start > m.fin - m.start)""",
    "ctx_reach": """SELECT m.doc_id, m.sentence_no, m.start, m.fin, m.flag, m.kind, coalesce(min(nxt.start), 1000000000) AS stop_after,
        coalesce(max(lst.fin), 0) AS stop_before, any_value(coalesce(x.e, m.n)) AS ahead, any_value(coalesce(y.pos, 0)) AS behind
        FROM ctx_kept m LEFT JOIN ctx_kept nxt ON nxt.doc_id = m.doc_id AND nxt.sentence_no = m.sentence_no AND nxt.kind = 'end' AND nxt.start > m.start
        LEFT JOIN ctx_kept lst ON lst.doc_id = m.doc_id AND lst.sentence_no = m.sentence_no AND lst.kind = 'end' AND lst.start < m.start
        LEFT JOIN ctx_words x ON x.doc_id = m.doc_id AND x.sentence_no = m.sentence_no AND x.i = m.j + 8
        LEFT JOIN ctx_words y ON y.doc_id = m.doc_id AND y.sentence_no = m.sentence_no AND y.i = m.i - 8
        WHERE m.kind <> 'end' GROUP BY ALL""",
    "ctx_scopes": """SELECT doc_id, sentence_no, flag, fin AS since, least(ahead, stop_after) AS till FROM ctx_reach WHERE kind IN ('forward', 'both')
        UNION ALL SELECT doc_id, sentence_no, flag, greatest(behind, stop_before), start FROM ctx_reach WHERE kind IN ('backward', 'both')""",
    "ctx_mentions": """SELECT g.doc_id, lang AS model, CAST(g.doc_id AS VARCHAR) AS disease, 'C_' || replace(term, ' ', '_') AS CUI, start_char, end_char,
        sentence_no, start_char - sentence_start AS f, end_char - sentence_start AS t
        FROM grams g JOIN terms USING (term) JOIN sentence_rows s ON s.doc_id = g.doc_id AND g.start_char >= s.sentence_start AND g.start_char < s.sentence_end""",
    "ctx_flagged": """SELECT m.model, m.disease, m.CUI, m.start_char, m.end_char,
        coalesce(string_agg(DISTINCT flag, '|' ORDER BY flag), 'AFFIRMED') AS context_flag
        FROM ctx_mentions m LEFT JOIN ctx_scopes s ON s.doc_id = m.doc_id AND s.sentence_no = m.sentence_no AND s.since <= m.f AND s.till >= m.t
        GROUP BY m.model, m.disease, m.CUI, m.start_char, m.end_char""",
    "last_turn": "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id",
    "sections": """SELECT disease_name, max(a) AS clinical_presentation_section, max(b) AS diagnostic_evaluation_section,
        max(c) AS subtype_variant_section, max(d) AS management_therapy_section FROM (
        SELECT CAST(doc_id AS VARCHAR) AS disease_name, text AS a, NULL AS b, NULL AS c, NULL AS d FROM documents
        UNION ALL SELECT CAST(page_id AS VARCHAR), NULL, html, NULL, NULL FROM pages
        UNION ALL SELECT CAST(item_id AS VARCHAR), NULL, NULL, text, NULL FROM benchmark
        UNION ALL SELECT CAST(conv_id AS VARCHAR), NULL, NULL, NULL, text FROM last_turn) GROUP BY disease_name""",
    # --- vectors
    "pv": """SELECT 'm' || m AS model, CASE WHEN embedding[1] >= 0 THEN 'pubmed' WHEN embedding[2] >= 0 THEN 'hms' ELSE 'mme' END AS dataset,
        CAST(vec_id AS VARCHAR) AS patient_id, 'Disease ' || label AS rare_disease_name, m,
        CAST(embedding[m * ceil(len(embedding) / 4)::INT + 1 : (m + 1) * ceil(len(embedding) / 4)::INT] AS DOUBLE[]) AS vector
    FROM (SELECT *, unnest(range(0, 4)) AS m FROM embeddings)""",
    "cv": """SELECT model, rare_disease_name AS disease, list(a ORDER BY p) AS vector FROM (
        SELECT model, rare_disease_name, p, avg(vector[p]) AS a FROM (SELECT *, unnest(range(1, len(vector) + 1)) AS p FROM pv) GROUP BY ALL)
        GROUP BY ALL""",
    "dense": f"""SELECT *, CAST(row_number() OVER (PARTITION BY {Q} ORDER BY score DESC, disease) AS INTEGER) AS rank FROM (
        SELECT model, dataset, patient_id, disease, round(list_cosine_similarity(pv.vector, cv.vector), 4) + 0.0 AS score
        FROM pv JOIN cv USING (model)) QUALIFY rank <= 5""",
    "active": """SELECT model, dataset, patient_id, rare_disease_name AS disease, 'P' || (m * 16 + p - 1) AS CUI,
        'position P' || (m * 16 + p - 1) AS UMLS_name, 'Finding' AS semantic_type_name
        FROM (SELECT *, unnest(range(1, len(vector) + 1)) AS p FROM pv) WHERE vector[p] > 0.15""",
    "pos_index": index_sql("active"),
    "sparse_scores": """SELECT i.model, q.dataset, q.patient_id, i.disease, round(sum(i.bm25), 6) AS bm25_sum, count(*) AS shared_cui_count
        FROM (SELECT DISTINCT dataset, patient_id, CUI FROM active) q JOIN pos_index i USING (CUI) GROUP BY ALL""",
    "sparse": ranked("sparse_scores", 5),
    "truth": "SELECT DISTINCT dataset, patient_id, rare_disease_name FROM pv",
    "categories": """SELECT 'Disease ' || label AS rare_disease_name, CAST(count(*) % 13 + 1 AS INTEGER) AS num_true_classifications,
        'class ' || (count(*) % 13 + 1) AS final_classification_string FROM embeddings GROUP BY label""",
    "merged": f"""SELECT model, dataset, patient_id, lower(trim(coalesce(d.disease, s.disease))) AS disease_norm,
        coalesce(d.disease, s.disease) AS disease, d.rank AS dense_rank, s.rank AS sparse_rank,
        round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 12) AS rrf_score
        FROM dense d FULL OUTER JOIN sparse s USING ({Q}, disease)""",
    "fused": f"""SELECT *, CAST(row_number() OVER (PARTITION BY {Q} ORDER BY rrf_score DESC, dense_rank IS NULL, dense_rank NULLS LAST,
        sparse_rank NULLS LAST, disease_norm) AS INTEGER) AS final_rank FROM merged""",
    "fused_truth": """SELECT f.*, t.rare_disease_name, c.num_true_classifications, c.final_classification_string
        FROM fused f LEFT JOIN truth t USING (dataset, patient_id) LEFT JOIN categories c USING (rare_disease_name)""",
    "dense_truth": """SELECT d.*, t.rare_disease_name, c.num_true_classifications FROM dense d LEFT JOIN truth t USING (dataset, patient_id)
        LEFT JOIN categories c USING (rare_disease_name)""",
    "fused_rank": f"""SELECT {Q}, coalesce(min(CASE WHEN lower(disease) = lower(rare_disease_name) THEN final_rank END), 11)
        AS ground_truth_disease_rank FROM fused_truth GROUP BY ALL""",
    "dense_truth_rank": f"""SELECT {Q}, coalesce(min(CASE WHEN lower(disease) = lower(rare_disease_name) THEN rank END), 11)
        AS ground_truth_disease_rank FROM dense_truth GROUP BY ALL""",
    "fused_hits": f"""SELECT {Q}, k, coalesce(CAST(best <= k AS INTEGER), 0) AS hit FROM (
        SELECT {Q}, min(CASE WHEN disease = rare_disease_name THEN final_rank END) AS best FROM fused_truth GROUP BY ALL),
        (SELECT unnest([1, 3, 5]) AS k)""",
    "dense_hits": f"""SELECT {Q}, k, coalesce(CAST(best <= k AS INTEGER), 0) AS hit FROM (
        SELECT {Q}, min(CASE WHEN disease = rare_disease_name THEN rank END) AS best FROM dense_truth GROUP BY ALL),
        (SELECT unnest([1, 3, 5]) AS k)""",
    "model_grid": """SELECT model, k, cohort FROM (SELECT DISTINCT model FROM dense), (SELECT unnest([1, 3, 5]) AS k),
        (SELECT unnest(['all', 'pubmed', 'non_pubmed']) AS cohort)""",
    "accuracy": f"""SELECT model, 'top' || k AS topk, cohort AS "group", count(hit) AS total, CAST(coalesce(sum(hit), 0) AS BIGINT) AS hits,
        coalesce(round(sum(hit) / nullif(count(hit), 0), 4), 0) AS accuracy
        FROM model_grid LEFT JOIN (SELECT *, {COHORT} AS cohort FROM fused_hits) USING (model, k, cohort) GROUP BY ALL""",
    "rates": """SELECT t.dataset, g.model, g.k, t.total_pts, CAST(coalesce(sum(hit), 0) AS BIGINT) AS matched_pts,
        round(coalesce(sum(hit), 0) / max(t.total_pts), 4) AS match_rate
        FROM (SELECT dataset, count(DISTINCT patient_id) AS total_pts FROM truth GROUP BY ALL) t CROSS JOIN (SELECT DISTINCT model, k FROM model_grid) g
        LEFT JOIN dense_hits h ON h.dataset = t.dataset AND h.model = g.model AND h.k = g.k GROUP BY ALL""",
    "complexity": """SELECT dataset, model, k, num_true_classifications, count(DISTINCT patient_id) AS total_pts,
        count(DISTINCT disease) AS total_diseases, count(DISTINCT CASE WHEN disease = rare_disease_name THEN patient_id END) AS matched_pts
        FROM dense_truth, (SELECT unnest([1, 3, 5]) AS k) WHERE rank <= k GROUP BY ALL""",
    "detail": f"""SELECT {Q}, rare_disease_name, min(CASE WHEN disease = rare_disease_name THEN final_rank END) AS matched_rank,
        min(CASE WHEN disease = rare_disease_name THEN disease END) AS matched_predicted_disease,
        CAST(count(*) AS INTEGER) AS n_predictions, string_agg(disease, ' | ' ORDER BY final_rank) AS top10_predicted_diseases
        FROM fused_truth WHERE final_rank <= 10 GROUP BY ALL""",
    "details": """SELECT *, coalesce(CAST(matched_rank <= 1 AS INTEGER), 0) AS hit_top1, coalesce(CAST(matched_rank <= 3 AS INTEGER), 0) AS hit_top3,
        coalesce(CAST(matched_rank <= 5 AS INTEGER), 0) AS hit_top5,
        CASE WHEN matched_rank IS NULL THEN 'not_found_in_top10' ELSE 'matched' END AS status FROM detail""",
    "outcomes": f"""SELECT {Q}, b, n, CASE WHEN n < b THEN 'better' WHEN n > b THEN 'worse' ELSE 'same' END AS kb_vs_base,
        CASE WHEN b = 1 AND n = 1 THEN 'stable_top1' WHEN b = 1 THEN 'lost_top1' WHEN n = 1 THEN 'gained_top1' ELSE 'never_top1' END AS top1_transition
        FROM (SELECT {Q}, coalesce(x.ground_truth_disease_rank, 11) AS b, coalesce(y.ground_truth_disease_rank, 11) AS n
        FROM dense_truth_rank x FULL OUTER JOIN fused_rank y USING ({Q}))""",
    "outcomes_cohort": f"SELECT *, {COHORT} AS cohort FROM outcomes",
    "lists": "SELECT dataset, patient_id, model, disease AS cand, rank FROM dense",
    "universe": """SELECT dataset, patient_id, model, cand, coalesce(l.rank, greatest(n, last_rank) + 1) AS r
        FROM (SELECT dataset, patient_id, unnest(cands) AS cand, len(cands) AS n FROM (
          SELECT dataset, patient_id, list(DISTINCT cand) AS cands FROM lists GROUP BY ALL))
        JOIN (SELECT dataset, patient_id, model, max(rank) AS last_rank FROM lists GROUP BY ALL) USING (dataset, patient_id)
        LEFT JOIN lists l USING (dataset, patient_id, model, cand)""",
    "avg_ranks": """SELECT *, rank() OVER (PARTITION BY dataset, patient_id, model ORDER BY r)
        + (count(*) OVER (PARTITION BY dataset, patient_id, model, r) - 1) / 2 AS ar FROM universe""",
    "spearman": """SELECT a.dataset, a.patient_id, a.model, b.model AS other,
        CASE WHEN stddev_pop(a.ar) = 0 OR stddev_pop(b.ar) = 0 THEN 0 ELSE covar_pop(a.ar, b.ar) / (stddev_pop(a.ar) * stddev_pop(b.ar)) END AS c
        FROM avg_ranks a JOIN avg_ranks b USING (dataset, patient_id, cand) WHERE a.model <> b.model GROUP BY ALL""",
    "picked": """SELECT dataset, patient_id, model, consensus FROM (
        SELECT dataset, patient_id, model, round(sum(c), 9) AS consensus FROM spearman GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY dataset, patient_id ORDER BY consensus DESC, model) = 1""",
    "reranked": f"""SELECT {Q}, disease, final_rank AS original_rank,
        round(1 / (1 + exp(final_rank / 10.0 - rrf_score * 100)), 4) AS score FROM fused""",
    "knowledge": """SELECT 'Disease ' || (p_size % 8) AS disease_name, max(p_name) AS a, max(p_brand) AS b, max(p_type) AS c,
        max(CASE WHEN p_retailprice > 900 THEN p_name END) AS d FROM part GROUP BY ALL""",
    "cases": """SELECT DISTINCT dataset, patient_id, text AS case_data FROM truth LEFT JOIN documents ON patient_id = CAST(doc_id AS VARCHAR)""",
    # --- notes
    "notes": f"""SELECT user_id AS person_id, event_id AS note_id, ts AS note_date, event_type AS CUI, event_type AS umls_name,
        {SEVERITY} AS severity, CASE WHEN value < 2 THEN 'NEGATED_EXISTENCE' WHEN value < 4 THEN 'HISTORICAL'
        WHEN value >= 6 THEN 'AFFIRMED' END AS context_flag FROM events""",
    "persons": """SELECT user_id AS person_id, CASE WHEN avg(value) > 50 THEN 'case' ELSE 'control' END AS "group",
        CAST(date_trunc('day', min(CASE WHEN event_type = 'error' THEN ts END)) AS TIMESTAMP) + INTERVAL 10 DAYS AS dx_date
        FROM events GROUP BY user_id""",
    "model_concepts": "SELECT DISTINCT 'h' || hour(ts) AS model, event_type AS CUI FROM events WHERE value > 250",
    "context": "SELECT * FROM notes JOIN model_concepts USING (CUI) WHERE context_flag = 'AFFIRMED'",
    "group_context": """SELECT c.*, p."group" FROM context c JOIN persons p USING (person_id)""",
    "weekly": """SELECT person_id, umls_name, CAST(date_trunc('week', note_date) AS TIMESTAMP) AS week_start, severity FROM notes
        QUALIFY row_number() OVER (PARTITION BY person_id, umls_name, date_trunc('week', note_date)
        ORDER BY severity = 'unknown', note_date DESC, note_id DESC) = 1""",
    "grid": """SELECT person_id, umls_name, week_start, CASE WHEN w.severity IS NULL THEN 2 ELSE 1 END AS code, coalesce(w.severity, 'unknown') AS severity
        FROM (SELECT DISTINCT person_id, week_start FROM weekly) JOIN (SELECT DISTINCT person_id, umls_name FROM weekly) USING (person_id)
        LEFT JOIN weekly w USING (person_id, umls_name, week_start)""",
    "labelled": """SELECT g.*, CASE WHEN week_start < dx_date THEN 'before' ELSE 'after' END AS before_after_dx
        FROM grid g LEFT JOIN persons USING (person_id)""",
    "gb": "SELECT * FROM labelled WHERE before_after_dx = 'before'",
    "co": """SELECT a.umls_name AS symptom_1, b.umls_name AS symptom_2, count(*) AS "count", count(DISTINCT person_id) AS distinct_person_count
        FROM weekly a JOIN weekly b USING (person_id, week_start) WHERE a.umls_name < b.umls_name GROUP BY ALL""",
    "cooc": """SELECT co.*, t.n AS symptom_1_total, round("count" / t.n, 6) AS cooccurrence_rate FROM co
        JOIN (SELECT umls_name AS symptom_1, count(*) AS n FROM weekly GROUP BY ALL) t USING (symptom_1)""",
    "widx": """SELECT person_id, week_start, CAST(row_number() OVER (PARTITION BY person_id ORDER BY week_start) - 1 AS INTEGER) AS week_index
        FROM (SELECT DISTINCT person_id, week_start FROM gb)""",
    "pw": """SELECT person_id, week_start, week_index, symptom_1, symptom_2,
        coalesce(max(CASE WHEN umls_name = symptom_1 THEN code END), 0) || '_' || coalesce(max(CASE WHEN umls_name = symptom_2 THEN code END), 0) AS joint_state,
        max(CASE WHEN umls_name = symptom_1 THEN severity END) AS severity_1, max(CASE WHEN umls_name = symptom_2 THEN severity END) AS severity_2
        FROM gb JOIN widx USING (person_id, week_start)
        JOIN (SELECT symptom_1, symptom_2 FROM cooc WHERE distinct_person_count >= 10) ON umls_name = symptom_1 OR umls_name = symptom_2
        GROUP BY ALL""",
    "states": """SELECT * FROM (SELECT *, lead(joint_state) OVER (PARTITION BY person_id, symptom_1, symptom_2 ORDER BY week_index) AS next_state FROM pw)
        WHERE next_state IS NOT NULL""",
    "importance": """SELECT umls_name, count(DISTINCT CASE WHEN "group" = 'case' THEN person_id END) AS freq_case,
        count(DISTINCT CASE WHEN "group" = 'control' THEN person_id END) AS freq_ctrl FROM weekly JOIN persons USING (person_id) GROUP BY ALL""",
    "importance_score": "SELECT *, round(log2((freq_case + 5.0) / (freq_ctrl + 5.0)), 9) AS importance_score FROM importance",
    "weights": """SELECT *, round(importance_score * ln(1 + freq_within_patient), 9) AS umls_weight FROM (
        SELECT person_id, umls_name, count(DISTINCT week_start) AS freq_within_patient FROM weekly GROUP BY ALL)
        LEFT JOIN (SELECT umls_name, importance_score FROM importance_score) USING (umls_name)""",
    "order_notes": """SELECT o_custkey AS person_id, o_orderdate AS note_date, p_brand, p_type,
        o_orderkey * 10 + l_linenumber AS note_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    # --- responses
    "usage": """SELECT event_type AS model, CAST(user_id AS VARCHAR) AS disease_name, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        CASE WHEN value < 1 THEN NULL ELSE floor(value * 10) END AS shown FROM events""",
    "token_values": """SELECT model, 'input' AS metric, CAST(k * 3000 AS DOUBLE) AS value FROM usage
        UNION ALL SELECT model, 'output', shown FROM usage WHERE shown IS NOT NULL
        UNION ALL SELECT model, 'cached', CAST(k * 700 AS DOUBLE) FROM usage
        UNION ALL SELECT model, 'reasoning', floor(value * 3) FROM usage""",
    "markdown": rf"""SELECT CAST(page_id AS VARCHAR) AS disease_name, regexp_replace(html, '{HREF}',
        '[\2](http://' || regexp_extract(url, 'https?://([^/]+)', 1) || '\1)', 'g') AS disease_text FROM pages""",
    "links": rf"""SELECT CAST(page_id AS VARCHAR) AS disease_name, 'http://' || regexp_extract(url, 'https?://([^/]+)', 1) AS host,
        unnest(regexp_extract_all(html, '{HREF}', 1)) AS href, unnest(regexp_extract_all(html, '{HREF}', 2)) AS label FROM pages""",
    "md_links": r"""SELECT disease_name, unnest(regexp_extract_all(disease_text, '\[([^\]]+)\]\((https?://[^\s)]+)', 1)) AS label,
        unnest(regexp_extract_all(disease_text, '\[([^\]]+)\]\((https?://[^\s)]+)', 2)) AS url FROM markdown""",
    "citations": r"SELECT *, regexp_extract(url, 'https?://([^/]+)', 1) AS domain FROM md_links",
    "top10": """SELECT domain AS website, count(DISTINCT disease_name) AS disease_count, count(url) AS citations,
        'Other / Unknown' AS category FROM citations GROUP BY domain ORDER BY disease_count DESC, website LIMIT 10""",
    "sentences": r"""SELECT CAST(conv_id AS VARCHAR) AS disease_name, turn, role, trim(unnest(regexp_split_to_array(text, '[.\n]+'))) AS query FROM conversations""",
    "queries": """SELECT 'blocks' AS model, disease_name, query FROM sentences WHERE query <> ''
        UNION ALL SELECT DISTINCT 'events', disease_name, query FROM sentences WHERE query <> ''
        UNION ALL SELECT 'grounding', disease_name, query FROM sentences WHERE query <> ''""",
    # --- text rules
    "summary_lines": """SELECT lang AS model, CAST(doc_id AS VARCHAR) AS disease, string_split(text, chr(10)) AS ls FROM documents""",
}
TITLE_LIST = f"[{quoted(TITLES)}]"
_NAMES = sorted(CTES, key=len, reverse=True)


def _uses(text: str) -> set[str]:
    found = set(re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", text)) | set(re.findall(r",\s*([a-z_0-9]+)\s+[a-z]\b", text))
    return found & set(CTES)


def sql(body: str) -> str:
    """The body preceded by the expressions it needs, in dependency order."""
    needed: set[str] = set()
    stack = list(_uses(body))
    while stack:
        name = stack.pop()
        if name not in needed:
            needed.add(name)
            stack += list(_uses(CTES[name]) - {name})
    if not needed:
        return body
    parts = [f"{name} AS MATERIALIZED ({text})" for name, text in CTES.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + body
