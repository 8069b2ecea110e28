"""Concept mentions: filters, coverage, overlap, dictionary tagging and terminology tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions.spans import COPIES, DOC, each_copy, few, sentence_spans, word_grams, words_of_longest
from rankweave.functions.text import NEGATIONS, is_negated, split_trim
from rankweave.operators.vocabulary import (
    BLOCKED_NAMES,
    EXCLUDED_CONTEXTS,
    SEMANTIC_GROUPS,
    SYMPTOM_TYPES,
    TARGET_TYPES,
    TERMINOLOGIES,
)


def concept_filter(
    mentions: DataFrame,
    min_sim: float = 0.8,
    target_types: Sequence[str] = TARGET_TYPES,
    negations: Sequence[str] = NEGATIONS,
    trim: bool = True,
) -> DataFrame:
    """Mentions that are similar enough, carry a target type and are not negated.  One pass, each mention once.

    ``trim=False`` keeps the blanks after the ``|`` separator, so that only the first type of a mention can match.
    """
    names = F.col("semantic_type_name")
    wanted = F.array(*[F.lit(t) for t in target_types])
    several = F.arrays_overlap(split_trim(names, r"\|", trim), wanted)
    # most mentions have one type, which is looked up without splitting
    one = (F.trim(names) if trim else names).isin(list(target_types))
    return mentions.filter(
        (F.col("similarity") >= min_sim)
        & F.when(F.contains(names, F.lit("|")), several).otherwise(one)
        & ~is_negated(F.col("UMLS_name"), negations)
    )


def blocklist_filter(
    mentions: DataFrame,
    types: Sequence[str] = SYMPTOM_TYPES,
    min_sim: float = 0.9,
    blocked_names: Sequence[str] = BLOCKED_NAMES,
) -> DataFrame:
    """Mentions of exactly one of ``types``, similar enough, whose name is not blocked."""
    return mentions.filter(
        F.col("semantic_type_name").isin(list(types))
        & (F.col("similarity") >= min_sim)
        & ~F.col("UMLS_name").isin(list(blocked_names))
    )


def names_per_type(mentions: DataFrame) -> DataFrame:
    """Distinct concept names per model and type."""
    return mentions.groupBy("model", "semantic_type_name").agg(F.count_distinct("UMLS_name").alias("total"))


def context_filter(
    notes: DataFrame, concepts: DataFrame | None, flags: Sequence[str] = EXCLUDED_CONTEXTS, keep_null: bool = False,
    once: Sequence[str] = (),
) -> DataFrame:
    """Note mentions in a usable context whose concept belongs to a model's set, for all models at once.

    A null context is dropped unless ``keep_null``.  With ``once`` only these columns and one row for each combination
    are kept, before the concept sets of all models multiply the rows.  Without ``concepts`` only the context counts.
    """
    pattern = "(" + "|".join(flags) + ")"
    usable = ~F.col("context_flag").rlike(pattern)
    usable = F.coalesce(usable, F.lit(True)) if keep_null else usable
    kept = notes.filter(usable)
    kept = kept.select(*once).distinct() if once else kept
    return kept if concepts is None else kept.join(concepts.select("model", "CUI").distinct(), "CUI")


def _kept_types(mentions: DataFrame, min_sim: float) -> DataFrame:
    """Mentions above the threshold and not negated, one row per semantic type; only lists of types are split."""
    names = F.col("semantic_type_name")
    types = F.when(F.contains(names, F.lit("|")), split_trim(names, r"\|")).when(names.isNotNull(), F.array(F.trim(names)))
    kept = mentions.filter((F.col("similarity") >= min_sim) & ~is_negated(F.col("UMLS_name")))
    return kept.withColumn("semantic_type", F.explode(types))


def semantic_group(c: Column, groups: Mapping[str, Sequence[str]] = SEMANTIC_GROUPS) -> Column:
    """Group of a semantic type, null when it belongs to none."""
    expr = None
    for name, types in groups.items():
        hit = c.isin(list(types))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr


def grouped_concepts(
    mentions: DataFrame, groups: Mapping[str, Sequence[str]] = SEMANTIC_GROUPS, min_sim: float = 0.8
) -> DataFrame:
    """Distinct (model, group_name, CUI, disease)."""
    return (
        _kept_types(mentions, min_sim)
        .withColumn("group_name", semantic_group(F.col("semantic_type"), groups))
        .filter(F.col("group_name").isNotNull())
        .select("model", "group_name", "CUI", "disease")
        .distinct()
    )


def semantic_group_coverage(grouped: DataFrame) -> DataFrame:
    """Distinct concepts and diseases per (group, model), from :func:`grouped_concepts`."""
    return grouped.groupBy("group_name", "model").agg(
        F.count_distinct("CUI").alias("distinct_cuis"), F.count_distinct("disease").alias("distinct_diseases")
    )


def type_matrix(mentions: DataFrame, models: Sequence[str] | None = None, min_sim: float = 0.8) -> DataFrame:
    """Distinct concepts per semantic type (rows) and model (columns), missing = 0."""
    pairs = _kept_types(mentions, min_sim).select("model", "semantic_type", "CUI").distinct()
    # counted before the pivot, so the pivot only sees one row per (type, model)
    counts = pairs.groupBy("model", "semantic_type").count()
    return counts.groupBy("semantic_type").pivot("model", list(models) if models else None).agg(
        F.sum("count")
    ).na.fill(0)


def concepts_per_disease(grouped: DataFrame) -> DataFrame:
    """Per (model, group): number of diseases, mean and sample deviation of their distinct concepts."""
    per_disease = grouped.groupBy("model", "group_name", "disease").agg(F.count_distinct("CUI").alias("n"))
    return per_disease.groupBy("model", "group_name").agg(
        F.count("*").alias("n_diseases"),
        F.round(F.avg("n"), 6).alias("mean_cuis"),
        F.round(F.stddev("n"), 6).alias("std_cuis"),
    )


def membership_overlap(
    rows: DataFrame, item: Sequence[str], member: str, by: Sequence[str] = ()
) -> DataFrame:
    """Items per exact set of members holding them (the numbers of an UpSet chart).

    The set of one item is bounded by the number of members, and duplicates collapse before the shuffle.
    """
    sets = (
        rows.select(*by, *item, member)
        .distinct()
        .groupBy(*by, *item)
        .agg(F.array_sort(F.collect_set(member)).alias("members"))
    )
    return sets.groupBy(*by, "members").agg(F.count("*").alias("n_items"))


def pairwise_jaccard(rows: DataFrame, set_col: str, item_col: str, by: str) -> DataFrame:
    """Jaccard index of the item sets of every ordered pair of ``set_col`` values, per ``by``; the diagonal is 1.

    Intersections come from the counts per distinct membership set, so pairs are expanded once per kind of set and
    never once per item.
    """
    kinds = membership_overlap(rows, [item_col], set_col, [by])
    shared = (
        kinds.withColumn("set_1", F.explode("members"))
        .withColumn("set_2", F.explode("members"))
        .groupBy(by, "set_1", "set_2")
        .agg(F.sum("n_items").alias("shared"))
    )
    sizes = shared.filter(F.col("set_1") == F.col("set_2")).select(by, "set_1", F.col("shared").alias("size"))
    grid = sizes.withColumnRenamed("size", "size_1").join(
        sizes.select(by, F.col("set_1").alias("set_2"), F.col("size").alias("size_2")), by
    )
    both = F.coalesce(F.col("shared"), F.lit(0))
    return grid.join(shared, [by, "set_1", "set_2"], "left").select(
        by,
        "set_1",
        "set_2",
        both.alias("shared"),
        (both / (F.col("size_1") + F.col("size_2") - both)).alias("jaccard"),
    )


def jaccard_summary(matrix: DataFrame, by: str) -> DataFrame:
    """Mean and sample deviation of the off-diagonal values per group, over ordered pairs (each value twice)."""
    return (
        matrix.filter(F.col("set_1") != F.col("set_2"))
        .groupBy(by)
        .agg(
            F.round(F.avg("jaccard"), 6).alias("mean_jaccard"), F.round(F.stddev("jaccard"), 6).alias("std_jaccard")
        )
    )


def jaccard_pair_means(matrix: DataFrame) -> DataFrame:
    """Mean over the groups per unordered pair."""
    return (
        matrix.filter(F.col("set_1") < F.col("set_2"))
        .groupBy("set_1", "set_2")
        .agg(F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))
    )


def terminology_map(raw: DataFrame, sabs: Sequence[str] = TERMINOLOGIES, tty: str = "PT") -> DataFrame:
    """Terminology table from a header-less pipe file: one row per (CUI, CODE, SAB), the smallest name wins."""
    return (
        raw.filter(F.col("_c11").isin(list(sabs)) & (F.col("_c12") == tty))
        .groupBy(F.col("_c0").alias("CUI"), F.col("_c13").alias("CODE"), F.col("_c11").alias("SAB"))
        .agg(F.min(F.col("_c12")).alias("TTY"), F.min(F.col("_c14")).alias("CUI_Name"))
    )


SECTION_COLUMNS = (
    "clinical_presentation_section",
    "diagnostic_evaluation_section",
    "subtype_variant_section",
    "management_therapy_section",
)


def assemble_sections(*tables: DataFrame, columns: Sequence[str] = SECTION_COLUMNS) -> DataFrame:
    """Full outer join of section tables on ``disease_name``, done as one union and one aggregate.

    Table i holds ``disease_name`` and column i.  Where a table has several different sections of a disease, all are
    kept, one after the other in sorted order.
    """
    parts = None
    for table, own in zip(tables, columns, strict=True):
        part = table.select(
            "disease_name",
            *[(F.col(c) if c == own else F.lit(None).cast("string")).alias(c) for c in columns],
        )
        parts = part if parts is None else parts.unionByName(part)
    found = lambda c: F.array_sort(F.collect_set(c))
    return parts.groupBy("disease_name").agg(
        *[F.when(F.size(found(c)) > 0, F.array_join(found(c), "\n")).alias(c) for c in columns])


def build_document(sections: DataFrame, columns: Sequence[str] = SECTION_COLUMNS) -> DataFrame:
    """One text per disease: its name and its headed sections; a missing section is empty, a nameless row drops out."""
    heads = ["Clinical Presentation", "Diagnostic Evaluation", "Subtype Variant", "Management Therapy"]
    name = F.trim(F.coalesce(F.col("disease_name").cast("string"), F.lit("")))
    parts = [name]
    for head, c in zip(heads, columns, strict=True):
        parts += [F.lit(f"\n### {head}:\n"), F.coalesce(F.col(c), F.lit(""))]
    text = F.regexp_replace(F.concat(*parts), r"^\s+|\s+$", "")
    return sections.select(name.alias("disease_name"), text.alias("document")).filter(F.col("disease_name") != "")


def tag_concepts(
    docs: DataFrame,
    dictionary: DataFrame,
    keys: Sequence[str] = ("model", "disease"),
    text_col: str = "text",
    max_tokens: int = 512,
    longest: int | None = None,
) -> DataFrame:
    """Every dictionary concept found in every text, with chunk, span and sentence.

    ``dictionary``: term (lower-case words of letters and digits, separated by one blank), CUI, UMLS_name,
    semantic_type_name; one row per (term, CUI).  A term matches a run of words inside one sentence with nothing but
    blanks or hyphens between them; an exact match has similarity 1.0.  Runs have up to ``longest`` words, by default as
    many as the dictionary's longest term, which a small job looks up.  Texts with equal keys are documents of their own.

    Words travel with their sentence, so one branch of the plan names the documents.  A small job counts the dictionary: one of
    up to 500,000 terms is sent to the words, which then do not move; a larger one meets them by a shuffle.
    """
    spans = sentence_spans(docs, list(keys), text_col, max_tokens)
    runs = word_grams(spans.drop("n_tokens"), longest or words_of_longest(dictionary))
    found = runs.join(F.broadcast(dictionary) if few(dictionary) else dictionary, "term").drop("term")
    return each_copy(found.withColumns({"similarity": F.lit(1.0), "matched_text": matched_text()}))


def matched_text() -> Column:
    """The part of the sentence that a mention covers."""
    return F.col("sentence").substr(F.col("start_char") - F.col("sentence_start") + 1, F.col("end_char") - F.col("start_char"))


def chunk_sentences(
    docs: DataFrame, keys: Sequence[str] = ("disease",), text_col: str = "text", max_tokens: int = 512
) -> DataFrame:
    """Greedy packing of sentences into chunks of at most ``max_tokens`` words, with character offsets.

    A sentence longer than the limit is a chunk of its own.  Offsets refer to the original text.  Texts with equal keys
    are packed apart.
    """
    keys = list(keys)
    spans = sentence_spans(docs, keys, text_col, max_tokens)
    chunks = spans.groupBy(*keys, DOC, COPIES, "chunk_index").agg(
        F.min("sentence_start").alias("start_char"),
        F.max("sentence_end").alias("end_char"),
        F.count("*").alias("n_sentences"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    return each_copy(chunks)


def chunk_texts(docs: DataFrame, chunks: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """Chunk bounds with the text they cover."""
    text = F.col(text_col).substr(F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return chunks.join(docs.select(*keys, text_col), list(keys)).withColumn("chunk_text", text).drop(text_col)


def label_types(rows: DataFrame, type_map: DataFrame, sep: str = "| ") -> DataFrame:
    """Semantic type ids to names: an unknown id stays as it is; order kept; joined by ``sep``.

    ``rows`` holds ``semantic_type`` array<string>; ``type_map`` TUI, Type_name (one name per id).  Names are looked
    up once per distinct id list, which is far fewer than the rows, and joined back by the list.
    """
    lists = rows.select("semantic_type").distinct()
    ids = lists.select("semantic_type", F.posexplode("semantic_type").alias("pos", "TUI"))
    named = (
        ids.join(type_map.select("TUI", "Type_name"), "TUI", "left")
        .groupBy("semantic_type")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("Type_name", "TUI").alias("name")))).alias("parts"))
        .select("semantic_type", F.array_join(F.col("parts.name"), sep).alias("semantic_type_name"))
    )
    return rows.join(named, "semantic_type", "left").select(*rows.columns, "semantic_type_name")


def disease_universe(
    names: DataFrame, base: DataFrame, overrides: DataFrame
) -> DataFrame:
    """Distinct disease names joined to their category rows; override rows replace base rows of the same name."""
    kept = base.join(overrides.select("rare_disease_name").distinct(), "rare_disease_name", "left_anti")
    categories = kept.unionByName(overrides).distinct()
    return names.select("rare_disease_name").distinct().join(categories, "rare_disease_name")


def assign_ids(rows: DataFrame, order: Sequence[str], name: str = "patient_id", buckets: int | None = None) -> DataFrame:
    """Sequential number 1..n over an ordering, without ever sorting everything in one task.

    Rows are range-partitioned and sorted once; a row's number inside its partition is offset by the sizes of the
    partitions before it, a table of one row per partition.  Both read the same sorted table, and its order is total
    (``order`` must be; add a key column to break ties), so a partition that is computed again has the same numbers.
    """
    order = list(order)
    parts = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # partition number and position, in one column
    ranged = (
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    )
    part, position = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + position + 1).cast("long"))
        .drop("_part", "_at", "_offset")
    )


def concept_count_stats(patients: DataFrame, list_col: str = "phenotype_umls_cuis") -> DataFrame:
    """Concepts per patient (size of the comma list): mean, deviation, median per data set and overall."""
    counted = patients.select(
        F.explode(F.array(F.col("dataset"), F.lit("overall"))).alias("dataset"),
        F.size(F.split(list_col, ",")).alias("n"),
    )
    return counted.groupBy("dataset").agg(
        F.count("*").alias("patients"),
        F.round(F.avg("n"), 6).alias("mean_concepts"),
        F.round(F.stddev("n"), 6).alias("std_concepts"),
        F.percentile_approx("n", 0.5, 10000).alias("median_concepts"),
    )
