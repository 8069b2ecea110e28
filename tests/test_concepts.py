from pyspark.sql import functions as F

from rankweave.operators import concepts as c

MENTION = "model string, disease string, chunk_index int, UMLS_name string, CUI string, similarity double, semantic_type_name string"
ROWS = [
    ("a", "d1", 0, "Cough", "C1", 0.8, "Finding"),
    ("a", "d1", 0, "Dry cough", "C1", 0.9, "Temporal Concept| Sign or Symptom"),
    ("a", "d1", 0, "No fever", "C2", 0.95, "Finding"),
    ("a", "d2", 1, "Weak", "C3", 0.79, "Finding"),
    ("a", "d2", 1, "Gene X", "C4", 1.0, "Gene or Genome| Enzyme"),
    ("b", "d1", 0, "Cough", "C1", 1.0, "Finding"),
    ("b", "d3", 0, "Clock", "C5", 1.0, "Temporal Concept"),
]


def mentions(spark):
    return spark.createDataFrame(ROWS, MENTION)


def test_concept_filter(spark):
    kept = c.concept_filter(mentions(spark))
    assert sorted((r["model"], r["UMLS_name"]) for r in kept.collect()) == [
        ("a", "Cough"), ("a", "Dry cough"), ("a", "Gene X"), ("b", "Cough")]
    untrimmed = c.concept_filter(mentions(spark), trim=False)
    assert "Dry cough" not in [r["UMLS_name"] for r in untrimmed.collect()]


def test_blocklist_filter(spark):
    rows = c.blocklist_filter(mentions(spark), min_sim=0.8, blocked_names=("No fever",))
    assert sorted((r["model"], r["UMLS_name"]) for r in rows.collect()) == [("a", "Cough"), ("b", "Cough")]
    assert {tuple(r) for r in c.names_per_type(rows).collect()} == {("a", "Finding", 1), ("b", "Finding", 1)}


def test_context_filter_null_flag(spark):
    notes = spark.createDataFrame(
        [(1, "C1", None), (2, "C1", "NEGATED_EXISTENCE"), (3, "C1", "OK"), (4, "C9", "OK")], "person_id int, CUI string, context_flag string")
    concepts = spark.createDataFrame([("a", "C1"), ("b", "C1"), ("a", "C1")], "model string, CUI string")
    got = sorted((r["person_id"], r["model"]) for r in c.context_filter(notes, concepts).collect())
    assert got == [(3, "a"), (3, "b")]
    kept = c.context_filter(notes, concepts, keep_null=True)
    assert kept.count() == 4


def test_group_coverage_and_matrix(spark):
    grouped = c.grouped_concepts(mentions(spark))
    cover = {(r["group_name"], r["model"]): (r["distinct_cuis"], r["distinct_diseases"]) for r in c.semantic_group_coverage(grouped).collect()}
    assert cover == {("Symptoms & Conditions", "a"): (1, 1), ("Genetics & Molecular", "a"): (1, 1), ("Symptoms & Conditions", "b"): (1, 1)}
    matrix = {r["semantic_type"]: (r["a"], r["b"]) for r in c.type_matrix(mentions(spark), ["a", "b"]).collect()}
    assert matrix["Finding"] == (1, 1) and matrix["Enzyme"] == (1, 0) and matrix["Temporal Concept"] == (1, 1)
    stats = {(r["model"], r["group_name"]): (r["n_diseases"], r["mean_cuis"], r["std_cuis"]) for r in c.concepts_per_disease(grouped).collect()}
    assert stats[("b", "Symptoms & Conditions")] == (1, 1.0, None)


def test_pairwise_jaccard(spark):
    rows = spark.createDataFrame(
        [("g", "x", 1), ("g", "x", 2), ("g", "y", 2), ("g", "y", 3), ("g", "z", 9), ("g", "x", 2)], "grp string, model string, item int")
    matrix = c.pairwise_jaccard(rows, "model", "item", "grp")
    got = {(r["set_1"], r["set_2"]): r["jaccard"] for r in matrix.collect()}
    assert len(got) == 9 and got[("x", "x")] == 1.0 and got[("x", "z")] == 0.0
    assert got[("x", "y")] == got[("y", "x")] == 1 / 3
    summary = c.jaccard_summary(matrix, "grp").first()
    assert summary["mean_jaccard"] == round((1 / 3) * 2 / 6, 6)
    assert c.jaccard_pair_means(matrix).count() == 3


def test_membership_overlap(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "b"), (3, "a"), (3, "b")], "item int, model string")
    assert {tuple(r["members"]): r["n_items"] for r in c.membership_overlap(rows, ["item"], "model").collect()} == {("a", "b"): 2, ("b",): 1}


def test_terminology_map(spark):
    names = ["_c0", "_c11", "_c12", "_c13", "_c14"]
    rows = [("C1", "MSH", "PT", "D1", "beta"), ("C1", "MSH", "PT", "D1", "alpha"), ("C1", "MSH", "SY", "D1", "x"), ("C2", "OTHER", "PT", "D2", "y")]
    got = c.terminology_map(spark.createDataFrame(rows, names)).collect()
    assert [r.asDict() for r in got] == [{"CUI": "C1", "CODE": "D1", "SAB": "MSH", "TTY": "PT", "CUI_Name": "alpha"}]


def test_sections_and_document(spark):
    t = [spark.createDataFrame(rows, f"disease_name string, {col} string") for rows, col in zip(
        ([("A", "ca")], [("A", "da"), ("B", "db")], [("C", "sc")], [("B", None)]), c.SECTION_COLUMNS)]
    rows = {r["disease_name"]: r for r in c.assemble_sections(*t).collect()}
    assert set(rows) == {"A", "B", "C"} and rows["A"]["diagnostic_evaluation_section"] == "da" and rows["B"]["management_therapy_section"] is None
    docs = {r["disease_name"]: r["document"] for r in c.build_document(c.assemble_sections(*t)).collect()}
    assert docs["A"].startswith("A\n### Clinical Presentation:\nca\n### Diagnostic Evaluation:\nda") and docs["A"].endswith("### Management Therapy:")


def test_label_types_unknown_and_order(spark):
    rows = spark.createDataFrame([(1, ["T2", "T9", "T1"])], "id int, semantic_type array<string>")
    names = spark.createDataFrame([("T1", "one"), ("T2", "two")], "TUI string, Type_name string")
    assert c.label_types(rows, names).first()["semantic_type_name"] == "two| T9| one"


def test_disease_universe(spark):
    names = spark.createDataFrame([("A",), ("B",), ("A",), ("Z",)], "rare_disease_name string")
    base = spark.createDataFrame([("A", "1"), ("B", "2")], "rare_disease_name string, code string")
    over = spark.createDataFrame([("B", "9")], "rare_disease_name string, code string")
    assert {tuple(r) for r in c.disease_universe(names, base, over).collect()} == {("A", "1"), ("B", "9")}


def test_assign_ids_is_dense_and_ordered(spark):
    # a third of the rows share one order value; the key breaks the ties
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("v"))
    got = c.assign_ids(rows, ["v", "id"], "n", buckets=5).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 3001))
    keys = [(r["v"], r["id"]) for r in got]
    assert keys == sorted(keys)


def test_concept_count_stats(spark):
    patients = spark.createDataFrame([("p", "1", "a, b, c"), ("p", "2", "a"), ("h", "3", "a,b")], "dataset string, patient_id string, phenotype_umls_cuis string")
    got = {r["dataset"]: (r["patients"], r["mean_concepts"]) for r in c.concept_count_stats(patients).collect()}
    assert got == {"p": (2, 2.0), "h": (1, 2.0), "overall": (3, 2.0)}
