from pyspark.sql import functions as F

from rankweave.functions import text as t
from rankweave.operators import readability
from rankweave.operators.concepts import chunk_sentences, chunk_texts, tag_concepts


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("r")).first()["r"]


def test_norm_name(spark):
    assert one(spark, t.norm_name, "  Crohn’s  Disease (type-2) ") == "crohn s disease type 2"
    assert one(spark, t.norm_name, None) == ""


def test_norm_id(spark):
    assert one(spark, t.norm_id, " 12.0 ") == "12"
    assert one(spark, t.norm_id, "P-7.05") == "P-7.05"


def test_first_nonempty(spark):
    df = spark.createDataFrame([(None, "  ", "x"), ("a", "b", "c"), (None, None, None)], "a string, b string, c string")
    got = [r[0] for r in df.select(t.first_nonempty([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got == ["x", "a", ""]


def test_safe_name(spark):
    assert one(spark, t.safe_name, "/a b:c.d/") == "a_b_c.d"


def test_clean_markdown(spark):
    assert one(spark, t.clean_markdown, "## **Head** body **b** end ") == "body  end"


def test_remove_links(spark):
    text = "See [site](https://a.org/x) and https://b.org/y now (a.org, sub.b-c.net) but (not this)."
    assert one(spark, t.remove_links, text) == "See site and  now  but (not this)."


def test_smog(spark):
    text = "Banana potato. Elephant runs! Cat sat? Go\nYes"
    df = spark.createDataFrame([("m", text), ("m", "Short. Text")], "model string, text string")
    rows = {r["text"]: r for r in readability.smog(df).collect()}
    assert rows[text]["sentences"] == 5
    assert rows[text]["polysyllables"] == 3
    assert rows[text]["smog"] == round(1.043 * (30 * 3 / 5) ** 0.5 + 3.1291, 2)
    assert rows["Short. Text"]["smog"] == 0.0
    assert readability.smog_by_model(readability.smog(df)).first()["texts"] == 2


def test_extract_sections_dialects(spark):
    texts = [
        ("a", "intro\n## 1. Overview\nfirst\n\n## 2. Genetics\nsecond line\nthird"),
        ("b", "**1 Overview**\nfirst\n**2 Genetics**\nsecond"),
        ("c", "### **1. Overview**\nfirst\n### **2. Genetics**\nsecond"),
        ("d", "1 Overview\nfirst\n2 Genetics\nsecond. 3 cats sat\n10 References\nlast"),
        ("e", "no headings here"),
    ]
    rows = readability.extract_sections(spark.createDataFrame(texts, "disease string, summary string")).collect()
    got = {(r["disease"], r["section_no"]): (r["title"], r["body"]) for r in rows}
    assert got[("a", 1)] == ("Overview", "first") and got[("a", 2)] == ("Genetics", "second line\nthird")
    for d in "bc":
        assert got[(d, 1)] == ("Overview", "first") and got[(d, 2)] == ("Genetics", "second")
    assert got[("d", 2)] == ("Genetics", "second. 3 cats sat") and got[("d", 10)] == ("References", "last")
    assert not any(k[0] == "e" for k in got)


def test_extract_sections_loses_no_text(spark):
    long = "A title of many letters " * 8
    texts = [
        ("colon", "## 1. Genetics: causes?\nfirst\n## 2. " + long + "\nsecond"),
        ("list", "## 1. Plan\n1. Assess the patient\n2. Treat\n## 2. Next\n1. Assess\n2. Treat"),
        ("control", "## 1. One\na\u001eb\u001fc\n## 2. Two\nx"),
        ("bare", "1 One\na\n1 Again\nb\n2 Two: more\n3 It ends. So no title\nc"),
        ("empty", ""), ("none", None),
    ]
    rows = readability.extract_sections(spark.createDataFrame(texts, "disease string, summary string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["disease"], []).append((r["section_no"], r["title"], r["body"]))
    assert got["colon"] == [(1, "Genetics: causes?", "first"), (2, long.strip(), "second")]
    assert got["list"] == [(1, "Plan", "1. Assess the patient\n2. Treat"), (2, "Next", "1. Assess\n2. Treat")]
    assert got["control"] == [(1, "One", "a\u001eb\u001fc"), (2, "Two", "x")]
    assert got["bare"] == [(1, "One", "a\n1 Again\nb"), (2, "Two: more", "3 It ends. So no title\nc")]
    assert got.keys() == {"colon", "list", "control", "bare"}


DICTIONARY = [
    ("fever", "C1", "Fever", "Sign or Symptom"),
    ("high fever", "C2", "High fever", "Finding"),
    ("cough", "C3", "Cough", "Sign or Symptom"),
]


def test_tag_concepts(spark):
    text = "No high Fever today.  Dry cough, fever! High\nfever"
    docs = spark.createDataFrame([("m", "d1", text), ("m", "d2", None), ("m", "d3", "")], "model string, disease string, text string")
    dictionary = spark.createDataFrame(DICTIONARY, "term string, CUI string, UMLS_name string, semantic_type_name string")
    rows = tag_concepts(docs, dictionary).collect()
    got = sorted((r["start_char"], r["CUI"], r["matched_text"], r["sentence_no"]) for r in rows)
    assert got == [(3, "C2", "high Fever", 0), (8, "C1", "Fever", 0), (26, "C3", "cough", 1), (33, "C1", "fever", 1), (45, "C1", "fever", 3)]
    for r in rows:
        assert text[r["start_char"] : r["end_char"]] == r["matched_text"]
        assert text[r["sentence_start"] : r["sentence_end"]] == r["sentence"]
        assert r["similarity"] == 1.0


def test_chunk_sentences(spark):
    text = "a b c. d e. f g h i j k l. m."
    docs = spark.createDataFrame([("d", text)], "disease string, text string")
    chunks = chunk_sentences(docs, ["disease"], max_tokens=5)
    got = [tuple(r) for r in chunk_texts(docs, chunks, ["disease"]).orderBy("chunk_index").select("chunk_index", "n_tokens", "chunk_text").collect()]
    assert got == [(0, 5, "a b c. d e."), (1, 7, "f g h i j k l."), (2, 1, "m.")]


def test_tags_digits_hyphens_long_terms_and_letters(spark):
    texts = [("a", "Type 2 diabetes and COVID-19."), ("b", "Acute on chronic heart failure"), ("c", "Heart, failure to thrive"),
             ("d", "\u0130zmir Fever and Cough."), ("d", "fever")]
    docs = spark.createDataFrame([("m", *t) for t in texts], "model string, disease string, text string")
    terms = ["type 2 diabetes", "type diabetes", "covid 19", "acute on chronic heart failure", "heart failure", "fever", "cough"]
    dictionary = spark.createDataFrame([(t, t, t, "Finding") for t in terms], "term string, CUI string, UMLS_name string, semantic_type_name string")
    rows = tag_concepts(docs, dictionary).collect()
    got = sorted((r["disease"], r["CUI"], r["matched_text"]) for r in rows)
    assert got == [
        ("a", "covid 19", "COVID-19"), ("a", "type 2 diabetes", "Type 2 diabetes"),
        ("b", "acute on chronic heart failure", "Acute on chronic heart failure"), ("b", "heart failure", "heart failure"),
        ("d", "cough", "Cough"), ("d", "fever", "Fever"), ("d", "fever", "fever")]


def test_chunks_of_texts_with_one_key_stay_apart(spark):
    docs = spark.createDataFrame([("d", "a b. c d."), ("d", "e f g.")], "disease string, text string")
    got = sorted((r["start_char"], r["end_char"], r["n_tokens"]) for r in chunk_sentences(docs, ["disease"], max_tokens=9).collect())
    assert got == [(0, 6, 3), (0, 9, 4)]
