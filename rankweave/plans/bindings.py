"""Canonical tables derived by Spark from the driver tables.  Every binding reads its whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.functions.text import words
from rankweave.operators.vocabulary import TARGET_TYPES

MODELS = ("m0", "m1", "m2", "m3")
LANGS = ("de", "en", "es", "fr")
# Types by word length; the first three lengths fall outside the target types.
TYPES = ("Quantitative Concept", "Temporal Concept", "Geographic Area", *TARGET_TYPES, "Daily or Recreational Activity")
TITLES = (
    "Overview", "Presentation", "Diagnosis", "Subtypes", "Management", "Genetics", "Epidemiology", "Prognosis",
    "Monitoring", "References",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str, rows: int = 250_000) -> int:
    """Partitions for what has a row per row of the table, so that each gets about ``rows``; counted in the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // rows))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, dealt out evenly: a file of a single row group is one scan task, however long its texts are."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "text").hint("rebalance")


# ---------------------------------------------------------------- text: documents and benchmark


def mentions(spark: SparkSession, sf_dir: str, clustered: bool = False) -> DataFrame:
    """One mention per word of every document: knowledge source = language, disease = document.

    With ``clustered`` the texts are dealt out by (model, disease), which the mentions inherit: what groups them so moves nothing.
    """
    ws = docs(spark, sf_dir, clustered).select("model", "disease", words(F.col("text")).alias("ws"))
    # the word before comes from the shifted array, so no array travels with the exploded rows
    shifted = F.concat(F.array(F.lit("")), F.col("ws"))
    rows = ws.select("model", "disease", F.posexplode(F.arrays_zip("ws", shifted.alias("before"))).alias("i", "w")).filter(
        F.col("w.ws").isNotNull()
    )
    word, before = F.col("w.ws"), F.col("w.before")
    types = F.array(*[F.lit(t) for t in TYPES])
    size = F.length(word)
    # by length, as constants: rounding and a regular expression for each word would cost more than all the rest
    similarity = F.element_at(F.array(*[F.round(1 - 0.6 / F.lit(n), 4) for n in range(1, 65)]), F.least(size, F.lit(64)))
    second = F.when(
        F.right(word, F.lit(1)).isin(*"aeiou"), F.concat(F.lit("| "), F.element_at(types, F.least(size + 7, F.lit(len(TYPES)))))
    ).otherwise("")
    return rows.select(
        "model",
        "disease",
        F.expr("i div 512").cast("int").alias("chunk_index"),
        F.when(before.isin("no", "not", "without"), F.concat_ws(" ", before, word)).otherwise(word).alias("UMLS_name"),
        F.concat(F.lit("C_"), word).alias("CUI"),
        F.when(size <= 64, similarity).otherwise(F.round(1 - 0.6 / size, 4)).alias("similarity"),
        F.concat(F.element_at(types, F.least(size, F.lit(len(TYPES)))), second).alias("semantic_type_name"),
    )


def text_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as patients; the concept list is the item's words."""
    return table(spark, sf_dir, "benchmark").select(
        F.when(F.length("text") > 200, "pubmed").otherwise("hms").alias("dataset"),
        F.col("item_id").cast("string").alias("patient_id"),
        F.array_join(F.transform(words(F.col("text")), lambda w: F.concat(F.lit("C_"), w)), ", ").alias(
            "phenotype_umls_cuis"
        ),
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and adjacent word pairs of the benchmark items as dictionary terms."""
    ws = table(spark, sf_dir, "benchmark").select(words(F.col("text")).alias("ws"))
    pairs = F.zip_with(
        F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))),
        F.slice("ws", 2, F.size("ws")),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    terms = ws.select(F.explode(F.concat("ws", pairs)).alias("term")).distinct()
    return terms.select(
        "term",
        F.concat(F.lit("C_"), F.translate("term", " ", "_")).alias("CUI"),
        F.col("term").alias("UMLS_name"),
        F.when(F.col("term").contains(" "), "Finding").otherwise("Sign or Symptom").alias("semantic_type_name"),
    )


def docs(spark: SparkSession, sf_dir: str, clustered: bool = False) -> DataFrame:
    """Documents; with ``clustered`` dealt out by (model, disease), so what groups them so moves no text again."""
    named = [F.col("lang").alias("model"), F.col("doc_id").cast("string").alias("disease"), "text"]
    return table(spark, sf_dir, "documents").select(*named).repartition("model", "disease") if clustered else texts(spark, sf_dir).select(*named)


# The trigger phrases of the made-up texts: frequent words of their four languages, in all kinds of the default rules.
TEXT_RULES = (
    ("no", "NEGATED_EXISTENCE", "forward"), ("nicht", "NEGATED_EXISTENCE", "forward"), ("pas", "NEGATED_EXISTENCE", "backward"),
    ("was", "HISTORICAL", "forward"), ("von der", "HISTORICAL", "backward"), ("or", "HYPOTHETICAL", "both"), ("que", "HYPOTHETICAL", "forward"),
    ("of the", "FAMILY", "forward"), ("of", "FAMILY", "backward"), ("de la", "FAMILY", "both"), ("de la", "HISTORICAL", "forward"),
    ("and", None, "end"), ("und", None, "end"), ("et", None, "end"), ("is that", None, "end"), ("that was", None, "pseudo"), ("of the and", None, "pseudo"),
)


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown summaries: a numbered heading before each of the first ten lines, dialect by language."""
    titles = F.array(*[F.lit(t) for t in TITLES])

    def head(i: Column) -> Column:
        n, t = (i + 1).cast("string"), F.element_at(titles, i + 1)
        return (
            F.when(F.col("lang") == "en", F.concat(F.lit("## "), n, F.lit(". "), t))
            .when(F.col("lang") == "fr", F.concat(F.lit("**"), n, F.lit(" "), t, F.lit("**")))
            .when(F.col("lang") == "de", F.concat(F.lit("### **"), n, F.lit(". "), t, F.lit("**")))
            .otherwise(F.concat(n, F.lit(" "), t))
        )

    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.when(i < 10, F.concat(head(i), F.lit("\n"), line)).otherwise(line)
    )
    return texts(spark, sf_dir).select(
        F.col("lang").alias("model"), F.col("doc_id").cast("string").alias("disease"), F.array_join(lines, "\n").alias("summary")
    )


def section_tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Four section tables keyed by number: documents, pages, benchmark items, whole conversations turn by turn."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("text"))
    sources = [
        (table(spark, sf_dir, "documents"), "doc_id", "text", "clinical_presentation_section"),
        (table(spark, sf_dir, "pages"), "page_id", "html", "diagnostic_evaluation_section"),
        (table(spark, sf_dir, "benchmark"), "item_id", "text", "subtype_variant_section"),
        (last, "conv_id", "text", "management_therapy_section"),
    ]
    return [df.select(F.col(k).cast("string").alias("disease_name"), F.col(t).alias(name)) for df, k, t, name in sources]


# ---------------------------------------------------------------- vectors: embeddings


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models, each seeing a quarter of the dimensions; the data set follows the signs of the first two values."""
    first, second = F.get("embedding", F.lit(0)), F.get("embedding", F.lit(1))
    width = F.ceil(F.size("embedding") / 4).cast("int")  # the last model has what is left
    slices = F.array(*[F.slice("embedding", width * m + 1, width) for m in range(4)])
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.when(first >= 0, "pubmed").when(second >= 0, "hms").otherwise("mme").alias("dataset"),
            F.col("vec_id").cast("string").alias("patient_id"),
            F.concat(F.lit("Disease "), F.col("label")).alias("rare_disease_name"),
            F.posexplode(slices).alias("m", "vector"),
        )
        .withColumn("model", F.concat(F.lit("m"), F.col("m")))
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge base: one mean vector per (model, disease)."""
    values = vectors(spark, sf_dir).select("model", "rare_disease_name", F.posexplode("vector").alias("p", "v"))
    means = values.groupBy("model", "rare_disease_name", "p").agg(F.avg(F.col("v").cast("double")).alias("a"))
    return means.groupBy("model", F.col("rare_disease_name").alias("disease")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("p", "a"))), lambda x: x["a"]).alias("vector")
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("dataset", "patient_id", "rare_disease_name").distinct()


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of classes per disease, from the number of its vectors."""
    n = (F.count("*") % 13 + 1).cast("int")
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.concat(F.lit("Disease "), F.col("label")).alias("rare_disease_name"))
        .agg(n.alias("num_true_classifications"))
        .withColumn("final_classification_string", F.concat(F.lit("class "), F.col("num_true_classifications")))
    )


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, dataset, patient, disease, CUI): the positions of the values in a vector's upper part as concepts.

    Which positions a vector has is the binding's own definition of a patient's concepts, as a text's words are; every
    vector takes part.
    """
    rows = vectors(spark, sf_dir).select(
        "model", "dataset", "patient_id", "rare_disease_name", "m", F.posexplode("vector").alias("p", "v")
    )
    return rows.filter(F.col("v") > 0.15).select(
        "model", "dataset", "patient_id", F.col("rare_disease_name").alias("disease"),
        F.concat(F.lit("P"), F.col("m") * 16 + F.col("p")).alias("CUI"),
    )


def position_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir).select(
        "model", "disease", "CUI", F.concat(F.lit("position "), F.col("CUI")).alias("UMLS_name"),
        F.lit("Finding").alias("semantic_type_name"),
    )


def position_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _active(spark, sf_dir).select("dataset", "patient_id", "CUI").distinct()


# ---------------------------------------------------------------- notes: events and orders


def severity_band(value: Column) -> Column:
    return F.when(value < 20, "unknown").when(value < 60, "mild").when(value < 120, "moderate").otherwise("severe")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as note mentions."""
    value = F.col("value")
    flag = F.when(value < 2, "NEGATED_EXISTENCE").when(value < 4, "HISTORICAL").when(value >= 6, "AFFIRMED")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("person_id"), F.col("event_id").alias("note_id"), F.col("ts").alias("note_date"),
        F.col("event_type").alias("CUI"), F.col("event_type").alias("umls_name"),
        severity_band(value).alias("severity"), flag.alias("context_flag"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, group, dx_date): group by mean value, diagnosis ten days after the first error event."""
    first = F.min(F.when(F.col("event_type") == "error", F.col("ts")))
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("person_id"))
        .agg(
            F.when(F.avg("value") > 50, "case").otherwise("control").alias("group"),
            (F.date_trunc("day", first).cast("timestamp_ntz") + F.expr("INTERVAL 10 DAYS")).alias("dx_date"),
        )
    )


def model_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept sets per model: event types with a large value in that hour of the day."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("value") > 250)
        .select(F.concat(F.lit("h"), F.hour("ts")).alias("model"), F.col("event_type").alias("CUI"))
        .distinct()
    )


def order_notes(spark: SparkSession, sf_dir: str, symptom: str) -> DataFrame:
    """Order lines as dense notes: person = customer, symptom = a part attribute, date = order date."""
    dealt = parts(spark, sf_dir, "lineitem")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").repartition(dealt, "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition(dealt, "o_orderkey")
    kinds = table(spark, sf_dir, "part").select("p_partkey", F.col(symptom).alias("umls_name"))
    quantity = F.col("l_quantity")
    return (
        lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        .join(kinds, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("note_id"),
            F.col("o_orderdate").alias("note_date"), F.col("umls_name").alias("CUI"), "umls_name",
            F.when(quantity < 10, "unknown").when(quantity < 25, "mild").when(quantity < 40, "moderate")
            .otherwise("severe").alias("severity"),
        )
    )


# ---------------------------------------------------------------- responses: events, pages, conversations


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model responses with a token usage JSON; a tiny value gives a text where a number belongs."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.floor(F.col("value") * 10)
    shown = F.when(F.col("value") < 1, F.lit('"n/a"')).otherwise(out.cast("string"))
    text = F.concat(
        F.lit('{"input_tokens": '), (k * 3000).cast("string"), F.lit(', "output_tokens": '), shown,
        F.lit(', "input_tokens_details": {"cached_tokens": '), (k * 700).cast("string"),
        F.lit('}, "output_tokens_details": {"reasoning_tokens": '), F.floor(F.col("value") * 3).cast("string"), F.lit("}}"),
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), F.col("user_id").cast("string").alias("disease_name"), text.alias("usage"),
        F.col("value").cast("string").alias("total_running_time"), (k * 3000).alias("input_tokens"), out.alias("output_tokens"),
    )


def usage_json(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """(model, usage): events as responses whose usage JSON has one of the provider layouts; a tiny value is no number."""
    k = F.get_json_object("props", "$.k").cast("bigint") * 3000
    shown = F.when(F.col("value") < 1, F.lit('"n/a"')).otherwise(F.floor(F.col("value") * 10).cast("string"))
    reasoning = F.floor(F.col("value") * 3).cast("string")
    pieces = {
        "input_output": ('{"input_tokens": ', k, ', "output_tokens": ', shown, ', "output_tokens_details": {"reasoning_tokens": ', reasoning, "}}"),
        "prompt_completion": ('{"completion_tokens": ', shown, ', "prompt_tokens": ', k, ', "completion_tokens_details": {"reasoning_tokens": ', reasoning, "}}"),
        "server_tools": ('{"input_tokens": ', k, ', "output_tokens": ', shown, ', "server_tool_use": {"web_search_requests": ', reasoning, "}}"),
        "metadata": ('{"prompt_token_count": ', k, ', "candidates_token_count": ', shown, ', "thoughts_token_count": ', reasoning, "}"),
    }[layout]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in pieces])
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), text.alias("usage"))


RESULTS = "array<struct<title:string,type:string,url:string,encrypted_content:string>>"
HREF = r'<a\b[^>]*?\bhref="([^"]*)"[^>]*>([^<]*)</a>'  # whatever other attributes the anchor has


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their anchors rewritten as markdown links on the page's own host."""
    host = F.concat(F.lit("http://"), F.regexp_extract("url", "https?://([^/]+)", 1))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("disease_name"),
        F.regexp_replace(F.col("html"), F.lit(HREF), F.concat(F.lit("[$2]("), host, F.lit("$1)"))).alias("disease_text"),
    )


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors of a page as JSON text in the two provider layouts."""
    host = F.concat(F.lit("http://"), F.regexp_extract("url", "https?://([^/]+)", 1))
    links = F.zip_with(
        F.regexp_extract_all("html", F.lit(HREF), 1),
        F.regexp_extract_all("html", F.lit(HREF), 2),
        lambda href, label: F.struct(label.alias("title"), F.lit("web_search_result").alias("type"), href.alias("href")),
    )
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("disease_name"), host.alias("host"), links.alias("links")
    )
    url = lambda x: F.concat(F.col("host"), x["href"])
    triples = F.transform("links", lambda x: F.struct(x["title"].alias("title"), x["type"].alias("type"), url(x).alias("url")))
    chunks = F.transform(
        "links", lambda x: F.struct(F.struct(url(x).alias("uri"), x["title"].alias("title")).alias("web"))
    )
    grounding = F.array(F.struct(F.struct(chunks.alias("grounding_chunks")).alias("grounding_metadata")))
    return rows.select("disease_name", F.to_json(triples).alias("content"), F.to_json(grounding).alias("candidates"))


def _sentences(text: str) -> Column:
    return F.filter(F.transform(F.split(text, r"[.\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def search_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as responses; the sentences are the search queries, in the three provider layouts."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("disease_name"), _sentences("text").alias("s")
    )
    blocks = F.transform(
        "s",
        lambda q: F.struct(
            F.lit("server_tool_use").alias("type"), F.lit("web_search").alias("name"), F.struct(q.alias("query")).alias("input")
        ),
    )
    events = F.transform(
        "s", lambda q: F.struct(F.lit("web_search_call").alias("type"), F.struct(q.alias("query")).alias("action"))
    )
    grounding = F.struct(F.struct(F.col("s").alias("web_search_queries")).alias("grounding_metadata"))
    return rows.select(
        "disease_name", F.to_json(blocks).alias("content"), F.to_json(events).alias("output"),
        F.to_json(grounding).alias("candidates"),
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as whole JSON answers: the provider layout follows the role."""
    rows = table(spark, sf_dir, "conversations").select(
        "role", F.concat_ws("-", "conv_id", "turn").alias("disease_name"), "text", _sentences("text").alias("s")
    )
    result = F.struct(
        F.lit("t").alias("title"), F.lit("web_search_result").alias("type"), F.lit("http://a.org").alias("url"),
        F.lit("xyz").alias("encrypted_content"),
    )
    block = lambda q: F.struct(
        F.lit("text").alias("type"), q.alias("text"), F.lit(None).cast(RESULTS).alias("content")
    )
    search = F.struct(
        F.lit("web_search_tool_result").alias("type"), F.lit(None).cast("string").alias("text"), F.array(result).alias("content")
    )
    blocks = F.struct(F.col("disease_name").alias("id"), F.concat(F.transform("s", block), F.array(search)).alias("content"))
    messages = F.array(F.struct(F.lit("message").alias("type"), F.array(
        F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"))).alias("content")))
    output = F.struct(F.col("disease_name").alias("id"), messages.alias("output"))
    choices = F.struct(F.col("disease_name").alias("id"), F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    answer = F.when(F.col("role") == "assistant", F.to_json(blocks)).when(F.col("role") == "user", F.to_json(output)).otherwise(F.to_json(choices))
    return rows.select(F.col("role").alias("model"), "disease_name", answer.alias("response"))

