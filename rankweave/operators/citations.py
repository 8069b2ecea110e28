"""Citations in responses: extraction, counts per disease, top sites."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import domain
from rankweave.operators.vocabulary import SITE_CATEGORIES

# --- fixed values: patterns of a markdown link and of a title / type / url triple in JSON text ---
LINK = r"\[([^\]]+)\]\((https?://[^\s)]+)"
TRIPLE = r'"title"\s*:\s*"([^"]+)"[^}]*?"type"\s*:\s*"([^"]+)"[^}]*?"url"\s*:\s*"([^"]+)"'
_CHUNKS = (
    "array<struct<grounding_metadata:struct<grounding_chunks:array<struct<web:struct<uri:string,title:string>>>>>>"
)
OUT = ["disease_name", "label", "url", "domain"]


def markdown_citations(responses: DataFrame, text_col: str = "disease_text") -> DataFrame:
    """(disease_name, label, url, domain) of every markdown link in the text, duplicates kept."""
    found = F.arrays_zip(
        F.regexp_extract_all(text_col, F.lit(LINK), 1).alias("label"),
        F.regexp_extract_all(text_col, F.lit(LINK), 2).alias("url"),
    )
    return (
        responses.filter(F.col(text_col).contains("](http"))
        .select("disease_name", F.inline(found).alias("label", "url"))
        .withColumn("domain", domain(F.col("url")))
        .select(*OUT)
    )


def grounding_citations(responses: DataFrame, json_col: str = "candidates") -> DataFrame:
    """Web chunks of the first candidate of a nested JSON answer; the title names the site."""
    first = F.get(F.from_json(json_col, _CHUNKS), F.lit(0))["grounding_metadata"]["grounding_chunks"]
    return (
        responses.select("disease_name", F.explode(first).alias("c"))
        .select("disease_name", F.col("c.web.title").alias("label"), F.col("c.web.uri").alias("url"))
        .filter(F.col("url").isNotNull())
        .withColumn("domain", domain(F.col("url")))
        .select(*OUT)
    )


def triple_citations(responses: DataFrame, json_col: str = "content") -> DataFrame:
    """Distinct title / type / url triples inside JSON text."""
    part = lambda i: F.regexp_extract_all(json_col, F.lit(TRIPLE), i)
    return (
        responses.select("disease_name", F.inline(F.arrays_zip(part(1), part(2), part(3))).alias("label", "type", "url"))
        .distinct()
        .withColumn("domain", domain(F.col("url")))
        .select(*OUT, "type")
    )


def citations_per_disease(citations: DataFrame) -> DataFrame:
    """Citations of each disease."""
    return citations.groupBy("disease_name").agg(F.count("*").alias("citation_count"))


def citation_stats(citations: DataFrame) -> DataFrame:
    """Total, mean and deviation per disease, number of diseases with citations; one row."""
    return citations_per_disease(citations).agg(
        F.sum("citation_count").alias("total_citations"),
        F.round(F.avg("citation_count"), 2).alias("avg_citations"),
        F.round(F.stddev("citation_count"), 2).alias("std_citations"),
        F.count("*").alias("n_diseases"),
    )


def diseases_without_citations(responses: DataFrame, citations: DataFrame) -> DataFrame:
    """Diseases that cite nothing."""
    return responses.select("disease_name").distinct().join(citations, "disease_name", "left_anti")


def site_category(c: Column, categories: Mapping[str, Sequence[str]] = SITE_CATEGORIES) -> Column:
    """Category of a site, 'Other / Unknown' for any other."""
    expr = None
    for name, sites in categories.items():
        hit = c.isin(list(sites))
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("Other / Unknown")


def top_sites(
    citations: DataFrame, n: int = 10, site: str = "domain", categories: Mapping[str, Sequence[str]] = SITE_CATEGORIES
) -> DataFrame:
    """The ``n`` sites cited by most diseases (ties by name) with their category."""
    ranked = citations.groupBy(F.col(site).alias("website")).agg(
        F.count_distinct("disease_name").alias("disease_count"), F.count("url").alias("citations")
    )
    return ranked.orderBy(F.col("disease_count").desc(), "website").limit(n).withColumn(
        "category", site_category(F.col("website"), categories)
    )


def site_category_summary(
    citations: DataFrame, n: int = 10, site: str = "domain", categories: Mapping[str, Sequence[str]] = SITE_CATEGORIES
) -> DataFrame:
    """Per category over the top ``n`` sites: distinct diseases and percent of all citations.

    The broadcast side has ``n`` rows; the percent base is a one-value scalar subquery.
    """
    top = top_sites(citations, n, site, categories).select("website", "category")
    total = citations.select(F.count("url").alias("total")).scalar()
    rows = citations.select("disease_name", "url", F.col(site).alias("website")).join(F.broadcast(top), "website")
    return (
        rows.groupBy("category")
        .agg(F.count_distinct("disease_name").alias("unique_disease_count"), F.count("url").alias("n"))
        .select("category", "unique_disease_count", F.round(F.col("n") * 100.0 / total, 2).alias("citation_percentage"))
    )
