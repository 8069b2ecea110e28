"""Text operators: numbered sections and readability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.text import clean_markdown, polysyllable_count, sentence_count

# A heading is a line with a number and a title.  Marked: after '#' signs or '**', whatever the title holds but '**'.
# Bare: without a mark; then the title starts with a capital and holds no end of a sentence.
MARKED = r"^[ \t]*(?:#{1,6}[ \t]*(?:\*\*[ \t]*)?|\*\*[ \t]*)(\d{1,2})[.)]?[ \t]+((?:(?!\*\*).)+?)[ \t]*(?:\*\*)?[ \t:]*$"
BARE = r"^[ \t]*(\d{1,2})\.?[ \t]+(\p{Lu}(?:[^.;!*]|[.;!](?![ \t]|$))*?)[ \t]*$"


def extract_sections(summaries: DataFrame, text_col: str = "summary") -> DataFrame:
    """Markdown summary to its numbered sections: keys + section_no, title, body.

    A text with marked headings is cut at these alone, so numbered list lines stay in the bodies.  In a text without
    any, a bare heading's number must be larger than the one before it.  What precedes the first heading is dropped.
    Texts are cut at line positions, so no character is special.
    """
    keys = [c for c in summaries.columns if c != text_col]
    cols = summaries.select(*keys, F.split(text_col, "\n").alias("_lines"))

    def headings(pattern: str) -> Column:
        found = F.transform("_lines", lambda line, i: F.struct(
            (i + 1).alias("at"), F.regexp_extract(line, pattern, 1).try_cast("int").alias("no"),
            F.trim(F.regexp_extract(line, pattern, 2)).alias("title")))
        return F.filter(found, lambda h: h["no"].isNotNull())

    cols = cols.withColumns({"_marked": headings(MARKED), "_bare": headings(BARE)})
    # The few bare headings are folded from left to right; each must rise above the last one taken.
    rising = F.aggregate(
        "_bare", F.filter("_bare", lambda h: F.lit(False)),
        lambda kept, h: F.when((F.size(kept) == 0) | (h["no"] > F.try_element_at(kept, F.lit(-1))["no"]), F.concat(kept, F.array(h))).otherwise(kept))
    cols = cols.withColumn("_heads", F.when(F.size("_marked") > 0, F.col("_marked")).otherwise(rising))
    cut = cols.select(*keys, "_lines", "_heads", F.posexplode("_heads").alias("_i", "_h"))
    after = F.coalesce(F.get("_heads", F.col("_i") + 1)["at"], F.size("_lines") + 1)
    body = F.array_join(F.slice("_lines", F.col("_h.at") + 1, after - F.col("_h.at") - 1), "\n")
    return cut.select(
        *keys, F.col("_h.no").alias("section_no"), F.col("_h.title").alias("title"),
        F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def smog(docs: DataFrame, text_col: str = "text", clean: bool = False) -> DataFrame:
    """Adds sentences, polysyllables and the SMOG grade ``1.043*sqrt(30*p/n)+3.1291`` (0 when n < 3), rounded to 2.

    Sentences end at '.', '!', '?' or a line break; syllables are runs of vowels.
    """
    text = clean_markdown(F.col(text_col)) if clean else F.col(text_col)
    n, p = F.col("sentences"), F.col("polysyllables")
    grade = F.when(n < 3, F.lit(0.0)).otherwise(F.round(1.043 * F.sqrt(30.0 * p / n) + 3.1291, 2))
    return (
        docs.withColumn("sentences", sentence_count(text))
        .withColumn("polysyllables", polysyllable_count(text))
        .withColumn("smog", grade)
    )


def smog_by_model(scored: DataFrame) -> DataFrame:
    """Mean and sample deviation of the grade per model."""
    return scored.groupBy("model").agg(
        F.count("*").alias("texts"),
        F.round(F.avg("smog"), 6).alias("mean_smog"),
        F.round(F.stddev("smog"), 6).alias("std_smog"),
    )
