"""Response telemetry: run time, tokens, cost, search queries, flattening of JSON answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.json import parsed

ACCURACY = 10000


def _quartiles(c: str, name: str, digits: int) -> list[Column]:
    q = F.percentile_approx(c, [0.25, 0.5, 0.75], ACCURACY)
    return [
        F.round(q[0], digits).alias(f"q1_{name}"),
        F.round(q[1], digits).alias(f"median_{name}"),
        F.round(q[2], digits).alias(f"q3_{name}"),
        F.round(q[2] - q[0], digits).alias(f"iqr_{name}"),
    ]


def runtime_stats(responses: DataFrame, col: str = "total_running_time", by: str = "model") -> DataFrame:
    """Mean, population deviation, quartiles, interquartile range and count of a numeric text column, rounded to 2."""
    rows = responses.select(by, F.expr(f"try_cast({col} AS double)").alias(col)).filter(F.col(col).isNotNull())
    return rows.groupBy(by).agg(
        F.round(F.avg(col), 2).alias(f"avg_{col}"),
        F.round(F.stddev_pop(col), 2).alias(f"std_{col}"),
        *_quartiles(col, col, 2),
        F.count("*").alias("record_count"),
    )


def token_values(responses: DataFrame, json_col: str, paths: Mapping[str, str], by: str = "model") -> DataFrame:
    """Long form (model, metric, value): each metric is a dotted path in the JSON text, parsed once per row.

    A value that is no number becomes null and does not count.
    """
    doc = responses.select(by, parsed(json_col, paths.values()).alias("j"))
    entries = [
        F.struct(F.lit(metric).alias("metric"), F.col(f"j.{path}").try_cast("double").alias("value"))
        for metric, path in paths.items()
    ]
    return doc.select(by, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def token_stats(values: DataFrame, by: str = "model") -> DataFrame:
    """Mean, sample deviation, quartiles and interquartile range per metric, rounded to 2."""
    return values.groupBy(by, "metric").agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 2).alias("avg_value"),
        F.round(F.stddev("value"), 2).alias("std_value"),
        *_quartiles("value", "value", 2),
    )


def token_ratios(values: DataFrame, ratios: Mapping[str, tuple[str, str]], by: str = "model") -> DataFrame:
    """Ratios of means, e.g. reasoning over output tokens, one column per ratio."""
    mean = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
    return values.groupBy(by).agg(
        *[F.round(F.try_divide(mean(a), mean(b)), 4).alias(name) for name, (a, b) in ratios.items()]
    )


# --- fixed values: where the providers put the numbers of input and output tokens; several output parts are added ---
USAGE_LAYOUTS = {
    "input_output": ("input_tokens", ["output_tokens"]),
    "prompt_completion": ("prompt_tokens", ["completion_tokens"]),
    "server_tools": ("input_tokens", ["output_tokens"]),
    "metadata": ("prompt_token_count", ["candidates_token_count", "thoughts_token_count"]),
}


def token_usage(responses: DataFrame, layout: str, json_col: str = "usage", by: str = "model") -> DataFrame:
    """(model, input_tokens, output_tokens) from the usage JSON of one provider layout; what is no number is null."""
    source, parts = USAGE_LAYOUTS[layout]
    doc = responses.select(by, parsed(json_col, [source, *parts]).alias("j"))
    number = lambda path: F.col(f"j.{path}").try_cast("long")
    values = [number(p) for p in parts]
    known = F.when(F.coalesce(*values).isNotNull(), sum((F.coalesce(v, F.lit(0)) for v in values[1:]), F.coalesce(values[0], F.lit(0))))
    return doc.select(by, number(source).alias("input_tokens"), known.alias("output_tokens"))


def token_cost(usage: DataFrame, prices: DataFrame, by: str = "model") -> DataFrame:
    """Summed cost per model in currency units, and ``n_unpriced``, the rows of a model without a price (its cost is null).

    ``usage``: model, input_tokens, output_tokens; ``prices``: model, threshold, and per million tokens input_low,
    input_high, output_low, output_high.  The high prices hold above ``threshold`` input tokens; a null threshold
    means flat prices (the low ones).
    """
    tiered = F.col("input_tokens") > F.col("threshold")
    price = lambda side: F.when(tiered, F.col(f"{side}_high")).otherwise(F.col(f"{side}_low"))
    cost = lambda side: F.round(F.sum(F.col(f"{side}_tokens") * price(side) / 1e6), 6)
    return (
        usage.join(prices.withColumn("_priced", F.lit(1)), by, "left")
        .groupBy(by)
        .agg(
            cost("input").alias("input_cost"), cost("output").alias("output_cost"),
            F.count_if(F.col("_priced").isNull()).alias("n_unpriced"),
        )
        .withColumn("total_cost", F.round(F.col("input_cost") + F.col("output_cost"), 6))
    )


_BLOCKS = "array<struct<id:string,input:struct<query:string>,name:string,type:string,tool_use_id:string>>"
_EVENTS = "array<struct<id:string,type:string,status:string,action:struct<query:string,type:string>>>"
_GROUNDING = "array<struct<grounding_metadata:struct<web_search_queries:array<string>>>>"


def extract_queries(responses: DataFrame, layout: str, json_col: str, distinct: bool = False) -> DataFrame:
    """Search queries (model, disease_name, query) from one of three JSON layouts.

    * ``blocks``: array of typed blocks; ``server_tool_use`` named ``web_search`` with ``input.query``
    * ``events``: array of events; ``web_search_call`` with ``action.query``
    * ``grounding``: list or object with ``grounding_metadata.web_search_queries``

    Text that is no JSON yields no rows.
    """
    keys = ["model", "disease_name"]
    if layout == "blocks":
        items = responses.select(*keys, F.explode(F.from_json(json_col, _BLOCKS)).alias("i"))
        query, keep = F.col("i.input.query"), (F.col("i.type") == "server_tool_use") & (F.col("i.name") == "web_search")
    elif layout == "events":
        items = responses.select(*keys, F.explode(F.from_json(json_col, _EVENTS)).alias("i"))
        query, keep = F.col("i.action.query"), F.col("i.type") == "web_search_call"
    elif layout == "grounding":
        lists = F.transform(F.from_json(json_col, _GROUNDING), lambda g: g["grounding_metadata"]["web_search_queries"])
        items = responses.select(*keys, F.explode(F.flatten(F.filter(lists, lambda q: q.isNotNull()))).alias("i"))
        query, keep = F.col("i"), F.lit(True)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    out = items.filter(keep).select(*keys, query.alias("query")).filter(F.col("query").isNotNull())
    return out.distinct() if distinct else out


def query_count_summary(queries: DataFrame, diseases: DataFrame | None = None) -> DataFrame:
    """Queries per disease, summarised per model: mean, deviation, quartiles, min over positives, max, diseases.

    ``diseases`` (model, disease_name) adds diseases without any query with count 0.
    """
    counts = queries.groupBy("model", "disease_name").agg(F.count("*").alias("n"))
    if diseases is not None:
        counts = diseases.select("model", "disease_name").distinct().join(counts, ["model", "disease_name"], "left").select(
            "model", "disease_name", F.coalesce("n", F.lit(0)).alias("n")
        )
    positive = F.col("n") > 0
    return counts.groupBy("model").agg(
        F.round(F.avg("n"), 2).alias("avg_query_count"),
        F.round(F.stddev("n"), 2).alias("std_query_count"),
        *_quartiles("n", "query_count", 2),
        F.min(F.when(positive, F.col("n"))).alias("min_query_count"),
        F.max("n").alias("max_query_count"),
        F.count_if(positive).alias("num_diseases_with_queries"),
    )


# One schema for the answer texts of all providers; the encrypted field is read only to drop its carriers.
_TEXT = (
    "content array<struct<type:string,text:string,encrypted_content:string>>, "
    "output array<struct<type:string,content:array<struct<type:string,text:string>>>>, "
    "choices array<struct<message:struct<content:string>>>, "
    "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
)
# Search results inside a block hold encrypted parts as well; listed fields survive.
_CLEAN = (
    "array<struct<id:string,type:string,name:string,text:string,input:struct<query:string>,tool_use_id:string,"
    "encrypted_content:string,content:array<struct<title:string,type:string,url:string,encrypted_content:string>>>>"
)


def drop_encrypted(json_text: Column) -> Column:
    """Content blocks as JSON text without blocks or search results that carry an encrypted part."""
    blocks = F.filter(F.from_json(json_text, _CLEAN), lambda b: b["encrypted_content"].isNull())
    cleaned = F.transform(
        blocks,
        lambda b: b.dropFields("encrypted_content").withField(
            "content",
            F.transform(
                F.filter(b["content"], lambda r: r["encrypted_content"].isNull()),
                lambda r: r.dropFields("encrypted_content"),
            ),
        ),
    )
    return F.to_json(cleaned)


def flatten_responses(
    raw: DataFrame, columns: Sequence[str], json_col: str = "response", keys: Sequence[str] = ("model", "disease_name")
) -> DataFrame:
    """A JSON answer to one row: the listed top-level keys as text columns, and the answer text.

    The answer text is the first that exists of: all text blocks joined by line breaks; the first ``output_text`` of
    a ``message``; the first choice; the first part of the first candidate.  ``content`` loses encrypted parts.
    Text that is no JSON gives a row of nulls.
    """
    top = F.from_json(json_col, "map<string,string>")
    doc = F.from_json(json_col, _TEXT)
    rows = raw.select(*keys, top.alias("t"), doc.alias("d"))
    blocks = F.transform(
        F.filter("d.content", lambda b: b["text"].isNotNull() & b["encrypted_content"].isNull()), lambda b: b["text"]
    )
    joined = F.when(F.size(blocks) > 0, F.array_join(blocks, "\n"))
    messages = F.flatten(
        F.transform(F.filter("d.output", lambda o: (o["type"] == "message") & o["content"].isNotNull()), lambda o: o["content"])
    )
    output_text = F.get(F.filter(messages, lambda m: m["type"] == "output_text"), F.lit(0))["text"]
    choice = F.get("d.choices", F.lit(0))["message"]["content"]
    part = F.get(F.get("d.candidates", F.lit(0))["content"]["parts"], F.lit(0))["text"]
    value = lambda c: drop_encrypted(F.col("t")[c]) if c == "content" else F.col("t")[c]
    return rows.select(
        *keys, *[value(c).alias(c) for c in columns], F.coalesce(joined, output_text, choice, part).alias("disease_text")
    )


def category_pivot(rows: DataFrame, category: str, model: str, measures: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Category x model table of the summed measures, 0 where absent."""
    wide = rows.groupBy(category).pivot(model, list(models))
    return wide.agg(*[F.sum(m).alias(m) for m in measures]).na.fill(0)


def status_summary(log: DataFrame, ok: str = "saved") -> DataFrame:
    """Status log of processed items: totals by (model, dataset).

    ``log``: model, dataset, patient_id, n_rows, error.  An item failed when it has an error, was skipped when it
    produced nothing, else it is ``ok``.
    """
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("n_rows") == 0, "skipped").otherwise(ok)
    return log.withColumn("status", status).groupBy("model", "dataset").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("status") == ok).alias(f"n_{ok}"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.sum("n_rows").alias("total_rows"),
    )
