"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

All work is done by built-in column functions and joins.  A verdict depends on (host, path) only, so everything runs
on distinct pairs; keys that many pages share are reduced to one row before they are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # 64-bit words in a block: 512 bits, and one bit of each word per key


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty where the url is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Key of a listed URL: scheme, query and fragment gone, no ``www.``, no ending dot or default port in the host, and no
    ``.html`` or slash at the end of the path."""
    plain = F.regexp_replace(F.regexp_replace(host, r"(\.|:80|:443)\z", ""), r"^www\.", "")
    return F.concat(plain, F.regexp_replace(path, r"(/|\.html)\z", ""))


def _bloom_words(hashed: Column) -> list[Column]:
    """One bit for each word of the block, from six bits of the second hash each."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def _keyed(df: DataFrame, n_blocks: Column) -> DataFrame:
    return df.withColumn("_block", F.pmod(F.xxhash64("key", F.lit(1)), n_blocks)).withColumn("_bits", F.xxhash64("key", F.lit(2)))


def bloom_filter(listed: DataFrame, n_blocks: Column) -> DataFrame:
    """Blocked Bloom filter of the column ``key``: one row per block that holds a key, words combined by bitwise or."""
    rows = _keyed(listed.select("key"), n_blocks)
    return rows.groupBy("_block").agg(*[F.bit_or(w).alias(f"_w{i}") for i, w in enumerate(_bloom_words(F.col("_bits")))])


def listed_keys(keys: DataFrame, listed: DataFrame, bits_per_key: int = 16) -> DataFrame:
    """Rows of ``listed`` whose key occurs in ``keys``: the Bloom filter passes possible hits to the exact join.

    The number of blocks follows the size of the list through a scalar subquery, so the false positive rate stays put.
    """
    n_blocks = listed.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)) * bits_per_key / (64 * WORDS)))).scalar()
    blocks = bloom_filter(listed, n_blocks)
    asked = _keyed(keys.select("key").distinct(), n_blocks)
    hit = asked.join(blocks, "_block")
    for i, w in enumerate(_bloom_words(F.col("_bits"))):
        hit = hit.filter(F.col(f"_w{i}").bitwiseAND(w) != 0)
    return listed.join(hit.select("key"), "key")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to pages (columns of these names are replaced).

    rules: ``action`` (allow or block), ``host``, ``path``; a rule fits its host and all subdomains where the url's path
    starts with its path.  The longest fitting rule decides (of equal lengths the longer host, then block).  Without
    one, a url whose canonical form is in ``listed.key`` is blocked and any other allowed.  Null urls, urls without
    ``://``, empty tables and null rules or keys are fine: they fit nothing, and an unfitted url is allowed.
    """
    host, path = url_parts(F.col(url_col))
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*[pages[f"`{c}`"] for c in names]).alias("row"), host.alias("_host"), path.alias("_path"))
    rules = rules.select("action", "host", "path").dropna().distinct()
    lengths = rules.agg(F.collect_set(F.length("path"))).scalar()  # at most as many as a path has characters
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).scalar()  # labels of the longest rule's host: no longer suffix fits one
    pairs = rows.select("_host", "_path").distinct().withColumn("_lengths", lengths).withColumn("_most", F.coalesce(most, F.lit(1)))
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - F.col("_most") + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    fits = F.flatten(F.transform(suffixes, lambda s: F.transform(
        F.filter("_lengths", lambda n: n <= F.length("_path")),
        lambda n: F.concat(s, F.lit(" "), F.substr(F.col("_path"), F.lit(1), n)))))
    url_key = F.concat(F.lit("="), canonical(F.col("_host"), F.col("_path")))
    asked = pairs.filter(F.col("_host") != "").withColumn(
        "key", F.explode(F.array_distinct(F.concat(fits, F.array(url_key))))).drop("_lengths", "_most")

    known = rules.select(
        F.concat_ws(" ", "host", "path").alias("key"), "action", F.concat("host", "path").alias("_rule"),
        F.length(F.concat("host", "path")).alias("_len"), F.length("host").alias("_host_len"),
    ).unionByName(listed.select(
        F.concat(F.lit("="), "key").alias("key"), F.lit("block").alias("action"), F.lit(None).cast("string").alias("_rule"),
        F.lit(-1).alias("_len"), F.lit(-1).alias("_host_len"),
    ).dropna(subset=["key"]).distinct())
    found = listed_keys(asked, known)
    best = (
        asked.join(found, "key").groupBy("_host", "_path")
        .agg(F.max(F.struct("_len", "_host_len", "action", "_rule")).alias("_best"))
    )
    return rows.join(best, ["_host", "_path"], "left").select(
        "row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best._rule").alias("rule"),
        F.coalesce("_best.action", F.lit("allow")).alias("verdict"))
