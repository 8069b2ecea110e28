"""Secret scans: strong patterns, and weak parts of a credential that count only together.

Identifiers, secrets and endpoints are found in one pass over the texts.  Strong ones are reported at once.  A weak
one is reported when its complementary parts lie within its scope: a join of intervals that is cut into cells of one
scope's width, where each cell keeps only the first start and the last end per role, so no pair is ever written out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from rankweave.llm.common import Scratch, id_and_text, row_hash, same_row, whole_rows, with_text

SCOPE = 200  # code points between two parts of one credential

# Kinds in the order in which spans that start together are listed.
STRONG = ("assign", "access", "hex")
WEAK = ("weak_secret", "weak_id", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "identifier", "weak_id": "identifier",
        "endpoint": "endpoint"}

_ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more: a maximal run is one match either way
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_.-])")
_NAME = re.compile(r"""(?<![A-Za-z0-9])(?:user|username|user_id|login|client_id|account_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{3,}""")
_PLACE = re.compile(r"""(?<![A-Za-z0-9+.-])(?:[a-z][a-z0-9+.-]*://[^\s"'<>]+|(?:[a-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}(?![0-9]))""")

SPAN = "array<struct<start: int, rank: int, end: int>>"
KINDS = STRONG + WEAK


def find_parts(text: str) -> tuple[list, list]:
    """(start, rank of the kind, end) of strong and of weak parts; a weak part never overlaps a strong one."""
    strong = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    strong += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    strong += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    starts, ends = [], []  # strong parts as separate stretches of text
    for start, _, end in sorted(strong):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def free(start: int, end: int) -> bool:
        before = bisect_left(starts, end)  # stretches that begin before the end; only the last of them can reach in
        return not before or ends[before - 1] <= start

    weak = []
    for rank, pattern in ((3, _MIXED), (4, _NAME), (5, _PLACE)):
        for m in pattern.finditer(text):
            found = m[0]
            mixed = re.search("[0-9]", found) and re.search("[a-z]", found) and re.search("[A-Z]", found)
            if (rank > 3 or mixed) and free(m.start(), m.end()):
                weak.append((m.start(), rank, m.end()))
    return sorted(strong), sorted(weak)


def _parts(docs: DataFrame) -> DataFrame:
    spans = ArrayType(StructType([StructField("start", IntegerType()), StructField("rank", IntegerType()), StructField("end", IntegerType())]))
    schema = StructType([docs.schema["doc_id"], docs.schema["_rh"], StructField("strong", spans), StructField("weak", spans)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [find_parts(t) for t in frame["text"]]
            as_rows = lambda part: [{"start": s, "rank": k, "end": e} for s, k, e in part]
            yield frame[["doc_id", "_rh"]].assign(strong=[as_rows(a) for a, _ in found], weak=[as_rows(b) for _, b in found])

    return docs.mapInPandas(run, schema)


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(_row, spans): the weak parts of each row that their complements confirm, from ``_row, strong, weak``.

    A secret needs an identifier within its scope, an identifier a secret and an endpoint, an endpoint both others.
    """
    every = parts.select("_row", F.explode(F.concat("strong", "weak")).alias("p"))
    role = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(i), F.lit(ROLE[k]))]), F.col("p.rank"))
    cell = lambda at: F.floor(at / scope).cast("int")
    every = every.select("_row", role.alias("role"), F.col("p.start").alias("s"), F.col("p.end").alias("e"), F.col("p.rank").alias("rank"))
    cells = (
        every.withColumn("_cell", F.explode(F.sequence(cell(F.col("s")), cell(F.col("e") - 1))))
        .groupBy("_row", "_cell", "role").agg(F.min("s").alias("_first"), F.max("e").alias("_last"))
    )
    weak = every.filter(F.col("rank") >= len(STRONG)).withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("s") - scope), cell(F.col("e") + scope))))
    near = (F.col("_last") >= F.col("s") - scope) & (F.col("_first") <= F.col("e") + scope)
    seen = (
        weak.join(cells.withColumnRenamed("role", "_role"), ["_row", "_cell"]).filter(near)
        .groupBy("_row", "rank", "role", "s", "e").agg(F.collect_set("_role").alias("roles"))
    )
    has = lambda r: F.array_contains("roles", r)
    confirmed = (
        F.when(F.col("role") == "secret", has("identifier"))
        .when(F.col("role") == "identifier", has("secret") & has("endpoint"))
        .otherwise(has("identifier") & has("secret"))
    )
    return seen.filter(confirmed).groupBy("_row").agg(
        F.collect_list(F.struct(F.col("s").alias("start"), "rank", F.col("e").alias("end"))).alias("added"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _rh, strong, spans): one row per document; spans sorted by start, then kind; code points, end exclusive.

    Null and empty texts have no spans; null and repeated doc_ids keep their rows (a row is numbered when the parts
    are stored); an empty table gives no rows.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("_rh", row_hash(F.col("text")))
    parts = Scratch(docs.sparkSession, "secret-parts").store(_parts(texts).withColumn("_row", F.monotonically_increasing_id()))
    links = linked(parts.filter(F.size("weak") > 0), scope)
    return parts.join(links, "_row", "left").select(
        "doc_id", "_rh", "strong",
        F.array_sort(F.concat("strong", F.coalesce("added", F.array().cast(SPAN)))).alias("spans"))


def listing(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span but endpoints replaced by ``[SECRET]``; overlapping spans become one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for t, rows in zip(texts, found):
            at, kept = 0, []
            for s in sorted((r for r in (rows if rows is not None else []) if r["rank"] != KINDS.index("endpoint")), key=lambda r: r["start"]):
                if s["start"] >= at:
                    kept += [t[at:s["start"]], "[SECRET]"]
                at = max(at, s["end"])
            out.append("".join([*kept, t[at:]]))
        return pd.Series(out)

    return run(text, spans)


def mask_documents(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with the reported spans masked in ``text`` (and ``n_chars`` counted again); all rows and columns stay."""
    found = scan(docs, scope).filter(F.size("spans") > 0).groupBy("doc_id", "_rh").agg(F.first("spans").alias("_spans"))
    keyed = whole_rows(docs)
    joined = keyed.join(found, same_row(keyed, found), "left").select("row", "_text", "_spans")
    text = masked(F.col("_text"), F.coalesce("_spans", F.array().cast(SPAN)))
    row = F.when(F.col("_spans").isNull(), F.col("row")).otherwise(with_text(F.col("row"), text, docs.columns))
    return joined.select(row.alias("row")).select("row.*")
