"""Schema repair: canonical names, required columns, types, one row per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = ("", "nan", "none", "null")


def standardize(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]],
    required: Sequence[str],
    types: Mapping[str, str] | None = None,
    keys: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """Frame with canonical column names.

    ``aliases``: canonical name to the names it may have, first present wins (case-insensitive).  Missing required
    columns raise ``ValueError``.  Text is trimmed; columns in ``types`` are cast and rows with a bad value dropped;
    rows with an empty or 'nan' key are dropped; of several rows with one key the smallest by ``order`` (then by all
    columns) stays.  That choice is an aggregate, so duplicates combine before the shuffle.
    """
    present = {c.lower(): c for c in df.columns}
    chosen = {}
    for name, alternatives in aliases.items():
        for candidate in (name, *alternatives):
            if candidate.lower() in present:
                chosen[name] = present[candidate.lower()]
                break
    missing = [c for c in required if c not in chosen]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found: {', '.join(df.columns)}")

    types = dict(types or {})
    source_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    columns = []
    for name, source in chosen.items():
        c = F.col(f"`{source}`")
        if name in types:
            c = F.trim(c).try_cast(types[name]) if source_types[source] == "string" else c.try_cast(types[name])
        elif source_types[source] == "string":
            c = F.trim(c)
        columns.append(c.alias(name))
    out = df.select(*columns)
    typed = [c for c in types if c in chosen]
    out = out.dropna(subset=typed) if typed else out
    for key in keys:
        text = F.col(key).cast("string")
        out = out.filter(text.isNotNull() & ~F.lower(text).isin(*MISSING))
    if not keys:
        return out
    rest = [c for c in out.columns if c not in keys]
    if not rest:
        return out.distinct()
    ranking = F.struct(*order, *[c for c in rest if c not in order])
    first = out.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranking).alias("_r"))
    return first.select(*keys, "_r.*").select(*chosen)
