"""JSON text columns: one parse per row for any number of paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_of_paths(paths: Iterable[str]) -> T.StructType:
    """Struct type that holds every dotted path ('a.b.c') with string leaves."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def build(node: dict) -> T.DataType:
        if not node:
            return T.StringType()
        return T.StructType([T.StructField(name, build(child)) for name, child in node.items()])

    return build(tree)


def parsed(column: str, paths: Iterable[str]) -> Column:
    """The JSON text parsed once; text that is no JSON gives nulls."""
    return F.from_json(column, schema_of_paths(paths))
