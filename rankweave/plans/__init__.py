"""Bindings of the driver tables, the query registry and its SQL counterparts."""
