"""Paths as column functions: Catalyst expressions over a VARIANT column (or JSON text) where the query allows, else Arrow batches.

A VARIANT column is read as it is; JSON text is parsed in the expression, so parse it once (``JsonFrame.variants``) where several
functions read it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import frame, native
from ..plans.parser import parse


def json_query(doc: Column, query: str, variant: bool = True) -> Column:
    """All values, as JSON texts."""
    path = parse(query)
    if native.expressible(path):
        return frame.texts_of(path, doc if variant else F.try_parse_json(doc))
    return frame.json_query(F.to_json(doc) if variant else doc, path)


def json_exists(doc: Column, query: str, variant: bool = True) -> Column:
    path = parse(query)
    if native.expressible(path):
        return F.coalesce(frame.found_in(path, doc if variant else F.try_parse_json(doc)), F.lit(False))
    return F.size(json_query(doc, query, variant)) > 0


def json_value(doc: Column, query: str, variant: bool = True) -> Column:
    """The single node's value: a string as it is, others as JSON text; NULL unless there is just one."""
    path = parse(query)
    if not native.expressible(path):
        found = json_query(doc, query, variant)
        only = F.when(F.size(found) == 1, F.get(found, 0))
        return F.coalesce(F.try_variant_get(F.when(only.startswith('"'), F.try_parse_json(only)), "$", "string"), only)
    v = doc if variant else F.try_parse_json(doc)
    nodes = native.nodelist(path, v, v)
    node = native.one(v, path) if path.singular else F.when(F.size(nodes) == 1, F.get(nodes, 0))
    return F.when(native.kind(node) == "string", F.try_variant_get(node, "$", "string")).otherwise(F.to_json(node))
