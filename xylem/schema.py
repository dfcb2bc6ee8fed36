"""The node table: a row for each node, numbered in document order."""

from __future__ import annotations

from pyspark.sql import types as T

#: A node's position ``pre`` in document order, the number ``size`` of rows below it, its depth ``level``, its parent's position, and ``ord``, its place among siblings from 1. Attributes and namespace declarations follow their element. ``value`` is the text of text-like nodes, attributes and elements that hold text alone; null for elements with element children.
NODE_FIELDS = [
    ("pre", T.IntegerType()), ("size", T.IntegerType()), ("level", T.IntegerType()), ("parent_pre", T.IntegerType()), ("kind", T.StringType()), ("prefix", T.StringType()),
    ("local_name", T.StringType()), ("ns_uri", T.StringType()), ("value", T.StringType()), ("ord", T.IntegerType()),
]
NODE_COLUMNS = [n for n, _ in NODE_FIELDS]
KINDS = ("document", "element", "attribute", "namespace", "text", "cdata", "comment", "processing_instruction", "declaration", "doctype", "entity_reference")
#: Kinds that only their own axes reach.
SIDE_KINDS = ("attribute", "namespace", "declaration", "doctype")
XML_NS = "http://www.w3.org/XML/1998/namespace"


def node_ddl(id_type: str) -> str:
    return f"doc_id {id_type}, " + ", ".join(f"{n} {t.simpleString()}" for n, t in NODE_FIELDS) + ", error string"
