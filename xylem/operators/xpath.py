"""Queries on the node table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import XPathNodeTypeError
from ..plans.ast import Call, Filter, Path, Union, names_of, parse
from ..plans.lower import Engine
from ..schema import NODE_COLUMNS
from ..sources.shred import shred
from ..storage import settle


def _documents(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'document'").select("doc_id", *NODE_COLUMNS)


def _shows_nodes(e) -> bool:
    return isinstance(e, (Path, Union, Filter)) or isinstance(e, Call) and e.name == "id"


def xpath(nodes: DataFrame, expression: str, *, namespaces: dict[str, str] | None = None, variables: dict[str, object] | None = None, semantics: str = "xpath1", context: DataFrame | None = None) -> DataFrame:
    """The expression's value for every document (or every node of ``context``: rows of doc_id and NODE_COLUMNS).

    A node-set gives its nodes (doc_id, NODE_COLUMNS), each once; with context also ``o_pre``, the context node's
    position. Any other expression gives (doc_id, value), with context (doc_id, pre, value): a row for each, also where
    node-sets in it are empty. Rows have no order; sort by doc_id and pre where it matters.
    """
    e = parse(expression)
    engine = Engine(nodes, namespaces or {}, variables or {}, semantics)
    start = _documents(nodes) if context is None else context.select("doc_id", *NODE_COLUMNS).dropDuplicates(["doc_id", "pre"])
    if _shows_nodes(e):
        f = engine.node_set(e, start)
        if context is None:
            return f.df.select("doc_id", *NODE_COLUMNS)
        return engine._spread(f, start, False)
    df, v, _ = engine.value(e, start)
    return df.select("doc_id", *([] if context is None else ["pre"]), v.alias("value"))


def scan(df: DataFrame, *expressions: str, id_col: str = "doc_id", markup_col: str = "xml", **options) -> DataFrame:
    """The node table of documents for these expressions, scanned once: no other names than they need, each document in one place, kept in the shared folder."""
    return settle(shred(df, id_col, markup_col, names=names_of(*expressions), **options).repartition("doc_id"))


def at_xpath(nodes: DataFrame, expression: str, **options) -> DataFrame:
    """Of each document the first node in document order."""
    if not _shows_nodes(parse(expression)):
        raise XPathNodeTypeError("a node-set is needed here", expression=expression)
    w = W.partitionBy("doc_id").orderBy("pre")
    return xpath(nodes, expression, **options).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def extract(nodes: DataFrame, record: str, columns: dict[str, str], **options) -> DataFrame:
    """A row for each node of ``record``: doc_id, pre, and for each column its expression's value there.

    The record's nodes are found once; a node-set gives the text of its first node, null where it is empty.
    """
    engine = Engine(nodes, options.get("namespaces") or {}, options.get("variables") or {}, options.get("semantics", "xpath1"))
    df = engine.node_set(parse(record), _documents(nodes)).df.select("doc_id", *NODE_COLUMNS)
    out: list[Column] = []
    for name, expression in columns.items():
        e = parse(expression)
        if attribute := engine._attribute(e):
            df = engine.with_attributes(df)
            v = F.col("_attrs")[attribute]
        elif _shows_nodes(e):
            df, v = engine._aggregate(e, df, lambda f: F.min_by("sv", "pre"), F.lit(None).cast("string"), True)
        else:
            df, v, _ = engine.value(e, df)
        out.append(v.alias(name))
    return df.select("doc_id", "pre", *out)


def xpath_column(xml: Column, expression: str, kind: str = "string") -> Column:
    """The fast path for well-formed documents without namespaces: Spark's own evaluator, no shredding."""
    return {"string": F.xpath_string, "number": F.xpath_double, "boolean": F.xpath_boolean}[kind](xml, F.lit(expression))


@dataclass(frozen=True)
class NodeSet:
    """A set of nodes as rows (doc_id, NODE_COLUMNS), with the operations of a list; all but those that name counts are lazy."""

    df: DataFrame
    nodes: DataFrame

    def first(self, n: int = 1) -> NodeSet:
        w = W.partitionBy("doc_id").orderBy("pre")
        return NodeSet(self.df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k"), self.nodes)

    def last(self) -> NodeSet:
        return NodeSet(self.df.withColumn("_k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("pre")))).filter("_k = 1").drop("_k"), self.nodes)

    def at(self, start: int, stop: int | None = None) -> NodeSet:
        """Places start to before stop of each document, from 0."""
        k = F.row_number().over(W.partitionBy("doc_id").orderBy("pre")) - 1
        return NodeSet(self.df.withColumn("_k", k).filter((F.col("_k") >= start) & (F.col("_k") < (start + 1 if stop is None else stop))).drop("_k"), self.nodes)

    def size(self) -> DataFrame:
        """(doc_id, n), 0 where there is none."""
        n = self.df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        return _documents(self.nodes).select("doc_id").join(n, "doc_id", "left").fillna(0, ["n"])

    def text(self) -> DataFrame:
        """(doc_id, text): the nodes' texts joined in order."""
        sv = Engine(self.nodes).with_string(self.df)
        return sv.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "sv"))), lambda x: x["sv"]), "").alias("text"))

    def concat(self, other: NodeSet) -> NodeSet:
        """All of both, copies too."""
        return NodeSet(self.df.unionByName(other.df), self.nodes)

    def union(self, other: NodeSet) -> NodeSet:
        return NodeSet(self.df.unionByName(other.df).dropDuplicates(["doc_id", "pre"]), self.nodes)

    def without(self, other: NodeSet) -> NodeSet:
        return NodeSet(self.df.join(other.df, ["doc_id", "pre"], "left_anti").select(self.df.columns), self.nodes)

    def unique(self) -> NodeSet:
        return NodeSet(self.df.dropDuplicates(["doc_id", "pre"]), self.nodes)

    def filter(self, condition) -> NodeSet:
        return NodeSet(self.df.filter(condition), self.nodes)

    def find(self, expression: str, **options) -> NodeSet:
        got = xpath(self.nodes, expression, context=self.df, **options)
        return NodeSet(got.select("doc_id", *NODE_COLUMNS).dropDuplicates(["doc_id", "pre"]), self.nodes)

    def tally(self, column: str) -> DataFrame:
        return self.df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


# --- navigation


def children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    return xpath(nodes, "child::node()", context=of)


def parent(nodes: DataFrame, of: DataFrame) -> DataFrame:
    return xpath(nodes, "..", context=of)


def siblings(nodes: DataFrame, skip_blank: bool = False) -> DataFrame:
    """nodes with next_pre and previous_pre, the neighbours among siblings; with skip_blank white text between them doesn't count."""
    tree = nodes.filter(~F.col("kind").isin("attribute", "namespace", "declaration", "doctype", "document"))
    if skip_blank:
        tree = tree.filter((F.col("kind") != "text") | (F.trim(F.regexp_replace("value", r"\s+", " ")) != ""))
    w = W.partitionBy("doc_id", "parent_pre").orderBy("pre")
    return tree.withColumn("next_pre", F.lead("pre").over(w)).withColumn("previous_pre", F.lag("pre").over(w))


def attributes(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, attributes map of qualified names): a row for each element."""
    name = F.concat_ws(":", F.when(F.col("prefix") != "", F.col("prefix")), "local_name")
    a = nodes.filter("kind = 'attribute'").groupBy("doc_id", F.col("parent_pre").alias("pre")).agg(F.map_from_entries(F.collect_list(F.struct(name, "value"))).alias("attributes"))
    return nodes.filter("kind = 'element'").select("doc_id", "pre").join(a, ["doc_id", "pre"], "left").withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def in_scope_namespaces(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, prefix, uri) of all elements: of equal prefixes the nearest binding."""
    got = xpath(nodes, "namespace::*", context=nodes.filter("kind = 'element'"))
    return got.select("doc_id", F.col("o_pre").alias("pre"), F.col("local_name").alias("prefix"), F.col("value").alias("uri"))


def identifier() -> Column:
    """A node's name by its kind: the name, a target, else null."""
    name = F.concat_ws(":", F.when(F.col("prefix") != "", F.col("prefix")), "local_name")
    return F.when(F.col("kind").isin("element", "attribute", "processing_instruction", "entity_reference", "doctype"), name)


def text_content(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """of with ``sv``, the text below each node."""
    return Engine(nodes).with_string(of)


def inner_text(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, text): of each element the text directly in it."""
    own = nodes.filter(F.col("kind").isin("text", "cdata", "entity_reference")).groupBy("doc_id", F.col("parent_pre").alias("pre")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pre"), "value"))), lambda x: x["value"]), "").alias("text"))
    return nodes.filter("kind = 'element'").select("doc_id", "pre").join(own, ["doc_id", "pre"], "left").withColumn("text", F.coalesce("text", F.lit("")))
