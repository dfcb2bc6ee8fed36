"""Changes to node tables: each gives a new table with positions, sizes, levels and places numbered anew."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DocumentStructureError
from ..schema import NODE_COLUMNS, NODE_FIELDS
from ..sources.shred import STEP
from ..sources.tree import numbered
from ..storage import settle
from ..validation import check_element_name

_ALL = ["doc_id", *NODE_COLUMNS]


def remove(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Without the targets (rows of doc_id, pre, size) and all below them."""
    t = targets.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_t"), F.col("size").alias("_s"))
    gone = (F.col("doc_id") == F.col("_d")) & (F.col("pre") >= F.col("_t")) & (F.col("pre") <= F.col("_t") + F.col("_s"))
    return renumber(nodes.join(t, gone, "left_anti").select(*_ALL).withColumn("_key", F.array(F.col("pre").cast("long"))))


def renumber(nodes: DataFrame) -> DataFrame:
    """Dense numbers for rows with ``_key`` (array<long>, the new order within a document): rows of a document pass in order, and their levels tell what holds what. Texts of elements are gathered anew."""
    kind = dict(nodes.dtypes)["doc_id"]
    kinds = [pa.int32()] * 4 + [pa.string()] * 5 + [pa.int32()]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: pa.DataType | None = None
        last: object = None
        held: list[list] = [[] for _ in range(6)]  # of the document that is being read
        docs: list = []
        out: list[list] = [[] for _ in kinds]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(docs, ids), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=_ALL)
            for c in (docs, *out):
                c.clear()
            return made

        def document() -> Iterator[pa.RecordBatch]:
            columns = numbered(*held).columns()
            for c in held:
                c.clear()
            for low in range(0, len(columns[0]), STEP):
                for c, values in zip(out, columns, strict=True):
                    c += values[low : low + STEP]
                docs.extend([last] * (len(out[0]) - len(docs)))
                if len(docs) >= STEP:
                    yield batch()

        for b in batches:
            ids = b.schema.field(0).type
            for d, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held[0] and d != last:
                    yield from document()
                last = d
                for c, v in zip(held, row, strict=True):
                    c.append(v)
        if held[0]:
            yield from document()
        if docs:
            yield batch()

    rows = nodes.select("doc_id", "level", "kind", "prefix", "local_name", "ns_uri", "value", "_key").repartition("doc_id").sortWithinPartitions("doc_id", "_key").drop("_key")
    return settle(rows.mapInArrow(number, f"doc_id {kind}, " + ", ".join(f"{n} {t.simpleString()}" for n, t in NODE_FIELDS)))


def insert(nodes: DataFrame, targets: DataFrame, new: DataFrame, where: str = "last") -> DataFrame:
    """With the trees ``new`` put at each target (doc_id, pre, size, level, parent_pre).

    new: rows of NODE_COLUMNS of a fragment (as the scanner gives; its document row stays out), the same for all targets, or
    with doc_id for each document its own. where: first or last inside, before, after. Text next to text stays apart.
    """
    if where not in ("first", "last", "before", "after"):
        raise DocumentStructureError("where is first, last, before or after", where=where)
    t = targets.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_t"), F.col("size").alias("_s"), F.col("level").alias("_l"), F.col("parent_pre").alias("_tp"), F.col("kind").alias("_tk"))
    sides = nodes.filter("kind in ('attribute', 'namespace')").groupBy(F.col("doc_id").alias("_ad"), F.col("parent_pre").alias("_ap")).agg(F.count(F.lit(1)).alias("_na"))
    t = t.join(sides, (F.col("_d") == F.col("_ad")) & (F.col("_t") == F.col("_ap")), "left")
    at = {"last": F.col("_t") + F.col("_s"), "first": F.col("_t") + F.coalesce("_na", F.lit(0)), "before": F.col("_t") - 1, "after": F.col("_t") + F.col("_s")}[where]
    inside = where in ("first", "last")
    body = new.filter("kind <> 'document'")
    body = body.select(*([F.col("doc_id").alias("_nd")] if "doc_id" in new.columns else []), *(F.col(c).alias("n_" + c) for c in NODE_COLUMNS))
    met = body.join(t, F.col("_nd") == F.col("_d")) if "_nd" in body.columns else t.crossJoin(body)
    # new rows take negative positions apart from all others until they are numbered
    unique = -(F.col("_t").cast("long") * 1_000_000 + F.col("n_pre") + 1)
    add = met.select(
        F.col("_d").alias("doc_id"), unique.alias("pre"), F.col("n_size").alias("size"), (F.col("n_level") + F.col("_l") - (0 if inside else 1)).cast("int").alias("level"),
        F.when(F.col("n_parent_pre") == 0, (F.col("_t") if inside else F.col("_tp")).cast("long")).otherwise(-(F.col("_t").cast("long") * 1_000_000 + F.col("n_parent_pre") + 1)).alias("parent_pre"),
        *(F.col("n_" + c).alias(c) for c in ("kind", "prefix", "local_name", "ns_uri", "value", "ord")),
        F.array(at.cast("long"), F.lit(1).cast("long"), (-F.col("_l")).cast("long") if where == "after" else F.lit(0).cast("long"), F.col("n_pre").cast("long")).alias("_key"),
    )
    old = nodes.select("doc_id", F.col("pre").cast("long").alias("pre"), "size", "level", F.col("parent_pre").cast("long").alias("parent_pre"), *NODE_COLUMNS[4:], F.array(F.col("pre").cast("long")).alias("_key"))
    return renumber(old.unionByName(add))


def replace(nodes: DataFrame, targets: DataFrame, new: DataFrame) -> DataFrame:
    """The trees ``new`` in place of each target."""
    marked = insert(nodes, targets, new, "after")
    gone = targets.select("doc_id", "pre", "size")
    shift = _shift(targets, new)
    moved = gone.join(shift, ["doc_id", "pre"]).select("doc_id", (F.col("pre") + F.col("_by")).cast("int").alias("pre"), "size")
    return remove(marked, moved)


def _shift(targets: DataFrame, new: DataFrame) -> DataFrame:
    """How far each target moves when ``new`` is put after all targets: new's rows, for each target that ends before it."""
    n = new.filter("kind <> 'document'").groupBy(*(["doc_id"] if "doc_id" in new.columns else [])).agg(F.count(F.lit(1)).alias("_n"))
    a = targets.select("doc_id", "pre").alias("a")
    b = targets.select("doc_id", (F.col("pre") + F.col("size")).alias("e")).alias("b")
    before = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.e") < F.col("a.pre")), "left").groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.pre").alias("pre")).agg(F.count("b.e").alias("_c"))
    with_n = before.join(n, "doc_id") if "doc_id" in n.columns else before.crossJoin(n)
    return with_n.select("doc_id", "pre", (F.col("_c") * F.col("_n")).alias("_by"))


def set_attribute(nodes: DataFrame, targets: DataFrame, name: str, value) -> DataFrame:
    """With the attribute set on each target element; value is a constant or a Column of the target's row."""
    check_element_name(name)
    v = value if isinstance(value, Column) else F.lit(str(value))
    t = targets.filter("kind = 'element'").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_t"), F.col("level").alias("_l"), v.cast("string").alias("_v"))
    has = nodes.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("parent_pre") == F.col("_t")) & (F.col("kind") == "attribute") & (F.col("local_name") == name) & (F.col("prefix") == ""), "left")
    changed = has.withColumn("value", F.when(F.col("_t").isNotNull(), F.col("_v")).otherwise(F.col("value"))).select(*_ALL)
    old = nodes.filter((F.col("kind") == "attribute") & (F.col("local_name") == name) & (F.col("prefix") == "")).select(F.col("doc_id").alias("_xd"), F.col("parent_pre").alias("_xp"))
    fresh = t.join(old, (F.col("_d") == F.col("_xd")) & (F.col("_t") == F.col("_xp")), "left_anti")
    add = fresh.select(
        F.col("_d").alias("doc_id"), (-F.col("_t").cast("long") - 1).alias("pre"), F.lit(0).alias("size"), (F.col("_l") + 1).cast("int").alias("level"), F.col("_t").cast("long").alias("parent_pre"),
        F.lit("attribute").alias("kind"), F.lit("").alias("prefix"), F.lit(name).alias("local_name"), F.lit("").alias("ns_uri"), F.col("_v").alias("value"), F.lit(None).cast("int").alias("ord"),
        F.array(F.col("_t").cast("long"), F.lit(1).cast("long")).alias("_key"),
    )
    keep = changed.withColumn("pre", F.col("pre").cast("long")).withColumn("parent_pre", F.col("parent_pre").cast("long")).withColumn("_key", F.array("pre"))
    return renumber(keep.unionByName(add))


def remove_attribute(nodes: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    t = targets.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_t"))
    gone = nodes.filter((F.col("kind") == "attribute") & (F.concat_ws(":", F.when(F.col("prefix") != "", F.col("prefix")), "local_name") == name)).join(t, (F.col("doc_id") == F.col("_d")) & (F.col("parent_pre") == F.col("_t")), "left_semi")
    return remove(nodes, gone)


def rename(nodes: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """Elements, attributes or instructions with another local name."""
    check_element_name(name)
    t = targets.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_t"))
    return nodes.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_t")), "left").withColumn("local_name", F.when(F.col("_t").isNotNull(), F.lit(name)).otherwise(F.col("local_name"))).select(*_ALL)


def set_namespace(nodes: DataFrame, targets: DataFrame, prefix: str, uri: str) -> DataFrame:
    """Nodes with another prefix and URI; the declaration is the caller's to add."""
    t = targets.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_t"))
    n = nodes.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_t")), "left")
    hit = F.col("_t").isNotNull()
    return n.withColumn("prefix", F.when(hit, F.lit(prefix)).otherwise(F.col("prefix"))).withColumn("ns_uri", F.when(hit, F.lit(uri)).otherwise(F.col("ns_uri"))).select(*_ALL)


def set_value(nodes: DataFrame, targets: DataFrame, value) -> DataFrame:
    """Texts, CDATA, comments, instructions or attributes with another value; elements that hold text alone follow."""
    v = value if isinstance(value, Column) else F.lit(str(value))
    t = targets.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_t"), v.cast("string").alias("_v"))
    n = nodes.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_t")), "left").withColumn("value", F.when(F.col("_t").isNotNull(), F.col("_v")).otherwise(F.col("value")))
    return renumber(n.select(*_ALL).withColumn("_key", F.array(F.col("pre").cast("long"))))
