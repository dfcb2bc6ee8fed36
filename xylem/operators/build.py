"""Markup from rows: a builder of Columns, and the serializer of the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DocumentStructureError, SerializationError
from ..schema import NODE_COLUMNS
from ..validation import check_comment, check_declaration, check_element_name, check_entity_name, check_pi_target, check_prefix, check_uri, comment_ok, require


def escape_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_attribute(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&quot;"))


def _column(x) -> Column:
    if isinstance(x, Column):
        return F.coalesce(x.cast("string"), F.lit(""))
    return F.lit("" if x is None else "true" if x is True else "false" if x is False else str(x))


class Fragment:
    """A Column of markup; what isn't one is text and gets escaped."""

    def __init__(self, column: Column, is_root: bool = False):
        self.column, self.is_root = column, is_root


def text(x) -> Fragment:
    return Fragment(escape_text(_column(x)))


def raw(x) -> Fragment:
    """Markup as it is."""
    return Fragment(_column(x))


def cdata(x) -> Fragment:
    """]]> inside is split over two sections."""
    return Fragment(F.concat(F.lit("<![CDATA["), F.replace(_column(x), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")))


def comment(x) -> Fragment:
    if not isinstance(x, Column):
        return Fragment(F.lit(f"<!--{check_comment(str(x))}-->"))
    c = _column(x)
    return Fragment(F.concat(F.lit("<!--"), require(comment_ok(c), c, "not a valid comment"), F.lit("-->")))


def processing_instruction(target: str, data="") -> Fragment:
    return Fragment(F.concat(F.lit(f"<?{check_pi_target(target)} "), _column(data), F.lit("?>")))


def entity_reference(name: str) -> Fragment:
    return Fragment(F.lit(f"&{check_entity_name(name)};"))


def declaration(version: str = "1.0", encoding: str | None = "UTF-8", standalone: str | None = None) -> Fragment:
    check_declaration(version, encoding, standalone)
    said = f'<?xml version="{version}"' + (f' encoding="{encoding}"' if encoding else "") + (f' standalone="{standalone}"' if standalone else "") + "?>"
    return Fragment(F.lit(said))


def doctype(name: str, external_id: str | None = None, system_id: str | None = None) -> Fragment:
    check_element_name(name)
    rest = f' PUBLIC "{external_id}" "{system_id or ""}"' if external_id else f' SYSTEM "{system_id}"' if system_id else ""
    return Fragment(F.lit(f"<!DOCTYPE {name}{rest}>"))


def el(name: str, attributes: dict | None = None, *children, namespaces: dict[str, str] | None = None, prefix: str | None = None, expand_empty: bool = True) -> Fragment:
    """An element. Attributes whose Column is null are left out; children are Fragments, or text."""
    q = check_element_name(f"{check_prefix(prefix)}:{name}" if prefix else name)
    parts: list[Column] = [F.lit("<" + q)]
    for p, u in (namespaces or {}).items():
        check_prefix(p)
        parts.append(F.lit(f' xmlns{":" + p if p else ""}="{check_uri(u, p)}"'))
    for k, v in (attributes or {}).items():
        check_element_name(k)
        said = F.concat(F.lit(f' {k}="'), escape_attribute(_column(v)), F.lit('"'))
        parts.append(F.when(v.isNotNull(), said).otherwise(F.lit("")) if isinstance(v, Column) else said)
    inner = [c.column if isinstance(c, Fragment) else text(c).column for c in children]
    if inner or expand_empty:
        parts += [F.lit(">"), *inner, F.lit(f"</{q}>")]
    else:
        parts.append(F.lit("/>"))
    return Fragment(F.concat(*parts), True)


def elements(values: dict) -> Fragment:
    """An element of text for each name."""
    return Fragment(F.concat(*(el(k, None, v).column for k, v in values.items())))


def each(children: Column, render) -> Fragment:
    """Fragments of an array's items, in order: render takes an item's Column."""
    return Fragment(F.array_join(F.transform(children, lambda x: render(x).column), ""))


def group_children(df: DataFrame, keys: list[str], fragment: Fragment, order: list[str], name: str = "children") -> DataFrame:
    """(keys, name): a group's fragments, sorted and joined. A group becomes one string, so it must be one document's worth."""
    rows = df.select(*keys, F.struct(*order, fragment.column.alias("_x")).alias("_r"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_x"]), "").alias(name))


def document(*parts: Fragment) -> Column:
    """A document's Column: a declaration comes first, and exactly one element."""
    if sum(p.is_root for p in parts) != 1:
        raise DocumentStructureError("a document has one root element")
    return F.concat(*(p.column for p in parts))


def serialize(nodes: DataFrame, *, declaration: bool | None = None, encoding: str = "UTF-8", expand_empty: bool = True, indent: int = 0) -> DataFrame:
    """(doc_id, xml): documents from their nodes.

    Each node gives its opening mark at its position and its closing mark where its subtree ends; marks are sorted within
    a document, deepest end first. ``declaration`` None keeps what there was. ``indent`` puts elements that stand among
    elements alone on lines of their own.
    """
    if declaration is not None and encoding.upper() not in ("UTF-8", "UTF8", "US-ASCII", "ISO-8859-1", "UTF-16"):
        raise SerializationError("unknown encoding", encoding=encoding)
    q = F.concat_ws(":", F.when(F.col("prefix") != "", F.col("prefix")), "local_name")
    sides = nodes.filter("kind in ('attribute', 'namespace')")
    mark = F.when(F.col("kind") == "namespace", F.concat(F.lit(" xmlns"), F.when(F.col("local_name") != "", F.concat(F.lit(":"), "local_name")).otherwise(""), F.lit('="'), escape_attribute(F.col("value")), F.lit('"')))
    mark = mark.otherwise(F.concat(F.lit(" "), q, F.lit('="'), escape_attribute(F.coalesce("value", F.lit(""))), F.lit('"')))
    held = sides.groupBy("doc_id", F.col("parent_pre").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", mark.alias("m")))), lambda x: x["m"]), "").alias("_attrs"), F.count(F.lit(1)).alias("_n_attrs")).withColumnRenamed("doc_id", "_d")
    main = nodes.filter("kind not in ('attribute', 'namespace', 'document')").join(held, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left")
    kind, value = F.col("kind"), F.coalesce("value", F.lit(""))
    empty = F.col("size") == F.coalesce("_n_attrs", F.lit(0))
    closes = (kind == "element") & (~empty | F.lit(expand_empty))
    opening = (
        F.when(kind == "element", F.concat(F.lit("<"), q, F.coalesce("_attrs", F.lit("")), F.when(closes, ">").otherwise("/>")))
        .when(kind == "text", escape_text(value)).when(kind == "cdata", cdata(value).column).when(kind == "comment", F.concat(F.lit("<!--"), value, F.lit("-->")))
        .when(kind == "processing_instruction", F.concat(F.lit("<?"), "local_name", F.when(value != "", F.concat(F.lit(" "), value)).otherwise(""), F.lit("?>")))
        .when(kind == "entity_reference", F.concat(F.lit("&"), "local_name", F.lit(";")))
        .when(kind == "doctype", F.concat(F.lit("<!DOCTYPE "), "local_name", F.when(value != "", F.concat(F.lit(" "), value)).otherwise(""), F.lit(">")))
        .when(kind == "declaration", F.concat(F.lit("<?xml "), value, F.lit("?>")) if declaration is None else F.lit(""))
    )
    pad = F.lit("")
    if indent:
        mixed = nodes.filter("kind in ('text', 'cdata', 'entity_reference')").select(F.col("doc_id").alias("_md"), F.col("parent_pre").alias("_mp")).distinct().withColumn("_mixed", F.lit(True))
        main = main.join(mixed, (F.col("doc_id") == F.col("_md")) & (F.col("parent_pre") == F.col("_mp")), "left")
        own = mixed.select(F.col("_md").alias("_od"), F.col("_mp").alias("_op"), F.lit(True).alias("_own"))
        main = main.join(own, (F.col("doc_id") == F.col("_od")) & (F.col("pre") == F.col("_op")), "left")
        pad = F.when(F.col("_mixed").isNull() & (kind != "declaration"), F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), F.col("level") - 1))).otherwise("")
        inner = F.when(F.col("_own").isNull() & ~empty, F.concat(F.lit("\n"), F.repeat(F.lit(" " * indent), F.col("level") - 1))).otherwise("")
        ending = F.concat(inner, F.lit("</"), q, F.lit(">"))
        opening = F.concat(pad, opening)
    else:
        ending = F.concat(F.lit("</"), q, F.lit(">"))
    # at one position closing marks come first, the deepest first; an element's own opening comes before what it holds
    marks = main.select("doc_id", F.explode(F.array_compact(F.array(F.struct(F.col("pre").alias("at"), F.lit(1).alias("o"), F.lit(0).alias("d"), opening.alias("s")), F.when(closes, F.struct((F.col("pre") + F.col("size") + 1).alias("at"), F.lit(0).alias("o"), (-F.col("level")).alias("d"), ending.alias("s")))))).alias("_m"))
    joined = marks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_m")), lambda m: m["s"]), "").alias("xml"))
    docs = nodes.filter("kind = 'document'").select("doc_id").join(joined, "doc_id", "left")
    head = f'<?xml version="1.0" encoding="{encoding}"?>' if declaration else ""
    body = F.coalesce("xml", F.lit(""))
    return docs.select("doc_id", F.concat(F.lit(head), F.ltrim(body) if indent else body).alias("xml"))


def inner_xml(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, pre, xml): the markup inside each element of ``of``."""
    o = of.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_o"), F.col("size").alias("_s")).distinct()
    below = nodes.join(o, (F.col("doc_id") == F.col("_d")) & (F.col("pre") > F.col("_o")) & (F.col("pre") <= F.col("_o") + F.col("_s")) & ~((F.col("parent_pre") == F.col("_o")) & F.col("kind").isin("attribute", "namespace")))
    part = below.select(F.struct("doc_id", F.col("_o").alias("pre")).alias("doc_id"), *NODE_COLUMNS)
    heads = o.select(F.struct(F.col("_d").alias("doc_id"), F.col("_o").alias("pre")).alias("doc_id"), *(F.lit("document").alias(c) if c == "kind" else F.lit(None).cast(dict(nodes.dtypes)[c]).alias(c) for c in NODE_COLUMNS))
    return serialize(part.unionByName(heads)).select("doc_id.doc_id", "doc_id.pre", "xml")
