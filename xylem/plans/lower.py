"""From an XPath tree to a DataFrame: axis steps are joins on the node table, predicates are filters, semi-joins or windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..errors import XPathContextError, XPathNodeTypeError
from ..functions import xpath as X
from ..schema import NODE_COLUMNS, SIDE_KINDS, XML_NS
from .ast import REVERSE, Binary, Call, Filter, Literal, Negate, Node, Path, Step, Test, Union, Variable, positional, uses

TEXTUAL = ("text", "cdata", "entity_reference")


@dataclass
class Frame:
    """Rows of a node (NODE_COLUMNS) and its document, for origins ``o_pre``; per_doc: o_pre means nothing, the rows hold for every origin of the document."""

    df: DataFrame
    per_doc: bool = False

    @property
    def keys(self) -> list[str]:
        return ["doc_id"] if self.per_doc else ["doc_id", "o_pre"]


@dataclass
class Engine:
    """Lowers expressions against one node table."""

    nodes: DataFrame
    namespaces: dict[str, str] = field(default_factory=dict)
    variables: dict[str, object] = field(default_factory=dict)
    semantics: str = "xpath1"
    _n: int = 0

    @property
    def compat(self) -> bool:
        return self.semantics == "compat"

    def fresh(self, name: str) -> str:
        self._n += 1
        return f"_{name}{self._n}"

    # --- node-sets

    def node_set(self, e: Node, origins: DataFrame) -> Frame:
        """The nodes of e for each origin, each once. origins: rows of doc_id and NODE_COLUMNS, one a node."""
        if isinstance(e, Path):
            return self.path(e, origins)
        if isinstance(e, Union):
            frames = [self.node_set(p, origins) for p in e.parts]
            per_doc = all(f.per_doc for f in frames)
            parts = [self._spread(f, origins, per_doc) for f in frames]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            return Frame(df.dropDuplicates([*(["doc_id"] if per_doc else ["doc_id", "o_pre"]), "pre"]), per_doc)
        if isinstance(e, Filter):
            f = self.node_set(e.of, origins)
            return Frame(self.filtered(f.df, e.predicates, f.keys, False), f.per_doc)
        if isinstance(e, Call) and e.name == "id":
            return self._id(e.args[0], origins)
        raise XPathNodeTypeError("a node-set is needed here", found=type(e).__name__)

    def _spread(self, f: Frame, origins: DataFrame, per_doc: bool) -> DataFrame:
        if not f.per_doc or per_doc:
            return f.df.select("doc_id", "o_pre", *NODE_COLUMNS)
        return origins.select("doc_id", F.col("pre").alias("_o")).join(f.df, "doc_id").select("doc_id", F.col("_o").alias("o_pre"), *NODE_COLUMNS)

    def path(self, e: Path, origins: DataFrame) -> Frame:
        steps = list(e.steps)
        if e.start is not None:
            f = self.node_set(e.start, origins)
        elif e.absolute:
            # the document's own descendants and children need no join: they are all nodes, and those of level 1
            first = steps[0] if steps else None
            if first and first.axis in ("descendant", "child", "descendant-or-self"):
                steps.pop(0)
                here = self.nodes.filter(self.test(first.test, first.axis))
                if first.axis == "child":
                    here = here.filter("level = 1")
                elif first.axis == "descendant":
                    here = here.filter("level > 0")
                here = here.select("doc_id", F.lit(0).alias("o_pre"), *NODE_COLUMNS)
                f = Frame(self.filtered(here, first.predicates, ["doc_id"], False), True)
            else:
                f = Frame(self.nodes.filter("kind = 'document'").select("doc_id", F.lit(0).alias("o_pre"), *NODE_COLUMNS), True)
        else:
            f = Frame(origins.select("doc_id", F.col("pre").alias("o_pre"), *NODE_COLUMNS))
        for s in steps:
            f = Frame(self.step(f.df, s), f.per_doc)
        return f

    def test(self, t: Test, axis: str) -> Column:
        """Whether a node passes; nodes aside from the tree only on their own axes."""
        kind = F.col("kind")
        main = {"attribute": "attribute", "namespace": "namespace"}.get(axis, "element")
        if axis in ("attribute", "namespace"):
            side = kind == axis
        elif axis in ("self", "ancestor-or-self"):
            side = ~kind.isin("declaration", "doctype")  # an attribute is its own self
        else:
            side = ~kind.isin(*SIDE_KINDS)
        if t.type == "node":
            return side
        if t.type == "text":
            return side & kind.isin(*TEXTUAL)
        if t.type == "comment":
            return side & (kind == "comment")
        if t.type == "processing-instruction":
            ok = side & (kind == "processing_instruction")
            return ok & (F.col("local_name") == t.name) if t.name is not None else ok
        ok = side & (kind == main)
        if t.prefix is not None:
            if t.prefix in self.namespaces:
                ok &= F.coalesce(F.col("ns_uri"), F.lit("")) == self.namespaces[t.prefix]
            elif t.prefix == "xml":
                ok &= F.col("ns_uri") == XML_NS
            elif self.compat:
                ok &= F.col("prefix") == t.prefix
            else:
                raise XPathContextError("a prefix without a namespace", prefix=t.prefix)
        elif not self.compat and t.name != "*":
            ok &= F.coalesce(F.col("ns_uri"), F.lit("")) == (self.namespaces.get("", "") if axis not in ("attribute", "namespace") else "")
        if t.name != "*":
            ok &= F.lower("local_name") == t.name.lower() if self.compat else F.col("local_name") == t.name
        return ok

    def step(self, df: DataFrame, s: Step) -> DataFrame:
        keep = ["doc_id", "o_pre"]
        if s.axis == "self":
            out = df.filter(self.test(s.test, "self")).withColumn("_ctx", F.col("pre"))
            out = self.filtered(out, s.predicates, [*keep, "_ctx"], False)
            return out.select(*keep, *NODE_COLUMNS)
        c = df.select(F.col("doc_id").alias("c_doc"), "o_pre", *(F.col(x).alias("c_" + x) for x in ("pre", "size", "level", "parent_pre", "kind")))
        d = self.nodes.filter(self.test(s.test, s.axis))
        pre, size, c_pre, c_size = F.col("pre"), F.col("size"), F.col("c_pre"), F.col("c_size")
        tree = ~F.col("c_kind").isin("attribute", "namespace")
        on = {
            "child": (F.col("parent_pre") == c_pre),
            "attribute": (F.col("parent_pre") == c_pre),
            "parent": (pre == F.col("c_parent_pre")),
            "descendant": (pre > c_pre) & (pre <= c_pre + c_size),
            "descendant-or-self": (pre >= c_pre) & (pre <= c_pre + c_size),
            "ancestor": (pre < c_pre) & (c_pre <= pre + size),
            "ancestor-or-self": (pre <= c_pre) & (c_pre <= pre + size),
            "following": (pre > c_pre + c_size),
            "preceding": (pre + size < c_pre),
            "following-sibling": (F.col("parent_pre") == F.col("c_parent_pre")) & (pre > c_pre) & tree,
            "preceding-sibling": (F.col("parent_pre") == F.col("c_parent_pre")) & (pre < c_pre) & tree,
            "namespace": (F.col("parent_pre") <= c_pre) & (c_pre <= F.col("_scope")),
        }[s.axis]
        if s.axis == "namespace":
            owners = self.nodes.filter("kind = 'element'").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), (F.col("pre") + F.col("size")).alias("_scope"))
            d = d.join(owners, (F.col("doc_id") == F.col("_d")) & (F.col("parent_pre") == F.col("_p")))
        joined = d.join(c, (F.col("doc_id") == F.col("c_doc")) & on).withColumnRenamed("c_pre", "_ctx").select(*keep, "_ctx", *NODE_COLUMNS)
        if s.axis == "namespace":  # of equal prefixes the nearest; an empty URI takes the binding back
            w = W.partitionBy(*keep, "_ctx", "local_name").orderBy(F.desc("level"))
            joined = joined.withColumn("_k", F.row_number().over(w)).filter("_k = 1 and value <> ''").drop("_k")
        out = self.filtered(joined, s.predicates, [*keep, "_ctx"], s.axis in REVERSE)
        out = out.select(*keep, *NODE_COLUMNS)
        # a child or attribute has one parent, so these steps make no node twice
        return out if s.axis in ("child", "attribute") else out.dropDuplicates([*keep, "pre"])

    def filtered(self, df: DataFrame, predicates: tuple[Node, ...], groups: list[str], reverse: bool) -> DataFrame:
        """The rows that pass all predicates; places count within the groups, after each predicate anew."""
        columns = df.columns
        for p in predicates:
            bare = p.args[0] if isinstance(p, Call) and p.name == "not" else p
            if isinstance(bare, (Path, Union, Filter)) and not self._attribute(bare):
                inner, how = (p.args[0], "left_anti") if isinstance(p, Call) else (p, "left_semi")
                f = self.node_set(inner, self._origins(df))
                df = self._match(df, f, how)
                continue
            if positional(p):
                w = W.partitionBy(*groups)
                df = df.withColumn("_position", F.row_number().over(w.orderBy(F.desc("pre") if reverse else "pre")).cast("double"))
                if uses(p, "last"):
                    df = df.withColumn("_last", F.count(F.lit(1)).over(w).cast("double"))
            df, value, kind = self.value(p, df)
            ok = X.compare("=", F.col("_position"), value) if kind == "number" else X.to_boolean(value, kind)
            df = df.filter(ok).select(*columns)
        return df

    @staticmethod
    def _origins(df: DataFrame) -> DataFrame:
        return getattr(df, "_context", df).select("doc_id", *NODE_COLUMNS).dropDuplicates(["doc_id", "pre"])

    @staticmethod
    def _match(df: DataFrame, f: Frame, how: str) -> DataFrame:
        r = f.df.select(F.col("doc_id").alias("_d"), F.col("o_pre").alias("_o"))
        return df.join(r, F.col("doc_id").eqNullSafe(F.col("_d")) if f.per_doc else (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_o")), how)

    # --- values

    @staticmethod
    def _of(df: DataFrame, context: DataFrame) -> DataFrame:
        """df, marked as ``context`` with values joined to it: further values start from the bare context, so plans grow by their number and don't double."""
        df._context = getattr(context, "_context", context)
        return df

    def value(self, e: Node, df: DataFrame) -> tuple[DataFrame, Column, str]:
        """(df with what the value needs joined to it, the value, its kind). df: rows of doc_id and NODE_COLUMNS, the context nodes."""
        if isinstance(e, Literal):
            return df, X.lit(e.value), e.kind
        if isinstance(e, Variable):
            if e.name not in self.variables:
                raise XPathContextError("an unbound variable", variable=e.name)
            v = self.variables[e.name]
            return df, X.lit(v), "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        if isinstance(e, Negate):
            df, v, k = self.scalar(e.of, df, "number")
            return df, -v, k
        if isinstance(e, Binary):
            return self._binary(e, df)
        if isinstance(e, Call) and e.name != "id":
            return self._call(e, df)
        return self._first(e, df)

    def scalar(self, e: Node, df: DataFrame, kind: str) -> tuple[DataFrame, Column, str]:
        """The value as a kind; a node-set as boolean asks whether there is any."""
        if kind == "boolean" and (name := self._attribute(e)):
            df = self.with_attributes(df)
            return df, F.col("_attrs")[name].isNotNull(), "boolean"
        if kind == "boolean" and self._is_nodes(e):
            df, v = self._aggregate(e, df, lambda f: F.count(F.lit(1)) > 0, F.lit(False))
            return df, v, "boolean"
        df, v, k = self.value(e, df)
        return df, {"number": X.to_number, "string": X.to_string, "boolean": X.to_boolean}[kind](v, k), kind

    @staticmethod
    def _is_nodes(e: Node) -> bool:
        return isinstance(e, (Path, Union, Filter)) or isinstance(e, Call) and e.name == "id"

    def with_string(self, df: DataFrame) -> DataFrame:
        """df with ``sv``, the nodes' string values. Elements with element children have theirs joined from the text below them."""
        inner = df.filter("value is null").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("size").alias("_s")).distinct()
        texts = self.nodes.filter(F.col("kind").isin(*TEXTUAL)).select("doc_id", F.col("pre").alias("_t"), F.col("value").alias("_v"))
        met = inner.join(texts, (F.col("doc_id") == F.col("_d")) & (F.col("_t") > F.col("_p")) & (F.col("_t") <= F.col("_p") + F.col("_s")))
        joined = met.groupBy("_d", "_p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_t", "_v"))), lambda x: x["_v"]), "").alias("_sv"))
        return df.join(joined, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left").withColumn("sv", F.coalesce("value", "_sv", F.lit(""))).drop("_d", "_p", "_sv")

    def _attribute(self, e: Node) -> str | None:
        """The name, if e is a plain attribute of the context node: ``@name``."""
        if isinstance(e, Path) and not e.absolute and e.start is None and len(e.steps) == 1 and not self.compat:
            s = e.steps[0]
            if s.axis == "attribute" and not s.predicates and s.test.type == "name" and s.test.prefix is None and s.test.name != "*":
                return s.test.name
        return None

    def with_attributes(self, df: DataFrame) -> DataFrame:
        """df with ``_attrs``, a map of each node's attributes without namespace: one join, however many are asked for."""
        if "_attrs" in df.columns:
            return df
        a = self.nodes.filter("kind = 'attribute' and coalesce(ns_uri, '') = ''").groupBy(F.col("doc_id").alias("_ad"), F.col("parent_pre").alias("_ap")).agg(F.map_from_entries(F.collect_list(F.struct("local_name", "value"))).alias("_attrs"))
        return self._of(df.join(a, (F.col("doc_id") == F.col("_ad")) & (F.col("pre") == F.col("_ap")), "left").drop("_ad", "_ap"), df)

    def _aggregate(self, e: Node, df: DataFrame, agg, empty: Column, strings: bool = False) -> tuple[DataFrame, Column]:
        """df with agg over e's nodes of each row joined to it, or ``empty``."""
        f = self.node_set(e, self._origins(df))
        name = self.fresh("v")
        rows = self.with_string(f.df) if strings else f.df
        got = rows.groupBy(*f.keys).agg(agg(f).alias(name))
        got = got.withColumnRenamed("doc_id", name + "d").withColumnRenamed("o_pre", name + "o")
        on = F.col("doc_id") == F.col(name + "d")
        if not f.per_doc:
            on &= F.col("pre") == F.col(name + "o")
        return self._of(df.join(got, on, "left").drop(name + "d", name + "o"), df), F.coalesce(F.col(name), empty)

    def _first(self, e: Node, df: DataFrame) -> tuple[DataFrame, Column, str]:
        if isinstance(e, Path) and not e.absolute and e.start is None and e.steps == (Step("self", Test("node")),):
            name = self.fresh("s")
            return self._of(self.with_string(df).withColumnRenamed("sv", name), df), F.col(name), "string"
        if name := self._attribute(e):
            df = self.with_attributes(df)
            return df, F.coalesce(F.col("_attrs")[name], F.lit("")), "string"
        df, v = self._aggregate(e, df, lambda f: F.min_by("sv", "pre"), F.lit(""), True)
        return df, v, "string"

    def _binary(self, e: Binary, df: DataFrame) -> tuple[DataFrame, Column, str]:
        if e.op in ("and", "or"):
            df, a, _ = self.scalar(e.left, df, "boolean")
            df, b, _ = self.scalar(e.right, df, "boolean")
            return df, (a & b) if e.op == "and" else (a | b), "boolean"
        if e.op in ("+", "-", "*", "div", "mod"):
            df, a, _ = self.scalar(e.left, df, "number")
            df, b, _ = self.scalar(e.right, df, "number")
            v = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: X.divide(a, b), "mod": lambda: X.modulo(a, b, self.compat)}[e.op]()
            return df, v, "number"
        left, right = self._is_nodes(e.left), self._is_nodes(e.right)
        if (left or right) and not self.compat:
            return self._exists_compare(e, df, left, right)
        df, a, ka = self.value(e.left, df)
        df, b, kb = self.value(e.right, df)
        return df, self._compare(e.op, a, ka, b, kb), "boolean"

    def _compare(self, op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
        if op not in ("=", "!="):
            return X.compare(op, X.to_number(a, ka), X.to_number(b, kb))
        if self.compat:  # the left side's kind decides
            kind = ka
        else:
            kind = "boolean" if "boolean" in (ka, kb) else "number" if "number" in (ka, kb) else "string"
        if kind == "number":
            return X.compare(op, X.to_number(a, ka), X.to_number(b, kb))
        to = X.to_boolean if kind == "boolean" else X.to_string
        return (to(a, ka) == to(b, kb)) if op == "=" else (to(a, ka) != to(b, kb))

    def _exists_compare(self, e: Binary, df: DataFrame, left: bool, right: bool) -> tuple[DataFrame, Column, str]:
        """Whether some node (or pair of nodes) compares; against a boolean, whether there is any node."""
        name = self.fresh("e")
        one, other_side = (self._attribute(e.left), e.right) if left else (self._attribute(e.right), e.left)
        if one and not (left and right):
            df = self.with_attributes(df)
            df, v, k = self.value(other_side, df)
            a = F.col("_attrs")[one]
            if k == "boolean":
                x, kx = a.isNotNull(), "boolean"
                return df, self._compare(e.op, x, kx, v, k) if left else self._compare(e.op, v, k, x, kx), "boolean"
            x = F.coalesce(a, F.lit(""))
            return df, a.isNotNull() & (self._compare(e.op, x, "string", v, k) if left else self._compare(e.op, v, k, x, "string")), "boolean"
        origins = self._origins(df)
        if left and right:
            a, b = self.node_set(e.left, origins), self.node_set(e.right, origins)
            x = self.with_string(a.df).select("doc_id", "o_pre", F.col("sv").alias("_a"))
            y = self.with_string(b.df).select(F.col("doc_id").alias("_d"), F.col("o_pre").alias("_o"), F.col("sv").alias("_b"))
            on = F.col("doc_id") == F.col("_d")
            if not a.per_doc and not b.per_doc:
                on &= F.col("o_pre") == F.col("_o")
            met = x.join(y, on & self._compare(e.op, F.col("_a"), "string", F.col("_b"), "string"))
            per_doc = a.per_doc and b.per_doc
            hit = met.select("doc_id", (F.col("_o") if a.per_doc else F.col("o_pre")).alias("o_pre"))
        else:
            nodes, other = (e.left, e.right) if left else (e.right, e.left)
            op = e.op if left else {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(e.op, e.op)
            with_other, v, k = self.value(other, origins)
            if k == "boolean":
                df, has, _ = self.scalar(nodes, df, "boolean")
                df, v, k = self.value(other, df)
                return df, self._compare(op, has, "boolean", v, k), "boolean"
            f = self.node_set(nodes, origins)
            rows = self.with_string(f.df)
            if isinstance(other, (Literal, Variable)):
                per_doc = f.per_doc
            else:  # the other side depends on the origin
                side = with_other.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_o"), v.alias("_other"))
                rows = rows.join(side, (F.col("doc_id") == F.col("_d")) & (F.lit(True) if f.per_doc else F.col("o_pre") == F.col("_o")))
                rows = rows.withColumn("o_pre", F.col("_o"))
                v, per_doc = F.col("_other"), False
            hit = rows.filter(self._compare(op, F.col("sv"), "string", v, k)).select("doc_id", "o_pre")
        keys = ["doc_id"] if per_doc else ["doc_id", "o_pre"]
        got = hit.select(*keys).distinct().withColumn(name, F.lit(True)).withColumnRenamed("doc_id", name + "d").withColumnRenamed("o_pre", name + "o")
        on = F.col("doc_id") == F.col(name + "d")
        if not per_doc:
            on &= F.col("pre") == F.col(name + "o")
        return self._of(df.join(got, on, "left").drop(name + "d", name + "o"), df), F.coalesce(F.col(name), F.lit(False)), "boolean"

    def _call(self, e: Call, df: DataFrame) -> tuple[DataFrame, Column, str]:
        n, kind = e.name, e.kind
        if n in ("position", "last"):
            if "_" + n not in df.columns:
                raise XPathContextError(f"{n}() has a meaning in predicates only")
            return df, F.col("_" + n), kind
        if n in ("true", "false"):
            return df, F.lit(n == "true"), kind
        if n in ("count", "sum"):
            if not self._is_nodes(e.args[0]):
                raise XPathNodeTypeError(f"{n}() needs a node-set")
            if n == "count":
                df, v = self._aggregate(e.args[0], df, lambda f: F.count(F.lit(1)).cast("double"), F.lit(0.0))
            else:
                df, v = self._aggregate(e.args[0], df, lambda f: F.sum(X.to_number(F.col("sv"), "string")), F.lit(0.0), True)
            return df, v, kind
        if n in ("local-name", "name", "namespace-uri"):
            column = {"local-name": F.col("local_name"), "name": F.concat_ws(":", F.when(F.col("prefix") != "", F.col("prefix")), "local_name"), "namespace-uri": F.col("ns_uri")}[n]
            named = F.when(F.col("kind").isin("element", "attribute", "processing_instruction", "namespace"), F.coalesce(column, F.lit(""))).otherwise("")
            if not e.args:
                return df, named, kind
            df, v = self._aggregate(e.args[0], df, lambda f: F.min_by(named, F.col("pre")), F.lit(""))
            return df, v, kind
        if n == "lang":
            return self._lang(e, df)
        if n in ("boolean", "not"):
            df, v, _ = self.scalar(e.args[0], df, "boolean")
            return df, v if n == "boolean" else ~v, kind
        if n in ("string", "number", "string-length", "normalize-space") and not e.args:
            e = Call(n, (Path((Step("self", Test("node")),)),))
        wanted = {"number": "number", "floor": "number", "ceiling": "number", "round": "number"}.get(n, "string")
        args = []
        for k, a in enumerate(e.args):
            df, v, _ = self.scalar(a, df, "number" if n == "substring" and k else wanted)
            args.append(v)
        if n == "translate":
            words = [a.value for a in e.args[1:] if isinstance(a, Literal)]
            if len(words) != 2:
                raise XPathContextError("translate() takes literal characters")
            return df, X.translate(args[0], str(words[0]), str(words[1]), self.compat), kind
        f = {
            "string": lambda a: a, "number": lambda a: a, "concat": F.concat, "starts-with": lambda a, b: a.startswith(b), "contains": lambda a, b: a.contains(b),
            "substring-before": X.substring_before, "substring-after": X.substring_after, "substring": X.substring, "string-length": X.string_length,
            "normalize-space": X.normalize_space, "floor": X.floor, "ceiling": X.ceiling, "round": lambda a: X.round_(a, self.compat),
        }[n]
        return df, f(*args), kind

    def _lang(self, e: Call, df: DataFrame) -> tuple[DataFrame, Column, str]:
        """The nearest xml:lang of the node or above is the language, or one of its kinds (compat: the very same)."""
        df, wanted, _ = self.scalar(e.args[0], df, "string")
        name = self.fresh("l")
        marks = self.nodes.filter((F.col("kind") == "attribute") & (F.col("local_name") == "lang") & ((F.col("ns_uri") == XML_NS) | (F.col("prefix") == "xml"))).select(F.col("doc_id").alias("_d"), F.col("parent_pre").alias("_p"), F.col("value").alias("_v"))
        owners = self.nodes.filter("kind = 'element'").select(F.col("doc_id").alias("_e"), F.col("pre").alias("_q"), F.col("size").alias("_s"))
        scopes = marks.join(owners, (F.col("_d") == F.col("_e")) & (F.col("_p") == F.col("_q"))).select("_d", "_p", "_s", "_v")
        here = self._origins(df).select("doc_id", F.col("pre").alias(name + "o"))
        near = here.join(scopes, (F.col("doc_id") == F.col("_d")) & (F.col("_p") <= F.col(name + "o")) & (F.col(name + "o") <= F.col("_p") + F.col("_s")))
        got = near.groupBy(F.col("doc_id").alias(name + "d"), name + "o").agg(F.max_by("_v", "_p").alias(name))
        df = self._of(df.join(got, (F.col("doc_id") == F.col(name + "d")) & (F.col("pre") == F.col(name + "o")), "left").drop(name + "d", name + "o"), df)
        v = F.col(name)
        same = (v == wanted) if self.compat else (F.lower(v) == F.lower(wanted)) | F.lower(v).startswith(F.concat(F.lower(wanted), F.lit("-")))
        return df, F.coalesce(same, F.lit(False)), "boolean"

    def _id(self, arg: Node, origins: DataFrame) -> Frame:
        """Elements whose attribute id is one of the words of the argument, or of a node of it."""
        if self._is_nodes(arg):
            f = self.node_set(arg, origins)
            words = self.with_string(f.df).select("doc_id", "o_pre", F.explode(F.split(F.trim("sv"), r"[ \t\r\n]+")).alias("_w"))
            per_doc = f.per_doc
        else:
            df, v, k = self.value(arg, origins)
            words = df.select("doc_id", F.col("pre").alias("o_pre"), F.explode(F.split(F.trim(X.to_string(v, k)), r"[ \t\r\n]+")).alias("_w"))
            per_doc = False
        ids = self.nodes.filter("kind = 'attribute' and local_name = 'id'").select(F.col("doc_id").alias("_d"), F.col("parent_pre").alias("_p"), F.col("value").alias("_w"))
        hit = words.distinct().join(ids.withColumnRenamed("_d", "doc_id"), ["doc_id", "_w"]).select(F.col("doc_id").alias("_d"), "o_pre", "_p")
        out = self.nodes.join(hit, (F.col("doc_id") == F.col("_d")) & (F.col("pre") == F.col("_p"))).select("doc_id", "o_pre", *NODE_COLUMNS)
        return Frame(out.dropDuplicates(["doc_id", "o_pre", "pre"]), per_doc)
