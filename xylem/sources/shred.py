"""Scans: documents to node rows, by an XML or a tolerant HTML scanner, one document at a time on the executors."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BackendError, NamespaceError, ParseError
from ..schema import NODE_COLUMNS, node_ddl
from .tree import TEXTUAL, Tree

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag closes.
CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
#: Elements beyond which such closing doesn't reach.
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Node rows that a batch holds at most.
STEP = 50_000


def shred_xml(xml: str, strict: bool = True) -> list[list]:
    return scan_xml(xml, strict).rows()


def scan_xml(xml: str, strict: bool = True) -> Tree:
    """The nodes of a well-formed document. External entities aren't read; references to undeclared entities are kept as nodes."""
    tree, parser = Tree(), expat.ParserCreate("utf-8")  # the text is decoded already, whatever its declaration says
    parser.buffer_text, parser.ordered_attributes = True, True
    parser.UseForeignDTD(True)
    state = {"cdata": None}
    parser.ExternalEntityRefHandler = lambda *_: 1

    def chars(data):
        if state["cdata"] is None:
            tree.text("text", data)
        else:
            state["cdata"].append(data)

    def cdata_end():
        tree.text("cdata", "".join(state["cdata"]))
        state["cdata"] = None

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tree.start, lambda _: tree.end(), chars
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: state.update(cdata=[]), cdata_end
    parser.CommentHandler = lambda d: tree.add("comment", None, d)
    parser.ProcessingInstructionHandler = lambda t, d: tree.add("processing_instruction", t, d)
    parser.SkippedEntityHandler = lambda n, p: None if p else tree.text("entity_reference", f"&{n};", n)
    parser.XmlDeclHandler = lambda v, e, s: tree.add("declaration", "xml", " ".join(x for x in (f'version="{v}"' if v else "", f'encoding="{e}"' if e else "", f'standalone="{"yes" if s else "no"}"' if s >= 0 else "") if x), counted=False)
    parser.StartDoctypeDeclHandler = lambda n, s, p, i: tree.add("doctype", n, " ".join(x for x in (f'PUBLIC "{p}"' if p else "", "SYSTEM" if s and not p else "", f'"{s}"' if s else "") if x), counted=False)
    try:
        parser.Parse(xml.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        if not strict:
            parser.buffer_text = False  # hands on the text before the error
            return tree.finish()
        raise ParseError(expat.ErrorString(e.code), line=e.lineno, column=e.offset, source=xml[:80]) from None
    return tree.finish()


_DECLARED = re.compile(rb"^<\?xml[^>]*?\sencoding\s*=\s*[\"']([A-Za-z][\w.\-]*)[\"']")
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(raw: bytes, encoding: str | None = None) -> str:
    """The text of a document's bytes: by ``encoding``, else its byte order mark, else its declaration, else as UTF-8."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            raw, encoding = raw[len(mark) :], encoding or name
            break
    if encoding is None and raw[:2] in (b"<\x00", b"\x00<"):
        encoding = "utf-16-le" if raw[:1] == b"<" else "utf-16-be"
    if encoding is None and (m := _DECLARED.match(raw)):
        encoding = m[1].decode("ascii")
    try:
        return raw.decode(encoding or "utf-8")
    except (LookupError, UnicodeDecodeError) as e:
        raise ParseError("bytes that aren't of their encoding", encoding=encoding or "utf-8", reason=str(e)) from None


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tree, self.names = Tree(), []

    def handle_starttag(self, tag, attrs):
        if closes := CLOSES.get(tag):
            fence = FENCES.get(tag, ())
            for k in range(len(self.names) - 1, -1, -1):
                if self.names[k] in closes:
                    self._close(k)
                elif self.names[k] in fence or tag not in FENCES:
                    break
        self.tree.start(tag, [x for k, v in dict(reversed(attrs)).items() for x in (k, v or "")], namespaces=False)
        self.names.append(tag)
        if tag in VOID:
            self._close(len(self.names) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in self.names:
            self._close(len(self.names) - 1 - self.names[::-1].index(tag))

    def _close(self, k: int) -> None:
        while len(self.names) > k:
            self.names.pop()
            self.tree.end()

    def handle_data(self, data):
        self.tree.text("text", data)

    def handle_comment(self, data):
        self.tree.add("comment", None, data)

    def handle_pi(self, data):
        target, _, rest = data.rstrip("?").partition(" ")
        self.tree.add("processing_instruction", target, rest)

    def handle_decl(self, decl):
        name = decl.split()
        self.tree.add("doctype", name[1] if len(name) > 1 else "", " ".join(name[2:]), counted=False)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.tree.text("cdata", data[6:])


def scan_html(html: str, strict: bool = False, references: Iterable[str] | None = None) -> Tree:
    """The nodes of any text, read as HTML: names in lower case, void elements empty, open elements closed where they must be.

    ``references``: names of the character references that are decoded, where a semicolon ends them; all others stay as
    they stand. None: all that HTML knows.
    """
    p, mark = _Html(), ""
    if references is not None:
        mark = next(c for c in map(chr, range(0xE000, 0x10FFFE)) if c not in html)  # in place of each & that stays
        html = re.sub(f"&(?!(?:{'|'.join(map(re.escape, references))});)", mark, html)
    p.feed(html)
    p.close()
    t = p.tree.finish()
    if mark and mark in html:
        for c in (t.names, t.values):
            c[:] = [v.replace(mark, "&") if v else v for v in c]
    return t


BACKENDS: dict[str, Callable[[str, bool], Tree]] = {"xml": scan_xml, "html": scan_html}


def reader(backend: str = "xml", mode: str = "permissive", fragment: bool = False, encoding: str | None = None, references: Iterable[str] | None = None) -> Callable[[str | bytes | None], tuple[Tree, str | None]]:
    """From a document, text or bytes, to its nodes and what is wrong with it; see shred."""
    if backend not in BACKENDS:
        raise BackendError("unknown scanner", backend=backend, known=", ".join(BACKENDS))
    scan = BACKENDS[backend]
    if references is not None:
        if backend != "html":
            raise BackendError("references are chosen for HTML alone", backend=backend)
        scan = partial(scan_html, references=tuple(references))

    def read(text: str | bytes | None) -> tuple[Tree, str | None]:
        try:
            if text is None:
                raise ParseError("no document")
            text = decode(text, encoding) if isinstance(text, bytes) else text
            text = f"<root>{text}</root>" if fragment else text
            return scan(text, True), None
        except (ParseError, NamespaceError) as e:
            if mode == "failfast":
                raise
            return Tree().finish() if mode != "recover" or not isinstance(text, str) else _recovered(scan, text), str(e)

    return read


def markup_of(df: DataFrame, column: str) -> Column:
    return df[column] if dict(df.dtypes)[column] == "binary" else df[column].cast("string")


def shred(df: DataFrame, id_col: str = "doc_id", markup_col: str = "xml", *, backend: str = "xml", mode: str = "permissive", fragment: bool = False, names: Iterable[str] | None = None, encoding: str | None = None) -> DataFrame:
    """Node rows (doc_id, NODE_COLUMNS, error) of every document.

    permissive: a malformed document, or a null, gives its document row alone, with ``error``; recover: it gives the nodes
    before the error, open elements closed, and ``error``; failfast: it fails the query. ``fragment`` puts the markup into
    a root of its own. ``names`` keeps, besides the document, only elements and attributes with these names and the text
    in such elements, so what a query doesn't need never leaves the scanner. A binary column is decoded; see decode.
    """
    read, wanted = reader(backend, mode, fragment, encoding), frozenset(names) if names is not None else None
    kind = dict(df.dtypes)[id_col]
    kinds = [pa.int32()] * 4 + [pa.string()] * 5 + [pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            columns: list[list] = [[] for _ in kinds]

            def batch(b=b, at=at, columns=columns) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *NODE_COLUMNS, "error"])

            for i, text in enumerate(b.column(1)):
                tree, error = read(text.as_py())
                nodes = tree.columns() if wanted is None else _wanted(tree, wanted)
                for low in range(0, len(nodes[0]), STEP):  # a long document goes out in slices
                    n = len(nodes[0][low : low + STEP])
                    at += [i] * n
                    for c, values in zip(columns, nodes, strict=False):
                        c += values[low : low + STEP]
                    columns[-1] += [error] * n
                    if len(at) >= STEP:
                        yield batch()
                        at.clear()
                        for c in columns:
                            c.clear()
            if at:
                yield batch()

    return df.select(df[id_col], markup_of(df, markup_col)).mapInArrow(run, node_ddl(kind))


def _recovered(scan: Callable[[str, bool], Tree], text: str) -> Tree:
    try:
        return scan(text, False)
    except NamespaceError:
        return Tree().finish()


def _wanted(t: Tree, names: frozenset[str]) -> list[list]:
    """Columns of the document, the elements and attributes of these names, and all text in such elements."""
    kept, until = [], -1
    for i, kind in enumerate(t.kinds):
        if kind == "element":
            if t.names[i] not in names:
                continue
            until = max(until, i + t.sizes[i])
        elif kind == "attribute":
            if t.names[i] not in names:
                continue
        elif i and (kind not in TEXTUAL or i > until):
            continue
        kept.append(i)
    return [[c[i] for i in kept] for c in t.columns()]


def check_root(nodes: DataFrame) -> DataFrame:
    """(doc_id, roots) of the documents that don't have exactly one root element."""
    return nodes.groupBy("doc_id").agg(F.sum(F.when((F.col("level") == 1) & (F.col("kind") == "element"), 1).otherwise(0)).alias("roots")).filter("roots <> 1")


def declarations(df: DataFrame, id_col: str = "doc_id", markup_col: str = "xml") -> DataFrame:
    """(doc_id, has_declaration, version, encoding, standalone, doctype_name, external_id, system_id), read off the prolog, whatever its length, without scanning the rest."""
    head = F.trim(markup_col)
    part = lambda name: F.nullif(F.regexp_extract(head, rf"^<\?xml[^>]*\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    before = r"^(?:[^<]++|<!--(?s:.*?)-->|<\?(?s:.*?)\?>|<\?[^>]*+>)*+"  # possessive, so that a prolog of any length is a loop and not a recursion
    doctype = before + r"<!DOCTYPE\s+([^\s>\[]+)(?:\s+PUBLIC\s+[\"']([^\"']*)[\"'])?(?:\s+SYSTEM)?(?:\s*[\"']([^\"']*)[\"'])?"
    named = lambda k: F.nullif(F.regexp_extract(head, doctype, k), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), head.startswith("<?xml").alias("has_declaration"), part("version").alias("version"), part("encoding").alias("encoding"), part("standalone").alias("standalone"), named(1).alias("doctype_name"), named(2).alias("external_id"), named(3).alias("system_id"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, xml) of files, a document each; doc_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("xml"))


def read_records(spark: SparkSession, path: str, row_tag: str, schema: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for every ``row_tag`` element of files that may each be larger than memory."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("mode", mode)
    return (reader.schema(schema) if schema else reader).load(path)


def write_records(df: DataFrame, path: str, root_tag: str = "rows", row_tag: str = "row") -> None:
    df.write.format("xml").option("rootTag", root_tag).option("rowTag", row_tag).mode("overwrite").save(path)
