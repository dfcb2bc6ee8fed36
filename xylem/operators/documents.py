"""Queries, changes and markup of whole documents: each is scanned, changed, asked and written in one pass on its worker.

No node table is made, so nothing is shuffled, kept on disk or joined. What it gives is what shred and the operators on
node tables give; those are for what crosses documents, or for node tables that are at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import DocumentStructureError
from ..plans.ast import Call, Filter, Path, Union, parse
from ..plans.local import Local
from ..schema import NODE_FIELDS
from ..sources import tree as T
from ..sources.shred import markup_of, reader, scan_xml
from ..validation import check_element_name

ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
KINDS = {"string": "string", "number": "double", "boolean": "boolean"}
#: A batch is handed on at so many rows, or when so many characters of markup have been read for it.
ROWS, CHARS = 10_000, 8_000_000

Rows = Callable[[T.Tree, object], Iterator[tuple]]


def _shows_nodes(e) -> bool:
    return isinstance(e, (Path, Union, Filter)) or isinstance(e, Call) and e.name == "id"


@dataclass(frozen=True)
class Documents:
    """A column of markup, read as shred reads it (backend, mode, fragment, encoding; references: see scan_html), and the changes to be made to each document."""

    df: DataFrame
    id_col: str = "doc_id"
    markup_col: str = "xml"
    backend: str = "xml"
    mode: str = "permissive"
    fragment: bool = False
    encoding: str | None = None
    references: tuple[str, ...] | None = None
    changes: tuple = ()

    def rows(self, columns: list[tuple[str, str]], make: Callable[[], Rows]) -> DataFrame:
        """(doc_id, columns): what make()(tree, markup) gives for each document. columns: names and types."""
        options, changes = (self.backend, self.mode, self.fragment, self.encoding, self.references), self.changes
        reader(*options)  # options without a meaning fail here, not on a worker
        kinds, names = [ARROW[k] for _, k in columns], ["doc_id", *(n for n, _ in columns)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read, of, change = reader(*options), make(), [c() for c in changes]
            for b in batches:
                at: list[int] = []
                held: list[tuple] = []
                chars = 0

                def batch(b=b, at=at, held=held) -> pa.RecordBatch:
                    made = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True))], names=names)
                    at.clear(), held.clear()
                    return made

                for i, cell in enumerate(b.column(1)):
                    text = cell.as_py()
                    tree, _ = read(text)
                    for c in change:
                        tree = c(tree)
                    for row in of(tree, text):
                        at.append(i)
                        held.append(row)
                        if len(at) >= ROWS:
                            yield batch()
                    chars += len(text or "")
                    if chars >= CHARS and at:
                        yield batch()
                        chars = 0
                if at:
                    yield batch()

        kind = dict(self.df.dtypes)[self.id_col]
        return self.df.select(self.df[self.id_col], markup_of(self.df, self.markup_col)).mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"`{n}` {k}" for n, k in columns)]))

    # --- questions

    def xpath(self, expression: str, *, namespaces: dict[str, str] | None = None, variables: dict[str, object] | None = None, semantics: str = "xpath1") -> DataFrame:
        """The expression's value for every document: (doc_id, value), or the nodes of a node-set (doc_id, NODE_COLUMNS). Rows have no order."""
        e, engine = parse(expression), Local(namespaces or {}, variables or {}, semantics)
        if _shows_nodes(e):
            engine.nodes(e)  # an expression without a meaning fails here, not on a worker

            def nodes() -> Rows:
                f = engine.nodes(e)
                return lambda t, _: (t.row(i) for i in f(t, 0))

            return self.rows([(n, k.simpleString()) for n, k in NODE_FIELDS], nodes)
        _, kind = engine.value(e)

        def value() -> Rows:
            v, _ = engine.value(e)
            return lambda t, _: iter(((v(t, 0, 0, 0),),))

        return self.rows([("value", KINDS[kind])], value)

    def extract(self, record: str, columns: dict[str, str], *, namespaces: dict[str, str] | None = None, variables: dict[str, object] | None = None, semantics: str = "xpath1") -> DataFrame:
        """A row for each node of ``record``: doc_id, pre, and for each column its expression's value there.

        A node-set gives the text of its first node, null where it is empty.
        """
        engine = Local(namespaces or {}, variables or {}, semantics)
        of, asked = parse(record), {n: parse(e) for n, e in columns.items()}

        def compiled() -> tuple[list, list[str]]:
            got = [_first_text(engine, e) if _shows_nodes(e) else engine.value(e) for e in asked.values()]
            return [v for v, _ in got], [k for _, k in got]

        engine.nodes(of)
        _, kinds = compiled()

        def make() -> Rows:
            f, (values, _) = engine.nodes(of), compiled()
            return lambda t, _: ((i, *(v(t, i, 0, 0) for v in values)) for i in f(t, 0))

        return self.rows([("pre", "int"), *((n, KINDS[k]) for n, k in zip(columns, kinds, strict=True))], make)

    def attributes(self) -> DataFrame:
        """(doc_id, pre, attributes map of qualified names): a row for each element."""
        return self.rows([("pre", "int"), ("attributes", "map<string,string>")], lambda: lambda t, _: t.attribute_maps())

    def serialize(self, *, declaration: bool | None = None, encoding: str = "UTF-8", expand_empty: bool = True, original: str | None = None) -> DataFrame:
        """(doc_id, xml): documents as they are now; ``original`` names a column of what was read. For indented markup serialize a node table."""
        head = f'<?xml version="1.0" encoding="{encoding}"?>' if declaration else ""

        def make() -> Rows:
            return lambda t, text: iter(((head + T.markup(t, declaration, expand_empty), *([text] if original else [])),))

        return self.rows([("xml", "string"), *([(original, "string")] if original else [])], make)

    # --- changes

    def changed(self, targets: str, change: Callable[[T.Tree, list[int]], T.Tree], **options) -> Documents:
        """With a change to the nodes that ``targets`` finds in each document."""
        e, engine = parse(targets), Local(options.get("namespaces") or {}, options.get("variables") or {}, options.get("semantics", "xpath1"))
        engine.nodes(e)

        def make() -> Callable[[T.Tree], T.Tree]:
            f = engine.nodes(e)
            return lambda t: change(t, found) if (found := f(t, 0)) else t

        return replace(self, changes=(*self.changes, make))

    def remove(self, targets: str, **options) -> Documents:
        """Without the targets and all below them."""
        return self.changed(targets, lambda t, at: T.replaced(t, at, None), **options)

    def replace(self, targets: str, markup: str, **options) -> Documents:
        """The markup's trees in place of each target."""
        new = scan_xml(markup)
        return self.changed(targets, lambda t, at: T.replaced(t, at, new), **options)

    def insert(self, targets: str, markup: str, where: str = "last", **options) -> Documents:
        """With the markup's trees at each target: first or last inside, before, after. Text next to text stays apart."""
        if where not in ("first", "last", "before", "after"):
            raise DocumentStructureError("where is first, last, before or after", where=where)
        new = scan_xml(markup)
        return self.changed(targets, lambda t, at: T.inserted(t, at, new, where), **options)

    def set_attribute(self, targets: str, name: str, value: str, **options) -> Documents:
        """With the attribute set on each target element."""
        check_element_name(name)
        return self.changed(targets, lambda t, at: T.with_attribute(t, at, name, value), **options)


def _first_text(engine: Local, e) -> tuple[Callable, str]:
    """The text of the first node, null where there is none."""
    if name := engine.attribute(e):
        return lambda t, i, p, n: t.attribute(i, name), "string"
    f = engine.nodes(e)
    return lambda t, i, p, n: t.string(got[0]) if (got := f(t, i)) else None, "string"
