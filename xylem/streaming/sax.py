"""Event scans: a row for each start, end, text and so on; records read off them; streams of XML files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = ("start_document", "end_document", "start_element", "end_element", "characters", "cdata", "comment", "processing_instruction", "error")
_ARROW = [("seq", pa.int64()), ("event", pa.string()), ("name", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("namespaces", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.string()))]
#: A document is fed to the scanner in slices of so many characters; a batch of events is handed on at so many rows, or when so many characters have been read for it.
SLICE, ROWS, CHARS = 1 << 17, 5_000, 1 << 20
DDL = "seq long, event string, name string, attributes map<string,string>, namespaces map<string,string>, text string, depth int, path array<string>"


class Handler:
    """Base of user handlers: a method for each event, called in document order; all do nothing, but ``on_error`` raises."""

    def on_start_document(self): ...
    def on_end_document(self): ...
    def on_start_element(self, name, attributes, namespaces): ...
    def on_end_element(self, name): ...
    def on_characters(self, text): ...
    def on_cdata(self, text): ...
    def on_comment(self, text): ...
    def on_processing_instruction(self, target, data): ...

    def on_error(self, error):
        raise error

    def on_warning(self, message): ...


class ElementHandler(Handler):
    """Keeps the path of open elements; subclasses call super()."""

    def __init__(self):
        self.path: list[str] = []

    def on_start_element(self, name, attributes, namespaces):
        self.path.append(name)

    def on_end_element(self, name):
        self.path.pop()

    @property
    def depth(self) -> int:
        return len(self.path)

    @property
    def current(self) -> str | None:
        return self.path[-1] if self.path else None

    @property
    def parent(self) -> str | None:
        return self.path[-2] if len(self.path) > 1 else None

    def inside(self, name: str) -> bool:
        return name in self.path

    def path_string(self, sep: str = "/") -> str:
        return sep + sep.join(self.path)

    def matches(self, pattern) -> bool:
        """A compiled pattern is searched in the path; a text must be the path, or its end if it doesn't begin with a slash."""
        s = self.path_string()
        return bool(pattern.search(s)) if hasattr(pattern, "search") else s == pattern or not pattern.startswith("/") and s.endswith("/" + pattern)


class BlockHandler(Handler):
    """Callables by event, as BlockHandler(start_element=f)."""

    def __init__(self, **blocks: Callable):
        for k, f in blocks.items():
            if not hasattr(self, "on_" + k):
                raise TypeError(f"no such event: {k}")
            setattr(self, "on_" + k, f)


def drive(xml: str, handler: Handler) -> None:
    """Scans the text and calls the handler for each event."""
    for _ in steps(xml, handler, len(xml)):
        pass


def steps(xml: str, handler: Handler, length: int = SLICE) -> Iterator[None]:
    """As drive, but stops after each slice of the text, for what was gathered to be taken away. A text isn't cut where a slice ends."""
    if not isinstance(handler, Handler):
        raise TypeError("a Handler is needed")
    p = expat.ParserCreate("utf-8")
    p.buffer_text, p.ordered_attributes = True, True
    cdata: list[list[str] | None] = [None]
    begun: list[str] = []  # the latest text, which goes on if it stood at the end of a slice
    cut = [False]

    def flush():
        cut[0] = False
        if begun:
            text = "".join(begun)
            begun.clear()
            handler.on_characters(text)

    def after_text(f):
        def call(*args):
            flush()
            return f(*args)

        return call

    def start(name, flat):
        pairs = list(zip(flat[::2], flat[1::2], strict=True))
        ns = {k[6:]: v for k, v in pairs if k == "xmlns" or k.startswith("xmlns:")}
        handler.on_start_element(name, {k: v for k, v in pairs if k != "xmlns" and not k.startswith("xmlns:")}, ns)

    def chars(data):
        if cdata[0] is not None:
            cdata[0].append(data)
            return
        if not cut[0]:
            flush()
        cut[0] = False
        begun.append(data)

    def cdata_end():
        text, cdata[0] = "".join(cdata[0] or []), None
        handler.on_cdata(text)

    def cdata_start():
        cdata[0] = []

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = after_text(start), after_text(handler.on_end_element), chars
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = after_text(cdata_start), cdata_end
    p.CommentHandler, p.ProcessingInstructionHandler = after_text(handler.on_comment), after_text(handler.on_processing_instruction)
    handler.on_start_document()
    try:
        for at in range(0, len(xml) or 1, length or 1):
            p.Parse(xml[at : at + length].encode("utf-8", "surrogatepass"), at + length >= len(xml))
            cut[0] = True
            yield
    except expat.ExpatError as e:
        flush()
        handler.on_error(e)
        return
    handler.on_end_document()


class _Rows(ElementHandler):
    def __init__(self, wanted: frozenset[str] = frozenset(EVENTS)):
        super().__init__()
        self.rows: list[tuple] = []
        self.wanted, self.seq = wanted, 0

    def _add(self, event, name=None, attributes=None, namespaces=None, text=None):
        if event in self.wanted:
            self.rows.append((self.seq, event, name, list((attributes or {}).items()), list((namespaces or {}).items()), text, len(self.path), list(self.path)))
        self.seq += 1

    def on_start_document(self):
        self._add("start_document")

    def on_end_document(self):
        self._add("end_document")

    def on_start_element(self, name, attributes, namespaces):
        super().on_start_element(name, attributes, namespaces)
        self._add("start_element", name, attributes, namespaces)

    def on_end_element(self, name):
        self._add("end_element", name)
        super().on_end_element(name)

    def on_characters(self, text):
        self._add("characters", text=text)

    def on_cdata(self, text):
        self._add("cdata", text=text)

    def on_comment(self, text):
        self._add("comment", text=text)

    def on_processing_instruction(self, target, data):
        self._add("processing_instruction", target, text=data)

    def on_error(self, error):
        self._add("error", text=str(error))


def sax_events(df: DataFrame, id_col: str = "doc_id", markup_col: str = "xml", events: list[str] | None = None) -> DataFrame:
    """(doc_id, seq, event, name, attributes, namespaces, text, depth, path) of every document's events; malformed ones end with an error event, nulls have that alone. ``events`` keeps only these."""
    wanted = frozenset(events or EVENTS)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            chars = 0

            def batch(b=b, at=at, rows=rows) -> pa.RecordBatch:
                columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), _ARROW, strict=True)]
                made = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", *(n for n, _ in _ARROW)])
                at.clear(), rows.clear()
                return made

            for i, cell in enumerate(b.column(1)):
                h, text = _Rows(wanted), cell.as_py()
                if text is None:
                    h._add("error", text="no document")
                for _ in steps(text, h) if text is not None else ():
                    for low in range(0, len(h.rows), ROWS):
                        part = h.rows[low : low + ROWS]
                        rows += part
                        at += [i] * len(part)
                        if len(at) >= ROWS:
                            yield batch()
                    h.rows.clear()
                rows += h.rows
                at += [i] * len(h.rows)
                chars += len(text or "")
                if at and (len(at) >= ROWS or chars >= CHARS):
                    yield batch()
                    chars = 0
            if at:
                yield batch()

    return df.select(df[id_col], df[markup_col].cast("string")).mapInArrow(run, f"doc_id {kind}, {DDL}")


def in_element(name: str) -> Column:
    return F.array_contains("path", name)


def path_string(sep: str = "/") -> Column:
    return F.concat(F.lit(sep), F.array_join("path", sep))


def records(events: DataFrame, record: str, fields: list[str], attributes: list[str] | None = None) -> DataFrame:
    """(doc_id, record_no, the record's attributes, its fields' text): a row for each ``record`` element, from events.

    Fields are elements directly in the record; of several of a name texts are joined in order. A missing field is null.
    """
    from pyspark.sql import Window as W

    number = F.sum(F.when((F.col("event") == "start_element") & (F.col("name") == record), 1).otherwise(0)).over(W.partitionBy("doc_id").orderBy("seq"))
    own = events.withColumn("record_no", number).filter(F.array_contains("path", record))
    depth = F.array_position("path", record)
    text = F.when(F.col("event").isin("characters", "cdata"), F.struct("seq", "text"))
    field = lambda f: F.array_sort(F.collect_list(F.when((F.element_at("path", -1) == f) & (F.size("path") == depth + 1), text)))
    held = lambda f: F.nullif(F.array_join(F.transform(field(f), lambda x: x["text"]), ""), F.lit(""))
    top = (F.col("event") == "start_element") & (F.col("name") == record)
    return own.groupBy("doc_id", "record_no").agg(*(F.max(F.when(top, F.col("attributes")[a])).alias(a) for a in attributes or []), *(held(f).alias(f) for f in fields))


def read_stream(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """A stream of the ``row_tag`` elements of XML files that arrive in a folder. Each file needs one root."""
    return spark.readStream.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by key and tumbling window, of events no later than ``late`` behind the newest."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
