"""WARC archives: a writer with revisit records, and a reader that gives a chunked record table."""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_rows, fresh_path, keep_one, open_fs, text_of

#: Payloads below this many bytes are always stored; equal ones beyond it are stored once.
REVISIT_BYTES = 1000
#: An archive is closed once it holds this many uncompressed bytes.
ARCHIVE_BYTES = 64 << 20
#: Payload bytes in a row of the chunk table.
CHUNK_BYTES = 256 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = (
    "record_id string, record_type string, refers_to string, uri string, chunk_no long, chunk_offset long, data binary, running_sha1 string, running_bytes long, "
    "is_last boolean, declared_digest string, declared_bytes long, error string"
)
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("chunk_no", pa.int64()), ("chunk_offset", pa.int64()),
    ("data", pa.binary()), ("running_sha1", pa.string()), ("running_bytes", pa.int64()), ("is_last", pa.bool_()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()),
    ("error", pa.string()),
])


def urn(page_id) -> str:
    return "<urn:page:" + ("" if page_id is None else str(page_id)) + ">"


def record_head(page_id, url: str | None, kind: str, refers_to, digest: str, payload_bytes: int) -> bytes:
    """The WARC header and the HTTP header of a record; the HTTP header of a revisit states the length of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="%/:?#[]@!$&'()*+,;=~"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (payload_bytes if kind == 'response' else 0)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Archive:
    """One archive; appears under its name only once it is whole, so a retried or doubled task leaves no torn file."""

    def __init__(self, folder: str):
        self.fs, where = open_fs(folder)
        self.fs.create_dir(where, recursive=True)
        self.name = f"{where}/{uuid.uuid4().hex}.warc.gz"
        self.out, self.bytes, self.records = self.fs.open_output_stream(self.name + ".part", compression=None), 0, 0

    def add(self, *parts: bytes) -> None:
        with gzip.GzipFile(fileobj=self.out, mode="wb", compresslevel=1, mtime=0) as member:  # a member a record
            for part in parts:
                for at in range(0, len(part), 1 << 20):
                    member.write(part[at : at + (1 << 20)])
        self.bytes += sum(map(len, parts))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(self.name + ".part", self.name)
        return self.name, self.records, self.bytes


def write_warc(df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a WARC/1.1 record (one gzip member) per row of df into archives in ``folder``; returns its manifest, (archive, records, bytes).

    Payload is the column in UTF-8, null as empty. Of records with equal payloads of at least ``revisit_bytes`` bytes that
    with the largest id is a response, the others are revisits that refer to it; smaller ones are responses. Rows that
    share the id of the response are responses, too (their record ids don't tell them apart). A row without an id is a
    response with an empty record name and is referred to by none. A null url leaves its header out.

    Digests are computed and grouped before any payload moves (salted, so copies may be any share of the rows); payloads
    are shuffled once, to meet the decision made for their id. Only archives that the manifest names count: a retried task
    writes others.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    base = df.select(df[id_col].alias("_id"), (df[url_col].cast("string") if url_col else F.lit(None).cast("string")).alias("_url"), text_of(df, payload_col).alias("_html"))
    signed = base.select("*", F.sha1(F.encode("_html", "UTF-8")).alias("_sha"), F.octet_length("_html").cast("long").alias("_bytes"))
    ids = signed.filter(F.col("_id").isNotNull() & (F.col("_bytes") >= revisit_bytes)).select("_id", "_sha").distinct()
    copies = keep_one(ids, ["_sha"], ["_id"]).filter("_size > 1 and _id <> _keep._id").select("_id", "_sha", F.col("_keep._id").alias("_to"))
    decided = signed.join(copies.hint("shuffle_hash"), ["_id", "_sha"], "left")
    rows = decided.select(F.col("_id").cast("string").alias("id"), F.col("_url").alias("url"), F.encode("_html", "UTF-8").alias("payload"), F.col("_sha").alias("sha"), F.col("_to").cast("string").alias("to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, done = None, []
        for b in batches:
            for page, url, payload, sha, to in zip(*(b.column(i) for i in range(5)), strict=True):
                payload, kind, to = payload.as_py(), "response" if to.as_py() is None else "revisit", to.as_py()
                at = at or _Archive(folder)
                at.add(record_head(page.as_py(), url.as_py(), kind, to, sha.as_py(), len(payload)), payload if kind == "response" else b"", b"\r\n\r\n")
                if at.bytes >= archive_bytes:
                    done.append(at.close())
                    at = None
        if at:
            done.append(at.close())
        yield pa.RecordBatch.from_pydict({"archive": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}, schema=pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    manifest = folder.rstrip("/") + "-manifest"
    rows.mapInArrow(write, "archive string, records long, bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def _headers(f) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := f.readline(1 << 16)) not in (b"", b"\r\n", b"\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(f, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> Iterator[dict]:
    """Rows of the chunk table, from an uncompressed WARC stream. Never holds more than a chunk of a payload.

    A chunk carries the SHA-1 and the count of the payload's bytes up to its own end, so the last one has those of the
    whole payload. A payload of 0 bytes has one empty chunk. A revisit has one chunk without data; its digest and bytes
    are those declared. A digest or length that doesn't fit what was declared, and a cut stream, are told in ``error``.
    """
    while True:
        while (line := f.readline(1 << 16)) in (b"\r\n", b"\n"):
            pass
        if not line:
            return
        if not line.startswith(b"WARC/"):
            yield dict.fromkeys(_ARROW.names) | {"chunk_no": 0, "is_last": True, "error": "no WARC record where one should begin"}
            return
        head = _headers(f)
        left = int(head.get("content-length") or 0)
        said = head.get("warc-payload-digest", "")
        row = {
            "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"),
            "declared_digest": said.partition(":")[2] or None, "declared_bytes": None, "error": None,
        }
        if head.get("content-type", "").startswith("application/http"):
            while left > 0 and (line := f.readline(min(left, 1 << 16))):
                left -= len(line)
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    row["declared_bytes"] = int(value)
                if line in (b"\r\n", b"\n"):
                    break
        if row["record_type"] == "revisit":
            while left > 0 and (data := f.read(min(left, chunk_bytes))):
                left -= len(data)
            yield row | {"chunk_no": 0, "chunk_offset": 0, "data": None, "running_sha1": row["declared_digest"], "running_bytes": row["declared_bytes"], "is_last": True}
            continue
        digest, total, k = hashlib.sha1(), 0, 0
        while True:
            data = f.read(min(left, chunk_bytes)) if left else b""
            left -= len(data)
            digest.update(data)
            last = left == 0 or not data
            if last:
                if left:
                    row["error"] = f"{left} bytes are missing"
                elif row["declared_digest"] and row["declared_digest"].lower() != digest.hexdigest():
                    row["error"] = "the payload doesn't fit its digest"
                elif row["declared_bytes"] not in (None, total + len(data)):
                    row["error"] = "the payload doesn't fit its length"
            yield row | {"chunk_no": k, "chunk_offset": total, "data": data if with_data else None, "running_sha1": digest.hexdigest(), "running_bytes": total + len(data), "is_last": last}
            total += len(data)
            k += 1
            if last:
                break


def read_warc(spark: SparkSession, archives: list[str], *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives (``.warc`` or ``.warc.gz``), an archive a task; see read_records. An empty list gives no rows.

    ``with_data`` False leaves the bytes out, where only lengths and digests are wanted.
    """
    if not archives:
        return spark.createDataFrame([], CHUNKS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, where = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(where, compression=None) as raw, (gzip.GzipFile(fileobj=raw, mode="rb") if path.endswith(".gz") else raw) as plain, io.BufferedReader(plain, 1 << 20) as f:
                    for row in read_records(f, chunk_bytes, with_data):
                        rows.append(row)
                        held += len(row["data"] or b"") + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    # an archive a task: the list holds file names alone, as a file index does
    paths = spark.sparkContext.parallelize([(p,) for p in archives], len(archives)).toDF("archive string")
    return paths.mapInArrow(read, CHUNKS)


def archives_of(manifest: DataFrame) -> list[str]:
    return sorted(r[0] for r in manifest.select("archive").collect())


def round_trip(df: DataFrame, **options) -> DataFrame:
    """Writes df's records below the shared folder and reads them back: the chunk table without the bytes."""
    folder = fresh_path(df.sparkSession, "warc")
    return read_warc(df.sparkSession, archives_of(write_warc(df, folder, **options)), with_data=False)
