"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit that refers to one) and a metadata record. The request and the metadata
name the response in WARC-Concurrent-To. Files are made of gzip members, one per record. Reading gives one row per
record; assembling joins the records through their concurrent-to identifiers and gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import attach
from ..plans.stage import new_path, stage
from .tokenfile import open_fs
from .words import text_buffers

VERSION = b"WARC/1.1"
CHUNK = 1 << 16
GZIP_LEVEL = 1
NAMELESS = "-"  # stands for a null id in record names
SALTS = 32
DATE = "2024-01-01T00:00:00Z"  # pages carry no time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "file string, at long, record_id string, type string, concurrent_to string, target string, date string, "
    "payload_digest string, payload_bytes long, refers_to string, fields map<string,string>, payload binary"
)


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, name: str) -> str:
    """The same identifier for the same record in every run."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{name}')}"


def _clean(value: str | None) -> str:
    return " ".join((value or "").split())


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _name(page_id: int | None) -> str:
    return NAMELESS if page_id is None else str(page_id)


def capture_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> list[bytes]:
    """Request, response or revisit, and metadata of one page."""
    own_digest = digest(payload)
    name = f"{_name(page_id)}/{own_digest}"
    target, main = _clean(url), record_id("response", name)
    base = lambda kind, own: [("WARC-Type", kind), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
    size = str(len(payload))
    request = base("request", record_id("request", name)) + [("WARC-Concurrent-To", f"<{main}>"), ("Content-Type", "application/http;msgtype=request")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    answer = base(kind, main) + [("WARC-Payload-Digest", f"sha1:{own_digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        answer += [("WARC-Refers-To", f"<{record_id('response', f'{_name(refers_to)}/{own_digest}')}>"), ("WARC-Profile", REVISIT_PROFILE)]
    metadata = base("metadata", record_id("metadata", name)) + [("WARC-Concurrent-To", f"<{main}>"), ("Content-Type", "application/warc-fields")]
    return [
        _record(request, f"GET {target} HTTP/1.1\r\n\r\n".encode()),
        _record(answer, http if refers_to is not None else http + payload),
        _record(metadata, f"page-id: {_name(page_id)}\r\npayload-bytes: {size}\r\n".encode()),
    ]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = name = None
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:  # a name of its own per attempt
                name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                where, path = open_fs(name)
                out = where.open_output_stream(path, compression=None)
            data, at = text_buffers(batch.column(2))
            ids, urls, refers = (batch.column(k).to_pylist() for k in (0, 1, 3))
            for k in range(batch.num_rows):
                for record in capture_records(ids[k], urls[k], data[at[k]: at[k + 1]].tobytes(), refers[k]):
                    out.write(_member(record))
                    count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["file", "records"])

    return run


def write_captures(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as WARC captures; returns (file, records), the list of the files that count.

    Of pages with equal payloads the one with the largest id is the response, the others are revisits of it; null ids
    come after all others, and are responses if there is no other id. A null html is an empty payload; a null url an
    empty target. Every row makes a record. A record is named by id and payload, so rows that repeat both make records of
    one name; an id with several payloads makes several captures. An empty table writes no file. Payloads are never
    shuffled to find equals, only their digests; they move once, to meet their role. Digests and null ids that many rows
    share are salted.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    where, name = open_fs(folder)
    where.create_dir(name, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("name", F.coalesce(F.col("page_id").cast("string"), F.lit(NAMELESS)))
    named = stage(rows.select("page_id", "name", "sha").distinct(), "digests")
    leaders = named.groupBy("sha").agg(F.max("page_id").alias("leader"))
    role = attach(named, leaders, ["sha"], how="inner").select("name", "sha", F.when(~F.col("page_id").eqNullSafe(F.col("leader")), F.col("leader")).alias("refers"))
    nameless = F.col("name") == NAMELESS
    role = role.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(nameless, SALTS - 1).otherwise(0))))
    rows = rows.withColumn("salt", F.when(nameless, F.pmod(F.xxhash64("url"), F.lit(SALTS))).otherwise(0).cast("int"))
    cast = rows.join(role, ["name", "sha", "salt"]).select("page_id", "url", "html", "refers")
    return stage(cast.mapInArrow(_write(folder), "file string, records long"), "warc-files")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields["content-length"])]


def members(path: str) -> Iterator[tuple[int, bytes]]:
    """Start and content of each gzip member of a file, read in chunks."""
    where, name = open_fs(path)
    with where.open_input_stream(name, compression=None) as stream:
        start, data = 0, b""
        while True:
            unzip, out, used = zlib.decompressobj(31), [], 0
            while not unzip.eof:
                if not data:
                    data = stream.read(CHUNK)
                    if not data:
                        if used:
                            raise ValueError(f"{path}: ends inside the record at {start}")
                        return
                out.append(unzip.decompress(data))
                used += len(data) - len(unzip.unused_data)
                data = unzip.unused_data
            yield start, b"".join(out)
            start += used


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _read(with_payload: bool):
    def rows(file: str) -> Iterator[dict]:
        for at, data in members(file):
            fields, block = parse(data)
            kind = fields.get("warc-type")
            payload = block.partition(b"\r\n\r\n")[2] if kind in ("response", "revisit") and fields.get("content-type", "").startswith("application/http") else block
            notes = {}
            if kind == "metadata":
                notes = dict(line.split(": ", 1) for line in payload.decode("utf-8", "replace").split("\r\n") if ": " in line)
            said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind == "response" and said is not None and said != digest(payload):
                raise ValueError(f"{file}: payload of the record at {at} differs from its digest")
            yield {
                "file": file, "at": at, "record_id": _bare(fields.get("warc-record-id")), "type": kind, "concurrent_to": _bare(fields.get("warc-concurrent-to")),
                "target": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "payload_digest": said,
                "payload_bytes": len(payload), "refers_to": _bare(fields.get("warc-refers-to")), "fields": list(notes.items()), "payload": payload if with_payload else None,
            }

    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("target", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(file):
                    held.append(row)
                    size += row["payload_bytes"] if with_payload else 256
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_records(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the listed files (column `file`), checked against its payload digest; a damaged file raises."""
    dealt = files.select("file").repartition(max(1, files.count()), "file")
    return dealt.mapInArrow(_read(with_payload), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, response, requests array, metadata array, orphan boolean, copies long).

    A capture is a response, revisit or resource record; the records concurrent to it, whichever of the two names the
    other, belong to it. Records that name a capture that is not there form a row with a null response, marked as
    orphan. Records of one name are one record; copies says how many of the capture's own there are.
    """
    inner = [c for c in records.columns if c not in ("file", "at")]
    named = records.filter("record_id is not null").groupBy("record_id").agg(F.first(F.struct(*inner)).alias("record"), F.count(F.lit(1)).alias("copies"))
    rows = named.select("record.*", "copies")
    main = F.col("type").isin("response", "revisit", "resource")
    packed = F.struct(*[F.col(c) for c in inner]).alias("record")
    other = rows.filter(main & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    sides = rows.filter(~main).join(other, "record_id", "left")
    sides = sides.select(F.coalesce("capture", "concurrent_to", "record_id").alias("capture_id"), packed, F.lit(0).cast("long").alias("copies"))
    mains = rows.filter(main).select(F.col("record_id").alias("capture_id"), packed, "copies")
    kind = F.col("record.type")
    grouped = mains.unionByName(sides).groupBy("capture_id").agg(
        F.max(F.when(kind.isin("response", "revisit", "resource"), F.col("capture_id"))).alias("there"),
        F.sort_array(F.collect_list(F.when(kind == "request", F.struct("record.record_id", "record.target", "record.date", "record.payload_bytes")))).alias("requests"),
        F.sort_array(F.collect_list(F.when(kind == "metadata", F.struct("record.record_id", F.map_entries("record.fields").alias("fields"))))).alias("metadata"),
        F.first(F.when(kind.isin("response", "revisit", "resource"), F.col("record")), ignorenulls=True).alias("response"),
        F.max("copies").alias("copies"),
    )
    return grouped.select("capture_id", "response", "requests", "metadata", F.col("there").isNull().alias("orphan"), "copies")


def page_captures(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages, read the archives back, assemble the captures, and give per page
    (id, payload_bytes long, payload_digest string, record_type string, refers_to long), one row per row of `pages`."""
    files = write_captures(pages, folder, id_col, url_col, html_col)
    captures = assemble(read_records(files, with_payload=False)).filter(~F.col("orphan"))
    note = F.map_from_entries(F.col("metadata")[0]["fields"])
    flat = captures.select(
        F.col("response.record_id").alias("rid"), F.nullif(note["page-id"], F.lit(NAMELESS)).cast("long").alias("page"), note["payload-bytes"].cast("long").alias("bytes"), "copies",
        F.col("response.payload_bytes").alias("stored"), F.col("response.payload_digest").alias("sum"), F.col("response.type").alias("type"), F.col("response.refers_to").alias("refers"),
    )
    flat = stage(flat, "captures")
    referred = flat.filter("type = 'response'").select(F.col("rid").alias("refers"), F.col("page").alias("refers_to"))
    joined = attach(flat, referred, ["refers"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    size = F.when(F.col("type") == "response", F.col("stored")).otherwise(F.col("bytes"))
    return joined.select(F.col("page").alias(id_col), size.alias("payload_bytes"), F.col("sum").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
