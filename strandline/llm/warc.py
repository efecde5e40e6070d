"""WARC archives: writer, monolithic gzip normaliser with a sidecar index, reader.

``write_archives`` streams records into whole-file gzip archives.
``normalise`` inflates each such file once, rewrites every record as its own
gzip member and writes a sidecar offset index, so that any record can later be
read alone.  ``read_archives`` seeks by the index and yields records.

Files live in the shared folder.  A task writes under a name of its own and
reports it, and only names in the written manifest count: a lost task's files
are ignored, and a later stage starts from the manifest.

Defined results: a null payload is empty; of records with equal payloads the
rows with the smallest id are responses and the rest revisits (null ids come
last; where all ids are null every row is a response); an empty table gives no
archive and no rows; columns other than page_id, url and html are not read, so
their names cannot clash; ids of any type are kept whole; memory is bounded by
one record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, materialize, release, shuffle_partitions, slices, table

#: An archive is closed after so many bytes of records.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
DATE = "2020-01-01T00:00:00Z"


def _store(uri: str):
    """File system and path of a URI; plain local folders need no URI scheme."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- records -------------------------------------------------------------------


def record(kind: str, record_id: str, url: str, digest: str, length: int, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit holds the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    url = "".join(c for c in url if c not in "\r\n")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record or HTTP message, names in lower case; continuation lines are joined."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            fields[last] = value.strip()
    return fields


def inflate(stream, chunk: int = CHUNK):
    """Inflate a gzip stream of any number of members, piece by piece."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(chunk):
        while data:
            begun = True
            yield z.decompress(data, chunk)
            if z.eof:
                data, z, begun = z.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
            else:
                data = z.unconsumed_tail
    if begun:
        yield z.flush()
        if not z.eof:
            raise ValueError("the gzip stream is cut short")


def records(pieces):
    """Cut an inflated stream into whole records, by their Content-Length."""
    buffer = bytearray()
    pieces = iter(pieces)

    def fill(until) -> bool:
        while not until():
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        if not fill(lambda: b"\r\n\r\n" in buffer):
            if bytes(buffer).strip():
                raise ValueError("the archive ends inside a record")
            return
        head = buffer.index(b"\r\n\r\n") + 4
        size = head + int(parse_head(bytes(buffer[:head]))["content-length"]) + 4
        if not fill(lambda size=size: len(buffer) >= size):
            raise ValueError("the archive ends inside a record")
        yield bytes(buffer[:size])
        del buffer[:size]


def parse(data: bytes) -> dict:
    """Type, ids, digest and payload of one record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "payload_bytes": int(parse_head(http)["content-length"]), "payload": payload if fields["warc-type"] == "response" else None,
    }


def page_urn(page_id) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


# ---- distributed writer, normaliser and reader -----------------------------------


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, first: ``first`` is the page that holds the payload, null where this one does."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sized = pages.select("page_id", F.sha1(payload).alias("sha"), F.length(payload).alias("n"))
    # one row a payload that occurs more than once; partial sums take the heat out of hot payloads
    firsts = materialize(
        sized.filter(F.col("n") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null").drop("c"),
        "warc-firsts",
    )
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"))
    # a written table: Spark broadcasts it if it is small, else joins by the digest and splits skewed partitions
    return rows.join(firsts, "sha", "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")
    )


MANIFEST = "path string, records long, bytes long"
INDEX = "path string, offset long, length long, record_id string, record_type string"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, first) rows as monolithic gzip archives; returns the manifest."""

    def run(batches):
        import pyarrow as pa

        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        out = None
        for batch in slices(batches, "html"):
            for page_id, url, html, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, z, n, size = store.open_output_stream(name, compression=None), zlib.compressobj(4, zlib.DEFLATED, 31), 0, 0
                payload = (html or "").encode()
                kind = "response" if first is None else "revisit"
                data = record(kind, page_urn(page_id), url or "", payload_digest(payload), len(payload), payload, first if first is None else page_urn(first))
                out.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})

    return pages.select("page_id", "url", "html", "first").mapInArrow(run, MANIFEST)


def normalise_stream(source, target, level: int = 4):
    """Rewrite a gzip archive record by record; yields (offset, length, record)."""
    at = 0
    for data in records(inflate(source)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        target.write(member)
        yield at, len(member), data
        at += len(member)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path) of archives -> manifest of record-per-member archives, each with a sidecar index beside it."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = f"{base}/{uuid.uuid4().hex}.warc.gz"
                rows = []
                with store.open_input_stream(path, compression=None) as source, store.open_output_stream(name, compression=None) as target:
                    for at, size, data in normalise_stream(source, target):
                        head = parse_head(data.partition(b"\r\n\r\n")[0])
                        rows.append((at, size, head["warc-record-id"].strip("<>"), head["warc-type"]))
                offset, length, ids, kinds = zip(*rows, strict=True) if rows else ([], [], [], [])
                pq.write_table(
                    pa.table({"path": [name] * len(rows), "offset": list(offset), "length": list(length), "record_id": list(ids), "record_type": list(kinds)}),
                    name + ".idx", filesystem=store,
                )
                yield pa.RecordBatch.from_pydict({"path": [name], "records": [len(rows)], "bytes": [sum(length)]})

    spread = archives.select("path").repartition(shuffle_partitions(archives.sparkSession))
    return spread.mapInArrow(run, MANIFEST)


RECORD = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_archives(manifest: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records of normalised archives, each read by its offset in the sidecar index and checked against its digest."""
    schema = RECORD if payload else RECORD.removesuffix(", payload binary")
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                index = pq.read_table(path + ".idx", filesystem=store, columns=["offset", "length"])
                with store.open_input_file(path) as file:
                    rows, size = [], 0
                    for at, length in zip(index["offset"].to_pylist(), index["length"].to_pylist(), strict=True):
                        got = parse(b"".join(inflate(io.BytesIO(file.read_at(length, at)))))
                        if got["payload"] is not None and payload_digest(got["payload"]) != got["payload_digest"]:
                            raise ValueError(f"{path}: record {got['record_id']} does not match its digest")
                        rows.append(got)
                        size += len(got["payload"] or b"")
                        if size >= CHUNK * 4 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=_arrow(names))
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], schema=_arrow(names))

    spread = manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession))
    return spread.mapInArrow(run, schema)


def _arrow(names: list[str]):
    import pyarrow as pa

    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.schema([(n, kinds.get(n, pa.string())) for n in names])


def archive(pages: DataFrame, min_bytes: int = 0, keep_monolithic: bool = False) -> tuple[DataFrame, str]:
    """Write, deduplicate and normalise pages; returns the manifest of normalised archives and their folder."""
    spark = pages.sparkSession
    raw, folder = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    whole = materialize(write_archives(deduplicated(pages, min_bytes), raw), "warc-raw-manifest")
    done = materialize(normalise(whole, folder), "warc-manifest")
    release(spark)
    if not keep_monolithic:
        store, base = _store(raw)
        if os.path.basename(base).startswith("warc-raw") and store.get_file_info(base).type.name == "Directory":
            store.delete_dir(base)
    return done, folder


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    got = read_archives(*archive(pages), payload=False)
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(pages.schema["page_id"].dataType)
    return got.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
