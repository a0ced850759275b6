"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id, in ranges that depend on the rows alone
(``ranges``); each range's task writes numbered files, rolled once their compressed
size reaches ``roll_bytes``. A record is a gzip member of its own with fixed time
stamps, so the same rows always give the same files, however they were partitioned
and on however many cores. Files get their final names by a rename, and the manifest that Spark
commits says which files are part of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm import ranges
from roadtrace.llm.storage import join_hot, materialize, read_file, shared_folder, small_batches, write_committed

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes at which a file is rolled, and payload bytes of a range, which holds several files. For files of 1 GB
#: give ``roll_bytes`` 1 << 30 and ``per_task`` 16 << 30.
ROLL_BYTES, RANGE_BYTES, LEVEL = 2 << 20, 24 << 20, 4
#: Repeated payloads (about 60 bytes each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_PAYLOADS = 100_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, url, copy: int = 0) -> str:
    """The same for the same row; ``copy`` tells rows of one id, URL and payload apart."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url or ""}' + (f'|{copy}' if copy else ''))}>"


def target_uri(url) -> str:
    """A URL without characters that a header cannot hold."""
    return "".join(c for c in url or "" if c.isprintable()) or "urn:none"


def _member(data: bytes) -> bytes:
    """One gzip member without time or name: equal data, equal bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return _member("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n")


def page_record(page_id, url, payload: bytes, refers_to, refers_url=None, copy: int = 0) -> bytes:
    """A response, or where ``refers_to`` (page_id of the response, ``refers_url`` its URL) is given a revisit, whose block has the HTTP header alone."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url, copy)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target_uri(url)), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url)), ("WARC-Refers-To-Target-URI", target_uri(refers_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record(headers, block)


def _info(name: str) -> bytes:
    block = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, None)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")], block)


def first_of_each_payload(pages: DataFrame) -> DataFrame:
    """pages with _size, _sha (of the payload), _response, the largest page_id of rows with an equal payload (null: none has an id), and _response_url, that row's (the largest of several)."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("_sha", F.sha1(raw)).withColumn("_size", F.octet_length(raw).cast("long"))
    keyed = rows.withColumn("_key", F.concat_ws(":", "_sha", "_size"))
    groups = materialize(keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("_to")), "payloads")
    groups = groups.select("_key", "_n", F.col("_to.page_id").alias("_response"), F.col("_to.url").alias("_response_url"))
    shared = groups.where(F.col("_n") > 1)  # a payload of one row is its own response
    if shared.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS:
        out = keyed.join(F.broadcast(shared.select("_key", "_response", "_response_url")), "_key", "left")
    else:
        total = groups.agg(F.sum("_n")).head()[0] or 0
        out = join_hot(keyed, shared, "_key", "_n", total, ["_response", "_response_url"])
    return out.withColumn("_response", F.coalesce("_response", "page_id"))


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, per_task: int = RANGE_BYTES, min_bytes: int = 0) -> DataFrame:
    """Write all rows in ascending page_id and return the manifest (file, part, number, n_records, n_bytes).

    Of rows with equal payloads of at least ``min_bytes`` the one with the largest
    page_id is the response (repeated rows of that id all are) and the others
    revisit it; a payload of rows without an id has responses only. A null html
    is an empty payload, a null url ``urn:none``; null ids come first; unprintable
    characters are left out of a URL. Record ids follow from page_id and url, and for
    rows that repeat both from their place among those in a range (rows wholly alike that
    fill several ranges share the id of each range's first). A revisit names its response by the
    format's own headers. An empty table has an empty manifest. Other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = first_of_each_payload(pages)
    revisit = (F.col("_size") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_response")) & F.col("_response").isNotNull()
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.struct(F.col("_response").alias("page_id"), F.col("_response_url").alias("url"))).alias("_refers_to"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    parts = ranges.cut(own, "page_id", ["url", "html"], F.octet_length("html"), per_task)
    ranged = ranges.deal(rows, parts, "page_id", ["url", "html"], carried=["_refers_to"])

    def write(batches):
        part, number, n, held, size = None, 0, 0, [], 0
        last, copies = None, 0

        def roll():
            name = f"{folder}/part-{part:07d}-{number:05d}.warc.gz"
            data = [_info(name.rsplit("/", 1)[1]), *held]
            write_committed(name, data)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([sum(map(len, data))], pa.int64())], names=["file", "part", "number", "n_records", "n_bytes"])

        for batch in batches:
            for page, url, html, to, many, at in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if at != part:
                    if held:
                        yield roll()
                    part, number, n, held, size = at, 0, 0, [], 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                if (page, url or "") != last:
                    last, copies = (page, url or ""), 0
                for _ in range(many):
                    # rows of one id and URL are neighbours
                    own = page_record(page, url, payload, to and to["page_id"], to and to["url"], copies and part << 32 | copies)
                    copies += 1
                    held.append(own)
                    n, size = n + 1, size + len(own)
                    if size >= roll_bytes:
                        yield roll()
                        number, n, held, size = number + 1, 0, [], 0
        if held:
            yield roll()

    columns = ranged.select("page_id", "url", "html", "_refers_to", "_n", "_part")
    return materialize(columns.mapInArrow(write, "file string, part int, number int, n_records long, n_bytes long"), "warc-manifest")


def _members(data: bytes, step: int = 1 << 16):
    """The decompressed gzip members of a file, fed in small pieces: what follows a member would be copied at its end."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the last member is cut off")
            parts.append(z.decompress(view[at : at + step]))
            at = min(at + step, len(view))
        at -= len(z.unused_data)
        yield b"".join(parts)


def parse_warc(data: bytes):
    """(headers, block) of each record of a file of gzip members."""
    for raw in _members(data):
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if first != VERSION:
            raise ValueError(f"not a {VERSION} record")
        headers = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(headers["Content-Length"])]
        if headers.get("WARC-Block-Digest") != f"sha1:{base32_sha1(block)}":
            raise ValueError("block digest differs")
        yield headers, block


def read_warc(manifest: DataFrame) -> DataFrame:
    """Per page record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (responses)."""

    def read(batches):
        for files in batches:
            for name in files.column("file").to_pylist():
                rows = []
                for headers, block in parse_warc(read_file(name)):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = headers["WARC-Type"] == "response"
                    if response and (len(payload) != size or base32_sha1(payload) != digest):
                        raise ValueError("payload digest differs")
                    page, to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    rows.append((page, size, digest, headers["WARC-Type"], to, headers["WARC-Target-URI"], payload if response else None))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    text = pa.string()
    types = {"page_id": text, "payload_bytes": pa.int64(), "payload_digest": text, "record_type": text, "refers_to": text, "url": text, "payload": pa.binary()}
    files = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "file")
    rows = files.mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")
    return rows.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and return what reads back: the contract's columns."""
    manifest = write_warc(pages, shared_folder(pages.sparkSession, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
