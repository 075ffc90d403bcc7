"""WARC archives with a two-level capture index.

write(): every task writes one archive of gzip members, one per record, into the shared folder and returns each record's file, offset and length. A
file is named by a fresh id, so what a lost or repeated task has left is never referred to. Of records with equal payloads, the one with the
smallest page_id is a response and the others are revisits of it; payloads meet by digest; the html is
shuffled only where the list of shared payloads is too long to be broadcast.

build_index(): captures are sorted by reversed-host URL key and page_id over range partitions (so a key with very many captures spans several), and packed to
compressed blocks of BLOCK_LINES lines. The sparse directory is the blocks' first and last keys.
lookup() bisects the range partitions' bounds (one line per partition), then the directory of a partition, unpacks the blocks that can hold a key, and makes range reads of
the records. read_all() makes the range reads of all captures. archived() looks all urls up; a range partition has about SPAN_LINES captures, so a search holds no more.

Defined cases: a null html is an empty payload; a null url has the empty key and no target URI in its record; a null page_id is a response unless a record with
an id has its payload; rows that repeat the smallest page_id are responses all; control characters in a url are percent-encoded; an empty table gives empty results.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import parts_for
from ledgerlens.session import materialize, row_count, work_dir

BLOCK_LINES, ARCHIVE_BYTES, READ_BATCH, READ_BLOCKS, SPAN_LINES = 2048, 1 << 28, 256, 8, 1 << 17
CAPTURE = "url_key string, page_id long, file string, offset long, length long"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_URL = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: https://Www.Example.org/a?b -> org,example,www)/a?b"""
    if not url:
        return ""
    url = _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)
    found = _URL.match(url)
    if not found:
        return url
    return ",".join(reversed(found[1].lower().split("."))) + ")" + (found[2] or "/")


def _filesystem(uri: str):
    return fs.FileSystem.from_uri(uri)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; refers_to is the page of an equal payload, or null for a response."""
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """(page_id, payload bytes, digest, type, refers to): a response's figures are taken from its payload anew."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(x) if (x := fields[name][len("<urn:page:"):-1]) else None
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:], "revisit", number("WARC-Refers-To")
    payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    return number("WARC-Record-ID"), len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response", None


def write(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write a record per row; the captures, written as a table."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("sha1"))
    size = F.octet_length("payload")
    groups = rows.select("page_id", "sha1", size.alias("size")).filter(F.col("size") >= min_bytes)
    shared = materialize(
        groups.groupBy("sha1", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
        .select(F.col("sha1").alias("shared_sha1"), F.col("size").alias("shared_size"), "first_id"), "shared-payloads")
    revisits = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    ready = rows.join(shared, (F.col("sha1") == F.col("shared_sha1")) & (size == F.col("shared_size")), "left").select(
        "page_id", "url", "payload", "sha1", revisits.alias("refers_to"))

    def run(batches):
        out, offset, file = None, 0, ""
        try:
            for batch in batches:
                found = {n: [] for n in ("url_key", "page_id", "file", "offset", "length")}
                for page_id, url, body, sha1, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or offset > ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        file, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        system, path = _filesystem(file)
                        system.create_dir(path.rsplit("/", 1)[0])
                        out = system.open_output_stream(path, compression=None)
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    packer = zlib.compressobj(1, wbits=31)
                    member = packer.compress(record(page_id, url, body, digest, refers_to)) + packer.flush()
                    out.write(member)
                    for column, value in zip(found.values(), (url_key(url), page_id, file, offset, len(member))):
                        column.append(value)
                    offset += len(member)
                yield pa.record_batch([pa.array(found["url_key"], pa.string()), pa.array(found["page_id"], pa.int64()), pa.array(found["file"], pa.string()),
                                       pa.array(found["offset"], pa.int64()), pa.array(found["length"], pa.int64())], list(found))
        finally:
            if out is not None:
                out.close()

    return materialize(ready.mapInArrow(run, CAPTURE), "captures")


def build_index(captures: DataFrame) -> DataFrame:
    """(span, block, first_key, last_key, lines): sorted blocks, compressed; span is the range partition."""
    columns = ["url_key", "page_id", "file", "offset", "length"]

    def pack(batches):
        held, number = [], 0

        def block(rows):
            lines = zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in (k.replace("\t", "%09"), *r)) for k, *r in rows).encode(), 6)
            return pa.record_batch([pa.array([span]), pa.array([number], pa.int32()), pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([lines])],
                                   ["span", "block", "first_key", "last_key", "lines"])

        span = uuid.uuid4().hex
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in columns))
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held, number = held[BLOCK_LINES:], number + 1
        if held:
            yield block(held)

    spans = parts_for(row_count(captures) or captures.count(), SPAN_LINES, captures.sparkSession.sparkContext.defaultParallelism)
    ordered = captures.repartitionByRange(spans, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    return materialize(ordered.select(*columns).mapInArrow(pack, "span string, block int, first_key string, last_key string, lines binary"), "capture-index")


def _entries(lines: bytes):
    for line in zlib.decompress(lines).decode().split("\n"):
        key, page_id, file, offset, length = line.split("\t")
        yield key, int(page_id) if page_id else None, file, int(offset), int(length)


def fetched(archive, offset: int, length: int) -> bytes:
    """Range read of one record from an open archive."""
    archive.seek(offset)
    return zlib.decompress(archive.read(length), wbits=31)


def _pages(entries):
    """The records of entries that are sorted by file, one archive open at a time."""
    rows, current, archive = [], None, None
    try:
        for _, _, file, offset, length in entries:
            if file != current:
                if archive is not None:
                    archive.close()
                system, path = _filesystem(file)
                current, archive = file, system.open_input_file(path)
            rows.append(parsed(fetched(archive, offset, length)))
            if len(rows) == READ_BATCH:
                yield _page_batch(rows)
                rows = []
    finally:
        if archive is not None:
            archive.close()
    if rows:
        yield _page_batch(rows)


def _page_batch(rows):
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def read_all(index: DataFrame) -> DataFrame:
    """Every record by range reads, in the order of each block's archives."""

    def run(batches):
        for batch in batches:
            for lines in batch.column("lines"):
                yield from _pages(sorted(_entries(lines.as_py()), key=lambda e: e[2:4]))

    blocks = row_count(index) or index.count()
    tasks = parts_for(blocks, READ_BLOCKS, index.sparkSession.sparkContext.defaultParallelism)
    return index.select("lines").repartition(tasks).mapInArrow(run, PAGE)


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """Records of all captures of the given urls (column url), however many urls there are."""
    spans = index.groupBy("span").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()  # one line per range partition
    spans = sorted((r["low"], r["high"], r["span"]) for r in spans)
    lows, highs, names = ([s[i] for s in spans] for i in range(3))

    def route(batches):
        for batch in batches:
            found = []
            for url in batch.column("url").to_pylist():
                key = url_key(url).replace("\t", "%09")
                found += [(key, names[i]) for i in range(bisect.bisect_left(highs, key), bisect.bisect_right(lows, key))]
            yield pa.record_batch([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], ["key", "span"])

    def search(keys: pa.Table, blocks: pa.Table) -> pa.Table:
        order = sorted(zip(blocks.column("first_key").to_pylist(), blocks.column("last_key").to_pylist(), blocks.column("lines")), key=lambda b: b[:2])
        first, last = [b[0] for b in order], [b[1] for b in order]
        wanted: dict[int, set] = {}
        for key in keys.column("key").to_pylist():
            for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                wanted.setdefault(i, set()).add(key)
        hits = [e for i, own in wanted.items() for e in _entries(order[i][2].as_py()) if e[0] in own]
        found = list(_pages(sorted(hits, key=lambda e: e[2:4])))
        return pa.Table.from_batches(found, _SCHEMA)

    keys = urls.select("url").distinct().mapInArrow(route, "key string, span string").distinct()
    return keys.groupBy("span").cogroup(index.groupBy("span")).applyInArrow(search, PAGE)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder."""
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write archives and their index, then look every url up in it and read the records of its captures back."""
    return lookup(build_index(write(pages, archive_folder(pages.sparkSession), min_bytes)), pages)
