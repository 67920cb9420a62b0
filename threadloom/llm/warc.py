"""WARC archives with a two-level capture index: compressed sorted blocks under a sparse directory."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import batches as sized
from threadloom.llm.common import cut, shared_dir

LEAST = 100  # bytes a payload must have to be revisited
LINES = 1_000  # captures in a block of the index
ARCHIVE = 256 << 20  # bytes after which a task opens the next archive
GIVEN = 8 << 20  # bytes of payloads that a task holds before it hands them on


def url_key(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; what cannot be read as a URL is its own key."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host = (parts.hostname or "").strip(".")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return f"){text}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path.lower() or '/'}{query}"


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:") or "://" not in folder:
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return pafs.FileSystem.from_uri(folder)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, kind: str) -> bytes:
    """One record as a gzip member: WARC head, HTTP head and, unless it is a revisit, the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {re.sub(r'[\\r\\n]+', ' ', url or '')}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + made.flush()


def parse(member: bytes) -> dict:
    """What a gzip member says: head fields, and of the payload its bytes and its own length and digest."""
    import hashlib

    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] != "revisit" and (len(payload) != said or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", fields.get(k, ""))) else None
    return {"page_id": number("WARC-Record-ID"), "bytes": said, "digest": digest, "type": fields["WARC-Type"], "refers": number("WARC-Refers-To"), "payload": payload}


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html) below ``folder`` and return the captures, written to ``folder``/captures.

    Of rows with equal payloads of at least ``LEAST`` bytes that with the smallest page_id is the response and
    the others revisit it; smaller payloads are all responses. A null html is an empty payload, a null url an
    empty address. Rows with a null page_id can be no first capture if one with an id has the same payload.
    Digests are reduced before they are joined, and the join on a hot digest can be split. A task that is run again
    writes archives of other names; only captures that are committed name an archive that is used.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    firsts = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    joined = rows.join(firsts, "digest", "left")
    later = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    ready = joined.select("page_id", "url", "payload", "digest", F.when(later, F.col("first")).alias("refers"), F.when(later, "revisit").otherwise("response").alias("type"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(f"{root}/warc", recursive=True)
        sink = None
        try:
            for batch in sized(batches, "payload"):
                out = []
                for page, url, payload, digest, refers, kind in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    if sink is None or at > ARCHIVE:
                        if sink:
                            sink.close()
                        name, at = f"warc/{uuid.uuid4().hex}.warc.gz", 0
                        sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(page, url, payload, digest, refers, kind)
                    sink.write(member)
                    out.append((url_key(url), page, kind, digest, name, at, len(member)))
                    at += len(member)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "type", "digest", "file", "at", "length"])
        finally:
            if sink:
                sink.close()

    schema = "key string, page_id bigint, type string, digest string, file string, at bigint, length bigint"
    ready.select("page_id", "url", "payload", "digest", "refers", "type").mapInArrow(archive, schema).write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.parquet(f"{folder}/captures")


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the captures as sorted compressed blocks; return the sparse directory, one row a block.

    Captures are dealt by ranges of (key, page_id) and sorted in each part. A part writes blocks of ``LINES``
    captures into one file and names each block's first key, place and length. The directory is as many times
    shorter than the captures as a block has lines.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(f"{root}/index", recursive=True)
        name, at, lines, first, sink, made = f"index/{uuid.uuid4().hex}.idx", 0, [], None, None, []

        def flush():
            nonlocal at, lines, sink
            sink = sink or fs.open_output_stream(f"{root}/{name}", compression=None)
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            sink.write(data)
            made.append((*first, name, at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for key, page, file, place, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if not lines:
                    first = (key, page)
                lines.append(json.dumps([key, page, file, place, length]))
                if len(lines) == LINES:
                    flush()
        if lines:
            flush()
        if sink:
            sink.close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "at", "length"])

    ordered = captures.select("key", "page_id", "file", "at", "length").repartitionByRange("key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", F.col("page_id").asc_nulls_first())
    ordered.mapInArrow(blocks, "key string, page_id bigint, file string, at bigint, length bigint").write.parquet(f"{folder}/directory")
    return captures.sparkSession.read.parquet(f"{folder}/directory")


def _order(key: str, page: int | None) -> tuple:
    return (key.encode("utf-8", "surrogatepass"), page is not None, page or 0)


def lookup(wanted: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Every capture of each (url, page_id) in ``wanted``, read back from the archives.

    The directory's files (one a part of the index, a few hundred whatever the input) are gathered with their
    first keys; each wanted key goes to the part that holds its range. There the part's directory is searched by
    bisection for the block, the block is read by its range and searched for the capture, and the record is
    read by its range from the archive. Wanted keys come sorted, so each block is read once.
    """
    spark = wanted.sparkSession
    parts = directory.groupBy("file").agg(F.min_by(F.struct("key", "page_id"), F.struct("key", F.col("page_id").isNotNull(), "page_id")).alias("first")).collect()
    edges = sorted((_order(*p["first"]), p["file"]) for p in parts)
    lows, files = [e[0] for e in edges], [e[1] for e in edges]
    shared = spark.sparkContext.broadcast((lows, files))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows, files = shared.value
        for batch in batches:
            keys = [url_key(u) for u in batch.column(0).to_pylist()]
            pages = batch.column(1).to_pylist()
            # a key that equals a part's first key may have begun in the part before only if it lies before it
            file = [files[max(0, bisect_right(lows, _order(k, p)) - 1)] if files else None for k, p in zip(keys, pages)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(pages, pa.int64()), pa.array(file, pa.string())], ["key", "page_id", "file"])

    routed = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(route, "key string, page_id bigint, file string")
    routed = routed.where("file is not null").distinct()
    sparse = directory.select("key", "page_id", "file", F.col("at"), F.col("length"))
    both = routed.select("file", "key", "page_id", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("length")).unionByName(sparse.select("file", "key", "page_id", "at", "length"))
    # a part's directory rows come before the keys that are looked up in it
    # the number is given, as small keys stand for large reads and must not be put together by their own size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "file").sortWithinPartitions("file", F.col("at").asc_nulls_last(), "key", F.col("page_id").asc_nulls_first())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        file, rows, handle, block, lines, archives = None, [], None, None, [], {}
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        fields = ("page_id", "bytes", "digest", "type", "refers", "payload")
        give = lambda out: pa.RecordBatch.from_pylist([dict(zip(kinds.names, (r[n] for n in fields))) for r in out], schema=kinds)

        def load(k):
            found = [json.loads(x) for x in zlib.decompress(handle.read_at(rows[k][2], rows[k][1])).decode("utf-8", "surrogatepass").split("\n")]
            return found, [_order(x[0], x[1]) for x in found]

        try:
            for batch in batches:
                out, held = [], 0
                for part, key, page, at, length in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    if part != file:
                        if handle:
                            handle.close()
                        file, rows, tops, handle, block = part, [], [], fs.open_input_file(f"{root}/{part}"), None
                    if at is not None:
                        rows.append((_order(key, page), at, length))
                        tops.append(rows[-1][0])
                        continue
                    want = _order(key, page)
                    k = max(0, bisect_right(tops, want) - 1)
                    if block != k:
                        block, (lines, keys) = k, load(k)
                    hit = bisect_right(keys, want) - 1
                    while True:  # captures with the same key and page may reach back over blocks
                        while hit >= 0 and keys[hit] == want:
                            _, _, name, place, size = lines[hit]
                            if name not in archives:
                                if len(archives) >= 64:
                                    archives.pop(next(iter(archives))).close()
                                archives[name] = fs.open_input_file(f"{root}/{name}")
                            out.append(parse(archives[name].read_at(size, place)))
                            held += len(out[-1]["payload"]) + 200
                            if held > GIVEN:
                                yield give(out)
                                out, held = [], 0
                            hit -= 1
                        if hit >= 0 or k == 0:
                            break
                        k -= 1
                        block, (lines, keys) = k, load(k)
                        hit = len(keys) - 1
                yield give(out)
        finally:
            for open_file in (*archives.values(), *([handle] if handle else [])):
                open_file.close()

    return dealt.mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive all pages, index the captures, then look every page up and read its record back.

    ``folder`` is a new folder below the shared one unless it is named.
    """
    folder = folder or os.path.join(shared_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    captures = write(pages, folder)
    directory = index(captures, folder)
    return lookup(pages, directory, folder)
