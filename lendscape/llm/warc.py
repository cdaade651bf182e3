"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL keys and written as compressed blocks of lines; a sparse directory
holds the first key of each block. Looking a key up takes a binary search for the part, one for the block,
a range read of that block and a range read of the record. Keys, blocks and records are dealt to tasks
separately, so a URL or host with most of the captures is spread over many.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.session import Workspace

LEAST_REVISIT = 1000
FILE_BYTES = 256 << 20
BLOCK_LINES = 1000
READ_BYTES = 8 << 20
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2000-01-01T00:00:00Z"
NO_URL = "-"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: ``com,example)/path?query``. Scheme, user and fragment go.

    A null or empty URL has the key ``-``; one that cannot be taken apart is its own key.
    """
    if not url:
        return NO_URL
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return quote(url.lower(), safe="/:?&=%,")
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    query = f"?{parts.query}" if parts.query else ""
    return quote(f"{key}){(parts.path or '/')}{query}".lower(), safe="/:?&=%,()+;@!~*'$")


def record(page_id, url, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record; with ``refers_to`` a revisit, which has the response's headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        VERSION,
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {CAPTURED}",
    ]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        lines += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"Refers-To-Page: {refers_to}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the payload's stated length; an error if the record contradicts itself."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if first != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return headers, payload, int(stated["Content-Length"])


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, size, refers_to (null for a response).

    Of equal payloads of at least ``least`` bytes the one with the largest page_id is the response. Rows that
    repeat that page_id are responses too; one without a page_id is a revisit unless none has one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.filter(F.col("size") >= least).select("page_id", "digest", "size")
    heads = large.groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(heads.drop("n"), ["digest", "size"], "left")
    later: Column = F.coalesce(F.col("page_id") != F.col("head"), F.col("head").isNotNull())
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(later, F.col("head")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Each record a gzip member of its own; returns captures: urlkey, page_id, path, offset, length.

    A file is closed at ``file_bytes``, so a task never holds more. Only files that captures name are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, path, out = TaskContext.get().partitionId(), [], 0, "", []

        def flush() -> pa.RecordBatch:
            common.write_file(path, b"".join(held))
            names = ["urlkey", "page_id", "path", "offset", "length"]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for page_id, url, payload, digest, n, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = path or f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                member = _member(record(page_id, url, payload, digest, n, refers_to))
                out.append((url_key(url), page_id, path, size, len(member)))
                held.append(member)
                size += len(member)
                if size >= file_bytes:
                    yield flush()
                    held, size, path, out = [], 0, "", []
        if out:
            yield flush()

    return rows.mapInArrow(run, "urlkey string, page_id long, path string, offset long, length long")


def write_index(captures: DataFrame, folder: str, parts: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorted captures as compressed blocks, with a sparse directory beside each part.

    Returns a row per part: part, cdx, idx, first and last key. A directory line has a block's first key,
    offset and length; a block has lines of key, page_id, path, offset and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lines, members, directory, size, last = TaskContext.get().partitionId(), [], [], [], 0, ""

        def close() -> None:
            nonlocal lines, size
            member = _member("\n".join(lines).encode())
            directory.append(f"{lines[0].partition(chr(9))[0]}\t{size}\t{len(member)}")
            members.append(member)
            lines, size = [], size + len(member)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append("\t".join("" if x is None else str(x) for x in row))
                last = row[0]
                if len(lines) == block_lines:
                    close()
        if lines:
            close()
        if directory:
            name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
            common.write_file(f"{name}.cdx.gz", b"".join(members))
            common.write_file(f"{name}.idx", "\n".join(directory).encode())
            row = [[part], [f"{name}.cdx.gz"], [f"{name}.idx"], [directory[0].partition("\t")[0]], [last]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "cdx", "idx", "first", "last"])

    order = ["urlkey", "page_id", "path", "offset"]
    rows = captures.select(*order, "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "part long, cdx string, idx string, first string, last string")


@lru_cache(maxsize=4)
def _directory(path: str) -> tuple[list[str], list[tuple[int, int]]]:
    lines = [line.split("\t") for line in common.read_file(path).decode().split("\n")]
    return [k for k, _, _ in lines], [(int(o), int(n)) for _, o, n in lines]


def locate(key: str, parts: list[tuple[str, str, str, str]]) -> Iterator[tuple[str, int, int]]:
    """Blocks (file, offset, length) that can hold a key. ``parts``: last key, first key, cdx and idx, in order."""
    for k in range(bisect_left(parts, (key,)), len(parts)):
        last, first, cdx, idx = parts[k]
        if first > key:
            return
        keys, blocks = _directory(idx)
        for b in range(max(0, bisect_left(keys, key) - 1), bisect_right(keys, key)):
            yield cdx, *blocks[b]


@lru_cache(maxsize=1)
def _block(path: str, offset: int, length: int) -> dict[str, list[tuple[str, int, int]]]:
    found: dict[str, list[tuple[str, int, int]]] = {}
    for line in zlib.decompress(common.read_range(path, offset, length), 31).decode().split("\n"):
        key, _, warc, at, n = line.split("\t")
        found.setdefault(key, []).append((warc, int(at), int(n)))
    return found


def lookup(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Records (path, offset, length) of URL keys (column ``urlkey``, each once).

    The index's list of parts, a row per index file and so bounded by the partitions it was written with,
    goes to the tasks; directories and blocks are read where they are needed.
    """
    listed = sorted((r["last"], r["first"], r["cdx"], r["idx"]) for r in index.collect())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*at, key) for key in batch.column(0).to_pylist() for at in locate(key, listed)]
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cdx", "at", "n", "urlkey"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [r for cdx, at, n, key in rows for r in _block(cdx, at, n).get(key, ())]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "offset", "length"])

    ordered = keys.select("urlkey").repartitionByRange(parts, "urlkey").sortWithinPartitions("urlkey")
    blocks = ordered.mapInArrow(find, "cdx string, at long, n long, urlkey string")
    near = blocks.repartition(parts, "cdx", "at").sortWithinPartitions("cdx", "at")
    return near.mapInArrow(fetch, "path string, offset long, length long")


def read_records(places: DataFrame, parts: int) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records, read from their archives.

    Places are dealt in file order; neighbours are read together. A payload that does not match its
    record's digest is an error.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or row[1] != held[-1][1] + held[-1][2] or row[1] + row[2] - held[0][1] > READ_BYTES):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in stretches(batches):
            path, begin = held[0][0], held[0][1]
            data = common.read_range(path, begin, held[-1][1] + held[-1][2] - begin)
            out = []
            for _, offset, length in held:
                headers, payload, size = parsed(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                kind = headers["WARC-Type"]
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {path} at {offset} does not match its digest")
                page, head = headers.get("Page-ID"), headers.get("Refers-To-Page")
                out.append((page and int(page), size, digest, kind, head and int(head)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    order = ["path", "offset"]
    rows = places.select(*order, "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, ws: Workspace) -> DataFrame:
    """Archive every page, index the captures, look every URL up again and read its records.

    A null html is an empty payload, a null url has the key ``-``. Repeated rows are archived each. No pages give
    no files and no rows. Other columns are ignored.
    """
    common.small_batches(spark)
    parts = common.partitions(spark)
    captures = ws.store(write_archives(with_revisits(pages), ws.folder("archives")), "captures")
    index = ws.store(write_index(captures, ws.folder("index"), parts), "parts")

    @F.pandas_udf("string")
    def keyed(urls):
        import pandas as pd

        return pd.Series([url_key(u) for u in urls], dtype=object)

    keys = pages.select(keyed("url").alias("urlkey")).distinct()
    return read_records(ws.store(lookup(keys, index, parts), "places"), parts)
