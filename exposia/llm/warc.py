"""WARC archives with a two-level capture index.

Records are gzip members of their own. Captures are sorted by reversed-host URL key into blocks of
lines, each compressed; a sparse directory at the end of an index file holds the first key of every
block. A look-up finds the index file by its key range, searches the directory by halves, reads one
block by its byte range, and then the record by its own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from exposia.llm.files import new_name, reader, writer
from exposia.llm.text import text_chunks
from exposia.sources.staging import materialize, scratch_path

DATE = "1970-01-01T00:00:00Z"
BLOCK_LINES = 512
LEAST_REVISIT = 0
READ_ROWS = 8192  # captures read by a task
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: ``org,example,www)/path?x``; case of the host is dropped."""
    url = "".join(c if c > " " else quote(c) for c in url or "")
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    labels = ",".join(reversed(host.split(".")))
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{labels}{f':{port}' if port and port not in (80, 443) else ''}){tail}"


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {page_id}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record: a response, or a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c if c > ' ' else quote(c) for c in url or '')}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record and its payload; the digest of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.decode().rpartition("Content-Length: ")[2])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda urn: None if urn == "<urn:page:None>" else int(urn[10:-1])
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(refers) if refers else None,
        "payload": payload,
    }


def _write_archives(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at = new_name(folder, "archive", ".warc.gz"), 0
        with writer(path) as out:
            for batch in text_chunks(batches, "html"):
                keys, starts, sizes = [], [], []
                for page_id, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                    press = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = press.compress(record(page_id, url, (html or "").encode(), refers)) + press.flush()
                    out.write(raw)
                    keys.append(capture_key(url, page_id))
                    starts.append(at)
                    sizes.append(len(raw))
                    at += len(raw)
                columns = [pa.array(keys), pa.array([path] * len(keys)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "path", "start", "size"])

    return rows


def _write_index(folder: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, directory, lines, last = new_name(folder, "index", ".cdx"), 0, [], [], None

        def close(out) -> int:
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(raw)
            directory.append((lines[0][0], at, len(raw)))
            lines.clear()
            return at + len(raw)

        with writer(path) as out:
            for batch in batches:
                for line in zip(*(batch.column(c).to_pylist() for c in ("key", "path", "start", "size"))):
                    lines.append(line)
                    last = line[0]
                    if len(lines) == BLOCK_LINES:
                        at = close(out)
            if lines:
                at = close(out)
            foot = zlib.compress(json.dumps(directory).encode())
            out.write(foot + len(foot).to_bytes(8, "little"))
        if directory:
            columns = [path, directory[0][0], last]
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["path", "first", "last"])

    return rows


class Index:
    """Look-ups in one index file."""

    def __init__(self, path: str):
        self.file = reader(path)
        size = self.file.size()
        foot = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(foot, size - 8 - foot)))
        self.firsts = [d[0].encode() for d in self.directory]
        self.held: tuple[int, list, list] = (-1, [], [])

    def block(self, i: int) -> tuple[list, list]:
        if self.held[0] != i:
            _, start, size = self.directory[i]
            lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(size, start)).decode().split("\n")]
            self.held = (i, [x[0].encode() for x in lines], lines)
        return self.held[1:]

    def find(self, key: str) -> Iterator[list]:
        """All captures under a key; equal keys may run over blocks."""
        name = key.encode()
        for i in range(max(0, bisect_left(self.firsts, name) - 1), bisect_right(self.firsts, name)):
            keys, lines = self.block(i)
            yield from lines[bisect_left(keys, name) : bisect_right(keys, name)]


def _look_up(shards: list[tuple[str, str, str]]):
    """Captures of sorted keys, by range reads."""
    ends = [last.encode() for _, _, last in shards]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_index: dict[int, Index] = {}
        files: dict[str, object] = {}
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                i = bisect_left(ends, key.encode())
                while i < len(shards) and shards[i][1].encode() <= key.encode():
                    if i not in open_index:
                        open_index.clear()  # keys come in order: one index at a time
                        open_index[i] = Index(shards[i][0])
                    for _, path, start, size in open_index[i].find(key):
                        if path not in files:
                            if len(files) >= 64:
                                files.clear()
                            files[path] = reader(path)
                        found.append(parse(zlib.decompress(files[path].read_at(size, start), 31)))
                    i += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds)], names=names)

    return rows


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [capture_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and the index; returns the index files
    as ``path, first, last``, one row per task.

    Of records with equal payloads of ``least_revisit`` bytes or more, that with the largest page_id
    is a response and the others revisit it. A null html is an empty payload, a null url an empty one.
    Rows that repeat a page_id with an equal payload are all responses or all revisits; rows without page_id are
    responses where no other row has their payload, else revisits. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    html = F.coalesce("html", F.lit(""))
    marks = pages.select("page_id", F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    marks = materialize(marks.filter(F.col("size") >= least_revisit), "digests")
    largest = marks.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    largest = largest.filter("n > 1 and refers_to is not null").drop("n")
    again = marks.join(largest, "sha1").filter("page_id is null or page_id != refers_to")
    again = again.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "refers_to").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.sha1(html.cast("binary")) == F.col("_sha1"))
    # the payload goes by page_id and digest: a payload that many pages share stays spread
    rows = pages.join(again, same, "left").select("page_id", "url", "html", "refers_to")
    captures = rows.mapInArrow(_write_archives(folder), "key string, path string, start long, size long")
    captures = materialize(captures, "captures")
    ordered = captures.repartitionByRange("key").sortWithinPartitions("key")
    return materialize(ordered.mapInArrow(_write_index(folder), "path string, first string, last string"), "index")


def read_captures(index: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the captures of ``pages``
    (page_id, url), each found through the index. Names of index files, one per task, are collected.

    The keys are small but what they lead to is not, so they are dealt to tasks by number.
    """
    shards = sorted(((r["path"], r["first"], r["last"]) for r in index.collect()), key=lambda s: s[1].encode())
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(_keys, "key string").distinct()
    keys = keys.repartitionByRange(1 + pages.count() // READ_ROWS, "key").sortWithinPartitions("key")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return keys.mapInArrow(_look_up(shards), schema)
