"""Objects of JSON feature collections, read in blocks: one document may span many tasks.

Files are read by Spark's text source with ``}`` for a line end, so that every block holds whole records
and any store that Spark reads will do. Where a block starts, two things are unknown: whether it is
inside a string, and which objects and arrays are open.

1. Each block is summed up for both answers to the first question: how many of the open brackets it
   closes and which ones it leaves open. The summaries, one row a block, are chained per file.
2. Each block is cut from its then known start. An element of a ``features`` array of a top-level
   object leaves as one row; what is left of the document is its skeleton, with the array empty.
   What a block border cuts is put together again by the block it began in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from exposia.sources.staging import materialize

FEATURE, DOCUMENT = "feature", "document"
_PART = " part"
_FEATURES = re.compile(rb'(?<!\\)"features"[ \t\r\n]*:[ \t\r\n]*\[')
_PACKED = re.compile(r"[.](gz|bz2|zst|lz4|snappy|deflate)$")
_BETWEEN = b" \t\r\n\x1e"  # what may stand between documents
_SYMBOL = {ord("{"): "{", ord("["): "["}
_ARRAY = "F"  # an open array of features
_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1


class BrokenDocument(ValueError):
    """A file that is not a sequence of JSON objects."""


def brackets(data: bytes, in_string: bool) -> tuple[np.ndarray, np.ndarray, set[int], bool]:
    """Places of the brackets outside strings, the step in depth of each, the places that open an
    array of features, and whether the data end inside a string."""
    cells = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(cells == 34)
    if len(quotes):
        slashed = quotes[(quotes > 0) & (cells[np.maximum(quotes - 1, 0)] == 92)]
        escaped = [q for q in slashed.tolist() if _slashes(data, q) % 2]
        quotes = np.setdiff1d(quotes, escaped, assume_unique=True) if escaped else quotes
    places = np.flatnonzero(_STEP[cells])
    places = places[(np.searchsorted(quotes, places) + in_string) % 2 == 0]
    arrays = {m.end() - 1 for m in _FEATURES.finditer(data)}
    return places, _STEP[cells[places]], arrays, bool((len(quotes) + in_string) % 2)


def _slashes(data: bytes, at: int) -> int:
    """Backslashes right before a place."""
    start = at
    while start and data[start - 1] == 92:
        start -= 1
    return at - start


@dataclass
class Effect:
    """What a stretch does to the open brackets: it closes so many and leaves these open."""

    in_string: bool = False
    closes: int = 0
    opens: str = ""

    def then(self, data: bytes) -> None:
        places, steps, arrays, self.in_string = brackets(data, self.in_string)
        if not len(places):
            return
        depth = np.cumsum(steps)
        closes = max(0, -int(depth.min()))
        after = np.minimum.accumulate(depth[::-1])[::-1]
        left = places[(steps > 0) & (after >= depth)]  # never closed within the stretch
        opens = "".join(_ARRAY if p in arrays else _SYMBOL[data[p]] for p in left.tolist())
        self.closes += max(0, closes - len(self.opens))
        self.opens = self.opens[: max(0, len(self.opens) - closes)] + opens


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes | None]]:
    """Block and bytes for each stretch of a batch that lies in one block, None after a block's last.

    A blank last record is not given its bracket: it is what follows the last one in a file.
    """
    block, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        starts, files = np.asarray(batch.column("start")), np.asarray(batch.column("file").dictionary_encode().indices)
        cuts = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            this = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c != "part"}
            if block is not None and (this["file"], this["start"]) != (block["file"], block["start"]):
                yield from _end(block, held)
                held = []
            block = this
            parts = held + batch.column("part").slice(a, b - a).to_pylist()
            held = [parts.pop()]
            if parts:
                yield block, b"}".join(parts) + b"}"
    if block is not None:
        yield from _end(block, held)


def _end(block: dict, held: list[bytes]) -> Iterator[tuple[dict, bytes | None]]:
    if held[0].strip(_BETWEEN):
        yield block, held[0] + b"}"
        held = []
    yield block | {"blank": b"".join(held) if held else None}, None


_SUMMARY = "file string, start long, size long, bytes long, blank boolean, strings array<boolean>, closes array<int>, opens array<string>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    effects, total = [Effect(False), Effect(True)], 0
    for block, data in _records(batches):
        if data is not None:
            total += len(data)
            for effect in effects:
                effect.then(data)
            continue
        blank = block["blank"]
        if blank is not None:  # its bracket closes something, unless the file ends here
            total += len(blank) + 1
        row = {
            "file": block["file"], "start": block["start"], "size": block["size"], "bytes": total, "blank": blank is not None,
            "strings": [e.in_string for e in effects], "closes": [e.closes for e in effects], "opens": [e.opens for e in effects],
        }
        yield pa.RecordBatch.from_pylist([row], schema=_arrow(_SUMMARY))
        effects, total = [Effect(False), Effect(True)], 0


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    return pa.schema([(n, kind(k)) for n, k in (c.strip().split(" ") for c in ddl.split(","))])


_ENTRY = "file string, start long, in_string boolean, opened string, document_from long, feature_from long"


def chained(blocks: pd.DataFrame) -> pd.DataFrame:
    """Where each block of one file starts, from the summaries of its blocks."""
    blocks = blocks.sort_values("start")
    name, last = blocks["file"].iloc[0], len(blocks) - 1
    over = int(blocks["bytes"].sum() - blocks["size"].iloc[0])
    # of a plain file: whether the last record had its bracket; a byte order mark is not among the bytes
    plain = not _PACKED.search(name)
    cut_off, closed = plain and over in (1, -2), plain and over in (0, -3)
    in_string, opened, document, feature, out = False, "", 0, 0, []
    for i, b in enumerate(blocks.itertuples(index=False)):
        out.append((name, b.start, in_string, opened, document, feature))
        closes, opens = int(b.closes[int(in_string)]), b.opens[int(in_string)]
        if closes > len(opened):
            raise BrokenDocument(f"{name}: a bracket closes nothing")
        document = b.start if closes >= len(opened) else document
        feature = b.start if closes >= len(opened) - 2 else feature
        opened, in_string = opened[: len(opened) - closes] + opens, bool(b.strings[int(in_string)])
        if i == last and (cut_off if not b.blank else cut_off and opened):
            raise BrokenDocument(f"{name}: it ends inside a document")
        if b.blank and not in_string and (opened or i < last or closed):  # blanks before a bracket, not the end
            if not opened:
                raise BrokenDocument(f"{name}: a bracket closes nothing")
            opened = opened[:-1]
            document = b.start if not opened else document
            feature = b.start if len(opened) <= 2 else feature
    if opened or in_string:
        raise BrokenDocument(f"{name}: it ends inside a document")
    return pd.DataFrame(out, columns=["file", "start", "in_string", "opened", "document_from", "feature_from"])


@dataclass
class Cutter:
    """Cuts one block, stretch by stretch, into features and skeletons."""

    file: str
    start: int
    in_string: bool
    opened: str
    document_from: int
    feature_from: int
    rows: list[dict] = field(default_factory=list)
    skeleton: list[bytes] = field(default_factory=list)
    held: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        self.depth, self.opened = len(self.opened), self.opened[:3]  # deeper ones only count
        self.document_here, self.feature_here = not self.opened, not self._in_feature()

    def _in_feature(self) -> bool:
        return self.opened[:2] == "{" + _ARRAY and len(self.opened) > 2

    def _fail(self, what: str) -> None:
        raise BrokenDocument(f"{self.file}: {what}")

    def _row(self, kind: str, here: bool, begun: int, data: list[bytes]) -> None:
        part = "" if here else _PART
        self.rows.append({"file": self.file, "kind": kind + part, "begun": begun, "start": self.start, "data": b"".join(data)})

    def _outside(self, data: bytes) -> None:
        """Bytes of no feature: between documents, between features, or of a skeleton."""
        if not self.depth:
            if data.strip(_BETWEEN):
                self._fail(f"not a JSON object: {data.strip(_BETWEEN)[:40]!r}")
        elif self.opened == "{" + _ARRAY:
            if data.strip(b" \t\r\n,") or data.count(b",") > 1:
                self._fail("an array of features holds something else")
        else:
            self.skeleton.append(data)

    def add(self, data: bytes) -> None:
        places, steps, arrays, self.in_string = brackets(data, self.in_string)
        depth = self.depth + np.cumsum(steps)
        if len(depth) and depth.min() < 0:
            self._fail("a bracket closes nothing")
        near = np.where(steps > 0, depth, depth + 1) <= 3  # brackets of documents, their members and features
        at = 0
        for p, step, after in zip(places[near].tolist(), steps[near].tolist(), depth[near].tolist()):
            features = self.opened[:2] == "{" + _ARRAY
            if step > 0:
                if after == 1 or (after == 3 and features):
                    self.depth = after - 1
                    self._outside(data[at:p])
                    at = p
                    if data[p] != ord("{"):
                        self._fail("an array where an object should be")
                    if after == 1:
                        self.document_here, self.document_from = True, self.start
                    else:
                        self.feature_here, self.feature_from = True, self.start
                self.opened = self.opened[: after - 1] + (_ARRAY if p in arrays else chr(data[p]))
                if after == 2 and p in arrays:
                    self.skeleton.append(data[at : p + 1])
                    at = p + 1
            else:
                if after == 2 and features:
                    self.held.append(data[at : p + 1])
                    self._row(FEATURE, self.feature_here, self.feature_from, self.held)
                    self.held, at = [], p + 1
                elif after == 1 and features:
                    self.depth, self.opened = 2, self.opened[:2]
                    self._outside(data[at:p])
                    at = p
                elif after == 0:
                    self._row(DOCUMENT, self.document_here, self.document_from, [*self.skeleton, data[at : p + 1]])
                    self.skeleton, at = [], p + 1
                self.opened = self.opened[:after]
        self.depth = int(depth[-1]) if len(depth) else self.depth
        if self._in_feature():
            self.held.append(data[at:])
        else:
            self._outside(data[at:])

    def end(self) -> list[dict]:
        if self.held:
            self._row(FEATURE, False, self.feature_from, self.held)
        if self.skeleton:
            self._row(DOCUMENT, False, self.document_from, self.skeleton)
        return self.rows


_CUT = "file string, kind string, begun long, start long, data binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter, schema = None, _arrow(_CUT)
    for block, data in _records(batches):
        if cutter is None:
            if block["start"] and block["in_string"] is None:
                raise BrokenDocument(f"{block['file']}: it was split in another way than before")
            cutter = Cutter(block["file"], block["start"], bool(block["in_string"]), block["opened"] or "", block["document_from"] or 0, block["feature_from"] or 0)
        if data is not None:
            cutter.add(data)
            rows, cutter.rows = cutter.rows, []
        else:
            if block["blank"] is not None and cutter.depth:
                cutter.add(block["blank"] + b"}")
            rows, cutter = cutter.end(), None
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``kind, data``: every element of a ``features`` array as JSON text (``feature``), and every
    top-level document without them (``document``).

    Documents are JSON objects, any number to a file, one after the other. A file that ends inside
    one, or holds anything else, is an error. A single document is split over tasks like any text.
    """
    # workers find this package where it lies on their disk, on their path or not
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    read = spark.read.option("lineSep", "}").text(path)
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file"), ("file_block_start", "start"), ("file_size", "size"))]
    blocks = read.select(F.col("value").cast("binary").alias("part"), *meta)
    summaries = materialize(blocks.mapInArrow(_summaries, _SUMMARY), "blocks")  # one row a block
    entries = materialize(summaries.groupBy("file").applyInPandas(chained, _ENTRY), "entries").filter("start > 0")
    columns = ["part", "file", "start"]
    if entries.isEmpty():
        none = {n: F.lit(None).cast(t) for n, t in (("in_string", "boolean"), ("opened", "string"), ("document_from", "long"), ("feature_from", "long"))}
        cut = blocks.select(*columns).withColumns(none).mapInArrow(_cut, _CUT)
        return cut.select("kind", F.col("data").cast("string").alias("data"))
    known = entries.withColumnsRenamed({"file": "_file", "start": "_start"})
    # a row of about a hundred bytes for each block of some megabytes, first blocks left out
    placed = blocks.join(F.broadcast(known), (F.col("file") == F.col("_file")) & (F.col("start") == F.col("_start")), "left")
    cut = materialize(placed.drop("_file", "_start", "size").mapInArrow(_cut, _CUT), "objects")
    parts = cut.filter(F.col("kind").endswith(_PART)).groupBy("file", "begun", "kind")
    joined = parts.agg(F.array_sort(F.collect_list(F.struct("start", F.col("data").cast("string").alias("data")))).alias("parts"))
    joined = joined.select(F.regexp_replace("kind", _PART, "").alias("kind"), F.array_join("parts.data", "").alias("data"))
    complete = cut.filter(~F.col("kind").endswith(_PART)).select("kind", F.col("data").cast("string").alias("data"))
    return complete.union(joined)

