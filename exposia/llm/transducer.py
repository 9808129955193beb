"""Sentence pieces by a weighted transducer.

Three parts are compiled once: the normaliser (a space before the text, spaces as the mark), the
pieces with their costs, and the bytes of characters that no piece has. Each input is composed with
them and the cheapest path in the tropical semiring (costs add, the least counts) gives the ids.
The scores of the vocabulary file are ranks and not log
probabilities, so a piece of rank r costs ``4 + ln(r + 10)``, as frequencies fall with ranks; a byte
is used only where no piece has the character. Equal costs go to the longer last piece.

No piece crosses the start of a run of spaces or a control character, so paths are sums over the
parts between, and each kind of part is solved once per worker.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from exposia.llm.lattice import MARK, Known, Lattice, Pieces, spans_of
from exposia.llm.text import give_back, prefix_hash, span_hash, text_chunks, utf8

VOCABULARY = "piece_bpe_32k.model"
BYTE_COST = 1e7
RESERVED = 1e6  # ranks above mark pieces that the vocabulary sets apart
_CACHED_PARTS = 350_000
_PARTS_AT_ONCE = 20_000  # parts of one lattice
_CHUNK = 1 << 19


class Transducer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.output = [b""] * size  # what an id stands for
        edges: list[tuple[bytes, int, float]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.output[i] = bytes([int(piece[3:5], 16)])
                edges.append((self.output[i], i, BYTE_COST))
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.output[i] = piece.replace(MARK, " ").encode()
                rank = -model.get_score(i)
                edges.append((self.output[i], i, 4 + math.log(rank + 10) if rank < RESERVED else RESERVED))
        best: dict[bytes, tuple[float, int]] = {}
        for text, i, cost in edges:
            own = text in best and model.is_byte(best[text][1]) == model.is_byte(i)
            if text not in best or own and (cost, i) < best[text] or model.is_byte(best[text][1]) and not own:
                best[text] = cost, i  # a character's own piece goes before its byte
            if b" " in text.lstrip(b" "):
                raise ValueError(f"a piece crosses a border: {text!r}")
        inside = {c for text in best if len(text) > 1 for c in text}
        self.kind = np.full(256, 2, np.uint8)  # 0: space, 1: control characters that stand alone, 2: others
        self.kind[[c for c in range(0x20) if c not in inside]] = 1
        self.kind[0x20] = 0
        self.pieces = Pieces(list(best))
        self.costs = np.array([c for c, _ in best.values()])
        self.ids = np.array([i for _, i in best.values()], np.int32)
        self.bytes = np.frombuffer(b"".join(self.output), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in self.output])]).astype(np.int64)
        self.known = Known(_CACHED_PARTS)
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.solved, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)  # ids of all known parts

    def _solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add the cheapest paths of some parts."""
        found, counts = [self.solved], [np.zeros(0, np.int64)]
        for k in range(0, len(starts), _PARTS_AT_ONCE):
            some = slice(k, k + _PARTS_AT_ONCE)
            lattice = Lattice.of(self.pieces, *spans_of(data, starts[some], ends[some]))
            path, count = lattice.shortest(self.costs[lattice.piece])
            found.append(self.ids[path])
            counts.append(count)
        self.solved = np.concatenate(found)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(counts))])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and where each text's start."""
        column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        data, offsets = utf8(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        kind = self.kind[data]
        border = np.ones(len(data), bool)
        border[1:] = (kind[1:] == 1) | (kind[:-1] == 1) | ((kind[1:] == 0) & (kind[:-1] != 0))
        border[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(border)
        ends = np.append(starts[1:], len(data))
        name, at, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if self.known.full:
            self._forget()
        number, fresh = self.known.find(name)
        if fresh.any():
            self._solve(data, starts[at[fresh]], ends[at[fresh]])
        number = number[back]
        begin, count = self.bounds[number], np.diff(self.bounds)[number]
        place = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        owner = np.searchsorted(offsets, starts, "right") - 1
        per_text = np.bincount(owner, count, minlength=n).astype(np.int64)
        return self.solved[place], np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of some ids, those of each between two offsets; bytes that make no character
        are replaced."""
        ends = self.ends[ids + 1]
        data, places = spans_of(self.bytes, self.ends[ids], ends)
        raw, places = data.tobytes(), places[offsets].tolist()
        return [raw[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(places[:-1], places[1:])]


_LOADED: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in text_chunks(batches, limit=_CHUNK):
        ids, offsets = model.encode(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), lists], names=["row", "ids"])
    give_back()


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    for batch in batches:
        for start in range(0, len(batch), 250):
            part = batch.slice(start, 250)
            lists = part.column("ids")
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))]).astype(np.int64)
            flat = np.asarray(pc.list_flatten(lists), "<i4")
            ids = np.split(flat, offsets[1:-1])
            texts = model.decode(flat, offsets)
            columns = [
                part.column("row"),
                lists,
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                pa.array(texts, pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "ids", "n_ids", "ids_crc32", "text", "text_sha256"])
    give_back()


_DECODED = "ids array<int>, n_ids long, ids_crc32 long, text string, text_sha256 string"


def _with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``row`` (all columns but the text) and ``text``, and the type of the first."""
    other = docs.drop("text")
    row = F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias("row")
    return docs.select(row, F.col("text").alias("text")), other.schema.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``row`` (all columns of ``docs`` but the text) and ``ids``. A null or empty text has no ids.

    The mark itself (U+2581) in a text is read as a space.
    """
    rows, kind = _with_row(docs)
    return rows.mapInArrow(lambda batches: _encoded(batches, path), f"row {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``row``, ``ids``, ``n_ids``, ``ids_crc32`` (of the ids as little-endian 32-bit), ``text`` and its
    ``text_sha256``; null ids are no ids."""
    kind = encoded.select("row").schema["row"].dataType.simpleString()
    return encoded.select("row", "ids").mapInArrow(lambda batches: _decoded(batches, path), f"row {kind}, {_DECODED}")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """:func:`decode` of :func:`encode`, by one worker a task instead of one for each of both."""
    rows, kind = _with_row(docs)
    return rows.mapInArrow(lambda batches: _decoded(_encoded(batches, path), path), f"row {kind}, {_DECODED}")
