"""Token ids in binary files with Elias-Fano document boundaries.

A shard holds the ids of its documents one after the other (16 bits each where the vocabulary
allows, else 32), then two Elias-Fano sequences: where each document ends, and the doc_ids. Select
marks every 256 entries give any entry in near-minimal space and without a table of 64-bit offsets.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from exposia.llm.files import new_name, reader, writer
from exposia.llm.lattice import Known, spans_of
from exposia.llm.text import LOWER, SPACE, prefix_hash, span_hash, text_chunks, utf8, words
from exposia.sources.staging import materialize, scratch_path

END = 1
VOCABULARY = "word_bpe_49k.json"
MARK_EVERY = 256
_MAGIC = b"EFIDS001"
_CACHED_WORDS = 900_000
_JOINED_PARTS = 100  # encoded as one text
_CHUNK = 1 << 20
_READ_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0 up."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((top >> low_bits) + n + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::MARK_EVERY])

    def select(self, first: int, last: int) -> np.ndarray:
        """Entries first to last - 1, from the mark before them on."""
        if last <= first:
            return np.zeros(0, np.int64)
        mark = first // MARK_EVERY
        begin = int(self.marks[mark])
        after = (last - 1) // MARK_EVERY + 1
        end = int(self.marks[after]) if after < len(self.marks) else 8 * len(self.high)
        cells = np.unpackbits(self.high[begin // 8 : -(-(end + 1) // 8)], bitorder="little")
        ones = np.flatnonzero(cells) + begin // 8 * 8
        ones = ones[ones >= begin][first - mark * MARK_EVERY :][: last - first]
        high = ones - np.arange(first, last)
        if not self.low_bits:
            return high
        a, b = first * self.low_bits, last * self.low_bits
        cells = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 :][: b - a].reshape(-1, self.low_bits)
        low = (cells.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return (high << self.low_bits) | low

    def save(self, out) -> dict:
        parts = [self.low.tobytes(), self.high.tobytes(), self.marks.astype("<i8").tobytes()]
        for part in parts:
            out.write(part)
        return {"n": self.n, "low_bits": self.low_bits, "bytes": [len(p) for p in parts]}

    @classmethod
    def load(cls, file, offset: int, head: dict) -> EliasFano:
        parts = []
        for size in head["bytes"]:
            parts.append(file.read_at(size, offset))
            offset += size
        low, high, marks = (np.frombuffer(p, t) for p, t in zip(parts, (np.uint8, np.uint8, "<i8")))
        return cls(head["n"], head["low_bits"], low, high, marks)


_LETTER, _DIGIT, _SIGN, _APOSTROPHE, _OTHER = range(5)
_BAR = ord("|")


def _byte_kinds() -> np.ndarray:
    """Kind of each byte; the bar, control characters and all bytes beyond ASCII are others."""
    kinds = np.full(256, _OTHER, np.uint8)
    for c in range(0x21, 0x7F):
        kinds[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN
    kinds[ord("'")], kinds[_BAR] = _APOSTROPHE, _OTHER
    return kinds


_KINDS = _byte_kinds()
_CUT = np.zeros(64, bool)
_CUT[[_LETTER * 8 + k for k in (_DIGIT, _SIGN, _APOSTROPHE)]] = True
_CUT[[_DIGIT * 8 + k for k in (_LETTER, _DIGIT, _SIGN, _APOSTROPHE)]] = True
_CUT[[_SIGN * 8 + k for k in (_LETTER, _DIGIT)]] = True
_LATIN = 0xC3, 0xC9  # first bytes of U+00C0 to U+027F
_NO_LETTER = (0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)  # two signs, and a letter whose lower case is no single letter
_FIRST_MARK = 0xCC  # combining marks have no lesser first byte

# What a vocabulary file must state so that its words fall apart at kinds of characters.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def kinds_of(data: np.ndarray) -> np.ndarray:
    """Kind of each byte, both bytes of a Latin letter as letters."""
    kinds = _KINDS[data]
    first = np.flatnonzero((data >= _LATIN[0]) & (data <= _LATIN[1]))
    for a, b in _NO_LETTER:
        first = first[(data[first] != a) | (data[first + 1] != b)]
    kinds[first] = kinds[first + 1] = _LETTER
    return kinds


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words cut where the splitter surely cuts: start, end, text number and whether it is all letters;
    and the bytes with A-Z lower-cased where that changes no id.

    A cut is made only before ASCII or a Latin letter, which join nothing before them. A letter stays
    as it is before a character that may be a combining mark, and in parts with a bar, which the names
    of special tokens have.
    """
    kinds, space = kinds_of(data), SPACE[data]
    edge = space.copy()  # whether a part starts here
    edge[1:] |= space[:-1] | _CUT[kinds[:-1] * 8 + kinds[1:]]
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    solid = ~space[starts]
    starts, ends = starts[solid], ends[solid]
    owner = np.searchsorted(offsets, starts, "right") - 1
    low = LOWER[data]
    bare = np.flatnonzero((low[:-1] != data[:-1]) & (data[1:] >= _FIRST_MARK))
    low[bare] = data[bare]
    bars = np.unique(np.searchsorted(starts, np.flatnonzero(data == _BAR), "right") - 1)
    for a, b in zip(starts[bars], ends[bars]):
        low[a:b] = data[a:b]
    strange = np.concatenate([[0], np.cumsum(kinds != _LETTER)])
    return starts, ends, owner, strange[ends] == strange[starts], low


class WordEncoder:
    """Ids of whole texts from ids of their words, each kind of word encoded once.

    Right for tokenizers that never join across white space, as the given one, which drops it. Where the
    vocabulary file has the given one's normaliser and splitter, words are cut further, and parts of
    letters are encoded many at a time: each is one word to the tokenizer, whose last id says that it ends.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype(np.uint32 if self.wide else np.uint16)
        self.closes = self._closing(json.loads(self.tokenizer.to_str()))
        self.known = Known(_CACHED_WORDS)
        self._forget()

    def _closing(self, stated: dict) -> np.ndarray | None:
        """Which ids end a word, or None where words are not to be cut."""
        model, suffix = stated["model"], stated["model"].get("end_of_word_suffix")
        plain = not any(stated[k] for k in ("post_processor", "truncation", "padding")) and not model.get("dropout")
        if not (plain and suffix and stated["normalizer"] == _NORMALIZER and stated["pre_tokenizer"] == _SPLITTER):
            return None
        for added in stated["added_tokens"]:
            name = np.frombuffer(added["content"].encode(), np.uint8)
            starts, *_ = parts(name, np.array([0, len(name)]))
            if added["normalized"] or added["single_word"] or added["lstrip"] or added["rstrip"] or len(starts) != 1 or _BAR not in name:
                return None
        closes = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, bool)
        closes[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
        return closes

    def _forget(self) -> None:
        self.known.clear()
        self.solved, self.bounds = np.zeros(0, self.kind), np.zeros(1, np.int64)  # ids of all known parts

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(code.ids, self.kind) for code in found]

    def _letters(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of letters, concatenated, and their number by part."""
        joined, places = spans_of(np.append(data, np.uint8(0x20)), starts, ends + 1)
        joined[places[1:] - 1] = 0x20
        raw, cuts = joined.tobytes(), [*places[:-1:_JOINED_PARTS].tolist(), len(joined)]
        ids = np.concatenate([np.zeros(0, self.kind), *self._each([raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])])])
        last = np.flatnonzero(self.closes[ids])
        if len(last) != len(starts) or len(ids) and last[-1] != len(ids) - 1:
            raise ValueError("the vocabulary does not end every word as stated")
        return ids, np.diff(last, prepend=-1)

    def _solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> None:
        """Encode some parts; their ids follow those of all known parts."""
        ids, count = np.zeros(0, self.kind), np.zeros(len(starts), np.int64)
        if letters.any():
            ids, count[letters] = self._letters(data, starts[letters], ends[letters])
        rest = np.flatnonzero(~letters)
        if len(rest):
            raw = data.tobytes()
            each = self._each([raw[a:b].decode() for a, b in zip(starts[rest], ends[rest])])
            count[rest] = [len(x) for x in each]
            ids = np.concatenate([ids, *each])
            order = np.concatenate([np.flatnonzero(letters), rest])  # back to the order of the parts
            begin = np.empty(len(starts), np.int64)
            begin[order] = np.cumsum(count[order]) - count[order]
            ids, _ = spans_of(ids, begin, begin + count)
        self.solved = np.concatenate([self.solved, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(count)])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids with the end id after each text, and the number of ids of each text."""
        data, offsets = utf8(column)
        n = len(offsets) - 1
        if not len(data):
            return np.full(n, END, self.kind), np.ones(n, np.int64)
        if self.closes is None:
            starts, ends, owner = words(data, offsets)
            letters = np.zeros(len(starts), bool)
        else:
            starts, ends, owner, letters, data = parts(data, offsets)
        name, at, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if self.known.full:
            self._forget()
        number, fresh = self.known.find(name)
        if fresh.any():
            new = at[fresh]
            self._solve(data, starts[new], ends[new], letters[new])
        size = self.bounds[number + 1] - self.bounds[number]
        begin, count = self.bounds[number][back], size[back]
        per_text = np.bincount(owner, count, minlength=n).astype(np.int64) + 1
        out = np.full(per_text.sum(), END, self.kind)
        place = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        body = np.ones(len(out), bool)
        body[np.cumsum(per_text) - 1] = False
        out[body] = self.solved[place]
        return out, per_text


_LOADED: dict[str, WordEncoder] = {}


def load(path: str) -> WordEncoder:
    """One encoder per worker, with the words it knows by now."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _write(folder: str, vocabulary: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(vocabulary)
        path, sizes, ids, unnamed, total = new_name(folder, "ids", ".bin"), [], [], 0, 0
        shard = TaskContext.get().partitionId()
        with writer(path) as out:
            out.write(_MAGIC)
            for batch in text_chunks(batches, limit=_CHUNK):
                tokens, count = encode(batch.column("text"))
                out.write(tokens.astype(tokens.dtype.newbyteorder("<")).tobytes())
                sizes.append(count)
                ids.append(np.asarray(batch.column("doc_id").drop_null(), np.int64))
                unnamed += batch.column("doc_id").null_count  # these come last
                total += len(tokens)
            if not ids:
                return
            ids = np.concatenate(ids)
            named = len(ids)
            ids = np.concatenate([ids, np.full(unnamed, ids[-1] if named else 0)])
            ends = EliasFano.of(np.cumsum(np.concatenate(sizes)))
            head = {"width": 4 if encode.wide else 2, "n_ids": total, "least_id": int(ids[0]), "named": named}
            head |= {"ends": ends.save(out), "docs": EliasFano.of(ids - ids[0]).save(out)}
            foot = json.dumps(head).encode()
            out.write(foot + len(foot).to_bytes(8, "little") + _MAGIC)
        names = ["shard", "path", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard, path, len(ids), total)], names=names)

    return rows


class Shard:
    """Reads documents of one file by their number."""

    def __init__(self, path: str):
        self.file = reader(path)
        size = self.file.size()
        if self.file.read_at(8, size - 8) != _MAGIC:
            raise ValueError(f"not a token file: {path}")
        foot = int.from_bytes(self.file.read_at(8, size - 16), "little")
        head = json.loads(self.file.read_at(foot, size - 16 - foot))
        self.type, self.n_ids = np.dtype(f"<u{head['width']}"), head["n_ids"]
        at = 8 + head["n_ids"] * head["width"]
        self.ends = EliasFano.load(self.file, at, head["ends"])
        self.ids = EliasFano.load(self.file, at + sum(head["ends"]["bytes"]), head["docs"])
        self.least_id, self.named = head["least_id"], head["named"]

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Where documents first to last - 1 start, and where the last of them ends."""
        if first:
            return self.ends.select(first - 1, last)
        return np.r_[0, self.ends.select(0, last)]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.type.itemsize, 8 + start * self.type.itemsize)
        return np.frombuffer(raw, self.type)

    def doc_ids(self, first: int, last: int) -> pa.Array:
        return pa.array(self.ids.select(first, last) + self.least_id, mask=np.arange(first, last) >= self.named)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base, n in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "n_docs"))):
            shard = Shard(path)
            step = max(1, min(50_000, int(_READ_IDS * n / max(1, shard.n_ids))))
            for first in range(0, n, step):
                last = min(n, first + step)
                at = shard.bounds(first, last)
                raw = shard.tokens(int(at[0]), int(at[-1])).astype("<u4")
                crc = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
                columns = [base + at[:-1], np.diff(at), np.array(crc, np.int64)]
                arrays = [shard.doc_ids(first, last), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts in ascending doc_id; returns ``path, n_docs, n_ids, base`` by shard.

    ``base`` counts the ids of the shards before. A null or empty text is its end id alone. Rows with
    equal doc_id each count, ordered by a hash of their text; those without doc_id come after all
    others, and a shard notes where they begin. An empty table writes no shard. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_mark", F.xxhash64("text"))
    order = F.col("doc_id").asc_nulls_last(), F.col("_mark").asc()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shards = rows.select("doc_id", "text").mapInArrow(_write(folder, vocabulary), "shard long, path string, n_docs long, n_ids long")
    shards = materialize(shards, "shards")  # one row per task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    each = shards.select("path", "base", "n_docs").repartition(max(1, shards.count()), "path")  # rows are small, files are not
    return each.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
