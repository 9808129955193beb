"""Language identification by unigram pieces with every segmentation counted.

Each language has a probability for every piece of a fixed public vocabulary (its byte pieces make
every text possible). The probability of a word is the sum over all ways to cut it into pieces, by
the forward algorithm; a text is its words. Piece probabilities are fitted by expectation
maximisation on word counts of labelled texts. A word is its lower-cased bytes after one space; cut every
``WORD_BYTES`` bytes where it is longer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from exposia.llm.lattice import MARK, Known, Lattice, Pieces, spans_of
from exposia.llm.text import prefix_hash, span_hash, text_chunks, utf8, words, worker_state
from exposia.sources.staging import materialize

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
FIT_DOCS = 3000  # labelled texts used per language, at most about so many
ROUNDS = 4
WORD_BYTES = 64
_SMOOTHING = 0.01
_CACHED_WORDS = 300_000
_WORDS_AT_ONCE = 20_000  # words of one lattice


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a vocabulary as bytes, a space for its mark, and all single bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    found = {model.id_to_piece(i).replace(MARK, " ").encode() for i in plain}
    return sorted(found | {bytes([b]) for b in range(256)})


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words with their space, where they start and end, and their texts."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    starts, ends, owner = words(data, offsets)
    long = ends - starts > WORD_BYTES - 1
    if long.any():
        parts = -(-(ends - starts) // (WORD_BYTES - 1))
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends, owner = np.repeat(ends, parts), np.repeat(owner, parts)
        starts = np.repeat(starts, parts) + step * (WORD_BYTES - 1)
        ends = np.minimum(ends, starts + WORD_BYTES - 1)
    return data, starts, ends, owner


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of spans with a space before each."""
    body, offsets = spans_of(data, starts, ends)
    out = np.full(len(body) + len(starts), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[:-1] + np.arange(len(starts))] = False
    out[keep] = body
    return out, offsets + np.arange(len(offsets))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n of each chunk."""
    for batch in text_chunks(batches):
        data, starts, ends, owner = _words(batch.column("text"))
        code = batch.column("lang").dictionary_encode()
        lang = np.asarray(code.indices, np.int64)[owner]
        name = span_hash(prefix_hash(data), starts, ends) + lang.astype(np.uint64)
        _, at, count = np.unique(name, return_index=True, return_counts=True)
        body, offsets = _spaced(data, starts[at], ends[at])
        raw = body.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        langs = code.dictionary.take(pa.array(lang[at]))
        yield pa.RecordBatch.from_arrays([langs, pa.array(texts, pa.binary()), pa.array(count)], names=["lang", "word", "n"])


def _expected(pieces: Pieces, langs: list[str], logs: np.ndarray):
    """Expected piece counts under the probabilities so far."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(logs.shape)
        for batch in batches:
            column = batch.column("lang").dictionary_encode()
            lang = np.array([langs.index(x) for x in column.dictionary.to_pylist()])[np.asarray(column.indices)]
            raw = batch.column("word").to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)
            lattice = Lattice.of(pieces, np.frombuffer(b"".join(raw), np.uint8), offsets)
            of = lang[lattice.owner]
            weight = logs[lattice.piece, of]
            ahead, behind = lattice.log_sums(weight), lattice.log_sums_back(weight)
            share = np.exp(ahead[lattice.source] + weight + behind[lattice.target] - ahead[lattice.last][lattice.owner])
            np.add.at(total, (lattice.piece, of), share * np.asarray(batch.column("n"))[lattice.owner])
        piece, of = np.nonzero(total)
        columns = [pa.array(piece), pa.array(of), pa.array(total[piece, of])]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "lang", "n"])

    return rows


@dataclass
class LanguageModel:
    """``logs[piece, language]``: log probabilities."""

    pieces: list[bytes]
    langs: list[str]
    logs: np.ndarray


def fit(docs: DataFrame, path: str, use: Column, max_docs: int = FIT_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit on rows of ``docs`` (doc_id, text, lang) where ``use`` holds and lang is not null.

    About ``max_docs`` texts a language are used, chosen by a hash of doc_id and text: the fit is
    bounded by that and by the vocabulary, whatever the size of the table. Languages are a short list.
    """
    known = docs.filter(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces, langs = vocabulary(path), sorted(counts)
    logs = np.full((len(pieces), len(langs)), -np.log(len(pieces)))
    if not langs:
        return LanguageModel(pieces, langs, logs)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_docs / counts[lang]))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / 1_000_003
    sample = known.filter(chance < share[F.col("lang")]).select("lang", "text")
    table = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    table = materialize(table, "words")
    automaton = Pieces(pieces)
    for _ in range(rounds):
        sums = table.mapInArrow(_expected(automaton, langs, logs), "piece long, lang long, n double")
        found = sums.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()  # vocabulary x languages
        mass = np.full(logs.shape, _SMOOTHING)
        mass[found["piece"], found["lang"]] += found["n"]
        logs = np.log(mass / mass.sum(axis=0))
    return LanguageModel(pieces, langs, logs)


class _Words:
    """Log probabilities of words by language, each kind of word summed once per worker."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, Pieces(model.pieces)
        self.known = Known(_CACHED_WORDS)
        self.table = np.zeros((1024, len(model.langs)))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        name, at, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        if self.known.full:
            self.known.clear()
        number, fresh = self.known.find(name)
        at, place = at[fresh], number[fresh]
        while len(self.known.names) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for k in range(0, len(at), _WORDS_AT_ONCE):
            some = at[k : k + _WORDS_AT_ONCE]
            lattice = Lattice.of(self.pieces, *_spaced(data, starts[some], ends[some]))
            self.table[place[k : k + _WORDS_AT_ONCE]] = lattice.log_sums(self.model.logs[lattice.piece])[lattice.last]
        return self.table[number][back]


def _predict(model: LanguageModel, text: int):
    """``text``: which field of the row holds the text, so that it is sent once."""
    mark = uuid.uuid4().hex

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            columns = [row, pc.struct_field(row, text), batch.column("letters")]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "text", "letters"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = worker_state(mark, lambda: _Words(model))
        for batch in text_chunks(with_text(batches), limit=1 << 20, keep=mark):
            data, starts, ends, owner = _words(batch.column("text"))
            word = scores(data, starts, ends)
            total = np.zeros((len(batch), len(model.langs)))
            for k in range(len(model.langs)):
                total[:, k] = np.bincount(owner, word[:, k], minlength=len(batch))
            best = total.argmax(axis=1)
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            score = 1 / odds.sum(axis=1)
            letters = np.asarray(batch.column("letters").to_pylist(), bool)
            lang = [model.langs[b] if some else UNKNOWN for b, some in zip(best, letters)]
            columns = [batch.column("row"), pa.array(lang, pa.string()), pa.array(np.where(letters, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score"])

    return rows


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang_pred`` and ``score``, the chance of that language
    among the model's, all equally likely beforehand.

    A text without any letter, an empty or a null one is ``und`` with score 0, as is every text where
    the model knows no language. Equal chances go to the first language by name.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, letters)
    text = [c.lower() for c in docs.columns].index("text")
    if not model.langs:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = f"row {docs.schema.simpleString()}, lang_pred string, score double"
    return rows.mapInArrow(_predict(model, text), schema)
