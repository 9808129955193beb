"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over long ones.

1. Items come in blocks of bounded size. One pass over all documents counts, per term of a block, the
   documents that hold it, and all documents and terms: the weights need them.
2. A second pass reads texts in pieces. A piece is inverted: per term of the block a list of its
   documents in order with whole-number impacts.
3. Per item the short lists are summed into accumulators. These, in order of document, are one more
   list with a bound, beside the long ones. Windows of documents are then walked in order: lists
   whose bounds together stay below the k-th best score so far give no candidates; they are only
   probed for candidates of the others that can still reach it.
4. Each task sends its best k per item; these are cut to k in two steps, so that no task sees all.

The k-th best score of an item is kept from piece to piece within a task. Nothing is estimated: a
document is passed over only when its bound is below k scores already held.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from exposia.llm.runs import LETTERS_AND_DIGITS, per_text, runs_of
from exposia.llm.text import LOWER, prefix_hash, span_hash, text_chunks, utf8

TOP = 20
LENGTH_SHARE = 25  # of a document's weight that follows its length, in percent
SATURATION = 12
PIECE_BYTES = 4 << 20  # of text inverted at once
WINDOW = 1024  # documents walked under one threshold
SHORT_SHARE = 8  # short lists together hold a document in so many at most
BLOCK_TERMS = 200_000  # of items looked up at once
SPREAD = 256
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SMALL = str.maketrans({c: c + 32 for c in range(65, 91)})
_ALL_DOCS, _ALL_TERMS = -1, -2


@dataclass
class Items:
    """A block of items: their ids, and per item the places of its terms with how often each occurs."""

    ids: list[int | None] = field(default_factory=list)
    numbers: list[int] = field(default_factory=list)
    terms: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _hash_terms(terms: list[str]) -> np.ndarray:
    spelled = [t.encode() for t in terms]
    ends = np.cumsum([len(t) for t in spelled])
    data = np.frombuffer(b"".join(spelled), np.uint8)
    return span_hash(prefix_hash(data), np.concatenate([[0], ends[:-1]]), ends)


def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Items]:
    """Items in blocks that hold about ``most`` different terms of an item at most, or one item."""
    held: list[tuple[int, int | None, Counter]] = []
    size = 0
    for number, row in enumerate(items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()):
        count = Counter(_TERM.findall((row["text"] or "").translate(_SMALL)))
        if held and size + len(count) > most:
            yield _block(held)
            held, size = [], 0
        if count:
            held.append((number, row["item_id"], count))
            size += len(count)
    if held:
        yield _block(held)


def _block(held: list[tuple[int, int | None, Counter]]) -> Items:
    terms = list({t for _, _, count in held for t in count})
    hashes = _hash_terms(terms)
    order = np.argsort(hashes)
    place = {terms[i]: at for at, i in enumerate(order)}
    out = Items(hashes=hashes[order])
    for number, item_id, count in held:
        out.ids.append(item_id)
        out.numbers.append(number)
        out.terms.append((np.array([place[t] for t in count], np.int64), np.array(list(count.values()), np.int64)))
    return out


def _postings(column: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, text and occurrences of each known term in each text, in this order, and terms of each text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, owner = runs_of(LETTERS_AND_DIGITS[low], offsets)
    found = span_hash(prefix_hash(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
    known = hashes[at] == found
    pair, often = np.unique(at[known] * n + owner[known], return_counts=True)
    return pair // max(n, 1), pair % max(n, 1), often, per_text(owner, n)


def _counter(hashes: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, terms = np.zeros(len(hashes), np.int64), 0, 0
        for batch in text_chunks(batches):
            term, _, _, n = _postings(batch.column("text"), hashes)
            held += np.bincount(term, minlength=len(hashes))
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        seen = np.flatnonzero(held)
        names, counts = np.r_[seen, _ALL_DOCS, _ALL_TERMS], np.r_[held[seen], docs, terms]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], names=["term", "n"])

    return rows


def _weigh(docs: DataFrame, block: Items) -> tuple[int, int]:
    """Set the weights of a block's terms; returns the numbers of documents and of all their terms."""
    counted = docs.select("text").mapInArrow(_counter(block.hashes), "term long, n long")
    found = dict(counted.groupBy("term").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False, name=None))
    n, terms = int(found.get(_ALL_DOCS, 0)), int(found.get(_ALL_TERMS, 0))
    held = [int(found.get(i, 0)) for i in range(len(block.hashes))]
    block.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in held], np.int64)
    return n, terms


class Best:
    """The k best documents of an item so far: score, whether it has no id, id."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((0, 3), np.int64)

    @property
    def threshold(self) -> int:
        """Least score that can still matter."""
        return max(1, int(self.rows[-1, 0])) if len(self.rows) == self.k else 1

    def add(self, rows: np.ndarray) -> None:
        both = np.concatenate([self.rows, rows])
        self.rows = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))][: self.k]


@dataclass
class Piece:
    """The inverted texts of a piece: documents of term t stand at ``starts[t] : starts[t + 1]``."""

    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    most: np.ndarray
    n_docs: int

    @classmethod
    def of(cls, column: pa.Array, block: Items, n: int, terms: int) -> Piece:
        term, doc, often, length = _postings(column, block.hashes)
        spread = 100 - LENGTH_SHARE + (LENGTH_SHARE * length * n) // max(terms, 1)
        impact = block.weights[term] * ((1_000_000_000 * often) // (1000 * often + SATURATION * spread[doc]))
        starts = np.searchsorted(term, np.arange(len(block.hashes) + 1))
        most = np.zeros(len(block.hashes), np.int64)
        np.maximum.at(most, term, impact)
        return cls(starts, doc, impact, most, len(length))

    def lists(self, terms: np.ndarray, often: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Documents, impacts and bound of each list of an item: the accumulators and the long ones."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        n_short = int(np.searchsorted(np.cumsum(sizes[order]), self.n_docs // SHORT_SHARE, "right"))
        parts = []
        for i in order:
            at = slice(self.starts[terms[i]], self.starts[terms[i] + 1])
            parts.append((self.docs[at], self.impacts[at] * often[i], int(self.most[terms[i]] * often[i])))
        short, long = parts[:n_short], parts[n_short:]
        if len(short) > 1:
            docs, sums = summed([d for d, _, _ in short], [x for _, x, _ in short])
            short = [(docs, sums, int(sums.max()))]
        return short + long


def summed(docs: list[np.ndarray], impacts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One ordered list of the documents of several, with the sums of their impacts."""
    every, worth = np.concatenate(docs), np.concatenate(impacts)
    order = np.argsort(every, kind="stable")
    every, worth = every[order], worth[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(worth, first) if len(first) else worth


def walk(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, best: Best, names: np.ndarray, window: int = WINDOW) -> None:
    """Put the documents of the lists that reach the k best into ``best``; ``names``: no id, id of each."""
    lists = sorted(lists, key=lambda x: x[2])
    bounds = np.cumsum([b for _, _, b in lists])  # of the lists up to each
    edges = np.arange(0, n_docs + window, window)
    cuts = [np.searchsorted(d, edges) for d, _, _ in lists]
    for w in range(len(edges) - 1):
        least = best.threshold
        first = int(np.searchsorted(bounds, least))  # the lists before it cannot reach the threshold
        if first == len(lists):
            return
        inside = [(d[c[w] : c[w + 1]], x[c[w] : c[w + 1]]) for (d, x, _), c in zip(lists[first:], cuts[first:])]
        docs, score = summed([d for d, _ in inside], [x for _, x in inside])
        for i in range(first - 1, -1, -1):
            alive = score + bounds[i] >= least
            docs, score = docs[alive], score[alive]
            if not len(docs):
                break
            there, worth, _ = lists[i]
            at = np.minimum(np.searchsorted(there, docs), len(there) - 1)
            score = score + np.where(there[at] == docs, worth[at], 0)
        reach = score >= least
        if reach.any():
            best.add(np.column_stack([score[reach], names[docs[reach]]]))


def _searcher(block: Items, n: int, terms: int, top: int, piece_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in block.ids]
        for batch in text_chunks(batches, limit=piece_bytes):
            names = np.column_stack([np.asarray(batch.column("unnamed"), np.int64), np.asarray(batch.column("doc_id"), np.int64)])
            order = np.lexsort((names[:, 1], names[:, 0]))
            piece = Piece.of(batch.column("text").take(pa.array(order)), block, n, terms)
            names = names[order]
            for held, (places, often) in zip(best, block.terms):
                if lists := piece.lists(places, often):
                    walk(lists, piece.n_docs, held, names)
        for number, item_id, held in zip(block.numbers, block.ids, best):
            if size := len(held.rows):
                score, unnamed, doc = held.rows.T
                found = [pa.array([number] * size), pa.array([item_id] * size, pa.int64()), pa.array(doc, mask=unnamed == 1), pa.array(score)]
                yield pa.RecordBatch.from_arrays(found, names=["number", "item_id", "doc_id", "score"])

    return rows


def search(docs: DataFrame, items: DataFrame, *, top: int = TOP, piece_bytes: int = PIECE_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents (doc_id, text) of each row of ``items``
    (item_id, text) by score, only those above 0.

    Equal scores go by ascending doc_id, a null doc_id last; rows with one doc_id each count. A null
    or empty text has no terms: such a document is in no result and such an item has none. Rows with
    one item_id are items of their own. Empty tables give no rows. Other columns are ignored. Terms
    are told apart by 64-bit hashes.
    """
    docs = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().cast("long").alias("unnamed"), "text"
    )
    parts = []
    for block in item_blocks(items, block_terms):
        n, terms = _weigh(docs, block)
        parts.append(docs.mapInArrow(_searcher(block, n, terms, top, piece_bytes), "number long, item_id long, doc_id long, score long"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = reduce(DataFrame.union, parts).withColumn("_task", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for keys in (["number", "_task"], ["number"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return found.select("item_id", "rank", "doc_id", "score")
