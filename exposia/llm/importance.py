"""Importance resampling towards a target: hashed n-gram gains, scores, and a distributed quickselect.

1. One pass counts the hashed features (words and pairs of words) of the corpus and of the target
   into a table of ``BUCKETS`` rows; the gain of a bucket is the log ratio of its smoothed shares.
2. A second pass sums the gains of each document in arrays, adds Gumbel noise from a hash of its
   doc_id and writes one small row of keys a document, so that later passes never see a text.
3. The k-th key is found by quickselect: random pivots, exact counts below, at and above each, and
   the range that holds rank k is looked at again. Only counts and pivots reach the driver.
4. Rows up to the k-th key are ordered by range and numbered from the sizes of the ranges; all
   others keep a null rank.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from exposia.llm.runs import LETTERS_AND_DIGITS, per_text, runs_of
from exposia.llm.text import LOWER, group_sums, prefix_hash, span_hash, text_chunks, utf8
from exposia.sources.staging import materialize

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
PIVOTS = 32  # random keys a round, on average
SORTED_AT_ONCE = 4096  # keys left when the driver orders them itself
_KEPT_LENGTHS = 64
_SHIFTS: dict[int, np.ndarray] = {}


def _shift_table(length: int) -> np.ndarray:
    """What ``length`` more bytes do to a crc32, as four tables of a byte each: it is linear."""
    if length in _SHIFTS:
        return _SHIFTS[length]
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << b) ^ base for b in range(32)], np.uint32)
    table = np.zeros((4, 256), np.uint32)
    for b in range(32):
        table[b // 8, (np.arange(256) >> (b % 8)) & 1 == 1] ^= bits[b]
    if length <= _KEPT_LENGTHS:
        _SHIFTS[length] = table
    return table


def joined_crc(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings put together, from the crc32 of each."""
    if not len(left):
        return np.zeros(0, np.uint32)
    lengths, at = np.unique(right_length, return_inverse=True)
    tables = np.stack([_shift_table(int(n)) for n in lengths])
    moved = right.copy()
    for k in range(4):
        moved ^= tables[at, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return moved


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, and the number of words of each text."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    low = LOWER[data]
    starts, ends, owner = runs_of(LETTERS_AND_DIGITS[low], offsets)
    words = per_text(owner, n)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    _, first, at = np.unique(span_hash(prefix_hash(low), starts, ends), return_index=True, return_inverse=True)
    raw, space = low.tobytes(), zlib.crc32(b" ")
    spelled = [raw[starts[i] : ends[i]] for i in first]
    alone = np.array([zlib.crc32(w) for w in spelled], np.uint32)[at]
    after = np.array([zlib.crc32(w, space) for w in spelled], np.uint32)[at]
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    both = joined_crc(alone[pair], after[pair + 1], (ends - starts)[pair + 1] + 1)
    found = np.concatenate([alone, both]).astype(np.int64) % buckets
    return found, np.concatenate([owner, owner[pair]]), words


def _counter(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_chunks(batches):
            total += np.bincount(features(batch.column("text"), buckets)[0], minlength=buckets)
        kept = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(total[kept])], names=["bucket", "n"])

    return rows


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all texts; tasks send one row a bucket at most."""
    counted = texts.select("text").mapInArrow(_counter(buckets), "bucket int, n long")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole-number gain of each bucket: how much likelier the target's features are, smoothed by one."""
    buckets, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(corpus.tolist(), target.tolist())],
        np.int64,
    )


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a hash of the doc_id; null counts as empty text."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int.from_bytes(hashlib.sha256(name.encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            bucket, owner, words = features(batch.column("text"), len(gain))
            n = per_text(owner, len(batch))
            order = np.argsort(owner, kind="stable")
            total = group_sums(gain[bucket[order]], np.concatenate([[0], np.cumsum(n)]))
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = batch.column("doc_id").to_pylist()
            score = weight + np.array([noise(i, seed) for i in ids], np.int64)
            found = [batch.column("row"), *map(pa.array, (words, n, weight, score))]
            yield pa.RecordBatch.from_arrays(found, names=["row", "n_words", "n_features", "weight", "score"])

    return rows


def _literal(key: Sequence[int], names: Sequence[str]) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, key)])


def kth_key(keys: DataFrame, names: Sequence[str], k: int, total: int, pivots: int = PIVOTS, at_once: int = SORTED_AT_ONCE) -> tuple[int, ...]:
    """The k-th smallest (from 1) of ``total`` keys: columns of whole numbers, never null, no two alike.

    Each round draws random keys of the range that is left, counts the rows below, at and between
    them, and goes on with the range that holds rank k. At most ``at_once`` keys are ordered at the driver.
    """
    key = F.struct(*[F.col(n).cast("long").alias(n) for n in names])
    low = high = None
    left, rank, seed = total, k, 0
    while True:
        active = keys.select(*names)
        active = active if low is None else active.filter(key > _literal(low, names))
        active = active if high is None else active.filter(key < _literal(high, names))
        if left <= at_once:
            return sorted(tuple(r) for r in active.collect())[rank - 1]
        seed += 1
        draw = F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1 << 40)) < int((1 << 40) * pivots / left)
        points = sorted({tuple(r) for r in active.filter(draw).limit(8 * pivots).collect()})
        if not points:
            continue
        marks = F.array(*[_literal(p, names) for p in points])
        below = F.size(F.filter(marks, lambda p: p < key))
        at = F.array_contains(marks, key)
        counts = active.groupBy(below.alias("below"), at.alias("at")).count().collect()
        found = {(r["below"], r["at"]): r["count"] for r in counts}
        for i in range(len(points) + 1):  # the keys below point i, then the point itself
            here = found.get((i, False), 0)
            if rank <= here:
                low, high = points[i - 1] if i else low, points[i] if i < len(points) else high
                left = here
                break
            rank -= here
            if rank <= (there := found.get((i, True), 0)):
                return points[i]
            rank -= there


def ranked(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of the keys: ranges are ordered, then numbered from
    their sizes (one row a range)."""
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names)
    rows = materialize(rows.withColumn("_place", F.monotonically_increasing_id()), "winners")
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    rows = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return rows.withColumn("rank", F.col("_start") + inside + 1).drop("_place", "_part", "_start")


def importance_sample(
    docs: DataFrame,
    target: DataFrame,
    *,
    keep: Sequence[str] | None = None,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``row`` (the ``keep`` columns of ``docs``, all by default) with ``n_words, n_features, weight,
    score, rank`` for every row of ``docs`` (doc_id, text).

    ``rank`` counts from 1 over the drawn documents, the highest score first, and is null for others.
    Of the N documents of ``least_words`` words or more floor(percent * N / 100) are drawn. A null
    or empty text has no words, weight 0, and a score from its noise alone. A null doc_id takes the
    noise of an empty id and comes after equal scores with one. Rows with one doc_id each count and
    are told apart by a hash of their text, then at random; rows equal in both give the same values.
    An empty target makes every gain the same share of the corpus; an empty ``docs`` gives no rows.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    names = list(keep) if keep is not None else docs.columns
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[f"`{c}`" for c in names]).alias("row"))
    row_type = rows.schema["row"].dataType.simpleString()
    marked = rows.select("doc_id", "text", F.struct("row", "doc_id", F.xxhash64("text").alias("mark")).alias("row"))
    schema = f"row struct<row:{row_type},doc_id:bigint,mark:bigint>, n_words long, n_features long, weight long, score long"
    scored = marked.mapInArrow(_scorer(gain, seed), schema).select(
        "row.row", "n_words", "n_features", "weight", "score",
        (-F.col("score")).alias("_order"),
        F.col("row.doc_id").isNull().cast("long").alias("_unnamed"),
        F.coalesce("row.doc_id", F.lit(0)).cast("long").alias("_doc"),
        F.col("row.mark").alias("_mark"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    scored = materialize(scored, "scored")
    order = ["_order", "_unnamed", "_doc", "_mark", "_seq"]
    eligible = scored.filter(F.col("n_words") >= least_words)
    total = eligible.count()
    wanted = percent * total // 100
    out = ["row", "n_words", "n_features", "weight", "score", "rank"]
    if not wanted:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    last = _literal(kth_key(eligible, order, wanted, total), order)
    wins = (F.col("n_words") >= least_words) & (F.struct(*order) <= last)
    drawn = ranked(scored.filter(wins), order).withColumn("rank", F.col("rank").cast("long"))
    rest = scored.filter(~wins).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*out).unionByName(rest.select(*out))
