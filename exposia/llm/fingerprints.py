"""Document fingerprints by consistent weighted sampling.

The terms of a text are its five-word shingles, weighted by how often they occur. Each of 64 slots
draws, per term, gamma variables r and c and a uniform b from hashes of the term, so that all texts
draw alike. With t = floor(ln(weight) / r + b) and ln y = r (t - b), the slot keeps the term and t
of least ln c - ln y - r. Two texts keep the same with a probability equal to the sum of minima over
the sum of maxima of their weights.

The draws come from two tables under two parts of the term's hash: (r, b) from one, c from the
other, so that a term costs look-ups and no logarithms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from exposia.llm.text import mix, shingles, text_chunks, utf8, word_hashes

SLOTS = 64
_TABLE_BITS = 15
_ROWS = 16_384
PART_BYTES = 32 << 20  # of texts in a range
_U = np.uint64
_TABLES: list[np.ndarray] = []


def _uniform(stream: int) -> np.ndarray:
    cells = np.arange(SLOTS << _TABLE_BITS, dtype=_U) + _U(stream << 40)
    bits = mix(mix(cells * _U(0x9E3779B97F4A7C15) + _U(1)))
    return ((bits >> _U(11)).astype(np.float64) + 0.5).reshape(-1, SLOTS) / float(1 << 53)


def _tables() -> list[np.ndarray]:
    """r, b, ln c, and r (b - 1), by hash part and slot; 32 MB once per worker."""
    if not _TABLES:
        r = -np.log(_uniform(1) * _uniform(2))
        b = _uniform(3)
        c = np.log(-np.log(_uniform(4) * _uniform(5)))
        _TABLES.extend(x.astype(np.float32) for x in (r, b, c, r * (b - 1)))
    return _TABLES


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """16-bit marks of the kept samples, a row of SLOTS per text, and whether it has any word."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    term, owner = shingles(*word_hashes(data, offsets), n)
    order = np.argsort(term, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    term, owner = term[order], owner[order]
    fresh = np.ones(len(term), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    weight = np.diff(np.append(at, len(term)))
    term, owner = term[at], owner[at]
    best = np.full((n, SLOTS), np.inf, np.float32)
    kept = np.zeros((n, SLOTS), np.uint16)
    r, b, c, once = _tables()
    for start in range(0, len(term), _ROWS):
        part = slice(start, start + _ROWS)
        h, o, w = term[part], owner[part], weight[part]
        first = (h >> _U(64 - _TABLE_BITS)).astype(np.int64)
        second = ((h >> _U(20)) & _U((1 << _TABLE_BITS) - 1)).astype(np.int64)
        value = once[first] + c[second]
        level = np.zeros((0, SLOTS), np.int64)
        more = np.flatnonzero(w > 1)
        if len(more):
            rr, bb = r[first[more]], b[first[more]]
            level = np.floor(np.log(w[more])[:, None].astype(np.float32) / rr + bb)
            value[more] = c[second[more]] - rr * (level - bb) - rr
        heads = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        least = np.minimum.reduceat(value, heads, axis=0)
        texts = o[heads]
        better = least < best[texts]
        best[texts] = np.where(better, least, best[texts])
        index = np.cumsum(np.r_[True, o[1:] != o[:-1]]) - 1
        row, slot = (x[::-1] for x in np.nonzero((value == least[index]) & better[index]))  # of ties the least term stays
        step = np.zeros(len(row), _U)
        if len(more):
            place = np.full(len(h), -1)
            place[more] = np.arange(len(more))
            many = place[row] >= 0
            step[many] = level[place[row[many]], slot[many]].astype(np.int64).astype(_U)
        kept[o[row], slot] = (mix(h[row] + step * _U(0xD6E8FEB86659FD93)) >> _U(48)).astype(np.uint16)
    return kept, np.bincount(owner, minlength=n) > 0


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Share of equal slots; texts without words are like each other only."""
    return np.where(some_a & some_b, (a == b).mean(axis=1), (some_a == some_b).astype(float))


def _texts(marks: np.ndarray, some: np.ndarray) -> list[str]:
    return [m.tobytes().hex() if s else "" for m, s in zip(marks, some)]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and order; the row after each is its next document."""
    held: pa.RecordBatch | None = None
    for batch in text_chunks(batches):
        table = pa.concat_batches([held, batch]) if held is not None else batch
        held = table.slice(len(table) - 1)
        if len(table) == 1:
            continue
        tail = np.asarray(table.column("tail").to_pylist(), bool)[:-1]
        texts = [t or "" for t in table.column("text").to_pylist()]
        edited = [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:])]
        marks, some = signatures(pa.array(texts, pa.large_string()))
        other, some_other = signatures(pa.array(edited, pa.large_string()))
        near_edited = likeness(marks[:-1], some[:-1], other, some_other)
        near_next = likeness(marks[:-1], some[:-1], marks[1:], some[1:])
        columns = [
            table.column("doc_id").slice(0, len(edited)),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(_texts(marks[:-1], some[:-1])),
            pa.array(_texts(other, some_other)),
            pa.array(near_edited),
            pa.array(near_next),
        ]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~tail))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third (rounded down, code points)
    replaced by the start of the next document in descending doc_id, the first one after the last.

    A null or empty text has no terms and the fingerprint "". One to four words are one term. Rows
    with equal doc_id are ordered by a hash of their text, null doc_ids come last; a single row is
    its own next. Other columns of ``docs`` are ignored.

    Rows are dealt to ranges of doc_id (of the text's hash, where it is null) of about ``PART_BYTES``,
    and the first row of each range is repeated behind the range before it, so no order is kept in one
    task. Only the first id of each range is collected.
    """
    spark = docs.sparkSession
    order = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("down"), F.xxhash64("text").alias("mark"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("order", order)
    unnamed = F.col("doc_id").isNull()
    size = F.octet_length("text")
    total, of_unnamed = rows.agg(F.sum(size), F.sum(F.when(unnamed, size))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + (total or 0) // PART_BYTES)
    bounds = rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    above = [F.when(F.col("doc_id") < F.lit(int(x)), 1).otherwise(0) for x in sorted(set(bounds or []))]
    pieces = 1 + (of_unnamed or 0) // PART_BYTES
    piece = F.least(F.lit(pieces - 1), F.floor((F.col("order.mark") / float(1 << 64) + 0.5) * pieces)).cast("int")
    part = F.when(unnamed, F.lit(len(above) + 1) + piece).otherwise(sum(above, F.lit(0)))
    rows = rows.withColumn("part", part)
    heads = rows.groupBy("part").agg(F.min("order").alias("order")).orderBy("part").collect()
    schema = f"order {rows.schema['order'].dataType.simpleString()}, before int"
    before = [(h["order"], heads[i - 1]["part"]) for i, h in enumerate(heads)]
    if heads:
        named = [h["order"]["down"] for h in heads if h["order"]["down"] is not None]
        may_be = F.col("doc_id").isNull() | F.col("doc_id").isin([-x for x in named])
        first = F.broadcast(spark.createDataFrame(before, schema))  # one row per range
        keys = first.select(F.col("order").alias("_head"), "before")
        tails = rows.filter(may_be).join(keys, F.col("order").eqNullSafe(F.col("_head")))
        tails = tails.select("doc_id", "text", "order", F.col("before").alias("part"), F.lit(True).alias("tail"))
        rows = rows.select("doc_id", "text", "order", "part", F.lit(False).alias("tail")).union(tails)
    else:
        rows = rows.withColumn("tail", F.lit(False))
    rows = rows.repartitionById(len(above) + 1 + pieces, "part").sortWithinPartitions("part", "tail", "order")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "tail").mapInArrow(_fingerprint, schema)
