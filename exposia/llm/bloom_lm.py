"""Language-model scores from a log-frequency Bloom filter.

Counts of one- and two-token n-grams of the training texts are quantised to ``q = 1 + floor(log2 c)``
and each n-gram is entered with every level up to its q. A look-up probes level after level until
one is missing, so a count is never underestimated, and overestimated only by chance. The filter has
a stated size and is broadcast; n-grams rarer than a cutoff are left out of it, the lowest cutoff
for which the entries fit. The cutoff follows from counts over all texts. Of what the filter does not
know, texts send the n-grams that may still have a level below the cutoff to a join with the stored
levels, so the size of the filter changes no score. Pairs weigh as much as the share of training
tokens whose pair would be known without that token. Of a pair only its level is stored.

Exact token counts, for the base score, are joined: the most frequent ``TOP`` tokens are broadcast,
the few other occurrences are joined by token.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from exposia.llm.groups import apply_to_groups
from exposia.llm.text import group_sums, mix, signed, text_chunks, utf8, word_hashes
from exposia.sources.staging import materialize

FILTER_BITS = 28
TOP = 1 << 17
_BLOCK_BITS = 20
_PROBES = 3
_U = np.uint64
_BEGIN, _END = _U(0x1234567), _U(0x7654321)
_PAIR = _U(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and where each text starts."""
    data, offsets = utf8(column)
    name, owner = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(owner, minlength=n) + 1
    ends = np.cumsum(count)
    out = np.full(int(ends[-1]) if n else 0, _END, _U)
    body = np.ones(len(out), bool)
    body[ends - 1] = False
    out[body] = name
    return out, np.concatenate([[0], ends]).astype(np.int64)


def pairs(token: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it, the begin mark before the first."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[offsets[:-1]] = _BEGIN
    return mix(before * _PAIR + token)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, limit=4 << 20):
        token, offsets = tokens(batch.column("text"))
        for order, names in ((1, token), (2, pairs(token, offsets))):
            name, n = np.unique(names, return_counts=True)
            if order == 1:  # the begin mark is the context of the first tokens
                name, n = np.r_[name, _BEGIN], np.r_[n, len(batch)]
            columns = [signed(name), pa.array(np.full(len(name), order, np.int8)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "ngram", "n"])


def _places(name: np.ndarray, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Block of each n-gram and its places in the block for one level."""
    h = mix(name ^ mix(np.array([level], _U)))
    mask = _U((1 << _BLOCK_BITS) - 1)
    return h, [((h >> _U(_BLOCK_BITS * i)) & mask).astype(np.int64) for i in range(_PROBES)]


def _block(group: pa.Table) -> pa.RecordBatch:
    name, level = group["name"].to_numpy().view(_U), group["level"].to_numpy()
    bits = np.zeros(1 << _BLOCK_BITS, bool)
    for j in range(1, int(level.max()) + 1):
        for place in _places(name[level >= j], j)[1]:
            bits[place] = True
    cells = np.packbits(bits, bitorder="little").tobytes()
    return pa.RecordBatch.from_arrays([group["block"].slice(0, 1).combine_chunks(), pa.array([cells])], names=["block", "cells"])


class LogFrequencyFilter:
    """Quantised counts by membership probes."""

    def __init__(self, cells: np.ndarray, shift: int, cutoff: int):
        self.cells, self.shift, self.cutoff = cells, shift, cutoff

    def levels(self, name: np.ndarray) -> np.ndarray:
        """Highest level up to which all probes hit; 0 for unseen or left-out n-grams."""
        base = (name >> _U(self.shift)).astype(np.int64) << (_BLOCK_BITS - 3) if self.shift < 64 else np.zeros(len(name), np.int64)
        level, alive = np.zeros(len(name), np.int64), np.arange(len(name))
        for j in itertools.count(1):
            _, places = _places(name[alive], j)
            hit = np.ones(len(alive), bool)
            for place in places:
                hit &= (self.cells[base[alive] + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            alive = alive[hit]
            if not len(alive):
                return np.where(level < self.cutoff, 0, level)
            level[alive] = j


def middle(level: np.ndarray) -> np.ndarray:
    """A middle count of the level: exact for 1, between its bounds above."""
    return np.where(level > 0, np.sqrt(np.exp2(level - 1.0) * (np.exp2(level * 1.0) - 1)), 0.0)


def log_chance(one: np.ndarray, before: np.ndarray, two: np.ndarray, total: int, weight: float) -> np.ndarray:
    """Log of each token's chance, from the levels of the token, of the one before and of the pair."""
    one, before, two = middle(one), middle(before), middle(two)
    share = np.where(two > 0, np.minimum(1.0, two / np.maximum(before, np.maximum(two, 1.0))), 0.0)
    return np.log10(weight * share + (1 - weight) * (one + 1) / total)


def level_of(n: str) -> Column:
    return (F.floor(F.log2(n) + 1e-9) + 1).cast("int")


def build_filter(counts: DataFrame, bits: int = FILTER_BITS) -> LogFrequencyFilter:
    """The filter over ``name`` and ``n``, or ``level`` in its place. Only its blocks, ``2 ** bits``
    bits in all, come to the driver."""
    level = F.col("level") if "level" in counts.columns else level_of("n").alias("level")
    leveled = counts.select("name", level)
    sums = {r["level"]: r["n"] for r in leveled.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    room, cutoff = (1 << bits) * np.log(2) / _PROBES, 1
    while sum(q * n for q, n in sums.items() if q >= cutoff) > room:
        cutoff += 1
    shift = 64 - max(0, bits - _BLOCK_BITS)
    block = F.shiftrightunsigned("name", shift) if shift < 64 else F.lit(0).cast("long")
    kept = leveled.filter(F.col("level") >= cutoff).withColumn("block", block)
    blocks = apply_to_groups(kept, ["block"], _block, "block long, cells binary")
    size = 1 << (_BLOCK_BITS - 3)
    cells = np.zeros(size << max(0, bits - _BLOCK_BITS), np.uint8)
    for row in blocks.toLocalIterator():
        cells[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["cells"], np.uint8)
    return LogFrequencyFilter(cells, shift, cutoff)


def _lists(count: np.ndarray, **fields: pa.Array) -> pa.ListArray:
    """So many structs for each row."""
    items = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), items)


def _score(model, top, total: int, weight: float):
    """Per text: tokens, sums over the top tokens, the model's score, and the other tokens.

    ``score`` is over the tokens all whose levels are known here; ``open`` are the others, one entry
    for each pair of the text, and ``probes`` the names to look up for them. What a text was trained
    on has level 1 at least, so nothing is open there when only level 1 is left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, (names, logs) = model.value, top.value
        row = TaskContext.get().partitionId() << 40
        for batch in text_chunks(batches):
            token, offsets = tokens(batch.column("text"))
            at = np.minimum(np.searchsorted(names, token), max(len(names) - 1, 0))
            known = names[at] == token if len(names) else np.zeros(len(token), bool)
            base = np.where(known, logs[at], 0.0) if len(names) else np.zeros(len(token))
            double = pairs(token, offsets)
            before = np.empty_like(token)
            before[1:] = token[:-1]
            before[offsets[:-1]] = _BEGIN
            single, back = np.unique(token, return_inverse=True)
            pair, place = np.unique(double, return_inverse=True)
            level = np.empty((3, len(token)), np.int64)
            level[0], level[2] = lookup.levels(single)[back], lookup.levels(pair)[place]
            level[1, 1:] = level[0, :-1]
            level[1, offsets[:-1]] = lookup.levels(np.array([_BEGIN]))[0]
            owner = np.repeat(np.arange(len(batch)), np.diff(offsets))
            least = np.asarray(batch.column("trained").cast(pa.int8()), np.int64)[owner]
            unsure = (level == 0) & (least < lookup.cutoff - 1)
            level = np.where((level == 0) & ~unsure, least, level)
            late = unsure.any(axis=0)
            score = np.where(late, 0.0, log_chance(*level, total, weight))
            late = np.flatnonzero(late)
            _, first, tf = np.unique(mix(double[late] ^ mix(owner[late].astype(_U))), return_index=True, return_counts=True)
            order = np.argsort(first)
            late, tf = late[first[order]], tf[order]
            n_late = np.bincount(owner[late], minlength=len(batch))
            nth = np.arange(len(late)) - (np.cumsum(n_late) - n_late)[owner[late]]
            entry, kind = np.nonzero(unsure[:, late].T)
            name = np.stack([token[late], before[late], double[late]])[kind, entry]
            n_probes = np.bincount(owner[late][entry], minlength=len(batch))
            rare = np.flatnonzero(~known)
            count = np.bincount(np.searchsorted(offsets, rare, "right") - 1, minlength=len(batch))
            one, context, two = (pa.array(x.astype(np.int8)) for x in level[:, late])
            columns = [
                batch.column("row"),
                pa.array(np.arange(row, row + len(batch))),
                pa.array(np.diff(offsets)),
                pa.array(group_sums(known.astype(np.int64), offsets)),
                pa.array(group_sums(base, offsets)),
                pa.array(group_sums(score, offsets)),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), signed(token[rare])),
                _lists(n_late, tf=pa.array(tf.astype(np.int32)), one=one, before=context, two=two),
                _lists(n_probes, name=signed(name), at=pa.array(nth[entry].astype(np.int32)), kind=pa.array(kind.astype(np.int8))),
            ]
            row += len(batch)
            names_out = ["row", "id", "n_tokens", "known", "base", "score", "rare", "open", "probes"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return rows


def _close(total: int, weight: float):
    """The score of the open tokens of each text, with the levels found for them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(pc.fill_null(pc.list_value_length(batch.column(c)), 0), np.int64) for c in ("open", "found"))
            entry, found = batch.column("open").flatten(), batch.column("found").flatten()
            tf, *level = (np.asarray(entry.field(c), np.int64) for c in ("tf", "one", "before", "two"))
            level = np.stack(level)
            at, kind, known = (np.asarray(found.field(c), np.int64) for c in ("at", "kind", "level"))
            level[kind, np.repeat(np.cumsum(n) - n, m) + at] = known
            late = group_sums(tf * log_chance(*level, total, weight), np.concatenate([[0], np.cumsum(n)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(late)], names=["id", "_late"])

    return rows


def score(docs: DataFrame, train: Column, bits: int = FILTER_BITS, top: int = TOP) -> DataFrame:
    """``row`` (columns of ``docs`` but the text), ``n_tokens, n_known, train_tokens, base_score, score``.

    Learns from rows where ``train`` holds. A null or empty text is its end token alone. With no
    training text every count is 0. Repeated rows each count and each give a row.
    """
    sc = docs.sparkSession.sparkContext
    train = F.coalesce(train, F.lit(False))
    used = docs.filter(train).select("text")
    counts = used.mapInArrow(_count, "name long, ngram byte, n long").groupBy("name", "ngram").agg(F.sum("n").alias("n"))
    exact = F.when(F.col("ngram") == 1, F.col("n")).alias("n")
    counts = materialize(counts.filter("n > 0").select("name", "ngram", level_of("n").alias("level"), exact), "counts")
    begin = int(np.array([_BEGIN]).view(np.int64)[0])
    single = counts.filter((F.col("ngram") == 1) & (F.col("name") != begin)).select("name", "n")
    sums = single.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"]
    total = n + v + 1
    once = counts.filter("ngram = 2 and level = 1").count()  # every token ends one pair
    weight = min(0.95, max(0.01, (n - once) / max(n, 1)))
    lookup = build_filter(counts.select("name", "level"), bits)
    model = sc.broadcast(lookup)
    head = single.orderBy(F.desc("n"), "name").limit(top).toPandas().sort_values("name", key=lambda s: s.to_numpy().view(_U))
    names = head["name"].to_numpy(np.int64).view(_U)
    frequent = sc.broadcast((names, np.log10(head["n"].to_numpy(float) + 1)))

    other = docs.drop("text")
    row = F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias("row")
    schema = f"row {other.schema.simpleString()}, id long, n_tokens long, known long, base double, score double, rare array<long>"
    schema += ", open array<struct<tf:int,one:byte,before:byte,two:byte>>, probes array<struct<name:long,at:int,kind:byte>>"
    scored = docs.select(row, F.col("text").alias("text"), train.alias("trained")).mapInArrow(_score(model, frequent, total, weight), schema)
    scored = materialize(scored, "scored")
    rare = scored.select("id", F.explode("rare").alias("name")).groupBy("id", "name").agg(F.count(F.lit(1)).alias("tf"))
    found = rare.join(single, "name").groupBy("id").agg(
        F.sum("tf").alias("_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("_base")
    )
    joined = scored.join(found, "id", "left")
    score = F.col("score")
    if lookup.cutoff > 1:
        probes = scored.select("id", F.explode("probes").alias("p")).select("id", "p.*")
        levels = probes.join(counts.filter(F.col("level") < lookup.cutoff).select("name", "level"), "name")
        levels = levels.groupBy("id").agg(F.collect_list(F.struct("at", "kind", "level")).alias("found"))
        late = scored.filter(F.size("open") > 0).select("id", "open").join(levels, "id", "left")
        late = late.mapInArrow(_close(total, weight), "id long, _late double")
        joined = joined.join(late, "id", "left")
        score = (score + F.coalesce("_late", F.lit(0.0))).alias("score")
    zero = F.lit(0)
    base = F.col("base") + F.coalesce("_base", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total))
    return joined.select(
        "row", "n_tokens", (F.col("known") + F.coalesce("_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), score,
    )
