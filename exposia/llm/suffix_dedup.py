"""Removal of long repeats with enhanced suffix arrays.

A byte goes if a 100-byte string that covers it also starts earlier in the corpus.

1. Each 100-byte window has an anchor: its 40-byte gram of least hash, the leftmost of equals. Equal
   windows have equal anchors at equal places, so windows only need comparing under one anchor. The
   windows of one anchor occurrence are neighbours and make one slice of text.
2. Under an anchor, a slice equal to an earlier one is a repeat as a whole. Only the first of each
   kind of slice, under anchors with several kinds, is compared further.
3. Those slices go to their anchor as text. A suffix array with common-prefix lengths is built over
   all window starts of a batch of anchors, and a stack scan gives the tree of common-prefix
   intervals; intervals of 100 bytes or more whose left neighbours differ are the maximal repeats,
   with all their occurrences. All but the first occurrence of each go.

Equal slices are reduced inside each chunk of text before the shuffle, so copies send one row per
chunk. Anchors that head different slices in over one in ``HOT_SHARE`` documents, or more than
``GROUP`` kinds of slices, are not brought to one task: their windows are compared one by one by
hash with a pre-aggregated minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from exposia.llm.groups import runs
from exposia.llm.text import give_back, mix, powers, prefix_hash, signed, span_hash, text_chunks, utf8
from exposia.sources.staging import materialize

LENGTH = 100
GRAM = 40
HOT_SHARE = 300
GROUP = 4000
CHUNK_BYTES = 1 << 20  # text cut into slices at once; each byte takes about 90 more for a while
PIECE = 1 << 20
LAST_ID = (1 << 63) - 1
_U = np.uint64
_BATCH_BYTES = 1 << 19


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _slices(data: np.ndarray, offsets: np.ndarray):
    """Anchor hash, slice hash, text number, first and last window start, running hash."""
    n = len(data)
    running = prefix_hash(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return np.zeros(0, _U), np.zeros(0, _U), empty, empty, empty, running
    _, down = powers(n)
    gram = mix((running[GRAM:] - running[:-GRAM]) * down[: n - GRAM + 1] + _U(GRAM))
    place = np.arange(len(gram), dtype=_U)
    best = _least((gram & ~_U(0xFFFFFF)) | place, LENGTH - GRAM + 1) & _U(0xFFFFFF)
    limit = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.flatnonzero(np.arange(LENGTH, n + 1) <= limit[: n - LENGTH + 1])
    anchor = best[starts].astype(np.int64)
    cut = np.ones(len(starts), bool)
    cut[1:] = anchor[1:] != anchor[:-1]
    first = starts[cut]
    last = starts[np.append(np.flatnonzero(cut)[1:] - 1, len(starts) - 1)] if len(starts) else empty
    at = anchor[cut]
    whole = mix(span_hash(running, first, last + LENGTH) + (at - first).astype(_U))
    return gram[at], whole, np.searchsorted(offsets, first, "right") - 1, first, last, running


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, doc, th and start within the document, long documents in overlapping pieces."""
    for batch in text_chunks(batches, limit=CHUNK_BYTES):
        data, offsets = utf8(batch.column("text"))
        doc, th = (np.asarray(batch.column(c), np.int64) for c in ("doc", "th"))
        if len(data) <= PIECE:
            yield data, offsets, doc, th, np.zeros(len(doc), np.int64)
            continue
        for i in range(len(doc)):
            for a in range(int(offsets[i]), int(offsets[i + 1]), PIECE):
                piece = data[a : min(a + PIECE + LENGTH - 1, int(offsets[i + 1]))]
                yield piece, np.array([0, len(piece)]), doc[i : i + 1], th[i : i + 1], np.array([a - offsets[i]])


def _pack(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Start and length in one number that sorts by start."""
    return (start << 8) | length


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors that head many different slices of a chunk."""
    for data, offsets, doc, _, _ in _parts(batches):
        anchor, whole, *_ = _slices(data, offsets)
        order = np.lexsort((whole, anchor))
        anchor, whole = anchor[order], whole[order]
        kind = np.ones(len(anchor), bool)
        kind[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        name, count = np.unique(anchor[kind], return_counts=True)
        often = count >= max(4, len(doc) / HOT_SHARE)
        yield pa.RecordBatch.from_arrays([signed(name[often]), pa.array(count[often].astype(np.int64))], names=["anchor", "n"])


def _windows(anchor, whole, owner, first, last, running, hot):
    """The same slices, those of hot anchors cut into single windows named by their own hash."""
    length = last - first + LENGTH
    if len(hot) and len(anchor):
        single = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        count = (last - first + 1)[single]
        begin = np.repeat(first[single] - np.cumsum(count) + count, count) + np.arange(count.sum())
        each = span_hash(running, begin, begin + LENGTH)
        keep = ~single
        anchor, whole = np.r_[anchor[keep], each], np.r_[whole[keep], each]
        owner = np.r_[owner[keep], np.repeat(owner[single], count)]
        first, length = np.r_[first[keep], begin], np.r_[length[keep], np.full(len(begin), LENGTH)]
    return anchor, whole, owner, first, length


def _merged(owner: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Spans of each owner with overlapping and touching ones joined."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    shift = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + owner * shift)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = start[1:] + owner[1:] * shift > reach[:-1]
    ends = np.append(np.flatnonzero(fresh)[1:] - 1, len(owner) - 1)
    return owner[fresh], start[fresh], reach[ends] - owner[fresh] * shift


def _anchors(hot: np.ndarray):
    """Per chunk the first of each kind of slice; what repeats inside the chunk is a span (stop set)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, doc, th, base in _parts(batches):
            anchor, whole, owner, first, length = _windows(*_slices(data, offsets), hot)
            start = first - offsets[owner] + base[owner]
            pack = _pack(start, length)
            order = np.lexsort((pack, th[owner], doc[owner], whole, anchor))
            again = np.zeros(len(order), bool)
            again[1:] = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            lead = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
            same = (doc[owner][order] == doc[owner][lead]) & (th[owner][order] == th[owner][lead])
            repeat = again & (~same | (pack[order] != pack[lead]))
            keep, gone = order[~again], order[repeat]
            o, a, b = _merged(owner[gone], start[gone], start[gone] + length[gone])
            key = np.r_[anchor[keep], mix(doc[o].astype(_U) * _U(31) + a.astype(_U))]
            n, m = len(keep), len(o)
            yield pa.RecordBatch.from_arrays(
                [
                    signed(key),
                    signed(np.r_[whole[keep], np.zeros(m, _U)]),
                    pa.array(np.r_[doc[owner[keep]], doc[o]]),
                    pa.array(np.r_[th[owner[keep]], th[o]]),
                    pa.array(np.r_[pack[keep], _pack(a, np.zeros(m, np.int64))]),
                    pa.array(np.r_[np.zeros(n, np.int64), b], mask=np.r_[np.ones(n, bool), np.zeros(m, bool)]),
                ],
                names=["anchor", "whole", "doc", "th", "pack", "stop"],
            )

    return rows


def interval_tree(lcp: np.ndarray, left: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, length) of suffix-array intervals with a common prefix of ``least`` or more and
    two different left neighbours; a neighbour below 0 differs from every other. ``lcp[i]`` is the
    common prefix of entries i - 1 and i."""
    found = []
    changes = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | (left[1:] < 0))])
    high = np.flatnonzero(lcp >= least)
    if not len(high):
        return found
    for block in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
        stack: list[tuple[int, int]] = []  # (first entry, length)
        for i, length in [*zip(block.tolist(), lcp[block].tolist()), (int(block[-1]) + 1, least - 1)]:
            first = i - 1
            while stack and stack[-1][1] > length:
                first, size = stack.pop()
                if changes[i - 1] > changes[first]:
                    found.append((first, i - 1, size))
            if length >= least and (not stack or stack[-1][1] < length):
                stack.append((first, length))
    return found


def suffix_array(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """Suffixes of LENGTH bytes or more in order of group, then bytes, with common prefixes.

    Returns start, slice number and, for each entry, the bytes shared with the entry before."""
    n = np.diff(offsets)
    count = np.maximum(n - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][owner]
    rest = offsets[1:][owner] - start
    cells = -(-int(rest.max(initial=LENGTH)) // 8)
    padded = np.concatenate([data, np.zeros(8 * cells, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    columns = []
    for c in range(cells):
        word = np.ascontiguousarray(words[start + 8 * c]).view(">u8").ravel().astype(_U)
        spare = np.clip(8 * (c + 1) - rest, 0, 8)  # bytes past the slice
        word = np.where(spare >= 8, _U(0), word >> (8 * np.minimum(spare, 7)).astype(_U) << (8 * np.minimum(spare, 7)).astype(_U))
        columns.append(word)
    order = np.lexsort([rest, *columns[::-1], group[owner]])
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    for word in columns:
        w = word[order]
        differ = w[1:] ^ w[:-1]
        lead = np.full(len(differ), 8)
        for k in range(8):
            lead = np.where((lead == 8) & ((differ >> _U(56 - 8 * k)) != 0), k, lead)
        lcp[1:] += np.where(same, lead, 0)
        same &= lead == 8
    shorter = np.minimum(rest[order][1:], rest[order][:-1])
    lcp[1:] = np.where(group[owner][order][1:] == group[owner][order][:-1], np.minimum(lcp[1:], shorter), 0)
    return start[order], owner[order], lcp


def repeats(texts: list[bytes], group: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Maximal repeats inside each group: slice numbers, starts in them, and the length."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, owner, lcp = suffix_array(data, offsets, group)
    inside = start > offsets[:-1][owner]
    left = np.where(inside, data[start - 1].astype(np.int64), -1)
    return [
        (owner[a : b + 1], start[a : b + 1] - offsets[owner[a : b + 1]], size)
        for a, b, size in interval_tree(lcp, left, LENGTH)
    ]


def _spans_of(tables: list[pa.Table]) -> pa.RecordBatch | None:
    """All but the first occurrence of every maximal repeat, for some anchors at once."""
    table = pa.concat_tables(tables)
    doc, th, pack = (table[c].to_numpy() for c in ("doc", "th", "pack"))
    group = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    base = pack >> 8
    owners, starts, stops = [], [], []
    for owner, start, size in repeats(table["slice"].to_pylist(), group):
        at = base[owner] + start
        order = np.lexsort((at, th[owner], doc[owner]))
        gone = order[1:]
        gone = gone[(doc[owner[gone]] != doc[owner[order[0]]]) | (th[owner[gone]] != th[owner[order[0]]]) | (at[gone] != at[order[0]])]
        owners.append(owner[gone])
        starts.append(at[gone])
        stops.append(at[gone] + size)
    if not owners:
        return None
    owner, start, stop = _merged(np.concatenate(owners), np.concatenate(starts), np.concatenate(stops))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[owner]), pa.array(th[owner]), pa.array(_pack(start, np.zeros(len(start), np.int64))), pa.array(stop)],
        names=["doc", "th", "pack", "stop"],
    )


def _maximal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give_back()
    held, size = [], 0
    for group in runs(batches, ["anchor"]):
        held.append(group)
        size += group.nbytes
        if size >= _BATCH_BYTES:
            found, held, size = _spans_of(held), [], 0
            if found is not None:
                yield found
    if held and (found := _spans_of(held)) is not None:
        yield found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of wanted slices; those of large groups as windows (slice null, anchor their hash)."""
    for batch in text_chunks(batches):
        data, offsets = utf8(batch.column("text"))
        wanted = batch.column("wanted")
        doc, th = (np.repeat(np.asarray(batch.column(c), np.int64), np.diff(np.asarray(wanted.offsets))) for c in ("doc", "th"))
        owner = np.repeat(np.arange(len(batch)), np.diff(np.asarray(wanted.offsets)))
        flat = wanted.flatten()
        anchor, pack = (np.asarray(flat.field(c), np.int64) for c in ("anchor", "pack"))
        large = np.asarray(flat.field("large").cast(pa.int8())).astype(bool)
        start = offsets[owner] + (pack >> 8)
        length = pack & 0xFF
        raw = data.tobytes()
        texts = [None if w else raw[a : a + n] for a, n, w in zip(start.tolist(), length.tolist(), large.tolist())]
        keep = np.flatnonzero(~large)
        if large.any():
            running = prefix_hash(data)
            count = np.where(large, length - LENGTH + 1, 0)
            again = np.repeat(np.arange(len(pack)), count)
            step = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
            at = start[again] + step
            name = span_hash(running, at, at + LENGTH).view(np.int64)
            moved = (pack[again] & ~0xFF) + (step << 8) + LENGTH
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(doc[again]), pa.array(th[again]), pa.array(moved), pa.nulls(len(again), pa.binary())],
                names=["anchor", "doc", "th", "pack", "slice"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[keep]), pa.array(doc[keep]), pa.array(th[keep]), pa.array(pack[keep]), pa.array([texts[i] for i in keep], pa.binary())],
            names=["anchor", "doc", "th", "pack", "slice"],
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document."""
    for batch in text_chunks(batches):
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "spans")}
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            raw = (text or "").encode()
            ends = np.array([(s["start"], s["stop"]) for s in spans or []], np.int64).reshape(-1, 2)
            _, start, stop = _merged(np.zeros(len(ends), np.int64), ends[:, 0], ends[:, 1])
            at, rest = 0, []
            for a, b in zip(start.tolist(), stop.tolist()):
                rest.append(raw[at:a])
                at = b
            left = b"".join([*rest, raw[at:]])
            values = (len(raw), len(raw) - len(left), len(start), hashlib.sha256(left).hexdigest(), left, left.decode(errors="ignore"))
            for name, value in zip(out, (*values, [{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist())])):
                out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        columns = [batch.column("row"), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]]
        yield pa.RecordBatch.from_arrays(columns, names=["row", *out])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and any others) as struct ``row``, and per document
    ``n_bytes, n_removed, n_spans, kept_sha256, kept`` (bytes left), ``kept_text`` (the same without
    characters that were cut through) and ``spans`` (removed runs).

    A null text is empty. A null doc_id comes after all others. Rows with one doc_id are ordered by
    a 64-bit hash of their text; rows equal in both are one document, neither earlier than the other, and
    get the same result. Windows never cross documents. Texts under 100 bytes stay as they are.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    total = docs.count()
    repeated = docs.select(doc).distinct().count() != total
    th = (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("th")  # needed only to tell rows of one doc apart
    keyed = docs.select(doc, th, "text")
    often = keyed.mapInArrow(_often, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    # Below HOT_SHARE * (anchors in a mean document) anchors can be so frequent: a bounded list.
    hot = often.filter(F.col("n") >= max(16, total / HOT_SHARE)).select("anchor").toPandas()["anchor"]
    hot = np.sort(hot.to_numpy(np.int64).view(_U))

    slices = keyed.mapInArrow(_anchors(hot), "anchor long, whole long, doc long, th long, pack long, stop long")
    kind = "rank() over (partition by anchor, whole order by doc, th, pack) as _place"
    mixed = "min(whole) over (partition by anchor) != max(whole) over (partition by anchor) as _mixed"
    placed = slices.repartition("anchor").selectExpr("*", kind, mixed)
    found = placed.filter("stop is not null or _place > 1 or _mixed")
    stop = F.coalesce("stop", F.when(F.col("_place") > 1, F.shiftright("pack", 8) + F.col("pack").bitwiseAND(F.lit(0xFF))))
    found = materialize(found.select("anchor", "doc", "th", "pack", stop.alias("stop")), "slices")

    open_ = found.filter("stop is null").select("anchor", "doc", "th", "pack")
    large = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP)
    open_ = open_.join(large.select("anchor", F.lit(True).alias("large")), "anchor", "left")
    item = F.struct("anchor", "pack", F.coalesce("large", F.lit(False)).alias("large"))
    wanted = open_.groupBy("doc", "th").agg(F.collect_list(item).alias("wanted"))
    one = keyed.dropDuplicates(["doc", "th"]) if repeated else keyed
    cut = one.join(wanted, ["doc", "th"]).mapInArrow(_cut, "anchor long, doc long, th long, pack long, slice binary")
    cut = materialize(cut, "cut")
    text = cut.filter("slice is not null").repartition("anchor").sortWithinPartitions("anchor")
    maximal = text.mapInArrow(_maximal, "doc long, th long, pack long, stop long")
    single = cut.filter("slice is null").select("anchor", "doc", "th", "pack")
    first = single.groupBy("anchor").agg(F.min(F.struct("doc", "th", "pack")).alias("first"))
    later = single.join(first, "anchor").filter(F.struct("doc", "th", "pack") > F.col("first"))
    start = F.shiftright("pack", 8).alias("start")
    later = later.select("doc", "th", "pack", (start + LENGTH).alias("stop"))

    spans = found.filter("stop is not null").select("doc", "th", "pack", "stop").union(maximal).union(later)
    spans = spans.select("doc", "th", start, "stop").groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, spans array<struct<start:long,stop:long>>"
    row_type = docs.drop("text").schema.simpleString()
    joined = docs.select(doc, th, "text", row).join(spans, ["doc", "th"], "left")
    return joined.select("row", "text", "spans").mapInArrow(_kept, f"row {row_type}, {schema}")
