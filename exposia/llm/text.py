"""Words, shingles and hashes of many texts at once, as numpy arrays.

Texts stay one byte buffer with offsets. A null text is an empty one. Words are runs of bytes other
than space and 0x09-0x0D, with A-Z lower-cased.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text handled at once in a task; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
SHINGLE_WORDS = 5
_KEPT_POWERS = (1 << 20) + (1 << 16)

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_STATE: dict[str, object] = {}


def worker_state(mark: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by this worker for later tasks; a worker keeps one such thing."""
    if mark not in _STATE:
        _STATE.clear()
        _STATE[mark] = make()
    return _STATE[mark]


def give_back(keep: str | None = None) -> None:
    """Drop the worker's state unless it is ``keep``, and return freed memory to the system: workers
    live on and their stages add up."""
    if keep not in _STATE:
        _STATE.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_STEP = 0x5851F42D4C957F2D
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)
_POSITION = mix(np.arange(301, 301 + SHINGLE_WORDS, dtype=_U)) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    if n:
        steps[0] = 1
    return np.cumprod(steps)


_CACHE: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses."""
    if "up" not in _CACHE or len(_CACHE["up"]) < n:
        size = max(n, _KEPT_POWERS)
        up, down = _powers(_STEP, size), _powers(_STEP_INVERSE, size)
        if n > _KEPT_POWERS:  # a long chunk: not kept
            return up, down
        _CACHE["up"], _CACHE["down"] = up, down
    return _CACHE["up"][:n], _CACHE["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one longer than the data."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up, out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span: equal spans hash alike wherever they stand."""
    _, down = powers(max(len(running) - 1, 1))
    safe = np.minimum(starts, max(len(running) - 2, 0))
    return mix((running[ends] - running[starts]) * down[safe] + (ends - starts).astype(_U))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts, with the end last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts together are within ``limit`` bytes, one row at least.

    To be called once in a task: it gives back memory before the first slice and after the last,
    the worker's state too if it is not ``keep``.
    """
    give_back(keep)
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(np.asarray(lengths, np.int64))
        start = 0
        while start < len(batch):
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    give_back(keep)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each lower-cased word, in order."""
    low = LOWER[data]
    starts, ends, owner = words(low, offsets)
    return span_hash(prefix_hash(low), starts, ends), owner


def shingles(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of five words; a shorter text is one run of all its words."""
    if not len(hashes):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    padded = np.concatenate([hashes, np.zeros(SHINGLE_WORDS, _U)])
    short = np.flatnonzero((count > 0) & (count < SHINGLE_WORDS))
    place = np.arange(len(hashes)) - first[owner]
    at = np.flatnonzero(place <= count[owner] - SHINGLE_WORDS)
    at = np.sort(np.concatenate([at, first[short]])) if len(short) else at
    size = np.minimum(count[owner[at]], SHINGLE_WORDS)
    total = size.astype(_U)
    for j in range(SHINGLE_WORDS):
        total += np.where(j < size, padded[at + j] * _POSITION[j], _U(0))
    return mix(total), owner[at]


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and where each text's start."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    values, owner = shingles(*word_hashes(data, offsets), n)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int64)


def group_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each slice, empty slices included."""
    running = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return running[offsets[1:]] - running[offsets[:-1]]


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
