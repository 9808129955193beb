"""Words that are runs of chosen bytes, of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

# Digits, ASCII letters and every byte of a character beyond ASCII.
LETTERS_AND_DIGITS = np.zeros(256, bool)
LETTERS_AND_DIGITS[0x30:0x3A] = True
LETTERS_AND_DIGITS[0x41:0x5B] = True
LETTERS_AND_DIGITS[0x61:0x7B] = True
LETTERS_AND_DIGITS[0x80:] = True


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of true bytes; a run never crosses from text to text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def per_text(owner: np.ndarray, n: int) -> np.ndarray:
    """How many runs each of the n texts has."""
    return np.bincount(owner, minlength=n).astype(np.int64)
