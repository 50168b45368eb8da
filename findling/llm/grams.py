"""Hashed character n-grams of a batch of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15


def framed(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank before each and one after the last, and where each begins.

    The blank before a text also ends the text before it.
    """
    starts = offsets + np.arange(len(offsets))
    out = np.full(len(flat) + len(offsets), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[starts] = False
    out[inside] = flat
    return out, starts


def gram_buckets(
    out: np.ndarray, starts: np.ndarray, orders: tuple[int, ...], bits: int
) -> Iterator[tuple[int, np.ndarray]]:
    """``n`` and the bucket at every place for each of ``orders``, which ascend up to 7.

    Runs that leave their text are among them; ``leaving`` names their places.
    """
    end = int(starts[-1])
    wide = orders[-1] > 3
    kind = np.uint64 if wide else np.uint32
    factor = kind(MULTIPLIER) if wide else kind(MULTIPLIER >> 32 | 1)
    shift = kind((64 if wide else 32) - bits)
    code = out.astype(kind)
    for n in range(1, orders[-1] + 1):
        if n > 1:
            code = code[:-1] << kind(8)
            code |= out[n - 1 :]
        if n in orders:
            tagged = code[:end] + kind(n << 8 * min(n, 7 if wide else 3))
            tagged *= factor
            tagged >>= shift
            yield n, tagged


def leaving(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Places from which a run of ``n`` bytes reaches into the text after the next blank."""
    if n < 3:
        return np.zeros(0, np.int64)
    at = (starts[1:, None] - np.arange(1, n - 1)[None, :]).ravel()
    return np.unique(at[(at >= 0) & (at < size)])
