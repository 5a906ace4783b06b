"""Texts as arrays of folded code points, and hashes of their character n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(2)
def fold_table(digits: bool) -> np.ndarray:
    """For each code point its lower-case letter, or digit if asked for; 32 for everything else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum() if digits else ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def normalise(text: str | None, digits: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single blanks between words, and the position in the text of each."""
    codes = fold_table(digits)[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = codes == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q code points in a row, put together from those of the halves."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    base, mask = 0x100000001B3, (1 << 64) - 1
    power, width, done, out = codes.astype(np.uint64), 1, 0, None
    while True:
        if q & width:
            if out is None:
                out = power
            else:
                out = power[: len(codes) - done - width + 1] * np.uint64(pow(base, done, 1 << 64) & mask) + out[width:][: len(codes) - done - width + 1]
            done += width
        if done == q:
            return out * np.uint64(0x9E3779B97F4A7C15)
        power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2


