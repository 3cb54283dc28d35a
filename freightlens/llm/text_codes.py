"""Texts as arrays of code points, normalised with table look-ups instead of per-character Python."""

from __future__ import annotations

import numpy as np

#: Code points above this are taken as letters without case.
TABLE_END = 0x30000
SPACE = 32


def letter_tables(keep: str = "isalnum") -> tuple[np.ndarray, np.ndarray]:
    """Two tables over code points: is the character kept, and its one-character lower case."""
    chars = [chr(c) for c in range(TABLE_END)]
    kept = np.fromiter((getattr(c, keep)() for c in chars), bool, TABLE_END)
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars), np.uint32, TABLE_END)
    return kept, lower


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalise(text: str, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased kept characters with each run of others as one space, trimmed; and where each stood in the text."""
    codes = code_points(text)
    kept, lower = tables
    low = np.minimum(codes, TABLE_END - 1)
    is_kept = kept[low] | (codes >= TABLE_END)
    first_other = np.empty(len(codes), bool)
    first_other[:1] = False
    first_other[1:] = ~is_kept[1:] & is_kept[:-1]
    places = np.flatnonzero(is_kept | first_other)
    if len(places) and not is_kept[places[-1]]:
        places = places[:-1]
    out = np.where(codes[places] < TABLE_END, lower[low[places]], codes[places])
    return np.where(is_kept[places], out, SPACE).astype(np.uint32), places


def rolling_hash(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every run of q codes."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[:n].copy()
    for j in range(1, q):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += wide[j : j + n]
    return out
