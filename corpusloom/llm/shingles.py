"""Words and five-word shingles as 64-bit numbers, whole texts at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd

SHINGLE = 5
# Odd multipliers for the words of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit numbers; a permutation for each salt."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def positions(text: str | None) -> np.ndarray:
    """A number for the shingle that starts at each word; with fewer than five words one for them all, without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    k = min(SHINGLE, len(words))
    m = len(words) - k + 1
    s = np.full(m, k, np.uint64)
    for i in range(k):
        s += h[i : i + m] * PLACES[i]
    return mixed(s)


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct shingles, ascending."""
    return np.unique(positions(text))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two ascending arrays without repeats."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())
