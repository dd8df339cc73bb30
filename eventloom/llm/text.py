"""Words and hashed word shingles, as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_S = np.uint64(32)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; bytes.split() and bytes.lower() know ASCII only, as meant here."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(w: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, w)), ">u8").astype(np.uint64)


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """64-bit hashes of all k-word windows in order; the whole sequence as one where it has fewer than k words."""
    h = word_hashes(words(text))
    if len(h) == 0:
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MIX[i % 4]
        out ^= out >> _S
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, k))
