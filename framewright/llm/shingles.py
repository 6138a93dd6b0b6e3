"""Hashed words and word shingles of whole texts, for code that runs in tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

# A-Z to lower case; the rest as it is.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}
# Bytes of texts hashed at once; a longer text is hashed alone. A hash takes some fifty bytes for each.
SLICE_BYTES = 1 << 17


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, SLICE_BYTES * 2), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slices(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Texts as lower-cased bytes, in runs of about SLICE_BYTES."""
    held, some = 0, []
    for text in texts:
        some.append((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
        held += len(some[-1])
        if held >= SLICE_BYTES:
            yield some
            held, some = 0, []
    if some:
        yield some


def word_hashes(some: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in order."""
    buffer = b" ".join(some) + b" "
    a = np.frombuffer(buffer, dtype=np.uint8)
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(_LETTER[a] * powers(_BASE, len(a)), out=sums[1:])
    blank = _BLANK[a]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    hashes = mix((sums[end] - sums[start]) * powers(_INVERSE, len(a))[start])
    text_end = np.cumsum([len(t) + 1 for t in some])
    return np.split(hashes, np.searchsorted(start, text_end[:-1]))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of fewer words, of the whole run."""
    n = len(words)
    if n == 0:
        return words
    width = min(n, k)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : n - width + 1 + j])
    return np.unique(out)
