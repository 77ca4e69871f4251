"""Hashed words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from basketlens.llm.common import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space separated words (A-Z lower-cased) in order, and the words of each text."""
    raws = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    hashes, counts = [], np.zeros(len(texts), np.int64)
    first, size = 0, 0
    # a few texts at a time, so that the working arrays stay small
    for i, raw in enumerate(raws):
        size += len(raw) + 1
        if size >= 1 << 17 or i == len(raws) - 1:
            part, counts[first: i + 1] = _hashed(raws[first: i + 1])
            hashes.append(part)
            first, size = i + 1, 0
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def _hashed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    white = _WHITE[data]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    terms = (data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    words = mix64((sums[end] - sums[start]) * powers(_INVERSE, len(data))[start])
    breaks = np.cumsum([len(r) + 1 for r in raws])
    return words, np.diff(np.searchsorted(start, breaks, "right"), prepend=0)


def shingled(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, times in the text) of the distinct shingles of every text, ordered by text and hash.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    words, counts = hashed_words(texts)
    seeds = mix64(np.arange(1, width + 1, dtype=np.uint64), 7) | np.uint64(1)
    n = len(words)
    text = np.repeat(np.arange(len(texts)), counts)
    owners, hashes = [], []
    if n >= width:
        sums = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            sums += words[k: n - width + 1 + k] * seeds[k]
        same = text[: n - width + 1] == text[width - 1:]
        owners.append(text[: n - width + 1][same])
        hashes.append(mix64(sums[same], 3))
    first = np.cumsum(counts) - counts
    for t in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[t]: first[t] + counts[t]]
        owners.append(np.array([t]))
        hashes.append(mix64(np.array([(own * seeds[: len(own)]).sum(dtype=np.uint64)]), 3))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner, shingle = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])])
    at = np.flatnonzero(new)
    return owner[at], shingle[at], np.diff(np.append(at, len(owner)))
