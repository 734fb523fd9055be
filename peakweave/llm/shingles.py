"""Word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .spans import mix, padded, span_hashes, text_parts, words

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Shingles worked on together.
STEP_SIZE = 1 << 20


class Shingled(NamedTuple):
    """A block of texts: its first and end row, hashes of all shingles, more bits of the same, the first shingle of each text (one more than texts), word hashes, and the first word of each shingle."""

    first: int
    end: int
    hashes: np.ndarray
    more: np.ndarray
    begin: np.ndarray
    words: np.ndarray
    at: np.ndarray


def _chain(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """One hash for the k words from each place on."""
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(at), STEP_SIZE):
        place = at[a : a + STEP_SIZE]
        x = h[place]
        for j in range(1, k):
            x = mix(x * _STEP) + h[place + j]
        out[a : a + STEP_SIZE] = mix(x)
    return out


def _of_words(h: np.ndarray, more: np.ndarray | None, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, more bits of them, the first of each text, and the first word of each."""
    n_words = np.diff(first)
    n_shingles = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate(([0], np.cumsum(n_shingles)))
    at = np.repeat(first[:-1] - begin[:-1], n_shingles) + np.arange(begin[-1])
    out = []
    for x in (h, more):
        if x is None:
            out.append(mix(out[0] + _STEP))
            continue
        s = _chain(np.concatenate([x, np.zeros(k, np.uint64)]), at, k)
        for i in np.flatnonzero((n_words < k) & (n_words > 0)):
            y = n_words[i : i + 1].astype(np.uint64)
            for v in x[first[i] : first[i + 1]]:
                y = mix(y * _STEP) + v
            s[begin[i]] = mix(y)[0]
        out.append(s)
    return out[0], out[1], begin, at


def shingled(column: pa.Array, k: int, seed: int = 0) -> Iterator[Shingled]:
    """All k-word shingles (A-Z as a-z) of the texts, block by block; a long text comes whole, and has no more bits than 64 a shingle.

    A text of fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    held: list[np.ndarray] = []
    for a, b, data, offsets, _, last in text_parts(column):
        starts, ends, first = words(data, offsets)
        pad = padded(data, True)
        if held or not last:
            held.append(span_hashes(pad, starts, ends, seed))
            if not last:
                continue
            h, more, first = np.concatenate(held), None, np.array([0, sum(map(len, held))])
            held = []
        else:
            h, more = span_hashes(pad, starts, ends, seed, wide=True)
        s, more, begin, at = _of_words(h, more, first, k)
        yield Shingled(a, b, s, more, begin, h, at)
