"""Subword lattices: the probability of a word over all its segmentations.

Pieces and their scores come from an existing vocabulary file.  Words of equal
length are worked on together: arcs are found by hashing all substrings, then
the forward recursion runs in log space over their ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from .spans import _MASK, _STEP, HashTable, _eights, mix, padded, span_hashes

#: Stands for the word mark of the vocabulary, so that a word has one byte more than its text.
MARK = b"\x01"
#: Words, and bytes of words, worked on together.
GROUP, GROUP_BYTES = 4096, 1 << 17
#: Longer words, in bytes, are worked on alone, in slices of so many bytes.
LONG_WORD, SLICE = 512, 1 << 14
#: Numbers below the reciprocal of this are scaled up by it.
SCALE = 1e120


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces of a sentencepiece model as bytes, and their first log probabilities.

    Scores of the file that are merge ranks (0, -1, -2, ...) rank the pieces
    but are no log probabilities; they are read as such ranks and weighted by
    1 / (rank + 10).  Byte pieces stand after all others.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    worst = 0.0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        piece, score = model.id_to_piece(i), model.get_score(i)
        if score < -1e8 or piece.count("▁") > 1 or "▁" in piece[1:]:
            continue
        found[piece.replace("▁", "\x01").encode()] = -score
        worst = max(worst, -score)
    for b in range(256):
        found.setdefault(bytes([b]), worst + b)
    weight = 1.0 / (np.array(list(found.values())) + 10.0)
    return list(found), np.log(weight / weight.sum())


class Lattice:
    def __init__(self, pieces: Sequence[bytes], log_p: np.ndarray):
        self.log_p = np.append(log_p, -np.inf)
        self.p, self.log_step = np.exp(log_p).tolist(), math.log(SCALE)
        self.longest = max(map(len, pieces))
        self.sizes = sorted({len(p) for p in pieces})
        self.table = HashTable(max(10, 2 + len(pieces).bit_length()))
        ends = np.cumsum([len(p) for p in pieces])
        self.table.add(span_hashes(padded(np.frombuffer(b"".join(pieces), np.uint8)), ends - [len(p) for p in pieces], ends), np.arange(len(pieces)))

    def _arcs(self, rows: np.ndarray) -> dict[int, np.ndarray]:
        """By piece size: the piece that begins at each place of each word (one number after the last: none)."""
        m, n = rows.shape
        eights, out = _eights(padded(rows.ravel()))[: m * n].reshape(m, n).copy(), {}
        for size in self.sizes:
            if size <= n:
                # The same hash as span_hashes gives, without a gather for each place.
                h = np.full((m, n - size + 1), mix(np.array([size], np.uint64) * _STEP)[0])
                for j in range(0, size, 8):
                    h = mix(h ^ (eights[:, j : j + n - size + 1] & _MASK[min(8, size - j)]))
                h[h == 0] = 1
                out[size] = self.table.find(h.ravel()).reshape(m, -1)
        return out

    def _forward(self, arcs: dict[int, np.ndarray], m: int, n: int) -> np.ndarray:
        alpha = np.full((m, n + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, n + 1):
            alpha[:, end] = _log_sum([alpha[:, end - s] + self.log_p[a[:, end - s]] for s, a in arcs.items() if s <= end])
        return alpha

    def _groups(self, words: Sequence[bytes]):
        """Words of equal length up to LONG_WORD, a group at a time: their numbers, and their bytes with the mark."""
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= LONG_WORD]
        edge = np.flatnonzero(np.diff(size[order])) + 1
        for same in np.split(order, edge):
            step = max(1, min(GROUP, GROUP_BYTES // (int(size[same[0]]) + 1))) if len(same) else 1
            for a in range(0, len(same), step):
                at = same[a : a + step]
                rows = np.frombuffer(b"".join([MARK + words[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1)
                yield at, rows

    def _slice_arcs(self, row: np.ndarray, lo: int) -> tuple[list[int], list[int], list[int]]:
        """The arcs that begin in a slice of a word: for each place, from which arc on its own are, and sizes and pieces of all."""
        n = min(SLICE, len(row) - lo)
        found = self._arcs(row[None, lo : lo + n + self.longest - 1])
        at = [np.flatnonzero(a[0, :n] >= 0) for a in found.values()]
        place = np.concatenate(at)
        size = np.concatenate([np.full(len(x), s) for x, s in zip(at, found)])
        piece = np.concatenate([a[0, x] for x, a in zip(at, found.values())])
        order = np.argsort(place, kind="stable")
        return np.searchsorted(place[order], np.arange(n + 1)).tolist(), size[order].tolist(), piece[order].tolist()

    def _forward_slice(self, arcs: tuple, window: list[float], log_scale: float) -> tuple[list[float], list[float], list[float], float]:
        """Forward sums of the places of a slice with the log of what each was scaled by, and the window and scale that the next slice begins with."""
        first, size, piece = arcs
        n, p = len(first) - 1, self.p
        a = window + [0.0] * n
        scales = [0.0] * n
        for t in range(n):
            if 0.0 < a[t] < 1 / SCALE:
                for i in range(t, t + len(window)):
                    a[i] *= SCALE
                log_scale -= self.log_step
            scales[t] = log_scale
            x = a[t]
            if x:
                for k in range(first[t], first[t + 1]):
                    a[t + size[k]] += x * p[piece[k]]
        return a[:n], scales, a[n:], log_scale

    def _long(self, word: bytes, weight: float = 0.0, out: np.ndarray | None = None) -> float:
        """The log marginal of a long word; out: gets its expected counts times the weight."""
        row = np.frombuffer(MARK + word, np.uint8)
        window, log_scale, begins = [1.0] + [0.0] * self.longest, 0.0, []
        for lo in range(0, len(row), SLICE):
            begins.append((window, log_scale))
            *_, window, log_scale = self._forward_slice(self._slice_arcs(row, lo), window, log_scale)
        whole = math.log(window[0]) + log_scale if window[0] > 0 else -math.inf
        if out is None or whole == -math.inf:
            return whole
        beta, log_beta, p = [1.0] + [0.0] * self.longest, 0.0, self.p
        for i in range(len(begins) - 1, -1, -1):
            arcs = self._slice_arcs(row, i * SLICE)
            first, size, piece = arcs
            alpha, scales, _, _ = self._forward_slice(arcs, *begins[i])
            for t in range(len(alpha) - 1, -1, -1):
                # beta[s - 1] belongs to the place s further on.
                unit, total = weight * math.exp(scales[t] + log_beta - whole), 0.0
                for k in range(first[t], first[t + 1]):
                    x = p[piece[k]] * beta[size[k] - 1]
                    total += x
                    out[piece[k]] += alpha[t] * x * unit
                beta.insert(0, total)
                beta.pop()
                if 0.0 < total < 1 / SCALE:
                    beta = [x * SCALE for x in beta]
                    log_beta -= self.log_step
        return whole

    def log_marginals(self, words: Sequence[bytes]) -> np.ndarray:
        """The natural log of the sum over all segmentations of each word."""
        out = np.zeros(len(words))
        for at, rows in self._groups(words) if len(words) else ():
            out[at] = self._forward(self._arcs(rows), *rows.shape)[:, -1]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._long(w)
        return out

    def expected_counts(self, words: Sequence[bytes], weights: np.ndarray) -> np.ndarray:
        """How often each piece is expected in words that occur `weights` times (forward-backward)."""
        out = np.zeros(len(self.log_p) - 1)
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                self._long(w, float(weights[i]), out)
        for at, rows in self._groups(words) if len(words) else ():
            m, n = rows.shape
            arcs = self._arcs(rows)
            alpha = self._forward(arcs, m, n)
            beta = np.full((m, n + 1), -np.inf)
            beta[:, n] = 0
            for start in range(n - 1, -1, -1):
                beta[:, start] = _log_sum([beta[:, start + s] + self.log_p[a[:, start]] for s, a in arcs.items() if start + s <= n])
            for s, a in arcs.items():
                hit = a >= 0
                lp = alpha[:, : n - s + 1] + self.log_p[a] + beta[:, s:] - alpha[:, -1:]
                w = np.broadcast_to(weights[at][:, None], a.shape)
                out += np.bincount(a[hit], np.exp(lp[hit]) * w[hit], len(out))
        return out


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=0)) + safe
