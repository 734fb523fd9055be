"""Re-Pair grammars over arrays of ids.

Each round counts all neighbouring pairs, gives the most frequent ones a
nonterminal each and replaces their occurrences that do not overlap, from the
left.  Rounds go on until a round would no longer pay.  Rules of a round refer
to terminals and earlier rounds only, so rules expand round by round.

A packed grammar is little-endian uint32: magic, base (the first nonterminal),
rounds, rules, symbols, ids; rules of each round; left sides, right sides and
expansion lengths of the rules; the symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .spans import _STEP, HashTable

MAGIC = 0x52505231


@dataclass
class Grammar:
    base: int
    per_round: np.ndarray
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    n_ids: int


def compress(ids: np.ndarray, base: int, rounds: int = 12, per_round: int = 4096, least: int = 12, gain: float = 0.02) -> Grammar:
    """The grammar of an array of ids below `base`.

    A pair gets a rule if it occurs `least` times or more and is among the
    `per_round` most frequent; rounds end when one removes less than the share
    `gain` of the symbols, or after `rounds`.
    """
    seq = ids.astype(np.uint32)
    lefts, rights, lengths, counts = [], [], [], []
    length = np.zeros(0, np.uint32)
    nonterminal = base
    for _ in range(rounds):
        if len(seq) < 2 * least:
            break
        keys = ((seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]) + np.uint64(1)
        order = np.sort(keys)
        edge = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        count = np.diff(np.append(edge, len(order)))
        often = np.flatnonzero(count >= least)
        if len(often) > per_round:
            often = often[np.argpartition(count[often], -per_round)[-per_round:]]
            often.sort()
        if not len(often) or count[often].sum() < gain * len(seq):
            break
        pairs = order[edge[often]]
        # An odd factor maps different keys to different numbers, so a hit in the table is exact.
        table = HashTable(max(10, len(pairs).bit_length() + 2))
        table.add(pairs * _STEP, np.arange(len(pairs)))
        at = table.find(keys * _STEP)
        pairs = pairs - np.uint64(1)
        # In a run of hits that follow one another, take every second from the first.
        where = np.flatnonzero(at >= 0)
        new_run = np.concatenate(([True], np.diff(where) != 1))
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - start) % 2 == 0]
        seq[where] = (nonterminal + at[where]).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        before, seq = len(seq), seq[keep]
        left, right = (pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        all_lengths = np.concatenate([np.ones(base, np.uint32), length])
        length = np.concatenate([length, all_lengths[left] + all_lengths[right]])
        lefts.append(left)
        rights.append(right)
        counts.append(len(pairs))
        nonterminal += len(pairs)
        if before - len(seq) < gain * before:
            break
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return Grammar(base, np.array(counts, np.uint32), cat(lefts), cat(rights), length, seq, len(ids))


def pack(g: Grammar) -> bytes:
    head = np.array([MAGIC, g.base, len(g.per_round), len(g.left), len(g.symbols), g.n_ids], np.uint32)
    return b"".join(np.asarray(x).astype("<u4").tobytes() for x in (head, g.per_round, g.left, g.right, g.lengths, g.symbols))


def unpack(raw: bytes) -> Grammar:
    x = np.frombuffer(raw, "<u4")
    if len(x) < 6 or x[0] != MAGIC:
        raise ValueError("not a packed grammar")
    base, rounds, rules, symbols, n = (int(v) for v in x[1:6])
    parts = np.split(x[6:], np.cumsum([rounds, rules, rules, rules]))
    if len(parts[4]) != symbols:
        raise ValueError("a packed grammar is cut off")
    return Grammar(base, *parts[:4], parts[4], n)


def gather(start: np.ndarray, count: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[s : s + c] for each s and c, one after the other."""
    count = count.astype(np.int64)
    total = np.cumsum(count)
    n = int(total[-1]) if len(total) else 0
    return flat[np.repeat(start - total + count, count) + np.arange(n)]


class Decoder:
    """Expands a grammar, whole or from any place on."""

    def __init__(self, g: Grammar):
        self.g = g
        self.count = np.concatenate([np.ones(g.base, np.int64), g.lengths.astype(np.int64)])
        self.start = np.cumsum(self.count) - self.count
        self.flat = np.empty(int(self.count.sum()), np.uint32)
        self.flat[: g.base] = np.arange(g.base, dtype=np.uint32)
        first = 0
        for n in g.per_round.astype(np.int64).tolist():
            both = np.empty(2 * n, np.int64)
            both[0::2], both[1::2] = g.left[first : first + n], g.right[first : first + n]
            ids = gather(self.start[both], self.count[both], self.flat)
            at = self.start[g.base + first] if n else 0
            self.flat[at : at + len(ids)] = ids
            first += n
        self.ends = np.cumsum(self.count[g.symbols])

    def all(self) -> np.ndarray:
        return gather(self.start[self.g.symbols], self.count[self.g.symbols], self.flat)

    def slice(self, first: int, n: int) -> np.ndarray:
        """n ids from place `first` on; only the symbols that cover them are expanded."""
        n = max(0, min(n, self.g.n_ids - first))
        if n == 0:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, [first, first + n - 1], "right")
        part = self.g.symbols[a : b + 1]
        skip = first - (int(self.ends[a - 1]) if a else 0)
        return gather(self.start[part], self.count[part], self.flat)[skip : skip + n]
