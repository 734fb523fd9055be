"""Vectorised work on the bytes of many texts at once: words, chunks, hashes.

Arrow string arrays are read where they lie.  Words are found with a table of
byte classes and hashed eight bytes at a time, so no Python object is made for a
word.  Where a hash stands for a span, its bytes are compared as well
(`SpanTable`).  Functions take and give numpy arrays; blocks hold about `BLOCK`
bytes, and a longer text comes in parts, so memory does not follow the size of a
partition or of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_OTHER = np.zeros(256, bool)
_OTHER[:128] = ~_LETTER[:128]
#: 1: white space, 2: an ASCII letter, 3: another ASCII character, 0: the rest; and between which a chunk ends.
_KIND = (_WHITE + 2 * _LETTER + 3 * (_OTHER & ~_WHITE)).astype(np.uint8)
_CUTS = np.zeros(16, bool)
_CUTS[[0 * 4 + 1, 2 * 4 + 1, 3 * 4 + 1, 2 * 4 + 3]] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_STEP, _STEP2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The low bytes of 8: _MASK[n] keeps n of them.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans of more bytes are hashed and compared one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for blocks of about `size` bytes.

    A null is an empty text.  A text longer than `size` is a block of its own.
    """
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(part) == 0:
            continue
        if not pa.types.is_large_string(part.type):
            part = part.cast(pa.large_string())
        if part.null_count:
            part = part.fill_null("")
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(part):
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), len(part))
            lo, hi = int(offsets[first]), int(offsets[last])
            yield row + first, row + last, data[lo:hi], offsets[first : last + 1] - lo
            first = last
        row += len(part)


def _cut_places(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places in (lo, hi) before ASCII white space that follows an ASCII letter or digit, with no "<" in the bytes before: words, chunks and tokens all end there."""
    white, word = _WHITE[data[lo + 1 : hi]], _ALNUM[data[lo : hi - 1]]
    at = lo + 1 + np.flatnonzero(white & word)
    opened = lo + np.flatnonzero(data[lo:hi] == 0x3C)
    if len(opened):
        last = np.concatenate(([-64], opened))[np.searchsorted(opened, at)]
        at = at[at - last > 32]
    return at


def text_parts(column: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bool, bool]]:
    """As text_blocks, and whether the block begins its first text and ends its last one: a text of more than two blocks comes in parts.

    Parts begin with white space; a text without a place to cut is one part.
    """
    for first, end, data, offsets in text_blocks(column, size):
        if len(data) <= 2 * size:
            yield first, end, data, offsets, True, True
            continue
        done = 0
        while done < len(data):
            cut, look = len(data), done + size
            while look < len(data):
                at = _cut_places(data, look - 1, min(len(data), look + (1 << 16)))
                if len(at):
                    cut = int(at[0])
                    break
                look += 1 << 16
            if len(data) - cut < size // 4:
                cut = len(data)
            yield first, end, data[done:cut], np.array([0, cut - done]), done == 0, cut == len(data)
            done = cut


def words(data: np.ndarray, offsets: np.ndarray, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and the first word of each text (one more than texts).

    inner: words are also cut between an ASCII letter and an ASCII character that is no letter.
    """
    n = len(data)
    white = _WHITE[data]
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[offsets] = True
    edge = white | first_of_text[:n]
    if inner and n:
        edge[1:] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
    begins = ~white
    begins[1:] &= white[:-1] | edge[1:]
    stops = edge
    stops[1:] &= ~white[:-1]
    stops[:1] = False
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    if len(ends) < len(starts):
        ends = np.append(ends, n)
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the chunks at which any supported tokenizer must cut, and the first chunk of each text.

    Cuts are before white space after something else, and before an ASCII
    character that is no letter after an ASCII letter.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        kind = _KIND.take(data)
        cut[1:n] = _CUTS.take(kind[:-1] * np.uint8(4) + kind[1:])
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n) if len(starts) else starts, np.searchsorted(starts, offsets)


def padded(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """The bytes, A-Z as a-z if `lower`, and eight more, so that eight can be read from any place on."""
    out = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=out[: len(data)]) if lower else np.copyto(out[: len(data)], data)
    return out


def _eights(pad: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ndarray((len(pad) - 7,), "<u8", pad, strides=(1,))


def span_hashes(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, wide: bool = False):
    """64-bit hashes of spans of padded bytes; wide: two arrays, 128 bits in all.  Equal bytes give equal hashes; 0 does not occur.

    Spans of one length up to 8 bytes have different hashes if they differ.
    """
    eights, size = _eights(pad), ends - starts
    out = [mix(size.astype(np.uint64) * step + np.uint64((seed + i) % (1 << 64))) for i, step in enumerate((_STEP, _STEP2)[: 1 + wide])]
    for j in range(0, min(LONG, int(size.max(initial=0))), 8):
        at = slice(None) if j == 0 else np.flatnonzero((size > j) & (size <= LONG))
        part = eights[starts[at] + j] & _MASK[np.minimum(size[at] - j, 8)]
        out[0][at] = mix(out[0][at] ^ part)
        if wide:
            out[1][at] = mix(out[1][at] * _STEP + part)
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(pad[starts[i] : ends[i]].data, digest_size=16, key=seed.to_bytes(8, "little")).digest()
        for x, v in zip(out, np.frombuffer(digest, np.uint64)):
            x[i] = v
    for x in out:
        x[x == 0] = 1
    return tuple(out) if wide else out[0]


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which spans, of the same sizes, hold the same bytes in the padded arrays a and b."""
    x, y, out = _eights(a), _eights(b), np.ones(len(size), bool)
    for j in range(0, min(LONG, int(size.max(initial=0))), 8):
        at = np.arange(len(size)) if j == 0 else np.flatnonzero((size > j) & (size <= LONG))
        out[at] &= (x[a_starts[at] + j] ^ y[b_starts[at] + j]) & _MASK[np.minimum(size[at] - j, 8)] == 0
    for i in np.flatnonzero(size > LONG).tolist():
        n = int(size[i])
        out[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    return out


def unusual(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts (a mask) with white space beyond ASCII, control characters 1C-1F, or "<|": none of our cuts is safe there."""
    out = np.zeros(len(offsets) - 1, bool)
    n = len(data)
    if n < 2:
        return out
    lead = np.zeros(256, bool)
    lead[[0x1C, 0x1D, 0x1E, 0x1F, 0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True
    at = np.flatnonzero(lead[data])
    a = data[at]
    b = data[np.minimum(at + 1, n - 1)]
    c = data[np.minimum(at + 2, n - 1)]
    bad = a < 0x20
    bad |= (a == 0x3C) & (b == 0x7C)
    bad |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    bad |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    bad |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    bad |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    bad |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    out[np.searchsorted(offsets, at[bad], "right") - 1] = True
    return out


class HashTable:
    """Open addressing over numpy arrays: 64-bit keys (not 0) to row numbers, at most half full."""

    def __init__(self, bits: int):
        self.bits, self.limit = bits, 1 << (bits - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.zeros(1 << bits, np.int64)
        self.n = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers of the keys; -1 where a key is not there."""
        slot = self._slots(h)
        key = self.keys[slot]
        out = np.where(key == h, self.rows[slot], -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        mask = (1 << self.bits) - 1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        slot, left, mask = self._slots(h), np.arange(len(h)), (1 << self.bits) - 1
        while len(left):
            s = slot[left]
            free = self.keys[s] == 0
            self.keys[s[free]] = h[left[free]]
            won = self.keys[s] == h[left]
            self.rows[s[won]] = rows[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & mask
        self.n += len(h)


class SpanTable:
    """Distinct spans of bytes, numbered as they come.  Keys are hashes, and a hit counts only where the bytes agree."""

    def __init__(self, bits: int):
        self.table = HashTable(bits)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.bytes, self.n_bytes = np.zeros(1 << 16, np.uint8), 0

    @property
    def n(self) -> int:
        return self.table.n

    def find(self, pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The number of each span of padded bytes with hashes h; -1 where it is not there, -2 where another has its hash."""
        row = self.table.find(h)
        hit = np.flatnonzero(row >= 0)
        at, size = row[hit], (ends - starts)[hit]
        same = self.size[at] == size
        same[same] = same_spans(self.bytes, self.start[at[same]], pad, starts[hit[same]], size[same])
        row[hit[~same]] = -2
        return row

    def add(self, pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        """Adds spans whose hashes are distinct and not there yet, in the order given."""
        n, m, size = self.n, self.n + len(h), ends - starts
        while len(self.start) < m:
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
        total = np.cumsum(size)
        grown = int(total[-1]) if len(total) else 0
        while len(self.bytes) < self.n_bytes + grown + 8:
            self.bytes = np.resize(self.bytes, 2 * len(self.bytes))
        self.start[n:m], self.size[n:m] = self.n_bytes + total - size, size
        self.bytes[self.n_bytes : self.n_bytes + grown] = pad[np.repeat(starts - total + size, size) + np.arange(grown)]
        self.n_bytes += grown
        self.table.add(h, np.arange(n, m))

    def span(self, row: int) -> bytes:
        return self.bytes[self.start[row] : self.start[row] + self.size[row]].tobytes()

    def spans(self) -> list[bytes]:
        """All spans in order."""
        raw = self.bytes[: self.n_bytes].tobytes()
        return [raw[a : a + b] for a, b in zip(self.start[: self.n].tolist(), self.size[: self.n].tolist())]
