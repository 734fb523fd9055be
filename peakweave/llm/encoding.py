"""Batch encoding with a public tokenizer file, exact and cached by chunk.

A text is cut only where its tokenizer must cut too: before white space that
follows something else, and between an ASCII letter and an ASCII character that
is no letter.  No token of the supported tokenizers spans such a place, so the
ids of a text are the ids of its chunks, one after the other.  Chunks repeat,
so each worker keeps a bounded table from chunk to ids; only chunks that it
lacks go to the library, many in one call, in calls of about equal size.  A
chunk is found by a hash, and its bytes are compared with those in the table.
Long texts come in parts that end where a chunk ends.

Texts in which a cut could change the result (white space beyond ASCII, strings
of special tokens, chunks whose hash is that of another) go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

from . import spans

#: Characters of the chunks that go to the library in one call.
CALL_CHARS = 200_000
#: Bytes of the chunks that a table keeps.
TABLE_BYTES = 1 << 25


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes columns of texts to ids.

    spaced: white space makes tokens (byte-level models); else words alone do.
    bits: the table keeps up to 2 ** (bits - 1) chunks and is emptied when full.
    """

    def __init__(self, path: str, spaced: bool, bits: int = 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.bits = spaced, bits
        self._empty()

    def _empty(self) -> None:
        self.table = spans.SpanTable(self.bits)
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 14, np.uint32), 0

    def _library(self, parts: Sequence[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each part has; a part counts as one given word, so parts never join.  sizes: their bytes."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        call = np.cumsum(sizes + 8) // CALL_CHARS
        edge = [0, *(np.flatnonzero(np.diff(call)) + 1).tolist(), len(parts)]
        for first, last in zip(edge[:-1], edge[1:]):
            enc = self.tokenizer.encode(parts[first:last], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(enc.ids, np.uint32))
            counts.append(np.bincount(np.array(enc.word_ids, np.int64), minlength=last - first))
        return np.concatenate(ids), np.concatenate(counts)

    def _add(self, pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        raw = pad.tobytes()
        ids, counts = self._library([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())], ends - starts)
        n, m = self.table.n, self.table.n + len(h)
        while len(self.start) < m:
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        while len(self.ids) < self.n_ids + len(ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.start[n:m] = self.n_ids + np.cumsum(counts) - counts
        self.count[n:m] = counts
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        self.table.add(pad, starts, ends, h)

    def _rows(self, pad: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each chunk in the table, into which those that lack are put; -2 for a chunk whose hash is that of another."""
        h = spans.span_hashes(pad, starts, ends)
        row = self.table.find(pad, starts, ends, h)
        lacking = np.flatnonzero(row == -1)
        if not len(lacking):
            return row
        new, at = np.unique(h[lacking], return_index=True)
        if self.table.n + len(new) > self.table.table.limit or self.table.n_bytes > TABLE_BYTES:
            self._empty()
            lacking = np.arange(len(h))
            new, at = np.unique(h, return_index=True)
        while self.table.table.limit < len(new):  # a block with more chunks than the table holds
            self.bits += 1
            self._empty()
        at = lacking[at]
        self._add(pad, starts[at], ends[at], new)
        row[lacking] = self.table.find(pad, starts[lacking], ends[lacking], h[lacking])
        return row

    def _block(self, data: np.ndarray, offsets: np.ndarray, lengths_only: bool) -> tuple[np.ndarray | None, np.ndarray]:
        starts, ends, first = spans.chunks(data, offsets) if self.spaced else spans.words(data, offsets, inner=True)
        odd = spans.unusual(data, offsets)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        pad = spans.padded(data)
        if odd.any():
            keep = ~odd[text_of]
            starts, ends, text_of = starts[keep], ends[keep], text_of[keep]
        row = self._rows(pad, starts, ends)
        if len(row) and row.min() < 0:
            odd[text_of[row < 0]] = True
            keep = ~odd[text_of]
            row, text_of = row[keep], text_of[keep]
        counts = self.count[row]
        per_text = np.bincount(text_of, counts, len(offsets) - 1).astype(np.int64)
        ids = None
        if not lengths_only:
            total = np.cumsum(counts)
            ids = self.ids[np.repeat(self.start[row] - total + counts, counts) + np.arange(total[-1] if len(total) else 0)]
        if odd.any():
            raw = data.tobytes()
            texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in np.flatnonzero(odd)]
            whole = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
            if ids is not None:
                pieces = np.split(ids, np.cumsum(per_text)[:-1])
                for i, x in zip(np.flatnonzero(odd), whole):
                    pieces[i] = x
                ids = np.concatenate(pieces)
            per_text[odd] = [len(x) for x in whole]
        return ids, per_text

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, their ids, number of ids of each row), block by block; a long text's ids come together."""
        held: list[np.ndarray] = []
        for a, b, data, offsets, _, last in spans.text_parts(column):
            ids, counts = self._block(data, offsets, False)
            if held or not last:
                held.append(ids)
                if not last:
                    continue
                ids = np.concatenate(held)
                counts, held = np.array([len(ids)]), []
            yield a, b, ids, counts

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each row."""
        out = np.zeros(len(column), np.int64)
        for a, b, data, offsets, _, _ in spans.text_parts(column):
            out[a:b] += self._block(data, offsets, True)[1]
        return out


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, spaced: bool) -> ChunkEncoder:
    """One encoder for each file and worker process."""
    key = (path, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, spaced)
    return _ENCODERS[key]
