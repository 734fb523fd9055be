"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are lower-cased and runs of white space become one blank.  An
item of m characters may be found with up to k = m * error_percent div 100
edits (insertions, deletions, substitutions).  It is split into k + 1 pieces:
if it occurs with k edits or fewer, one piece occurs unchanged.  An automaton
over all pieces scans each text once; every hit says where the item would
begin, and the window around is verified with Myers' bit-parallel edit
distance.

An item shorter than `least_chars` is found without edits only, and only where
it does not begin or end within a word.

Items come in blocks of bounded size (BLOCK_CHARS), each with one automaton
sent to all tasks, so a benchmark of any size is matched whole.

Defined results: null texts, null items and items without a character match
nothing; repeated rows and repeated items are each reported for themselves; empty
tables give no row.  Ids of rows and of items may be of any type.  Other columns
are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import free_name, given_back, texts, with_columns

BLOCK_CHARS = 8_000_000
ERROR_PERCENT, LEAST_CHARS = 6, 40
#: Characters of a text that are normalised together.
SLICE_CHARS = 1 << 20
_BLANK = re.compile(r"\s")


def normalised(text: str) -> str:
    out, first = [], 0
    while first < len(text):
        cut = _BLANK.search(text, first + SLICE_CHARS) if len(text) - first > SLICE_CHARS else None
        last = cut.start() if cut else len(text)
        out.append(" ".join(text[first:last].lower().split()))
        first = last
    return " ".join(x for x in out if x)


def myers_best(pattern_masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance of a pattern of m characters to any substring of the text, and where the first such substring ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    get = pattern_masks.get
    for i, c in enumerate(text):
        x = get(c, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hp, hn = (vn | ~(d0 | vp)) & full, vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        vp, vn = (hn | ~(d0 | hp)) & full, hp & d0
        if score < best:
            best, end = score, i + 1
    return best, end


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The budget + 1 pieces of an item, of about equal length, with their places."""
    n, m = budget + 1, len(item)
    cut = [i * m // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:])]


class ItemMatcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[object, str]], error_percent: int, least_chars: int = 0):
        import ahocorasick

        self.items = items
        self.short = [len(t) < least_chars for _, t in items]
        self.budget = [0 if short else len(t) * error_percent // 100 for short, (_, t) in zip(self.short, items)]
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for at, piece in pieces(t, self.budget[i]):
                found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def _verify(self, i: int, text: str, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the best match that begins between lo and hi, if the budget allows it."""
        _, item = self.items[i]
        m, k = len(item), self.budget[i]
        if self.short[i]:
            for at in range(lo, hi + 1):
                inner = (at > 0 and text[at - 1].isalnum() and item[0].isalnum()) or (at + m < len(text) and text[at + m].isalnum() and item[-1].isalnum())
                if not inner and text.startswith(item, at):
                    return 0, at, at + m
            return None
        if i not in self.masks:
            self.masks[i] = masks(item), masks(item[::-1])
        exact = text.find(item, max(0, lo - k), hi + k + m)
        if exact >= 0:
            return 0, exact, exact + m
        first, last = max(0, lo - k), min(len(text), hi + m + 2 * k)
        window = text[first:last]
        distance, end = myers_best(self.masks[i][0], m, window)
        if distance > k:
            return None
        # The longest prefix before `end` that the reversed item matches best gives the start.
        _, back = myers_best(self.masks[i][1], m, window[:end][::-1][: m + k])
        return distance, first + end - back, first + end

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end): the best match of each item that occurs in a normalised text."""
        begins: dict[int, list[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for i, at in where:
                begins.setdefault(i, []).append(last + 1 - size - at)
        out = []
        for i, starts in sorted(begins.items()):
            starts.sort()
            k, best, a = self.budget[i], None, 0
            for b in range(1, len(starts) + 1):
                # Hits whose windows overlap are verified together.
                if b == len(starts) or starts[b] - starts[b - 1] > 2 * k + 1:
                    got = self._verify(i, text, starts[a], starts[b - 1])
                    if got is not None and (best is None or got < best):
                        best = got
                    a = b
            if best is not None:
                out.append((i, *best))
        return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Normalised items, in blocks of about BLOCK_CHARS characters."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = int(total) // BLOCK_CHARS + 1
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        block = sorted(((r["item_id"], normalised(r["text"])) for r in part), key=lambda x: (x[0] is None, str(x[0]), x[1]))
        block = [x for x in block if x[1]]
        if block:
            yield block


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, error_percent: int = ERROR_PERCENT, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance, match_start and match_end (in the normalised text) for every row and item that occurs in it."""
    rows = texts(docs, id_col, text_col)
    items = benchmark.select(F.col(item_id_col).alias("item_id"))
    schema = T.StructType([rows.schema["doc_id"], items.schema["item_id"], T.StructField("distance", T.IntegerType()), T.StructField("match_start", T.IntegerType()), T.StructField("match_end", T.IntegerType())])
    item_type, out = to_arrow_type(items.schema["item_id"].dataType), None
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, shared, error_percent, least_chars)
            for batch in batches:
                found, which = [], []
                for row, text in enumerate(batch.column(1)):
                    t = text.as_py()
                    if t:
                        hits = matcher.find(normalised(t))
                        found += hits
                        which += [row] * len(hits)
                columns = [batch.column(0).take(pa.array(which, pa.int64())), pa.array([matcher.items[f[0]][0] for f in found], item_type)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([f[j] for f in found], pa.int32()) for j in (1, 2, 3)], schema.names)

        part = rows.mapInArrow(given_back(match), schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame, error_percent: int = ERROR_PERCENT, least_chars: int = LEAST_CHARS, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no item occurs."""
    out = docs
    for block in item_blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        flag = free_name(out, "contaminated")

        def judge(column: pa.Array, shared=shared, name=uuid.uuid4().hex) -> list[pa.Array]:
            matcher = _matcher(name, shared, error_percent, least_chars)
            return [pa.array([bool(t.as_py()) and bool(matcher.find(normalised(t.as_py()))) for t in column], pa.bool_())]

        out = with_columns(out, text_col, [T.StructField(flag, T.BooleanType())], judge).where(~F.col(flag)).drop(flag)
    return out


#: The matchers that a worker made last, by the name of their block: a worker outlives the query that it works for.
_MATCHERS: dict[str, ItemMatcher] = {}


def _matcher(name: str, shared, error_percent: int, least_chars: int) -> ItemMatcher:
    if name not in _MATCHERS:
        while len(_MATCHERS) > 1:
            del _MATCHERS[next(iter(_MATCHERS))]
        _MATCHERS[name] = ItemMatcher(shared.value, error_percent, least_chars)
    return _MATCHERS[name]
