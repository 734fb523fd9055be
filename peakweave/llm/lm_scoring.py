"""Language-model scores: subword lattices over an existing vocabulary, and a smoothed word unigram as base.

The corpus is gathered once into counts of words over all training rows.  Expectation
steps over those counts turn the vocabulary's own scores into piece
probabilities; a text's probability is the product over its words of the sum
over all segmentations, times that of the end.

The HOT most frequent words (a fixed number, and HOT_BYTES at most) go to every
task with their counts and probabilities; all other words of a document are joined
with the counts, however many there are.  Words are found by hashes and compared
byte by byte; those that share a hash are counted apart.

Defined results: a null or empty text has the end token alone; a null id counts
as the empty string in the split; repeated rows are scored each for itself and
learned from as often; with no training row all counts are 0.  Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, remainder, summed, texts, written
from .lattice import Lattice, load_pieces
from .spans import LONG, SpanTable, padded, same_spans, span_hashes, text_parts, words

#: Words that every task gets with their counts.
HOT, HOT_BYTES = 1 << 17, 1 << 22
#: Words that a task counts before it hands them on.
HELD, HELD_BYTES = 1 << 17, 1 << 24
#: Expected counts are added up as whole multiples of this, so that no order matters.
UNIT = 2.0**-16
#: Added to the expected count of each piece.
PIECE_PRIOR = 0.1
#: Expectation steps.
ROUNDS = 2
LN10 = math.log(10)


def _agree(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which spans hold the same bytes as the span whose number is given for each."""
    size = ends - starts
    out = size == size[other]
    out[out] = same_spans(pad, starts[out], pad, starts[other[out]], size[out])
    return out


def _count_words(rows: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs, A-Z as a-z."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = SpanTable(19), np.zeros(HELD, np.int64)

        def record(names: list[bytes], n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(n)], ["word", "c"])

        for batch in batches:
            for _, _, data, offsets, _, _ in text_parts(batch.column(0)):
                starts, ends, _ = words(data, offsets)
                if not len(starts):
                    continue
                pad = padded(data, True)
                h = span_hashes(pad, starts, ends)
                new, at, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                # A word stands for all that have its hash; one that differs is handed on by itself.
                odd = np.flatnonzero(~_agree(pad, starts, ends, at[which]))
                n -= np.bincount(which[odd], minlength=len(new))
                row = table.find(pad, starts[at], ends[at], new)
                fresh = np.flatnonzero(row == -1)
                if table.n + len(fresh) > HELD or table.n_bytes > HELD_BYTES:
                    yield record(table.spans(), counts[: table.n])
                    table, counts = SpanTable(19), np.zeros(max(HELD, len(new)), np.int64)
                    if len(new) > table.table.limit:
                        table = SpanTable(len(new).bit_length() + 2)
                    row, fresh = np.full(len(new), -1), np.arange(len(new))
                row[fresh] = table.n + np.arange(len(fresh))
                table.add(pad, starts[at[fresh]], ends[at[fresh]], new[fresh])
                kept = row >= 0
                counts[row[kept]] += n[kept]
                odd = np.concatenate([odd, at[~kept]])
                if len(odd):
                    yield record([pad[a:b].tobytes() for a, b in zip(starts[odd].tolist(), ends[odd].tolist())], np.concatenate([np.ones(len(odd) - int((~kept).sum()), np.int64), n[~kept]]))
        if table.n:
            yield record(table.spans(), counts[: table.n])

    return rows.select("text").mapInArrow(given_back(count), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _expect(vocab: DataFrame, pieces: list[bytes], log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the counted words."""
    n_pieces = len(pieces)

    def expect(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        model, total = Lattice(pieces, log_p), np.zeros(n_pieces, np.int64)
        for batch in batches:
            got = model.expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
            total += np.rint(got / UNIT).astype(np.int64)
        return total

    return summed(vocab.select("word", "c"), expect, n_pieces).astype(float) * UNIT


def _most_frequent(vocab: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The words from some count on, HOT of them and HOT_BYTES at most, and their counts; long words are never among them."""
    level, short = F.floor(F.log2("c") * 8).cast("int"), F.length("word") <= LONG
    n = {r["level"]: r for r in vocab.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("b")).collect()}  # one row for each eighth of a doubling
    total, size, least = 0, 0, None
    for at in sorted(n, reverse=True):
        total, size = total + n[at]["n"], size + n[at]["b"]
        if total > HOT or size > HOT_BYTES:
            break
        least = at
    if least is None:
        return [], np.zeros(0, np.int64)
    hot = vocab.where(short & (level >= least)).select("word", "c").toArrow().sort_by("word")
    return hot["word"].to_pylist(), hot["c"].to_numpy()


def lm_scores(docs: DataFrame, vocabulary: str, folds: int = 10, fold: int = 0, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    vocabulary: path of a sentencepiece model whose pieces are used.  Rows whose
    crc32(id as text) mod `folds` is not `fold` are learned from.  rounds:
    expectation steps that turn the vocabulary's scores into piece probabilities;
    with 0 the scores weight the segmentations as they are.
    """
    rows = texts(docs, id_col, text_col)
    rows = rows.withColumn("held_out", remainder(F.col("doc_id"), folds) == fold)
    training = rows.where(~F.col("held_out"))
    vocab = written(_count_words(training), "words")
    n_texts = training.count()
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + n_texts, v + (n_texts > 0)
    whole = n + 0.1 * (v + 1)

    pieces, log_p = load_pieces(vocabulary)
    end = n_texts + PIECE_PRIOR
    share = end / (n + 2 * PIECE_PRIOR)
    log_p = log_p + math.log1p(-share)
    for _ in range(rounds):
        weight = _expect(vocab, pieces, log_p) + PIECE_PRIOR
        share = end / (weight.sum() + end)
        log_p = np.log(weight / (weight.sum() + end))
    end_score = math.log10(share)

    hot_words, hot_counts = _most_frequent(vocab)
    model = Lattice(pieces, log_p)
    hot_scores = model.log_marginals(hot_words) / LN10
    shared = rows.sparkSession.sparkContext.broadcast((hot_words, hot_counts, hot_scores, pieces, log_p))
    id_type = rows.schema["doc_id"].dataType
    parts = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()), T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, counts, scores, _, _ = shared.value
        table = SpanTable(max(10, len(hot_words).bit_length() + 2))
        sizes = np.array([len(w) for w in hot_words], np.int64)
        hot, ends = padded(np.frombuffer(b"".join(hot_words), np.uint8)), np.cumsum(sizes)
        h = span_hashes(hot, ends - sizes, ends)
        once = np.sort(np.unique(h, return_index=True)[1])  # of two hot words with one hash, one is joined like any other
        table.add(hot, (ends - sizes)[once], ends[once], h[once])
        base_of = np.append(np.log10(counts[once] + 0.1), 0.0)
        score_of, one = np.append(scores[once], 0.0), np.append(np.ones(len(once)), 0.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, data, offsets, begins, last in text_parts(batch.column(1)):
                m = b - a
                starts, ends, first = words(data, offsets)
                pad = padded(data, True)
                h = span_hashes(pad, starts, ends)
                doc = np.repeat(np.arange(m), np.diff(first))
                at = np.maximum(table.find(pad, starts, ends, h), -1)
                # One row for each document (or part of one): what its hot words and its end give; its key is no word, for it has a blank.
                n_words = np.diff(first)
                known = np.bincount(doc, one[at], m).astype(np.int64)
                base = np.bincount(doc, base_of[at], m) - n_words * math.log10(whole)
                lm = np.bincount(doc, score_of[at], m)
                if last:
                    known, base, lm = known + (n_texts > 0), base + math.log10(n_texts + 0.1) - math.log10(whole), lm + end_score
                columns = [np.arange(row, row + m), None, None, [b" " + int(r).to_bytes(8, "big") for r in range(row, row + m)], n_words + last, known, base, lm]
                yield _record(parts, columns, batch.column(0).slice(a, m), batch.column(2).slice(a, m))
                # One row for each other word of each document.
                rare = np.flatnonzero(at < 0)
                if len(rare):
                    order = rare[np.lexsort((h[rare], doc[rare]))]
                    before = np.concatenate((order[:1], order[:-1]))
                    new = (doc[order] != doc[before]) | (h[order] != h[before])
                    new[0] = True
                    size = ends[order] - starts[order]
                    old = np.flatnonzero(~new)
                    new[old] = size[old] != (ends - starts)[before[old]]
                    old = np.flatnonzero(~new)
                    new[old] = ~same_spans(pad, starts[order[old]], pad, starts[before[old]], size[old])
                    edge = np.flatnonzero(new)
                    times, order = np.diff(np.append(edge, len(order))), order[edge]
                    raw = pad.tobytes()
                    names = [raw[x:y] for x, y in zip(starts[order].tolist(), ends[order].tolist())]
                    k = len(order)
                    zero = np.zeros(k)
                    yield _record(parts, [row + doc[order], None, None, names, times, np.zeros(k, np.int64), zero, zero], pa.nulls(k, batch.column(0).type), pa.nulls(k, pa.bool_()))
                row += m if last else 0

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, pieces, log_p = shared.value
        model = Lattice(pieces, log_p)
        for batch in batches:
            names, c = batch.column(4).to_pylist(), np.nan_to_num(batch.column(0).cast(pa.float64()).to_numpy(zero_copy_only=False))
            times, known, base, score_ = (batch.column(i).to_numpy() for i in (5, 6, 7, 8))
            word = np.array([w[:1] != b" " for w in names], bool)
            distinct = list({w for w in names if w[:1] != b" "})
            value = dict(zip(distinct, (model.log_marginals(distinct) / LN10).tolist()))
            lm = np.array([value.get(w, 0.0) for w in names])
            known = np.where(word, np.where(c > 0, times, 0), known)
            base = np.where(word, times * np.log10(c + 0.1), base)
            score_ = np.where(word, times * lm, score_)
            n_tokens = np.where(word, 0, times)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(n_tokens), pa.array(known), pa.array(base), pa.array(score_)], out.names)

    out = T.StructType([parts["row"], parts["doc_id"], parts["held_out"], parts["n"], parts["n_known"], parts["base"], parts["score"]])
    joined = rows.select("doc_id", "text", "held_out").mapInArrow(given_back(score), parts).join(vocab, "word", "left")
    joined = joined.select("c", "row", "doc_id", "held_out", "word", "n", "n_known", "base", "score").mapInArrow(given_back(rest), out)
    result = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")))
    return result.select("doc_id", "held_out", F.col("n").alias("n_tokens"), "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _record(schema: T.StructType, columns: list, ids: pa.Array, held: pa.Array) -> pa.RecordBatch:
    row, _, _, names, *numbers = columns
    return pa.RecordBatch.from_arrays([pa.array(row), ids, held, pa.array(names, pa.binary()), *(pa.array(x) for x in numbers)], schema.names)
