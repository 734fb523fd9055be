"""Best-fit packing of documents into sequences of a fixed capacity, bulk-synchronously.

Lengths are whole numbers up to the capacity, so documents of one length are
interchangeable and so are gaps of one size: the range-sorted lists of
documents and of gaps are two histograms of at most `capacity` classes, however
many rows there are.  A superstep takes one class of documents, longest first,
sweeps the sorted gap classes from its successor (the smallest gap that holds
it) upwards, and updates the gaps; documents of a class that want the same gaps
get them by rank.  The outcome is exactly best-fit decreasing.  What a superstep
decides are runs: "ranks a..b of length L go to sequences s.., q in each, from
offset o on".  Ranks are dealt over all tasks at once from counts by (task,
length); each row then finds its place by binary search in the runs.

Only the histogram reaches the driver, and only the runs go to the tasks.

Defined results: a null text is empty and holds the end id alone; only
documents longer than the capacity are cut; repeated ids are documents of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, texts, written
from .encoding import encoder

RUN_FIELDS = ("length", "rank", "per_sequence", "sequence", "offset")


def best_fit_runs(counts: np.ndarray, capacity: int) -> tuple[dict[str, np.ndarray], int]:
    """Runs of the best-fit-decreasing packing of counts[L] items of each length L, and the number of sequences.

    A run begins at a rank of its length and lasts up to the next run's; item i
    of it goes to sequence + i div per_sequence, at offset + (i mod per_sequence) * length.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in range(capacity, 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            k = bisect.bisect_left(sizes, length)
            if k < len(sizes):
                gap = sizes[k]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(k)
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, each, first, capacity - gap))
                leave(gap - each * length, first, full)
            rest = min(left - full * each, each - 1) if full < n else 0
            if rest:
                runs.append((length, rank + full * each, rest, first + full, capacity - gap))
                leave(gap - rest * length, first + full, 1)
            used = full + bool(rest)
            leave(gap, first + used, n - used)
            rank += full * each + rest
            left -= full * each + rest
    table = np.array(runs, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {k: table[:, i] for i, k in enumerate(RUN_FIELDS)}, opened


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32, and (task, nth): its number among the task's pieces of that length."""
    rows = texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(tokenizer, spaced), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, ids, n in enc.encode(batch.column(1)):
                raw = np.insert(ids, np.cumsum(n), end_id).astype("<u4").tobytes()
                n = n + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                at = (np.cumsum(n) - n)[doc] + start
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at.tolist(), (at + length).tolist())]
                # Number the pieces of each length on from what this task had.
                order = np.argsort(length, kind="stable")
                of, first = np.unique(length[order], return_index=True)
                within = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                nth = np.empty(len(order), np.int64)
                nth[order] = within
                nth += seen[length]
                seen[of] += np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(nth)], schema.names)

    return rows.mapInArrow(given_back(cut), schema)


def best_fit_pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (its columns: length, task, nth and any others)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    runs, _ = best_fit_runs(counts, capacity)
    base = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))
    ranked = pieces.join(base, ["length", "task"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    keep = [c for c in pieces.columns if c not in ("task", "nth")]
    schema = T.StructType([pieces.schema[c] for c in keep] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    # One sortable number for (length, rank): ranks of a length are below 2 ** 50.
    keys = (runs["length"] << 50) + runs["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            run = np.searchsorted(keys, (length << 50) + rank, "right") - 1
            i, each = rank - runs["rank"][run], runs["per_sequence"][run]
            where = [pa.array(runs["sequence"][run] + i // each), pa.array(runs["offset"][run] + i % each * length)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + where, schema.names)

    return ranked.select(*keep, "_rank").mapInArrow(given_back(place), schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    return best_fit_pack(written(token_pieces(docs, tokenizer, end_id, capacity, spaced, id_col, text_col), "pieces"), capacity)
