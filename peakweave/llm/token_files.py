"""Token-ID files, compressed by Re-Pair grammars.

Documents are range-sorted by id (and by their place in the input, so that an id
that many rows share is split as any other range) and encoded; each task cuts its
ids into shards of about `shard_ids` ids (a document is never cut) and stores each
as grammars with rules and expansion lengths, so any document can be decoded
alone.  A grammar covers 2 * `shard_ids` ids at most: a shard has one, or several
if it holds a very long document.  Files are Parquet with one row for a shard:
part, block, first (ids before it in its part), n_ids, doc_ids, counts (ids of
each document) and grammars.  Spark's committer writes them, so a lost task leaves
nothing half done.

Defined results: a null text is empty and gives the end id alone; a null id
sorts first; repeated ids are documents of their own, in the order of the input;
an empty table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grammar
from .common import given_back, texts
from .encoding import encoder


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = True, shard_ids: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the documents in ascending order of their ids and writes the shards to `path`."""
    rows = texts(docs, id_col, text_col).withColumn("_nth", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("doc_id", "_nth").sortWithinPartitions("doc_id", "_nth").drop("_nth")
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("grammars", T.ArrayType(T.BinaryType()))])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced)
        base = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part = TaskContext.get().partitionId()
        block, first = 0, 0
        ids: list[np.ndarray] = []
        names: list = []
        counts: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal block, first, held
            whole = np.concatenate(ids)
            n_parts = max(1, len(whole) // shard_ids)
            packed = [grammar.pack(grammar.compress(x, base)) for x in np.array_split(whole, n_parts)]
            arrays = [pa.array([c], t) for c, t in zip((part, block, first, held), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            doc_ids, n = pa.concat_arrays(names), pa.array(np.concatenate(counts))
            arrays += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (doc_ids, n, pa.array(packed, pa.binary()))]
            block, first, held = block + 1, first + held, 0
            for x in (ids, names, counts):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            for a, b, block_ids, n in enc.encode(batch.column(1)):
                # The end id goes after the ids of each document.
                ids.append(np.insert(block_ids, np.cumsum(n), end_id))
                names.append(batch.column(0).slice(a, b - a))
                counts.append(n + 1)
                held += len(ids[-1])
                if held >= shard_ids:
                    yield close()
        if names:
            yield close()

    rows.mapInArrow(given_back(shards), schema).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian uint32) of each document."""
    return _read(spark, path, "ids", T.BinaryType(), pa.binary(), lambda x: x)


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    return _read(spark, path, "ids_crc32", T.LongType(), pa.int64(), zlib.crc32)


def _read(spark: SparkSession, path: str, name: str, kind, arrow_kind, made) -> DataFrame:
    files = spark.read.parquet(path)
    # One row for each range partition of the writer, never for documents or shards.
    total, before = 0, {}
    for r in sorted(files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        before[r.part] = total
        total += r.n
    id_type = files.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField(name, kind)])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, first = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                doc_ids, counts = batch.column(2)[i].values, batch.column(3)[i].values.to_numpy()
                packed = batch.column(4)[i].values
                raw = b"".join(grammar.Decoder(grammar.unpack(x.as_buffer())).all().astype("<u4").tobytes() for x in packed)
                ends = np.cumsum(counts)
                starts = ends - counts
                out = [made(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + first + before[part]), pa.array(counts), pa.array(out, arrow_kind)], schema.names)

    return files.select("part", "first", "doc_ids", "counts", "grammars").mapInArrow(given_back(documents), schema)


def decode_document(row, index: int) -> np.ndarray:
    """The ids of one document of a shard row, by random access into its grammar."""
    first, n, out = int(sum(row.counts[:index])), int(row.counts[index]), []
    for raw in row.grammars:
        g = grammar.unpack(bytes(raw))
        if n > 0 and first < g.n_ids:
            out.append(grammar.Decoder(g).slice(first, n))
            n -= len(out[-1])
        first = max(0, first - g.n_ids)
    return np.concatenate(out)
