"""What the operators of this subpackage share: folders, columns, tables written between jobs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of a text, as Java and DuckDB write the pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a temporary folder stands for it on a local master; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/peakweave-checkpoints"
    return f"{base.rstrip('/')}/peakweave/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared one, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; results that were not written or collected are lost."""
    remove(spark, shared_dir(spark))


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and lost executors cost no result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a mapInArrow, which at its end gives freed memory back to the system: a worker outlives its task, and the next stage may need none of it."""

    def then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
            if trim is not None:
                trim(0)

    return then_trim


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, named doc_id and text; other columns, whatever their names, are not read."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def lower_ascii(col: Column) -> Column:
    """A-Z as a-z; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, small: bool = False) -> np.ndarray:
    """The sum over all tasks of the int64 arrays (of length `size`) that `count` makes from a task's batches.

    Arrays travel in slices, are added up slice by slice on the executors, and
    only the sum, `size` numbers, reaches the driver.  small: a task's numbers
    travel as 16 bits, the largest standing for all above.
    """
    kind = np.uint16 if small else np.int64
    n_slices = max(1, min(32, size // 4096))
    width = -(-size // n_slices)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count(batches)
        if total.any():
            total = np.minimum(total, np.iinfo(kind).max).astype(kind)
            parts = [total[i * width : (i + 1) * width] for i in range(n_slices)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n_slices), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(raw, kind).astype(np.int64)
                sums[i] = sums[i] + x if i in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    out = np.zeros(size, np.int64)
    for r in rows.mapInArrow(given_back(per_task), schema).repartition(n_slices, "slice").mapInArrow(given_back(add), schema).collect():
        at = r["slice"] * width
        out[at : at + width] += np.frombuffer(r["counts"], np.int64)
    return out


def with_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """All columns of df and new ones that `make` gives for the texts of a batch; a clash of names is the caller's to avoid."""
    schema = T.StructType([*df.schema.fields, *fields])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(at))], schema.names)

    return df.mapInArrow(given_back(run), schema)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n
