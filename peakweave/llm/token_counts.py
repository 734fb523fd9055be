"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts come in Arrow batches and are worked on in blocks balanced by bytes; a
long text is a block of its own and is split at safe boundaries (see
`encoding`).  Nothing is shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty
table gives an empty result; repeated rows are counted each for itself; other
columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import given_back, texts
from .encoding import encoder


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, spaced: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    tokenizer: path of a tokenizers file; spaced: whether white space makes tokens.
    """
    rows = texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaced)
        for batch in batches:
            text = batch.column(1)
            n = pa.array(enc.lengths(text), pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(given_back(count), schema)
