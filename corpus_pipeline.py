"""The corpus pipeline: toxicity, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm import decontamination, jaccard_join, language_id, packing, toxicity
from peakweave.llm.common import WORD, free_name, written
from peakweave.llm.encoding import tokenizer_path
from peakweave.session import ship

TOXIC_FROM = 0.3
#: A text whose confidence (see language_id) is lower is in no language that the model knows.  The lowest of 3,358 rows
#: outside training at sf0.1 has 0.08; texts that mix known languages, or have more numbers than words, are below 0.5.
LEAST_LANGUAGE_CONFIDENCE = 0.02


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below TOXIC_FROM; null texts stay."""
    ship(spark)
    model = toxicity.toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "toxicity")
    return toxicity.with_toxicity(docs, model, score=score).where((F.col(score) < TOXIC_FROM) | F.col("text").isNull()).drop(score)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows: not `und`, and not below LEAST_LANGUAGE_CONFIDENCE."""
    ship(spark)
    model = language_id.language_model(docs)
    pred, score, sure = (free_name(docs, x) for x in ("language", "language_score", "language_confidence"))
    named = language_id.with_language(docs, model, pred=pred, score=score, confidence=sure)
    return named.where((F.col(pred) != "und") & (F.col(sure) >= LEAST_LANGUAGE_CONFIDENCE)).drop(pred, score, sure)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of rows linked by a Jaccard similarity of 0.8 on 5-word shingles.

    It is the row with the smallest id.  Rows that hold the same id and text are
    one; rows that share an id and hold different texts are not, unless they are
    linked.  Rows without an id or a word stay.
    """
    ship(spark)
    names = docs.columns
    text_hash, nth = free_name(docs, "text_hash"), free_name(docs, "nth")
    groups = jaccard_join.jaccard_groups(docs, k=5, threshold=80)
    losers = written(groups.where(~F.col("is_head")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "losers")
    # They grow with the documents, so they are never broadcast: the plan is the same at every size.
    losers = losers.distinct().hint("merge")
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    kept = keyed.join(losers, (keyed["doc_id"] == F.col("_id")) & (keyed[text_hash] == F.col("_hash")), "left_anti")
    # Copies under one id lie next to each other after the join; what takes no part in links is a group of its own.
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return kept.withColumn(nth, F.when(alone, F.monotonically_increasing_id())).dropDuplicates(["doc_id", text_hash, nth]).select(*names)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark item occurs."""
    ship(spark)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: Several stages are models; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
