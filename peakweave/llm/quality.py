"""Quality rules with DataFrame functions alone: counts of a text, and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into BUCKETS buckets.  Two
multinomials over the buckets are counted, one over all rows, one over the rows
that are trusted (by the labels).  A text's score is the mean over its n-grams
of log(trusted / all), so texts of all lengths compare, and rows below
THRESHOLD are not kept.  Counts of both multinomials, BUCKETS numbers each, are
all that reaches the driver; the ratios go back as one literal.  Trusted ids are
counted, and sent to all tasks if they are BROADCAST_IDS at most; if there are more,
they are joined by sort and merge.

Defined results: a null or empty text has no words, all counts 0 and score 0,
and fails; without any trusted row every score is 0; null ids are never
trusted; an id is trusted if any of its labels is good; repeated rows are
counted and judged each for itself.  Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

BUCKETS, THRESHOLD, PRIOR = 1 << 14, -0.12, 1.0
#: Ids (eight bytes each) that may be sent to every task.
BROADCAST_IDS = 1 << 21
_BLANK = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


def _words(text):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BLANK), "")


def _buckets(hashes):
    """Buckets of all words and of all pairs of neighbours, from the words' hashes."""
    n = F.size(hashes)
    one = F.transform(hashes, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    two = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.pmod(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1)), F.lit(BUCKETS)).cast("int")))
    return F.concat(one, F.coalesce(two, F.array().cast("array<int>")))


def _bucket_counts(rows: DataFrame) -> list[int]:
    hashed = rows.select(F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    counts = [0] * BUCKETS
    # explode_outer: a filter on the array, which explode brings along, would be pushed down and hash each text for each word.
    for r in hashed.select(F.explode_outer(_buckets(F.col("h"))).alias("b")).where("b is not null").groupBy("b").count().collect():  # BUCKETS rows at most
        counts[r["b"]] = r["count"]
    return counts


def log_ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(trusted / all) of each bucket, both smoothed; rounded, so that it prints the same everywhere."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    trusted = trusted.hint("broadcast" if trusted.count() <= BROADCAST_IDS else "merge")
    everything = _bucket_counts(docs)
    good = _bucket_counts(docs.where("doc_id is not null").join(trusted, "doc_id", "left_semi"))
    n_all, n_good = sum(everything) + PRIOR * BUCKETS, sum(good) + PRIOR * BUCKETS
    if not sum(good):
        return [0.0] * BUCKETS
    return [round(math.log((g + PRIOR) / n_good) - math.log((a + PRIOR) / n_all), 5) for g, a in zip(good, everything)]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept of every row."""
    rows = texts(docs, id_col, text_col)
    ratios = log_ratios(rows, labels)
    weights = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = rows.select("doc_id", _words(F.col("text")).alias("w"), (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    step = step.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    n = F.size("h")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(5))))).otherwise(F.array().cast("array<bigint>"))
    step = step.withColumn("h5", windows).withColumn("buckets", _buckets(F.col("h")))
    score = F.when(F.size("buckets") > 0, F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get(weights, b)) / F.size("buckets")).otherwise(0.0)
    step = step.withColumn("score", score).drop("h", "buckets")
    # Only texts with a window that repeats are looked at further.
    sorted_ = F.when(F.size(F.array_distinct("h5")) < F.size("h5"), F.array_sort(F.transform("h5", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    step = step.withColumn("s", sorted_).drop("h5")
    same = lambda j, k: F.coalesce(F.get("s", j)["x"] == F.get("s", k)["x"], F.lit(False))
    where = F.transform(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: same(j, j + 1) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0))))), lambda j: F.get("s", j)["i"])
    step = step.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(where))).drop("s")
    covered = F.aggregate(F.sequence(F.lit(0), F.size("p") - 1), F.lit(0).cast("long"), lambda a, j: a + F.least(F.lit(5), F.coalesce(F.get("p", j + 1) - F.get("p", j), F.lit(5))))
    step = step.withColumn("n_repeat_words", F.when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(covered))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return step.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
