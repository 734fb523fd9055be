"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, language_id, license_scan, lm_scoring, packing, quality, token_counts, token_files, toxicity
from .common import shared_dir
from .encoding import tokenizer_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir), k=3, threshold=90)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.token_file_digests(spark, path)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), limit=1024)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_token_counts": op10_token_counts,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.c
)
SELECT s.doc_id, cast(len(s.s) AS bigint) AS n_shingles, g.c AS component_id, cast(coalesce(k.n, 0) AS bigint) AS n_links
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) g USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM p GROUP BY a) k USING (doc_id)
"""

_LICENSE_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1_SQL = f"""
WITH t(template, license, text) AS (VALUES {", ".join(f"({i}, {_quoted(name)}, {_quoted(text)})" for i, (name, text) in enumerate(license_scan.TEMPLATES))}),
tw AS (SELECT template, license, {_LICENSE_WORDS} AS w FROM t), tk AS (SELECT *, len(w) AS n, least(len(w), {license_scan.K}) AS k FROM tw),
ts AS (SELECT DISTINCT template, license, k, n, array_to_string(w[i + 1:i + k], ' ') AS sh FROM (SELECT *, unnest(range(0, n - k + 1)) AS i FROM tk)),
tn AS (SELECT template, count(*) AS total FROM ts GROUP BY template),
d AS (SELECT row_number() OVER () AS row, doc_id, {_LICENSE_WORDS} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT row, doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS sh FROM (SELECT d.*, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM ts))),
hits AS (SELECT row, doc_id, template, license, k, n, i, sh, unnest([i // n, i // n - 1]) AS win FROM ds JOIN ts USING (k, sh)),
c AS (SELECT row, doc_id, template, license, win * n AS first, count(DISTINCT sh) / any_value(total) AS containment FROM hits JOIN tn USING (template) WHERE win >= 0 AND i >= win * n AND i + k <= win * n + 2 * n GROUP BY row, doc_id, template, license, win, n),
b AS (SELECT *, row_number() OVER (PARTITION BY row, template ORDER BY containment DESC, first) AS nth FROM c WHERE containment >= {license_scan.CONTAINMENT})
SELECT doc_id, license, containment, first::int AS window_start FROM b WHERE nth = 1
"""

ORACLES: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
}
