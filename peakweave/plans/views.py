"""The driver's tables read as reads, profiles, annotation, sites, sequences and matrices; in DataFrames and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import crosslink_position
from ..operators import profiles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, long = F.col("q"), lambda c: F.col(c).cast("long")
    li = table(spark, sf_dir, "lineitem").withColumn("q", long("l_quantity"))
    deleted = (F.col("l_linenumber") == 7) & (q >= 6)
    half = F.floor(q / 2)
    return li.select(
        F.col("l_returnflag").alias("sample"),
        F.concat(F.lit("c"), (F.col("l_suppkey") % 25).cast("string")).alias("contig"),
        F.when(F.col("l_linestatus") == "F", "-").otherwise("+").alias("strand"),
        (F.col("l_linestatus") == "F").alias("is_reverse"),
        F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long").alias("pos"),
        (F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) + q + F.when(deleted, 2).otherwise(0)).cast("long").alias("aend"),
        F.when(deleted, F.concat(half.cast("string"), F.lit("M2D"), (q - half).cast("string"), F.lit("M"))).otherwise(F.concat(q.cast("string"), F.lit("M"))).alias("cigar"),
        F.concat(F.lit("r"), long("l_orderkey").cast("string"), F.lit("_u"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("qname"),
    )


READS = """reads AS (
  SELECT l_returnflag AS sample, 'c' || (l_suppkey % 25) AS contig, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand,
    l_linestatus = 'F' AS is_reverse, datediff('day', date '1995-01-01', l_shipdate::date)::bigint AS pos,
    (datediff('day', date '1995-01-01', l_shipdate::date) + l_quantity::bigint + CASE WHEN l_linenumber = 7 AND l_quantity >= 6 THEN 2 ELSE 0 END)::bigint AS aend,
    CASE WHEN l_linenumber = 7 AND l_quantity >= 6 THEN (l_quantity::bigint // 2) || 'M2D' || (l_quantity::bigint - l_quantity::bigint // 2) || 'M' ELSE l_quantity::bigint || 'M' END AS cigar,
    'r' || l_orderkey || '_u' || round(l_discount * 100)::int AS qname
  FROM lineitem
), xl AS (
  SELECT *, CASE WHEN contains(cigar, 'D') THEN CASE WHEN is_reverse THEN aend - regexp_extract(cigar, 'D([0-9]+)M', 1)::bigint - 1 ELSE pos + regexp_extract(cigar, '^([0-9]+)M', 1)::bigint END
    WHEN is_reverse THEN aend ELSE pos - 1 END AS xl_pos FROM reads
), profile AS (SELECT sample, contig, strand, xl_pos AS pos, count(*) AS n FROM xl GROUP BY ALL),
pooled AS (SELECT contig, strand, pos, sum(n)::bigint AS n FROM profile GROUP BY ALL)"""


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sample."""
    return profiles.from_reads(reads(spark, sf_dir), crosslink_position(F.col("pos"), F.col("aend"), F.col("is_reverse"), F.col("cigar")))


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples together."""
    return profile(spark, sf_dir).groupBy("contig", "strand", "pos").agg(F.sum("n").alias("n"))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e = F.floor(F.col("p_partkey") / 8), F.col("p_partkey") % 8
    start = (F.floor(g / 25) % 10) * 250 + e * 30
    return table(spark, sf_dir, "part").select(
        (g % 250).alias("gene_id"), g.alias("transcript_id"), F.concat(F.lit("c"), (g % 25).cast("string")).alias("contig"),
        F.when(g % 2 == 0, "+").otherwise("-").alias("strand"), start.alias("start"), (start + 10 + F.col("p_size") % 20).cast("long").alias("end"), e.alias("e"),
    )


EXONS = """exons AS (
  SELECT g % 250 AS gene_id, g AS transcript_id, 'c' || (g % 25) AS contig, CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand, ((g // 25) % 10) * 250 + e * 30 AS start,
    ((g // 25) % 10) * 250 + e * 30 + 10 + p_size % 20 AS "end", e FROM (SELECT p_partkey // 8 AS g, p_partkey % 8 AS e, p_size FROM part)
)"""


def merged(keys: str, source: str = "exons", name: str = "merged", gap: int = 0, more: str = "") -> str:
    """SQL for the union of intervals by key."""
    return f"""{name} AS (SELECT {keys}, min(start) AS start, max("end") AS "end"{more} FROM (
  SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS brk FROM {source}))
  GROUP BY {keys}, island)"""


TX_KEYS = "transcript_id, gene_id, contig, strand"


def tx_map(source: str = "exons") -> str:
    """SQL for the map of transcripts with the intervals of a source."""
    return (
        merged(TX_KEYS, source)
        + f""", tx_map AS (
  SELECT {TX_KEYS}, row_number() OVER w - 1 AS exon_idx, start AS g_start, "end" AS g_end, (sum("end" - start) OVER w - ("end" - start))::bigint AS t_start, (sum("end" - start) OVER w)::bigint AS t_end,
    (sum("end" - start) OVER (PARTITION BY {TX_KEYS}))::bigint AS tx_len
  FROM merged WINDOW w AS (PARTITION BY {TX_KEYS} ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END ROWS UNBOUNDED PRECEDING)
)"""
    )


TX_MAP = tx_map()
GENE_MAP = merged("gene_id, contig, strand", "exons", "gene_exons") + ', gexons AS (SELECT gene_id AS transcript_id, * FROM gene_exons), ' + tx_map("gexons")


def cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exons 2 to 5 of each transcript, the outer ones in part."""
    return exons(spark, sf_dir).where("e between 2 and 5").withColumn("start", F.expr("if(e = 2, start + 5, start)")).withColumn("end", F.expr("if(e = 5, `end` - 5, `end`)"))


CDS = """cds AS (SELECT gene_id, transcript_id, contig, strand, CASE WHEN e = 2 THEN start + 5 ELSE start END AS start, CASE WHEN e = 5 THEN "end" - 5 ELSE "end" END AS "end" FROM exons WHERE e BETWEEN 2 AND 5)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("c"), (k % 25).cast("string")).alias("contig"), F.when(F.floor(k / 25) % 2 == 0, "+").otherwise("-").alias("strand"), ((k * 97) % 2400 + 50).alias("pos"))


SITES = """sites AS (SELECT s_suppkey AS id, 'c' || (s_suppkey % 25) AS contig, CASE WHEN (s_suppkey // 25) % 2 = 0 THEN '+' ELSE '-' END AS strand, (s_suppkey * 97) % 2400 + 50 AS pos FROM supplier)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]+", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), seq.alias("seq")).where(F.length("seq") >= 20)


SEQUENCES = "sequences AS (SELECT * FROM (SELECT doc_id AS seq_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents) WHERE length(seq) >= 20)"


def seq_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sites on each sequence."""
    s = sequences(spark, sf_dir)
    at = F.explode(F.array(*(F.struct((F.col("seq_id") * m % F.length("seq")).alias("pos"), F.lit(i + 1).cast("long").alias("n")) for i, m in enumerate((7, 13, 29)))))
    return s.select("seq_id", at.alias("x")).groupBy("seq_id", F.col("x.pos").alias("pos")).agg(F.sum("x.n").alias("n"))


SEQ_PROFILE = SEQUENCES + """, seq_profile AS (
  SELECT seq_id, seq_id * m % length(seq) AS pos, sum(n)::bigint AS n FROM sequences, (VALUES (7, 1), (13, 2), (29, 3)) t(m, n) GROUP BY ALL
)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("bin", "x"))
    return e.select("row_id", "bin", F.greatest(F.col("x").cast("double"), F.lit(0.0)).alias("value"))


MATRIX = "matrix AS (SELECT vec_id AS row_id, (i - 1)::int AS bin, greatest(embedding[i]::double, 0.0) AS value FROM embeddings, range(1, 65) t(i))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of each gene."""
    return exons(spark, sf_dir).groupBy(F.col("gene_id").alias("segment_id"), "contig", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))


SEGMENTS = """segments AS (SELECT gene_id AS segment_id, contig, strand, min(start) AS start, max("end") AS "end" FROM exons GROUP BY ALL)"""


SPLICED = """spliced AS (SELECT i.transcript_id, i.contig, i.strand, tx_len, CASE WHEN i.strand = '-' THEN t_start + g_end - 1 - pos ELSE t_start + pos - g_start END AS t, n, pos AS g_pos
  FROM pooled p JOIN tx_map i ON p.contig = i.contig AND p.strand = i.strand AND pos >= g_start AND pos < g_end),
in_introns AS (SELECT i.transcript_id || '|intron|' || i.start AS segment_id, i.contig, i.strand, i.start, i."end", p.pos, p.n, p.pos AS g_pos FROM pooled p JOIN introns i ON p.contig = i.contig AND p.strand = i.strand AND p.pos >= i.start AND p.pos < i."end")"""
PLACED = SPLICED + """, inside AS (SELECT transcript_id || '|exon' AS segment_id, contig, strand, 0::bigint AS start, tx_len AS "end", t AS pos, n, g_pos FROM spliced UNION ALL SELECT * FROM in_introns)"""
PLACED_PARTS = SPLICED + """, coding AS (SELECT transcript_id, min(t) AS c0, max(t) + 1 AS c1 FROM (SELECT e.transcript_id, CASE WHEN strand = '-' THEN t_start + g_end - 1 - g ELSE t_start + g - g_start END AS t FROM (SELECT transcript_id, unnest([min(start), max("end") - 1]) AS g FROM cds GROUP BY transcript_id) e JOIN tx_map m ON e.transcript_id = m.transcript_id AND g >= g_start AND g < g_end) GROUP BY transcript_id),
inside AS (SELECT transcript_id || '|' || part AS segment_id, contig, strand, CASE part WHEN 'CDS' THEN c0 WHEN '3UTR' THEN c1 ELSE 0 END AS start, CASE part WHEN '5UTR' THEN c0 WHEN 'CDS' THEN c1 ELSE tx_len END AS "end", t AS pos, n, g_pos
  FROM (SELECT s.*, c0, c1, CASE WHEN c0 IS NULL THEN 'exon' WHEN t < c0 THEN '5UTR' WHEN t < c1 THEN 'CDS' ELSE '3UTR' END AS part FROM spliced s LEFT JOIN coding USING (transcript_id)) UNION ALL SELECT * FROM in_introns)"""


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, start, seq): 2,700 invented bases of each contig with an exon, in chunks of 64."""
    contigs = exons(spark, sf_dir).select("contig").distinct().select("contig", F.explode(F.sequence(F.lit(0), F.lit(2699), F.lit(64))).alias("start"))
    at = F.sequence(F.col("start"), F.least(F.col("start") + 63, F.lit(2699)))
    seq = F.array_join(F.transform(at, lambda i: F.translate(F.substring(F.md5(F.concat(F.col("contig"), F.lit("|"), i.cast("string")).cast("binary")), 1, 1), "0123456789abcdef", "AAAACCCCGGGGTTTT")), "")
    return contigs.select("contig", F.col("start").cast("long").alias("start"), seq.alias("seq"))


GENOME = """genome AS (SELECT contig, i, translate(substr(md5(contig || '|' || i), 1, 1), '0123456789abcdef', 'AAAACCCCGGGGTTTT') AS base FROM (SELECT DISTINCT contig FROM exons), range(0, 2700) t(i))"""


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with mates: length of the read, aligned length, whether it is paired, second, and its mate mapped, and the template's length."""
    q, k = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("sample"), q.alias("length"), (q + F.when((k == 7) & (q >= 6), 2).otherwise(0)).cast("long").alias("aligned"), (k % 3 != 0).alias("is_paired"), (k % 3 == 2).alias("is_read2"),
        (k % 5 == 0).alias("mate_unmapped"), (F.when(k % 2 == 0, -1).otherwise(1) * (q + F.col("l_partkey") % 50)).cast("long").alias("tlen"),
    )


FRAGMENTS = """fragments AS (SELECT l_returnflag AS sample, l_quantity::bigint AS length, l_quantity::bigint + CASE WHEN l_linenumber = 7 AND l_quantity >= 6 THEN 2 ELSE 0 END AS aligned, l_linenumber % 3 <> 0 AS is_paired,
  l_linenumber % 3 = 2 AS is_read2, l_linenumber % 5 = 0 AS mate_unmapped, (CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * (l_quantity::bigint + l_partkey % 50))::bigint AS tlen FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample table: umi_pattern, barcode, track and lane, some with several lanes."""
    k = F.col("n_nationkey")
    barcode = F.concat(*(F.substring(F.lit("ACGT"), (x % 4 + 1).cast("int"), F.lit(1)) for x in (F.floor(k / 4), k)))
    rows = table(spark, sf_dir, "nation").where("n_nationkey < 16").select(F.lit("NXXNN").alias("umi_pattern"), barcode.alias("barcode"), F.concat(F.lit("t"), k.cast("string")).alias("track"), F.expr("if(n_nationkey % 3 = 0, 'L1', 'L1,L2')").alias("lanes"))
    return rows.select("umi_pattern", "barcode", "track", F.explode(F.split("lanes", ",")).alias("lane"))


SAMPLES = """samples AS (SELECT 'NXXNN' AS umi_pattern, substr('ACGT', (n_nationkey // 4 % 4 + 1)::int, 1) || substr('ACGT', (n_nationkey % 4 + 1)::int, 1) AS barcode, 't' || n_nationkey AS track, unnest(CASE WHEN n_nationkey % 3 = 0 THEN ['L1'] ELSE ['L1', 'L2'] END) AS lane FROM nation WHERE n_nationkey < 16)"""
