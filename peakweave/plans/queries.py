"""Queries of the engine's own operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reads import PRESETS, aligned_positions, crosslink_position, demultiplex, first_deletion_offset, fragment_length, reverse_complement, rewrite_name, split_barcode, track_hub
from ..operators import coordinates as co
from ..operators import intervals as iv
from ..operators import profiles as pr
from ..operators import segments as sg
from ..operators import sequences as sq
from ..operators import statistics as st
from ..operators.ranking import coarse, with_rank
from . import views as v

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


R, E, X, M, C, S, G = f"WITH {v.READS}", v.EXONS, v.MATRIX, v.TX_MAP, v.CDS, v.SITES, v.SEGMENTS
IN = "p.contig = i.contig AND p.strand = i.strand AND p.pos >= i.start AND p.pos < i.\"end\""
r6 = lambda c: F.round(c, 6)
#: Tails that are fractions lie on the edge of rounding; a little more puts them on one side in both engines.
p6 = lambda c: F.round(F.col(c) + 1.234e-9, 6)


def introns_sql(keys: str, source: str = "merged") -> str:
    return f'introns AS (SELECT * FROM (SELECT {keys}, "end" AS start, lead(start) OVER (PARTITION BY {keys} ORDER BY start) AS "end" FROM {source}) WHERE "end" > start)'


# Reads and profiles.


@query(f"{R} SELECT sample, contig, strand, cigar, xl_pos AS xl, count(*) AS n FROM xl GROUP BY ALL")
def xl_position(spark, d):
    x = crosslink_position(F.col("pos"), F.col("aend"), F.col("is_reverse"), F.col("cigar"))
    return v.reads(spark, d).groupBy("sample", "contig", "strand", "cigar", x.alias("xl")).agg(F.count("*").alias("n"))


@query(f"{R} SELECT contig, strand, CASE WHEN contains(cigar, 'D') THEN pos + l // 2 + CASE WHEN l // 2 >= regexp_extract(cigar, '^([0-9]+)M', 1)::bigint THEN 2 ELSE 0 END ELSE pos + l // 2 END AS xl, count(*) AS n FROM (SELECT *, aend - pos - CASE WHEN contains(cigar, 'D') THEN 2 ELSE 0 END AS l FROM reads) GROUP BY ALL")
def xl_centre(spark, d):
    at = aligned_positions(F.col("pos"), F.col("cigar"))
    return v.reads(spark, d).groupBy("contig", "strand", F.get(at, F.floor(F.size(at) / 2).cast("int")).alias("xl")).agg(F.count("*").alias("n"))


@query(f"{R} SELECT contig, strand, CASE WHEN is_reverse THEN pos ELSE aend - 1 END AS xl, count(*) AS n FROM reads GROUP BY ALL")
def xl_nascent(spark, d):
    x = crosslink_position(F.col("pos"), F.col("aend"), F.col("is_reverse"), F.col("cigar"), PRESETS["nascent-read1"])
    return v.reads(spark, d).groupBy("contig", "strand", x.alias("xl")).agg(F.count("*").alias("n"))


@query(f"{R} SELECT cigar, regexp_extract(cigar, '^([0-9]+)M', 1)::bigint AS k, count(*) AS n FROM reads WHERE contains(cigar, 'D') GROUP BY ALL")
def first_deletion(spark, d):
    return v.reads(spark, d).groupBy("cigar", first_deletion_offset(F.col("cigar")).alias("k")).agg(F.count("*").alias("n")).where("k is not null")


@query(f"{R} SELECT * FROM profile")
def strand_depth(spark, d):
    return v.profile(spark, d)


@query(f"{R} SELECT contig, pos, sum(n)::bigint AS n FROM profile GROUP BY ALL")
def unstranded_depth(spark, d):
    return v.profile(spark, d).groupBy("contig", "pos").agg(F.sum("n").alias("n"))


@query(f"{R} SELECT * FROM pooled")
def union_replicates(spark, d):
    return v.pooled(spark, d)


@query(f"{R} SELECT contig, strand, pos, n FROM pooled WHERE contig = 'c3' AND strand = '+' AND pos >= 500 AND pos < 900")
def range_clip(spark, d):
    return v.pooled(spark, d).where("contig = 'c3' and strand = '+' and pos >= 500 and pos < 900")


@query(f"{R} SELECT contig, strand, pos, round(n * 1e6 / (SELECT count(*) FROM reads), 6) AS cpm FROM pooled")
def cpm(spark, d):
    total = v.reads(spark, d).agg(F.count("*").alias("t"))
    return v.pooled(spark, d).crossJoin(F.broadcast(total)).select("contig", "strand", "pos", r6(F.col("n") * 1e6 / F.col("t")).alias("cpm"))


@query(f"{R} SELECT sample, contig, strand, pos, pos + 1 AS \"end\", CASE WHEN strand = '-' THEN -n ELSE n END AS value FROM profile WHERE pos > 0 AND pos < 2499")
def bedgraph(spark, d):
    return v.profile(spark, d).where("pos > 0 and pos < 2499").select("sample", "contig", "strand", "pos", (F.col("pos") + 1).alias("end"), F.expr("if(strand = '-', -n, n)").alias("value"))


@query(f"{R} SELECT split_part(qname, '_', 2) AS umi, count(*) AS n FROM reads GROUP BY ALL")
def umi_hist(spark, d):
    return v.reads(spark, d).groupBy(F.element_at(F.split("qname", "_"), -1).alias("umi")).agg(F.count("*").alias("n"))


@query(f"{R} SELECT contig, strand, pos, count(DISTINCT split_part(qname, '_', 2)) AS n FROM reads GROUP BY ALL")
def dedup_umi(spark, d):
    unique = v.reads(spark, d).select("contig", "strand", "pos", F.element_at(F.split("qname", "_"), -1).alias("umi")).dropDuplicates()
    return unique.groupBy("contig", "strand", "pos").agg(F.count("*").alias("n"))


@query(f"{R} SELECT sample, count(*) AS mapped, count(*) FILTER (is_reverse) AS reverse, count(*) FILTER (contains(cigar, 'N')) AS spliced, count(*) FILTER (contains(cigar, 'D')) AS deleted FROM reads GROUP BY sample")
def alignment_stats(spark, d):
    flag = lambda c, name: F.count_if(c).alias(name)
    return v.reads(spark, d).groupBy("sample").agg(F.count("*").alias("mapped"), flag(F.col("is_reverse"), "reverse"), flag(F.col("cigar").contains("N"), "spliced"), flag(F.col("cigar").contains("D"), "deleted"))


@query(f"{R} SELECT sample, aend - pos AS length, count(*) AS n FROM reads GROUP BY ALL")
def fragment_lengths(spark, d):
    return v.reads(spark, d).groupBy("sample", (F.col("aend") - F.col("pos")).alias("length")).agg(F.count("*").alias("n"))


@query(f"{R} SELECT contig, strand, pos // 50 AS bin, sum(n)::bigint AS n FROM pooled WHERE pos >= 0 GROUP BY ALL")
def binned_counts(spark, d):
    return v.pooled(spark, d).where("pos >= 0").groupBy("contig", "strand", F.floor(F.col("pos") / 50).alias("bin")).agg(F.sum("n").alias("n"))


# Intervals.


@query(f"""{R}, {E}, {v.merged("gene_id, contig, strand")}, {introns_sql("gene_id, contig, strand")}, k AS (SELECT *, 'exon' AS kind FROM merged UNION ALL SELECT *, 'intron' FROM introns),
h AS (SELECT i.gene_id, sum(n) FILTER (kind = 'exon') AS a, sum(n) FILTER (kind = 'intron') AS b FROM pooled p JOIN k i ON {IN} GROUP BY i.gene_id)
SELECT g.gene_id, coalesce(a, 0)::bigint AS exon_count, coalesce(b, 0)::bigint AS intron_count FROM (SELECT DISTINCT gene_id FROM exons) g LEFT JOIN h USING (gene_id)""")
def count_features(spark, d):
    return pr.count_features(v.pooled(spark, d), v.exons(spark, d))


@query(f"{R}, {E} SELECT transcript_id * 8 + e AS id, sum(n)::bigint AS total, count(*) AS bases FROM pooled p JOIN exons i ON {IN} GROUP BY ALL")
def count_intervals(spark, d):
    return pr.count_intervals(v.pooled(spark, d), v.exons(spark, d).withColumn("id", F.col("transcript_id") * 8 + F.col("e")))


@query(f"WITH {E}, {v.merged('gene_id, contig, strand', gap=8)} SELECT * FROM merged")
def merge_intervals(spark, d):
    return iv.merge(v.exons(spark, d), ("gene_id", "contig", "strand"), 8)


@query(f"WITH {E}, {v.merged('gene_id, contig, strand')}, {introns_sql('gene_id, contig, strand')} SELECT * FROM introns")
def introns(spark, d):
    return iv.gaps(v.exons(spark, d), ("gene_id", "contig", "strand"))


SUBTRACT = f"""sub AS (SELECT DISTINCT {v.TX_KEYS}, p FROM (SELECT *, unnest(range(start, "end")) AS p FROM exons)
  EXCEPT SELECT {v.TX_KEYS}, unnest(range(start, "end")) FROM cds),
rest AS (SELECT {v.TX_KEYS}, min(p) AS start, max(p) + 1 AS "end" FROM (SELECT *, p - row_number() OVER (PARTITION BY {v.TX_KEYS} ORDER BY p) AS i FROM sub) GROUP BY {v.TX_KEYS}, i)"""


@query(f"WITH {E}, {C}, {SUBTRACT} SELECT * FROM rest")
def truncate_intervals(spark, d):
    return iv.subtract(v.exons(spark, d), v.cds(spark, d), co.TX)


CLUSTERS = v.merged("contig, strand", '(SELECT contig, strand, pos AS start, pos + 1 AS "end", n FROM pooled WHERE n >= 3)', "clusters", 5, ", max(n) AS score, count(*) AS bases")


@query(f"{R}, {CLUSTERS} SELECT * FROM clusters")
def cluster_merge(spark, d):
    return iv.clusters(v.pooled(spark, d).where("n >= 3"), 5)


@query(f"""{R}, {v.merged("sample, contig, strand", '(SELECT sample, contig, strand, pos AS start, pos + 1 AS "end" FROM profile WHERE n >= 2)', "own", 5)},
{v.merged("contig, strand", "own", "joined", 0, ", count(DISTINCT sample) AS samples")} SELECT * FROM joined WHERE samples >= 2""")
def reproducible_clusters(spark, d):
    own = iv.clusters(v.profile(spark, d).where("n >= 2"), 5, ("sample", "contig", "strand"))
    return iv.reproducible(own.select("sample", "contig", "strand", "start", "end"), 2)


@query(f"""{R}, {CLUSTERS}, {S} SELECT * FROM clusters c WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.contig = c.contig AND c.start < s.pos + 40 AND s.pos - 40 < c."end")""")
def remove_control(spark, d):
    control = v.sites(spark, d).select("contig", (F.col("pos") - 40).alias("start"), (F.col("pos") + 40).alias("end"))
    return iv.join_overlaps(iv.clusters(v.pooled(spark, d).where("n >= 3"), 5), control, ("contig",), "left_anti")


@query(f"""{R}, {E}, {v.merged("contig, strand")}, {introns_sql("contig, strand")}, c AS (SELECT *, 'exon' AS name FROM merged UNION ALL SELECT *, 'intron' FROM introns)
SELECT name, count(*) AS n FROM reads r JOIN c ON r.contig = c.contig AND r.strand = c.strand AND r.pos < c."end" AND c.start < r.aend WHERE least(r.aend, c."end") - greatest(r.pos, c.start) >= 0.5 * (r.aend - r.pos) GROUP BY name""")
def context_stats(spark, d):
    keys = ("contig", "strand")
    context = iv.merge(v.exons(spark, d), keys).withColumn("name", F.lit("exon")).unionByName(iv.gaps(v.exons(spark, d), keys).withColumn("name", F.lit("intron")))
    found = iv.join_overlaps(v.reads(spark, d).withColumnsRenamed({"pos": "start", "aend": "end"}), context, keys)
    return found.where("least(`end`, b_end) - greatest(start, b_start) >= 0.5 * (`end` - start)").groupBy(F.col("b_name").alias("name")).agg(F.count("*").alias("n"))


# Coordinates and regions.


@query(f"WITH {E}, {M} SELECT * FROM tx_map")
def tx_map(spark, d):
    return co.transcript_map(v.exons(spark, d))


POINTS = "points AS (SELECT transcript_id, start + (e * 7) % 20 AS pos FROM exons)"
T_OF_G = "CASE WHEN strand = '-' THEN t_start + g_end - 1 - pos ELSE t_start + pos - g_start END"


def _points(spark, d):
    return v.exons(spark, d).select("transcript_id", (F.col("start") + (F.col("e") * 7) % 20).alias("pos"))


@query(f"WITH {E}, {M}, {POINTS} SELECT transcript_id, pos, {T_OF_G} AS t_pos FROM points JOIN tx_map USING (transcript_id) WHERE pos >= g_start AND pos < g_end")
def genome2tx(spark, d):
    return co.genome_to_transcript(_points(spark, d), co.transcript_map(v.exons(spark, d))).select("transcript_id", "pos", "t_pos")


@query(f"WITH {E}, {M} SELECT transcript_id, t AS t_pos, CASE WHEN strand = '-' THEN g_end - 1 - (t - t_start) ELSE g_start + t - t_start END AS pos FROM tx_map, range(0, 200, 13) r(t) WHERE t >= t_start AND t < t_end")
def tx2genome(spark, d):
    at = v.exons(spark, d).select("transcript_id").distinct().withColumn("t_pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"), F.lit(13).cast("long"))))
    return co.transcript_to_genome(at, co.transcript_map(v.exons(spark, d))).select("transcript_id", "t_pos", "pos")


@query(f"""WITH {E}, {M} SELECT transcript_id, min(g) AS start, max(g) + 1 AS "end" FROM (SELECT transcript_id, exon_idx, CASE WHEN strand = '-' THEN g_end - 1 - (t - t_start) ELSE g_start + t - t_start END AS g FROM tx_map, range(10, 60) r(t) WHERE t >= t_start AND t < t_end) GROUP BY transcript_id, exon_idx""")
def tx_interval2genome(spark, d):
    at = v.exons(spark, d).select("transcript_id", F.lit(10).cast("long").alias("ts"), F.lit(60).cast("long").alias("te")).distinct()
    return co.transcript_interval_to_genome(at, co.transcript_map(v.exons(spark, d))).select("transcript_id", "start", "end")


@query(f"""WITH {E}, {M}, a AS (SELECT e1.transcript_id, e1.start + 3 AS start, e1."end" - 2 AS "end" FROM exons e1),
t AS (SELECT a.transcript_id, a.start, a."end", pos, {T_OF_G} AS t_pos FROM (SELECT *, unnest([start, "end" - 1]) AS pos FROM a) a JOIN tx_map m ON a.transcript_id = m.transcript_id AND pos >= g_start AND pos < g_end)
SELECT transcript_id, start, "end", min(t_pos) AS ts, max(t_pos) + 1 AS te FROM t GROUP BY ALL HAVING count(*) >= 2""")
def genome_interval2tx(spark, d):
    a = v.exons(spark, d).select("transcript_id", (F.col("start") + 3).alias("start"), (F.col("end") - 2).alias("end"))
    return co.genome_interval_to_transcript(a, co.transcript_map(v.exons(spark, d)))


def _region(name: str, sql: str) -> None:
    def run(spark, d):
        return co.region(v.exons(spark, d), name, v.cds(spark, d))

    run.__name__ = f"regions_{name}"
    query(f"WITH {E}, {C}, {SUBTRACT}, spans AS (SELECT {v.TX_KEYS}, min(start) AS s, max(\"end\") AS e FROM exons GROUP BY ALL), lim AS (SELECT transcript_id, min(start) AS c0, max(\"end\") AS c1 FROM cds GROUP BY ALL), num AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END) AS i, count(*) OVER (PARTITION BY transcript_id) AS c FROM exons), {v.merged(v.TX_KEYS)}, {introns_sql(v.TX_KEYS)} {sql}")(run)


def _at(a: str, b: str, c: str, e: str) -> str:
    return f"SELECT {v.TX_KEYS}, CASE WHEN strand = '-' THEN {c} ELSE {a} END AS start, CASE WHEN strand = '-' THEN {e} ELSE {b} END AS \"end\" FROM spans"


_region("5flank", _at("s - 500", "s", "e", "e + 500"))
_region("3flank", _at("e", "e + 500", "s - 500", "s"))
_region("tss", _at("s - 500", "s + 500", "e - 500", "e + 500"))
_region("tts", _at("e - 500", "e + 500", "s - 500", "s + 500"))
_region("primary", _at("s", "e", "s", "e"))
_region("exons", f'SELECT {v.TX_KEYS}, start, "end" FROM exons')
_region("CDS", f'SELECT {v.TX_KEYS}, start, "end" FROM cds')
_region("introns", "SELECT * FROM introns")
_region("first_exon", f'SELECT {v.TX_KEYS}, start, "end" FROM num WHERE c >= 3 AND i = 1')
_region("last_exon", f'SELECT {v.TX_KEYS}, start, "end" FROM num WHERE c >= 3 AND i = c')
_region("middle_exons", f'SELECT {v.TX_KEYS}, start, "end" FROM num WHERE c >= 3 AND i > 1 AND i < c')
_region("5UTR", "SELECT rest.* FROM rest JOIN lim USING (transcript_id) WHERE CASE WHEN strand = '-' THEN start >= c1 ELSE \"end\" <= c0 END")
_region("3UTR", "SELECT rest.* FROM rest JOIN lim USING (transcript_id) WHERE CASE WHEN strand = '-' THEN \"end\" <= c0 ELSE start >= c1 END")


@query(f'WITH {E}, {M} SELECT transcript_id, max(tx_len) AS tx_len, count(*) AS exons, max(tx_len) FILTER (exon_idx = 0) AS total, max(g_end - g_start) FILTER (exon_idx = 0) AS first_exon FROM tx_map GROUP BY transcript_id')
def transcript_lengths(spark, d):
    first = F.col("exon_idx") == 0
    return co.transcript_map(v.exons(spark, d)).groupBy("transcript_id").agg(F.max("tx_len").alias("tx_len"), F.count("*").alias("exons"), F.max(F.when(first, F.col("tx_len"))).alias("total"), F.max(F.when(first, F.col("g_end") - F.col("g_start"))).alias("first_exon"))


# Metagenes and matrices.

COUNTED = f"""pieces AS (SELECT {v.TX_KEYS}, 'exons' AS region, g_start AS start, g_end AS "end", t_start FROM tx_map
  UNION ALL SELECT {v.TX_KEYS}, CASE WHEN strand = '-' THEN 'flank3' ELSE 'flank5' END, min(g_start) - 100, min(g_start), 0 FROM tx_map GROUP BY {v.TX_KEYS}
  UNION ALL SELECT {v.TX_KEYS}, CASE WHEN strand = '-' THEN 'flank5' ELSE 'flank3' END, max(g_end), max(g_end) + 100, 0 FROM tx_map GROUP BY {v.TX_KEYS}),
counted AS (SELECT i.transcript_id, region, CASE WHEN i.strand = '-' THEN t_start + i."end" - 1 - pos ELSE t_start + pos - i.start END AS base, sum(n)::bigint AS n FROM pooled p JOIN pieces i ON {IN} GROUP BY ALL),
lens AS (SELECT DISTINCT transcript_id, tx_len FROM tx_map)"""


@query(f"{R}, {E}, {M}, {COUNTED} SELECT * FROM counted")
def count_transcript(spark, d):
    return pr.count_transcript(v.pooled(spark, d), v.exons(spark, d), 100)


BINNED = f"""{COUNTED}, binned AS (SELECT transcript_id, region, greatest((base * nb + len - 1) // len - 1, 0)::int AS bin, sum(n)::bigint AS n FROM (SELECT c.*, CASE WHEN region = 'exons' THEN 100 ELSE 10 END AS nb, CASE WHEN region = 'exons' THEN tx_len ELSE 100 END AS len FROM counted c JOIN lens USING (transcript_id)) GROUP BY ALL)"""


@query(f"{R}, {E}, {M}, {BINNED} SELECT region, bin, round(sum(n / t), 6) AS density FROM (SELECT *, sum(n) OVER (PARTITION BY transcript_id) AS t FROM binned) GROUP BY ALL")
def meta_gene(spark, d):
    return pr.meta_gene(v.pooled(spark, d), v.exons(spark, d)).withColumn("density", r6("density"))


@query(f"""{R}, {E}, {M}, {BINNED}, grid AS (SELECT 'exons' AS region, unnest(range(0, 100))::int AS bin UNION ALL SELECT 'flank5', unnest(range(0, 10))::int UNION ALL SELECT 'flank3', unnest(range(0, 10))::int),
f AS (SELECT g.*, t.transcript_id, coalesce(b.n, 0) + 1 AS n FROM grid g CROSS JOIN (SELECT DISTINCT transcript_id FROM binned) t LEFT JOIN binned b ON b.transcript_id = t.transcript_id AND b.region = g.region AND b.bin = g.bin),
m AS (SELECT region, bin, sum(n / s) AS x FROM (SELECT *, sum(n) OVER (PARTITION BY transcript_id) AS s FROM f) GROUP BY ALL) SELECT region, bin, round(x / sum(x) OVER (), 6) AS density FROM m""")
def meta_gene_pseudo_count(spark, d):
    return pr.normalised(pr.meta_gene(v.pooled(spark, d), v.exons(spark, d), pseudo_count=1.0)).withColumn("density", r6("density"))


@query(f"{R}, {E}, {M}, {BINNED} SELECT region, bin, sum(n)::double AS density FROM binned GROUP BY ALL")
def meta_gene_counts(spark, d):
    return pr.meta_gene(v.pooled(spark, d), v.exons(spark, d), row_norm=False)


def _dense(flank: str, place: str) -> str:
    counted = COUNTED.replace("min(g_start) - 100", f"min(g_start) - {flank}").replace("max(g_end) + 100", f"max(g_end) + {flank}")
    return f"""{counted}, found AS (SELECT transcript_id, (floor(x / 25.0) * 25)::int AS bin, sum(n) AS n FROM (SELECT c.*, CASE region WHEN 'flank5' THEN base - {flank.replace("max(tx_len)", "tx_len")} WHEN 'flank3' THEN base + tx_len ELSE base END - {place} AS x FROM counted c JOIN lens USING (transcript_id)) WHERE floor(x / 25.0) * 25 >= -100 AND floor(x / 25.0) * 25 < 300 GROUP BY ALL),
dense AS (SELECT r.transcript_id AS row_id, b::int AS bin, coalesce(n, 0)::double AS value FROM (SELECT DISTINCT transcript_id FROM found) r CROSS JOIN range(-100, 300, 25) t(b) LEFT JOIN found f ON f.transcript_id = r.transcript_id AND f.bin = b)"""


DENSE, DENSE_END = _dense("greatest(100, 300 - max(tx_len))", "0"), _dense("greatest(100 - max(tx_len), 300, 0)", "tx_len")


@query(f"{R}, {E}, {M}, {DENSE} SELECT * FROM dense")
def binding_matrix(spark, d):
    return pr.binding_matrix(v.pooled(spark, d), v.exons(spark, d))


@query(f"{R}, {E}, {M}, {DENSE_END} SELECT * FROM dense")
def binding_matrix_end(spark, d):
    return pr.binding_matrix(v.pooled(spark, d), v.exons(spark, d), align="end")


@query(f"{R.replace('pooled AS (SELECT contig, strand, pos', 'pooled AS (SELECT contig, translate(strand, $$+-$$, $$-+$$) AS strand, pos')}, {E}, {M}, {DENSE} SELECT row_id, -bin AS bin, value FROM dense WHERE -bin BETWEEN -150 AND 50")
def reverse_strand_cropped(spark, d):
    return pr.crop(pr.binding_matrix(v.pooled(spark, d), v.exons(spark, d), reverse=True), -150, 50)


@query(f"WITH {X} SELECT row_id, bin, round(value / greatest((SELECT min(value) FROM matrix WHERE value > 0), quantile_cont(value, 0.99) OVER (PARTITION BY row_id)), 6) AS value FROM matrix")
def quantile_row_norm(spark, d):
    return pr.quantile_row_norm(v.matrix(spark, d)).withColumn("value", r6("value"))


@query(f"WITH {X} SELECT row_id, bin, round(value / nullif(sum(value) OVER (PARTITION BY row_id), 0), 6) AS value FROM matrix")
def sum_row_norm(spark, d):
    return pr.sum_row_norm(v.matrix(spark, d)).withColumn("value", r6("value"))


@query(f"WITH {X} SELECT row_id, greatest(ceil(bin * 10 / 63.0) - 1, 0)::int AS \"group\", round(avg(value), 6) AS value FROM matrix GROUP BY ALL")
def compress_matrix(spark, d):
    return pr.compress_columns(v.matrix(spark, d), 10).withColumn("value", r6("value"))


@query(f"WITH {X} SELECT a.row_id, a.bin, round(a.value / CASE WHEN b.value = 0 THEN (SELECT min(value) FROM matrix WHERE value > 0) ELSE b.value END, 6) AS value FROM matrix a JOIN matrix b ON a.row_id = b.row_id AND b.bin = 63 - a.bin")
def norm_by_matrix(spark, d):
    m = v.matrix(spark, d)
    return pr.norm_by_matrix(m, m.withColumn("bin", 63 - F.col("bin"))).withColumn("value", r6("value"))


@query(f"WITH {X}, k AS (SELECT row_id, sum(value) AS s FROM matrix GROUP BY row_id) SELECT row_id, row_number() OVER (ORDER BY round(s, 6) DESC, row_id) AS place FROM k")
def sorted_matrix(spark, d):
    sums = v.matrix(spark, d).groupBy("row_id").agg(r6(F.sum("value")).alias("s"))
    return with_rank(sums, -coarse(F.col("s")), [F.desc("s"), F.asc("row_id")]).select("row_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {X}, k AS (SELECT row_id, row_number() OVER (ORDER BY row_id DESC) AS place FROM (SELECT DISTINCT row_id FROM matrix)), m AS (SELECT place, bin, value FROM matrix JOIN k USING (row_id)),
c AS (SELECT place, greatest(ceil(bin * 10 / 63.0) - 1, 0)::int AS "group", avg(value) AS value FROM m GROUP BY ALL), n AS (SELECT max(place) AS n FROM k)
SELECT greatest(ceil((place - 1) * 20 / (n - 1)) - 1, 0)::int AS row_group, "group", round("group" * 63 / 10.0 - CASE WHEN "group" = 0 THEN 0.063 ELSE 0 END, 6) AS edge, round(avg(value), 6) AS value FROM c, n GROUP BY ALL""")
def compress_rows(spark, d):
    return pr.compress_matrix(pr.in_order(v.matrix(spark, d)).select("place", "bin", "value"), 20, 10).withColumn("value", r6("value")).withColumn("edge", r6("edge"))


@query(f"""WITH {X}, k AS (SELECT row_id, row_number() OVER (ORDER BY s DESC, row_id) AS place FROM (SELECT row_id, sum(value) AS s FROM matrix GROUP BY row_id)) SELECT place, row_id, bin, round(least(value, 1.0), 6) AS value FROM matrix JOIN k USING (row_id)""")
def heat_map(spark, d):
    return pr.heat_map(v.matrix(spark, d)).withColumn("value", r6("value"))


def _order(name: str, sql: str, column: str) -> None:
    def run(spark, d):
        exons, cds = v.exons(spark, d), v.cds(spark, d)
        lengths = co.transcript_lengths(exons, cds).select(F.col("transcript_id").alias("row_id"), F.col(column).alias("key"))
        return pr.in_order(pr.binding_matrix(v.pooled(spark, d), exons), lengths).select("place", "row_id", "bin", "value")

    run.__name__ = f"rows_by_{name}"
    query(f"{R}, {E}, {C}, {M}, {DENSE}, {SUBTRACT}, {LENGTHS} SELECT place, row_id, bin, value FROM dense JOIN (SELECT row_id, row_number() OVER (ORDER BY {sql} DESC, row_id) AS place FROM (SELECT DISTINCT row_id FROM dense) r LEFT JOIN tx_lengths l ON l.transcript_id = r.row_id) USING (row_id)")(run)


LENGTHS = """ends AS (SELECT transcript_id, min(start) AS c0, max("end") AS c1 FROM cds GROUP BY ALL),
utrs AS (SELECT transcript_id, sum("end" - start) FILTER (CASE WHEN strand = '-' THEN start >= c1 ELSE "end" <= c0 END) AS u5, sum("end" - start) FILTER (CASE WHEN strand = '-' THEN "end" <= c0 ELSE start >= c1 END) AS u3 FROM rest JOIN ends USING (transcript_id) GROUP BY ALL),
firsts AS (SELECT transcript_id, "end" - start AS f FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END) AS i FROM exons) WHERE i = 1),
tx_lengths AS (SELECT transcript_id, t.total, coalesce(u5, 0)::bigint AS utr5, coalesce(u3, 0)::bigint AS utr3, f AS first_exon FROM (SELECT transcript_id, max(tx_len) AS total FROM tx_map GROUP BY ALL) t JOIN firsts USING (transcript_id) LEFT JOIN utrs USING (transcript_id))"""


@query(f"WITH {E}, {C}, {M}, {SUBTRACT}, {LENGTHS} SELECT * FROM tx_lengths")
def transcript_length_table(spark, d):
    return co.transcript_lengths(v.exons(spark, d), v.cds(spark, d))


for _by in ("total", "utr3", "utr5", "first_exon"):
    _order(_by, _by, _by)


@query(f"{R}, {E}, {M}, {DENSE} SELECT place, row_id, bin, value FROM dense JOIN (SELECT row_id, row_number() OVER (ORDER BY row_id DESC) AS place FROM (SELECT DISTINCT row_id FROM dense)) USING (row_id)")
def rows_backwards(spark, d):
    return pr.in_order(pr.binding_matrix(v.pooled(spark, d), v.exons(spark, d))).select("place", "row_id", "bin", "value")


@query(f"{R}, {E}, {M}, {DENSE} SELECT place, row_id, bin, value FROM dense JOIN (SELECT row_id, row_number() OVER (ORDER BY k DESC NULLS LAST, row_id) AS place FROM (SELECT DISTINCT row_id FROM dense) r LEFT JOIN (SELECT s_suppkey AS row_id, s_nationkey AS k FROM supplier) USING (row_id)) USING (row_id)")
def rows_by_given_keys(spark, d):
    keys = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("key"))
    return pr.in_order(pr.binding_matrix(v.pooled(spark, d), v.exons(spark, d)), keys).select("place", "row_id", "bin", "value")


@query(f"WITH {E} SELECT {v.TX_KEYS}, start, \"end\" FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY CASE WHEN strand = '-' THEN start ELSE -start END) AS i FROM exons) WHERE i = 1")
def last_exon_transcript(spark, d):
    return co.last_exon_of_transcript(v.exons(spark, d))


@query(f"WITH {E} SELECT gene_id, contig, strand, min(start) AS start, max(\"end\") AS \"end\", string_agg(DISTINCT start || '-' || \"end\", ',' ORDER BY start || '-' || \"end\") AS exons FROM exons GROUP BY ALL")
def flat_genes(spark, d):
    names = F.array_sort(F.transform("exons", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))))
    return co.flat_genes(v.exons(spark, d)).withColumn("exons", F.array_join(names, ","))


@query(f"WITH {E}, {v.merged('gene_id, contig, strand')} SELECT gene_id AS transcript_id, * FROM merged")
def merged_genes(spark, d):
    return co.merged_genes(v.exons(spark, d))


@query(f"""{R}, {S}, w AS (SELECT CASE WHEN s.strand = '-' THEN p.pos < s.pos ELSE p.pos >= s.pos END AS d, n FROM pooled p JOIN sites s ON p.contig = s.contig AND p.strand = s.strand AND p.pos >= s.pos - 50 AND p.pos < s.pos + 50),
t AS (SELECT coalesce(sum(n) FILTER (d), 0) AS a, coalesce(sum(n) FILTER (NOT d), 0) AS b FROM w) SELECT round(log2(a / greatest(1, b - a)), 6) AS processing_index FROM t""")
def processing_index(spark, d):
    return pr.processing_index(v.pooled(spark, d), v.sites(spark, d)).withColumn("processing_index", r6("processing_index"))


@query(f"""{R}, {E}, {M}, j AS (SELECT transcript_id, t_end AS j FROM tx_map WHERE t_end < tx_len), t AS (SELECT i.transcript_id, {T_OF_G.replace("strand", "i.strand")} AS t, n FROM pooled p JOIN tx_map i ON p.contig = i.contig AND p.strand = i.strand AND pos >= g_start AND pos < g_end),
w AS (SELECT transcript_id, j, t - j + 20 AS base, sum(n) AS n FROM t JOIN j USING (transcript_id) WHERE t >= j - 20 AND t <= j + 10 GROUP BY ALL)
SELECT base, round(sum(n / s), 6) AS density FROM (SELECT *, sum(n) OVER (PARTITION BY transcript_id, j) AS s FROM w) GROUP BY base""")
def junction_meta(spark, d):
    return pr.junction_meta(v.pooled(spark, d), v.exons(spark, d)).withColumn("density", r6("density"))


@query(f"""{R}, o AS (SELECT *, count(*) OVER (PARTITION BY contig, strand, pos) - 1 AS others FROM profile), l AS (SELECT sample, others, unnest(range(1, n + 1)) AS level FROM o)
SELECT sample, f::int AS fold, level, count(*) FILTER (others >= f) AS hits, count(*) AS totals FROM l, (VALUES (1), (2)) t(f) GROUP BY ALL""")
def reproducibility(spark, d):
    return pr.reproducibility(v.profile(spark, d))


@query(f"""{R} SELECT a.sample AS a, b.sample AS b, count(*) AS totals, count(c.pos) AS hits FROM profile a JOIN (SELECT DISTINCT sample FROM profile) b ON a.sample <> b.sample LEFT JOIN profile c ON c.sample = b.sample AND c.contig = a.contig AND c.strand = a.strand AND c.pos = a.pos GROUP BY ALL""")
def pairwise_reproducibility(spark, d):
    p = v.profile(spark, d)
    others = F.broadcast(p.select(F.col("sample").alias("b")).distinct())  # one row for each sample
    pairs = p.select(F.col("sample").alias("a"), "contig", "strand", "pos").join(others, F.col("a") != F.col("b"))
    return pairs.join(p.select(F.col("sample").alias("b"), "contig", "strand", "pos", F.lit(1).alias("hit")), ["b", "contig", "strand", "pos"], "left").groupBy("a", "b").agg(F.count("*").alias("totals"), F.count("hit").alias("hits"))


@query(f"""{R} SELECT f::int AS fold, round(avg(CASE WHEN b.pos IS NULL THEN 0.0 ELSE 1.0 END), 6) AS share FROM profile a JOIN (VALUES (1), (2), (3)) t(f) ON a.n >= f LEFT JOIN profile b ON b.sample = 'R' AND a.contig = b.contig AND a.strand = b.strand AND a.pos = b.pos WHERE a.sample = 'A' GROUP BY f""")
def fold_reproducibility(spark, d):
    p = v.profile(spark, d)
    other = p.where("sample = 'R'").select("contig", "strand", "pos", F.lit(1.0).alias("hit"))
    hit = p.where("sample = 'A'").join(other, ["contig", "strand", "pos"], "left").select(F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.col("n").cast("int")))).alias("fold"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
    return hit.groupBy("fold").agg(r6(F.avg("hit")).alias("share"))


# Smoothing.


@query(f"{R} SELECT contig, strand, q AS pos, sum(n)::bigint AS n FROM (SELECT *, unnest(range(pos - 3, pos + 4)) AS q FROM pooled) GROUP BY ALL")
def spread(spark, d):
    return pr.spread(v.pooled(spark, d), 3, 3)


@query(f"{R} SELECT contig, strand, q AS pos, sum(n)::bigint AS n FROM (SELECT *, unnest(range(pos - 2, pos + 6)) AS q FROM pooled) GROUP BY ALL")
def spread_asym(spark, d):
    return pr.spread(v.pooled(spark, d), 2, 5)


@query(f"{R} SELECT contig, strand, pos, n, (sum(n) OVER (PARTITION BY contig, strand ORDER BY pos RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) - n)::bigint AS window_sum FROM pooled")
def cluster_window_sum(spark, d):
    return pr.window_sums(v.pooled(spark, d), 15, own=False, bin_width=512)


HEIGHTS = """SELECT {k}, h AS height, round(sum(c) OVER (PARTITION BY {k} ORDER BY h DESC ROWS UNBOUNDED PRECEDING) / sum(c) OVER (PARTITION BY {k}), 6) AS p FROM (SELECT {k}, h, sum(l) AS c FROM (
  SELECT {k}, (sum(sum(n)) OVER (PARTITION BY {k} ORDER BY q))::bigint AS h, lead(q) OVER (PARTITION BY {k} ORDER BY q) - q AS l FROM (SELECT {k}, pos - {b} AS q, n FROM {t} UNION ALL SELECT {k}, pos + {b} + 1, -n FROM {t}) GROUP BY {k}, q) WHERE h > 0 GROUP BY ALL)"""


@query(f"{R} {HEIGHTS.format(k='contig, strand', b=5, t='pooled')}")
def height_distribution(spark, d):
    return pr.height_distribution(v.pooled(spark, d), 5).withColumn("p", r6("p"))


# Randomisation and statistics.

HASH = "('0x' || substr(md5({}), 1, 8))::bigint"
INSIDE = f"inside AS (SELECT i.segment_id, i.start, i.\"end\", p.contig, p.strand, p.pos, p.n FROM pooled p JOIN segments i ON {IN})"
DRAWN = f"""drawn AS (SELECT segment_id, rand_id, contig, strand, start + {HASH.format("'42|' || rand_id || '|' || segment_id || '|' || pos || '|' || tag")} % ("end" - start) AS pos, count(*) AS n
  FROM (SELECT *, unnest(range(1, n + 1)) AS tag FROM inside), range(0, {{n}}) t(rand_id) GROUP BY ALL)"""


@query(f"{R}, {E}, {G}, {INSIDE}, {DRAWN.format(n=5)} SELECT * REPLACE (rand_id::int AS rand_id) FROM drawn")
def randomise_tags(spark, d):
    return st.randomise_tags(v.pooled(spark, d), v.segments(spark, d), 5)


@query(f"""{R}, {E}, {G}, {INSIDE}, k AS (SELECT segment_id, count(*) AS k FROM inside GROUP BY 1),
places AS (SELECT segment_id, rand_id, pos, k, row_number() OVER (PARTITION BY segment_id, rand_id ORDER BY {HASH.format("'42|' || rand_id || '|' || segment_id || '|' || pos")}, pos) AS i FROM (SELECT segment_id, k, rand_id, unnest(range(start, "end")) AS pos FROM segments JOIN k USING (segment_id), range(0, 3) t(rand_id))),
s AS (SELECT segment_id, n, row_number() OVER (PARTITION BY segment_id ORDER BY pos) AS i FROM inside)
SELECT p.segment_id, p.rand_id::int AS rand_id, p.pos, s.n FROM places p JOIN s ON p.segment_id = s.segment_id AND p.i = s.i""")
def randomise_sites(spark, d):
    return st.randomise_sites(v.pooled(spark, d), v.segments(spark, d), 3)


def _fdr(columns: str, b: int = 15, n: int = 100) -> str:
    """SQL from `inside` to the rates (fdr) of bases (f2)."""
    plain = lambda k, t: HEIGHTS.format(k=k, b=b, t=t).replace("round(", "(").replace(", 6)", ")")
    return f"""{DRAWN.format(n=n)}, o AS ({plain("segment_id", "inside")}), z AS ({plain("segment_id, rand_id", "drawn")}),
x AS (SELECT o.*, r.rand_id FROM o, range(0, {n}) r(rand_id)), q AS (SELECT x.segment_id, x.height, x.p, coalesce(z.p, 0) AS q FROM x ASOF LEFT JOIN z ON z.segment_id = x.segment_id AND z.rand_id = x.rand_id AND x.height <= z.height),
f AS (SELECT segment_id, height, (avg(q) + stddev_samp(q)) / p AS fdr FROM q GROUP BY segment_id, height, p),
h AS (SELECT {columns}, (sum(n) OVER (PARTITION BY segment_id ORDER BY pos RANGE BETWEEN {b} PRECEDING AND {b} FOLLOWING))::bigint AS height FROM inside), f2 AS (SELECT h.*, f.fdr FROM h JOIN f USING (segment_id, height))"""


@query(f"{R}, {E}, {G}, {INSIDE}, {_fdr('segment_id, pos, n')} SELECT segment_id, pos, n, height, round(fdr, 6) AS fdr FROM f2")
def crosslink_fdr(spark, d):
    return st.crosslink_fdr(v.pooled(spark, d), v.segments(spark, d)).withColumn("fdr", r6("fdr"))


@query(f"""{R}, {E}, {G}, {INSIDE}, {_fdr('segment_id, contig, strand, pos, n')}, b AS (SELECT *, row_number() OVER (PARTITION BY contig, strand, pos ORDER BY round(fdr, 9), n DESC, segment_id) AS i FROM f2 WHERE round(fdr, 9) <= 0.5)
SELECT segment_id, contig, strand, pos, n, height, round(CASE WHEN fdr = 0 THEN 1e9 ELSE -log10(fdr) END, 6) AS score FROM b WHERE i = 1""")
def significant_bases(spark, d):
    rates = st.crosslink_fdr(v.pooled(spark, d), v.segments(spark, d)).withColumn("fdr", F.round("fdr", 9))
    found = rates.join(v.segments(spark, d).select("segment_id", "contig", "strand"), "segment_id")
    # The invented signal is even, so the threshold is wider than the operator's own, and infinite scores are drawn in.
    return st.significant_bases(found, 0.5).withColumn("score", r6(F.least("score", F.lit(1e9)))).drop("fdr")


@query(f"""{R}, {E}, {v.GENE_MAP}, {introns_sql(v.TX_KEYS)}, {v.PLACED}, {_fdr('segment_id, contig, strand, g_pos, pos, n')} SELECT segment_id, contig, strand, g_pos, n, round(coalesce(fdr, 1), 6) AS fdr FROM f2""")
def segment_fdr(spark, d):
    placed = sg.place(v.pooled(spark, d), v.exons(spark, d), "all")
    return sg.on_contig(st.fdr_of_placed(placed), placed).select("segment_id", "contig", "strand", "g_pos", "n", r6(F.coalesce("fdr", F.lit(1.0))).alias("fdr"))


def _tail(k: str, n: str, p: str) -> str:
    return f"CASE WHEN {k} <= 0 THEN 1.0 WHEN {k} > {n} OR {p} <= 0 THEN 0.0 WHEN {p} >= 1 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))) END"


PVALUES = f"""h AS (SELECT *, (sum(n) OVER (PARTITION BY segment_id ORDER BY pos RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) - n)::bigint AS w, (sum(n) OVER (PARTITION BY segment_id))::bigint AS total, "end" - start AS l, (least("end", pos + 15) - greatest(start, pos - 15)) / ("end" - start) AS share FROM inside),
pv AS (SELECT * EXCLUDE (w, total, l, share), {_tail("n - 1", "total", "1.0 / l")} * {_tail("w", "total", "share")} AS p FROM h)"""


@query(f"{R}, {E}, {G}, {INSIDE}, {PVALUES} SELECT segment_id, pos, n, round(p + 1.234e-9, 6) AS p FROM pv")
def binomial_pvalues(spark, d):
    return st.binomial_pvalues(v.pooled(spark, d), v.segments(spark, d)).withColumn("p", p6("p"))


@query(f"""{R}, {E}, {G}, {INSIDE}, {PVALUES}, {v.merged("segment_id", '(SELECT segment_id, pos - 15 AS start, pos + 16 AS "end", p FROM pv WHERE round(p, 9) < 0.05)', "windows", 0, ", min(p) AS p")} SELECT segment_id, start, "end", round(p + 1.234e-9, 6) AS p FROM windows""")
def significance_windows(spark, d):
    found = st.binomial_pvalues(v.pooled(spark, d), v.segments(spark, d)).withColumn("p", F.round("p", 9))
    return st.significance_windows(found, 15).withColumn("p", p6("p"))


def _grouping(name: str, tx_map: str, placed: str) -> None:
    def run(spark, d):
        placed_ = sg.place(v.pooled(spark, d), v.exons(spark, d), name, v.cds(spark, d))
        return st.binomial_of_placed(placed_).withColumn("p", p6("p"))

    run.__name__ = f"binomial_{name}"
    query(f"{R}, {E}, {C}, {tx_map}, {introns_sql(v.TX_KEYS)}, {placed}, {PVALUES} SELECT segment_id, pos, n, round(p + 1.234e-9, 6) AS p FROM pv")(run)


_grouping("exons", v.TX_MAP, v.PLACED)
_grouping("utrs", v.TX_MAP, v.PLACED_PARTS)
_grouping("all", v.GENE_MAP, v.PLACED)


@query(f"{R}, {E}, {v.TX_MAP}, {introns_sql(v.TX_KEYS)}, {v.PLACED}, {PVALUES} SELECT contig, strand, g_pos AS pos, round(min(p) + 1.234e-9, 6) AS p FROM pv GROUP BY ALL")
def least_p_of_bases(spark, d):
    placed = sg.place(v.pooled(spark, d), v.exons(spark, d))
    found = st.binomial_of_placed(placed, keep=("contig", "strand", "g_pos")).select("contig", "strand", F.col("g_pos").alias("pos"), "p")
    return st.bases_output(found).withColumn("p", p6("p"))


@query(f"{R} SELECT contig, strand, pos, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY p DESC)), 6) AS q FROM (SELECT contig, strand, pos, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM (SELECT *, 1.0 / (1 + n * n + pos % 7) AS p FROM pooled WHERE pos >= 0))")
def bh_fdr(spark, d):
    p = v.pooled(spark, d).where("pos >= 0").select("contig", "strand", "pos", (1.0 / (1 + F.col("n") * F.col("n") + F.col("pos") % 7)).alias("p"))
    return st.bh_fdr(p).select("contig", "strand", "pos", r6("p").alias("p"), r6("q").alias("q"))


BOOT = """c AS (SELECT count(*) AS c FROM t), b AS (SELECT r, sum(test) / sum(control) AS x, avg(test) AS m FROM (SELECT r, ('0x' || substr(md5('7|' || r || '|' || i), 1, 8))::bigint % c AS idx FROM c, range(0, 1000) a(r), range(0, (SELECT count(*) FROM t)) k(i)) JOIN t USING (idx) GROUP BY r)
SELECT round((SELECT sum(test) / sum(control) FROM t), 6) AS ratio, round(quantile_cont(x, 0.025), 6) AS lo, round(quantile_cont(x, 0.975), 6) AS hi FROM b"""
RATIOS = "SELECT s_suppkey, s_nationkey AS test, s_suppkey % 17 AS control, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier"


def _ratios(spark, d):
    return v.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("test"), (F.col("s_suppkey") % 17).alias("control"))


def _indexed(rows: DataFrame) -> DataFrame:
    return with_rank(rows, F.floor(F.col("s_suppkey") / 65_536), ["s_suppkey"], "idx", 0)


@query(f"WITH t AS ({RATIOS}), {BOOT}")
def bootstrap_ratio_ci(spark, d):
    return st.bootstrap_ratio(_indexed(_ratios(spark, d))).select(*(r6(c).alias(c) for c in ("ratio", "lo", "hi")))


@query(f"WITH t AS ({RATIOS} WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)), {BOOT}")
def set_enrichment(spark, d):
    members = v.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    inside = v.table(spark, d, "supplier").join(members, "s_nationkey", "left_semi").select("s_suppkey")
    return st.set_enrichment(_ratios(spark, d), inside, "s_suppkey").select(*(r6(c).alias(c) for c in ("ratio", "lo", "hi")))


@query(f"WITH t AS ({RATIOS}), {BOOT.split('SELECT round((SELECT')[0]} SELECT round(quantile_cont(m, 0.05), 6) AS lo, round(quantile_cont(m, 0.95), 6) AS hi FROM b")
def bootstrap_mean_ci(spark, d):
    means = st.bootstrap_statistic(_indexed(_ratios(spark, d)), lambda times: F.sum(F.col("test") * times) / F.sum(times), 1000)
    return st.boot_ci(means, {"lo": 0.05, "hi": 0.95}).select(r6("lo").alias("lo"), r6("hi").alias("hi"))


TWO = f"{R}, {E}, {G}, two AS (SELECT i.segment_id, p.sample, p.pos, p.n FROM profile p JOIN segments i ON {IN}), a AS (SELECT * FROM two WHERE sample = 'A'), b AS (SELECT * FROM two WHERE sample = 'R')"


def _two(spark, d):
    p = iv.join_points(v.profile(spark, d), v.segments(spark, d)).select("segment_id", "sample", "pos", "n")
    return (p.where(F.col("sample") == s).drop("sample") for s in ("A", "R"))


@query(f"{TWO} SELECT segment_id, round(sum(a.n * b.n * abs(a.pos - b.pos)) / sum(a.n * b.n), 6) AS distance FROM a JOIN b USING (segment_id) GROUP BY 1")
def avg_distance(spark, d):
    return st.average_distance(*_two(spark, d), "segment_id").withColumn("distance", r6("distance"))


@query(f"{TWO} SELECT segment_id, round(avg(m), 6) AS distance FROM (SELECT a.segment_id, a.pos, min(abs(a.pos - b.pos)) AS m FROM a JOIN b USING (segment_id) GROUP BY ALL) GROUP BY 1")
def min_distance(spark, d):
    return st.min_distance(*_two(spark, d), "segment_id").withColumn("distance", r6("distance"))


@query(f"""{TWO}, g AS (SELECT segment_id, unnest(range(start, "end")) AS p FROM segments WHERE segment_id IN (SELECT segment_id FROM a INTERSECT SELECT segment_id FROM b)),
x AS (SELECT segment_id, q AS p, sum(n) AS x FROM (SELECT *, unnest(range(pos - 10, pos + 11)) AS q FROM a) GROUP BY ALL), y AS (SELECT segment_id, q AS p, sum(n) AS y FROM (SELECT *, unnest(range(pos - 10, pos + 11)) AS q FROM b) GROUP BY ALL),
f AS (SELECT segment_id, p, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM g LEFT JOIN x USING (segment_id, p) LEFT JOIN y USING (segment_id, p)),
k AS (SELECT *, rank() OVER (PARTITION BY segment_id ORDER BY x) + (count(*) OVER (PARTITION BY segment_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY segment_id ORDER BY y) + (count(*) OVER (PARTITION BY segment_id, y) - 1) / 2 AS ry FROM f)
SELECT segment_id, round(CASE WHEN vx > 0 AND vy > 0 THEN rho END, 6) AS rho FROM (SELECT segment_id, corr(rx, ry) AS rho, var_samp(rx) AS vx, var_samp(ry) AS vy FROM k GROUP BY 1)""")
def corr_profile(spark, d):
    return st.profile_correlation(*_two(spark, d), v.segments(spark, d), 10).withColumn("rho", r6("rho"))


# Sequences.


@query(f"WITH {v.SEQUENCES} SELECT kmer, count(*) AS n, min(start) AS first FROM (SELECT substr(seq, s + 1, 5) AS kmer, s::int AS start FROM (SELECT seq, unnest(range(0, length(seq) - 4)) AS s FROM sequences)) GROUP BY kmer")
def kmer_matches(spark, d):
    return sq.kmer_matches(v.sequences(spark, d), 5).groupBy("kmer").agg(F.count("*").alias("n"), F.min("start").alias("first"))


KMERS = "m AS (SELECT seq_id, substr(seq, s + 1, 4) AS kmer, s AS start FROM (SELECT *, unnest(range(0, length(seq) - 3)) AS s FROM sequences))"


@query(f"WITH {v.SEQ_PROFILE}, {KMERS}, w AS (SELECT seq_id, q AS start, sum(n) AS n FROM (SELECT *, unnest(range(pos - 5, pos + 6)) AS q FROM seq_profile) GROUP BY ALL) SELECT kmer, sum(n)::bigint AS freq FROM m JOIN w USING (seq_id, start) GROUP BY kmer")
def kmer_frequency(spark, d):
    return sq.kmer_frequency(sq.kmer_matches(v.sequences(spark, d), 4), v.seq_profile(spark, d), 5)


def _kmer_z(k: int) -> str:
    """SQL for kmer and z of all k-mers, with windows of 15 and 100 randomisations: how often each start of a sequence is covered comes from edges."""
    runs = "(SELECT {k}seq_id, q AS start, lead(q) OVER w AS e, sum(sum(n)) OVER w AS n FROM (SELECT {k}seq_id, greatest(pos - 15, 0) AS q, n FROM {t} UNION ALL SELECT {k}seq_id, pos + 16, -n FROM {t}) GROUP BY {k}seq_id, q WINDOW w AS (PARTITION BY {k}seq_id ORDER BY q))"
    bases = ", ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) b{i}(x{i})" for i in range(k))
    return f"""{v.SEQ_PROFILE}, m AS (SELECT seq_id, substr(seq, s + 1, {k}) AS kmer, s AS start FROM (SELECT *, unnest(range(0, length(seq) - {k - 1})) AS s FROM sequences)),
o AS (SELECT kmer, sum(n) AS f FROM m JOIN (SELECT seq_id, unnest(range(start, e)) AS start, n FROM {runs.format(k="", t="seq_profile")} WHERE n > 0) USING (seq_id, start) GROUP BY kmer),
t AS (SELECT seq_id, length(seq) AS l, pos, r, unnest(range(1, n + 1)) AS tag FROM seq_profile JOIN sequences USING (seq_id), range(0, 100) x(r)),
dr AS (SELECT seq_id, r, {HASH.format("'42|' || r || '|' || seq_id || '|' || pos || '|' || tag")} % l AS pos, count(*) AS n FROM t GROUP BY ALL),
fr AS (SELECT r, kmer, sum(n) AS f FROM m JOIN (SELECT r, seq_id, unnest(range(start, e)) AS start, n FROM {runs.format(k="r, ", t="dr")} WHERE n > 0) USING (seq_id, start) GROUP BY ALL),
sr AS (SELECT kmer, f / sum(f) OVER (PARTITION BY r) AS s FROM fr), mo AS (SELECT kmer, sum(s) / 100 AS mean, sum(s * s) AS s2 FROM sr GROUP BY kmer), universe AS (SELECT {" || ".join(f"x{i}" for i in range(k))} AS kmer FROM {bases}),
z AS (SELECT kmer, (coalesce(f, 0) / (SELECT sum(f) FROM o) - coalesce(mean, 0)) / nullif(sqrt(greatest((coalesce(s2, 0) - 100 * coalesce(mean, 0) * coalesce(mean, 0)) / 99, 0)), 0) AS z FROM universe LEFT JOIN o USING (kmer) LEFT JOIN mo USING (kmer))"""


@query(f"WITH {_kmer_z(5)} SELECT kmer, round(z, 4) AS z FROM z")
def kmer_enrichment(spark, d):
    return sq.kmer_enrichment(v.sequences(spark, d), v.seq_profile(spark, d)).withColumn("z", F.round("z", 4))


@query("WITH " + " SELECT 'all' AS profile, 2 AS k, kmer, round(z, 4) AS z FROM z UNION ALL SELECT * FROM (WITH ".join([_kmer_z(2), _kmer_z(3)]) + " SELECT 'all', 3, kmer, round(z, 4) FROM z)")
def kmer_enrichment_several(spark, d):
    return sq.kmer_enrichments(v.sequences(spark, d), {"all": v.seq_profile(spark, d)}, [2, 3]).withColumn("z", F.round("z", 4))


@query(f"SELECT {' || '.join(f'x{i}' for i in range(6))} AS kmer FROM " + ", ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) b{i}(x{i})" for i in range(6)))
def kmer_universe(spark, d):
    return sq.kmer_universe(spark, 6).select("kmer")


@query(f"""WITH {E}, {v.merged(v.TX_KEYS)}, {introns_sql(v.TX_KEYS)}, {v.GENOME}, parts AS (SELECT *, 'exon' AS kind, -1 AS o FROM merged UNION ALL SELECT *, 'intron', start FROM introns),
j AS (SELECT transcript_id, strand, kind, o, string_agg(base, '' ORDER BY i) AS seq FROM parts p JOIN genome g ON g.contig = p.contig AND g.i >= p.start AND g.i < p."end" GROUP BY ALL)
SELECT transcript_id, kind, CASE WHEN o >= 0 THEN o END AS start, CASE WHEN strand = '-' THEN reverse(translate(seq, 'ATGCN', 'TACGN')) ELSE seq END AS seq FROM j""")
def segment_sequences(spark, d):
    return sq.segment_sequences(v.genome(spark, d), iv.merge(v.exons(spark, d), co.TX), iv.gaps(v.exons(spark, d), co.TX))


@query(f"""WITH {S}, {E}, {v.GENOME} SELECT s.id, s.contig, s.pos AS start, s.pos + 70 AS "end", string_agg(base, '' ORDER BY i) AS seq FROM sites s JOIN genome g ON g.contig = s.contig AND g.i >= s.pos AND g.i < s.pos + 70 GROUP BY ALL""")
def fetch_sequence(spark, d):
    return sq.fetch(v.genome(spark, d), v.sites(spark, d).select("id", "contig", F.col("pos").alias("start"), (F.col("pos") + 70).alias("end")))


@query(f"WITH {v.SEQUENCES} SELECT seq_id, reverse(translate(seq, 'ATGCN', 'TACGN')) AS rc, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 6) AS gc FROM sequences")
def reverse_complement_gc(spark, d):
    return v.sequences(spark, d).select("seq_id", reverse_complement(F.col("seq")).alias("rc"), r6(F.length(F.regexp_replace("seq", "[^GC]", "")) / F.length("seq")).alias("gc"))


# What else the workflow asks for.


@query(f"{R}, {S} SELECT s.id, p.pos - s.pos + 30 AS base, sum(n)::bigint AS n FROM pooled p JOIN sites s ON p.contig = s.contig AND p.strand = s.strand AND p.pos >= s.pos - 30 AND p.pos <= s.pos + 20 GROUP BY ALL")
def get_window(spark, d):
    return pr.window_around(v.pooled(spark, d), v.sites(spark, d), 30, 20)


@query(f"{R}, {E}, {M}, {BINNED.replace('- 100', '- ceil(max(tx_len) * 0.1)::bigint').replace('+ 100', '+ ceil(max(tx_len) * 0.1)::bigint').replace('ELSE 100 END AS len', 'ELSE ceil(tx_len * 0.1)::bigint END AS len')} SELECT region, bin, round(sum(n / t), 6) AS density FROM (SELECT *, sum(n) OVER (PARTITION BY transcript_id) AS t FROM binned) GROUP BY ALL")
def meta_gene_scaled_flanks(spark, d):
    return pr.meta_gene(v.pooled(spark, d), v.exons(spark, d), flank=0.1).withColumn("density", r6("density"))


INTRON_MAP = (v.merged(v.TX_KEYS) + ", " + introns_sql(v.TX_KEYS) + ", " + v.TX_MAP.split(", tx_map AS", 1)[1].join(["tx_map AS", ""]).replace("FROM merged", "FROM introns"))


@query(f"""{R}, {E}, {INTRON_MAP}, c AS (SELECT i.transcript_id, tx_len, {T_OF_G.replace("strand", "i.strand")} AS t, sum(n) AS n FROM pooled p JOIN tx_map i ON p.contig = i.contig AND p.strand = i.strand AND pos >= g_start AND pos < g_end GROUP BY ALL),
b AS (SELECT transcript_id, greatest((t * 100 + tx_len - 1) // tx_len - 1, 0)::int AS bin, sum(n) AS n FROM c GROUP BY ALL)
SELECT 'exons' AS region, bin, round(sum(n / s), 6) AS density FROM (SELECT *, sum(n) OVER (PARTITION BY transcript_id) AS s FROM b) GROUP BY bin""")
def intron_meta(spark, d):
    return pr.meta_gene(v.pooled(spark, d), co.region(v.exons(spark, d), "introns"), flank=0, bins=(0, 100, 0)).withColumn("density", r6("density"))


REGION_PARTS = f"""lim AS (SELECT transcript_id, min(start) AS c0, max("end") AS c1 FROM cds GROUP BY ALL), {v.merged(v.TX_KEYS, "cds", "cds_merged")},
parts AS (SELECT *, 'CDS' AS region, 100 AS nb FROM cds_merged UNION ALL SELECT rest.*, CASE WHEN (strand = '-') = (start >= c1) THEN '5UTR' ELSE '3UTR' END, CASE WHEN (strand = '-') = (start >= c1) THEN 20 ELSE 70 END FROM rest JOIN lim USING (transcript_id) WHERE "end" <= c0 OR start >= c1),
pm AS (SELECT *, (sum("end" - start) OVER w - ("end" - start))::bigint AS t_start, (sum("end" - start) OVER (PARTITION BY transcript_id, region))::bigint AS tx_len FROM parts WINDOW w AS (PARTITION BY transcript_id, region ORDER BY CASE WHEN strand = '-' THEN -start ELSE start END ROWS UNBOUNDED PRECEDING))"""


@query(f"""{R}, {E}, {C}, {SUBTRACT}, {REGION_PARTS}, h AS (SELECT region, nb, tx_len, n, CASE WHEN i.strand = '-' THEN t_start + i."end" - 1 - pos ELSE t_start + pos - i.start END AS t FROM pooled p JOIN pm i ON {IN})
SELECT region, greatest((t * nb + tx_len - 1) // tx_len - 1, 0)::int AS bin, round(sum(n * nb / tx_len), 6) AS density FROM h GROUP BY ALL""")
def region_meta(spark, d):
    exons, cds = v.exons(spark, d), v.cds(spark, d)
    regions = [(name, bins, co.region(exons, name, cds)) for name, bins in (("5UTR", 20), ("CDS", 100), ("3UTR", 70))]
    return pr.region_meta(v.pooled(spark, d), regions).withColumn("density", r6("density"))


@query(f"""WITH {E}, named AS (SELECT contig, start, "end", CASE WHEN e < 4 THEN 'early' ELSE 'late' END AS name FROM exons), {v.merged("contig, name", "named")},
free AS (SELECT contig, unnest(range(0, 2500)) AS p FROM (SELECT DISTINCT contig FROM exons) EXCEPT SELECT contig, unnest(range(start, "end")) FROM named)
SELECT contig, start, "end", name FROM merged UNION ALL SELECT contig, min(p), max(p) + 1, 'none' FROM (SELECT *, p - row_number() OVER (PARTITION BY contig ORDER BY p) AS i FROM free) GROUP BY contig, i""")
def context_bed(spark, d):
    e = v.exons(spark, d)
    named = e.select("contig", "start", "end", F.expr("if(e < 4, 'early', 'late')").alias("name"))
    return iv.contexts(named, e.select("contig").distinct().withColumn("length", F.lit(2500).cast("long")))


@query(f"WITH {v.SEQUENCES} SELECT seq_id, seq[1:1] || seq[4:5] AS umi, seq[2:3] AS barcode, length(seq) - 5 AS rest, regexp_replace('r' || seq_id || '_' || seq[1:3], '_([ACGT]+)$', ':\\1') AS name FROM sequences")
def umi_extract(spark, d):
    umi, barcode, rest = split_barcode(F.col("seq"), "NXXNN")
    name = rewrite_name(F.concat(F.lit("r"), F.col("seq_id").cast("string"), F.lit("_"), F.substring("seq", 1, 3)), "_([ACGT]+)$", ":$1")
    return v.sequences(spark, d).select("seq_id", umi.alias("umi"), barcode.alias("barcode"), F.length(rest).cast("long").alias("rest"), name.alias("name"))


def _places(tags: str, n: int) -> str:
    return f"SELECT segment_id, r, start + {HASH.format(chr(39) + '42|' + chr(39) + ' || r || ' + chr(39) + '|' + chr(39) + ' || segment_id || ' + chr(39) + '|' + chr(39) + ' || pos || ' + chr(39) + '|' + chr(39) + ' || tag')} % (\"end\" - start) AS pos, count(*) AS n FROM (SELECT *, unnest(range(1, n + 1)) AS tag FROM {tags}), range(0, {n}) t(r) GROUP BY ALL"


@query(f"""{TWO.replace("SELECT i.segment_id, p.sample", 'SELECT i.segment_id, i.start, i."end", p.sample')}, dr AS ({_places("a", 100)}), o AS (SELECT segment_id, sum(a.n * b.n * abs(a.pos - b.pos)) / sum(a.n * b.n) AS distance FROM a JOIN b USING (segment_id) GROUP BY 1),
x AS (SELECT segment_id, r, sum(dr.n * b.n * abs(dr.pos - b.pos)) / sum(dr.n * b.n) AS x FROM dr JOIN b USING (segment_id) GROUP BY ALL), mo AS (SELECT segment_id, avg(x) AS mean, stddev_samp(x) AS sd FROM x GROUP BY 1)
SELECT segment_id, round(distance, 6) AS distance, round((distance - mean) / nullif(sd, 0), 6) AS z FROM o JOIN mo USING (segment_id)""")
def exon_reproducibility_z(spark, d):
    p = v.profile(spark, d)
    a, b = (p.where(F.col("sample") == s).drop("sample") for s in ("A", "R"))
    return st.reproducibility_z(a, b, v.segments(spark, d), 100).select("segment_id", r6("distance").alias("distance"), r6("z").alias("z"))


@query(f"""{R}, {E}, {v.TX_MAP}, {introns_sql(v.TX_KEYS)}, {v.PLACED}, {PVALUES}, g AS (SELECT gene_id, pv.contig, pv.strand, g_pos AS pos, round(avg(p) + 1.234e-9, 6) AS p FROM pv JOIN (SELECT DISTINCT transcript_id, gene_id FROM exons) e ON e.transcript_id = split_part(segment_id, '|', 1)::bigint GROUP BY ALL)
SELECT gene_id, contig, strand, pos, p, round(least(1.0, min(p * m / r) OVER (ORDER BY p DESC)), 6) AS q FROM (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS r FROM g)""")
def binomial_bh(spark, d):
    exons = v.exons(spark, d)
    placed = sg.place(v.pooled(spark, d), exons)
    found = st.binomial_of_placed(placed, keep=("contig", "strand", "g_pos")).withColumn("transcript_id", F.substring_index("segment_id", "|", 1).cast("long"))
    found = found.join(exons.select("transcript_id", "gene_id").distinct(), "transcript_id").select("gene_id", "contig", "strand", F.col("g_pos").alias("pos"), "p")
    return st.bh_fdr(st.gene_averages(found, ["gene_id", "contig", "strand", "pos"]).withColumn("p", p6("p"))).withColumn("q", r6("q"))


@query(f"WITH {v.FRAGMENTS} SELECT sample, CASE WHEN is_paired AND length >= 20 THEN abs(tlen) - greatest(0, aligned - length) ELSE length END AS length, count(*) AS n FROM fragments WHERE NOT is_read2 AND NOT mate_unmapped GROUP BY ALL")
def paired_fragment_lengths(spark, d):
    length = fragment_length(F.col("length"), F.col("aligned"), F.col("is_paired"), F.col("tlen"), 20)
    return v.fragments(spark, d).where("not is_read2 and not mate_unmapped").groupBy("sample", length.alias("length")).agg(F.count("*").alias("n"))


@query(f"{R}, {CLUSTERS} SELECT count(*) AS clusters, sum(bases)::bigint AS bases FROM clusters")
def cluster_counts(spark, d):
    return iv.cluster_counts(iv.clusters(v.pooled(spark, d).where("n >= 3"), 5))


@query(f"""WITH {E}, named AS (SELECT contig, start, "end", CASE WHEN e < 4 THEN 'early' ELSE 'late' END AS name FROM exons), {v.merged("contig, name", "named")}
SELECT name, count(*) AS intervals, sum("end" - start)::bigint AS bases, min("end" - start) AS shortest, max("end" - start) AS longest, round(avg("end" - start), 6) AS mean FROM merged GROUP BY name""")
def context_lengths(spark, d):
    named = v.exons(spark, d).select("contig", "start", "end", F.expr("if(e < 4, 'early', 'late')").alias("name"))
    return iv.context_lengths(iv.merge(named, ("contig", "name"))).withColumn("mean", r6("mean"))


@query(f"""WITH {v.SEQUENCES}, {v.SAMPLES}, r AS (SELECT seq_id, seq, CASE WHEN seq_id % 2 = 0 THEN 'L1' ELSE 'L2' END AS lane FROM sequences)
SELECT track, seq_id, seq[1:1] || seq[4:5] AS umi, length(seq) - 5 AS rest FROM r JOIN samples s ON s.barcode = seq[2:3] AND s.lane = r.lane""")
def demultiplexed(spark, d):
    lanes = v.sequences(spark, d).withColumn("lane", F.expr("if(seq_id % 2 = 0, 'L1', 'L2')"))
    return demultiplex(lanes, v.samples(spark, d)).select("track", "seq_id", "umi", F.length("rest").cast("long").alias("rest"))


@query(f"""WITH {v.SAMPLES} SELECT track, concat_ws(chr(10), '    track ' || track, '    parent all', '    bigDataUrl ' || track || '.bw', '    shortLabel ' || track, '    longLabel ' || track || ' +', '    color 0,0,0', '    type bigWig') AS stanza FROM (SELECT DISTINCT track FROM samples)""")
def track_hub_text(spark, d):
    tracks = v.samples(spark, d).select("track").distinct().select("track", F.concat("track", F.lit(".bw")).alias("url"), F.lit("+").alias("strand"), F.lit("0,0,0").alias("colour"))
    return track_hub(tracks, "all")


@query(f"""{R}, {E}, {C}, {SUBTRACT}, {REGION_PARTS}, h AS (SELECT region, nb, i.transcript_id, tx_len, n, CASE WHEN i.strand = '-' THEN t_start + i."end" - 1 - pos ELSE t_start + pos - i.start END AS t FROM pooled p JOIN pm i ON {IN}),
k AS (SELECT transcript_id, region, greatest((t * nb + tx_len - 1) // tx_len - 1, 0)::int AS bin, sum(n) AS x FROM h GROUP BY ALL), lens AS (SELECT DISTINCT transcript_id, region, nb FROM pm), grid AS (SELECT transcript_id, region, unnest(range(0, nb))::int AS bin FROM lens WHERE transcript_id IN (SELECT transcript_id FROM k)),
f AS (SELECT g.*, coalesce(x, 0) + 1 AS x FROM grid g LEFT JOIN k USING (transcript_id, region, bin)), y AS (SELECT region, bin, sum(x / s) AS density FROM (SELECT *, sum(x) OVER (PARTITION BY transcript_id) AS s FROM f) GROUP BY ALL)
SELECT region, bin, round(density / sum(density) OVER (), 6) AS density FROM y""")
def region_meta_normalised(spark, d):
    exons, cds = v.exons(spark, d), v.cds(spark, d)
    regions = [(name, bins, co.region(exons, name, cds)) for name, bins in (("5UTR", 20), ("CDS", 100), ("3UTR", 70))]
    return pr.normalised(pr.region_meta(v.pooled(spark, d), regions, length_norm=False, row_norm=True, pseudo_count=1.0)).withColumn("density", r6("density"))
