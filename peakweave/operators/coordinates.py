"""Transcript coordinates: maps, conversions both ways, regions of transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import gaps, merge, merged_in_order, subtract

TX = ("transcript_id", "gene_id", "contig", "strand")


def transcript_map(exons: DataFrame, introns: bool = False) -> DataFrame:
    """One row for each exon (or intron) in transcript order, with its place in transcript coordinates."""
    parts = gaps(exons, TX).withColumn("_nth", F.col("start")) if introns else merged_in_order(exons, TX)
    # Both strands are summed up in the order of the sequence that they are sorted in; a minus strand counts from its far end.
    w, whole, minus = Window.partitionBy(*TX).orderBy("_nth"), Window.partitionBy(*TX), F.col("strand") == "-"
    length = F.col("end") - F.col("start")
    placed = parts.select(*TX, "start", "end", F.row_number().over(w).alias("_i"), F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_sum"), F.count("*").over(whole).cast("int").alias("_n"), F.sum(length).over(whole).alias("tx_len"))
    before = F.when(minus, F.col("tx_len") - F.col("_sum")).otherwise(F.col("_sum") - length)
    return placed.select(*TX, F.when(minus, F.col("_n") - F.col("_i")).otherwise(F.col("_i") - 1).alias("exon_idx"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), before.alias("t_start"), (before + length).alias("t_end"), "tx_len")


def _t_of_g(g):
    return F.when(F.col("strand") == "-", F.col("t_start") + F.col("g_end") - 1 - g).otherwise(F.col("t_start") + g - F.col("g_start"))


def _g_of_t(t):
    return F.when(F.col("strand") == "-", F.col("g_end") - 1 - (t - F.col("t_start"))).otherwise(F.col("g_start") + t - F.col("t_start"))


def genome_to_transcript(points: DataFrame, tx_map: DataFrame) -> DataFrame:
    """(transcript_id, pos) to t_pos; positions outside of exons are dropped."""
    return points.join(tx_map, "transcript_id").where("pos >= g_start and pos < g_end").withColumn("t_pos", _t_of_g(F.col("pos")))


def transcript_to_genome(points: DataFrame, tx_map: DataFrame) -> DataFrame:
    """(transcript_id, t_pos) to pos; positions beyond the transcript are dropped."""
    return points.join(tx_map, "transcript_id").where("t_pos >= t_start and t_pos < t_end").withColumn("pos", _g_of_t(F.col("t_pos")))


def transcript_interval_to_genome(intervals: DataFrame, tx_map: DataFrame) -> DataFrame:
    """(transcript_id, ts, te) to the genome intervals that it covers, one for each exon."""
    both = intervals.join(tx_map, "transcript_id").where("ts < t_end and te > t_start")
    a, b = _g_of_t(F.greatest("ts", "t_start")), _g_of_t(F.least("te", "t_end") - 1)
    return both.withColumn("start", F.least(a, b)).withColumn("end", F.greatest(a, b) + 1)


def genome_interval_to_transcript(intervals: DataFrame, tx_map: DataFrame) -> DataFrame:
    """(transcript_id, start, end) to (ts, te); both ends must lie in exons."""
    ends = intervals.select("transcript_id", "start", "end", F.explode(F.array(F.col("start"), F.col("end") - 1)).alias("pos"))
    t = genome_to_transcript(ends, tx_map).groupBy("transcript_id", "start", "end").agg(F.min("t_pos").alias("ts"), (F.max("t_pos") + 1).alias("te"), F.count("*").alias("c"))
    return t.where(F.when(F.col("end") - F.col("start") == 1, F.col("c") >= 1).otherwise(F.col("c") >= 2)).drop("c")


def spans(exons: DataFrame) -> DataFrame:
    return exons.groupBy(*TX).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _at(df: DataFrame, a: Column, b: Column, c: Column, d: Column) -> DataFrame:
    """Intervals [a, b) of a plus strand and [c, d) of a minus strand; sequences without a strand are read as plus."""
    minus = F.col("strand") == "-"
    return df.select(*TX, F.when(minus, c).otherwise(a).alias("start"), F.when(minus, d).otherwise(b).alias("end"))


def _numbered(exons: DataFrame) -> DataFrame:
    """Exons with their number in transcript order and how many there are."""
    w = Window.partitionBy(*TX)
    by = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    return exons.withColumn("_i", F.row_number().over(w.orderBy(by, "end"))).withColumn("_n", F.count("*").over(w))


def _which(exons: DataFrame, which: str) -> DataFrame:
    return _numbered(exons).where("_n >= 3").where(which).select(*TX, "start", "end")


def _utr(exons: DataFrame, cds: DataFrame, five: bool) -> DataFrame:
    limits = cds.groupBy("transcript_id").agg(F.min("start").alias("c0"), F.max("end").alias("c1"))
    rest = subtract(exons.select(*TX, "start", "end"), cds.select(*TX, "start", "end"), TX).join(limits.hint("merge"), "transcript_id")  # grows with the transcripts, so it is never broadcast
    before, after = F.col("end") <= F.col("c0"), F.col("start") >= F.col("c1")
    minus = F.col("strand") == "-"
    return rest.where(F.when(minus, after if five else before).otherwise(before if five else after)).select(*TX, "start", "end")


_S, _E = "start", "end"
#: Named regions: functions of exons, coding parts, and the lengths before and after a place.
REGIONS: dict[str, Callable[[DataFrame, DataFrame | None, int, int], DataFrame]] = {
    "5flank": lambda x, cds, up, down: _at(spans(x), F.col(_S) - up, F.col(_S), F.col(_E), F.col(_E) + up),
    "3flank": lambda x, cds, up, down: _at(spans(x), F.col(_E), F.col(_E) + up, F.col(_S) - up, F.col(_S)),
    "tss": lambda x, cds, up, down: _at(spans(x), F.col(_S) - up, F.col(_S) + down, F.col(_E) - down, F.col(_E) + up),
    "tts": lambda x, cds, up, down: _at(spans(x), F.col(_E) - up, F.col(_E) + down, F.col(_S) - down, F.col(_S) + up),
    "primary": lambda x, cds, up, down: spans(x),
    "exons": lambda x, cds, up, down: x.select(*TX, _S, _E),
    "introns": lambda x, cds, up, down: gaps(x, TX),
    "first_exon": lambda x, cds, up, down: _which(x, "_i = 1"),
    "last_exon": lambda x, cds, up, down: _which(x, "_i = _n"),
    "middle_exons": lambda x, cds, up, down: _which(x, "_i > 1 and _i < _n"),
    "CDS": lambda x, cds, up, down: cds.select(*TX, _S, _E),
    "5UTR": lambda x, cds, up, down: _utr(x, cds, True),
    "3UTR": lambda x, cds, up, down: _utr(x, cds, False),
}


def register_region(name: str, make: Callable[[DataFrame, DataFrame | None, int, int], DataFrame]) -> None:
    """Adds a region of one's own, a function of exons, coding parts, up and down."""
    REGIONS[name] = make


def region(exons: DataFrame, name: str, cds: DataFrame | None = None, up: int = 500, down: int = 500) -> DataFrame:
    """The intervals of a named region of every transcript."""
    if name not in REGIONS:
        raise ValueError(f"no region {name}")
    return REGIONS[name](exons, cds, up, down)


def last_exon_of_transcript(exons: DataFrame) -> DataFrame:
    """The last exon of every transcript, however many it has."""
    return _numbered(exons).where("_i = _n").select(*TX, "start", "end")


def transcript_lengths(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """(transcript_id, total, utr5, utr3, first_exon): bases in all exons, in the untranslated parts (0 without one) and in the first exon."""
    size = lambda df, name: df.groupBy("transcript_id").agg(F.sum(F.col("end") - F.col("start")).alias(name))
    out = size(merge(exons, TX), "total")
    for part, name in ((_utr(exons, cds, True), "utr5"), (_utr(exons, cds, False), "utr3"), (_numbered(exons).where("_i = 1"), "first_exon")):
        out = out.join(size(part, name).hint("merge"), "transcript_id", "left")
    return out.select("transcript_id", "total", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("utr5", "utr3", "first_exon")))


def merged_genes(exons: DataFrame) -> DataFrame:
    """The union of a gene's exons over all its transcripts, as one transcript for each gene and strand."""
    return merge(exons, ("gene_id", "contig", "strand")).select(F.col("gene_id").alias("transcript_id"), "gene_id", "contig", "strand", "start", "end")


def flat_genes(exons: DataFrame) -> DataFrame:
    """One row for each gene: its contig, strand, span, and exons (start, end) in order, of all transcripts."""
    return exons.groupBy("gene_id", "contig", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("exons"))
