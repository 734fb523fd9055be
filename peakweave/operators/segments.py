"""Segments for tests of signal: spliced exons, their coding and untranslated parts, and introns.

A segment's bases are numbered along the transcript, so signal on both sides of
an intron is next to each other.  Signal that has its segment ("placed") has
segment_id, contig, strand, start, end, pos (in the segment), n and g_pos (on the
contig).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coordinates import TX, merged_genes, transcript_map
from .intervals import gaps, join_signal, laid_out

COLUMNS = ("segment_id", "contig", "strand", "start", "end", "pos", "n", "g_pos")


def _name(kind: str | Column, *more: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws("|", F.col("transcript_id").cast("string"), kind, *(x.cast("string") for x in more))


def place_spliced(profile: DataFrame, exons: DataFrame, cds: DataFrame | None = None) -> DataFrame:
    """Signal in the exons of each transcript, which are one segment; with coding parts up to three: before, in and after them."""
    tx_map = transcript_map(exons).withColumnsRenamed({"g_start": "start", "g_end": "end"}).drop("gene_id")
    hit = laid_out(join_signal(profile, tx_map))
    t = F.when(F.col("strand") == "-", F.col("t_start") + F.col("end") - 1 - F.col("pos")).otherwise(F.col("t_start") + F.col("pos") - F.col("start"))
    hit = hit.select("transcript_id", "contig", "strand", "tx_len", t.alias("t"), "n", F.col("pos").alias("g_pos"))
    if cds is None:
        return hit.select(_name("exon").alias("segment_id"), "contig", "strand", F.lit(0).cast("long").alias("start"), F.col("tx_len").alias("end"), F.col("t").alias("pos"), "n", "g_pos")
    coding = _coding_span(exons, cds)
    hit = hit.join(coding, "transcript_id", "left")
    part = F.when(F.col("c0").isNull(), "exon").when(F.col("t") < F.col("c0"), "5UTR").when(F.col("t") < F.col("c1"), "CDS").otherwise("3UTR")
    zero = F.lit(0).cast("long")
    start = F.when(part == "CDS", F.col("c0")).when(part == "3UTR", F.col("c1")).otherwise(zero)
    end = F.when(part == "5UTR", F.col("c0")).when(part == "CDS", F.col("c1")).otherwise(F.col("tx_len"))
    return hit.select(_name(part).alias("segment_id"), "contig", "strand", start.alias("start"), end.alias("end"), F.col("t").alias("pos"), "n", "g_pos")


def _coding_span(exons: DataFrame, cds: DataFrame) -> DataFrame:
    """(transcript_id, c0, c1): where the coding part begins and ends in transcript coordinates."""
    tx_map = transcript_map(exons).select("transcript_id", "strand", "g_start", "g_end", "t_start")
    ends = cds.groupBy("transcript_id").agg(F.min("start").alias("a"), F.max("end").alias("b")).select("transcript_id", F.explode(F.array(F.col("a"), F.col("b") - 1)).alias("g"))
    at = ends.join(tx_map, "transcript_id").where("g >= g_start and g < g_end")
    t = F.when(F.col("strand") == "-", F.col("t_start") + F.col("g_end") - 1 - F.col("g")).otherwise(F.col("t_start") + F.col("g") - F.col("g_start"))
    return at.groupBy("transcript_id").agg(F.min(t).alias("c0"), (F.max(t) + 1).alias("c1"))


def place_introns(profile: DataFrame, exons: DataFrame) -> DataFrame:
    """Signal in introns, each a segment of its own, numbered from its start on the contig."""
    hit = laid_out(join_signal(profile, gaps(exons, TX).drop("gene_id")))
    return hit.select(_name("intron", F.col("start")).alias("segment_id"), "contig", "strand", "start", "end", "pos", "n", F.col("pos").alias("g_pos"))


def place(profile: DataFrame, exons: DataFrame, grouping: str = "exons", cds: DataFrame | None = None) -> DataFrame:
    """Signal in segments.  grouping: "exons" (each transcript's exons), "utrs" (their coding and untranslated parts) or "all" (the exons of all transcripts of a gene); introns are always segments of their own."""
    if grouping == "all":
        exons = merged_genes(exons)
    elif grouping not in ("exons", "utrs"):
        raise ValueError(f"no grouping {grouping}")
    spliced = place_spliced(profile, exons, cds if grouping == "utrs" else None)
    return spliced.select(*COLUMNS).unionByName(place_introns(profile, exons).select(*COLUMNS))


def on_contig(found: DataFrame, placed: DataFrame) -> DataFrame:
    """Results by segment and place (segment_id, pos and others) with contig, strand and g_pos."""
    return found.join(placed.select("segment_id", "pos", "contig", "strand", "g_pos"), ["segment_id", "pos"])
