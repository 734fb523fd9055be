"""Writers of positional file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("nullValue", "NA").option("header", header).csv(path)


def write_bedgraph(profile: DataFrame, contigs: DataFrame, path: str) -> None:
    """A folder for each strand under path (plus, minus): contig, pos, pos + 1, value.  Edges of a sequence are left out; minus values are negative."""
    inside = profile.join(contigs, "contig").where("pos > 0 and pos < length - 1")
    for name, strand, value in (("plus", "+", F.col("n")), ("minus", "-", -F.col("n"))):
        _tsv(inside.where(F.col("strand") == strand).select("contig", "pos", F.col("pos") + 1, value).sort("contig", "pos"), f"{path}/{name}")


def write_bed6(profile: DataFrame, path: str) -> None:
    _tsv(profile.where("n > 0").select("contig", "pos", F.col("pos") + 1, F.lit("."), "n", "strand").sort("contig", "pos"), path)


def write_bins(bins: DataFrame, width: int, path: str) -> None:
    """Binned counts (contig, strand, bin, n) as BED."""
    _tsv(bins.sort("contig", "bin", "strand").select("contig", F.col("bin") * width, (F.col("bin") + 1) * width, F.lit("."), "n", "strand"), path)


def bed12(blocks: DataFrame) -> DataFrame:
    """One BED12 row for each id from its blocks (id, contig, strand, start, end, p): block count, sizes and starts; the score is the least p."""
    b = blocks.groupBy("id", "contig", "strand").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min("p").alias("score"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("b"))
    sizes = F.array_join(F.transform("b", lambda x: (x["end"] - x["start"]).cast("string")), ",")
    starts = F.array_join(F.transform("b", lambda x: (x["start"] - F.col("s")).cast("string")), ",")
    return b.select("contig", F.col("s").alias("start"), F.col("e").alias("end"), "id", "score", "strand", F.col("s").alias("thick_start"), F.col("e").alias("thick_end"), F.lit("0,0,0").alias("rgb"), F.size("b").alias("block_count"), sizes.alias("block_sizes"), starts.alias("block_starts"))


def write_bed12(blocks: DataFrame, path: str) -> None:
    _tsv(bed12(blocks).sort("contig", "start"), path)


def write_significant(bases: DataFrame, path: str) -> None:
    """contig, start, end, -log10 of the rate, depth, strand."""
    _tsv(bases.sort("contig", "pos", "strand").select("contig", "pos", F.col("pos") + 1, "score", "n", "strand"), path)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; nulls are NA."""
    _tsv(df, path, True)


def write_matrix(matrix: DataFrame, path: str, bins: list[int]) -> None:
    """A long matrix as a wide one; the bins, which are its columns, are given."""
    _tsv(matrix.groupBy("row_id").pivot("bin", bins).agg(F.first("value")), path, True)


def write_chrom_sizes(contigs: DataFrame, path: str) -> None:
    """contig and length, as programs that index a bedGraph ask for."""
    _tsv(contigs.select("contig", "length").sort("contig"), path)


def write_track_hub(stanzas: DataFrame, path: str) -> None:
    """The stanzas (track, stanza) of a track database as text, an empty line after each."""
    stanzas.sort("track").select(F.concat("stanza", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def save_table(df: DataFrame, name: str, keys: list[str] | None = None, buckets: int = 64) -> None:
    """A table of the catalogue, bucketed and sorted by its keys, if given, so that joins on them need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.bucketBy(buckets, *keys).sortBy(*keys) if keys else writer).saveAsTable(name)
