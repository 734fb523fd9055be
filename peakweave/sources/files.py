"""Readers of positional file formats into typed DataFrames; Spark reads and splits the files."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.reads import PRESETS, Preset, crosslink_position
from ..operators import profiles


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped reads of SAM text: qname, contig, pos (0-based), aend, is_reverse, is_read1, is_read2, cigar, tlen."""
    f = F.split("value", "\t")
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("contig"), (f[3].cast("long") - 1).alias("pos"), f[5].alias("cigar"), f[8].cast("long").alias("tlen"))
    lengths = F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDN=X]"), F.lit(1))
    aend = F.col("pos") + F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return rows.where(~flag(4)).select("qname", "contig", "pos", aend.alias("aend"), flag(16).alias("is_reverse"), flag(64).alias("is_read1"), flag(128).alias("is_read2"), "cigar", "tlen")


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig and length from the header."""
    v = F.col("value")
    return spark.read.text(path).where(v.startswith("@SQ")).select(F.regexp_extract(v, "\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract(v, "\tLN:([0-9]+)", 1).cast("long").alias("length"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, name, score, strand; columns that are missing are null (score 1)."""
    f = F.split("value", "\t")
    field = lambda i: F.get(f, F.lit(i))
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").rlike("^(#|track|browser)"))
    return rows.select(field(0).alias("contig"), field(1).cast("long").alias("start"), field(2).cast("long").alias("end"), field(3).alias("name"), F.coalesce(field(4).try_cast("double"), F.lit(1.0)).alias("score"), field(5).alias("strand"))


def read_bedgraph(spark: SparkSession, path: str, strand: str = ".") -> DataFrame:
    """contig, strand, pos, value: one row for each base; values as they stand in the file."""
    f = F.split("value", "[\t ]+")
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").rlike("^(#|track|browser)")).select(f[0].alias("contig"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].cast("double").alias("value"))
    return rows.where("`end` > start").select("contig", F.lit(strand).alias("strand"), F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _file, _block (where the part of the file that a task reads begins) and _id (grows within a part)."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def _with_header(lines: DataFrame, header: Column, name: Column) -> DataFrame:
    """Lines that are no header, with what the header before them gives (_name) and its number in the part (_nth, 0: in a part before).

    Parts of a file are read apart; the last header of each (one row for a part) is handed on.
    """
    part = ["_file", "_block"]
    own = lines.withColumn("_header", F.when(header, name)).withColumn("_is", F.when(header, 1).otherwise(0))
    w = Window.partitionBy(*part).orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    last = own.groupBy(*part).agg(F.max_by("_header", F.when(F.col("_is") == 1, F.col("_id"))).alias("_last"))
    before = last.select(*part, F.last("_last", True).over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    named = own.withColumn("_own", F.last("_header", True).over(w)).withColumn("_nth", F.sum("_is").over(w)).join(F.broadcast(before), part)
    return named.where("_is = 0").withColumn("_name", F.coalesce("_own", "_before")).drop("_header", "_is", "_own", "_before")


def read_wig(spark: SparkSession, path: str, strand: str = ".", base: int = 0) -> DataFrame:
    """contig, strand, pos, value of variableStep text.  base: what the file counts its first position as."""
    v = F.col("value")
    rows = _with_header(_lines(spark, path), v.contains("Step"), F.regexp_extract(v, "chrom=([^\\s]+)", 1)).where(v.rlike("^[0-9]"))
    f = F.split(v, "[\t ]+")
    return rows.select(F.col("_name").alias("contig"), F.lit(strand).alias("strand"), (f[0].cast("double").cast("long") - base).alias("pos"), f[1].cast("double").alias("value")).where(~F.isnan("value"))


def both_strands(plus: DataFrame, minus: DataFrame | None = None) -> DataFrame:
    """One profile from two value tables; the minus table's values are negative in files and become positive."""
    out = plus.withColumn("strand", F.lit("+"))
    return out if minus is None else out.unionByName(minus.withColumn("strand", F.lit("-")).withColumn("value", F.abs("value")))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """contig, source, feature, start (0-based), end, score, strand, frame, attributes (a map), gene_id, transcript_id."""
    f = F.split("value", "\t")
    pairs = F.transform(F.regexp_extract_all(f[8], F.lit('([A-Za-z0-9_.]+ +"[^"]*")'), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "^[A-Za-z0-9_.]+", 0), F.regexp_extract(x, '"([^"]*)"', 1)))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda a, x: F.when(F.exists(a, lambda y: y["key"] == x["col1"]), a).otherwise(F.concat(a, F.array(F.struct(x["col1"].alias("key"), x["col2"].alias("value"))))))
    rows = spark.read.text(path).where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    out = rows.select(f[0].alias("contig"), f[1].alias("source"), f[2].alias("feature"), (f[3].cast("long") - 1).alias("start"), f[4].cast("long").alias("end"), f[5].alias("score"), f[6].alias("strand"), f[7].alias("frame"), F.map_from_entries(first).alias("attributes"))
    return out.withColumn("gene_id", F.try_element_at("attributes", F.lit("gene_id"))).withColumn("transcript_id", F.try_element_at("attributes", F.lit("transcript_id")))


def read_fasta(spark: SparkSession, path: str, chunk: int = 65_536) -> DataFrame:
    """contig, start, seq: records cut into chunks, so that a long sequence is many rows.

    Files are read line by line, part by part; a line's place is the sum of the
    lengths before it in its part and what the record had in the parts before.
    """
    v, part = F.col("value"), ["_file", "_block"]
    rows = _with_header(_lines(spark, path), v.startswith(">"), F.regexp_extract(v, "^>([^\\s]+)", 1))
    rows = rows.select(*part, "_id", "_nth", F.col("_name").alias("contig"), F.regexp_replace("value", "\\s", "").alias("seq")).where(F.length("seq") > 0)
    w = Window.partitionBy(*part, "_nth").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("seq")).over(w), F.lit(0)))
    # One row for each part and the records that it holds bases of; the last record of a part may go on in the next one.
    held = rows.groupBy(*part, "contig", "_nth").agg(F.sum(F.length("seq")).alias("_n"))
    before = held.select("_file", "contig", "_nth", "_block", F.coalesce(F.sum("_n").over(Window.partitionBy("_file", "contig").orderBy("_block", "_nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(before), [*part, "contig", "_nth"]).withColumn("_at", F.col("_at") + F.col("_before"))
    bins = F.explode(F.sequence(F.floor(F.col("_at") / chunk), F.floor((F.col("_at") + F.length("seq") - 1) / chunk)))
    cut = placed.select("contig", "seq", "_at", bins.alias("_bin"))
    lo = F.greatest("_at", F.col("_bin") * chunk)
    piece = F.substring(F.col("seq"), (lo - F.col("_at") + 1).cast("int"), (F.least(F.col("_at") + F.length("seq"), (F.col("_bin") + 1) * chunk) - lo).cast("int"))
    joined = cut.groupBy("contig", "_bin").agg(F.array_sort(F.collect_list(F.struct(lo.alias("at"), piece.alias("s")))).alias("p"))
    return joined.select("contig", (F.col("_bin") * chunk).alias("start"), F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """What read_sam gives, from binary BAM files; a file is one unit of work, so a large one is best split by contig before."""
    schema = "qname string, contig string, pos long, aend long, is_reverse boolean, is_read1 boolean, is_read2 boolean, cigar string, tlen long"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for rows in _bam_rows(gzip.decompress(content.as_buffer())):
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, schema)


def _bam_rows(raw: bytes, step: int = 10_000) -> Iterator[list[dict]]:
    """Mapped reads of an inflated BAM file, some at a time."""
    if raw[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    contigs = []
    (n_contigs,) = struct.unpack_from("<i", raw, at)
    at += 4
    for _ in range(n_contigs):
        (size,) = struct.unpack_from("<i", raw, at)
        contigs.append(raw[at + 4 : at + 3 + size].decode())
        at += 8 + size
    rows = []
    while at < len(raw):
        size, contig, pos, name_size, _, _, n_ops, flag, _, _, _, tlen = struct.unpack_from("<iiiBBHHHiiii", raw, at)
        name_at = at + 36
        ops = struct.unpack_from(f"<{n_ops}I", raw, name_at + name_size)
        at += 4 + size
        if flag & 4:
            continue
        # Codes of operations (fixed values), and those that use up bases of the reference.
        spelled = [(x >> 4, "MIDNSHP=X"[x & 15]) for x in ops]
        rows.append({"qname": raw[name_at : name_at + name_size - 1].decode(), "contig": contigs[contig], "pos": pos, "aend": pos + sum(k for k, op in spelled if op in "MDN=X"), "is_reverse": bool(flag & 16), "is_read1": bool(flag & 64), "is_read2": bool(flag & 128), "cigar": "".join(f"{k}{op}" for k, op in spelled), "tlen": tlen})
        if len(rows) == step:
            yield rows
            rows = []
    if rows:
        yield rows


def read_sample_table(spark: SparkSession, path: str) -> DataFrame:
    """umi_pattern, barcode, track, lane: one row for each lane."""
    rows = spark.read.csv(path, sep="\t", schema="umi_pattern string, barcode string, track string, lanes string")
    return rows.select("umi_pattern", "barcode", "track", F.explode(F.split("lanes", ",")).alias("lane"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row_id, bin, value in long form from a tab-separated matrix with a header of bins."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, *bins = wide.columns
    long = wide.unpivot(first, bins, "bin", "value")
    return long.select(F.col(first).alias("row_id"), F.col("bin").cast("int").alias("bin"), F.col("value").try_cast("double").alias("value"))


def read_named_tables(spark: SparkSession, glob: str, pattern: str, columns: list[str]) -> DataFrame:
    """Many tab-separated files with a header as one table, with columns from the groups of a pattern on their names."""
    out = spark.read.csv(glob, sep="\t", header=True, inferSchema=True).withColumn("_file", F.input_file_name())
    for i, c in enumerate(columns, 1):
        out = out.withColumn(c, F.regexp_extract("_file", pattern, i))
    return out.drop("_file")


def filter_mates(reads: DataFrame, drop: str | None) -> DataFrame:
    """Without first or second mates; reads that are neither stay."""
    return reads if drop is None else reads.where(~F.col(f"is_{drop}"))


#: The columns of a profile, which any source of one's own has to give.
PROFILE = ("contig", "strand", "pos", "n")


def as_profile(df: DataFrame) -> DataFrame:
    """A profile from any DataFrame with contig, strand, pos and n, one row for each base; it raises without one of them."""
    missing = [c for c in PROFILE if c not in df.columns]
    if missing:
        raise ValueError(f"a profile needs the columns {', '.join(missing)}")
    return df.groupBy("contig", "strand", "pos").agg(F.sum("n").alias("n"))


def read_profile(spark: SparkSession, reads: str | None = None, plus: str | None = None, minus: str | None = None, bed: str | None = None, preset: str | Preset = "individual") -> DataFrame:
    """contig, strand, pos, n from the first that is given: SAM reads, bedGraph values by strand, or BED."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    if reads:
        rows = filter_mates(read_bam(spark, reads) if reads.endswith(".bam") else read_sam(spark, reads), p.drop_mate)
        strand = F.when(F.col("is_reverse") != F.lit(p.reverse_direction), "-").otherwise("+")
        rows = rows.withColumn("strand", strand)
        return profiles.from_reads(rows, crosslink_position(F.col("pos"), F.col("aend"), F.col("is_reverse"), F.col("cigar"), p), ("contig", "strand"))
    if plus:
        values = both_strands(read_bedgraph(spark, plus), read_bedgraph(spark, minus) if minus else None)
        return values.groupBy("contig", "strand", "pos").agg(F.sum("value").alias("n"))
    if bed:
        return read_bed(spark, bed).groupBy("contig", "strand", F.col("start").alias("pos")).agg(F.sum("score").alias("n"))
    raise ValueError("give reads, plus (and minus), or bed")


def select(profile: DataFrame, contig: str, start: int = 0, end: int | None = None, strand: str = ".") -> DataFrame:
    """Positions of a range; strand "." sums both strands."""
    out = profile.where((F.col("contig") == contig) & (F.col("pos") >= start))
    out = out if end is None else out.where(F.col("pos") < end)
    return out.groupBy("contig", "pos").agg(F.sum("n").alias("n")) if strand == "." else out.where(F.col("strand") == strand)


def read_length_section(spark: SparkSession, path: str, section: str = "Sequence Length Distribution") -> DataFrame:
    """(file, start, end, count) from the section of reports of read quality: lines "length" or "from-to", a tab, and a count."""
    v = F.col("value")
    rows = _with_header(_lines(spark, path), v.startswith(">>"), v).where(F.col("_name").startswith(f">>{section}") & ~v.startswith("#"))
    f = F.split(v, "\t")
    ends = F.split(f[0], "-")
    return rows.select(F.col("_file").alias("file"), ends[0].cast("long").alias("start"), F.element_at(ends, -1).cast("long").alias("end"), f[1].cast("double").cast("long").alias("count"))
