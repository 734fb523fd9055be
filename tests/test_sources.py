"""Readers and writers on small hand-made files."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from peakweave.sources import files, sinks


def lines(path, *rows):
    path.write_text("".join(r + "\n" for r in rows))
    return str(path)


def test_sam(spark, tmp_path):
    f = lines(tmp_path / "a.sam", "@SQ\tSN:c1\tLN:500", "r_AAC\t0\tc1\t101\t60\t10M2D5M\t*\t0\t0\t*\t*", "q_AAG\t16\tc1\t201\t60\t20M\t*\t0\t0\t*\t*", "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*")
    assert sorted((r.qname, r.pos, r.aend, r.is_reverse) for r in files.read_sam(spark, f).collect()) == [("q_AAG", 200, 220, True), ("r_AAC", 100, 117, False)]
    assert [tuple(r) for r in files.sam_contigs(spark, f).collect()] == [("c1", 500)]
    assert sorted(tuple(r) for r in files.read_profile(spark, reads=f).collect()) == [("c1", "+", 110, 1), ("c1", "-", 220, 1)]


def test_bed_and_bedgraph(spark, tmp_path):
    f = lines(tmp_path / "a.bed", "track x", "c1\t5\t6\t.\t2.5\t+", "c1\t5\t6\t.\t1\t+", "c1\t9\t10")
    assert sorted((r.contig, r.strand or "", r.pos, r.n) for r in files.read_profile(spark, bed=f).collect()) == [("c1", "", 9, 1.0), ("c1", "+", 5, 3.5)]
    g = lines(tmp_path / "a.bg", "c1\t5\t7\t-2")
    p = lines(tmp_path / "b.bg", "c1\t1\t2\t3")
    assert sorted(tuple(r) for r in files.read_profile(spark, plus=p, minus=g).collect()) == [("c1", "+", 1, 3.0), ("c1", "-", 5, 2.0), ("c1", "-", 6, 2.0)]


def test_wig(spark, tmp_path):
    f = lines(tmp_path / "a.wig", "variableStep\tchrom=c1", "5.0\t2", "7\t3", "variableStep chrom=c2", "1\t4")
    assert sorted((r.contig, r.pos, r.value) for r in files.read_wig(spark, f).collect()) == [("c1", 5, 2.0), ("c1", 7, 3.0), ("c2", 1, 4.0)]


def test_gtf(spark, tmp_path):
    f = lines(tmp_path / "a.gtf", "#x", 'c1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1"; exon_number "2"; tag "a"; tag "b";')
    r = files.read_gtf(spark, f).first()
    assert (r.start, r.end, r.gene_id, r.transcript_id, r.attributes["exon_number"]) == (10, 20, "g1", "t1", "2")


def test_fasta(spark, tmp_path):
    f = lines(tmp_path / "a.fa", ">c1 first", "ACGT", "AC", ">c2", "GG")
    assert sorted(tuple(r) for r in files.read_fasta(spark, f, 4).collect()) == [("c1", 0, "ACGT"), ("c1", 4, "AC"), ("c2", 0, "GG")]


def test_round_trips(spark, tmp_path):
    p = spark.createDataFrame([("c1", "+", 0, 1), ("c1", "+", 5, 2), ("c1", "-", 7, 3)], "contig string, strand string, pos long, n long")
    sinks.write_bedgraph(p, spark.createDataFrame([("c1", 100)], "contig string, length long"), str(tmp_path / "bg"))
    back = files.read_profile(spark, plus=str(tmp_path / "bg/plus"), minus=str(tmp_path / "bg/minus"))
    assert sorted(tuple(r) for r in back.collect()) == [("c1", "+", 5, 2.0), ("c1", "-", 7, 3.0)]
    sinks.write_bed6(p, str(tmp_path / "bed"))
    assert files.read_profile(spark, bed=str(tmp_path / "bed")).count() == 3
    m = spark.createDataFrame([("a", 0, 1.0), ("a", 25, 2.0), ("b", 0, 3.0)], "row_id string, bin int, value double")
    sinks.write_matrix(m, str(tmp_path / "m"), [0, 25])
    assert sorted((r.row_id, r.bin, r.value) for r in files.read_matrix(spark, str(tmp_path / "m")).where("value is not null").collect()) == [("a", 0, 1.0), ("a", 25, 2.0), ("b", 0, 3.0)]


def test_bed12_and_samples(spark, tmp_path):
    b = spark.createDataFrame([("w", "c1", "+", 10, 20, 0.1), ("w", "c1", "+", 30, 35, 0.01)], "id string, contig string, strand string, start long, end long, p double")
    r = sinks.bed12(b).first()
    assert (r.start, r.end, r.block_count, r.block_sizes, r.block_starts, r.score) == (10, 35, 2, "10,5", "0,20", 0.01)
    f = lines(tmp_path / "s.tsv", "NNNXX\tAC\tt1\tL1,L2")
    assert sorted(r.lane for r in files.read_sample_table(spark, f).collect()) == ["L1", "L2"]


def test_parts_of_a_file(spark, tmp_path):
    """Headers and places reach across the parts in which a file is read."""
    seqs = {f"c{i}": "".join("ACGT"[(i + j * j) % 4] for j in range(300 + 90 * i)) for i in range(4)}
    f = lines(tmp_path / "a.fa", *(x for k, s in seqs.items() for x in [f">{k} more", *(s[a : a + 37] for a in range(0, len(s), 37))]))
    w = lines(tmp_path / "a.wig", *(x for k in seqs for x in [f"variableStep chrom={k}", *(f"{j} {j % 7}.5" for j in range(60))]))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        chunks = files.read_fasta(spark, f, 50).collect()
        assert files._lines(spark, f).select("_block").distinct().count() > 5
        values = files.read_wig(spark, w).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {k: "".join(r.seq for r in sorted((r for r in chunks if r.contig == k), key=lambda r: r.start)) for k in seqs} == seqs
    assert all(r.start % 50 == 0 and len(r.seq) <= 50 for r in chunks)
    assert sorted((r.contig, r.pos, r.value) for r in values) == [(k, j, j % 7 + 0.5) for k in seqs for j in range(60)]


def test_bam(spark, tmp_path):
    def read(name, flag, pos, cigar, tlen=0, contig=0):
        ops = b"".join(struct.pack("<I", (n << 4) | "MIDNSHP=X".index(c)) for n, c in cigar)
        seq = sum(n for n, c in cigar if c in "MIS=X")
        body = struct.pack("<iiBBHHHiiii", contig, pos, len(name) + 1, 60, 0, len(cigar), flag, seq, -1, -1, tlen) + name.encode() + b"\0" + ops + b"\x11" * ((seq + 1) // 2) + b"\xff" * seq
        return struct.pack("<i", len(body)) + body

    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 500)
    raw = head + read("r_AAC", 0, 100, [(10, "M"), (2, "D"), (5, "M")]) + read("u", 4, -1, [], contig=-1) + read("q_AAG", 16 | 128, 200, [(20, "M")], -33)
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw[:60]) + gzip.compress(raw[60:]))
    got = sorted(tuple(r) for r in files.read_bam(spark, str(tmp_path / "a.bam")).collect())
    assert got == [("q_AAG", "c1", 200, 220, True, False, True, "20M", -33), ("r_AAC", "c1", 100, 117, False, False, False, "10M2D5M", 0)]
    assert sorted(tuple(r) for r in files.read_profile(spark, reads=str(tmp_path / "a.bam")).collect()) == [("c1", "+", 110, 1), ("c1", "-", 220, 1)]


def test_read_lengths_and_many_files(spark, tmp_path):
    f = lines(tmp_path / "a.txt", ">>Basic Statistics\tpass", "x\t1", ">>END_MODULE", ">>Sequence Length Distribution\tpass", "#Length\tCount", "20\t5.0", "21-25\t7.0", ">>END_MODULE")
    assert sorted(tuple(r)[1:] for r in files.read_length_section(spark, f).collect()) == [(20, 20, 5), (21, 25, 7)]
    for name in ("A-1", "B-2"):
        lines(tmp_path / f"{name}.tsv", "x\ty", f"1\t{name}")
    got = files.read_named_tables(spark, str(tmp_path / "*.tsv"), "([A-Z])-([0-9]).tsv", ["track", "nth"]).collect()
    assert sorted((r.x, r.y, r.track, r.nth) for r in got) == [(1, "A-1", "A", "1"), (1, "B-2", "B", "2")]


def test_contract_of_profiles(spark):
    df = spark.createDataFrame([("c", "+", 1, 2), ("c", "+", 1, 3)], "contig string, strand string, pos long, n long")
    assert [tuple(r) for r in files.as_profile(df).collect()] == [("c", "+", 1, 5)]
    with pytest.raises(ValueError, match="strand"):
        files.as_profile(df.drop("strand"))


def test_sorted_sinks_and_tables(spark, tmp_path):
    p = spark.createDataFrame([("c2", "+", 9, 1), ("c1", "-", 7, 3), ("c1", "+", 5, 2)], "contig string, strand string, pos long, n long")
    read = lambda name: [x for f in sorted((tmp_path / name).glob("part-*")) for x in f.read_text().splitlines()]
    sinks.write_bins(p.withColumnRenamed("pos", "bin"), 10, str(tmp_path / "bins"))
    assert read("bins") == ["c1\t50\t60\t.\t2\t+", "c1\t70\t80\t.\t3\t-", "c2\t90\t100\t.\t1\t+"]
    sinks.write_significant(p.withColumn("score", F.lit(1.5)), str(tmp_path / "s"))
    assert read("s") == ["c1\t5\t6\t1.5\t2\t+", "c1\t7\t8\t1.5\t3\t-", "c2\t9\t10\t1.5\t1\t+"]
    sinks.write_chrom_sizes(spark.createDataFrame([("c2", 5), ("c1", 7)], "contig string, length long"), str(tmp_path / "sizes"))
    assert read("sizes") == ["c1\t7", "c2\t5"]
    sinks.write_track_hub(spark.createDataFrame([("b", "track b"), ("a", "track a")], "track string, stanza string"), str(tmp_path / "hub"))
    assert read("hub") == ["track a", "", "track b", ""]
