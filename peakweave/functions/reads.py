"""Column functions on aligned reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Preset:
    """How a read becomes one base."""

    offset: int = -1
    read_end: bool = False
    use_deletions: bool = True
    centre: bool = False
    reverse_direction: bool = False
    drop_mate: str | None = None


#: Five kinds of experiment and how their reads become bases (fixed values): single-nucleotide cross-linking, the same
#: with paired reads, the same by the middle of a read, and nascent transcription from first or second mates.
PRESETS = {
    "individual": Preset(),
    "enhanced": Preset(drop_mate="read2"),
    "individual-centre": Preset(centre=True, drop_mate="read1"),
    "nascent-read1": Preset(offset=0, read_end=True, use_deletions=False, drop_mate="read1"),
    "nascent-read2": Preset(offset=0, use_deletions=False, reverse_direction=True, drop_mate="read2"),
}


def _consumed(ops: Column, all_ops: bool) -> Column:
    """The lengths of CIGAR operations summed: those that consume the reference, or all."""
    lengths = F.regexp_extract_all(ops, F.lit("([0-9]+)[A-Z=]" if all_ops else "([0-9]+)[MNX=]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def first_deletion_offset(cigar: Column, reverse: Column | bool = False, all_ops: bool = False) -> Column:
    """Bases from a read's 5' end to its first deletion; null without one.  all_ops counts insertions and clips too."""
    before = F.regexp_extract(cigar, "^([^D]*?)[0-9]+D", 1)
    after = F.regexp_extract(cigar, "D([^D]*)$", 1)
    reverse = reverse if isinstance(reverse, Column) else F.lit(reverse)
    return F.when(cigar.contains("D"), F.when(reverse, _consumed(after, all_ops)).otherwise(_consumed(before, all_ops)))


def aligned_positions(pos: Column, cigar: Column) -> Column:
    """All reference positions that a base of the read is aligned to."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[A-Z=])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "[A-Z=]", 0).alias("op"), F.regexp_extract(x, "[0-9]+", 0).cast("long").alias("len")))
    start = F.struct(pos.cast("long").alias("at"), F.array().cast("array<bigint>").alias("found"))

    def step(a: Column, x: Column) -> Column:
        aligned = x["op"].isin("M", "=", "X")
        found = F.when(aligned, F.concat(a["found"], F.sequence(a["at"], a["at"] + x["len"] - 1))).otherwise(a["found"])
        at = F.when(aligned | x["op"].isin("D", "N"), a["at"] + x["len"]).otherwise(a["at"])
        return F.struct(at.alias("at"), found.alias("found"))

    return F.aggregate(ops, start, step, lambda a: a["found"])


def crosslink_position(pos: Column, aend: Column, is_reverse: Column, cigar: Column, preset: Preset = PRESETS["individual"]) -> Column:
    """The base that a read stands for: at a deletion, in the middle, or beside one end."""
    from_end = is_reverse if not preset.read_end else ~is_reverse
    out = F.when(from_end, aend - 1 - preset.offset).otherwise(pos + preset.offset)
    if preset.centre:
        at = aligned_positions(pos, cigar)
        out = F.get(at, F.floor(F.size(at) / 2).cast("int"))
    if preset.use_deletions:
        k = first_deletion_offset(cigar, is_reverse)
        out = F.when(k.isNotNull(), F.when(is_reverse, aend - k - 1).otherwise(pos + k)).otherwise(out)
    return out


def hash_number(*parts: Column | int | str) -> Column:
    """A reproducible number below 2 ** 32 from the text of all parts: the same on any cluster, and in any engine with md5."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


#: IUPAC codes and the bases they stand for (fixed values).
IUPAC = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def iupac_regex(pattern: str) -> str:
    """A pattern with ambiguity codes as a regular expression."""
    return "".join(f"[{IUPAC[c]}]" if c in IUPAC else c for c in pattern.upper())


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATGCN", "TACGN"))


def split_barcode(seq: Column, pattern: str) -> tuple[Column, Column, Column]:
    """(umi, barcode, rest) of a read by a pattern of N (UMI) and X (barcode) at its beginning."""
    pick = lambda c: F.concat(*(F.substring(seq, i + 1, 1) for i, x in enumerate(pattern) if x == c)) if c in pattern else F.lit("")
    return pick("N"), pick("X"), F.substring(seq, len(pattern) + 1, 1 << 30)


def rewrite_name(name: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(name, pattern, replacement)


def fragment_length(length: Column, aligned: Column, is_paired: Column, tlen: Column, paired_from: int) -> Column:
    """A fragment's length: the read's, or, for a paired read of `paired_from` bases or more, the template's less what introns and deletions add."""
    return F.when(is_paired & (length >= paired_from), F.abs(tlen) - F.greatest(F.lit(0), aligned - length)).otherwise(length)


def demultiplex(reads: DataFrame, samples: DataFrame, seq: str = "seq", lane: str = "lane") -> DataFrame:
    """Reads with the track of the sample whose barcode and lane they have, their UMI, and what is left of them; others are dropped.

    samples: umi_pattern, barcode, track, lane (one row for each lane).  Patterns
    are few; reads are cut by each and joined on barcode and lane.
    """
    out = None
    patterns = sorted(r["umi_pattern"] for r in samples.select("umi_pattern").distinct().collect())
    for pattern in patterns:
        umi, barcode, rest = split_barcode(F.col(seq), pattern)
        cut = reads.withColumns({"umi": umi, "barcode": barcode, "rest": rest})
        mine = samples.where(F.col("umi_pattern") == pattern).select("barcode", "track", F.col("lane").alias("_lane"))
        one = cut.join(mine, (cut["barcode"] == mine["barcode"]) & (cut[lane] == mine["_lane"])).drop(mine["barcode"]).drop("_lane")
        out = one if out is None else out.unionByName(one)
    return reads.where("false") if out is None else out


def track_hub(tracks: DataFrame, parent: str) -> DataFrame:
    """(track, stanza): the text of a track database, one stanza for each track (track, url, strand, colour), under a parent."""
    line = lambda key, value: F.concat(F.lit(f"    {key} "), value)
    shown = F.concat_ws("\n", F.concat(F.lit("    track "), F.col("track")), line("parent", F.lit(parent)), line("bigDataUrl", F.col("url")), line("shortLabel", F.col("track")), line("longLabel", F.concat_ws(" ", F.col("track"), F.col("strand"))), line("color", F.col("colour")), line("type", F.lit("bigWig")))
    return tracks.select("track", shown.alias("stanza"))
