"""Sequences of bases: k-mers around signal, their enrichment, and sequences of spliced segments."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.reads import reverse_complement
from .coordinates import TX
from .intervals import join_overlaps
from .profiles import spread

_CODE = np.full(256, -1, np.int64)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def kmer_matches(sequences: DataFrame, k: int) -> DataFrame:
    """(seq_id, kmer, start): every k-mer of bases A, C, G, T with its start."""
    s = sequences.where(F.length("seq") >= k).select("seq_id", F.upper("seq").alias("seq"), F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("start"))
    return s.select("seq_id", F.expr(f"substring(seq, start + 1, {k})").alias("kmer"), "start").where(F.col("kmer").rlike("^[ACGT]+$"))


def kmer_frequency(matches: DataFrame, profile: DataFrame, width: int, extra=()) -> DataFrame:
    """For each k-mer, the counts within `width` of each of its starts; profile: seq_id, pos, n."""
    wide = spread(profile, width, width, ("seq_id", *extra)).withColumnsRenamed({"pos": "start"})
    return matches.join(wide, ["seq_id", "start"]).groupBy(*extra, "kmer").agg(F.sum("n").alias("freq"))


def kmer_name(code: Column, k: int) -> Column:
    """The k-mer that a number below 4 ** k stands for."""
    digits = [F.substring(F.lit("ACGT"), F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)) for i in range(k)]
    return F.concat(*digits)


def kmer_universe(spark: SparkSession, k: int) -> DataFrame:
    """(code, kmer): all 4 ** k k-mers."""
    return spark.range(4**k).select(F.col("id").alias("code"), kmer_name(F.col("id"), k).alias("kmer"))


def kmer_codes(seq: str, k: int) -> np.ndarray:
    """The number of the k-mer at each place of a sequence; -1 where there is none."""
    base = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if len(base) < k:
        return np.full(len(base), -1, np.int64)
    code, bad = np.zeros(len(base) - k + 1, np.int64), np.zeros(len(base) - k + 1, bool)
    for j in range(k):
        part = base[j : len(base) - k + 1 + j]
        code = code * 4 + part
        bad |= part < 0
    code[bad] = -1
    return np.concatenate([code, np.full(k - 1, -1, np.int64)])


#: Constants of MD5: turns by round, and the sines.
_TURNS = [x for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]


def md5_numbers(blocks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of many texts of at most 55 bytes: rows of 64 bytes with zeros behind the texts (they are filled up in place)."""
    blocks[np.arange(len(blocks)), lengths] = 0x80
    words = np.ascontiguousarray(blocks.view("<u4").T)
    words[14] = lengths * 8
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    first = a.copy()
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        f += words[g]
        turned = (f << np.uint32(_TURNS[i])) | (f >> np.uint32(32 - _TURNS[i]))
        turned += b
        a, b, c, d = d, turned, b, c
    return (a + first).byteswap().astype(np.int64)


def draw_numbers(names: list[bytes], rands: int, seed: int) -> np.ndarray:
    """(rands x names): the first 32 bits of the MD5 of seed, randomisation and name."""
    heads = [f"{seed}|{r}".encode() for r in range(rands)]
    size = np.array([len(x) for x in names])
    if len(heads[-1]) + size.max() > 55:
        return np.array([[int.from_bytes(hashlib.md5(h + x, usedforsecurity=False).digest()[:4], "big") for x in names] for h in heads], np.int64)
    tails = np.frombuffer(b"".join(x.ljust(64, b"\0") for x in names), np.uint8).reshape(-1, 64)
    out, done = np.empty((rands, len(names)), np.int64), 0
    for width in sorted({len(h) for h in heads}):
        mine = np.frombuffer(b"".join(h for h in heads if len(h) == width), np.uint8).reshape(-1, width)
        blocks = np.zeros((len(mine), len(names), 64), np.uint8)
        blocks[:, :, :width] = mine[:, None, :]
        blocks[:, :, width:] = tails[None, :, : 64 - width]
        out[done : done + len(mine)] = md5_numbers(blocks.reshape(-1, 64), np.tile(size + width, len(mine))).reshape(len(mine), -1)
        done += len(mine)
    return out


def kmer_counts(sequences: DataFrame, profile: DataFrame, k: int, width: int, rands: int, seed: int = 42) -> DataFrame:
    """(rand_id, code, freq): for each k-mer, the counts within `width` of each of its starts; rand_id -1: as observed, 0..: counts placed anew."""
    return kmer_counts_of(sequences, profile, [k], width, rands, seed).drop("k")


def kmer_counts_of(sequences: DataFrame, profile: DataFrame, ks: list[int], width: int, rands: int, seed: int = 42) -> DataFrame:
    """(k, rand_id, code, freq): as kmer_counts, for several k; counts are placed anew once for all of them.

    A sequence and its counts are one unit of work: a task looks up the k-mers
    around every count, and hands on sums for each randomisation and k-mer.
    """
    tags = profile.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("tags"))
    work = sequences.join(tags, "seq_id").select("seq_id", "seq", F.col("tags.pos").alias("pos"), F.col("tags.n").alias("n"))
    ks = list(dict.fromkeys(ks))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = np.arange(-width, width + 1)
        # The last column of each randomisation takes what is no k-mer.
        totals = {k: np.zeros((rands + 1) * (4**k + 1), np.int64) for k in ks}
        held = {k: [] for k in ks}
        at_once = max(1, (1 << 15) // (rands + 1))

        def flush(k: int) -> None:
            if held[k]:
                totals[k] += np.bincount(np.concatenate(held[k]), minlength=len(totals[k]))
            held[k].clear()

        def add(seqs: list[tuple]) -> None:
            """Sequences: id, text, places, counts, length."""
            begin, lines = width, {k: [np.full(width, 4**k)] for k in ks}
            names, at, zero, length = [], [], [], []
            for seq_id, seq, pos, n, size in seqs:
                for k in ks:
                    codes = kmer_codes(seq, k)
                    lines[k] += [np.where(codes < 0, 4**k, codes), np.full(size - len(codes) + width, 4**k)]
                names += [f"|{seq_id}|{p}|{t}".encode() for p, m in zip(pos.tolist(), n.tolist()) for t in range(1, m + 1)]
                at.append(np.repeat(pos, n))
                zero.append(np.full(len(at[-1]), begin))
                length.append(np.full(len(at[-1]), size))
                begin += size + width
            at, zero, length = (np.concatenate(x) for x in (at, zero, length))
            line = {k: np.concatenate(x) for k, x in lines.items()}
            for a in range(0, len(names), at_once):
                part = slice(a, a + at_once)
                places = np.concatenate([at[None, part], draw_numbers(names[part], rands, seed) % length[None, part]]) + zero[None, part]
                window = places[:, :, None] + around
                for k in ks:
                    row = line[k][window]
                    row += (np.arange(rands + 1) * (4**k + 1))[:, None, None]
                    held[k].append(row.ravel())
                    if sum(map(len, held[k])) > len(totals[k]) + (1 << 20):
                        flush(k)

        for batch in batches:
            seqs, bases = [], 0
            for i in range(batch.num_rows):
                seq, pos, n = batch.column(1)[i].as_py(), batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
                if n.sum() > 0:
                    seqs.append((batch.column(0)[i].as_py(), seq, pos, n, len(seq)))
                    bases += len(seq) + width + int(n.sum())
                if bases > 1 << 18:
                    add(seqs)
                    seqs, bases = [], 0
            if seqs:
                add(seqs)
        for k in ks:
            flush(k)
            sums = totals[k].reshape(rands + 1, -1)[:, :-1]
            rand, code = np.nonzero(sums)
            if len(rand):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rand), k)), pa.array(rand - 1), pa.array(code), pa.array(sums[rand, code])], ["k", "rand_id", "code", "freq"])

    return work.mapInArrow(count, "k long, rand_id long, code long, freq long").groupBy("k", "rand_id", "code").agg(F.sum("freq").alias("freq"))


def kmer_enrichment(sequences: DataFrame, profile: DataFrame, k: int = 5, width: int = 15, rands: int = 100, seed: int = 42) -> DataFrame:
    """(kmer, z) of all 4 ** k k-mers: the observed share of each against randomised profiles; a randomisation without it counts as 0, and so does a k-mer that does not occur.  Null where shares do not vary."""
    return kmer_enrichments(sequences, {"": profile}, [k], width, rands, seed).select("kmer", "z")


def kmer_enrichments(sequences: DataFrame, profiles: dict[str, DataFrame], ks: list[int], width: int = 15, rands: int = 100, seed: int = 42) -> DataFrame:
    """(profile, k, kmer, z) for several named profiles and several k; a profile's counts are placed anew once for all k."""
    out = None
    for name, profile in profiles.items():
        counts = kmer_counts_of(sequences, profile, ks, width, rands, seed)
        share = counts.withColumn("s", F.col("freq") / F.sum("freq").over(Window.partitionBy("k", "rand_id")))
        drawn = F.when(F.col("rand_id") >= 0, F.col("s"))
        moments = share.groupBy("k", "code").agg(F.sum(F.when(F.col("rand_id") < 0, F.col("s"))).alias("obs"), F.sum(drawn).alias("s1"), F.sum(drawn * drawn).alias("s2"))
        some = lambda c: F.coalesce(c, F.lit(0.0))
        mean = some("s1") / rands
        var = (some("s2") - rands * mean * mean) / (rands - 1)
        universe = None
        for k in ks:
            one = kmer_universe(sequences.sparkSession, k).select(F.lit(k).alias("k"), "code", "kmer")
            universe = one if universe is None else universe.unionAll(one)
        found = universe.join(moments.withColumn("k", F.col("k").cast("int")), ["k", "code"], "left")
        one = found.select(F.lit(name).alias("profile"), "k", "kmer", ((some("obs") - mean) / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0))).alias("z"))
        out = one if out is None else out.unionAll(one)
    return out


def fetch(chunks: DataFrame, intervals: DataFrame) -> DataFrame:
    """The intervals (contig, start, end and any others) with their sequence, from chunks (contig, start, seq) of sequences.  Only chunks that an interval touches are cut, and only what it needs of them is sorted."""
    keyed = intervals.withColumn("_key", F.monotonically_increasing_id())
    pieces = chunks.select("contig", "start", (F.col("start") + F.length("seq")).alias("end"), "seq")
    hit = join_overlaps(keyed.select("_key", "contig", "start", "end"), pieces, ("contig",))
    a, b = F.greatest("start", "b_start"), F.least("end", "b_end")
    cut = hit.select("_key", a.alias("at"), F.substring("b_seq", (a - F.col("b_start") + 1).cast("int"), (b - a).cast("int")).alias("part"))
    joined = cut.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("seq"))
    return keyed.join(joined, "_key").drop("_key")


def segment_sequences(chunks: DataFrame, exons: DataFrame, introns: DataFrame) -> DataFrame:
    """(transcript_id, kind, start, seq): a transcript's exons joined in its own direction, and each intron by itself (its start tells which)."""
    minus = F.col("strand") == "-"
    parts = fetch(chunks, exons.select(*TX, "start", "end").withColumn("kind", F.lit("exon")).unionByName(introns.select(*TX, "start", "end").withColumn("kind", F.lit("intron"))))
    of = F.when(F.col("kind") == "intron", F.col("start")).otherwise(F.lit(-1).cast("long"))
    whole = parts.groupBy("transcript_id", "strand", "kind", of.alias("of")).agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))
    seq = F.array_join(F.transform("p", lambda x: x["seq"]), "")
    return whole.select("transcript_id", "kind", F.when(F.col("of") >= 0, F.col("of")).alias("start"), F.when(minus, reverse_complement(seq)).otherwise(seq).alias("seq"))
