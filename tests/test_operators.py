"""Small cases of the engine's own operators, worked out by hand or by brute force."""

import hashlib
import math
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from peakweave.functions.reads import PRESETS, aligned_positions, crosslink_position, first_deletion_offset, iupac_regex, reverse_complement
from peakweave.operators import coordinates as co
from peakweave.operators import intervals as iv
from peakweave.operators import profiles as pr
from peakweave.operators import segments as sg
from peakweave.operators import sequences as sq
from peakweave.operators import statistics as st
from peakweave.operators.ranking import coarse, with_rank
from peakweave.plans.queries import QUERIES

EXONS = "transcript_id long, gene_id long, contig string, strand string, start long, end long"


def test_first_deletion(spark):
    df = spark.createDataFrame([("10M2D5M",), ("3S4M1I6M2D5M",), ("20M",), ("5M100N5M1D3M",)], "c string")
    got = [tuple(r) for r in df.select(first_deletion_offset(F.col("c")), first_deletion_offset(F.col("c"), True), first_deletion_offset(F.col("c"), all_ops=True)).collect()]
    assert got == [(10, 5, 10), (10, 5, 14), (None, None, None), (110, 3, 110)]


@pytest.mark.parametrize("name,reverse,want", [("individual", False, 110), ("individual", True, 111), ("nascent-read1", False, 116), ("nascent-read1", True, 100), ("nascent-read2", False, 100), ("nascent-read2", True, 116)])
def test_presets(spark, name, reverse, want):
    df = spark.createDataFrame([(100, 117, reverse, "10M2D5M")], "pos long, aend long, rev boolean, c string")
    assert df.select(crosslink_position(F.col("pos"), F.col("aend"), F.col("rev"), F.col("c"), PRESETS[name])).first()[0] == want


def test_aligned_positions(spark):
    df = spark.createDataFrame([(100, "2S3M1I2M2D1M10N2M")], "pos long, c string")
    assert df.select(aligned_positions(F.col("pos"), F.col("c"))).first()[0] == [100, 101, 102, 103, 104, 107, 118, 119]


def test_worked_transcript(spark):
    # The documented example of a transcript on the minus strand.
    exons = spark.createDataFrame([(1, 1, "c", "-", a, b) for a, b in ((100, 108), (112, 119), (124, 131))], EXONS)
    tx = co.transcript_map(exons)
    assert sorted((r.t_start, r.t_end) for r in tx.collect()) == [(0, 7), (7, 14), (14, 22)]
    points = spark.createDataFrame([(1, 115)], "transcript_id long, pos long")
    assert co.genome_to_transcript(points, tx).first().t_pos == 10
    every = spark.range(22).select(F.lit(1).cast("long").alias("transcript_id"), F.col("id").alias("t_pos"))
    there = co.transcript_to_genome(every, tx).select("transcript_id", "pos", F.col("t_pos").alias("was"))
    back = co.genome_to_transcript(there, tx).collect()
    assert len(back) == 22 and all(r.t_pos == r.was for r in back)


def test_window_merge_gap(spark):
    s = spark.createDataFrame([("c", "+", p, 1) for p in (10, 15, 22)], "contig string, strand string, pos long, n long")
    assert sorted((r.start, r.end) for r in iv.clusters(s, 4).collect()) == [(10, 16), (22, 23)]
    assert sorted((r.start, r.end) for r in iv.clusters(s, 6).collect()) == [(10, 23)]


def test_interval_joins_match_brute_force(spark):
    a = [("c", (i * 37) % 5000, (i * 37) % 5000 + 1 + i % 1500, i) for i in range(60)]
    b = [("c", (i * 91) % 5000, (i * 91) % 5000 + 1 + i % 900, i) for i in range(60)]
    schema = "contig string, start long, end long, id long"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((p[3], q[3]) for p in a for q in b if p[1] < q[2] and q[1] < p[2])
    assert sorted((r.id, r.b_id) for r in iv.join_overlaps(x, y).collect()) == want
    none = sorted(p[3] for p in a if not any(p[1] < q[2] and q[1] < p[2] for q in b))
    assert sorted(r.id for r in iv.join_overlaps(x, y, how="left_anti").collect()) == none


def test_bins(spark):
    df = spark.createDataFrame([(0,), (10,), (11,), (99,), (100,)], "p long")
    assert [r[0] for r in df.select(pr.bin_of(F.col("p"), F.lit(100), 10)).collect()] == [0, 0, 1, 9, 9]


def test_empty_profile(spark):
    none = spark.createDataFrame([], "contig string, strand string, pos long, n long")
    exons = spark.createDataFrame([(1, 7, "c", "+", 0, 10)], EXONS)
    assert [tuple(r) for r in pr.count_features(none, exons).collect()] == [(7, 0, 0)]
    assert pr.meta_gene(none, exons).count() == 0
    assert pr.spread(none, 2, 2).count() == 0


def test_spread_and_heights(spark):
    p = spark.createDataFrame([("c", "+", 100, 3), ("c", "+", 104, 1)], "contig string, strand string, pos long, n long")
    assert pr.spread(p, 3, 3).agg(F.sum("n")).first()[0] == 4 * 7
    assert max(r.p for r in pr.height_distribution(p, 3).collect()) == 1.0


@pytest.mark.parametrize("width", [3, 10, 25, 1000])
def test_window_sums_wider_than_a_bin(spark, width):
    at = [(i * 37) % 211 for i in range(40)]
    p = spark.createDataFrame([("c", "+", x, i + 1) for i, x in enumerate(at)], "contig string, strand string, pos long, n long")
    got = {r.pos: r.window_sum for r in pr.window_sums(p, width, bin_width=10).collect()}
    assert got == {x: sum(i + 1 for i, y in enumerate(at) if abs(x - y) <= width) for x in at}


@pytest.mark.parametrize("samples", ["A", "AB", "ABCD"])
def test_reproducibility_has_every_fold(spark, samples):
    # Position i is covered by the first i + 1 samples.
    rows = [(x, "c", "+", i, 1) for i in range(len(samples)) for x in samples[: i + 1]]
    got = {(r.sample, r.fold): (r.hits, r.totals) for r in pr.reproducibility(spark.createDataFrame(rows, "sample string, contig string, strand string, pos long, n long")).collect()}
    n = len(samples)
    assert got == {(x, f): (n - max(i, f), n - i) for i, x in enumerate(samples) for f in range(1, n)}


def test_binomial_tail():
    got = st.binomial_tail([0, 3, 11], [10, 10, 10], [0.3, 0.3, 0.3])
    want = sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3, 11))
    assert got[0] == 1 and abs(got[1] - want) < 1e-12 and got[2] == 0


def test_binomial_tail_of_large_numbers():
    # Exact sums of whole numbers; the continued fraction took ever more steps, and was off by 1e-11 and more.
    for n, k, q in ((2000, 400, 4), (2000, 560, 4), (40000, 7000, 5), (40000, 8001, 5), (40000, 9500, 5)):
        parts = [math.comb(n, k)]  # times (q - 1) ** (n - i), over q ** n
        for i in range(k, n):
            parts.append(parts[-1] * (n - i) // (i + 1))
        top = 0
        for i, c in enumerate(parts):
            top = top * (q - 1) + c
        want = float(Fraction(top, q**n))
        assert abs(st.binomial_tail([k], [n], [1 / q])[0] - want) < 1e-12 * want


def test_signal_of_intervals(spark):
    at = [(i * 37) % 700 - 60 for i in range(90)]
    p = spark.createDataFrame([("c", "+", x, i + 1) for i, x in enumerate(at)], "contig string, strand string, pos long, n long")
    spans = [(i, "c", "+", (i * 91) % 600 - 80, (i * 91) % 600 - 80 + 1 + (i * 53) % 300) for i in range(40)]
    x = spark.createDataFrame(spans, "id long, contig string, strand string, start long, end long")
    want = sorted((i, y, n + 1) for i, _, _, a, b in spans for n, y in enumerate(at) if a <= y < b)
    for width in (1, 16, 256):
        assert sorted((r.id, r.pos, r.n) for r in iv.laid_out(iv.join_signal(p, x, bin_width=width)).collect()) == want


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.03, 1.0]
    got = {r.i: r.q for r in st.bh_fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    order = sorted(range(len(p)), key=lambda i: p[i])
    low, want = 1.0, {}
    for rank in range(len(p), 0, -1):
        i = order[rank - 1]
        low = min(low, p[i] * len(p) / rank)
        want[i] = low
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_strings(spark):
    assert iupac_regex("RGN") == "[AG]G[ACGT]"
    assert spark.createDataFrame([("ATGCN",)], "s string").select(reverse_complement(F.col("s"))).first()[0] == "NGCAT"


def intervals(seed, n, size):
    return [("c", "+", a, a + 1 + (i * 7919 + seed) % size) for i in range(n) for a in [(i * 104729 + seed * 31) % 4000]]


@pytest.mark.parametrize("gap", [0, 5])
@pytest.mark.parametrize("size", [20, 900])
def test_merge_and_subtract_by_bins(spark, gap, size):
    schema = "contig string, strand string, start long, end long"
    a, b = (spark.createDataFrame(intervals(s, 60, size), schema) for s in (1, 2))
    keys = ("contig", "strand")
    rows = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert rows(iv.merge(a, keys, gap)) == rows(iv.merge(a, keys, gap, bin_width=64))
    left = {p for _, _, s, e in intervals(1, 60, size) for p in range(s, e)} - {p for _, _, s, e in intervals(2, 60, size) for p in range(s, e)}
    got = rows(iv.subtract(a, b, keys, 64))
    assert got == rows(iv.subtract(a, b, keys)) and {p for s, e in got for p in range(s, e)} == left and sum(e - s for s, e in got) == len(left)


@pytest.mark.parametrize("bin_width", [1, 16, 4096])
def test_coverage_across_bins(spark, bin_width):
    at = [(-9, 2), (0, 1), (5, 3), (30, 1), (33, 4)]
    p = spark.createDataFrame([("c", "+", x, n) for x, n in at], "contig string, strand string, pos long, n long")
    got = {x: r.n for r in pr.coverage_runs(p, 3, 8, bin_width=bin_width).collect() for x in range(r.start, r.end)}
    want = {}
    for x, n in at:
        for y in range(x - 3, x + 9):
            want[y] = want.get(y, 0) + n
    assert got == want


def test_rank_without_one_task(spark):
    x = [(i, ((i * 7919) % 101 - 50) * 1.5) for i in range(300)] + [(300, None)]
    df = spark.createDataFrame(x, "i long, x double")
    got = {r.i: r.place for r in with_rank(df, F.coalesce(-coarse(F.col("x")), F.lit(2**62)), [F.desc_nulls_last("x"), F.asc("i")]).collect()}
    order = sorted(range(301), key=lambda i: (x[i][1] is None, -(x[i][1] or 0), i))
    assert got == {i: place for place, i in enumerate(order, 1)}


def test_bh_keeps_nulls_and_small_p(spark):
    p = [None, 1e-300, 0.0, 1e-12, 2e-12, 0.5, None, 1.0, 1 / 1024, 1 / 2048]
    got = {r.i: r.q for r in st.bh_fdr(spark.createDataFrame(list(enumerate(p)), "i int, p double")).collect()}
    known = sorted((x, i) for i, x in enumerate(p) if x is not None)
    low, want = 1.0, {0: None, 6: None}
    for rank in range(len(known), 0, -1):
        x, i = known[rank - 1]
        low = min(low, x * len(known) / rank)
        want[i] = low
    assert all(got[i] == want[i] if want[i] is None else abs(got[i] - want[i]) <= 1e-12 * max(want[i], 1e-280) for i in want)


def test_k_mers_around_counts_placed_anew(spark):
    seqs = {1: "ACGTACGTNACGTTTGACA", 2: "GGGACCA"}
    counts = [(1, 3, 2), (1, 18, 1), (2, 0, 1)]
    s, p = spark.createDataFrame(list(seqs.items()), "seq_id long, seq string"), spark.createDataFrame(counts, "seq_id long, pos long, n long")
    got = {(r.rand_id, r.code): r.freq for r in sq.kmer_counts(s, p, 2, 3, 4).collect()}
    want = {}
    for seq_id, pos, n in counts:
        seq = seqs[seq_id]
        for tag in range(1, n + 1):
            for r in range(-1, 4):
                at = pos if r < 0 else int(hashlib.md5(f"42|{r}|{seq_id}|{pos}|{tag}".encode()).hexdigest()[:8], 16) % len(seq)
                for x in range(max(0, at - 3), min(len(seq) - 1, at + 4)):
                    if set(seq[x : x + 2]) <= set("ACGT"):
                        key = r, "ACGT".index(seq[x]) * 4 + "ACGT".index(seq[x + 1])
                        want[key] = want.get(key, 0) + 1
    assert got == want
    assert [r.kmer for r in sq.kmer_universe(spark, 2).orderBy("code").collect()] == [a + b for a in "ACGT" for b in "ACGT"]


def test_draws_are_md5_numbers():
    for names in ([b"|7|12|1", b"|1234567|99|3"], [b"|" + b"x" * 70 + b"|1|1", b"|2|2|2"]):
        want = [[int(hashlib.md5(f"42|{r}".encode() + x).hexdigest()[:8], 16) for x in names] for r in range(12)]
        assert sq.draw_numbers(names, 12, 42).tolist() == want


def test_several_k_in_one_pass(spark):
    s, p = spark.createDataFrame([(1, "ACGTACGTNACGTTTGACA"), (2, "GGGACCA")], "seq_id long, seq string"), spark.createDataFrame([(1, 3, 2), (2, 0, 1)], "seq_id long, pos long, n long")
    both = sq.kmer_enrichments(s, {"x": p}, [2, 3], 4, 10)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {(r.k, r.kmer): r.z for r in both.collect()} == {(k, r.kmer): r.z for k in (2, 3) for r in sq.kmer_enrichment(s, p, k, 4, 10).collect()}


def test_shared_ids_and_pseudo_counts(spark):
    # The second contig has a transcript of the same id; bases 3 and 4 have signal on both.
    exons = spark.createDataFrame([(1, 1, c, "+", 0, 10) for c in "cd"] + [(2, 2, "e", "-", 5, 15)], EXONS)
    p = spark.createDataFrame([(c, x, y, n) for c, x, y, n in (("c", "+", 3, 1), ("c", "+", 4, 2), ("d", "+", 3, 4), ("e", "-", 14, 3))], "contig string, strand string, pos long, n long")
    assert sorted(tuple(r) for r in pr.count_transcript(p, exons).collect()) == [(1, "exons", 3, 5), (1, "exons", 4, 2), (2, "exons", 0, 3)]
    got = {(r.region, r.bin): r.density for r in pr.meta_gene(p, exons, 0, (0, 5, 0), pseudo_count=1.0).collect()}
    one, two = [1, 8, 1, 1, 1], [4, 1, 1, 1, 1]
    assert set(got) == {("exons", b) for b in range(5)} and all(abs(got["exons", b] - one[b] / 12 - two[b] / 8) < 1e-12 for b in range(5))
    # No task keeps a row for each base of each transcript.
    assert not re.search(r"Aggregate \[transcript_id#\d+L?, region", pr.meta_gene(p, exons)._jdf.queryExecution().optimizedPlan().toString())


def test_junctions_from_one_map(spark):
    # Two exons of 5 and one of 12 lie within one junction's window; the second contig has a transcript of the same id.
    exons = spark.createDataFrame([(1, 1, "c", "-", a, b) for a, b in ((0, 12), (20, 25), (30, 35))] + [(1, 1, "d", "+", a, b) for a, b in ((0, 3), (9, 19))], EXONS)
    p = spark.createDataFrame([("c", "-", x, n) for x, n in ((34, 1), (21, 2), (11, 4), (2, 8), (15, 9))] + [("d", "+", 10, 3)], "contig string, strand string, pos long, n long")
    found = pr.junction_meta(p, exons)
    t = {0: 1, 8: 2, 10: 4, 19: 8, 4: 3}  # the signal by place in the transcript
    want = {}
    for j in (5, 10, 3):
        near = {x - j + 20: n for x, n in t.items() if j - 20 <= x <= j + 10}
        for base, n in near.items():
            want[base] = want.get(base, 0) + n / sum(near.values())
    got = {r.base: r.density for r in found.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    # The map of transcripts is made once: its exons are dealt by transcript once and joined with signal alone.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and len(re.findall(r"\bJoin\b", plan)) == 1


@pytest.mark.parametrize("query", ["meta_gene", "meta_gene_counts", "reverse_strand_cropped", "rows_by_given_keys", "meta_gene_scaled_flanks", "rows_backwards", "rows_by_first_exon", "rows_by_utr5"])
def test_no_rows_kept_for_each_base(spark, query):
    # Signal is dealt by transcript as arrays: no aggregate has a group for each base of a transcript.
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    groups = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert groups and not any("transcript_id" in g and "base" in g for g in groups)
    assert "_signal" in plan and "Generate posexplode(signal" in plan


@pytest.mark.parametrize("query", ["meta_gene", "meta_gene_counts", "reverse_strand_cropped", "meta_gene_scaled_flanks", "rows_backwards", "rows_by_given_keys", "rows_by_first_exon", "rows_by_utr5"])
def test_annotation_is_never_broadcast(spark, query):
    # However small the files are, intervals and signal meet by a merge; of a ranking's joins only the one with the sizes of its buckets is a broadcast.
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == query.startswith("rows_")


@pytest.mark.parametrize("query", ["meta_gene_counts", "reverse_strand_cropped", "meta_gene_scaled_flanks", "rows_backwards"])
def test_exons_are_sorted_once(spark, query):
    # A task that maps transcripts sorts its exons once and has no groups of them: all that follows until the join with signal is in that order.
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exons = next(x for x in plan.split("== Initial Plan ==")[0].split("SortMergeJoin")[1].split("Exchange hashpartitioning(") if "REPARTITION_BY_COL" not in x and "Window" in x)
    assert "tx_len" in exons and len(re.findall(r"[+:]- \*?(?:\(\d+\) )?Sort \[", exons)) == 1 and "Aggregate" not in exons


def test_no_groups_of_exons(spark):
    # Neither the map of transcripts nor the tables of lengths and untranslated parts number islands and group by them.
    plan = QUERIES["rows_by_utr5"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_last" in plan and "island" not in plan


@pytest.mark.parametrize("gap", [0, 7])
def test_merge_of_any_intervals(spark, gap):
    # Nested, equal, touching and empty ones, and keys that are null, against a plain sweep.
    rows = [(None if k == 3 else k, s, s + (i * 31 + k) % 17) for k in range(4) for i in range(60) for s in [(i * i * 37 + k * 11) % 900]]
    rows += [(9, 5, 5), (9, 5, 20), (9, 5, 20), (9, 8, 10), (9, 20, 30), (9, 38, 40)]
    want = []
    for key in {r[0] for r in rows}:
        own = []
        for _, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            if own and s <= own[-1][2] + gap:
                own[-1][2] = max(own[-1][2], e)
            else:
                own.append([key, s, e])
        want += [tuple(x) for x in own]
    df = spark.createDataFrame(rows, "k long, start long, end long")
    assert sorted(map(str, (tuple(r) for r in iv.merge(df, ["k"], gap).collect()))) == sorted(map(str, want))
    if not gap:
        between = [(a[0], a[2], b[1]) for a, b in zip(want, want[1:]) if a[0] == b[0]]
        assert sorted(map(str, (tuple(r) for r in iv.gaps(df, ["k"]).collect()))) == sorted(map(str, between))


def test_bootstrap_of_any_function(spark):
    rows = spark.createDataFrame([(i, i % 5, 1 + i % 3) for i in range(40)], "idx long, test long, control long")
    own = st.bootstrap(rows, lambda f: f[["rand_id"]].head(1).assign(value=f["test"].sum() / f["control"].sum()), "rand_id long, value double", 20)
    same = st.bootstrap_statistic(rows, lambda times: st.count_ratio(times=times), 20)
    a, b = ({r.rand_id: r.value for r in df.collect()} for df in (own, same))
    assert len(a) == 20 and all(abs(a[k] - b[k]) < 1e-12 for k in b)


def test_own_regions_and_segments(spark):
    exons = spark.createDataFrame([(1, 1, "c", "-", a, b) for a, b in ((100, 108), (112, 119), (124, 131))], EXONS)
    co.register_region("second_exon", lambda x, cds, up, down: x.where("start = 112").select(*co.TX, "start", "end"))
    assert [(r.start, r.end) for r in co.region(exons, "second_exon").collect()] == [(112, 119)]
    cds = exons.where("start <= 112").withColumn("start", F.expr("if(start = 100, 104, start)"))
    p = spark.createDataFrame([("c", "-", x, 1) for x in (101, 106, 115, 130, 110)], "contig string, strand string, pos long, n long")
    got = {r.g_pos: (r.segment_id, r.start, r.end, r.pos) for r in sg.place(p, exons, "utrs", cds).collect()}
    assert got == {130: ("1|5UTR", 0, 7, 0), 115: ("1|CDS", 7, 18, 10), 106: ("1|CDS", 7, 18, 15), 101: ("1|3UTR", 18, 22, 20), 110: ("1|intron|108", 108, 112, 110)}
    assert {(r.segment_id, r.start, r.end) for r in sg.place(p, exons).collect()} == {("1|exon", 0, 22), ("1|intron|108", 108, 112)}


def test_sequences_across_chunks(spark):
    seq = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(200))
    chunks = spark.createDataFrame([("c", i, seq[i : i + 16]) for i in range(0, 200, 16)], "contig string, start long, seq string")
    at = [(i, "c", (i * 37) % 150, (i * 37) % 150 + 1 + i * 3) for i in range(12)]
    got = {r.id: r.seq for r in sq.fetch(chunks, spark.createDataFrame(at, "id long, contig string, start long, end long")).collect()}
    assert got == {i: seq[a:b] for i, _, a, b in at}
