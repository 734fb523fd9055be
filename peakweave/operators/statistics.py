"""Randomisation with reproducible hashes, false discovery rates, bootstraps, distances."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.reads import hash_number
from .intervals import join_points
from .profiles import coverage_runs, height_distribution, window_sums
from .ranking import with_rank


#: Parts in which the randomisations of a segment are dealt to tasks.
GROUPS = 16


def randomise_tags(profile: DataFrame, segments: DataFrame, rands: int, seed: int = 42) -> DataFrame:
    """(segment_id, rand_id, contig, strand, pos, n): every count of a segment is placed anew, evenly and on its own."""
    return randomise_placed(join_points(profile, segments), rands, seed)


def randomise_placed(inside: DataFrame, rands: int, seed: int = 42) -> DataFrame:
    """As randomise_tags, for signal (segment_id, contig, strand, start, end, pos, n) that has its segments already."""
    return _drawn(inside.withColumn("rand_id", F.explode(F.sequence(F.lit(0), F.lit(rands - 1)))), ["segment_id", "rand_id", "contig", "strand"], seed)


def _drawn(inside: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """(keys, pos, n): counts of signal with a randomisation (rand_id) placed anew in their segments."""
    at = F.concat_ws("|", F.lit(str(seed)), F.col("rand_id"), F.col("segment_id"), F.col("pos"))
    tags = inside.select(*keys, "start", "end", at.alias("_at"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_tag"))
    pos = F.col("start") + hash_number(F.col("_at"), F.col("_tag")) % (F.col("end") - F.col("start"))
    return tags.select(*keys, pos.alias("pos")).groupBy(*keys, "pos").agg(F.count("*").alias("n"))


def randomise_sites(profile: DataFrame, segments: DataFrame, rands: int, seed: int = 42) -> DataFrame:
    """(segment_id, rand_id, pos, n): the sites of a segment move to distinct positions, counts and all."""
    inside = join_points(profile, segments)
    k = inside.groupBy("segment_id").agg(F.count("*").alias("k"))
    rand = F.explode(F.sequence(F.lit(0), F.lit(rands - 1)))
    ranks = Window.partitionBy("segment_id", "rand_id")
    places = segments.join(k, "segment_id").select("segment_id", "k", rand.alias("rand_id"), "start", "end").select("segment_id", "k", "rand_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    places = places.withColumn("i", F.row_number().over(ranks.orderBy(hash_number(seed, F.col("rand_id"), F.col("segment_id"), F.col("pos")), "pos"))).where("i <= k").select("segment_id", "rand_id", "i", "pos")
    sites = inside.select("segment_id", "n", "pos", rand.alias("rand_id")).withColumn("i", F.row_number().over(ranks.orderBy("pos"))).drop("pos")
    return places.join(sites, ["segment_id", "rand_id", "i"]).select("segment_id", "rand_id", "pos", "n")


def crosslink_fdr(profile: DataFrame, segments: DataFrame, rands: int = 100, width: int = 15, seed: int = 42) -> DataFrame:
    """(segment_id, pos, n, height, fdr) of every base with signal in a segment.

    The rate of a height is (mean + standard deviation over randomisations of
    P(H >= height)) over the observed P; a randomisation without that height
    counts as 0.  One job for all segments and randomisations.
    """
    return fdr_of_placed(join_points(profile, segments), rands, width, seed)


def fdr_of_placed(placed: DataFrame, rands: int = 100, width: int = 15, seed: int = 42) -> DataFrame:
    """As crosslink_fdr, for signal (segment_id, contig, strand, start, end, pos, n) that has its segments already."""
    inside = placed.select("segment_id", "pos", "n")
    observed = height_distribution(inside, width, ("segment_id",))
    # Randomisations are dealt in GROUPS; all that is done to one of a segment happens in the task that it is dealt to.
    group = F.explode(F.sequence(F.lit(0), F.lit(min(rands, GROUPS) - 1)))
    dealt = placed.select("segment_id", "start", "end", "pos", "n", group.alias("group")).repartition("segment_id", "group")
    dealt = dealt.withColumn("rand_id", F.explode(F.sequence(F.col("group"), F.lit(rands - 1), F.lit(min(rands, GROUPS)))))
    keys = ["segment_id", "group", "rand_id"]
    random = height_distribution(_drawn(dealt, keys, seed), width, keys).drop("group")
    # P at an observed height is that of the next height that a randomisation has.
    w = Window.partitionBy("segment_id", "rand_id").orderBy(F.desc("height"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    wanted = observed.select("segment_id", F.explode(F.sequence(F.lit(0), F.lit(rands - 1))).alias("rand_id"), "height", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("p"))
    both = wanted.unionByName(random.select("segment_id", "rand_id", "height", F.lit(0).alias("kind"), "p"))
    filled = both.withColumn("q", F.coalesce(F.max("p").over(w), F.lit(0.0))).where("kind = 1")
    rates = filled.groupBy("segment_id", "height").agg((F.avg("q") + F.stddev_samp("q")).alias("r")).join(observed, ["segment_id", "height"])
    at = window_sums(inside, width, ("segment_id",)).withColumnRenamed("window_sum", "height")
    return at.join(rates, ["segment_id", "height"]).select("segment_id", "pos", "n", "height", (F.col("r") / F.col("p")).alias("fdr"))


def significant_bases(found: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The best row of each base up to the threshold, with -log10 of its rate (infinite for 0)."""
    w = Window.partitionBy("contig", "strand", "pos").orderBy("fdr", F.desc("n"))
    best = found.where(F.col("fdr") <= threshold).withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")
    return best.withColumn("score", F.when(F.col("fdr") == 0, F.lit(math.inf)).otherwise(-F.log10(F.nullif("fdr", F.lit(0.0)))))


def bh_fdr(df: DataFrame, p: str = "p") -> DataFrame:
    """Adds q by Benjamini and Hochberg; a null p has a null q and does not count.

    Ranks come from counts of distinct p, so no task sorts all rows.  Counts are
    summed in two levels: buckets that grow with p, and the values of a bucket.
    Below 1/1024 there are 64 buckets for each halving, above 1023 equal ones.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_c"))
    small = -F.floor(-F.log2(F.greatest(F.col(p), F.lit(5e-324))) * 64) - 1
    buckets = counts.withColumn("_b", F.when(F.col(p) >= 1 / 1024, F.floor(F.col(p) * 1024)).otherwise(small))
    totals = buckets.groupBy("_b").agg(F.sum("_c").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    m = totals.agg(F.sum("_t").alias("_m"))
    inner = Window.partitionBy("_b").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    raw = buckets.join(F.broadcast(before.select("_b", "_before")), "_b").crossJoin(F.broadcast(m)).withColumn("_raw", F.col(p) * F.col("_m") / (F.col("_before") + F.sum("_c").over(inner)))
    least = raw.groupBy("_b").agg(F.min("_raw").alias("_l"))
    after = least.withColumn("_after", F.min("_l").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)))
    q = F.least(F.lit(1.0), F.coalesce("_after", F.lit(1.0)), F.min("_raw").over(Window.partitionBy("_b").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)))
    table = raw.join(F.broadcast(after.select("_b", "_after")), "_b").select(p, q.alias("q"))
    return df.join(table, p, "left")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers, by Stirling's series from 10 on and the recurrence below."""
    x = np.asarray(x, float).copy()
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift[low] += np.log(x[low])
        x[low] += 1
    z = 1 / (x * x)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


#: Nodes and weights of Gauss and Legendre on [0, 1].
_NODES, _WEIGHTS = ((x + y) / 2 for x, y in zip(np.polynomial.legendre.leggauss(40), (1.0, 0.0)))
#: From here on both powers of the integrand make it smooth enough for the nodes.
LARGE = 30


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """The logarithm of x!, less Stirling's formula, for x of LARGE or more."""
    z = 1 / (x * x)
    return (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / x


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x"""
    e = (x - mean) / mean
    return mean * ((1 + e) * np.log1p(e) - e)


def _tail_by_integral(i: np.ndarray, j: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X > i) for X ~ Binomial(i + j + 1, p), i and j of LARGE or more: t ** i (1 - t) ** j is integrated from p away from its peak.

    The work does not grow with i and j: the integral ends where the integrand is
    exp(-42) of its value at p.
    """
    n, q = i + j, 1 - p
    at_p = (n + 1) * np.sqrt(n / (2 * math.pi * i * j)) * np.exp(_stirling_error(n) - _stirling_error(i) - _stirling_error(j) - _deviance(i, n * p) - _deviance(j, n * q))
    left = p * n <= i
    sign = np.where(left, -1.0, 1.0)
    up, down = sign / p, -sign / q
    s = np.sqrt(i * j / n) / n
    z = np.abs(p - i / n) / s
    most = np.where(left, p, q) * (1 - 1e-9)
    length = np.minimum(s * (np.sqrt(z * z + 84) - z), most)
    for _ in range(4):  # Newton's steps to the end; from the first on they come from beyond it
        short = i * np.log1p(up * length) + j * np.log1p(down * length) + 42
        length = np.clip(length - short / (i * up / (1 + up * length) + j * down / (1 + down * length)), length / 4, most)
    total = np.zeros_like(p)
    for x, w in zip(_NODES, _WEIGHTS):
        u = length * x
        total += w * np.exp(i * np.log1p(up * u) + j * np.log1p(down * u))
    beyond = at_p * length * total
    return np.where(left, beyond, 1 - beyond)


def binomial_tail(k, n, p) -> pd.Series:
    """P(X >= k) for X ~ Binomial(n, p): the regularised incomplete beta function I_p(k, n - k + 1), by its continued fraction, or by an integral where that would take many steps."""
    k, n, p = (np.asarray(x, float) for x in np.broadcast_arrays(k, n, p))
    out = np.where(k <= 0, 1.0, np.where((k > n) | (p <= 0), 0.0, np.where(p >= 1, 1.0, np.nan)))
    at = np.flatnonzero(np.isnan(out) & ~np.isnan(p))
    large = np.minimum(k[at] - 1, n[at] - k[at]) >= LARGE
    some, at = at[large], at[~large]
    out[some] = np.clip(_tail_by_integral(k[some] - 1, n[some] - k[some], p[some]), 0.0, 1.0)
    a, b, x = k[at], n[at] - k[at] + 1, p[at]
    # The fraction converges fast below the mean; above it the other tail is taken.
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + step * d), safe(1 + step / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    value = front * h
    out[at] = np.clip(np.where(flip, 1 - value, value), 0.0, 1.0)
    return pd.Series(out)


def binomial_pvalues(profile: DataFrame, segments: DataFrame, width: int = 15) -> DataFrame:
    """(segment_id, pos, n, p): the chance of a base's count and of the counts around it, given the segment's total."""
    return binomial_of_placed(join_points(profile, segments), width)


def binomial_of_placed(placed: DataFrame, width: int = 15, keep: Sequence[str] = ()) -> DataFrame:
    """As binomial_pvalues, for signal (segment_id, start, end, pos, n) that has its segments already; keep: other columns to bring along."""
    # Totals first: rows dealt by segment serve the sums of its bins too.
    inside = placed.select("segment_id", "start", "end", "pos", "n", *keep).withColumn("total", F.sum("n").over(Window.partitionBy("segment_id")))
    sums = window_sums(inside, width, ("segment_id",), own=False)
    lo, hi = F.greatest("start", F.col("pos") - width), F.least("end", F.col("pos") + width)
    out = ("segment_id", "pos", "n", *keep)
    ready = sums.select(*out, "window_sum", "total", (F.col("end") - F.col("start")).alias("length"), ((hi - lo) / (F.col("end") - F.col("start"))).alias("share"))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, around, total, length, share = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "window_sum", "total", "length", "share"))
            p = binomial_tail(n - 1, total, 1.0 / length) * binomial_tail(around, total, share)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(p.to_numpy())], [*out, "p"])

    return ready.mapInArrow(tails, StructType([*ready.select(*out).schema.fields, StructField("p", DoubleType())]))


def bases_output(found: DataFrame, keys=("contig", "strand", "pos")) -> DataFrame:
    """The least p of each base over all segments that hold it, whatever it is."""
    return found.groupBy(*keys).agg(F.min("p").alias("p"))


def significance_windows(bases: DataFrame, width: int, threshold: float = 0.05, keys=("segment_id",)) -> DataFrame:
    """Merged windows around bases below the threshold, with the least p."""
    from .intervals import merge

    wide = bases.where(F.col("p") < threshold).select(*keys, (F.col("pos") - width).alias("start"), (F.col("pos") + width + 1).alias("end"), "p")
    return merge(wide, keys, 0, [F.min("p").alias("p")])


def bootstrap_draws(rows: DataFrame, n_boot: int, seed: int = 7) -> DataFrame:
    """(rand_id, times and the columns of rows): resamples with replacement of rows that have an index `idx` from 0 on.

    Draws are hashes, so they are the same anywhere; the pairs of resample and
    draw are a distributed range, and nothing is collected but the number of rows.
    """
    n = rows.count()
    draws = rows.sparkSession.range(n_boot * n).select(F.floor(F.col("id") / max(1, n)).alias("rand_id"), (F.col("id") % max(1, n)).alias("draw"))
    idx = (hash_number(seed, F.col("rand_id"), F.col("draw")) % max(1, n)).alias("idx")
    return draws.select("rand_id", idx).groupBy("rand_id", "idx").agg(F.count("*").alias("times")).join(rows, "idx")


def count_ratio(test: str = "test", control: str = "control", times: Column | None = None) -> Column:
    """sum(test) / sum(control); infinite without control."""
    times = F.lit(1) if times is None else times
    return F.coalesce(F.sum(F.col(test) * times) / F.nullif(F.sum(F.col(control) * times), F.lit(0)), F.lit(math.inf))


def bootstrap_statistic(rows: DataFrame, statistic: Callable[[Column], Column], n_boot: int, seed: int = 7) -> DataFrame:
    """(rand_id, value): any aggregate of rows for each resample; it is given how often a row was drawn."""
    return bootstrap_draws(rows, n_boot, seed).groupBy("rand_id").agg(statistic(F.col("times")).alias("value"))


def bootstrap(rows: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, n_boot: int, seed: int = 7) -> DataFrame:
    """Any function of a resample, a pandas frame with a column rand_id and each row as often as it was drawn."""
    drawn = bootstrap_draws(rows, n_boot, seed)
    again = drawn.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_i", "times")
    return again.groupBy("rand_id").applyInPandas(func, schema)


def boot_ci(values: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """One row with the named quantiles of the values of all resamples."""
    return values.agg(*(F.percentile("value", F.lit(q)).alias(name) for name, q in quantiles.items()))


def bootstrap_ratio(rows: DataFrame, n_boot: int = 1000, seed: int = 7, quantiles=(0.025, 0.975)) -> DataFrame:
    """ratio, lo, hi of sum(test) / sum(control): rows have index 0.. (`idx`)."""
    ci = boot_ci(bootstrap_statistic(rows, lambda times: count_ratio(times=times), n_boot, seed), dict(zip(("lo", "hi"), quantiles)))
    return rows.agg(count_ratio().alias("ratio")).crossJoin(ci)  # one row each


def set_enrichment(rows: DataFrame, members: DataFrame, on: str, n_boot: int = 1000, seed: int = 7) -> DataFrame:
    """ratio, lo, hi of sum(test) / sum(control) over the rows whose key is in a set; they are numbered anew by the key, a number that no two rows share."""
    inside = rows.join(members.select(on).distinct(), on, "left_semi")
    numbered = with_rank(inside, F.floor(F.col(on) / 65_536), [on], "idx", 0)
    return bootstrap_ratio(numbered, n_boot, seed)


def rand_apply(draws: DataFrame, keys: list[str], func: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Any function of the rows of a randomisation (or bootstrap) of one key."""
    return draws.groupBy(*keys).applyInPandas(func, schema)


def average_distance(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """sum(n1 n2 |p1 - p2|) / sum(n1 n2) by key, from running sums over both profiles in order: no pairs are made."""
    both = a.select(key, "pos", F.col("n").alias("x"), F.lit(0).cast("long").alias("y")).unionByName(b.select(key, "pos", F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))
    both = both.groupBy(key, "pos").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    p, x, y = F.col("pos"), F.col("x"), F.col("y")
    part = x * (p * run(y) - run(p * y)) + y * (p * run(x) - run(p * x))
    return both.withColumn("d", part).groupBy(key).agg((F.sum("d") / F.nullif((F.sum("x") * F.sum("y")).cast("double"), F.lit(0.0))).alias("distance")).where("distance is not null")


def min_distance(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The mean over a's sites of the distance to the nearest of b's, by key; not symmetric."""
    both = a.select(key, "pos", F.lit(1).alias("is_a")).unionByName(b.select(key, "pos", F.lit(0).alias("is_a")))
    at = F.when(F.col("is_a") == 0, F.col("pos"))
    w = Window.partitionBy(key).orderBy("pos")
    before, after = F.max(at).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.min(at).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("d", F.least(F.col("pos") - before, after - F.col("pos"))).where("is_a = 1 and d is not null")
    return near.groupBy(key).agg(F.avg("d").alias("distance"))


def profile_correlation(a: DataFrame, b: DataFrame, segments: DataFrame, width: int = 10) -> DataFrame:
    """(segment_id, rho): Spearman's correlation of two smoothed profiles (segment_id, pos, n) over all bases of each segment that has signal in both.

    Bases without signal count, and are never laid out: they share one rank, which
    follows from how many they are.  Null where a profile is even.
    """
    key = "segment_id"
    bounds = segments.select(key, "start", "end")

    def ranked(df: DataFrame, name: str) -> DataFrame:
        """Smoothed values within their segment, as ranks among all its bases, less the mean rank."""
        runs = coverage_runs(df.select(key, "pos", "n"), width, width, (key,)).withColumnsRenamed({"start": "_s", "end": "_e"}).join(bounds, key)
        runs = runs.select(key, F.greatest("_s", "start").alias("s"), F.least("_e", "end").alias("e"), "n", (F.col("end") - F.col("start")).alias("length")).where("s < e")
        ties = runs.groupBy(key, "n", "length").agg(F.sum(F.col("e") - F.col("s")).alias("c"))
        w = Window.partitionBy(key)
        zeros = F.col("length") - F.sum("c").over(w)
        below = F.sum("c").over(w.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
        mean = (F.col("length") + 1) / 2
        ranks = ties.select(key, "n", (zeros + below + (F.col("c") + 1) / 2 - mean).alias("r"), ((zeros + 1) / 2 - mean).alias("z"))
        return runs.join(ranks, [key, "n"]).select(key, "length", F.explode(F.sequence("s", F.col("e") - 1)).alias("pos"), F.col("r").alias(name), F.col("z").alias(f"{name}0"))

    x, y = ranked(a, "x"), ranked(b, "y")
    zero = x.groupBy(key, "length").agg(F.first("x0").alias("zx")).join(y.groupBy(key).agg(F.first("y0").alias("zy")), key)
    both = x.select(key, "pos", "x").join(y.select(key, "pos", "y"), [key, "pos"], "full").join(zero, key)
    dx, dy = F.coalesce("x", "zx"), F.coalesce("y", "zy")
    rest = F.col("length") - F.col("m")
    sums = both.groupBy(key, "length", "zx", "zy").agg(F.count("*").alias("m"), F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"))
    xy, xx, yy = F.col("xy") + rest * F.col("zx") * F.col("zy"), F.col("xx") + rest * F.col("zx") * F.col("zx"), F.col("yy") + rest * F.col("zy") * F.col("zy")
    return sums.select(key, F.when((xx > 1e-9) & (yy > 1e-9), xy / F.sqrt(xx * yy)).alias("rho"))


def reproducibility_z(a: DataFrame, b: DataFrame, segments: DataFrame, rands: int, seed: int = 42) -> DataFrame:
    """(segment_id, distance, z): the average distance of two profiles against those of a's counts placed anew; segments without signal in either are left out."""
    inside = [join_points(x, segments).select("segment_id", "pos", "n") for x in (a, b)]
    observed = average_distance(inside[0], inside[1], "segment_id")
    drawn = randomise_tags(a, segments, rands, seed).select(F.concat_ws("|", "segment_id", "rand_id").alias("key"), "pos", "n")
    fixed = inside[1].withColumn("rand_id", F.explode(F.sequence(F.lit(0), F.lit(rands - 1)))).select(F.concat_ws("|", "segment_id", "rand_id").alias("key"), "pos", "n")
    random = average_distance(drawn, fixed, "key").withColumn("segment_id", F.substring_index("key", "|", 1).cast("long"))
    moments = random.groupBy("segment_id").agg(F.avg("distance").alias("mean"), F.stddev_samp("distance").alias("sd"))
    return observed.join(moments, "segment_id").select("segment_id", "distance", ((F.col("distance") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"))


def gene_averages(found: DataFrame, keys: list[str]) -> DataFrame:
    """The mean p of a base over the transcripts that have it."""
    return found.where("p is not null").groupBy(*keys).agg(F.avg("p").alias("p"))
