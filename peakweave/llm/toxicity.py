"""Toxicity scores by weak supervision.

Voters are words (runs of letters, A-Z as a-z), beginnings of words, and
patterns of a text.  A word or beginning votes if it occurs once, twice or four
times; which ones vote is mined from a bounded sample of labelled rows: those
that occur in enough distinct toxic texts and hardly in others.  Patterns are
shares of capitals, exclamation marks and symbols above a limit.  The given
label is a voter too, and a fallible one.

A generative label model with a hidden class estimates by expectation-maximisation
how often each voter, the given label included, fires in each class, and how
voters depend on one another: in each class a voter's rate depends on whether its
parent fires, and the parents make the tree that carries the most conditional
mutual information.  The tree is there from the first round on: toxic texts are of
several kinds, and without it the silence of many alike voters would outvote the rest.  The model's posteriors train a linear classifier (logistic
regression with a ridge penalty) on the votes, and that classifier scores every
row.

Bounds: SAMPLE labelled ids are learned from, chosen by a hash (of several texts
of one id the least); the model has VOTERS word voters.  What occurs in the sample
is counted by the executors; the driver gets features that can become voters.

Defined results: a null or empty text has no vote and the score of such texts;
without a labelled row every score is 0; a null id counts as the empty string
in the split; several labels of one id count as one, toxic if half of them are;
repeated rows are scored each for itself.  A long text is read in parts.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, remainder, summed, texts, with_columns, written
from .spans import HashTable, mix, padded, span_hashes, text_parts

SAMPLE, VOTERS = 6_000, 512
#: Bytes of texts whose features are held at once.
BLOCK = 1 << 18
#: Bytes of the beginnings of words, and the numbers of occurrences that vote.
BEGINNINGS, TIMES = (5, 6, 7, 8, 9), (1, 2, 4)
#: A word voter occurs in so many distinct toxic texts at least, with this share of toxic ones or more, and is as unlikely under the base rate.
SUPPORT, PRECISION, DEVIATIONS = 4, 0.6, 5.0
#: What the given label's rates in class 1 and in class 0 are expected to be, and for how many times the rows labelled 1 that counts.
LABEL_RIGHT, LABEL_WRONG, LABEL_PRIOR = 0.95, 0.02, 0.5
#: A word is left out if a stronger voter occurs in this share of its toxic texts.
ACCOMPANIED = 0.8
#: Symbols and limits of the pattern voters: shares of capitals, of "!" and of symbols among all bytes.
SYMBOLS = b"#*$%&|<>@~^"
LIMITS = (0.5, 0.03, 0.05)
ORDERS = 3
#: Rounds of the label model, rows that a voter's rate in a class counts for where its parent's state is known too, and the ridge.
ROUNDS, TREE_PRIOR, RIDGE = 25, 4.0, 0.1

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of letters in a block of texts and of their beginnings, with two free low bits, and the text of each.

    A beginning hashes as a word of those bytes does.
    """
    n = len(data)
    letter = _LETTERS[data]
    edge = ~letter
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = letter.copy()
    begins[1:] &= edge[:-1] | first[1:n]
    stops = edge | first[:n]
    stops[1:] &= letter[:-1]
    stops[:1] = False
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    if len(ends) < len(starts):
        ends = np.append(ends, n)
    pad = padded(data, True)
    owner = np.searchsorted(offsets, starts, "right") - 1
    out, owners = [span_hashes(pad, starts, ends)], [owner]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        out.append(span_hashes(pad, starts[longer], starts[longer] + size))
        owners.append(owner[longer])
    return np.concatenate(out) & ~np.uint64(3), np.concatenate(owners)


def with_times(h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The distinct features of one text: its hashes, with the level of how often each occurs (1: once, 2: twice, 3: four times or more) in the low bits."""
    base, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, times, len(base))
    return np.sort(np.concatenate([base[n >= t] | np.uint64(level) for level, t in enumerate(TIMES, 1)]))


def pattern_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Capitals, exclamation marks, symbols and bytes of each text (texts x 4)."""
    out = [np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets]) for mask in (_CAPITAL[data], data == 33, _SYMBOL[data])]
    return np.stack([*out, np.diff(offsets)], axis=1)


def patterns(counts: np.ndarray) -> np.ndarray:
    """Which pattern voters fire (texts x patterns)."""
    return counts[:, :3] / np.maximum(1, counts[:, 3:]) > np.array(LIMITS)


def text_features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, features, the text of each, how often it occurs, patterns) block by block; a long text's features are counted part by part."""
    held, counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
    for a, b, data, offsets, begins, last in text_parts(column, BLOCK):
        h, owner = word_features(data, offsets)
        found = pattern_counts(data, offsets)
        if begins and last:
            yield a, b, h, owner, np.ones(len(h), np.int64), patterns(found)
            continue
        if begins:
            held, counts = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0
        new, n = np.unique(h, return_counts=True)
        both, at = np.unique(np.concatenate([held[0], new]), return_inverse=True)
        held = both, np.bincount(at, np.concatenate([held[1], n]), len(both)).astype(np.int64)
        counts = counts + found
        if last:
            yield a, b, held[0], np.zeros(len(held[0]), np.int64), held[1], patterns(counts)


def features_by_text(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct features with how often they occur, patterns) of each text in order."""
    for a, b, h, owner, times, found in text_features(column):
        order = np.argsort(owner, kind="stable")
        h, times, cut = h[order], times[order], np.searchsorted(owner[order], np.arange(b - a + 1))
        for i in range(b - a):
            yield with_times(h[cut[i] : cut[i + 1]], times[cut[i] : cut[i + 1]]), found[i]


def _toxic_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of enough distinct toxic rows, in how many toxic rows each occurs, and in how many distinct ones; sorted by feature."""
    groups = [f"g{i}" for i in range(ORDERS)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, _ in features_by_text(batch.column(0)):
                if len(x):
                    # Near copies count once: they share their smallest feature under most orders.
                    least = [mix(x ^ np.uint64(i << 32)).min().astype(np.int64) for i in range(ORDERS)]
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), *(pa.array(np.full(len(x), g, np.int64)) for g in least)], ["feature", *groups])

    rows = sample.where("toxic = 1").select("text").mapInArrow(given_back(make), "feature long, " + ", ".join(f"{g} long" for g in groups))
    found = rows.groupBy("feature").agg(F.count("*").alias("n"), *(F.size(F.collect_set(g)).alias(g) for g in groups))
    found = found.select("feature", "n", F.greatest(*groups).alias("support")).where(F.col("support") >= SUPPORT).toArrow()
    feature = found["feature"].to_numpy().view(np.uint64)
    order = np.argsort(feature)
    return feature[order], found["n"].to_numpy()[order], found["support"].to_numpy()[order].astype(np.int64)


def _rows_with(sample: DataFrame, feature: np.ndarray) -> np.ndarray:
    """In how many rows each of the features occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(len(feature), np.int64)
        for batch in batches:
            for x, _ in features_by_text(batch.column(0)):
                out[np.flatnonzero(np.isin(feature, x, assume_unique=True))] += 1
        return out

    return summed(sample.select("text"), count, len(feature)) if len(feature) else np.zeros(0, np.int64)


def _votes(sample: DataFrame, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """toxic, which of the features (sorted) it holds, and the patterns of each sampled row, in a fixed order."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            holds, found = [], []
            for x, p in features_by_text(batch.column(1)):
                holds.append(np.packbits(np.isin(feature, x, assume_unique=True)).tobytes())
                found.append(p.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(holds, pa.binary()), pa.array(found, pa.binary())], ["toxic", "holds", "patterns"])

    got = sample.mapInArrow(given_back(make), "toxic int, holds binary, patterns binary").collect()  # SAMPLE rows at most, a bit for each feature
    got.sort(key=lambda r: (r["toxic"], bytes(r["holds"]), bytes(r["patterns"])))
    holds = np.array([np.unpackbits(np.frombuffer(r["holds"], np.uint8), count=len(feature)) for r in got], np.uint8).reshape(len(got), len(feature))
    return np.array([r["toxic"] for r in got]), holds, np.array([np.frombuffer(r["patterns"], np.uint8) for r in got]).reshape(len(got), len(LIMITS))


def candidates(feature: np.ndarray, n1: np.ndarray, n: np.ndarray, toxic: int, rows: int) -> np.ndarray:
    """Places of the features that tell toxic rows from others, the strongest first: n1 of their n rows are toxic."""
    rate = max(toxic, 1) / rows
    precision = (n1 + rate) / (n + 1)
    deviations = (n1 - n * rate) / np.sqrt(n * rate * (1 - rate) + 1e-9)
    good = np.flatnonzero((precision >= PRECISION) & (deviations >= DEVIATIONS))
    return good[np.lexsort((feature[good], -deviations[good]))][: 8 * VOTERS]


def choose_voters(holds: np.ndarray) -> list[int]:
    """The candidates (columns, the strongest first; toxic rows) that become voters: one whose toxic texts nearly all hold a stronger voter adds nothing (it shares a passage with that one)."""
    holds, chosen = np.ascontiguousarray(holds.T, np.float32), []
    for i in range(len(holds)):
        if not chosen or (holds[chosen] @ holds[i]).max() < ACCOMPANIED * holds[i].sum():
            chosen.append(i)
        if len(chosen) == VOTERS:
            break
    return chosen


def dependency_tree(fires: np.ndarray, post: np.ndarray) -> np.ndarray:
    """The parent of each voter (-1: none) in the tree of most mutual information between voters within the classes."""
    k = fires.shape[1]
    info = np.zeros((k, k))
    for w in (post, 1 - post):
        total = w.sum() + 4e-3
        on = w @ fires + 2e-3
        both = (fires * w[:, None]).T @ fires + 1e-3
        off = total - on
        for x, row, column in ((both, on, on), (on[:, None] - both, on, off), (on[None, :] - both, off, on), (total - on[:, None] - on[None, :] + both, off, off)):
            x = np.maximum(x, 1e-3)
            info += x * np.log(x * total / (row[:, None] * column[None, :]))
    parent, best, left = np.full(k, -1), np.full(k, -np.inf), np.ones(k, bool)
    at = 0
    for _ in range(k):
        left[at] = False
        better = left & (info[at] > best)
        best[better], parent[better] = info[at][better], at
        if left.any():
            at = int(np.argmax(np.where(left, best, -np.inf)))
    return parent


def label_model(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
    """Posterior probability of class 1 of each row (rows x voters of 0/1), and the given label's estimated rates in class 1 and 0."""
    fires, given = votes.astype(float), labels.astype(float)
    rows = len(given)
    post = np.where(labels == 1, 0.9, 0.1 * given.mean() + 0.01)
    parent = np.full(fires.shape[1], -1)
    before = np.zeros_like(fires)
    for step in range(ROUNDS):
        if step in (0, ROUNDS // 2) and fires.shape[1]:
            parent = dependency_tree(fires, post)
            before = np.where(parent >= 0, fires[:, parent], 0.0)
        log_odds = np.log((post.sum() + 1e-9) / (rows - post.sum() + 1e-9))
        strength = LABEL_PRIOR * given.sum() + 1
        rates = []
        for sign, w, expected in ((1, post, LABEL_RIGHT), (-1, 1 - post, LABEL_WRONG)):
            n = w.sum() + 1e-9
            on = (w @ fires + 0.5) / (n + 1)
            # A voter's rate by its parent's state, drawn to its rate in the class.
            with_parent = (w @ before + 1e-9), (w @ (1 - before) + 1e-9)
            both = (w @ (fires * before)), (w @ (fires * (1 - before)))
            rate1, rate0 = ((x + TREE_PRIOR * on) / (m + TREE_PRIOR) for x, m in zip(both, with_parent))
            rate = np.clip(np.where(before > 0, rate1, rate0), 1e-6, 1 - 1e-6)
            log_odds = log_odds + sign * (fires * np.log(rate) + (1 - fires) * np.log(1 - rate)).sum(axis=1)
            q = (w @ given + strength * expected) / (n + strength)
            rates.append(q)
            log_odds = log_odds + sign * (given * np.log(q) + (1 - given) * np.log(1 - q))
        post = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return post, (float(rates[0]), float(rates[1]))


def linear_classifier(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a logistic regression on posterior labels (Newton steps)."""
    x = np.column_stack([votes, np.ones(len(votes))]).astype(float)
    w = np.zeros(x.shape[1])
    w[-1] = np.log((post.mean() + 1e-3) / (1 - post.mean() + 1e-3))
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - post) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())  # full steps can overshoot
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity_model(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """Hashes of the word voters and the classifier's weights, learned from labelled rows outside the fold; None without any."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("double").alias("_toxic")).where(F.col("_toxic").isNotNull() & F.col("_id").isNotNull())
    known = known.where(remainder(F.col("_id"), folds) != fold).groupBy("_id").agg((F.avg("_toxic") >= 0.5).cast("int").alias("_toxic"))
    # SAMPLE ids, chosen by a hash: small enough to be sent to every task.
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = texts(docs, id_col, text_col)
    sample = rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["_id"]).where("text is not null")
    sample = written(sample.groupBy("_id").agg(F.min("text").alias("text"), F.first("_toxic").alias("toxic")).select("toxic", "text"), "toxicity-sample")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return None
    feature, n1, _ = _toxic_features(sample)
    best = candidates(feature, n1, _rows_with(sample, feature), toxic, n)
    # Features are looked up in order of their hashes, and used in order of their strength.
    order = np.argsort(feature[best])
    y, holds, found = _votes(sample, feature[best][order])
    holds = holds[:, np.argsort(order)]
    chosen = choose_voters(holds[y == 1])
    votes = np.column_stack([holds[:, chosen], found])
    return feature[best][chosen], linear_classifier(votes, label_model(votes, y)[0])


def with_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, text_col: str = "text", score: str = "score") -> DataFrame:
    """All columns of docs, and the score under the name given."""

    def judge(column: pa.Array) -> list[pa.Array]:
        out = np.zeros(len(column))
        if model is not None:
            voters, w = model
            bases, at_base = np.unique(voters & ~np.uint64(3), return_inverse=True)
            table = HashTable(max(10, len(bases).bit_length() + 2))
            table.add(bases | np.uint64(1), np.arange(len(bases)))
            # What a word gives once it occurs as often as each level asks.
            gives = np.zeros((len(bases), len(TIMES)))
            gives[at_base, (voters & np.uint64(3)).astype(int) - 1] = w[: len(voters)]
            for a, b, h, owner, times, found in text_features(column):
                at = table.find(h | np.uint64(1))
                hit = at >= 0
                pairs, which = np.unique(owner[hit] * (len(bases) + 1) + at[hit], return_inverse=True)
                n = np.bincount(which, times[hit], len(pairs))
                given = sum((gives[pairs % (len(bases) + 1), level] * (n >= t) for level, t in enumerate(TIMES)), np.zeros(len(pairs)))
                s = np.bincount(pairs // (len(bases) + 1), given, b - a).astype(float)
                s += found @ w[len(voters) : -1] + w[-1]
                out[a:b] = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        return [pa.array(out)]

    return with_columns(docs, text_col, [T.StructField(score, T.DoubleType())], judge)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of every row."""
    model = toxicity_model(docs, labels, folds, fold, id_col, text_col)
    rows = texts(docs, id_col, text_col).withColumn("held_out", remainder(F.col("doc_id"), folds) == fold)
    scored = with_toxicity(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
