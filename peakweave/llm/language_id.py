"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters, lower-cased, with anything
but letters read as one blank.  A value is the n-gram's share of the text's
n-grams times its inverse document frequency, which is counted over all
training rows.  Weights are trained by follow-the-regularised-leader (proximal,
per coordinate) with an elastic net on a bounded sample, and the temperature of
the softmax is set on rows that the training left out.

The softmax only shares a text out among the languages learned; it says nothing
of texts in none of them.  So a text can also be given a confidence: the mean
log ratio of its n-grams' shares in a language to equal shares, for the language
that suits best, words without a letter counting as LETTERLESS n-grams of ratio 1
each, through a logistic curve.  The curve is fitted on the rows that the training left out, each
once with its own language and once as if that had not been learned.

Bounds: the weights are fitted on about PER_LANG sampled rows of each language
(chosen by a hash, a repeated row once); every language that occurs is learned.

Defined results: `und` with score 0 for a null text, a text without a letter,
and for all rows if nothing can be learned from; of languages with equal scores
the first by name; confidence is 0 for `und`, and 1 for all others if no row was
left out to fit it on; repeated rows are judged each for itself; other columns are
not read.  A long text is read in parts, and its n-grams are those of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_back, remainder, summed, texts, with_columns
from .spans import text_parts, words

BITS = 16
ORDERS = (1, 2, 3)
PER_LANG = 400
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-4, 1e-4
#: Bytes of texts whose n-grams are held at once; an n-gram takes some 60 bytes.
BLOCK = 1 << 18
#: Features are shares, far below 1; this brings them to a scale that suits the rates above.
SCALE = 50.0
#: Added to the count of each n-gram in a language's profile.
PROFILE_PRIOR = 0.5
#: N-grams that a word without a letter counts for in the confidence.
LETTERLESS = 4

_maps: dict[str, np.ndarray] = {}


def _characters() -> np.ndarray:
    """Every code point's lower case; 32 for all that are no letters."""
    if "lower" not in _maps:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _maps["lower"] = out
    return _maps["lower"]


def ngrams(data: np.ndarray, offsets: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block of texts, the text of each, which texts have a letter, and the last characters.

    before: the last characters of the part before, if the block is a part of a
    text that goes on; its n-grams then are those that end in this part.
    """
    m = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    c = _characters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    text = np.repeat(np.arange(m), np.diff(at))
    letter = c != 32
    has = np.bincount(text[letter], minlength=m) > 0
    # Runs of blanks count once.
    keep = letter.copy()
    keep[1:] |= (letter[:-1]) | (text[1:] != text[:-1])
    keep[:1] = True
    done = 0 if before is None else len(before)
    if done and len(c) and before[-1] == 32 and c[0] == 32:
        keep[0] = False
    c, text = c[keep], text[keep]
    if done:
        c, text = np.concatenate([before, c]), np.concatenate([np.zeros(done, text.dtype), text])
    grams, owners = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    h = np.zeros(len(c), np.uint32)
    for n in ORDERS:
        k = len(c) - n + 1
        if k <= 0:
            break
        h = (h[:k] * np.uint32(0x9E3779B1) + c[n - 1 :]) if n > 1 else c.copy()
        inside = text[:k] == text[n - 1 :]
        inside[: max(0, done - n + 1)] = False
        x = (h + np.uint32(n * 0x51ED27)) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        grams.append((x >> np.uint32(32 - BITS))[inside])
        owners.append(text[:k][inside])
    return np.concatenate(grams), np.concatenate(owners), has, c[max(0, len(c) - ORDERS[-1] + 1) :]


class Grams(NamedTuple):
    """The n-grams of a block of texts: its first and end row, buckets, the text of each, how often each counts (None: once), which texts have a letter, and words without a letter."""

    first: int
    end: int
    gram: np.ndarray
    owner: np.ndarray
    times: np.ndarray | None
    has: np.ndarray
    letterless: np.ndarray

    def totals(self) -> np.ndarray:
        return np.bincount(self.owner, self.times, self.end - self.first).astype(np.int64)

    def means(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight (buckets x columns) of the n-grams of each text."""
        m, n = self.end - self.first, np.maximum(1, self.totals())
        out = np.empty((m, weights.shape[1]))
        for i in range(weights.shape[1]):
            w = weights[:, i][self.gram]
            out[:, i] = np.bincount(self.owner, w if self.times is None else w * self.times, m) / n
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct buckets by text, how often each occurs, and the first of each text (one more than texts)."""
        if self.times is not None:
            return self.gram.astype(np.int64), self.times, np.array([0, len(self.gram)])
        x, n = np.unique((self.owner.astype(np.uint64) << np.uint64(BITS)) | self.gram, return_counts=True)
        return (x & np.uint64((1 << BITS) - 1)).astype(np.int64), n, np.searchsorted(x >> np.uint64(BITS), np.arange(self.end - self.first + 1))


def gram_blocks(column: pa.Array) -> Iterator[Grams]:
    """The n-grams of all texts, block by block; those of a long text are counted part by part."""
    count, before, has, letterless = None, None, False, 0
    for a, b, data, offsets, begins, last in text_parts(column, BLOCK):
        if begins and last:
            gram, owner, with_letter, _ = ngrams(data, offsets)
            yield Grams(a, b, gram, owner, None, with_letter, letterless_words(data, offsets))
            continue
        if begins:
            count, before, has, letterless = np.zeros(1 << BITS, np.int64), None, False, 0
        gram, _, with_letter, before = ngrams(data, offsets, before)
        count += np.bincount(gram, minlength=1 << BITS)
        has, letterless = has or bool(with_letter[0]), letterless + int(letterless_words(data, offsets)[0])
        if last:
            gram = np.flatnonzero(count)
            yield Grams(a, b, gram, np.zeros(len(gram), np.int64), count[gram], np.array([has]), np.array([letterless]))


def letterless_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words without a letter each text of a block has."""
    starts, ends, first = words(data, offsets)
    lead = (data & 0xC0) != 0x80
    letter = np.zeros(len(data), np.int64)
    letter[lead] = _characters()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)] != 32
    before = np.concatenate(([0], np.cumsum(letter)))
    none = np.concatenate(([0], np.cumsum(before[ends] == before[starts])))
    return none[first[1:]] - none[first[:-1]]


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """How many texts hold each n-gram bucket; the last number counts the texts."""
    out = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for x in gram_blocks(batch.column(0)):
            out[:-1] += np.bincount(x.pairs()[0], minlength=1 << BITS)
            out[-1] += x.end - x.first
    return out


def _vectors(sample: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray, int, int]]:
    """(lang, buckets, shares, n-grams, words without a letter) of the sampled rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in gram_blocks(batch.column(1)):
                which, n, cut = x.pairs()
                rows = np.flatnonzero(x.has).tolist()
                columns = [pa.array([batch.column(0)[x.first + i].as_py() for i in rows], pa.string())]
                columns += [pa.array([y[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in rows], pa.binary()) for y in (which, n)]
                columns.append(pa.array(x.letterless[rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n", "letterless"])

    out = []
    for r in sample.mapInArrow(given_back(make), "lang string, bucket binary, n binary, letterless long").collect():  # the sampled rows
        n = np.frombuffer(r["n"], np.int32).astype(np.float32)
        total = float(n.sum(dtype=float))
        out.append((r["lang"], np.frombuffer(r["bucket"], np.int32), n / np.float32(total), int(total), r["letterless"]))
    return out


def fit_confidence(vectors: list[tuple[str, np.ndarray, np.ndarray, int, int]], used: list[int], left_out: list[int], langs: list[str], size: int) -> tuple[np.ndarray, float, float]:
    """Log ratios (buckets x languages) of the used rows, and slope and intercept of the confidence on the rows left out."""
    k = len(langs)
    number = {x: i for i, x in enumerate(langs)}
    count = np.full((size, k), PROFILE_PRIOR)
    for i in used:
        lang, bucket, share, n, _ = vectors[i]
        count[bucket, number[lang]] += share * n
    ratio = np.log(count / count.sum(axis=0) * size).astype(np.float32)
    fit, known = [], []
    for i in left_out:
        lang, bucket, share, n, letterless = vectors[i]
        means = share @ ratio[bucket] * (n / (n + LETTERLESS * letterless))
        # With one language alone, the same counts on other n-grams stand for the unlearned one.
        strange = np.delete(means, number[lang]) if k > 1 else share @ ratio[(bucket + size // 2) % size] * (n / (n + LETTERLESS * letterless))
        fit += [means[number[lang]], strange.max()]
        known += [1.0, 0.0]
    if not fit:
        return ratio, 0.0, np.inf
    x, y = np.stack([fit, np.ones(len(fit))], axis=1), np.array(known)
    # No row is taken as certain, as with the temperature.
    y = np.where(y > 0, 1 - 1 / (len(left_out) + 2), 1 / (len(left_out) + 2))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (y - p) - 1e-3 * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return ratio, float(b[0]), float(b[1])


def train(vectors: list[tuple[str, np.ndarray, np.ndarray, int, int]], langs: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, tuple[np.ndarray, float, float]]:
    """Weights (buckets x languages), biases, temperature and what fit_confidence gives, by FTRL-proximal with an elastic net."""
    size, k = len(idf), len(langs)
    number = {x: i for i, x in enumerate(langs)}
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))
    rng = np.random.default_rng(7)
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0], vectors[i][1].tobytes(), vectors[i][2].tobytes()))
    order = list(rng.permutation(order))
    left_out, used = order[::5], [x for i, x in enumerate(order) if i % 5] or order

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    def features(i: int) -> tuple[int, np.ndarray, np.ndarray]:
        lang, bucket, share, *_ = vectors[i]
        return number[lang], np.append(bucket, size), np.append(SCALE * share * idf[bucket], 1.0)

    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            y, at, x = features(i)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    logits, truth = [], []
    for i in left_out:
        y, at, x = features(i)
        logits.append(x @ w[at])
        truth.append(y)
    logits, truth = np.array(logits), np.array(truth)

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        nll = np.log(np.exp(s).sum(axis=1, keepdims=True)) - s
        return float((target * nll).sum())

    # No row is taken as certain, or rows that are all right would send the temperature to 0.
    target = np.full((len(truth), k), 1 / (len(truth) + 2) / max(1, k - 1))
    target[np.arange(len(truth)), truth] = 1 - (1 / (len(truth) + 2) if k > 1 else 0)
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    return w[:-1], w[-1], float(temperature), fit_confidence(vectors, used, left_out if len(order) > len(left_out) else [], langs, size)


def language_model(docs: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray, float, tuple[np.ndarray, float, float]]:
    """Languages, weights with the inverse document frequencies in them, biases, temperature and what fit_confidence gives, learned from rows outside the fold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where((remainder(F.col("doc_id"), folds) != fold) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy("lang").collect()  # one row for each language
    df = summed(rows.select("text"), _document_frequencies, (1 << BITS) + 1)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    if not counts:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, (np.zeros((1 << BITS, 0), np.float32), 0.0, np.inf)
    # A share of a hash, so that the same rows are taken on any cluster; the table has one row for each language.
    wanted = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, PER_LANG / r["count"]) * (1 << 20)) + 1) for r in counts], "lang string, below int")
    chosen = rows.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("below")).select("doc_id", "lang", "text").dropDuplicates(["doc_id", "text", "lang"])
    vectors = _vectors(chosen.select("lang", "text"))
    langs = sorted({v[0] for v in vectors})
    if not langs:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, (np.zeros((1 << BITS, 0), np.float32), 0.0, np.inf)
    w, bias, temperature, known = train(vectors, langs, idf)
    return langs, (SCALE * idf[:, None] * w).astype(np.float32), bias, temperature, known


def with_language(docs: DataFrame, model: tuple, text_col: str = "text", pred: str = "lang_pred", score: str = "score", confidence: str | None = None) -> DataFrame:
    """All columns of docs, and the predicted language, its probability among the languages learned and, if named, the confidence that the text is in any of them."""
    langs, weights, bias, temperature, (ratio, slope, intercept) = model
    shared = docs.sparkSession.sparkContext.broadcast((weights, ratio if confidence else None))

    def predict(column: pa.Array) -> list[pa.Array]:
        weights, ratio = shared.value
        names, scores, sure = [], [], []
        if not langs:
            names, scores, sure = ["und"] * len(column), [0.0] * len(column), [0.0] * len(column)
        for x in gram_blocks(column) if langs else ():
            s = (x.means(weights) + bias) / temperature
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names += [langs[k] if ok else "und" for k, ok in zip(best.tolist(), x.has.tolist())]
            scores += np.where(x.has, p[np.arange(len(best)), best], 0.0).tolist()
            if confidence:
                n = np.maximum(1, x.totals())
                fit = x.means(ratio).max(axis=1) * (n / (n + LETTERLESS * x.letterless))
                sure += np.where(x.has, 1 / (1 + np.exp(-np.clip(slope * fit + intercept, -700, 700))), 0.0).tolist()
        out = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return [*out, pa.array(sure, pa.float64())] if confidence else out

    fields = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    return with_columns(docs, text_col, fields + ([T.StructField(confidence, T.DoubleType())] if confidence else []), predict)


def identify_languages(docs: DataFrame, folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    model = language_model(docs, folds, fold, id_col, text_col, lang_col)
    rows = texts(docs, id_col, text_col).withColumn("held_out", remainder(F.col("doc_id"), folds) == fold)
    return with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")
