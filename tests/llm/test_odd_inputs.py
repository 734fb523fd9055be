"""What hashes, long texts, shared ids, ties and many classes must not change; models against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from peakweave.llm import decontamination, encoding, jaccard_join, language_id, lattice, license_scan, lm_scoring, packing, quality, shingles, spans, token_counts, token_files, toxicity

SF = "/root/testdata/sf0.001"
BYTES, WORDS, PIECES = (encoding.tokenizer_path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def thue_morse(n, letters="eq"):
    """A word and its complement, which a polynomial hash modulo 2^64 with an odd base cannot tell apart from 1,024 letters on."""
    w = letters[0]
    while len(w) < n:
        w += w.translate(str.maketrans(letters, letters[::-1]))
    return w, w.translate(str.maketrans(letters, letters[::-1]))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def library(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_a_polynomial_hash_confuses(spark, tmp_path, n):
    x, y = thue_morse(n)
    docs = frame(spark, [(1, x), (2, x), (3, y)])
    want = library(BYTES, [x, x, y])
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs, BYTES).collect()) == [(i + 1, len(w)) for i, w in enumerate(want)]
    token_files.write_token_files(docs, str(tmp_path / "f"), BYTES, 2)
    assert {r.doc_id: r.ids_crc32 for r in token_files.token_file_digests(spark, str(tmp_path / "f")).collect()} == {i + 1: zlib.crc32(np.array([*w, 2], "<u4").tobytes()) for i, w in enumerate(want)}
    packed = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, WORDS).collect()}
    assert packed == {i + 1: zlib.crc32(np.array([*w, 1], "<u4").tobytes()) for i, w in enumerate(library(WORDS, [x, x, y]))}
    assert {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_join(docs, 3, 90).collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_words_that_a_polynomial_hash_confuses_count_apart(spark):
    x, y = thue_morse(1024)
    # 20, 21 and 23 are learned from.
    got = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, [(20, x), (21, x), (23, y)]), PIECES).collect()}
    assert not any(r.held_out for r in got.values())
    base = lambda c: math.log10((c + 0.1) / (6 + 0.1 * 4)) + math.log10((3 + 0.1) / (6 + 0.1 * 4))
    assert all(abs(got[i].base_score - base(c)) < 1e-9 for i, c in ((20, 2), (21, 2), (23, 1)))


def test_a_span_with_the_hash_of_another_is_not_it():
    e = encoding.ChunkEncoder(BYTES, True)
    e.lengths(pa.array(["one two"]))
    # Every key of the table gets the bytes of other spans of the same size.
    e.table.bytes[: e.table.n_bytes] = 122
    assert [list(ids) for _, _, ids, _ in e.encode(pa.array(["one two"]))] == library(BYTES, ["one two"])


LONG = [" ".join(f"{w}{i % 977}" for i, w in enumerate(["Der", "the", "über", "<b>", "x,y", "word\n"] * 60_000)), "a short text"]


def test_long_texts_come_in_parts_and_give_the_same():
    assert len(LONG[0]) > 2 * spans.BLOCK
    blocks = list(spans.text_parts(pa.array(LONG)))
    assert len(blocks) > 2 and b"".join(x[2].tobytes() for x in blocks).decode() == "".join(LONG)
    for path, spaced in ((BYTES, True), (WORDS, False)):
        want = library(path, LONG)
        e = encoding.ChunkEncoder(path, spaced)
        got = [list(x) for _, _, ids, n in e.encode(pa.array(LONG)) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == want and e.lengths(pa.array(LONG)).tolist() == [len(x) for x in want]
    data = np.frombuffer(LONG[0].encode(), np.uint8)
    gram, _, has, _ = language_id.ngrams(data, np.array([0, len(data)]))
    first = next(language_id.gram_blocks(pa.array(LONG)))
    assert first.has[0] and (np.bincount(gram, minlength=1 << 16)[first.gram] == first.times).all() and first.times.sum() == len(gram)
    features = next(toxicity.text_features(pa.array(LONG)))
    h, n = np.unique(toxicity.word_features(data, np.array([0, len(data)]))[0], return_counts=True)
    assert (features[2] == h).all() and (features[4] == n).all() and (features[5] == toxicity.patterns(toxicity.pattern_counts(data, np.array([0, len(data)])))).all()
    long = next(shingles.shingled(pa.array(LONG), 3))
    words = re.findall(r"[^\x20\x09-\x0D]+", LONG[0].lower())
    assert len(long.hashes) == len(words) - 2 and len(np.unique(long.hashes)) == len({tuple(words[i : i + 3]) for i in range(len(words) - 2)})
    assert decontamination.normalised(LONG[0] * 2) == " ".join((LONG[0] * 2).lower().split())


def test_long_texts_are_scored_like_their_words(spark):
    got = {r.doc_id: r for r in lm_scoring.lm_scores(frame(spark, [(20, LONG[0]), (21, LONG[1])]), PIECES).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in LONG]
    c = collections.Counter(w for ws in words for w in ws)
    n, v = sum(c.values()) + 2, len(c) + 1
    base = sum(k * math.log10((k if w in set(words[1]) else k) + 0.1) for w, k in collections.Counter(words[0]).items() if c[w] == k)
    base += sum(k * math.log10(c[w] + 0.1) for w, k in collections.Counter(words[0]).items() if c[w] != k)
    base += math.log10(2.1) - (len(words[0]) + 1) * math.log10(n + 0.1 * (v + 1))
    assert got[20].n_tokens == len(words[0]) + 1 and abs(got[20].base_score - base) < 1e-6 * abs(base)


def test_long_words_have_the_same_sums(monkeypatch):
    pieces, log_p = lattice.load_pieces(PIECES)
    model = lattice.Lattice(pieces, log_p)
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abcdeinrst"), n).astype(np.uint8)) for n in (600, 3000)]
    monkeypatch.setattr(lattice, "SLICE", 700)
    a, b = model.log_marginals(words), model.expected_counts(words, np.array([1.0, 2.0]))
    monkeypatch.setattr(lattice, "LONG_WORD", 1 << 20)
    c, d = model.log_marginals(words), model.expected_counts(words, np.array([1.0, 2.0]))
    assert np.allclose(a, c, rtol=1e-9) and np.allclose(b, d, rtol=1e-6, atol=1e-9)


def test_no_rounds_keep_the_vocabularys_scores(spark):
    pieces, log_p = lattice.load_pieces(PIECES)
    r = lm_scoring.lm_scores(frame(spark, [(20, "the")]), PIECES, rounds=0).first()
    share = (1 + lm_scoring.PIECE_PRIOR) / (2 + 2 * lm_scoring.PIECE_PRIOR)
    want = lattice.Lattice(pieces, log_p + math.log1p(-share)).log_marginals([b"the"])[0] / math.log(10) + math.log10(share)
    assert abs(r.score - want) < 1e-9


def near(words, *changes):
    return " ".join("changed" if i in changes else w for i, w in enumerate(words))


def test_rows_that_share_an_id(spark):
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    docs = frame(spark, [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 99)), (3, near(b, 99)), (5, "alone here now")])
    got = sorted((r.doc_id, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(docs, 3, 90).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (5, 5, 0)]
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text.split()[0]) for r in kept) == [(1, "a0"), (1, "b0"), (5, "alone")]
    twice = docs.unionByName(docs)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, twice, SF).collect()) == sorted((r.doc_id, r.text) for r in kept)


def test_short_items_and_ids_of_any_type(spark):
    docs = frame(spark, [(1, "So what is Two plus two, then"), (2, "what is two plus twofold"), (3, "nothing")])
    for kind, name in (("int", 7), ("string", "q7"), ("long", 7)):
        bench = spark.createDataFrame([(name, "two PLUS two"), (None, "  ")], f"item_id {kind}, text string")
        assert [(r.doc_id, r.item_id, r.distance) for r in decontamination.benchmark_matches(docs, bench).collect()] == [(1, name, 0)]
        assert sorted(r.doc_id for r in decontamination.decontaminated(docs, bench).collect()) == [2, 3]


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 70)]
    rows = [(i, " ".join(letters[i % 70] * int(rng.integers(2, 6)) + "a" for _ in range(8)), f"l{i % 70:02d}") for i in range(70 * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert {r.lang_pred for r in got} == {x for _, _, x in rows} and np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_language_ties_and_brute_force(spark):
    """Scores are the softmax of mean n-gram weights; of equal ones the first by name wins."""
    rows = [(i, "ab ab" if i % 2 else "cd cd", "y" if i % 2 else "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.language_model(docs)
    langs, weights, bias, temperature, _ = model
    text = "abc dab"
    gram, _, _, _ = language_id.ngrams(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    s = (np.mean([weights[g] for g in gram], axis=0) + bias) / temperature
    p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    got = language_id.with_language(frame(spark, [(1, text)]), model).first()
    assert got.lang_pred == langs[int(p.argmax())] and abs(got.score - p.max()) < 1e-6
    tied = language_id.with_language(frame(spark, [(1, text)]), (langs, np.zeros_like(weights), np.zeros(2), 1.0, model[4])).first()
    assert (tied.lang_pred, tied.score) == ("x", 0.5)


def test_label_model_estimates_rates_and_dependencies():
    rng = np.random.default_rng(3)
    truth = rng.random(6000) < 0.2
    label = np.where(truth, rng.random(6000) < 0.9, rng.random(6000) < 0.01).astype(int)
    fires = lambda right, wrong: np.where(truth, rng.random(6000) < right, rng.random(6000) < wrong).astype(np.uint8)
    first = fires(0.5, 0.02)
    copy = np.where(rng.random(6000) < 0.95, first, 1 - first).astype(np.uint8)
    votes = np.column_stack([first, copy, fires(0.4, 0.05), fires(0.3, 0.01)])
    post, rates = toxicity.label_model(votes, label)
    assert np.mean((post > 0.5) == truth) > np.mean(label == truth) and abs(rates[0] - 0.9) < 0.06 and abs(rates[1] - 0.01) < 0.02
    parent = toxicity.dependency_tree(votes.astype(float), post)
    assert parent[1] == 0 or parent[0] == 1
    w = toxicity.linear_classifier(votes, post)
    assert w[3] > 1 and w[0] + w[1] > 1 and w[-1] < 0


def test_toxicity_scores_are_the_classifiers(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.toxicity_model(docs, labels)
    voters, w = model
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    for r in docs.collect():
        (have, found), = toxicity.features_by_text(pa.array([r.text]))
        s = np.isin(voters, have) @ w[: len(voters)] + found @ w[len(voters) : -1] + w[-1]
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-s))) < 1e-9


def test_license_scan_against_brute_force(spark):
    rng = np.random.default_rng(4)
    templates = license_scan.TEMPLATES
    words = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if x]
    texts = []
    for i in range(60):
        w = words(templates[i % len(templates)][1])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = "changed"
        texts.append(" ".join([*(f"f{j}" for j in range(int(rng.integers(0, 40)))), *w, *(f"g{j}" for j in range(int(rng.integers(0, 40))))]))
    want = set()
    for d, text in enumerate(texts):
        w = words(text)
        for name, t in templates:
            tw = words(t)
            k, n = min(5, len(tw)), len(tw)
            sh = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
            found = [(-len(sh(tw) & sh(w[a : a + 2 * n])) / len(sh(tw)), a) for a in range(0, len(w), n)]
            if found and -min(found)[0] >= license_scan.CONTAINMENT:
                want.add((d, name, -min(found)[0], min(found)[1]))
    got = {(r.doc_id, r.license, r.containment, r.window_start) for r in license_scan.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert got == want


def test_min_hashes_meet_as_often_as_sets_overlap(spark):
    """Each band is a min-hash of its own: two sets agree in a share of the bands that is their Jaccard similarity, also for small sets."""
    rng = np.random.default_rng(5)
    rows = [(i, x[:6].tolist(), [*x[:1].tolist(), *x[6:11].tolist()]) for i in range(300) if len(x := rng.integers(-(2**62), 2**62, 11)) == 11]
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    same = sum((license_scan.min_hash("a", band) == license_scan.min_hash("b", band)).cast("int") for band in range(license_scan.BANDS))
    share = df.select(F.avg(same)).first()[0] / license_scan.BANDS
    assert abs(share - 1 / 11) < 0.02


def test_quality_scores_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return [signed(x) % quality.BUCKETS for x in h + pairs]

    rows = {r.doc_id: buckets(r.text) for r in docs.collect()}
    every, good = collections.Counter(), collections.Counter()
    for d, b in rows.items():
        every.update(b)
        if d in trusted:
            good.update(b)
    n_all, n_good = sum(every.values()) + quality.BUCKETS, sum(good.values()) + quality.BUCKETS
    ratio = [round(math.log((good[b] + 1) / n_good) - math.log((every[b] + 1) / n_all), 5) for b in range(quality.BUCKETS)]
    for r in quality.quality_rules(docs, labels).collect():
        want = float(np.mean([ratio[b] for b in rows[r.doc_id]])) if rows[r.doc_id] else 0.0
        assert abs(r.score - want) < 1e-6 and r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_threshold_is_included(spark):
    docs = frame(spark, [(1, " ".join(f"w{i}" for i in range(12)))])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs, labels, threshold=0.0).first().kept


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, an empty text, columns whose names clash with those that operators make."""
    rows = [(None, "the cat and the dog were here with them", "en", "s", 1, "a", 0.5, 1), (None, None, None, None, None, "b", 0.5, 2), (1, "", "en", "s", 0, "c", 0.5, 3), (2, None, "en", "s", 0, "d", None, 4), (3, "the cat and the dog were here with them", "en", "s", 1, "e", 0.5, 5), (3, "the cat and the dog were here with them", "en", "s", 1, "e", 0.5, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, text_hash string, toxicity double, nth int")


def test_stages_on_odd_rows(spark, odd):
    wanted = {"toxicity": 6, "language_id": 3, "jaccard_join": 5, "decontamination": 6}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.count() == wanted[name], name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == 6


def test_stages_on_an_empty_table(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), SF).count() == 0


def test_token_files_with_null_and_repeated_ids(spark, odd, tmp_path):
    path = str(tmp_path / "f")
    token_files.write_token_files(odd, path, BYTES, 2, shard_ids=4)
    got = token_files.token_file_digests(spark, path).collect()
    assert collections.Counter(r.doc_id for r in got) == {None: 2, 1: 1, 2: 1, 3: 2}
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert [a for a, _ in ends] == [sum(n for _, n in ends[:i]) for i in range(len(ends))]


def test_a_document_longer_than_a_shard_has_several_grammars(spark, tmp_path):
    path = str(tmp_path / "f")
    text = " ".join(f"word{i}" for i in range(300))
    token_files.write_token_files(frame(spark, [(1, "a"), (2, text)]), path, BYTES, 2, shard_ids=50)
    shard = spark.read.parquet(path).where(F.array_contains("doc_ids", 2)).first()
    assert len(shard.grammars) > 1
    assert token_files.decode_document(shard, shard.doc_ids.index(2)).tolist() == [*library(BYTES, [text])[0], 2]
