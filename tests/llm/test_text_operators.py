"""The operators of the llm subpackage on small tables, against brute force, round trips or held-out rows."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakweave.llm import decontamination, encoding, grammar, graph, jaccard_join, language_id, lattice, license_scan, lm_scoring, packing, quality, spans, token_counts, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, key long, score double"
#: Nulls, empty, blanks, ties and repeats, odd characters, one long text without blanks.
TEXTS = [None, "", " \t\n", "a", "one two", "The cat sat on the mat.\nThe cat sat on the mat.\n", "The cat sat on the mat.\nThe cat sat on the mat.\n", "x" * 20_000, "é ü  tab\there  two", "I'll <|endoftext|> go", "日本語 テスト", "word " * 3000, "A,b;c--d 12 3.4\r\n\r\nend ", "\x1cfoo\x1d bar"]


def table(spark, texts=TEXTS, ids=None):
    rows = [(ids[i] if ids else i, t, "en", "s", 0, "w", 1, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns with clashing names, a null id and a repeated row."""
    return table(spark, [*TEXTS, "null id", "again", "again"], [*range(len(TEXTS)), None, 99, 99])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encoding.tokenizer_path(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library(name, spaced):
    e = encoding.ChunkEncoder(encoding.tokenizer_path(name), spaced, bits=6)
    got = [list(x) for _, _, ids, n in e.encode(pa.array(TEXTS)) for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == library(name, TEXTS)
    assert e.lengths(pa.array(TEXTS)).tolist() == [len(x) for x in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1 \n\t'.,sé 日<|>", max_size=40), min_size=1, max_size=5))
def test_encoder_on_any_text(texts):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = encoding.encoder(encoding.tokenizer_path(name), spaced)
        got = [list(x) for _, _, ids, n in e.encode(pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == library(name, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=20), max_size=6))
def test_words(texts):
    for a, b, data, offsets in spans.text_blocks(pa.array(texts, pa.string()), 8):
        starts, ends, first = spans.words(data, offsets)
        raw = data.tobytes()
        got = [[raw[s:e].decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] for i in range(b - a)]
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts[a:b]]


def test_token_counts(odd, none):
    got = collections.Counter(tuple(r) for r in token_counts.token_counts(odd, encoding.tokenizer_path("byte_bpe_50k.json"), 100).collect())
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    ids = library("byte_bpe_50k.json", [t for _, t in rows])
    assert got == collections.Counter((d, len((t or "").encode()), len(x), len(x) > 100) for (d, t), x in zip(rows, ids))
    assert token_counts.token_counts(none, encoding.tokenizer_path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=300), st.integers(1, 5))
def test_grammar_round_trip(ids, least):
    x = np.array(ids, np.uint32)
    d = grammar.Decoder(grammar.unpack(grammar.pack(grammar.compress(x, 4, least=least, gain=0))))
    assert d.all().tolist() == ids
    for a in range(0, len(ids), 17):
        assert d.slice(a, 9).tolist() == ids[a : a + 9]


def test_grammar_shrinks():
    x = np.tile(np.arange(50, dtype=np.uint32), 400)
    assert len(grammar.compress(x, 50).symbols) < len(x) / 20


def test_token_files(spark, odd, none, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(odd.where("doc_id is not null"), path, encoding.tokenizer_path("byte_bpe_50k.json"), 2, shard_ids=500)
    rows = sorted((r.doc_id, r.text) for r in odd.where("doc_id is not null and doc_id <> 99").collect())
    start, want = 0, []
    for (d, _), x in zip(rows, library("byte_bpe_50k.json", [t for _, t in rows])):
        want.append((d, start, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())))
        start += len(x) + 1
    got = sorted(tuple(r) for r in token_files.token_file_digests(spark, path).collect())
    assert [g for g in got if g[0] != 99] == want and len(got) == len(want) + 2
    shard = spark.read.parquet(path).where(F.array_contains("doc_ids", 5)).first()
    i = shard.doc_ids.index(5)
    assert token_files.decode_document(shard, i).tolist() == [*library("byte_bpe_50k.json", [TEXTS[5]])[0], 2]
    token_files.write_token_files(none, str(tmp_path / "none"), encoding.tokenizer_path("byte_bpe_50k.json"), 2)
    assert token_files.token_file_digests(spark, str(tmp_path / "none")).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - x)
        else:
            gaps.append(capacity - x)
    return len(gaps)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80))
def test_packing_is_best_fit_decreasing(lengths):
    runs, opened = packing.best_fit_runs(np.bincount(lengths, minlength=31) if lengths else np.zeros(31, int), 30)
    assert opened == best_fit_decreasing(lengths, 30)


def test_packing(odd, none):
    tok = encoding.tokenizer_path("word_bpe_49k.json")
    got = packing.pack_documents(odd, tok, 1, 64).collect()
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = collections.Counter((d, p // 64, p, zlib.crc32(np.array([*x, 1][p : p + 64], "<u4").tobytes())) for (d, _), x in zip(rows, library("word_bpe_49k.json", [t for _, t in rows])) for p in range(0, len(x) + 1, 64))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(none, tok, 1, 64).count() == 0


def shingle_set(text, k):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components_of(sets, ids, threshold):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = collections.Counter()
    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= threshold * len(sets[a] | sets[b]):
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, links


@pytest.mark.parametrize("k,threshold", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, k, threshold):
    rng = np.random.default_rng(k)
    texts = []
    for g in range(12):
        base = [f"w{rng.integers(60)}" for _ in range(int(rng.integers(1, 120)))]
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = f"v{rng.integers(1000)}"
            texts.append(" ".join(w))
    texts += [None, "", "  ", "Solo", "solo", "shared passage of some words " * 3 + "x", "shared passage of some words " * 3 + "y"]
    ids = [int(x) for x in rng.permutation(len(texts))]
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(table(spark, texts, ids), k, threshold).collect()}
    sets = [shingle_set(t, k) for t in texts]
    want, links = components_of(sets, ids, threshold)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == dict(zip(ids, map(len, sets)))
    assert {i: r.n_links for i, r in got.items()} == {i: links[i] for i in ids}


def test_jaccard_join_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_WEIGHT", 700)
    texts = [" ".join(f"w{j}" for j in range(40 + i % 3)) + f" t{i}" for i in range(60)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_join(table(spark, texts), 3, 80).collect()}
    want, links = components_of([shingle_set(t, 3) for t in texts], list(range(60)), 80)
    assert got == {i: (want[i], links[i]) for i in range(60)}


@pytest.mark.parametrize("level", [0, 2, 99])
def test_jaccard_join_with_frequent_shingles(spark, monkeypatch, level):
    # All shingles frequent, those of the common passage, or none: the links are the same.
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEVEL", level)
    common = [f"c{j}" for j in range(12)]
    texts = [" ".join(common + [f"w{j}" for j in range(i % 9)] + ([f"t{i}"] if i % 4 else [])) for i in range(90)]
    texts += [" ".join(common[: 3 + i]) for i in range(9)] + ["one of its own", None]
    sets = [shingle_set(t, 3) for t in texts]
    want, links = components_of(sets, list(range(len(texts))), 80)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_join(table(spark, texts), 3, 80).collect()}
    assert got == {i: (want[i], links[i]) for i in range(len(texts))}


def test_frequent_shingles_are_dealt_to_spots(spark):
    rows = [(i, 20, [], [7]) for i in range(400)] + [(500, 21, [], [7]), (600, 90, [], [7]), (700, 20, [8], [])]
    classes = spark.createDataFrame(rows, "v long, n int, keys array<long>, hot array<long>")
    shared = jaccard_join._beside(classes, 90)
    assert {r.v for r in shared.collect()} == {*range(400), 500}
    assert max(r["count"] for r in shared.groupBy("key", "n", "spot").count().collect()) < 200
    edges = [(r.u, r.v) for r in jaccard_join._chains(shared, 90).collect()]
    assert len(edges) == 400
    assert len(set(jaccard_join._labels(501, [(np.array(x), np.array(y)) for x, y in [zip(*edges)]])[[*range(400), 500]])) == 1


def test_jaccard_join_odd_rows(odd, none):
    got = jaccard_join.jaccard_join(odd, 3, 90).collect()
    assert len(got) == odd.count() and [r.component_id for r in got if r.doc_id is None] == [None]
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert jaccard_join.jaccard_join(none, 3, 90).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (201, 202), (5, 5), (None, 3)]
    got = {r.v: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200, 202: 200}


def test_lattice_sums_all_segmentations():
    pieces = [b"\x01", b"a", b"b", b"ab", b"\x01a", b"ba", b"\x01ab"]
    p = np.array([0.2, 0.1, 0.15, 0.2, 0.1, 0.15, 0.1])
    by = dict(zip(pieces, p))

    def total(w):
        return 1.0 if not w else sum(by[w[:i]] * total(w[i:]) for i in range(1, len(w) + 1) if w[:i] in by)

    words = [b"abab", b"a", b"bba", b"c"]
    got = lattice.Lattice(pieces, np.log(p)).log_marginals(words)
    for w, x in zip(words, got):
        t = total(b"\x01" + w)
        assert (x == -np.inf and t == 0) or abs(x - math.log(t)) < 1e-12
    n = lattice.Lattice(pieces, np.log(p)).expected_counts([b"ab"], np.array([2.0]))
    assert abs(sum(n[i] * len(pieces[i]) for i in range(len(pieces))) - 6) < 1e-9


def test_lm_scores(spark, odd, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT", 3)
    texts = [*TEXTS, *(f"the cat {i} sat on The mat {i % 4}" for i in range(40))]
    got = {r.doc_id: r for r in lm_scoring.lm_scores(table(spark, texts), encoding.tokenizer_path("piece_bpe_32k.model")).collect()}
    lower = {i: i + 32 for i in range(65, 91)}
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    c = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + 1
    for i, ws in enumerate(words):
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[w] for w in ws), ends])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert len(lm_scoring.lm_scores(odd, encoding.tokenizer_path("piece_bpe_32k.model")).collect()) == odd.count()
    assert lm_scoring.lm_scores(none, encoding.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_words_seen_once_are_learned_from(spark):
    pieces, log_p = lattice.load_pieces(encoding.tokenizer_path("piece_bpe_32k.model"))
    vocab = spark.createDataFrame([(b"zyxquv", 1), (b"the", 3)], "word binary, c long")
    n = lm_scoring._expect(vocab, pieces, log_p)
    assert abs(sum(n[i] * len(p) for i, p in enumerate(pieces)) - (7 + 3 * 4)) < 1e-2


def edit_distance_anywhere(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=30))
def test_myers(p, t):
    assert decontamination.myers_best(decontamination.masks(p), len(p), t)[0] == edit_distance_anywhere(p, t)


def test_matches_equal_brute_force():
    rng = np.random.default_rng(3)
    items = [(i, "".join(rng.choice(list("abcd "), 60)).strip().replace("  ", " x")) for i in range(6)]
    m = decontamination.ItemMatcher(items, 10)
    for trial in range(60):
        _, item = items[trial % 6]
        w = list(item)
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(len(w)))] = "z"
        text = "".join(rng.choice(list("abcd"), 50)) + "".join(w) + "".join(rng.choice(list("abcd"), 50))
        got = {(i, d) for i, d, _, _ in m.find(text)}
        want = {(i, d) for i, (_, t) in enumerate(items) if (d := edit_distance_anywhere(t, text)) <= m.budget[i]}
        assert got == want


def test_decontamination(spark, odd, none):
    item = "The quick brown fox jumps over the lazy dog near the river bank today"
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, "")], "item_id long, text string")
    docs = table(spark, ["pre " + item.upper() + " post", "pre\n" + item.replace("quick", "quik") + ".", "nothing here", None])
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontamination.benchmark_matches(docs, bench).collect())
    assert got == [(0, 7, 0), (1, 7, 1)]
    assert sorted(r.doc_id for r in decontamination.decontaminated(docs, bench).collect()) == [2, 3]
    assert decontamination.benchmark_matches(odd, bench).count() == 0 and decontamination.decontaminated(odd, bench).count() == odd.count()
    assert decontamination.benchmark_matches(none, bench).count() == 0 and decontamination.benchmark_matches(docs, bench.where("false")).count() == 0


def test_license_scan(spark, odd, none):
    mit = license_scan.TEMPLATES[8][1]
    filler = " ".join(f"filler{i}" for i in range(400))
    docs = table(spark, [f"{filler} {mit} {filler}", "see\nRELEASED under the MIT license!", filler, "Released under the", None, " ".join(mit.split()[: len(mit.split()) * 9 // 10])])
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {(0, "MIT (grant)"), (1, "MIT (statement)"), (5, "MIT (grant)")}
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(none).count() == 0 and license_scan.scan_licenses(docs, []).count() == 0


def test_license_scan_finds_short_templates(spark):
    docs = table(spark, ["All rights reserved.", "some text before. ALL RIGHTS\nreserved, and after it", "all rights are reserved", "under Apache 2.0 it is", "apache"])
    assert {(r.doc_id, r.license, r.containment) for r in license_scan.scan_licenses(docs).collect()} == {(0, "Rights reserved (notice)", 1.0), (1, "Rights reserved (notice)", 1.0)}
    own = license_scan.scan_licenses(docs, [("a", "Apache 2.0"), ("b", "apache"), ("c", " - ")]).collect()
    assert {(r.doc_id, r.license) for r in own} == {(3, "a"), (3, "b"), (4, "b")}


def test_license_scan_misses_no_exact_occurrence(spark):
    # One shingle of a window's six is the template's.
    docs = table(spark, [f"w{i} x{i} Released under the MIT License y{i} z{i} u{i}" for i in range(3000)])
    assert license_scan.scan_licenses(docs).where("license = 'MIT (statement)'").count() == 3000


def test_quality_rules(spark, odd, none):
    good = [f"the cat sat on mat number {i} and then it went away to sleep again" for i in range(30)]
    junk = ["### @@ $$$ %% zz" * 12 + f" {i}" for i in range(30)]
    rows = good + junk + TEXTS
    labels = spark.createDataFrame([(i, 1 if i < 30 else 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows), labels).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = collections.Counter(windows)
        repeated = {x for j, y in enumerate(windows) if n[y] > 1 for x in range(j, j + 5)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    assert all(got[i].kept for i in range(30)) and not any(got[i].kept for i in range(30, 60))
    assert quality.quality_rules(odd, labels.where("false")).count() == odd.count() and quality.quality_rules(none, labels).count() == 0


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(5)
    texts, toxic = [], []
    for i in range(400):
        w = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(40)]
        toxic.append(int(i % 8 == 0))
        if toxic[-1]:
            for bad in rng.choice(["Vileword", "badterm", "NASTYONE"], 2, replace=False):
                w.insert(int(rng.integers(40)), str(bad))
        texts.append(" ".join(w))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(table(spark, texts), labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, y in enumerate(toxic) if got[i].held_out]) > 0.97
    assert toxicity.score_toxicity(odd, labels.where("false")).agg(F.max("score")).first()[0] == 0
    assert toxicity.score_toxicity(odd, labels).count() == odd.count() and toxicity.score_toxicity(none, labels).count() == 0


def test_language_id(spark, odd, none):
    rng = np.random.default_rng(6)
    words = {"en": "the and this with have from that were which".split(), "de": "der und nicht über mit für sich auch ist".split()}
    rows = [(i, " ".join(rng.choice(words[x], 25)), x, "s") for i, x in enumerate(["en", "de"] * 90)] + [(500, None, "en", "s"), (501, "123 !!", "en", "s"), (502, "der und nicht mit", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows[:180]]) > 0.98
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify_languages(odd).count() == odd.count() and language_id.identify_languages(none).count() == 0
    assert {r.lang_pred for r in language_id.identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
