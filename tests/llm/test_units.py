"""The operators' parts: against plain versions, on generated input."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import decontaminate, jaccard_join, language_id, packing, pii, quality_classifier, repeats, substring_dedup, suffix_dedup, url_filter


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(deadline=None)
def test_best_fit_decreasing(lengths):
    places = packing.best_fit_decreasing(lengths, 64)
    room, want = {}, [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, w) for w, r in room.items() if r >= lengths[i]]
        least = min((r for r, _ in fits), default=None)
        got = places[i][0]
        if least is None:
            assert got not in room
            room[got] = 64
        else:
            assert room[got] == least
        assert places[i][1] == 64 - room[got]
        room[got] -= lengths[i]


@given(st.lists(st.text("ab cAé!'<|\x1c\n", max_size=30), max_size=8))
@settings(deadline=None, max_examples=60)
def test_word_tokenizer(texts):
    t = _tokenizer()
    assert t.encode_many(texts) == [t.whole(x) for x in texts]


_made = []


def _tokenizer():
    if not _made:
        _made.append(packing.WordTokenizer(packing.default_tokenizer(), cache_words=40))
    return _made[0]


@pytest.mark.parametrize("slab", [7, 64, 1 << 20])
def test_segments_cover_each_window_once(monkeypatch, slab):
    monkeypatch.setattr(repeats, "SLAB_UNITS", slab)
    rng = random.Random(slab)
    docs = [np.array([rng.randrange(3) for _ in range(rng.randrange(120))], np.uint8) for _ in range(30)]
    seen = {}
    for doc, qid, cid, lo, n in repeats.segments(docs, 20, 9, suffix_dedup.first_buckets):
        for d, q, c, a, k in zip(doc, qid, cid, lo, n):
            for p in range(a, a + k):
                assert (d, p) not in seen
                seen[d, p] = q
    assert set(seen) == {(d, p) for d, u in enumerate(docs) for p in range(len(u) - 19)}
    by_text = {}
    for (d, p), q in seen.items():  # equal windows have equal anchors
        assert by_text.setdefault(docs[d][p:p + 20].tobytes(), q) == q


def test_repeats_on_few_letters(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab") for _ in range(25)) for _ in range(6)]
    texts = ["".join(rng.choice([*parts, rng.choice("abc"), " "]) for _ in range(rng.randrange(9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in
           suffix_dedup.remove_repeated_strings(docs, length=20, gram=9).collect()}
    assert got == dict(enumerate(brute.suffix_rows(texts, 20)))


def test_repeated_words_and_paths(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in
           substring_dedup.remove_repeated_words(docs, window=7, gram=3).collect()}
    assert got == dict(enumerate(brute.substring_rows(texts, 7)))
    # a passage between unique words is one path, at its source coordinates
    passage = " ".join(f"p{i}" for i in range(90))
    two = spark.createDataFrame([(1, f"x y {passage} z"), (2, f"{passage} u v")], "doc_id long, text string")
    rows = repeats.with_row_id(two)
    paths = substring_dedup.repeated_paths(rows).join(rows, "rid").collect()
    assert {(r.doc_id, r.lo, r.n) for r in paths} == {(1, 2, 56), (2, 0, 56)}


@pytest.mark.parametrize("frequent, members, ids", [(1 << 20, 64, 1_000_000), (0, 2, 0), (40, 1, 10)])
def test_jaccard_chains(spark, monkeypatch, frequent, members, ids):
    """Families whose members link only through others, and hubs; with other
    orders, group parts and joins the same components."""
    monkeypatch.setattr(jaccard_join, "FREQUENT_TOKENS", frequent)
    monkeypatch.setattr(jaccard_join, "GROUP_MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_IDS", ids)
    rng = random.Random(7)
    texts = []
    for f in range(6):
        words = [f"f{f}w{i}" for i in range(60)]
        for _ in range(12):
            words = words.copy()
            words[rng.randrange(60)] = f"e{rng.randrange(10 ** 6)}"
            texts.append(" ".join(words))
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_components(docs).collect()}
    assert got == dict(enumerate(brute.jaccard_rows(list(range(len(texts))), texts)))


def test_window_blocks_agree(spark):
    """Windows joined in one broadcast or in many blocks give the same hits."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(60))) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(rng.choice("abcdé") for _ in range(i % 9))) for i in range(40)],
                                  "item_id long, text string")
    one = decontaminate.contaminated_words(docs, items, width=4).collect()
    many = decontaminate.contaminated_words(docs, items, width=4, max_broadcast_bytes=20_000).collect()
    assert sorted(one) == sorted(many) and any(r.contaminated for r in one)
    windows = {}
    for i, t in ((r.item_id, r.text.split()) for r in items.collect()):
        for s in range(max(len(t) - 3, 1 if t else 0)):
            windows.setdefault(tuple(t[s:s + 4]), set()).add(str(i))
    for r in one:
        w = texts[r.doc_id].split()
        hit, ids = set(), set()
        for win, names in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    ids |= names
        assert (r.n_words, r.n_hit, r.item_ids) == (len(w), len(hit), sorted(ids))


def test_contamination_is_by_row(spark, tmp_path):
    """Rows that share a null or equal doc_id each have their own hits."""
    import corpus_pipeline as cp
    from conftest import prose, write_tables

    dirty, clean = prose(2, 60), prose(20, 60)  # the benchmark holds prose(2, 60)
    part = " ".join(dirty.split()[:20])
    rows = [(None, dirty), (None, clean), (None, part), (None, None), (5, dirty), (5, clean), (5, part), (5, part), (6, clean)]
    sf_dir = write_tables(tmp_path, [t for _, t in rows], [i for i, _ in rows], extra=False)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.contaminated_words(docs, items).collect()]
    want = [(i, len((t or "").split()), 0 if t in (clean, None) else len(t.split()), t not in (clean, None)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text) for r in cp.drop_contaminated(spark, docs, sf_dir).collect()]
    assert sorted(kept, key=str) == sorted([(i, t) for i, t in rows if t in (clean, None)], key=str)


def test_bits_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 900), dtype=np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, rng.integers(0, len(x) + 1), replace=False),
                                      rng.integers(0, 1 << 60, rng.integers(0, 300), dtype=np.uint64)]))
        most = jaccard_join.most_shared(len(x), jaccard_join.cell_bits(x), jaccard_join.cell_bits(y))
        assert most >= len(np.intersect1d(x, y))


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_prefix_lengths(percent):
    for n in range(1, 400):
        for m in range(1, n + 1):
            need = min((k for k in range(m + 1) if 100 * k >= percent * (n + m - k)), default=None)
            if need is not None and need > 0:
                assert jaccard_join.needed(n, m, percent) == need
                assert need >= n - jaccard_join.probe_length(n, percent) + 1
                assert need >= m - jaccard_join.index_length(m, percent) + 1


def test_pii_patterns_match_the_plain_ones(spark):
    rng = random.Random(8)
    alphabet = "a1@.+- ()%\n5299"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["4111 1111-1111 1111", "9" * 4000, "a." * 3000 + "@b", "x@" + "y." * 3000 + "z", "1." * 4000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.SpanModel({}, {}, {}, {})
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base_spans] for r in pii.find_pii(docs, model).collect()}
    assert got == {i: brute.pii_base(t) for i, t in enumerate(texts)}


def test_span_model_learns_keys(spark):
    keys = [(i, f'see token = "{i:02d}{"9f" * 19}" there') for i in range(40)]
    numbers = [(100 + i, f"order 98079157628{i:05d} shipped") for i in range(40)]
    docs = spark.createDataFrame(keys + numbers, "doc_id long, text string")
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_pii(docs).collect()}
    assert all(found[i] == ["secret"] for i, _ in keys)
    assert not any("secret" in found[i] for i, _ in numbers)


def test_keys_with_a_late_digit_are_candidates(spark):
    """However many letters stand before the first digit; long runs stay linear."""
    keys = ["Ab" * n + "7c" for n in (3, 32, 33, 100, 5000)]
    texts = [f'token = "{k}" end' for k in keys] + ["x" * 2_000_000 + " 1", "ab-" * 400_000 + "9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(c.start, c.end) for c in r._cand] for r in pii.with_candidates(docs).collect()}
    want = {i: [(9, 9 + len(k))] for i, k in enumerate(keys)}
    assert got == want | {len(keys): [], len(keys) + 1: [(0, 1_200_001)]}


def test_redact(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "é a@b.de x 1.2.3.4"), (2, None), (3, "none")], "doc_id long, text string")
    found = pii.find_pii(docs)
    out = {r.doc_id: r.t for r in found.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out == {1: "é <EMAIL> x <IP>", 2: None, 3: "none"}


def test_digest_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    url_filter.build_index([("block", "net/"), ("allow", "org/a/")], str(tmp_path))
    index = url_filter.DigestIndex(str(tmp_path / "keys.u64"), str(tmp_path / "rules.bin"))
    assert index.match(["x.net", "org", "com"], ["/", "/a/b", "/"]) == [("block", "net/"), ("allow", "org/a/"), None]


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(2)
    crf = language_id.Crf(["a", "b"], np.zeros((2, 2)), rng.normal(size=(2, 2)), rng.normal(size=2),
                          np.zeros(0, np.uint64), np.zeros((0, 2)))
    phi = np.exp(rng.normal(size=(6, 2))).astype(np.float32)
    seqs = [np.array([0, 3, 5, 1]), np.array([2]), np.array([4, 4, 0])]
    order, rows, offsets = language_id._ragged(seqs)
    got = crf.marginals(phi, rows, offsets)
    for place, s in enumerate(order):
        total, sums = 0.0, np.zeros((len(seqs[s]), 2))
        for y in itertools.product(range(2), repeat=len(seqs[s])):
            p = np.exp(crf.start[y[0]]) * np.prod([phi[w, k] for w, k in zip(seqs[s], y)])
            p *= np.prod([np.exp(crf.transitions[i, j]) for i, j in zip(y, y[1:])])
            total += p
            for t, k in enumerate(y):
                sums[t, k] += p
        for t in range(len(seqs[s])):
            assert np.allclose(got[offsets[t] + place], sums[t] / total, atol=1e-4)


def test_code_switched_words():
    samples = [("en", "the cat and the dog of this house".split())] * 30 + [("fr", "le chat et le chien de cette maison".split())] * 30
    crf = language_id.train_crf(samples)
    words = language_id.Labeller(crf).word_languages("the cat and the dog, le chat et le chien de cette maison 12")
    assert words == ["en"] * 5 + ["fr"] * 8


def test_long_words_are_read_whole():
    """Every trigram of an unspaced text is in one piece, and its letters, not
    three spaced words or its two ends, decide the language."""
    rng = random.Random(4)
    for n in [*range(1, 80), 1000]:
        core = "".join(rng.choice("abcdefgh") for _ in range(n))
        pieces = language_id.word_pieces(core)
        marks = ["".join(map(chr, filter(None, c))) for c in language_id._codes(pieces).tolist()]
        assert [m[i:i + 3] for m in marks for i in range(len(m) - 2)] == [f"^{core}$"[i:i + 3] for i in range(n)]
        assert max(map(len, marks)) <= language_id.PIECE + 2
    line = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    samples = [(x, [p for _ in range(8) for p in language_id.word_pieces(line(a, 60))]) for x, a in
               [("ja", "ねこいぬと"), ("zh", "猫狗和这家")] for _ in range(40)]
    samples += [("en", "the cat and the dog of this house".split())] * 40
    labeller = language_id.Labeller(language_id.train_crf(samples))
    ja, zh = line("ねこいぬと", 14), line("猫狗和这家", 3000)
    texts = [ja + zh + ja, f"the cat and {zh}", f"{zh}。{zh} the dog"]
    assert labeller.label(texts)[0] == ["zh"] * 3
    assert labeller.word_languages(f"the cat 12 {zh} of this house") == ["en", "en", "zh", "en", "en", "en"]


def test_training_sample_has_every_language(spark):
    """A rare language beside a large one and a text with many copies: each has
    its texts, copies once, and the sample keeps its bound."""
    from pyspark.sql import functions as F

    n = 60_000
    many = spark.range(n).select(F.concat(F.lit("the text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    copies = spark.range(n).select(F.lit("le chat").alias("text"), F.lit("fr").alias("lang"))
    rare = spark.range(20).select(F.concat(F.lit("der hund "), F.col("id") % 10).alias("text"), F.lit("de").alias("lang"))
    rows = language_id.training_sample(many.union(copies).union(rare), 300).collect()
    count = {x: [r.lang for r in rows].count(x) for x in ("en", "fr", "de")}
    assert len(rows) == len(set(rows)) and (count["fr"], count["de"]) == (1, 10) and 200 < count["en"] < 400
    assert language_id.training_sample(many.limit(0), 300).count() == 0


def test_language_bounds():
    assert language_id.language_bounds({"a": 10 ** 12, "b": 700, "c": 3}, 1500) == {"a": 797, "b": 700, "c": 3}
    assert language_id.language_bounds({"a": 900, "b": 600}, 1500) == {"a": 900, "b": 600}
    assert set(language_id.language_bounds({str(i): 10 ** 6 for i in range(200)}, 1500).values()) == {100}
    assert language_id.language_bounds({}, 1500) == {}


def test_flat_trees_learn_a_threshold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = quality_classifier.grow_trees(x, y)
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.97
    assert model.score(x[:0]).shape == (0,)
