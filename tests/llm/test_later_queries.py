"""Operators 11 to 13 and the special tokens of packing: odd rows, empty
tables, and the driver's small tables against DuckDB or brute force."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF, prose
from pyspark.sql import functions as F

from sightline.llm import hard_negatives, prefix_trie, repeats, toxicity
from sightline.llm import queries as corpus

QUERIES = corpus.queries()


def _against_sql(spark, sf_dir, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    res = con.execute(corpus.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = Counter(res.fetchall())
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == want
    return want


# -- hard negatives ----------------------------------------------------------

def _embeddings(folder, rows):
    ids, vectors, labels = zip(*rows) if rows else ((), (), ())
    pq.write_table(pa.table({
        "vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())),
        "label": pa.array(labels, pa.int32()), "score": pa.array(["x"] * len(ids), pa.string()),
        "row": pa.array([None] * len(ids), pa.int64())}), f"{folder}/embeddings.parquet")
    return str(folder)


def _odd_vectors():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).astype(np.float32).tolist(), int(i % 3)) for i in range(260)]
    hot = rng.normal(size=64).astype(np.float32).tolist()
    rows += [(i, hot, i % 2) for i in range(300, 420)]  # many equal vectors: ties by id
    rows += [(500, None, 1), (501, [None] * 64, 1), (502, [float("nan")] * 64, 1), (503, [float("inf")] * 64, 0),
             (504, hot, None), (505, [], 1), (600, [0.0] * 64, 1), (507, hot[:10], 0), (508, [1.0] * 70, 0),
             (700, [-x for x in hot], 1), (None, hot, 0), (None, hot[::-1], 1), (300, hot, 0), (300, hot, 0)]
    return rows


def test_hard_negatives_odd_rows(spark, tmp_path):
    rows = _against_sql(spark, _embeddings(tmp_path, _odd_vectors()), "op11_hard_negatives", ["embeddings"])
    assert len(rows) > 50


def test_hard_negatives_empty(spark, tmp_path):
    assert not _against_sql(spark, _embeddings(tmp_path, []), "op11_hard_negatives", ["embeddings"])


def test_hard_negatives_in_blocks(spark):
    """Several blocks of anchors, and other options, give the same as one."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    anchor = F.col("vec_id") % 10 == 0
    one = hard_negatives.mine(rows, anchor, positives=2, negatives=3, levels=1)
    many = hard_negatives.mine(rows, anchor, positives=2, negatives=3, levels=4, block_bytes=1 << 15)
    assert Counter(one.collect()) == Counter(many.collect()) and one.count() > 200


def test_intervals_hold_the_score():
    rng = np.random.default_rng(1)
    for scale, width in ((100, 64), (5, 100), (1 << 26, 64)):
        x = (rng.normal(size=(300, width)) * scale).astype(np.int64)
        x[0] = 0
        codes, aligned, left = hard_negatives.encode(x)
        import pandas as pd
        rows = hard_negatives.Rows(pd.DataFrame({
            "vec_id": range(300), "label": 0, "row": range(300), "vector": [r.tobytes() for r in x],
            "codes": [r.tobytes() for r in codes], "aligned": [r.tobytes() for r in aligned], "left": left}), width)
        queries = hard_negatives.Queries(x)
        at = np.arange(300)
        for n in (0, 1, 7):
            scores = x @ x[n]
            so_far = wrong = np.zeros(300)
            spans = []
            for level in range(hard_negatives.LEVELS):
                so_far, wrong, lower, upper = hard_negatives.intervals(rows, at, queries, n, level, so_far, wrong)
                assert (lower <= scores).all() and (scores <= upper).all()
                spans.append((upper - lower).mean())
            assert n == 0 or spans[-1] < spans[0] / 4


# -- prefix trie -------------------------------------------------------------

def _conversations(folder, rows):
    ids, turns, roles, texts = zip(*rows) if rows else ((), (), (), ())
    pq.write_table(pa.table({
        "conv_id": pa.array(ids, pa.int64()), "turn": pa.array(turns, pa.int64()), "role": pa.array(roles, pa.string()),
        "text": pa.array(texts, pa.string()), "pos": pa.array([1] * len(ids), pa.int64()),
        "block": pa.array(["x"] * len(ids), pa.string())}), f"{folder}/conversations.parquet")
    return str(folder)


def _odd_conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 4 if t < 3 else c}")
            for c in range(0, 40) for t in range(c % 5)]
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(30)]  # long copies
    rows += [(300, t, "user", "same") for t in range(75)] + [(301, t, None, None) for t in range(20)]
    rows += [(400, None, "user", "null turn"), (400, None, "a", "first of ties"), (400, 1, "user", None), (400, 1, "user", None),
             (401, 0, "user", "é" * 50 + "\U0001F600"), (401, 1, "user", "x" * 200_000), (-5, 0, "user", "negative"),
             (None, 0, "user", "no id"), (505, 0, "user", "base absent"), (600, 0, "u", "a"), (600, 0, "u", "a"), (699, 3, "u", "a")]
    return rows


def test_prefix_trie_odd_rows(spark, tmp_path):
    rows = _against_sql(spark, _conversations(tmp_path, _odd_conversations()), "op12_prefix_trie", ["conversations"])
    assert max(r[1] for r in rows) >= 75


def test_prefix_trie_empty(spark, tmp_path):
    assert not _against_sql(spark, _conversations(tmp_path, []), "op12_prefix_trie", ["conversations"])


def test_prefix_trie_widths_agree(spark, tmp_path):
    turns = prefix_trie.number_turns(spark.read.parquet(f"{_conversations(tmp_path, _odd_conversations())}/conversations.parquet"))
    narrow, wide = (Counter(prefix_trie.prefix_trie(turns, width=w).collect()) for w in (3, 16))
    assert narrow == wide


# -- toxicity ----------------------------------------------------------------

def _terms(text):
    out = Counter()
    for w in re.findall(r"\w+", (text or "").lower()):
        if len(w) > 24:
            out.update({w[a:a + n] for n in (3, 4) for a in range(len(w) - n + 1)})
        else:
            out.update([w, *["^" + w[:n] for n in (3, 4, 5, 6) if len(w) > n]])
    return out


def _toxicity_by_hand(sf_dir):
    """The same model without index, blocks or Spark: (doc_id, score)."""
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    labels = con.execute(f"SELECT doc_id, max(toxic) FROM '{sf_dir}/labels.parquet' WHERE toxic IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1").fetchall()
    labels = {i: int(y > 0) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    texts: dict = {}
    for i, t in docs:
        if i in labels:
            texts[i] = t if texts.get(i) is None else min(t, texts[i]) if t is not None else texts[i]
    having = {i: set(_terms(t)) for i, t in texts.items()}
    n, p = len(texts), sum(labels[i] for i in texts)
    rows, positive = Counter(), Counter()
    for i, terms in having.items():
        rows.update(terms)
        positive.update(terms if labels[i] else ())
    chi = {t: (positive[t] * n - rows[t] * p) ** 2 * n / (rows[t] * (n - rows[t]) * p * (n - p))
           for t in rows if rows[t] >= toxicity.MIN_ROWS and rows[t] < n and 0 < p < n}
    chosen = sorted((t for t in chi if chi[t] >= toxicity.MIN_CHI2), key=lambda t: (-chi[t], t.encode()))[:toxicity.MAX_TERMS]
    idf = {t: np.log((1 + n) / (1 + rows[t])) + 1 for t in chosen}

    def vector(text):
        v = {t: (1 + np.log(k)) * idf[t] for t, k in _terms(text).items() if t in idf}
        size = np.sqrt(sum(w * w for w in v.values())) or 1.0
        return {t: w / size for t, w in v.items()}

    return docs, {i: vector(t) for i, t in texts.items()}, labels, vector


def test_toxicity_neighbours_are_exact(spark):
    docs, vectors, labels, vector = _toxicity_by_hand(SF)
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.classify(d.select("doc_id", "text"), y.select("doc_id", "toxic"), evidence=True).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    hits = 0
    for r in got:
        q = vector(text[r.doc_id])
        cosines = {i: sum(w * v.get(t, 0.0) for t, w in q.items()) for i, v in vectors.items()}
        best = sorted((c for c in cosines.values() if c > 1e-12), reverse=True)[:toxicity.NEIGHBOURS]
        assert np.allclose([n.cosine for n in r.neighbours], best, atol=1e-9)
        for n in r.neighbours:
            assert abs(cosines[n.doc_id] - n.cosine) < 1e-9 and labels[n.doc_id] == n.label
        hits += len(best)
    assert hits > 500


@pytest.mark.parametrize("which", ["edge_dir", "empty_dir", "small", "sf0.1"])
def test_toxicity(spark, request, which):
    sf_dir = {"small": SF, "sf0.1": "/root/testdata/sf0.1"}.get(which) or request.getfixturevalue(which)
    con = duckdb.connect()
    rows = QUERIES["op13_toxicity"](spark, sf_dir).collect()
    ids = con.execute(f"SELECT doc_id FROM '{sf_dir}/documents.parquet'").fetchall()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, in ids)
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    if which == "sf0.1":
        label = dict(con.execute(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
        held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
        assert sum(p and y for p, y in held) >= 0.85 * sum(y for _, y in held)
        assert sum(not p and not y for p, y in held) >= 0.97 * sum(not y for _, y in held)


def test_isotonic_rises_and_fits():
    rng = np.random.default_rng(3)
    votes = rng.random(500)
    knots, values = toxicity.isotonic(votes, (rng.random(500) < votes).astype(float))
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= -1e-12).all()
    assert abs(np.interp(0.5, knots, values) - 0.5) < 0.2


# -- changed operators -------------------------------------------------------

def test_packing_special_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["x <|endoftext|> y", "x <|ENDOFTEXT|> y", "glued<|endoftext|>word", "<|startoftext|>", "<|StartOfText|>a", "a <|end oftext|>"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in QUERIES["op2_packing"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (rows[i].doc_tokens, rows[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_suffix_dedup_many_equal_rows(spark, tmp_path):
    text = prose(11, 200)
    n = 2000
    pq.write_table(pa.table({"doc_id": pa.array([None] * n + [1], pa.int64()), "text": [text] * n + [prose(12, 90)]}),
                   f"{tmp_path}/documents.parquet")
    rows = QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect()
    size = len(text.encode())
    assert Counter((r.n_bytes, r.n_removed, r.n_spans) for r in rows if r.doc_id is None) == {(size, size, 1): n}
    docs = repeats.with_row_id(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    from sightline.llm.suffix_dedup import repeated_strings
    marked = repeats.with_places(docs, repeated_strings(docs))
    assert marked.agg(F.max(F.size("places"))).first()[0] <= size  # not times the rows


def _rows_of(spark, column, values, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", column(F.col("v"))).collect())]


def test_running_sums_in_blocks(spark):
    from sightline.llm import pii

    rng = np.random.default_rng(2)
    values = [rng.integers(0, 50, n).tolist() for n in (0, 1, 2, 63, 64, 65, 128, 4095, 4096, 4097, 9000)]
    sums = _rows_of(spark, pii.before_each, values, "array<int>")
    assert sums == [np.concatenate([[0], np.cumsum(v)[:-1]]).astype(int).tolist() if v else [] for v in values]
    tops = _rows_of(spark, lambda v: pii.before_each(v, pii._larger), values, "array<int>")
    assert tops == [[max([0, *v[:i]]) for i in range(len(v))] if len(v) < 5000 else
                    np.concatenate([[0], np.maximum.accumulate(v)[:-1]]).tolist() for v in values]


def test_overlaps_and_redaction(spark):
    """Binary search and block cutting against plain loops, spans that nest and overlap."""
    from sightline.llm import pii

    rng = np.random.default_rng(4)
    rows = []
    for n in (0, 1, 5, 70, 200, 5000):
        size = 40 * max(n, 1)
        text = "".join(rng.choice(list("ab é\U0001F600"), size))
        draw = lambda k: [(int(s), int(s + rng.integers(1, 60))) for s in rng.integers(0, size - 60, k)] if size > 60 else []
        rows.append((len(rows), text, draw(n), draw(min(n, 300))))
    kind = "i int, t string, s array<struct<start:int,end:int>>, f array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, kind).withColumn(
        "k", F.transform("s", lambda s: F.struct(F.lit("x").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    got = df.select("i", pii.outside(F.col("f"), F.col("s")).alias("o"), pii.redact(F.col("t"), F.col("k")).alias("r")).collect()
    for i, o, r in sorted(got):
        _, text, spans, found = rows[i]
        assert [tuple(x) for x in o] == [f for f in found if not any(s < f[1] and f[0] < e for s, e in spans)]
        out, at = [], 0
        for s, e in sorted(spans):
            if s >= at:
                out.append(text[at:s] + "<X>")
            at = max(at, e)
        assert r == "".join(out) + text[at:]


def test_pii_many_matches_in_one_text(spark):
    """2 MB of addresses: time in proportion to the matches."""
    import time

    from sightline.llm import pii

    took = []
    for n in (10_000, 100_000):
        text = " ".join(f"user{i}@mail{i % 9}.org" for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        spans = df.select(pii.base_spans(F.col("text"), "email").alias("s")).select(
            F.size("s").alias("n"), pii.redact(F.lit(text), F.col("s")).alias("r")).first()
        took.append(time.time() - began)
        assert spans["n"] == n and spans["r"] == " ".join(["<EMAIL>"] * n)
    assert took[1] < 30 * max(took[0], 1)


def test_pii_spans_by_hand(spark):
    """Column ``spans`` from the fitted model, by plain regular expressions."""
    from sightline.llm import pii

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = pii.fit_span_model(docs)
    got = {r["doc_id"]: r["spans"] for r in pii.digest_columns(pii.find_pii(docs, model)).collect()}
    votes = pii.with_candidates(docs).select("doc_id", F.col("_cand").alias("c")).collect()
    import brute
    import regex
    for r, (i, text) in zip(sorted(votes), sorted(docs.collect())):
        assert r["doc_id"] == i
        base = brute.pii_base(text or "")
        free = [(k, m.start(), m.end()) for k, p in pii.CANDIDATES.items() for m in regex.finditer(p, text or "")
                if not any(s < m.end() and m.start() < e for _, s, e in base)]
        assert [(c["kind"], c["start"], c["end"]) for c in r["c"]] == free
        yes = [(c["kind"], c["start"], c["end"]) for c in r["c"]
               if model.bias[c["kind"]] + sum(model.weights[c["kind"]][f, c[f]] for f in pii.FEATURES) >= 0]
        order = {k: n for n, k in enumerate(pii.KINDS)}
        want = [":".join(map(str, s)) for s in sorted([*base, *yes], key=lambda s: (order[s[0]], s[1]))]
        assert got[i] == ",".join(want)


def test_quality_one_id_on_many_rows(spark):
    """A sampled id's rows don't all come to the driver."""
    from sightline.llm import quality_classifier as qc

    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(7, 0), (7, 1), (7, None), (8, 1)], "doc_id long, quality int").union(
        spark.range(50).select(F.lit(7).cast("long"), F.lit(1)))
    x, y = qc.training_statistics(docs, labels)
    assert x.shape == (1, len(qc.STATISTICS)) and y.tolist() == [1.0]
    assert x[0].tolist() == qc.statistics("text 0")


def test_quality_scores_by_hand(spark):
    """Every row's score from the fitted trees, node by node."""
    from sightline.llm import quality_classifier as qc

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    model = qc.grow_trees(*qc.training_statistics(docs, labels), trees=20)
    for r in qc.score_quality(docs, model).collect():
        x, total = qc.statistics(r["text"]), model.base
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        assert abs(r["score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_language_labels_by_hand(spark):
    """Rows labelled in batches against one text at a time in plain double sums."""
    from sightline.llm import language_id as li

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    crf = li.fit(docs, max_train_rows=200)
    got = {r["doc_id"]: r for r in li.label_languages(docs.where("doc_id % 3 = 0"), crf).collect()}
    move, first = np.exp(crf.transitions), np.exp(crf.start)
    for i, text in [(r["doc_id"], r["text"]) for r in docs.where("doc_id % 3 = 0").collect()]:
        words = [c if " " in c else li.letters_of(c) for c in li.positions_of(text)]
        words = [w for w in words if w]
        if not words:
            assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0
            continue
        log = crf.potentials(words).astype(np.float64)
        phi = np.exp(log - log.max(axis=1, keepdims=True))
        ahead, back = [], [np.ones(len(first))]
        for t, p in enumerate(phi):
            a = p * (first if t == 0 else ahead[-1] @ move)
            ahead.append(a / a.sum())
        for p in phi[:0:-1]:
            b = move @ (p * back[-1])
            back.append(b / b.sum())
        mass = sum((a * b) / (a * b).sum() for a, b in zip(ahead, back[::-1]))
        share = mass / mass.sum()
        assert abs(share.max() - got[i]["score"]) < 1e-3
        if np.sort(share)[-1] - np.sort(share)[-2] > 1e-2:
            assert got[i]["lang_pred"] == crf.languages[int(share.argmax())]


def test_substring_dedup_collisions_remove_nothing_wrong(spark, monkeypatch):
    """Texts of the same weak identifiers and other words: nothing goes but what
    really repeats, whole texts or parts."""
    import brute
    from sightline.llm import substring_dedup as sd

    def weak(words):  # two identifiers for all words
        return {1: sd.mix(words & np.uint64(1), words & np.uint64(1))}

    def like(text, seed):
        """Other words with the same weak identifiers."""
        out, x = [], seed
        for w in text.split():
            want = int(sd.to_words(w)[0]) & 1
            while True:
                x += 1
                if int(sd.to_words(f"w{x}")[0]) & 1 == want:
                    out.append(f"w{x}")
                    break
        return " ".join(out)

    a = prose(21, 120)
    texts = [a, like(a, 1000), like(a, 5000), prose(22, 80), prose(22, 80), None, "", "short text"]
    texts.append(texts[1])  # and a real copy of a text with collisions
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (sd.BLOCK_IDS, 7):
        monkeypatch.setattr(sd, "BLOCK_IDS", block)
        got = sd.remove_repeated_words(docs, kept=False, first=weak).collect()
        want = brute.substring_rows(texts)
        assert Counter(tuple(r) for r in got) == Counter((i, *w) for i, w in enumerate(want))
    plain = sd.remove_repeated_words(docs, kept=True).collect()
    assert Counter((r[0], *r[1:4]) for r in plain) == Counter((i, *w) for i, w in enumerate(want))
