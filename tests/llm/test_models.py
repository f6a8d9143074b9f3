import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from common_cases import cases, empty, frame, long_rows, twins, with_ids
from pyspark.sql import functions as F

from loomgraph.llm import language, lm_score, quality
from loomgraph.llm.lattice import Pieces, WordLattice
from loomgraph.llm.topk import top_k

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    scored = quality.quality_scores(docs.join(labels, "doc_id").where(quality.held_out()), model).collect()
    assert np.mean([(r["__score"] >= 0.7) == r["quality"] for r in scored]) > 0.93


def test_quality_cases(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.good_documents(docs, none).count() == len(cases())
    one = spark.createDataFrame([(1, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert quality.good_documents(docs, one).count() == 0
    both = spark.createDataFrame([(i, i % 2) for i, _ in cases() if i], "doc_id long, quality int")
    scored = quality.quality_scores(docs, quality.fit_quality(docs, both))
    assert scored.columns == [*(c for c in docs.columns if c != "__score"), "__score"]  # one of that name gives way
    assert all(0 <= r["__score"] <= 1 for r in scored.collect())
    assert quality.good_documents(empty(spark), both).count() == 0


def test_chunks_cover_documents():
    net = quality.ByteConvNet()
    sizes = [0, 1, 511, 512, 513, 960, 961, 5000]
    places = np.concatenate([[0], np.cumsum(sizes)])
    start, size, first = net.chunks(np.zeros(places[-1], np.uint8), places)
    for k, n in enumerate(sizes):
        covered = np.zeros(n, bool)
        for s, z in zip(start[first[k] : first[k + 1]], size[first[k] : first[k + 1]]):
            covered[s - places[k] : s - places[k] + z] = True
        assert covered.all()


def test_network_learns():
    """What was learned is told apart."""
    texts = [b"### bad ### text" * 9, b"good plain prose here " * 9] * 8
    y = np.array([0, 1] * 8, np.float32)
    net = quality.ByteConvNet(filters=6).fit(texts, y, np.ones(16, np.float32), steps=60)
    data, places = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s = net.scores(data, places)
    assert s[y == 1].min() > 0.8 > 0.2 > s[y == 0].max()


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.predicted_languages(docs, language.fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(language.held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98


def test_language_cases(spark):
    docs = frame(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") % 3 == 0, "yy"))
    got = language.predicted_languages(docs, language.fit_languages(docs)).collect()
    assert len(got) == len(cases())
    no_letter = {i for i, t in with_ids() if not any(map(str.isalpha, t))}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in no_letter) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.fit_languages(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.predicted_languages(docs, None).collect()} == {"und"}
    assert language.predicted_languages(empty(spark), None).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 30])
def test_codewords(n):
    code = language.codewords(n)
    assert len({tuple(r) for r in code}) == n
    if n > 2:
        assert min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= 2


def test_decoding_survives_a_wrong_bit(spark):
    texts = [w * 40 for w in (b"alpha beta ", b"gamma delta ", b"epsilon zeta ", b"theta iota ")] * 5
    model = language.LanguageCodes(texts, ["a", "b", "c", "d"] * 5)
    data, places = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    model.weights[:, :, 0] *= -1
    assert (model.predict(data, places)[0] == np.arange(20) % 4).all()


def brute_top(rows, k):
    ok = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in {x for x in ok if x[0] % 5 == 0}:
        out += [(q, i, sum(x * y for x, y in zip(a, b)), len(a)) for i, b in ok if i != q and len(a) == len(b)]
    ranked = []
    for q in {x[0] for x in out}:
        best = sorted({(-s, i) for p, i, s, _ in out if p == q})[:k]
        ranked += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(ranked)


def test_top_k(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 400)]  # ties
    rows += [(401, None), (402, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (403, [float("nan")] * 6), (404, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (405, [1.0, 2.0]), (406, [3.0, 1.0]), (407, [0.0] * 6), rows[5], rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    for k in (10, 1000):
        got = top_k(df, F.col("vec_id") % 5 == 0, k=k).collect()
        assert sorted(map(tuple, got)) == brute_top(rows, k)
    assert top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_top_k_prunes(spark):
    """Clusters far apart: the bound leaves out most annuli."""
    from loomgraph.llm import topk

    r = random.Random(3)
    rows = [(i, [10.0 * (i % 4 == c) + r.gauss(0, 0.01) for c in range(4)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    topk.ANNULUS_BYTES, before = 1 << 10, topk.ANNULUS_BYTES
    sent, best_of = [], topk.best_of
    topk.best_of = lambda pairs, annuli, *more: sent.append((pairs.count(), annuli.count())) or best_of(pairs, annuli, *more)
    try:
        got = top_k(df, F.col("vec_id") % 500 == 0, k=5).collect()
    finally:
        topk.ANNULUS_BYTES, topk.best_of = before, best_of
    assert sum(n for n, _ in sent) < 0.6 * 4 * sent[0][1]  # of all pairs of four queries and annuli
    grid = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q in range(0, 2000, 500):
        best = sorted((-sum(a * b for a, b in zip(grid[q], grid[i])), i) for i in grid if i != q)[:5]
        assert [(x["vec_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == q] == [(i, -s) for s, i in best]


def test_top_k_wide(spark):
    """Components beyond 32 bits after scaling, and ones whose squares leave the doubles' whole numbers."""
    r = random.Random(6)
    rows = [(i, [r.uniform(-4e5, 4e5) for _ in range(3)]) for i in range(60)] + [(60, [2.5e6, 1.0, 2.0]), (61, [-2.2e6, 0.0, 1.0]), (62, [2.5e6, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, F.col("vec_id") % 5 == 0, k=4).collect())) == brute_top(rows, 4)


def test_lattice_sums_all_segmentations():
    r = random.Random(4)
    spelled = [b"a", b"b", b"ab", b"ba", b"aba", b" a", b" ", b"a", b"b"]
    kinds = np.array([0] * 7 + [1, 1])
    log_p = np.log(np.array([0.2, 0.15, 0.2, 0.1, 0.05, 0.1, 0.1, 0.06, 0.04]))
    lattice = WordLattice(Pieces(spelled, kinds), log_p)
    words = [b" " + bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(40)]

    def total(w: bytes) -> float:
        return 1.0 if not w else sum(math.exp(log_p[k]) * total(w[len(s) :]) for k, s in enumerate(spelled) if w.startswith(s))

    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    start = np.cumsum(size) - size
    assert np.allclose(lattice.forward(data, start, size), [math.log(total(w)) for w in words])
    n = lattice.expected(data, start, size, np.ones(len(words)))
    lengths = np.array([len(s) for s in spelled])
    assert (n * lengths).sum() == pytest.approx(len(data))


@pytest.mark.parametrize("head", [lm_score.HEAD, 20])
def test_language_scores(spark, head, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", head)
    rows = with_ids()
    out = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c, texts = Counter(), 0
    for i, t in rows:
        if not out[i]:
            c.update(t.encode().lower().split())
            texts += 1
    n, v = sum(c.values()) + texts, len(c) + 1
    expected = Counter()
    for i, t in rows:
        w = t.encode().lower().split()
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((texts + 1) / (n + v + 1))
        expected[i, out[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 4)] += 1
    got = lm_score.language_scores(frame(spark), PIECES).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 4)) for r in got) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_score.language_scores(empty(spark), PIECES).count() == 0


def test_network_forward():
    """Scores of a small network against plain Python, over texts of none to several chunks and over one text in parts."""
    net = quality.ByteConvNet(filters=3)
    r = random.Random(14)
    texts = [b"", b"a", b"abcabcabcabcabcabc" * 5, bytes(r.choice(b"abcd ") for _ in range(1300))]
    p = {k: v.astype(float) for k, v in net.p.items()}

    def plain(t: bytes) -> float:
        codes = []
        for i in range(len(t)):
            again = any(i >= lag and t[i - lag : i - lag + 8] == t[i : i + 8] for lag in range(1, quality.LAGS + 1)) and len(t) - i >= 8
            codes.append(t[i] + 256 * again)
        step, chunks = quality.CHUNK - quality.OVERLAP, []
        for c in range(max(1, -(-(len(t) - quality.OVERLAP) // step))):
            part = codes[c * step : c * step + quality.CHUNK]
            padded = part + [quality.PAD] * (quality.CHUNK - len(part))
            windows = [np.concatenate([p["embed"][x] for x in padded[i : i + 8]]) for i in range(0, quality.CHUNK - 4, 4) if i < max(1, len(part))]
            chunks.append(np.maximum(np.max([w @ p["conv"] + p["bias"] for w in windows], axis=0), 0))
        z = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0), [math.log1p(len(t)) / 5]])
        return 1 / (1 + math.exp(-(z @ p["out"] + p["c"][0])))

    data, places = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert net.scores(data, places) == pytest.approx([plain(t) for t in texts], abs=1e-5)
    before, quality.AT_ONCE = quality.AT_ONCE, 1
    try:
        assert net.scores(np.frombuffer(texts[3], np.uint8), np.array([0, 1300]))[0] == pytest.approx(plain(texts[3]), abs=1e-5)
    finally:
        quality.AT_ONCE = before


def test_language_margins(monkeypatch):
    """The margins of texts read together, by themselves in parts, and by plain Python."""
    texts = [b"Alpha beta gamma " * 9, b"x", b"", b"delta epsilon zeta " * 7, b"eta theta " * 30]
    model = language.LanguageCodes(texts, ["a", "b", "b", "b", "c"])
    together = model.margins(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))

    def bucket(gram: bytes) -> int:
        h = 0
        for x in gram:
            h = (h * 0x01000193 + x) & 0xFFFFFFFF
        return (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - language.BUCKET_BITS

    monkeypatch.setattr(language, "AT_ONCE", 40)
    for t, row in zip(texts, together):
        total = np.zeros(len(row))
        for o, order in enumerate(language.ORDERS):
            grams = [bucket(t.lower()[k : k + order]) for k in range(len(t) - order + 1)]
            total += model.weights[o][grams].sum(axis=0, dtype=float)[: len(row)] / max(1, len(grams)) if grams else 0
        assert row == pytest.approx(total / model.usual, abs=1e-5)
        assert model.margins(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] == pytest.approx(total / model.usual, abs=1e-5)


def test_scores_sum_segmentations(spark):
    """score against a sum over all segmentations in plain Python, words of twin letters and long ones among them."""
    a, b = twins()
    rows = [(1, "the cat the"), (2, a), (3, f"{b} zqxj"), (4, ""), (9, "Straße 日本"), (12, a + b + "tail")]
    spelled, _, kinds, _ = lm_score.read_pieces(PIECES)
    p = np.exp(lm_score.first_weights(PIECES))
    text, of_byte = {spelled[k]: p[k] for k in np.flatnonzero(kinds == 0)}, {spelled[k]: p[k] for k in np.flatnonzero(kinds == 1)}
    longest = max(map(len, text))

    def log_total(w: bytes) -> float:
        alpha, scale = [1.0], 0.0
        for i in range(1, len(w) + 1):
            alpha.append(sum(alpha[i - n] * text.get(w[i - n : i], 0) for n in range(1, min(i, longest) + 1)) + alpha[i - 1] * of_byte.get(w[i - 1 : i], 0))
            if alpha[-1] < 1e-100:  # only the last places count from here on
                alpha, scale = [x * 1e100 for x in alpha], scale - 100
        return math.log10(alpha[-1]) + scale

    got = {r["doc_id"]: r for r in lm_score.language_scores(frame(spark, rows), PIECES, rounds=0).collect()}
    for i, t in rows:
        assert got[i]["score"] == pytest.approx(sum(log_total(b" " + w) for w in t.encode().lower().split()) + math.log10(p[kinds == 2].max()), rel=1e-6)
    trained = [t.encode().lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    known = {w for t in trained for w in t}
    assert {i: sum(w in known for w in t.encode().lower().split()) + 1 for i, t in rows} == {i: r["n_known"] for i, r in got.items()}


def test_long_texts(spark):
    docs = frame(spark, [(i, t if i != 3 else t[:50_000]) for i, t in long_rows()]).withColumn("lang", F.when(F.col("doc_id") > 3, "xx").otherwise("yy"))
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["__score"] for r in quality.quality_scores(docs, quality.fit_quality(docs, labels)).collect()}
    assert len(scored) == 5 and all(0 <= s <= 1 for s in scored.values())
    assert {r["doc_id"]: r["lang_pred"] for r in language.predicted_languages(docs, language.fit_languages(docs)).collect()}.keys() == scored.keys()
    got = {r["doc_id"]: r["n_tokens"] for r in lm_score.language_scores(docs, PIECES, rounds=1).collect()}
    assert got == {r["doc_id"]: len(r["text"].split()) + 1 for r in docs.select("doc_id", "text").collect()}
