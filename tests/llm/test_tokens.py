import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from common_cases import cases, empty, frame, long_rows, twins, with_ids
from tokenizers import Tokenizer

from loomgraph.llm import packing, token_counts
from loomgraph.llm.pieces import Codec, Encoder, Vocabulary, codec_summary, decoded, encoded

BYTES, WORDS, PIECES = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
SIGNS = ["'", "s", "t", "re", "v", "ll", "m", "d", " ", "  ", "\n", "a", "9", "!", "é", "日", " ", "The", " the", "ing", "½", "İ", "Σ", "é", "<|", "µ"]


def mixtures(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_counts(spark):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.token_counts(frame(spark), BYTES, limit=100).collect()
    expected = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 100) for i, t in with_ids())
    assert Counter(map(tuple, got)) == expected
    assert token_counts.token_counts(empty(spark), BYTES).count() == 0


def test_transducers():
    library, counter = Tokenizer.from_file(BYTES), token_counts.TokenCounter(BYTES)
    texts = [*mixtures(1, 1500), "x'", "a'r", "a're", "'" * 9, " " * 300, "=" * 1000, "日本語" * 400, "a" * 600]
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_scan_equals_walk():
    goto, begins = token_counts.split_transducer()
    r = np.random.default_rng(2)
    kinds = r.choice(11, 3000, p=[0.3, 0.05, 0.05, 0.05, 0.1, 0.05, 0.15, 0.05, 0.1, 0.08, 0.02]).astype(np.uint8)
    state, starts = token_counts.FREE, np.zeros(3001, bool)
    for k, c in enumerate(kinds):
        starts[k] |= bool(begins[c, state] & token_counts.HERE)
        starts[k - 1] |= bool(begins[c, state] & token_counts.BEFORE)
        state = goto[c, state]
    assert (token_counts.word_starts(kinds, goto, begins)[:-1] == starts[:2999]).all()


def test_word_ids():
    library, words = Tokenizer.from_file(WORDS), packing.WordIds(WORDS, memo=50)
    for t in [*mixtures(3, 800), *(t for _, t in with_ids())]:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_words_met_last_are_kept():
    """A full table keeps the words that are met again, and forgets those that are not; the library takes few words at once."""
    calls = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode(self, text, **kw):
            calls.append(text.split())
            return self.library.encode(text, **kw)

    r, letters = random.Random(5), "abcdefghijklmnopqrstuvwxyz"
    library, words = Tokenizer.from_file(WORDS), packing.WordIds(WORDS, memo=200)
    words.tokenizer = Counted(library)
    for k in range(30):
        text = " ".join([*["often"] * (k >= 10), *("".join(r.choices(letters, k=9)) for _ in range(40))])
        assert [np.frombuffer(x, "<u4").tolist() for x in words.of([text])] == [library.encode(text, add_special_tokens=False).ids]
    assert sum(c.count("often") for c in calls) == 1
    assert len(words.memo) + len(words.older) < 250
    calls.clear()
    text = " ".join("".join(r.choices(letters, k=9)) for _ in range(20_000))
    assert [np.frombuffer(x, "<u4").tolist() for x in words.of([text])] == [library.encode(text, add_special_tokens=False).ids]
    assert max(map(len, calls)) <= 4096


def test_words_of_many_texts():
    """New words of many texts are one call of the library, not a row of it each."""
    calls = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode(self, text, **kw):
            calls.append(text)
            return self.library.encode(text, **kw)

        def encode_batch(self, texts, **kw):
            calls.extend(texts)
            return self.library.encode_batch(texts, **kw)

    library, words = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    words.tokenizer = Counted(library)
    texts = [f"It's word{k}, said no {k}: don't!' ''s !'s \xe9t\xe9 {'x' * k}" for k in range(50)]
    got = list(packing.ids_of_all(words, pa.array([*texts, None, ""])))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in [*texts, "", ""]]
    assert len(calls) == 1


def test_packing(spark):
    library, expected = Tokenizer.from_file(WORDS), Counter()
    for i, t in with_ids():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 512):
            expected[i, k // 512, k, min(512, len(ids) - k), zlib.crc32(ids[k : k + 512].tobytes())] += 1
    got = packing.pack_documents(frame(spark), WORDS, capacity=512).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 512
    assert len(by) <= sum(k for _, k in packing.best_fit(dict(Counter(r["length"] for r in got)), 512))
    assert packing.pack_documents(empty(spark), WORDS).count() == 0


def fewest(items: list[int], capacity: int) -> int:
    best = [len(items)]

    def place(k: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b >= items[k]:
                left = list(bins)
                left.remove(b)
                place(k + 1, [*left, b - items[k]])
        place(k + 1, [*bins, capacity - items[k]])

    items = sorted(items, reverse=True)
    place(0, [])
    return best[0]


def test_bin_completion():
    r = random.Random(5)
    exact = greedy = 0
    for _ in range(60):
        items = [r.randint(10, 60) for _ in range(r.randint(1, 11))]
        for solve in (packing.best_fit, packing.bin_completion):
            made = solve(dict(Counter(items)), 100)
            used = Counter()
            for filling, times in made:
                assert sum(n * k for n, k in filling) <= 100
                for n, k in filling:
                    used[n] += k * times
            assert used == Counter(items)
        least = fewest(items, 100)
        exact += sum(k for _, k in packing.bin_completion(dict(Counter(items)), 100)) == least
        greedy += sum(k for _, k in packing.best_fit(dict(Counter(items)), 100)) == least
    assert exact >= 58 and exact >= greedy


def test_pieces(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = frame(spark)
    ids = encoded(docs, PIECES)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in ids.collect()) == Counter((i, tuple(library.encode(t))) for i, t in with_ids())
    assert Counter(map(tuple, decoded(ids, PIECES).collect())) == Counter(with_ids())
    summary = codec_summary(docs, PIECES).collect()
    assert all(r["round_trip"] for r in summary) and len(summary) == len(cases())
    assert encoded(empty(spark), PIECES).count() == 0


def test_stream():
    library, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), Codec(PIECES)
    r = random.Random(6)
    for text in [*mixtures(7, 300), "a" * 500, "word " * 90, "\n" * 70]:
        expected = library.encode(text)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == expected
        encoder, out, left = Encoder(codec.v), [], " " + text if text else ""
        while left:
            n = r.randint(1, 30)
            out += encoder.feed(left[:n])
            left = left[n:]
        assert out + encoder.feed("", end=True) == expected
        assert len(encoder.best) <= 2 * codec.v.longest + 1


def test_unigram_stream():
    """A vocabulary with scores that are logarithms: the best path by brute force over all segmentations."""
    v = Vocabulary(PIECES)
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.2, "aba": -2.9, "ba": -2.4, "bb": -4.0}
    v.made, v.ids, v.longest = 1, {p: k for k, p in enumerate(pieces)}, 3
    v.scores, v.text, v.trie = np.array(list(pieces.values())), dict(enumerate(pieces)), {}
    for p, k in v.ids.items():
        node = v.trie
        for c in p:
            node = node.setdefault(c, {})
        node[""] = k

    def best(text: str) -> float:
        score = [0.0] + [-1e9] * len(text)
        for i in range(1, len(text) + 1):
            score[i] = max(score[i - n] + pieces[text[i - n : i]] for n in range(1, min(3, i) + 1) if text[i - n : i] in pieces)
        return score[-1]

    r = random.Random(8)
    for _ in range(100):
        text = "".join(r.choice("ab") for _ in range(r.randint(1, 40)))
        encoder, ids = Encoder(v), []
        for c in text:
            ids += encoder.feed(c)
        ids += encoder.feed("", end=True)
        assert "".join(v.text[k] for k in ids) == text
        assert sum(v.scores[k] for k in ids) == pytest.approx(best(text))


def test_long_words():
    """Chunk maps against the library, over tables that fill up and begin anew."""
    library, r = Tokenizer.from_file(BYTES), random.Random(11)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters, n in (("abcdefgh", 9000), ("ab", 5000), ("aAzZ09+/", 7000), ("日本語文章", 3000), ("=", 4500))] + [*twins(13), "ab" * 3000 + "c", "a" * 4097]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = token_counts.TokenCounter(BYTES)
    assert counter.count(texts).tolist() == expected
    words = counter.words
    words.most = 4096
    words.clear()
    assert counter.count(texts).tolist() == expected


def test_long_texts(spark):
    library, pieces, rows = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), long_rows()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(frame(spark, rows), BYTES).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}
    short = [(i, t[:1_150_000] if i != 3 else t[:60_000]) for i, t in rows]
    got = {r["doc_id"]: (r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in codec_summary(frame(spark, short), PIECES).collect()}
    assert got == {i: (len(ids := pieces.encode(t)), zlib.crc32(np.array(ids, "<u4").tobytes()), True) for i, t in short}
    words = packing.WordIds(WORDS)
    library = Tokenizer.from_file(WORDS)
    for _, t in rows:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_completions():
    r = random.Random(12)
    for _ in range(40):
        lengths = sorted({r.randint(3, 40) for _ in range(8)})
        have = np.zeros(101, np.int64)
        for n in lengths:
            have[n] = r.randint(1, 3)
        ways = packing.Completions(lengths, 100, 4, 100_000)
        gap = r.randint(20, 90)
        sums = {0}
        for n in lengths:
            sums = {s + n * k for s in sums for k in range(have[n] + 1)}
        least = gap - max(s for s in sums if s <= gap)
        found = ways.of(have, gap, gap)
        assert gap - sum(found[0]) == least
        assert all(max(Counter(f).values(), default=0) <= 3 and all(Counter(f)[n] <= have[n] for n in f) for f in found)
        assert not any(packing.dominates(a, b) for a in found for b in found if sum(a) == sum(b) and a != b and found.index(a) < found.index(b))


def test_fewest_sequences():
    r = random.Random(13)
    for _ in range(60):
        items = [r.randint(10, 90) for _ in range(r.randint(1, 9))]
        assert -(-sum(items) // 100) <= packing.fewest_sequences(dict(Counter(items)), 100) <= fewest(items, 100)
