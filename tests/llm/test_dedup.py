import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from common_cases import cases, empty, frame, long_rows, prose, twins, with_ids

from loomgraph.llm import near_dedup, repeats
from loomgraph.llm.common import run_hashes
from loomgraph.llm.exact_dedup import exact_groups, without_exact_copies
from loomgraph.llm.near_dedup import near_groups, without_near_copies
from loomgraph.llm.repeats import repeated_in, text_without_repeats, without_repeats


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    rows, groups = with_ids(), defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    expected = []
    for i, t in rows:
        ids = [x for x in groups[t] if x is not None]
        k = (min if keep == "smallest" else max)(ids) if ids else None
        expected.append((i, k, len(groups[t]), i == k, hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in exact_groups(frame(spark), keep=keep).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_exact_filter(spark):
    kept = without_exact_copies(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, None}
    assert exact_groups(empty(spark)).count() == 0 and without_exact_copies(empty(spark)).count() == 0


def test_exact_filter_ids_of_two_texts(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "c"), (4, None), (4, None), (5, ""), (None, "a"), (None, "a")]
    kept = [(r["doc_id"], r["text"]) for r in without_exact_copies(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a"), (2, "b"), (3, "c"), (4, None), (None, "a"), (None, "a")], key=str)


def shingle_set(text: str) -> frozenset:
    w = text.encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows, percent):
    sets = [(i, shingle_set(t)) for i, t in rows]
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), i is None or find(i) == i) for i, s in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near(spark, percent):
    got = {tuple(r) for r in near_groups(frame(spark), percent=percent).collect()}
    assert got == linked(with_ids(), percent)


def edited(n: int) -> list[tuple]:
    """Copies of one text, each changed in its own places, some of them of a copy that was changed already."""
    r, words = random.Random(9), prose(4, 150).split()
    rows, before = [(100, " ".join(words))], words
    for k in range(1, n):
        new = list(before if k % 3 == 0 else words)
        for _ in range(r.randint(1, 4)):
            new[r.randrange(len(new))] = f"x{k}y{r.randrange(99)}"
        rows.append((100 + k, " ".join(new)))
        before = new if k % 3 == 0 and len(set(new) - set(words)) < 12 else words
    return rows


def test_near_large_groups(spark, monkeypatch):
    rows = edited(90)
    expected = linked(rows, 85)
    assert {tuple(r) for r in near_groups(frame(spark, rows), percent=85).collect()} == expected
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "GROUP", 12)  # larger buckets are compared with their hubs
    assert {tuple(r) for r in near_groups(frame(spark, rows), percent=85).collect()} == expected


def crowded() -> list[tuple]:
    """Texts that share so much that all fall in the same buckets, too far apart for a link; two by two they share two
    more shingles, which make the link."""
    shared, rows = prose(6, 204), []
    for k in range(60):
        rows.append((200 + k, f"{shared} {prose(300 + k // 2, 2)} {prose(400 + k, 16)}"))
    return rows


def test_near_crowd(spark, monkeypatch):
    rows = crowded()
    expected = linked(rows, 85)
    assert len({c for _, _, c, _ in expected}) == 28
    monkeypatch.setattr(near_dedup, "GROUP", 4)
    assert {tuple(r) for r in near_groups(frame(spark, rows), percent=85).collect()} == expected


def test_near_filter(spark):
    kept = without_near_copies(frame(spark), percent=80)
    assert kept.columns == frame(spark).columns
    dropped = {i for i, _, _, k in linked(with_ids(), 80) if not k}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in cases()} - dropped
    assert near_groups(empty(spark)).count() == 0


def test_outlines_bound_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 50, 400)]
    sets += [np.unique(np.concatenate([sets[3][:k], sets[2]])) for k in (10, 300, 390)]
    marks, n = np.array([near_dedup.outline(s) for s in sets]), np.array([len(s) for s in sets])
    found = {(k, int(j)) for k, others in near_dedup.may_link(marks, n, 85) for j in others}
    for k, a in enumerate(sets):
        for j in range(k + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if both and 100 * both >= 85 * (len(a) + len(sets[j]) - both):
                assert (k, j) in found


def removed(rows, length):
    seen, out = set(), {}
    for i, t in sorted((i, t.encode()) for i, t in set(rows) if i is not None):
        cut = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                cut[k : k + length] = b"\1" * length
            seen.add(t[k : k + length])
        spans = [k for k in range(len(t)) if cut[k] and (not k or not cut[k - 1])]
        out[i] = (bytes(b for b, c in zip(t, cut) if not c), len(spans))
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_repeats(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 2000)
    expected = removed(with_ids(), 100)
    for r in without_repeats(frame(spark), 100, group=group).collect():
        if r["doc_id"] is None:
            assert bytes(r["__kept"]) == (r["text"] or "").encode()
        else:
            assert (bytes(r["__kept"]), len(r["__spans"])) == expected[r["doc_id"]]


def test_repeats_hot(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SAMPLED", 1)
    monkeypatch.setattr(repeats, "HOT_COUNT", 2)
    monkeypatch.setattr(repeats, "SALTS", 3)
    rows = edited(40)
    expected = removed(rows, 100)
    for r in without_repeats(frame(spark, rows), 100).collect():
        assert (bytes(r["__kept"]), len(r["__spans"])) == expected[r["doc_id"]]


def test_repeats_of_a_common_passage(spark, monkeypatch):
    """Its contexts meet by longer anchors, not as a row a string; some repeat what stands beside it too."""
    r, made, stored = random.Random(3), [], repeats.stored

    def counted(df, name):
        out = stored(df, name)
        made.append(out.count() if name == "strings" else 0)
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, ends = text(80), [text(90) for _ in range(3)]
    rows = [(k, (ends[k % 3] if k % 5 == 0 else text(90)) + passage + (ends[k % 2] if k % 4 == 0 else text(90))) for k in range(40)]
    expected = removed(rows, 100)
    for x in without_repeats(frame(spark, rows), 100, group=10).collect():
        assert (bytes(x["__kept"]), len(x["__spans"])) == expected[x["doc_id"]]
    assert sum(made) == 0


def test_repeats_text(spark):
    out = text_without_repeats(frame(spark), 100)
    assert out.columns == frame(spark).columns and out.count() == len(cases())
    assert without_repeats(empty(spark), 100).count() == 0


def test_transform():
    r = random.Random(4)
    for _ in range(150):
        length, base = r.choice([3, 5, 8, 12, 20]), bytes(r.choice(b"abc") for _ in range(60))
        contexts = []
        for _ in range(r.randint(1, 12)):
            a = r.randint(0, 30)
            contexts.append(base[a : a + r.randint(length, 30)] if r.random() < 0.6 else bytes(r.choice(b"ab") for _ in range(r.randint(length, 60))))
        seen, expected = set(), []
        for c in contexts:
            flags = []
            for k in range(len(c) - length + 1):
                flags.append(c[k : k + length] in seen)
                seen.add(c[k : k + length])
            expected.append(flags)
        assert [x.tolist() for x in repeated_in(contexts, length)] == expected


def test_twin_words(spark):
    a, b = twins()
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}"), (5, a + b), (6, "x " + a)]
    assert {tuple(r) for r in near_groups(frame(spark, rows), percent=85).collect()} == linked(rows, 85)
    expected = removed(rows, 100)
    for r in without_repeats(frame(spark, rows), 100).collect():
        assert (bytes(r["__kept"]), len(r["__spans"])) == expected[r["doc_id"]]


def test_shared_shingles():
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 12))] for _ in range(2))
        x, y = (shingle_set(b" ".join(w).decode()) for w in (a, b))
        assert near_dedup.shared_shingles(a, b, 5) == ((len(x), len(y), len(x & y)) if min(len(a), len(b)) >= 5 or a == b else (0, 0, 0))


def test_run_hashes():
    r = random.Random(9)
    runs = [bytes(r.choice(b"ab\0") for _ in range(n)) for n in [0, 1, 7, 8, 9, 63, 64, 65, 200] * 30]
    data, end = np.frombuffer(b"".join(runs), np.uint8), np.cumsum([len(x) for x in runs])
    h = run_hashes(data, end - [len(x) for x in runs], end)
    assert len({(x, int(k)) for x, k in zip(runs, h)}) == len(set(runs)) == len(set(h.tolist()))


def test_long_texts(spark):
    rows = long_rows()
    assert {tuple(r) for r in near_groups(frame(spark, rows), percent=85).collect()} == linked(rows, 85)
    assert {r["doc_id"]: r["keep_id"] for r in exact_groups(frame(spark, [*rows, (9, rows[0][1])])).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 9: 1}
    expected = removed(rows, 100)
    for r in without_repeats(frame(spark, rows), 100).collect():
        assert (bytes(r["__kept"]), len(r["__spans"])) == expected[r["doc_id"]]
