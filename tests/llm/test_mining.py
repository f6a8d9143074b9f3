"""Extraction, collocations and whitening against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from common_cases import cases, empty, frame, prose
from pyspark.sql import functions as F

from loomgraph.llm import collocations as co
from loomgraph.llm import html_extract as he
from loomgraph.llm import whitening as wh
from loomgraph.llm.html_tree import parse
from loomgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return he.fit_extractor()


def blocks_of(page: str) -> list[str]:
    return [n.text for n in parse(page) if n.text]


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<p>a<p>b<b>c<br>d</b><div>e</div>f", ["a", "bc d", "e", "f"]),
        ("<title>t</title><script>var a='</p><p>x';</script><style>p{}</style>y", ["y"]),
        ("a &amp;amp; b&nbsp;&eacute; &#x41;&copy", ["a &amp; b é A©"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
        ("<!-- <p>no --><!doctype html><p title='>'>a</p x>b<!-->c", ["a", "bc"]),
        ("x < y <3 <p", ["x < y <3 <p"]),
        ("<div><span>a\n\t b</div></span></i>c", ["a b", "c"]),
        ("<p>a<button>no</button><select><option>no</select>b<textarea>no</textarea>", ["a b"]),
        ("<button>never closed", ["never closed"]),
        ("<svg><title>no</title><svg></svg>no</svg>yes", ["yes"]),
        ("<script>no end <p>x", []),
        ("<h1>a<h2>b</h1>c", ["a", "b", "c"]),
        ("", []),
        ("<dl><dt>a<dd>b<dt>c</dl><pre> d\n e </pre>", ["a", "b", "c", "d e"]),
    ],
)
def test_blocks(page, expected):
    assert blocks_of(page) == expected


def test_deep_and_broken_pages():
    assert blocks_of("<div>" * 30_000 + "x" + "</div>" * 30_000) == ["x"]
    assert blocks_of("<p a=\"x>" * 3000 + "y")[-1].endswith("y")
    assert len(blocks_of("<button>" * 3000 + "<p>z" * 3000)) == 3001 - 1


def test_marginals_are_exact(model):
    """Messages against the sum over all labellings of small trees."""
    r = np.random.default_rng(3)
    for page in ("<div><p>a</p><p>b</p></div>c", "<ul><li>a<li>b</ul>", "x", "<nav><a href=x>a</a></nav><p>b"):
        trees = he.Trees([parse(page)])
        m = he.TreeModel(trees.features.shape[1])
        m.unary, m.pair = r.normal(size=m.unary.shape), r.normal(size=m.pair.shape)
        n = len(trees.kind)
        own = trees.features @ m.unary
        total, one = 0.0, np.zeros(n)
        for bits in range(1 << n):
            y = [bits >> k & 1 for k in range(n)]
            w = np.exp(sum(own[k] for k in range(n) if y[k]) + sum(m.pair[trees.kind[k], y[trees.parent[k]], y[k]] for k in range(n) if trees.parent[k] >= 0))
            total += w
            one += w * np.array(y)
        p, both, log_z = m.marginals(trees)
        assert np.allclose(p, one / total) and np.isclose(log_z, np.log(total))
        inner = trees.parent >= 0
        assert np.allclose(both[inner].sum(axis=1)[:, 1], p[inner]) and np.allclose(both[inner].sum(axis=2)[:, 1], p[trees.parent[inner]])


def test_gradient():
    """Seen minus expected features against differences of the likelihood."""
    pages = he.labelled_pages(6, 5)
    trees = he.Trees([parse(p) for p in pages])
    labels = np.random.default_rng(1).integers(0, 2, len(trees.kind))
    m = he.TreeModel(trees.features.shape[1])
    m.unary = np.random.default_rng(2).normal(size=m.unary.shape) * 0.1

    def likelihood() -> float:
        inner = np.flatnonzero(trees.parent >= 0)
        return (trees.features @ m.unary) @ labels + m.pair[trees.kind[inner], labels[trees.parent[inner]], labels[inner]].sum() - m.marginals(trees)[2]

    slope = trees.features.T @ (labels - m.marginals(trees)[0])
    for k in (0, 3, 12, 30):
        m.unary[k] += 1e-4
        up = likelihood()
        m.unary[k] -= 2e-4
        down = likelihood()
        m.unary[k] += 1e-4
        assert np.isclose((up - down) / 2e-4, slope[k], rtol=1e-3, atol=1e-3)


def labelled_text(page: str) -> str:
    inside, out = [], []
    for n in parse(page):
        inside.append(bool(n.parent >= 0 and inside[n.parent]) or "data-main" in n.attributes)
        if n.text and inside[-1]:
            out.append(n.text)
    return "\n".join(out)


def test_held_out_pages(model):
    pages = he.labelled_pages(200, 77)
    got = he.main_texts(model, [p.replace(he.Maker.MARK, "") for p in pages])
    wanted = [labelled_text(p) for p in pages]
    assert np.mean([a == b for a, b in zip(got, wanted)]) > 0.9
    lines = sum((Counter(a.split("\n")) & Counter(b.split("\n"))).total() for a, b in zip(got, wanted))
    assert lines > 0.98 * sum(b.count("\n") + 1 for b in wanted)


def test_pages_by_hand(model):
    body = "<p>The river rose all night, and by morning the bridge was gone.</p><p>Nobody was hurt.</p>"
    text = "Flood\nThe river rose all night, and by morning the bridge was gone.\nNobody was hurt."
    rest = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>", '<div class="cookie-consent"><p>We use cookies. Fine?</p></div>', '<section id="comments"><div class="comment"><p>I was there, it was loud. Really.</p></div></section><footer>&copy; Paper</footer>'
    for open_, close in (("<article>", "</article>"), ('<div class="post-content">', "</div>"), ("<main>", "</main>"), ('<div id="story">', "</div>")):
        page = f"<html><body>{rest[0]}{rest[1]}{open_}<h1>Flood</h1>{body}{close}{rest[2]}</body></html>"
        assert he.main_texts(model, [page]) == [text]


def given_text(page: str) -> str:
    """The rule of the tables' pages: headline and paragraphs of the article."""
    import html

    inside = page[page.index("<article>") : page.index("</article>")]
    parts = (" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inside))
    return "\n".join(p for p in parts if p)


def test_registered_extraction(spark):
    rows = QUERIES["op11_html_extraction"](spark, SF).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == given_text(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_extraction_cases(spark, model):
    page = "<article><h1>A</h1><p>One two three, four.</p></article><footer>x</footer>"
    rows = [(1, page), (1, page), (None, page), (2, None), (3, ""), (4, "no tags at all"), (5, "<article>" + "<p>Long, long text of words. " * 40_000 + "</article>"), (6, "<nav><a href=x>y</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("kind", F.lit("k")).withColumn("text", F.lit("old")).withColumn("parent", F.lit(1))
    got = he.extracted(df, model=model)
    assert got.columns == ["page_id", "html", "kind", "parent", "text", "n_chars"]
    by = {}
    for r in got.collect():
        by.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    one = "A\nOne two three, four."
    assert by[1] == [(one, len(one))] * 2 and by[None] == [(one, len(one))] and by[2] == by[3] == [("", 0)] and by[6] == [("", 0)]
    assert by[5][0][0].count("\n") == 39_999
    assert he.extracted(df.limit(0), model=model).count() == 0


def brute_collocations(rows, least, longest, percent, top):
    words, counts = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    found = []
    for (lang, p), a in counts.items():
        if a < least or len(p) < 2:
            continue
        score, _, l, r = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, " ".join(p), a, l, r, words[lang], score, p))
    longer = {}
    for lang, _, a, *_, p in found:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(a, longer.get((lang, p[i : i + k]), 0))
    kept = [x for x in found if 100 * longer.get((x[0], x[-1]), 0) < percent * x[2]]
    out = []
    for lang in {x[0] for x in kept}:
        mine = sorted((x for x in kept if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        out += [(lang, n, p, a, l, r, total, score) for n, (_, p, a, l, r, total, score, _) in enumerate(mine, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, shard", [(co.BLOCK, co.SHARD), (300, 50)])
def test_collocations(spark, block, shard):
    r = random.Random(4)
    rows = []
    for k in range(300):
        words = [r.choice(["Red", "fox", "the", "a", "dog.", "é", "ran,", "x\ty", "UP", "naïve"]) for _ in range(r.randint(0, 40))]
        rows.append((r.choice(["en", "de", None, "und"]), " ".join(words) + r.choice(["", " the red fox ran up", "\nthe red fox\r\n", "!?"])))
    rows += [("fr", None), ("fr", ""), ("es", " .. \t"), ("en", "the red fox " * 200), ("en", "one " * 900)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit(1)).withColumn("block", F.lit("x"))
    for least, longest, percent, top in ((30, 4, 80, 2000), (5, 3, 50, 7), (1, 2, 80, 50)):
        got = co.collocations(df, least=least, longest=longest, percent=percent, top=top, block=block, shard=shard).collect()
        assert sorted(map(tuple, got)) == brute_collocations(rows, least, longest, percent, top)


def test_collocation_cases(spark):
    rows = [(None, t) for _, t in cases()]
    got = co.collocations(frame(spark).drop("lang"), lang_col=None, least=3).collect()
    assert sorted(map(tuple, got)) == brute_collocations(rows, 3, 4, 80, 2000)
    assert co.collocations(empty(spark), lang_col=None).count() == 0
    with pytest.raises(ValueError):
        co.collocations(frame(spark), lang_col=None, least=0)


def test_long_texts_in_parts():
    text = prose(8, 5000).replace("7 ", "7. ").encode()
    parts = list(co.parts(text, 1000))
    assert b"".join(parts).replace(b".", b"") == text.replace(b".", b"") and all(len(p) >= 1000 for p in parts[:-1]) and max(map(len, parts)) < 2000
    assert list(co.parts(b"no end " * 500, 100)) == [b"no end " * 500]
    for numbers in ([], [0], [5, 3, -(2**62), 2**62, 7]):
        assert [co.unpacked(co.packed(np.array(numbers, np.int64), rising)).tolist() for rising in (True, False)] == [numbers] * 2


def check_whitening(rows, got, k=4):
    x = {}
    for i, v in rows:
        if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v):
            x.setdefault(i, []).append(tuple(int(np.floor(256 * float(c))) for c in v))
    fit = np.array(sorted({v for vs in x.values() for v in vs}), float)
    n = len(fit)
    mean = fit.mean(axis=0)
    values, directions = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, directions = values[::-1][:k], directions[:, ::-1][:, :k]
    assert len(got) == sum(map(len, x.values())) * len(values)
    sums = [sum(int(v) for v in c) for c in fit.T]
    signs = {}
    for r in got:
        j = r["component"] - 1
        exact = {sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x[r["vec_id"]]}
        assert r["n"] == n and r["deviation"] in exact and abs(r["explained"] / (values[j] / np.trace((fit - mean).T @ (fit - mean) / n)) - 1) < 1e-6 and r["identity_error"] < 1e-8
        w = [(np.array(v) - mean) @ directions[:, j] / np.sqrt(values[j]) for v in x[r["vec_id"]]]
        if len(w) == 1:
            assert abs(abs(r["whitened"]) - abs(w[0])) < 1e-6 * max(1, abs(w[0]))
            if abs(w[0]) > 1e-3:
                signs.setdefault(j, set()).add(np.sign(r["whitened"] * w[0]))
    assert all(len(s) == 1 for s in signs.values())


def test_registered_whitening(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(rows, QUERIES["op13_embedding_whitening"](spark, SF).collect())


def test_whitening_cases(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(c) for c in r.normal(size=5) * [5, 4, 3, 2, 1]]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(40)] + [(None, rows[1][1]), (7, rows[7][1])]
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf")] * 5), (204, [-0.0, -1e-9, 0.0, 1e-9, -256.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("x", F.lit(1)).withColumn("dim", F.lit(2))
    check_whitening(rows, wh.whitened(df).collect())
    short = spark.createDataFrame([*rows, (300, [1.0]), (301, [])], "vec_id long, embedding array<double>")
    check_whitening(rows, wh.whitened(short).collect())
    flat = [(k, [float(k % 7), float(2 * (k % 7)), 1.0]) for k in range(20)]
    got = wh.whitened(spark.createDataFrame(flat, "vec_id long, embedding array<double>")).collect()
    assert {g["component"] for g in got} == {1} and abs(got[0]["explained"] - 1) < 1e-9
    for few in ([], [(1, [1.0, 2.0])], [(1, None)], [(1, [])], [(1, [2.0]), (2, [2.0])]):
        assert wh.whitened(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == 0
    large = [(k, [float(c) * 1e12 for c in r.normal(size=3)]) for k in range(5)]
    with pytest.raises(Exception, match="64-bit"):
        wh.whitened(spark.createDataFrame(large, "vec_id long, embedding array<double>")).collect()
