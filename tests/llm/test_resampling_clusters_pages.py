"""Importance resampling, centroid clustering and main-text extraction against plain versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from regscope.llm import centroids, markup, queries, resampling, style_trees

LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(w), w + [" ".join(p) for p in zip(w, w[1:], strict=False)]


def test_checksums_of_features():
    texts = ["Ab c AB", None, "", "a\x00b\ny", "É é 한국어 z9", LONG, "x" * 70_000, "-", " tail", "a"]
    bucket, doc, n = resampling.feature_buckets(pa.array(texts, pa.string()))
    got = [Counter() for _ in texts]
    for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
        got[d][b] += 1
    for k, text in enumerate(texts):
        count, own = features(text)
        assert n[k] == count and got[k] == Counter(zlib.crc32(f.encode()) % 10_000 for f in own)
    sliced = pa.array(texts, pa.string()).slice(4, 3)
    assert np.array_equal(resampling.feature_buckets(sliced)[0], resampling.feature_buckets(pa.array(texts[4:7], pa.string()))[0])
    assert all(len(x) == 0 for x in resampling.feature_buckets(pa.array([], pa.string())))


def test_longer_features():
    bucket, doc, _ = resampling.feature_buckets(pa.array(["a b c d", "b c d", "q"]), 10_000, 3)
    own = lambda w: [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    for k, text in enumerate(("a b c d", "b c d", "q")):
        assert Counter(bucket[doc == k].tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in own(text.split()))


def plain_resampling(rows, target):
    have, want = Counter(), Counter()
    for _, t in rows:
        have.update(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1])
    for t in target:
        want.update(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1.0) * (s + 10_000.0) / ((have[b] + 1.0) * (t + 10_000.0))))
    out = []
    for i, text in rows:
        n, own = features(text)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    ranked = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return sorted((*r[:4], ranked.index(r) + 1 if r in ranked[: 25 * len(ranked) // 100] else None) for r in out if r[0] is not None)


def test_resampling_equals_a_plain_version(spark):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 500}" for _ in range(r.randrange(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, LONG), (203, "ÜBER " * 30), (None, "x " * 25), (7, rows[7][1])]
    target = [rows[3][1], rows[9][1], None, "", "x x"]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n int, score int, rank int").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(df, bench)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    all_rows = [tuple(x) for x in got.collect()]
    want = plain_resampling(rows, target)
    drop_rank = lambda x: x[:4]  # noqa: E731  of two equal rows either may be ranked first
    assert sorted(map(drop_rank, (x for x in all_rows if x[0] is not None))) == sorted(map(drop_rank, want))
    assert {x for x in all_rows if x[0] not in (None, 7)} == {x for x in want if x[0] != 7}
    ranks = sorted(x[4] for x in all_rows if x[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == 25 * sum(features(t)[0] >= 20 for _, t in rows) // 100
    assert resampling.resampled(df.limit(0), bench).count() == 0
    assert resampling.resampled(df, bench.limit(0)).count() == len(rows)


def test_ranks_of_tied_scores_go_to_smaller_identifiers(spark):
    """One text, and identifiers whose draws are equal only where they repeat."""
    rows = [(i % 40, "same words " * 12) for i in range(200)]
    got = resampling.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), spark.createDataFrame([("same",)], "text string")).collect()
    drawn = sorted((x for x in got if x.rank), key=lambda x: x.rank)
    assert [x.rank for x in drawn] == list(range(1, 51)) and [(-x.score, x.doc_id) for x in drawn] == sorted((-x.score, x.doc_id) for x in drawn)
    assert min(x.score for x in drawn) >= max(x.score for x in got if not x.rank)


@pytest.mark.parametrize("k", [1, 2, 7, 40])
def test_tree_search_finds_ties_too(k):
    r = np.random.default_rng(k)
    for dims, spread in ((2, 3), (5, 2), (64, 200)):
        points, x = r.integers(-spread, spread, (k, dims)), r.integers(-spread - 1, spread + 1, (300, dims))
        who, best, taken = centroids.Tree(points).nearest(x)
        all_pairs = ((x[:, None] - points[None]) ** 2).sum(axis=2)
        assert np.array_equal(who, all_pairs.argmin(axis=1)) and np.array_equal(best, all_pairs.min(axis=1)) and taken <= 300 * k


def test_tree_search_prunes_and_keeps_large_distances_exact():
    r = np.random.default_rng(1)
    points = r.integers(-5, 5, (40, 64)) + 4000 * r.integers(0, 9, (40, 1))
    x = points[r.integers(0, 40, 500)] + r.integers(-3, 3, (500, 64))
    who, best, taken = centroids.Tree(points).nearest(x)
    all_pairs = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    assert np.array_equal(who, all_pairs.argmin(axis=1)) and np.array_equal(best, all_pairs.min(axis=1))
    assert taken < 0.5 * 500 * 40
    far = np.array([[centroids.FAR] * 64, [-centroids.FAR] * 64])
    assert centroids.Tree(far).nearest(far[:1] - 1)[1][0] == 64 and centroids.Tree(far[1:]).nearest(far[:1])[1][0] == 64 * (2 * centroids.FAR) ** 2


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest()
    points = [v for _, v in sorted(kept, key=lambda p: (name(p[0]), p[1]))[:k]]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        of = [assign(v)[1] for _, v in kept]
        for c in range(len(points)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *assign(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, d, c in found]


def test_clusters_equal_a_plain_version(spark):
    r = random.Random(6)
    rows = [(i, [r.choice((-0.25, 0.0, 0.31, r.uniform(-1, 1))) for _ in range(8)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # many equal vectors
    rows += [(300, None), (301, []), (302, [1.0] * 7), (303, [1.0] * 7 + [None]), (304, [math.nan] + [0.0] * 7), (305, [math.inf] + [0.0] * 7), (None, [0.5] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, distance int").repartition(3)
    for k in (1, 6, 400):
        got = centroids.clusters(df, k=k, rounds=3, dimensions=8)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
        assert sorted(map(tuple, got.collect()), key=order) == sorted(plain_clusters(rows, k, 3, 8), key=order)
    assert centroids.clusters(df.limit(0)).count() == 0 and centroids.clusters(df).count() == 0  # no vector of 64


def test_clusters_of_huge_components_have_a_result(spark):
    df = spark.createDataFrame([(i, [float(s) * 3e38] * 64) for i, s in enumerate((1, 1, -1))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in centroids.clusters(df, k=2).collect()}
    assert {r.distance for r in got.values()} == {0} and len(got) == 3


def text_of(html):
    return markup.main_text(markup.read_page(html), frozenset(), markup.Keys())


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two&nbsp;three<p><b>four<br>five</article><footer>f</footer>", "A & B\none two three\nfour five"),
        ("<div id='cookie-banner'>We use</div><main><p>m</p><aside>s</aside><form>x<input></form></main>", "m"),
        ("<article><p>a</p><div class='ad'>buy</div><script>if (a < b) '</p>'</script><style>p{}</style><p>b</p></article>", "a\nb"),
        ("<article><p>a</p></article><section class=comments><article><p>me too</p></article></section>", "a"),
        ("<article><p>a</p></article><article class='comment'>me too</article><article><p>b</p></article>", "a\nb"),
        ("<article class='post comments-open sidebar-right'><p>t</p></article>", "t"),
        ("<body class='has-sidebar'><header>Site</header><div class='post-content'><p>x</p></div><div class=sidebar>y</div>", "x"),
        ("<header>Site</header><p>no article here</p><div>but text</div><footer>f", "no article here\nbut text"),
        ("<article><header><h1>Title</h1></header><table><tr><td>1</td><td>2</td></tr><tr><td>3</table><ul><li>x<li>y</ul></article>", "Title\n1 2\n3\nx\ny"),
        ("<nav><ul><li>menu<article><p>a nav that nothing closes</p></article>", "a nav that nothing closes"),
        ("<article><p>a &lt;b&gt; &#x263A; &bogus; 1 < 2 & 3</p><!-- <p>c</p> --><p hidden>h</p><p style='display: none'>i</p></article>", "a <b> ☺ &bogus; 1 < 2 & 3"),
        ("<article><p title='a > b'>q</p><p title=\"never closed>r</p></article>", "q\nr"),
        ("<p>cut in a tag <a href='x", "cut in a tag"),
        ("<script>never closed <article>a</article>", ""),
        ("<article><p>before <span class='share'>share me</span> after</p></article>", "before after"),
        ("plain words", "plain words"),
        ("", ""),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>flat", "deep\nflat"),
    ],
)
def test_roles_and_blocks(html, text):
    assert text_of(html) == text


def test_broken_markup_is_read_in_linear_time():
    for html in ("<a '>" * 50_000, '<a "' * 50_000 + ">", "<li><div>" * 20_000, "<button>" * 20_000 + "</a>" * 20_000, "<p><td>" * 10_000, "<a " * 50_000, "<!--" * 50_000, "</" * 50_000):
        markup.TreeRows().add(markup.read_page(html), markup.Keys())


PAGES = "page_id long, url string, html string, text string, host string, low string"


def site(n, host="http://A.example.org:80/x/", extra=""):
    """Pages without any element that names its role: a box that repeats and one that changes."""
    return [(i, f"{host}{i}", f"<div class='q7'><p>Read all our offers</p><a href=/o>offers</a></div><div class='k2'><p>Story {i} of a day.</p><p>It has its own words {i * 7}.</p></div>{extra}", "t", "h", "l") for i in range(n)]


def test_templates_of_a_host_go_and_articles_stay(spark):
    rows = site(12)
    rows += [(100 + i, f"http://copies.example.org/{i}", "<div class='k2'><p>One story</p></div><div class='q7'><p>Same box</p></div>", "t", "h", "l") for i in range(9)]  # copies tell nothing of a template
    rows += [(200, "http://alone.example.org/", rows[0][2], "t", "h", "l"), (201, None, rows[0][2], "t", "h", "l"), (202, "no host", rows[0][2], "t", "h", "l"), (203, rows[1][1], None, "t", "h", "l"), (204, rows[1][1], "", "t", "h", "l")]
    rows += [(5, rows[5][1], rows[5][2], "t", "h", "l"), (None, rows[4][1], rows[4][2], "t", "h", "l")]
    rows += [(300 + i, f"http://art.example.org/{i}", f"<article><p>Same opening</p><p>Story {i}</p><div class=zz><p>Join us today</p></div></article>", "t", "h", "l") for i in range(8)]
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    got = style_trees.main_texts(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r.page_id, r.text) for r in got.collect()]
    assert len(found) == len(rows)
    by = dict(found)
    for i in range(12):
        assert by[i] == f"Story {i} of a day.\nIt has its own words {i * 7}."
    assert by[None] == by[4] and sum(p == 5 for p, _ in found) == 2
    assert all(by[100 + i] == "One story\nSame box" for i in range(9))
    assert by[200] == by[201] == by[202] == "Read all our offers\noffers\nStory 0 of a day.\nIt has its own words 0."
    assert by[203] == by[204] == ""
    assert all(by[300 + i] == f"Same opening\nStory {i}" for i in range(8))
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert style_trees.main_texts(df.limit(0)).count() == 0


def plain_tree(pages):
    """Composite importance of the nodes of one host by recursion over the merged tree."""
    merged = {}
    for html in pages:
        rows, seen = markup.TreeRows(), {}
        rows.add(markup.read_page(html), markup.Keys())
        for k, parent, _, kind, value, share in zip(rows.key, rows.parent, rows.depth, rows.kind, rows.value, rows.share, strict=True):
            node = merged.setdefault(k, {"parent": parent, "pages": 0, "styles": Counter(), "features": Counter(), "share": 0.0})
            node["features" if kind else "styles"][value] += 1
            if not kind:
                node["pages"] += 1
                node["share"] += share
            seen[k] = True
    def importance(k):
        node = merged[k]
        m = node["pages"]
        below = [c for c in merged if merged[c]["parent"] == k]
        if m < 2:
            own = 1.0
        elif node["features"]:
            own = 1 - sum(math.log(n, m) for n in node["features"].values()) / len(node["features"])
        else:
            own = -sum(n / m * math.log(n / m, m) for n in node["styles"].values())
        if not below:
            return own
        keep = 0.9 ** len(node["styles"])
        return (1 - keep) * own + keep * sum(merged[c]["share"] / m * importance(c) for c in below)

    return {k: importance(k) for k in merged}


def test_composite_importance_equals_a_plain_recursion(spark):
    r = random.Random(2)
    pages = [f"<div class=a><p>same</p><ul>{'<li>x' * r.randrange(1, 4)}</ul></div><div class=b><h2>{r.randrange(3)}</h2><p>text {i} {r.random()}</p></div>" + ("<hr><div>extra</div>" if i % 3 == 0 else "") for i in range(20)]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    seen = style_trees.read_pages(style_trees.with_page(df, "page_id", "url", "html"))
    got = {x.key: x.composite for x in style_trees.composite(style_trees.node_table(seen)).collect()}
    want = plain_tree(pages)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_given_pages_keep_their_articles(spark):
    """The text between the article's tags, block by block, of every given page."""
    rows = queries.op13_html_extraction(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    from html import unescape

    for r in rows:
        inside = re.split(r"</article>|<footer>", pages[r.page_id].split("<article>")[1])[0]
        blocks = [" ".join(unescape(re.sub("<[^>]*>?", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b)
