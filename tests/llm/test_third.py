"""Ranked search, main text of pages and Merkle manifests: brute force, labelled pages, and tables with nulls, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import html
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lacewing.llm import extraction, merkle, queries, search

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def ranked(docs, items, k):
    """The contract of search(), read off."""
    found = lambda t: [re.sub(r"[A-Z]+", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, Counter(found(t))) for i, t in docs if found(t)]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    holding = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in own:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in found(text) if t in c)
            if s > 0:
                scores.append((-s, -1 if i is None else i))
        out += [(item, rank, None if i == -1 else i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    words = [f"w{i}" for i in range(90)] + ["É", "été", "X-Y", "naïve", "A1"]
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(words[int(x)] for x in (len(words) * rng.random(n) ** 3))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(400)]
    docs += [(500, None), (501, ""), (502, "--- ///"), (None, docs[5][1]), (None, docs[5][1]), (7, docs[7][1]), (503, text(20_000)), *[(600 + i, docs[9][1]) for i in range(40)]]
    items = [(1, "w1 W1 w2"), (2, text(40)), (3, None), (4, ""), (5, "unheard"), (6, " ".join(words)), (6, "w80"), (None, docs[9][1])]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, score string").repartition(5)
    got = search.search(frame, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"), 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items, 10)
    empty = frame.limit(0)
    assert search.search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert search.search(frame, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_search_in_blocks_of_items(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 5} c{i % 3} d") for i in range(100)]
    items = [(i, f"a{i % 7} b{(i + 1) % 5} c1") for i in range(12)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(search, "BLOCK_BYTES", 20)
    assert sorted(map(tuple, search.search(*frames, 3).collect()), key=str) == ranked(docs, items, 3)


def test_a_masks_bound_stops_the_evaluation():
    """All terms' holders come first; the others are never scored, and the result is the same."""
    import pandas as pd

    rows = pd.DataFrame({"n": [10] * 1000, "terms": [[0, 1] if i % 100 == 0 else [0] for i in range(1000)], "counts": [[2, 2] if i % 100 == 0 else [1] for i in range(1000)]})
    postings = search.Postings(rows, 1000, 10_000)
    masks, group = search.grouped(postings, np.array([0, 1]))
    assert len(masks) == 2 and len(group) == 1000
    none = np.empty(0, np.int64)
    scores, ids = search.best(postings, np.arange(1000), np.array([0, 1]), np.array([3, 5]), 10, (none, none))
    assert ids.tolist() == list(range(0, 1000, 100)) and len(set(scores.tolist())) == 1


def node(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def manifest_by_brute_force(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaves = []
    for d in docs:
        hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0
        leaves.append((*d[:2], node(*map(field, d)), node(*map(field, (*d[:4], lower(d[4]) if hit else d[4])))))

    def climb(level):
        """(root, paths) of a list of digests; a path lists (left, right)."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, p in enumerate(paths):
                a = at[i] // 16 * 16
                p.append((level[a : at[i]], level[at[i] + 1 : a + 16]))
                at[i] //= 16
            level = [node(*level[a : a + 16]) for a in range(0, len(level), 16)]
        return level[0], paths

    by_source = defaultdict(list)
    for x in leaves:
        by_source[x[1]].append(x)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        trees[s] = own, *climb([x[2] for x in own])
    root, tops = climb([trees[s][1] for s in names]) if names else (None, [])
    out = []
    for s, top in zip(names, tops, strict=True):
        own, subroot, paths = trees[s]
        for (i, _, leaf, now), path in zip(own, paths, strict=True):
            h = now
            for left, right in path + top:
                h = node(*left, h, *right)
            out.append((i, leaf, subroot, root, node(*[x for left, right in path + top for x in (*left, *right)]), h, h == root))
    return out


@pytest.mark.parametrize("hot", [0, 700])
def test_manifest_equals_brute_force(spark, hot):
    docs = [(i, f"s{i % 19}", "en" if i % 3 else None, i * 7 if i % 4 else None, f"Text {i} É" if i % 5 else None) for i in range(330)]
    docs += [(1000 + i, "hot", "en", 1, f"Copy {i}") for i in range(hot)]
    docs += [(2000, None, "de", 3, "X"), (2001, "alone", "de", 3, ""), (2002, "é", "de", 3, "É"), (None, "s1", "x", 1, "N"), (None, "s1", "x", 1, "M"), (5, "s5", "x", 1, "again"), *[(9, "s9", "en", 1, "Same")] * 40]
    frame = spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(6)
    got = merkle.manifest(frame, merkle.tampering())
    assert sorted(map(tuple, got.collect()), key=str) == sorted(manifest_by_brute_force(docs), key=str)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    docs = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.manifest(frame, merkle.tampering()).collect())) == sorted(manifest_by_brute_force(docs))
    assert merkle.manifest(frame).where("not verified").count() == 0


@tables
@pytest.mark.parametrize("name", ["op11_search", "op13_merkle"])
def test_oracles(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLES[name])
    assert got.columns == expected.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall()))


@pytest.fixture(scope="module")
def tree(spark):
    return extraction.trained(spark)


#: Held-out pages with their main text; none of their layouts is among the sketches.
PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></nav><article><h1>The story</h1><p>It began on a <b>dark</b> night &amp; ended well.</p><p>Yes.</p></article><footer>&copy; 2020 Someone</footer></body></html>", "The story It began on a dark night & ended well. Yes."),
    ("<div id=cookie-consent><p>This site uses cookies. By going on you agree to them all.</p><button>Agree</button></div><div class=main-content><h2>Soup</h2><p>Boil the water\n\n for   ten minutes and add&nbsp;salt.<br>Stir.</p><ul><li>Salt</li><li>Two carrots</li></ul></div><div class='user-comments'><p>I made this soup yesterday and everybody liked it a lot, thank you for it.</p></div>", "Soup Boil the water for ten minutes and add salt. Stir. Salt Two carrots"),
    ("<body><article><p>First part of the text is here.</p><div class='advertisement'>Buy now and save very much</div><p>Second part, a < b.</p><section id='comments'><article><p>Great article, I read it twice and learned much.</p></article></section></article><aside><p>A box at the side with quite some words in it.</p></aside><form action=x><p>Your name please</p><input></form>", "First part of the text is here. Second part, a < b."),
    ("<script>if (a < b) document.write('<p>no</p>')</script><!-- <p>none</p> --><main><p>Kept &lt;p&gt; as text.</p><noscript><p>off</p></noscript></main><nav>off</nav>", "Kept <p> as text."),
    ("<article><p>Not closed<p>nor this<article", "Not closed nor this"),
    ("<div id=page><header class='site-header'><h1 class='site-title'><a href=/>My Blog</a></h1><p>Just another page of words</p></header><div class='site-content'><main id=main><article class='post hentry'><header class='entry-header'><h1 class='entry-title'>On tea</h1></header><div class='entry-content'><p>Tea is made from leaves, as everybody knows well.</p><div class='adsbygoogle'>Cheap cups here</div><p>Drink it hot.</p></div><footer class='entry-footer'>Filed under: drinks</footer></article><div id='comments' class='comments-area'><ol class='comment-list'><li><p>I prefer coffee to tea, and so do all the people that I know.</p></li></ol></div></main></div><aside class='widget-area'><section class='widget'><h2>Recent</h2><ul><li><a href=x>On milk and honey</a></li></ul></section></aside></div>", "On tea Tea is made from leaves, as everybody knows well. Drink it hot."),
    ("<section aria-label='Cookie settings'><p>We set small files on your machine, please say if you agree to that.</p></section><div><h1>Rivers</h1><p>The river runs from the hills to the sea and takes its time for it.</p><p>It is long.</p><table><tr><td>Length</td><td>900 km</td></tr></table><p>In winter it freezes over, and in spring the ice goes out with much noise.</p></div><div>© 2021 River people</div>", "Rivers The river runs from the hills to the sea and takes its time for it. It is long. Length 900 km In winter it freezes over, and in spring the ice goes out with much noise."),
    (None, ""), ("", ""), ("<nav><a href=x>only</a></nav>", ""),
]


def test_held_out_pages(spark, tree):
    got = [extraction.main_text(page, tree) for page, _ in PAGES]
    assert got == [text for _, text in PAGES]


def test_the_labelled_table_is_learned(tree):
    rows = extraction.labelled()
    assert 1000 < len(rows) <= extraction.TRAINING_BLOCKS
    right = tree.judge(np.array([x for x, _ in rows])) == np.array([y > 0.5 for _, y in rows])
    assert right.mean() > 0.99
    assert len(extraction.labelled(50)) == 50


@tables
def test_all_given_pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op12_extraction(spark, DATA).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        expected = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, expected, len(expected))


def test_pages_with_nulls_and_clashing_columns(spark, tree):
    rows = [(1, "u", "<p>Some text that is long enough to stay here.</p>", "t"), (1, "u", "<p>Some text that is long enough to stay here.</p>", "t"), (None, None, None, None), (2, "v", "<p>" + "word " * 300_000, "t"), (3, "w", "😀 <b>x", "t")]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), tree)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert len(found) == 5 and found[0] == found[1] and (None, None, "", 0) in found
    assert next(x for x in found if x[0] == 2)[3] == 5 * 300_000 - 1 and next(x for x in found if x[0] == 3)[3] in (0, 3)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string"), tree).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='a", "'>", "\"", "<", ">", "&amp", "&", "text ", "<li>", "</ul>", "<!--", "-->", "<script>", "</script", "<a href=x>", "</a>", "é", "<nav>", "</nav>", "<br/>", "\x00", "</article>", "<article>"]), max_size=40))
def test_broken_markup_never_crashes(pieces):
    page = "".join(pieces)
    found = extraction.blocks(page)
    assert extraction.described(found).shape == (len(found), len(extraction.FEATURES))
    assert all(b.text and b.text == " ".join(b.text.split()) for b in found)


def test_many_unbalanced_quotes_take_no_long():
    extraction.blocks("<a b='" * 20_000)
    extraction.blocks("<" * 50_000 + "<!--" * 5)
