"""The Merkle manifest, whitening and HTML extraction against brute force, on tables and at the edges."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import decontaminate, exact_dedup, htmltext, merkle, queries, urlfilter, whiten

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# Merkle manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def beside(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i - i % 3
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])))
        i //= 3
    return out


def manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(part, [r.doc_id, r.source, r.lang, r.n_chars, t])))
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    keys = sorted(sources, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        sources[k].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {k: levels([leaf(r, r.text) for r in sources[k]]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(sources[k]):
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node, proof = leaf(r, text), beside(trees[k], i) + beside(top, j)
            for a, b in proof:
                node = sha(a + node + b)
            root = top[-1][0]
            out.append((r.doc_id, leaf(r, r.text), trees[k][-1][0], root, sha("".join(a + b for a, b in proof)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 8])
def test_merkle_on_a_table(spark, height):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = merkle.documents(docs, height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == manifest(docs.collect())


def test_merkle_edges(spark):
    rows = [(i, "a\nb" if i % 3 else None, "en", f"s{i % 4}" if i % 5 else None, i) for i in range(40)]
    rows += [(7, "a\nb", "en", "s3", 7)] * 3 + [(None, "x\n", None, "", None), (1, "é" * 100_000 + "\n", "fr", "only", 3), (-5, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for height in (1, 8):
        got = merkle.documents(docs.withColumn("idx", F.lit(1)).withColumn("k", F.lit("k")).withColumn("leaf", F.lit("l")), height)
        assert sorted(map(tuple, got.collect()), key=str) == manifest(docs.collect())
    lone = merkle.documents(docs.filter("source = 'only'")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == sha("")
    assert merkle.documents(docs.limit(0)).count() == 0


def test_traversal_is_bounded():
    leaves = [str(i) for i in range(200)]
    tree = merkle.Growing(2, 2)
    for x in leaves[:81]:
        tree.feed(x)
        assert sum(map(len, tree.open)) <= 2 * tree.top and sum(map(len, tree.nodes)) <= 9 + 3
    for n in (1, 2, 3, 4, 9, 10, 80, 81, 82, 200):
        whole, height = levels(leaves[:n]), merkle.levels_of(n)
        assert merkle.root_of(leaves[:n], height) == whole[-1][0]
        assert list(merkle.paths(leaves[:n], height)) == [beside(whole, i) for i in range(n)]


# whitening


def whitened(spark, rows, k=8):
    x = np.floor(1024 * np.array(rows, float)).astype(np.int64) + 100_000
    n = len(x)
    y = n * x - x.sum(axis=0)
    e, u = np.linalg.eigh((y / n).T @ (y / n) / n)
    return (y**2).sum(axis=1), (y / n) @ u[:, ::-1][:, :k] / np.sqrt(e[::-1][:k]), e[::-1][:k] / e.sum()


@pytest.mark.parametrize("fan_in", [2, 16])
def test_whitening_on_a_table(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whiten, "FAN_IN", fan_in)
    table = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(7)
    got = whiten.whiten(table).toPandas().sort_values(["vec_id", "component"])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    deviation, want, share = whitened(spark, [r.embedding for r in table.orderBy("vec_id").collect()])
    made = got.whitened.to_numpy().reshape(want.shape)
    assert np.allclose(made * np.sign((made * want).sum(axis=0)), want, atol=1e-10)
    assert (got.deviation.to_numpy()[::8] == deviation).all() and set(got.n) == {len(want)}
    assert np.allclose(got.explained.to_numpy()[:8], share, rtol=1e-10) and got.identity_error.max() < 1e-12


def test_jacobi():
    r = np.random.default_rng(5)
    for shape in [(1, 1), (3, 3), (20, 20), (30, 7)]:
        a = r.normal(size=shape) @ np.diag(10.0 ** -np.arange(shape[1]) * (shape[1] < 10) + (shape[1] >= 10))
        s, v = whiten.jacobi(a)
        assert np.allclose(v.T @ v, np.eye(shape[1]), atol=1e-13)
        assert np.allclose(s, np.linalg.svd(a, compute_uv=False), rtol=1e-10) and np.allclose(np.linalg.norm(a @ v, axis=0), s)
    assert whiten.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_whitening_edges(spark):
    kind = "vec_id long, embedding array<float>, component string"
    bad = [(3, None), (4, [math.nan, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (8, [math.inf, 0.0])]
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.0]), (9, [1e30, -1e30])]
    table = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], kind)
    got = whiten.whiten(table(bad + good)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i or 0, c) for i, _ in good for c in (1, 2))
    assert all(r.deviation is None for r in got if r.vec_id == 9)  # beyond a long
    small = whiten.whiten(table(good[:3])).collect()
    assert {r.whitened is None for r in small if r.component == 2} == {True} and max(r.identity_error for r in small) < 1e-12
    assert all(r.whitened is None and r.explained is None and r.deviation == 0 for r in whiten.whiten(table(good[:2])).collect())
    assert whiten.whiten(table(bad[:3])).count() == 0 and whiten.whiten(table([])).count() == 0


# html


def article(html):
    """What stands in the article of the tables' pages, which have no more than headings, paragraphs, bold type and line breaks there."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", body).replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)


def test_html_query(spark):
    got = queries.QUERIES["op13_html_extraction"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def text_of(html):
    return htmltext.main_text(htmltext.Page(html), None)


def test_html_markup():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>document.write("<article>x</article>")</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li>Home<li>More</ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<main><article class="post"><h1>Fish &amp; chips</h1><p>One <b>two</b><br>three&nbsp;&#8212;&#x41;<!-- no <p> --> four
  five<p>Open paragraph<ul><li>first<li>second</ul><form><input name=a><label>Mail</label><button>Send</button></form>
<div class="ad-slot">Buy <div>now</div>!</div><blockquote>Said</blockquote>Bare <span class="share">Share!</span> text<table><tr><td>c1<td>c2<tr><td>c3</table>
<noscript>Turn it on</noscript><section id="comments"><article class="comment"><p>First!!! Such a long and winding comment that goes on and on and on</p></article></section>
</article></main><aside><p>Related</p></aside><footer>&copy; 2020</footer></body></html>"""
    want = ["Fish & chips", "One two three —A four five", "Open paragraph", "first", "second", "Said", "Bare text", "c1", "c2", "c3"]
    assert text_of(page) == "\n\n".join(want)
    assert text_of("") == text_of("<p> \n</p>") == text_of("<script>x") == text_of("<!-- x") == ""
    assert text_of("a < b <3 &lt;p&gt; & c") == "a < b <3 <p> & c"
    assert text_of('<p title="a > b" data-x=\'>\'>t</p x>') == "t"
    assert text_of("<div id='sidebar'>s</div><div class='content'><h2>H</h2>x</div><div class=footer>f") == "H\n\nx"
    assert text_of("<article><p class=ad>Buy<p>Real</article>") == "Real"
    assert text_of("<article><p>a</p><nav><ul><li>x</ul><div></nav>b</article><p>c") == "a\n\nb"


@pytest.mark.parametrize("unit", ["<", "<a ", '<a href="', "<div>", "<!--", "<p>", "<span>", "</b>", "<li>", "<td>", "&", "<a x" + "y" * 40, "<b><p>", "<p class=ad>", "<div class=ad><div>"])
def test_html_of_any_length(unit):
    began = time.time()
    page = htmltext.Page(unit * 50_000 + "<p>" * 3 + "end</p>")
    htmltext.merge(page.root, htmltext.Page(unit * 1000).root)
    htmltext.main_text(page, page.root)
    assert time.time() - began < 10


def test_tree_matching():
    """Against the plain recurrence of simple tree matching."""
    r = random.Random(3)

    def tree(depth):
        kinds = r.sample("abcdef", r.randint(0, 5)) if depth else []
        return htmltext.Slot(r.choice("xy"), 1, {}, [s for k in kinds for s in [tree(depth - 1)] if not setattr(s, "kind", k)])

    def plain(a, b):
        if a.kind != b.kind:
            return 0
        m = [[0] * (len(b.below) + 1) for _ in range(len(a.below) + 1)]
        for i, s in enumerate(a.below):
            for j, t in enumerate(b.below):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain(s, t))
        return m[-1][-1] + 1

    for _ in range(500):
        a, b = tree(3), tree(3)
        assert htmltext.matched(a, b, {}) == plain(a, b)


WORDS = "apple river stone cloud maple tiger ocean light paper house green music".split()


def soup(i):
    """A page without any telling markup."""
    r = random.Random(i)
    para = lambda: " ".join(r.choice(WORDS) for _ in range(20)) + f" {i}."
    body = [para() for _ in range(r.randint(1, 4))]
    html = "<div class=a1><a href=/>Start</a> <a href=/b>Shop</a></div><div class=b2><h2>%s</h2>%s</div><div class=a1>All rights reserved by us</div><p>Call now</p>"
    return html % (f"Title {i}", "".join(f"<p>{b}</p>" for b in body)), "\n\n".join([f"Title {i}", *body])


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_wrappers(spark, parts):
    made = {i: soup(i) for i in range(60)}
    odd = "<div class=zz><p>Nothing found here</p></div>"
    rows = [(i, f"http://soup.example/{i}", html) for i, (html, _) in made.items()] + [(100, "http://soup.example/404", odd)]
    rows += [(200 + i, f"http://copies.example/{i}", made[3][0]) for i in range(4)] + [(300, None, None), (301, "no url", soup(7)[0])]
    # articles that share a paragraph keep it, and copies of one keep all of it
    rows += [(400 + i, f"http://arts.example/{i}", f"<article><h1>T{i}</h1><p>{soup(i)[1]}</p><p>Licence: as is.</p></article><p>Same</p>") for i in range(3)]
    rows += [(500 + i, f"http://same.example/{i}", f"<article><h1>T</h1><p>{soup(1)[1]}</p></article>") for i in range(9)]
    # what ten articles share is no part of them
    rows += [(600 + i, f"http://many.example/{i}", f"<article><h1>T{i}</h1><p>{soup(i)[1]}</p><p>Follow us</p></article>") for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    got = {r.page_id: r.text for r in htmltext.extract(pages.withColumn("host", F.lit("h"))).collect()}
    flat = lambda t: " ".join(t.split())
    assert {i: got[i] for i in made} == {i: text for i, (_, text) in made.items()}
    assert got[100] == "Nothing found here" and got[300] == ""
    assert all(flat(made[3][1]) in flat(got[200 + i]) for i in range(4)) and flat(soup(7)[1]) in flat(got[301])
    assert all(got[400 + i] == f"T{i}\n\n{flat(soup(i)[1])}\n\nLicence: as is." for i in range(3))
    assert all(got[500 + i] == f"T\n\n{flat(soup(1)[1])}" for i in range(9))
    assert all(got[600 + i] == f"T{i}\n\n{flat(soup(i)[1])}" for i in range(10))
    empty = htmltext.extract(pages.limit(0))
    assert empty.columns == ["page_id", "url", "text"] and empty.count() == 0


# long inputs and foreign files of earlier operators


def test_exact_dedup_beside_other_files(spark, tmp_path):
    spark.createDataFrame([(1, "Aé"), (2, "aé"), (3, "b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/aaa.parquet")
    spark.range(3).selectExpr("CAST(id AS INT) AS text").write.parquet(f"{tmp_path}/bbb.parquet")
    rows = exact_dedup.dedup(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in rows) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def test_exact_dedup_of_other_kinds(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "A")], "doc_id long, text string").write.json(f"{tmp_path}/docs")
    got = exact_dedup.dedup(spark.read.schema("doc_id long, text string").json(f"{tmp_path}/docs")).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 2), (2, 2)]
    spark.createDataFrame([(1, 5), (2, 5)], "doc_id long, text int").write.parquet(f"{tmp_path}/numbers")
    got = exact_dedup.dedup(spark.read.parquet(f"{tmp_path}/numbers")).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(1, 2), (2, 2)]


def test_hosts_of_many_labels(spark):
    long = ".".join(["a"] * 100_000)
    rows = [(1, f"http://{long}.net/x"), (2, f"http://{long}/"), (3, "http://net/"), (4, f"http://{long}.example.net/en/1"), (5, "http://xnet/"), (6, "http://.net/"), (7, "http:///x")]
    pages, began = spark.createDataFrame(rows, "page_id long, url string"), time.time()
    rules = {"net/": "block", "example.net/en/": "allow", "a.b.c.d/": "block"}
    for given in (rules, spark.createDataFrame(list(rules.items()), "rule string, verdict string")):
        got = {r.page_id: r.rule for r in urlfilter.filter_urls(pages, given).collect()}
        assert got == {1: "net/", 2: None, 3: "net/", 4: "example.net/en/", 5: None, 6: "net/", 7: None}
    assert time.time() - began < 60


def test_spans_of_a_long_text(spark):
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(100_000)]
    text = [f"clean{i}" if i % 50 == 0 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(text)), (2, "a b c"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: r.text for r in decontaminate.drop_spans(docs, bench).collect()}
    assert got == {1: "".join(f"clean{i} " for i in range(0, 100_000, 50)), 2: "a b c", 3: None} and time.time() - began < 60
