from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from tessera.llm import boosting, dom, html_extract

from .common import with_clashes


@pytest.fixture(scope="module")
def trees():
    return html_extract.model()


def test_held_out_pages(trees):
    right = total = 0
    for seed in range(50_000, 50_150):
        order = dom.preorder(dom.parse(html_extract.training_page(seed)))
        kept = html_extract.decode(order, trees.scores(html_extract.features(order)))
        for node, k, y in zip(order, kept, html_extract._labels(order), strict=True):
            if node.tag == "#text":
                total += 1
                right += k == (y > 0)
    assert right / total > 0.99


def test_article_amid_everything_else(trees):
    page = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><header><h1>Site</h1></header>
      <nav><ul><li><a href=/>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
      <article><h1>Title &amp; more</h1><p>First  paragraph,\nwith <b>bold</b> text &eacute;.<br>Next line of it.<p>Second one, it is not long.</p><div class="ad">Buy now</div><p>Third.</p></article>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=/d>Four</a></li></ul></aside><section class="comments"><p>I liked it, said a reader.</p></section><footer>&copy; 2020 &middot; Us</footer></body></html>"""
    assert html_extract.extract([page], trees) == ["Title & more\nFirst paragraph, with bold text é. Next line of it.\nSecond one, it is not long.\nThird."]


def test_no_child_is_kept_in_a_dropped_branch(trees):
    for seed in range(60_000, 60_040):
        order = dom.preorder(dom.parse(html_extract.training_page(seed)))
        kept = dict(zip(map(id, order), html_extract.decode(order, trees.scores(html_extract.features(order))), strict=True))
        assert all(kept[id(n.parent)] for n in order if n.parent is not None and kept[id(n)])


def test_broken_markup_and_odd_rows(spark, trees):
    long = "<article>" + "<p>A sentence of the text, as long as others are.</p>" * 3000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<"), (4, "u", "<article><p>Cut off in the midd"), (5, "u", "<article><p>Cut &am"), (None, "u", "</p></div>"), (6, "u", long), (7, "u", "<article><p>a < b & c</p><p>x</art")]
    table = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r["page_id"]: r for r in html_extract.main_text(table, trees=trees).collect()}
    assert [got[k]["text"] for k in (1, 2)] == ["", ""] and got[None]["text"] == ""
    assert got[4]["text"] == "Cut off in the midd" and got[5]["text"] == "Cut &am" and got[7]["text"] == "a < b & c\nx"
    assert got[6]["text"].count("\n") == 2999 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.main_text(table.limit(0), trees=trees).count() == 0


def test_harness_pages_give_their_articles(spark, sf_dir):
    import html
    import re

    from tessera.llm import registry

    rows = registry.queries()["op9_html_extraction"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)
        blocks = re.split(r"</?(?:p|h1)>", body[1] if body else "")
        want = [" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in want if b)


def test_deep_pages_take_time_in_proportion(spark, trees):
    for part, n in (("<div>", 100_000), ("<p><div><li>", 30_000), ("<a href='", 100_000), ('<td x="1">', 50_000), ("</b></div>", 100_000)):
        began = time.perf_counter()
        dom.parse(part * n)
        assert time.perf_counter() - began < 20, part
    deep = "<div>" * 100_000 + "<article><p>The text, which is far down, has a few words. It goes on for a while, so that it is kept.</p></article>"
    assert len(html_extract.extract([deep], trees)) == 1


def test_only_code_graphics_and_notices_are_raw(trees):
    page = "<article><h1>A title of some words</h1><p>Before, <math><mi>x</mi></math> and <object>a thing</object>, <audio>a sound</audio>, <video>a film</video>.</p>{}<p>After that, a last sentence of the text.</p></article>"
    raw = "<script>if (a < b) {}</script><style>p {}</style><svg><text>drawn</text></svg><template><p>no</p></template><noscript><p>Switch it on.</p></noscript>"
    assert html_extract.extract([page.format(raw)], trees) == ["A title of some words\nBefore, x and a thing, a sound, a film.\nAfter that, a last sentence of the text."]


def test_quotes_and_cut_off_tags():
    leaves = lambda page: [(n.parent.tag, n.text) for n in dom.preorder(dom.parse(page)) if n.tag == "#text"]
    assert leaves('<p class="a>b">one</p><p title=\'x>"\'>two') == [("p", "one"), ("p", "two")]
    assert leaves('<p class="a>one</p>') == [("p", "one")]  # a quote that never closes
    assert leaves("<p it's>one</p><p>two's</p>") == [("p", "one"), ("p", "two's")]
    assert leaves('<p>one</p><div class="a') == [("p", "one")]


def test_decoding_equals_the_best_of_all_labellings():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(1, 9)
        nodes = [dom.Node("div", None)]
        for _ in range(n - 1):
            nodes.append(dom.Node("div", rng.choice(nodes)))
        order = dom.preorder(nodes[0])
        scores = np.array([rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) + rng.random() for _ in order])
        up = [order.index(x.parent) if x.parent is not None else None for x in order]
        best = max((sum(s for s, k in zip(scores, labels, strict=True) if k), labels) for labels in itertools.product([False, True], repeat=n) if all(up[i] is None or not k or labels[up[i]] for i, k in enumerate(labels)))
        assert tuple(html_extract.decode(order, scores)) == best[1]


def test_a_boosted_stump_is_the_best_split():
    rng = np.random.default_rng(4)
    for _ in range(10):
        x = rng.integers(0, 8, (60, 3)).astype(float)
        y = (x[:, 1] + rng.normal(0, 1.5, 60) > 3).astype(float)
        found = boosting.fit(x, y, trees=1, depth=1, rate=1.0, l2=1.0, least=2.0)
        p = y.mean()
        g, h = y - p, np.full(60, p * (1 - p))
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)  # noqa: E731,B023
        best = max(gain(x[:, f] <= c) for f in range(3) for c in range(8) if h[x[:, f] <= c].sum() >= 2 and h[x[:, f] > c].sum() >= 2)
        mine = x[:, found.feature[0, 0]] <= found.threshold[0, 0]
        assert gain(mine) == pytest.approx(best)
        assert found.scores(x)[mine] == pytest.approx(found.base + g[mine].sum() / (h[mine].sum() + 1))
    loss = lambda m: float(np.log1p(np.exp(-(2 * y - 1) * m.scores(x))).mean())
    assert loss(boosting.fit(x, y, trees=30, depth=3)) < loss(boosting.fit(x, y, trees=1, depth=1)) < float(np.log(2))


def test_repeated_rows_stay(spark, trees):
    page = "<article><h1>Some title</h1><p>A sentence, as long as it needs to be.</p></article>"
    got = html_extract.main_text(spark.createDataFrame([(1, "u", page)] * 3 + [(1, "u", None)], "page_id long, url string, html string"), trees=trees).collect()
    assert sorted(r["n_chars"] for r in got) == [0] + [got[0]["n_chars"] or got[1]["n_chars"]] * 3
