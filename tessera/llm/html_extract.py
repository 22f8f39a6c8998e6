"""Main text of web pages: boosted trees over DOM nodes, then hierarchical decoding.

Every block element and every run of inline text is a node. Trees give each node the
log-odds that it holds main text, from its tag and attribute tokens, those of its
ancestors, subtree density, links, depth and siblings. Decoding picks the labelling of
greatest likelihood among those in which a node that holds main text has only ancestors
that do too, so no kept block stands in a dropped branch.

The trees are trained here, on pages made by ``training_page``: articles of many layouts
amid menus, headers, footers, sidebars, notices, adverts, forms and reader comments,
whose labels are known. Vocabulary is random, so only structure is learnt.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import boosting, dom

TRAINING_PAGES = 500
#: Nodes scored at once.
SCORED = 50_000

#: Attribute tokens by what they announce.
WORDS = {
    "main": "article content entry post story main text body page document".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs".split(),
    "head": "header masthead banner topbar logo brand branding hero".split(),
    "foot": "footer foot bottom copyright legal colophon".split(),
    "side": "sidebar aside side rail widget related recommended recommendations popular trending more".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted".split(),
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast warning subscribe newsletter paywall".split(),
    "comment": "comment comments reply replies disqus discussion respond reader".split(),
    "form": "form search login signup register input share sharing social tools toolbar button buttons".split(),
}
_GROUP = {word: k for k, words in enumerate(WORDS.values()) for word in words}
_TAGS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset label button select option textarea legend dialog", "table caption thead tbody tfoot tr td th", "figure figcaption", "blockquote pre", "html body #root", "head")
_TAG = {tag: k for k, tags in enumerate(_TAGS) for tag in tags.split()}
_N_TAGS, _N_GROUPS = len(_TAGS) + 1, len(WORDS)
_BAD_TAGS = {_TAG[t] for t in ("nav", "header", "footer", "aside", "form", "head")}
WIDTH = 1 + _N_TAGS + 2 * _N_GROUPS + 2 + 19


def features(order: list[dom.Node]) -> np.ndarray:
    """One row per node of ``order`` (parents before children)."""
    n = len(order)
    x = np.zeros((n, WIDTH))
    place = {id(node): i for i, node in enumerate(order)}
    parent = np.array([place[id(node.parent)] if node.parent is not None else -1 for node in order])
    leaf = np.array([node.tag == "#text" for node in order])
    tag = np.array([_TAG.get(node.tag, _N_TAGS - 1) for node in order])
    tag[leaf] = tag[parent[leaf]] if n else 0
    chars = np.array([node.chars for node in order], float)
    links = np.array([node.link_chars for node in order], float)
    before = np.cumsum(chars) - chars
    words = np.array([node.text.count(" ") + 1 if node.chars else 0 for node in order], float)
    stops = np.array([node.text.count(".") + node.text.count(",") for node in order], float)
    nodes, paragraphs, leaves = np.ones(n), (tag == _TAG["p"]).astype(float) * ~leaf, leaf.astype(float)
    sums = np.stack([chars, links, words, stops, nodes, paragraphs, leaves], 1)
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    groups = np.zeros((n, _N_GROUPS))
    for i, node in enumerate(order):
        for token in node.tokens:
            k = _GROUP.get(token)
            if k is not None:
                groups[i, k] += 1
    above = np.zeros((n, _N_GROUPS + 2))
    depth = np.zeros(n)
    for i in range(1, n):
        p = parent[i]
        above[i] = above[p]
        above[i, :_N_GROUPS] += groups[p]
        above[i, _N_GROUPS] += tag[p] == 0
        above[i, _N_GROUPS + 1] += tag[p] in _BAD_TAGS
        depth[i] = depth[p] + 1
    siblings, index, left, right, alike = (np.zeros(n) for _ in range(5))
    for node in order:
        kids = [place[id(c)] for c in node.children]
        if kids:
            count = len(kids)
            siblings[kids] = count
            index[kids] = np.arange(count) / count
            size = sums[kids, 0]
            left[kids[1:]] = size[:-1]
            right[kids[:-1]] = size[1:]
            kinds = tag[kids]
            alike[kids] = np.bincount(kinds, minlength=_N_TAGS)[kinds]
    total = max(sums[0, 0], 1.0) if n else 1.0
    size = sums[:, 0]
    up = np.maximum(parent, 0)
    x[:, 0] = leaf
    x[np.arange(n), 1 + tag] = 1
    a = 1 + _N_TAGS
    x[:, a : a + _N_GROUPS] = groups
    x[:, a + _N_GROUPS : a + 2 * _N_GROUPS + 2] = above
    b = a + 2 * _N_GROUPS + 2
    per = np.maximum(size, 1.0)
    x[:, b:] = np.stack(
        [
            depth, siblings, index, alike, np.log1p(size), sums[:, 1] / per, sums[:, 4] / per, size / total, np.log1p(sums[:, 5]), size / np.maximum(sums[:, 6], 1), sums[:, 3] / np.maximum(sums[:, 2], 1),
            np.log1p(left), np.log1p(right), before / total, np.log1p(sums[up, 0]), sums[up, 1] / per[up], size / np.maximum(sums[up, 0], 1), np.log1p(sums[up, 5]), tag[up],
        ],
        1,
    )
    return x


def decode(order: list[dom.Node], scores: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which every ancestor of a kept node is kept."""
    place = {id(node): i for i, node in enumerate(order)}
    keep, drop = scores.copy(), np.zeros(len(order))  # best of a node's subtree, relative to dropping all
    for i in range(len(order) - 1, 0, -1):
        keep[place[id(order[i].parent)]] += max(keep[i], drop[i])
    label = np.zeros(len(order), bool)
    label[:1] = keep[:1] > drop[:1]
    for i in range(1, len(order)):
        label[i] = label[place[id(order[i].parent)]] and keep[i] > drop[i]
    return label


def _words(rng: random.Random, low: int, high: int) -> str:
    return " ".join("".join(rng.choice("abcdefghilmnoprstuvz") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 3, 18).capitalize() + rng.choice(["." * 1, ".", ".", "!", "?"]) for _ in range(rng.randint(low, high)))


def training_page(seed: int) -> str:
    """A page whose elements tell in ``data-k`` whether their text is main text (1) or not (0)."""
    rng = random.Random(seed)
    semantic = rng.random() < 0.6

    def named(tag: str, group: str, inner: str, keep: int | None = 0) -> str:
        words = WORDS[group]
        attribute = ""
        if not semantic or tag == "div" or rng.random() < 0.3:
            attribute = f' {rng.choice(["class", "class", "id"])}="{rng.choice(words)}{rng.choice(["", "-" + rng.choice(["box", "wrap", "x1", "inner", "list"]), " " + rng.choice(["clearfix", "col", "wide"])])}"'
        mark = "" if keep is None else f' data-k="{keep}"'
        name = tag if semantic or rng.random() < 0.3 else "div"
        return f"<{name}{attribute}{mark}>{inner}</{name}>"

    def link_list(low: int, high: int) -> str:
        kind = rng.choice(["ul", "ul", "ol"])
        return f"<{kind}>" + "".join(f'<li><a href="/{k}">{_words(rng, 1, 4)}</a></li>' for k in range(rng.randint(low, high))) + f"</{kind}>"

    def paragraph() -> str:
        text = _sentences(rng, 1, 6) if rng.random() < 0.8 else _words(rng, 1, 6) + "."
        if rng.random() < 0.25:
            text = f"<b>{text}" + ("</b>" if rng.random() < 0.5 else "<br>")
        if rng.random() < 0.2:
            text += f' <a href="/x">{_words(rng, 1, 4)}</a> {_words(rng, 2, 8)}.'
        return f"<p>{text}" + ("</p>" if rng.random() < 0.85 else "")

    def advert() -> str:
        return named(rng.choice(["div", "div", "aside"]), "advert", rng.choice([_sentences(rng, 1, 2), f"<p>{_words(rng, 3, 10)}</p>", f'<a href="/b">{_words(rng, 2, 6)}</a>']))

    def article() -> str:
        parts = [f"<h1>{_words(rng, 2, 14)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.76:
                parts.append(paragraph())
            elif kind < 0.82:
                parts.append(f"<h{rng.randint(2, 4)}>{_words(rng, 1, 8)}</h2>")
            elif kind < 0.87:
                parts.append("<ul>" + "".join(f"<li>{_words(rng, 3, 14)}.</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.90:
                parts.append(f"<blockquote><p>{_sentences(rng, 1, 3)}</p></blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{_words(rng, 1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(2, 4))) + "</table>")
            elif kind < 0.94:
                parts.append(f"<pre>{_words(rng, 3, 20)}</pre>")
            elif kind < 0.97:
                parts.append(advert())
            else:
                parts.append(named("div", rng.choice(["form", "side", "notice"]), link_list(2, 4) if rng.random() < 0.6 else f"<p>{_words(rng, 3, 9)}</p>"))
        inner = "".join(parts)
        if rng.random() < 0.65:
            return f'<article data-k="1">{inner}</article>'
        return named(rng.choice(["main", "section", "div"]), "main", inner, 1)

    def comments() -> str:
        each = [f"<li><p>{_words(rng, 1, 2)}</p><p>{_sentences(rng, 1, 4)}</p></li>" for _ in range(rng.randint(1, 6))]
        return named("section", "comment", f"<h3>{_words(rng, 1, 3)}</h3><ol>{''.join(each)}</ol>" if rng.random() < 0.6 else "".join(f"<div><p>{_sentences(rng, 1, 4)}</p></div>" for _ in each)).replace("<section ", '<section class="comments" ', 1)

    def form() -> str:
        return f'<form data-k="0"><label>{_words(rng, 1, 2)}</label><input name="q"><button>{_words(rng, 1, 2)}</button></form>'

    top, bottom = [], []
    for chance, where, part in (
        (0.6, top, lambda: named("header", "head", rng.choice([f"<h1>{_words(rng, 1, 4)}</h1>", f"<p>{_words(rng, 2, 8)}</p>", f'<a href="/">{_words(rng, 1, 3)}</a>']) + (link_list(2, 6) if rng.random() < 0.3 else ""))),
        (0.85, top, lambda: named("nav", "menu", link_list(3, 9))),
        (0.3, top, lambda: named("div", "notice", f"<p>{_sentences(rng, 1, 2)}</p>" + (f"<button>{_words(rng, 1, 2)}</button>" if rng.random() < 0.5 else ""))),
        (0.5, top, advert),
        (0.2, top, form),
        (0.35, top if rng.random() < 0.4 else bottom, lambda: named("aside", "side", f"<h3>{_words(rng, 1, 3)}</h3>" + (link_list(2, 7) if rng.random() < 0.6 else f"<p>{_sentences(rng, 1, 3)}</p>"))),
        (0.35, bottom, comments),
        (0.25, bottom, advert),
        (0.2, bottom, form),
        (0.15, bottom, lambda: named("div", "notice", f"<p>{_sentences(rng, 1, 2)}</p>")),
        (0.85, bottom, lambda: named("footer", "foot", rng.choice([f"&copy; {_words(rng, 1, 3)} &middot; {_sentences(rng, 1, 2)}", f"<p>{_words(rng, 2, 8)}</p>", link_list(2, 5)]))),
    ):
        if rng.random() < chance:
            where.append(part())
    if rng.random() < 0.3:
        rng.shuffle(top)
    body = "".join(top) + article() + "".join(bottom)
    for _ in range(rng.choice([0, 0, 1, 2])):
        body = f'<div{rng.choice(["", "", " id=wrap", " class=container", " class=page"])}>{body}</div>'
    page = f"<!DOCTYPE html><html><head><title>{_words(rng, 2, 9)}</title><style>p{{}}</style></head><body>{body}</body></html>"
    return page[: rng.randint(len(page) * 2 // 3, len(page))] if rng.random() < 0.15 else page


def _labels(order: list[dom.Node]) -> np.ndarray:
    place = {id(node): i for i, node in enumerate(order)}
    own = np.zeros(len(order), bool)
    label = np.zeros(len(order))
    for i, node in enumerate(order):
        if node.mark is not None:
            own[i] = node.mark == "1"
        elif node.parent is not None:
            own[i] = own[place[id(node.parent)]]
        label[i] = own[i] and node.tag == "#text"
    for i in range(len(order) - 1, 0, -1):
        up = place[id(order[i].parent)]
        label[up] = max(label[up], label[i])
    return label


def train(pages: int = TRAINING_PAGES, first_seed: int = 0) -> boosting.Trees:
    orders = [dom.preorder(dom.parse(training_page(first_seed + k))) for k in range(pages)]
    return boosting.fit(np.concatenate([features(o) for o in orders]), np.concatenate([_labels(o) for o in orders]))


def extract(sources: list[str | None], trees: boosting.Trees) -> list[str]:
    """Main text of each page: its kept blocks in page order, one line each; empty if none."""
    texts: list[str] = []
    at = 0
    while at < len(sources):
        orders, matrices, held = [], [], 0
        while at < len(sources) and (not orders or held < SCORED):
            order = dom.preorder(dom.parse(sources[at] or ""))
            orders.append(order)
            matrices.append(features(order))
            held += len(order)
            at += 1
        scores = trees.scores(np.concatenate(matrices))
        start = 0
        for order in orders:
            kept = decode(order, scores[start : start + len(order)])
            texts.append("\n".join(node.text for node, k in zip(order, kept, strict=True) if k and node.tag == "#text"))
            start += len(order)
    return texts


_trained: list[boosting.Trees] = []


def model() -> boosting.Trees:
    """Trained once per process; the same pages and so the same trees each time."""
    if not _trained:
        _trained.append(train())
    return _trained[0]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: boosting.Trees | None = None) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    Defined cases: null or empty html, and pages without main text, give an empty text;
    broken or cut-off markup is read as far as it goes; repeated rows and null ids are
    kept; an empty table gives an empty result; other columns are ignored. Nothing is
    shuffled; a page is read whole.
    """
    spark: SparkSession = pages.sparkSession
    shared = spark.sparkContext.broadcast(trees or model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = extract(part.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
