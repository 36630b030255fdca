"""Main text of web pages by gradient-boosted trees over the nodes of the page.

Each block element gets figures of its subtree (text, link and tag densities), depth, siblings and
place, and bits for its tag and for its attribute tokens, its own and inherited. The trees rate
every node; a decoding over the page then picks the best choice in which no node inside a part that
was cut out comes back.

Pages carry no labels. The trees learn from a bounded sample: pages that name their parts by
elements (article, nav, footer, ...) label themselves, and each is written anew in layouts that
name the same parts by classes and ids instead, with menus, notices, adverts, forms, sidebars and
comments put in whose text is the page's own.
"""

from __future__ import annotations

import html
import pickle
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lekha.llm.boosting import Boosted
from lekha.llm.page_tree import FEATURES, Tree, decode
from lekha.llm.shared import bounded_batches
from lekha.llm.text import slices, worker_cache

#: Pages that the trees learn from, at most; chosen by a hash of their markup.
SAMPLE = 160
#: Longer pages (in characters) do not teach.
LONGEST = 200_000
_CONTENT = frozenset("article main".split())
_REST = frozenset("nav header footer aside form dialog search menu".split())
#: What pages call the main text and the parts around it.
_MAIN_NAMES = "content article post entry story main-content article-body post-content entry-content story-body main-text body-text text page-content blog-post".split()
_OTHER_NAMES = {
    "menu": "nav menu navbar navigation main-menu site-nav breadcrumb breadcrumbs topbar tabs pagination pager toc".split(),
    "header": "header site-header masthead banner top-header page-header branding logo".split(),
    "footer": "footer site-footer bottom colophon page-footer copyright legal credits".split(),
    "side": "sidebar side aside widget related related-posts recommended rail secondary trending tags".split(),
    "notice": "notice cookie cookie-banner consent alert message gdpr privacy popup modal overlay newsletter".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion ad-slot banner-ad commercial".split(),
    "form": "form search search-form subscribe signup login contact-form newsletter-form".split(),
    "comment": "comments comment comment-list reader-comments responses discussion replies disqus thread".split(),
    "share": "share social social-links sharing follow author-box byline meta".split(),
}


def weak_labels(tree: Tree) -> np.ndarray | None:
    """1 for nodes in an article (or main) element and in none of the parts around it; None without one."""
    n = len(tree.tag)
    inside, cut = np.zeros(n, bool), np.zeros(n, bool)
    rest = {w for names in _OTHER_NAMES.values() for x in names for w in (x,)}
    for i in range(n):
        p = tree.parent[i]
        if p >= 0:
            inside[i], cut[i] = inside[p], cut[p]
        inside[i] |= tree.tag[i] in _CONTENT
        cut[i] |= tree.tag[i] in _REST or tree.tag[i] == "div" and any(x in rest for x in tree.names(i)) and not any(x in _MAIN_NAMES for x in tree.names(i))
    return (inside & ~cut).astype(float) if inside.any() else None


def rewritten(blocks: list[str], rng: random.Random) -> str:
    """The same paragraphs in a layout of another kind; data-m marks the main part."""
    words = " ".join(blocks).split() or ["x"]

    def some(low: int, high: int) -> str:
        k = rng.randrange(len(words))
        return html.escape(" ".join(words[k : k + rng.randint(low, high)]) or words[0])

    def named(kind: str) -> str:
        name = rng.choice(_OTHER_NAMES[kind])
        return f'{rng.choice(("class", "class", "id"))}="{name}{rng.choice(("", "", "-1", " clearfix"))}"'

    def part(kind: str) -> str:
        element = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind)
        open_, close = (f"<{element}>", f"</{element}>") if element and rng.random() < 0.4 else (f"<{'section' if rng.random() < 0.2 else 'div'} {named(kind)}>", "</div>")
        if open_.startswith("<section"):
            close = "</section>"
        if kind in ("menu", "share"):
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{some(1, 2)}</a></li>' for i in range(rng.randint(2, 9))) + "</ul>"
        elif kind == "side":
            inner = f"<h3>{some(1, 4)}</h3>" + "".join(rng.choice((f'<p><a href="/r">{some(3, 9)}</a></p>', f"<p>{some(6, 30)}</p>", f'<li><a href="#">{some(2, 6)}</a></li>')) for _ in range(rng.randint(1, 6)))
        elif kind == "comment":
            inner = (f"<h3>{some(1, 3)}</h3>" if rng.random() < 0.6 else "") + "".join(f"<div {rng.choice(('', named('comment')))}><b>{some(1, 1)}</b><p>{some(4, 60)}</p></div>" for _ in range(rng.randint(1, 7)))
        elif kind == "form":
            inner = f'<label>{some(1, 3)}</label><input name="q"><p>{some(2, 12)}</p>'
        elif kind == "header":
            inner = rng.choice((f"<h1>{some(1, 4)}</h1>", f"<p>{some(2, 8)}</p>", f'<a href="/">{some(1, 2)}</a>'))
        else:
            inner = rng.choice((some(3, 25), f"<p>{some(3, 40)}</p>", f'<p>{some(2, 9)} <a href="#">{some(1, 3)}</a></p>'))
        return open_ + inner + close

    body = []
    for i, b in enumerate(blocks):
        safe = html.escape(b)
        tag = "h1" if i == 0 and rng.random() < 0.7 else rng.choice(("p",) * 12 + ("h2", "li", "blockquote"))
        body.append(f"<ul><li>{safe}</li></ul>" if tag == "li" else f"<{tag}>{safe}</{tag}>")
        if rng.random() < 0.06:
            body.append(part(rng.choice(("ad", "ad", "share", "notice", "side"))))
    if rng.random() < 0.25:
        body.append(part(rng.choice(("comment", "share", "form"))))
    if rng.random() < 0.4:
        body.insert(0, part("share"))
    kind = rng.random()
    open_, close = ("<article data-m>", "</article>") if kind < 0.25 else ("<main data-m>", "</main>") if kind < 0.35 else (f'<div {rng.choice(("class", "class", "id"))}="{rng.choice(_MAIN_NAMES)}" data-m>', "</div>") if kind < 0.92 else ("<div data-m>", "</div>")
    before = [part(k) for k in ("notice", "header", "menu", "ad", "form", "side") if rng.random() < 0.55]
    after = [part(k) for k in ("comment", "side", "share", "ad", "form", "menu", "notice", "footer") if rng.random() < 0.5]
    rng.shuffle(before)
    middle = open_ + "".join(body) + close
    if rng.random() < 0.4:
        middle = f"<div class=\"{rng.choice(('container', 'wrapper', 'row', 'page', 'site', 'layout'))}\">" + middle + (after.pop(0) if after and rng.random() < 0.6 else "") + "</div>"
    return "<html><body>" + "".join(before) + middle + "".join(after) + "</body></html>"


def _marked(tree: Tree) -> np.ndarray:
    """Labels of a page written by `rewritten`: in the marked part, and in none of the named ones there."""
    n, names = len(tree.tag), {x for v in _OTHER_NAMES.values() for x in v}
    out = np.zeros(n)
    for i in range(1, n):
        inside = out[tree.parent[i]] or "data-m" in tree.attributes[i]
        parts = tree.attributes[i].replace('"', " ").replace("-1", "").split()
        other = tree.tag[i] in _REST or "data-m" not in tree.attributes[i] and any(x in names or x.split("=")[-1] in names for x in parts)
        out[i] = bool(inside and not other)
    return out


def learn(pages: list[str], copies: int = 3, seed: int = 5) -> Boosted | None:
    """Trees from pages that label themselves and from rewritten ones; None without any."""
    rng, xs, ys = random.Random(seed), [], []

    def add(page: str, label) -> np.ndarray | None:
        tree = Tree(page)
        y = label(tree)
        if y is not None:
            xs.append(tree.features())
            ys.append(y)
        return y

    for page in pages:
        tree = Tree(page)
        y = weak_labels(tree)
        blocks = tree.text(y if y is not None else np.ones(len(tree.tag))).split("\n\n")
        if y is not None:
            xs.append(tree.features())
            ys.append(y)
        for _ in range(copies):
            add(rewritten(blocks, rng), _marked)
    if not xs:
        return None
    x, y = np.concatenate(xs), np.concatenate(ys)
    return Boosted.fit(x, y, np.ones(len(y)))


def extract(model: Boosted | None, pages: list[str]) -> list[str]:
    trees = [Tree(p) for p in pages]
    if model is None or not trees:
        return [""] * len(pages)
    parts = [t.features() for t in trees]
    odds = model.log_odds(np.concatenate(parts) if parts else np.zeros((0, FEATURES)))
    edge = np.cumsum([0, *map(len, parts)])
    return [t.text(decode(t.parent, odds[a:b])) for t, a, b in zip(trees, edge[:-1], edge[1:])]


def train(pages: DataFrame, sample: int = SAMPLE, longest: int = LONGEST, html_col: str = "html") -> Boosted | None:
    """Trees from at most `sample` different pages of at most `longest` characters each; None where no page has any.

    Ids play no part, so null and repeated ones teach as well; a page that stands in many rows counts once.
    """
    some = pages.select(F.col(html_col).alias("html")).where((F.length("html") > 0) & (F.length("html") <= longest)).withColumn("key", F.xxhash64("html", F.lit(5)))
    keys = some.select("key").distinct().orderBy("key").limit(sample)
    rows = some.join(F.broadcast(keys), "key").dropDuplicates(["key"]).repartition(1)  # `sample` short rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((i, h) for b in batches for i, h in zip(b.column("key").to_pylist(), b.column("html").to_pylist()))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn([h for _, h in got]))], pa.binary())], ["model"])

    got = rows.select("key", "html").mapInArrow(of, "model binary").collect()
    return pickle.loads(got[0].model) if got else None


def main_text(pages: DataFrame, model: Boosted | None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    White space inside a block becomes one space, blocks are joined by an empty line. Null and empty
    pages, and pages without main text, have the empty text; every row gives one, repeated and null
    ids too. Without a model all texts are empty.
    """
    bounded_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("main_text")
        for b in slices(batches, "html", 1 << 20):
            text = extract(sent.value, [x or "" for x in b.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")
