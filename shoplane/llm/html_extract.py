"""Main text of web pages: parse to leaf blocks, label every block with a
bidirectional LSTM, join the blocks labelled main text.

There are no hand labels, so the labeller learns from pages that say what their
parts are: blocks inside ``article`` or ``main`` and outside menus, asides,
forms, footers and the like are main text. Training copies vary that markup
(containers renamed, boilerplate of many kinds put in, made of the pages' own
words) so that the network reads tag paths, words and the page's course
together and not one tag.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplane.llm import bilstm
from shoplane.llm.common import bounded_sample
from shoplane.llm.html_blocks import Path, blocks, inherited, leaf_blocks

#: Path words that mark a block as main text, unless one of the others is in its path.
MAIN_WORDS = frozenset("article main .article .content .post .story .entry".split())
BOILERPLATE_WORDS = frozenset("""nav header footer aside form menu button .nav .menu .navbar .header .footer .sidebar .aside .ad .ads
.advert .advertisement .banner .sponsor .promo .cookie .cookies .consent .notice .alert .comment .comments .reply .replies .form
.search .login .signup .newsletter .subscribe .share .social .related .breadcrumb .breadcrumbs .copyright .popup .modal .widget
.toolbar .pagination .skip""".split())
#: Boilerplate put into training pages: (path words, most words in it).
NOISE = tuple((tuple(p.split()), n) for p, n in (
    ("nav ul li a", 3), ("div .menu a", 3), ("header div", 8), ("header h1 a", 4), ("aside p", 25), ("aside ul li a", 5), ("div .sidebar p", 25),
    ("div .ad", 15), ("div .advertisement p", 20), ("div .banner", 10), ("div .sponsor a", 8), ("div .promo p", 15), ("div .cookie p", 25),
    ("div .cookie .banner p", 25), ("div .notice", 20), ("div .consent p", 20), ("div .alert", 15), ("form label", 4), ("form p", 8), ("form button", 2),
    ("div .newsletter form p", 12), ("div .search form", 3), ("section .comments div .comment p", 30), ("div .comments ul li p", 30), ("section .comments h2", 3),
    ("ol .comment li p", 30), ("div .comments article .comment p", 30), ("div .related ul li a", 8), ("div .share a", 2), ("div .social ul li a", 2),
    ("footer", 12), ("footer p", 15), ("footer ul li a", 4), ("div .footer p", 15), ("div .copyright", 8), ("div .breadcrumb a", 3), ("div .login form p", 6),
    ("div .popup p", 15), ("div .widget p", 15), ("div .pagination a", 2), ("div .subscribe p", 12)))
_RENAMED = (("article",), ("main",), ("div", ".content"), ("div", ".post"), ("div", ".article"), ("main", "article"), ("section",), ("div",))


def teacher_label(path) -> int:
    inside = [k for k, w in enumerate(path) if w in MAIN_WORDS]
    return int(bool(inside) and not any(w in BOILERPLATE_WORDS for w in path))


def markup_labels(paths: list[Path]) -> list[bool]:
    """``teacher_label`` of each path."""
    def below(value, words):
        return value[0] or any(w in MAIN_WORDS for w in words), value[1] or any(w in BOILERPLATE_WORDS for w in words)
    return [main and not other for main, other in inherited(paths, (False, False), below)]


def varied(page, rng: random.Random, words: list[str]):
    """(blocks, labels) of a training copy of a page."""
    labelled = [(p, t, teacher_label(p)) for p, t in page]
    name = rng.choice(_RENAMED) if rng.random() < 0.5 else None
    out = []
    for p, t, y in labelled:
        if name and y:
            at = next(k for k, w in enumerate(p) if w in MAIN_WORDS)
            p = (*p[:at], *name, *(w for w in p[at + 1:] if w not in MAIN_WORDS))
        out.append((p, t, y))
    for _ in range(rng.randrange(6)):
        path, most = rng.choice(NOISE)
        made = [((("html", "body", *path)), " ".join(rng.choice(words) for _ in range(1 + rng.randrange(most))), 0) for _ in range(1 + rng.randrange(3))]
        inside = [k for k, b in enumerate(out) if b[2]]
        if inside and rng.random() < 0.4:  # in the middle of the article
            host = out[rng.choice(inside)][0]
            at = next((k + 1 for k, w in enumerate(host) if w in MAIN_WORDS), 2)
            k = rng.choice(inside)
            out[k:k] = [((*host[:at], *path), t, 0) for _, t, _ in made]
        else:
            k = rng.choice([0, len(out), rng.randrange(len(out) + 1)])
            if 0 < k < len(out) and out[k - 1][2] and out[k][2]:
                k = rng.choice([0, len(out)])
            out[k:k] = made
    return [(p, t) for p, t, _ in out], [y for _, _, y in out]


def _marked(html: str) -> bool:
    return any(markup_labels([p for p, _ in leaf_blocks(html)]))


def _sample(pages: DataFrame, fit_pages: int, fit_bytes: int, html_col: str, id_col: str) -> list:
    """(id, blocks) of at most ``fit_pages`` distinct pages and ``fit_bytes`` of html, lowest id hash first."""
    rows = bounded_sample(pages.select(F.col(id_col).alias("p_id"), F.col(html_col).alias("h")), "p_id", "h", fit_pages, fit_bytes)

    def run(batches):
        for batch in batches:
            pages_ = [blocks(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array([[" ".join(p) for p, _ in b] for b in pages_], pa.list_(pa.string())),
                 pa.array([[t for _, t in b] for b in pages_], pa.list_(pa.string()))],
                names=["p", "paths", "texts"])

    got = rows.select("p_id", "h").mapInArrow(run, "p string, paths array<string>, texts array<string>").collect()
    return sorted(((r.p, [(tuple(p.split()), t) for p, t in zip(r.paths, r.texts)]) for r in got), key=str)


def train_labeller(pages: DataFrame, fit_pages: int, rounds: int, seed: int, html_col: str = "html", id_col: str = "page_id", fit_bytes: int = 64 << 20):
    """The network, trained on at most ``fit_pages`` distinct pages and ``fit_bytes`` of those that say what
    their parts are (lowest id hash first); None if the table has no such page.

    The first draw is from all pages. Only if it meets a page without such marks is
    the table read for the marked ones and the sample drawn from them."""
    given = pages.where(F.col(html_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, html_col)
    got = _sample(given, fit_pages, fit_bytes, html_col, id_col)
    known = [page for _, page in got if any(teacher_label(p) for p, _ in page)]
    if len(known) < len(got) and len(got) >= fit_pages:
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array([_marked(h) for h in batch.column(1).to_pylist()], pa.bool_()))

        got = _sample(given.mapInArrow(run, given.schema), fit_pages, fit_bytes, html_col, id_col)
        known = [page for _, page in got if any(teacher_label(p) for p, _ in page)]
    net = bilstm.BiLstm(seed)
    if not known:
        return None
    words = sorted({w for page in known for _, t in page for w in t.split()})

    def batches(r):
        rng = random.Random(seed * 1000 + r)
        copies = [varied(page, rng, words) for page in known]
        rng.shuffle(copies)
        for lo in range(0, len(copies), 24):
            part = copies[lo:lo + 24]
            yield [bilstm.inputs(b) for b, _ in part], [y for _, y in part]

    net.train(batches, rounds)
    return net


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fit_pages: int = 300,
                 rounds: int = 12, seed: int = 7, group_blocks: int = 2000) -> DataFrame:
    """(id, url, text, n_chars, n_blocks) for every row of ``pages``.

    Null and empty pages, and pages without main text, give the empty text.
    Repeated rows each get a row; extra columns are ignored. If no page with an id
    says what its parts are, nothing can be learned: the markup rule decides alone
    and gives the empty text to every page without such marks."""
    net = train_labeller(pages, fit_pages, rounds, seed, html_col, id_col)

    def run(batches):
        for batch in batches:
            parsed = [leaf_blocks(h or "") for h in batch.column(2).to_pylist()]
            texts = [""] * len(parsed)
            group: list[int] = []
            held = 0

            def label():
                group.sort(key=lambda i: len(parsed[i]))
                if net is None:
                    marks = [markup_labels([p for p, _ in parsed[i]]) for i in group]
                else:
                    marks = [q > 0.5 for q in net.predict_paths([parsed[i] for i in group])]
                for i, mark in zip(group, marks):
                    texts[i] = " ".join(t for (_, t), y in zip(parsed[i], mark) if y)

            for i, page in enumerate(parsed):
                if page:
                    group.append(i)
                    held += len(page)
                if group and held >= group_blocks:
                    label()
                    group, held = [], 0
            if group:
                label()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([len(p) for p in parsed], pa.int64())], names=[id_col, url_col, "text", "n_chars", "n_blocks"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])
    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
