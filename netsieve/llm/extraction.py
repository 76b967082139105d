"""Main text of HTML pages: a linear-chain CRF over leaf blocks.

A page becomes its sequence of leaf blocks (``html_blocks``). Each block is
described by the tags, classes, ids and roles around it and by its text (length,
share of link text, closing punctuation, signs of notices). The chain labels the
blocks article or boilerplate together; the article's blocks are the main text.

It is trained on at most ``SAMPLE_PAGES`` labelled pages: pages whose article is
known as plain text, where a block is article if it is a line of that text, or its
beginning (a heading). To know markup that these pages happen not to have, each is
also set again with its own lines in other containers and with lines of other
pages as menus, headers, sidebars, notices, adverts, forms, comments and footers.

Defined results: NULL or empty html, and pages without article blocks, give an
empty text; tags cut off by the page's end are dropped; one row per row of
``pages``, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import random
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import read, task, with_workers
from netsieve.llm.crf import Chain
from netsieve.llm.html_blocks import Block, blocks

SAMPLE_PAGES = 240
SAMPLE_CHARS = 60_000  # longer pages are not trained on
VARIANTS = 4  # settings of each labelled page's lines
SEED_LINES = ["A first sentence that stands for the text of an article, long enough to be one.",
              "A second paragraph follows it. It has two sentences.", "Short one.", "A heading without a stop"]

# names that pages give to what is not their article, by kind
_BOILERPLATE = {
    "nav": ["nav", "menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toc", "pagination"],
    "header": ["header", "masthead", "banner", "topbar", "logo"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "complementary", "popular", "tags"],
    "notice": ["cookie", "notice", "consent", "gdpr", "popup", "modal", "alert", "disclaimer", "newsletter", "subscribe", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion"],
    "form": ["form", "search", "login", "signup", "contact"],
    "comments": ["comment", "comments", "discussion", "replies", "reply", "disqus", "respond", "feedback"],
    "footer": ["footer", "copyright", "contentinfo", "legal", "share", "social"],
}
_ARTICLE = ["article", "content", "post", "entry", "main", "story", "body", "text"]


def features(b: Block) -> list[str]:
    n = len(b.text)
    last = b.text[-1]
    out = [*b.around, f"p:{b.tag}", f"n:{min(n.bit_length(), 10)}", f"l:{int(b.linked * 4)}",
           "e:stop" if last in ".!?:;\"'»”)" else "e:open"]
    if b.text[0] in "©®":
        out.append("s:copyright")
    return out


def _names(rng: random.Random, words: list[str]) -> str:
    word = rng.choice(words)
    tail = rng.choice(["", "", "", "-box", " block", "_area", "-list", " widget-1"])
    return rng.choice([f' class="{word}{tail}"', f' id="{word}{tail}"', f" class='{word}'", f' role="{word}"' if not tail else f' class="{word}{tail}"'])


def _boilerplate(rng: random.Random, kind: str, lines: list[str]) -> str:
    words = _BOILERPLATE[kind]
    some = [escape(rng.choice(lines)) for _ in range(rng.randint(1, 4))]
    short = [" ".join(s.split()[:rng.randint(1, 4)]) for s in some]
    if kind == "nav" or rng.random() < 0.2:
        inner = "<ul>" + "".join(f'<li><a href="/{i}">{s}</a></li>' for i, s in enumerate(short)) + "</ul>"
    elif kind == "form":
        inner = f'<label>{short[0]}</label><input name="q"><textarea>{short[-1]}</textarea><select><option>{short[0]}<option>{short[-1]}</select><button>{short[-1]}</button>'
    elif kind == "comments":
        inner = "".join(f'<div{rng.choice(["", _names(rng, words)])}><p>{s}</p><span>{t}</span></div>' for s, t in zip(some, short))
        inner = rng.choice(["", f"<h3>{short[0]}</h3>"]) + inner
    elif kind == "footer":
        inner = f"&copy; {short[0]} &middot; {some[0]}"
    else:
        inner = rng.choice([some[0], f"<p>{some[0]}</p>", f"<h4>{short[0]}</h4><p>{some[0]}</p>", f'<h1>{short[0]}</h1><p><a href="#">{some[0]}</a></p>'])
    tag = {"nav": "nav", "header": "header", "aside": "aside", "footer": "footer", "form": "form"}.get(kind)
    if tag and rng.random() < 0.6:
        return f"<{tag}{rng.choice(['', _names(rng, words)])}>{inner}</{tag}>"
    box = rng.choice(["div", "div", "section", "ul" if inner.startswith("<li") else "div"])
    if kind == "form":
        return f"<form>{inner}</form>" if rng.random() < 0.7 else f"<{box}{_names(rng, words)}>{inner}</{box}>"
    return f"<{box}{_names(rng, words)}>{inner}</{box}>"


def _article(rng: random.Random, lines: list[str], others: list[str]) -> str:
    out = [f"<h1>{escape(lines[0][:60])}</h1>"] if rng.random() < 0.7 else []
    k = 0
    while k < len(lines):
        take = rng.choice([1, 1, 1, 1, 1, 2, 3])
        part = [escape(x) for x in lines[k:k + take]]
        k += take
        shape = rng.random()
        if take > 1 and shape < 0.5:
            out.append("<ul>" + "".join(f"<li>{x}</li>" for x in part) + "</ul>")
        elif take > 1 and shape < 0.7:
            out.append("<table><tr>" + "".join(f"<td>{x}</td>" for x in part) + "</tr></table>")
        else:
            for x in part:
                tag = rng.choice(["p"] * 12 + ["h2", "h3", "blockquote", "pre", "div", "section", "figcaption"])
                x = f'<a href="/x">{x}</a>' if rng.random() < 0.04 else f"<b>{x}<br>" if rng.random() < 0.1 else x
                out.append(f"<{tag}>{x}</{tag}>" if rng.random() < 0.9 or tag != "p" else f"<p>{x}")
        if rng.random() < 0.06:
            out.append(_boilerplate(rng, rng.choice(["ad", "aside", "notice", "comments", "nav", "footer"]), others))
    body = "".join(out)
    body += _boilerplate(rng, "comments", others) if rng.random() < 0.15 else ""
    shape = rng.random()
    if shape < 0.55:
        return f"<article{rng.choice(['', _names(rng, _ARTICLE)])}>{body}</article>"
    if shape < 0.7:
        return f"<main>{body}</main>"
    return f"<div{_names(rng, _ARTICLE)}>{body}</div>"


def set_again(lines: list[str], others: list[str], rng: random.Random) -> str:
    """A page with ``lines`` as its article and some of ``others`` around it."""
    before = [k for k in ("notice", "header", "nav", "form", "ad", "aside") if rng.random() < 0.45]
    after = [k for k in ("aside", "ad", "comments", "form", "notice", "nav") if rng.random() < 0.4] + ["footer"] * (rng.random() < 0.8)
    body = "".join(_boilerplate(rng, k, others) for k in before) + _article(rng, lines, others) + "".join(_boilerplate(rng, k, others) for k in after)
    if rng.random() < 0.5:
        body = f"<div{rng.choice(['', _names(rng, ['page', 'wrapper', 'container', 'site', 'layout'])])}>{body}</div>"
    return f"<html><head><title>{escape(lines[0][:50])}</title></head><body>{body}</body></html>"


def labelled_blocks(page: str, text: str) -> tuple[list[Block], np.ndarray]:
    """Blocks of a page and whether each is a line of the article's text or the
    beginning of its first line, taken from outside the page's head."""
    lines = [" ".join(x.split()) for x in text.split("\n")]
    own, start = set(filter(None, lines)), next(filter(None, lines), "")
    found = blocks(page)
    return found, np.array([int("t:head" not in b.around and (b.text in own or (b.tag in ("h1", "h2") and start.startswith(b.text)))) for b in found])


def train(pages: list[tuple[str, str]], variants: int = VARIANTS, seed: int = 0) -> Chain:
    """The chain for labelled pages (html, article text)."""
    rng = random.Random(seed)
    texts = [[" ".join(x.split()) for x in t.split("\n") if x.strip()] for _, t in pages]
    texts = [t for t in texts if t] or [SEED_LINES] * 40
    pool = [x for t in texts for x in t]
    sets = [labelled_blocks(p, t) for p, t in pages]
    for t in texts:
        for _ in range(variants):
            own = t[:rng.randint(1, 12)]
            others = [x for x in (rng.choice(pool) for _ in range(30)) if x not in own] or ["Something else entirely"]
            sets.append(labelled_blocks(set_again(own, others, rng), "\n".join(own)))
    described = [([features(b) for b in bl], y) for bl, y in sets if bl]
    seen: dict[str, int] = {}
    for rows, _ in described:
        for f in rows:
            for name in f:
                seen[name] = seen.get(name, 0) + 1
    chain = Chain(sorted(n for n, k in seen.items() if k >= 3))
    return chain.fit([chain.rows(rows) for rows, _ in described], [y for _, y in described])


def main_text(page: str | None, chain: Chain, known: frozenset, weight: dict[str, float]) -> str:
    found = blocks(page, known)
    bias = chain.w[-1]
    scores = [bias + sum(weight.get(n, 0.0) for n in features(b)) for b in found]
    return "\n".join(b.text for b, label in zip(found, chain.decode(scores)) if label)


def extract(pages: DataFrame, labelled: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. ``labelled``: page_id, html,
    text (the article); at most ``sample_pages`` of it reach the driver."""
    known_pages = labelled.where(f"html is not null and text is not null and length(html) <= {SAMPLE_CHARS}")
    chosen = known_pages.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).select("html", "text").collect()
    chain = train([(r["html"], r["text"]) for r in chosen])
    known = frozenset(n for n in chain.index if n[:2] in ("t:", "c:"))
    weight = {n: float(chain.w[i]) for n, i in chain.index.items()}

    @task
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = [main_text(p, chain, known, weight) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    src = with_workers(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def labelled_pages(pages: DataFrame, documents: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Pages whose url ends in a document's number, with that document's text.
    Only the pages with the least id hashes are looked up."""
    number = F.regexp_extract("url", r"^[a-z]+://[^/]+/(?:[^/?#]+/)*(\d+)(?:[/?#].*)?$", 1)
    some = pages.where("html is not null").select("page_id", number.try_cast("long").alias("doc_id")).where("doc_id is not null")
    ids = some.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return pages.select("page_id", "html").join(F.broadcast(texts.select("page_id", "text").limit(2 * sample_pages)), "page_id")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract(pages, labelled_pages(pages, read(spark, sf_dir, "documents")))
