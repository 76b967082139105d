"""Operators on pages, urls and embeddings."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.llm.ann import exact_neighbours, nearest_neighbours, op9_hilbert_ann, recall
from netsieve.llm.components import UnionFind
from netsieve.llm.crf import Chain
from netsieve.llm.extraction import extract, labelled_blocks, main_text, op8_html_text, set_again, train
from netsieve.llm.hilbert import hilbert_index
from netsieve.llm.html_blocks import blocks
from netsieve.llm.url_filter import filter_urls, intervals
from netsieve.llm.vector_dedup import bands_for, int8_codes, near_vectors

SF = "/root/testdata/sf0.01"


# ---- url filter ----

URLS = ["https://www.Example.org/a/b/c?x=1#y", "http://user@example.org:8080", "http://evil.example.org./A", "ftp://other.net/a", "not a url", "", None,
        "https://deep.sub.example.org/a", "https://example.orgx/a", "https://www.example.org/ab", "https://" + "h" * 300 + ".org/" + "s/" * 3000]
ENTRIES = [("x", "host", "www.example.org", "add", 10), ("x", "host", "www.example.org", "remove", 20), ("x", "host", "www.example.org", "add", 30),
           ("d", "domain", "Example.org", "add", 15), ("d", "domain", "example.org", "remove", 25), ("d", "domain", "example.org", "add", 25),
           ("p", "prefix", "www.example.org/a", "add", 5), ("p", "prefix", "www.example.org/a", "add", 5), ("p", "prefix", "www.example.org/a", "add", 12),
           ("p", "prefix", "www.example.org/a/b", "add", 40), ("q", "host", None, "add", 1), ("q", None, "other.net", "add", 1), ("q", "host", "other.net", "add", None)]


def brute_filter(url, ts):
    """Every entry against one capture: replay the list up to the fetch."""
    import re
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)[^/?#]*(/[^?#]*)?", url or "")
    if not m or ts is None:
        return set(), 0
    host = m[1].lower().rstrip(".")
    path = [s for s in (m[2] or "").split("/") if s]
    state = {}
    for lst, kind, pat, action, at in sorted((e for e in ENTRIES if None not in e), key=lambda e: (e[4], e[3])):
        if at <= ts:
            state[lst, kind, pat.lower()] = action == "add"
    hit = []
    for (lst, kind, pat), on in state.items():
        whole = host + "/" + "/".join(path).lower()
        if on and ((kind == "host" and host == pat) or (kind == "domain" and (host == pat or host.endswith("." + pat)))
                   or (kind == "prefix" and (whole + "/").startswith(pat + "/"))):
            hit.append(lst)
    return set(hit), len(hit)


@pytest.mark.parametrize("bucket", [7, 30 * 86400])
def test_url_filter_equals_replaying_the_list(spark, bucket):
    caps = [(i, u, t, "mine") for i, (u, t) in enumerate(itertools.product(URLS, [0, 5, 10, 11, 15, 20, 24, 25, 30, 41, None]))]
    caps += caps[:3]
    df = spark.createDataFrame(caps, "page_id long, url string, fetch_ts long, lists string")
    got = filter_urls(df, spark.createDataFrame(ENTRIES, "list string, kind string, pattern string, action string, ts long"), bucket).collect()
    assert len(got) == len(caps)
    for r in got:
        lists, n = brute_filter(r["url"], r["fetch_ts"])
        assert (r["blocked"], r["n_entries"], r["lists"]) == (n > 0, n, ",".join(sorted(lists))), (r["url"], r["fetch_ts"])


def test_url_filter_of_empty_tables(spark):
    none = spark.createDataFrame([], "list string, kind string, pattern string, action string, ts long")
    caps = spark.createDataFrame([(1, "http://a.org/", 5)], "page_id long, url string, fetch_ts long")
    assert [r["blocked"] for r in filter_urls(caps, none).collect()] == [False]
    assert filter_urls(caps.limit(0), none).collect() == [] and intervals(none).collect() == []


# ---- extraction ----

def test_blocks_of_broken_markup():
    page = ("<!DOCTYPE html><title>T</title><script>var a='</p>';</script><p><b>One &amp; two<br>three<p>Four\n  <i>fi</i>ve<!-- no <p> -->"
            "<ul><li>a<li><a href='x>y'>b</a></ul><td>6 < 7</td></div><style>p{}</style><img alt=\"<p>\">&lt;p&gt; <a")
    assert [b.text for b in blocks(page)] == ["T", "One & two three", "Four five", "a", "b", "6 < 7", "<p>"]
    assert blocks(None) == [] and blocks("") == [] and blocks("<") [0].text == "<"
    assert len(blocks("<div>" * 20_000 + "x")) == 1


def test_crf_learns_a_chain_and_viterbi_is_exact():
    rng = random.Random(0)
    chains, labels = [], []
    for _ in range(200):
        y = [int(3 <= i < 7) for i in range(10)]
        chains.append([[f"f{v}" if rng.random() < 0.8 else f"f{1 - v}"] for v in y])
        labels.append(np.array(y))
    c = Chain(["f0", "f1"])
    c.fit([c.rows(x) for x in chains], labels)
    alone = np.mean([[int(f[0] == "f1") for f in x] == y.tolist() for x, y in zip(chains, labels)])
    along = np.mean([c.decode(c.scores(c.rows(x))) == y.tolist() for x, y in zip(chains, labels)])
    assert along > 2 * alone
    s = c.scores(c.rows(chains[0]))

    def total(y):
        return c.first[y[0]] + sum(s[t] for t in range(10) if y[t]) + sum(c.move[a, b] for a, b in zip(y, y[1:]))
    assert total(c.decode(s)) == pytest.approx(max(total(y) for y in itertools.product((0, 1), repeat=10)))


def test_crf_gradients_equal_enumeration():
    rng = np.random.default_rng(4)
    c = Chain(["a", "b", "c"])
    c.w, c.move, c.first = rng.normal(size=4), rng.normal(size=(2, 2)), rng.normal(size=2)
    chains = [c.rows([[f for f in "abc" if rng.random() < 0.5] for _ in range(n)]) for n in (1, 4, 3)]
    labels = [rng.integers(0, 2, len(x)) for x in chains]

    def likelihood():
        out = 0.0
        for x, y in zip(chains, labels):
            s = c.scores(x)
            total = {v: c.first[v[0]] + sum(s[t] for t in range(len(v)) if v[t]) + sum(c.move[a, b] for a, b in zip(v, v[1:]))
                     for v in itertools.product((0, 1), repeat=len(y))}
            out += total[tuple(y.tolist())] - np.log(sum(np.exp(v) for v in total.values()))
        return out / len(chains)

    for values, grad in zip((c.w, c.move, c.first), c._gradients(chains, labels)):
        flat, g = values.reshape(-1), np.asarray(grad).reshape(-1)
        for i in range(len(flat)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = likelihood()
            flat[i] = old - 1e-5
            down = likelihood()
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def plain_blocks(page):
    """The rules tag by tag, with the whole stack searched each time."""
    from netsieve.llm import html_blocks as h
    out, stack, text = [], [], []

    def flush():
        words = " ".join(h.html.unescape("".join(text)).split())
        if words:
            out.append((words, next((t for t in reversed(stack) if t not in h.INLINE), "")))
        text.clear()

    at = 0
    for m in h._TOKEN.finditer(page):
        text.append(page[at:m.start()])
        at, tag = m.end(), (m[3] or m[6] or "").lower()
        if not tag:
            text.append(" " if m[0].startswith("<!") or m[1] else "")
            continue
        if tag in h.VOID and tag in h.INLINE:
            text.append(" ")
            continue
        if tag not in h.INLINE:
            flush()
        if m[2] or m[5]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == tag:
                    del stack[k:]
                    break
                if tag in h.INLINE and stack[k] not in h.INLINE:
                    break
        elif tag not in h.VOID:
            for k in range(len(stack) - 1, -1, -1):
                if tag not in h.INLINE and stack[k] == "p":
                    del stack[k:]
                    break
                if tag in h.INLINE or stack[k] not in h.INLINE:
                    for j in range(len(stack) - 1, -1, -1):
                        if tag in h.REPEATS and stack[j] == tag:
                            del stack[j:]
                            break
                        if stack[j] in h.REPEATS.get(tag, stack):
                            break
                    break
            stack.append(tag)
    text.append(page[at:])
    flush()
    return out


def test_blocks_equal_a_plain_walk_of_the_stack():
    rng = random.Random(2)
    tags = ["p", "div", "li", "ul", "ol", "table", "tr", "td", "b", "a", "i", "span", "br", "hr", "dl", "dt", "select", "option"]
    for _ in range(3000):
        page = "".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "x ", "y"]) for _ in range(rng.randrange(30)))
        assert [(b.text, b.tag) for b in blocks(page)] == plain_blocks(page), page


@pytest.mark.parametrize("start,end", [("<b>x", "</i>y"), ("<div>x", "</p>y"), ("<li>x", "</td>y"), ("<b>", "<p>x"), ('<a ">x', "</a '>"), ("<p><b>", "</b x"), ("<!-", "->"), ("<a b=\"'>", "<"), ("&#x", ";")])
def test_parsing_time_is_linear(start, end):
    def seconds(n):
        page, best = start * n + end * n, 9.9
        for _ in range(3):
            at = time.perf_counter()
            blocks(page, frozenset())
            best = min(best, time.perf_counter() - at)
        return best

    seconds(100)
    assert seconds(40_000) < 25 * seconds(4_000) + 0.05 and seconds(40_000) < 3


def test_extraction_of_pages_set_in_other_markup(spark):
    d = "/root/testdata/sf0.1"
    docs = [r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").where("length(text) between 300 and 4000").orderBy("doc_id").limit(400).collect()]
    known = [[" ".join(x.split()) for x in t.split("\n") if x.strip()] for t in docs]
    pool = [x for t in known for x in t]
    rng = random.Random(5)
    chain = train([(set_again(t, pool[:40], rng), "\n".join(t)) for t in known[:120]])
    wrong = total = 0
    for t in known[200:]:
        others = [x for x in (rng.choice(pool) for _ in range(20)) if x not in t]
        found, y = labelled_blocks(set_again(t, others, rng), "\n".join(t))
        from netsieve.llm.extraction import features
        wrong += sum(a != b for a, b in zip(chain.decode(chain.scores(chain.rows([features(b) for b in found]))), y))
        total += len(y)
    assert total > 2000 and wrong / total < 0.01


def test_extraction_of_the_pages(spark):
    import html
    import re
    got = {r["page_id"]: r for r in op8_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[p["page_id"]]["text"] == "\n".join(filter(None, want))
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", None, 3), (2, None, "", 3), (2, None, "", 3), (None, "u", "<nav>a</nav>", 3), (4, "u", "<article><p>Long " + "word " * 40_000 + "end.</p></article>", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    none = spark.createDataFrame([], "page_id long, html string, text string")
    got = extract(pages, none).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["1", "2", "2", "4", "None"]
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == by[2]["text"] == by[None]["text"] == "" and by[4]["n_chars"] == len("Long " + "word " * 40_000 + "end.")
    assert extract(pages.limit(0), none).collect() == []


# ---- embeddings ----

def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "l", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, label string, node int")


ODD = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (None, [1.0, 2.0]),
       (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0]), (10, [1.0, 2.0]), (11, [1.0, 2.0, 3.0]), (12, [-1.0, -2.0])]


@pytest.mark.parametrize("kind,tile", [("float", 512), ("double", 7)])
def test_near_vectors_equal_brute_force(spark, kind, tile):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([b + rng.normal(size=(rng.integers(1, 30), 16)) * rng.choice([0.02, 0.2, 0.3]) for b in base])
    x = np.concatenate([x, x[:5], 3 * x[5:8]]).astype("f4" if kind == "float" else "f8").astype(float)
    ids = rng.permutation(len(x)) * 2 + 1
    got = {r["vec_id"]: r for r in near_vectors(vectors(spark, [(int(i), v.tolist()) for i, v in zip(ids, x)], kind), tile=tile).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, uf = u @ u.T >= 0.95, UnionFind()
    for a, b in zip(*np.nonzero(near)):
        uf.union(int(ids[a]), int(ids[b]))
    assert [got[int(i)]["n_links"] for i in ids] == (near.sum(axis=1) - 1).tolist()
    assert [got[int(i)]["component_id"] for i in ids] == [uf.find(int(i)) for i in ids]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_near_vectors_of_odd_rows(spark):
    got = near_vectors(vectors(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    for i in (1, 2, 3, 4, 5, 6, 11, 12):
        assert by[i] == (0, i, True)
    assert by[8][1:] == (8, True) and by[9][1:] == (8, False) and by[10][1:] == (8, False)
    assert near_vectors(vectors(spark, [])).collect() == []


def test_int8_bound_holds():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 64)), rng.standard_cauchy((300, 64)), np.eye(64)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, step, err = int8_codes(x)
    about = (codes.astype(float) @ codes.T.astype(float)) * step[:, None] * step
    assert (np.abs(about - x @ x.T) <= err[:, None] + err + err[:, None] * err + 1e-9).all()


def test_bands_follow_the_table():
    planes, bands = bands_for(1 << 30, 0.95)
    assert planes == 24 and (1 - (1 - np.arccos(0.95) / np.pi) ** planes) ** bands <= 1e-6


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = hilbert_index(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_of_the_embeddings(spark):
    d = "/root/testdata/sf0.1"
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    found = op9_hilbert_ann(spark, d).cache()
    assert recall(found, exact_neighbours(e, e.where("vec_id % 20 = 0"))) >= 0.9
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    for r in found.orderBy("query_id").limit(200).collect():
        assert r["score"] == pytest.approx(float(v[r["query_id"]] @ v[r["vec_id"]]), abs=1e-12) and r["query_id"] != r["vec_id"]


def test_recall_with_several_ranges(spark, monkeypatch):
    import netsieve.llm.ann as ann
    monkeypatch.setattr(ann, "RANGE_ROWS", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1900, 24)) * rng.uniform(0.2, 3, size=(1900, 1))
    e = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double")
    found = nearest_neighbours(e, F.col("vec_id") % 20 == 0, tile=100)
    assert recall(found, exact_neighbours(e, e.where("vec_id % 20 = 0"))) >= 0.9


@pytest.mark.parametrize("long", [[], [1000.0], [20.0] * 30])
def test_recall_with_long_vectors_and_many_ranges(spark, monkeypatch, long):
    import netsieve.llm.ann as ann
    monkeypatch.setattr(ann, "RANGE_ROWS", 125)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:len(long)] *= np.array(long).reshape(-1, 1)
    e = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double")
    asked = F.col("vec_id") % 40 == 0
    assert recall(nearest_neighbours(e, asked), exact_neighbours(e, e.where(asked))) >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = ODD + [(20, [1.0, 2.0]), (40, [5.0, 0.0]), (60, [float("nan"), 0.0]), (80, [1.0, 1.0, 1.0])]
    got = {}
    for r in nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got[20] == [(1, 9, 10.0), (2, 8, 5.0), (3, 10, 5.0), (4, 40, 5.0), (5, 12, -5.0)]
    assert got[80] == [(1, 11, 6.0)] and set(got) == {20, 40, 80}
    assert nearest_neighbours(vectors(spark, []), F.lit(True)).collect() == []
