"""SentencePiece encoding, periodic runs, centroid clustering."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from netsieve.llm.centroids import centroid_clusters, centroid_report, op13_centroid_clusters, squared
from netsieve.llm.periodic import document_runs, op12_periodic_runs, run_digests, runs_of, suffix_automaton, text_runs
from netsieve.llm.pieces import MODEL, PieceEncoder, decoded, encoded, op11_sentencepiece, piece_digests

SF = "/root/testdata/sf0.01"
sha = lambda b: hashlib.sha256(b).hexdigest()


# ---- pieces ----

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


@pytest.fixture(scope="module")
def own():
    return PieceEncoder()


def random_texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "b", "e", "th", "in", "er", " ", "  ", "\n", "\t", "▁", "é", "梦", "𝔘", "́", "0", "//", "=", "-", " the", "ing", "　", "\x00", "️", "😀", "<s>", "<0x41>", "aaaa",
            "    ", "\r\n", ".", ",", "ation"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(n)]
    texts += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0xE000, 0x10FFFF)])) for _ in range(rng.randrange(1, 30))) for _ in range(n // 4)]
    return texts + ["a" * k for k in range(70)] + [" " * k for k in range(40)] + ["=" * k for k in range(70)]


def test_pieces_equal_the_library(own, library):
    texts = random_texts(3, 6000)
    theirs = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for t, a, b in zip(texts, own.encode(texts), theirs):
        assert a.tolist() == b, t
        assert own.decode(a) == library.decode(b), t


def test_long_words_equal_the_library(own, library):
    rng = random.Random(4)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 6000), ("abcXYZ019+/", 20_000), ("a", 50_001), ("=", 9_999), (" ", 5_000), ("的一是不", 9_000)):
        t = "".join(rng.choice(letters) for _ in range(n))
        assert own.encode([t])[0].tolist() == library.encode(t, add_bos=True, add_eos=True), letters


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(5)
    for _ in range(6000):
        ids = [rng.randrange(0, rng.choice([32000, 300, 260])) for _ in range(rng.randrange(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_words_kept_or_not_give_the_same_ids(own, monkeypatch):
    texts = random_texts(6, 300)
    once = [i.tolist() for i in own.encode(texts)]
    monkeypatch.setattr("netsieve.llm.pieces.CACHE_WORDS", 3)
    assert [i.tolist() for t in texts for i in own.encode([t])] == once
    monkeypatch.setattr("netsieve.llm.pieces.FEW_ROUNDS", 0)
    assert [i.tolist() for i in PieceEncoder().encode(texts)] == once


def test_piece_query_on_odd_rows(spark, library):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a  b", "y"), (2, "", "z"), (3, "word " * 40_000, "z"), (4, "\x00 ▁", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, piece_digests(df).collect()), key=str)
    want = []
    for d, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    assert got == sorted(want, key=str)
    assert piece_digests(df.limit(0)).collect() == []
    back = {r["doc_id"]: r["text"] for r in decoded(encoded(df)).collect()}
    assert back[3] == rows[4][1] and back[None] == "a  b" and back[1] == ""


def test_piece_query_on_the_table(spark, library):
    got = {r["doc_id"]: r for r in op11_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))


# ---- runs ----

def plain_runs(w, least=12):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        j = q
        while j < len(w):
            s = j
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            n = j - s + q
            if n >= max(least, 2 * q) and not any(all(w[k] == w[k - p] for k in range(s - q + p, j)) for p in range(1, q)):
                out.add((s - q, n, q))
            j += 1
    return sorted(out)


def random_words(rng, longest=100):
    n, k = rng.randrange(0, longest), rng.choice([1, 2, 2, 3, 5, 30, 1000])
    w = [rng.randrange(k) for _ in range(n)]
    if rng.random() < 0.5 and n > 5:
        a = rng.randrange(n)
        p = rng.randrange(1, max(2, (n - a) // 2 + 1))
        w = w[:a] + (w[a:a + p] * n)[:n - a]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        w, least = random_words(rng), rng.choice([12, 12, 4, 2])
        assert runs_of(w, least) == plain_runs(w, least), (w, least)


@pytest.mark.parametrize("sieve", [True, False])
def test_sieved_texts_equal_brute_force(sieve):
    rng = random.Random(8)
    texts = [random_words(rng, 140) for _ in range(1200)]
    flat = np.array([c for w in texts for c in w], np.int64)
    assert text_runs(flat, np.cumsum([len(w) for w in texts]), sieve=sieve) == [plain_runs(w) for w in texts]


def test_automaton_holds_just_the_substrings():
    rng = random.Random(9)
    for _ in range(50):
        w = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        link, length, ends = suffix_automaton(w)
        assert sum(length[s] - length[link[s]] for s in range(1, len(link))) == len({tuple(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1)})
        assert [length[s] for s in ends] == list(range(1, len(w) + 1))


def test_long_sequences_stay_fast():
    fib, nxt = [0], [0, 1]
    while len(nxt) < 30_000:
        fib, nxt = nxt, nxt + fib
    assert len(runs_of(nxt)) > 1000
    assert runs_of([0] * 100_000) == [(0, 100_000, 1)]
    assert runs_of([k % 997 for k in range(50_000)]) == [(0, 50_000, 997)]


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *top, None if not runs else 1000 * top[1] // top[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()),
            sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_query_on_odd_rows(spark):
    line = "one two three four five six seven "
    rows = [(1, None, 1), (2, "", 2), (None, line * 3, 3), (None, line * 3, 3), (3, "x " * 11, 4), (4, "x " * 12, 5), (5, "a\tb\x0bc\x0cd\r\n" * 9, 6), (6, "A a " * 7, 7),
            (7, " x  y\x1c " * 6, 8)] + [(k, line * (k % 4) + f"w{k} " * (k % 30), 0) for k in range(8, 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    want = sorted((plain_digest(d, t) for d, t, _ in rows), key=str)
    assert sorted(map(tuple, run_digests(df).collect()), key=str) == want
    assert sorted(map(tuple, run_digests(df, sieve=False).collect()), key=str) == want
    assert run_digests(df.limit(0)).collect() == []
    full = {r["doc_id"]: r for r in document_runs(df.where("doc_id = 4 or doc_id is null")).collect()}
    assert full[4]["collapsed"] == "x" and [tuple(r) for r in full[4]["runs"]] == [(0, 12, 1)]
    assert full[None]["collapsed"] == line.strip()


def test_run_query_on_the_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys() and sum(r[1] for r in got.values()) > 100
    short = [d for d, t in docs.items() if len((t or "").split()) < 400]
    assert len(short) > 200
    for d in short:
        assert got[d] == plain_digest(d, docs[d])


# ---- centroids ----

def plain_clusters(rows, k=16, rounds=3):
    """Every distance in every round, in whole numbers."""
    vs = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted(vs, key=lambda r: (r[0] is None, sha(f"1:{r[0]}".encode()), r[1]))[:k]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in vs]
        if turn < rounds:
            for j in range(len(cs)):
                mine = [v for (_, v), (_, at) in zip(vs, near) if at == j]
                if mine:
                    cs[j] = [sum(col) // len(mine) for col in zip(*mine)]
    inside = {}
    for d, j in near:
        inside[j] = inside.get(j, 0) + d
    return sorted(((i, j, d, inside[j], sum(inside.values()), sha(",".join(map(str, cs[j])).encode())) for (i, _), (d, j) in zip(vs, near)), key=str)


def vectors(n, seed, spread=1.0, kind=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 64)) * spread
    return [(k, (middle[k % 9] + kind * spread * rng.normal(size=64)).tolist()) for k in range(n)]


def test_clusters_on_odd_rows(spark):
    rows = vectors(90, 1) + [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [float("nan")] + [0.0] * 63), (205, [float("inf")] * 64), (206, [None] + [0.0] * 63),
                             (207, [0.0] * 64), (208, [-0.001] * 64), (None, [0.5] * 64), (3, vectors(9, 1)[3][1]), (7, [0.25] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int")
    assert sorted(map(tuple, centroid_report(df).collect()), key=str) == plain_clusters(rows)
    assert centroid_report(df.limit(0)).collect() == []
    assert centroid_report(df.where("vec_id = 205")).collect() == []
    few = rows[:3]
    assert sorted(map(tuple, centroid_report(df.where("vec_id < 3")).collect()), key=str) == plain_clusters(few)


@pytest.mark.parametrize("spread", [1e-3, 1e5, 3e8])
def test_clusters_of_numbers_of_any_size(spark, spread):
    rows = vectors(60, 2, spread, 0.8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(i, c, d if d < 2 ** 63 else None, n if n < 2 ** 63 else None, a if a < 2 ** 63 else None, s) for i, c, d, n, a, s in plain_clusters(rows)]
    assert sorted(map(tuple, centroid_report(df).collect()), key=str) == sorted(want, key=str)


def test_ties_go_to_the_smaller_number(spark):
    # copies of few points on a grid: most distances tie
    rows = [(k, [float(k % 3)] * 32 + [float(k % 2)] * 32) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, centroid_report(df).collect()), key=str) == plain_clusters(rows)


def test_bounds_save_distances_and_change_nothing(spark):
    rows = vectors(400, 3, kind=0.1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, _, states = centroid_clusters(df, rounds=6)
    cost = [s.selectExpr("avg(exact) c").first()["c"] for s in states]
    assert cost[0] == 16 and cost[-1] < 4
    for s in states[1:]:
        assert s.where("exact < 1").count() == 0


def test_squares_fit_or_become_whole_numbers():
    x = np.array([[1 << 40, -5], [3, 4]], np.int64)
    assert squared(x, x[:1]).tolist() == [[0], [((1 << 40) - 3) ** 2 + 81]]


def test_cluster_query_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op13_centroid_clusters(spark, SF).collect()), key=str) == plain_clusters(rows)
