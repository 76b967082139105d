"""Operators on documents: brute force on small tables, and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netsieve.llm.components import UnionFind, components, with_least
from netsieve.llm.mixing import mix, mixed
from netsieve.llm.near_dedup import band_count, drop_near_duplicates, near_duplicates
from netsieve.llm.packing import Capacities, best_fit, cuts, pack_documents, sequences
from netsieve.llm.quality import Network, keep_quality, score_quality
from netsieve.llm.shingles import shingle_sets
from netsieve.llm.superminhash import signatures
from netsieve.llm.token_store import Shard, document_starts, pack_shard, read_store, sample_arrays, train_dictionary, write_store
from netsieve.llm.tokens import Encoder, vocabulary
from netsieve.llm.toxicity import Chain, keep_clean, score_toxicity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """Rows (doc_id, text, source); lang and n_chars are filled in."""
    full = [(d, t, "en", s, len(t or "")) + ((1, "x", 2.0) if extra else ()) for d, t, s in rows]
    return spark.createDataFrame(full, DOCS + extra)


# columns that operators use inside; a table may have them too
CLASH = ", size int, component string, v1 double"


def odd_rows():
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30_000))
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "one", "b"), (5, "one", "b"), (6, long, "b"), (6, long, "b"),
            (None, "no id here at all", "c"), (8, "Ünï cödé 　 wörds, and 'quotes' <|endoftext|>", "c"), (9, "two words", None)]


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


# ---- shingles and signatures ----

def plain_shingles(text, width):
    """Words by hand: ASCII lower case, split at space and \\t to \\r."""
    words, word = [], ""
    for ch in (text or "") + " ":
        if ch == " " or "\t" <= ch <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += ch.lower() if "A" <= ch <= "Z" else ch
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def test_shingle_sets_equal_plain_sets():
    rng = random.Random(1)
    texts = [None, "", " ", "A", "a b", "A  b\tc\x0bD", "é É", "a\xa0b c", "x" * 9000 + " y z"]
    texts += [" ".join(rng.choice(["the", "The", "cat", "dog", "é", "b\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for width in (1, 3, 5):
        got, want = shingle_sets(texts, width), [plain_shingles(t, width) for t in texts]
        assert [len(g) for g in got] == [len(w) for w in want]
        for i in range(0, len(texts), 7):
            for j in range(0, len(texts), 11):
                assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


@pytest.mark.parametrize("n,common", [(12, 8), (400, 300)])
def test_superminhash_is_unbiased_with_less_variance(n, common):
    rng = np.random.default_rng(5)
    j = common / (2 * n - common)
    shares = []
    for _ in range(300):
        u = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
        s = signatures([u[:n], u[n - common:]], 251)
        shares.append((s[0] == s[1]).mean())
    independent = (j * (1 - j) / 251) ** 0.5
    assert abs(np.mean(shares) - j) < 4 * independent / 300 ** 0.5
    assert np.std(shares) < independent


def test_signature_does_not_depend_on_order_or_batch():
    a = np.arange(1, 60, dtype=np.uint64)
    one = signatures([a], 101)
    many = signatures([np.empty(0, np.uint64), a[::-1].copy(), a[:1]], 101)
    assert (one[0] == many[1]).all()
    assert (many[0] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_bands_meet_the_promised_miss_rate():
    for t in (80, 85, 95):
        assert (1 - (t / 100) ** 7) ** band_count(t) <= 1e-6


@pytest.mark.parametrize("threshold,n,common,pairs", [(80, 5, 4, 20_000), (80, 10, 8, 6_000), (80, 20, 16, 4_000), (85, 7, 6, 6_000), (85, 20, 17, 4_000)])
def test_small_sets_at_the_threshold_share_a_band(threshold, n, common, pairs):
    bands, rng, missed = band_count(threshold), np.random.default_rng(n), 0
    for _ in range(pairs // 2000):
        u = rng.integers(0, 2**63, (2000, n), dtype=np.uint64)
        a, b = (signatures(list(s), bands * 7).reshape(-1, bands, 7) for s in (u, u[:, :common]))
        missed += int((~(a == b).all(axis=2).any(axis=1)).sum())
    assert missed == 0


def test_whole_and_traced_shuffles_give_the_same_places(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, k, dtype=np.uint64) for k in (1, 5, 127, 128, 700)]
    got = []
    for small in (0, 128, 10**9):
        monkeypatch.setattr("netsieve.llm.superminhash.SMALL", small)
        got.append(signatures(sets, 203))
    assert (got[0] == got[1]).all() and (got[1] == got[2]).all()


def test_many_small_sets_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(1200):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split()
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = [rng.choice("pqrst") for _ in range(rng.randrange(2))]
        else:
            w = [rng.choice("abcdefghij") for _ in range(rng.randrange(5, 26))]
        rows.append((k, " ".join(w)))
    want = brute_components(rows, 5, 80)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) < 1000 and got == want


def brute_components(rows, width, threshold):
    sets, uf = [(d, plain_shingles(t, width)) for d, t in rows], UnionFind()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                uf.union(a, b)
    return {d: uf.find(d) for d, _ in rows}


def near_copies(seed=0, groups=6, size=14):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 25, 90]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 30)}"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,threshold,tile", [(3, 85, 256), (5, 80, 256), (3, 85, 3)])
def test_near_duplicates_equal_brute_force(spark, width, threshold, tile):
    rows = near_copies(width)
    got = near_duplicates(documents(spark, [(d, t, "s") for d, t in rows]), width, threshold, tile=tile).collect()
    want = brute_components(rows, width, threshold)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {d: len(plain_shingles(t, width)) for d, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(spark, empty):
    docs = documents(spark, odd_rows(), CLASH)
    got = {}
    for r in near_duplicates(docs, 3, 85).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert len(got[6]) == 2 and got[6][0] == got[6][1] and got[6][0][2]
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)]
    assert got[None] == [(3, None, True)]
    kept = drop_near_duplicates(docs, shingle=3, threshold=85)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x) for x in (1, 2, 3, 4, 6, None, 8, 9))
    assert near_duplicates(empty).collect() == [] and drop_near_duplicates(empty).collect() == []


def test_components_equal_union_find(spark):
    rng, uf = random.Random(2), UnionFind()
    links = [(rng.randint(1, 400), rng.randint(1, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    for a, b in links:
        if a and b:
            uf.union(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {x: uf.find(x) for x in uf.parent if uf.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_of_one_node_are_dealt_out(spark):
    hub = spark.range(1, 20_001).select(F.lit(0).alias("a"), F.col("id").alias("b"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = with_least(hub, 64).groupBy(F.spark_partition_id()).count().collect()
        parts = with_least(hub, 64).repartition(40, "a", F.pmod(F.xxhash64("b"), F.lit(64))).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in sizes) == 20_000 and max(r["count"] for r in parts) < 3000
    got = with_least(hub, 64).agg(F.count("*"), F.min("m"), F.max("m")).first()
    assert tuple(got) == (20_000, 1, 1)
    assert components(hub).agg(F.count("*"), F.max("component")).first()[:] == (20_000, 0)


def test_components_stop_as_soon_as_only_stars_are_left(spark, monkeypatch):
    from netsieve.llm import components as module

    cuts_made = []
    monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: cuts_made.append(1) or cut(df))
    stars = [(c, c + k) for c in (100, 200) for k in (1, 2, 3)]
    got = components(spark.createDataFrame(stars, "a long, b long").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == [(c + k, c) for c in (100, 200) for k in (1, 2, 3)]
    assert len(cuts_made) == 1  # no round but the forest of each task


def test_links_of_the_last_tiles_join_whole_components(spark):
    # exact copies, a chain of near copies and a text of its own, in any order of ids
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join(words[:58] + ["x", "y"]), " ".join(words[:56] + ["x", "y", "z", "v"]), " ".join(words), "other words that stand alone here"]
    rows = [(k, t) for k, t in zip((9, 4, 7, 2, 5), texts)]
    want = brute_components(rows, 5, 80)
    for tile in (1, 256):
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
        assert got == want


# ---- tokens, packing, store ----

@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoder_equals_the_tokenizer(name, spaced):
    rng = random.Random(4)
    bits = ["a", "wo,", "b.", ",", "..", "Foo", "'s", " ", " ", "  ", "\n", " \n", "\t", "é", "\xa0", "don't", "12", "###",
            "<|endoftext|>", "x" * 60, "Σ", "é", "́", "\x1c", "İ", "ŉ", "日本"]
    texts = ["", " "] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 16))) for _ in range(3000)]
    want = vocabulary(name).encode_batch(texts, add_special_tokens=False)
    assert [a.tolist() for a in Encoder(name, spaced).encode(texts)] == [e.ids for e in want]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_special_tokens_written_in_a_text_get_their_ids(name, spaced):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng, tok = random.Random(8), Tokenizer.from_file(public_tokenizers.path(name))
    special = [t.content for t in tok.get_added_tokens_decoder().values() if t.special]
    bits = [*special, *(s.upper() for s in special), special[0][:2], special[0][-2:], "<", "Foo", "bar,", "b.", " ", " ", "\n", "\u00e9"]
    texts = [*special, f"one {special[0]} two", f"One{special[0].upper()}two"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert any(tok.token_to_id(special[0]) in ids for ids in want)
    assert [a.tolist() for a in Encoder(name, spaced).encode(texts)] == want


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_an_encoder_keeps_no_more_chunks_than_it_may(name, spaced):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randint(0, 900)}" + rng.choice(["", ",", "."]) for _ in range(40)) for _ in range(60)]
    want = [e.ids for e in vocabulary(name).encode_batch(texts, add_special_tokens=False)]
    enc = Encoder(name, spaced, entries=50)
    for t, ids in zip(texts, want):
        assert enc.encode([t])[0].tolist() == ids and len(enc.codes) <= 50


def test_cuts_leave_only_the_first_piece_short():
    assert cuts(1, 4) == [(0, 1)] and cuts(4, 4) == [(0, 4)]
    assert cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_best_fit_equals_a_linear_search():
    rng = random.Random(6)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 200))), reverse=True)
        bins, offsets = best_fit(np.array(lengths, np.int64), 64)
        left, want = [], []
        for n in lengths:
            fits = [room for room in left if room >= n]
            want.append(min(fits) if fits else 64)
            if fits:
                left[left.index(min(fits))] -= n
            else:
                left.append(64 - n)
        assert len(set(bins.tolist())) == len(left)
        assert [64 - o for o in offsets.tolist()] == want
    c = Capacities(8)
    assert c.tightest(1) is None
    c.add(8, 1)
    assert c.tightest(8) == (8, 1) and c.tightest(0) is None


def check_packed(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing_of_odd_rows(spark, empty):
    docs = documents(spark, odd_rows(), ", length int, group string, piece double")
    packed = pack_documents(docs, group_pieces=8).cache()
    rows = packed.collect()
    check_packed(rows)
    tok = vocabulary("byte_bpe_50k.json")
    want = Counter()
    for d, t, _ in odd_rows():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (s, n) in enumerate(cuts(len(ids))):
            want[(d, k, s, n, zlib.crc32(ids[s:s + n].tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    back = sequences(docs, packed).collect()
    assert {r["sequence_id"]: len(r["ids"]) for r in back} == {s: sum(r["length"] for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows}}
    assert pack_documents(empty).collect() == []


def test_packing_wastes_little(spark):
    rows = pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert check_packed(rows) <= 1.01 * np.ceil(sum(r["length"] for r in rows) / 2048)


def test_store_round_trip(spark, tmp_path, empty):
    docs = documents(spark, odd_rows(), ", seq int, blob string, part double")
    path = str(tmp_path / "store")
    write_store(docs.repartition(3), path, shard_bytes=200)
    tok = vocabulary("word_bpe_49k.json")
    ids = [(d, tok.encode(t or "", add_special_tokens=False).ids + [2]) for d, t, _ in odd_rows()]
    ids.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    want, start = [], 0
    for d, i in ids:
        want.append((d, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    got = sorted(map(tuple, document_starts(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    some = read_store(spark, path, [4, 9]).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in some) == [(d, i) for d, i in ids if d in (4, 9)]
    write_store(empty, str(tmp_path / "none"))
    assert document_starts(spark, str(tmp_path / "none")).collect() == []


def test_shard_refuses_another_dictionary():
    import hashlib

    import zstandard
    d = train_dictionary([b"abcd" * 4] * 3)
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d)).compress(np.array([7, 2], "<u2").tobytes())
    blob = pack_shard([5, None], [2, 2], [frame, frame], hashlib.sha256(d).digest(), 2)
    s = Shard(blob, d)
    assert s.doc_ids == [5, None] and s.ids(1).tolist() == [7, 2]
    with pytest.raises(ValueError, match="another dictionary"):
        Shard(blob, d + b"x")


# ---- mixing ----

def test_mix_of_odd_rows(spark, empty):
    docs = documents(spark, odd_rows(), CLASH)
    rows = mix(docs, range_rows=2).collect()
    assert len(rows) == len(odd_rows())
    assert {r["source"]: r["target"] for r in rows if r["source"] is None or r["source"] != "b"}.keys() == {"a", "c", None}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(5), range_rows=3).collect()))
    out = mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in mix(docs).collect())
    assert mix(empty).collect() == [] and mixed(empty).collect() == []


def plain_mix(rows, budget_share=1.5):
    """Fair queueing document by document, for sources given in order."""
    import hashlib
    import re
    sizes = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, s in rows]
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(z for _, t, z in sizes if t == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, capped = budget_share * sum(total.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (budget - sum(2 * total[s] for s in capped)) / max(sum(weight[s] for s in rest), 1)
        over = [s for s in rest if level * weight[s] > 2 * total[s]]
        if not over:
            break
        capped.update(over)
    target = {s: 2 * total[s] if s in capped else level * weight[s] for s in names}
    key = lambda d: int(hashlib.md5(f"42|{'~' if d is None else d}".encode()).hexdigest()[:15], 16)
    served = []
    for s in names:
        at = 0
        for d, _, z in sorted((r for r in sizes if r[1] == s), key=lambda r: (key(r[0]), -1 if r[0] is None else r[0], r[2])):
            at += z
            served += [((e * total[s] + at) / target[s], -1 if d is None else d, e, s, z) for e in range(2) if z and target[s]]
    taken, spent = Counter(), 0
    for _, d, _, s, z in sorted(served, key=lambda r: r[:3]):
        spent += z
        if spent > budget:
            break
        taken[s] += z
    return taken


def test_mix_deals_out_repeated_rows(spark):
    one = "word " * 7
    rows = [(None, one, "a")] * 900 + [(5, one, "a")] * 700 + [(k, "x " * (1 + k % 40), "bcd"[k % 3]) for k in range(6, 600)] + [(9999, "long " * 60_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = plain_mix(rows)
    for range_rows in (10, 1000):
        got = mix(df, range_rows=range_rows)
        assert got.count() == len(rows)
        assert {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum("taken").alias("t")).collect() if r["t"]} == dict(want)


def test_packing_deals_out_copies_of_one_row(spark):
    rows = [(None, "same words here " * 9)] * 3000 + [(k, "w " * (k % 90)) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pack_documents(df, group_pieces=200)
    per = got.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert got.count() == len(rows) and len(per) > 12 and max(r["count"] for r in per) < 400
    ends = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert ends.where("n <> top or n > 2048").count() == 0


def test_dictionary_does_not_depend_on_the_order_of_repeats(spark):
    rows = [(k % 40, f"text {k} " * (k % 700)) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sample_arrays(d, "word_bpe_49k.json", False, 2, 30) for d in (df, df.orderBy(F.rand(1)).repartition(3))]
    assert got[0] == got[1] and 20 < len(got[0]) <= 30 and max(map(len, got[0])) <= 16 * 1024


def test_mix_targets_and_budget(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(1, 30), rng.choice(["a", "b", "b", "b", "c", "c", "d", None])) for k in range(3000)]
    got = mix(documents(spark, rows), range_rows=50).collect()
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], dict(size=r["source_size"], target=r["target"], taken=0))
        s["taken"] += r["taken"]
    # sharing again and again, as plainly as it can be put
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, left, open_ = dict.fromkeys(order, 0.0), 1.5 * total, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * by[s]["size"]}
        if not over:
            want.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            want[s] = 2.0 * by[s]["size"]
            left -= want[s]
        open_ -= over
    for s, v in by.items():
        assert v["target"] == pytest.approx(want[s])
        assert abs(v["taken"] - v["target"]) <= 60
    assert sum(v["taken"] for v in by.values()) <= 1.5 * total


# ---- classifiers ----

def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 4))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * x[:, 2])))
    y = (rng.random(6000) < p).astype(float)
    s = Network(x, y).scores(x)
    for lo in (0.1, 0.3, 0.5, 0.7):
        pick = (s >= lo) & (s < lo + 0.2)
        assert abs(s[pick].mean() - y[pick].mean()) < 0.08
    assert (Network(x, np.ones(6000)).scores(x) == 1).all() and (Network(x[:0], y[:0]).scores(x) == 0.5).all()


def accuracy(scored, labels, label):
    r = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return np.mean([a == b for a, b in r]), len(r)


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    right, n = accuracy(score_quality(docs, labels), labels, "quality")
    assert n > 500 and right > 0.98


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = score_toxicity(docs, labels)
    right, n = accuracy(scored, labels, "toxic")
    assert n > 500 and right > 0.97
    r = scored.where("held_out").join(labels.where("toxic = 1"), "doc_id").agg(F.avg("predicted")).first()[0]
    assert r > 0.85


@pytest.mark.parametrize("score,keep,label", [(score_quality, keep_quality, "quality"), (score_toxicity, keep_clean, "toxic")])
def test_classifiers_on_odd_rows(spark, empty, score, keep, label):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 10)] + [(None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    docs = documents(spark, odd_rows(), ", y int, features string, score double")
    rows = score(docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["held_out"]} == {d for d, _, _ in odd_rows() if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    kept = keep(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum((r["predicted"] == 1) == (label == "quality") for r in rows)
    none = labels.limit(0)
    assert score(empty, none).collect() == [] and keep(empty, labels).collect() == []
    assert len({r["score"] for r in score(docs, none).collect()}) == 1


def test_labels_of_held_out_rows_teach_nothing(spark):
    d = SF
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from netsieve.llm.common import held_out
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, score_toxicity(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_chain_feeds_earlier_categories_forward():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 2))
    first = (x[:, 0] > 0).astype(float)
    targets = np.column_stack([first, first])
    chain = Chain(x, targets, np.arange(2000) % 5)
    assert len(chain.models[1].w) == len(chain.models[0].w) + 1
    assert ((chain.predict(x)[:, 1] > 0.5) == (first > 0)).mean() > 0.97
