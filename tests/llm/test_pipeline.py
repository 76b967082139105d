"""The pipeline against a plain Python version of its deterministic stages."""

import hashlib
from collections import Counter

import corpus_pipeline
from netsieve.llm.common import read
from netsieve.llm.packing import cuts
from netsieve.llm.quality import score_quality
from netsieve.llm.tokens import vocabulary
from netsieve.llm.toxicity import score_toxicity
from tests.llm.test_text_operators import DOCS, brute_components, check_packed, odd_rows

SF = "/root/testdata/sf0.01"


def plain_mix(rows):
    """rows: (doc_id, text, source); copies of each document, one queue for all."""
    size = {d: len((t or "").encode().split()) for d, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[d] for d, _, x in rows if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    budget, open_, target = 1.5 * sum(whole.values()), set(sources), {}
    left = budget
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * whole[s]}
        for s in over or open_:
            target[s] = 2.0 * whole[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    queue = []
    for s in sources:
        mine = sorted((int(hashlib.md5(f"42|{d}".encode()).hexdigest()[:15], 16), d) for d, _, x in rows if x == s)
        for epoch in (0, 1):
            upto = epoch * whole[s]
            for _, d in mine:
                upto += size[d]
                if size[d] and target[s]:
                    queue.append((upto / target[s], d, epoch))
    copies, spent = Counter(), 0
    for _, d, _ in sorted(queue):
        spent += size[d]
        if spent > budget:
            break
        copies[d] += 1
    return copies


def test_pipeline_equals_its_plain_version(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    rows = {r["doc_id"]: r for r in docs.collect()}
    good = {r["doc_id"] for r in score_quality(docs, labels).where("score >= 0.7").collect()}
    left = docs.where(docs["doc_id"].isin(sorted(good)))
    clean = {r["doc_id"] for r in score_toxicity(left, labels).where("score < 0.5").collect()}
    component = brute_components([(d, rows[d]["text"]) for d in sorted(clean)], 5, 80)
    kept = sorted(d for d, c in component.items() if d == c)
    assert len(rows) > len(good) > len(clean) > len(kept) > 300
    copies = plain_mix([(d, rows[d]["text"], rows[d]["source"]) for d in kept])
    tok = vocabulary("byte_bpe_50k.json")
    want = Counter()
    for d, n in copies.items():
        ids = len(tok.encode(rows[d]["text"] or "", add_special_tokens=False).ids) + 1
        for k, (s, m) in enumerate(cuts(ids)):
            want[(d, k, s, m)] += n
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got) == want
    check_packed(got)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    odd = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in odd_rows()], DOCS)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
