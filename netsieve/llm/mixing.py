"""Mixing sources to target weights by weighted fair queueing (DataFrame only).

Every source is a flow. Its documents, shuffled by a keyed hash, queue up; a
document finishes at the virtual time ``cumulative source tokens / target``.
Serving all flows in order of virtual finish time until the total budget is
spent gives every source its share, whatever its document sizes are.

Sources that must repeat queue their documents once per epoch. No step sees one
source, or the global order, in one task: prefix sums run inside hash ranges of
about ``RANGE_ROWS`` documents and are shifted by the totals of earlier ranges,
themselves added up in heaps; rows alike are counted first and dealt out after; the
global order is cut by totals of virtual-time ranges, divided again where the
budget ends until few rows are left to sort.

Defined results: NULL text has size 0; NULL source is a source of its own, last;
documents of size 0 and sources without words take nothing; an empty table gives
an empty table; repeated rows queue one after the other; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from netsieve.llm.common import cut, hash60, read, word_count

# The weights of the sources in code point order, repeating; the
# share of all words that is mixed; how often a document may be taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2

RANGE_ROWS = 1000  # documents in one range of a prefix sum
FAN = 1000  # ranges added up in one heap


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: rows, source_size, weight, target.

    Targets are ``min(epochs * size, level * weight)`` where the level spends the
    budget exactly: what capped sources leave is shared by the others by weight.
    Sources are ordered by the level at which they reach their cap, so the
    number of capped ones is where the level of the rest first fits under it.
    """
    per = sizes.groupBy("source").agg(F.sum("n").alias("rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # windows without a key see one row per source, not the documents
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    w = ranked.withColumn("weight", weight)
    by_cap = W.orderBy(epochs * F.col("source_size") / F.col("weight"), F.col("rank"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    w = (w.withColumn("all", F.sum("source_size").over(everything))
          .withColumn("all_weight", F.sum("weight").over(everything))
          .withColumn("capped_size", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
          .withColumn("capped_weight", F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rest = share * F.col("all") - float(epochs) * F.col("capped_size")
    w = w.withColumn("level", rest / (F.col("all_weight") - F.col("capped_weight")))
    w = w.withColumn("fits", F.col("level") * F.col("weight") <= epochs * F.col("source_size"))
    # the first source that stays below its cap sets the level for itself and all after it
    first = F.min(F.when(F.col("fits"), F.struct(epochs * F.col("source_size") / F.col("weight"), F.col("rank"),
                                                 F.col("level").alias("level")))).over(everything)["level"]
    capped = epochs * F.col("source_size").cast("double")
    return w.withColumn("target", F.least(capped, F.coalesce(first * F.col("weight"), capped))).select(
        "source", "rows", "source_size", "weight", "target")


def before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """``totals`` (keys, range, words) with ``before``, the words of the key's earlier
    ranges: added up inside heaps of ``FAN`` ranges, then over the heaps."""
    t = totals.withColumn("heap", F.floor(F.col("range") / FAN))
    heap = t.groupBy(*keys, "heap").agg(F.sum("words").alias("all"))
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    heap = heap.withColumn("base", F.coalesce(F.sum("all").over(earlier(W.partitionBy(*keys, F.lit(1)).orderBy("heap"))), F.lit(0)))
    t = t.withColumn("inner", F.coalesce(F.sum("words").over(earlier(W.partitionBy(*keys, "heap").orderBy("range"))), F.lit(0)))
    same = " and ".join([f"t.{k} <=> h.{k}" for k in keys] + ["t.heap = h.heap"])
    return t.alias("t").join(heap.alias("h"), F.expr(same)).select(*[f"t.{c}" for c in totals.columns], (F.col("base") + F.col("inner")).alias("before"))


def virtual_times(sizes: DataFrame, targets: DataFrame, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document with ``v1 .. v<epochs>``, its virtual finish times. ``sizes``:
    doc_id, source, size, n (rows alike), key."""
    d = (sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source"))
         .select("d.doc_id", "d.source", "d.size", "d.n", "d.key", "t.source_size", "t.target",
                 F.floor(F.col("key") / float(1 << 60) * F.ceil(F.col("rows") / range_rows)).alias("range")))
    base = before(d.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words")), ["source"]).withColumnRenamed("before", "base")
    order = W.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = d.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
    shifted = inside.alias("i").join(base.alias("b"), F.expr("i.source <=> b.source and i.range = b.range"))
    # rows alike queue one after the other; their copies are dealt out in heaps
    heaps = (shifted.select("doc_id", "i.source", "size", "source_size", "target", "n", (F.col("base") + F.col("inside")).alias("upto"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(range_rows).cast("long"))).alias("heap"))
             .repartition(F.xxhash64("doc_id", "source", "size", "heap")))
    each = heaps.withColumn("place", F.explode(F.sequence(F.col("heap") + 1, F.least(F.col("heap") + range_rows, "n"))))
    cum = F.col("upto") + F.col("place") * F.col("size")
    finish = [F.when((F.col("size") > 0) & (F.col("target") > 0),
                     (e * F.col("source_size") + cum) / F.col("target")).alias(f"v{e + 1}") for e in range(epochs)]
    return each.select("doc_id", "source", "size", "source_size", "target", *finish)


def budget_end(times: DataFrame, share: float, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> tuple | None:
    """(edge, mark): the budget pays for all that finishes before the time ``edge``
    and, from then on, up to ``mark``, the last (virtual time, document, epoch) it
    pays for (None: nothing more). None where nothing is cut.

    The range in which the budget ends is divided into ranges again until it holds
    few rows, however unevenly the times lie; what reaches the driver is one row a
    turn."""
    served = times.select("doc_id", "size", F.posexplode(F.array(*[f"v{e + 1}" for e in range(epochs)])).alias("epoch", "v")).where("v is not null")
    rows, words = times.agg(F.count("*"), F.sum("size")).first()
    budget, parts = share * (words or 0), max(math.ceil(rows / range_rows), 2)
    lowest, highest, left = served.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not left:
        return None
    spent, within = 0, served
    while True:
        width = highest - lowest
        at = F.least(F.floor((F.col("v") - lowest) / width * parts), F.lit(parts - 1)) if width > 0 else F.lit(0)
        totals = within.groupBy(at.cast("long").alias("range")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("v").alias("lowest"), F.max("v").alias("highest"))
        totals = before(totals, []).withColumn("before", F.col("before") + spent).where(F.col("before") + F.col("words") > budget)
        first = totals.agg(F.min(F.struct("range", "before", "rows", "lowest", "highest")).alias("r")).first()["r"]
        if first is None:
            return None
        settled = first["rows"] == left
        spent, left, lowest, highest = first["before"], first["rows"], first["lowest"], first["highest"]
        within = served.where((F.col("v") >= lowest) & (F.col("v") <= highest))
        if left <= range_rows or settled:
            break
    # few rows, or rows of one and the same time
    upto = spent + F.sum("size").over(W.partitionBy(F.lit(1)).orderBy("v", "doc_id", "epoch").rowsBetween(W.unboundedPreceding, 0))
    mark = within.withColumn("upto", upto).where(F.col("upto") <= budget).agg(F.max(F.struct("v", F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "epoch"))).first()[0]
    return lowest, mark


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 42,
        range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
                .withColumn("key", hash60(F.lit(seed), F.col("doc_id"))))
    times = cut(virtual_times(sizes, source_targets(sizes, weights, share, epochs), epochs, range_rows))
    end = budget_end(times, share, epochs, range_rows)

    def pays(e: int) -> Column:
        v = F.col(f"v{e + 1}")
        if end is None:
            return v.isNotNull()
        edge, mark = end
        paid = v < edge
        if mark is not None:
            last = F.struct(F.lit(mark["v"]).alias("v"), F.lit(mark["doc_id"]).cast("long").alias("doc_id"), F.lit(mark["epoch"]).alias("epoch"))
            paid = paid | (F.struct(v.alias("v"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.lit(e).alias("epoch")) <= last)
        return F.coalesce(v.isNotNull() & paid, F.lit(False))

    paid = [pays(e) for e in range(epochs)]
    copies = sum((p.cast("long") for p in paid[1:]), paid[0].cast("long"))
    return (times.withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as the mix takes
    it. Rows alike in doc_id, source and size are taken alike."""
    plan = (mix(docs, **options).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
            .select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("copies").alias("p_copies")))
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("source").eqNullSafe(F.col("p_source")) & (word_count(F.col("text")) == F.col("p_size"))
    taken = docs.join(plan, same)
    return taken.select(*[F.col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("p_copies"))).alias("p_copy")).select(*docs.columns)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '~')), 1, 15) AS BIGINT) AS k FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM per),
lv AS (SELECT *, sum(source_size) OVER () AS al, sum(weight) OVER () AS aw,
         coalesce(sum(source_size) OVER (ORDER BY 2 * source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs,
         coalesce(sum(weight) OVER (ORDER BY 2 * source_size / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw FROM w),
l2 AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(al AS DOUBLE) - CAST(2.0 AS DOUBLE) * CAST(cs AS DOUBLE)) / (aw - cw) AS level FROM lv),
f AS (SELECT level FROM l2 WHERE level * weight <= 2 * source_size ORDER BY 2 * source_size / weight, rk LIMIT 1),
t AS (SELECT source, source_size, least(2.0 * CAST(source_size AS DOUBLE), coalesce((SELECT level FROM f) * weight, 2.0 * CAST(source_size AS DOUBLE))) AS target FROM w),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
s AS (SELECT doc_id, size, 0 AS epoch, CAST(cum AS DOUBLE) / target AS v FROM c WHERE size > 0 AND target > 0
      UNION ALL SELECT doc_id, size, 1, CAST(source_size + cum AS DOUBLE) / target FROM c WHERE size > 0 AND target > 0),
g AS (SELECT doc_id, size, sum(size) OVER (ORDER BY v, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM s),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM g WHERE upto <= 1.5 * (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT c.doc_id, c.size, c.source_size, c.target, coalesce(k.taken, 0) AS taken FROM c LEFT JOIN k ON c.doc_id = k.doc_id
"""
