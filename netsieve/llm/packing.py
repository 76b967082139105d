"""Best-fit packing of documents into fixed-length training sequences.

Documents are tokenised, closed with an end id, and only those longer than a
sequence are cut. Pieces are then packed best-fit decreasing: the longest first,
each into the open sequence with the least room that still holds it. A segment
tree over remaining capacities finds that sequence in logarithmic time.

Packing runs in hash groups of about ``GROUP_PIECES`` pieces, one task each (copies
of one row go to different groups); a
group wastes room in its last few sequences only, which at this size is less than
one sequence in a thousand. Full pieces need no search and no company. Only ids
and lengths are shuffled; token ids are counted and checksummed where the text is
read, and written out by ``sequences`` when a caller wants them.

Defined results: NULL or empty text is the end id alone; repeated rows are packed
as often as they occur; ties go by doc_id, then piece; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import cut, read, task, with_workers
from netsieve.llm.tokens import encoder

SEQUENCE = 2048  # tokens in a sequence
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
GROUP_PIECES = 20_000
# what a worker holds while it tokenises: chunks kept, and documents handled at once
CHUNKS_KEPT = 400_000
BATCH_DOCS = 1000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Capacities:
    """Open bins by remaining capacity: a segment tree whose leaf ``c`` counts
    the open bins with ``c`` tokens left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, bin_: int) -> None:
        self.bins[left].append(bin_)
        i = left + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Take out the bin with the least room that is at least ``need``."""
        count, i = self.count, need + self.size
        while not count[i]:
            # go up while this is a right child or nothing lies to the right
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        left = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return left, self.bins[left].pop()


def best_fit(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths must be given in falling order."""
    open_, used = Capacities(capacity), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        got = open_.tightest(n)
        if got is None:
            got, used = (capacity, used), used + 1
        left, b = got
        bins[k], offsets[k] = b, capacity - left
        if left > n:
            open_.add(left - n, b)
    return bins, offsets


def cuts(n: int, capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all full but
    the first, which takes what is left over."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def tokenised_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, spaced: bool = True, end_id: int = END_ID,
                     capacity: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    @task
    def encode(batches):
        enc = encoder(tokenizer, spaced, CHUNKS_KEPT)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                some = batch.slice(lo, BATCH_DOCS)
                rows = ([], [], [], [], [], [])
                for doc_id, ids in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()])):
                    ids = np.concatenate((ids, end))
                    for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                        part = ids[s:s + n]
                        for column, v in zip(rows, (doc_id, k, s, n, zlib.crc32(part.tobytes()), part)):
                            column.append(v)
                cols = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
                if with_ids:
                    cols.append(pa.array([r.astype("<i4") for r in rows[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    src = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return src.mapInArrow(encode, PIECES + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` is read twice."""
    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = best_fit(t["length"].to_numpy(), capacity)
        ids = t["group"].to_numpy() * (1 << 32) + bins
        return t.drop_columns(["group"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    row = [c.split()[0] for c in PIECES.split(", ")]
    # repeated rows are counted, and their copies numbered and dealt out like others
    counted = pieces.groupBy(*row).agg(F.count("*").alias("copies"))
    heaps = counted.withColumn("heap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(group_pieces).cast("long"))))
    heaps = heaps.repartition(F.xxhash64(*row, "heap"))
    upto = F.least(F.col("heap") + group_pieces, "copies") - 1
    copies = heaps.select(*row, F.explode(F.sequence(F.col("heap"), upto)).alias("copy"))
    groups = pieces.agg(F.greatest(F.ceil(F.count("*") / group_pieces), F.lit(1)).alias("groups"))
    keyed = copies.crossJoin(F.broadcast(groups)).withColumn("group", F.pmod(F.xxhash64(*row, "copy"), F.col("groups"))).drop("groups", "copy")
    out = PIECES + ", sequence_id long, offset long"
    return keyed.groupBy("group").applyInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, spaced: bool = True, end_id: int = END_ID,
                   capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    return pack(cut(tokenised_pieces(docs, tokenizer, spaced, end_id, capacity)), capacity, group_pieces)


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str = TOKENIZER, spaced: bool = True, end_id: int = END_ID,
              capacity: int = SEQUENCE) -> DataFrame:
    """The packed sequences: sequence_id, ids. A group is one sequence of at
    most ``capacity`` ids."""
    ids = tokenised_pieces(docs, tokenizer, spaced, end_id, capacity, with_ids=True)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ids = ids.groupBy(*same).agg(F.first("ids").alias("ids"))
    placed = packed.alias("p").join(ids.alias("i"), F.expr(" and ".join(f"p.{c} <=> i.{c}" for c in same)))
    return placed.groupBy("p.sequence_id").agg(F.array_sort(F.collect_list(F.struct("p.offset", "i.ids"))).alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
