"""Token-id store: documents as separately compressed id arrays.

Ids are written as little-endian unsigned integers of the least width that holds
the vocabulary. All documents are compressed with one shared zstandard dictionary,
trained on serialised id arrays, so that short documents compress well on their
own and one can be read without its neighbours.

Layout of a store (a folder Spark writes and reads):

* ``dictionary``: one row (hash, bytes, id_bytes)
* ``shards``: rows (part, seq, first_id, last_id, n_docs, n_tokens, blob) in
  ascending order of (part, seq) and of the documents' ids.

A blob is ``MAGIC``, the dictionary's SHA-256, id width and document count, then
the offset index (doc ids, presence bits, token counts, frame offsets) and the
frames. A frame is found from the index alone; a reader with another dictionary
is refused. Shards end at about ``SHARD_BYTES`` of frames.

Executors can be lost at any time: tasks only return rows, and Spark's commit
protocol writes them.

Defined results: NULL or empty text is the end id alone; a NULL doc_id sorts
first; repeated rows are kept, in order of id, length and checksum; an empty
table gives a store without shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from netsieve.llm.common import cut, read, task, with_workers
from netsieve.llm.tokens import encoder
from netsieve.session import checkpoint_dir

MAGIC = b"NSIDS001"
HEAD = struct.Struct("<8s32sII")
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
DICTIONARY_BYTES = 64 * 1024
SAMPLE_DOCS = 1000  # documents the dictionary is trained on
SAMPLE_BYTES = 16 * 1024  # of each sampled document's ids, in SAMPLE_BLOCKS blocks
SAMPLE_BLOCKS = 4
SHARD_BYTES = 1 << 20
LEVEL = 3


def id_width(vocabulary_size: int) -> int:
    return 2 if vocabulary_size <= 1 << 16 else 4


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary of the serialised arrays. With too few to train on, their
    bytes themselves serve as a raw dictionary."""
    import zstandard

    total = sum(map(len, arrays))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:size] or b"\0" * 8


def sample_arrays(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, sample_docs: int = SAMPLE_DOCS) -> list[bytes]:
    """Serialised ids of the ``sample_docs`` documents with the least id hashes."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    rows = encoded(texts, tokenizer, spaced, end_id, None)
    # blocks from the whole array, at even distances
    size, block = F.octet_length("frame"), SAMPLE_BYTES // SAMPLE_BLOCKS
    at = lambda k: (F.floor((size - block) * k / (SAMPLE_BLOCKS - 1) / 4) * 4).cast("int") + 1
    blocks = F.concat(*[F.substring(F.col("frame"), at(k), F.lit(block)) for k in range(SAMPLE_BLOCKS)])
    some = F.when(size <= SAMPLE_BYTES, F.col("frame")).otherwise(blocks)
    # of rows that share an id, one by its content
    one = rows.groupBy("doc_id").agg(F.min(F.struct("n_tokens", "ids_crc32", some.alias("ids"))).alias("r"))
    return [bytes(r["ids"]) for r in one.orderBy("doc_id").select("r.ids").collect() if r["ids"]]


def encoded(docs: DataFrame, tokenizer: str, spaced: bool, end_id: int, dictionary: bytes | None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and the compressed frame (without a
    dictionary: the serialised ids)."""
    @task
    def run(batches):
        import zstandard

        enc = encoder(tokenizer, spaced)
        width = f"<u{id_width(enc.tok.get_vocab_size())}"
        packer = None
        if dictionary:
            shared = zstandard.ZstdCompressionDict(dictionary)
            shared.precompute_compress(level=LEVEL)  # digested once, not for each document
            packer = zstandard.ZstdCompressor(dict_data=shared, write_content_size=True)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                some = batch.slice(lo, 4000)
                n, crc, frames = [], [], []
                for ids in enc.encode([t or "" for t in some.column(1).to_pylist()]):
                    ids = np.concatenate((ids, end))
                    raw = ids.astype(width).tobytes()
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.tobytes()))
                    frames.append(packer.compress(raw) if packer else raw)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frames, pa.binary())],
                    names=["doc_id", "n_tokens", "ids_crc32", "frame"])

    src = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, frame binary")


def pack_shard(doc_ids: list, n_tokens: list[int], frames: list[bytes], digest: bytes, width: int) -> bytes:
    """The bytes of one shard."""
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    known = np.packbits(np.array([d is not None for d in doc_ids], bool)).tobytes()
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    return b"".join([HEAD.pack(MAGIC, digest, width, len(frames)), ids.tobytes(), known,
                     np.array(n_tokens, "<u4").tobytes(), offsets.tobytes(), *frames])


class Shard:
    """Reads one shard; ``ids(k)`` decompresses the k-th document only."""

    def __init__(self, blob: bytes, dictionary: bytes):
        import zstandard

        magic, digest, self.width, n = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard of a token-id store")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = HEAD.size
        ids = np.frombuffer(blob, "<i8", n, at)
        at += 8 * n
        known = np.unpackbits(np.frombuffer(blob, "u1", (n + 7) // 8, at), count=n).astype(bool)
        at += (n + 7) // 8
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.n_tokens = np.frombuffer(blob, "<u4", n, at)
        at += 4 * n
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at).astype(np.int64)
        self.base, self.blob = at + 8 * (n + 1), blob
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def ids(self, k: int) -> np.ndarray:
        a, b = self.base + int(self.offsets[k]), self.base + int(self.offsets[k + 1])
        return np.frombuffer(self.unpacker.decompress(self.blob[a:b]), f"<u{self.width}").astype("<u4")


def shards_of(rows: DataFrame, digest: bytes, width: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of the frames in each partition, in the partition's order."""
    @task
    def run(batches) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, n, frames, size = [], [], [], 0

        def shard():
            known = [d for d in ids if d is not None]
            cols = [[part], [seq], [min(known, default=None)], [max(known, default=None)], [len(ids)], [sum(n)], [pack_shard(ids, n, frames, digest, width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["part", "seq", "first_id", "last_id", "n_docs", "n_tokens", "blob"])

        for batch in batches:
            for d, k, f in zip(*(batch.column(c).to_pylist() for c in range(3))):
                ids.append(d)
                n.append(k)
                frames.append(f)
                size += len(f)
                if size >= shard_bytes:
                    yield shard()
                    ids, n, frames, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    return rows.mapInArrow(run, "part int, seq int, first_id long, last_id long, n_docs long, n_tokens long, blob binary")


def write_store(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, spaced: bool = False, end_id: int = END_ID,
                shard_bytes: int = SHARD_BYTES, sample_docs: int = SAMPLE_DOCS) -> None:
    """Write the store of ``docs`` (doc_id, text) to the folder ``path``."""
    from netsieve.llm.tokens import vocabulary

    spark = docs.sparkSession
    dictionary = train_dictionary(sample_arrays(docs, tokenizer, spaced, end_id, sample_docs))
    digest, width = hashlib.sha256(dictionary).digest(), id_width(vocabulary(tokenizer).get_vocab_size())
    # texts are read and encoded once; only compressed frames are sorted
    frames = cut(encoded(docs, tokenizer, spaced, end_id, dictionary))
    ordered = frames.repartitionByRange("doc_id", "n_tokens", "ids_crc32").sortWithinPartitions("doc_id", "n_tokens", "ids_crc32")
    shards_of(ordered.select("doc_id", "n_tokens", "frame"), digest, width, shard_bytes).write.mode("errorifexists").parquet(f"{path}/shards")
    spark.createDataFrame([(digest, dictionary, width)], "hash binary, bytes binary, id_bytes int").coalesce(1).write.mode("errorifexists").parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a store: part, seq, k (place in the shard), doc_id, n_tokens,
    ids_crc32 (and ids). With ``doc_ids`` only their shards are read and only
    their frames decompressed."""
    dictionary = _dictionary(spark, path)
    wanted = None if doc_ids is None else set(doc_ids)

    @task
    def run(batches):
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                s = Shard(blob, dictionary)
                places = [k for k, d in enumerate(s.doc_ids) if wanted is None or d in wanted]
                got = [s.ids(k) for k in places]
                cols = [pa.array([part] * len(places), pa.int32()), pa.array([seq] * len(places), pa.int32()), pa.array(places, pa.int32()),
                        pa.array([s.doc_ids[k] for k in places], pa.int64()), pa.array([len(g) for g in got], pa.int64()),
                        pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64())]
                if with_ids:
                    cols.append(pa.array([g.astype("<i4") for g in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "seq", "k", "doc_id", "n_tokens", "ids_crc32", "ids"][:len(cols)])

    shards = spark.read.parquet(f"{path}/shards")
    if wanted is not None:
        shards = shards.where(f"last_id >= {min(wanted)} and first_id <= {max(wanted)}") if wanted else shards.limit(0)
    kinds = "part int, seq int, k int, doc_id long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return with_workers(shards.select("part", "seq", "blob")).mapInArrow(run, kinds)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files. ``start`` adds up
    the shards' totals first: by part, then inside each part, then inside each
    shard, so that no task sees more than a part's shards or a shard's documents."""
    shards = spark.read.parquet(f"{path}/shards").select("part", "seq", F.col("n_tokens").alias("total"))
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("total").alias("part_total"))
    parts = parts.select("part", F.coalesce(F.sum("part_total").over(upto(W.orderBy("part"))), F.lit(0)).alias("part_start"))
    base = shards.select("part", "seq", F.coalesce(F.sum("total").over(upto(W.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("in_part"))
    base = base.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("in_part")).alias("base"))
    docs = read_store(spark, path, with_ids=False)
    inside = F.coalesce(F.sum("n_tokens").over(upto(W.partitionBy("part", "seq").orderBy("k"))), F.lit(0))
    docs = docs.withColumn("inside", inside).join(base, ["part", "seq"])
    return docs.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex}"
    write_store(read(spark, sf_dir, "documents"), path)
    return document_starts(spark, path)
