"""SentencePiece (BPE with byte fallback) encoding and decoding of whole texts.

A text's words (a run of spaces with what follows it) never share a piece, so
each distinct word is encoded once per worker, many at a time, in rounds over one
flat array of symbols:

* every pair of neighbouring symbols of a word looks up the rank of the piece it
  makes and the least rank of any piece that could ever span it;
* the leftmost pair of least rank of each word merges (a segmented minimum), and so
  does every other pair that nothing of a better rank can take a symbol from: all
  pieces that could span its left edge have a worse rank, and all that could span
  its right edge none better. Merging these early changes no later choice, so the
  result is that of merging one best pair after the other;
* merged symbols are compacted, and words without pairs leave the array.

So the number of rounds follows the depth of the merges, not the length of a word.
Characters without a piece become their UTF-8 bytes.

Defined results: NULL text is empty, and encodes to the begin and end ids alone;
repeated rows and NULL ids give a row each; an empty table gives an empty table;
other columns are ignored. Models that normalise text, or are not BPE with byte
fallback, are refused.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsieve.llm.common import kept, read, task, with_workers

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # fixed value: how pieces write a space
CACHE_WORDS, CACHE_CHARS = 500_000, 16_000_000  # distinct words a worker keeps
PART_CHARS = 2_000_000  # characters handled at once
NO_RANK = np.int64(1) << 40
FEW_ROUNDS = 8  # long words take more; only then the wider rule pays
_RUN = re.compile(" +[^ ]*")


def _clamped(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``x[k] = min(high[k], max(low[k], x[k - 1]))`` from 0 on, by doubling: limits
    one after the other are limits again."""
    low, high, step = low.copy(), high.copy(), 1
    while step < len(low):
        a, b = low[:-step].copy(), high[:-step].copy()
        low[step:], high[step:] = np.minimum(high[step:], np.maximum(low[step:], a)), np.minimum(high[step:], np.maximum(low[step:], b))
        if (low == high).all():
            break
        step *= 2
    return low


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        head = varint()
        kind = head & 7
        if kind == 0:
            value = varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            value, at = raw[at:at + n], at + n
        yield head >> 3, value


class Model:
    """Pieces of a model file and the table of symbol pairs."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        path = name if os.sep in name else public_tokenizers.path(name)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = {1: [], 2: {}, 3: {}}
        for number, value in _fields(sp.serialized_model_proto()):
            if number in (2, 3):
                spec[number] = dict(_fields(value))
        trainer, normalizer = spec[2], spec[3]
        if trainer.get(3) != 2 or not trainer.get(35) or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError(f"{path}: not a BPE model with byte fallback and unchanged text")
        self.prefix = bool(normalizer.get(3, 1))
        self.size, self.bos, self.eos = sp.vocab_size(), sp.bos_id(), sp.eos_id()
        ids = range(self.size)
        self.text = [sp.id_to_piece(i) for i in ids]
        self.byte = np.zeros(256, np.int64)
        self.raw: list[bytes] = []  # what each id decodes to
        self.is_byte = [sp.is_byte(i) for i in ids]
        plain = []
        for i in ids:
            if self.is_byte[i]:
                value = int(self.text[i][1:-1], 16)
                self.byte[value] = i
                self.raw.append(bytes([value]))
            elif sp.is_control(i):
                self.raw.append(b"")
            elif sp.is_unknown(i):
                self.raw.append(" ⁇ ".encode())
            else:
                plain.append(i)
                self.raw.append(self.text[i].replace(SPACE, " ").encode())
        piece = {self.text[i]: i for i in plain}
        self.char = np.arange(0x110000, dtype=np.int64) + self.size  # symbols beyond the pieces: characters
        for t, i in piece.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        # words are cut at spaces, and at line ends where no piece holds one
        if any(SPACE in t.lstrip(SPACE) for t in piece):
            raise ValueError(f"{path}: pieces that run across words")
        self.lines = not any("\n" in t for t in piece)
        self._pairs(piece, [sp.get_score(i) for i in ids])

    def _pairs(self, piece: dict[str, int], scores: list[float]) -> None:
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in piece.values()}, reverse=True))}
        span: dict[int, int] = {}
        seen: set[str] = set()
        for t, i in sorted(piece.items(), key=lambda e: order[scores[e[1]]]):
            rank = order[scores[i]]
            for a in range(len(t) - 1):
                for b in range(a + 2, len(t) + 1):
                    part = t[a:b]
                    if part not in seen:  # pieces come best first
                        seen.add(part)
                        for c in range(1, b - a):
                            left = piece.get(part[:c])
                            right = piece.get(part[c:])
                            if left is not None and right is not None:
                                span[left << 32 | right] = rank
        keys = np.fromiter(span, np.int64, len(span))
        sort = np.argsort(keys)
        self.keys, self.span = keys[sort], np.fromiter(span.values(), np.int64, len(span))[sort]
        made = [piece.get(self.text[k >> 32] + self.text[k & 0xFFFFFFFF], -1) for k in self.keys.tolist()]
        self.made = np.array(made, np.int64)
        self.rank = np.array([NO_RANK if m < 0 else order[scores[m]] for m in made], np.int64)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        text = "".join(words)
        sym = self.char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rounds = 0
        while len(sym) > 1:
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.where(known, self.rank[at], NO_RANK)
            pair = np.flatnonzero(rank < NO_RANK)
            if not len(pair):
                break
            span = np.full(len(sym) + 1, NO_RANK)
            span[1:-1][known] = self.span[at[known]]
            safe = pair[(span[pair] > rank[pair]) & (span[pair + 2] >= rank[pair])]
            rounds += 1
            if rounds > FEW_ROUNDS:
                safe = np.concatenate((safe, self._more(sym, at, rank, span, pair, safe)))
            # the leftmost pair of least rank of each word
            new = np.flatnonzero(np.diff(word[pair], prepend=-1))
            least = np.minimum.reduceat(rank[pair] * len(sym) + pair, new) % len(sym)
            take = np.zeros(len(sym), bool)
            take[safe] = True
            take[least] = True
            here = np.flatnonzero(take)
            sym[here] = self.made[at[here]]
            stay = np.ones(len(sym), bool)
            stay[here + 1] = False
            alive = np.zeros(len(words), bool)
            alive[word[here]] = True
            active = alive[word]
            if 2 * np.count_nonzero(active) < len(sym):
                out = stay & ~active
                done.append((word[out], sym[out]))
                stay &= active
            sym, word = sym[stay], word[stay]
        done.append((word, sym))
        word, sym = (np.concatenate(p) for p in zip(*done))
        order = np.argsort(word, kind="stable")
        return self._with_bytes(word[order], sym[order], len(words))

    def _least_span(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.span[at], NO_RANK)

    def _more(self, sym: np.ndarray, at: np.ndarray, rank: np.ndarray, span: np.ndarray, pair: np.ndarray, safe: np.ndarray) -> np.ndarray:
        """Those of ``pair`` that may merge in this round, by a wider rule. ``span[k]`` belongs
        to the edge before symbol k.

        While a pair of rank r waits, its word merges nothing worse than r. An edge
        whose far symbol is whole is crossed by its own pair, or once its near
        symbol has gone into something on that side: the worst rank this takes is at
        least ``min(own, max(span, the next edge's))``. Pairs whose edges take
        worse than r wait until they merge. Of neighbouring pairs of one rank the
        first, third, ... merge. In all cases nothing that spans the edges of the
        new symbol may have a better rank."""
        own = np.full(len(sym) + 1, NO_RANK)
        own[1:-1] = rank
        before, behind = _clamped(span, own), _clamped(span[::-1], own[::-1])[::-1]
        r = rank[pair]
        pick = pair[(before[pair] >= r) & (behind[pair + 2] >= r)]
        if not len(pick):
            return pick
        # neighbours among them have one rank; a row of them counts from its first
        head = np.diff(pick, prepend=-2) != 1
        row = np.cumsum(head) - 1
        first = pick[head]
        sound = before[first] > rank[first]
        pick = pick[sound[row] & ((pick - first[row]) % 2 == 0)]
        for _ in range(2):
            if not len(pick):
                return pick
            taken = np.full(len(sym) + 3, -1)  # what a pair taken at k - 1 makes
            taken[pick + 1] = self.made[at[pick]]
            taken[safe + 1] = self.made[at[safe]]
            r, made = rank[pick], self.made[at[pick]]
            left = np.where(pick > 0, sym[pick - 1], -1)
            right = np.where(pick + 2 < len(sym), sym[np.minimum(pick + 2, len(sym) - 1)], -1)
            held = np.where(pick > 1, taken[pick - 1], -1)  # made by the pair two places before
            good = ((self._least_span(left, made) > r) & (self._least_span(held, made) > r) & (self._least_span(held, sym[pick]) > r)
                    & (self._least_span(made, right) >= r) & (self._least_span(made, taken[np.minimum(pick + 3, len(taken) - 1)]) >= r))
            if good.all():
                return pick
            # a row ends with the first pair that fails
            row = np.cumsum(np.diff(pick, prepend=-9) != 2) - 1
            bad = np.flatnonzero(~good)
            ends = np.full(row[-1] + 1, len(pick))
            np.minimum.at(ends, row[bad], bad)
            pick = pick[np.arange(len(pick)) < ends[row]]
        return pick

    def _with_bytes(self, word: np.ndarray, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        other = np.flatnonzero(sym >= self.size)
        if len(other):
            code = sym[other] - self.size
            raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            width = np.ones(len(sym), np.int64)
            width[other] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            as_byte = np.repeat(sym >= self.size, width)
            sym, word = np.repeat(sym, width), np.repeat(word, width)
            sym[as_byte] = self.byte[raw]
        return sym, np.bincount(word, minlength=n)


class PieceEncoder:
    """``encode(texts)`` gives one uint32 array of ids per text, begin and end ids
    included; ``decode(ids)`` gives the text back."""

    def __init__(self, name: str = MODEL):
        self.model = Model(name)
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.chars = 0
        self.ids, self.starts, self.lengths = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _words(self, t: str) -> list[str]:
        """Words as they are numbered: one that begins with a space or a line end
        stands for itself, another for itself after a space."""
        if not t:
            return []
        t = t.replace(SPACE, " ")
        if self.model.prefix and t[0] not in " \n":
            plain = t.replace("\n", " \n") if self.model.lines else t
            if "  " not in plain and plain[-1] != " " and (self.model.lines or "\n" not in t):
                return plain.split(" ")
        if self.model.prefix:
            t = " " + t
        first = re.match("[^ ]*", t)[0]
        # without a prefix the first word has no space: a line end, which no word holds then, marks it
        return ([first] if first else []) + _RUN.findall(t)

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        codes, new, rows = self.codes, [], []
        for t in texts:
            row = []
            for w in self._words(t):
                code = codes.get(w)
                if code is None:
                    code = codes[w] = len(codes)
                    new.append(w)
                row.append(code)
            rows.append(np.array(row, np.int64))
        if new:
            self.chars += sum(map(len, new))
            ids, lengths = self.model.merged([(w if w[:1] in (" ", "\n") else " " + w).replace(" ", SPACE) for w in new])
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, ids.astype("<u4")))
        out = []
        ends = np.array([self.model.eos], "<u4")
        for row in rows:
            n = self.lengths[row]
            upto = np.cumsum(n)
            total = int(upto[-1]) if len(upto) else 0
            at = np.repeat(self.starts[row] - (upto - n), n) + np.arange(total)
            out.append(np.concatenate((np.array([self.model.bos], "<u4"), self.ids[at], ends)))
        if len(codes) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._clear()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, part, chars = [], [], 0
        for t in texts:
            part.append(t)
            chars += len(t)
            if chars >= PART_CHARS:
                out += self._part(part)
                part, chars = [], 0
        return out + (self._part(part) if part else [])

    def decode(self, ids) -> str:
        raw, m = self.model.raw, self.model
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        # the space of the prefix, if the first piece that gives text begins with it
        first = next((k for k, i in enumerate(ids) if raw[i]), None)
        parts = [raw[i] for i in ids]
        if first is not None and m.prefix and m.text[ids[first]].startswith(SPACE):
            parts[first] = parts[first][1:]
        if all(raw[i] for i in ids[1:-1]):  # a control id ends a run of bytes
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        return self._decode_bytes(ids, parts)

    def _decode_bytes(self, ids: list[int], parts: list[bytes]) -> str:
        """Bytes that make no character become a replacement character each."""
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at:at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i, p in zip(ids, parts):
            if self.model.is_byte[i]:
                run += p
            else:
                flush()
                out.append(p.decode())
        flush()
        return "".join(out)


def piece_encoder(name: str) -> PieceEncoder:
    """The worker's encoder: its words serve all tasks it runs in a row."""
    return kept(f"pieces {name}", lambda: PieceEncoder(name))


def encoded(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids of each text."""
    @task
    def run(batches):
        enc = piece_encoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                ids = enc.encode([t or "" for t in some.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    src = with_workers(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return src.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows of ids (doc_id, ids)."""
    @task
    def run(batches):
        enc = piece_encoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                texts = [None if i is None else enc.decode(i) for i in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return with_workers(ids.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to. Ids
    are encoded, digested and decoded where the text is read: none is shuffled."""
    @task
    def run(batches):
        enc = piece_encoder(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                n, of_ids, of_text = [], [], []
                for ids in enc.encode([t or "" for t in some.column(1).to_pylist()]):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    of_text.append(hashlib.sha256(enc.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    src = with_workers(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_digests(read(spark, sf_dir, "documents"))
