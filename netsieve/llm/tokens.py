"""Token ids of whole texts with a public tokenizer, chunk results cached.

A byte-level or word BPE never merges across the start of a word, so a text can
be cut before a space, at a line end and before a closing comma or full stop, and
each distinct chunk encoded once per worker. Cuts are made only where they cannot
change the result; texts with runs of white space in which a cut would show, or
with the string of a special token, are encoded whole. New chunks are encoded many at a time; where the ids of each begin
is read off the leading spaces, or off a special token put between them.
"""

from __future__ import annotations

import os
import re

import numpy as np

from netsieve.llm.common import kept

CACHE_ENTRIES = 1_000_000  # chunks kept per worker, those met first: about 200 MB
PART_CHARS = 1_000_000  # characters handled at once, whatever an Arrow batch holds
JOINED = 1_000  # chunks encoded in one call

# white space other than single spaces and line ends between words: texts with
# any of it are encoded whole
_ODD = re.compile("[\t\r\f\v\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")


def _plain(t: str) -> bool:
    return not ("  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[:1] == "\n" or t[-1:] in ("\n", " ") or _ODD.search(t))


# letters whose lower case is one letter of the same range, and which no
# normalisation touches: for texts of these, lower-casing can come first
_EXOTIC = re.compile("[^\x00-\u012f\u0131-\u0137\u0139-\u0148\u014a-\u017e]")


def vocabulary(name: str):
    """The tokenizer in a file: a path, or a name known to public_tokenizers."""
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_file(name if os.sep in name else public_tokenizers.path(name))


_CLOSE = ",."


class _Codes(dict):
    """Numbers chunks in the order they are met; ``new`` has those without ids."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        code = self[chunk] = len(self)
        self.new.append(chunk)
        return code


class Encoder:
    """``encode(texts)`` gives one uint32 array of ids per text.

    ``spaced``: a space belongs to the token that follows it (byte-level BPE);
    otherwise white space only separates tokens.

    A chunk's first character says where it stood: a line end, a carriage return
    for the start of the text (no text that is cut contains one), else a space,
    which is left out."""

    def __init__(self, name: str, spaced: bool, entries: int = CACHE_ENTRIES):
        self.tok, self.spaced, self.entries = vocabulary(name), spaced, entries
        special = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.mark_id, self.mark = max(special.items())
        self.specials = tuple(special.values())
        self.special = re.compile("|".join(map(re.escape, self.specials)), re.IGNORECASE)
        self.heads = {h for s in self.specials for h in (s[0].lower(), s[0].upper())}
        self.close = dict(zip(_CLOSE, self._single(list(_CLOSE))))
        # byte-level BPE writes a leading space as U+0120
        self.opens = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.opens[[i for t, i in self.tok.get_vocab().items() if t.startswith("\u0120")]] = True
        self.codes = _Codes()
        # ids of all numbered chunks one after the other, and where each begins
        self.ids, self.starts, self.lengths = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _single(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(chunks, add_special_tokens=False)]

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks from one call."""
        if self.spaced:
            got = self.tok.encode_batch_fast([[" " + c for c in chunks]], is_pretokenized=True, add_special_tokens=False)[0].ids
            ids = np.asarray(got, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            ends = np.append(starts[1:], len(ids))
        else:
            if any(s[:2] in c for s in self.specials for c in chunks if s[:2] in c):
                return self._single(chunks)
            ids = np.asarray(self.tok.encode(self.mark.join(chunks), add_special_tokens=False).ids, "<u4")
            marks = np.flatnonzero(ids == self.mark_id)
            starts, ends = np.concatenate(([0], marks + 1)), np.append(marks, len(ids))
        if len(starts) != len(chunks):  # a chunk that looks like two: one by one
            return self._single([" " + c for c in chunks] if self.spaced else chunks)
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), ends.tolist())]

    def _learn(self) -> None:
        """Ids of the chunks numbered last, in their order."""
        codes, new = self.codes, self.codes.new
        closed, lines, plain, k = [], [], [], 0
        while k < len(new):
            c = new[k]
            if c[-1:] in _CLOSE and "A" <= c[-2:-1] < "\u0130" and c[-2].isalpha():
                # a comma or full stop after a letter is a token of its own
                closed.append(c)
                codes[c[:-1]]  # numbered and appended to ``new`` if need be
            elif self.spaced and c[:1] in ("\n", "\r"):
                lines.append(c)
            else:
                plain.append(c)
            k += 1
        got: dict[str, bytes] = dict(zip(lines, self._single([c.lstrip("\r") for c in lines])))
        for lo in range(0, len(plain), JOINED):
            part = plain[lo:lo + JOINED]
            got.update(zip(part, self._joined(part)))
        for c in closed:
            stem = got.get(c[:-1])
            if stem is None:
                at = codes[c[:-1]]
                stem = self.ids[self.starts[at]:self.starts[at] + self.lengths[at]].tobytes()
            got[c] = stem + self.close[c[-1]]
        found = [got[c] for c in new]
        lengths = np.array([len(f) // 4 for f in found], np.int64)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, np.frombuffer(b"".join(found), "<u4")))

    def _forget(self) -> None:
        """Keep the chunks that were met first."""
        if len(self.codes) > self.entries:
            over = len(self.codes) - self.entries
            for c in self.codes.new[-over:] if over <= len(self.codes.new) else list(self.codes)[self.entries:]:
                del self.codes[c]
            self.starts, self.lengths = self.starts[:self.entries], self.lengths[:self.entries]
            self.ids = self.ids[:int(self.starts[-1] + self.lengths[-1])]
        self.codes.new.clear()

    def _special(self, t: str) -> bool:
        """Whether a special token is written out in the text, in any case: such
        texts are encoded whole, since the tokenizer looks for them first."""
        return any(h in t for h in self.heads) and bool(self.special.search(t))

    def _part(self, texts: list[str]) -> list[np.ndarray]:
        number = self.codes.__getitem__
        whole, codes = [], []
        for t in texts:
            if self._special(t):
                chunks = []
            elif not self.spaced:
                chunks = (t if _EXOTIC.search(t) else t.lower()).replace("\n", " ").split(" ")
            elif _plain(t):
                chunks = ("\r" + t).replace("\n", " \n").split(" ")
            else:
                chunks = []
            whole.append(not chunks)
            codes.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        if self.codes.new:
            self._learn()
        ends = np.cumsum([len(c) for c in codes])
        flat = np.concatenate(codes)
        lengths = self.lengths[flat]
        upto = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.ids[np.repeat(self.starts[flat] - upto[:-1], lengths) + np.arange(upto[-1])]
        bounds = upto[np.concatenate(([0], ends))].tolist()
        out = [np.asarray(self.tok.encode(t, add_special_tokens=False).ids, "<u4") if w else ids[a:b]
               for t, w, a, b in zip(texts, whole, bounds[:-1], bounds[1:])]
        self._forget()
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


def encoder(name: str, spaced: bool, entries: int = CACHE_ENTRIES) -> Encoder:
    """The worker's encoder: its chunks, ``entries`` at most between parts, serve all
    tasks it runs in a row."""
    return kept(f"encoder {name} {spaced} {entries}", lambda: Encoder(name, spaced, entries))
