"""Token ids of whole texts, by the tokenizers library, which sees each distinct word of a part once.

A byte-level BPE never merges across its pre-token bounds. A single space
between two visible characters is always such a bound, and so is a single line
feed. Texts are cut in front of these; numpy finds the distinct words of some
megabytes of text, the library encodes those that a bounded cache does not
know, and the ids of all words are gathered in their order - equal to encoding
each text at once. Texts with other white space are encoded whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from . import textvec

#: Bytes of cached words in a Python worker: hashes and places of a word take 32, an id 4; the cache is emptied when it is full.
CACHE_BYTES = 40 << 20
_encoders: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies on this machine (every worker asks for itself)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _odd_places(buf: np.ndarray) -> np.ndarray:
    """Places of white space other than space and line feed, of controls, and of what may open a special token."""
    found = [np.flatnonzero((buf < 32) & (buf != 10) | (buf == 127))]
    lead = np.flatnonzero((buf == 0xC2) | (buf == 0xE1) | (buf == 0xE2) | (buf == 0xE3))
    if len(lead):
        ahead = np.append(buf, np.zeros(2, np.uint8))
        a, b, c = ahead[lead], ahead[lead + 1], ahead[lead + 2]
        odd = (a == 0xC2) & (b <= 0xA0)
        odd |= (a == 0xE1) & ((b == 0x9A) & (c == 0x80) | (b == 0xA0) & (c == 0x8E))
        odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81) & (c >= 0x9F))
        odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        found.append(lead[odd])
    found.append(np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))))
    return np.concatenate(found)


class Encoder:
    """Texts to token ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: The signs that stand for bytes in a byte-level vocabulary, by byte; the line feed stays a separator.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte_code = {b: b if b in shown else 256 + b - sum(x < b for x in shown) for b in range(256) if b != 10}
        #: A stop behind a letter is a pre-token of its own, unless more signs follow.
        self.stops = {ord(c): self.whole(c).tobytes() for c in ",.;:!?"}
        self.forget()

    def forget(self) -> None:
        """Empties the cache: 128-bit word hashes, sorted by their first half, and where a word's ids lie in the pool."""
        self.keys, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, "<u4"), 0

    def _look_up(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Place of each hash in the cache, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where((self.keys[at] == h) & (self.checks[at] == check), at, -1)

    def _add(self, h: np.ndarray, check: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts words into pool and cache; returns where their ids lie."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(len(self.pool) + len(flat), "<u4")])
        self.pool[self.used : self.used + len(flat)] = flat
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(h)
        at = np.searchsorted(self.keys, h[order])
        for name, new in (("keys", h), ("checks", check), ("begin", begin), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))
        return begin, size

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words. Letters behind a space are one pre-token, which goes straight to the model."""
        out: dict[bytes, bytes] = {}
        letters = [w for w in words if w[0] == 32 and w[1:].decode().isalpha() and max(w) < 0xC9]
        if letters:
            tokenize, code = self.library.model.tokenize, self.byte_code
            signs = b"\n".join(letters).decode("latin-1").translate(code).split("\n")
            out = {w: array("I", [t.id for t in tokenize(s)]).tobytes() for w, s in zip(letters, signs, strict=True)}
        out.update((w, self.whole(w.decode()).tobytes()) for w in set(words).difference(out))
        return out

    def _missing(self, buf: np.ndarray, raw: bytes, s: np.ndarray, e: np.ndarray, odd: set[int]) -> list[bytes]:
        """Ids of distinct words at ascending places: by the library, or as a known word and its stop."""
        words = [raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True)]
        stops = self.stops
        stopped = [i for i, w in enumerate(words) if w[-1] in stops and w[0] == 32 and w[1:-1].decode().isalpha() and max(w) < 0xC9]
        known: dict[bytes, bytes] = {}
        if stopped:
            lows, highs = s[stopped], e[stopped] - 1
            at = self._look_up(textvec.bytes_hash(buf, lows, highs), textvec.bytes_hash(buf, lows, highs, 1))
            for i, k in zip(stopped, at.tolist(), strict=True):
                if k >= 0:
                    known[words[i][:-1]] = self.pool[self.begin[k] : self.begin[k] + self.size[k]].tobytes()
        bare = {words[i][:-1] for i in stopped}
        whole = {raw[i:j] for i, j in zip(s.tolist(), e.tolist(), strict=True) if i in odd} if odd else set()
        stop_at = set(stopped)
        ask = bare.union(w for i, w in enumerate(words) if i not in stop_at).difference(known, whole)
        known.update(self._learn(list(ask)))
        known.update((w, self.whole(w.decode()).tobytes()) for w in whole)
        return [known[w[:-1]] + stops[w[-1]] if i in stop_at and w not in whole else known[w] for i, w in enumerate(words)]

    def encode_part(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, where each begins) of documents buf[offsets[i]:offsets[i+1]], UTF-8."""
        n = len(offsets) - 1
        gap = (buf == 32) | (buf == 10)
        bad = np.zeros(n + 1, bool)
        doc_of = lambda places: np.searchsorted(offsets, places, "right") - 1
        if len(buf):
            bad[doc_of(_odd_places(buf))] = True
            bad[doc_of(np.flatnonzero(gap[:-1] & gap[1:]))] = True
            filled = np.flatnonzero(np.diff(offsets))
            bad[filled[(buf[offsets[filled]] == 32) | (buf[offsets[filled + 1] - 1] == 32)]] = True
        bad = bad[:n]
        opens = gap.copy()
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        if bad.any():  # such a document is one word
            for d in np.flatnonzero(bad):
                opens[offsets[d] : offsets[d + 1]] = False
                opens[offsets[d]] = True
        starts = np.flatnonzero(opens)
        if not len(starts):
            return np.empty(0, "<u4"), np.zeros(n + 1, np.int64)
        ends = np.append(starts[1:], len(buf))
        h = textvec.bytes_hash(buf, starts, ends)
        check = textvec.bytes_hash(buf, starts, ends, 1)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        if not (check == check[first][which]).all():  # two words share half a hash: take all
            first, which = np.arange(len(starts)), np.arange(len(starts))
        if 32 * len(self.keys) + 4 * self.used > CACHE_BYTES:
            self.forget()
        at = self._look_up(h[first], check[first])
        begin, size = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        hit = at >= 0
        begin[hit], size[hit] = self.begin[at[hit]], self.size[at[hit]]
        lost = np.flatnonzero(~hit)
        if len(lost):
            lost = lost[np.argsort(first[lost])]
            own = first[lost]
            ids = self._missing(buf, buf.tobytes(), starts[own], ends[own], set(offsets[:-1][bad].tolist()))
            begin[lost], size[lost] = self._add(h[own], check[own], ids)
        per = size[which]
        to = np.cumsum(per)
        out = self.pool[np.repeat(begin[which] - (to - per), per) + np.arange(to[-1])]
        return out, np.append(0, to)[np.searchsorted(starts, offsets)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
