"""Token ids of whole texts by chunks, exactly as the tokenizer gives them.

For a tokenizer whose pre-tokenizer drops white space and parts letters, digits and other signs (the word_bpe
vocabulary), a text's ids are its chunks' ids in a row when it is cut at ASCII white space and between ASCII
letters, digits and signs. The apostrophe (contractions), control characters and everything beyond ASCII are
never cut from their neighbours, so the tokenizer sees whatever could compose or contract in one chunk.
Cutting, hashing and gathering are numpy operations over whole buffers; each distinct chunk is encoded once
per worker process and remembered by a 64-bit hash, up to ``room`` chunks. The hash of a chunk is the sum of a
mixed number for each byte and its place, so no two chunks collide by their form; by chance, two of a billion distinct
chunks do with a probability of 1 in 37. Whether letters are folded follows the tokenizer; one of another kind is refused.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np

SEGMENT = 1 << 20
#: Texts with so long a run without white space go to the tokenizer whole.
LONG = re.compile(rf"\S{{{SEGMENT}}}")
#: Where a special token could begin; such texts go to the tokenizer whole.
MARK = "<|"
# Byte classes: 0 white space, 1 letter, 2 digit, 3 sign, 4 anything that must keep its neighbours.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[33:127] = 3
_CLASS[ord("'")] = 4
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CUT = np.zeros((5, 5), bool)
_CUT[0, :] = _CUT[:, 0] = True
for _a, _b in ((1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)):
    _CUT[_a, _b] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: What a tokenizer must encode alike as a whole and in chunks.
PROBE = ["Ab9 c,d-E f1g2  hi\tJ\nk..l 12 3'4 x_Y (z) 007a", "THE Quick  brown\n\nfox! 42%% it's a.b", "  lead", "tail  ", "a"]


@cache
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(path: str) -> ChunkEncoder:
    """The process's one encoder of a vocabulary: what a task has learned serves the next."""
    return ChunkEncoder(path)


class ChunkEncoder:
    def __init__(self, path: str, room: int = 1_000_000):
        self.tokenizer, self.room = load(path), room
        alike = all((self.whole(c) == self.whole(c.lower())).all() for c in map(chr, range(65, 91)) if len(self.whole(c)) == len(self.whole(c.lower())))
        self.fold = _FOLD if alike else np.arange(256, dtype=np.uint8)
        self._forget()
        if any(got.tolist() != self.whole(t).tolist() for got, t in zip(self.encode(PROBE), PROBE)):
            raise ValueError(f"{path}: not a tokenizer whose ids are those of its chunks")

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        """Encodes chunks, some hundred at a time with blanks between, and notes the ids of each."""
        sizes, ids = [], []
        for k in range(0, len(chunks), 256):
            some = [c.decode("utf-8", "surrogatepass") for c in chunks[k : k + 256]]
            ends = np.cumsum([len(c) + 1 for c in some])
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            owner = np.searchsorted(ends, np.fromiter((o[0] for o in got.offsets), np.int64, len(got.ids)), "right")
            sizes.append(np.bincount(owner, minlength=len(some)))
            ids.append(np.array(got.ids, "<u4"))
        size, new = np.concatenate(sizes), np.concatenate(ids)
        if self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], new, np.zeros(max(len(new), self.used) // 2 + 1024, "<u4")])
        else:
            self.pool[self.used : self.used + len(new)] = new
        at = self.used + np.cumsum(size) - size
        self.used += len(new)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, size)

    def _segment(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each chunk, first byte of each chunk) of a buffer that starts and ends between chunks."""
        raw = np.frombuffer(data, np.uint8)
        kind = _CLASS[raw]
        cut = np.ones(len(raw) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1], kind[1:]]
        starts = np.flatnonzero(cut[:-1] & (kind != 0))
        ends = np.flatnonzero(cut[1:] & (kind != 0)) + 1
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64), starts
        # The place of every byte in its chunk; the same bytes at the same places give the same number.
        x = np.arange(len(raw), dtype=np.uint64)
        x -= np.maximum.accumulate(np.where(cut[:-1], x, np.uint64(0)))
        x = ((x << np.uint64(8)) + self.fold[raw] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        codes = total[ends] - total[starts]
        keys, first, back = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.room:
            self._forget()
        where = np.searchsorted(self.keys, keys)
        new = np.append(self.keys, np.uint64(0))[where] != keys
        new |= where == len(self.keys)
        if new.any():
            low = data.lower() if self.fold is _FOLD else data
            self._learn(keys[new], [low[starts[k] : ends[k]] for k in first[new].tolist()])
            where = np.searchsorted(self.keys, keys)
        size = self.size[where][back]
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[where][back] - (stop - size), size) + np.arange(stop[-1])]
        return ids, size, starts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, as little-endian 32-bit numbers; a null text counts as empty."""
        out: list = [None] * len(texts)
        plain, raw = [], []
        for i, t in enumerate(texts):
            if t and (MARK in t or len(t) >= SEGMENT and LONG.search(t)):
                out[i] = self.whole(t)
            else:
                plain.append(i)
                raw.append((t or "").encode("utf-8", "surrogatepass"))
        data, begin = b"\n".join(raw), np.cumsum([0] + [len(r) + 1 for r in raw])
        ids, sizes, starts, at = [], [], [], 0
        while at < len(data):
            end = len(data)
            if end - at > SEGMENT:
                # To the next line end or blank, however far that is.
                found = [x for x in (data.find(b"\n", at + SEGMENT), data.find(b" ", at + SEGMENT, at + SEGMENT + 4096)) if x >= 0]
                end = min(found, default=len(data))
            part = self._segment(data[at:end])
            ids.append(part[0])
            sizes.append(part[1])
            starts.append(part[2] + at)
            at = end
        if ids:
            flat, size, start = np.concatenate(ids), np.concatenate(sizes), np.concatenate(starts)
            before = np.concatenate([[0], np.cumsum(size)])
            bound = before[np.searchsorted(start, begin[: len(raw) + 1])]
            for k, i in enumerate(plain):
                out[i] = flat[bound[k] : bound[k + 1]]
        empty = np.zeros(0, "<u4")
        return [empty if x is None else x for x in out]


def crc32(ids: np.ndarray) -> int:
    """Of little-endian unsigned 32-bit ids."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
