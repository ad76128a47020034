"""Benchmark decontamination by SimHash over windows of an item's size.

Every document is slid over with windows as long as each benchmark item (in words); for items with more words than the
document the window is the whole document. A window's fingerprint is the 64-bit SimHash of the words in its middle three
fifths, as is the item's: at a similarity of 0.8 what is cut off at a window's ends does not reach the middle, and few
words inside can have changed, so the fingerprints stay within ``RADIUS`` bits. Candidates are all items within that radius of a
window, found by multi-index Hamming blocks: 64 bits are cut into four blocks with limits t that add up to RADIUS - 3, and
of two fingerprints within the radius at least one block differs in no more than its t bits (else the sum would be
greater), so looking up those neighbours of each block misses none. Around a candidate the windows of the item's size are
compared exactly: it counts when the similarity of the five-word shingles, weighted by their number, is 0.8 or more.

Fingerprints of all windows are computed in bit slices: the counts of 64 bits over a window are held as a few 64-bit
numbers, one for each binary digit, and growing every window of a buffer by a word is one addition with carry.

The benchmark is searched in parts of bounded size (``PART_ITEMS``, ``PART_BYTES``), one pass over the documents for each,
so no benchmark is too large; all usual ones are one part.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, per_row, runs, shingle_codes, word_codes

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 11
BLOCKS = 4
PART_ITEMS = 10_000
PART_BYTES = 16 << 20
WORD = re.compile(r"[^\W_]+")
#: Windows whose fingerprints are computed together.
CHUNK = 8192
GAP = re.compile(r"[\W_]")
#: Characters whose words are coded together.
TOGETHER = 1 << 18


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _codes(words: list[str]) -> np.ndarray:
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.array([len(w) for w in encoded], np.int64)
    ends = np.cumsum(size)
    return word_codes(b"".join(encoded), ends - size, ends)


@cache
def _letters() -> np.ndarray:
    """For each code point, whether words are made of it."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        out[m.start() : m.end()] = True
    return out


def _coded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(place in the text, code) of the words of a lower-cased text."""
    data = text.encode("utf-8", "surrogatepass")
    if text.isascii():
        starts, ends = runs(_letters()[:128][np.frombuffer(data, np.uint8)])
        return starts, word_codes(data, starts, ends)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends = runs(_letters()[points])
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
    return starts, word_codes(data, at[starts], at[ends])


def text_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words of the texts, where each text's codes end)."""
    lowered = [(t or "").lower() for t in texts]
    codes, ends, total, k = [], [], 0, 0
    while k < len(lowered):
        some, size = [], 0
        while k < len(lowered) and (not some or size + len(lowered[k]) <= TOGETHER):
            some.append(lowered[k])
            size += len(lowered[k]) + 1
            k += 1
        if size <= 2 * TOGETHER:
            places, found = _coded("\n".join(some))
            ends.append(total + np.searchsorted(places, np.cumsum([len(t) + 1 for t in some])))
            total += len(found)
            codes.append(found)
            continue
        # A very long text by pieces that end between words.
        at = 0
        while at < len(some[0]):
            gap = GAP.search(some[0], at + TOGETHER)
            to = gap.start() if gap else len(some[0])
            codes.append(_coded(some[0][at:to])[1])
            total, at = total + len(codes[-1]), to
        ends.append([total])
    return (np.concatenate(codes), np.concatenate(ends).astype(np.int64)) if codes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def middle(size: int) -> tuple[int, int]:
    """(first word, words) of the part of a window of ``size`` words that is fingerprinted; of short ones (where 0.8 means equal) all.

    Over 8 words, multiples of 4 (of an eighth of the next power of two, if that is more), so that there are few sizes to compute.
    """
    words = size if size <= 8 else -(-3 * size // 5)
    words -= words % max(4, (1 << words.bit_length()) >> 3) if words > 8 else 0
    return (size - words) // 2, words


def fingerprint(codes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the codes."""
    ones = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(codes), bitorder="little").view("<u8")[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted overlap: shared weight over the larger total (windows have their item's size, or are the whole of a shorter document)."""
    return sum(min(n, b[k]) for k, n in a.items() if k in b) / max(1, sum(a.values()), sum(b.values()))


def _add(planes: list[np.ndarray], more: list[np.ndarray]) -> None:
    """planes += more; both are numbers in bit slices, the lowest digit first."""
    carry = None
    for k in range(max(len(planes), len(more)) + 1):
        if k >= len(more) and carry is None:
            return
        if k == len(planes):
            if k >= len(more) and not carry.any():
                return
            planes.append(np.zeros_like(planes[0]) if planes else np.zeros_like(more[0]))
        a, b = planes[k], more[k] if k < len(more) else None
        if b is None or carry is None:
            x = carry if b is None else b
            carry = a & x
            planes[k] = a ^ x
        else:
            half = a ^ b
            planes[k], carry = half ^ carry, (a & b) | (half & carry)


def _at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """A bit is 1 where the number in its slices is ``least`` or more."""
    if least >> len(planes):
        return np.zeros_like(planes[0])
    above, equal = None, None
    for k in range(len(planes) - 1, -1, -1):
        p = planes[k]
        if least >> k & 1:
            equal = p if equal is None else equal & p
        else:
            more = p if equal is None else equal & p
            above = more if above is None else above | more
            equal = ~p if equal is None else equal & ~p
    return equal if above is None else above | equal


def window_prints(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, first start, fingerprints) of all windows of the ascending ``sizes``, some thousand starts at a time."""
    for at in range(0, len(codes), CHUNK):
        n = min(CHUNK, len(codes) - at)
        part = np.zeros(n + sizes[-1], np.uint64)
        have = codes[at : at + n + sizes[-1]]
        part[: len(have)] = have
        # doubled[k]: counts over 2 ** k words from each place on.
        doubled: list[list[np.ndarray]] = [[part]]
        planes: list[np.ndarray] = []
        reach = 0
        for size in sizes:
            while reach < size:
                k = (size - reach).bit_length() - 1
                k = k if k >= 3 else 0
                while len(doubled) <= k:
                    step, last = 1 << (len(doubled) - 1), doubled[-1]
                    wide = [p[:-step].copy() for p in last]
                    _add(wide, [p[step:] for p in last])
                    doubled.append(wide)
                _add(planes, [p[reach : reach + n] for p in doubled[k]])
                reach += 1 << k
            yield size, at, _at_least(planes, size // 2 + 1)[: max(0, len(codes) - size + 1 - at)]


class Blocks:
    """Fingerprints by Hamming blocks: which are within the radius of given ones."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS):
        self.prints, self.radius = prints, radius
        bits, spare = 64 // BLOCKS, radius - BLOCKS + 1
        limits = [max(0, spare // BLOCKS + (b < spare % BLOCKS)) for b in range(BLOCKS)]
        self.any, self.starts, self.members = [], [], []
        for b, limit in enumerate(limits):
            masks = np.array([sum(1 << i for i in c) for k in range(limit + 1) for c in combinations(range(bits), k)], np.uint64)
            values = ((prints >> np.uint64(b * bits)) & np.uint64((1 << bits) - 1))[:, None] ^ masks
            flat = values.ravel().astype(np.int64)
            count = np.bincount(flat, minlength=1 << bits)
            self.any.append(count > 0)
            self.starts.append(np.concatenate([[0], np.cumsum(count)]))
            self.members.append((np.argsort(flat, kind="stable") // len(masks)).astype(np.int32))

    def met(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in found, number of the fingerprint) of all that share a block's neighbourhood, block by block."""
        blocks = found.astype("<u8", copy=False).view("<u2").reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            own = blocks[:, b].astype(np.intp)
            at = np.flatnonzero(self.any[b][own])
            if len(at):
                own = own[at]
                first = self.starts[b][own]
                size = self.starts[b][own + 1] - first
                ends = np.cumsum(size)
                yield np.repeat(at, size), self.members[b][np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]

    def near(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As ``met``, but only what is within the radius."""
        for at, n in self.met(found):
            good = np.bitwise_count(found[at] ^ self.prints[n]) <= self.radius
            if good.any():
                yield at[good], n[good]


class Index:
    """Benchmark items: fingerprints in Hamming blocks for each size of middle, and exact shingle weights."""

    def __init__(self, items: list[tuple], width: int = WIDTH, radius: int = RADIUS, least: float = SIMILARITY):
        self.width, self.least = width, least
        split = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in split if w]
        self.size = [len(w) for _, w in self.items]
        codes = [_codes(w) for _, w in self.items]
        self.weights = [Counter(shingle_codes(c, width).tolist()) for c in codes]
        self.shingles = [np.array(sorted(w), np.uint64) for w in self.weights]
        groups = defaultdict(list)
        for n, c in enumerate(codes):
            first, words = middle(len(c))
            groups[words].append((n, fingerprint(c[first : first + words])))
        self.groups = {k: (np.array([n for n, _ in v]), Blocks(np.array([p for _, p in v], np.uint64), radius)) for k, v in sorted(groups.items())}

    def search(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """For each text, (item, similarity, first word, words) of the best window of every item that it holds."""
        out: list = [[] for _ in texts]
        if not self.groups or not texts:
            return out
        flat, ends = text_codes(texts)
        begin = np.concatenate([[0], ends[:-1]])
        shingles = shingle_codes(flat, self.width)
        hits = defaultdict(set)
        for size, at, prints in window_prints(flat, list(self.groups)):
            numbers, blocks = self.groups[size]
            for place, n in blocks.near(prints):
                place = place + at
                doc = np.searchsorted(ends, place, "right")
                inside = place + size <= ends[doc]
                for d, p, k in zip(doc[inside].tolist(), (place - begin[doc])[inside].tolist(), numbers[n[inside]].tolist()):
                    hits[d, k].add(p)
        for (d, n), places in sorted(hits.items()):
            best = self._best(flat[begin[d] : ends[d]], shingles[begin[d] : ends[d]], n, sorted(places))
            if best:
                out[d].append((n, *best))
        return out

    def _best(self, codes: np.ndarray, shingles: np.ndarray, n: int, places: list[int]) -> tuple[float, int, int] | None:
        """(similarity, first word, words) of the best window around candidates whose middles start at ``places``, the first of equals.

        ``shingles`` are those that start at each word; the last ones, which reach beyond the text, are not looked at.
        """
        size, weights = self.size[n], self.weights[n]
        if len(codes) <= size:
            s = similarity(weights, Counter(shingle_codes(codes, self.width).tolist()))
            return (s, 0, len(codes)) if s >= self.least else None
        offset, last, ranges = middle(size)[0], len(codes) - size, []
        for p in places:
            lo, hi = max(0, p - offset - size), min(last, p - offset + size)
            if ranges and lo <= ranges[-1][1] + 1:
                ranges[-1][1] = max(ranges[-1][1], hi)
            else:
                ranges.append([lo, hi])
        total = sum(weights.values())
        best = (0.0, 0, 0)
        for lo, hi in ranges:
            here = shingles[lo : hi + size - self.width + 1] if size >= self.width else shingle_codes(codes[lo : hi + size], size)
            own = self.shingles[n]
            if np.count_nonzero(own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here) < self.least * total:
                continue
            here = here.tolist()
            span, seen, shared = total, Counter(), 0
            for k, x in enumerate(here):
                if x in weights:
                    seen[x] += 1
                    shared += seen[x] <= weights[x]
                if k >= span and (y := here[k - span]) in weights:
                    shared -= seen[y] <= weights[y]
                    seen[y] -= 1
                if k >= span - 1 and shared / total > best[0]:
                    best = (shared / total, lo + k - span + 1, size)
        return best if best[0] >= self.least else None


def parts_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items: int = PART_ITEMS, size: int = PART_BYTES) -> Iterator[list[tuple]]:
    """The items in parts of about ``items`` and ``size`` bytes at most, by a hash of id and text; each is brought to the driver by itself."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-2 * count // items) if count > items else 1, -(-2 * total // size) if total > size else 1)
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()
        yield sorted(((r[0], r[1]) for r in part), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


_INDEXES: dict = {}


def _index(name: str, items, options: dict) -> Index:
    """The worker process's index of a part: built once, kept until another part comes."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Index(items.value, **options)
    return _INDEXES[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_items: int = PART_ITEMS, **options) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, similarity, first_word, n_words.

    The best window of the item's size (of a shorter document, the whole) is reported, the first of equal ones. Null and empty texts hold nothing;
    items without a word are held by nothing. Very long texts are searched whole. Repeated rows and repeated items are reported each; a null id stays null. Other
    columns are ignored; empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for part in parts_of(benchmark, items=part_items):
        name, items = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(part)

        def make(name=name, items=items):
            index = _index(name, items, options)

            def work(ids, texts):
                found = [(d, index.items[n][0], s, p, k) for d, of in zip(ids, index.search(texts)) for n, s, p, k in of]
                cols = list(zip(*found)) or [[]] * 5
                return tuple(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())))

            return work

        found = per_row(rows, "doc_id long, item_id long, similarity double, first_word long, n_words long", make)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", part_items: int = PART_ITEMS, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item.

    Null and empty texts hold none and stay, as do repeated rows; very long texts are searched whole; an empty table gives an empty
    result, and an empty benchmark leaves all rows.
    """
    at = docs.columns.index(text_col)
    for k, part in enumerate(parts_of(benchmark, items=part_items)):
        name, items = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(part)

        def run(batches, name=name, items=items):
            index = _index(name, items, options)
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    rows = batch.slice(k, 512)
                    yield rows.filter(pa.array([not found for found in index.search(rows.column(at).to_pylist())], pa.bool_()))

        # A further part works on what the one before has left.
        docs = (cut(docs) if k else docs).mapInArrow(run, docs.schema)
    return docs
