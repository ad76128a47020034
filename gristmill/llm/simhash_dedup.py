"""Near-duplicates by SimHash: tiled exact comparison of fingerprints with numpy.

``near_duplicates`` links fingerprints of 64 bits within a few bits, by their definition; ``similar_texts`` and
``one_of_each`` link texts whose sets of five-word shingles have a similarity of 0.8 or more: fingerprints of 256 bits
choose the candidates, the whole sets decide.

Two fingerprints within ``radius`` bits have population counts, in every block of bits, that differ by no more
than ``radius`` in total. Distinct fingerprints are therefore dealt to cells by the population counts of
four 16-bit blocks (at most 17**4 cells, whatever the data), cells are cut into tiles of bounded size, and only
tile pairs of cells within the radius meet. Inside a pair, sub-tiles are ordered by the population counts
of the eight bytes and skipped where those are too far apart; the rest is compared with exclusive-or and bit
counts. Every link is found; each task reports a spanning forest of its links, not all pairs. A cell of c
fingerprints is cut into about sqrt(c / 1024) tiles, so what is shuffled grows with c ** 1.5 and the comparisons with
c ** 2.

Sets of shingles whose similarity is 0.8 or more differ in size by a factor of 1.25 at most, so their cells are classes of
size, of which only neighbours meet. Candidates (a forest of them) make components; within such a component, tiled again, the
sets themselves are compared, nearest fingerprints first and only texts that no link connects so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, bitmap, components, cut, flagged, mixed, per_row, runs, shingle_codes, word_codes

SEED = 42
BLOCKS = 4
SIDE = 64 // BLOCKS + 1
TILE = 8192
SUB = 512
WIDTH = 5
SIMILARITY = 0.8
# Prints of 256 bits. At similarity 0.8 two prints differ in 39 bits on average with a deviation of 6 (sets of few shingles in up to
# 48), unrelated ones in 128 with a deviation of 8. Bits allowed in all and in the first 64; for sets of under FEW shingles the second.
WORDS = 4
RADIUS = (64, 80)
FIRST = (24, 30)
FEW = 32
#: Sets in a tile: at most about so many shingles, and so many sets.
TILE_SHINGLES = 3 << 20
TILE_SETS = 4096
#: Shingles in a row that carries a part of a set.
PART = 4096


def _majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit hashes the number whose bits are 1 where over half of the hashes have them set."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    # 255 ones fit a byte.
    for at in range(0, len(hashes), 255):
        part = np.ascontiguousarray(hashes[at : at + 255], "<u8")
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash (unsigned) of the text's word shingles, repeats included; no word: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
    return int(_majority(hashes[:, None])[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) per input row; fp is the fingerprint as a signed bigint. A null text counts as empty."""

    def make():
        def work(ids, texts):
            return ids, np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)

        return work

    kind = dict(docs.dtypes)[id_col]
    return per_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, fp long", make)


def _links(own: np.ndarray, other: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of own, one of other) within the radius."""

    def ordered(x):
        pops = np.bitwise_count(x.view(np.uint8).reshape(-1, 8)).astype(np.int16)
        by = np.lexsort(pops.T[::-1])
        return x[by], pops[by]

    (a, pa_), (b, pb) = ordered(own), ordered(other)
    left, right = [], []
    spans = [(i, pa_[i : i + SUB].min(0), pa_[i : i + SUB].max(0)) for i in range(0, len(a), SUB)]
    for j in range(0, len(b), SUB):
        lo, hi = pb[j : j + SUB].min(0), pb[j : j + SUB].max(0)
        for i, low, high in spans:
            if np.maximum(0, np.maximum(low - hi, lo - high)).sum() > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a[i : i + SUB, None] ^ b[None, j : j + SUB]) <= radius)
            left.append(a[i + x])
            right.append(b[j + y])
    return (np.concatenate(left), np.concatenate(right)) if left else (a[:0], b[:0])


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its part) of the graph with edges u-v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            keep = root != np.arange(len(nodes))
            return nodes[keep], nodes[root[keep]]
        root = new


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((cell, tile), role, batch columns from the fourth on) of consecutive rows (cell, tile, role, ...) with equal keys."""
    for batch in batches:
        keys = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]
        edge = np.flatnonzero(sum(np.diff(k) != 0 for k in keys)) + 1
        for a, b in zip([0, *edge], [*edge, batch.num_rows]):
            if b > a:
                yield (int(keys[0][a]), int(keys[1][a])), int(keys[2][a]), batch.slice(a, b - a).columns[3:]


def _compare(batches: Iterator[pa.RecordBatch], links, columns) -> Iterator[pa.RecordBatch]:
    """Forests of links. Rows come sorted by cell, tile, role; role 0 are the tile's own, role 1 those to hold against them.

    ``columns`` makes a part of a tile from batch columns, ``links(x, y)`` yields arrays (u, v) of the links between two parts;
    with equal parts both directions may be among them.
    """
    key, own, us, vs, held = None, [], [], [], 0

    def shrink():
        nonlocal us, vs, held
        u, v = _forest(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
        us, vs, held = [u], [v], 0
        return u, v

    def done():
        u, v = shrink()
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for at, role, cols in _runs(batches):
        if at != key:
            yield from done()
            key, own, us, vs, held = at, [], [], [], 0
        part = columns(cols)
        for x in [*own, *([part] if role == 0 else [])]:
            for u, v in links(x, part):
                us.append(u)
                vs.append(v)
                held += len(u)
                if held > 1 << 20:
                    shrink()
        if role == 0:
            own.append(part)
    yield from done()


def _dealt(rows: DataFrame, homes, key: str, columns: list[str], tile: int) -> DataFrame:
    """Rows (cell, tile, role, columns) in their tiles: every row once with role 0 in a tile of its own cell, and with role 1 in the
    earlier tiles of that cell and in all tiles of its other homes. ``cell`` has a bounded number of values, whatever the data."""
    count = F.col("count")
    sizes = cut(rows.groupBy("cell").count().select(F.col("cell").alias("home"), F.ceil(count / F.greatest(F.lit(float(tile)), F.sqrt(count * 1024))).cast("int").alias("tiles")))
    spread = rows.select(key, *columns, "cell", F.explode(homes).alias("home")).join(F.broadcast(sizes), "home")
    mine = F.pmod(F.xxhash64(key), F.col("tiles")).cast("int")
    at_home = F.col("home") == F.col("cell")
    spread = spread.select(key, *columns, "home", at_home.alias("own"), mine.alias("mine"), F.explode(F.when(at_home, F.sequence(F.lit(0), mine)).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("tile"))
    spread = spread.select(F.col("home").alias("cell"), "tile", F.when(F.col("own") & (F.col("mine") == F.col("tile")), 0).otherwise(1).alias("role"), key, *columns)
    return spread.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "role")


def fingerprint_links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (column fp) linked within the radius."""
    width = 64 // BLOCKS
    pops = [F.bit_count(F.expr(f"shiftrightunsigned(fp, {i * width}) & {(1 << width) - 1}L")) for i in range(BLOCKS)]
    cell = sum((p * SIDE ** (BLOCKS - 1 - i) for i, p in enumerate(pops)), F.lit(0)).cast("int")
    moves = [m for m in product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, m)) <= radius]
    before = [m for m in moves if m < (0,) * BLOCKS]
    valid = lambda m: F.expr(" AND ".join(f"pops[{i}] + {d} BETWEEN 0 AND {width}" for i, d in enumerate(m) if d))
    shift = lambda m: sum(d * SIDE ** (BLOCKS - 1 - i) for i, d in enumerate(m))
    homes = F.array_compact(F.array(F.col("cell"), *[F.when(valid(m), F.col("cell") + shift(m)) for m in before]))
    rows = distinct.select("fp", cell.alias("cell"), F.array(*pops).alias("pops"))

    def links(x, y):
        u, v = _links(x, y, radius)
        some = u < v if x is y else slice(None)
        yield u[some].view(np.int64), v[some].view(np.int64)

    def run(batches):
        return _compare(batches, links, lambda cols: cols[0].to_numpy(zero_copy_only=False).view(np.uint64))

    # At most SIDE ** BLOCKS cells, whatever the data.
    return _dealt(rows, homes, "fp", [], tile).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id, fp.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; component_id is the smallest id that
    links reach. Null, empty and wordless texts have fingerprint 0, which links like any other. Repeated rows
    and equal fingerprints share a component. A null id never becomes component_id unless all of its
    component's ids are null. Very long texts are read whole. Other columns are ignored; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("size")))
    parts = components(fingerprint_links(nodes.select("fp"), radius))
    placed = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(roots, "root").select("fp", "size", "component_id")
    out = attach(prints, cut(named), "fp", "size", "id", prints.count())
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


# Similarity of whole texts.
def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted codes of the text's distinct shingles; of fewer words there is one shingle, the whole, also of none."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at = np.frombuffer(data, np.uint8)
    codes = word_codes(data, *runs((at != 32) & ((at < 9) | (at > 13))))
    return np.unique(shingle_codes(codes, width)) if len(codes) else np.zeros(1, np.uint64)


def wide_print(codes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """SimHash of a set of shingle codes, as ``words`` 64-bit numbers: a bit is 1 if set in over half of the hashes."""
    salts = [np.uint64(w * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for w in range(words)]
    return _majority(mixed(codes[:, None] + np.array(salts, np.uint64))).astype(np.uint64)


PRINT = ["f0", "f1", "f2", "f3"]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text); rows of equal id and text, which can stand for each other, have one number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.col(id_col).alias("id"), text.alias("text"))


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """(row, id, key, n, f0 to f3): key names the text's set of shingles, n is its size, f0 to f3 are its print."""

    def make():
        def work(row, ids, texts):
            sets = [shingle_set(t, width) for t in texts]
            prints = np.stack([wide_print(s) for s in sets])
            size = np.array([len(s) for s in sets], np.int64)
            key = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
            return row, ids, key.view(np.int64), size, *prints.T.copy().view(np.int64)

        return work

    return per_row(rows, f"row long, id {dict(rows.dtypes)['id']}, key long, n long, f0 long, f1 long, f2 long, f3 long", make)


def _near(a: tuple, b: tuple, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (places in a, places in b) between prints that are near; a and b are (sizes, prints)."""

    def ordered(part):
        n, prints = part
        by = np.lexsort((np.bitwise_count(prints).sum(axis=1), n))
        return by, n[by], prints[by], np.bitwise_count(prints[by]).sum(axis=1).astype(np.int64)

    (ia, na, fa, ca), (ib, nb, fb, cb) = ordered(a), ordered(b)
    for i in range(0, len(ia), SUB):
        x, f, c = na[i : i + SUB], fa[i : i + SUB], ca[i : i + SUB]
        low, high = np.searchsorted(nb, least * x[0] - 1e-9), np.searchsorted(nb, x[-1] / least + 1e-9, "right")
        for j in range(low, high, SUB):
            y, g, d = nb[j : j + SUB], fb[j : j + SUB], cb[j : j + SUB]
            # Tiles whose population counts are too far apart hold no link.
            few = int(min(x[0], y[0]) < FEW)
            if max(c.min() - d.max(), d.min() - c.max()) > RADIUS[few]:
                continue
            p, q = np.nonzero(np.bitwise_count(f[:, None, 0] ^ g[None, :, 0]) <= FIRST[few])
            good = (np.bitwise_count(f[p] ^ g[q]).sum(axis=1) <= RADIUS[few]) & (np.minimum(x[p], y[q]) >= least * np.maximum(x[p], y[q]) - 1e-9)
            if good.any():
                yield ia[i + p[good]], ib[j + q[good]]


def print_links(nodes: DataFrame, least: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect the keys of nodes (key, n, f0 to f3) whose prints are near and whose sizes allow the similarity."""
    cell = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(least))).cast("int")
    homes = F.array(F.col("cell"), F.col("cell") + 1)

    def columns(cols):
        key, n, *prints = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in cols)
        return key, n, np.stack(prints, axis=1).view(np.uint64)

    def links(x, y):
        for p, q in _near(x[1:], y[1:], least):
            u, v = x[0][p], y[0][q]
            yield u[u != v], v[u != v]

    return _dealt(nodes.select("key", "n", *PRINT, cell.alias("cell")), homes, "key", ["n", *PRINT], tile).mapInArrow(lambda batches: _compare(batches, links, columns), "u long, v long")


class _Sets:
    """Sets of shingles with keys and prints, and which of them links connect so far."""

    def __init__(self, least: float):
        self.least, self.key, self.prints, self.codes, self.label = least, [], [], [], np.zeros(0, np.int64)

    def add(self, key: int, prints: tuple, codes: np.ndarray) -> None:
        self.key.append(key)
        self.prints.append(prints)
        self.codes.append(codes)

    def link(self, own: int) -> list[tuple[int, int]]:
        """Links of the first ``own`` sets with each other (unless linked before: label has them) and with the further ones."""
        total, done, out = len(self.key), len(self.label), []
        self.label = label = np.concatenate([self.label, np.arange(done, total)])
        size = np.array([len(c) for c in self.codes])
        prints = np.array(self.prints, np.int64).view(np.uint64).reshape(total, -1)
        ends = np.cumsum(size)
        names, flat = np.unique(np.concatenate(self.codes), return_inverse=True)
        flat = flat.astype(np.int32)
        mask = np.zeros(len(names), bool)
        for i in range(own):
            first = max(i + 1, done)
            fits = np.minimum(size[i], size[first:]) >= self.least * np.maximum(size[i], size[first:]) - 1e-9
            apart = np.bitwise_count(prints[first:] ^ prints[i]).sum(axis=1)
            found = first + np.flatnonzero(fits & (apart <= RADIUS[int(size[i] < 2 * FEW)]) & (label[first:] != label[i]))
            if not len(found):
                continue
            found = found[np.argsort(apart[found - first], kind="stable")]
            mine = flat[ends[i] - size[i] : ends[i]]
            mask[mine] = True
            at, step = 0, 8
            while at < len(found):
                some = found[at : at + step]
                at, step = at + step, min(4 * step, 2048)
                some = some[label[some] != label[i]]
                if not len(some):
                    continue
                shared = np.add.reduceat(mask[np.concatenate([flat[ends[j] - size[j] : ends[j]] for j in some])].astype(np.int64), np.cumsum(size[some]) - size[some])
                for j in some[shared >= self.least * (size[i] + size[some] - shared) - 1e-9].tolist():
                    if label[j] != label[i]:
                        label[label == max(label[i], label[j])] = min(label[i], label[j])
                        out.append((self.key[i], self.key[j]))
            mask[mine] = False
        return out

    def keep(self, own: int) -> None:
        del self.key[own:], self.prints[own:], self.codes[own:]
        self.label = self.label[:own]


def _verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links of sets that are similar. Rows (cell, tile, role, key, part, f0 to f3, codes) come sorted; the parts of a set follow each other."""
    sets, at, own, held, parts, last = _Sets(least), None, 0, 0, [], None

    def close():
        nonlocal parts, last, held
        if last is not None:
            sets.add(last[0], last[1], np.concatenate(parts))
            held += len(sets.codes[-1])
        parts, last = [], None

    def flush(role):
        """Links what is held; of it only the tile's own sets stay."""
        nonlocal own, held
        own = len(sets.key) if role == 0 else own
        out = sets.link(own) if own else []
        sets.keep(own)
        held = 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["u", "v"])

    was = 0
    for cell, role, cols in _runs(batches):
        if cell != at or role != was:
            close()
            yield from flush(was)
            if cell != at:
                sets, own, held = _Sets(least), 0, 0
            at, was = cell, role
        key, part, *prints = (c.to_numpy(zero_copy_only=False) for c in cols[:-1])
        for k in range(len(key)):
            if last is None or key[k] != last[0]:
                close()
                if role and held >= TILE_SHINGLES:
                    yield from flush(1)
                last = int(key[k]), tuple(int(p[k]) for p in prints)
            parts.append(np.frombuffer(cols[-1][k].as_buffer(), np.uint64))
    close()
    yield from flush(was)


def _set_links(rows: DataFrame, nodes: DataFrame, candidates: DataFrame, width: int, least: float) -> DataFrame:
    """Edges (u, v) between the keys of similar sets, within the components (node, root) of candidates."""
    placed = cut(candidates.withColumnRenamed("node", "key").join(nodes, "key"))
    of_root = cut(placed.groupBy("root").agg(F.count("*").alias("size"), F.ceil(F.greatest(F.sum("n") / TILE_SHINGLES, F.count("*") / TILE_SETS)).cast("int").alias("tiles")))
    placed = cut(attach(placed, of_root, "root", "size", "key", placed.count()).select("key", "root", "row", "tiles", *PRINT))
    wanted = flagged(rows, "row", bitmap(placed.select(F.col("row").alias("_k"))), "_wanted").where("_wanted").groupBy("row").agg(F.first("text").alias("text"))

    def make():
        def work(text, *cols):
            sets = [shingle_set(t, width) for t in text]
            parts = [range(0, len(s), PART) for s in sets]
            times = np.array([len(p) for p in parts])
            return *[np.repeat(np.array(c, np.int64), times) for c in cols], np.concatenate([np.arange(len(p)) for p in parts]), pa.array([s[a : a + PART].tobytes() for s, p in zip(sets, parts) for a in p], pa.binary())

        return work

    names = ["key", "root", "tiles", *PRINT]
    sets = cut(per_row(wanted.join(placed, "row").select("text", *names), "".join(f"{n} long, " for n in names) + "part long, codes binary", make, 64))
    mine = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    dealt = sets.withColumn("mine", mine).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("mine"))))
    dealt = dealt.select(F.col("root").alias("cell"), "tile", F.when(F.col("mine") == F.col("tile"), 0).otherwise(1).alias("role"), "key", "part", *PRINT, "codes")
    return dealt.repartition("cell", "tile").sortWithinPartitions("cell", "tile", "role", "key", "part").mapInArrow(lambda batches: _verified(batches, least), "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(row, id, key, ...) of all rows, and (key, size, root) of the texts that another row equals or resembles."""
    rows = _rows(docs, id_col, text_col)
    prints = cut(_sketches(rows, width))
    nodes = cut(prints.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("n", *PRINT)]))
    candidates = components(print_links(nodes, least))
    parts = components(cut(_set_links(rows, nodes.drop("size"), candidates, width, least)))
    groups = nodes.select("key", "size").join(parts.withColumnRenamed("node", "key"), "key", "left").where("size > 1 OR root IS NOT NULL")
    return prints.select("row", "id", "key"), cut(groups.select("key", "size", F.coalesce("root", "key").alias("root")))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """One row per input row: id, component_id, the smallest id that links of similar texts reach.

    Null, empty and wordless texts count as equal, as do texts of the same set of shingles. Very long texts are compared whole.
    A null id never becomes component_id unless all of its component's ids are null. Repeated rows share a component. Other columns
    are ignored; an empty table gives an empty result.
    """
    prints, groups = _grouped(docs, id_col, text_col, width, least)
    total = prints.count()
    held = attach(prints, groups, "key", "size", "row", total)
    ids = cut(held.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size")))
    out = attach(held.drop("size"), ids, "root", "size", "row", total)
    return out.select(F.col("id").alias(id_col), F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (all columns, which must be sortable) without near copies: of each component of similar texts one row stays.

    That is the row with the smallest id (null only where all are null); of rows with that id, one. Rows are told apart by id and
    text, not by id alone. Only rows of components are shuffled, found by a bitmap of fixed size; nulls, empty and repeated
    texts as in ``similar_texts``. An empty table gives an empty result.
    """
    prints, groups = _grouped(docs, id_col, text_col, width, least)
    held = cut(attach(prints, groups, "key", "size", "row", prints.count()).where("root IS NOT NULL").select("row", "id", "root"))
    order = F.struct(F.col("id").isNull().alias("late"), F.col("id"), F.col("row"))
    winners = cut(held.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("size")).select(F.col("first.row").alias("row")))
    packed = docs.select(F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    marked = flagged(packed, "_row", bitmap(held.select(F.col("row").alias("_k"))), "_held")
    # Rows that the bitmap names: equal ones are put together first, then those of components that did not win go.
    one = marked.where("_held").groupBy("_row").agg(F.max("_doc").alias("_doc"))
    lost = held.select(F.col("row").alias("_row")).distinct().join(winners.select(F.col("row").alias("_row")), "_row", "left_anti")
    return marked.where("NOT _held").select("_doc.*").unionByName(one.join(lost, "_row", "left_anti").select("_doc.*"))
