"""Documents taken one after the other in Arrow batches: every row holds all tokens of its document.

So counts, scores for all queries and spans need no shuffle; of the scores only a partition's k best of each query leave it.
Arrays are cut so that memory follows ``CELLS``, not the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Numbers in one array of a kernel.
CELLS = 4_000_000


def expanded(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - start, count)


def cuts(sizes: np.ndarray, most: int = CELLS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum up to at most ``most`` (or of one row)."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, counts) of sorted keys."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], start, np.diff(np.append(start, len(keys)))


def token_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """(number of tokens of each row, all tokens)."""
    lists = batch.column("words")
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def chunks(batches: Iterator[pa.RecordBatch], most: int = CELLS // 2) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """The batches cut to rows of at most so many tokens."""
    for batch in batches:
        lengths, _ = token_lists(batch)
        for a, b in cuts(lengths, most):
            part = batch.slice(a, b - a)
            yield part, *token_lists(part)


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero, as the engines' round()."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


# Tables of an index.
def postings(words: DataFrame, positions: bool = False) -> DataFrame:
    """(term, doc_id, tf, positions if asked for) of (doc_id, words), each id once."""

    def of(batches):
        for batch, lengths, flat in chunks(batches):
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            m = len(coded.dictionary)
            key = np.repeat(np.arange(len(lengths)), lengths) * m + coded.indices.to_numpy()
            if positions:
                order = np.argsort(key, kind="stable")
                key = key[order]
            else:
                key = np.sort(key)
            own, start, tf = runs(key)
            out = [coded.dictionary.take(pa.array(own % m)), batch.column("doc_id").take(pa.array(own // m)), pa.array(tf.astype(np.int32))]
            if positions:
                pos = (expanded(np.ones(len(lengths), np.int64), lengths)[order]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(pos)))
            yield pa.RecordBatch.from_arrays(out, names=["term", "doc_id", "tf", "positions"][: len(out)])

    fields = [StructField("term", StringType()), words.schema["doc_id"], StructField("tf", IntegerType())]
    return words.select("doc_id", "words").mapInArrow(of, StructType(fields + [StructField("positions", ArrayType(IntegerType()))] * positions))


def partial_stats(words: DataFrame) -> DataFrame:
    """(term, ttf, df) of the rows of each batch, to be summed up."""

    def of(batches):
        for batch in batches:
            lengths, flat = token_lists(batch)
            if not len(flat):
                continue
            coded = flat.dictionary_encode()
            code, m = coded.indices.to_numpy(), len(coded.dictionary)
            own = runs(np.sort(np.repeat(np.arange(len(lengths)), lengths) * m + code))[0]
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(code, minlength=m)), pa.array(np.bincount(own % m, minlength=m))], names=["term", "ttf", "df"])

    return words.select("words").mapInArrow(of, "term string, ttf bigint, df bigint")


class Best:
    """The k best of each of m groups out of many chunks; equal scores go to the larger id, or to the smaller."""

    def __init__(self, m: int, k: int, smaller: bool = False):
        self.m, self.k, self.smaller = m, k, smaller
        self.least = np.full(m, -np.inf)
        self.parts: list[tuple] = []
        self.size, self.most = 0, 2 * m * k + CELLS // 4

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        score = rounded(score)
        on = score >= self.least[group]
        self.parts.append((group[on], score[on], ids[on]))
        self.size += len(self.parts[-1][0])
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, score, ids = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        tie = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
        order = np.lexsort((tie if self.smaller else ~tie, -score, group))
        start = np.searchsorted(group[order], np.arange(self.m))
        order = order[np.arange(len(order)) - start[group[order]] < self.k]
        group, score, ids = group[order], score[order], ids[order]
        own, first, n = runs(group)
        full = n >= self.k
        self.least[own[full]] = score[first[full] + self.k - 1]
        self.parts, self.size = [(group, score, ids)], len(group)
        return group, score, ids


@dataclass
class Queries:
    """Queries as arrays: their ids, the distinct terms with statistics (0 where the corpus lacks a term), and which query asks for which term."""

    ids: pa.Array
    terms: pa.Array
    ttf: np.ndarray
    df: np.ndarray
    #: Pairs in the order of terms.
    start: np.ndarray
    count: np.ndarray
    query: np.ndarray
    qtf: np.ndarray
    n_docs: int
    vocabulary: int
    avg_dl: float
    #: n-grams of terms (codes), the query and position of each.
    grams: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    gram_query: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gram_pos: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def per_query(self, x: np.ndarray) -> np.ndarray:
        """Sums of values of pairs."""
        return np.bincount(self.query, x, len(self.ids))


@dataclass
class Model:
    """A model's arithmetic: what a posting adds to a query that asks for it once, how often that counts, and what a document's score is then.

    With ``whole`` documents without any query term have a score too.
    """

    part: Callable
    weight: Callable = lambda qtf: qtf
    end: Callable | None = None
    whole: bool = False
    #: What a span of two consecutive query terms adds.
    gram: Callable | None = None


def _tf_part(tf, dl, q):
    return tf / (tf + 0.5 + 1.5 * dl / q.avg_dl)


def okapi_tf() -> Model:
    return Model(lambda tf, dl, t, q: _tf_part(tf, dl, q))


def tf_idf() -> Model:
    return Model(lambda tf, dl, t, q: _tf_part(tf, dl, q) * np.log(q.n_docs / q.df[t]))


def bm25(k1: float = 1.2, k2: float = 500.0, b: float = 0.75) -> Model:
    doc = lambda tf, dl, q: (tf + k1 * tf) / (tf + k1 * ((1 - b) + b * dl / q.avg_dl))
    return Model(lambda tf, dl, t, q: np.log((q.n_docs + 0.5) / (q.df[t] + 0.5)) * doc(tf, dl, q), lambda qtf: qtf * ((qtf + k2 * qtf) / (qtf + k2)))


def lucene_bm25(k1: float = 1.2, b: float = 0.75) -> Model:
    return Model(lambda tf, dl, t, q: np.log(1 + (q.n_docs - q.df[t] + 0.5) / (q.df[t] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / q.avg_dl)))


def lm_laplace() -> Model:
    return Model(lambda tf, dl, t, q: np.log(tf + 1.0), end=lambda gain, dl, q, size: gain - size * np.log(dl + q.vocabulary)[:, None], whole=True)


def lm_jelinek_mercer(lam: float = 0.9) -> Model:
    def base(q):
        with np.errstate(divide="ignore"):
            return np.log((1 - lam) * q.ttf / q.vocabulary)

    def start(q):
        of = np.repeat(base(q), q.count)
        return q.per_query(np.where(np.isfinite(of), q.qtf * of, 0.0))

    return Model(lambda tf, dl, t, q: np.log(lam * tf / dl + (1 - lam) * q.ttf[t] / q.vocabulary) - base(q)[t], end=lambda gain, dl, q, size: gain + start(q), whole=True)


def proximity(alpha: float = 1.3, missing: int = 287) -> Model:
    none = np.log(alpha + np.exp(-float(missing)))
    return Model(tf_idf().part, end=lambda gain, dl, q, size: gain + (size - 1) * none, gram=lambda span: np.log(alpha + np.exp(-span.astype(float))) - none)


class Chunk:
    """The query terms' postings of some rows: (row, term) keys in order, where their tokens start, how many, and the tokens' positions."""

    def __init__(self, lengths: np.ndarray, flat: pa.Array, q: Queries, positions: bool):
        self.rows, self.m = len(lengths), len(q.terms)
        code = pc.fill_null(pc.index_in(flat, value_set=q.terms), -1).to_numpy().astype(np.int64)
        on = np.flatnonzero(code >= 0)
        key = np.repeat(np.arange(self.rows), lengths)[on] * self.m + code[on]
        if positions:
            order = np.argsort(key, kind="stable")
            self.tokens, self.pos = key[order], (expanded(np.ones(self.rows, np.int64), lengths)[on])[order]
        else:
            self.tokens = np.sort(key)
        self.key, self.start, self.tf = runs(self.tokens)

    def spans(self, q: Queries, anchors: tuple, cap: int, ordered: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, gram, span) of the n-grams of which a row holds all terms.

        ``ordered``: the span is ``cap`` where the first of two terms does not begin before the second.
        """
        by, first, many = anchors
        at = np.full(self.rows * self.m, -1, np.int32)
        at[self.key] = np.arange(len(self.key))
        # Tokens as single numbers; those of another row or term are further off than the cap.
        big = (int(self.pos.max()) if len(self.pos) else 0) + cap + 2
        line = np.concatenate(([-big], self.tokens * big + self.pos, [(self.rows * self.m + 1) * big]))
        n = q.grams.shape[1]
        for a, b in cuts(many[self.key % self.m], CELLS // 4):
            key = self.key[a:b]
            anchor = key % self.m
            gram = by[expanded(first[anchor], many[anchor])]
            row = np.repeat(key // self.m, many[anchor])
            lists = at[row[:, None] * self.m + q.grams[gram]]
            on = (lists >= 0).all(axis=1)
            row, gram, lists = row[on], gram[on], lists[on]
            span = np.full(len(row), cap, np.int64)
            todo = np.arange(len(row))
            if n == 2 and ordered:
                todo = np.flatnonzero(self.pos[self.start[lists[:, 0]]] < self.pos[self.start[lists[:, 1]]])
            # From every token of the rarest term to the others' nearest before and after it; the span takes one of the two of each.
            rarest = np.argmin(self.tf[lists], axis=1)
            own, others = lists[np.arange(len(lists)), rarest], [lists[np.arange(len(lists)), (rarest + o) % n] for o in range(1, n)]
            for c, d in cuts(self.tf[own[todo]], CELLS // 4):
                hit = todo[c:d]
                count = self.tf[own[hit]]
                pos = self.pos[expanded(self.start[own[hit]], count)]
                sides = []
                for other in others:
                    target = np.repeat(self.key[other[hit]] * big, count) + pos
                    k = np.searchsorted(line, target)
                    sides.append((target - line[k - 1], line[k] - target))
                least = None
                for chosen in product((0, 1), repeat=n - 1):
                    ends = [reduce(np.maximum, [own_sides[side] for own_sides, to in zip(sides, chosen) if to == side], 0) for side in (0, 1)]
                    least = ends[0] + ends[1] if least is None else np.minimum(least, ends[0] + ends[1])
                span[hit] = np.minimum(span[hit], np.minimum.reduceat(least, np.cumsum(count) - count))
            yield row, gram, span


def _anchors(q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams in the order of their rarest terms, where each term's start, how many)."""
    rarest = q.grams[np.arange(len(q.grams)), np.argmin(q.df[q.grams], axis=1)]
    many = np.bincount(rarest, minlength=len(q.terms))
    return np.argsort(rarest, kind="stable"), np.cumsum(many) - many, many


def spans(words: DataFrame, q: Queries, id_field: StructField, cap: int = 500, ordered: bool = False) -> DataFrame:
    """(query_id, pos, doc_id, span) of the queries' n-grams that a document holds all terms of."""

    def of(batches):
        anchors = _anchors(q)
        rows = max(1, 2 * CELLS // max(1, len(q.terms)))
        for whole, _, _ in chunks(batches):
            for a in range(0, len(whole), rows):
                batch = whole.slice(a, rows)
                for row, gram, span in Chunk(*token_lists(batch), q, True).spans(q, anchors, cap, ordered):
                    out = [q.ids.take(pa.array(q.gram_query[gram])), pa.array(q.gram_pos[gram].astype(np.int32)), batch.column("doc_id").take(pa.array(row)), pa.array(span.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(out, names=["query_id", "pos", "doc_id", "span"])

    out = StructType([id_field, StructField("pos", IntegerType()), words.schema["doc_id"], StructField("span", IntegerType())])
    return words.where("doc_id IS NOT NULL").select("doc_id", "words").mapInArrow(of, out)


def top(words: DataFrame, q: Queries, id_field: StructField, model: Model, k: int, distinct_dl: bool = False) -> DataFrame:
    """(query_id, doc_id, score): of every partition each query's k best, equal scores by the larger id; scores at six digits."""

    def of(batches):
        m = len(q.ids)
        best, weight, size = Best(m, k), model.weight(q.qtf), q.per_query(q.qtf)
        anchors = _anchors(q) if model.gram else None
        rows = max(1, CELLS // max(m, len(q.terms) if model.gram else 1, len(q.query) // 2))
        for whole, _, _ in chunks(batches):
            for a in range(0, len(whole), rows):
                batch = whole.slice(a, rows)
                lengths, flat = token_lists(batch)
                x = Chunk(lengths, flat, q, model.gram is not None)
                dl = lengths.astype(float)
                if distinct_dl:
                    code = flat.dictionary_encode()
                    own = runs(np.sort(np.repeat(np.arange(len(lengths)), lengths) * max(1, len(code.dictionary)) + code.indices.to_numpy()))[0]
                    dl = np.bincount(own // max(1, len(code.dictionary)), minlength=len(lengths)).astype(float)
                row, term = x.key // x.m, x.key % x.m
                part = model.part(x.tf.astype(float), dl[row], term, q)
                count = q.count[term]
                pair = expanded(q.start[term], count)
                cell = np.repeat(row * m, count) + q.query[pair]
                score = np.bincount(cell, np.repeat(part, count) * weight[pair], len(lengths) * m)
                if model.gram:
                    for r, g, span in x.spans(q, anchors, 500, True):
                        score += np.bincount(r * m + q.gram_query[g], model.gram(span), len(score))
                held = np.repeat(lengths > 0, m)
                if not model.whole:
                    held = np.zeros(len(score), bool)
                    held[cell] = True
                score = score.reshape(-1, m)
                score = model.end(score, np.maximum(dl, 1e-300) if model.whole else dl, q, size) if model.end else score
                on = np.flatnonzero(held.reshape(-1, m) & (score >= best.least - 1e-6))
                ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
                best.add(on % m, score.ravel()[on], ids[on // m])
        group, score, ids = best.cut()
        yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(group)), pa.array(ids, kind) if len(ids) else pa.array([], kind), pa.array(score)], names=["query_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(words.schema["doc_id"].dataType)
    out = StructType([id_field, words.schema["doc_id"], StructField("score", DoubleType())])
    return words.where("doc_id IS NOT NULL").select("doc_id", "words").mapInArrow(of, out)


# Co-occurrence. All documents' tokens of interest meet each part of the vocabulary in one task, and counts are made term by term there:
# no pair of terms is shuffled, only documents' tokens (once for each part) and postings (once for each tile of the tokens).
#: Postings of a part of the vocabulary, and tokens in documents of a tile.
PART_POSTINGS, TILE_TOKENS = 40_000_000, 250_000_000


def _dealt(words: DataFrame, tokens: pa.Array, keys: list[int], tiles: int) -> DataFrame:
    """(part, chunk, docs, codes, terms): for every chunk of documents and every part its terms with their documents, and the documents' tokens, where terms is null."""
    parts = len(keys) // tiles

    def of(batches):
        from zlib import crc32

        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for whole, _, _ in chunks(batches):
            for a in range(0, len(whole), 60_000):
                batch = whole.slice(a, 60_000)
                lengths, flat = token_lists(batch)
                if not len(flat):
                    continue
                coded, n = flat.dictionary_encode(), len(batch)
                m = len(coded.dictionary)
                own = runs(np.sort(np.repeat(np.arange(n), lengths) * m + coded.indices.to_numpy()))[0]
                row, code = own // m, own % m
                token = pc.fill_null(pc.index_in(coded.dictionary, value_set=tokens), -1).to_numpy()[code]
                on = (token >= 0) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[row]
                part = np.fromiter((crc32(w.encode()) % parts for w in coded.dictionary.to_pylist()), np.int64, m)
                order = np.argsort(part, kind="stable")
                place = np.empty(m, np.int64)
                place[order] = np.arange(m)
                by_term = np.sort(place[code] * n + row)
                count = np.bincount(code, minlength=m)[order].astype(np.int32)
                docs, ends = (by_term % n).astype(np.uint16), np.concatenate(([0], np.cumsum(count)))
                first = np.searchsorted(part[order], np.arange(parts + 1))
                rows = []
                for tile in range(tiles):
                    here = on & (token % tiles == tile)
                    held = np.bincount(row[here], minlength=n).astype(np.int32).tobytes(), (token[here] // tiles).astype(np.int32).tobytes()
                    for p in range(parts):
                        c, d = first[p], first[p + 1]
                        rows.append((keys[tile * parts + p], *held, None))
                        rows.append((keys[tile * parts + p], docs[ends[c] : ends[d]].tobytes(), count[c:d].tobytes(), coded.dictionary.take(pa.array(order[c:d]))))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r[3]) if r[3] is not None else 0 for r in rows]))).astype(np.int32)), pa.concat_arrays([r[3] for r in rows if r[3] is not None]), mask=pa.array([r[3] is None for r in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), lists], names=["part", "chunk", "docs", "codes", "terms"])
                chunk += 1

    return words.select("doc_id", "words").mapInArrow(of, "part int, chunk bigint, docs binary, codes binary, terms array<string>")


def _associates(held: dict, listed: list, df: np.ndarray, of_token: Callable, n_docs: int, k: int) -> tuple[pa.Array, tuple]:
    """(terms in order, (token, score, place of the term)): each token's k best terms of one part."""
    order = sorted(held)
    sizes = np.concatenate([np.frombuffer(held[c][0], np.int32) for c in order]).astype(np.int64)
    begin, base = np.cumsum(sizes) - sizes, dict(zip(order, np.cumsum([0] + [len(held[c][0]) // 4 for c in order[:-1]])))
    codes = np.concatenate([np.frombuffer(held[c][1], np.int32) for c in order])
    names = pa.chunked_array([x[3] for x in listed]).combine_chunks().dictionary_encode()
    terms = names.dictionary.take(pc.sort_indices(names.dictionary))
    place = pc.index_in(names.dictionary, value_set=terms).to_numpy()[names.indices.to_numpy()]
    term = np.repeat(place, np.concatenate([np.frombuffer(x[2], np.int32) for x in listed]))
    doc = np.concatenate([np.frombuffer(x[1], np.uint16).astype(np.int32) + np.int32(base[x[0]]) for x in listed])
    # Terms by their number of documents, frequent ones first.
    fy = np.bincount(term, minlength=len(terms))
    by = np.argsort(-fy, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    doc = doc[np.argsort(rank[term], kind="stable")]
    fy, same = fy[by], of_token(terms)[by]
    ends = np.cumsum(fy)
    many = np.concatenate(([0], np.cumsum(sizes[doc])))
    per_term = np.diff(many[np.concatenate(([0], ends))])
    m, best = len(df), Best(len(df), k, smaller=True)
    ln_x, ln_y, ln_n = np.log(np.maximum(df, 1)), np.log(fy), np.log(n_docs)

    def similarity(x, y, ln_both):
        over, under = np.maximum(x, y) - ln_both, ln_n - np.minimum(x, y)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(under > 0, np.exp(-over / under), 0.0)

    for a, b in cuts(per_term, CELLS // 2):
        if best.size > best.m * k * 2:
            best.cut()
        # Tokens that a term of so many documents can be among the best of, at most if all documents of one hold the other.
        near = np.clip(ln_x, ln_y[b - 1], ln_y[a])
        able = similarity(ln_x, near, np.minimum(ln_x, near)) >= best.least - 1e-6
        s, t = ends[a] - fy[a], ends[b - 1]
        cells, whole = (b - a) * m, None
        local = np.repeat(np.arange(b - a), fy[a:b])
        for c, d in cuts(sizes[doc[s:t]], CELLS // 2):
            own = doc[s + c : s + d]
            x = codes[expanded(begin[own], sizes[own])]
            cell = np.repeat(local[c:d], sizes[own]) * m + x
            cell = cell if able.all() else cell[able[x]]
            if cells <= 4 * len(cell) or b - a == 1:
                got = np.bincount(cell, minlength=cells)
                whole = got if whole is None else whole + got
                found = None
            else:
                found = runs(np.sort(cell))
        if whole is not None:
            at = np.flatnonzero(whole)
            both = whole[at]
        else:
            at, both = (found[0], found[2]) if found is not None else (np.zeros(0, np.int64),) * 2
        x, y = at % m, at // m + a
        on = same[y] != x
        x, y, both = x[on], y[on], both[on]
        score = similarity(ln_x[x], ln_y[y], np.log(both))
        on = score >= best.least[x] - 1e-6
        best.add(x[on], score[on], by[y[on]])
    return terms, best.cut()


def associates(words: DataFrame, tokens: pa.Array, df: np.ndarray, n_docs: int, postings: int, k: int) -> DataFrame:
    """(token, term, score): of every part of the vocabulary each token's k terms of highest similarity (Google-normalised distance)."""
    spark = words.sparkSession
    tiles = max(1, -(-int(df.sum()) // TILE_TOKENS))
    parts = max(spark.sparkContext.defaultParallelism, -(-postings // PART_POSTINGS))
    # One key for each partition.
    n, keys = tiles * parts, {}
    for i, at in spark.range(64 * tiles * parts).selectExpr("cast(id as int) AS i", f"pmod(hash(cast(id as int)), {tiles * parts}) AS at").orderBy("i").collect():
        keys.setdefault(at, i)
    spare = iter(range(64 * n, 65 * n))
    keys = [keys.get(p, None) if p in keys else next(spare) for p in range(n)]
    tile_of = {key: p // parts for p, key in enumerate(keys)}

    def of(batches):
        held: dict[int, dict] = {}
        listed: dict[int, list] = {}
        for batch in batches:
            for part, chunk, docs, codes, own in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist(), batch.column("docs"), batch.column("codes"), batch.column("terms")):
                if own.is_valid:
                    listed.setdefault(part, []).append((chunk, docs.as_py(), codes.as_py(), pa.concat_arrays([own.values])))
                else:
                    held.setdefault(part, {})[chunk] = docs.as_py(), codes.as_py()
        for part in sorted(listed):
            tile = tile_of[part]
            mine = tokens.take(pa.array(np.arange(tile, len(tokens), tiles)))
            if not len(mine) or not any(len(x[3]) for x in listed[part]):
                continue
            where = lambda terms: pc.fill_null(pc.index_in(terms, value_set=mine), -1).to_numpy()  # noqa: B023, E731
            terms, (token, score, term) = _associates(held[part], listed.pop(part), df[tile::tiles], where, n_docs, k)
            yield pa.RecordBatch.from_arrays([mine.take(pa.array(token)), terms.take(pa.array(term)), pa.array(score)], names=["token", "term", "score"])

    return _dealt(words, tokens, keys, tiles).repartition(n, "part").mapInArrow(of, "token string, term string, score double")


def vectors(words: DataFrame) -> DataFrame:
    """(term, tf): of each chunk of documents a row for every term, with a map document -> (tf, positions)."""

    def of(batches):
        for batch, lengths, flat in chunks(batches):
            if not len(flat):
                continue
            if batch.column("doc_id").null_count:
                raise ValueError("a document without an id can't be in a term vector")
            coded, n = flat.dictionary_encode(), len(batch)
            key = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lengths)
            order = np.argsort(key, kind="stable")
            own, start, tf = runs(key[order])
            term, first, _ = runs(own // n)
            pos = expanded(np.ones(n, np.int64), lengths)[order].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(pos))
            ids = batch.column("doc_id").cast(pa.string()).take(pa.array(own % n))
            held = pa.StructArray.from_arrays([pa.array(tf.astype(np.int32)), lists], names=["tf", "pos"])
            entries = pa.MapArray.from_arrays(pa.array(np.append(first, len(own)).astype(np.int32)), ids, held)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(term)), entries], names=["term", "tf"])

    return words.select("doc_id", "words").mapInArrow(of, "term string, tf map<string, struct<tf:int, pos:array<int>>>")
