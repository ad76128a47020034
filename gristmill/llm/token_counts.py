"""Edit-aware token counts.

A document is kept as its pre-tokens (the tokenizer's own pre-tokens, which encode independently) in blocks; a
segment tree over the blocks holds the sums of characters and of tokens. An edit re-splits the text from shortly
before it until the new split meets an old boundary beyond it, encodes only the pre-tokens between, and updates
the sums on the path from the block to the root.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPLIT = regex.compile(PATTERN)  # \s and classes as in the vocabulary's own splitter
#: A pre-token's end depends on so many characters after it at most.
AHEAD = 2
BLOCK = 64


@cache
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a ranks file (base64 token and rank a line), without special tokens."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Tokens of single pre-tokens; remembers up to ``room`` of them."""

    def __init__(self, path: str, room: int = 300_000):
        self.encode, self.room, self.known = encoding(path).encode_ordinary, room, {}

    def count(self, parts: list[str]) -> list[int]:
        new = set(parts).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.room:
                self.known, new = {}, set(parts)
            for p in new:
                self.known[p] = len(self.encode(p))
        return list(map(self.known.__getitem__, parts))


@cache
def counter(path: str) -> Counter:
    """The process's one counter of a vocabulary: what a task has learned serves the next."""
    return Counter(path)


def pre_tokens(text: str) -> list[str]:
    return SPLIT.findall(text)


class TokenTree:
    """A document's pre-tokens with a segment tree of character and token sums over blocks of them."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]):
        self._count = count
        parts = pre_tokens(text)
        self._build(parts, count(parts))
        self.recounted = 0

    def _build(self, parts: list[str], tokens: list[int]) -> None:
        self.blocks = [(parts[i : i + BLOCK], tokens[i : i + BLOCK]) for i in range(0, len(parts), BLOCK)] or [([], [])]
        n = self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (p, t) in enumerate(self.blocks):
            self.chars[n + i], self.tokens[n + i] = sum(map(len, p)), sum(t)
        for i in range(n - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def __len__(self) -> int:
        return self.chars[1]

    def _block_at(self, offset: int) -> tuple[int, int]:
        """(block that holds the character at the offset, the block's first offset); of the end, the last block with characters."""
        node, first = 1, 0
        offset = max(0, min(offset, self.chars[1] - 1))
        while node < self.leaves:
            node *= 2
            if offset - first >= self.chars[node]:
                first += self.chars[node]
                node += 1
        return node - self.leaves, first

    def _set(self, i: int, parts: list[str], tokens: list[int]) -> None:
        self.blocks[i] = (parts, tokens)
        node = i + self.leaves
        self.chars[node], self.tokens[node] = sum(map(len, parts)), sum(tokens)
        while node > 1:
            node //= 2
            self._pull(node)

    def text(self) -> str:
        return "".join("".join(p) for p, _ in self.blocks)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from start to end (clipped to the text) with ``new``."""
        start = max(0, min(start, len(self)))
        end = max(start, min(end, len(self)))
        first, at = self._block_at(start - AHEAD)
        parts, tokens = self.blocks[first]
        keep = 0
        while keep < len(parts) and at + len(parts[keep]) + AHEAD <= start:
            at += len(parts[keep])
            keep += 1
        old, costs, last, reach = parts[keep:], tokens[keep:], first, at + sum(map(len, parts[keep:]))
        grow = 1
        while True:
            # Blocks up to some way beyond the edit; more, should the split not meet an old boundary there.
            while last + 1 < len(self.blocks) and reach < end + 64 * grow:
                last += 1
                old, costs = old + self.blocks[last][0], costs + self.blocks[last][1]
                reach += sum(map(len, self.blocks[last][0]))
            body = "".join(old)
            edited = body[: start - at] + new + body[end - at :]
            shift = len(new) - (end - start)
            ends, x = {}, at
            for k, p in enumerate(old):
                x += len(p)
                ends[x + shift] = k + 1
            made, x, met = [], at, None
            for m in SPLIT.finditer(edited):
                made.append(m.group())
                x = at + m.end()
                # Equal from here on once a boundary lies beyond the edit and both splits have it.
                if x >= start + len(new) and x in ends and x - shift >= end and x + AHEAD < at + len(edited):
                    met = ends[x]
                    break
            if met is not None or last + 1 >= len(self.blocks):
                break
            grow *= 4
        rest = (old[met:], costs[met:]) if met is not None else ([], [])
        self.recounted += len(made)
        parts, tokens = parts[:keep] + made + rest[0], tokens[:keep] + self._count(made) + rest[1]
        self._set(first, parts, tokens)
        for i in range(first + 1, last + 1):
            self._set(i, [], [])
        if len(parts) > 16 * BLOCK + 4 * BLOCK * (last - first):
            self._build([p for b, _ in self.blocks for p in b], [t for _, b in self.blocks for t in b])


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """The edits of the registered query, each given in positions of the text as the one before leaves it.

    The first line is dropped with its line end where there are more; the middle character goes; the character a third of
    the way in becomes a line break; a closing line is added.
    """
    line = text.find("\n") + 1
    n = len(text) - line
    out = [(0, line, "")] if line else []
    if n:
        out.append((n // 2, n // 2 + 1, ""))
        n -= 1
        if n:
            out.append((n // 3, n // 3 + 1, "\n"))
    return [*out, (n, n, "\nEnd of document.")]


def edited_counts(docs: DataFrame, tokenizer: str, edits: Callable[[str], list] = standard_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens of the text, n_tokens_edited after its edits, n_pre_tokens, n_recounted.

    n_recounted is the number of pre-tokens that the edits had counted again. A null text counts as empty. Repeated rows are
    counted each; a null id stays null. Other columns are ignored; an empty table gives an empty result.
    """

    def make():
        count = counter(tokenizer).count

        def work(ids, texts):
            rows = []
            for t in texts:
                tree = TokenTree(t or "", count)
                row = [tree.total, sum(len(p) for p, _ in tree.blocks)]
                for e in edits(t or ""):
                    tree.edit(*e)
                rows.append((row[0], tree.total, row[1], tree.recounted))
            cols = np.array(rows, np.int64).reshape(-1, 4).T.copy()
            return ids, *[pa.array(c) for c in cols]

        return work

    kind = dict(docs.dtypes)[id_col]
    return per_row(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), f"id {kind}, n_tokens long, n_tokens_edited long, n_pre_tokens long, n_recounted long", make, 64).withColumnRenamed("id", id_col)
