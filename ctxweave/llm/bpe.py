"""Byte-level BPE encoding and decoding from a public rank file.

A text is cut into words by the vocabulary's pattern. A short word is a contiguous
array of part boundaries with the rank of each two adjacent parts beside it: the array
is scanned for the least rank, the boundary between those two parts is deleted and the
ranks of its neighbours are refreshed, until no rank is left. Words that a worker has
not seen yet go through this together, one matrix row a word, so each step is a few
numpy calls for thousands of words. A long word uses a heap over a linked list, which
gives the same parts in n log n steps.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.llm.grams import release
from ctxweave.runtime import prepare

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
SHORT, KEPT, RETAINED = 64, 500_000, 150_000
_NONE = np.int32(0x7FFFFFFF)
_MARKS = frozenset(".,;:!?")
_MIXED = re.compile(r" \s|\s ")


class Encoder:
    """One vocabulary. Words that were encoded before are kept, up to a bounded number."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.pattern, self.shipped = regex.compile(pattern), pattern == PATTERN
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for piece, rank in self.ranks.items():
            for cut in range(1, len(piece)):
                a, b = self.ranks.get(piece[:cut]), self.ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.uint64))
        self.keys = np.array(keys, np.uint64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.bits = 22
        self.slots = self._slots()
        self.known: dict[str, bytes] = {}

    def _slots(self) -> np.ndarray:
        """An open-addressing table of key indexes (-1: free)."""
        size = 1 << self.bits
        slots = np.full(size, -1, np.int32)
        todo = np.arange(len(self.keys), dtype=np.int32)
        at = self._hash(self.keys)
        while len(todo):
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            left = slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (size - 1)
        return slots

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the joined parts a and b, elementwise; _NONE where they don't join."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        at, todo = self._hash(keys), np.arange(len(keys))
        while len(todo):
            s = self.slots[at]
            hit = s >= 0
            same = hit & (self.keys[np.maximum(s, 0)] == keys[todo])
            out[todo[same]] = self.merged[s[same]]
            go = hit & ~same
            todo, at = todo[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_short(self, words: list[bytes]) -> list[np.ndarray]:
        """Parts of words of at most SHORT bytes, all together."""
        n = np.array([len(w) for w in words])
        wide = int(n.max())
        parts = np.zeros((len(words), wide), np.int32)
        inside = np.arange(wide)[None, :] < n[:, None]
        parts[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), wide), _NONE, np.int32)  # of part k with part k + 1
        if wide > 1:
            both = inside[:, 1:]
            ranks[:, :-1][both] = self.pair_ranks(parts[:, :-1][both], parts[:, 1:][both])
        done: list[np.ndarray | None] = [None] * len(words)
        live = np.arange(len(words))
        while len(live):
            k = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            least = ranks[rows, k]
            over = least == _NONE
            if over.any():
                for r in np.flatnonzero(over):
                    done[live[r]] = parts[r, : n[r]]
                keep = ~over
                live, parts, ranks, n, k, least = live[keep], parts[keep], ranks[keep], n[keep], k[keep], least[keep]
                if not len(live):
                    break
                wide = int(n.max())
                parts, ranks = parts[:, :wide], ranks[:, :wide]
                rows = np.arange(len(live))
            # delete the boundary after part k: everything behind it moves up by one
            columns = np.arange(parts.shape[1])[None, :]
            source = np.minimum(columns + (columns > k[:, None]), parts.shape[1] - 1)
            parts = np.take_along_axis(parts, source, 1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= k[:, None]), parts.shape[1] - 1), 1)
            ranks[:, -1] = _NONE
            parts[rows, k] = least
            n = n - 1
            ranks[rows, k] = _NONE
            has = np.flatnonzero(k + 1 < n)
            ranks[has, k[has]] = self.pair_ranks(parts[has, k[has]], parts[has, k[has] + 1])
            has = np.flatnonzero(k > 0)
            ranks[has, k[has] - 1] = self.pair_ranks(parts[has, k[has] - 1], parts[has, k[has]])
        return done

    def encode_long(self, word: bytes) -> np.ndarray:
        """Parts of a word of any length."""
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(word[k : k + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, k, e = heapq.heappop(heap)
            if gone[k] or after[k] >= n or end[after[k]] != e:
                continue
            right = after[k]
            gone[right] = 1
            end[k] = e
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                e2 = end[after[k]]
                if (r := ranks.get(word[k:e2])) is not None:
                    heapq.heappush(heap, (r, k, e2))
            if before[k] >= 0:
                p = before[k]
                if (r := ranks.get(word[p:e])) is not None:
                    heapq.heappush(heap, (r, p, e))
        out, k = [], 0
        while k < n:
            out.append(ranks[word[k : end[k]]])
            k = after[k]
        return np.array(out, np.int32)

    def words(self, words: list[str]) -> list[bytes]:
        """Parts of each word, as bytes of int32."""
        out: list[bytes | None] = [None] * len(words)
        short: list[tuple[int, bytes]] = []
        for k, w in enumerate(words):
            b = w.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(b)
            if rank is not None:
                out[k] = rank.to_bytes(4, sys.byteorder)
            elif len(b) <= SHORT:
                short.append((k, b))
            else:
                out[k] = self.encode_long(b).tobytes()
        short.sort(key=lambda x: len(x[1]))
        for x in range(0, len(short), 4096):
            part = short[x : x + 4096]
            for (k, _), ids in zip(part, self.encode_short([b for _, b in part])):
                out[k] = ids.tobytes()
        return out

    def stretches(self, text: str) -> list[str]:
        """The words of the text, or longer stretches of it that cut() will cut into words.

        With the shipped pattern a text in which no space has white space beside it is
        cut before every space: the pattern has a space only at the start of a word or
        among white space alone, so no word reaches over such a cut, and what it looks
        ahead at, white space before something else or the end, is on neither side. All
        other texts, and those of other patterns, are cut by the pattern at once.
        """
        if not self.shipped or _MIXED.search(text):
            return [m.group() for m in self.pattern.finditer(text)]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + x for x in rest]

    def cut(self, stretch: str) -> list[str]:
        """The words of a stretch. Of the shipped pattern's, letters with or without a mark behind them need no pattern."""
        if not self.shipped:
            return [stretch]
        body = stretch[1:] if stretch[:1] == " " else stretch
        if body.isalpha():
            return [stretch]
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return [stretch[:-1], body[-1]]
        return [m.group() for m in self.pattern.finditer(stretch)]

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches that aren't known yet."""
        cut = [self.cut(x) for x in stretches]
        distinct = list({w for c in cut for w in c})
        of = dict(zip(distinct, self.words(distinct)))
        self.known.update((x, of[c[0]] if len(c) == 1 else b"".join([of[w] for w in c])) for x, c in zip(stretches, cut))

    def forget(self) -> None:
        """Keeps only the stretches learnt first, which are mostly the frequent ones."""
        if len(self.known) > RETAINED:
            self.known = dict(islice(self.known.items(), RETAINED))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else self.stretches(t) for t in texts]
        every = set()
        for s in split:
            if s:
                every.update(s)
        missing = every.difference(self.known)
        if missing:
            if len(self.known) + len(missing) > KEPT:
                self.forget()
                missing = every.difference(self.known)
            self.learn(list(missing))
        known = self.known
        return [None if s is None else np.frombuffer(b"".join([known[w] for w in s]), np.int32) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def encoder(path: str = RANKS, pattern: str = PATTERN) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, pattern)


def _groups(texts: list, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    k, held = 0, 0
    for j, t in enumerate(texts):
        held += len(t or "")
        if held > most:
            yield k, j + 1
            k, held = j + 1, 0
    if k < len(texts):
        yield k, len(texts)


def _encode(path: str, pattern: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for x, y in _groups(texts):
                got = enc.encode_batch(texts[x:y])
                sizes = np.array([0 if g is None else len(g) for g in got], np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                none = pa.array([g is None for g in got], pa.bool_())
                values = pa.array(np.concatenate([g for g in got if g is not None]) if any(g is not None for g in got) else np.zeros(0, np.int32), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=none)
                count = pa.array([None if g is None else len(g) for g in got], pa.int32())
                same = pa.array([None if g is None else enc.decode(g) == t for g, t in zip(got, texts[x:y])] if check else [None] * (y - x), pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), ids, count, same], names=["doc_id", "tokens", "n_tokens", "round_trip"])
        enc.forget()  # a worker process outlives its tasks and may serve other stages next
        release()

    return run


def encode(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, check: bool = True) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip) of every row.

    Words are cut by `pattern`; what it doesn't match is left out, as is the way with
    such patterns, and round_trip, which tells whether the tokens decode to the text
    again (null without `check`), is false then. A null text has null
    tokens; an empty text has none. Whole texts are encoded, however long. Repeated
    rows are encoded each by itself; a null doc_id stays null. Other columns are not
    read. An empty table gives an empty result. Special tokens' strings in a text are
    ordinary text.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).mapInArrow(_encode(path, pattern, check), "doc_id long, tokens array<int>, n_tokens int, round_trip boolean")


def decode(tokens: DataFrame, path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens).

    Null tokens give a null text, no tokens an empty one. Repeated rows are decoded each
    by itself; a null doc_id stays null. Other columns are not read. An empty table
    gives an empty result.
    """
    prepare(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            texts = [None if t is None else enc.decode(np.array(t, np.int64)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("i"), F.col("tokens").cast("array<int>").alias("t")).mapInArrow(run, "doc_id long, text string")
