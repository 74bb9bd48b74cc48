"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items' word n-grams form a hash set; one pass over all documents finds where
they occur and counts in how many documents each occurs. An n-gram seeds its item where
it is rare, that is in no more than a share of all documents. An item is thought of as a
few stretches, and a stretch without a rare n-gram, as of an item that is copied widely,
is seeded by its rarest one, so common n-grams seed no more than that. Seed positions of a document and an item that lie near one another make one window,
which is aligned with the whole item word by word by Smith-Waterman; edits, insertions
and deletions cost score, and the score over the item's perfect score decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.llm import grams
from ctxweave.runtime import prepare

N, SHARE, LEAST, MATCH, MISMATCH, GAP, THRESHOLD, STRETCHES, PART = 3, 0.001, 2, 2, -1, -1, 0.5, 16, 8_000_000
RESULT = "doc_id long, item_id long, score double, start_word long, end_word long"


def smith_waterman(a: np.ndarray, b: np.ndarray, b_len: np.ndarray, a_len: np.ndarray, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Best local score and the end column (exclusive, in b) of each pair; rows of a and b are padded.

    One pass over the rows of a, all pairs and columns at once; a gap within a row is a
    running maximum because gaps cost the same for each word.
    """
    pairs, wide = b.shape
    h = np.zeros((pairs, wide + 1), np.int32)
    best, where = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64)
    valid = np.arange(wide)[None, :] < b_len[:, None]
    ramp = (np.arange(wide + 1) * -gap).astype(np.int32)[None, :]
    for i in range(a.shape[1]):
        live = i < a_len
        if not live.any():
            break
        step = np.where((a[:, i : i + 1] == b) & valid & live[:, None], match, mismatch)
        new = np.zeros_like(h)
        np.maximum(h[:, :-1] + step, h[:, 1:] + gap, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        new[:, 1:][~valid] = 0
        h = np.where(live[:, None], new, h)
        top = new[:, 1:].max(axis=1)
        better = live & (top > best)
        where = np.where(better, new[:, 1:].argmax(axis=1) + 1, where)
        best = np.maximum(best, np.where(live, top, 0))
    return best, where


def align_start(a: np.ndarray, b: np.ndarray, end: int, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP) -> int:
    """First word in b of the best alignment that ends at `end`: the same search on reversed words."""
    _, e = smith_waterman(a[None, ::-1], b[None, :end][:, ::-1], np.array([end]), np.array([len(a)]), match, mismatch, gap)
    return end - int(e[0])


class Items:
    """Test items as arrays: words, n-grams, and which item has an n-gram where."""

    def __init__(self, ids: list[int], texts: list[str], n: int = N):
        w = grams.words(pa.array(texts, pa.large_string()))
        self._build(np.array(ids, np.int64), w, n)

    def __getstate__(self) -> tuple:
        """Hashes of the words alone; a task makes the rest anew."""
        return self.ids, np.concatenate([*self.words, np.zeros(0, np.uint64)]), self.sizes, self.n

    def __setstate__(self, state: tuple) -> None:
        ids, hashes, sizes, n = state
        none = np.zeros(0, np.int64)
        self._build(ids, grams.Words(hashes, none, none, np.concatenate(([0], np.cumsum(sizes))), none, none), n)

    def _build(self, ids: np.ndarray, w: grams.Words, n: int) -> None:
        self.n = n
        self.words = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.ids = ids
        g, rows = grams.ngrams(w, n)
        at = np.arange(len(g)) - np.searchsorted(rows, rows) if len(g) else np.zeros(0, np.int64)
        order = np.argsort(g, kind="stable")
        self.grams, self.rows, self.at = g[order], rows[order], at[order]
        self.distinct, self.first = np.unique(self.grams, return_index=True)
        self.first = np.append(self.first, len(self.grams))
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.distinct >> np.uint64(42)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in g that hold a gram of an item, its index among distinct grams)."""
        p = np.flatnonzero(self.filter[(g >> np.uint64(42)).astype(np.int64)])
        if not len(p) or not len(self.distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.distinct, g[p])
        ok = (k < len(self.distinct)) & (self.distinct[np.minimum(k, len(self.distinct) - 1)] == g[p])
        return p[ok], k[ok]


def _document_counts(items: Items):
    """Of one task: in how many documents each gram of an item occurs, and under -1 how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(items.distinct), np.int64), 0
        for b in batches:
            total += b.num_rows
            for _, text in grams.pieces(b.column(0)):
                g, rows = grams.ngrams(grams.words(text), items.n)
                p, k = items.find(g)
                pairs = np.unique(rows[p] * len(counts) + k) if len(p) else p
                counts += np.bincount(pairs % max(1, len(counts)), minlength=len(counts))
        some = np.flatnonzero(counts)
        grams.release()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(counts[some], total))], names=["gram", "n"])

    return run


def windows(items: Items, least: int, k: np.ndarray, place: np.ndarray, n_words: int) -> list[tuple[int, int, int]]:
    """(item, first word, end word) of each stretch of a document that seeds an item.

    Seeds whose implied item starts lie within an item's length of one another share
    one window, which reaches over the whole item with a quarter of slack at each end.
    A window needs `least` seeds, or all grams of an item that has fewer.
    """
    if not len(k):
        return []
    many = items.first[k + 1] - items.first[k]
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.first[k], many)
    item, begin = items.rows[at], np.repeat(place, many) - items.at[at]
    order = np.lexsort((begin, item))
    item, begin = item[order], begin[order]
    out = []
    cut = np.concatenate(([True], (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > items.sizes[item[1:]])))
    heads = np.append(np.flatnonzero(cut), len(item))
    for x, y in zip(heads[:-1], heads[1:]):
        size = int(items.sizes[item[x]])
        if y - x < min(least, max(1, size - items.n + 1)):
            continue
        slack = size // 4 + 2
        out.append((int(item[x]), max(0, int(begin[x]) - slack), min(n_words, int(begin[y - 1]) + size + slack)))
    return out


def matches(items: Items, rare: np.ndarray, column: pa.Array, least: int, threshold: float, match: int, mismatch: int, gap: int, chunk: int = 500_000) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of each window of a column that reaches the threshold."""
    todo = []
    for at, text in grams.pieces(column):
        w = grams.words(text)
        g, rows = grams.ngrams(w, items.n)
        p, k = items.find(g)
        p, k = p[rare[k]], k[rare[k]]
        if not len(p):
            continue
        row, place = rows[p], p - np.searchsorted(rows, rows[p])
        heads = np.append(np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))), len(row))
        for x, y in zip(heads[:-1], heads[1:]):
            r = int(row[x])
            words = w.hashes[w.first[r] : w.first[r + 1]]
            for item, begin, end in windows(items, least, k[x:y], place[x:y], len(words)):
                todo.append((end - begin, len(items.words[item]), at + r, item, begin, words[begin:end]))
    todo.sort(key=lambda t: (t[0], t[1]))
    out = []
    k = 0
    while k < len(todo):
        j = k + 1
        while j < len(todo) and (j - k + 1) * todo[j][0] <= chunk and todo[j][0] <= 2 * todo[k][0] + 16:
            j += 1
        part = todo[k:j]
        k = j
        wide, tall = max(t[0] for t in part), max(t[1] for t in part)
        b_words, a_words = np.zeros((len(part), wide), np.uint64), np.zeros((len(part), tall), np.uint64)
        for r, t in enumerate(part):
            b_words[r, : t[0]] = t[5]
            a_words[r, : t[1]] = items.words[t[3]]
        a_len, b_len = np.array([t[1] for t in part]), np.array([t[0] for t in part])
        best, end = smith_waterman(a_words, b_words, b_len, a_len, match, mismatch, gap)
        score = best / (match * a_len)
        for r in np.flatnonzero(score >= threshold):
            t = part[r]
            e = int(end[r])
            out.append((t[2], t[3], float(score[r]), t[4] + align_start(items.words[t[3]], t[5], e, match, mismatch, gap), t[4] + e))
    return sorted(out)


def _align(items: Items, rare: np.ndarray, *how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(ids[r], int(items.ids[item]), *rest) for r, item, *rest in matches(items, rare, b.column(1), *how)]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "start_word", "end_word"])
        grams.release()

    return run


def _clean(items: Items, rare: np.ndarray, at: int, *how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[m[0] for m in matches(items, rare, b.column(at), *how)]] = False
            yield b.filter(pa.array(keep))
        grams.release()

    return run


def read_items(benchmark: DataFrame, n: int = N, most: int = PART) -> Iterator[Items]:
    """The test items, in as many parts as keep the texts of each near `most` bytes, which take about eight times that in a task."""
    b = benchmark.select(F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").distinct()
    parts = 1 + (b.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // most
    for part in range(parts):
        got = b.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).orderBy("i", "t").toArrow()
        yield Items(got.column("i").to_pylist(), got.column("t").to_pylist(), n)


def seeded(docs: DataFrame, benchmark: DataFrame, n: int, share: float, text: str = "text", most: int = PART) -> Iterator[tuple[Items, np.ndarray]]:
    """Each part of the items with its rare grams, by one count over all documents."""
    texts = docs.select(F.col(text).cast("string").alias("t")).where("t is not null")
    for items in read_items(benchmark, n, most):
        if not len(items.distinct):
            continue
        counts = texts.mapInArrow(_document_counts(items), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        df = np.zeros(len(items.distinct) + 1, np.int64)
        df[counts.column("gram").to_numpy()] = counts.column("n").to_numpy()  # the last is that of -1
        yield items, rare_seeds(items, df[:-1], int(df[-1]), share)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N, share: float = SHARE, least: int = LEAST, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, most: int = PART) -> DataFrame:
    """Where documents hold test items, whole, edited or in good part: RESULT, best alignment of each window.

    Words are split at ASCII white space after lower-casing; spans count words. Rows
    with a null id or text, empty and blank texts, and items without words give
    nothing. An item of fewer than n words is one gram, which a document has only if it
    is those words and no more: one or two words that stand in other prose are no sign
    of a test item. A repeated row of documents gives a repeated result; a repeated item
    gives one. Other columns are not read. Empty tables give an empty result.

    Documents are read twice, once to count and once to align, and never shuffled. The
    items go to every task; where their texts pass `most` bytes they go in parts, each
    with its own two passes and tasks.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null")
    parts = [texts.mapInArrow(_align(items, rare, least, threshold, match, mismatch, gap), RESULT) for items, rare in seeded(texts, benchmark, n, share, "t", most)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = N, share: float = SHARE, least: int = LEAST, match: int = MATCH, mismatch: int = MISMATCH, gap: int = GAP, text: str = "text", most: int = PART) -> DataFrame:
    """The rows that hold no test item, with all their columns, whatever their names.

    Rows of null, empty and blank texts stay, and so do those of a null id without an
    item; repeated rows stay or go together. An empty table of documents gives an empty
    result, one of items gives all rows. What a part of the items (`most`) leaves is
    written before the next part, so no task holds more than one.
    """
    prepare(docs.sparkSession)
    at, out = docs.columns.index(text), None
    for items, rare in seeded(docs, benchmark, n, share, text, most):
        left = docs if out is None else out.checkpoint()
        out = left.mapInArrow(_clean(items, rare, at, least, threshold, match, mismatch, gap), docs.schema)
    return docs if out is None else out


def rare_seeds(items: Items, df: np.ndarray, total: int, share: float, stretches: int = STRETCHES) -> np.ndarray:
    """Which distinct grams seed.

    A gram is rare if its document count is at most `share` of all documents. Every one
    of the `stretches` equal parts of an item that has no rare gram is seeded by its
    rarest: in an item copied often all grams are frequent, and only a few of them seed.
    """
    limit = max(2.0, share * total)
    rare = df <= limit
    if not len(items.grams):
        return rare
    of = np.searchsorted(items.distinct, items.grams)
    many = np.bincount(items.rows, minlength=len(items.ids))[items.rows]
    part = items.rows * stretches + items.at * np.minimum(stretches, many) // many
    order = np.lexsort((items.at, df[of], part))
    first = np.concatenate(([True], np.diff(part[order]) != 0))
    rare[of[order[first]]] = True
    return rare
