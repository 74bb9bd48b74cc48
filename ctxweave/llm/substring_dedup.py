"""Substring deduplication by paragraph MinHash banding.

A paragraph is a line. As passages are also pasted into the middle of lines, every
window of a few words of a text is looked up as well, so a passage is found up to its
first and last word wherever it stands and however it is punctuated.

1. Paragraphs get MinHash signatures over word n-grams in bands tuned to the threshold
   and the recall asked for. Windows are anchored at their least word gram. Only 4 bytes
   of an anchor and 8 of a band go to the ranges that count them; a bit each comes back
   to the batch of texts that it came from, which travels compressed.
2. A batch sends on the windows whose anchor occurs elsewhere, and the paragraphs that
   share a band with another content, so nothing unlike all else is moved as words.
3. The different contents of a bucket are brought together, and exact Jaccard similarity
   of their n-gram sets decides on every pair that isn't linked already. A bucket of
   over `BLOCK` contents is dealt out as pairs of blocks.
4. Similar contents form components. All but the first occurrence in each component,
   by doc_id and place, are removals, as are windows that an earlier document has (they
   are the same where 96 bits of hashes are); neighbouring removals of a document make
   a run, and runs of at least `least_words` words are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxweave.llm import exchange, graph, grams
from ctxweave.runtime import prepare, shuffle_width

THRESHOLD, RECALL, ROWS, N, LEAST_PARAGRAPH, LEAST_WORDS = 0.7, 0.95, 3, 3, 8, 20
BLOCK, WINDOW, BATCH = 4096, 0.6, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def tune_bands(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands of `rows` rows that a pair at the threshold collides in with probability `recall`."""
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold and recall must lie in (0, 1)")
    miss = 1 - threshold**rows
    return 1 if miss <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def _fold(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words; order counts. first: starts, with an end."""
    sizes = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], sizes)
    odd = grams.mix(np.arange(1, int(sizes.max()) + 1, dtype=np.uint64)) | np.uint64(1)
    return grams.mix(np.add.reduceat(h * odd[place], first[:-1]) + sizes.astype(np.uint64))


class Pieces:
    """Words and lines of a batch of texts; rows, places and hashes of spans of words."""

    def __init__(self, text: pa.Array):
        w = grams.words(text, lower=False)
        self.w, n = w, len(w.hashes)
        self.rows = w.rows
        self.first = w.first[:-1]
        self.lines = np.zeros((0, 2), np.int64)
        self._chars: np.ndarray | None = None
        self._same: np.ndarray | None = None
        if n == 0:
            return
        line = np.searchsorted(np.flatnonzero(w.raw == 10), w.starts)
        head = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (self.rows[1:] != self.rows[:-1]))))
        self.lines = np.stack([head, np.append(head[1:], n)], axis=1)

    def varied(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a to b are more than one word said again and again."""
        if self._same is None:
            h = self.w.hashes
            self._same = np.concatenate(([0, 0], np.cumsum(h[1:] == h[:-1])))
        return self._same[b] - self._same[np.minimum(a + 1, b)] < np.maximum(b - a - 1, 1)

    @property
    def chars(self) -> np.ndarray:
        """Number of characters up to and with each byte."""
        if self._chars is None:
            self._chars = np.cumsum((self.w.raw & 0xC0) != 0x80)
        return self._chars

    def joined(self, spans: np.ndarray) -> grams.Words:
        """The words of the spans alone, each span as a row."""
        sizes = spans[:, 1] - spans[:, 0]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(spans[:, 0], sizes)
        none = np.zeros(0, np.int64)
        return grams.Words(self.w.hashes[at], none, none, np.concatenate(([0], np.cumsum(sizes))), self.w.raw, none)

    def hashes(self, spans: np.ndarray) -> np.ndarray:
        j = self.joined(spans)
        return _fold(j.hashes, j.first) if len(spans) else np.zeros(0, np.uint64)

    def bytes(self, spans: np.ndarray) -> list[bytes]:
        raw, w = self.w.raw.tobytes(), self.w
        return [raw[a:b] for a, b in zip(w.starts[spans[:, 0]].tolist(), w.ends[spans[:, 1] - 1].tolist())]

    def places(self, spans: np.ndarray) -> dict[str, np.ndarray]:
        """Row, first and end character, first and end word, counted within the row's text."""
        row = self.rows[spans[:, 0]]
        w, base = self.w, self.first[row]
        before = np.where(w.offsets[row] > 0, self.chars[np.maximum(w.offsets[row] - 1, 0)], 0)
        return {
            "row": row,
            "start": self.chars[w.starts[spans[:, 0]]] - 1 - before,
            "end": self.chars[w.ends[spans[:, 1] - 1] - 1] - before,
            "word": spans[:, 0] - base,
            "word_end": spans[:, 1] - base,
        }


def _powers(x: int, n: int) -> np.ndarray:
    """x to the powers 0 to n, modulo 2**64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))), dtype=np.uint64)


class Windows:
    """Every window of `size` words of a text, in runs: key, first word and number of windows of each run.

    The key is the least gram of a window. Windows that follow each other tend to share
    it, so they go under one key, and the same window has the same key anywhere.
    """

    def __init__(self, p: Pieces, size: int):
        h, n = p.w.hashes, len(p.w.hashes)
        self.size, none = size, np.zeros(0, np.int64)
        self.key, self.at, self.n, self.sums = none.astype(np.uint64), none, none, none.astype(np.uint64)
        q, m = max(1, size // 3), n - size + 1
        if m < 1:
            return
        end = np.repeat(p.w.first[1:], np.diff(p.w.first))
        at = np.flatnonzero(np.arange(n) + size <= end)
        at = at[p.varied(at, at + size)]
        if not len(at):
            return
        up = _powers(_BASE, n)
        self.back = _powers(_BACK, n)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)))
        g = grams.mix((self.sums[q:] - self.sums[: n - q + 1]) * self.back[: n - q + 1])
        span = size - q + 1  # grams of a window
        low = np.uint64((1 << span.bit_length()) - 1)
        least, wide = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low), 1
        while wide < span:
            step = min(wide, span - wide)
            least, wide = np.minimum(least[: len(least) - step], least[step:]), wide + step
        begin = np.arange(m, dtype=np.uint64)
        place = (begin + ((least[:m] - begin) & low)).astype(np.int64)[at]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(place) != 0))))
        self.key, self.at, self.n = g[place[first]], at[first], np.diff(np.append(first, len(at)))

    def hashes(self, first: np.ndarray) -> np.ndarray:
        """A hash of 32 bits of the windows that begin at these words."""
        return (grams.mix((self.sums[first + self.size] - self.sums[first]) * self.back[first]) >> np.uint64(32)).astype(np.uint32)


def _groups(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest doc of each record's key."""
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    n, out = np.diff(np.append(first, len(key))), (np.zeros(len(key), np.int64), np.zeros(len(key), np.int64))
    for x, ufunc in zip(out, (np.minimum, np.maximum)):
        x[order] = np.repeat(ufunc.reduceat(doc[order], first), n)
    return out


def _flag_windows(parts: list[tuple[np.ndarray, ...]], size: int) -> tuple[np.ndarray, ...]:
    """(doc, start, end, word, word_end, keep) of stretches whose windows stand in an earlier document too."""
    key, doc, word, base, n, own, start, end = (np.concatenate(x) for x in zip(*parts))
    low, high = _groups(key, doc)
    taken = low < high
    flat, run = np.repeat(taken, n), np.repeat(np.flatnonzero(taken), n[taken])
    none = np.zeros(0, np.int64)
    if not len(run):
        return (none,) * 6
    off = np.arange(n.sum())[flat] - (np.cumsum(n) - n)[run]
    own, start, end = own[flat], start[flat].astype(np.int64), end[flat].astype(np.int64)
    keep, _ = _groups(grams.mix(key[run] + grams.mix(own.astype(np.uint64) + np.uint64(1))), doc[run])
    x = np.flatnonzero(keep != doc[run])
    if not len(x):
        return (none,) * 6
    first = np.flatnonzero(np.concatenate(([True], (np.diff(x) != 1) | (np.diff(run[x]) != 0) | (np.diff(keep[x]) != 0))))
    a, b = x[first], x[np.append(first[1:], len(x)) - 1]
    r = run[a]
    return doc[r], base[r] + start[a], base[r] + end[b], word[r] + off[a], word[r] + off[b] + size, keep[a]


def line_sets(p: Pieces, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word n-grams of each line; (grams, first of each line with an end)."""
    g, rows = grams.ngrams(p.joined(spans), N)
    return grams.unique_per_row(g, rows, len(spans))


def band_keys(sets: np.ndarray, first: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Key of each band of each line's MinHash signature, (lines, bands)."""
    out = np.zeros((len(first) - 1, bands), np.uint64)
    if not len(out):
        return out
    for b in range(bands):
        key = np.full(len(out), b + 1, np.uint64)
        for r in range(rows):
            seed = grams.mix(np.array([b * rows + r + 1], np.uint64))[0]
            key = grams.mix(key ^ np.minimum.reduceat((sets ^ seed) * (seed | np.uint64(1)), first[:-1]))
        out[:, b] = key
    return out


def _range(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(33)) % np.uint64(ranges)).astype(np.int32)


class Batch:
    """Anchors and bands of a batch of texts, in an order that hangs on the batch alone."""

    def __init__(self, texts: pa.Array, bands: int, size: int, least: int, keep: bool):
        self.parts, keys, self.h, own = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros((0, bands), np.uint64)]
        for at, text in grams.pieces(texts):
            p = Pieces(text)
            w = Windows(p, size)
            lines = p.lines[(p.lines[:, 1] - p.lines[:, 0] >= least) & p.varied(*p.lines.T)]
            h, x = np.unique(p.hashes(lines), return_index=True)
            keys.append(w.key)
            if len(lines):
                own.append(band_keys(*line_sets(p, lines[x]), bands))
                self.h.append(h)
            if keep:
                self.parts.append((at, p, w, lines))
        self.anchors, self.bands, self.h = np.concatenate(keys), np.concatenate(own).ravel(), np.concatenate(self.h)


_INDEX = "r int, m long, kind int, a binary, b binary"
_BITS = "m long, kind int, r int, a binary, b binary"
_BLOB = "r int, kind int, key binary, a binary, b binary, c binary, d binary, e binary"
_FOUND = "kind int, doc_id long, start int, end int, word int, word_end int, keep_doc_id long, line binary"


def _map(bands: int, ranges: int, size: int, least: int):
    """Map: (id, text) to the batch's anchors (kind 0) and bands with contents (kind 1) by range, and the batch itself (kind 2)."""

    def emit(ids: pa.Array, texts: pa.Array, m: int) -> Iterator[pa.RecordBatch]:
        b = Batch(texts, bands, size, least, False)
        sig = np.repeat(b.h.astype(np.uint32), bands)
        for kind, key, cols in ((0, b.anchors, {}), (1, b.bands, {"b": sig})):
            for out in exchange.scatter(_range(key, ranges), {"a": key.astype(np.uint32)} | cols, len(key) + 1):
                n = out.num_rows
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.full(n, m)), pa.array(np.full(n, kind, np.int32)), out.column(1), out.column(2) if cols else pa.nulls(n, pa.binary())], names=["r", "m", "kind", "a", "b"])
        packed = pa.BufferOutputStream()
        table = pa.record_batch([ids, texts], names=["i", "t"])
        with pa.ipc.new_stream(packed, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
            w.write_batch(table)
        yield pa.RecordBatch.from_arrays([pa.array([m % ranges], pa.int32()), pa.array([m]), pa.array([2], pa.int32()), pa.array([packed.getvalue().to_pybytes()]), pa.nulls(1, pa.binary())], names=["r", "m", "kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = TaskContext.get().partitionId() << 24
        parts, held = [], 0
        for b in batches:
            b = b.filter(pc.is_valid(b.column(0)))
            for at, text in grams.pieces(b.column(1)):
                parts.append((b.column(0).slice(at, len(text)), text.cast(pa.large_string())))
                held += text.nbytes
                if held >= BATCH:
                    yield from emit(*map(pa.concat_arrays, zip(*parts)), m)
                    parts, held, m = [], 0, m + 1
                    grams.release()
        if parts:
            yield from emit(*map(pa.concat_arrays, zip(*parts)), m)
        grams.release()

    return run


def _count(table: pa.Table) -> pa.Table:
    """Of one range: whether each anchor and band occurs again, and whether a band's contents differ, as bits for the batch; batches pass through."""
    r = table.column("r")[0].as_py()
    cols = {k: table.column(k).to_pylist() for k in ("m", "kind", "a", "b")}
    out = [[], [], [], [], []]
    for kind in (0, 1):
        own = [k for k, x in enumerate(cols["kind"]) if x == kind]
        if not own:
            continue
        key = np.concatenate([np.frombuffer(cols["a"][k], np.uint32) for k in own])
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        n = np.diff(np.append(heads, len(key)))
        again, differs = np.zeros(len(key), bool), np.zeros(len(key), bool)
        again[order] = np.repeat(n > 1, n)
        if kind:
            sig = np.concatenate([np.frombuffer(cols["b"][k], np.uint32) for k in own])[order]
            differs[order] = np.repeat(np.minimum.reduceat(sig, heads) != np.maximum.reduceat(sig, heads), n)
        at = 0
        for k in own:
            to = at + len(cols["a"][k]) // 4
            for c, v in zip(out, (cols["m"][k], kind, r, np.packbits(again[at:to]).tobytes(), np.packbits(differs[at:to]).tobytes() if kind else None)):
                c.append(v)
            at = to
    for k in [k for k, x in enumerate(cols["kind"]) if x == 2]:
        for c, v in zip(out, (cols["m"][k], 2, r, cols["a"][k], None)):
            c.append(v)
    return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["m", "kind", "r", "a", "b"])


def _back(r: np.ndarray, rows: dict[int, bytes]) -> np.ndarray:
    """The bits that came back for records of the ranges r."""
    order, n = np.argsort(r, kind="stable"), np.bincount(r)
    bits = [np.unpackbits(np.frombuffer(rows[k], np.uint8), count=int(n[k])).astype(bool) for k in np.flatnonzero(n)]
    out = np.zeros(len(r), bool)
    out[order] = np.concatenate(bits) if bits else False
    return out


def _repeated(bands: int, ranges: int, size: int, least: int):
    """Of one batch: windows of anchors that occur again (kind 2, or 3 where windows are long), bands of different contents (1), lines that occur again (5) and contents (4)."""

    def run(table: pa.Table) -> pa.Table:
        rows: dict[tuple[int, int], tuple] = {(k, r): (a, b) for k, r, a, b in zip(*(table.column(c).to_pylist() for c in ("kind", "r", "a", "b")))}
        got = pa.ipc.open_stream(next(a for (k, _), (a, _) in rows.items() if k == 2)).read_all().combine_chunks()
        ids, texts = got.column(0).to_numpy().astype(np.int64), got.column(1).combine_chunks() if isinstance(got.column(1), pa.ChunkedArray) else got.column(1)
        b = Batch(texts, bands, size, least, True)
        anchors = _back(_range(b.anchors, ranges), {r: x[0] for (k, r), x in rows.items() if k == 0})
        of_band = _range(b.bands, ranges)
        again, differs = (_back(of_band, {r: x[j] for (k, r), x in rows.items() if k == 1}) for j in (0, 1))
        out: list[pa.RecordBatch] = []
        # lines
        repeated = np.unique(b.h[again.reshape(-1, bands).any(axis=1)])
        different = np.unique(b.h[differs.reshape(-1, bands).any(axis=1)])
        h = np.repeat(b.h, bands)[differs]
        if len(h):
            pairs = np.unique(np.stack([b.bands[differs], h]), axis=1)
            out += _blobs(1, _range(pairs[0], ranges), list(pairs))
        # windows
        runs, at = [], 0
        for first, p, w, lines in b.parts:
            mask = anchors[at : at + len(w.key)]
            at += len(w.key)
            if mask.any():
                runs.append(_runs(p, w, mask, ids[first:]))
            own = p.hashes(lines)
            x = np.flatnonzero(np.isin(own, repeated))
            if len(x):
                place = p.places(lines[x])
                out += _blobs(5, _range(own[x], ranges), [own[x], ids[first:][place["row"]], *(place[k].astype(np.uint32) for k in ("start", "end", "word", "word_end"))])
            x = np.flatnonzero(np.isin(own, different))
            x = x[np.unique(own[x], return_index=True)[1]]
            if len(x):
                text, r = p.bytes(lines[x]), _range(own[x], ranges)
                for k in np.unique(r):
                    t = [text[y] for y in np.flatnonzero(r == k)]
                    out.append(_row(int(k), 4, own[x][r == k], np.array([len(y) for y in t], np.uint32), b"".join(t)))
        if runs:
            out += _window_blobs(*(np.concatenate(c) for c in zip(*runs)), ranges)
        grams.release()
        return pa.Table.from_batches(out, _SCHEMA)

    return run


_NAMES = ["r", "kind", "key", "a", "b", "c", "d", "e"]
_SCHEMA = pa.schema([(n, pa.int32() if k < 2 else pa.binary()) for k, n in enumerate(_NAMES)])


def _row(r: int, kind: int, *cols: np.ndarray | bytes) -> pa.RecordBatch:
    values = [c if isinstance(c, bytes) else c.tobytes() for c in cols]
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([kind], pa.int32()), *(pa.array([v], pa.binary()) for v in [*values, *[None] * (6 - len(values))])], schema=_SCHEMA)


def _blobs(kind: int, r: np.ndarray, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for out in exchange.scatter(r, dict(zip(_NAMES[2:], cols))):
        none = pa.nulls(out.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.full(out.num_rows, kind, np.int32)), *(out.column(k + 1) if k < len(cols) else none for k in range(6))], schema=_SCHEMA)


def _runs(p: Pieces, w: Windows, mask: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, doc, first word, first character and windows of the runs of the mask; hash, start and end of each window."""
    key, at, n = w.key[mask], w.at[mask], w.n[mask]
    first = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    x = p.places(np.stack([at, at + w.size], axis=1))
    base = np.repeat(p.chars[p.w.starts[at]], n)
    start, end = p.chars[p.w.starts[first]] - base, p.chars[p.w.ends[first + w.size - 1] - 1] - base + 1
    return key, ids[x["row"]], x["word"], x["start"], n, w.hashes(first), start, end


def _window_blobs(key: np.ndarray, doc: np.ndarray, word: np.ndarray, base: np.ndarray, n: np.ndarray, own: np.ndarray, start: np.ndarray, end: np.ndarray, ranges: int) -> Iterator[pa.RecordBatch]:
    kind, small = (2, np.uint16) if end.max() < 1 << 16 else (3, np.uint32)
    r = _range(key, ranges)
    order = np.argsort(r, kind="stable")
    r, size_of, begin = r[order], n[order], (np.cumsum(n) - n)[order]
    every = np.repeat(begin - (np.cumsum(size_of) - size_of), size_of) + np.arange(n.sum())
    cols = [c[order] for c in (key, doc, word.astype(np.uint32), base.astype(np.uint32), n.astype(np.uint32))]
    flat = [own[every], start[every].astype(small), end[every].astype(small)]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)]))
    edge = np.concatenate(([0], np.cumsum(size_of)))[cut]
    for k in range(len(cut) - 1):
        yield _row(int(r[cut[k]]), kind, *(c[cut[k] : cut[k + 1]] for c in cols), b"".join(c[edge[k] : edge[k + 1]].tobytes() for c in flat))


def _window_runs(table: pa.Table, small: type) -> tuple[np.ndarray, ...]:
    """key, doc, word, base and number of windows of each run; hash, start and end of each window."""
    g = exchange.gather(table, {"key": np.uint64, "a": np.int64, "b": np.uint32, "c": np.uint32, "d": np.uint32})
    own: list[list[np.ndarray]] = [[], [], []]
    step = np.dtype(small).itemsize
    for blob in table.column("e").to_pylist():
        n = len(blob) // (4 + 2 * step)
        for x, kind, at in zip(own, (np.uint32, small, small), (0, 4 * n, (4 + step) * n)):
            x.append(np.frombuffer(blob, kind, n, at))
    return (*(g[k].astype(np.int64) if k in "bcd" else g[k] for k in g), *(np.concatenate(x) for x in own))


def _collide(table: pa.Table, size: int) -> pa.Table:
    """Of one range: repeated windows (kind 0), buckets of different lines that share a band (1: content, bucket), occurrences of lines (2) and contents (3)."""
    kinds = np.array(table.column("kind").to_pylist())
    names = ("kind", "doc_id", "start", "end", "word", "word_end", "keep_doc_id")
    out, lines = {k: [np.zeros(0, np.int64)] for k in names}, []

    def put(kind: int, *cols: np.ndarray) -> None:
        for k, v in zip(names, (np.full(len(cols[0]), kind), *cols)):
            out[k].append(v.view(np.int64) if v.dtype == np.uint64 else v)
        lines.append(pa.nulls(len(cols[0]), pa.binary()))

    runs = [_window_runs(table.filter(pa.array(kinds == k)), small) for k, small in ((2, np.uint16), (3, np.uint32)) if (kinds == k).any()]
    if runs:
        put(0, *_flag_windows(runs, size))
    if (kinds == 1).any():
        g = exchange.gather(table.filter(pa.array(kinds == 1)), {"key": np.uint64, "a": np.uint64})
        order = np.lexsort((g["a"], g["key"]))
        key, h = g["key"][order], g["a"][order].astype(np.int64)
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
        a, b = buckets(key[fresh], h[fresh])
        z = np.zeros(len(a), np.int32)
        put(1, a, z, z, z, z, b)
    if (kinds == 5).any():
        g = exchange.gather(table.filter(pa.array(kinds == 5)), {"key": np.uint64, "a": np.int64, "b": np.uint32, "c": np.uint32, "d": np.uint32, "e": np.uint32})
        put(2, g["a"], g["b"], g["c"], g["d"], g["e"], g["key"])
    contents: dict[int, bytes] = {}
    own = table.filter(pa.array(kinds == 4))
    for key, sizes, text in zip(*(own.column(c).to_pylist() for c in ("key", "a", "b"))):
        end = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
        contents.update((h, text[x:y]) for h, x, y in zip(np.frombuffer(key, np.int64).tolist(), np.append(0, end[:-1]).tolist(), end.tolist()))
    if contents:
        z = np.zeros(len(contents), np.int32)
        put(3, np.array(list(contents), np.int64), z, z, z, z, z)
        lines[-1] = pa.array(list(contents.values()), pa.binary())
    cols = [pa.array(np.concatenate(v).astype(np.int64 if k in ("doc_id", "keep_doc_id") else np.int32)) for k, v in out.items()]
    return pa.table([*cols, pa.concat_arrays(lines) if lines else pa.nulls(0, pa.binary())], names=[*names, "line"])


def buckets(key: np.ndarray, h: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(content, bucket) of the buckets of several contents; both sorted by key, then content.

    A bucket's name is a hash of its members, so the same bucket of another band has the
    same name. A bucket of over `block` members becomes one bucket for each two blocks.
    """
    if not len(h):
        return h, h
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key)))
    name = grams.mix(np.add.reduceat(grams.mix(h.view(np.uint64)), first) + n.astype(np.uint64)).view(np.int64)
    plain = np.repeat((n > 1) & (n <= block), n)
    out_h, out_name = [h[plain]], [np.repeat(name, n)[plain]]
    for k in np.flatnonzero(n > block):
        parts = np.array_split(h[first[k] : first[k] + n[k]], -(-int(n[k]) // block))
        for x in range(len(parts)):
            for y in range(x + 1, len(parts)):
                both = np.concatenate((parts[x], parts[y]))
                own = grams.mix(name[k : k + 1].view(np.uint64) + np.uint64(x * len(parts) + y + 1)).view(np.int64)
                out_h.append(both)
                out_name.append(np.repeat(own, len(both)))
    return np.concatenate(out_h), np.concatenate(out_name)


def links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of similar sets that link all that similar pairs link; pairs linked already aren't compared."""
    sizes = np.array([len(x) for x in sets])
    first = np.cumsum(sizes) - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    part, out, mark = np.arange(len(sets)), [], np.zeros(len(values), bool)
    for k in range(len(sets) - 1):
        j = k + 1 + np.flatnonzero(part[k + 1 :] != part[k])
        n = sizes[j]
        j = j[np.minimum(n, sizes[k]) >= threshold * np.maximum(n, sizes[k]) - 1e-9]
        if not len(j):
            continue
        n = sizes[j]
        own = ids[first[k] : first[k] + sizes[k]]
        mark[own] = True
        begin = np.cumsum(n) - n
        shared = np.add.reduceat(mark[ids[np.arange(n.sum()) + np.repeat(first[j] - begin, n)]], begin, dtype=np.int64)
        mark[own] = False
        j = j[shared >= threshold * (n + sizes[k] - shared) - 1e-9]
        for c in np.unique(part[j]):
            out.append((k, int(j[part[j] == c][0])))
            part[part == c] = part[k]
    return out


def _verified(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        name, h = table.column("name").to_numpy(), table.column("h").to_numpy()
        _, at, of = np.unique(h, return_index=True, return_inverse=True)
        text = table.column("line").take(pa.array(at)).combine_chunks()
        sets = []
        for _, part in grams.pieces(text.cast(pa.large_binary()).view(pa.large_string())):
            p = Pieces(part)
            values, first = line_sets(p, np.stack([p.w.first[:-1], p.w.first[1:]], axis=1))
            sets += [values[x:y] for x, y in zip(first[:-1], first[1:])]
        order = np.lexsort((h, name))
        cuts = np.flatnonzero(np.diff(name[order])) + 1
        a, b = [], []
        for own in np.split(order, cuts):
            for x, y in links([sets[k] for k in of[own]], threshold):
                a.append(h[own[x]])
                b.append(h[own[y]])
        grams.release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def repeats(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, least_words: int = LEAST_WORDS, gap: int = 2, least_paragraph: int = LEAST_PARAGRAPH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words, keep_doc_id): each stretch that repeats an earlier document's.

    start and end count characters of the text; n_words counts the repeated words;
    keep_doc_id is the document that keeps the first repeated piece of the stretch.
    Pieces are windows of 0.6 * least_words words, which are found in all cases, and
    whole lines of at least `least_paragraph` words; a shorter line is only looked up
    in windows that reach over it. Pieces at most `gap` words apart are one stretch.
    Repetitions within one document are left alone, windows and lines of one word over
    and over among them, and so are stretches of less than `least_words` words. Rows with a null id, and null, empty and blank texts, give
    nothing. Rows of one id are one document. Other columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    ranges = shuffle_width(spark)
    size = max(1, round(WINDOW * least_words))
    how = (tune_bands(threshold, recall), ranges, size, least_paragraph)
    texts = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    counted = texts.mapInArrow(_map(*how), _INDEX).groupBy("r").applyInArrow(_count, _BITS)
    found = counted.groupBy("m").applyInArrow(_repeated(*how), _BLOB).groupBy("r").applyInArrow(lambda t: _collide(t, size), _FOUND).checkpoint()
    members = found.where("kind = 1").select(F.col("doc_id").alias("h"), F.col("keep_doc_id").alias("name")).distinct()
    content = found.where("kind = 3").select(F.col("doc_id").alias("h"), "line")
    both = members.join(content, "h").select(F.pmod(F.xxhash64("name"), F.lit(ranges)).alias("r"), "name", "h", "line")
    similar = both.groupBy("r").applyInArrow(_verified(threshold), "a long, b long")
    component = graph.components(similar)
    held = found.where("kind = 2").select(F.col("keep_doc_id").alias("h"), "doc_id", "start", "end", "word", "word_end")
    near = held.join(component, held["h"] == component["id"], "left").select(F.coalesce("component", "h").alias("component"), "doc_id", "start", "end", "word", "word_end")
    keep = near.groupBy("component").agg(F.min("doc_id").alias("keep_doc_id"))
    near = near.join(keep, "component").where("doc_id <> keep_doc_id")
    names = ["doc_id", "start", "end", "word", "word_end", "keep_doc_id"]
    flags = found.where("kind = 0").select(*names).union(near.select(*names))
    by = Window.partitionBy("doc_id").orderBy("word", "word_end", "keep_doc_id", "start")
    reach = F.max("word_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = flags.withColumn("reach", reach).withColumn("run", F.sum((F.coalesce(F.col("word") - F.col("reach") > gap, F.lit(True))).cast("int")).over(by))
    fresh = F.greatest(F.col("word_end") - F.greatest("word", F.coalesce("reach", F.lit(0))), F.lit(0))
    return (
        runs.groupBy("doc_id", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(fresh).alias("n_words"), F.min(F.struct("word", "keep_doc_id")).alias("k"))
        .where(F.col("n_words") >= least_words)
        .select("doc_id", "start", "end", "n_words", F.col("k.keep_doc_id").alias("keep_doc_id"))
    )
