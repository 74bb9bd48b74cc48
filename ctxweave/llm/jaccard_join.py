"""N-gram Jaccard self-join with set-relation skipping.

A document is the set of its word n-grams; the join gives every pair of documents
whose sets have at least the given Jaccard similarity. The join is exact but for chance
matches of hashes: sets are 64 bits; an n-gram is its range and 32 bits, some 38 with
100 ranges, so one pair in some millions may have its overlap off by one; and a gram
that two different sets alone share is lost where their low 32 bits are alike.

1. Each map task sends its distinct sets' n-grams to hash ranges, 4 bytes a gram. The
   range's owner counts in how many distinct sets each gram occurs and returns only
   grams that occur in several; a gram of one set never adds to an overlap.
2. Sets order their grams from rare to frequent. Two similar sets share a gram of
   their prefixes, and the prefix of a set unlike all others holds unshared grams
   only, so it posts nothing. Prefix postings go to the gram's range: the index lists.
3. An index list is blocked by its sets' first lead, their size and the gram's position
   in them. Two blocks whose sizes and positions leave too little room for an overlap
   skip all of their pairs at once. A set's leads are the grams of its prefix with the
   least hashes: a block whose first lead is another list's gram skips its inner pairs,
   as that list has them, and so do single pairs that share another lead of a lesser
   hash than the list's gram. So a pair is met in about one list, however many grams
   it shares. Lists of over `LONG` sets are dealt out as pairs of parts.
4. Candidates meet in groups around a pivot: of the sets of lesser hash that share half
   of a set's leads, so are likely very similar, the least; for want of such a set the
   least it is paired with. The pivot's overlaps with all its group are computed, and
   those of two other sets are derived from these: bounds on them drop pairs unseen,
   and only the differences from the pivot are looked at.

The pairs of a family of different texts that are alike grow with its square, so
`links` and `duplicates` never make rows of them. A set that meets the same least set in
many of its long index lists is of that set's family. A family of `DENSE` sets or more
is compared part by part as matrices of sets by grams, and so are others that meet it in
a list (its visitors). A block gives how many links each set has, and one set that stands
for all that are connected there. No pair is left out or looked at twice: within a family
and with its visitors all are compared, the rest are met and verified as above.

Identical sets are one set throughout and are expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.llm import grams, graph
from ctxweave.runtime import prepare, shuffle_width

_S1 = "r int, m long, kind int, a binary, b binary, c binary, d binary"
_S2 = "m long, kind int, a binary, b binary, c binary, d binary"
_S3 = "r int, kind int, set long, n int, a binary, b binary, c binary, d binary, e binary, f binary"
_FLUSH = 3_000_000
GROUP, LONG = 4000, 4096
#: sets that make a family; sets and grams of a part of one
DENSE, PART, PART_GRAMS = 64, 2000, 2_000_000


def _rows(columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


_B = pa.binary()
_K1 = [pa.int32(), pa.int64(), pa.int32(), _B, _B, _B, _B]
_K2 = [pa.int64(), pa.int32(), _B, _B, _B, _B]
_K3 = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), _B, _B, _B, _B, _B, _B]
_N1 = ["r", "m", "kind", "a", "b", "c", "d"]
_N2 = ["m", "kind", "a", "b", "c", "d"]
_N3 = ["r", "kind", "set", "n", "a", "b", "c", "d", "e", "f"]
_LEAD = 4


def _pack(count: np.ndarray) -> bytes:
    """How many records each set has; most have few, so each takes about a byte once compressed."""
    return count.astype(np.uint16).tobytes() if not len(count) or count.max() < 65536 else b"+" + count.astype(np.uint32).tobytes()


def _owners(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(owner of each record, count of each set)."""
    count = np.frombuffer(packed, np.uint16) if len(packed) % 2 == 0 else np.frombuffer(packed[1:], np.uint32)
    return np.repeat(np.arange(len(count), dtype=np.int32), count), count


def _sets(n: int, ranges: int):
    """Map: (id, text) to the postings of distinct sets, and which id has which set."""

    def emit(parts: list, m: int) -> pa.RecordBatch | None:
        ids = np.concatenate([p[0] for p in parts])
        keys = np.concatenate([p[1] for p in parts])
        values = np.concatenate([p[2] for p in parts])
        sizes = np.concatenate([p[3] for p in parts])
        first = np.concatenate(([0], np.cumsum(sizes)))
        sets, at, of = np.unique(keys, return_index=True, return_inverse=True)
        n_of = sizes[at]
        owner = np.repeat(np.arange(len(sets), dtype=np.uint32), n_of)
        take = np.arange(len(owner), dtype=np.int64)
        take += np.repeat(first[at] - (np.cumsum(n_of) - n_of), n_of)
        g = values[take]
        del take, values
        r = ((g >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
        fp = g.astype(np.uint32)
        del g
        order = np.argsort(r, kind="stable")
        r, fp, owner = r[order], fp[order], owner[order]
        del order
        sig = sets.astype(np.uint32)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)]))
        out = [[], [], [], [], [], [], []]
        for x, y in zip(cuts[:-1], cuts[1:]):
            count = np.bincount(owner[x:y], minlength=len(sets))
            for c, v in zip(out, (int(r[x]), m, 0, fp[x:y].tobytes(), _pack(count), sig[count > 0].tobytes(), None)):
                c.append(v)
        for c, v in zip(out, (m % ranges, m, 1, ids.tobytes(), of.astype(np.uint32).tobytes(), sets.tobytes(), n_of.astype(np.uint32).tobytes())):
            c.append(v)
        return _rows(out, _K1, _N1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = TaskContext.get().partitionId() << 20
        parts, held = [], 0
        for b in batches:
            b = b.filter(pc.is_valid(b.column(0)))
            for at, text in grams.pieces(b.column(1)):
                ids = b.column(0).slice(at, len(text)).to_numpy(zero_copy_only=False).astype(np.int64)
                g, rows = grams.ngrams(grams.words(text), n)
                v, first = grams.unique_per_row(g, rows, len(text))
                sizes = np.diff(first)
                full = sizes > 0
                if not full.any():
                    continue
                sums = np.add.reduceat(grams.mix(v), first[:-1][full])
                keys = grams.mix(sums + sizes[full].astype(np.uint64))
                parts.append((ids[full], keys, v, sizes[full]))
                held += len(v)
                if held > _FLUSH:
                    out, parts = emit(parts, m), []
                    yield out
                    held, m = 0, m + 1
                    grams.release()
        if parts:
            out, parts = emit(parts, m), []
            yield out
        grams.release()

    return run


def _level(df: np.ndarray) -> np.ndarray:
    """A document frequency in one byte: exact to 64, by sixteenths of a doubling above. Only the order of grams hangs on it."""
    return np.where(df <= 64, df, np.minimum(64 + 16 * np.log2(np.maximum(df, 1) / 64.0), 255)).astype(np.uint8)


def _frequencies(table: pa.Table) -> pa.Table:
    """Of one range: grams of several sets, back to where they came from, with their number of sets."""
    out = [[], [], [], [], [], []]
    fps, sigs, owners, ms = [], [], [], []
    cols = {k: table.column(k).to_pylist() for k in ("m", "kind", "a", "b", "c", "d", "r")}
    for k, kind in enumerate(cols["kind"]):
        if kind == 1:
            for c, v in zip(out, (cols["m"][k], 1, cols["a"][k], cols["b"][k], cols["c"][k], cols["d"][k])):
                c.append(v)
            continue
        owner, count = _owners(cols["b"][k])
        fps.append(np.frombuffer(cols["a"][k], np.uint32))
        sigs.append(np.repeat(np.frombuffer(cols["c"][k], np.uint32), count[count > 0]))
        owners.append((owner, len(count)))
        ms.append(cols["m"][k])
    if fps:
        key = (np.concatenate(fps).astype(np.uint64) << np.uint64(32)) | np.concatenate(sigs)
        order = np.argsort(key)
        s = key[order]
        fp = s >> np.uint64(32)
        new_pair = np.concatenate(([True], s[1:] != s[:-1]))
        new_fp = np.concatenate(([True], fp[1:] != fp[:-1]))
        heads = np.flatnonzero(new_fp)
        df = np.add.reduceat(new_pair.astype(np.uint32), heads)
        df_at = np.empty(len(s), np.uint32)
        df_at[order] = np.repeat(df, np.diff(np.concatenate((heads, [len(s)]))))
        x = 0
        for m, f, (o, n) in zip(ms, fps, owners):
            d = df_at[x : x + len(f)]
            x += len(f)
            keep = d > 1
            if keep.any():
                for c, v in zip(out, (m, 0, f[keep].tobytes(), _pack(np.bincount(o[keep], minlength=n)), _level(d[keep]).tobytes(), int(cols["r"][0]).to_bytes(4, "little"))):
                    c.append(v)
    done = pa.Table.from_batches([_rows(out, _K2, _N2)])
    grams.release()
    return done


def _prefixes(threshold: float):
    """Of one batch's sets: prefix postings, the contents of sets that post, and the members."""

    def run(table: pa.Table) -> pa.Table:
        out = [[] for _ in _N3]
        cols = {k: table.column(k).to_pylist() for k in ("kind", "a", "b", "c", "d")}
        meta = [k for k, kind in enumerate(cols["kind"]) if kind == 1]
        own = [k for k, kind in enumerate(cols["kind"]) if kind == 0]
        ids, of = np.frombuffer(cols["a"][meta[0]], np.int64), np.frombuffer(cols["b"][meta[0]], np.uint32)
        sets, n = np.frombuffer(cols["c"][meta[0]], np.uint64), np.frombuffer(cols["d"][meta[0]], np.uint32).astype(np.int64)

        def put(*row) -> None:
            for c, v in zip(out, row):
                c.append(v)

        put(0, 2, None, None, ids.tobytes(), sets[of].tobytes(), None, None, None, None)
        if own:
            token = np.concatenate([np.frombuffer(cols["a"][k], np.uint32).astype(np.uint64) | np.uint64(int.from_bytes(cols["d"][k], "little") << 32) for k in own])
            owner = np.concatenate([_owners(cols["b"][k])[0] for k in own]).astype(np.int64)
            df = np.concatenate([np.frombuffer(cols["c"][k], np.uint8) for k in own])
            order = np.lexsort((token, df, owner))
            token, owner = token[order], owner[order]
            shared = np.bincount(owner, minlength=len(sets))
            start = np.cumsum(shared) - shared
            rank = np.arange(len(token)) - start[owner]
            pos = rank + (n - shared)[owner]
            length = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            inside = pos < length[owner]
            posts = np.bincount(owner[inside], minlength=len(sets)) > 0
            short = grams.mix(token).astype(np.uint32)
            by = np.flatnonzero(inside)
            by = by[np.lexsort((short[by], owner[by]))]
            nth = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
            lead = np.full((len(sets), _LEAD), 0xFFFFFFFF, np.uint32)
            lead[owner[by][nth < _LEAD], nth[nth < _LEAD]] = short[by][nth < _LEAD]
            r = (token[inside] >> np.uint64(32)).astype(np.int32)
            by = np.argsort(r, kind="stable")
            r, tk, ow, rk = r[by], token[inside][by], owner[inside][by], rank[inside][by]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(r)) + 1, [len(r)])) if len(r) else np.zeros(1, np.int64)
            for x, y in zip(cuts[:-1], cuts[1:]):
                o = ow[x:y]  # in order, for tokens were sorted by owner
                count = np.bincount(o, minlength=len(sets))[posts]
                here = np.flatnonzero(posts)[count > 0]
                put(int(r[x]), 0, None, None, tk[x:y].astype(np.uint32).tobytes(), rk[x:y].astype(np.uint32).tobytes(), _pack(count[count > 0]), sets[here].tobytes(), np.stack([n, shared], axis=1)[here].astype(np.uint32).tobytes(), lead[here].tobytes())
            for k in np.flatnonzero(posts):
                t = np.sort(token[start[k] : start[k] + shared[k]])
                put(None, 1, int(sets[k].astype(np.int64)), int(n[k]), t.astype(np.uint32).tobytes(), (t >> np.uint64(32)).astype(np.uint32).tobytes(), None, None, None, None)
        done = pa.Table.from_batches([_rows(out, _K3, _N3)])
        grams.release()
        return done

    return run


_POSTING = (("token", np.uint64, 1), ("set", np.uint64, 1), ("n", np.uint32, 1), ("pos", np.uint32, 1), ("rank", np.uint32, 1), ("lead", np.uint32, _LEAD))


def _packed(p: dict[str, np.ndarray], at: np.ndarray) -> bytes:
    return b"".join(p[c][at].astype(kind).tobytes() for c, kind, _ in _POSTING)


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    m, out, at = len(blob) // sum(np.dtype(kind).itemsize * wide for _, kind, wide in _POSTING), {}, 0
    for c, kind, wide in _POSTING:
        x = np.frombuffer(blob, kind, m * wide, at)
        at += x.nbytes
        out[c] = x.reshape(-1, wide) if wide > 1 else x if kind is np.uint64 else x.astype(np.int64)
    return out


def expand(p: dict[str, np.ndarray], side: np.ndarray, threshold: float, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, leads that they share) of the pairs of the index lists that may be similar; a pair needs the two sides, where there are two.

    A list of many sets a first lead is blocked by first lead, size and position, any
    other by size and position. All pairs of two blocks are skipped at once where sizes
    and positions rule them out; without the leads the blocks that a block may pair with
    follow it, up to a size that its own size and position tell.
    """
    token, n, pos, lead = p["token"], p["n"], p["pos"], p["lead"]
    _, of = np.unique(token, return_inverse=True)
    leads = np.bincount(np.unique(np.stack([of, lead[:, 0].astype(np.int64)]), axis=1)[0], minlength=1) if len(token) else np.zeros(1, np.int64)
    first = np.where((4 * leads <= np.bincount(of, minlength=1))[of] if len(token) else np.zeros(0, bool), lead[:, 0].astype(np.int64), -1)
    order = np.lexsort((p["set"], side, pos, n, first, token))
    first, of = first[order], of[order]
    token, sets, n, pos, rank, lead, side = token[order], p["set"][order], n[order], pos[order], p["rank"][order], lead[order], side[order]
    two, size, none = bool(len(side)) and side.min() != side.max(), len(token), np.zeros(0, np.int64)
    new = lambda *cols: np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cols], axis=0))))
    if size < 2:
        return none, none, none
    head = new(token, first, n, pos, side)
    many = np.diff(np.append(head, size))
    t, l0, bn, bp, bs = token[head], first[head], n[head], pos[head], side[head]
    top, count = np.maximum.reduceat(rank, head), len(head)
    end = lambda *cols: np.repeat(np.append(new(*cols)[1:], count), np.diff(np.append(new(*cols), count)))
    list_end, lead_end = end(t), end(t, l0)
    short = grams.mix(t).astype(np.uint32)
    at = np.arange(count)
    begin = np.where((l0 == short) | (l0 < 0), at, lead_end)  # a lead's pairs are met in the list of the lead itself
    plain = np.flatnonzero(l0 < 0)
    far = np.minimum(bn[plain] / threshold, (bn[plain] - bp[plain] + top[plain]) * (1 + threshold) / threshold - bn[plain])
    by = of[head[plain]] * float(1 << 33)
    list_end[plain] = np.append(-1, plain)[np.searchsorted(by + bn[plain], by + np.maximum(np.floor(far + 1e-6), -1.0), "right")] + 1

    def may(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        nx, ny = sizes[x], sizes[y]
        need = np.ceil(threshold / (1 + threshold) * (nx + ny) - 1e-9)
        return (np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-9) & (np.minimum(nx - places[x], ny - places[y]) + np.minimum(ranks[x], ranks[y]) >= need)

    names, local = np.unique(sets, return_inverse=True)
    found, fresh, held = np.zeros(0, np.uint64), [], 0
    span = np.maximum(list_end - begin, 0)
    total, done = np.cumsum(span), 0
    while done < count:
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + chunk, "right")))
        k = span[done:stop]
        f = np.repeat(at[done:stop], k)
        g = np.arange(len(f)) - np.repeat(np.cumsum(k) - k, k) + begin[f]
        done = stop
        ok = ((f != g) | (many[f] > 1)) & may(f, g, bn, bp, top)  # blocks
        if two:
            ok &= bs[f] != bs[g]
        f, g = f[ok], g[ok]
        pairs, last = np.cumsum(many[f] * many[g]), 0
        while last < len(f):
            to = max(last + 1, int(np.searchsorted(pairs, (pairs[last - 1] if last else 0) + chunk, "right")))
            ff, gg = f[last:to], g[last:to]
            last = to
            m = many[ff] * many[gg]
            q = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(many[gg], m)
            i, j = np.repeat(head[ff], m) + q // wide, np.repeat(head[gg], m) + q % wide
            ok = ((np.repeat(ff != gg, m)) | (i < j)) & may(i, j, n, pos, rank)
            i, j, own = i[ok], j[ok], np.repeat(short[ff], m)[ok]
            ok, like = sets[i] != sets[j], np.zeros(len(i), np.uint64)
            for x in range(_LEAD):
                for y in range(_LEAD):
                    same = lead[i, x] == lead[j, y]
                    ok &= ~(same & (lead[i, x] < own))
                    like += same & (lead[i, x] != 0xFFFFFFFF)
            x, y = local[i[ok]].astype(np.uint64), local[j[ok]].astype(np.uint64)
            new_pairs = (np.minimum(x, y) << np.uint64(34)) | (np.maximum(x, y) << np.uint64(4)) | np.minimum(like[ok], np.uint64(15))
            fresh.append(new_pairs)
            held += len(new_pairs)
            if held > max(chunk, len(found)):
                found, fresh, held = np.unique(np.concatenate((found, *fresh))), [], 0
    found = np.unique(np.concatenate((found, *fresh)))
    x, y = names[(found >> np.uint64(34)).astype(np.int64)].astype(np.int64), names[((found >> np.uint64(4)) & np.uint64(0x3FFFFFFF)).astype(np.int64)].astype(np.int64)
    return np.minimum(x, y), np.maximum(x, y), (found & np.uint64(15)).astype(np.int64)


_CANDIDATES = "kind int, key long, a binary, b binary, c binary"


def _pairs_row(a: np.ndarray, b: np.ndarray, like: np.ndarray) -> tuple:
    return 0, 0, a.tobytes(), b.tobytes(), like.astype(np.uint8).tobytes()


def _postings(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(postings of one range by token and set, first of each list, sets of each list)."""
    get = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
    count = np.concatenate([_owners(x)[1].astype(np.int64) for x in table.column("c").to_pylist()])
    of = np.repeat(np.arange(len(count)), count)
    n_shared, rank = get("e", np.uint32).reshape(-1, 2)[of].astype(np.int64), get("b", np.uint32).astype(np.int64)
    token = get("a", np.uint32).astype(np.uint64) | np.uint64(table.column("r")[0].as_py() << 32)
    p = {"token": token, "set": get("d", np.uint64)[of], "n": n_shared[:, 0], "pos": n_shared[:, 0] - n_shared[:, 1] + rank, "rank": rank, "lead": get("f", np.uint32).reshape(-1, _LEAD)[of]}
    order = np.lexsort((p["set"], token))
    order = order[np.concatenate(([True], (np.diff(token[order]) != 0) | (np.diff(p["set"][order]) != 0)))]
    p = {c: x[order] for c, x in p.items()}
    head = np.flatnonzero(np.concatenate(([True], np.diff(p["token"]) != 0)))
    return p, head, np.diff(np.append(head, len(order)))


def _leaders(dense: int):
    """Of one range's lists of `dense` sets or more: the least sets of the lists that each set is in, and of how many."""

    def run(table: pa.Table) -> pa.Table:
        p, head, many = _postings(table)
        at = np.flatnonzero(np.repeat(many >= dense, many))
        least = np.repeat(p["set"][head], many)[at]
        sets, n = p["set"][at], p["n"][at]
        order = np.lexsort((least, sets))
        sets, least, n = sets[order], least[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(sets) != 0) | (np.diff(least) != 0)))) if len(sets) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(sets)))
        r = np.full(len(first), table.column("r")[0].as_py(), np.int32)
        grams.release()
        return pa.table({"r": r, "set": sets[first].astype(np.int64), "p": least[first].astype(np.int64), "c": c.astype(np.int64), "n": n[first].astype(np.int64)})

    return run


def visitors(p: dict[str, np.ndarray], of: np.ndarray, label: np.ndarray, family: np.ndarray, threshold: float, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(set, family) where a set meets another family in a list `of`, at a size that it may be similar at; of two families the lesser is visited.

    `family` tells whether a posting's set has one, which is `label` then.
    """
    at = np.flatnonzero(family)
    at = at[np.lexsort((label[at], of[at]))]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    head = np.flatnonzero(np.concatenate(([True], (np.diff(of[at]) != 0) | (np.diff(label[at]) != 0))))
    list_of, name = of[at][head], label[at][head]
    least, most = np.minimum.reduceat(p["n"][at], head), np.maximum.reduceat(p["n"][at], head)
    lo, hi = np.searchsorted(of, list_of, "left"), np.searchsorted(of, list_of, "right")
    total, done, out = np.cumsum(hi - lo), 0, [np.zeros((0, 2), np.int64)]
    while done < len(head):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + chunk, "right")))
        k = (hi - lo)[done:stop]
        f = np.repeat(np.arange(done, stop), k)
        x = np.arange(len(f)) - np.repeat(np.cumsum(k) - k, k) + lo[f]
        ok = (~family[x] | (name[f] < label[x])) & (p["n"][x] >= threshold * least[f] - 1e-9) & (threshold * p["n"][x] <= most[f] + 1e-9)
        out.append(np.unique(np.stack([p["set"][x[ok]].astype(np.int64), name[f[ok]]], axis=1), axis=0))
        done = stop
    out = np.unique(np.concatenate(out), axis=0)
    return out[:, 0], out[:, 1]


def _lists(threshold: float, long: int, dense: int = 0):
    """Of one range's index lists: pairs of sets that may be similar (kind 0), long lists as pairs of their parts (kind 1), and visitors of families (kind 2).

    Sets of families are known in lists of `dense` sets or more; they are in no pair there.
    """

    def run(table: pa.Table, labels: pa.Table | None) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), _B, _B, _B)], names=["kind", "key", "a", "b", "c"])
        p, head, many = _postings(table)
        rows = []
        if labels is not None and labels.num_rows:
            sets, label = labels.column("set").to_numpy(), labels.column("g").to_numpy()
            by = np.argsort(sets)
            own = p["set"].astype(np.int64)
            at = by[np.minimum(np.searchsorted(sets, own, sorter=by), len(by) - 1)]
            family = (sets[at] == own) & np.repeat(many >= dense, many)
            of = np.repeat(np.arange(len(head)), many)
            a, g = visitors(p, of, label[at], family, threshold)
            rows.append((2, 0, a.tobytes(), g.tobytes(), None))
            p, of = {c: x[~family] for c, x in p.items()}, of[~family]
            head = np.flatnonzero(np.concatenate(([True], np.diff(of) != 0))) if len(of) else np.zeros(0, np.int64)
            many = np.diff(np.append(head, len(of)))
        for k in np.flatnonzero(many > long):
            parts = np.array_split(np.arange(head[k], head[k] + many[k]), -(-int(many[k]) // long))
            for x in range(len(parts)):
                for y in range(x, len(parts)):
                    key = grams.mix(p["token"][head[k] : head[k] + 1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x * len(parts) + y))
                    rows.append((1, int(key.view(np.int64)[0]), _packed(p, parts[x]), _packed(p, parts[y]) if x != y else None, None))
        rest = np.flatnonzero(np.repeat(many <= long, many))
        rows.append(_pairs_row(*expand({c: x[rest] for c, x in p.items()}, np.zeros(len(rest), np.int8), threshold)))
        grams.release()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), _B, _B, _B))], names=["kind", "key", "a", "b", "c"])

    return run if dense else lambda table: run(table, None)


def _parts(threshold: float):
    """Of one pair of parts of a long list: pairs of sets that may be similar."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            p = _unpacked(a)
            side = np.zeros(len(p["set"]), np.int8)
            if b is not None:
                q = _unpacked(b)
                side = np.repeat(np.array([0, 1], np.int8), (len(p["set"]), len(q["set"])))
                p = {c: np.concatenate((p[c], q[c])) for c in p}
            rows.append(_pairs_row(*expand(p, side, threshold)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), _B, _B, _B))], names=["kind", "key", "a", "b", "c"])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, like in zip(*(batch.column(k).to_pylist() for k in range(3))):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.int64)), pa.array(np.frombuffer(b, np.int64)), pa.array(np.frombuffer(like, np.uint8).astype(np.int32))], names=["a", "b", "like"])


def _in_common(owner: np.ndarray, column: np.ndarray, rows: int, columns: int, a: np.ndarray, b: np.ndarray, bits: int = 1 << 25) -> np.ndarray:
    """How many columns the rows a and b share, by bit rows over some columns at a time."""
    out = np.zeros(len(a), np.int64)
    wide = max(64, min(-(-columns // 64) * 64, bits // max(rows, 1) // 64 * 64))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for x in range(0, columns, wide):
        lo, hi = np.searchsorted(column, (x, x + wide))
        if lo == hi:
            continue
        marks = np.zeros((rows, wide), bool)
        marks[owner[lo:hi], column[lo:hi] - x] = True
        packed = np.packbits(marks, axis=1).view(np.uint64)
        step = max(1, bits // wide)
        for k in range(0, len(a), step):
            out[k : k + step] += np.bitwise_count(packed[a[k : k + step]] & packed[b[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def derive(tokens: np.ndarray, owner: np.ndarray, n: np.ndarray, pivot: int, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(which of the pairs a, b are similar, their overlaps), from the pivot's answers.

    The pivot's overlap with every set is computed once. Two sets share what both share
    with the pivot, which is at least the sum of their overlaps with it less its size
    and at most the lesser of them, and what both have beyond it. The bounds drop pairs
    unseen; of the others only the differences from the pivot are looked at.
    """
    own = np.sort(tokens[owner == pivot])
    at = np.minimum(np.searchsorted(own, tokens), max(len(own) - 1, 0))
    inside = own[at] == tokens if len(own) else np.zeros(len(tokens), bool)
    answer = np.bincount(owner[inside], minlength=len(n))
    _, extra, times = np.unique(tokens[~inside], return_inverse=True, return_counts=True)
    shared = times[extra] > 1
    beyond, more = owner[~inside][shared], (np.cumsum(times > 1) - 1)[extra[shared]]
    room = np.bincount(beyond, minlength=len(n))
    need = np.ceil(threshold / (1 + threshold) * (n[a] + n[b]) - 1e-9)
    some = np.flatnonzero(np.minimum(answer[a], answer[b]) + np.minimum(room[a], room[b]) >= need)
    x, y = a[some], b[some]
    missing = np.ones((len(n), len(own)), bool)
    missing[owner[inside], at[inside]] = False
    lacks, which = np.nonzero(missing[np.unique(np.concatenate((x, y)))]) if len(own) and len(some) else (np.zeros(0, np.int64),) * 2
    lacks = np.unique(np.concatenate((x, y)))[lacks] if len(lacks) else lacks
    overlap = answer[x] + answer[y] - len(own) + _in_common(lacks, which, len(n), len(own), x, y) + _in_common(beyond, more, len(n), int((times > 1).sum()), x, y)
    good = overlap >= threshold * (n[x] + n[y] - overlap) - 1e-9
    return some[good], overlap[good]


def _verify(threshold: float):
    """Of one pivot's group: exact overlaps of the candidate pairs."""

    def run(members: pa.Table, pairs: pa.Table) -> pa.Table:
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "overlap": pa.array([], pa.int64()), "jaccard": pa.array([], pa.float64())})
        if not members.num_rows or not pairs.num_rows:
            return none
        names = members.column("set").to_numpy()
        order = np.argsort(names)
        low, high = members.column("a").to_pylist(), members.column("b").to_pylist()
        sizes = np.array([len(low[k]) // 4 for k in order])
        join = lambda parts: np.frombuffer(b"".join([parts[k] for k in order]), np.uint32).astype(np.uint64)
        tokens, owner = join(low) | (join(high) << np.uint64(32)), np.repeat(np.arange(len(order)), sizes)
        names, n = names[order], members.column("n").to_numpy()[order].astype(np.int64)
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        x, y = (np.minimum(np.searchsorted(names, c), len(names) - 1) for c in (a, b))
        ok = np.flatnonzero((names[x] == a) & (names[y] == b))
        pivot = int(np.searchsorted(names, pairs.column("pivot")[0].as_py()))
        which, overlap = derive(tokens, owner, n, min(pivot, len(names) - 1), x[ok], y[ok], threshold)
        a, b, union = a[ok[which]], b[ok[which]], n[x[ok[which]]] + n[y[ok[which]]] - overlap
        grams.release()
        return pa.table({"a": pa.array(a), "b": pa.array(b), "overlap": pa.array(overlap.astype(np.int64)), "jaccard": pa.array(overlap / np.maximum(union, 1))})

    return run


def overlaps(tokens: np.ndarray, owner: np.ndarray, left: int, right: int, same: bool, wide: int = 1024, chunk: int = 2_000_000) -> np.ndarray:
    """How many tokens each of the first `left` sets shares with each of the `right` after them; same: with each of the first themselves.

    A token of many of the sets is a column of two matrices that are multiplied, the
    pairs of any other are counted one by one.
    """
    out = np.zeros((left, right), np.int32)
    _, of = np.unique(tokens, return_inverse=True)
    a = np.flatnonzero(owner < left)
    b = a if same else np.flatnonzero(owner >= left)
    count = of.max() + 1 if len(of) else 0
    da, db = np.bincount(of[a], minlength=count), np.bincount(of[b], minlength=count)
    cost = da * db
    heavy = cost * 150 > left * right
    shift = 0 if same else left
    column = np.cumsum(heavy) - 1
    for x in range(0, int(heavy.sum()), wide):
        sides = []
        for at, rows, low in ((a, left, 0), (b, right, shift)):
            at = at[heavy[of[at]]]
            at = at[(column[of[at]] >= x) & (column[of[at]] < x + wide)]
            marks = np.zeros((rows, wide), np.float32)
            marks[owner[at] - low, column[of[at]] - x] = 1
            sides.append(marks)
        out += (sides[0] @ sides[1].T).astype(np.int32)
    light = ~heavy & (cost > same)
    a, b = a[light[of[a]]], b[light[of[b]]]
    a = a[np.argsort(of[a], kind="stable")]
    b = b[np.argsort(of[b], kind="stable")]
    lo, k = np.searchsorted(of[b], of[a]), db[of[a]]
    total, done, flat = np.cumsum(k), 0, out.reshape(-1)
    while done < len(a):
        stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + chunk, "right")))
        m = k[done:stop]
        j = b[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[done:stop], m)]
        np.add.at(flat, np.repeat(owner[a[done:stop]], m) * right + owner[j] - shift, np.int32(1))
        done = stop
    return out


def connected(like: np.ndarray, same: bool) -> np.ndarray:
    """For each row, then each column, of a matrix of links, the number of its component; same: rows and columns are the same sets."""
    rows, columns = like.shape
    row, column, many = np.full(rows, -1), np.full(columns, -1), 0
    for first in range(rows):
        if row[first] >= 0:
            continue
        front = np.array([first])
        row[first] = many
        while len(front):
            new = np.flatnonzero(like[front].any(axis=0) & (column < 0))
            column[new] = many
            front = new[row[new] < 0] if same else np.flatnonzero(like[:, new].any(axis=1) & (row < 0))
            row[front] = many
        many += 1
    if same:
        return row
    column[column < 0] = many + np.arange((column < 0).sum())
    return np.concatenate((row, column))


def _dense(threshold: float):
    """Of two parts, or one with itself: how many documents each set is linked to there, and one set of its component."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        left, same = int((side == 0).sum()), table.column("x")[0].as_py() == table.column("y")[0].as_py()
        low, high = table.column("a").to_pylist(), table.column("b").to_pylist()
        names, n, w = (table.column(c).to_numpy()[order].astype(np.int64) for c in ("set", "n", "w"))
        join = lambda parts: np.frombuffer(b"".join([parts[k] for k in order]), np.uint32).astype(np.uint64)
        tokens, owner = join(low) | (join(high) << np.uint64(32)), np.repeat(np.arange(len(order)), [len(low[k]) // 4 for k in order])
        first = 0 if same else left
        right = len(order) - first
        if not left or not right:
            return pa.table({"set": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        shared = overlaps(tokens, owner, left, right, same)
        like = np.zeros(shared.shape, bool)
        for k in range(0, left, 256):
            o = shared[k : k + 256]
            like[k : k + 256] = (o > 0) & (o >= threshold * (n[:left][k : k + 256, None] + n[None, first:] - o) - 1e-9)
        del shared
        if same:
            np.fill_diagonal(like, False)
        links = np.concatenate([like[k : k + 256] @ w[first:] for k in range(0, left, 256)])
        if not same:
            links = np.concatenate((links, sum(w[:left][k : k + 256] @ like[k : k + 256] for k in range(0, left, 256))))
        _, at, of = np.unique(connected(like, same), return_index=True, return_inverse=True)
        some = np.flatnonzero(links > 0)
        grams.release()
        return pa.table({"set": pa.array(names[some]), "root": pa.array(names[at[of[some]]]), "links": pa.array(links[some])})

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(np.frombuffer(sets, np.int64))], names=["doc_id", "set"])


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for sets, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(sets, np.int64)), pa.array(np.frombuffer(g, np.int64))], names=["set", "g"])


def _families(leaders: DataFrame, dense: int) -> DataFrame:
    """(set, g, n): sets of families of `dense` and more. A set points to the least set of most of its long lists, if these are a sixteenth as many as its grams, and on from there."""
    met = leaders.groupBy("set", "p").agg(F.sum("c").alias("c"), F.max("n").alias("n"))
    up = met.groupBy("set").agg(F.max(F.struct("c", "p")).alias("m"), F.max("n").alias("n")).where("16 * m.c >= n").select("set", F.col("m.p").alias("g"), "n").checkpoint()
    for _ in range(2):
        on = up.select(F.col("set").alias("g"), F.col("g").alias("next"))
        up = up.join(on, "g", "left").select("set", F.coalesce("next", "g").alias("g"), "n")
    large = up.groupBy("g").agg(F.count("*").alias("many")).where(F.col("many") >= dense).select("g")
    return up.join(large, "g").select("set", "g", "n").checkpoint()


def _blocks(families: DataFrame, visits: DataFrame, part: int, part_grams: int) -> DataFrame:
    """(g, x, y, side, set): what each block compares, parts x and y of a family, or part -1 - x of its visitors and y."""
    size = families.groupBy("g").agg(F.count("*").alias("many"), F.sum("n").alias("grams"))
    guests = visits.groupBy("g").agg(F.count("*").alias("guests"))
    parts = lambda many, n: F.greatest(F.ceil(many / part), F.ceil(n / part_grams))
    shape = size.join(guests, "g", "left").select("g", parts(F.col("many"), F.col("grams")).cast("int").alias("s"), F.coalesce(parts(F.col("guests"), F.col("guests") * F.col("grams") / F.col("many")), F.lit(0)).cast("int").alias("v"))
    until = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = families.join(shape, "g").select("g", "set", "s", "v", F.pmod(F.xxhash64("set"), F.col("s")).cast("int").alias("i"))
    within = own.select("g", "set", "i", until("s").alias("j")).select("g", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), (F.col("i") > F.col("j")).cast("int").alias("side"), "set")
    hosts = own.where("v > 0").select("g", "set", "i", until("v").alias("j")).select("g", (-1 - F.col("j")).alias("x"), F.col("i").alias("y"), F.lit(1).alias("side"), "set")
    come = visits.join(shape, "g").select("g", "set", F.pmod(F.xxhash64("set"), F.col("v")).cast("int").alias("i"), until("s").alias("j")).select("g", (-1 - F.col("i")).alias("x"), F.col("j").alias("y"), F.lit(0).alias("side"), "set")
    return within.union(hosts).union(come)


def _found(docs: DataFrame, threshold: float, n: int, doc_id: str, text: str, group: int, long: int, dense: int, part: int = PART, part_grams: int = PART_GRAMS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of similar sets: a < b, overlap, jaccard; blocks of families: set, root, links; members: doc_id, set). With dense = 0 there are no families."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = prepare(docs.sparkSession)
    ranges = shuffle_width(spark)
    s1 = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(_sets(n, ranges), _S1)
    s2 = s1.groupBy("r").applyInArrow(_frequencies, _S2)
    s3 = s2.groupBy("m").applyInArrow(_prefixes(threshold), _S3).checkpoint()
    members = s3.where("kind = 2").select("a", "b").mapInArrow(_members, "doc_id long, set long").distinct()
    postings = s3.where("kind = 0").select("r", "a", "b", "c", "d", "e", "f").groupBy("r")
    families = None
    if dense:
        leaders = postings.applyInArrow(_leaders(dense), "r int, set long, p long, c long, n long").checkpoint()
        families = _families(leaders, dense)
        if families.isEmpty():
            families = None
    if families is None:
        lists = postings.applyInArrow(_lists(threshold, long), _CANDIDATES).checkpoint()
    else:
        labels = leaders.select("r", "set").distinct().join(families.select("set", "g"), "set").groupBy("r")
        lists = postings.cogroup(labels).applyInArrow(_lists(threshold, long, dense), _CANDIDATES).checkpoint()
    parts = lists.where("kind = 1").groupBy("key").applyInArrow(_parts(threshold), _CANDIDATES)
    candidates = lists.where("kind = 0").union(parts).select("a", "b", "c").mapInArrow(_pairs, "a long, b long, like int").groupBy("a", "b").agg(F.max("like").alias("like"))
    if families is not None:
        of = lambda c, g: families.select(F.col("set").alias(c), F.col("g").alias(g))
        candidates = candidates.join(of("a", "ga"), "a", "left").join(of("b", "gb"), "b", "left").select("a", "b", "like", "ga", "gb").where("ga is null or gb is null or ga <> gb").checkpoint()
        met = candidates.where("ga is not null or gb is not null").withColumn("g", F.least("ga", "gb")).select(F.when(F.col("ga").eqNullSafe(F.col("g")), F.col("b")).otherwise(F.col("a")).alias("set"), "g")
        visits = lists.where("kind = 2").select("a", "b").mapInArrow(_visits, "set long, g long").union(met).distinct().checkpoint()
        candidates = candidates.where("ga is null and gb is null").select("a", "b", "like")
    else:
        candidates = candidates.checkpoint()
    both = candidates.union(candidates.select(F.col("b").alias("a"), F.col("a").alias("b"), "like"))
    near = F.min(F.when((F.col("b") < F.col("a")) & (F.col("like") >= _LEAD // 2), F.col("b")))
    pivot = both.groupBy("a").agg(F.coalesce(near, F.least("a", F.min("b"))).alias("p"))
    blocks = pivot.groupBy("p").agg(F.ceil(F.count("*") / group).alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    keyed = candidates.join(pivot.join(blocks, "p"), "a").select(F.when(F.col("blocks") == 1, F.col("p")).otherwise(F.xxhash64("p", block("a"), block("b"))).alias("k"), F.col("p").alias("pivot"), "a", "b")
    needed = keyed.select("k", F.explode(F.array("pivot", "a", "b")).alias("set")).distinct()
    contents = s3.where("kind = 1").select("set", "n", "a", "b").dropDuplicates(["set"])
    grouped = needed.join(contents, "set").select("k", "set", "n", "a", "b")
    again = keyed.select(F.col("k").alias("q"), "pivot", "a", "b")
    pairs = grouped.groupBy("k").cogroup(again.groupBy("q")).applyInArrow(_verify(threshold), "a long, b long, overlap long, jaccard double")
    none = spark.createDataFrame([], "set long, root long, links long")
    if families is None:
        return pairs.checkpoint(), none, members
    many = members.groupBy("set").agg(F.count("*").alias("w"))
    work = _blocks(families, visits, part, part_grams).join(contents, "set").join(many, "set").select("g", "x", "y", "side", "set", "n", "w", "a", "b")
    dense_links = work.groupBy("g", "x", "y").applyInArrow(_dense(threshold), "set long, root long, links long")
    # in one plan, so that the contents are shuffled once
    found = pairs.select("a", "b", "overlap", "jaccard").union(dense_links.select("set", "root", "links", F.lit(None).cast("double"))).checkpoint()
    return found.where("jaccard is not null"), found.where("jaccard is null").select(F.col("a").alias("set"), F.col("b").alias("root"), F.col("overlap").alias("links")), members


def set_pairs(docs: DataFrame, threshold: float = 0.5, n: int = 3, doc_id: str = "doc_id", text: str = "text", group: int = GROUP, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(pairs of similar sets: a < b, overlap, jaccard; members: doc_id, set).

    A pivot with more than `group` sets has its pairs split into blocks of about that
    many sets on either side, so that no task holds a whole large group; an index list
    of more than `long` sets is split alike.
    """
    pairs, _, members = _found(docs, threshold, n, doc_id, text, group, long, 0)
    return pairs, members


def jaccard_pairs(docs: DataFrame, threshold: float = 0.5, n: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every pair of similar documents: doc_a < doc_b, jaccard.

    Words are split at ASCII white space after lower-casing. A text of fewer than n
    words is one n-gram of all its words. Rows with a null id, and null, empty or blank
    texts, have no pairs. Equal rows count once; rows of one id are never a pair. Other
    columns are not read, whatever their names. An empty table gives an empty result.
    """
    pairs, members = set_pairs(docs, threshold, n, doc_id, text)
    left = members.select(F.col("set").alias("a"), F.col("doc_id").alias("x"))
    right = members.select(F.col("set").alias("b"), F.col("doc_id").alias("y"))
    across = pairs.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    within = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return across.union(within)


def _classes(pairs: DataFrame, dense: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, set, class_id): class_id is the least doc_id of the documents whose sets are connected."""
    component = graph.components(pairs.select("a", "b").union(dense.select("set", "root")))
    of = members.join(component, members["set"] == component["id"], "left").select("doc_id", "set", F.coalesce("component", "set").alias("g"))
    return of.join(of.groupBy("g").agg(F.min("doc_id").alias("class_id")), "g").select("doc_id", "set", "class_id")


def _own(threshold: float, n: int, part: int):
    """Of one id's texts: how many of its sets are similar to others of them, over all of its sets."""

    def run(table: pa.Table) -> pa.Table:
        g, rows = grams.ngrams(grams.words(table.column("t").combine_chunks()), n)
        v, first = grams.unique_per_row(g, rows, table.num_rows)
        sets = [x.tobytes() for x in np.split(v, first[1:-1])]
        sets = [np.frombuffer(x, np.uint64) for x in sorted(set(sets)) if x]
        many = 0
        for x in range(0, len(sets), part):
            for y in range(0, len(sets), part):
                a, b = sets[x : x + part], sets[y : y + part]
                size = np.array([len(z) for z in a + b])
                o = overlaps(np.concatenate(a + b), np.repeat(np.arange(len(size)), size), len(a), len(b), False)
                many += int(((o > 0) & (o >= threshold * (size[: len(a), None] + size[None, len(a) :] - o) - 1e-9)).sum())
        return pa.table({"doc_id": table.column("i").slice(0, 1), "own": pa.array([many - len(sets)], pa.int64())})

    return run


def links(docs: DataFrame, threshold: float = 0.5, n: int = 3, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE, part: int = PART) -> DataFrame:
    """Every document: doc_id, class_id, links, where links is its number of pairs in jaccard_pairs.

    class_id is the lowest doc_id that these pairs connect it with, its own if there
    are none. Null, empty and blank texts have no links; rows of a null id are left out.
    Equal rows count once. Rows of one id are never a pair; if they differ, its links are
    those of each text, and its class the lowest of theirs. An empty table gives an
    empty result.
    """
    pairs, blocks, members = _found(docs, threshold, n, doc_id, text, GROUP, LONG, dense, part)
    many = members.groupBy("set").agg(F.count("*").alias("w"))
    to = lambda a, b: pairs.select(F.col(a).alias("set"), F.col(b).alias("other"))
    across = to("a", "b").union(to("b", "a")).join(many.withColumnRenamed("set", "other"), "other").select("set", F.col("w").alias("links"))
    total = across.union(blocks.select("set", "links")).groupBy("set").agg(F.sum("links").alias("links"))
    of = _classes(pairs, blocks, members).join(many, "set").join(total, "set", "left")
    got = of.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum(F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    several = members.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("i")).checkpoint()
    if not several.isEmpty():
        own = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).join(several, "i", "left_semi").groupBy("i").applyInArrow(_own(threshold, n, part), "doc_id long, own long")
        got = got.join(own, "doc_id", "left").select("doc_id", "class_id", (F.col("links") - F.coalesce("own", F.lit(0))).alias("links"))
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return every.join(got, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def duplicates(docs: DataFrame, threshold: float = 0.5, n: int = 3, doc_id: str = "doc_id", text: str = "text", dense: int = DENSE) -> DataFrame:
    """(doc_id, keep): documents whose group has one of a lower id, and the lowest id of the group.

    Groups are the connected components of jaccard_pairs, so null, empty and blank texts
    are in none, and rows of null ids neither. Rows of one id count as one document. An
    empty table gives an empty result.
    """
    of = _classes(*_found(docs, threshold, n, doc_id, text, GROUP, LONG, dense))
    return of.groupBy("doc_id").agg(F.min("class_id").alias("keep")).where("doc_id > keep")


def drop_duplicates(docs: DataFrame, threshold: float = 0.5, n: int = 3, doc_id: str = "doc_id", text: str = "text", most: int = 1_000_000) -> DataFrame:
    """The rows of docs but those that duplicates() names, with all their columns.

    Rows with a null id stay, and so do null, empty and blank texts; repeated rows stay
    or go together. An empty table gives an empty result. Up to `most` ids to drop, 8 bytes each, are sent to every
    task; more are joined by a shuffle.
    """
    gone = duplicates(docs, threshold, n, doc_id, text).select(F.col("doc_id").alias("__gone")).checkpoint()
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
