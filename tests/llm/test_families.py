"""Families of texts that are alike: their links are counted and their classes found without a row a pair."""

import random
from collections import Counter

import numpy as np

from ctxweave.llm import jaccard_join

DOCS = "doc_id long, text string"


def shingles(t, n=3):
    w = t.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def similar(a, b, threshold):
    x, y = shingles(a), shingles(b)
    return bool(x and y) and len(x & y) / len(x | y) >= threshold


def brute_force(docs, threshold):
    """{id: (class, links)}, equal rows once, no links within an id."""
    docs = sorted({(k, t) for k, t in docs if k is not None and t is not None})
    texts = sorted({(k, frozenset(shingles(t))): t for k, t in docs}.items(), key=lambda x: x[0][0])
    texts = [(k[0], t) for k, t in texts]
    root, links = {k: k for k, _ in docs}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(texts):
        for b, y in texts[i + 1 :]:
            if a != b and similar(x, y, threshold):
                links[a] += 1
                links[b] += 1
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return {k: (find(k), links[k]) for k in root}


def edited(rng, words, vocab, share):
    return " ".join(rng.choice(vocab) if rng.random() < share else w for w in words)


def corpus(seed):
    """Two families that share a passage, copies, chains from one text to another, odd rows."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocab) for _ in range(25)]
    docs = []
    for many, length in ((40, 60), (25, 50)):
        base = passage + [rng.choice(vocab) for _ in range(length)]
        docs += [edited(rng, base, vocab, rng.choice([0.02, 0.05, 0.1, 0.15])) for _ in range(many)]
    chain = [rng.choice(vocab) for _ in range(60)]
    for _ in range(12):
        at = rng.randrange(50)
        chain = chain[:at] + [rng.choice(vocab) for _ in range(8)] + chain[at + 8 :]
        docs.append(" ".join(chain))
    docs += [docs[0]] * 4 + [docs[45]] * 2 + [" ".join(passage + [rng.choice(vocab) for _ in range(k)]) for k in range(0, 40, 4)]
    docs += [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(10)]
    return list(enumerate(docs))


def test_duplicates_are_brute_force(spark):
    docs = corpus(3)
    want = brute_force(docs, 0.3)
    gone = {r["doc_id"]: r["keep"] for r in jaccard_join.duplicates(spark.createDataFrame(docs, DOCS).repartition(3), 0.3, dense=4).collect()}
    assert gone == {k: c for k, (c, _) in want.items() if c < k}


def test_links_of_odd_rows(spark):
    """One row a document: null ids go, blank texts are alone, equal rows count once, texts of one id aren't linked."""
    docs = corpus(4)
    docs += [(None, docs[0][1]), (500, None), (501, ""), (502, " \n"), (503, "two words"), (504, "Two  words"), docs[0], docs[3], (7, docs[8][1]), (7, docs[60][1]), (505, docs[1][1]), (505, docs[2][1])]
    d = spark.createDataFrame(docs, DOCS)
    want = brute_force(docs, 0.5) | {500: (500, 0)}
    assert want[504] == (503, 1)
    got = [tuple(r) for r in jaccard_join.links(d, dense=4, part=6).collect()]
    assert {k: (c, n) for k, c, n in got} == want and len(got) == len(want)


def test_a_family_makes_no_row_a_pair(spark):
    """Pairs of a family of m texts are m * (m - 1) / 2; what links() and duplicates() rest on doesn't make them."""
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(500)]
    base = [rng.choice(vocab) for _ in range(80)]
    m = 240
    d = spark.createDataFrame([(k, f"{edited(rng, base, vocab, 0.02)} {k}") for k in range(m)], DOCS).repartition(4)
    every = jaccard_join.jaccard_pairs(d).count()
    pairs, blocks, _ = jaccard_join._found(d, 0.5, 3, "doc_id", "text", jaccard_join.GROUP, jaccard_join.LONG, jaccard_join.DENSE)
    assert every > 0.9 * m * (m - 1) / 2 and pairs.count() + blocks.count() <= 2 * m
    assert blocks.agg({"links": "sum"}).first()[0] + 2 * pairs.count() == 2 * every  # all texts differ


def test_overlaps_and_components_of_a_block():
    rng = np.random.default_rng(3)
    for left, right, same in ((7, 9, False), (30, 30, True), (1, 40, False), (60, 5, False)):
        sets = [np.unique(np.concatenate((rng.integers(0, 20, 8), rng.integers(100, 4000, rng.integers(0, 200))))) for _ in range(left if same else left + right)]
        tokens, owner = np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        got = jaccard_join.overlaps(tokens, owner, left, right, same, wide=64, chunk=50)
        others = sets if same else sets[left:]
        for i in range(left):
            for j in range(right):
                assert i == j and same or got[i, j] == len(np.intersect1d(sets[i], others[j]))
    for size, share in ((12, 0.1), (20, 0.04), (5, 0.0), (9, 0.9)):
        like = rng.random((size, size)) < share
        like |= like.T
        np.fill_diagonal(like, False)
        of = jaccard_join.connected(like, True)
        reach = np.linalg.matrix_power(like.astype(float) + np.eye(size), size) > 0
        assert ((of[:, None] == of[None, :]) == reach).all()
        part = rng.random((size, 6)) < share
        whole = np.zeros((size + 6, size + 6))
        whole[:size, size:] = part
        of, reach = jaccard_join.connected(part, False), np.linalg.matrix_power(whole + whole.T + np.eye(size + 6), size + 6) > 0
        assert ((of[:, None] == of[None, :]) == reach).all()
