"""Quality by compression: two zstandard dictionaries, one of good and one of bad labelled text.

A text is compressed block by block with either dictionary. The difference of the two
sizes over their sum says which class it resembles; a logistic curve fitted on labelled
texts that the dictionaries haven't seen, weighted by how often each class is labelled,
turns it into the probability of being good.

Dictionaries and curve see a bounded sample: at most `per_class` labelled texts of each
class, those of the least hash of doc_id, half for the dictionaries and half for the
curve. Lines that texts of both classes hold say nothing and are left out of the
dictionaries. Every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.runtime import prepare

PER_CLASS, BLOCK, DICTIONARY, LEVEL, THRESHOLD = 2000, 512, 65536, 3, 0.5


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    block: int = BLOCK
    level: int = LEVEL
    _tools: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def difference(self, text: str) -> float:
        """(size by the bad dictionary - size by the good one) / their sum; 0 for an empty text."""
        if self._tools is None:
            made = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
                if raw:
                    d.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) if raw else zstandard.ZstdCompressor(level=self.level, write_content_size=False))
            self._tools = tuple(made)
        good, bad = self._tools
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        parts = [raw[k : k + self.block] for k in range(0, len(raw), self.block)]
        g, b = sum([len(good.compress(p)) for p in parts]), sum([len(bad.compress(p)) for p in parts])
        return (b - g) / (b + g)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.difference(text) + self.bias, -500, 500))))


def _dictionary(texts: list[str], shared: set[str], size: int, block: int) -> bytes:
    samples = []
    for t in texts:
        raw = "\n".join(x for x in t.split("\n") if x not in shared).encode("utf-8", "surrogatepass")
        samples += [raw[k : k + block] for k in range(0, len(raw), block)]
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:  # too little text to train on: its last bytes serve as they are
        return b"".join(samples)[-size:] if sum(map(len, samples)) >= 8 else b""


def fit(good: list[str], bad: list[str], prior: float, block: int = BLOCK, size: int = DICTIONARY, level: int = LEVEL) -> Model:
    """Fit on labelled texts. prior: the share of good ones among all labelled. With one class only, all score the prior."""
    half = lambda x: (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :] or x)
    (g1, g2), (b1, b2) = half(good), half(bad)
    shared = {x for t in g1 for x in t.split("\n")} & {x for t in b1 for x in t.split("\n")}
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    model = Model(_dictionary(g1, shared, size, block), _dictionary(b1, shared, size, block), 0.0, float(np.log(prior / (1 - prior))), block, level)
    if not good or not bad:
        return model
    x = np.array([model.difference(t) for t in [*g2, *b2]])
    y = np.array([1.0] * len(g2) + [0.0] * len(b2))
    weight = np.where(y > 0, prior / len(g2), (1 - prior) / len(b2))
    scale = x.std() or 1.0
    w, c = 0.0, model.bias
    for _ in range(50):  # Newton's method, slightly damped by a penalty on the slope
        p = 1 / (1 + np.exp(-np.clip(w * x / scale + c, -30, 30)))
        r = weight * p * (1 - p) + 1e-12
        g = np.array([(weight * (p - y) * x / scale).sum() + 1e-3 * w, (weight * (p - y)).sum()])
        h = np.array([[(r * (x / scale) ** 2).sum() + 1e-3, (r * x / scale).sum()], [(r * x / scale).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        w, c = w - np.clip(step[0], -2, 2), c - np.clip(step[1], -2, 2)
    model.slope, model.bias = float(w / scale), float(c)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, block: int = BLOCK, size: int = DICTIONARY, level: int = LEVEL) -> Model:
    """Fit on labelled documents.

    Labels of null, of no document or of a null text are left out, and so are those of
    a document that is labelled both ways; a label that comes twice counts once. Rows of
    one doc_id are a text each. Equal hashes are told apart by doc_id and text.
    """
    known = labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("i", "y")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class) for y in (0, 1)]
    sample = parts[0].union(parts[1])  # at most 2 x per_class rows of 12 bytes
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).where("t is not null").join(F.broadcast(sample), "i").select("i", "y", "t").orderBy(F.xxhash64("i", F.lit(1)), "i", "t").collect()
    return fit([r["t"] for r in rows if r["y"] == 1], [r["t"] for r in rows if r["y"] == 0], counts.get(1, 0) / max(1, sum(counts.values())), block, size, level)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, quality, keep) of every row: the probability of being good, and whether it reaches the threshold.

    A null text has a null score and isn't kept. An empty text tells nothing and scores
    what a size difference of 0 does. A score that is just the threshold is kept. Repeated rows are scored alike, each by itself; a
    null doc_id stays null. Other columns are not read. An empty table gives an empty
    result.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [None if t is None else model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([x is not None and x >= threshold for x in p], pa.bool_())], names=["doc_id", "quality", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")).mapInArrow(run, "doc_id long, quality double, keep boolean")
