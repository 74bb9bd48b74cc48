"""Exact cosine nearest neighbours, embedding in batches, and vector records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxweave.functions.scalars import cosine
from ctxweave.operators import pattern, write


def knn(vectors: DataFrame, query: list[float], k: int = 5, threshold: float | None = None, id_column: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector, highest `distance` (cosine) first, then those under the threshold left out.

    The embedding itself isn't returned. Rows without an embedding are never near.
    Plans as a scan, a projection and a bounded heap: no shuffle of the vectors.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(embedding).isNotNull()).withColumn("distance", cosine(embedding, q)).drop(embedding).where("distance is not null")
    top = scored.orderBy(F.desc("distance"), id_column).limit(k)
    return (top if threshold is None else top.where(F.col("distance") >= threshold)).orderBy(F.desc("distance"), id_column)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "id", query_id: str = "query_id", embedding: str = "embedding", block: int = 4096, most: int = 50_000_000) -> DataFrame:
    """(query_id, id, distance, rank) of the k nearest of each query.

    Queries go to every task as one matrix, so each block of vectors is one matrix
    product and only k rows a query leave it; queries whose vectors take more than
    `most` bytes are split and their results united.
    """
    n, dims = queries.select(F.count("*"), F.max(F.size(embedding))).first()
    parts = 1 + (n * max(1, dims or 1) * 8) // most
    out = None
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == part).select(query_id, embedding).where(F.col(embedding).isNotNull()).toPandas()
        found = vectors.select(id_column, embedding).where(F.col(embedding).isNotNull()).mapInPandas(_nearest(rows[query_id].tolist(), rows[embedding].tolist(), k, id_column, embedding, block), "query_id long, id long, distance double")
        out = found if out is None else out.union(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("distance"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")


def _nearest(ids: list, queries: list, k: int, id_column: str, embedding: str, block: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = np.array([np.asarray(x, np.float64) for x in queries], np.float64) if queries else np.zeros((0, 1))
        norm = np.linalg.norm(q, axis=1)
        for b in batches:
            for x in range(0, len(b), block):
                part = b.iloc[x : x + block]
                if not len(part) or not len(q):
                    continue
                v = np.stack([np.asarray(e, np.float64) for e in part[embedding]])
                own = part[id_column].to_numpy()
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (q @ v.T) / np.outer(norm, np.linalg.norm(v, axis=1))
                s[~np.isfinite(s)] = -np.inf
                best = [np.lexsort((own, -row))[:k] if len(own) <= 4 * k else _top(row, own, k) for row in s]
                which, at = np.repeat(np.arange(len(q)), [len(x) for x in best]), np.concatenate(best)
                there = np.isfinite(s[which, at])
                which, at = which[there], at[there]
                yield pd.DataFrame({"query_id": np.asarray(ids)[which], "id": own[at], "distance": s[which, at]})

    return run


def _top(s: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best, ties by id."""
    least = np.partition(s, len(s) - k)[len(s) - k]
    some = np.flatnonzero(s >= least)
    return some[np.lexsort((own[some], -s[some]))][:k]


def hash_embedding(text: str, dims: int = 64) -> np.ndarray:
    """A deterministic unit vector of a text's words: signed feature hashing. Stands in where no model is at hand."""
    v = np.zeros(dims)
    for word in text.lower().split():
        h = xxhash.xxh64_intdigest(word.encode())
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: Callable[[list[str]], np.ndarray] | None = None, batch: int = 32, dims: int = 64) -> DataFrame:
    """Adds the embedding of a text column, null for null. The embedder gets lists of at most `batch` texts and must return as many vectors."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            got: list = [None] * len(s)
            there = [k for k, t in enumerate(s) if t is not None]
            for x in range(0, len(there), batch):
                part = there[x : x + batch]
                texts = [s.iloc[k] for k in part]
                vectors = embedder(texts) if embedder else [hash_embedding(t, dims) for t in texts]
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                for k, v in zip(part, vectors):
                    got[k] = [float(x) for x in v]
            yield pd.Series(got, dtype=object)

    return df.withColumn(out, run(F.col(text)))


def upsert(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Vector records by id, the last of each id in force."""
    return write.merge_last(old, new, ["id"], order)


def get_by_ids(vectors: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    return pattern.lookup(vectors, "id", ids, id_column)


def vectors_by_ids(vectors: DataFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, embedding) of the ids that have one."""
    return pattern.lookup(vectors.where("embedding is not null"), "id", ids, id_column).select("id", "embedding")


def delete_entity(vectors: DataFrame, entity: str) -> DataFrame:
    return vectors.where((F.col("entity_name") != entity) | F.col("entity_name").isNull())


def delete_relations_of(vectors: DataFrame, entity: str) -> DataFrame:
    """Relation records without those that start or end at the entity."""
    hit = F.coalesce(F.col("src_id") == entity, F.lit(False)) | F.coalesce(F.col("tgt_id") == entity, F.lit(False))
    return vectors.where(~hit)


def graph_rag(nodes: DataFrame, edges: DataFrame, query: list[float], wanted: DataFrame, k: int = 5, hops: int = 2, top: int = 5, id_column: str = "id") -> DataFrame:
    """(id, degree): nearest nodes, what lies within some hops of them and is wanted, the best-connected first."""
    seeds = knn(nodes, query, k, id_column=id_column).select(F.col(id_column).alias("id"))
    reached = pattern.bfs(edges, seeds, hops).where("distance > 0").select("id").join(wanted.select(F.col(wanted.columns[0]).alias("id")).distinct(), "id", "left_semi")
    return reached.join(pattern.degree(edges), "id").orderBy(F.desc("degree"), "id").limit(top)


@dataclass
class CellIndex:
    """Vectors by the nearest of some centroids, and how far from its centroid a cell reaches, as an angle."""

    centroids: np.ndarray
    rows: DataFrame  # cell, id, embedding
    reach: DataFrame  # cell, reach


def _angles(centroids: np.ndarray, series: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in series])
    v = v / np.linalg.norm(v, axis=1)[:, None]
    return np.arccos(np.clip(v @ centroids.T, -1, 1))


def cell_index(vectors: DataFrame, cells: int = 256, id_column: str = "id", embedding: str = "embedding", seed: int = 7) -> CellIndex:
    """An index to look neighbours up in; write its two tables out to use it more than once.

    At most `cells` vectors, by a hash of their ids, are the centroids. Vectors that are
    null or of no length are near to nothing and left out.
    """
    held = vectors.where(F.col(embedding).isNotNull()).where(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0).select(F.col(id_column).alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))
    picked = held.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells).toPandas()["embedding"].tolist()
    c = np.array(picked, np.float64) if picked else np.zeros((1, 1))
    c = c / np.maximum(np.linalg.norm(c, axis=1), 1e-300)[:, None]

    @F.pandas_udf("cell int, angle double")
    def nearest(series: pd.Series) -> pd.DataFrame:
        angle = _angles(c, series) if len(series) else np.zeros((0, len(c)))
        return pd.DataFrame({"cell": angle.argmin(axis=1).astype(np.int32), "angle": angle.min(axis=1)})

    placed = held.withColumn("x", nearest("embedding")).select(F.col("x.cell").alias("cell"), "id", "embedding", F.col("x.angle").alias("angle")).checkpoint()
    return CellIndex(c, placed.drop("angle"), placed.groupBy("cell").agg(F.max("angle").alias("reach")))


def knn_cells(index: CellIndex, queries: DataFrame, k: int = 5, query_id: str = "query_id", embedding: str = "embedding", probe: int = 8) -> DataFrame:
    """(query_id, id, distance, rank), the same as knn_batch gives: an exact search that skips cells.

    The `probe` nearest cells of a query come first. What they give bounds the angle of
    the k-th neighbour, and of the other cells only those are searched that may reach
    within it; all of them, where the first held fewer than k.
    """
    c = index.centroids

    @F.pandas_udf("array<struct<angle:double,cell:int>>")
    def order(series: pd.Series) -> pd.Series:
        if not len(series):
            return pd.Series([], dtype=object)
        return pd.Series([[{"angle": float(r[x]), "cell": int(x)} for x in np.argsort(r, kind="stable")] for r in _angles(c, series)])

    asked = queries.where(F.col(embedding).isNotNull()).where(F.aggregate(embedding, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) > 0).select(F.col(query_id).alias("query_id"), F.col(embedding).cast("array<double>").alias("q"))
    cells = asked.select("query_id", "q", F.posexplode(order("q")).alias("nth", "x")).select("query_id", "q", "nth", "x.cell", "x.angle")
    scored = lambda some: some.join(index.rows, "cell").select("query_id", "id", cosine("embedding", "q").alias("distance"))
    w = Window.partitionBy("query_id").orderBy(F.desc("distance"), "id")
    best = lambda df: df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    first = best(scored(cells.where(F.col("nth") < probe))).checkpoint()
    bound = first.where(F.col("rank") == k).select("query_id", F.acos(F.least(F.greatest("distance", F.lit(-1.0)), F.lit(1.0))).alias("within"))
    rest = cells.where(F.col("nth") >= probe).join(index.reach, "cell").join(bound, "query_id", "left").where(F.col("angle") - F.col("reach") <= F.coalesce("within", F.lit(4.0)) + 1e-6)
    return best(first.drop("rank").union(scored(rest.select("query_id", "q", "cell"))))
