"""Procedures by name: what a query may call, listed and found by pattern."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ctxweave.functions.scalars import full_match


@dataclass(frozen=True)
class Procedure:
    name: str
    signature: str
    run: Callable[..., DataFrame]


class Procedures:
    """A registry; names are unique."""

    def __init__(self) -> None:
        self._all: dict[str, Procedure] = {}

    def add(self, name: str, signature: str, run: Callable[..., DataFrame]) -> Procedures:
        if name in self._all:
            raise ValueError(f"a procedure is named {name} already")
        self._all[name] = Procedure(name, signature, run)
        return self

    def call(self, name: str, *args: object, **kwargs: object) -> DataFrame:
        if name not in self._all:
            raise LookupError(f"no procedure is named {name}")
        return self._all[name].run(*args, **kwargs)

    def listing(self, spark: SparkSession, pattern: str | None = None) -> DataFrame:
        """(name, signature), those whose whole name matches a pattern, if one is given."""
        rows = spark.createDataFrame([(p.name, p.signature) for p in self._all.values()], "name string, signature string")
        return (rows if pattern is None else rows.where(full_match("name", pattern))).orderBy("name")


def standard() -> Procedures:
    """The library's own table functions."""
    from ctxweave.operators import pattern, text_search, vector
    from ctxweave.plans import schema
    from ctxweave.sources import readers

    p = Procedures()
    for name, signature, run in (
        ("vector_search.search", "(vectors, query, k, threshold) :: (id, distance)", vector.knn),
        ("vector_search.search_batch", "(vectors, queries, k) :: (query_id, id, distance, rank)", vector.knn_batch),
        ("text_search.search_all", "(docs, query, key, text, limit) :: (key, score)", text_search.bm25),
        ("embeddings.text", "(df, text) :: (embedding)", vector.embed),
        ("graph.bfs", "(edges, seeds, max_depth) :: (id, distance)", pattern.bfs),
        ("graph.degree", "(edges) :: (id, degree)", pattern.degree),
        ("schema.node_type_properties", "(nodes) :: (label, property, type, non_null, total)", schema.property_profile),
        ("migrate.parquet", "(path, columns) :: (row)", readers.parquet),
        ("migrate.jdbc", "(url, table, columns) :: (row)", readers.jdbc),
    ):
        p.add(name, signature, run)
    return p
