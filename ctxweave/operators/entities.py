"""Entities of chunks: a pluggable extractor with a rule-based default, merged and linked."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Extractor = Callable[[str], tuple[list[tuple[str, str]], list[tuple[str, str, str]]]]
_NAME = re.compile(r"\b[^\W\d_a-z][^\W_]+(?:[ ][^\W\d_a-z][^\W_]+)+")


def capitalised_names(text: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Runs of two or more capitalised words as entities, neighbours within a sentence as related."""
    entities, related = [], []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        names = list(dict.fromkeys(m.group() for m in _NAME.finditer(sentence)))
        entities += [(n, "Name") for n in names]
        related += [(a, "NEAR", b) for a, b in zip(names, names[1:])]
    return list(dict.fromkeys(entities)), list(dict.fromkeys(related))


def extract(chunks: DataFrame, key: str = "hash", text: str = "text", extractor: Extractor = capitalised_names, workspace: str = "base") -> dict[str, DataFrame]:
    """entities (entity_id, name, type, file_path, workspace) and relations (src, type, dst, file_path, workspace).

    file_path is the chunk's key, by which entities link to chunks. Null texts have none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                if t is None:
                    continue
                found, related = extractor(t)
                rows += [(k, n, kind, None, None) for n, kind in found]
                rows += [(k, a, None, kind, c) for a, kind, c in related]
            yield pd.DataFrame(rows, columns=["k", "name", "kind", "relation", "other"])

    found = chunks.select(F.col(key).cast("string").alias(key), text).mapInPandas(run, "k string, name string, kind string, relation string, other string")
    e = found.where("kind is not null").select(F.md5(F.concat_ws("\u0000", F.lit(workspace), "name", "kind")).alias("entity_id"), "name", F.col("kind").alias("type"), F.col("k").alias("file_path"), F.lit(workspace).alias("workspace")).distinct()
    r = found.where("relation is not null").select(F.col("name").alias("src"), F.col("relation").alias("type"), F.col("other").alias("dst"), F.col("k").alias("file_path"), F.lit(workspace).alias("workspace")).distinct()
    return {"entities": e, "relations": r}
