"""Key-value records, document status and memories as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.operators import pattern, write

STATUSES = ("pending", "processing", "preprocessed", "processed", "failed")


def kv_upsert(old: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """(id, data, created_at, updated_at): new ids get both times, known ids new data and a new updated_at. created_at is kept."""
    n = new.select("id", F.col("data").alias("__data")).where("id is not null").groupBy("id").agg(F.max("__data").alias("__data")).withColumn("__new", F.lit(True))
    j = old.join(n, "id", "full_outer")
    return j.select("id", F.when(F.col("__new"), F.col("__data")).otherwise(F.col("data")).alias("data"), F.coalesce("created_at", F.lit(now)).cast("long").alias("created_at"), F.when(F.col("__new"), F.lit(now)).otherwise(F.col("updated_at")).cast("long").alias("updated_at"))


def kv_get(kv: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each requested (pos, id), null where there is none."""
    return pattern.aligned_lookup(kv, "id", ids, "id", "pos")


def kv_missing(kv: DataFrame, ids: DataFrame) -> DataFrame:
    return pattern.missing(kv, "id", ids, "id")


def kv_delete(kv: DataFrame, ids: DataFrame) -> DataFrame:
    return write.delete(kv, ids, ["id"])


def docs_by_status(docs: DataFrame, *statuses: str) -> DataFrame:
    return docs.where(F.col("status").isin(*statuses))


def docs_by_track(docs: DataFrame, track: str) -> DataFrame:
    return docs.where(F.col("track_id") == track)


def doc_by(docs: DataFrame, column: str, value: str | None) -> DataFrame:
    """The first document, by id, with a value in a column; none for a blank value or the placeholder of unknown sources."""
    if not (value or "").strip() or value == "unknown_source":
        return docs.limit(0)
    return docs.where(F.col(column) == value).orderBy("id").limit(1)


def doc_by_basename(docs: DataFrame, name: str | None) -> DataFrame:
    if not (name or "").strip() or name == "unknown_source":
        return docs.limit(0)
    return docs.where(F.element_at(F.split("file_path", "[/\\\\]"), -1) == name).orderBy("id").limit(1)


def save_memory(memories: DataFrame, owns: DataFrame, produced: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memories with new ones, and the edges to their user and, where known, their session. new: memory_id, user_id, content, created_at, session_id."""
    kept = write.create(memories, new.select(*memories.columns), ["memory_id"])
    return (
        kept,
        write.merge_edges(owns, new.select(F.col("user_id").alias("src"), F.col("memory_id").alias("dst"))),
        write.merge_edges(produced, new.select(F.col("session_id").alias("src"), F.col("memory_id").alias("dst"))),
    )


def update_memory(memories: DataFrame, memory_id: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(memories with the new content, the row that changed: none if there is no such memory)."""
    hit = F.col("memory_id") == memory_id
    new = memories.withColumn("content", F.when(hit, F.lit(content)).otherwise(F.col("content")))
    return new, new.where(hit)
