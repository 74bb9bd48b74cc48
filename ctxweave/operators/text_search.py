"""Full-text recall: a postings table and BM25.

Score: sum over query words of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)),
idf = ln(1 + (N - df + 0.5) / (df + 0.5)), k1 = 1.2, b = 0.75. N, df and the average are
those of the searched documents. Words are runs of letters, digits and underscores in lower case.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(text: str) -> list[str]:
    return sorted({w for w in re.split(r"[^\w]+", text.lower()) if w})


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): the index; write it out to search it more than once."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    each = docs.select(F.col(key), words.alias("w")).select(key, F.size("w").cast("long").alias("length"), F.explode("w").alias("term"))
    return each.groupBy(key, "term", "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, key: str, text: str, limit: int | None = 10, k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of documents that hold a query word, best first. A blank query finds nothing and reads nothing.

    One pass over the texts counts documents, words and the documents of each query
    word; a second takes only the counts of the query's words of documents that have
    any, and sums within the row, so that nothing is exploded or joined. `key` tells
    documents apart.
    """
    wanted = terms(query)
    if not wanted:
        return docs.sparkSession.createDataFrame([], f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    count = lambda t: F.size(F.filter("w", lambda x: x == t))
    counts = [count(t).alias(f"tf{k}") for k, t in enumerate(wanted)]
    sized = docs.select(F.col(key).alias("key"), words.alias("w")).select("key", F.size("w").alias("length"), *counts)
    held = [F.count_if(F.col(f"tf{k}") > 0).cast("double").alias(f"df{k}") for k in range(len(wanted))]
    corpus = sized.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("avg_length"), *held)  # one row
    score = F.lit(0.0)
    for k in range(len(wanted)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        score += F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    some = F.greatest(*[F.col(f"tf{k}") for k in range(len(wanted))], F.lit(0)) > 0
    out = sized.where(some).crossJoin(F.broadcast(corpus)).select(F.col("key").alias(key), score.alias("score"))
    return out if limit is None else out.orderBy(F.desc("score"), key).limit(limit)


def search_memories(memories: DataFrame, user: str, query: str, limit: int = 10) -> DataFrame:
    """A user's memories that match, best first. The whole table's figures weigh the words, then the owner's rows are taken."""
    hits = bm25(memories, query, "memory_id", "content", None)
    return memories.where(F.col("user_id") == user).join(hits, "memory_id").orderBy(F.desc("score"), "memory_id").limit(limit)


def memories_newest(memories: DataFrame, produced: DataFrame, user: str | None = None) -> DataFrame:
    """Memories newest first, with the session that produced each, null where none did."""
    rows = memories if user is None else memories.where(F.col("user_id") == user)
    return rows.join(produced.select("memory_id", F.col("session_id").alias("source_session")), "memory_id", "left").orderBy(F.desc("created_at"), "memory_id")
