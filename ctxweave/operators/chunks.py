"""Documents to linked chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxweave.operators import write


def strip_html(x: str | Column) -> Column:
    """Text of a page: without head matter, scripts, styles and comments; block ends as line ends; tags off; basic entities decoded."""
    c = F.col(x) if isinstance(x, str) else x
    c = F.regexp_replace(c, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>|</(p|div|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer)\s*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(c, r"[ \t\x0B\f\r]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def split_chunks(docs: DataFrame, key: str, text: str, separator: str = "\n", size: int | None = None) -> DataFrame:
    """(key, pos, hash, text): a chunk for each part that isn't blank; parts over `size` characters are cut at it."""
    parts = F.split(F.col(text), separator)
    if size:
        cut = lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(p) - 1) / size), F.lit(0)).cast("int")), lambda k: F.substring(p, k * size + 1, F.lit(size)))
        parts = F.flatten(F.transform(parts, cut))
    each = docs.select(F.col(key), F.posexplode(parts).alias("pos", "text"))
    return each.where(F.trim("text") != "").select(key, "pos", F.sha2("text", 256).alias("hash"), "text")


def chunk_nodes(chunks: DataFrame, key: str) -> DataFrame:
    """One node for each text: MERGE on the hash, the first occurrence in force."""
    return write.first_rows(chunks, ["hash"], [key, "pos"]).select("hash", "text")


def next_chain(chunks: DataFrame, key: str) -> DataFrame:
    """(src, dst) of hashes of neighbouring chunks of a document, each pair once."""
    w = Window.partitionBy(key).orderBy("pos")
    return chunks.select(F.col("hash").alias("src"), F.lead("hash").over(w).alias("dst")).where("dst is not null").distinct()


def length_stats(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.agg(F.count("*").alias("n_chunks"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.avg(n).alias("avg_chars"))


def mentioned_in(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(entity_id, hash) where an entity's file_path is a chunk's hash."""
    c = chunks.select("hash").distinct()
    return entities.join(c, entities["file_path"] == c["hash"]).select("entity_id", "hash").distinct()


def workspace(explicit: str | None = None, derived: str | None = None, default: str = "base") -> str:
    """The namespace of entities: what is asked for, else what is derived, else the default."""
    return (explicit or "").strip() or (derived or "").strip() or default
