"""Ingest of graph documents: nested nodes and relationships of one source each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "struct<id:string,type:string,properties:map<string,string>>"
SCHEMA = f"nodes array<{NODE}>, relationships array<struct<source:{NODE},target:{NODE},type:string,properties:map<string,string>>>, source struct<page_content:string,metadata:map<string,string>>"


def ingest(docs: DataFrame, include_source: bool = True, base_label: str | None = None) -> dict[str, DataFrame]:
    """documents, nodes, edges and mentions of graph documents (SCHEMA).

    A document's id is its metadata's id, else the MD5 of its content. Nodes merge by
    (id, type); a relationship brings its ends along. Properties of a key merge to the
    greatest value. Only sources of relationships are mentioned by the document.
    """
    keyed = docs.withColumn("doc_id", F.coalesce(F.element_at("source.metadata", F.lit("id")), F.md5("source.page_content")))
    documents = keyed.where("doc_id is not null").groupBy("doc_id").agg(F.min("source.page_content").alias("text"))
    rel = keyed.select("doc_id", F.explode("relationships").alias("r"))
    listed = keyed.select(F.explode("nodes").alias("n")).select("n.*")
    ends = rel.select("r.source.*").union(rel.select("r.target.*"))
    found = listed.union(ends).where("id is not null")
    nodes = found.select("id", "type").distinct()
    props = found.select("id", "type", F.explode("properties").alias("k", "v")).groupBy("id", "type", "k").agg(F.max("v").alias("v")).groupBy("id", "type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    nodes = nodes.join(props, ["id", "type"], "left").select("id", "type", F.array(*([F.lit(base_label)] if base_label else []), F.col("type")).alias("labels"), F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))
    edges = rel.where("r.source.id is not null and r.target.id is not null").select(F.col("r.source.id").alias("src"), F.upper(F.regexp_replace("r.type", " ", "_")).alias("type"), F.col("r.target.id").alias("dst")).distinct()
    mentions = rel.where("r.source.id is not null").select("doc_id", F.col("r.source.id").alias("id")).distinct()
    out = {"nodes": nodes, "edges": edges}
    return out | ({"documents": documents, "mentions": mentions} if include_source else {})
