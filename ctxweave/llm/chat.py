"""Chat formatting as prefix trees.

Conversations that share their first turns share the nodes of those turns. A node is
identified by a running digest of its turns, so trees are built by grouping and joining
on digests and no task ever holds a tree. Nodes are laid out depth-first: each tree is
one token sequence in which shared turns stand once. A node belongs to the least
conversation that has it, and what one conversation owns follows each other in that
order, so it is conversations that are sorted and not nodes. A node's position ids continue its
parent's, and its attention intervals are its ancestors' spans in the sequence; within
the node attention is causal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxweave.llm import bpe
from ctxweave.runtime import prepare, shuffle_width


def render(role: str, text: str) -> str:
    """A turn as it is tokenised."""
    return f"<|{role}|>\n{text}<|end|>\n"


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path, pattern)
        for b in batches:
            got = enc.encode_batch([render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())])
            sizes = np.array([len(g) for g in got], np.int64)
            values = pa.array(np.concatenate(got) if got else np.zeros(0, np.int32), pa.int32())
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], tokens, pa.array(sizes), *b.columns[4:]], names=["conv", "depth", "role", "tokens", "n", "node", "conv_ids"])

    return run


def _depth_first(chains: DataFrame) -> DataFrame:
    """Adds before and seq_before, the tokens and nodes that stand before the chain's own in its tree, in order of (tree_id, path).

    A tree may hold most of all conversations, so none is sorted in one task: chains are
    range-partitioned, counted within each part, and what a tree has in earlier parts
    is added.
    """
    parts = chains.repartitionByRange(shuffle_width(chains.sparkSession), "tree_id", "path").withColumn("part", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy("part", "tree_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("k", F.coalesce(F.sum("c").over(own), F.lit(0))).withColumn("to", F.coalesce(F.sum("s").over(own), F.lit(0)))
    earlier = Window.partitionBy("tree_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("tree_id", "part").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    before = totals.select("tree_id", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"))
    return inside.join(before, ["tree_id", "part"]).select("conv", "tree_id", (F.col("k") + F.col("c0")).alias("seq_before"), (F.col("to") + F.col("s0")).alias("before"))


def prefix_trees(conversations: DataFrame, path: str = bpe.RANKS, pattern: str = bpe.PATTERN) -> DataFrame:
    """One row a node of the trees.

    tree_id: the least conv_id of the tree; seq: the node's number in depth-first order,
    children by their least conv_id; depth; role; tokens; start, end: the node's span in
    the tree's token sequence; position_ids; attention: spans of the ancestors, root
    first; conv_ids: the conversations that end with the node, in order.

    Turns follow the turn column; gaps don't matter. Rows with a null conv_id or turn are
    left out, a null role or text is empty. Repeated rows count once; several different
    rows of one turn follow each other by role and text. Other columns are not read. An
    empty table gives an empty result.

    What is held and moved grows with the turns, however long a conversation is, but
    for the result's own attention spans, one for each ancestor of a node.
    """
    prepare(conversations.sparkSession)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null and turn is not null")
    said = Window.partitionBy("conv").orderBy("turn", "role", "text")
    turns = turns.withColumn("nth", F.row_number().over(said)).withColumn("depth", F.dense_rank().over(said) - 1).withColumn("first", F.coalesce(F.lag("depth").over(said) != F.col("depth"), F.lit(True)))
    # a prefix's digest is made of two running sums of its turns' hashes, so it takes no list of turns
    order = Window.partitionBy("conv").orderBy("depth")
    digest = F.md5(F.concat(F.md5("role"), F.md5("text")))
    sums = [F.sum(F.xxhash64(F.lit(k), "depth", digest).cast("decimal(20,0)")).over(order.rowsBetween(Window.unboundedPreceding, 0)) for k in (1, 2)]
    steps = turns.where("first").withColumn("node", F.md5(F.concat_ws("|", "depth", *sums))).withColumn("last", F.lead("depth").over(order).isNull()).select("conv", "depth", "role", "text", "node", "last").checkpoint()
    nodes = steps.groupBy("node").agg(F.min("conv").alias("least"), F.sort_array(F.collect_list(F.when(F.col("last"), F.col("conv")))).alias("conv_ids"))
    # a node belongs to its least conversation, so a conversation owns the end of its chain or nothing
    owned = steps.join(nodes, "node").where("conv = least").select("conv", "depth", "role", "text", "node", "conv_ids")
    kept = owned.mapInArrow(_encode(path, pattern), "conv long, depth int, role string, tokens array<int>, n long, node string, conv_ids array<long>").checkpoint()
    totals = kept.groupBy("conv").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    chain = steps.select("conv", "depth", "node").join(totals.select("conv"), "conv", "left_semi").join(nodes.select("node", "least"), "node")
    chains = chain.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "least"))), lambda x: x["least"]).alias("path")).join(totals, "conv").withColumn("tree_id", F.col("path")[0])
    placed = kept.join(_depth_first(chains), "conv").withColumn("seq", F.col("seq_before") + F.row_number().over(order) - 1).withColumn("end", F.col("before") + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("n")).drop("before", "seq_before").checkpoint()
    spans = placed.select("node", F.struct("start", "end").alias("span"))
    above = chain.select("conv", "depth", "node").join(spans, "node").groupBy("conv").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "span"))), lambda x: x["span"]).alias("spans"))
    attention = F.slice("spans", 1, F.col("depth"))
    position = F.aggregate(attention, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return (
        placed.join(above, "conv")
        .withColumn("attention", attention)
        .withColumn("position", position)
        .select("tree_id", F.col("seq").cast("long").alias("seq"), "depth", "role", "tokens", "start", "end", F.sequence(F.col("position"), F.col("position") + F.col("n") - 1).alias("position_ids"), "attention", "conv_ids")
    )
