"""Property graphs on DataFrames: pattern expansion, lookups and traversal."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class PropertyGraph:
    """Nodes by label (each with its id column) and edges by type (columns src, dst and properties)."""

    nodes: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)
    edges: dict[str, tuple[str, DataFrame, str]] = field(default_factory=dict)

    def add_nodes(self, label: str, df: DataFrame, key: str = "id") -> PropertyGraph:
        self.nodes[label] = (df, key)
        return self

    def add_edges(self, kind: str, start: str, df: DataFrame, end: str) -> PropertyGraph:
        for label in (start, end):
            if label not in self.nodes:
                raise ValueError(f"no nodes have the label {label}")
        self.edges[kind] = (start, df, end)
        return self

    def scan(self, label: str) -> DataFrame:
        return self.nodes[label][0]

    def match(self, start: str, *hops: str) -> DataFrame:
        """A fixed path along the given edge types; `<TYPE` goes backwards. Columns are prefixed n0_, n1_, ..."""
        df, key = self.nodes[start]
        out, here, at = df.select([F.col(c).alias(f"n0_{c}") for c in df.columns]), start, f"n0_{key}"
        for k, hop in enumerate(hops, 1):
            back = hop.startswith("<")
            a, edges, b = self.edges[hop.lstrip("<")]
            source, target, src, dst = (b, a, "dst", "src") if back else (a, b, "src", "dst")
            if source != here:
                raise ValueError(f"{hop} doesn't leave {here}")
            nodes, node_key = self.nodes[target]
            step = edges.select(F.col(src).alias("__s"), F.col(dst).alias("__d"))
            there = nodes.select([F.col(c).alias(f"n{k}_{c}") for c in nodes.columns])
            out = out.join(step, out[at] == step["__s"]).join(there, F.col("__d") == F.col(f"n{k}_{node_key}")).drop("__s", "__d")
            here, at = target, f"n{k}_{node_key}"
        return out

    def counts(self) -> DataFrame:
        """(kind, name, n) of every label and edge type, in one job."""
        parts = [df.agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.lit(label).alias("name"), "n") for label, (df, _) in self.nodes.items()]
        parts += [df.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit(kind).alias("name"), "n") for kind, (_, df, _) in self.edges.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


def expand(nodes: DataFrame, key: str, edges: DataFrame, others: DataFrame, other_key: str, src: str = "src", dst: str = "dst", how: str = "inner") -> DataFrame:
    """(a)-[:R]->(b); how='left' is OPTIONAL MATCH. The edge's src and dst columns are dropped."""
    e = edges.withColumnsRenamed({src: "__src", dst: "__dst"})
    there = e.join(others, e["__dst"] == others[other_key])
    return nodes.join(there, nodes[key] == there["__src"], how).drop("__src", "__dst")


def connect(pairs: DataFrame, starts: DataFrame, start_key: str, ends: DataFrame, end_key: str) -> DataFrame:
    """(src, dst) pairs both of whose ends exist, once each: MATCH two nodes, MERGE the edge."""
    a, b = starts.select(F.col(start_key).alias("src")).distinct(), ends.select(F.col(end_key).alias("dst")).distinct()
    return pairs.select("src", "dst").where("src is not null and dst is not null").distinct().join(a, "src", "left_semi").join(b, "dst", "left_semi")


def lookup(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose key is among the ids; ids that miss have no row."""
    wanted = ids.select(F.col(id_column).alias("__id")).where("__id is not null").distinct()
    return df.join(wanted, df[key] == wanted["__id"], "left_semi")


def aligned_lookup(df: DataFrame, key: str, ids: DataFrame, id_column: str, position: str) -> DataFrame:
    """One row for each request, in its place, null where the id has no row."""
    asked = ids.select(F.col(position).alias("__pos"), F.col(id_column).alias("__id"))
    return asked.join(df, asked["__id"] == df[key], "left").select(F.col("__pos").alias(position), F.col("__id").alias("requested"), *[df[c] for c in df.columns])


def missing(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    """The set of ids that have no row."""
    wanted = ids.select(F.col(id_column).alias("id")).where("id is not null").distinct()
    return wanted.join(df.select(F.col(key).alias("__k")), F.col("id") == F.col("__k"), "left_anti")


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def degree(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, degree); a loop counts twice."""
    return edges.select(F.col(src).alias("id")).union(edges.select(F.col(dst).alias("id"))).where("id is not null").groupBy("id").agg(F.count("*").alias("degree"))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 10, src: str = "src", dst: str = "dst", directed: bool = False, every: int = 4) -> DataFrame:
    """(id, distance) of all that is reachable from the seeds' column `id` within a number of hops.

    A loop of frontier joins: each round joins only the nodes first met in the round
    before, and the visited set is checkpointed so that plans stay short. It ends early
    when nothing new is met.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    if not directed:
        e = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = e.where("a is not null and b is not null").distinct()
    visited = seeds.select("id").where("id is not null").distinct().withColumn("distance", F.lit(0)).checkpoint()
    frontier = visited
    for k in range(1, max_depth + 1):
        found = frontier.select(F.col("id").alias("a")).join(e, "a").select(F.col("b").alias("id")).distinct()
        frontier = found.join(visited.select("id"), "id", "left_anti").withColumn("distance", F.lit(k)).checkpoint()
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
        if k % every == 0:
            visited = visited.checkpoint()
    return visited


def same_labels(a: str | Column, b: str | Column) -> Column:
    """Two label lists are the same set."""
    f = lambda x: F.array_sort(F.array_distinct(F.col(x) if isinstance(x, str) else x))
    return f(a) == f(b)


def covers(inner: str | Column, outer: str | Column) -> Column:
    """A label list that isn't empty and lies within another."""
    f = lambda x: F.col(x) if isinstance(x, str) else x
    return (F.size(f(inner)) > 0) & (F.size(F.array_except(f(inner), f(outer))) == 0)
