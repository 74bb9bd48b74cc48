"""Schema discovery, search and description; the index advisor."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.functions.scalars import graph_type, search_pattern
from ctxweave.plans.model import Index


def property_profile(nodes: dict[str, DataFrame], examples: int = 3) -> DataFrame:
    """(label, property, type, non_null, total, filling_factor, examples): one pass a label.

    Examples are up to three values, or `examples` if that is fewer: the shortest, the
    least and the greatest.
    """
    parts = []
    for label, df in nodes.items():
        stats = [F.struct(F.lit(c).alias("property"), F.lit(graph_type(t)).alias("type"), F.count(F.col(f"`{c}`")).alias("non_null"), F.count("*").alias("total")) for c, t in df.dtypes]
        parts.append(df.agg(F.array(*stats).alias("s")).select(F.lit(label).alias("label"), F.inline("s")))
    out = reduce(DataFrame.union, parts).withColumn("filling_factor", F.when(F.col("total") > 0, 100.0 * F.col("non_null") / F.col("total")).otherwise(0.0))
    if not examples:
        return out
    shown = []
    for label, df in nodes.items():
        values = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(f"`{c}`").alias("v")) for c in df.columns])).alias("x")).select("x.*").where("v is not null")
        least = values.groupBy("property").agg(F.min_by("v", F.struct(F.length("v"), "v")).alias("a"), F.min("v").alias("b"), F.max("v").alias("c"))
        shown.append(least.select(F.lit(label).alias("label"), "property", F.slice(F.array_distinct(F.array("a", "b", "c")), 1, examples).alias("examples")))
    return out.join(reduce(DataFrame.union, shown), ["label", "property"], "left")


def typed_profile(rows: DataFrame, label: str, prop: str, kind: str) -> DataFrame:
    """(label, property, type, count) of values whose types differ within a property."""
    return rows.groupBy(F.col(label).alias("label"), F.col(prop).alias("property"), F.col(kind).alias("type")).agg(F.count("*").alias("n"))


def node_count_estimate(profile: DataFrame) -> DataFrame:
    """(label, estimate): the most values of any property, nulls left out."""
    sums = profile.where("type <> 'Null'").groupBy("label", "property").agg(F.sum("n").alias("n"))
    return sums.groupBy("label").agg(F.max("n").alias("estimate"))


def primary_type(profile: DataFrame) -> DataFrame:
    """(label, property, type): the most frequent type that isn't Null, ties by name."""
    best = profile.where("type <> 'Null'").groupBy("label", "property").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))
    return best


def relationship_schema(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(start, type, end, n) of the kinds of edges: edges (src, dst, type), nodes (id, label)."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("label").alias("start")), nodes.select(F.col("id").alias("dst"), F.col("label").alias("end"))
    return edges.join(a, "src").join(b, "dst").groupBy("start", "type", "end").agg(F.count("*").alias("n"))


def property_keys(rows: DataFrame, label: str, properties: str) -> DataFrame:
    """(label, properties): the distinct keys of a map column, sorted."""
    keys = rows.select(F.col(label).alias("label"), F.explode(F.map_keys(properties)).alias("k"))
    return keys.groupBy("label").agg(F.sort_array(F.collect_set("k")).alias("properties"))


def document(nodes: dict[str, DataFrame], edges: dict[str, tuple[str, DataFrame, str]], indexes: list[Index] = (), constraints: list = (), enums: list = ()) -> dict:
    """The schema as a document; types come from the tables' own schemas, so no data is read."""
    props = lambda df, skip=(): [{"key": c, "type": graph_type(t)} for c, t in df.dtypes if c not in skip]
    return {
        "nodes": [{"labels": [k], "properties": props(df)} for k, df in nodes.items()],
        "edges": [{"type": k, "start_node_labels": [a], "end_node_labels": [b], "properties": props(df, ("src", "dst"))} for k, (a, df, b) in edges.items()],
        "indexes": [{"kind": i.kind, "labels": i.labels, "properties": i.properties} for i in indexes],
        "constraints": [{"kind": c.kind, "labels": c.labels, "properties": c.properties} for c in constraints],
        "enums": [{"name": e.name, "values": e.values} for e in enums],
    }


def node_schema(doc: dict, labels: list[str]) -> dict | str:
    """A node with its indexes, constraints and edges in, out and to itself; a text if there is none. Loops are in one list only."""
    want = sorted(labels)
    node = next((n for n in doc["nodes"] if sorted(n["labels"]) == want), None)
    if node is None:
        return f"no node has the labels {', '.join(labels)}"
    starts = [e for e in doc["edges"] if sorted(e["start_node_labels"]) == want]
    ends = [e for e in doc["edges"] if sorted(e["end_node_labels"]) == want]
    within = lambda xs: [x for x in xs if x["labels"] and set(x["labels"]) <= set(labels)]
    return {"node": node, "indexes": within(doc["indexes"]), "constraints": within(doc["constraints"]), "outbound": [e for e in starts if e not in ends], "inbound": [e for e in ends if e not in starts], "loops": [e for e in starts if e in ends]}


def relationship_of(doc: dict, kind: str, start: list[str], end: list[str]) -> dict | str:
    found = next((e for e in doc["edges"] if e["type"] == kind and sorted(e["start_node_labels"]) == sorted(start) and sorted(e["end_node_labels"]) == sorted(end)), None)
    return found or f"no relationship {kind} leads from {', '.join(start)} to {', '.join(end)}"


def enum_schema(doc: dict, name: str) -> dict | str:
    return next((e for e in doc["enums"] if e["name"] == name), f"no enum is named {name}")


def search(doc: dict, pattern: str) -> list[dict]:
    """What in a schema document matches a pattern, nodes first, then edges, then enums, each with its reasons."""
    rx = re.compile(search_pattern(pattern))
    out = []
    for kind, items, names in (("node", doc["nodes"], lambda n: [("label", x) for x in n["labels"]]), ("relationship", doc["edges"], lambda e: [("type", e["type"])]), ("enum", doc["enums"], lambda e: [("name", e["name"]), *(("value", v) for v in e["values"])])):
        for x in items:
            reasons = [f"{what}: {v}" for what, v in names(x) if rx.search(v)]
            reasons += [f"property: {p['key']}" for p in x.get("properties", []) if rx.search(p["key"])]
            reasons += [f"description: {x['description']}"] if x.get("description") and rx.search(x["description"]) else []
            if reasons:
                out.append({"kind": kind, "item": x, "reasons": reasons})
    return out


def search_table(schema: DataFrame, pattern: str, columns: list[str]) -> DataFrame:
    """Rows of a schema table (as information_schema gives) one of whose columns matches."""
    return schema.where(reduce(lambda a, b: a | b, [F.col(c).rlike(search_pattern(pattern)) for c in columns]))


def describe(doc: dict) -> str:
    """The schema as a text for a prompt."""
    lines = ["Nodes:"]
    lines += [f"- {':'.join(n['labels'])} ({', '.join(f'{p["key"]}: {p["type"].lower()}' for p in n['properties'])})" for n in doc["nodes"]]
    lines += ["Relationships:"]
    lines += [f"- (:{':'.join(e['start_node_labels'])})-[:{e['type']}]->(:{':'.join(e['end_node_labels'])})" + (f" ({', '.join(f'{p["key"]}: {p["type"].lower()}' for p in e['properties'])})" if e["properties"] else "") for e in doc["edges"]]
    return "\n".join(lines)


def advise(df: DataFrame, existing: list[Index], tables: dict[str, str]) -> dict:
    """Indexes that a query's filters and joins would use: (recommended, existing, missing).

    Reads the optimised plan; tables maps a column to the label of its table.
    """
    text = df._jdf.queryExecution().optimizedPlan().toString()
    used = set()
    for line in text.splitlines():
        if re.search(r"\b(Filter|Join)\b", line):
            used |= {c for c in re.findall(r"([A-Za-z_][A-Za-z_0-9]*)#\d+", line) if c in tables}
    wanted = [Index("label_property", [tables[c]], [c]) for c in sorted(used)]
    have = [i for i in wanted if any(i.labels == x.labels and i.properties == x.properties for x in existing)]
    return {"recommended": wanted, "existing": have, "missing": [i for i in wanted if i not in have], "optimised": len(have) == len(wanted)}
