"""From tables to graph tables: what to load, loading it, and checking what was loaded."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxweave.plans.catalogue import Catalogue
from ctxweave.plans.model import Edge, GraphModel, Node

CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"


def load_node(node: Node, table: DataFrame) -> DataFrame:
    """The node's properties, one row a key; rows with a null key part are left out. Of rows with one key the greatest stays."""
    cols = [F.col(p.source or p.name).alias(p.name) for p in node.properties]
    rows = table.select(*cols).where(" and ".join(f"`{k}` is not null" for k in node.key))
    rest = [p.name for p in node.properties if p.name not in node.key]
    if not rest:
        return rows.distinct()
    return rows.groupBy(*node.key).agg(F.max(F.struct(*rest)).alias("__r")).select(*[F.col(p.name) if p.name in node.key else F.col(f"__r.{p.name}").alias(p.name) for p in node.properties])


Columns = str | list[str]


def _whole(columns: Columns) -> tuple[Column, Column]:
    """A key as one value (a struct if it has several columns), and whether all of it is there."""
    cols = [F.col(c) for c in ([columns] if isinstance(columns, str) else columns)]
    there = cols[0].isNotNull()
    for c in cols[1:]:
        there &= c.isNotNull()
    return (cols[0] if len(cols) == 1 else F.struct(*[c.alias(f"k{k}") for k, c in enumerate(cols, 1)])), there


def _ends(pairs: DataFrame, at: str, target: DataFrame, refers_to: Columns, key: Columns) -> DataFrame:
    """Pairs whose column `at` refers to a row of the target, with that row's key in its place."""
    own, there = _whole(refers_to)
    if refers_to == key:
        return pairs.join(target.where(there).select(own.alias(at)), at, "left_semi")
    known = target.where(there & _whole(key)[1]).select(own.alias(at), _whole(key)[0].alias("__key")).distinct()
    return pairs.join(known, at).drop(at).withColumnRenamed("__key", at)


def load_fk_edge(table: DataFrame, key: Columns, fk: Columns, target: DataFrame, target_key: Columns, refers_to: Columns | None = None) -> DataFrame:
    """(src, dst) of a foreign key: null and dangling keys make no edge.

    Keys may have several columns; src and dst are then structs of k1, k2 and so on.
    refers_to: the target's columns that fk holds, if they aren't its key.
    """
    (src, has_src), (dst, has_dst) = _whole(key), _whole(fk)
    pairs = table.where(has_src & has_dst).select(src.alias("src"), dst.alias("dst")).distinct()
    return _ends(pairs, "dst", target, refers_to or target_key, target_key).select("src", "dst")


def load_join_edge(table: DataFrame, start: Columns, end: Columns, starts: DataFrame, start_key: Columns, ends: DataFrame, end_key: Columns, starts_at: Columns | None = None, ends_at: Columns | None = None) -> DataFrame:
    """(src, dst) through a join table, both ends of which exist; keys as for load_fk_edge."""
    (src, has_src), (dst, has_dst) = _whole(start), _whole(end)
    pairs = table.where(has_src & has_dst).select(src.alias("src"), dst.alias("dst")).distinct()
    return _ends(_ends(pairs, "src", starts, starts_at or start_key, start_key), "dst", ends, ends_at or end_key, end_key).select("src", "dst")


@dataclass
class Result:
    done: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def ingest(model: GraphModel, catalogue: Catalogue, frames: dict[str, DataFrame], write, only_nodes: set[str] | None = None, only_edges: set[tuple] | None = None, retries: int = 0) -> Result:
    """Loads what is planned; `write(name, frame)` stores each. An error of one is noted and the rest goes on.

    None means all; an empty set means none. Frames are lazy: errors of execution are
    noted too if `write` runs what it is given, as a save does. A load that fails is
    tried `retries` times more, so `write` should replace what a broken one left.
    """
    out = Result()
    for n in model.nodes:
        if n.source and (only_nodes is None or n.source in only_nodes):
            _try(out, n.label, lambda n=n: write(n.label, load_node(n, frames[n.source])), retries)
    for e in model.edges:
        if only_edges is None or e.key in only_edges:
            _try(out, e.type, lambda e=e: write(e.type, load_edge(e, model, frames)), retries)
    return out


def load_edge(e: Edge, model: GraphModel, frames: dict[str, DataFrame]) -> DataFrame:
    a, b = model.node(e.start[0]), model.node(e.end[0])
    if e.kind == "many_to_many":
        w = e.width
        return load_join_edge(frames[e.source], e.columns[:w], e.columns[w:], frames[a.source], a.key, frames[b.source], b.key, e.targets[:w] or None, e.targets[w:] or None)
    return load_fk_edge(frames[e.source], a.key, e.columns, frames[b.source], b.key, e.targets or None)


def _try(out: Result, name: str, f, retries: int = 0) -> None:
    for left in range(retries, -1, -1):
        try:
            f()
            out.done.append(name)
            return
        except Exception as e:  # noqa: BLE001  one table's failure is reported and doesn't stop the others
            if not left:
                out.errors[name] = f"{type(e).__name__}: {str(e)[:500]}"


# --- what to load again ---


def summary(model: GraphModel, counts: dict[str, int | None], source: dict[str, str]) -> dict:
    """What is stored after a load, to plan the next one."""
    return {
        "source": source,
        "model_hash": model.hash(),
        "nodes": {n.source: {"properties": sorted(p.name for p in n.properties), "key": n.key, "rows": counts.get(n.source)} for n in model.nodes if n.source},
        "edges": {"|".join(e.key): {"mapping": [e.source, *e.columns], "start": sorted(e.start), "end": sorted(e.end), "kind": e.kind} for e in model.edges},
    }


def plan(stored: dict | None, model: GraphModel, counts: dict[str, int | None], policy: str = "auto") -> tuple[dict[str, str], dict[tuple, str]]:
    """(nodes by source table, edges by key) to load, each with its reason.

    policy: auto compares with what is stored, reset loads all, skip loads nothing.
    """
    if policy == "skip":
        return {}, {}
    old_nodes = {} if policy == "reset" or not stored else stored["nodes"]
    old_edges = {} if policy == "reset" or not stored else stored["edges"]
    nodes: dict[str, str] = {}
    for n in model.nodes:
        if not n.source:
            continue
        was, rows = old_nodes.get(n.source), counts.get(n.source)
        if was is None:
            nodes[n.source] = "new"
        elif was["properties"] != sorted(p.name for p in n.properties):
            nodes[n.source] = "properties changed"
        elif was["key"] != n.key:
            nodes[n.source] = "key changed"
        elif rows is None or was["rows"] is None:
            nodes[n.source] = "count unknown"
        elif rows > was["rows"]:
            nodes[n.source] = "rows added"
        elif rows != was["rows"]:
            nodes[n.source] = "count changed"
    planned = {label for n in model.nodes if n.source in nodes for label in n.labels}
    edges: dict[tuple, str] = {}
    for e in model.edges:
        was = old_edges.get("|".join(e.key))
        if was is None:
            edges[e.key] = "new"
        elif was["mapping"] != [e.source, *e.columns] or was["kind"] != e.kind:
            edges[e.key] = "mapping changed"
        elif was["start"] != sorted(e.start):
            edges[e.key] = "start changed"
        elif was["end"] != sorted(e.end):
            edges[e.key] = "end changed"
        elif planned & {*e.start, *e.end}:
            edges[e.key] = "an end is loaded"
    return nodes, edges


# --- checks ---


@dataclass
class Issue:
    severity: str
    what: str


def score(critical: int | Column, warning: int | Column, info: int | Column):
    """100 less 10, 3 and 1 an issue, not under 0."""
    points = 100 - (10 * critical + 3 * warning + 1 * info)
    return F.round(F.greatest(F.lit(0.0), points.cast("double")), 2) if isinstance(points, Column) else round(max(0.0, float(points)), 2)


def issues_score(issues: list[Issue]) -> float:
    n = {s: sum(i.severity == s for i in issues) for s in (CRITICAL, WARNING, INFO)}
    return score(n[CRITICAL], n[WARNING], n[INFO])


def count_severity(expected: Column, actual: Column) -> Column:
    """CRITICAL over a tenth off, WARNING if off at all, null if equal."""
    off = F.abs(actual - expected)
    return F.when(off == 0, F.lit(None)).when(off > 0.1 * F.greatest(expected, F.lit(1)), CRITICAL).otherwise(WARNING)


def check_model(model: GraphModel, catalogue: Catalogue) -> tuple[list[Issue], float]:
    """(issues, percentage of entity tables covered) of a model against the tables."""
    out: list[Issue] = []
    entities = {t.name: t for t in catalogue.entities()}
    covered = {n.source for n in model.nodes} & set(entities)
    out += [Issue(CRITICAL, f"table {t} has no node") for t in sorted(set(entities) - covered)]
    for n in model.nodes:
        if n.source in entities:
            t = entities[n.source]
            keys = {f.column for f in t.foreign_keys}
            have = {p.source or p.name for p in n.properties}
            lost = [c.name for c in t.columns if c.name not in keys and c.name not in have]
            if lost:
                out.append(Issue(WARNING, f"{n.label} lacks {', '.join(lost)}"))
        if not any(set(n.key) <= set(i.properties) and n.label in i.labels for i in model.indexes):
            out.append(Issue(INFO, f"the key of {n.label} isn't indexed"))
        if not n.label[:1].isupper():
            out.append(Issue(INFO, f"label {n.label} doesn't start with a capital"))
    labels = [x for n in model.nodes for x in n.labels]
    out += [Issue(WARNING, f"label {x} is used twice") for x in sorted({x for x in labels if labels.count(x) > 1})]
    if len(model.edges) < (wanted := sum(len(t.foreign_keys) for t in entities.values())):
        out.append(Issue(WARNING, f"{len(model.edges)} edges for {wanted} foreign keys"))
    out += [Issue(CRITICAL, f"edge {e.type} has no node at an end") for e in model.edges if not (set(e.start) & set(labels) and set(e.end) & set(labels))]
    out += [Issue(INFO, f"edge type {e.type} isn't in capitals") for e in model.edges if e.type != e.type.upper()]
    return out, 100.0 if not entities else round(100.0 * len(covered) / len(entities), 2)


def check_loaded(model: GraphModel, nodes: dict[str, DataFrame], edges: dict[str, DataFrame], expected: dict[str, int], indexes: list | None = None, constraints: list | None = None, types: bool = False) -> list[Issue]:
    """Issues of loaded tables against the model. All row counts are one job; the rest compares names."""
    from ctxweave.functions.scalars import compatible, graph_type

    out = [Issue(CRITICAL, f"label {n.label} is missing") for n in model.nodes if n.label not in nodes]
    out += [Issue(CRITICAL, f"edge type {e.type} is missing") for e in model.edges if e.type not in edges]
    for n in model.nodes:
        if n.label in nodes:
            have = dict(nodes[n.label].dtypes)
            out += [Issue(CRITICAL, f"{n.label} lacks property {p.name}") for p in n.properties if p.name not in have]
            if types:
                out += [Issue(WARNING, f"{n.label}.{p.name} is {graph_type(have[p.name])}, not {p.type}") for p in n.properties if p.name in have and not compatible(p.type, graph_type(have[p.name]))]
    out += [Issue(WARNING, f"index on {i.labels}{i.properties} is missing") for i in model.indexes if indexes is not None and i not in indexes]
    out += [Issue(CRITICAL, f"constraint on {c.labels}{c.properties} is missing") for c in model.constraints if constraints is not None and c not in constraints]
    asked = [("node", k, df) for k, df in nodes.items() if k in expected] + [("edge", k, df) for k, df in edges.items() if k in expected]
    counted = [df.agg(F.lit(kind).alias("kind"), F.lit(k).alias("name"), F.count("*").alias("n")) for kind, k, df in asked]
    got = {(r["kind"], r["name"]): r["n"] for r in reduce(DataFrame.union, counted).collect()} if counted else {}
    for kind, name, _ in asked:
        n, want = got[kind, name], expected[name]
        if kind == "node" and n != want:
            out.append(Issue(CRITICAL if abs(n - want) > 0.1 * max(want, 1) else WARNING, f"{name} has {n} nodes, not {want}"))
        if kind == "edge" and n < 0.5 * want:
            out.append(Issue(WARNING, f"{name} has less than half of its edges"))
    return out


def constraint_violations(model: GraphModel, nodes: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(label, kind, properties, rows) of the constraints that rows break; what a database would enforce."""
    parts = []
    for c in model.constraints:
        label = c.labels[0]
        if label not in nodes:
            continue
        df = nodes[label]
        if c.kind == "unique":
            bad = df.where(" and ".join(f"`{p}` is not null" for p in c.properties)).groupBy(*c.properties).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
        elif c.kind == "exists":
            bad = df.where(" or ".join(f"`{p}` is null" for p in c.properties)).agg(F.count("*").alias("rows"))
        else:
            continue
        parts.append(bad.select(F.lit(label).alias("label"), F.lit(c.kind).alias("kind"), F.lit(",".join(c.properties)).alias("properties"), "rows"))
    out = spark.createDataFrame([], "label string, kind string, properties string, rows long")
    for p in parts:
        out = out.union(p)
    return out.where("rows > 0")
