"""Graph models: nodes, edges, indexes, constraints and enums, as documents and under edits."""

from __future__ import annotations

import hashlib
import json
from copy import deepcopy
from dataclasses import asdict, dataclass, field

from ctxweave.plans.catalogue import Catalogue, property_types, relation_name, title_label


@dataclass
class Property:
    name: str
    type: str = "String"
    source: str | None = None  # the column it comes from, if it bears another name


@dataclass
class Node:
    labels: list[str]
    properties: list[Property]
    key: list[str]
    source: str | None = None

    @property
    def label(self) -> str:
        return self.labels[0]


@dataclass
class Edge:
    type: str
    start: list[str]
    end: list[str]
    properties: list[Property] = field(default_factory=list)
    source: str | None = None
    kind: str = "one_to_many"
    columns: list[str] = field(default_factory=list)  # of the source table: the end's key; through a join table the start's, then the end's
    targets: list[str] = field(default_factory=list)  # what the columns refer to, if not the ends' keys
    width: int = 1  # how many of a join table's columns belong to the start

    @property
    def key(self) -> tuple[str, str, str]:
        """Distinguishes several foreign keys of one table."""
        return (self.source or "", self.type, ",".join(self.columns))


@dataclass
class Index:
    kind: str  # label, label_property, text, vector
    labels: list[str]
    properties: list[str] = field(default_factory=list)


@dataclass
class Constraint:
    kind: str  # unique, exists, data_type
    labels: list[str]
    properties: list[str]
    type: str | None = None


@dataclass
class Enum:
    name: str
    values: list[str]


@dataclass
class GraphModel:
    nodes: list[Node] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    enums: list[Enum] = field(default_factory=list)

    def node(self, label: str) -> Node:
        found = next((n for n in self.nodes if label in n.labels), None)
        if found is None:
            raise KeyError(f"no node has the label {label}")
        return found

    def edge(self, kind: str) -> Edge:
        found = next((e for e in self.edges if e.type == kind), None)
        if found is None:
            raise KeyError(f"no edge has the type {kind}")
        return found

    def to_document(self) -> dict:
        return asdict(self)

    @classmethod
    def from_document(cls, d: dict) -> GraphModel:
        props = lambda xs: [Property(**p) for p in xs]
        return cls(
            [Node(**{**n, "properties": props(n["properties"])}) for n in d.get("nodes", [])],
            [Edge(**{**e, "properties": props(e["properties"])}) for e in d.get("edges", [])],
            [Index(**x) for x in d.get("indexes", [])],
            [Constraint(**x) for x in d.get("constraints", [])],
            [Enum(**x) for x in d.get("enums", [])],
        )

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_document(), sort_keys=True).encode()).hexdigest()

    def ddl(self) -> list[str]:
        """Statements for its indexes and constraints."""
        out = []
        for i in self.indexes:
            name = ":".join(i.labels)
            out.append(f"CREATE INDEX ON :{name}({', '.join(i.properties)});" if i.properties else f"CREATE INDEX ON :{name};")
        for c in self.constraints:
            name = ":".join(c.labels)
            if c.kind == "unique":
                out.append(f"CREATE CONSTRAINT ON (n:{name}) ASSERT {', '.join('n.' + p for p in c.properties)} IS UNIQUE;")
            elif c.kind == "exists":
                out += [f"CREATE CONSTRAINT ON (n:{name}) ASSERT EXISTS (n.{p});" for p in c.properties]
            elif c.kind == "data_type":
                out += [f"CREATE CONSTRAINT ON (n:{name}) ASSERT n.{p} IS TYPED {(c.type or 'STRING').upper()};" for p in c.properties]
        return out


def model_tables(catalogue: Catalogue) -> GraphModel:
    """The model that follows from the tables: a node for each entity, an edge for each relationship.

    Foreign-key columns become edges and no properties. A key of several columns stays
    whole. A table may end up without its key as a property if that is a foreign key
    too; then the key columns are kept.
    """
    m = GraphModel()
    for t in catalogue.entities():
        types = property_types(t)
        key = t.primary_keys or ["id"]
        props = [Property(c.name, types[c.name]) for c in t.columns if t.key_code(c.name) != "MUL" or c.name in key]
        label = title_label(t.name)
        m.nodes.append(Node([label], props, key, t.name))
        indexed = []
        for c in t.columns:
            if t.key_code(c.name):
                indexed.append([c.name])
        for columns in [*indexed, *t.indexes]:
            if not any(i.labels == [label] and i.properties == columns for i in m.indexes):
                m.indexes.append(Index("label_property", [label], list(columns)))
        if t.primary_keys:
            m.constraints.append(Constraint("unique", [label], list(t.primary_keys)))
        m.constraints += [Constraint("unique", [label], [u]) for u in sorted(t.unique)]
    for r in catalogue.relationships():
        if {r.start, r.end} <= {t.name for t in catalogue.entities()}:
            types = property_types(catalogue.tables[r.table]) if r.table else {}
            m.edges.append(
                Edge(relation_name(r), [title_label(r.start)], [title_label(r.end)], [Property(x, types[x]) for x in r.extra], r.table or r.start, r.kind, list(r.columns), list(r.targets), r.width)
            )
    return m


def join_edge(catalogue: Catalogue, table: str, start_column: str, end_column: str, kind: str | None = None) -> Edge:
    """A many-to-many edge through a table that isn't one by its shape, such as order lines."""
    t = catalogue.tables[table]
    by = {f.column: f for f in t.foreign_keys}
    types = property_types(t)
    extra = [Property(c.name, types[c.name]) for c in t.columns if c.name not in by]
    return Edge(kind or table.upper(), [title_label(by[start_column].table)], [title_label(by[end_column].table)], extra, table, "many_to_many", [start_column, end_column])


# --- edits: each takes a model and returns another ---


def _edit(f):
    def run(model: GraphModel, *args, **kwargs) -> GraphModel:
        m = deepcopy(model)
        f(m, *args, **kwargs)
        return m

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _swap(labels: list[str], old: str, new: str) -> list[str]:
    return [new if x == old else x for x in labels]


@_edit
def change_node_label(m: GraphModel, old: str, new: str) -> None:
    m.node(old)
    for n in m.nodes:
        n.labels = _swap(n.labels, old, new)
    for e in m.edges:
        e.start, e.end = _swap(e.start, old, new), _swap(e.end, old, new)
    for x in [*m.indexes, *m.constraints]:
        x.labels = _swap(x.labels, old, new)


@_edit
def rename_property(m: GraphModel, label: str, old: str, new: str) -> None:
    """The property gets a new name; its source column stays what it was."""
    n = m.node(label)
    for p in n.properties:
        if p.name == old:
            p.name, p.source = new, p.source or old
    n.key = _swap(n.key, old, new)
    for x in [*m.indexes, *m.constraints]:
        if label in x.labels:
            x.properties = _swap(x.properties, old, new)


@_edit
def drop_property(m: GraphModel, label: str, name: str) -> None:
    n = m.node(label)
    if name in n.key:
        raise ValueError(f"{name} is the key of {label}")
    n.properties = [p for p in n.properties if p.name != name]
    m.indexes = [i for i in m.indexes if not (label in i.labels and name in i.properties)]
    m.constraints = [c for c in m.constraints if not (label in c.labels and name in c.properties)]


@_edit
def add_property(m: GraphModel, label: str, name: str, type: str = "String", source: str | None = None) -> None:  # noqa: A002
    n = m.node(label)
    if all(p.name != name for p in n.properties):
        n.properties.append(Property(name, type, source))


@_edit
def change_node_key(m: GraphModel, label: str, columns: list[str]) -> None:
    """Bare column names; a table prefix is taken off."""
    m.node(label).key = [c.rpartition(".")[2] for c in columns]


@_edit
def add_node(m: GraphModel, labels: list[str], properties: list[Property], key: list[str], source: str | None = None) -> None:
    if any(labels[0] in n.labels for n in m.nodes):
        raise ValueError(f"{labels[0]} exists")
    m.nodes.append(Node(labels, properties, key, source))


@_edit
def drop_node(m: GraphModel, label: str) -> None:
    """With its edges, indexes and constraints."""
    m.node(label)
    m.nodes = [n for n in m.nodes if label not in n.labels]
    m.edges = [e for e in m.edges if label not in e.start + e.end]
    m.indexes = [i for i in m.indexes if label not in i.labels]
    m.constraints = [c for c in m.constraints if label not in c.labels]


@_edit
def rename_edge(m: GraphModel, old: str, new: str) -> None:
    m.edge(old)
    for e in m.edges:
        if e.type == old:
            e.type = new


@_edit
def drop_edge(m: GraphModel, kind: str) -> None:
    m.edge(kind)
    m.edges = [e for e in m.edges if e.type != kind]


@_edit
def add_edge(m: GraphModel, kind: str, start: str, end: str, properties: list[Property] | None = None, source: str | None = None, columns: list[str] | None = None, how: str = "one_to_many") -> None:
    m.edges.append(Edge(kind, m.node(start).labels, m.node(end).labels, properties or [], source, how, columns or []))


@_edit
def add_edge_property(m: GraphModel, kind: str, name: str, type: str = "String") -> None:  # noqa: A002
    e = m.edge(kind)
    if all(p.name != name for p in e.properties):
        e.properties.append(Property(name, type))


@_edit
def drop_edge_property(m: GraphModel, kind: str, name: str) -> None:
    e = m.edge(kind)
    e.properties = [p for p in e.properties if p.name != name]


@_edit
def add_index(m: GraphModel, label: str, properties: list[str] = (), kind: str = "label_property") -> None:
    new = Index(kind if properties else "label", [label], list(properties))
    if new not in m.indexes:
        m.indexes.append(new)


@_edit
def drop_index(m: GraphModel, label: str, properties: list[str] = ()) -> None:
    m.indexes = [i for i in m.indexes if not (label in i.labels and i.properties == list(properties))]


@_edit
def add_constraint(m: GraphModel, label: str, properties: list[str], kind: str = "unique", type: str | None = None) -> None:  # noqa: A002
    new = Constraint(kind, [label], list(properties), type)
    if new not in m.constraints:
        m.constraints.append(new)


@_edit
def drop_constraint(m: GraphModel, label: str, properties: list[str], kind: str = "unique") -> None:
    m.constraints = [c for c in m.constraints if not (label in c.labels and c.properties == list(properties) and c.kind == kind)]


@_edit
def change_mapping(m: GraphModel, kind: str, source: str, columns: list[str], how: str | None = None) -> None:
    e = m.edge(kind)
    e.source, e.columns, e.kind, e.targets, e.width = source, [c.rpartition(".")[2] for c in columns], how or e.kind, [], 1


EDITS = {f.__name__: f for f in (change_node_label, rename_property, drop_property, add_property, change_node_key, add_node, drop_node, rename_edge, drop_edge, add_edge, add_edge_property, drop_edge_property, add_index, drop_index, add_constraint, drop_constraint, change_mapping)}


def apply_edits(model: GraphModel, edits: list[dict]) -> tuple[GraphModel, list[str]]:
    """(model, history) after edits {'op': name, ...arguments}, in order."""
    history = []
    for e in edits:
        args = {k: v for k, v in e.items() if k != "op"}
        if e.get("op") not in EDITS:
            raise ValueError(f"no such edit: {e.get('op')}")
        model = EDITS[e["op"]](model, **args)
        history.append(f"{e['op']}: " + ", ".join(f"{k}={v}" for k, v in args.items()))
    return model, history


def merge_models(parts: list[GraphModel]) -> GraphModel:
    """One model of several, each element once."""
    out = GraphModel()
    for p in deepcopy(parts):
        out.nodes += [n for n in p.nodes if not any(sorted(n.labels) == sorted(x.labels) for x in out.nodes)]
        out.edges += [e for e in p.edges if all(e.key != x.key for x in out.edges)]
        for name in ("indexes", "constraints", "enums"):
            mine = getattr(out, name)
            mine += [x for x in getattr(p, name) if x not in mine]
    return out


def match_tables(labels: list[str], tables: list[str]) -> dict[str, str | None]:
    """Which table a proposed label means: by equal letters, then singular against plural, then one within the other."""
    bare = lambda s: "".join(c for c in s.lower() if c.isalnum())
    single = lambda s: s[:-3] + "y" if s.endswith("ies") else s[:-1] if s.endswith("s") and not s.endswith("ss") else s
    out = {}
    for label in labels:
        x = bare(label)
        out[label] = next((t for test in (lambda t: bare(t) == x, lambda t: single(bare(t)) == single(x), lambda t: x in bare(t) or bare(t) in x) for t in sorted(tables) if test(t)), None)
    return out


def changes(old: GraphModel | None, new: GraphModel) -> dict[str, list[str]]:
    """Reasons, by source table, why a table's part of the model differs; tables that don't aren't listed."""
    out: dict[str, list[str]] = {}
    before = {n.source: n for n in old.nodes} if old else {}
    for n in new.nodes:
        was, reasons = before.pop(n.source, None), []
        if was is None:
            reasons.append("new")
        else:
            added, gone = {p.name for p in n.properties} - {p.name for p in was.properties}, {p.name for p in was.properties} - {p.name for p in n.properties}
            reasons += [f"added {x}" for x in sorted(added)] + [f"removed {x}" for x in sorted(gone)]
            reasons += ["labels changed"] if sorted(n.labels) != sorted(was.labels) else []
            reasons += ["key changed"] if n.key != was.key else []
            types = {p.name: p.type for p in was.properties}
            reasons += [f"type of {p.name} changed" for p in n.properties if p.name in types and types[p.name] != p.type]
        if reasons:
            out[n.source] = reasons
    out |= {t: ["dropped"] for t in before}
    old_edges = {e.key: e for e in old.edges} if old else {}
    for e in new.edges:
        if old_edges.get(e.key) != e:
            out.setdefault(e.source, []).append(f"edge {e.type} " + ("new" if e.key not in old_edges else "changed"))
    return out


def review(old: GraphModel | None, new: GraphModel, accept) -> GraphModel:
    """The old model with the changed tables' parts that `accept(table, reasons)` takes; unchanged tables aren't asked about."""
    why = changes(old, new)
    taken = {t for t, reasons in why.items() if accept(t, reasons)}
    base = deepcopy(old) if old else GraphModel()
    side = lambda m, t: GraphModel([n for n in m.nodes if n.source == t], [e for e in m.edges if e.source == t], *[[x for x in xs if any(x.labels == n.labels for n in m.nodes if n.source == t)] for xs in (m.indexes, m.constraints)])
    for t in taken:
        mine = side(base, t)
        base.nodes = [n for n in base.nodes if n.source != t]
        base.edges = [e for e in base.edges if e.source != t]
        base.indexes = [i for i in base.indexes if i not in mine.indexes]
        base.constraints = [c for c in base.constraints if c not in mine.constraints]
    return merge_models([base, *[side(new, t) for t in sorted(taken, key=str)]])
