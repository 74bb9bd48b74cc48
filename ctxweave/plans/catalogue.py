"""Relational catalogue: tables with keys, their kinds, and the relationships between them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ctxweave.functions.scalars import graph_type

AUXILIARY = {"id", "created_at", "updated_at", "created_on", "updated_on", "created_by", "updated_by", "deleted_at", "timestamp", "modified_at", "version", "status"}


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False
    auto: bool = False
    precision: int | None = None
    scale: int | None = None


@dataclass
class ForeignKey:
    column: str
    table: str
    target: str
    constraint: str | None = None


@dataclass
class Reference:
    table: str
    columns: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    constraint: str | None = None


@dataclass
class Table:
    name: str
    columns: list[Column]
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    indexes: list[list[str]] = field(default_factory=list)
    rows: int | None = None
    view: bool = False
    unique: set[str] = field(default_factory=set)

    @property
    def primary_keys(self) -> list[str]:
        return [c.name for c in self.columns if c.primary]

    @property
    def kind(self) -> str:
        """view, join or entity."""
        return "view" if self.view else "join" if is_join_table(self) else "entity"

    @property
    def references(self) -> list[Reference]:
        """Foreign keys; columns of one constraint to one table are one key of several columns."""
        out: dict[object, Reference] = {}
        for k, f in enumerate(self.foreign_keys):
            r = out.setdefault((f.constraint, f.table) if f.constraint else k, Reference(f.table, constraint=f.constraint))
            r.columns += (f.column,)
            r.targets += (f.target,)
        return list(out.values())

    def key_code(self, column: str) -> str:
        """PRI, UNI, MUL or nothing, as database clients print it."""
        if column in self.primary_keys:
            return "PRI"
        if column in self.unique:
            return "UNI"
        return "MUL" if any(f.column == column for f in self.foreign_keys) else ""


def is_join_table(t: Table) -> bool:
    """At least two foreign keys, and they are half of the columns or all that isn't auxiliary."""
    keys = {f.column for f in t.foreign_keys}
    if len(t.references) < 2:
        return False
    return len(keys) / len(t.columns) >= 0.5 or not [c for c in t.columns if c.name not in keys and c.name.lower() not in AUXILIARY]


@dataclass
class Relationship:
    kind: str  # one_to_many or many_to_many
    start: str
    end: str
    start_column: str
    end_column: str
    table: str | None = None
    columns: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()
    constraint: str | None = None
    targets: tuple[str, ...] = ()  # what the columns refer to
    width: int = 1  # how many of the columns belong to the start


class Catalogue:
    """Tables by name, with Spark's schemas and declared keys."""

    def __init__(self, tables: list[Table]):
        self.tables = {t.name: t for t in tables}

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame], primary: dict[str, list[str]], foreign: dict[str, list[tuple[str, str, str]]], count: bool = False) -> Catalogue:
        """foreign: table -> (column, other table, its column). Row counts are taken only if asked for."""
        return cls(
            [
                Table(name, [Column(f.name, f.dataType.simpleString(), f.nullable, f.name in primary.get(name, [])) for f in df.schema.fields], [ForeignKey(*fk) for fk in foreign.get(name, [])], rows=df.count() if count else None)
                for name, df in frames.items()
            ]
        )

    @classmethod
    def from_spark(cls, spark: SparkSession, database: str | None = None, primary: dict[str, list[str]] | None = None, foreign: dict[str, list[tuple[str, str, str]]] | None = None) -> Catalogue:
        """What the session's catalogue lists; Parquet has no keys, so those are given."""
        found = []
        for t in spark.catalog.listTables(database) if database else spark.catalog.listTables():
            columns = spark.catalog.listColumns(t.name, database) if database else spark.catalog.listColumns(t.name)
            found.append(Table(t.name, [Column(c.name, c.dataType, c.nullable, c.name in (primary or {}).get(t.name, [])) for c in columns], [ForeignKey(*fk) for fk in (foreign or {}).get(t.name, [])], view=t.tableType == "VIEW"))
        return cls(found)

    @classmethod
    def from_information_schema(cls, columns: DataFrame, tables: DataFrame, keys: DataFrame, counts: dict[str, int] | None = None) -> Catalogue:
        """What a live database's information schema lists, read by JDBC like any other table.

        columns: table_name, column_name, data_type, is_nullable, ordinal_position;
        tables: table_name, table_type; keys: table_name, column_name, constraint_name,
        constraint_type, referenced_table, referenced_column, in the order of the key's
        columns. They have a row a column, so they are collected; the tables themselves
        are not read.
        """
        held = keys.collect()
        of = lambda t, kind: [k for k in held if k["table_name"] == t and k["constraint_type"] == kind]
        found = []
        listed = sorted(columns.collect(), key=lambda r: (r["table_name"], r["ordinal_position"]))
        for t in sorted(tables.collect(), key=lambda r: r["table_name"]):
            name = t["table_name"]
            primary = {k["column_name"] for k in of(name, "PRIMARY KEY")}
            cols = [Column(r["column_name"], r["data_type"], r["is_nullable"] == "YES", r["column_name"] in primary) for r in listed if r["table_name"] == name]
            foreign = [ForeignKey(k["column_name"], k["referenced_table"], k["referenced_column"], k["constraint_name"]) for k in of(name, "FOREIGN KEY")]
            found.append(Table(name, cols, foreign, rows=(counts or {}).get(name), view="VIEW" in t["table_type"], unique={k["column_name"] for k in of(name, "UNIQUE")}))
        return cls(found)

    def relationships(self) -> list[Relationship]:
        """One-to-many for each foreign key of an entity, many-to-many for each join table's first two. Keys of several columns stay whole."""
        out = []
        for t in self.tables.values():
            if t.kind == "entity":
                out += [Relationship("one_to_many", t.name, f.table, f.columns[0], f.targets[0], columns=f.columns, constraint=f.constraint, targets=f.targets) for f in t.references]
            elif t.kind == "join":
                a, b = t.references[:2]
                keys = {f.column for f in t.foreign_keys}
                out.append(Relationship("many_to_many", a.table, b.table, a.targets[0], b.targets[0], t.name, a.columns + b.columns, tuple(c.name for c in t.columns if c.name not in keys), targets=a.targets + b.targets, width=len(a.columns)))
        return out

    def entities(self) -> list[Table]:
        return [t for t in self.tables.values() if t.kind == "entity"]

    def expected_nodes(self) -> int:
        return sum(t.rows or 0 for t in self.entities())


def pascal(name: str) -> str:
    """order_items -> OrderItems."""
    return "".join(p[:1].upper() + p[1:].lower() for p in re.split(r"[_\s-]+", name) if p)


def title_label(name: str) -> str:
    """order_items -> Order_Items."""
    return name.title()


def relation_name(r: Relationship) -> str:
    """The join table's name; else the constraint's name before _fk; else A_TO_B."""
    if r.kind == "many_to_many":
        return (r.table or "").upper()
    if r.constraint and "_fk" in r.constraint.lower():
        return r.constraint[: r.constraint.lower().index("_fk")].upper()
    return f"{r.start}_TO_{r.end}".upper()


def sanitised(name: str) -> str:
    """A label of letters, digits and underscores that doesn't start with a digit."""
    s = re.sub(r"[^A-Za-z0-9_]", "_", name)
    return f"_{s}" if s[:1].isdigit() else s or "_"


def is_metadata_column(name: str) -> bool:
    return name.lower() in AUXILIARY - {"id", "status"}


def looks_like_key(name: str) -> bool:
    return name.lower().endswith("_id") and len(name) > 3


def property_types(t: Table) -> dict[str, str]:
    return {c.name: graph_type(c.type) for c in t.columns}
