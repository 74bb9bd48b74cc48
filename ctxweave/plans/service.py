"""Running query texts: parameters, a read-only gate, namespaces, tools and the question chain."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


class NotReadOnly(PermissionError):
    """A statement that isn't a query."""


#: nodes of parsed plans that queries consist of; a statement with any other isn't read-only
QUERY_NODES = frozenset(
    "Aggregate AsOfJoin Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project Range Repartition RepartitionByExpression "
    "Sample Sort SubqueryAlias Tail Transpose Union UnionLoop UnionLoopRef Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases "
    "UnresolvedTableValuedFunction UnresolvedTranspose UnresolvedWith UnresolvedOrdinal Window WithWindowDefinition RelationTimeTravel ResolvedInlineTable".split()
)
#: functions that call whatever they are told to
CALLS_OUT = frozenset({"reflect", "java_method", "try_reflect"})


def _list(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def nodes_of(plan) -> Iterator:
    """Every node of a parsed plan: children, common table expressions and subqueries in expressions."""
    work = [plan]
    while work:
        p = work.pop()
        yield p
        work += _list(p.children())
        work += _list(p.innerChildren())
        work += _list(p.subqueries())
        if _kind(p) == "InsertIntoStatement":
            work.append(p.table())
        if _kind(p) == "RelationTimeTravel":
            work.append(p.relation())


def _kind(p) -> str:
    return p.getClass().getSimpleName().rstrip("$")


def _called(plan) -> set[str]:
    """Names of the functions in a node's expressions."""
    found, work = set(), _list(plan.expressions())
    while work:
        e = work.pop()
        if _kind(e) == "UnresolvedFunction":
            found.add(_list(e.nameParts())[-1].lower())
        work += _list(e.children())
    return found


def parsed(spark: SparkSession, text: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(text)


def is_read_only(spark: SparkSession, text: str) -> bool:
    """By the parsed plan and not by words in the text, so keywords in literals and names do no harm.

    All nodes must be of QUERY_NODES, wherever they stand, so an INSERT under common
    table expressions or several of them on one source are found; functions that call
    arbitrary code make a statement no query.
    """
    return all(_kind(p) in QUERY_NODES and not CALLS_OUT & _called(p) for p in nodes_of(parsed(spark, text)))


def databases_of(spark: SparkSession, text: str) -> tuple[set[str], bool]:
    """(databases that the statement names, whether it names something else that can't be told)."""
    found, other = set(), False
    for p in nodes_of(parsed(spark, text)):
        kind = _kind(p)
        if kind == "UnresolvedRelation":
            parts = _list(p.multipartIdentifier())
        elif kind in ("UnresolvedIdentifier", "UnresolvedTable", "UnresolvedTableOrView"):
            parts = _list(p.nameParts() if kind == "UnresolvedIdentifier" else p.multipartIdentifier())
        else:
            other |= kind not in QUERY_NODES | {"InsertIntoStatement", "CreateTable", "CreateTableAsSelect", "DropTable"}
            continue
        if len(parts) == 3 and parts[0].lower() == "spark_catalog":
            parts = parts[1:]
        other |= len(parts) > 2
        if len(parts) == 2:
            found.add(parts[0])
    return found, other


_CURRENT = Lock()  # a session has one current database, and statements are analysed in it


class GraphSession:
    """Runs query texts in a namespace (a Spark database).

    With `allowed`, a text may name no database outside of it, neither as the current
    one nor in a qualified name. Names are resolved before another text gets its turn,
    so sessions and threads don't meet in each other's namespace.
    """

    def __init__(self, spark: SparkSession, read_only: bool = True, allowed: set[str] | None = None, default: str = "default"):
        self.spark, self.read_only, self.allowed, self.current = spark, read_only, allowed, default
        self._pool = ThreadPoolExecutor(4)

    def databases(self) -> list[str]:
        """Namespaces that exist and are allowed."""
        names = {d.name for d in self.spark.catalog.listDatabases()}
        return sorted(names if self.allowed is None else names & self.allowed)

    def use(self, name: str) -> None:
        if name not in self.databases():
            raise LookupError(f"database {name} isn't available")
        self.current = name

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        if self.read_only and not is_read_only(self.spark, text):
            raise NotReadOnly("only queries are allowed here")
        if self.allowed is not None:
            named, other = databases_of(self.spark, text)
            if other or {self.current, *named} - self.allowed:
                raise LookupError("the statement names a database that isn't available")
        with _CURRENT:
            before = self.spark.catalog.currentDatabase()
            self.spark.catalog.setCurrentDatabase(self.current)
            try:
                df = self.spark.sql(text, args=args)
                df._jdf.queryExecution().optimizedPlan()  # settles current_database() too
                return df
            finally:
                self.spark.catalog.setCurrentDatabase(before)

    def sql_async(self, text: str, args: dict | list | None = None) -> Future:
        """The rows, in the future."""
        return self._pool.submit(lambda: self.sql(text, args).collect())

    def connected(self) -> bool:
        return self.spark.range(1).count() == 1


@dataclass
class Toolbox:
    """Tools by unique name. A tool that fails returns an error row."""

    tools: dict[str, Callable[..., object]] = field(default_factory=dict)

    def add(self, name: str, f: Callable[..., object]) -> Toolbox:
        if name in self.tools:
            raise ValueError(f"a tool is named {name} already")
        self.tools[name] = f
        return self

    def names(self) -> list[str]:
        return sorted(self.tools)

    def get(self, name: str) -> Callable[..., object]:
        if name not in self.tools:
            raise KeyError(f"no tool is named {name}")
        return self.tools[name]

    def call(self, name: str, **args: object) -> list[dict]:
        try:
            out = self.get(name)(**args)
        except Exception as e:  # noqa: BLE001  callers get errors as rows
            return [{"error": f"{type(e).__name__}: {e}"}]
        if isinstance(out, DataFrame):
            return [r.asDict(recursive=True) for r in out.collect()]
        return out if isinstance(out, list) else [{"result": out}]


@dataclass
class QuestionChain:
    """Question to query to rows to answer; the two language steps are given as functions."""

    session: GraphSession
    write_query: Callable[[str, str], str]
    write_answer: Callable[[str, list[dict]], str]
    schema: str = ""
    top_k: int = 10
    return_direct: bool = False

    def ask(self, question: str) -> dict:
        query = extract_query(self.write_query(question, self.schema))
        rows = [r.asDict(recursive=True) for r in self.session.sql(query).limit(self.top_k).collect()]
        return {"query": question, "steps": [{"query": query}, {"context": rows}], "result": rows if self.return_direct else self.write_answer(question, rows)}


def extract_query(text: str) -> str:
    """What stands in the first fenced block, without a language tag; else the text."""
    parts = text.split("```")
    if len(parts) < 3:
        return text.strip()
    head, _, rest = parts[1].partition("\n")
    return (rest if rest and head.strip().isalpha() else parts[1]).strip()
