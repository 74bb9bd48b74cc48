"""More registered queries: modelling, planning, schema discovery, services, events and stores, each beside the SQL that it equals.

What a plan says of the test tables is told as rows. Where it follows from the tables'
columns, the SQL reads these; where it is a rule applied to given names, the SQL spells
out what the rule gives.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxweave.functions import scalars as S
from ctxweave.operators import analytics, chunks, entities, pattern, skills, stores, text_search, vector, write
from ctxweave.plans import catalogue as C
from ctxweave.plans import ingest, schema, service
from ctxweave.plans import model as M
from ctxweave.queries import ENTITIES, FAILED, FOREIGN, PRIMARY, SQL, frames, messages, query, star_model, tool_calls
from ctxweave.runtime import table
from ctxweave.streaming import events

TABLES = (*ENTITIES, "lineitem")


def rows(spark: SparkSession, data: list[tuple], kind: str) -> DataFrame:
    return spark.createDataFrame(data, kind)


def values(data: list[tuple], names: str) -> str:
    """A SELECT of given rows."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in data)}) t({names})"


def described(tables: tuple[str, ...] = TABLES) -> str:
    """(tab, col) of the tables' own columns."""
    return " UNION ALL ".join(f"SELECT '{t}' AS tab, column_name AS col FROM (DESCRIBE {t})" for t in tables)


def listed(xs: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


PRI = " OR ".join(f"(tab = '{t}' AND col IN {listed(k)})" for t, k in PRIMARY.items())
MUL = " OR ".join(f"(tab = '{t}' AND col IN {listed([f[0] for f in fs])})" for t, fs in FOREIGN.items())

# --- catalogue and model ---


@query("q77_table_kinds", f"SELECT tab AS name, CASE WHEN tab = 'order_part' THEN 'join' ELSE 'entity' END AS kind, count(*) AS n_columns FROM ({described()} UNION ALL SELECT 'order_part', unnest(['l_orderkey', 'l_partkey', 'created_at'])) GROUP BY 1")
def q77(spark, d):
    f = frames(spark, d)
    f["order_part"] = f["lineitem"].select("l_orderkey", "l_partkey", F.current_date().alias("created_at"))
    c = C.Catalogue.from_frames(f, PRIMARY, FOREIGN | {"order_part": FOREIGN["lineitem"][:2]})
    return rows(spark, [(t.name, t.kind, len(t.columns)) for t in c.tables.values()], "name string, kind string, n_columns long")


@query("q78_relationships", values([("one_to_many", t, f[1], f[0], f[2], f"{t}_TO_{f[1]}".upper()) for t, fs in FOREIGN.items() for f in fs], 'kind, "start", "end", start_column, end_column, name'))
def q78(spark, d):
    _, c, _ = star_model(spark, d)
    return rows(spark, [(r.kind, r.start, r.end, r.start_column, r.end_column, C.relation_name(r)) for r in c.relationships()], "kind string, start string, end string, start_column string, end_column string, name string")


@query("q79_key_codes", f"SELECT tab AS table_name, col AS column_name, CASE WHEN {PRI} THEN 'PRI' WHEN {MUL} THEN 'MUL' ELSE '' END AS code FROM ({described()})")
def q79(spark, d):
    _, c, _ = star_model(spark, d)
    return rows(spark, [(t.name, x.name, t.key_code(x.name)) for t in c.tables.values() for x in t.columns], "table_name string, column_name string, code string")


@query("q80_model_properties", f"SELECT upper(tab[1]) || tab[2:] AS label, col AS property, ({PRI}) AS is_key FROM ({described()}) WHERE ({PRI}) OR NOT ({MUL})")
def q80(spark, d):
    m, _, _ = star_model(spark, d)
    m = M.GraphModel.from_document(json.loads(json.dumps(m.to_document())))  # and back
    return rows(spark, [(n.label, p.name, p.name in n.key) for n in m.nodes for p in n.properties], "label string, property string, is_key boolean")


@query("q81_model_edges", values([(f"{t}_TO_{f[1]}".upper(), t.title(), f[1].title(), t, f[0], f[2]) for t, fs in FOREIGN.items() for f in fs], 'type, "start", "end", source, fk, refers_to'))
def q81(spark, d):
    m, _, _ = star_model(spark, d)
    return rows(spark, [(e.type, e.start[0], e.end[0], e.source, ",".join(e.columns), ",".join(e.targets)) for e in m.edges], "type string, start string, end string, source string, fk string, refers_to string")


@query("q82_model_ddl", f"SELECT 'CREATE INDEX ON :' || upper(tab[1]) || tab[2:] || '(' || col || ');' AS statement FROM ({described()}) WHERE ({PRI}) OR ({MUL}) UNION ALL " + values([(f"CREATE CONSTRAINT ON (n:{t.title()}) ASSERT {', '.join('n.' + k for k in ks)} IS UNIQUE;",) for t, ks in PRIMARY.items()], "statement"))
def q82(spark, d):
    m, _, _ = star_model(spark, d)
    return rows(spark, [(x,) for x in m.ddl()], "statement string")


EDITS = [{"op": "change_node_label", "old": "Part", "new": "Product"}, {"op": "rename_property", "label": "Product", "old": "p_name", "new": "title"}, {"op": "drop_node", "label": "Region"}, {"op": "rename_edge", "old": "ORDERS_TO_CUSTOMER", "new": "PLACED"}]


@query("q83_edits_cascade", f"""SELECT CASE WHEN tab = 'part' THEN 'Product' ELSE upper(tab[1]) || tab[2:] END AS a, CASE WHEN col = 'p_name' THEN 'title' ELSE col END AS b FROM ({described()}) WHERE tab <> 'region' AND (({PRI}) OR NOT ({MUL}))
    UNION ALL {values([('PLACED' if t == 'orders' else f'{t}_TO_{f[1]}'.upper(), 'Product' if f[1] == 'part' else f[1].title()) for t, fs in FOREIGN.items() for f in fs if f[1] != 'region'], 'a, b')}""")
def q83(spark, d):
    m, history = M.apply_edits(star_model(spark, d)[0], [{k: v for k, v in e.items()} for e in EDITS])
    assert len(history) == len(EDITS)
    return rows(spark, [(n.label, p.name) for n in m.nodes for p in n.properties] + [(e.type, e.end[0]) for e in m.edges], "a string, b string")


@query("q84_changes_and_review", values([("customer", "added note"), ("customer", "removed c_name"), ("part", "dropped"), ("taken", "Customer"), ("kept", "Part")], "what, detail"))
def q84(spark, d):
    old, _, _ = star_model(spark, d)
    new = M.drop_node(M.add_property(M.drop_property(old, "Customer", "c_name"), "Customer", "note"), "Part")
    why = {t: [r for r in rs if not r.startswith("edge")] for t, rs in M.changes(old, new).items()}
    left = M.review(old, new, lambda t, _: t == "customer")
    told = [("taken", n.label) for n in left.nodes if any(p.name == "note" for p in n.properties)] + [("kept", n.label) for n in left.nodes if n.label == "Part"]
    return rows(spark, [(t, r) for t, rs in why.items() for r in rs] + told, "what string, detail string")


@query("q85_match_tables", values([("Customer", "customer"), ("Orders", "orders"), ("Order", "orders"), ("Nations", "nation"), ("LineItem", "lineitem"), ("Planet", None)], "label, tab"))
def q85(spark, d):
    found = M.match_tables(["Customer", "Orders", "Order", "Nations", "LineItem", "Planet"], list(frames(spark, d)))
    return rows(spark, list(found.items()), "label string, tab string")


NAMES = ["order_items", "customer_id", "Created_At", "status", "2nd-name", "id", "a b", "_id", "UPDATED_BY"]


@query("q86_names", """SELECT n AS name, array_to_string(list_transform(list_filter(regexp_split_to_array(n, '[_\\s-]+'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), '') AS pascal,
    CASE WHEN regexp_matches(regexp_replace(n, '[^A-Za-z0-9_]', '_', 'g'), '^[0-9]') THEN '_' ELSE '' END || regexp_replace(n, '[^A-Za-z0-9_]', '_', 'g') AS sanitised,
    lower(n) LIKE '%\\_id' ESCAPE '\\' AND length(n) > 3 AS looks_like_key, lower(n) IN ('created_at', 'updated_at', 'created_on', 'updated_on', 'created_by', 'updated_by', 'deleted_at', 'timestamp', 'modified_at', 'version') AS is_metadata
    FROM (SELECT unnest([""" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS n)")
def q86(spark, d):
    return rows(spark, [(n, C.pascal(n), C.sanitised(n), C.looks_like_key(n), C.is_metadata_column(n)) for n in NAMES], "name string, pascal string, sanitised string, looks_like_key boolean, is_metadata boolean")


# --- planning and checks ---


@query("q87_plan_reasons", values([("node", "orders", "rows added"), ("node", "lineitem", "count unknown")], "kind, name, reason") + " UNION ALL " + values([("edge", f"{t}_TO_{f[1]}".upper(), "an end is loaded") for t, fs in FOREIGN.items() for f in fs if t in ("orders", "lineitem")], "kind, name, reason"))
def q87(spark, d):
    m, _, f = star_model(spark, d)
    counts = {r["name"].lower(): r["n"] for r in pattern.PropertyGraph({t.title(): (f[t], PRIMARY[t][0]) for t in ENTITIES}).counts().collect()}
    before = json.loads(json.dumps(ingest.summary(m, {**counts, "orders": counts["orders"] - 1}, {"host": "local"})))
    nodes, edges = ingest.plan(before, m, counts)
    return rows(spark, [("node", k, v) for k, v in nodes.items()] + [("edge", k[1], v) for k, v in edges.items()], "kind string, name string, reason string")


@query("q88_model_check", values([("CRITICAL", "table part has no node"), ("WARNING", "Customer lacks c_name"), ("CRITICAL", "edge LINEITEM_TO_PART has no node at an end"), ("INFO", "the key of Lineitem isn't indexed")], "severity, what"))
def q88(spark, d):
    m, c, _ = star_model(spark, d)
    m = M.drop_property(m, "Customer", "c_name")
    m.nodes = [n for n in m.nodes if n.label != "Part"]
    issues, _ = ingest.check_model(m, c)
    return rows(spark, [(i.severity, i.what) for i in issues], "severity string, what string")


KINDS = ["Integer", "Float", "String", "Boolean", "Date", "Map"]


@query("q89_types_compatible", """SELECT a AS declared, b AS actual, a = b OR (a = 'Integer' AND b = 'Float') OR (a = 'Float' AND b = 'Integer') OR (a = 'String' AND b = 'Date') OR (a = 'Boolean' AND b = 'Integer') AS ok
    FROM (SELECT unnest(['Integer', 'Float', 'String', 'Boolean', 'Date', 'Map']) AS a), (SELECT unnest(['Integer', 'Float', 'String', 'Boolean', 'Date', 'Map']) AS b)""")
def q89(spark, d):
    return rows(spark, [(a, b, S.compatible(a, b)) for a in KINDS for b in KINDS], "declared string, actual string, ok boolean")


@query("q90_loaded_counts", "SELECT 'CRITICAL' AS severity, 'Customer has ' || count(*) || ' nodes, not ' || 2 * count(*) AS what FROM customer UNION ALL SELECT 'WARNING', 'Part has ' || count(*) || ' nodes, not ' || (count(*) + 1) FROM part UNION ALL SELECT 'WARNING', 'ORDERS_TO_CUSTOMER has less than half of its edges' UNION ALL SELECT 'CRITICAL', 'Region lacks property r_name'")
def q90(spark, d):
    m, _, f = star_model(spark, d)
    m.edges = [e for e in m.edges if e.type in ("ORDERS_TO_CUSTOMER", "NATION_TO_REGION")]
    loaded = {n.label: f[n.source] for n in m.nodes} | {"Region": f["region"].drop("r_name")}
    n, parts = f["customer"].count(), f["part"].count()
    edges = {e.type: ingest.load_edge(e, m, f) for e in m.edges}
    issues = ingest.check_loaded(m, loaded, edges, {"Customer": 2 * n, "Part": parts + 1, "ORDERS_TO_CUSTOMER": f["orders"].count() * 3, "NATION_TO_REGION": 1})
    return rows(spark, [(i.severity, i.what) for i in issues], "severity string, what string")


@query("q91_composite_key_edges", "SELECT DISTINCT (l.l_orderkey * 10 + l.l_linenumber) % 1000 AS src, l.l_orderkey AS k1, l.l_linenumber AS k2 FROM lineitem l WHERE l.l_orderkey % 5 = 0 AND l.l_orderkey IS NOT NULL AND l.l_linenumber IS NOT NULL")
def q91(spark, d):
    lines = table(spark, d, "lineitem")
    notes = lines.where("l_orderkey % 5 = 0").select(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) % 1000).alias("note"), "l_orderkey", "l_linenumber")
    return ingest.load_fk_edge(notes, "note", ["l_orderkey", "l_linenumber"], lines, ["l_orderkey", "l_linenumber"]).select("src", "dst.k1", "dst.k2")


# --- schema ---


def star_document(spark: SparkSession, d: str) -> dict:
    m, _, f = star_model(spark, d)
    edges = {e.type: (e.start[0], ingest.load_edge(e, m, f), e.end[0]) for e in m.edges}
    return schema.document({n.label: f[n.source] for n in m.nodes}, edges, m.indexes, m.constraints, [M.Enum("Segment", ["AUTOMOBILE", "BUILDING"])])


@query("q92_node_schema", values([("outbound", "ORDERS_TO_CUSTOMER"), ("inbound", "LINEITEM_TO_ORDERS"), ("index", "o_orderkey"), ("index", "o_custkey"), ("constraint", "o_orderkey")], "part, what") + " UNION ALL SELECT 'property', column_name FROM (DESCRIBE orders)")
def q92(spark, d):
    n = schema.node_schema(star_document(spark, d), ["Orders"])
    told = [("property", p["key"]) for p in n["node"]["properties"]] + [(k, e["type"]) for k in ("outbound", "inbound", "loops") for e in n[k]]
    told += [("index", ",".join(i["properties"])) for i in n["indexes"]] + [("constraint", ",".join(i["properties"])) for i in n["constraints"]]
    return rows(spark, told, "part string, what string")


@query("q93_relationships_and_enums", values([("relationship", "Orders", "Customer"), ("none", "no relationship ORDERS_TO_CUSTOMER leads from Part to Customer", None), ("enum", "AUTOMOBILE,BUILDING", None), ("none", "no enum is named Colour", None)], 'kind, a, b'))
def q93(spark, d):
    doc = star_document(spark, d)
    r = schema.relationship_of(doc, "ORDERS_TO_CUSTOMER", ["Orders"], ["Customer"])
    return rows(spark, [("relationship", r["start_node_labels"][0], r["end_node_labels"][0]), ("none", schema.relationship_of(doc, "ORDERS_TO_CUSTOMER", ["Part"], ["Customer"]), None), ("enum", ",".join(schema.enum_schema(doc, "Segment")["values"]), None), ("none", schema.enum_schema(doc, "Colour"), None)], "kind string, a string, b string")


@query("q94_schema_search", f"SELECT 'node' AS kind, upper(tab[1]) || tab[2:] AS item, 'property: ' || col AS reason FROM ({described()}) WHERE col LIKE '%custkey%' UNION ALL " + values([("node", "Customer", None), ("relationship", "ORDERS_TO_CUSTOMER", "type: ORDERS_TO_CUSTOMER"), ("relationship", "CUSTOMER_TO_NATION", "type: CUSTOMER_TO_NATION"), ("enum", "Segment", "value: BUILDING")], "kind, item, reason").replace("NULL", "'label: Customer'"))
def q94(spark, d):
    found = schema.search(star_document(spark, d), "custkey|customer|^build")
    name = lambda x: x["item"].get("type") or x["item"].get("name") or x["item"]["labels"][0]
    return rows(spark, [(x["kind"], name(x), r) for x in found for r in x["reasons"]], "kind string, item string, reason string")


@query("q95_schema_text", values([(f"- (:{t.title()})-[:{t}_TO_{f[1]}]->(:{f[1].title()})".replace(f"{t}_TO_{f[1]}", f"{t}_TO_{f[1]}".upper()),) for t, fs in FOREIGN.items() for f in fs] + [("Nodes:",), ("Relationships:",)], "line"))
def q95(spark, d):
    lines = schema.describe(star_document(spark, d)).split("\n")
    return rows(spark, [(x,) for x in lines if not x.startswith("- ") or x.startswith("- (:")], "line string")


@query("q96_index_advice", values([("Orders", "o_custkey", False), ("Orders", "o_totalprice", False), ("Customer", "c_custkey", True)], "label, property, there"))
def q96(spark, d):
    m, _, f = star_model(spark, d)
    q = f["orders"].where("o_totalprice > 1000").join(f["customer"], F.col("o_custkey") == F.col("c_custkey"))
    columns = {c: t.title() for t in ("orders", "customer") for c in f[t].columns}
    found = schema.advise(q, [M.Index("label_property", ["Customer"], ["c_custkey"])], columns)
    return rows(spark, [(i.labels[0], i.properties[0], i in found["existing"]) for i in found["recommended"]], "label string, property string, there boolean")


# --- services ---

STATEMENTS = [
    ("select 1", True), ("with c as (select 1 as a) select * from c", True), ("select 'drop table x' as s", True), ("values (1), (2)", True), ("from t |> where a > 1", True),
    ("with c as (select 1 as a) insert into t select * from c", False), ("from s insert into a select 1 insert into b select 2", False), ("drop table t", False), ("create view v as select 1", False), ("delete from t", False),
    ("update t set a = 1", False), ("set x = y", False), ("cache table t", False), ("select reflect('a', 'b')", False),
]


@query("q97_read_only_gate", values(STATEMENTS, "statement, ok"))
def q97(spark, d):
    return rows(spark, [(s, service.is_read_only(spark, s)) for s, _ in STATEMENTS], "statement string, ok boolean")


@query("q98_tenant_gate", values([("select 1 as a", True), ("select * from other.t", False), ("select * from spark_catalog.other.t", False), ("with c as (select * from other.t) select * from c", False), ("select * from parquet.`/x`", False)], "statement, ok"))
def q98(spark, d):
    own = service.GraphSession(spark, allowed={"default"})

    def passes(text: str) -> bool:
        try:
            own.sql(text)
        except LookupError:
            return False
        return True

    texts = ["select 1 as a", "select * from other.t", "select * from spark_catalog.other.t", "with c as (select * from other.t) select * from c", "select * from parquet.`/x`"]
    return rows(spark, [(t, passes(t)) for t in texts], "statement string, ok boolean")


@query("q99_question_chain", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def q99(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("chain_nation")
    chain = service.QuestionChain(service.GraphSession(spark), lambda q, s: "Here:\n```sql\nselect n_nationkey, n_name from chain_nation order by n_nationkey\n```", lambda q, r: "", return_direct=True)
    found = chain.ask("Which nations are there?")["result"]
    return rows(spark, [(r["n_nationkey"], r["n_name"]) for r in found], ", ".join(f"{n} {t}" for n, t in table(spark, d, "nation").select("n_nationkey", "n_name").dtypes))


@query("q100_toolbox", "SELECT 'region' AS tool, CAST(count(*) AS BIGINT) AS n, false AS failed FROM region UNION ALL SELECT 'broken', 1, true UNION ALL SELECT 'unknown', 1, true")
def q100(spark, d):
    box = service.Toolbox().add("region", lambda: table(spark, d, "region")).add("broken", lambda: spark.sql("selec"))
    told = {n: box.call(n) for n in ("region", "broken", "unknown")}
    return rows(spark, [(n, len(r), "error" in r[0]) for n, r in told.items()], "tool string, n long, failed boolean")


# --- scalars ---


@query("q101_validation", r"""SELECT doc_id, regexp_full_match(source || '_' || doc_id, '[a-zA-Z0-9_-]{1,128}') AS session_ok, regexp_full_match(lang || CASE WHEN doc_id % 2 = 0 THEN '@x.y' ELSE ' z' END, '[a-zA-Z0-9_@.\-]{1,256}') AS user_ok,
    CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS skill_ok FROM documents""")
def q101(spark, d):
    t = table(spark, d, "documents")
    name = F.element_at(F.array(F.lit("a-b2"), F.lit("A-b"), F.lit("a--b"), F.lit("a")), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    user = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "@x.y").otherwise(" z"))
    return t.select("doc_id", S.valid_session_id(F.concat_ws("_", "source", "doc_id")).alias("session_ok"), S.valid_user_id(user).alias("user_ok"), S.valid_skill(name, F.lit("what it does")).alias("skill_ok"))


@query("q102_iso_formats", """SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000' AS dt, strftime(ts, '%H:%M:%S.%f') || '000' AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000+02:00' AS z,
    'PT' || CASE WHEN event_id // 3600 > 0 THEN (event_id // 3600) || 'H' ELSE '' END || CASE WHEN event_id % 3600 // 60 > 0 THEN (event_id % 3600 // 60) || 'M' ELSE '' END || CASE WHEN event_id % 60 > 0 THEN (event_id % 60) || '.5S' ELSE '0.5S' END AS p FROM events""")
def q102(spark, d):
    return table(spark, d, "events").select("event_id", S.iso_date("ts").alias("d"), S.iso_local_datetime("ts").alias("dt"), S.iso_local_time("ts").alias("t"), S.iso_datetime("ts", "+02:00").alias("z"), S.iso_duration(F.col("event_id") * 1000000 + 500000).alias("p"))


@query("q103_blocks_and_front_matter", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'sql' || chr(10) || role ELSE 'no block ' || role END AS block, 'skill-' || role AS name FROM conversations")
def q103(spark, d):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("See ```sql\n"), "role", F.lit("``` and ```more```"))).otherwise(F.concat(F.lit("no block "), "role"))
    head = F.concat(F.lit("---\nname: skill-"), "role", F.lit("\ndescription: x\ntags: [a, b]\n---\nbody"))
    return table(spark, d, "conversations").select("conv_id", "turn", S.fenced_block(text).alias("block"), S.frontmatter(head)["name"].alias("name"))


@query("q104_nested_values", "SELECT event_id, event_type AS found FROM events UNION ALL SELECT event_id, CAST(user_id AS VARCHAR) FROM events")
def q104(spark, d):
    inner = F.to_json(F.struct(F.col("event_type").alias("name")))
    value = F.to_json(F.struct(F.array(F.struct(inner.alias("text"))).alias("items"), F.struct(F.col("user_id").cast("string").alias("name")).alias("deep"), F.lit("x").alias("other")))
    return table(spark, d, "events").select("event_id", F.explode(S.extract_nested(value, ["name"])).alias("found"))


# --- writes and stores ---


@query("q105_create", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def q105(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    new = n.select((F.col("n_nationkey") + 100).cast(n.schema["n_nationkey"].dataType).alias("n_nationkey"), "n_name")
    return write.append(write.create(n, new, ["n_nationkey"]), new)


@query("q106_deleted_count", "SELECT count(*) AS deleted FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q106(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return write.deleted_count(table(spark, d, "orders"), gone, ["o_custkey"])


@query("q107_emptiness", "SELECT 'orders' AS name, count(*) = 0 AS is_empty FROM orders UNION ALL SELECT 'none', count(*) = 0 FROM orders WHERE o_orderkey < 0")
def q107(spark, d):
    o = table(spark, d, "orders")
    return rows(spark, [("orders", pattern.is_empty(o)), ("none", pattern.is_empty(o.where("o_orderkey < 0")))], "name string, is_empty boolean")


@query("q108_memories", """WITH m AS (SELECT conv_id AS memory_id, 'u' || conv_id % 3 AS user_id, min(text) AS content FROM conversations WHERE turn = 0 GROUP BY conv_id)
    SELECT memory_id, user_id, CASE WHEN memory_id = 2 THEN 'changed' ELSE content END AS content FROM m UNION ALL SELECT memory_id + 1000000, 'new', 'kept' FROM m WHERE memory_id % 10 = 0""")
def q108(spark, d):
    m = table(spark, d, "conversations").where("turn = 0").groupBy(F.col("conv_id").alias("memory_id")).agg(F.min("text").alias("content")).select("memory_id", F.concat(F.lit("u"), F.col("memory_id") % 3).alias("user_id"), "content")
    new = m.where("memory_id % 10 = 0").select((F.col("memory_id") + 1000000).alias("memory_id"), F.lit("new").alias("user_id"), F.lit("kept").alias("content"), F.col("memory_id").alias("session_id"))
    edges = rows(spark, [], "src string, dst long")
    kept, owns, produced = stores.save_memory(m, edges, rows(spark, [], "src long, dst long"), new)
    assert owns.columns == produced.columns == ["src", "dst"]
    return stores.update_memory(kept, 2, "changed")[0]


@query("q109_memories_of_a_user", "SELECT DISTINCT conv_id AS memory_id FROM conversations WHERE turn = 0 AND conv_id % 3 = 1 AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])(the|what)($|[^\\p{L}\\p{N}_])')")
def q109(spark, d):
    m = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("memory_id"), F.concat(F.lit("u"), F.col("conv_id") % 3).alias("user_id"), F.col("text").alias("content"))
    return text_search.search_memories(m, "u1", "What, the", 1 << 30).select("memory_id").distinct()


@query("q110_skills_by_name", "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END AS updated_at, 1 AS created_at FROM nation WHERE contains(lower(n_name), 'an')")
def q110(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("updated_at"), F.lit(1).alias("created_at"), "n_nationkey")
    new = n.where("n_nationkey % 2 = 0").withColumn("updated_at", F.lit(2)).withColumn("created_at", F.lit(2))
    return skills.search_by_name(skills.list_skills(skills.add_skills(n, new)), "AN").select("name", "updated_at", "created_at")


@query("q111_workspaces", values([("asked", "asked"), ("derived", "derived"), ("base", "base")], "given, used"))
def q111(spark, d):
    return rows(spark, [("asked", chunks.workspace("asked", "derived")), ("derived", chunks.workspace(" ", "derived")), ("base", chunks.workspace())], "given string, used string")


@query("q112_given_extractor", "SELECT DISTINCT md5('base' || chr(0) || lang || chr(0) || 'Language') AS entity_id, lang AS name FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def q112(spark, d):
    docs = table(spark, d, "documents").where("lang is not null").select(F.col("doc_id").alias("hash"), F.concat(F.col("lang"), F.lit("|"), F.col("text")).alias("text"))
    return entities.extract(docs, extractor=lambda t: ([(t.partition("|")[0], "Language")], []))["entities"].select("entity_id", "name").distinct()


# --- events ---


def hooks(spark: SparkSession, d: str, names: tuple[str, str], fields: dict[str, str]) -> DataFrame:
    """Payloads of a tool's start and end as another runtime writes them."""
    e = table(spark, d, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    one = lambda hook: F.to_json(F.struct(F.lit(hook).alias(fields["hook"]), F.concat(F.lit("u"), "user_id").alias(fields["session"]), at.alias("timestamp"), F.col("event_type").alias(fields["tool"]), F.col("event_id").cast("string").alias(fields["call"])))
    return e.select(F.explode(F.array(*[one(n) for n in names])).alias("value"))


RUNTIMES = {"command_b": (("PreToolUse", "PostToolUse"), {"hook": "hook_event_name", "session": "session_id", "tool": "tool_name", "call": "tool_use_id"}), "sdk_a": (("pre_tool", "post_tool"), {"hook": "event", "session": "sessionId", "tool": "tool_name", "call": "tool_use_id"}), "sdk_b": (("on_tool_start", "on_tool_end"), {"hook": "hook", "session": "session_id", "tool": "tool", "call": "call_id"})}


@query("q113_payloads_of_runtimes", "SELECT r AS source_sdk, t AS event_type, 'u' || user_id AS session_id, event_type AS tool_name, CAST(event_id AS VARCHAR) AS tool_use_id FROM events, (SELECT unnest(['command_b', 'sdk_a', 'sdk_b']) AS r), (SELECT unnest(['tool_start', 'tool_end']) AS t)")
def q113(spark, d):
    parts = [events.from_payloads(hooks(spark, d, *how), r) for r, how in RUNTIMES.items()]
    return parts[0].union(parts[1]).union(parts[2]).select("source_sdk", "event_type", "session_id", "tool_name", "tool_use_id")


@query("q114_action_labels", "SELECT conv_id || '-' || turn AS action_id, ['Action', 'Message', upper(role[1]) || role[2:] || 'Message'] AS labels FROM conversations")
def q114(spark, d):
    return messages(spark, d).select("action_id", events.type_labels("action_type").alias("labels"))


def lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A start for each user, and an end for those of even ids."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    start = F.to_json(F.struct(F.lit("SessionStart").alias("hook_event_name"), F.concat(F.lit("u"), "user_id").alias("session_id"), iso("a").alias("timestamp"), F.concat(F.lit("p"), "user_id").alias("user_id")))
    end = F.to_json(F.struct(F.lit("Stop").alias("hook_event_name"), F.concat(F.lit("u"), "user_id").alias("session_id"), iso(F.col("b") + F.expr("interval 1 hour")).alias("timestamp"), F.lit("done").alias("status"), (F.col("user_id") / 2).alias("total_cost_usd")))
    return events.from_payloads(u.select(F.explode(F.filter(F.array(start, F.when(F.col("user_id") % 2 == 0, end)), lambda x: x.isNotNull())).alias("value")), "command_a")


@query("q115_active_users", "SELECT DISTINCT 'u' || user_id AS session_id, 'p' || user_id AS user_id FROM events WHERE user_id % 2 <> 0")
def q115(spark, d):
    return events.active_users(lifecycle(spark, d))


@query("q116_ended_sessions", "SELECT 'u' || user_id AS session_id, CASE WHEN user_id % 2 = 0 THEN 'done' ELSE 'active' END AS status, CASE WHEN user_id % 2 = 0 THEN user_id / 2 END AS total_cost_usd, CASE WHEN user_id % 2 = 0 THEN strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') END AS ended_at FROM events GROUP BY user_id")
def q116(spark, d):
    e = lifecycle(spark, d)
    return analytics.end_sessions(events.sessions_of(e), e.where("event_type = 'session_end'")).select("session_id", "status", "total_cost_usd", "ended_at")


@query("q117_skill_usage_detected", f"SELECT 's' || user_id AS session_id, 'skill-' || event_type AS skill, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CASE WHEN {FAILED} THEN 'read' ELSE 'load' END AS action FROM events GROUP BY ALL")
def q117(spark, d):
    e = table(spark, d, "events")
    failed = F.get_json_object("props", "$.k").cast("int") < 10
    name = F.concat(F.lit("skill-"), "event_type")
    given = F.when(failed, F.to_json(F.struct(F.concat(F.lit("/home/x/"), name, F.lit("/SKILL.md")).alias("file_path")))).otherwise(F.to_json(F.struct(name.alias("skill_name"))))
    none = F.lit(None).cast("string")
    base = e.select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.lit("tool_start").alias("event_type"), F.when(failed, "Read").otherwise("mcp__s__get_skill").alias("tool_name"), given.alias("tool_input"), none.alias("result"), none.alias("content"))
    return skills.detect_usage(base, rows(spark, [("x",)], "name string"))


@query("q118_event_types", "SELECT event_type AS tool_name, n FROM (SELECT event_type, 2 * count(*) AS n FROM events GROUP BY 1)")
def q118(spark, d):
    seen: list[DataFrame] = []
    hub = events.Hub().add("kept", {"tool_start", "tool_end"}, seen.append).add("other", {"message"}, lambda df: None)
    hub.emit(events.from_payloads(hooks(spark, d, *RUNTIMES["sdk_b"]), "sdk_b"))
    return seen[0].groupBy("tool_name").agg(F.count("*").alias("n"))


@query("q119_calls_by_status", f"SELECT event_type AS tool_name, CASE WHEN {FAILED} THEN 'failed' ELSE 'completed' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def q119(spark, d):
    return tool_calls(spark, d).groupBy("tool_name", "status").agg(F.count("*").alias("n"))


@query("q120_vector_index", SQL["q50_knn_batch_topk"])
def q120(spark, d):
    e = table(spark, d, "embeddings")
    index = vector.cell_index(e.withColumnRenamed("vec_id", "id"), 64)
    return vector.knn_cells(index, e.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), 5).withColumn("distance", F.round("distance", 6))


@query("q121_typed_actions", "SELECT conv_id || '-' || turn AS action_id, text AS content, CAST(turn AS BIGINT) AS input_tokens FROM conversations")
def q121(spark, d):
    stored = messages(spark, d).select("action_id", "action_type", F.to_json(F.struct(F.col("text").alias("content"), F.col("timestamp").cast("long").alias("input_tokens"))).alias("properties"))
    return events.typed(stored).select("action_id", "content", "input_tokens")


@query("q122_catalogue_of_information_schema", values([("customer", "c_custkey", "PRI"), ("orders", "o_orderkey", "PRI"), ("orders", "o_custkey", "MUL"), ("view_of_orders", "o_orderkey", "")], "tab, col, code"))
def q122(spark, d):
    columns = rows(spark, [("customer", "c_custkey", "bigint", "NO", 1), ("orders", "o_custkey", "bigint", "YES", 2), ("orders", "o_orderkey", "bigint", "NO", 1), ("view_of_orders", "o_orderkey", "bigint", "YES", 1)], "table_name string, column_name string, data_type string, is_nullable string, ordinal_position int")
    kinds = rows(spark, [("customer", "BASE TABLE"), ("orders", "BASE TABLE"), ("view_of_orders", "VIEW")], "table_name string, table_type string")
    keys = rows(spark, [("customer", "c_custkey", "customer_pk", "PRIMARY KEY", None, None), ("orders", "o_orderkey", "orders_pk", "PRIMARY KEY", None, None), ("orders", "o_custkey", "placed_fk", "FOREIGN KEY", "customer", "c_custkey")], "table_name string, column_name string, constraint_name string, constraint_type string, referenced_table string, referenced_column string")
    c = C.Catalogue.from_information_schema(columns, kinds, keys)
    assert [C.relation_name(r) for r in c.relationships()] == ["PLACED"] and c.tables["view_of_orders"].kind == "view"
    return rows(spark, [(t.name, x.name, t.key_code(x.name)) for t in c.tables.values() for x in t.columns], "tab string, col string, code string")
