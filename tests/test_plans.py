import json

import pytest

from ctxweave.plans import ingest, schema, service
from ctxweave.plans import model as M
from ctxweave.plans.catalogue import Catalogue, Column, ForeignKey, Table, is_join_table, pascal, sanitised, title_label
from ctxweave.sources import readers


def shop() -> Catalogue:
    key = lambda *names: [Column(n, "bigint", primary=k == 0) for k, n in enumerate(names)]
    return Catalogue(
        [
            Table("customers", [*key("id"), Column("name", "string")], rows=10),
            Table("orders", [*key("id", "customer_id"), Column("total", "decimal(10,2)")], [ForeignKey("customer_id", "customers", "id", "placed_fk")], rows=20),
            Table("tags", [*key("id"), Column("tag", "string")], rows=5),
            Table("order_tags", [Column("order_id", "bigint"), Column("tag_id", "bigint"), Column("created_at", "timestamp")], [ForeignKey("order_id", "orders", "id"), ForeignKey("tag_id", "tags", "id")]),
            Table("v", [Column("x", "int")], view=True),
        ]
    )


def test_kinds_and_relationships():
    c = shop()
    assert {t.name: t.kind for t in c.tables.values()} == {"customers": "entity", "orders": "entity", "tags": "entity", "order_tags": "join", "v": "view"}
    assert is_join_table(c.tables["order_tags"]) and c.tables["orders"].key_code("customer_id") == "MUL"
    assert [(r.kind, r.start, r.end) for r in c.relationships()] == [("one_to_many", "orders", "customers"), ("many_to_many", "orders", "tags")]
    assert c.expected_nodes() == 35
    assert pascal("order_items") == "OrderItems" and title_label("order_items") == "Order_Items" and sanitised("1 a") == "_1_a"


def test_model():
    m = M.model_tables(shop())
    assert [n.label for n in m.nodes] == ["Customers", "Orders", "Tags"]
    assert [e.type for e in m.edges] == ["PLACED", "ORDER_TAGS"]
    assert [p.name for p in m.node("Orders").properties] == ["id", "total"]
    assert M.GraphModel.from_document(json.loads(json.dumps(m.to_document()))) == m and len(m.hash()) == 64
    assert "CREATE CONSTRAINT ON (n:Customers) ASSERT n.id IS UNIQUE;" in m.ddl()
    issues, covered = ingest.check_model(m, shop())
    assert covered == 100.0 and not [i for i in issues if i.severity == ingest.CRITICAL]


def test_edits():
    m = M.model_tables(shop())
    out, history = M.apply_edits(m, [{"op": "change_node_label", "old": "Tags", "new": "Tag"}, {"op": "rename_property", "label": "Orders", "old": "total", "new": "sum"}, {"op": "change_node_key", "label": "Orders", "columns": ["orders.id"]}, {"op": "drop_node", "label": "Customers"}])
    assert [n.label for n in m.nodes] == ["Customers", "Orders", "Tags"] and len(history) == 4
    assert [n.label for n in out.nodes] == ["Orders", "Tag"] and [e.type for e in out.edges] == ["ORDER_TAGS"] and out.edges[0].end == ["Tag"]
    p = out.node("Orders").properties[1]
    assert (p.name, p.source) == ("sum", "total") and out.node("Orders").key == ["id"]
    assert not [i for i in out.indexes if "Customers" in i.labels]
    assert len(M.EDITS) == 17
    with pytest.raises(ValueError):
        M.apply_edits(m, [{"op": "nothing"}])
    assert M.merge_models([m, m]) == m
    assert M.match_tables(["Customer", "Categories"], ["customers", "category"]) == {"Customer": "customers", "Categories": "category"}


def test_plan():
    m = M.model_tables(shop())
    counts = {"customers": 10, "orders": 20, "tags": 5}
    stored = json.loads(json.dumps(ingest.summary(m, counts, {"host": "h"})))
    assert ingest.plan(stored, m, counts) == ({}, {})
    nodes, edges = ingest.plan(stored, m, counts | {"customers": 11})
    assert nodes == {"customers": "rows added"} and list(edges.values()) == ["an end is loaded"]
    assert ingest.plan(stored, m, counts | {"tags": None})[0] == {"tags": "count unknown"}
    assert ingest.plan(None, m, counts)[0] == {"customers": "new", "orders": "new", "tags": "new"}
    assert ingest.plan(stored, m, counts, "skip") == ({}, {}) and len(ingest.plan(stored, m, counts, "reset")[0]) == 3
    assert ingest.score(1, 2, 3) == 81.0 and ingest.score(20, 0, 0) == 0.0 and ingest.issues_score([]) == 100.0


def test_ingest_and_checks(spark):
    frames = {
        "customers": spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string"),
        "orders": spark.createDataFrame([(1, 1, 2.0), (2, None, 3.0), (3, 9, 4.0)], "id long, customer_id long, total double"),
        "tags": spark.createDataFrame([(1, "x")], "id long, tag string"),
        "order_tags": spark.createDataFrame([(1, 1), (1, 1), (1, 7)], "order_id long, tag_id long"),
    }
    m, got = M.model_tables(shop()), {}
    r = ingest.ingest(m, shop(), frames, lambda name, df: got.__setitem__(name, df.cache()))
    assert not r.errors and got["Customers"].count() == 2
    assert [tuple(x) for x in got["PLACED"].collect()] == [(1, 1)] and [tuple(x) for x in got["ORDER_TAGS"].collect()] == [(1, 1)]
    assert ingest.ingest(m, shop(), frames, lambda *_: None, only_nodes=set(), only_edges=set()).done == []
    assert "Customers" in ingest.ingest(m, shop(), {k: v for k, v in frames.items() if k != "customers"}, lambda n, df: df.count()).errors
    tries = []

    def flaky(name, df):
        tries.append(name)
        if tries.count(name) < 3:
            raise OSError("gone")

    assert len(ingest.ingest(m, shop(), frames, flaky, retries=2).done) == 5 and tries.count("Tags") == 3
    nodes = {n.label: got[n.label] for n in m.nodes}
    issues = ingest.check_loaded(m, nodes, {e.type: got[e.type] for e in m.edges}, {"Customers": 2, "Tags": 9})
    assert [i.severity for i in issues] == [ingest.CRITICAL]
    bad = nodes | {"Tags": got["Tags"].union(got["Tags"])}
    assert [tuple(x) for x in ingest.constraint_violations(m, bad, spark).collect()] == [("Tags", "unique", "id", 2)]


def test_keys_of_several_columns(spark):
    key = lambda *names: [Column(n, "bigint", primary=True) for n in names]
    c = Catalogue(
        [
            Table("stock", [*key("shop", "item"), Column("n", "int")]),
            Table("sale", [*key("id"), Column("shop", "bigint"), Column("item", "bigint")], [ForeignKey("shop", "stock", "shop", "sale_fk"), ForeignKey("item", "stock", "item", "sale_fk")]),
            Table("moved", [Column(x, "bigint") for x in ("shop", "item", "to_sale")], [ForeignKey("shop", "stock", "shop", "a_fk"), ForeignKey("item", "stock", "item", "a_fk"), ForeignKey("to_sale", "sale", "id", "b_fk")]),
        ]
    )
    assert [(r.kind, r.columns, r.width) for r in c.relationships()] == [("one_to_many", ("shop", "item"), 1), ("many_to_many", ("shop", "item", "to_sale"), 2)]
    frames = {
        "stock": spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7), (None, 2, 8)], "shop long, item long, n int"),
        "sale": spark.createDataFrame([(10, 1, 2), (11, 2, 2), (12, 2, None), (13, 2, 1)], "id long, shop long, item long"),
        "moved": spark.createDataFrame([(1, 1, 10), (1, 1, 10), (2, 2, 10), (2, 1, 99), (None, 1, 10)], "shop long, item long, to_sale long"),
    }
    m = M.model_tables(c)
    m = M.GraphModel.from_document(json.loads(json.dumps(m.to_document())))
    flat = lambda e: sorted((r["src"] if isinstance(r["src"], int) else tuple(r["src"]), r["dst"] if isinstance(r["dst"], int) else tuple(r["dst"])) for r in ingest.load_edge(e, m, frames).collect())
    assert flat(m.edge("SALE")) == [(10, (1, 2)), (13, (2, 1))] and flat(m.edge("MOVED")) == [((1, 1), 10)]
    by_number = ingest.load_fk_edge(frames["sale"], "id", "item", frames["stock"], ["shop", "item"], "n")
    assert by_number.count() == 0
    assert ingest.load_fk_edge(frames["sale"], "id", "item", frames["stock"], ["shop", "item"], "item").count() == 3 + 2 - 1


def test_schema(spark):
    person, company = spark.createDataFrame([("Alice", 30)], "name string, age long"), spark.createDataFrame([("C",)], "name string")
    knows = spark.createDataFrame([("Alice", "Bob", 2020)], "src string, dst string, since long")
    doc = schema.document({"Person": person, "Company": company}, {"KNOWS": ("Person", knows, "Person"), "WORKS_AT": ("Person", knows.drop("since"), "Company")}, [M.Index("label", ["Person"])], [], [M.Enum("Status", ["Active", "Inactive"])])
    n = schema.node_schema(doc, ["Person"])
    assert [p["key"] for p in n["node"]["properties"]] == ["name", "age"] and [e["type"] for e in n["loops"]] == ["KNOWS"] and [e["type"] for e in n["outbound"]] == ["WORKS_AT"] and n["inbound"] == []
    assert isinstance(schema.node_schema(doc, ["Nobody"]), str) and schema.enum_schema(doc, "Status")["values"] == ["Active", "Inactive"]
    assert schema.relationship_of(doc, "KNOWS", ["Person"], ["Person"])["properties"][0]["key"] == "since"
    assert [x["kind"] for x in schema.search(doc, "KNOW.*")] == ["relationship"] and schema.search(doc, "zzz_no_match_zzz") == [] and schema.search(doc, "a(") == []
    assert {x["kind"] for x in schema.search(doc, "active")} == {"enum"}
    assert "(:Person)-[:KNOWS]->(:Person) (since: integer)" in schema.describe(doc)
    profile = {(r["label"], r["property"]): (r["non_null"], r["examples"]) for r in schema.property_profile({"Person": person}).collect()}
    assert profile["Person", "name"] == (1, ["Alice"])
    found = schema.advise(person.where("age > 3"), [], {"age": "Person", "name": "Person"})
    assert [i.properties for i in found["missing"]] == [["age"]] and not found["optimised"]


def test_service(spark):
    s = service.GraphSession(spark)
    assert s.sql("select :x as v", {"x": 5}).first()["v"] == 5 and s.connected()
    assert s.sql("select 'drop table create' as set_it").count() == 1
    for text in ("create table t (a int) using parquet", "drop table if exists t", "set a = b"):
        with pytest.raises(service.NotReadOnly):
            s.sql(text)
    spark.range(3).createOrReplaceTempView("gate_rows")
    for text in (
        "with c as (select 1 as a) insert into t select * from c",
        "from gate_rows insert into a select id insert into b select id",
        "insert overwrite table t select 1",
        "create view v as select 1",
        "create or replace temp view v as select 1",
        "cache table gate_rows",
        "truncate table t",
        "merge into t using s on t.a = s.a when matched then delete",
        "use other",
        "select reflect('java.lang.System', 'exit', 1)",
        "select * from gate_rows where id in (select java_method('java.lang.Long', 'parseLong', '1'))",
    ):
        assert not service.is_read_only(spark, text), text
        with pytest.raises(service.NotReadOnly):
            s.sql(text)
    for text, n in {
        "with c as (select id from gate_rows) select * from c union all select * from c": 6,
        "select id, row_number() over (order by id) as r from gate_rows where id in (select max(id) from gate_rows) or exists (select 1) limit 2": 2,
        "select * from values (1, 'insert into'), (2, 'drop') as v(a, b) lateral view explode(array(1, 2)) e as x order by a": 4,
        "select a.id from gate_rows a join gate_rows b on a.id = b.id group by a.id having count(*) > 0": 3,
        "from gate_rows |> where id > 0 |> select id": 2,
        "select * from gate_rows tablesample (100 percent)": 3,
    }.items():
        assert s.sql(text).count() == n, text
    assert s.sql_async("select 1 as a").result()[0]["a"] == 1
    with pytest.raises(LookupError):
        service.GraphSession(spark, allowed=set()).use("default")
    spark.sql("create database if not exists gate_other")
    spark.sql("create or replace temp view outside as select 1 as a")
    own = service.GraphSession(spark, allowed={"default"})
    assert own.sql("select * from outside").count() == 1 and own.sql("select count(*) from gate_rows").first()[0] == 3
    for text in ("select * from gate_other.t", "with c as (select * from gate_other.t) select * from c", "select 1 where exists (select * from spark_catalog.gate_other.t)", "select * from parquet.`/root`", "select * from other_catalog.default.t"):
        with pytest.raises(LookupError):
            own.sql(text)
    writer = service.GraphSession(spark, read_only=False, allowed={"default"})
    for text in ("insert into gate_other.t select 1", "drop table if exists gate_other.t", "use gate_other", "create table gate_other.t (a int) using parquet"):
        with pytest.raises(LookupError):
            writer.sql(text)
    other = service.GraphSession(spark, default="gate_other")
    both = [(x, x.sql_async("select current_database() as d")) for x in [other, s] * 8]
    assert all(f.result()[0]["d"] == x.current for x, f in both) and spark.catalog.currentDatabase() == "default"
    spark.sql("drop database gate_other")
    box = service.Toolbox().add("q", lambda text: s.sql(text))
    assert box.call("q", text="select 1 as a") == [{"a": 1}] and "error" in box.call("q", text="selec")[0]
    with pytest.raises(ValueError):
        box.add("q", len)
    chain = service.QuestionChain(s, lambda q, _: "```sql\nselect 2 as n\n```", lambda q, rows: f"{rows[0]['n']}")
    assert chain.ask("how many?")["result"] == "2"


def test_sources(spark, tmp_path, data):
    assert readers.read(spark, "parquet", path=f"{data}/nation.parquet", columns=["n_name"], limit=3).columns == ["n_name"]
    assert readers.from_uri("postgresql://u:p%40@h/db")["url"] == "jdbc:postgresql://h:5432/db" and readers.from_uri("mysql://u@h:1/db")["url"] == "jdbc:mysql://h:1/db"
    with pytest.raises(ValueError):
        readers.from_uri("ftp://x/y")
    (tmp_path / "a.txt").write_text("x\ny")
    assert readers.read(spark, "text", path=str(tmp_path)).first()["text"] == "x\ny"
    assert readers.read(spark, "payloads", path=str(tmp_path)).count() == 0
    assert readers.sample(spark.range(9), 0).count() == 0


def test_changes_and_review():
    old = M.model_tables(shop())
    new = M.add_property(M.drop_property(old, "Orders", "total"), "Orders", "note")
    assert M.changes(old, old) == {} and M.changes(old, new) == {"orders": ["added note", "removed total"]}
    asked = []
    assert M.changes(M.review(old, new, lambda t, why: asked.append(t) or False), old) == {} and asked == ["orders"]
    assert [p.name for p in M.review(old, new, lambda *_: True).node("Orders").properties] == ["id", "note"]
    assert set(M.changes(None, old)) == {"customers", "orders", "tags", "order_tags"}
