"""Facts with known values, and properties against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxweave.functions import scalars as S
from ctxweave.operators import analytics, chunks, evals, graph_documents, pattern, skills, stores, text_search, vector, write


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tool_stats(spark):
    calls = spark.createDataFrame([("s", f"a{k}", t, 10.0, "completed") for k, t in enumerate(["Read"] * 3 + ["Write"] * 2)], "session_id string, action_id string, tool_name string, duration_ms double, status string")
    got = rows(analytics.tool_stats(calls).select("tool_name", "call_count", "error_count"))
    assert got == [("Read", 3, 0), ("Write", 2, 0)]
    assert rows(analytics.tool_stats(calls, "other")) == []


def test_tool_stats_with_results(spark):
    calls = spark.createDataFrame([("s", "1", "Read", None, None), ("s", "2", "Read", None, None)], "session_id string, tool_use_id string, tool_name string, duration_ms double, status string")
    results = spark.createDataFrame([("1", True, 5.0), ("2", False, 7.0)], "tool_use_id string, is_error boolean, duration_ms double")
    assert rows(analytics.tool_stats_with_results(calls, results).select("call_count", "avg_duration_ms", "error_count")) == [(2, 6.0, 1)]


def test_session_summary(spark):
    sessions = spark.createDataFrame([("s",), ("empty",)], "session_id string")
    actions = spark.createDataFrame([("s", "1", "user_message"), ("s", "2", "tool_call"), ("s", "3", "assistant_message")], "session_id string, action_id string, action_type string")
    got = {r[0]: r[1:5] for r in rows(analytics.session_summary(sessions, actions))}
    assert got == {"s": (3, 1, 1, 1), "empty": (0, 0, 0, 0)}


def test_sequence(spark):
    a = spark.createDataFrame([("s", "a", "tool_call", 1), ("s", "b", "tool_result", 2), ("s", "c", "user_message", 3)], "session_id string, action_id string, action_type string, timestamp int")
    parents = spark.createDataFrame([("a", "b")], "parent string, child string")
    got = {r["action_id"]: (r["next_action_id"], r["children"]) for r in analytics.action_sequence(a, parents).collect()}
    assert got == {"a": ("b", ["b"]), "b": ("c", []), "c": (None, [])}


def test_status_counts(spark):
    d = spark.createDataFrame([("processed",), ("processed",), ("pending",), ("failed",), ("odd",)], "status string")
    got = dict(rows(analytics.status_counts(d, ["pending", "processing", "processed", "failed"])))
    assert got == {"pending": 1, "processing": 0, "processed": 2, "failed": 1, "all": 4}


def test_paginate_clamps(spark):
    d = spark.range(300).select(F.col("id").cast("string").alias("id"), F.col("id").alias("updated_at"), F.lit(0).alias("created_at"), F.lit("").alias("file_path"))
    page, total = analytics.paginate(d, page=0, size=1000, sort="nonsense")
    assert page.count() == 200 and total.first()[0] == 300
    assert page.first()["updated_at"] == 299


def test_end_sessions(spark):
    s = spark.createDataFrame([("s", "active", None, None, None, None)], "session_id string, status string, total_cost_usd double, total_input_tokens long, total_output_tokens long, ended_at string")
    e = spark.createDataFrame([("s", "t1", "completed", 0.05, 1000, 500)], "session_id string, timestamp string, status string, total_cost_usd double, total_input_tokens long, total_output_tokens long")
    assert rows(analytics.end_sessions(s, e)) == [("s", "completed", 0.05, 1000, 500, "t1")]


VECTORS = [("cat", [1.0, 0.0, 0.0, 0.0]), ("kitten", [0.8, 0.6, 0.0, 0.0]), ("dog", [0.0, 0.0, 1.0, 0.0]), ("car", [0.0, 0.0, 0.0, 1.0]), ("none", None)]


@pytest.mark.parametrize(("k", "threshold", "want"), [(5, 0.2, ["cat", "kitten"]), (5, 0.95, ["cat"]), (1, None, ["cat"])])
def test_knn(spark, k, threshold, want):
    v = spark.createDataFrame(VECTORS, "id string, embedding array<double>")
    got = vector.knn(v, [1.0, 0.0, 0.0, 0.0], k, threshold).collect()
    assert [r["id"] for r in got] == want
    assert got[0]["distance"] == pytest.approx(1.0) and "embedding" not in got[0]


def test_knn_batch_is_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    m[7] = m[8]
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "id long, embedding array<double>")
    q = v.where("id < 5").withColumnRenamed("id", "query_id")
    n = m / np.linalg.norm(m, axis=1)[:, None]
    want = {(i, j) for i in range(5) for j in sorted(range(60), key=lambda j: (-(n[i] @ n[j]), j))[:3]}
    assert {(r["query_id"], r["id"]) for r in vector.knn_batch(v, q, 3, block=16).collect()} == want
    assert {(r["query_id"], r["id"]) for r in vector.knn_batch(v, q, 3, most=100).collect()} == want


def test_bfs_is_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    near = {0: 0}
    front = [0]
    for k in range(1, 11):
        new = {b for a, b in [*edges, *[(b, a) for a, b in edges]] if a in front} - set(near)
        near |= {x: k for x in new}
        front = list(new)
    got = dict(rows(pattern.bfs(df, spark.createDataFrame([(0,)], "id long"))))
    assert got == near


def test_degree_counts_loops_twice(spark):
    assert rows(pattern.degree(spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")).orderBy("id")) == [(1, 3), (2, 1)]


def test_lookups(spark):
    t = spark.createDataFrame([("doc-1", "a"), ("doc-2", "b")], "id string, data string")
    ids = spark.createDataFrame([(0, "doc-1"), (1, "missing"), (2, "doc-2")], "pos int, id string")
    got = stores.kv_get(t, ids).orderBy("pos").collect()
    assert [r["data"] for r in got] == ["a", None, "b"]
    assert rows(stores.kv_missing(t, spark.createDataFrame([("doc-1",), ("doc-3",), ("doc-3",)], "id string"))) == [("doc-3",)]


def test_match_follows_and_returns(spark):
    g = pattern.PropertyGraph()
    g.add_nodes("Person", spark.createDataFrame([("Alice", 30), ("Bob", 25)], "name string, age int"), "name").add_nodes("Company", spark.createDataFrame([("C",)], "name string"), "name")
    g.add_edges("KNOWS", "Person", spark.createDataFrame([("Alice", "Bob", 2020)], "src string, dst string, since int"), "Person").add_edges("WORKS_AT", "Person", spark.createDataFrame([("Bob", "C")], "src string, dst string"), "Company")
    assert rows(g.match("Person", "KNOWS", "WORKS_AT").select("n0_name", "n2_name")) == [("Alice", "C")]
    assert rows(g.match("Company", "<WORKS_AT", "<KNOWS").select("n2_name")) == [("Alice",)]
    assert {r["name"]: r["n"] for r in g.counts().collect()} == {"Person": 2, "Company": 1, "KNOWS": 1, "WORKS_AT": 1}


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id int, v string, created int")
    new = spark.createDataFrame([(2, "x", 20), (2, "y", 21), (3, None, 22), (None, "z", 23)], "id int, v string, created int")
    assert sorted(rows(write.merge_first(old, new, ["id"], ["created"]))) == [(1, "a", 10), (2, "b", 10), (3, None, 22)]
    last = write.merge_last(old, new, ["id"], ["created"], keep=["created"])
    assert sorted(rows(last)) == [(1, "a", 10), (2, "y", 10), (3, None, 22)]
    again = write.merge_last(last, new, ["id"], ["created"], keep=["created"])
    assert sorted(rows(again)) == sorted(rows(last))
    assert sorted(rows(write.patch(old, spark.createDataFrame([(1, None, 5), (9, "q", 1)], "id int, v string, created int"), ["id"]))) == [(1, "a", 5), (2, "b", 10)]
    with pytest.raises(write.UniqueViolation):
        write.create(old, old.limit(1), ["id"])


def test_detach_delete(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id int")
    edges = spark.createDataFrame([(1, 2), (2, 2), (1, 1)], "src int, dst int")
    kept, (left,) = write.detach_delete(nodes, "id", [edges], spark.createDataFrame([(2,)], "id int"))
    assert rows(kept) == [(1,)] and rows(left) == [(1, 1)]


def test_versioned_table(spark, tmp_path):
    t = write.VersionedTable(spark, str(tmp_path / "t"))
    assert t.version() is None
    t.write(spark.range(2), 0)
    t.write(spark.range(3), 1)
    t.write(spark.range(9), 1)
    assert t.version() == 1 and t.read().count() == 3
    assert t.drop()["status"] == "success" and t.version() is None


def test_kv_upsert_keeps_creation(spark):
    empty = spark.createDataFrame([], "id string, data string, created_at long, updated_at long")
    one = stores.kv_upsert(empty, spark.createDataFrame([("a", "1")], "id string, data string"), 5)
    two = stores.kv_upsert(one, spark.createDataFrame([("a", "2"), ("b", "3")], "id string, data string"), 9)
    assert sorted(rows(two)) == [("a", "2", 5, 9), ("b", "3", 9, 9)]


def test_memories(spark):
    m = spark.createDataFrame([("1", "u", "likes green tea", 1), ("2", "u", "green green grass", 2), ("3", "v", "tea", 3)], "memory_id string, user_id string, content string, created_at int")
    assert [r["memory_id"] for r in text_search.search_memories(m, "u", "green").collect()] == ["2", "1"]
    assert rows(text_search.search_memories(m, "u", "   ")) == []
    new, changed = stores.update_memory(m, "9", "x")
    assert changed.isEmpty() and new.count() == 3
    assert stores.doc_by(m, "content", "unknown_source").isEmpty()


def test_usage(spark):
    u = spark.createDataFrame([("s", "k", 2, "b"), ("s", "k", 1, "a"), ("s", "j", 5, "c")], "session_id string, skill string, at int, action string")
    got = {r["skill"]: (r["first_access"], r["last_access"], r["access_count"], r["actions"]) for r in skills.usage(u).collect()}
    assert got == {"k": (1, 2, 2, ["a", "b"]), "j": (5, None, 1, ["c"])}


def test_skills(spark):
    s = spark.createDataFrame([("Alpha",), ("beta",)], "name string")
    d = skills.add_dependency(spark.createDataFrame([], "src string, dst string"), s, spark.createDataFrame([("Alpha", "beta"), ("Alpha", "gone"), ("Alpha", "beta")], "src string, dst string"))
    assert rows(skills.dependencies(s, d, "Alpha")) == [("beta",)] and rows(skills.dependents(s, d, "beta")) == [("Alpha",)]
    assert rows(skills.search_by_name(s, "ALP")) == [("Alpha",)]


def test_sentences(spark):
    t = "First sentence. Second sentence! Third sentence? Fourth sentence."
    want = ["First sentence.", "Second sentence!", "Third sentence?", "Fourth sentence."]
    df = spark.createDataFrame([(t,), ("Hi. OK.",), ("",), (None,)], "t string")
    assert evals.split_sentences(t) == want
    assert [r[0] for r in df.select(evals.sentences("t")).collect()] == [want, [], [], None]
    got = evals.coherence(df, "t").collect()
    assert [r["n_sentences"] for r in got] == [4, 0, 0, 0] and 0 <= got[0]["coherence"] <= 1 and got[1]["coherence"] == 0


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(S.tool_server(F.lit("mcp__playwright__browser_click"))) == "playwright" and val(S.tool_operation(F.lit("mcp__playwright__browser_click"))) == "browser_click"
    assert val(S.iso_local_time(F.lit("2024-01-15 10:30:45").cast("timestamp_ntz"))) == "10:30:45.000000000"
    assert val(S.iso_local_datetime(F.lit("2024-01-15 10:30:45").cast("timestamp_ntz"))) == "2024-01-15T10:30:45.000000000"
    for micros, want in ((122_330_000, "PT2M2.33S"), (0, "PT0S"), (3_600_000_000, "PT1H"), (500_000, "PT0.5S"), (61_000_000, "PT1M1S")):
        assert val(S.iso_duration(F.lit(micros))) == want
    assert val(S.full_match(F.lit("abc"), "b")) is False and val(S.full_match(F.lit("abc"), "a.c")) is True
    assert S.search_pattern("a(") == r"(?i)a\("
    assert val(S.fenced_block(F.lit("x\n```sql\nselect 1\n```\ny"))) == "sql\nselect 1\n"
    assert val(S.valid_session_id(F.lit("a b"))) is False
    assert val(S.valid_skill(F.lit("a--b"), F.lit("x"))) is False and val(S.valid_skill(F.lit("a-b"), F.lit("x"), F.lit(None).cast("string"))) is True
    assert S.parse_frontmatter("---\nname: x\ntools:\n- a\n- b\n---\nbody") == {"name": "x", "tools": ["a", "b"]}
    assert S.nested_strings({"a": [{"skill": "s"}], "b": '{"skill": "t"}'}, {"skill"}) == ["s", "t"]


def test_chunks(spark):
    d = spark.createDataFrame([(1, "a\n\nb\na"), (2, "a\nb"), (3, None)], "doc_id int, text string")
    c = chunks.split_chunks(d, "doc_id", "text")
    assert [r["text"] for r in c.orderBy("doc_id", "pos").collect()] == ["a", "b", "a", "a", "b"]
    assert chunks.chunk_nodes(c, "doc_id").count() == 2 and chunks.next_chain(c, "doc_id").count() == 2
    assert [r["text"] for r in chunks.split_chunks(spark.createDataFrame([(1, "abcde")], "doc_id int, text string"), "doc_id", "text", size=2).orderBy("text").collect()] == ["ab", "cd", "e"]
    html = "<html><head><title>t</title></head><body><script>x</script><p>One &amp; two</p><p>Three</p></body>"
    assert spark.range(1).select(chunks.strip_html(F.lit(html))).first()[0] == "One & two\nThree"
    assert chunks.workspace(None, " ", "base") == "base" and chunks.workspace("w", "d") == "w"


def test_graph_documents(spark):
    node = lambda i: {"id": i, "type": "T", "properties": {"p": i}}
    d = spark.createDataFrame([([node("lonely")], [{"source": node("a"), "target": node("b"), "type": "likes to", "properties": {}}], {"page_content": "text", "metadata": {}})], graph_documents.SCHEMA)
    g = graph_documents.ingest(d, base_label="Entity")
    assert {r["id"] for r in g["nodes"].collect()} == {"lonely", "a", "b"} and g["nodes"].first()["labels"] == ["Entity", "T"]
    assert rows(g["edges"]) == [("a", "LIKES_TO", "b")]
    assert [r["id"] for r in g["mentions"].collect()] == ["a"]


def test_procedures(spark):
    from ctxweave.functions.procedures import standard

    p = standard()
    assert p.listing(spark).count() == 9 and p.listing(spark, "graph").count() == 0 and p.listing(spark, r"graph\..*").count() == 2
    assert p.call("graph.degree", spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 2
    with pytest.raises(LookupError):
        p.call("nothing")


def test_entities(spark):
    from ctxweave.operators import entities

    c = spark.createDataFrame([("h", "Ada Lovelace met Charles Babbage. Nothing else."), ("e", None)], "hash string, text string")
    g = entities.extract(c)
    assert {r["name"] for r in g["entities"].collect()} == {"Ada Lovelace", "Charles Babbage"} and rows(g["relations"].select("src", "dst")) == [("Ada Lovelace", "Charles Babbage")]
    linked = chunks.mentioned_in(g["entities"], c)
    assert linked.count() == 2


def test_cells_give_the_exact_neighbours(spark):
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.normal(size=(150, 16)), rng.normal(size=(5, 16)).repeat(30, axis=0) + rng.normal(size=(150, 16)) * 0.05])
    v = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)] + [(900, None), (901, [0.0] * 16), (902, m[3].tolist())], "id long, embedding array<double>")
    q = spark.createDataFrame([(k, (m[k] + rng.normal(size=16) * 0.3).tolist()) for k in range(0, 300, 9)] + [(500, None), (501, [0.0] * 16)], "query_id long, embedding array<double>")
    want = sorted((r["query_id"], r["id"], round(r["distance"], 9), r["rank"]) for r in vector.knn_batch(v, q, 7).collect())
    for cells, probe in ((40, 3), (3, 1), (1000, 1)):
        index = vector.cell_index(v, cells)
        got = sorted((r["query_id"], r["id"], round(r["distance"], 9), r["rank"]) for r in vector.knn_cells(index, q, 7, probe=probe).collect())
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in want] and all(abs(x[2] - y[2]) < 1e-8 for x, y in zip(got, want))
    assert vector.knn_cells(vector.cell_index(v.limit(0)), q).count() == 0 and vector.knn_cells(index, q, 1000).where("query_id = 0").count() == 301


def test_skill_detection(spark):
    from ctxweave.streaming.events import ENVELOPE, FIELDS

    def event(**kw):
        return tuple(kw.get(f) for f in FIELDS)

    e = spark.createDataFrame(
        [
            event(event_type="tool_start", session_id="s", timestamp="1", tool_name="Skill", tool_input='{"skill": "pdf"}'),
            event(event_type="tool_start", session_id="s", timestamp="2", tool_name="Read", tool_input='{"file_path": "/x/docx/SKILL.md"}'),
            event(event_type="tool_end", session_id="s", timestamp="3", tool_name="Read", result="---\nname: docx\n---\nbody"),
            event(event_type="message", session_id="s", timestamp="4", content="/pdf make one"),
            event(event_type="message", session_id="s", timestamp="5", content="/unknown thing"),
        ],
        ENVELOPE,
    )
    uses = skills.detect_usage(e, spark.createDataFrame([("pdf",), ("docx",)], "name string"))
    assert {(r["skill"], r["action"]) for r in uses.collect()} == {("pdf", "load"), ("docx", "read"), ("docx", "content"), ("pdf", "expand")}
    got = {r["skill"]: r["access_count"] for r in skills.usage(uses).collect()}
    assert got == {"pdf": 2, "docx": 2}


def test_skills_in_results_and_messages(spark):
    from ctxweave.streaming.events import ENVELOPE, FIELDS
    def event(**kw):
        return tuple(kw.get(f) for f in FIELDS)

    listed = '[{"type": "text", "text": "{\\"skills\\": [{\\"name\\": \\"pdf\\"}, {\\"name\\": \\"other\\"}]}"}]'
    e = spark.createDataFrame(
        [
            event(event_type="tool_end", session_id="s", timestamp="1", tool_name="mcp__skills__list_skills", result=listed),
            event(event_type="tool_end", session_id="s", timestamp="2", tool_name="search_by_name", result='[{"name": "docx"}]'),
            event(event_type="tool_end", session_id="s", timestamp="3", tool_name="Bash", result='[{"name": "docx"}]'),
            event(event_type="message", session_id="s", timestamp="4", content="---\nname: fresh\n---\nbody"),
        ],
        ENVELOPE,
    )
    uses = skills.detect_usage(e, spark.createDataFrame([("pdf",), ("docx",)], "name string"))
    assert {(r["skill"], r["action"]) for r in uses.collect()} == {("pdf", "list_skills_result"), ("docx", "search_by_name_result"), ("fresh", "prompt_expansion")}


def test_delete_skill_and_memory(spark):
    s, d = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    used = spark.createDataFrame([("s", "a")], "session_id string, skill string")
    kept, deps, left, n = skills.delete_skill(s, d, used, "a")
    assert rows(kept) == [("b",)] and deps.isEmpty() and left.isEmpty() and n.first()[0] == 1
    m = spark.createDataFrame([], "memory_id string, user_id string, content string, created_at int")
    e = spark.createDataFrame([], "src string, dst string")
    new = spark.createDataFrame([("1", "u", "x", 1, "s"), ("2", "u", "y", 2, None)], "memory_id string, user_id string, content string, created_at int, session_id string")
    kept, owns, produced = stores.save_memory(m, e, e, new)
    assert kept.count() == 2 and owns.count() == 2 and rows(produced) == [("s", "1")]
