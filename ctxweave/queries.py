"""The registered queries over the test tables, each beside the SQL that it equals.

Sessions are users of `events` (a tool call each) or conversations (a message each); the
relational source is the star schema; documents give chunks, records and statuses; the
vectors of `embeddings` and their labels form a bipartite graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxweave.functions import procedures
from ctxweave.functions import scalars as S
from ctxweave.operators import analytics, chunks, entities, evals, graph_documents, pattern, skills, stores, text_search, vector, write
from ctxweave.plans import ingest, schema
from ctxweave.plans.catalogue import Catalogue
from ctxweave.plans.model import GraphModel, model_tables
from ctxweave.runtime import prepare, table
from ctxweave.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- bindings ---

FAILED = "CAST(json_extract_string(props, '$.k') AS INT) < 10"


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    failed = F.get_json_object("props", "$.k").cast("int") < 10
    return table(spark, d, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").cast("string").alias("action_id"), F.lit("tool_call").alias("action_type"), F.col("ts").alias("timestamp"), F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), F.when(failed, "failed").otherwise("completed").alias("status")
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.concat_ws("-", "conv_id", "turn").alias("action_id"), F.concat("role", F.lit("_message")).alias("action_type"), F.col("turn").alias("timestamp"), "role", "text")


def doc_status(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    status = F.when(F.col("toxic").isNull(), "pending").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "processed").otherwise("processing")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), status.alias("status"), F.col("source").alias("track_id"), F.col("n_chars").alias("updated_at"), F.col("doc_id").alias("created_at"), F.col("lang").alias("file_path"))


DOC_STATUS = """SELECT d.doc_id AS id, CASE WHEN l.toxic IS NULL THEN 'pending' WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'processed' ELSE 'processing' END AS status,
    d.source AS track_id, d.n_chars AS updated_at, d.doc_id AS created_at, d.lang AS file_path FROM documents d LEFT JOIN labels l USING (doc_id)"""


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


CHUNKS = """SELECT doc_id, pos, sha256(t) AS hash, t AS text FROM (
    SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS pos, unnest(p) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(t) <> ''"""

PRIMARY = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}
FOREIGN = {
    "nation": [("n_regionkey", "region", "r_regionkey")],
    "customer": [("c_nationkey", "nation", "n_nationkey")],
    "supplier": [("s_nationkey", "nation", "n_nationkey")],
    "orders": [("o_custkey", "customer", "c_custkey")],
    "lineitem": [("l_orderkey", "orders", "o_orderkey"), ("l_partkey", "part", "p_partkey"), ("l_suppkey", "supplier", "s_suppkey")],
}
ENTITIES = ("region", "nation", "customer", "supplier", "part", "orders")


def frames(spark: SparkSession, d: str, names: tuple[str, ...] = (*ENTITIES, "lineitem")) -> dict[str, DataFrame]:
    return {n: table(spark, d, n) for n in names}


def star_model(spark: SparkSession, d: str) -> tuple[GraphModel, Catalogue, dict[str, DataFrame]]:
    f = frames(spark, d)
    c = Catalogue.from_frames(f, PRIMARY, FOREIGN)
    return model_tables(c), c, f


def vector_edges(spark: SparkSession, d: str) -> DataFrame:
    """vec - label: labels are negative ids."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("src"), (-F.col("label") - 1).cast("long").alias("dst"))


VECTOR_EDGES = "SELECT vec_id AS src, CAST(-label - 1 AS BIGINT) AS dst FROM embeddings"

# --- analytics ---


@query("q01_tool_usage_stats", f"""SELECT event_type AS tool_name, starts_with(event_type, 'mcp__') AS is_mcp, CAST(NULL AS VARCHAR) AS mcp_server, count(*) AS call_count, round(avg(value), 6) AS avg_duration_ms,
    CAST(sum(CASE WHEN {FAILED} THEN 1 ELSE 0 END) AS BIGINT) AS error_count FROM events GROUP BY 1""")
def q01(spark, d):
    return analytics.tool_stats(tool_calls(spark, d)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("q02_tool_usage_stats_session", f"""SELECT event_type AS tool_name, starts_with(event_type, 'mcp__') AS is_mcp, CAST(NULL AS VARCHAR) AS mcp_server, count(*) AS call_count, round(avg(value), 6) AS avg_duration_ms,
    CAST(sum(CASE WHEN {FAILED} THEN 1 ELSE 0 END) AS BIGINT) AS error_count FROM events WHERE user_id = 7 GROUP BY 1""")
def q02(spark, d):
    return analytics.tool_stats(tool_calls(spark, d), 7).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


SUMMARY = """SELECT s.session_id, count(a.conv_id) AS total_actions, CAST(0 AS BIGINT) AS tool_calls, count(*) FILTER (WHERE a.role = 'user') AS user_messages,
    count(*) FILTER (WHERE a.role = 'assistant') AS assistant_messages, CAST(0 AS BIGINT) AS errors FROM (SELECT DISTINCT conv_id AS session_id FROM conversations) s LEFT JOIN {} a ON a.conv_id = s.session_id GROUP BY 1"""


@query("q03_session_summary", SUMMARY.format("conversations"))
def q03(spark, d):
    m = messages(spark, d)
    return analytics.session_summary(m.select("session_id").distinct(), m)


@query("q04_session_summary_empty", SUMMARY.format("(SELECT * FROM conversations WHERE role = 'system')"))
def q04(spark, d):
    m = messages(spark, d)
    return analytics.session_summary(m.select("session_id").distinct(), m.where("role = 'system'"))


@query("q05_session_tool_histogram", "SELECT user_id AS session_id, event_type AS tool_name, count(*) AS n FROM events GROUP BY 1, 2")
def q05(spark, d):
    return analytics.tool_histogram(tool_calls(spark, d))


@query("q06_list_sessions_recent", "SELECT user_id AS session_id, max(ts) AS started_at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def q06(spark, d):
    return analytics.list_sessions(table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("started_at")))


@query("q07_session_actions_filtered", "SELECT CAST(event_id AS VARCHAR) AS action_id, ts, event_type FROM events WHERE user_id = 7 AND event_type = (SELECT min(event_type) FROM events) ORDER BY ts, event_id LIMIT 1000")
def q07(spark, d):
    calls = tool_calls(spark, d).withColumn("action_type", F.col("tool_name"))
    first = table(spark, d, "events").agg(F.min("event_type").alias("t"))
    return analytics.session_actions(calls.join(F.broadcast(first), calls["tool_name"] == first["t"]).drop("t"), 7).select("action_id", F.col("timestamp").alias("ts"), F.col("tool_name").alias("event_type"))


@query("q08_last_action_per_session", "SELECT user_id AS session_id, CAST(arg_max(event_id, ts) AS VARCHAR) AS action_id, max(ts) AS timestamp FROM events GROUP BY 1")
def q08(spark, d):
    return analytics.last_action(tool_calls(spark, d))


@query("q09_followed_by_edges", "SELECT CAST(event_id AS VARCHAR) AS prev, CAST(n AS VARCHAR) AS curr FROM (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NOT NULL")
def q09(spark, d):
    return analytics.followed_by(tool_calls(spark, d))


PARENTS = "SELECT a.conv_id || '-' || a.turn AS parent, b.conv_id || '-' || b.turn AS child FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'"


def parent_edges(spark: SparkSession, d: str) -> DataFrame:
    m = messages(spark, d)
    w = Window.partitionBy("session_id").orderBy("timestamp")
    before = m.select("action_id", "role", F.lag("action_id").over(w).alias("parent"), F.lag("role").over(w).alias("r"))
    return before.where("role = 'assistant' and r = 'user'").select("parent", F.col("action_id").alias("child"))


@query("q10_action_sequence", f"""WITH p AS ({PARENTS}), c AS (SELECT parent, list_sort(list(child)) AS children FROM p GROUP BY 1)
    SELECT m.conv_id AS session_id, m.conv_id || '-' || m.turn AS action_id, m.role || '_message' AS action_type, lead(m.conv_id || '-' || m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn) AS next_action_id,
    coalesce(c.children, []) AS children FROM conversations m LEFT JOIN c ON c.parent = m.conv_id || '-' || m.turn""")
def q10(spark, d):
    return analytics.action_sequence(messages(spark, d), parent_edges(spark, d))


@query("q11_parent_of_edges", PARENTS)
def q11(spark, d):
    return parent_edges(spark, d)


@query("q12_stable_action_ids", "SELECT conv_id, turn, substr(sha256(CAST(conv_id AS VARCHAR) || chr(0) || role || chr(0) || CAST(turn AS VARCHAR)), 1, 32) AS action_id FROM conversations")
def q12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.stable_id("conv_id", "role", "turn").alias("action_id"))


@query("q13_forked_sessions", """WITH s AS (SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN conv_id // 2 END AS parent_session_id FROM conversations)
    SELECT s.session_id, p.session_id AS parent FROM s LEFT JOIN s p ON p.session_id = s.parent_session_id""")
def q13(spark, d):
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    forks = s.where("session_id % 3 = 0").select(F.col("session_id").alias("src"), F.expr("session_id div 2").alias("dst"))
    return pattern.expand(s, "session_id", forks, s.select(F.col("session_id").alias("parent")), "parent", how="left")


@query("q14_optional_match", """SELECT c.c_custkey, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS total FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def q14(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("total"))
    return table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("q15_two_hop_path", "SELECT c_custkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def q15(spark, d):
    g = pattern.PropertyGraph()
    g.add_nodes("Customer", table(spark, d, "customer").select("c_custkey"), "c_custkey").add_nodes("Order", table(spark, d, "orders").select("o_orderkey"), "o_orderkey").add_nodes("Part", table(spark, d, "part").select("p_partkey"), "p_partkey")
    g.add_edges("PLACED", "Customer", table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), "Order")
    g.add_edges("CONTAINS", "Order", table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), "Part")
    return g.match("Customer", "PLACED", "CONTAINS").groupBy(F.col("n0_c_custkey").alias("c_custkey")).agg(F.count("*").alias("lines"), F.count_distinct("n2_p_partkey").alias("parts"))


@query("q16_reverse_expand", "SELECT p_partkey, count(DISTINCT l_orderkey) AS in_degree FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def q16(spark, d):
    edges = write.merge_edges(None, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))
    return table(spark, d, "part").select("p_partkey").join(edges, F.col("p_partkey") == F.col("dst")).groupBy("p_partkey").agg(F.count("*").alias("in_degree"))


# --- lookups, records, writes ---


@query("q17_filter_keys_missing", "SELECT DISTINCT i AS id FROM (SELECT doc_id * 2 AS i FROM documents) WHERE i NOT IN (SELECT doc_id FROM documents)")
def q17(spark, d):
    docs = table(spark, d, "documents")
    return pattern.missing(docs, "doc_id", docs.select((F.col("doc_id") * 2).alias("i")), "i")


@query("q18_aligned_multi_get", "SELECT pos, requested, doc_id, source FROM (SELECT turn AS pos, conv_id * 7 AS requested FROM conversations WHERE turn = 0 OR turn = 1) LEFT JOIN documents ON doc_id = requested")
def q18(spark, d):
    ids = table(spark, d, "conversations").where("turn = 0 or turn = 1").select(F.col("turn").alias("pos"), (F.col("conv_id") * 7).alias("i"))
    return pattern.aligned_lookup(table(spark, d, "documents").select("doc_id", "source"), "doc_id", ids, "i", "pos")


@query("q19_in_set_lookup", "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q19(spark, d):
    return pattern.lookup(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id", table(spark, d, "labels").where("toxic = 1"), "doc_id")


@query("q20_disjunctive_endpoint_delete", f"SELECT src, dst FROM ({VECTOR_EDGES}) WHERE NOT (src = 3 OR dst = -2)")
def q20(spark, d):
    e = vector_edges(spark, d)
    return e.where(~((F.col("src") == 3) | (F.col("dst") == -2)))


@query("q21_merge_first_write", f"SELECT hash, min(doc_id) AS first_doc FROM ({CHUNKS}) GROUP BY 1")
def q21(spark, d):
    c = line_chunks(spark, d).select("hash", F.col("doc_id").alias("first_doc"), "pos")
    return write.merge_first(c.limit(0), c, ["hash"], ["first_doc", "pos"]).select("hash", "first_doc")


@query("q22_merge_last_write", """WITH o AS (SELECT c_custkey AS id, c_name AS name, CAST(1 AS BIGINT) AS created_at FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS name FROM orders GROUP BY 1)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(o.created_at, 2) AS created_at FROM o FULL JOIN n ON o.id = n.id""")
def q22(spark, d):
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).cast("long").alias("created_at"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), F.lit(2).cast("long").alias("created_at"), "o_orderkey")
    return write.merge_last(old, new, ["id"], ["o_orderkey"], keep=["created_at"])


@query("q23_kv_upsert", """WITH o AS (SELECT doc_id AS id, lang AS data FROM documents WHERE doc_id % 2 = 0), n AS (SELECT doc_id AS id, source AS data FROM documents WHERE doc_id % 3 = 0)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.data, o.data) AS data, CAST(CASE WHEN o.id IS NULL THEN 200 ELSE 100 END AS BIGINT) AS created_at, CAST(CASE WHEN n.id IS NULL THEN 100 ELSE 200 END AS BIGINT) AS updated_at FROM o FULL JOIN n ON o.id = n.id""")
def q23(spark, d):
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.col("lang").alias("data"), F.lit(100).cast("long").alias("created_at"), F.lit(100).cast("long").alias("updated_at"))
    return stores.kv_upsert(old, docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.col("source").alias("data")), 200)


@query("q24_merge_edge_dedupe", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem")
def q24(spark, d):
    return write.merge_edges(None, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")))


@query("q25_partial_patch", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'low' END, d.source) AS source, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def q25(spark, d):
    changes = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "low").alias("source"))
    return write.patch(table(spark, d, "documents").select("doc_id", "source", "lang"), changes, ["doc_id"])


@query("q26_detach_delete", "SELECT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def q26(spark, d):
    c = table(spark, d, "customer")
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    # orders' keys aren't customers', so only src is a node of this label
    gone = c.where("c_nationkey = 3").select("c_custkey")
    return write.delete(edges, gone.select(F.col("c_custkey").alias("src")), ["src"])


@query("q27_skill_usage_rollup", """SELECT user_id AS session_id, event_type AS skill, min(ts) AS first_access, CASE WHEN count(*) > 1 THEN max(ts) END AS last_access, count(*) AS access_count,
    list(CAST(event_id AS VARCHAR) ORDER BY ts, event_id) AS actions FROM events GROUP BY 1, 2""")
def q27(spark, d):
    return skills.usage(table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("skill"), F.col("ts").alias("at"), F.col("event_id").cast("string").alias("action")))


@query("q28_skill_search_ci", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'part 1') OR contains(lower(p_name), 'e')")
def q28(spark, d):
    return table(spark, d, "part").where(S.contains_ci("p_name", "PART 1") | S.contains_ci("p_name", "E")).select("p_partkey", "p_name")


@query("q29_skill_dependencies", "SELECT n_name AS name, 'dependency' AS direction FROM nation WHERE n_regionkey = 1 UNION ALL SELECT r_name, 'dependent' FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey = 5")
def q29(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    names = n.select(F.col("n_name").alias("name")).union(r.select(F.col("r_name").alias("name")))
    deps = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_regionkey", "n_nationkey")
    out = names.join(deps.where("n_regionkey = 1").select(F.col("n_name").alias("name")), "name", "left_semi").select("name", F.lit("dependency").alias("direction"))
    return out.union(names.join(deps.where("n_nationkey = 5").select(F.col("r_name").alias("name")), "name", "left_semi").select("name", F.lit("dependent").alias("direction")))


@query("q30_doc_status_counts_dense", f"""WITH s AS ({DOC_STATUS}), k AS (SELECT unnest(['pending', 'processing', 'preprocessed', 'processed', 'failed']) AS status),
    c AS (SELECT k.status, count(s.id) AS n FROM k LEFT JOIN s ON s.status = k.status GROUP BY 1) SELECT * FROM c UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM c""")
def q30(spark, d):
    return analytics.status_counts(doc_status(spark, d), list(stores.STATUSES))


@query("q31_docs_paginated", f"SELECT * FROM ({DOC_STATUS}) ORDER BY updated_at DESC, id DESC LIMIT 50 OFFSET 50")
def q31(spark, d):
    return analytics.paginate(doc_status(spark, d), page=2, size=50)[0]


@query("q32_docs_by_status_in", f"SELECT * FROM ({DOC_STATUS}) WHERE status IN ('failed', 'processing')")
def q32(spark, d):
    return stores.docs_by_status(doc_status(spark, d), "failed", "processing")


@query("q33_memories_newest", "SELECT d.doc_id AS memory_id, d.source AS user_id, d.n_chars AS created_at, c.conv_id AS source_session FROM documents d LEFT JOIN (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0) c ON c.conv_id = d.doc_id WHERE d.source = 'src3'")
def q33(spark, d):
    m = table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.col("source").alias("user_id"), F.col("n_chars").alias("created_at"))
    made = table(spark, d, "conversations").where("conv_id % 2 = 0").select(F.col("conv_id").alias("memory_id"), F.col("conv_id").alias("session_id")).distinct()
    return text_search.memories_newest(m, made, "src3")


# --- relational to graph ---


@query("q34_node_ingest_customer", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL")
def q34(spark, d):
    m, _, f = star_model(spark, d)
    return ingest.load_node(m.node("Customer"), f["customer"])


@query("q35_edge_ingest_fk", "SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def q35(spark, d):
    m, _, f = star_model(spark, d)
    return ingest.load_edge(m.edge("ORDERS_TO_CUSTOMER"), m, f)


@query("q36_edge_ingest_join_table", "SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part)")
def q36(spark, d):
    from ctxweave.plans.model import join_edge

    m, c, f = star_model(spark, d)
    return ingest.load_edge(join_edge(c, "lineitem", "l_orderkey", "l_partkey"), m, f)


COUNTS = " UNION ALL ".join(f"SELECT 'node' AS kind, '{t.title()}' AS name, count(*) AS n FROM {t}" for t in ENTITIES)


@query("q37_global_counts", f"{COUNTS} UNION ALL SELECT 'edge', 'PLACED', count(*) FROM orders WHERE o_custkey IS NOT NULL")
def q37(spark, d):
    g = pattern.PropertyGraph()
    for t in ENTITIES:
        g.add_nodes(t.title(), table(spark, d, t), PRIMARY[t][0])
    g.add_edges("PLACED", "Customer", table(spark, d, "orders").where("o_custkey is not null").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), "Orders")
    return g.counts()


DEVIATION = f"""WITH e AS (SELECT name, n AS expected, CASE name WHEN 'Customer' THEN n * 8 // 10 WHEN 'Part' THEN n - 1 ELSE n END AS actual FROM ({COUNTS}))
    SELECT name, expected, actual, CASE WHEN actual = expected THEN NULL WHEN abs(actual - expected) > 0.1 * greatest(expected, 1) THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM e"""


def deviations(spark: SparkSession, d: str) -> DataFrame:
    g = pattern.PropertyGraph()
    for t in ENTITIES:
        g.add_nodes(t.title(), table(spark, d, t), PRIMARY[t][0])
    e = g.counts().select("name", F.col("n").alias("expected"))
    actual = F.when(F.col("name") == "Customer", F.expr("expected * 8 div 10")).when(F.col("name") == "Part", F.col("expected") - 1).otherwise(F.col("expected"))
    return e.withColumn("actual", actual).withColumn("severity", ingest.count_severity(F.col("expected"), F.col("actual")))


@query("q38_expected_vs_actual", DEVIATION)
def q38(spark, d):
    return deviations(spark, d)


@query("q39_validation_score", f"""SELECT round(greatest(0.0, CAST(100 - (10 * count(*) FILTER (WHERE severity = 'CRITICAL') + 3 * count(*) FILTER (WHERE severity = 'WARNING') + 0) AS DOUBLE)), 2) AS score FROM ({DEVIATION})""")
def q39(spark, d):
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return deviations(spark, d).agg(n("CRITICAL").alias("c"), n("WARNING").alias("w")).select(ingest.score(F.col("c"), F.col("w"), F.lit(0)).alias("score"))


@query("q40_ingestion_plan", "SELECT * FROM (VALUES ('node', 'orders', 'rows added'), ('node', 'lineitem', 'count unknown'), ('edge', 'ORDERS_TO_CUSTOMER', 'an end is loaded'), ('edge', 'LINEITEM_TO_ORDERS', 'an end is loaded'), ('edge', 'LINEITEM_TO_PART', 'an end is loaded'), ('edge', 'LINEITEM_TO_SUPPLIER', 'an end is loaded')) t(kind, name, reason)")
def q40(spark, d):
    m, c, f = star_model(spark, d)
    counts = {r["name"].lower(): r["n"] for r in pattern.PropertyGraph({t.title(): (f[t], PRIMARY[t][0]) for t in ENTITIES}).counts().collect()}
    before = ingest.summary(m, {**counts, "orders": counts["orders"] - 1}, {"host": "local", "database": d, "type": "parquet"})
    nodes, edges = ingest.plan(before, m, counts)
    rows = [("node", k, v) for k, v in nodes.items()] + [("edge", k[1], v) for k, v in edges.items()]
    return spark.createDataFrame(rows, "kind string, name string, reason string")


PROFILE = " UNION ALL ".join(f"SELECT '{t}' AS label, '{c}' AS property, count({c}) AS non_null, count(*) AS total, CASE WHEN count(*) > 0 THEN 100.0 * count({c}) / count(*) ELSE 0 END::DOUBLE AS filling_factor FROM {t}" for t, cs in {"labels": ("doc_id", "quality", "toxic"), "documents": ("doc_id", "text", "lang", "source", "n_chars")}.items() for c in cs)


@query("q41_property_profile", PROFILE)
def q41(spark, d):
    p = schema.property_profile({t: table(spark, d, t) for t in ("labels", "documents")}, examples=0)
    return p.select("label", "property", "non_null", "total", F.col("filling_factor").cast("double").alias("filling_factor"))


VALUES = """SELECT v, CASE WHEN v IS NULL THEN 'Null' WHEN lower(v) IN ('true', 'false') THEN 'Boolean' WHEN regexp_matches(v, '^-?[0-9]+$') THEN 'Integer' WHEN regexp_matches(v, '^-?[0-9]+\\.[0-9]+([eE][-+]?[0-9]+)?$') THEN 'Double'
    WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}') THEN 'LocalDateTime' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'Date' WHEN regexp_matches(v, '^[0-9]{2}:[0-9]{2}(:[0-9]{2})?') THEN 'LocalTime' ELSE 'String' END AS type
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') FROM orders UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'true' END FROM orders)"""


@query("q42_value_type_detection", f"SELECT type, count(*) AS n FROM ({VALUES}) GROUP BY 1")
def q42(spark, d):
    o = table(spark, d, "orders")
    parts = [F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 0, "true")]
    return o.select(F.explode(F.array(*parts)).alias("v")).groupBy(S.value_type("v").alias("type")).agg(F.count("*").alias("n"))


NODES = "SELECT 'c' || c_custkey AS id, 'Customer' AS label FROM customer UNION ALL SELECT 'o' || o_orderkey, 'Order' FROM orders UNION ALL SELECT 'n' || n_nationkey, 'Nation' FROM nation"
EDGES = "SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS type FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN' FROM customer"


@query("q43_relationship_schema", f"WITH n AS ({NODES}), e AS ({EDGES}) SELECT a.label AS start, e.type, b.label AS \"end\", count(*) AS n FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst GROUP BY 1, 2, 3")
def q43(spark, d):
    c, o, n = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    tag = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    nodes = c.select(tag("c", "c_custkey").alias("id"), F.lit("Customer").alias("label")).union(o.select(tag("o", "o_orderkey"), F.lit("Order"))).union(n.select(tag("n", "n_nationkey"), F.lit("Nation")))
    edges = o.select(tag("c", "o_custkey").alias("src"), tag("o", "o_orderkey").alias("dst"), F.lit("PLACED").alias("type")).union(c.select(tag("c", "c_custkey"), tag("n", "c_nationkey"), F.lit("LIVES_IN")))
    return schema.relationship_schema(edges, nodes)


@query("q44_node_count_estimate", """WITH p AS (SELECT 'documents' AS label, 'text' AS property, count(*) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'labels', 'quality', count(*) FROM labels WHERE quality IS NOT NULL UNION ALL SELECT 'labels', 'toxic', count(*) FROM labels WHERE toxic = 1)
    SELECT label, max(n) AS estimate FROM p GROUP BY 1""")
def q44(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    values = docs.select(F.lit("documents").alias("label"), F.lit("text").alias("property"), F.when(F.col("text").isNull(), "Null").otherwise("String").alias("type")).union(labels.select(F.lit("labels"), F.lit("quality"), F.when(F.col("quality").isNull(), "Null").otherwise("Integer"))).union(labels.where("toxic = 1").select(F.lit("labels"), F.lit("toxic"), F.lit("Integer")))
    return schema.node_count_estimate(schema.typed_profile(values, "label", "property", "type"))


# --- chunks, vectors, search, traversal ---


@query("q45_chunk_split_hash", CHUNKS)
def q45(spark, d):
    return line_chunks(spark, d)


@query("q46_chunk_length_stats", f"SELECT count(*) AS n_chunks, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS avg_chars FROM ({CHUNKS})")
def q46(spark, d):
    return chunks.length_stats(line_chunks(spark, d)).withColumn("avg_chars", F.round("avg_chars", 6))


@query("q47_next_chain", f"SELECT DISTINCT src, dst FROM (SELECT hash AS src, lead(hash) OVER (PARTITION BY doc_id ORDER BY pos) AS dst FROM ({CHUNKS})) WHERE dst IS NOT NULL")
def q47(spark, d):
    return chunks.next_chain(line_chunks(spark, d), "doc_id")


@query("q48_entity_mentioned_in", f"SELECT DISTINCT e.entity_id, c.hash FROM (SELECT lang || ':' || source AS entity_id, sha256(string_split(text, chr(10))[1]) AS file_path FROM documents) e JOIN ({CHUNKS}) c ON e.file_path = c.hash")
def q48(spark, d):
    e = table(spark, d, "documents").select(F.concat_ws(":", "lang", "source").alias("entity_id"), S.content_hash(F.split("text", "\n")[0]).alias("file_path"))
    return chunks.mentioned_in(e, line_chunks(spark, d))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


SCORED = "SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS distance FROM embeddings"


@query("q49_knn_cosine_threshold", f"SELECT vec_id, label, round(distance, 6) AS distance FROM (SELECT * FROM ({SCORED}) ORDER BY distance DESC, vec_id LIMIT 10) WHERE distance >= 0.2")
def q49(spark, d):
    found = vector.knn(table(spark, d, "embeddings"), query_vector(spark, d), 10, 0.2, "vec_id")
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("q50_knn_batch_topk", """SELECT query_id, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id < 20) WHERE rank <= 5""")
def q50(spark, d):
    e = table(spark, d, "embeddings")
    out = vector.knn_batch(e.withColumnRenamed("vec_id", "id"), e.where("vec_id < 20").withColumnRenamed("vec_id", "query_id"), 5)
    return out.withColumn("distance", F.round("distance", 6))


@query("q51_vector_get_by_ids", "SELECT vec_id, len(embedding) AS dims FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels) AND embedding IS NOT NULL")
def q51(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return vector.vectors_by_ids(e, table(spark, d, "labels"), "doc_id").select(F.col("id").alias("vec_id"), F.size("embedding").cast("long").alias("dims"))


@query("q52_bfs_distances", f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({VECTOR_EDGES}) WHERE src % 3 <> 1 UNION SELECT dst, src FROM ({VECTOR_EDGES}) WHERE src % 3 <> 1),
    r(id, distance) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.b, r.distance + 1 FROM r JOIN e ON e.a = r.id WHERE r.distance < 4) SELECT id, min(distance) AS distance FROM r GROUP BY 1""")
def q52(spark, d):
    return pattern.bfs(vector_edges(spark, d).where("src % 3 <> 1"), spark.range(1).select(F.lit(0).cast("long").alias("id")), 4)


@query("q53_degree_topk", f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ({VECTOR_EDGES}) UNION ALL SELECT dst FROM ({VECTOR_EDGES})) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def q53(spark, d):
    return pattern.degree(vector_edges(spark, d)).orderBy(F.desc("degree"), "id").limit(5)


@query("q54_graph_rag", f"""WITH RECURSIVE s AS (SELECT vec_id FROM ({SCORED}) ORDER BY distance DESC, vec_id LIMIT 5), e AS (SELECT src AS a, dst AS b FROM ({VECTOR_EDGES}) UNION ALL SELECT dst, src FROM ({VECTOR_EDGES})),
    r(id, distance) AS (SELECT vec_id, 0 FROM s UNION SELECT e.b, r.distance + 1 FROM r JOIN e ON e.a = r.id WHERE r.distance < 2),
    m AS (SELECT id, min(distance) AS distance FROM r GROUP BY 1), g AS (SELECT a AS id, count(*) AS degree FROM e GROUP BY 1)
    SELECT m.id, g.degree FROM m JOIN g ON g.id = m.id WHERE m.distance > 0 AND m.id IN (SELECT CAST(-label - 1 AS BIGINT) FROM embeddings) ORDER BY degree DESC, m.id LIMIT 5""")
def q54(spark, d):
    e = table(spark, d, "embeddings")
    return vector.graph_rag(e, vector_edges(spark, d), query_vector(spark, d), e.select((-F.col("label") - 1).cast("long").alias("id")), id_column="vec_id")


@query("q55_bm25_search", """WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS a FROM w),
    t AS (SELECT doc_id, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, (SELECT unnest(['idiot', 'token', 'license']) AS term)), f AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1)
    SELECT doc_id, round(sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * t.l / c.a))), 6) AS score FROM t JOIN f USING (term), c WHERE t.tf > 0 GROUP BY 1""")
def q55(spark, d):
    return text_search.bm25(table(spark, d, "documents"), "Idiot token, LICENSE!", "doc_id", "text", None).select("doc_id", F.round("score", 6).alias("score"))


@query("q56_embed_in_batches")
def q56(spark, d):
    return vector.embed(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "embedding")


COLUMNS = {"customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}


@query("q57_schema_regex_search", " UNION ALL ".join(f"SELECT '{t}' AS label, '{c}' AS property" for t, cs in COLUMNS.items() for c in cs if "cust" in c or c.endswith("status")))
def q57(spark, d):
    rows = [(t, c) for t in COLUMNS for c in table(spark, d, t).columns]
    return schema.search_table(spark.createDataFrame(rows, "label string, property string"), "CUST|status$", ["property"])


@query("q58_label_subset_indexes", "SELECT i, n FROM (SELECT n_nationkey AS i, [n_regionkey, n_nationkey % 3] AS a FROM nation) x, (SELECT r_regionkey AS n, [r_regionkey, 0, 1] AS b FROM region) y WHERE len(list_filter(a, lambda v: NOT list_contains(b, v))) = 0")
def q58(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.array("n_regionkey", F.col("n_nationkey") % 3).alias("a"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("n"), F.array("r_regionkey", F.lit(0), F.lit(1)).alias("b"))
    return a.crossJoin(F.broadcast(b)).where(pattern.covers("a", "b")).select("i", "n")


@query("q59_sentence_split", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10)[1:100] AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS sentence FROM s""")
def q59(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(evals.sentences("text")).alias("pos", "sentence"))


@query("q60_coherence_from_vectors", """WITH p AS (SELECT label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[])) AS c FROM embeddings)
    SELECT label, count(c) AS n_pairs, round(coalesce((avg(c) + 1) / 2, 0), 6) AS coherence FROM p GROUP BY 1""")
def q60(spark, d):
    return evals.neighbour_coherence(table(spark, d, "embeddings"), "label", "vec_id").withColumn("coherence", F.round("coherence", 6))


@query("q61_tool_name_parse", """WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'mcp__' || role || '__op_' || turn ELSE role END AS tool FROM conversations)
    SELECT conv_id, turn, tool, starts_with(tool, 'mcp__') AS is_mcp, CASE WHEN starts_with(tool, 'mcp__') THEN string_split(tool, '__')[2] END AS server, CASE WHEN starts_with(tool, 'mcp__') THEN string_split(tool, '__')[-1] ELSE tool END AS operation FROM t""")
def q61(spark, d):
    tool = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("mcp__"), "role", F.lit("__op_"), F.col("turn").cast("string"))).otherwise(F.col("role"))
    t = table(spark, d, "conversations").select("conv_id", "turn", tool.alias("tool"))
    return t.select("conv_id", "turn", "tool", S.is_remote_tool("tool").alias("is_mcp"), S.tool_server("tool").alias("server"), S.tool_operation("tool").alias("operation"))


@query("q62_graph_document_ingest", """SELECT DISTINCT md5(text) AS doc_id, source AS id FROM documents WHERE lang = 'en' AND text IS NOT NULL""")
def q62(spark, d):
    node = lambda i, t: F.struct(i.alias("id"), F.lit(t).alias("type"), F.create_map().cast("map<string,string>").alias("properties"))
    docs = table(spark, d, "documents").where("lang = 'en'")
    none = F.create_map().cast("map<string,string>")
    rel = F.struct(node(F.col("source"), "Source").alias("source"), node(F.col("lang"), "Language").alias("target"), F.lit("written in").alias("type"), none.alias("properties"))
    g = docs.select(F.array(node(F.col("source"), "Source")).alias("nodes"), F.array(rel).alias("relationships"), F.struct(F.col("text").alias("page_content"), none.alias("metadata")).alias("source"))
    return graph_documents.ingest(g)["mentions"]


@query("q63_html_chunks")
def q63(spark, d):
    pages = table(spark, d, "pages").select("page_id", chunks.strip_html("html").alias("text"))
    return chunks.split_chunks(pages, "page_id", "text", size=500)


@query("q64_graph_document_nodes", "SELECT DISTINCT source AS id, 'Source' AS type FROM documents WHERE lang = 'en' UNION ALL SELECT 'en', 'Language' WHERE EXISTS (SELECT 1 FROM documents WHERE lang = 'en')")
def q64(spark, d):
    node = lambda i, t: F.struct(i.alias("id"), F.lit(t).alias("type"), F.create_map().cast("map<string,string>").alias("properties"))
    docs = table(spark, d, "documents").where("lang = 'en'")
    none = F.create_map().cast("map<string,string>")
    rel = F.struct(node(F.col("source"), "Source").alias("source"), node(F.col("lang"), "Language").alias("target"), F.lit("written in").alias("type"), none.alias("properties"))
    g = docs.select(F.array(node(F.col("source"), "Source")).alias("nodes"), F.array(rel).alias("relationships"), F.struct(F.col("text").alias("page_content"), none.alias("metadata")).alias("source"))
    return graph_documents.ingest(g)["nodes"].select("id", "type")


# --- events, procedures, entities ---


def tool_events(spark: SparkSession, d: str) -> DataFrame:
    """Each row of `events` as a hook payload of a tool's start and one of its end."""
    e = table(spark, d, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    payload = lambda hook: F.to_json(F.struct(F.lit(hook).alias("hook_event_name"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), at.alias("timestamp"), F.col("event_type").alias("tool_name"), F.col("event_id").cast("string").alias("tool_use_id")))
    failed = F.get_json_object("props", "$.k").cast("int") < 10
    return e.select(F.explode(F.array(payload("PreToolUse"), F.when(failed, payload("PostToolUseFailure")).otherwise(payload("PostToolUse")))).alias("value"))


def event_actions(spark: SparkSession, d: str) -> DataFrame:
    return events.to_actions(events.from_payloads(tool_events(spark, d), "command_a"))


ACTION_ID = "substr(sha256('u' || user_id || chr(0) || '{}' || chr(0) || event_id), 1, 32)"


@query("q65_event_to_action", f"""SELECT {ACTION_ID.format('tool_call')} AS action_id, 'u' || user_id AS session_id, 'tool_call' AS action_type, event_type AS tool_name, 'completed' AS status, NULL AS parent_action_id FROM events
    UNION ALL SELECT {ACTION_ID.format('tool_result')}, 'u' || user_id, 'tool_result', event_type, CASE WHEN {FAILED} THEN 'failed' ELSE 'completed' END, {ACTION_ID.format('tool_call')} FROM events""")
def q65(spark, d):
    return event_actions(spark, d).select("action_id", "session_id", "action_type", "tool_name", "status", "parent_action_id")


@query("q66_action_graph_parents", f"SELECT {ACTION_ID.format('tool_call')} AS parent, {ACTION_ID.format('tool_result')} AS child FROM events")
def q66(spark, d):
    return events.graph_of(event_actions(spark, d))["parent_of"]


@query("q67_sessions_of_events", "SELECT 'u' || user_id AS session_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS started_at, 'active' AS status FROM events GROUP BY user_id")
def q67(spark, d):
    return events.sessions_of(events.from_payloads(tool_events(spark, d), "command_a")).select("session_id", "started_at", "status")


@query("q68_tool_stats_with_results", f"SELECT event_type AS tool_name, count(*) AS call_count, CAST(sum(CASE WHEN {FAILED} THEN 1 ELSE 0 END) AS BIGINT) AS error_count FROM events GROUP BY 1")
def q68(spark, d):
    a = event_actions(spark, d)
    calls = a.where("action_type = 'tool_call'").select("session_id", "tool_use_id", "tool_name", F.lit(None).cast("double").alias("duration_ms"), "status")
    results = a.where("action_type = 'tool_result'").select("tool_use_id", "is_error", F.lit(None).cast("double").alias("duration_ms"))
    return analytics.tool_stats_with_results(calls, results).select("tool_name", "call_count", "error_count")


@query("q69_procedures_by_pattern", "SELECT * FROM (VALUES ('vector_search.search', '(vectors, query, k, threshold) :: (id, distance)'), ('vector_search.search_batch', '(vectors, queries, k) :: (query_id, id, distance, rank)')) t(name, signature)")
def q69(spark, d):
    return procedures.standard().listing(spark, r"vector_search\..*")


@query("q70_chunk_entities")
def q70(spark, d):
    return entities.extract(chunks.chunk_nodes(line_chunks(spark, d), "doc_id"))["entities"]


@query("q71_label_sets_equal", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND list_sort(list_distinct([a.n_regionkey, a.n_nationkey % 3])) = list_sort(list_distinct([b.n_regionkey, b.n_nationkey % 3]))")
def q71(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.array("n_regionkey", F.col("n_nationkey") % 3).alias("l"))
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("l").alias("x")).crossJoin(F.broadcast(n.select(F.col("n_nationkey").alias("b"), F.col("l").alias("y"))))
    return pairs.where("a < b").where(pattern.same_labels("x", "y")).select("a", "b")


@query("q72_property_keys", "SELECT event_type AS label, list_sort(list_distinct(list(CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END))) AS properties FROM events GROUP BY 1")
def q72(spark, d):
    rows = table(spark, d, "events").select("event_type", F.create_map(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"), F.lit("1")).alias("m"))
    return schema.property_keys(rows, "event_type", "m")


@query("q73_primary_type", "WITH p AS (SELECT lang AS label, CASE WHEN n_chars % 3 = 0 THEN 'Null' WHEN n_chars % 3 = 1 THEN 'Integer' ELSE 'String' END AS type, count(*) AS n FROM documents GROUP BY 1, 2) SELECT label, 'n' AS property, arg_min(type, (-n, type)) AS type FROM p WHERE type <> 'Null' GROUP BY 1")
def q73(spark, d):
    kind = F.when(F.col("n_chars") % 3 == 0, "Null").when(F.col("n_chars") % 3 == 1, "Integer").otherwise("String")
    rows = table(spark, d, "documents").select("lang", F.lit("n").alias("p"), kind.alias("t"))
    return schema.primary_type(schema.typed_profile(rows, "lang", "p", "t"))


@query("q74_doc_lookup", f"SELECT * FROM ({DOC_STATUS}) WHERE track_id = 'src4' UNION ALL (SELECT * FROM ({DOC_STATUS}) WHERE file_path = 'fr' ORDER BY id LIMIT 1)")
def q74(spark, d):
    docs = doc_status(spark, d)
    return stores.docs_by_track(docs, "src4").union(stores.doc_by(docs, "file_path", "fr"))


@query("q75_vector_upsert_delete", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 5 <> 0")
def q75(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    new = e.where("id % 2 = 0").select("id", (F.col("label") + 100).alias("label"), F.lit(1).alias("at"))
    return write.delete(vector.upsert(e, new, ["at"]), e.where("id % 5 = 0").select("id"), ["id"])


@query("q76_constraint_violations", "SELECT 'Lineitem' AS label, 'unique' AS kind, 'l_orderkey,l_linenumber' AS properties, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def q76(spark, d):
    m, _, f = star_model(spark, d)
    return ingest.constraint_violations(m, {n.label: f[n.source] for n in m.nodes}, spark)


from ctxweave import plan_queries  # noqa: E402,F401  registers the others
