import json

import pytest

from ctxweave.operators import write
from ctxweave.streaming import actions as A
from ctxweave.streaming import events as E

PAYLOADS = [
    {"hook_event_name": "SessionStart", "session_id": "s", "timestamp": "2024-01-01T00:00:00Z", "model": "m"},
    {"hook_event_name": "UserPromptSubmit", "session_id": "s", "timestamp": "2024-01-01T00:00:01Z", "prompt": "hello"},
    {"hook_event_name": "PreToolUse", "session_id": "s", "timestamp": "2024-01-01T00:00:02Z", "tool_name": "mcp__web__get", "tool_use_id": "u1", "tool_input": {"a": 1}},
    {"hook_event_name": "PostToolUseFailure", "session_id": "s", "timestamp": "2024-01-01T00:00:03Z", "tool_name": "mcp__web__get", "tool_use_id": "u1", "error": "no"},
    {"hook_event_name": "Unknown", "session_id": "s", "timestamp": "2024-01-01T00:00:04Z"},
    {"hook_event_name": "Stop", "session_id": "s", "timestamp": "2024-01-01T00:00:05Z"},
]


def events(spark):
    return E.from_payloads(spark.createDataFrame([(json.dumps(p),) for p in PAYLOADS], "value string"), "command_a")


def test_payloads_to_actions(spark):
    e = events(spark)
    assert [r["event_type"] for r in e.orderBy("timestamp").collect()] == ["session_start", "message", "tool_start", "tool_end", "session_end"]
    got = {r["action_type"]: r for r in E.to_actions(e).collect()}
    assert set(got) == {"user_message", "tool_call", "tool_result"}
    assert got["tool_result"]["parent_action_id"] == got["tool_call"]["action_id"] and got["tool_result"]["status"] == "failed"
    assert got["tool_call"]["is_mcp"] and got["tool_call"]["mcp_server"] == "web" and got["user_message"]["labels"] == ["Action", "Message", "UserMessage"]
    g = E.graph_of(E.to_actions(e))
    assert g["has_action"].count() == 3 and g["followed_by"].count() == 2 and g["parent_of"].count() == 1 and g["tools"].first()["name"] == "mcp__web__get"
    assert E.sessions_of(e).first()["model"] == "m" and E.active_users(e).count() == 0
    assert E.active_users(e.where("event_type <> 'session_end'")).count() == 1


def test_failed_tools_count_alike(spark):
    p = {"event": "tool_failure", "session_id": "s", "tool_name": "Read", "tool_use_id": "u", "error": "x"}
    r = E.to_actions(E.from_payloads(spark.createDataFrame([(json.dumps(p),)], "value string"), "sdk_a")).first()
    assert (r["action_type"], r["status"], r["is_error"]) == ("tool_result", "failed", True)


def test_hub(spark):
    seen = []
    hub = E.Hub().add("a", {"message"}, lambda df: seen.append(("a", df.count()))).add("b", {"tool_start", "tool_end"}, lambda df: seen.append(("b", df.count())))
    hub.emit(events(spark))
    hub.remove("a").emit(events(spark))
    assert seen == [("a", 1), ("b", 2), ("b", 2)]


def test_stream_is_batch(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    e = events(spark)
    e.coalesce(1).write.mode("append").json(str(source / "1"))
    stream = A.read_events(spark, str(source / "*"))
    A.write_actions(stream, target, str(tmp_path / "cp")).awaitTermination(120)
    e.coalesce(1).write.mode("append").json(str(source / "2"))  # the same events again
    A.write_actions(stream, target, str(tmp_path / "cp")).awaitTermination(120)
    log = A.action_log(spark, target)
    got = [r["action_id"] for r in log.read().collect()]
    assert sorted(got) == sorted(r["action_id"] for r in E.to_actions(e).collect()) and len(got) == 3
    before = sorted(map(str, log.read().collect()))
    log.compact()
    log.vacuum()
    assert log.deltas() == [] and sorted(map(str, log.read().collect())) == before


def test_a_log_survives_a_break_at_any_step(spark, tmp_path):
    batch = lambda k: spark.createDataFrame([(k, k, "x"), (0, k, "late")], "id long, at long, v string")
    want = lambda n: sorted([(0, 0, "late"), *((k, k, "x") for k in range(1, n))])
    log = write.MergeLog(spark, str(tmp_path / "log"), ["id"], ["at", "v"])
    with pytest.raises(FileNotFoundError):
        log.read()
    for k in range(3):
        log.append(batch(k), k)
        log.append(batch(7), k)  # a batch that comes again
        assert sorted(map(tuple, log.read().collect())) == want(k + 1)
    (tmp_path / "log/d3").mkdir()  # a delta and a base whose jobs broke off
    (tmp_path / "log/base/v2").mkdir(parents=True)
    assert sorted(map(tuple, log.read().collect())) == want(3)
    log.append(batch(3), 3)
    log.compact()
    log.append(batch(4), 4)
    for _ in range(2):
        assert sorted(map(tuple, log.read().collect())) == want(5)
        log.vacuum()
    assert log.deltas() == [4]


def test_followed_by_stream(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # a state store for each, and few rows
    try:
        _followed_by_stream(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def _followed_by_stream(spark, tmp_path):
    source = tmp_path / "in"
    E.to_actions(events(spark)).coalesce(1).write.json(str(source))
    a = spark.readStream.schema("session_id string, action_id string, timestamp string, tool_name string, is_error boolean").json(str(source))
    q = A.followed_by_stream(a).writeStream.format("memory").queryName("edges").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in E.graph_of(E.to_actions(events(spark)))["followed_by"].collect()}
    assert {(r["prev"], r["curr"]) for r in spark.table("edges").collect()} == want
    q = A.windowed_usage(a).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["calls"] for r in spark.table("usage").collect()) == 2
