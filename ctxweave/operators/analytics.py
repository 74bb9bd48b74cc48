"""Session, action and tool analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxweave.functions.scalars import is_remote_tool, tool_server

ACTION_TYPES = ("user_message", "assistant_message", "system_message", "tool_call", "tool_result", "error")


def tool_stats(calls: DataFrame, session: str | int | None = None) -> DataFrame:
    """(tool_name, is_mcp, mcp_server, call_count, avg_duration_ms, error_count), most used first.

    calls: session_id, tool_name, duration_ms, status. Failures are calls of status 'failed'.
    """
    rows = calls if session is None else calls.where(F.col("session_id") == session)
    return (
        rows.where(F.col("tool_name").isNotNull())
        .groupBy("tool_name")
        .agg(F.count("*").alias("call_count"), F.avg("duration_ms").alias("avg_duration_ms"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("error_count"))
        .select("tool_name", is_remote_tool("tool_name").alias("is_mcp"), tool_server("tool_name").alias("mcp_server"), "call_count", "avg_duration_ms", "error_count")
        .orderBy(F.desc("call_count"), "tool_name")
    )


def tool_stats_with_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """tool_stats where a call's failure and duration come from its result, joined by tool_use_id."""
    r = results.groupBy("tool_use_id").agg(F.max("is_error").alias("is_error"), F.max("duration_ms").alias("result_ms"))
    joined = calls.join(r, "tool_use_id", "left")
    return tool_stats(joined.select("session_id", "tool_name", F.coalesce("duration_ms", "result_ms").alias("duration_ms"), F.when(F.col("is_error"), "failed").otherwise(F.coalesce("status", F.lit("completed"))).alias("status")))


def session_summary(sessions: DataFrame, actions: DataFrame) -> DataFrame:
    """Counts of each session's actions; a session without actions has zeros."""
    one = lambda *kinds: F.sum(F.when(F.col("action_type").isin(*kinds), 1).otherwise(0))
    counts = actions.groupBy("session_id").agg(F.count("action_id").alias("total_actions"), one("tool_call").alias("tool_calls"), one("user_message").alias("user_messages"), one("assistant_message").alias("assistant_messages"), one("error").alias("errors"))
    names = ("total_actions", "tool_calls", "user_messages", "assistant_messages", "errors")
    return sessions.join(counts, "session_id", "left").select("session_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def tool_histogram(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id", "tool_name").agg(F.count("*").alias("n"))


def status_counts(docs: DataFrame, statuses: list[str], total: str | None = "all") -> DataFrame:
    """(status, n) with a row for each known status, 0 where none; unknown ones are left out. The total counts known ones."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(s,) for s in statuses], "status string")
    counts = docs.groupBy("status").agg(F.count("*").alias("n"))
    out = known.join(counts, "status", "left")
    out = out.select("status", F.coalesce("n", F.lit(0)).alias("n"))
    if total is None:
        return out
    return out.union(out.agg(F.sum("n").alias("n")).select(F.lit(total).alias("status"), "n"))


def list_sessions(sessions: DataFrame, limit: int = 100, status: str | None = None) -> DataFrame:
    """Newest sessions first."""
    rows = sessions if status is None else sessions.where(F.col("status") == status)
    return rows.orderBy(F.desc("started_at"), "session_id").limit(limit)


def session_actions(actions: DataFrame, session: str | int, action_type: str | None = None, limit: int = 1000) -> DataFrame:
    """A session's actions in time order."""
    rows = actions.where(F.col("session_id") == session)
    if action_type is not None:
        rows = rows.where(F.col("action_type") == action_type)
    return rows.orderBy("timestamp", "action_id").limit(limit)


def last_action(actions: DataFrame) -> DataFrame:
    """(session_id, action_id, timestamp) of each session's last action, by an aggregate and no sort."""
    return actions.groupBy("session_id").agg(F.max(F.struct("timestamp", "action_id")).alias("x")).select("session_id", "x.action_id", "x.timestamp")


def followed_by(actions: DataFrame, order: list[str | Column] = ("timestamp", "action_id")) -> DataFrame:
    """(prev, curr) of consecutive actions of a session."""
    w = Window.partitionBy("session_id").orderBy(*order)
    return actions.select("session_id", F.lag("action_id").over(w).alias("prev"), F.col("action_id").alias("curr")).where("prev is not null").select("prev", "curr")


def action_sequence(actions: DataFrame, parents: DataFrame) -> DataFrame:
    """Each action with the one that follows it in its session and the list of its children, in one plan."""
    w = Window.partitionBy("session_id").orderBy("timestamp", "action_id")
    children = parents.groupBy(F.col("parent").alias("action_id")).agg(F.sort_array(F.collect_list("child")).alias("children"))
    return actions.select("session_id", "action_id", "action_type", F.lead("action_id").over(w).alias("next_action_id")).join(children, "action_id", "left").select("session_id", "action_id", "action_type", "next_action_id", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def usage_rollup(uses: DataFrame, keys: list[str], at: str, action: str) -> DataFrame:
    """first_access, last_access (null for a single use), access_count and the actions in order."""
    return (
        uses.groupBy(*keys)
        .agg(F.min(at).alias("first_access"), F.max(at).alias("__last"), F.count("*").alias("access_count"), F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), F.col(action).alias("a")))).alias("__l"))
        .select(*keys, "first_access", F.when(F.col("access_count") > 1, F.col("__last")).alias("last_access"), "access_count", F.transform("__l", lambda x: x["a"]).alias("actions"))
    )


def paginate(rows: DataFrame, page: int = 1, size: int = 50, sort: str = "updated_at", descending: bool = True, allowed: tuple[str, ...] = ("created_at", "updated_at", "id", "file_path")) -> tuple[DataFrame, DataFrame]:
    """(page of rows, total). Pages start at 1, sizes are held within 10 and 200, an unknown sort column means updated_at."""
    page, size = max(1, page), min(200, max(10, size))
    by = F.col(sort if sort in allowed else "updated_at")
    ordered = rows.orderBy(by.desc() if descending else by.asc(), F.col("id").desc() if descending else F.col("id").asc())
    return ordered.offset((page - 1) * size).limit(size), rows.agg(F.count("*").alias("total"))


def end_sessions(sessions: DataFrame, ends: DataFrame) -> DataFrame:
    """Sessions with what their last end event says; fields that it leaves out stay as they are."""
    last = ends.groupBy("session_id").agg(F.max_by(F.struct("status", "total_cost_usd", "total_input_tokens", "total_output_tokens", F.col("timestamp").alias("ended_at")), "timestamp").alias("e"))
    joined = sessions.join(last, "session_id", "left")
    names = ("status", "total_cost_usd", "total_input_tokens", "total_output_tokens", "ended_at")
    return joined.select(*[F.coalesce(F.col(f"e.{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in sessions.columns])
