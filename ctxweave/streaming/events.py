"""The agent event protocol: envelope, payloads of four runtimes, and actions with ids that events decide."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxweave.functions.scalars import is_remote_tool, normalised, stable_id, tool_server

EVENT_TYPES = ("session_start", "session_end", "tool_start", "tool_end", "agent_start", "agent_end", "llm_start", "llm_end", "handoff", "message", "error")

#: One row an event: what all have, then what some have.
ENVELOPE = """
    event_type string, session_id string, timestamp string, source_sdk string, metadata map<string,string>,
    model string, working_directory string, user_id string, status string, total_cost_usd double, total_input_tokens bigint, total_output_tokens bigint,
    tool_name string, tool_input string, tool_use_id string, result string, is_error boolean, error_message string,
    agent_name string, agent_type string, parent_agent_name string, output string, system_prompt string, input_items string,
    input_tokens bigint, output_tokens bigint, response string, from_agent string, to_agent string,
    role string, content string, error_type string, error_details string, recoverable boolean, parent_session_id string
"""
FIELDS = [x.split()[0] for x in " ".join(ENVELOPE.split()).split(", ")]

#: hook name -> (event type, role or null, is an error), for each runtime
HOOKS: dict[str, dict[str, tuple[str, str | None, bool]]] = {
    "command_a": {
        "SessionStart": ("session_start", None, False), "UserPromptSubmit": ("message", "user", False), "UserPromptExpansion": ("message", "user", False), "PreToolUse": ("tool_start", None, False),
        "PostToolUse": ("tool_end", None, False), "PostToolUseFailure": ("tool_end", None, True), "PermissionDenied": ("error", None, True), "StopFailure": ("error", None, True),
        "PermissionRequest": ("message", "system", False), "SubagentStart": ("agent_start", None, False), "SubagentStop": ("agent_end", None, False), "Stop": ("session_end", None, False),
    },
    "command_b": {
        "SessionStart": ("session_start", None, False), "UserPromptSubmit": ("message", "user", False), "PreToolUse": ("tool_start", None, False), "PostToolUse": ("tool_end", None, False),
        "PermissionRequest": ("message", "system", False), "Stop": ("session_end", None, False),
    },
    "sdk_a": {
        "init": ("session_start", None, False), "prompt_submit": ("message", "user", False), "pre_tool": ("tool_start", None, False), "post_tool": ("tool_end", None, False), "tool_failure": ("error", None, True),
        "notification": ("message", "system", False), "subagent_start": ("agent_start", None, False), "subagent_stop": ("agent_end", None, False), "stop": ("session_end", None, False),
    },
    "sdk_b": {
        "init": ("session_start", None, False), "on_tool_start": ("tool_start", None, False), "on_tool_end": ("tool_end", None, False), "on_agent_start": ("agent_start", None, False), "on_agent_end": ("agent_end", None, False),
        "on_llm_start": ("llm_start", None, False), "on_llm_end": ("llm_end", None, False), "on_handoff": ("handoff", None, False), "end_session": ("session_end", None, False),
    },
}


def _from_map(pairs: dict[str, str | bool | None], key: Column) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def from_payloads(payloads: DataFrame, runtime: str, payload: str = "value", received: str | Column | None = None) -> DataFrame:
    """Events (ENVELOPE) of hook payloads, a JSON text a row; hooks that a runtime doesn't have give none.

    A failed tool comes as a tool_end with is_error from one runtime and as an error from
    another; either way there is a tool_end with is_error, so failures count alike.
    """
    hooks = HOOKS[runtime]
    j = lambda *paths: F.coalesce(*[F.get_json_object(F.col(payload), f"$.{p}") for p in paths])
    hook = j("hook_event_name", "event", "hook")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if received is None else (F.col(received) if isinstance(received, str) else received)
    base = payloads.withColumn("__hook", hook).where(F.col("__hook").isin(list(hooks)))
    kind, role, failed = (_from_map({h: x[k] for h, x in hooks.items()}, F.col("__hook")) for k in range(3))
    failed_tool = failed & j("tool_name").isNotNull()
    values: dict[str, Column] = {
        "event_type": F.when(failed_tool, "tool_end").otherwise(kind),
        "session_id": j("session_id", "sessionId"),
        "timestamp": F.coalesce(j("timestamp"), now),
        "source_sdk": F.lit(runtime),
        "metadata": F.map_filter(F.create_map(F.lit("hook"), F.col("__hook"), F.lit("transcript_path"), j("transcript_path")), lambda k, v: v.isNotNull()),
        "model": j("model"),
        "working_directory": j("cwd", "working_directory"),
        "user_id": j("user_id"),
        "status": F.coalesce(j("status"), F.when(kind == "session_end", "completed")),
        "total_cost_usd": j("total_cost_usd").cast("double"),
        "total_input_tokens": j("usage.input_tokens", "total_input_tokens").cast("bigint"),
        "total_output_tokens": j("usage.output_tokens", "total_output_tokens").cast("bigint"),
        "tool_name": j("tool_name", "tool"),
        "tool_input": j("tool_input", "input"),
        "tool_use_id": j("tool_use_id", "call_id"),
        "result": j("tool_response", "tool_result", "result"),
        "is_error": failed | F.coalesce(j("is_error").cast("boolean"), F.lit(False)),
        "error_message": j("error", "error_message", "reason"),
        "agent_name": j("agent_name", "agent_id", "subagent_type"),
        "agent_type": j("agent_type"),
        "parent_agent_name": j("parent_agent_name"),
        "output": j("output"),
        "system_prompt": j("system_prompt"),
        "input_items": j("input_items"),
        "input_tokens": j("input_tokens").cast("bigint"),
        "output_tokens": j("output_tokens").cast("bigint"),
        "response": j("response"),
        "from_agent": j("from_agent"),
        "to_agent": j("to_agent"),
        "role": role,
        "content": j("prompt", "message", "content"),
        "error_type": F.when(kind == "error", F.coalesce(j("error_type"), F.col("__hook"))),
        "error_details": j("error_details"),
        "recoverable": j("recoverable").cast("boolean"),
        "parent_session_id": j("parent_session_id"),
    }
    return base.select(*[values[f].alias(f) for f in FIELDS])


ROLES, STATUSES = ["user", "assistant", "system"], ["pending", "running", "completed", "failed", "cancelled", "timeout"]


def to_actions(events: DataFrame) -> DataFrame:
    """Actions of events. Session starts and ends are no actions.

    action_id depends on the session, the kind, and the tool use's id or the time, so an
    event that comes twice is the same action. A tool result's parent is its call's id.
    """
    e = events
    key = F.coalesce(F.col("tool_use_id"), F.col("timestamp"))
    call_id, result_id = stable_id("session_id", F.lit("tool_call"), key), stable_id("session_id", F.lit("tool_result"), key)
    kinds = {"tool_start": "tool_call", "tool_end": "tool_result", "agent_start": "subagent_start", "agent_end": "subagent_end", "llm_start": "llm_call", "llm_end": "llm_result", "handoff": "handoff", "error": "error"}
    role = normalised("role", ROLES, "user")
    action_type = F.when(F.col("event_type") == "message", F.concat(role, F.lit("_message"))).otherwise(_from_map(kinds, F.col("event_type")))
    body = F.to_json(F.struct("tool_input", "result", "error_message", "agent_name", "agent_type", "content", "response", "input_tokens", "output_tokens", "from_agent", "to_agent", "error_type", "error_details"))
    return (
        e.where(F.col("session_id").isNotNull() & ~F.col("event_type").isin("session_start", "session_end"))
        .withColumn("action_type", action_type)
        .where("action_type is not null")
        .select(
            F.when(F.col("event_type") == "tool_start", call_id).when(F.col("event_type") == "tool_end", result_id).otherwise(stable_id("session_id", "action_type", "timestamp", F.coalesce("agent_name", F.lit("")), F.coalesce("content", F.lit("")))).alias("action_id"),
            "session_id",
            "action_type",
            "timestamp",
            F.when(F.coalesce("is_error", F.lit(False)) | (F.col("event_type") == "error"), "failed").otherwise(normalised("status", STATUSES, "completed")).alias("status"),
            F.when((F.col("event_type") == "tool_end"), call_id).alias("parent_action_id"),
            "tool_name",
            "tool_use_id",
            F.coalesce("is_error", F.lit(False)).alias("is_error"),
            F.coalesce(is_remote_tool("tool_name"), F.lit(False)).alias("is_mcp"),
            tool_server("tool_name").alias("mcp_server"),
            type_labels(F.col("action_type")).alias("labels"),
            body.alias("properties"),
        )
    )


#: properties of a stored action that aren't strings
TYPED = "tool_input string, result string, error_message string, agent_name string, agent_type string, content string, response string, input_tokens bigint, output_tokens bigint, from_agent string, to_agent string, error_type string, error_details string"


def typed(actions: DataFrame, properties: str = "properties") -> DataFrame:
    """Stored actions with their JSON properties as columns of their types; a property that an action lacks, or that has another type, is null."""
    rest = [F.col(f"`{c}`") for c in actions.columns if c != properties]
    return actions.select(*rest, F.from_json(properties, TYPED).alias("__p")).select(*rest, "__p.*")


def type_labels(action_type: str | Column) -> Column:
    """Labels of an action: messages are Message and a label of their role."""
    c = F.col(action_type) if isinstance(action_type, str) else action_type
    camel = F.replace(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.when(F.endswith(c, F.lit("_message")), F.array(F.lit("Action"), F.lit("Message"), camel)).otherwise(F.array(F.lit("Action"), camel))


def sessions_of(events: DataFrame) -> DataFrame:
    """A session for each id that any event names, from its first start where there is one."""
    starts = events.where("event_type = 'session_start' and session_id is not null").groupBy("session_id").agg(F.min_by(F.struct("timestamp", "model", "working_directory", "user_id", "parent_session_id"), "timestamp").alias("s"))
    firsts = events.where("session_id is not null").groupBy("session_id").agg(F.min("timestamp").alias("first"))
    return firsts.join(starts, "session_id", "left").select("session_id", F.coalesce("s.timestamp", "first").alias("started_at"), F.lit("active").alias("status"), "s.model", "s.working_directory", "s.user_id", "s.parent_session_id", F.lit(None).cast("double").alias("total_cost_usd"), F.lit(None).cast("bigint").alias("total_input_tokens"), F.lit(None).cast("bigint").alias("total_output_tokens"), F.lit(None).cast("string").alias("ended_at"))


def graph_of(actions: DataFrame) -> dict[str, DataFrame]:
    """Edges and tools of actions: has_action, followed_by, parent_of, used_tool, tools."""
    from ctxweave.operators.analytics import followed_by

    tools = actions.where("action_type = 'tool_call' and tool_name is not null")
    return {
        "has_action": actions.select("session_id", "action_id").distinct(),
        "followed_by": followed_by(actions),
        "parent_of": actions.where("parent_action_id is not null").select(F.col("parent_action_id").alias("parent"), F.col("action_id").alias("child")).distinct(),
        "used_tool": tools.select("action_id", F.col("tool_name").alias("name")).distinct(),
        "tools": tools.groupBy(F.col("tool_name").alias("name")).agg(F.min_by("is_mcp", "timestamp").alias("is_mcp"), F.min_by("mcp_server", "timestamp").alias("mcp_server")),
    }


def active_users(events: DataFrame) -> DataFrame:
    """(session_id, user_id) of sessions that started and haven't ended."""
    e = events.where("event_type in ('session_start', 'session_end') and session_id is not null")
    last = e.groupBy("session_id").agg(F.max_by("event_type", F.struct("timestamp", F.col("event_type") == "session_end")).alias("t"), F.max_by("user_id", F.when(F.col("user_id").isNotNull(), F.col("timestamp"))).alias("user_id"))
    return last.where("t = 'session_start'").select("session_id", "user_id")


@dataclass
class Hub:
    """Sends each event to the connectors that take its type, in the order they were added."""

    connectors: list[tuple[str, set[str], Callable[[DataFrame], None]]] = field(default_factory=list)

    def add(self, name: str, kinds: set[str], write: Callable[[DataFrame], None]) -> Hub:
        if unknown := kinds - set(EVENT_TYPES):
            raise ValueError(f"no such event types: {sorted(unknown)}")
        self.connectors.append((name, kinds, write))
        return self

    def remove(self, name: str) -> Hub:
        self.connectors = [c for c in self.connectors if c[0] != name]
        return self

    def emit(self, events: DataFrame) -> None:
        for _, kinds, write in self.connectors:
            write(events.where(F.col("event_type").isin(sorted(kinds))))
