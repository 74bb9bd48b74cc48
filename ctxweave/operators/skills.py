"""Skills, what they depend on, and how they are used."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxweave.functions.scalars import contains_ci, extract_nested, frontmatter, skill_from_path, tool_operation
from ctxweave.operators import write
from ctxweave.operators.analytics import usage_rollup


def add_skills(skills: DataFrame, new: DataFrame) -> DataFrame:
    """Last write of a name wins; created_at stays."""
    return write.merge_last(skills, new, ["name"], ["updated_at"], keep=["created_at"])


def list_skills(skills: DataFrame) -> DataFrame:
    return skills.orderBy("name")


def search_by_name(skills: DataFrame, part: str) -> DataFrame:
    return skills.where(contains_ci("name", part)).orderBy("name")


def delete_skill(skills: DataFrame, depends_on: DataFrame, used: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(skills, dependencies, usage without the skill, number of skills deleted)."""
    gone = skills.sparkSession.createDataFrame([(name,)], "name string")
    count = write.deleted_count(skills, gone, ["name"])
    kept, (deps,) = write.detach_delete(skills, "name", [depends_on], gone)
    return kept, deps, used.where(F.col("skill") != name), count


def add_dependency(depends_on: DataFrame, skills: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges between skills that exist, each once."""
    names = skills.select("name")
    known = pairs.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select("src", "dst")
    return write.merge_edges(depends_on, known)


def remove_dependency(depends_on: DataFrame, src: str, dst: str) -> DataFrame:
    return depends_on.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def dependencies(skills: DataFrame, depends_on: DataFrame, name: str) -> DataFrame:
    return depends_on.where(F.col("src") == name).join(skills, F.col("dst") == F.col("name")).select(*skills.columns).orderBy("name")


def dependents(skills: DataFrame, depends_on: DataFrame, name: str) -> DataFrame:
    return depends_on.where(F.col("dst") == name).join(skills, F.col("src") == F.col("name")).select(*skills.columns).orderBy("name")


def usage(uses: DataFrame) -> DataFrame:
    """Usage edges of (session_id, skill, at, action)."""
    return usage_rollup(uses, ["session_id", "skill"], "at", "action")


def result_names(value: object, depth: int = 10) -> list[str]:
    """Names of the skills that a list or search tool's result holds, direct or as JSON text in it."""
    if depth < 0:
        return []
    if isinstance(value, str):
        try:
            return result_names(json.loads(value), depth - 1)
        except ValueError:
            return []
    if isinstance(value, list):
        return [x for v in value for x in result_names(v, depth - 1)]
    if not isinstance(value, dict):
        return []
    if isinstance(value.get("name"), str) and value["name"]:
        return [value["name"]]
    out = [x for k in ("skills", "results", "items", "content") if k in value for x in result_names(value[k], depth - 1)]
    return out + (result_names(value["text"], depth - 1) if isinstance(value.get("text"), str) else [])


def detect_usage(events: DataFrame, known: DataFrame) -> DataFrame:
    """(session_id, skill, at, action) that tool events tell of.

    A use is a skill tool called with a name, a SKILL.md file that is read, content with
    a skill's front matter in a result or a message, an expanded prompt that names a
    skill, or a name in the result of a list or search tool. Names that aren't known
    skills are left out of the last two kinds.
    """
    base = events.select("session_id", F.col("timestamp").alias("at"), "event_type", "tool_name", "tool_input", "result", "content")
    called = base.where(F.lower("tool_name").contains("skill")).select("session_id", "at", F.explode(extract_nested("tool_input", ["skill", "skill_name", "name"])).alias("skill"), F.lit("load").alias("action"))
    read = base.where(F.col("tool_input").contains("SKILL.md")).select("session_id", "at", F.explode(F.transform(extract_nested("tool_input", ["file_path", "path", "command"]), lambda p: skill_from_path(p))).alias("skill"), F.lit("read").alias("action"))
    shown = base.where(F.col("result").contains("---")).select("session_id", "at", frontmatter("result")["name"].alias("skill"), F.lit("content").alias("action"))
    named = base.where(F.col("content").startswith("/")).select("session_id", "at", F.regexp_extract("content", r"^/([a-z0-9-]+)", 1).alias("skill"), F.lit("expand").alias("action"))
    named = named.join(known.select(F.col("name").alias("skill")).distinct(), "skill", "left_semi").select("session_id", "at", "skill", "action")
    message = base.where((F.col("event_type") == "message") & F.col("content").contains("---")).select("session_id", "at", frontmatter("content")["name"].alias("skill"), F.lit("prompt_expansion").alias("action"))

    @F.pandas_udf("array<string>")
    def names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: result_names(t) if t else [])

    operation = tool_operation("tool_name")
    listed = base.where((F.col("event_type") == "tool_end") & operation.isin("list_skills", "search_skills", "search_by_name"))
    listed = listed.select("session_id", "at", F.explode(names("result")).alias("skill"), F.concat(operation, F.lit("_result")).alias("action"))
    listed = listed.join(known.select(F.col("name").alias("skill")).distinct(), "skill", "left_semi").select("session_id", "at", "skill", "action")
    return called.union(read).union(shown).union(named).union(message).union(listed).where("skill is not null and skill <> ''").distinct()
