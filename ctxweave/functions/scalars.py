"""Scalar functions as column expressions; Python only where recursion or parsing leaves no choice."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SESSION_ID = r"^[a-zA-Z0-9_-]{1,128}$"
USER_ID = r"^[a-zA-Z0-9_@.\-]{1,256}$"
SKILL_NAME = r"^[a-z0-9]+(-[a-z0-9]+)*$"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(*parts: str | Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by NUL; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def content_hash(x: str | Column) -> Column:
    return F.sha2(_c(x), 256)


def document_id(x: str | Column) -> Column:
    return F.md5(_c(x))


def full_match(x: str | Column, pattern: str) -> Column:
    """The whole string matches, as the graph query language's =~ means it."""
    return _c(x).rlike(f"^(?:{pattern})$")


def search_pattern(pattern: str) -> str:
    """A case-insensitive pattern for rlike; text that is no valid pattern is searched literally."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return f"(?i){pattern}"


def contains_ci(x: str | Column, part: str) -> Column:
    """Literal substring without regard to case."""
    return F.contains(F.lower(_c(x)), F.lit(part.lower()))


def valid_session_id(x: str | Column) -> Column:
    return _c(x).rlike(SESSION_ID)


def valid_user_id(x: str | Column) -> Column:
    return _c(x).rlike(USER_ID)


def valid_skill(name: str | Column, description: str | Column, compatibility: str | Column | None = None) -> Column:
    """Name of 1-64 characters in lower-case words joined by single hyphens, description of 1-1024, compatibility absent or 1-500."""
    n, d = _c(name), _c(description)
    ok = n.rlike(SKILL_NAME) & (F.length(n) <= 64) & F.length(d).between(1, 1024)
    if compatibility is None:
        return ok
    c = _c(compatibility)
    return ok & (c.isNull() | F.length(c).between(1, 500))


def is_remote_tool(tool: str | Column) -> Column:
    return F.startswith(_c(tool), F.lit("mcp__"))


def tool_server(tool: str | Column) -> Column:
    """Second part of mcp__server__operation, null for other names."""
    return F.when(is_remote_tool(tool), F.get(F.split(_c(tool), "__"), F.lit(1)))


def tool_operation(tool: str | Column) -> Column:
    """Last part of mcp__server__operation, the name itself for others."""
    return F.when(is_remote_tool(tool), F.element_at(F.split(_c(tool), "__"), -1)).otherwise(_c(tool))


def fenced_block(x: str | Column) -> Column:
    """Content of the first fenced block, with its language tag; the text itself where there is none."""
    found = F.regexp_extract(_c(x), r"(?s)```(.*?)```", 1)
    return F.when(F.contains(_c(x), F.lit("```")) & (found != ""), found).otherwise(_c(x))


def normalised(x: str | Column, allowed: list[str], fallback: str) -> Column:
    """The value if it is allowed, else the fallback."""
    return F.when(_c(x).isin(allowed), _c(x)).otherwise(F.lit(fallback))


def iso_date(x: str | Column) -> Column:
    return F.date_format(_c(x), "yyyy-MM-dd")


def iso_local_datetime(x: str | Column) -> Column:
    """Nine digits of a second; Spark keeps six, the rest are zeros."""
    return F.concat(F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000"))


def iso_local_time(x: str | Column) -> Column:
    return F.concat(F.date_format(_c(x), "HH:mm:ss.SSSSSS"), F.lit("000"))


def iso_datetime(x: str | Column, offset: str | Column) -> Column:
    """A local timestamp with its offset, which Spark's timestamps don't keep."""
    return F.concat(iso_local_datetime(x), _c(offset) if isinstance(offset, Column) else F.lit(offset))


def iso_duration(micros: str | Column) -> Column:
    """ISO 8601 duration of a number of microseconds, such as PT2M2.33S."""
    total = F.abs(_c(micros).cast("long"))
    whole = F.floor(total / 1000000)
    hours, minutes = F.floor(whole / 3600), F.floor(whole % 3600 / 60)
    seconds = F.regexp_replace(F.format_string("%d.%06d", whole % 60, total % 1000000), r"\.?0+$", "")
    seconds = F.when((whole % 60 == 0) & (total % 1000000 == 0), "").otherwise(F.concat(F.when(whole % 60 == 0, F.regexp_replace(F.format_string("0.%06d", total % 1000000), r"0+$", "")).when(total % 1000000 == 0, (whole % 60).cast("string")).otherwise(seconds), F.lit("S")))
    body = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""), seconds)
    return F.concat(F.when(_c(micros) < 0, "-").otherwise(""), F.lit("PT"), F.when(body == "", "0S").otherwise(body))


def value_type(x: str | Column) -> Column:
    """Type of a string's value: Null, Boolean, Integer, Double, LocalDateTime, Date, LocalTime or String."""
    s = _c(x)
    return (
        F.when(s.isNull(), "Null")
        .when(F.lower(s).isin("true", "false"), "Boolean")
        .when(s.rlike(r"^-?[0-9]+$"), "Integer")
        .when(s.rlike(r"^-?[0-9]+\.[0-9]+([eE][-+]?[0-9]+)?$"), "Double")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"), "LocalDateTime")
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), "Date")
        .when(s.rlike(r"^[0-9]{2}:[0-9]{2}(:[0-9]{2})?"), "LocalTime")
        .otherwise("String")
    )


#: Spark type names and what they are called in a graph schema
TYPE_NAMES = {"string": "String", "boolean": "Boolean", "tinyint": "Integer", "smallint": "Integer", "int": "Integer", "bigint": "Integer", "float": "Float", "double": "Float", "date": "Date", "timestamp": "ZonedDateTime", "timestamp_ntz": "LocalDateTime"}


def graph_type(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return "Float"
    if spark_type.startswith(("array", "vector")):
        return "List"
    if spark_type.startswith(("map", "struct")):
        return "Map"
    if spark_type.startswith("interval"):
        return "Duration"
    return TYPE_NAMES.get(spark_type, "String")


#: declared types that a value may have instead
COMPATIBLE = {"Integer": {"Integer", "Float"}, "Float": {"Float", "Double", "Integer", "Decimal"}, "String": {"String", "Date", "LocalDateTime", "ZonedDateTime", "LocalTime"}, "Boolean": {"Boolean", "Integer"}}


def compatible(declared: str, actual: str) -> bool:
    return declared == actual or actual in COMPATIBLE.get(declared, set())


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors in double precision; null if either is null or has no length."""
    dot = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def parse_frontmatter(text: str | None) -> dict[str, str | list[str]]:
    """The head of a skill file between --- fences: `key: value` lines and `- item` lists. One line may come before the fence."""
    lines = (text or "").splitlines()
    start = next((k for k, x in enumerate(lines[:2]) if x.strip() == "---"), None)
    if start is None:
        return {}
    stop = next((k for k in range(start + 1, len(lines)) if lines[k].strip() == "---"), None)
    if stop is None:
        return {}
    out: dict[str, str | list[str]] = {}
    key = ""
    for line in lines[start + 1 : stop]:
        item = re.match(r"\s*-\s+(.*)$", line)
        pair = re.match(r"([A-Za-z0-9_-]+)\s*:\s*(.*)$", line)
        if item and key:
            held = out.get(key)
            out[key] = [*(held if isinstance(held, list) else []), item.group(1).strip().strip("\"'")]
        elif pair:
            key, value = pair.group(1), pair.group(2).strip().strip("\"'")
            out[key] = [x.strip().strip("\"'") for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else value
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def frontmatter(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """parse_frontmatter as a column; lists are JSON."""
    for s in texts:
        yield s.map(lambda t: {k: json.dumps(v) if isinstance(v, list) else v for k, v in parse_frontmatter(t).items()})


def nested_strings(value: object, keys: set[str], depth: int = 10) -> list[str]:
    """Strings under any of the keys, anywhere in nested lists and maps, to a depth."""
    if depth < 0:
        return []
    if isinstance(value, dict):
        own = [v for k, v in value.items() if k in keys and isinstance(v, str)]
        return own + [x for k, v in value.items() if not (k in keys and isinstance(v, str)) for x in nested_strings(v, keys, depth - 1)]
    if isinstance(value, list):
        return [x for v in value for x in nested_strings(v, keys, depth - 1)]
    if isinstance(value, str) and value[:1] in "{[":
        try:
            return nested_strings(json.loads(value), keys, depth - 1)
        except ValueError:
            return []
    return []


def extract_nested(x: str | Column, keys: list[str], depth: int = 10) -> Column:
    """nested_strings of a JSON column."""
    wanted = set(keys)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: nested_strings(t, wanted, depth) if t else [])

    return run(_c(x))


def skill_from_path(path: str | Column) -> Column:
    """Name of the folder that holds a SKILL.md, null for other paths."""
    found = F.regexp_extract(_c(path), r"([^/\\]+)[/\\]SKILL\.md", 1)
    return F.when(found != "", found)
