"""Times, truncation, bounded lists, hierarchy ids and settings."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.rollup import LEVELS


def iso_time(value: str) -> Column:
    """A time as ISO text in UTC with milliseconds, so that text order is time order; null where it can't be read."""
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(value), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def truncate(text: Column, length: int) -> Column:
    """At most ``length`` characters, the last being an ellipsis if some were cut."""
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length - 1)), F.lit("…"))).otherwise(text)


def bounded_list(values: Column, limit: int) -> Column:
    """``(shown, total, truncated)`` of an array: its distinct values in order, the first ``limit`` of them."""
    own = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.struct(F.slice(own, 1, limit).alias("shown"), F.size(own).cast("long").alias("total"), (F.size(own) > limit).alias("truncated"))


def focus_matches(focus: str) -> Column:
    """Whether a node lies in the group that a hierarchy id ``level:part:...`` names; parts are percent-encoded.  Ids of unknown levels and sizes match nothing."""
    from urllib.parse import unquote

    level, *parts = focus.split(":")
    columns = LEVELS.get(level, [])
    if not columns or len(parts) != len(columns):
        return F.lit(False)
    out = F.lit(True)
    for c, p in zip(columns, parts, strict=True):
        out &= F.coalesce(F.col(c), F.lit("")) == unquote(p)
    return out


def canonical_json(value: object) -> str:
    """JSON with names in order at every depth and no spaces, so that equal values have equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def validate_scope(config: object) -> list[str]:
    """What is wrong with a scope setting: names that it doesn't know, and values of another kind; none: it is valid."""
    if not isinstance(config, dict):
        return ["not an object"]
    wrong = [f"unknown name: {k}" for k in sorted(config) if k not in ("version", "projectId", "exclude", "roots")]
    if config.get("version", 1) != 1:
        wrong.append("version is not 1")
    if "projectId" in config and not (isinstance(config["projectId"], str) and re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{0,63}", config["projectId"])):
        wrong.append("projectId is no id")
    for name in ("exclude", "roots"):
        rules = config.get(name, [])
        if not isinstance(rules, list):
            wrong.append(f"{name} is no list")
            continue
        wrong += [f"{name}: no relative path: {r!r}" for r in rules if not isinstance(r, str) or not r.strip() or r.startswith("/") or ".." in r.split("/")]
    return wrong
