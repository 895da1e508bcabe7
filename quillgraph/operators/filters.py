"""Attribute filters by an allow-list."""

from __future__ import annotations

import math
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("type", "lang", "path_glob", "since")
_DAYS = ("%Y-%m-%d", "%Y%m%d")
_TIMES = [f"%Y-%m-%d{gap}%H:%M{tail}" for gap in "T " for tail in ("", ":%S", ":%S.%f")]
_WITHOUT = {"%Y-%m-%d %H:%M:%S.%f"}
FORMATS = [*_DAYS, *(f + z for f in _TIMES if f not in _WITHOUT for z in ("", "%z"))]


def to_epoch(value) -> float | None:
    """Seconds of a number or of a date text of a fixed grammar; None for anything else, a bare year included."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        try:
            got = float(value)
        except OverflowError:
            return None
        return got if math.isfinite(got) else None
    text = str(value).strip()
    if text.endswith(("Z", "z")):
        text = text[:-1] + "+00:00"
    for form in FORMATS:
        try:
            when = datetime.strptime(text, form)
        except ValueError:
            continue
        return (when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp()
    return None


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a case-sensitive glob; * crosses separators."""
    out, i = ["(?s)^"], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + (3 if glob[i + 1 : i + 2] == "^" else 2)) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end > 0:
            body = glob[i + 1 : end]
            no = body.startswith("^")
            inner = "".join(x if x.isalnum() or x in " -_/." else "\\" + x for x in body[no:])
            out.append(f"[{'^' if no else ''}{inner}]")
            i = end
        elif c == "[":
            out.append("(?!)")  # an open bracket without an end matches nothing
        else:
            out.append(c if c.isalnum() or c in "_/" else "\\" + c if ord(c) < 128 else c)
        i += 1
    return "".join(out) + "$"


def predicates(filters: dict | None) -> tuple[list[Column], bool, list[str]]:
    """(predicates in a fixed order, is the file's time needed?, dropped keys)."""
    found, needs_file, dropped = [], False, [k for k in filters or {} if k not in KEYS]
    for key in KEYS:
        if key not in (filters or {}):
            continue
        value = filters[key]
        if key == "since":
            at = to_epoch(value)
            if at is None:
                dropped.append(key)
            else:
                found.append(F.col("file_mtime") >= F.lit(at))
                needs_file = True
            continue
        if value is None or isinstance(value, (list, dict, set, tuple, bool)) or value == "":
            dropped.append(key)
        elif key == "type":
            found.append(F.col("type") == F.lit(str(value)))
        elif key == "lang":
            found.append(F.get_json_object("attrs", "$.lang") == F.lit(str(value)))
        else:
            found.append(F.get_json_object("attrs", "$.file_uid").rlike(glob_regex(str(value))))
    return found, needs_file, sorted(dropped)


def filtered(nodes: DataFrame, filters: dict | None, k: int = 0) -> tuple[DataFrame | None, list[str]]:
    """(nodes without files that meet all usable predicates, by uid, k + 1 at most if k > 0; dropped keys). None without a usable predicate."""
    found, needs_file, dropped = predicates(filters)
    if not found:
        return None, dropped
    base = nodes.where("type <> 'file'")
    if needs_file:
        files = nodes.where("type = 'file'").select(F.col("uid").alias("_file"), F.expr("try_cast(get_json_object(attrs, '$.mtime') as double)").alias("file_mtime"))
        base = base.withColumn("_owner", F.get_json_object("attrs", "$.file_uid")).join(files, F.col("_owner") == F.col("_file"), "left")
    out = base.where(reduce(lambda a, b: a & b, found)).select(*nodes.columns).orderBy("uid")
    return (out.limit(k + 1) if k > 0 else out), dropped
