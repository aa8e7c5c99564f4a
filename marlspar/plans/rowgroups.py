"""Which row groups a query has to read, from footer statistics, bloom filters and row ranges.

Spark prunes by itself when it scans; this is the same decision as data, to inspect a layout before running a query on it.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from decimal import Decimal

from pyspark.sql import SparkSession

from ..operators.filters import COMPARE, number_of
from ..sources.footer import Footer, Group, bloom_might_contain, read_footer


@dataclass
class GroupPlan:
    group: int
    first_row: int
    rows: int
    read: bool
    why: str
    bytes: int


def _bounds(group: Group, path: str):
    """(min, max, null count) where they can be compared: numbers, texts, dates and times."""
    chunk = group.chunk(path)
    if chunk is None or chunk.minimum is None or chunk.maximum is None:
        return None
    low, high = chunk.minimum, chunk.maximum
    if isinstance(low, (bool, bytes)) or chunk.annotation in ("UUID", "FLOAT16", "JSON") or chunk.annotation.startswith("TIME("):
        return None
    return low, high, chunk.null_count


def _never(bounds, op: str, target, floating: bool) -> bool:
    """Whether no row of the bounds can match one operator; NaN lies outside all bounds, nulls count as 0."""
    if bounds is None or isinstance(target, (bool, dict, bytes)):
        return False
    low, high, nulls = bounds
    if op == "$in":
        return isinstance(target, (list, tuple)) and all(_never(bounds, "$eq", t, floating) for t in target)
    if target is None:
        return op == "$eq" and nulls == 0
    if isinstance(target, (list, tuple)) or any(isinstance(low, kind) != isinstance(target, kind) for kind in (str, date)):
        return False
    if isinstance(target, date):
        low, high, target = map(number_of, (low, high, target))
    elif isinstance(target, float) and isinstance(low, Decimal):
        low, high = float(low), float(high)  # as the filter compares them
    if op == "$eq":
        return target < low or target > high
    if op == "$ne":
        return low == high == target and nulls == 0 and not floating
    if op in COMPARE:
        if nulls != 0 and (zero := number_of(target)) is not None and COMPARE[op](0, zero):
            return False
        edge = high if op in ("$gt", "$gte") else low
        return not COMPARE[op](edge, target)
    return False


def can_skip(group: Group, query: dict | None, blooms: dict[tuple[str, str, object], bool | None] | None = None) -> bool:
    """Whether no row of the group can match: any part of ``$and``, every part of ``$or``; never by ``$nor`` or ``$not``."""
    if not query:
        return False
    if "$and" in query:
        return any(can_skip(group, q, blooms) for q in query["$and"])
    if "$or" in query:
        return all(can_skip(group, q, blooms) for q in query["$or"])
    if "$nor" in query:
        return False
    for path, wanted in query.items():
        chunk = group.chunk(path)
        floating = chunk is not None and chunk.physical in ("FLOAT", "DOUBLE")
        bounds = _bounds(group, path)
        for op, target in (wanted if isinstance(wanted, dict) else {"$eq": wanted}).items():
            if _never(bounds, op, target, floating):
                return True
            targets = [target] if op == "$eq" else list(target) if op == "$in" and isinstance(target, (list, tuple)) else []
            if blooms and targets and all(_bloom_key(path, t) is not None and blooms.get(_bloom_key(path, t)) is False for t in targets):
                return True
    return False


def _bloom_key(path: str, target) -> tuple[str, str, object] | None:
    """What a bloom answer is kept by; a boolean is no number, and lists, dicts and null have none."""
    return (path, type(target).__name__, target) if isinstance(target, (int, str, float, bytes)) and not isinstance(target, bool) else None


def _bloom_targets(query: dict | None) -> list[tuple[str, object]]:
    if not query:
        return []
    for op in ("$and", "$or"):
        if op in query:
            return [x for q in query[op] for x in _bloom_targets(q)]
    out = []
    for path, wanted in query.items():
        tests = wanted if isinstance(wanted, dict) else {"$eq": wanted}
        targets = ([tests["$eq"]] if "$eq" in tests else []) + list(tests.get("$in") or [])
        out += [(path, t) for t in targets if _bloom_key(path, t) is not None]
    return out


def plan_groups(spark: SparkSession, path: str, columns: list[str] | None = None, filter: dict | None = None, row_start: int = 0, row_end: int | None = None, use_bloom_filters: bool = False) -> list[GroupPlan]:
    """The row groups of one file: read or skipped, why, and the bytes of the wanted columns."""
    footer: Footer = read_footer(spark, path)
    known: dict[tuple[str, str, object], list[bool | None]] = {}
    if use_bloom_filters:
        for column, target in _bloom_targets(filter):
            known[_bloom_key(column, target)] = bloom_might_contain(spark, path, column, target)
    out = []
    for i, g in enumerate(footer.groups):
        blooms = {k: v[i] for k, v in known.items()}
        size = sum(c.compressed for c in g.chunks if columns is None or c.path.split(".")[0] in columns)
        if g.first_row + g.rows <= row_start or row_end is not None and g.first_row >= row_end:
            out.append(GroupPlan(i, g.first_row, g.rows, False, "rows", size))
        elif can_skip(g, filter):
            out.append(GroupPlan(i, g.first_row, g.rows, False, "statistics", size))
        elif blooms and can_skip(g, filter, blooms):
            out.append(GroupPlan(i, g.first_row, g.rows, False, "bloom filter", size))
        else:
            out.append(GroupPlan(i, g.first_row, g.rows, True, "", size))
    return out
