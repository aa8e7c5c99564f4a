"""Mongo-style filters compiled to Spark columns.

Every leaf compiles to a column that is true or false, never null, so that ``&``, ``|`` and ``~`` keep two-valued logic. A
null scalar counts as 0 in comparisons and matches ``$eq: None``; a null struct, list or map, anything below one, and a
field that the schema lacks are "undefined": they match no comparison and equal None only with ``strict=False``. NaN matches
nothing but ``$ne``, ``$nin`` and ``$not``. Leaves over floats keep shapes that Spark does not push into Parquet statistics
where those would lose NaN rows.
"""

from __future__ import annotations

import math
import operator
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, time, timezone
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound, QueryError

COMPARE = {"$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}
LOGICAL = ("$and", "$or", "$nor")
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
COMPLEX = (T.StructType, T.ArrayType, T.MapType)


def filter_paths(query: dict | None) -> list[str]:
    """Every path that the filter names, once, in order."""

    def walk(q) -> Iterator[str]:
        if not isinstance(q, dict):
            return
        for op in LOGICAL:
            if op in q:
                for part in q[op]:
                    yield from walk(part)
                return
        yield from q

    return list(dict.fromkeys(walk(query or {})))


def filter_columns(query: dict | None) -> list[str]:
    """Top-level columns that the filter needs."""
    return list(dict.fromkeys(p.split(".")[0] for p in filter_paths(query)))


@dataclass
class Ref:
    """A resolved path; ``column`` is None where the schema has no such field."""

    column: Column | None
    kind: T.DataType | None = None
    above: list[Column] = field(default_factory=list)

    @property
    def compound(self) -> bool:
        return isinstance(self.kind, COMPLEX)

    @property
    def floating(self) -> bool:
        return isinstance(self.kind, FLOATS)

    def is_null(self) -> Column:
        """A null scalar under present structs: null, not undefined."""
        if self.compound:
            return F.lit(False)
        return reduce(operator.and_, (a.isNotNull() for a in self.above), self.column.isNull())


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(schema: T.StructType, path: str) -> Ref:
    """Follow a dotted path through structs."""
    first, *rest = path.split(".")
    if first not in schema.names:
        raise ColumnNotFound(f"parquet filter columns not found: {first}")
    names, kind, above = [first], schema[first].dataType, []
    for name in rest:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return Ref(None)
        above.append(F.col(".".join(map(_quote, names))))
        names.append(name)
        kind = kind[name].dataType
    return Ref(F.col(".".join(map(_quote, names))), kind, above)


# ---------------------------------------------------------------- values


def _is_number(v) -> bool:
    return isinstance(v, (int, float, Decimal)) and not isinstance(v, bool)


def _is_nan(v) -> bool:
    return isinstance(v, (float, Decimal)) and math.isnan(v)


def _millis(v: date) -> float:
    """Epoch milliseconds; naive times and dates are UTC."""
    when = v if isinstance(v, datetime) else datetime.combine(v, time())
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return (when - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1000


def number_of(v):
    """The number that a literal stands for in a comparison, or None."""
    if v is None:
        return 0
    if isinstance(v, bool):
        return int(v)
    if _is_number(v):
        return None if _is_nan(v) else v
    if isinstance(v, date):
        return _millis(v)
    if isinstance(v, str):
        s = v.strip()
        try:
            return float(int(s, 16)) if s[:2].lower() == "0x" else float(s) if s and "_" not in s and s.lower().lstrip("+-") not in ("nan", "inf") else 0 if not s else None
        except ValueError:
            return None
    return None


def _number_literal(v) -> Column:
    return F.lit(Decimal(v)) if isinstance(v, int) and not -(1 << 63) <= v < 1 << 63 else F.lit(v)


def _time_literal(v: date, kind: T.DataType) -> Column | None:
    """A literal of the column's own time type, which Spark can push down; None where it would not be exact."""
    when = v if isinstance(v, datetime) else datetime.combine(v, time())
    when = when.astimezone(timezone.utc).replace(tzinfo=None) if when.tzinfo else when
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestamp_ntz'{when.isoformat(sep=' ')}'")
    if isinstance(kind, T.TimestampType):
        since = when - datetime(1970, 1, 1)
        return F.expr(f"timestamp_micros({(since.days * 86400 + since.seconds) * 1000000 + since.microseconds}L)")
    return F.expr(f"date'{when.date().isoformat()}'") if when.time() == time() else None


TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def as_number(column: Column, kind: T.DataType) -> Column | None:
    """A column as the number it stands for; null where it stands for none. None for kinds that never do."""
    if isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType)):
        return column
    if isinstance(kind, T.BooleanType):
        return column.cast("int")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long") * F.lit(86400000)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column) / 1000
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column) / 1000
    if isinstance(kind, T.StringType):
        s = F.trim(column)
        plain = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
        return F.when(s == "", F.lit(0.0)).when(s.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(s, 3, 64), 16, 10).cast("double")).otherwise(plain)
    return None


# ---------------------------------------------------------------- leaves


def compare(ref: Ref, op: str, target, sql_nulls: bool = False) -> Column:
    """``$gt $gte $lt $lte``: a null scalar is 0; undefined and NaN match nothing."""
    if ref.column is None or ref.compound or isinstance(target, (list, tuple, dict)):
        return F.lit(False)
    test, c, kind = COMPARE[op], ref.column, ref.kind
    number = number_of(target)
    zero = not sql_nulls and number is not None and test(0, number)
    if isinstance(kind, T.StringType) and isinstance(target, str):
        held = test(c, F.lit(target))
    elif isinstance(kind, T.BinaryType):
        if not isinstance(target, (bytes, bytearray)):
            return F.lit(False)
        held, zero = test(c, F.lit(bytes(target))), False
    elif isinstance(kind, TIMES) and isinstance(target, date) and (literal := _time_literal(target, kind)) is not None:
        held = test(c, literal)
    else:
        own = as_number(c, kind)
        if own is None or number is None:
            return F.lit(False)
        held = test(own, _number_literal(number))
        if isinstance(kind, T.StringType):
            held = held & own.isNotNull()
    if ref.floating:
        held = held & ~F.isnan(c)
    held = held & c.isNotNull()
    return held | ref.is_null() if zero else held


def _literal(value, kind: T.DataType, strict: bool) -> Column | None:
    """``value`` as a literal to compare with a scalar of ``kind`` by ``=``; None where they can never be equal."""
    if isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType)):
        if _is_number(value):
            return None if _is_nan(value) else _number_literal(value)
        if not strict and isinstance(value, (bool, str)) and (number := number_of(value)) is not None:
            return F.lit(number)
    elif isinstance(kind, T.StringType):
        return F.lit(value) if isinstance(value, str) else None
    elif isinstance(kind, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    elif isinstance(kind, TIMES):
        return _time_literal(value, kind) if isinstance(value, date) else None
    elif isinstance(kind, T.BinaryType):
        return F.lit(bytes(value)) if isinstance(value, (bytes, bytearray)) else None
    return None


def equal(ref: Ref, target, strict: bool = True) -> Column:
    """``$eq``: deep equality, of one type where strict."""
    c, kind = ref.column, ref.kind
    if target is None:
        if c is None:
            return F.lit(not strict)
        return ref.is_null() if strict else c.isNull()
    if c is None or _is_nan(target):
        return F.lit(False)
    if isinstance(kind, T.ArrayType):
        if not isinstance(target, (list, tuple)):
            return F.lit(False)
        parts = [_item(c, kind, i, x, strict) for i, x in enumerate(target)]
        return F.coalesce(reduce(operator.and_, parts, F.size(c) == len(target)), F.lit(False)) & c.isNotNull()
    if isinstance(kind, T.StructType):
        if not isinstance(target, dict) or set(target) != set(kind.names):
            return F.lit(False)
        parts = [equal(Ref(c.getField(n), kind[n].dataType), x, strict) for n, x in target.items()]
        return reduce(operator.and_, parts, c.isNotNull())
    if isinstance(kind, T.MapType):
        if not isinstance(target, dict):
            return F.lit(False)
        parts = [F.coalesce(F.map_contains_key(c, F.lit(n).cast(kind.keyType)), F.lit(False)) & equal(Ref(F.try_element_at(c, F.lit(n).cast(kind.keyType)), kind.valueType), x, strict) for n, x in target.items()]
        return F.coalesce(reduce(operator.and_, parts, F.size(c) == len(target)), F.lit(False)) & c.isNotNull()
    literal = _literal(target, kind, strict)
    if literal is None:
        if not strict and isinstance(kind, (T.StringType, T.BooleanType)) and isinstance(target, (int, float, Decimal, str)) and (number := number_of(target)) is not None:
            own = as_number(c, kind)
            return F.coalesce(own == F.lit(float(number)), F.lit(False))
        if isinstance(kind, T.DateType) and isinstance(target, date):
            return F.coalesce(as_number(c, kind) == F.lit(_millis(target)), F.lit(False))
        return F.lit(False)
    return (c == literal) & ~F.isnan(c) & c.isNotNull() if ref.floating else (c == literal) & c.isNotNull()


def _item(c: Column, kind: T.ArrayType, i: int, value, strict: bool) -> Column:
    return equal(Ref(F.get(c, F.lit(i)), kind.elementType), value, strict)


def not_equal(ref: Ref, target, strict: bool = True) -> Column:
    """``$ne``: nulls, undefined and NaN match any target but their own."""
    if ref.column is not None and target is not None and not ref.compound:
        literal = _literal(target, ref.kind, strict)
        if literal is not None:
            apart = ref.column != literal
            return F.coalesce(apart, F.lit(True)) if ref.floating else apart | ref.column.isNull()
    return ~equal(ref, target, strict)


def _has_element(ref: Ref, target, strict: bool) -> Column:
    return F.coalesce(F.exists(ref.column, lambda x: equal(Ref(x, ref.kind.elementType), target, strict)), F.lit(False))


def within(ref: Ref, targets, strict: bool = True) -> Column:
    """``$in``: some target equals the value, or an element of it where it is a list."""
    if not isinstance(targets, (list, tuple, set, frozenset)):
        return F.lit(False)
    if ref.column is None:
        return reduce(operator.or_, (equal(ref, t, strict) for t in targets), F.lit(False))
    if isinstance(ref.kind, T.ArrayType):
        any_of = [equal(ref, t, strict) | _has_element(ref, t, strict) for t in targets]
        return reduce(operator.or_, any_of, F.lit(False))
    literals = [] if ref.compound else [x for t in targets if t is not None and (x := _literal(t, ref.kind, strict)) is not None]
    others = [t for t in targets if t is None or ref.compound or _literal(t, ref.kind, strict) is None]
    out = []
    if literals:
        held = ref.column.isin(*literals)
        out.append(held & ~F.isnan(ref.column) & ref.column.isNotNull() if ref.floating else held & ref.column.isNotNull())
    out += [equal(ref, t, strict) for t in others if not _is_nan(t)]
    return reduce(operator.or_, out) if out else F.lit(False)


def not_within(ref: Ref, targets, strict: bool = True) -> Column:
    """``$nin``: the opposite of ``$in``; a target that is no list matches neither."""
    if not isinstance(targets, (list, tuple, set, frozenset)):
        return F.lit(False)
    return ~F.coalesce(within(ref, targets, strict), F.lit(False))


def condition(ref: Ref, wanted, strict: bool, sql_nulls: bool) -> Column:
    """All operators of one field's condition; a value stands for ``$eq``."""
    if not isinstance(wanted, dict):
        return equal(ref, wanted, strict)
    out = []
    for op, target in wanted.items():
        if op in COMPARE:
            out.append(compare(ref, op, target, sql_nulls))
        elif op == "$eq":
            out.append(equal(ref, target, strict))
        elif op == "$ne":
            out.append(not_equal(ref, target, strict))
        elif op == "$in":
            out.append(within(ref, target, strict))
        elif op == "$nin":
            out.append(not_within(ref, target, strict))
        elif op == "$not":
            out.append(~condition(ref, target, strict, sql_nulls))
        else:
            raise QueryError(f"parquet filter operator not known: {op}")
    return reduce(operator.and_, out) if out else F.lit(True)


def compile_filter(query: dict | None, schema: T.StructType, strict: bool = True, sql_nulls: bool = False) -> Column | None:
    """The filter as one two-valued column; None where it matches all rows.

    ``$and``, ``$or`` and ``$nor`` are looked for in this order and the keys beside the one found are ignored, with a warning.
    ``sql_nulls``: nulls match no comparison, as in SQL.
    """
    if not query:
        return None
    missing = [c for c in filter_columns(query) if c not in schema.names]
    if missing:
        raise ColumnNotFound(f"parquet filter columns not found: {', '.join(missing)}")

    def build(q: dict) -> Column:
        if not isinstance(q, dict):
            raise QueryError(f"parquet filter must be an object: {q!r}")
        for op in LOGICAL:
            if op not in q:
                continue
            if len(q) > 1:
                warnings.warn(f"filter keys beside {op} are ignored: {[k for k in q if k != op]}", stacklevel=2)
            parts = [build(p) for p in q[op]]
            if op == "$and":
                return reduce(operator.and_, parts, F.lit(True)) if parts else F.lit(True)
            either = reduce(operator.or_, parts) if parts else F.lit(False)
            return ~either if op == "$nor" else either
        parts = [condition(resolve(schema, path), wanted, strict, sql_nulls) for path, wanted in q.items()]
        return reduce(operator.and_, parts) if parts else F.lit(True)

    return build(query)
