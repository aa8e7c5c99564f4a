"""Helpers over collected values."""

from __future__ import annotations

import math
from datetime import date, datetime, time, timezone
from decimal import Decimal
from itertools import chain

from pyspark.sql import Row


def to_json(value):
    """A value in JSON's terms: times as ISO text in UTC, bytes as a list of numbers, -0 as 0, NaN and infinities as null."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): to_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [to_json(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return list(value)
    if isinstance(value, date):
        when = value if isinstance(value, datetime) else datetime.combine(value, time())
        when = when.astimezone(timezone.utc) if when.tzinfo else when
        return when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) or math.isinf(value) else 0.0 if value == 0 else value
    if type(value).__name__ == "VariantVal":
        return to_json(value.toPython())
    return value


def equals(a, b, strict: bool = True) -> bool:
    """Deep equality; NaN equals nothing, and booleans are no numbers where strict."""
    if isinstance(a, Row):
        a = a.asDict()
    if isinstance(b, Row):
        b = b.asDict()
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equals(v, b[k], strict) for k, v in a.items())
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(equals(x, y, strict) for x, y in zip(a, b, strict=True))
    if strict and isinstance(a, bool) != isinstance(b, bool):
        return False
    if not strict and isinstance(a, (bool, int, float, str)) and isinstance(b, (bool, int, float, str)) and type(a) is not type(b):
        from ..operators.filters import number_of

        x, y = number_of(a), number_of(b)
        return x is not None and y is not None and x == y
    return a == b


def flatten(chunks) -> list:
    """Chunks of a column as one list."""
    return list(chain.from_iterable(chunks or []))


def snappy_uncompress(data: bytes, size: int) -> bytes:
    """A raw snappy block of known decompressed size."""
    import pyarrow as pa

    return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
