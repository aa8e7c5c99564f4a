"""Read schemas and fix-ups for Parquet types that Spark refuses or reads as raw bytes, from the footer's annotations.

All are column expressions; only WKB geometry needs Python (see ``geo``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FormatError


def uuid_text(b: Column) -> Column:
    """16 bytes as lower-case dashed text."""
    return F.regexp_replace(F.lower(F.hex(b)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def float16(b: Column) -> Column:
    """Two little-endian bytes of an IEEE half float as a double, subnormals, infinities and NaN included."""
    raw = F.conv(F.concat(F.hex(F.substring(b, 2, 1)), F.hex(F.substring(b, 1, 1))), 16, 10).cast("int")
    sign = F.when(raw >= 32768, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(raw, 10).bitwiseAND(F.lit(31)), raw.bitwiseAND(F.lit(1023)).cast("double")
    finite = F.when(exponent == 0, fraction * float(2.0**-24)).otherwise(F.pow(F.lit(2.0), (exponent - 15).cast("double")) * (1.0 + fraction / 1024.0))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(b.isNotNull(), sign * F.when(exponent == 31, special).otherwise(finite))


def nanos_timestamp(n: Column, utc: bool = True) -> Column:
    """Epoch nanoseconds as a timestamp, cut to microseconds towards the past."""
    micros = F.timestamp_micros(F.call_function("div", n - F.pmod(n, F.lit(1000)), F.lit(1000)))
    return micros if utc else micros.cast("timestamp_ntz")


def json_value(s: Column) -> Column:
    """JSON text as a variant; invalid text gives null."""
    return F.try_parse_json(s)


def timestamp_millis_only(c: Column) -> Column:
    return F.date_trunc("MILLISECOND", c)


@dataclass
class Leaf:
    """A column or a field below one: its Spark read type, what its footer annotation says, and the fields below it.

    ``shape`` is value, struct, list, map or variant; a list has its element below it, a map its key and value.
    """

    name: str
    kind: T.DataType
    annotation: str
    physical: str
    shape: str = "value"
    below: list[Leaf] = field(default_factory=list)


_PHYSICAL = {"BOOLEAN": T.BooleanType(), "INT32": T.IntegerType(), "INT64": T.LongType(), "INT96": T.TimestampType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BINARY": T.BinaryType(), "FIXED_LEN_BYTE_ARRAY": T.BinaryType()}


def _primitive(physical: str, note: str) -> T.DataType:
    """Spark type to read a primitive leaf with; types that Spark refuses are read raw."""
    if note in ("STRING", "ENUM", "JSON"):
        return T.StringType()
    if note == "BSON" or note.startswith("INTERVAL"):
        raise FormatError(f"parquet {note} not supported")
    if note == "DATE":
        return T.DateType()
    if note.startswith("DECIMAL("):
        p, s = (int(x) for x in note[8:-1].split(","))
        return T.DecimalType(p, s)
    if note.startswith("TIMESTAMP(") and "NANOS" not in note:
        return T.TimestampType() if note.endswith("true)") else T.TimestampNTZType()
    if note.startswith("INTEGER("):
        bits, signed = note[8:-1].split(",")
        return {("8", "true"): T.ByteType(), ("16", "true"): T.ShortType(), ("8", "false"): T.ShortType(), ("16", "false"): T.IntegerType(), ("32", "false"): T.LongType(), ("64", "false"): T.DecimalType(20, 0)}.get((bits, signed), _PHYSICAL[physical])
    return _PHYSICAL[physical]


def _element(f) -> Leaf:
    """A JVM Parquet schema field, its repetition aside."""
    note = f.getLogicalTypeAnnotation()
    note = "" if note is None else note.toString()
    if f.isPrimitive():
        physical = f.getPrimitiveTypeName().toString()
        return Leaf(f.getName(), _primitive(physical, note), note, physical)
    group = f.asGroupType()
    children = [group.getType(i) for i in range(group.getFieldCount())]
    if note.startswith("VARIANT"):  # plain or shredded: Spark puts the parts together
        return Leaf(f.getName(), T.VariantType(), note, "GROUP", "variant")
    if note == "LIST" and len(children) == 1:
        repeated = children[0]
        wrapped = not repeated.isPrimitive() and repeated.asGroupType().getFieldCount() == 1 and repeated.getName() not in ("array", f"{group.getName()}_tuple")
        inner = _repeated(repeated.asGroupType().getType(0)) if wrapped else _element(repeated)
        return Leaf(f.getName(), T.ArrayType(inner.kind), note, "GROUP", "list", [inner])
    if note in ("MAP", "MAP_KEY_VALUE") and len(children) == 1:
        pair = children[0].asGroupType()
        key, value = _element(pair.getType(0)), _repeated(pair.getType(1))
        return Leaf(f.getName(), T.MapType(key.kind, value.kind), note, "GROUP", "map", [key, value])
    parts = [_repeated(c) for c in children]
    return Leaf(f.getName(), T.StructType([T.StructField(x.name, x.kind) for x in parts]), note, "GROUP", "struct", parts)


def _repeated(f) -> Leaf:
    own = _element(f)
    return Leaf(own.name, T.ArrayType(own.kind), "", "GROUP", "list", [own]) if f.getRepetition().toString() == "REPEATED" else own


def leaves(schema) -> list[Leaf]:
    """Top-level columns of a JVM Parquet message type."""
    return [_repeated(schema.getType(i)) for i in range(schema.getFieldCount())]


def needs_schema(parts: list[Leaf]) -> bool:
    """Whether Spark would refuse to infer the schema, for a type at any depth."""
    return any(x.annotation in ("UUID", "FLOAT16") or x.annotation.startswith("TIME(") or "NANOS" in x.annotation or needs_schema(x.below) for x in parts)


def read_schema(parts: list[Leaf]) -> T.StructType:
    return T.StructType([T.StructField(x.name, x.kind) for x in parts])


def decoded(leaf: Leaf, column: Column, value: Callable[[Leaf, Column, bool], Column | None], inside: bool = False) -> Column | None:
    """``column`` with ``value`` applied to every leaf at any depth; None where no leaf changes, so that nothing is rebuilt in vain.

    ``inside`` tells ``value`` that the leaf is below a list or map, where no Python can run.
    """
    if leaf.shape in ("value", "variant"):
        return value(leaf, column, inside)
    if leaf.shape == "struct":
        parts = [(x.name, decoded(x, column.getField(x.name), value, inside)) for x in leaf.below]
        if all(new is None for _, new in parts):
            return None
        whole = F.struct(*[(column.getField(n) if new is None else new).alias(n) for n, new in parts])
        return F.when(column.isNotNull(), whole)
    changed: list[bool] = []

    def inner(x: Leaf) -> Callable[[Column], Column]:
        def one(c: Column) -> Column:
            new = decoded(x, c, value, True)
            changed.append(new is not None)
            return c if new is None else new

        return one

    if leaf.shape == "list":
        out = F.transform(column, inner(leaf.below[0]))
    else:
        key, val = map(inner, leaf.below)
        out = F.map_from_arrays(F.transform(F.map_keys(column), key), F.transform(F.map_values(column), val))
    return out if any(changed) else None


#: Names of the parser hooks and the leaves that they take.
HOOKS = ("uuid", "float16", "nanos", "json", "date", "timestamp", "string", "geometry", "geography", "decimal")


def hook_of(leaf: Leaf, geo: dict[str, str] | None = None) -> str | None:
    """The hook that decodes a leaf; ``geo`` names top-level columns that hold WKB without an annotation."""
    note = leaf.annotation
    if leaf.name in (geo or {}):
        return geo[leaf.name]
    if note.startswith(("GEOMETRY", "GEOGRAPHY")):
        return note.split("(")[0].lower()
    if note in ("UUID", "FLOAT16", "JSON", "DATE"):
        return note.lower()
    if note.startswith("TIMESTAMP("):
        return "nanos" if "NANOS" in note else "timestamp"
    if note.startswith("DECIMAL("):
        return "decimal"
    if leaf.physical == "BINARY" and note in ("", "STRING", "ENUM"):
        return "string" if note == "" else None
    return None


def session_zone_is_utc(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z")
