"""Conversions of leaves below structs, lists and maps equal those of flat columns; variants, plain and shredded."""

import datetime
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import marlspar as m

IDS = [uuid.UUID(int=k * 10**30 + 7).bytes for k in range(4)]
WKB = [struct.pack("<BIdd", 1, 1, k, -k) for k in range(4)]


def values(kind, raw):
    array = pa.array(raw, kind.storage_type if isinstance(kind, pa.BaseExtensionType) else kind)
    return pa.ExtensionArray.from_storage(kind, array) if isinstance(kind, pa.BaseExtensionType) else array


KINDS = {
    "half": (pa.float16(), [np.float16(x) for x in (1.5, -2.0, 0.25, 65504)]),
    "id": (pa.uuid(), IDS),
    "nanos": (pa.timestamp("ns", "UTC"), [1_700_000_000_123_456_789 + k for k in range(4)]),
    "doc": (pa.json_(), ['{"k": 1}', "[1, 2]", "3", "{}"]),
    "raw": (pa.binary(), [b"a", b"b", "é".encode(), b""]),
    "amount": (pa.decimal128(9, 2), [1, 2, 3, 4]),
}


def write(path, kinds=KINDS):
    flat = {n: values(k, raw) for n, (k, raw) in kinds.items()}
    nested = pa.StructArray.from_arrays(list(flat.values()), names=list(flat))
    inner = pa.StructArray.from_arrays([nested], names=["deep"])
    columns = {**flat, "s": inner, **{f"l_{n}": pa.ListArray.from_arrays(pa.array([0, 2, 2, 3, 4], pa.int32()), x) for n, x in flat.items()}}
    columns["m"] = pa.MapArray.from_arrays(pa.array([0, 1, 2, 3, 4], pa.int32()), pa.array(["a", "b", "c", "d"]), nested)
    columns["ls"] = pa.ListArray.from_arrays(pa.array([0, 1, 2, 3, 4], pa.int32()), nested)
    pq.write_table(pa.table(columns), path, store_schema=False)


@pytest.mark.parametrize("left_out", [None, "doc"])
def test_nested_leaves_equal_flat_ones(spark, tmp_path, left_out):
    path = str(tmp_path / "nested.parquet")
    kinds = {n: x for n, x in KINDS.items() if n != left_out}
    write(path, kinds)
    df = m.read(spark, path, decimal_as_double=True)
    for name in kinds:
        show = (lambda c: F.to_json(c)) if name == "doc" else (lambda c: c)
        deep, mapped, listed = F.col("s.deep").getField(name), F.map_values("m")[0].getField(name), F.col("ls")[0].getField(name)
        rows = df.select(show(F.col(name)), *[show(x) for x in (deep, mapped, listed)]).collect()
        assert len(rows) == 4
        for r in rows:
            assert r[0] == r[1] == r[2] == r[3] and r[0] is not None
        flat = [r[0] for r in rows]
        lists = df.select(F.transform(f"l_{name}", show)).collect()
        assert [r[0] for r in lists] == [flat[:2], [], flat[2:3], flat[3:]]
    first = df.select("half", "id", "raw", "amount", "nanos").first()
    assert (first["half"], first["id"], first["raw"], first["amount"]) == (1.5, str(uuid.UUID(bytes=IDS[0])), "a", 1.0)
    assert first["nanos"].microsecond == 123456


def test_null_structs_stay_null(spark, tmp_path):
    path = str(tmp_path / "null.parquet")
    kind = pa.struct([("id", pa.binary(16))])
    pq.write_table(pa.table({"s": pa.array([{"id": IDS[1]}, None, {"id": None}], kind), "t": values(pa.uuid(), IDS[:3])}), path)
    assert [r["s"] if r["s"] is None else r["s"]["id"] for r in m.read(spark, path).collect()][1:] == [None, None]


def test_parser_hooks_reach_nested_leaves(spark, tmp_path):
    path = str(tmp_path / "hooks.parquet")
    write(path)
    df = m.read(spark, path, parsers={"uuid": lambda c: F.hex(c)})
    r = df.select("id", F.col("s.deep.id"), F.col("l_id")[0], F.map_values("m")[0]["id"]).first()
    assert set(r) == {IDS[0].hex().upper()}


def test_geometry_in_lists(spark, tmp_path):
    from marlspar.functions.geo import geojson_lists
    from pyspark.sql import types as T

    df = spark.createDataFrame([([[bytearray(WKB[1])], None, []],), (None,)], "g array<array<binary>>")
    rows = df.select(geojson_lists(F.col("g"), T.ArrayType(T.ArrayType(T.BinaryType())))).collect()
    assert [r[0] for r in rows] == [[['{"type":"Point","coordinates":[1.0,-1.0]}'], None, []], None]


def test_variants_beside_types_that_force_a_schema(spark, tmp_path):
    """Spark writes shredded variants; a UUID column next to them makes the reader name every type itself."""
    folder = str(tmp_path / "variants")
    rows = spark.sql("""select id, parse_json(case when id % 3 = 0 then '{"a": ' || id || ', "b": [1, {"c": null}]}' when id % 3 = 1 then '"text"' else '[1.5, true]' end) v,
                        named_struct('p', parse_json('{"q": ' || id || '}')) s from range(9)""")
    rows.coalesce(1).write.parquet(folder)
    df = m.read(spark, folder)
    want = [{"a": 0, "b": [1, {"c": None}]}, "text", [1.5, True]]
    got = {r["id"]: (m.to_json(r["v"]), m.to_json(r["s"]["p"])) for r in df.collect()}
    assert [got[i][0] for i in range(3)] == want and got[4] == ("text", {"q": 4})
    from marlspar.functions import decode
    from marlspar.sources.footer import list_files, read_footer

    schema = decode.read_schema(decode.leaves(read_footer(spark, list_files(spark, folder)[0][0]).schema))
    assert schema["v"].dataType.simpleString() == "variant" and schema["s"].dataType.simpleString() == "struct<p:variant>"
    again = spark.read.schema(schema).parquet(folder)
    assert {r["id"]: (m.to_json(r["v"]), m.to_json(r["s"]["p"])) for r in again.collect()} == got


@pytest.mark.parametrize("sql", ["(1)::TINYINT", "300::SMALLINT", "70000", "5000000000", "1.25::DOUBLE", "0.5::FLOAT", "true", "NULL", "12.34::DECIMAL(9,2)", "DATE '2024-02-03'", "TIMESTAMP '2024-02-03 04:05:06.789'", "repeat('long text ', 20)", "{'k': [1, 2], 'n': NULL}", "[{'a': 1}, {'a': 2}]"])
def test_variant_values_of_another_writer(spark, tmp_path, sql):
    import duckdb

    path = str(tmp_path / "v.parquet")
    duckdb.sql(f"COPY (SELECT 1 AS i, ({sql})::VARIANT AS v) TO '{path}' (FORMAT PARQUET)")
    want = duckdb.sql(f"SELECT ({sql}) AS x").fetchall()[0][0]
    got = m.read_objects(spark, path)[0]["v"]
    got = got.toPython() if hasattr(got, "toPython") else got
    if isinstance(want, datetime.datetime):
        got = got.replace(tzinfo=None)
    assert got == want or float(got) == float(want)
