"""Which row groups a filter can skip: typed statistics, and bloom answers for targets of every kind."""

import datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import marlspar as m
from marlspar.plans.rowgroups import can_skip, plan_groups
from marlspar.sources.footer import Chunk, Group, _plain_bytes, read_footer

UTC = datetime.timezone.utc


@pytest.fixture(scope="module")
def dated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "dated.parquet")
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(30)]
    times = [datetime.datetime(2024, 1, 1, k % 24, tzinfo=UTC) + datetime.timedelta(days=k) for k in range(30)]
    table = {"d": days, "t": pa.array(times, pa.timestamp("us", "UTC")), "local": pa.array([t.replace(tzinfo=None) for t in times], pa.timestamp("ms")), "n": pa.array([t for t in times], pa.timestamp("ns", "UTC")), "x": pa.array([Decimal(k) / 10 for k in range(30)], pa.decimal128(9, 1)), "wide": pa.array([Decimal(k - 5) for k in range(30)], pa.decimal128(30, 0)), "u": pa.array([2**32 - 30 + k for k in range(30)], pa.uint32())}
    pq.write_table(pa.table(table), path, row_group_size=10)
    return path


def groups_read(spark, path, query):
    return [g.group for g in plan_groups(spark, path, filter=query) if g.read]


@pytest.mark.parametrize(
    ("query", "groups"),
    [
        ({"d": {"$lt": datetime.date(2024, 1, 5)}}, [0]),
        ({"d": {"$eq": datetime.date(2024, 1, 25)}}, [2]),
        ({"d": {"$gte": datetime.datetime(2024, 1, 11), "$lt": datetime.datetime(2024, 1, 12)}}, [1]),
        ({"t": {"$gt": datetime.datetime(2024, 1, 25, tzinfo=UTC)}}, [2]),
        ({"local": {"$in": [datetime.datetime(2024, 1, 2, 1), datetime.datetime(2024, 1, 12, 11)]}}, [0, 1]),
        ({"n": {"$lt": datetime.datetime(2024, 1, 2, tzinfo=UTC)}}, [0]),
        ({"x": {"$eq": Decimal("1.5")}}, [1]),
        ({"x": {"$eq": 0.9}}, [0]),
        ({"x": {"$gt": 1.9}}, [2]),
        ({"wide": {"$lt": 0}}, [0]),
        ({"u": {"$gte": 2**32 - 5}}, [2]),
        ({"d": {"$eq": "2024-01-25"}}, [0, 1, 2]),
        ({"d": {"$gt": 5}}, [0, 1, 2]),
    ],
)
def test_typed_statistics_prune(spark, dated, query, groups):
    assert groups_read(spark, dated, query) == groups
    held = m.read(spark, dated, filter=query).count()
    skipped = [g for g in range(3) if g not in groups]
    assert all(m.read(spark, dated, filter=query, row_start=10 * g, row_end=10 * g + 10).count() == 0 for g in skipped)
    assert held == sum(m.read(spark, dated, filter=query, row_start=10 * g, row_end=10 * g + 10).count() for g in groups)


def test_statistics_have_their_types(spark, dated):
    low = {c.path: c.minimum for c in read_footer(spark, dated).groups[0].chunks}
    assert low["d"] == datetime.date(2024, 1, 1) and low["t"] == low["n"] == datetime.datetime(2024, 1, 1, tzinfo=UTC)
    assert low["local"] == datetime.datetime(2024, 1, 1) and low["x"] == Decimal("0.0") and low["wide"] == -5 and low["u"] == 2**32 - 30


def group(**columns):
    return Group(10, 100, 0, [Chunk(n, p, "", "SNAPPY", [], 10, 10, 10, 4, None, 50, None, None, None) for n, p in columns.items()])


def test_bloom_answers_for_every_kind_of_target():
    g = group(a="INT64", b="INT64")
    no = {("b", "int", 5): False, ("b", "int", 1): False}
    assert can_skip(g, {"b": {"$eq": 5}}, no) and can_skip(g, {"b": 5}, no)
    assert not can_skip(g, {"a": {"$eq": [1]}}, no) and can_skip(g, {"a": {"$eq": [1]}, "b": {"$eq": 5}}, no)
    assert not can_skip(g, {"a": {"$in": []}, "b": {"$gt": 2}}, no)
    assert not can_skip(g, {"b": {"$eq": {"x": 1}}}, no) and not can_skip(g, {"b": {"$in": [5, {"x": 1}]}}, no)
    assert not can_skip(g, {"b": {"$in": [5, [1]]}}, no) and not can_skip(g, {"b": {"$in": [5, None]}}, no)
    assert not can_skip(g, {"b": {"$eq": True}}, no) and not can_skip(g, {"b": {"$eq": 1.0}}, no)
    assert can_skip(g, {"b": {"$in": [5, 1]}}, no) and not can_skip(g, {"b": {"$in": [5, 2]}}, no)


@pytest.mark.parametrize(
    ("value", "physical", "note", "data"),
    [
        (5, "INT32", "", b"\x05\0\0\0"), (5.0, "INT32", "", b"\x05\0\0\0"), (5.5, "INT32", "", None), ("abc", "INT32", "", None), (1 << 40, "INT32", "", None), (True, "INT32", "", None),
        (-1, "INT64", "INTEGER(64,true)", b"\xff" * 8), (float("nan"), "INT64", "", None), (float("inf"), "INT32", "", None), (5, "INT32", "DECIMAL(9,2)", None), (5, "INT32", "DATE", None),
        (5, "BINARY", "STRING", None), ("é", "BINARY", "STRING", "é".encode()), (b"\0", "BINARY", "", b"\0"), ("x", "FIXED_LEN_BYTE_ARRAY", "", None), (b"x", "FIXED_LEN_BYTE_ARRAY", "", b"x"),
        (0.1, "FLOAT", "", None), (0.5, "FLOAT", "", b"\0\0\0?"), (0.0, "DOUBLE", "", None), (1e300, "FLOAT", "", None), (5, "INT96", "", None), ([1], "INT64", "", None),
    ],
)
def test_plain_bytes_only_where_exact(value, physical, note, data):
    assert _plain_bytes(value, physical, note) == data


def test_filters_with_blooms_lose_no_rows(spark, tmp_path):
    p = str(tmp_path / "bloom")
    source = spark.range(200).selectExpr("cast(id * 2 as int) code", "array(cast(id as int)) l", "concat('k', id) s")
    source.coalesce(1).write.option("parquet.bloom.filter.enabled#code", "true").option("parquet.bloom.filter.enabled#s", "true").parquet(p)
    file = next(str(x) for x in (tmp_path / "bloom").iterdir() if x.name.startswith("part"))
    for query, read in (({"l": {"$eq": [3]}, "code": {"$eq": 6}}, True), ({"code": {"$eq": 5.5}}, True), ({"code": {"$in": [7, [8]]}}, True), ({"code": {"$eq": 7}}, False), ({"code": 7}, False), ({"s": {"$eq": 3}}, True), ({"code": {"$eq": {"x": 1}}}, True)):
        assert [g.read for g in plan_groups(spark, file, filter=query, use_bloom_filters=True)] == [read]
        assert read or m.read(spark, file, filter=query).count() == 0


def test_footers_tell_encodings_sizes_and_order(spark, tmp_path):
    path = str(tmp_path / "more.parquet")
    pq.write_table(pa.table({"s": ["a", "bc", None], "l": [[1], [2, 3], None]}), path, sorting_columns=[pq.SortingColumn(0, descending=True)])
    s, l = read_footer(spark, path).groups[0].chunks
    assert s.data_encodings == {"RLE_DICTIONARY": 1} and s.dictionary_encodings == {"PLAIN": 1}
    assert s.unencoded_bytes == 3 and s.definition_levels == [1, 2] and l.repetition_levels == [3, 1] and l.definition_levels == [1, 0, 0, 3]
    assert s.bounding_box is None and s.geometry_types is None
    assert m.footer_frame(spark, path).first()["sorting_columns"] == ["s desc"]
