"""Row ranges, ordering, projection, sources, footers, types and chunks."""

import http.server
import json
import threading

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import marlspar as m
from marlspar.plans.rowgroups import plan_groups
from marlspar.plans.schema import is_flat, is_list_like, is_map_like, max_definition_level, max_repetition_level, physical_columns, schema_path, schema_tree

TABLE = pa.table({"a": ["abc", "abc", "abc", None, "abc"], "b": pa.array([1, 2, 3, 4, 5], pa.int64()), "c": [2.0, 3.0, 4.0, 5.0, 2.0], "d": [True, True, True, True, False], "e": pa.array([[1, 2, 3], None, None, [1, 2, 3], [1, 2]], pa.list_(pa.int32()))})


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("query") / "five.parquet")
    pq.write_table(TABLE, p, row_group_size=2)
    return p


def b_of(df):
    return [r["b"] for r in df.collect()]


def test_read_ranges_come_before_filters(spark, path):
    assert b_of(m.read(spark, path)) == [1, 2, 3, 4, 5]
    assert b_of(m.read(spark, path, row_start=1, row_end=3)) == [2, 3]
    assert b_of(m.read(spark, path, row_start=3, row_end=99)) == [4, 5]
    assert b_of(m.read(spark, path, row_start=1, row_end=4, filter={"c": {"$gt": 3}})) == [3, 4]


def test_query_slices_after_filters(spark, path):
    assert b_of(m.query(spark, path, filter={"c": {"$gte": 3}}, row_start=1, row_end=3)) == [3, 4]
    assert b_of(m.query(spark, path, filter={"c": {"$gte": 3}}, row_end=1)) == [2]
    assert b_of(m.query(spark, path, filter={"c": {"$gte": 3}}, row_start=2)) == [4]
    assert b_of(m.query(spark, path, row_start=1, row_end=2)) == [2]
    with pytest.raises(m.QueryError, match="rowStart must be positive"):
        m.query(spark, path, row_start=-1)


def test_order_by(spark, path):
    df = m.query(spark, path, order_by="c", row_end=3)
    assert df.columns == ["__index__", "a", "b", "c", "d", "e"] and [(r["__index__"], r["b"]) for r in df.collect()] == [(0, 1), (4, 5), (1, 2)]
    assert b_of(m.query(spark, path, order_by="c", filter={"b": {"$gt": 1}}, columns=["b"])) == [5, 2, 3, 4]
    assert m.query(spark, path, order_by="c", columns=["b"]).columns == ["__index__", "b"]
    assert b_of(m.query(spark, path, order_by="a")) == [1, 2, 3, 5, 4]
    with pytest.raises(m.ColumnNotFound, match="orderBy column not found: z"):
        m.query(spark, path, order_by="z")


def test_null_numbers_rank_as_zero_and_nan_last(spark, tmp_path):
    p = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"i": range(6), "k": pa.array([2.0, None, -1.0, float("nan"), 0.0, None])}), p)
    assert [r["i"] for r in m.query(spark, p, order_by="k").collect()] == [2, 1, 4, 5, 0, 3]


def test_own_index_column_wins(spark, tmp_path):
    p = str(tmp_path / "i.parquet")
    pq.write_table(pa.table({"__index__": [7, 8], "k": [2, 1]}), p)
    assert [tuple(r) for r in m.query(spark, p, order_by="k").collect()] == [(8, 1), (7, 2)]
    assert [tuple(r) for r in m.read_rows(spark, p, [1]).collect()] == [(8, 1)]


def test_projection(spark, path):
    assert m.read(spark, path, columns=["c", "b", "c"], row_format="array").columns == ["c", "b", "c"]
    assert m.read(spark, path, columns=["c", "b", "c", "zz"]).columns == ["b", "c"]
    assert m.read(spark, path, columns=[]).count() == 5
    with pytest.raises(m.ColumnNotFound, match="parquet column not found: zz"):
        m.read(spark, path, columns=["zz"], row_format="array")
    with pytest.raises(m.QueryError, match="rowFormat"):
        m.read(spark, path, filter={"b": 1}, row_format="array")
    assert m.read_objects(spark, path, columns=["b", "e"], row_end=2) == [{"b": 1, "e": [1, 2, 3]}, {"b": 2, "e": None}]
    assert m.read_column(spark, path, ["c"]).to_pylist() == TABLE.column("c").to_pylist()
    with pytest.raises(m.QueryError, match="exactly one"):
        m.read_column(spark, path, ["b", "c"])


def test_read_rows(spark, path):
    want = [(1, 2), (4, 5)]
    assert sorted((r["__index__"], r["b"]) for r in m.read_rows(spark, path, [4, 1, 99]).collect()) == want
    assert sorted((r["__index__"], r["b"]) for r in m.read_rows(spark, path, [4, 1], inline=1).collect()) == want
    assert m.read_rows(spark, path, []).count() == 0


def test_many_files_count_positions_through(spark, tmp_path):
    for k in range(3):
        pq.write_table(pa.table({"b": range(10 * k, 10 * k + 10)}), str(tmp_path / f"p{k}.parquet"))
    assert sorted(b_of(m.read(spark, str(tmp_path), row_start=8, row_end=23))) == list(range(8, 23))
    assert [r["__index__"] for r in m.query(spark, str(tmp_path), order_by="b", row_start=12, row_end=15).collect()] == [12, 13, 14]
    assert m.count_rows(spark, str(tmp_path)) == 30
    assert {(r["row_group"], r["n_rows"]) for r in m.footer_frame(spark, str(tmp_path)).collect()} == {(0, 10)}


def test_bytes_and_sources(spark, path):
    data = open(path, "rb").read()
    for source in (data, m.MemorySource(data), m.FileSource(path), m.CachedSource(m.FileSource(path)), m.CachedSource(m.FileSource(path), whole_below=10)):
        assert b_of(m.read(spark, source)) == [1, 2, 3, 4, 5]
    s = m.CachedSource(m.MemorySource(b"0123456789"), whole_below=2)
    assert (s.slice(2, 4), s.slice(-3), s.slice(8), s.slice(2, 4)) == (b"23", b"789", b"89", b"23")
    for bad in ((-3, 2), (5, 2)):
        with pytest.raises(m.QueryError):
            s.slice(*bad)


class Handler(http.server.BaseHTTPRequestHandler):
    data, ranges, head, asked = b"", True, True, []

    def do_HEAD(self):
        self.send_response(200 if self.head else 403)
        if self.head:
            self.send_header("Content-Length", str(len(self.data)))
        self.end_headers()

    def do_GET(self):
        self.asked.append(self.headers.get("Range"))
        part, status = self.data, 200
        if self.ranges and (r := self.headers.get("Range")):
            a, b = map(int, r.removeprefix("bytes=").split("-"))
            part, status = self.data[a : b + 1], 206
        self.send_response(status)
        if status == 206:
            self.send_header("Content-Range", f"bytes {a}-{b}/{len(self.data)}")
        self.send_header("Content-Length", str(len(part)))
        self.end_headers()
        self.wfile.write(part)

    def log_message(self, *args):
        pass


@pytest.mark.parametrize(("ranges", "head"), [(True, True), (True, False), (False, True), (False, False)])
def test_urls(spark, path, ranges, head):
    kind = type("H", (Handler,), {"data": open(path, "rb").read(), "ranges": ranges, "head": head, "asked": []})
    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), kind) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_port}/x"
        assert m.url_size(url) == len(kind.data)
        source = m.UrlSource(url)
        assert source.slice(4, 9) == kind.data[4:9] and source.slice(-4) == b"PAR1"
        assert b_of(m.read(spark, source)) == [1, 2, 3, 4, 5]
        if not ranges and head:
            assert len(kind.asked) == 1
        server.shutdown()


def test_footer_and_schema(spark, path):
    footer = m.read_footer(spark, path)
    assert footer.rows == 5 and [g.rows for g in footer.groups] == [2, 2, 1]
    chunk = footer.groups[0].chunk("b")
    assert (chunk.minimum, chunk.maximum, chunk.null_count, chunk.physical) == (1, 2, 0, "INT64")
    tree = schema_tree(footer.schema)
    assert physical_columns(tree) == ["a", "b", "c", "d", "e.list.element"]
    nodes = schema_path(tree, ["e", "list", "element"])
    assert (max_definition_level(nodes), max_repetition_level(nodes)) == (3, 1)
    assert is_list_like(schema_path(tree, ["e"])[-1]) and not is_map_like(schema_path(tree, ["e"])[-1]) and is_flat(schema_path(tree, ["b"]))
    with pytest.raises(m.QueryError, match="schema element not found"):
        schema_path(tree, ["e", "nope"])
    columns = {(r["row_group"], r["column"]): r for r in m.footer_frame(spark, path, "columns").collect()}
    assert columns[1, "b"]["min_value"] == "3" and len(columns) == 15
    assert m.footer_frame(spark, path, "files").first()["n_rows"] == 5


@pytest.mark.parametrize(("data", "why"), [(b"PAR1", "too short"), (b"PAR1" + b"x" * 20, "footer != PAR1"), (b"PAR1" + b"\xff\xff\xff\x7fPAR1" * 2, "metadata length")])
def test_broken_files(spark, data, why):
    with pytest.raises(m.FormatError, match=why):
        m.read(spark, data)


def test_pages_and_blooms(spark, tmp_path):
    p = str(tmp_path / "bloom")
    spark.range(2000).selectExpr("id", "cast(id * 3 as int) code", "concat('k', id) s").coalesce(1).write.option("parquet.bloom.filter.enabled#code", "true").option("parquet.bloom.filter.expected.ndv#code", "2000").option("parquet.bloom.filter.enabled#s", "true").option("parquet.bloom.filter.expected.ndv#s", "2000").parquet(p)
    file = next(str(x) for x in (tmp_path / "bloom").iterdir() if x.name.startswith("part"))
    assert m.bloom_might_contain(spark, file, "code", 300) == [True] and m.bloom_might_contain(spark, file, "code", 301) == [False]
    assert m.bloom_might_contain(spark, file, "s", "k17") == [True] and m.bloom_might_contain(spark, file, "id", 1) == [None]
    assert [g.why for g in plan_groups(spark, file, filter={"code": {"$eq": 301}}, use_bloom_filters=True)] == ["bloom filter"]
    assert [g.read for g in plan_groups(spark, file, filter={"code": {"$in": [301, 300]}}, use_bloom_filters=True)] == [True]
    for flags in ({"bloom_filters": False}, {"page_index": False}, {}):
        assert m.read(spark, file, filter={"code": {"$in": [300, 301]}}, **flags).count() == 1
    pages = m.page_index(spark, file).filter("column = 'id'").collect()
    assert pages and pages[0]["first_row"] == 0 and pages[0]["min_bytes"] == bytes(8)


def test_group_plans(spark, path):
    read_ = lambda q, **k: [g.group for g in plan_groups(spark, path, filter=q, **k) if g.read]
    assert read_({"b": {"$gt": 4}}) == [2] and read_({"b": 3}) == [1] and read_({"b": {"$ne": 5}}) == [0, 1]
    assert read_({"$or": [{"b": 1}, {"b": 5}]}) == [0, 2] and read_({"$and": [{"b": {"$gte": 3}}, {"b": {"$lt": 5}}]}) == [1]
    assert read_({"$nor": [{"b": 1}]}) == [0, 1, 2] and read_({"b": {"$in": [9, 3]}}) == [1]
    assert read_({"c": {"$ne": 2.0}}) == [0, 1, 2] and read_(None, row_start=2, row_end=4) == [1]
    assert read_({"a": {"$eq": "abd"}}) == [] and read_({"a": {"$eq": None}}) == [1]


def test_types_that_spark_refuses(spark, tmp_path):
    p = str(tmp_path / "types.parquet")
    halves = np.array([1.0, -0.0, 5.9604645e-08, 65504, -2], dtype=np.float16)
    pq.write_table(pa.table({"h": pa.array(halves), "n": pa.array([1_700_000_000_123_456_789, -1, 0, None, 1], pa.timestamp("ns", "UTC")), "t": pa.array([1, 2, 3, 4, 5], pa.time64("us")), "ms": pa.array([1, 2, 3, 4, 5], pa.time32("ms")), "u": pa.array([bytes(range(16))] * 5, pa.uuid()), "u64": pa.array([0, 1, 2, 3, 2**64 - 1], pa.uint64()), "raw": pa.array([b"x\xc3\xa9", None, b"", b"y", b"z"]), "l": pa.array([[1], None, [], [2], [3]], pa.list_(pa.int64())), "p": pa.array([{"q": 1}] * 5)}), p)
    rows = m.read(spark, p).collect()
    assert [r["h"] for r in rows] == [float(x) for x in halves] and str(rows[1]["h"]) == "-0.0"
    assert rows[0]["n"].microsecond == 123456 and rows[3]["n"] is None and rows[1]["n"].microsecond == 999999
    assert [r["t"] for r in rows] == [1, 2, 3, 4, 5] == [r["ms"] for r in rows]
    assert rows[0]["u"] == "00010203-0405-0607-0809-0a0b0c0d0e0f"
    assert rows[4]["u64"] == 2**64 - 1 and rows[0]["raw"] == "xé" and rows[0]["p"]["q"] == 1 and rows[2]["l"] == []
    assert bytes(m.read(spark, p, utf8=False).first()["raw"]) == b"x\xc3\xa9"
    assert m.read(spark, p, filter={"u": "00010203-0405-0607-0809-0a0b0c0d0e0f", "h": {"$lt": 0}}).count() == 1
    assert m.read(spark, p, parsers={"uuid": lambda c: c.substr(1, 1)}).first()["u"] == b"\x00"


@pytest.mark.parametrize("options", [{"compression": "brotli"}, {"use_byte_stream_split": ["x", "h"], "use_dictionary": False}])
def test_files_that_spark_cannot_read(spark, tmp_path, options):
    p = str(tmp_path / "odd.parquet")
    halves = np.array([1.0, -2.0, 0.5], dtype=np.float16)
    pq.write_table(pa.table({"x": [1.5, None, -3.0], "h": pa.array(halves), "s": ["a", None, "c"], "t": pa.array([1, 2, 3], pa.timestamp("us", "UTC")), "p": [{"q": [1, 2]}, None, {"q": None}]}), p, row_group_size=2, **options)
    assert [(r["x"], r["h"], r["s"], r["p"] and r["p"]["q"]) for r in m.read(spark, p).collect()] == [(1.5, 1.0, "a", [1, 2]), (None, -2.0, None, None), (-3.0, 0.5, "c", None)]
    assert [r["s"] for r in m.query(spark, p, filter={"x": {"$lt": 1}}, row_start=1).collect()] == ["c"]
    assert [r["__index__"] for r in m.query(spark, p, order_by="x").collect()] == [2, 1, 0]


@pytest.mark.parametrize("codec", ["none", "snappy", "gzip", "lz4", "zstd"])
def test_codecs(spark, tmp_path, codec):
    p = str(tmp_path / "c.parquet")
    pq.write_table(TABLE, p, compression=codec)
    assert b_of(m.read(spark, p)) == [1, 2, 3, 4, 5]
    assert m.snappy_uncompress(pa.compress(b"abc" * 50, codec="snappy", asbytes=True), 150) == b"abc" * 50


def point(x, y):
    return b"\x01\x01\x00\x00\x00" + np.array([x, y], dtype="<f8").tobytes()


def test_geometry(spark, tmp_path):
    from marlspar.functions.geo import geo_crs, wkb_to_geojson

    p = str(tmp_path / "geo.parquet")
    meta = {"geo": json.dumps({"columns": {"g": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 4326}}}, "h": {"encoding": "WKB", "edges": "spherical"}}})}
    pq.write_table(pa.table({"g": [point(1, 2), None], "h": [point(3, 4), point(5, 6)]}).replace_schema_metadata(meta), p)
    table = m.ParquetTable(spark, p)
    assert table.geo == {"g": "geometry", "h": "geography"} and geo_crs(table.footer.key_values) == {"g": "EPSG:4326"}
    assert [tuple(r) for r in m.read(spark, table).collect()] == [('{"type":"Point","coordinates":[1.0,2.0]}', '{"type":"Point","coordinates":[3.0,4.0]}'), (None, '{"type":"Point","coordinates":[5.0,6.0]}')]
    assert bytes(m.read(spark, p, geoparquet=False, utf8=False).first()["g"]) == point(1, 2)
    count = lambda n: np.array([n], dtype="<u4").tobytes()
    line = b"\x01" + count(2) + count(2) + np.arange(4, dtype="<f8").tobytes()
    assert wkb_to_geojson(line) == {"type": "LineString", "coordinates": [[0, 1], [2, 3]]}
    z = b"\x00" + np.array([1001], dtype=">u4").tobytes() + np.arange(3, dtype=">f8").tobytes()
    assert wkb_to_geojson(z) == {"type": "Point", "coordinates": [0, 1, 2]}
    both = b"\x01" + count(7) + count(2) + line + z
    assert [g["type"] for g in wkb_to_geojson(both)["geometries"]] == ["LineString", "Point"]
    ring = b"\x01" + count(3) + count(1) + count(3) + np.zeros(6, dtype="<f8").tobytes()
    assert wkb_to_geojson(b"\x01" + count(6) + count(1) + ring)["coordinates"] == [[[[0, 0]] * 3]]
    with pytest.raises(ValueError, match="Unsupported geometry type"):
        wkb_to_geojson(b"\x01" + count(99))


def test_json_columns_become_variants(spark):
    from pyspark.sql import functions as F

    from marlspar.functions.decode import json_value

    rows = spark.createDataFrame([('{"k": [1, {"z": null}]}',), ("broken",)], "s string").select(json_value(F.col("s")).alias("v")).collect()
    assert m.to_json(rows[0]["v"]) == {"k": [1, {"z": None}]} and rows[1]["v"] is None


def test_chunks_and_callbacks(spark, path):
    chunks = list(m.iter_chunks(spark, path, columns=["b", "e"], rows=2))
    assert m.flatten(c.data.to_pylist() for c in chunks if c.column == "b") == [1, 2, 3, 4, 5]
    assert all(c.row_end - c.row_start == len(c.data) <= 2 for c in chunks)
    seen, pages, done = [], [], []
    m.for_chunks(spark, path, on_chunk=seen.append, on_page=pages.append, on_complete=done.extend, columns=["b"], filter={"b": {"$gt": 3}})
    assert m.flatten(c.data.to_pylist() for c in seen) == [1, 2, 3, 4, 5] and pages and [r["b"] for r in done] == [4, 5]
    m.for_chunks(spark, path)


def test_leaves_of_structs(spark, tmp_path):
    p = str(tmp_path / "s.parquet")
    pq.write_table(pa.table({"p": [{"q": 1, "r": {"s": "x"}}, {"q": 2, "r": {"s": None}}]}), p)
    assert {c.column: c.data.to_pylist() for c in m.iter_leaves(spark, p)} == {"p.q": [1, 2], "p.r.s": ["x", None]}


def test_streams_of_files(spark, path, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.parquet").write_bytes(open(path, "rb").read())
    schema = m.read(spark, path).schema
    df = m.stream(spark, str(folder), schema, filter={"b": {"$gte": 3}}, columns=["b", "a"], files_per_trigger=1)
    query = df.writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("matched").columns == ["a", "b"] and sorted(r["b"] for r in spark.table("matched").collect()) == [3, 4, 5]


def test_values():
    from datetime import date, datetime

    assert m.to_json({"a": [b"\x01\x02", -0.0, float("nan"), datetime(2020, 1, 2, 3, 4, 5, 678000), date(2020, 1, 2)]}) == {"a": [[1, 2], 0.0, None, "2020-01-02T03:04:05.678Z", "2020-01-02T00:00:00.000Z"]}
    assert m.equals({"a": [1, 2]}, {"a": [1, 2]}) and not m.equals([1], [1, 2]) and not m.equals(True, 1) and m.equals(True, 1, strict=False) and m.equals("5", 5, strict=False)
