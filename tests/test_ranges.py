"""Row ranges open the files and row groups that they touch; URLs are read by ranges; early stop leaves later files out."""

import http.server
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import marlspar as m
from marlspar.sources.table import ParquetTable


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("many files+1%")
    for k in range(6):
        pq.write_table(pa.table({"i": pa.array(range(100 * k, 100 * k + 100)), "s": [f"k{k}"] * 100, "l": [[k]] * 100}), path / f"part {k}.parquet", row_group_size=20)
    (path / "_hidden").write_bytes(b"x")
    return str(path)


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    path = tmp_path_factory.mktemp("flat")
    for k in range(6):
        pq.write_table(pa.table({"i": pa.array(range(100 * k, 100 * k + 100)), "s": [f"k{k}"] * 100}), path / f"part{k}.parquet", row_group_size=20)
    return str(path)


def opened(df):
    return sorted(x.rpartition("/")[2].replace("%20", " ") for x in df.inputFiles())


@pytest.mark.parametrize(("start", "end", "files"), [(0, 100, [0]), (150, 160, [1]), (90, 210, [0, 1, 2]), (500, None, [5]), (0, None, [0, 1, 2, 3, 4, 5])])
def test_a_range_opens_overlapping_files(spark, folder, start, end, files):
    df = m.read(spark, folder, row_start=start, row_end=end)
    assert [r["i"] for r in df.orderBy("i").collect()] == list(range(600))[start:end]
    assert opened(df) == [f"part {k}.parquet" for k in files]
    rows = m.read_rows(spark, folder, [start, start + 1])
    assert [tuple(r)[:2] for r in rows.orderBy("i").collect()] == [(start, start), (start + 1, start + 1)]


def test_ranges_beyond_the_end(spark, folder):
    assert m.read(spark, folder, row_start=600).count() == 0 and m.read(spark, folder, row_start=5, row_end=5).count() == 0
    assert m.read_rows(spark, folder, []).count() == 0 and m.count_rows(spark, folder) == 600


def test_a_small_range_opens_overlapping_row_groups(spark, flat):
    table = ParquetTable(spark, flat)
    groups = table.frame(positions=True, within=(130, 150))
    assert "MapInArrow" in groups._jdf.queryExecution().toString()
    assert sorted(r["i"] for r in groups.collect()) == list(range(120, 160))
    df = m.read(spark, flat, row_start=130, row_end=150, columns=["s"], filter={"i": {"$gte": 140}})
    assert [tuple(r) for r in df.collect()] == [("k1",)] * 10
    assert "MapInArrow" not in ParquetTable(spark, flat).frame(within=(0, 590))._jdf.queryExecution().toString()


def test_early_stop_leaves_later_files_out(spark, folder):
    whole = m.query(spark, folder, filter={"i": {"$gte": 50}}, row_start=10, row_end=40)
    early = m.query(spark, folder, filter={"i": {"$gte": 50}}, row_start=10, row_end=40, early_stop=True)
    assert [r["i"] for r in early.collect()] == [r["i"] for r in whole.collect()] == list(range(60, 90))
    assert opened(early) == ["part 0.parquet"] and len(opened(whole)) == 6
    assert m.query(spark, folder, filter={"i": {"$gte": 590}}, row_end=40, early_stop=True).count() == 10


class Ranges(http.server.BaseHTTPRequestHandler):
    data, asked = b"", []

    def do_HEAD(self):
        self.send_response(200)
        self.send_header("Content-Length", str(len(self.data)))
        self.end_headers()

    def do_GET(self):
        a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
        type(self).asked.append(b + 1 - a)
        self.send_response(206)
        self.send_header("Content-Length", str(b + 1 - a))
        self.end_headers()
        self.wfile.write(self.data[a : b + 1])

    def log_message(self, *args):
        pass


def test_urls_are_read_by_ranges(spark, tmp_path):
    import os

    path = tmp_path / "wide.parquet"
    pq.write_table(pa.table({"i": pa.array(range(4000)), "x": pa.array([k / 7 for k in range(4000)]), "blob": [os.urandom(1000) for _ in range(4000)]}), path, row_group_size=1000, compression="none")
    Ranges.data, Ranges.asked = path.read_bytes(), []
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        source = m.UrlSource(f"http://127.0.0.1:{server.server_port}/wide.parquet")
        rows = m.read(spark, source, columns=["i"], row_start=1500, row_end=1600, utf8=False).collect()
        assert [r["i"] for r in rows] == list(range(1500, 1600))
        assert sum(Ranges.asked) < len(Ranges.data) / 2
        assert m.read(spark, source, columns=["x"], utf8=False).count() == 4000
    finally:
        server.shutdown()


def test_many_files_that_arrow_decodes(spark, tmp_path):
    """Their row groups come from footers that executors read."""
    for k in range(12):
        pq.write_table(pa.table({"i": pa.array(range(10 * k, 10 * k + 10)), "x": [k / 3] * 10}), tmp_path / f"part{k:02}.parquet", row_group_size=4, compression="brotli")
    folder = str(tmp_path)
    assert [r["i"] for r in m.read(spark, folder).orderBy("i").collect()] == list(range(120))
    assert [r["i"] for r in m.read(spark, folder, row_start=37, row_end=93).orderBy("i").collect()] == list(range(37, 93))
    assert [tuple(r)[:2] for r in m.read_rows(spark, folder, [119, 0]).orderBy("i").collect()] == [(0, 0), (119, 119)]
