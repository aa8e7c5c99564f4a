import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "l_extendedprice"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_queries_match_sql(spark):
    import os

    import duckdb
    import pytest

    from marlspar import queries

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        cursor = db.execute(sql)
        columns = [c[0] for c in cursor.description]
        want = sorted(repr(dict(zip(columns, r, strict=True))) for r in cursor.fetchall())
        assert sorted(df.columns) == sorted(columns), name
        assert sorted(repr({c: r[c] for c in columns}) for r in df.collect()) == want, name


def test_bloom_probe_is_exact_where_the_filter_is_full(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from marlspar import queries

    full = list(range(900_000))  # over four times the keys that its filter is made for
    for name, keys in {"full": full, "gaps": [3 * k for k in full], "gaps_nulls": [*(3 * k for k in full), None], "held": [*queries._PROBES, None], "few_nulls": [None, 7], "nulls": [None], "empty": []}.items():
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"o_custkey": pa.array(keys, pa.int64())}), tmp_path / name / "orders.parquet")
        db = duckdb.connect()
        db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path / name}/orders.parquet'")
        want = db.execute(queries.ORACLES["bloom_probe"]).fetchall()
        got = [tuple(r) for r in queries.QUERIES["bloom_probe"](spark, str(tmp_path / name)).collect()]
        assert sorted(got) == sorted(want), name
