"""Reading and querying Parquet tables; everything returns lazy DataFrames.

``read`` takes row ranges as positions in the file, before the filter; ``query`` filters first, orders, then slices.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ColumnNotFound, QueryError
from ..sources.table import POSITION, ParquetTable
from .filters import FLOATS, INTEGERS, compile_filter, filter_columns

INDEX = "__index__"


def _table(spark: SparkSession, source, options: dict) -> ParquetTable:
    return source if isinstance(source, ParquetTable) else ParquetTable(spark, source, **options)


def _select(df: DataFrame, names: list[str], columns: list[str] | None, row_format: str) -> DataFrame:
    """Object rows have each wanted column once in file order; array rows have them as asked, repeats kept."""
    if row_format == "array":
        wanted = names if columns is None else columns
        missing = [c for c in wanted if c not in names]
        if missing:
            raise ColumnNotFound(f"parquet column not found: {missing[0]}")
    else:
        wanted = names if columns is None else [n for n in names if n in set(columns)]
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def _check(table: ParquetTable, filter: dict | None, row_format: str) -> None:
    if row_format not in ("object", "array"):
        raise QueryError(f"parquet rowFormat not known: {row_format}")
    if filter and row_format == "array":
        raise QueryError('parquet filter requires rowFormat: "object"')


def _in_range(start: int, end: int | None) -> Column | None:
    tests = [F.col(POSITION) >= start] * bool(start) + ([F.col(POSITION) < end] if end is not None else [])
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def read(spark: SparkSession, source, columns: list[str] | None = None, filter: dict | None = None, filter_strict: bool = True, row_start: int = 0, row_end: int | None = None, row_format: str = "object", sql_nulls: bool = False, **options) -> DataFrame:
    """Rows at positions [row_start, row_end) that match ``filter``. ``columns=[]`` keeps the rows without columns.

    Files without a row in the range are not opened; a range over a small part of its files leaves out row groups too.
    """
    table = _table(spark, source, options)
    _check(table, filter, row_format)
    within = _in_range(row_start, row_end)
    only = None if columns is None else [*columns, *filter_columns(filter)]
    df = table.frame(positions=within is not None, within=(row_start, row_end), only=only)
    test = compile_filter(filter, df.schema, filter_strict, sql_nulls)
    if within is not None:
        df = df.where(within)
    if test is not None:
        df = df.where(test)
    return _select(df, table.names, columns, row_format)


def read_objects(spark: SparkSession, source, **options) -> list[dict]:
    """Rows of ``read`` as dicts, on the driver."""
    return [row.asDict(recursive=True) for row in read(spark, source, **options).collect()]


def read_column(spark: SparkSession, source, columns: list[str], **options):
    """One whole column as an Arrow array, on the driver."""
    if len(columns) != 1:
        raise QueryError(f"parquet read column needs exactly one column, not {len(columns)}")
    table = _table(spark, source, options)
    if columns[0] not in table.names:
        raise ColumnNotFound(f"parquet column not found: {columns[0]}")
    return table.frame().select(F.col(f"`{columns[0]}`")).toArrow().column(0).combine_chunks()


def sort_key(column: Column, kind: T.DataType) -> Column:
    """Ascending rank: null numbers, booleans and times count as 0; null texts, and NaN, come last."""
    if isinstance(kind, (*INTEGERS, *FLOATS, T.DecimalType)):
        return F.coalesce(column, F.lit(0)).asc()
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column, F.lit(False)).asc()
    if isinstance(kind, T.DateType):
        return F.coalesce(column, F.expr("date'1970-01-01'")).asc()
    if isinstance(kind, T.TimestampType):
        return F.coalesce(column, F.expr("timestamp_micros(0L)")).asc()
    if isinstance(kind, T.TimestampNTZType):
        return F.coalesce(column, F.expr("timestamp_ntz'1970-01-01 00:00:00'")).asc()
    return column.asc_nulls_last()


def _enough(table: ParquetTable, filter: dict, filter_strict: bool, sql_nulls: bool, wanted: int) -> tuple[int, int | None]:
    """Positions of the first files that hold ``wanted`` matches; four times as many files at each try."""
    ends = list(accumulate(table.row_counts()))
    n = 1
    while n < len(ends):
        df = table.frame(within=(0, ends[n - 1]))
        if df.where(compile_filter(filter, df.schema, filter_strict, sql_nulls)).limit(wanted).count() >= wanted:
            return 0, ends[n - 1]
        n *= 4
    return 0, None


def query(spark: SparkSession, source, filter: dict | None = None, order_by: str | None = None, row_start: int = 0, row_end: int | None = None, columns: list[str] | None = None, filter_strict: bool = True, sql_nulls: bool = False, early_stop: bool = False, **options) -> DataFrame:
    """Rows that match, in the order of ``order_by`` (ascending, ties by position), then the slice [row_start, row_end) of them.

    Ordering without a filter adds each row's position as ``__index__`` in front, unless the file has such a column. Ordered
    and sliced results come in order; with a slice Spark keeps only row_end rows in each task. ``early_stop`` first counts
    matches over growing runs of files and leaves out the files behind those that hold row_end of them.
    """
    if row_start < 0:
        raise QueryError("parquet rowStart must be positive")
    table = _table(spark, source, options)
    if order_by is not None and order_by not in table.names:
        raise ColumnNotFound(f"parquet orderBy column not found: {order_by}")
    if order_by is None and not filter:
        return read(spark, table, columns, None, filter_strict, row_start, row_end)
    sliced = row_start > 0 or row_end is not None
    within = _enough(table, filter, filter_strict, sql_nulls, row_end) if early_stop and order_by is None and row_end is not None else (0, None)
    df = table.frame(positions=sliced or order_by is not None, within=within)
    test = compile_filter(filter, df.schema, filter_strict, sql_nulls)
    if test is not None:
        df = df.where(test)
    if order_by is not None:
        df = df.orderBy(sort_key(F.col(f"`{order_by}`"), df.schema[order_by].dataType), F.col(POSITION).asc())
    elif sliced:
        df = df.orderBy(F.col(POSITION).asc())
    if row_start:
        df = df.offset(row_start)
    if row_end is not None:
        df = df.limit(max(0, row_end - row_start))
    if order_by is not None and not filter and INDEX not in table.names:
        wanted = table.names if columns is None else [n for n in table.names if n in set(columns)]
        return df.select(F.col(POSITION).alias(INDEX), *[F.col(f"`{c}`") for c in wanted])
    return _select(df, table.names, columns, "object")


def read_rows(spark: SparkSession, source, rows: Iterable[int], columns: list[str] | None = None, inline: int = 1000, **options) -> DataFrame:
    """Rows at given positions, with ``__index__`` in front unless the file has one.

    Up to ``inline`` positions go into the plan as literals; more are joined, and Spark broadcasts them if they are small.
    """
    table, rows = _table(spark, source, options), sorted(set(rows))
    within = (max(0, rows[0]), max(0, rows[-1] + 1)) if rows else (0, 0)
    df = table.frame(positions=True, within=within, only=columns)
    if len(rows) <= inline:
        df = df.where(F.col(POSITION).isin(*rows)) if rows else df.where(F.lit(False))
    else:
        df = df.join(spark.createDataFrame([(r,) for r in rows], f"{POSITION} long"), POSITION, "left_semi")
    wanted = table.names if columns is None else [n for n in table.names if n in set(columns)]
    head = [F.col(POSITION).alias(INDEX)] if INDEX not in table.names else []
    return df.select(*head, *[F.col(f"`{c}`") for c in wanted])


def count_rows(spark: SparkSession, source, **options) -> int:
    """Rows by the footers alone."""
    return sum(_table(spark, source, options).row_counts())


def cached(df: DataFrame) -> DataFrame:
    """Keep a result for further queries, spilling to disk where memory ends."""
    from pyspark import StorageLevel

    return df.persist(StorageLevel.MEMORY_AND_DISK)
