"""Results as chunks, and filters over streams of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import compile_filter
from ..operators.query import read
from ..sources.table import POSITION, ParquetTable


@dataclass
class ColumnChunk:
    """Values of one column at positions [row_start, row_end)."""

    column: str
    data: object  # Arrow array
    row_start: int
    row_end: int


def iter_chunks(spark: SparkSession, source, columns: list[str] | None = None, row_start: int = 0, row_end: int | None = None, rows: int = 10_000, **options) -> Iterator[ColumnChunk]:
    """Column chunks in file order, unfiltered: an Arrow array for each column and each run of up to ``rows`` rows.

    Partitions come to the driver one at a time, so its memory holds one of them at most.
    """
    import pyarrow as pa

    table = source if isinstance(source, ParquetTable) else ParquetTable(spark, source, **options)
    names = [n for n in table.names if columns is None or n in columns]
    df = table.frame(positions=True, within=(row_start, row_end)).where(F.col(POSITION) >= row_start)
    if row_end is not None:
        df = df.where(F.col(POSITION) < row_end)
    df = df.select(POSITION, *[F.col(f"`{n}`") for n in names]).repartitionByRange(POSITION).sortWithinPartitions(POSITION) if len(table.files) > 1 else df.select(POSITION, *[F.col(f"`{n}`") for n in names])

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[0].as_py()], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["first", "data"])

    packed = df.mapInArrow(pack, "first long, data binary")
    for row in packed.toLocalIterator():
        for batch in pa.ipc.open_stream(bytes(row["data"])):
            for i, name in enumerate(names, start=1):
                yield ColumnChunk(name, batch.column(i), row["first"], row["first"] + batch.num_rows)


def iter_leaves(spark: SparkSession, source, **options) -> Iterator[ColumnChunk]:
    """Chunks of the leaves: structs come apart into dotted columns, lists stay whole. Spark hides page bounds, so runs of rows stand for pages."""
    import pyarrow as pa

    for chunk in iter_chunks(spark, source, **options):
        stack = [(chunk.column, chunk.data)]
        while stack:
            name, data = stack.pop()
            if pa.types.is_struct(data.type):
                stack += [(f"{name}.{f.name}", part) for f, part in reversed(list(zip(data.type, data.flatten(), strict=True)))]
            else:
                yield ColumnChunk(name, data, chunk.row_start, chunk.row_end)


def for_chunks(spark: SparkSession, source, on_chunk: Callable[[ColumnChunk], None] | None = None, on_page: Callable[[ColumnChunk], None] | None = None, on_complete: Callable[[list[dict]], None] | None = None, **options) -> None:
    """Callbacks over one read: chunks and leaves unfiltered, complete rows filtered. With none, the rows are decoded and dropped."""
    scan = {k: v for k, v in options.items() if k in ("columns", "row_start", "row_end")}
    if on_chunk is not None:
        for chunk in iter_chunks(spark, source, **scan):
            on_chunk(chunk)
    if on_page is not None:
        for chunk in iter_leaves(spark, source, **scan):
            on_page(chunk)
    df = read(spark, source, **options)
    if on_complete is not None:
        on_complete([r.asDict(recursive=True) for r in df.collect()])
    elif on_chunk is None and on_page is None:
        df.write.format("noop").mode("overwrite").save()


def stream(spark: SparkSession, folder: str, schema: T.StructType, filter: dict | None = None, columns: list[str] | None = None, strict: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over files that arrive in a folder, under the same filter and projection."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    test = compile_filter(filter, schema, strict)
    df = df if test is None else df.where(test)
    return df if columns is None else df.select(*[F.col(f"`{c}`") for c in schema.names if c in set(columns)])
