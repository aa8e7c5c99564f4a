"""Row groups decoded by Arrow on the executors, for files that Spark's own reader cannot read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.decode import Leaf
from .footer import Footer
from .ranges import ByteSource, CachedSource, SourceFile

#: Codecs without a class in Spark, and encodings that its vectorised reader refuses.
CODECS, ENCODINGS = {"BROTLI"}, {"BYTE_STREAM_SPLIT"}


def needs_arrow(footer: Footer) -> bool:
    return any(c.codec in CODECS or ENCODINGS.intersection(c.encodings) for g in footer.groups for c in g.chunks)


def arrow_frame(spark: SparkSession, groups: list[tuple[str, int, int]], leaves: list[Leaf], position: str, remote: ByteSource | None = None) -> DataFrame:
    """Raw columns of row groups (path, number in the file, position of the first row), typed as Spark would read them, with
    each row's position; a task for some row groups each. ``remote`` is read by ranges in the place of the path.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names, kinds = [x.name for x in leaves], [to_arrow_type(x.kind) for x in leaves]

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def fit(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
            array = column.combine_chunks()
            array = array.storage if isinstance(array, pa.ExtensionArray) else array
            if pa.types.is_float16(array.type):
                return array.view(pa.binary(2)).cast(pa.binary())
            if pa.types.is_temporal(array.type) and pa.types.is_integer(kind):
                return array.view(pa.int64() if array.type.bit_width == 64 else pa.int32()).cast(kind)
            return array.cast(kind, safe=False)

        for batch in batches:
            for path, group, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if remote is not None:
                    file = pq.ParquetFile(pa.PythonFile(SourceFile(CachedSource(remote)), mode="r"))
                else:
                    store, local = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                    file = pq.ParquetFile(local, filesystem=store)
                table = file.read_row_group(group, columns=names)
                arrays = [fit(table.column(n), k) for n, k in zip(names, kinds, strict=True)]
                yield from pa.Table.from_arrays([*arrays, pa.array(range(first, first + table.num_rows), pa.int64())], names=[*names, position]).to_batches(max_chunksize=10_000)

    schema = T.StructType([*[T.StructField(x.name, x.kind) for x in leaves], T.StructField(position, T.LongType())])
    n = max(1, min(len(groups), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame(groups, "path string, row_group int, first_row long").repartitionByRange(n, "path", "row_group").sortWithinPartitions("path", "row_group").mapInArrow(run, schema)
