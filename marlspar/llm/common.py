"""Helpers shared by the corpus operators: shared storage, written tables, parallelism from plan statistics."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh temporary one only in local mode, where one machine sees all of it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlspar-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts, by one aggregation; plan estimates are no bound where a table isn't read straight from files."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0]


def partitions_for(docs: DataFrame, bytes_each: int) -> int:
    """Partition count that keeps about ``bytes_each`` of text in a partition, never below the session's."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(docs) // bytes_each))


def read_sf(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(column: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def sub_batches(batches, most_bytes: int = 4 << 20, column: int = 1):
    """Cut Arrow batches so that one slice holds about ``most_bytes`` of text, but always a row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


_KEPT: dict = {}


def kept(key, make):
    """What a Python worker keeps between tasks: one heavy object at a time, so that operators that follow each other don't add up."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
