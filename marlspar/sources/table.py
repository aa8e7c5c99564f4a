"""A Parquet table: its base DataFrame with decoded columns and the position of every row."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import decode
from ..functions.geo import geo_columns, geojson, geojson_lists
from .arrow import arrow_frame, needs_arrow
from .footer import Footer, footer_frame, list_files, read_footer
from .ranges import ByteSource, UrlSource, footer_only

#: Hidden column with a row's position.
POSITION = "__position__"
#: Tables of more files join their first rows by a shuffle.
BROADCAST_FILES = 200_000
#: Row ranges over more files don't look for row groups in their footers.
FOOTERS = 64
#: Footers of up to so many files are read on the driver.
FEW = 8


@dataclass
class Options:
    """``parsers`` maps a hook's name (see ``decode.HOOKS``) to a function from Column to Column that replaces its decoding."""

    utf8: bool = True
    geoparquet: bool = True
    decimal_as_double: bool = False
    millis: bool = False
    json: bool = True
    bloom_filters: bool = True
    page_index: bool = True
    parsers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; a temporary one in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise QueryError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marlspar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _spill(spark: SparkSession, data: bytes) -> str:
    """Bytes as a file that all executors see."""
    path = f"{shared_folder(spark)}/source-{uuid.uuid4().hex}.parquet"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def _file() -> Column:
    """The path of a row's file, as ``_plain_name`` writes it."""
    return F.regexp_replace(F.try_url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/+", "file:/")


def _plain_name(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


class ParquetTable:
    """``source``: a path of a file, folder or pattern, the bytes of a file, or a byte-range source."""

    def __init__(self, spark: SparkSession, source: str | bytes | ByteSource, **options):
        self.spark, self.options = spark, Options(**options)
        if isinstance(source, (bytes, bytearray, memoryview)):
            source = _spill(spark, bytes(source))
        self.remote: ByteSource | None = None
        if not isinstance(source, str):
            if not hasattr(source, "slice"):
                raise ValueError("parquet expected a path, bytes or a byte source")
            if isinstance(source, UrlSource):  # executors read the ranges that they need
                self.remote, source = source, _spill(spark, footer_only(source))
            else:
                source = _spill(spark, source.slice(0, source.size))
        self.path = source
        self.files = list_files(spark, source)
        self.footer: Footer = read_footer(spark, self.files[0][0])
        self.leaves = decode.leaves(self.footer.schema)
        if self.remote is not None and not all(x.shape == "value" for x in self.leaves):
            self.path, self.remote = _spill(spark, self.remote.slice(0, self.remote.size)), None
            self.files = list_files(spark, self.path)
            self.footer = read_footer(spark, self.path)
        self.by_arrow = self.remote is not None or needs_arrow(self.footer)
        self._rows: list[int] | None = None
        self.geo = geo_columns(self.footer.key_values) if self.options.geoparquet else {}

    @property
    def names(self) -> list[str]:
        return [x.name for x in self.leaves]

    def row_counts(self) -> list[int]:
        """Rows of each file, by a scan without columns: Spark's tasks take them from the footers. A single file's footer is at hand."""
        if self._rows is None:
            if len(self.files) == 1:
                self._rows = [self.footer.rows]
            else:
                counted = self.spark.read.schema(T.StructType()).parquet(self.path).groupBy(_file()).count().collect()
                rows = {r[0]: r[1] for r in counted}
                self._rows = [rows.get(_plain_name(f[0]), 0) for f in self.files]
        return self._rows

    def _value(self, leaf: decode.Leaf, c: Column, inside: bool = False, geo: dict[str, str] | None = None) -> Column | None:
        """A leaf decoded, or None where it stays as Spark reads it, as WKB does in structs within lists or maps."""
        own = self.options.parsers
        hook = decode.hook_of(leaf, geo)
        if hook in own:
            return own[hook](c)
        if hook == "uuid":
            return decode.uuid_text(c)
        if hook == "float16":
            return decode.float16(c)
        if hook == "nanos":
            return decode.nanos_timestamp(c, leaf.annotation.endswith("true)"))
        if hook == "json" and self.options.json:
            return decode.json_value(c)
        if hook in ("geometry", "geography") and not inside:
            return geojson(c)
        if hook == "string" and self.options.utf8:
            return c.cast("string")
        if hook == "decimal" and self.options.decimal_as_double:
            return c.cast("double")
        if self.options.millis and isinstance(leaf.kind, T.TimestampType):
            return decode.timestamp_millis_only(c)
        return None

    def _decoded(self, leaf: decode.Leaf) -> Column:
        """A column with the leaves at every depth decoded."""
        c = F.col(f"`{leaf.name}`")
        if leaf.shape == "value":
            new = self._value(leaf, c, geo=self.geo)
        elif leaf.shape == "list" and self._holds_geometry(leaf):
            new = geojson_lists(c, leaf.kind)
        else:
            new = decode.decoded(leaf, c, self._value)
        return c if new is None else new

    def _holds_geometry(self, leaf: decode.Leaf) -> bool:
        """Whether lists alone stand between a column and WKB; Python, which reads WKB, takes such a column whole."""
        while leaf.shape == "list":
            leaf = leaf.below[0]
        hook = decode.hook_of(leaf)
        return leaf.shape == "value" and hook in ("geometry", "geography") and hook not in self.options.parsers

    def _overlapping(self, start: int, end: int | None) -> list[tuple[str, int, int]]:
        """(path, first position, rows) of the files that hold rows in [start, end)."""
        out, before = [], 0
        for (path, _, _), rows in zip(self.files, self.row_counts(), strict=True):
            if before + rows > start and (end is None or before < end):
                out.append((path, before, rows))
            before += rows
        return out

    def _groups(self, paths: list[str], within: tuple[int, int | None]) -> list[tuple[str, int, int]]:
        """(path, number, first position) of the row groups of files that hold rows in the range. Many footers are read by executors."""
        if len(paths) <= FEW:
            known = {p: [(i, g.first_row, g.rows) for i, g in enumerate((self.footer if p == self.footer.path else read_footer(self.spark, p)).groups)] for p in paths}
        else:
            known = {p: [] for p in paths}
            for r in footer_frame(self.spark, self.path, "row_groups").select("path", "row_group", "first_row", "n_rows").toLocalIterator():
                if r[0] in known:
                    known[r[0]].append(tuple(r)[1:])
        out, before = [], 0
        for (path, _, _), rows in zip(self.files, self.row_counts(), strict=True):
            out += [(path, i, before + first) for i, first, n in sorted(known.get(path, ())) if before + first + n > within[0] and (within[1] is None or before + first < within[1])]
            before += rows
        return out

    def frame(self, positions: bool = False, within: tuple[int, int | None] | None = None, only: list[str] | None = None) -> DataFrame:
        """Columns decoded; with ``positions`` also each row's place over all files in path order.

        ``within`` promises that only rows at positions [start, end) matter: files beyond it are not opened, and where it
        leaves out half of the rows of those it touches, neither are the row groups beyond it. ``only`` names the columns
        that matter; all keep their place in the result where Spark reads, since its planner leaves out the rest itself.
        """
        narrow = within is not None and (within[0] > 0 or within[1] is not None)
        if self.by_arrow or narrow and all(x.shape == "value" for x in self.leaves):
            files = [(f[0], None, None) for f in self.files] if not narrow else self._overlapping(*within)
            wanted = None if within is None or within[1] is None else within[1] - within[0]
            if self.by_arrow or wanted is not None and len(files) <= FOOTERS and 2 * wanted <= sum(f[2] for f in files):
                leaves = [x for x in self.leaves if only is None or x.name in only]
                raw = arrow_frame(self.spark, self._groups([f[0] for f in files], within or (0, None)), leaves, POSITION, self.remote)
                return raw.select(*[self._decoded(x).alias(x.name) for x in leaves], *[POSITION] * positions)
        reader = self.spark.read.option("parquet.filter.bloom.enabled", self.options.bloom_filters).option("parquet.filter.columnindex.enabled", self.options.page_index)
        if decode.needs_schema(self.leaves):
            reader = reader.schema(decode.read_schema(self.leaves))
        starts = self._overlapping(*within) if narrow and len(self.files) > 1 else None
        raw = reader.parquet(*([f[0] for f in starts] or [self.files[0][0]])) if starts is not None else reader.parquet(self.path)
        inferred = [x for x in self.leaves if x.name in raw.columns]
        out = [self._decoded(x).alias(x.name) for x in inferred]
        if not positions:
            return raw.select(*out)
        if len(self.files) == 1:
            return raw.select(*out, F.col("_metadata.row_index").alias(POSITION))
        if starts is None:
            starts = self._overlapping(0, None)
        placed = raw.select(*out, F.col("_metadata.row_index").alias(POSITION), _file().alias("__file__"))
        first = self.spark.createDataFrame([(_plain_name(path), before) for path, before, _ in starts], "__file__ string, __first__ long")
        if len(starts) <= BROADCAST_FILES:
            first = F.broadcast(first)
        return placed.join(first, "__file__").withColumn(POSITION, F.col(POSITION) + F.col("__first__")).drop("__file__", "__first__")
