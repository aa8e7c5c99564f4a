"""Parquet footers, page indexes and bloom filters as data.

One file's footer is read on the driver through the JVM's Hadoop file systems, so any path that Spark reads will do. Footers
of many files are read where the executors are, a row for each file, row group or column chunk.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from decimal import Context, Decimal
from functools import lru_cache
from uuid import UUID

from pyspark.sql import DataFrame, SparkSession

from ..errors import FormatError


@dataclass
class Chunk:
    """A column chunk."""

    path: str
    physical: str
    annotation: str
    codec: str
    encodings: list[str]
    values: int
    compressed: int
    uncompressed: int
    data_page_offset: int
    dictionary_page_offset: int | None
    bloom_filter_offset: int | None
    null_count: int | None
    minimum: object
    maximum: object
    data_encodings: dict[str, int] = field(default_factory=dict)  # pages by encoding
    dictionary_encodings: dict[str, int] = field(default_factory=dict)
    unencoded_bytes: int | None = None  # of byte arrays
    repetition_levels: list[int] = field(default_factory=list)  # how many values have each level; empty where all have one
    definition_levels: list[int] = field(default_factory=list)
    bounding_box: dict[str, float] | None = None
    geometry_types: list[int] | None = None


@dataclass
class Group:
    """A row group."""

    rows: int
    bytes: int
    first_row: int
    chunks: list[Chunk]

    def chunk(self, path: str) -> Chunk | None:
        return next((c for c in self.chunks if c.path == path), None)


@dataclass
class Footer:
    path: str
    size: int
    rows: int
    created_by: str | None
    key_values: dict[str, str]
    groups: list[Group]
    schema: object = field(repr=False)  # JVM message type


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, p, p.getFileSystem(conf)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the data files at a path: itself, or those in a folder or pattern, in path order."""
    _, _, p, fs = _hadoop(spark, path)
    found = fs.globStatus(p)
    if found is None or not len(found):
        raise FileNotFoundError(path)
    out = []
    for status in found:
        if status.isFile():
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
            continue
        inside = fs.listFiles(status.getPath(), True)
        while inside.hasNext():
            s = inside.next()
            if not s.getPath().getName().startswith(("_", ".")):
                out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def check_magic(spark: SparkSession, path: str) -> None:
    """Length, magic and footer length of a file, before anything is parsed."""
    jvm, _, p, fs = _hadoop(spark, path)
    size = fs.getFileStatus(p).getLen()
    if size < 12:
        raise FormatError("parquet file is too short")
    stream = fs.open(p)
    try:
        stream.seek(size - 8)
        tail = bytes(b & 0xFF for b in (stream.read() for _ in range(8)))
    finally:
        stream.close()
    if tail[4:] != b"PAR1":
        raise FormatError("parquet file invalid (footer != PAR1)")
    length = int.from_bytes(tail[:4], "little")
    if length > size - 12:
        raise FormatError(f"parquet metadata length {length} exceeds available buffer {size - 8}")


def typed(value, physical: str, note: str):
    """A statistic in its column's type: texts, dates, UTC or local times, decimals, unsigned numbers; what has no such type stays as stored."""
    if value is None or note == "":
        return value
    if isinstance(value, bytes):
        if note in ("STRING", "ENUM", "JSON"):
            return value.decode("utf-8", "replace")
        if note == "UUID" and len(value) == 16:
            return str(UUID(bytes=value))
        if note == "FLOAT16" and len(value) == 2:
            return struct.unpack("<e", value)[0]
    if note.startswith("DECIMAL("):
        unscaled = int.from_bytes(value, "big", signed=True) if isinstance(value, bytes) else value
        return Decimal(unscaled).scaleb(-int(note[8:-1].split(",")[1]), Context(prec=60))
    if isinstance(value, int) and not isinstance(value, bool):
        if note == "DATE":
            return _moment(timedelta(days=value), lambda t: t.date())
        if note.startswith("TIMESTAMP("):
            unit = note[10:-1].split(",")[0]
            micros = {"MILLIS": value * 1000, "MICROS": value, "NANOS": value // 1000}[unit]
            return _moment(timedelta(microseconds=micros), (lambda t: t.replace(tzinfo=timezone.utc)) if note.endswith("true)") else (lambda t: t))
        if note.startswith("INTEGER(") and note.endswith("false)"):
            return value & ((1 << (64 if physical == "INT64" else 32)) - 1)
    return value


def _moment(since: timedelta, form):
    """A time after the epoch; None beyond what Python's calendar holds."""
    try:
        return form(datetime(1970, 1, 1) + since)
    except OverflowError:
        return None


def _value(stats, which: str, physical: str, note: str):
    if stats is None or not stats.hasNonNullValue():
        return None
    v = stats.genericGetMin() if which == "min" else stats.genericGetMax()
    try:
        return typed(bytes(v.getBytes()) if hasattr(v, "getBytes") else v, physical, note)
    except OverflowError:
        return None


def read_footer(spark: SparkSession, path: str) -> Footer:
    """The footer of one file; kept as long as the file's size and time stay."""
    (name, size, changed), *more = list_files(spark, path)
    if more:
        raise FormatError(f"parquet expected one file: {path}")
    return _read_footer(spark, name, size, changed)


@lru_cache(maxsize=256)
def _read_footer(spark: SparkSession, path: str, size: int, changed: int) -> Footer:
    check_magic(spark, path)
    jvm, conf, p, _ = _hadoop(spark, path)
    hadoop = jvm.org.apache.parquet.hadoop
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(p, conf))
    try:
        meta = reader.getFooter()
        about, groups, first = meta.getFileMetaData(), [], 0
        for block in meta.getBlocks():
            chunks = []
            for c in block.getColumns():
                kind, stats = c.getPrimitiveType(), c.getStatistics()
                note = kind.getLogicalTypeAnnotation()
                bloom, dictionary = c.getBloomFilterOffset(), c.getDictionaryPageOffset()
                physical, said = kind.getPrimitiveTypeName().toString(), "" if note is None else note.toString()
                chunks.append(Chunk(c.getPath().toDotString(), physical, said, c.getCodec().toString(), sorted(e.toString() for e in c.getEncodings()), c.getValueCount(), c.getTotalSize(), c.getTotalUncompressedSize(), c.getFirstDataPageOffset(), dictionary or None, bloom if bloom >= 0 else None, stats.getNumNulls() if stats is not None and stats.isNumNullsSet() else None, _value(stats, "min", physical, said), _value(stats, "max", physical, said), **_more_of(c)))
            groups.append(Group(block.getRowCount(), block.getTotalByteSize(), first, chunks))
            first += block.getRowCount()
        kv = {e.getKey(): e.getValue() for e in about.getKeyValueMetaData().entrySet()}
        return Footer(path, size, first, about.getCreatedBy(), kv, groups, about.getSchema())
    finally:
        reader.close()


def _more_of(c) -> dict:
    """Encoding, size and geospatial statistics of a JVM column chunk."""
    out: dict = {}
    if (e := c.getEncodingStats()) is not None:
        out["data_encodings"] = {k.toString(): e.getNumDataPagesEncodedAs(k) for k in e.getDataEncodings()}
        out["dictionary_encodings"] = {k.toString(): e.getNumDictionaryPagesEncodedAs(k) for k in e.getDictionaryEncodings()}
    if (sizes := c.getSizeStatistics()) is not None:
        n = sizes.getUnencodedByteArrayDataBytes()
        out["unencoded_bytes"] = n.get() if n.isPresent() else None
        out["repetition_levels"], out["definition_levels"] = list(sizes.getRepetitionLevelHistogram()), list(sizes.getDefinitionLevelHistogram())
    if (geo := c.getGeospatialStatistics()) is not None:
        if (box := geo.getBoundingBox()) is not None:
            out["bounding_box"] = {f"{axis}{end}".lower(): v for axis in "XYZM" for end in ("Min", "Max") if (v := getattr(box, f"get{axis}{end}")()) == v and abs(v) != float("inf")}
        if (types := geo.getGeospatialTypes()) is not None:
            out["geometry_types"] = sorted(types.getTypes())
    return out


FOOTER_SCHEMAS = {
    "files": "path string, n_rows long, n_row_groups int, n_columns int, created_by string, format_version string, footer_bytes long, key_values map<string,string>",
    "row_groups": "path string, row_group int, first_row long, n_rows long, total_bytes long, sorting_columns array<string>",
    "columns": "path string, row_group int, column string, physical_type string, logical_type string, codec string, encodings array<string>, n_values long, null_count long, distinct_count long, min_value string, max_value string, compressed_bytes long, uncompressed_bytes long, max_definition_level int, max_repetition_level int, has_column_index boolean, has_offset_index boolean",
}


def footer_frame(spark: SparkSession, path: str, level: str = "row_groups") -> DataFrame:
    """Footers of all files at a path: ``level`` is files, row_groups or columns. Read by the executors, a task for some files each."""
    import pandas as pd

    files = list_files(spark, path)
    schema = FOOTER_SCHEMAS[level]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name in batch["path"]:
                store, local = fs.FileSystem.from_uri(name if "://" in name else "file://" + name.removeprefix("file:"))
                file = pq.ParquetFile(local, filesystem=store)
                m, first = file.metadata, 0
                if level == "files":
                    rows.append((name, m.num_rows, m.num_row_groups, m.num_columns, m.created_by, m.format_version, m.serialized_size, {k.decode(): v.decode("utf-8", "replace") for k, v in (m.metadata or {}).items()}))
                for g in range(m.num_row_groups):
                    group = m.row_group(g)
                    if level == "row_groups":
                        order = [m.schema.column(x.column_index).path + (" desc" if x.descending else "") for x in group.sorting_columns]
                        rows.append((name, g, first, group.num_rows, group.total_byte_size, order))
                    elif level == "columns":
                        for k in range(group.num_columns):
                            c, s = group.column(k), file.schema.column(k)
                            st = c.statistics
                            text = (lambda v: None if v is None else v.hex() if isinstance(v, bytes) else str(v)) if st else None
                            rows.append((name, g, c.path_in_schema, c.physical_type, str(s.logical_type), c.compression, list(c.encodings), c.num_values, st.null_count if st and st.has_null_count else None, st.distinct_count if st and st.has_distinct_count else None, text(st.min) if st and st.has_min_max else None, text(st.max) if st and st.has_min_max else None, c.total_compressed_size, c.total_uncompressed_size, s.max_definition_level, s.max_repetition_level, c.has_column_index, c.has_offset_index))
                    first += group.num_rows
            yield pd.DataFrame(rows, columns=names)

    n = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(f[0],) for f in files], "path string").repartition(n).mapInPandas(run, schema)


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """Pages of one file by its column and offset indexes; a chunk without an index has no rows."""
    footer = read_footer(spark, path)
    jvm, conf, p, _ = _hadoop(spark, footer.path)
    hadoop = jvm.org.apache.parquet.hadoop
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(p, conf))
    rows = []
    try:
        for g, block in enumerate(reader.getFooter().getBlocks()):
            for c in block.getColumns():
                offsets, columns = reader.readOffsetIndex(c), reader.readColumnIndex(c)
                if offsets is None:
                    continue
                nulls = list(columns.getNullPages()) if columns is not None else None
                counts = columns.getNullCounts() if columns is not None else None
                low, high = (columns.getMinValues(), columns.getMaxValues()) if columns is not None else (None, None)
                n = offsets.getPageCount()
                for k in range(n):
                    some = columns is not None and not nulls[k]
                    rows.append((g, c.getPath().toDotString(), k, offsets.getOffset(k), offsets.getCompressedPageSize(k), offsets.getFirstRowIndex(k), nulls[k] if nulls else None, counts[k] if counts else None, _buffer(low[k]) if some else None, _buffer(high[k]) if some else None, columns.getBoundaryOrder().toString() if columns is not None else None))
    finally:
        reader.close()
    return spark.createDataFrame(rows, "row_group int, column string, page int, offset long, compressed_bytes int, first_row long, null_page boolean, null_count long, min_bytes binary, max_bytes binary, boundary_order string")


def _buffer(b) -> bytes:
    view = b.duplicate()
    return bytes(view.get() & 0xFF for _ in range(view.remaining()))


def _plain_bytes(value, physical: str, note: str = "") -> bytes | None:
    """A value as the format's plain encoding, which bloom filters hash; None where the column's type cannot hold it exactly."""
    if isinstance(value, bool) or not isinstance(value, (bytes, bytearray)) and note not in ("", "STRING", "ENUM", "JSON") and not note.startswith("INTEGER("):
        return None
    if physical == "FIXED_LEN_BYTE_ARRAY" and isinstance(value, str):
        return None
    if physical in ("BINARY", "FIXED_LEN_BYTE_ARRAY"):
        return value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, (bytes, bytearray)) else None
    form = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}.get(physical)
    if form is None or not isinstance(value, (int, float)):
        return None
    if physical.startswith("INT"):
        bits = 31 if physical == "INT32" else 63
        if value != value or value in (float("inf"), float("-inf")) or value != int(value) or not -(1 << bits) <= value < 1 << bits:
            return None
        return struct.pack(form, int(value))
    try:
        data = struct.pack(form, value)
    except OverflowError:
        return None
    return data if value and struct.unpack(form, data)[0] == value else None  # zero has two encodings


def bloom_might_contain(spark: SparkSession, path: str, column: str, value) -> list[bool | None]:
    """For each row group, whether its bloom filter may hold ``value``; None where the chunk has no filter, or none that is supported."""
    footer = read_footer(spark, path)
    jvm, conf, p, _ = _hadoop(spark, footer.path)
    hadoop = jvm.org.apache.parquet.hadoop
    reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(p, conf))
    out: list[bool | None] = []
    try:
        for block in reader.getFooter().getBlocks():
            chunk = next((c for c in block.getColumns() if c.getPath().toDotString() == column), None)
            bloom = None if chunk is None else reader.readBloomFilter(chunk)
            if bloom is None:
                out.append(None)
                continue
            kind = chunk.getPrimitiveType()
            note = kind.getLogicalTypeAnnotation()
            data = _plain_bytes(value, kind.getPrimitiveTypeName().toString(), "" if note is None else note.toString())
            if data is None:
                out.append(None)
                continue
            hashed = jvm.org.apache.parquet.column.values.bloomfilter.XxHash().hashBytes(bytearray(data))
            out.append(bool(bloom.findHash(hashed)))
    finally:
        reader.close()
    return out


def footer_dict(footer: Footer) -> dict:
    """A footer as plain values."""
    plain = {k: v for k, v in footer.__dict__.items() if k not in ("schema", "groups")}
    plain["row_groups"] = [{"rows": g.rows, "bytes": g.bytes, "first_row": g.first_row, "columns": [dict(c.__dict__) for c in g.chunks]} for g in footer.groups]
    return json.loads(json.dumps(plain, default=lambda v: v.hex() if isinstance(v, bytes) else str(v)))
