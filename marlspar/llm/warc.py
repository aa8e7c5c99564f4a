"""WARC archives: one gzip member per record, written from a table of pages and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, write_table
from .token_store import open_uri, write_bytes

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "2020-01-01T00:00:00Z", level: int = 6) -> bytes:
    """A response record, or without its payload a revisit of page ``refers_to``, as a gzip member."""
    digest = base32_sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>", "WARC-Date": date, "WARC-Target-URI": _clean(url or "") or f"{ID}{page_id}", "Content-Type": "application/http;msgtype=response"}
    if refers_to is None:
        block += payload
    else:
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{ID}{refers_to}>"}
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(head + block + b"\r\n\r\n") + deflate.flush()


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def iter_members(stream, chunk: int = 1 << 18):
    """Contents of the gzip members of ``stream``, each decompressed incrementally. A cut member is an error."""
    inflate, parts, fresh = zlib.decompressobj(31), [], True
    while data := stream.read(chunk):
        while data:
            parts.append(inflate.decompress(data))
            fresh, data = False, b""
            if inflate.eof:
                yield b"".join(parts)
                data, inflate, parts, fresh = inflate.unused_data, zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("WARC: the last gzip member is cut short")


def iter_records(stream):
    """(WARC headers, HTTP headers, payload) of each record; lengths and digests are checked."""
    for member in iter_members(stream):
        head, sep, rest = member.partition(b"\r\n\r\n")
        if not head.startswith(b"WARC/") or not sep:
            raise ValueError("WARC: a record doesn't start with its version")
        fields = _headers(head)
        size = int(fields["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != b"\r\n\r\n":
            raise ValueError("WARC: content-length doesn't frame the block")
        if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError("WARC: block digest differs")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
            raise ValueError("WARC: payload digest differs")
        said = _headers(http)
        if fields["warc-type"] == "response" and int(said["content-length"]) != len(payload):
            raise ValueError("WARC: the HTTP content-length isn't the payload's")
        yield fields, said, payload


def write_archives(pages: DataFrame, least_bytes: int = 0, file_bytes: int = 32 << 20, level: int = 6) -> tuple[DataFrame, str]:
    """Write a record for every page; returns the manifest (path, n_records, n_bytes) and the folder.

    Of pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id becomes a response and the
    others revisit it. Null html is the empty payload; a null page_id is always a response; rows that repeat the smallest
    page_id and its payload are all responses. Equal payloads meet as (page_id, digest) rows only, never as html. An empty
    table gives an empty manifest.
    """
    spark, folder = pages.sparkSession, fresh_path(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    keys = source.filter(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    links = keys.join(first, "digest").filter(F.col("page_id") > F.col("refers_to")).distinct()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context, held, size, part = TaskContext.get(), [], 0, 0

        def flush():
            nonlocal held, size, part
            name = f"{folder}/pages-{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}.warc.gz"
            write_bytes(name, b"".join(held))
            out = pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([len(held)], pa.int64()), "n_bytes": pa.array([size], pa.int64())})
            held, size, part = [], 0, part + 1
            return out

        for batch in batches:
            for page, url, text, to in zip(*(batch.column(i) for i in range(4)), strict=True):
                held.append(build_record(page.as_py(), url.as_py(), text.as_py().encode(), to.as_py(), level=level))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    rows = source.join(links, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return write_table(rows.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")[0], folder


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, and the payload on demand."""

    def number(field: str | None):
        digits = (field or "").removeprefix(f"<{ID}").removesuffix(">")
        return int(digits) if digits else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, p = open_uri(path)
                rows: list[tuple] = []

                def flush():
                    nonlocal rows
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                    n = len(names) - (not with_payload)
                    out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(n)], names[:n])
                    rows = []
                    return out

                with store.open_input_stream(p) as stream:
                    for fields, http, payload in iter_records(stream):
                        kind = fields["warc-type"]
                        rows.append((number(fields["warc-record-id"]), int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), kind, number(fields.get("warc-refers-to")), payload.decode("utf-8", "replace") if with_payload and kind == "response" else None))
                        if len(rows) >= 2000:
                            yield flush()
                if rows:
                    yield flush()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, schema)
