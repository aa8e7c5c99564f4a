"""Token-ID output in patched frame-of-reference files.

A file holds the ids of consecutive documents. Ids are cut into blocks of ``BLOCK``; a block keeps its minimum, the width in
bits at a chosen percentile of the offsets from it, the low bits of all offsets packed at that width, and an exception list
of (position, whole offset) for those that need more. The index gives the byte at which each block's packed bits start.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import delete_path, fresh_path, partitions_for, sub_batches, write_table

BLOCK = 256
MAGIC = b"PFORIDS1"
#: magic, block size, ids, blocks, documents, exceptions
HEADER = struct.Struct("<8sIQQQQ")


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def pack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, BLOCK) unsigned -> (n, BLOCK * width / 8) bytes, each row packed at ``width`` bits, little-endian."""
    lanes = rows.reshape(-1, 64).T.astype(np.uint64)
    if width < 64:
        lanes = lanes & np.uint64((1 << width) - 1)
    words = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        words[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(len(rows), BLOCK * width // 8)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).reshape(-1, width).T)
    mask, lanes = np.uint64((1 << width) - 1), np.empty((64, words.shape[1]), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        lanes[j] = words[word] >> np.uint64(shift)
        if shift + width > 64:
            lanes[j] |= words[word + 1] << np.uint64(64 - shift)
        lanes[j] &= mask
    return np.ascontiguousarray(lanes.T).reshape(len(packed), BLOCK)


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, has_id: np.ndarray, sizes: np.ndarray, percentile: float = 0.9) -> bytes:
    """The bytes of a file. ``sizes``: ids of each document; ``has_id``: 0 where the document's id is null."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, dtype=np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    rows = padded.reshape(-1, BLOCK)
    base = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rows = rows - base[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.maximum(1, _bit_length(np.partition(rows, at, axis=1)[:, at])) if blocks else np.zeros(0, np.uint8)
    over = (rows >> width[:, None].astype(np.uint32)) > 0
    row, position = np.nonzero(over)
    spent = width.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(spent) - spent
    body = np.zeros(int(spent.sum()), dtype=np.uint8)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        body[starts[mine][:, None] + np.arange(int(w) * (BLOCK // 8))] = pack_bits(rows[mine], int(w))
    counts = over.sum(axis=1).astype("<u2") if blocks else np.zeros(0, "<u2")
    head = HEADER.pack(MAGIC, BLOCK, n, blocks, len(doc_ids), len(row))
    parts = [doc_ids.astype("<i8"), has_id.astype("u1"), sizes.astype("<u8"), base.astype("<u4"), width, counts, starts.astype("<u8"), position.astype("u1"), rows[row, position].astype("<u4"), body]
    return head + b"".join(x.tobytes() for x in parts)


class TokenFile:
    """Reader; ``block(i)`` decodes one block by the index, ``ids()`` all."""

    def __init__(self, data: bytes):
        magic, size, self.n, self.blocks, docs, exceptions = HEADER.unpack_from(data)
        if magic != MAGIC or size != BLOCK:
            raise ValueError("not a token-ID file")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.doc_ids, self.has_id, self.sizes = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
        self.base, self.width, counts, self.starts = take("<u4", self.blocks), take("u1", self.blocks), take("<u2", self.blocks), take("<u8", self.blocks).astype(np.int64)
        self.exception_ends = np.cumsum(counts.astype(np.int64))
        self.position, self.exception = take("u1", exceptions), take("<u4", exceptions)
        self.body = np.frombuffer(data, dtype=np.uint8, offset=at)

    def block(self, i: int) -> np.ndarray:
        w = int(self.width[i])
        out = unpack_bits(self.body[self.starts[i] : self.starts[i] + w * (BLOCK // 8)][None, :], w)[0].astype(np.uint32)
        lo, hi = (self.exception_ends[i - 1] if i else 0), self.exception_ends[i]
        out[self.position[lo:hi]] = self.exception[lo:hi]
        return (out + self.base[i])[: self.n - i * BLOCK]

    def ids(self) -> np.ndarray:
        out = np.empty((self.blocks, BLOCK), dtype=np.uint32)
        for w in np.unique(self.width):
            mine = np.flatnonzero(self.width == w)
            out[mine] = unpack_bits(self.body[self.starts[mine][:, None] + np.arange(int(w) * (BLOCK // 8))], int(w))
        row = np.repeat(np.arange(self.blocks), np.diff(self.exception_ends, prepend=0))
        out[row, self.position] = self.exception
        return (out + self.base[:, None]).reshape(-1)[: self.n]


def open_uri(path: str):
    """Arrow file system and path for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else "file:///" + path.split(":", 1)[-1].lstrip("/"))


def write_bytes(path: str, data: bytes) -> None:
    store, p = open_uri(path)
    store.create_dir(p.rpartition("/")[0], recursive=True)
    with store.open_output_stream(p) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    store, p = open_uri(path)
    with store.open_input_stream(p) as source:
        return source.read()


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, file_ids: int = 2_000_000, percentile: float = 0.9) -> tuple[DataFrame, str]:
    """Write ids of all documents in ascending doc_id order; returns the manifest (one row per file) and the folder.

    Documents are range-partitioned by doc_id. A task ends a file after the document that fills it to ``file_ids`` ids, under a name
    with its attempt id: files of failed attempts are never in the manifest. Null doc_ids come first; rows that repeat a
    doc_id follow each other by text. An empty table gives an empty manifest.
    """
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "token-files")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        context, tok = TaskContext.get(), encoder(tokenizer_path, 20_000_000)
        kept, ids, sizes, gathered, part = [], [], [], 0, 0

        def flush():
            nonlocal kept, ids, sizes, gathered, part
            numbers = [x for one in kept for x in one]
            all_sizes = np.concatenate(sizes)
            name = f"{folder}/ids-{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}.pfor"
            data = encode_file(np.concatenate(ids), np.array([x or 0 for x in numbers], dtype=np.int64), np.array([x is not None for x in numbers]), all_sizes, percentile)
            write_bytes(name, data)
            out = pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "part": pa.array([part], pa.int32()), "path": [name], "n_docs": pa.array([len(numbers)], pa.int64()), "n_ids": pa.array([int(all_sizes.sum())], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})
            kept, ids, sizes, gathered, part = [], [], [], 0, part + 1
            return out

        for batch in sub_batches(batches, 8 << 20):
            got, ends = tok.encode(batch.column(1))
            got = np.insert(got, ends, end_id).astype(np.uint32)
            numbers, stops, at = batch.column(0).to_pylist(), np.concatenate([[0], ends + 1 + np.arange(len(ends))]), 0
            while at < len(numbers):
                to = min(len(numbers), int(np.searchsorted(stops, stops[at] + file_ids - gathered)))
                ids.append(got[stops[at] : stops[to]])
                kept.append(numbers[at:to])
                sizes.append(np.diff(stops[at : to + 1]))
                gathered += len(ids[-1])
                at = to
                if gathered >= file_ids:
                    yield flush()
        if kept:
            yield flush()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = source.repartitionByRange(partitions_for(docs, 14 << 20), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(run, "shard int, part int, path string, n_docs long, n_ids long, n_bytes long")
    return write_table(manifest, "token-manifest")[0], folder


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Decode the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The running start takes one window over the manifest, which has a row per file, not per document.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(read_bytes(path))
                raw, ends = file.ids().astype("<u4").tobytes(), np.cumsum(file.sizes)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - file.sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids, pa.int64(), mask=file.has_id == 0), pa.array(first + ends - file.sizes, pa.int64()), pa.array(file.sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n_ids").over(W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("path", before.alias("first"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids and read them back. Null text counts as empty; extra columns are ignored."""
    return read_token_files(write_token_files(docs, tokenizer_path, end_id)[0])


__all__ = ["TokenFile", "delete_path", "encode_file", "read_token_files", "token_ids", "write_token_files"]
