"""Best-fit packing, certified by dual-feasible-function bounds.

Pieces are hashed into groups; each group is packed by best-fit decreasing and its bin count held against lower bounds from
dual-feasible functions. A group that meets its bound is optimal for its pieces and is final. Groups with a gap put their
pieces into common, larger groups and are packed again; the new packing stays only where it needs fewer bins.
"""


import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, sub_batches, write_table

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_lengths(n: int, most: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids: all ``most`` but the first, which may be shorter."""
    first = n % most or most
    return [first, *[most] * ((n - first) // most)]


def piece_table(docs: DataFrame, tokenizer_path: str, most: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts (null: empty), end each with ``end_id`` and cut only those longer than ``most``."""

    def run(batches):
        import pyarrow as pa

        from .tokens import encoder

        tok = encoder(tokenizer_path)
        for batch in sub_batches(batches):
            ids, ends = tok.encode(batch.column(1))
            raw = np.insert(ids, ends, end_id).astype("<u4")
            data, stops = raw.tobytes(), ends + 1 + np.arange(len(ends))
            doc, piece, start, length, crc, cut = [], [], [], [], [], []
            at = 0
            for number, stop in zip(batch.column(0).to_pylist(), stops.tolist(), strict=True):
                begin = at
                for k, n in enumerate(cut_lengths(stop - at, most)):
                    doc.append(number)
                    piece.append(k)
                    start.append(at - begin)
                    length.append(n)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
                    if with_ids:
                        cut.append(raw[at : at + n])
                    at += n
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(cut, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, PIECE + (", ids array<long>" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int, most_k: int = 24) -> int:
    """Fewest bins that any packing needs, by two families of dual-feasible functions on the histogram of lengths.

    The first counts pieces over capacity - t as whole bins and drops those under t, for each t up to half; the second is
    Fekete and Schepers' u(k), rounding (k + 1) x down to k-ths unless it is whole.
    """
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    many, volume = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(capacity // 2 + 1)
    whole = many[-1] - many[capacity - t]
    middle = volume[capacity - t] - np.where(t > 0, volume[np.maximum(t, 1) - 1], 0)
    best = int((whole + -(-middle // capacity)).max())
    for k in range(1, most_k + 1):
        scaled = np.where((k + 1) * size % capacity == 0, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, taken in the given order (longest first), and the number of bins."""
    bins, offsets, n = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has room r
    for i, length in enumerate(lengths.tolist()):
        fits = open_ >> length
        if fits:
            r = length + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - r
        if r > length:
            room[r - length].append(b)
            open_ |= 1 << (r - length)
    return bins, offsets, n


PACKED = PIECE + ", pack_group long, sequence_id long, offset long, n_bins long, bound long"


def _pack_groups(pieces: DataFrame, capacity: int, turn: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        return pdf.assign(sequence_id=(turn << 58) + (int(key[0]) << 28) + bins, offset=offsets, n_bins=n, bound=lower_bound(lengths, capacity))[[x.split()[0] for x in PACKED.split(", ")]]

    return pieces.groupBy("pack_group").applyInPandas(run, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_rows: int = 50_000, turns: int = 3, merge: int = 4) -> DataFrame:
    """Place pieces of at most ``capacity`` into sequences: adds pack_group, sequence_id, offset, n_bins and bound.

    ``pieces`` should be a written table: it is read more than once. ``group_rows`` bounds a task's memory. At each of at
    most ``turns`` - 1 exchanges, groups whose bin count exceeds their bound go ``merge`` to one. An empty table gives none.
    """
    names = [x.split()[0] for x in PIECE.split(", ")]
    spot = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    groups = max(1, -(-pieces.count() // group_rows))
    now, path = write_table(_pack_groups(pieces.select(*names, F.pmod(spot, F.lit(groups)).alias("pack_group")), capacity, 0), "packed")
    done: list[DataFrame] = []
    for turn in range(1, turns):
        apart = now.filter(F.col("n_bins") > F.col("bound"))
        gaps = apart.select("pack_group", "n_bins").distinct().agg(F.count("*").alias("n"), F.sum("n_bins").alias("bins")).first()
        if gaps["n"] < 2:
            break
        wide = -(-gaps["n"] // merge)
        mixed = apart.select(*names, F.pmod(F.xxhash64(spot, F.lit(turn)), F.lit(wide)).alias("pack_group"))
        again, path_again = write_table(_pack_groups(mixed, capacity, turn), "packed")
        bins = again.select("pack_group", "n_bins").distinct().agg(F.sum("n_bins")).first()[0]
        if bins >= gaps["bins"]:
            delete_path(pieces.sparkSession, path_again)
            break
        done.append(now.filter(F.col("n_bins") <= F.col("bound")))
        now = again
    for part in done:
        now = now.unionByName(part)
    return now


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, group_rows: int = 50_000) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids.

    Null text packs as an empty document (its end id alone); a null doc_id is carried; repeated rows are separate documents;
    an empty table gives none. ``n_bins`` over ``bound`` in the result tells that a group's packing isn't proven optimal.
    """
    pieces, path = write_table(piece_table(docs, tokenizer_path, capacity, end_id), "pieces")
    packed = pack_pieces(pieces, capacity, group_rows)
    delete_path(docs.sparkSession, path)
    return packed


def build_sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids array, by joining re-tokenized pieces to their places.

    A sequence gathers at most ``capacity`` ids, so its group is bounded. Needs unique doc_ids.
    """
    ids = piece_table(docs, tokenizer_path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
