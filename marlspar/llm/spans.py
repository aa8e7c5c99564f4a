"""Exact removal of 50-byte repeats across documents, by suffix arrays over the windows that can repeat.

Each 50-byte window has an anchor: the smallest hash among its 16-byte strings. Equal windows have equal anchors, so only
windows whose anchor occurs in two documents can repeat, and all windows of an anchor can be sorted in one place. A run of
neighbouring windows with one anchor is a segment.

Documents are dealt into blocks. A block tells each anchor bucket which anchors it holds and hears which of them others hold
too; it then sends those segments, once for each distinct content with its smallest and its largest document, to the
segment's bucket. There a suffix array over the distinct segments and common prefixes of neighbours give the smallest
document of each window, which returns to the blocks; a block marks its own occurrences, which no bucket sees. However often
a passage occurs, a bucket gets it once from each block.

All that surrounds a very common string has that string's anchor. Where an anchor has over ``hot`` segments, they are cut by
where the anchor lies in the window, to pieces of up to ``STEP`` windows with a string of 47 bytes in common, and dealt by
that string: a bucket gathers no more than what differs in the three bytes around it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .suffixes import common_prefixes_reach, suffix_array

LENGTH, GRAM, MOST, STEP = 50, 16, 64, 4  # bytes of a string, of an anchor's string, windows of a segment, of a hot piece
NO_ID = (1 << 63) - 1
SPREAD = 64  # blocks up to which each has a partition of its own
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ``GRAM`` bytes."""
    w = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = w[:-8] * _MIX[0]
    h ^= h >> np.uint64(29)
    h += w[8:] * _MIX[1]
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    h ^= h >> np.uint64(29)
    return h


def window_anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of each ``LENGTH``-byte window of ``data`` (uint8, at least ``LENGTH`` long)."""
    h = gram_hashes(data)
    span = LENGTH - GRAM + 1  # 16-byte strings in a window
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (span - width)], h[span - width :])


def spread(anchors: np.ndarray) -> np.ndarray:
    """Anchors are minima and so lean to small values; this one-to-one mix spreads them evenly."""
    x = anchors * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Block:
    """Texts of one block, their segments in a fixed order."""

    def __init__(self, doc_ids: list[int], texts: list[bytes]):
        self.doc_ids = np.array(doc_ids, dtype=np.int64)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.joined = b"".join(texts)
        self.at = np.cumsum(sizes) - sizes
        data = np.frombuffer(self.joined, dtype=np.uint8)
        long = np.flatnonzero(sizes >= LENGTH)
        if not len(long):
            self.start = self.windows = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        anchors = window_anchors(data)
        inside = np.zeros(len(anchors) + 1, dtype=np.int32)  # windows that lie in one document
        np.add.at(inside, self.at[long], 1)
        np.add.at(inside, np.minimum(self.at[long] + sizes[long] - LENGTH + 1, len(anchors)), -1)
        inside = np.cumsum(inside[:-1]) > 0
        new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
        new[self.at[long]] = True
        new |= np.concatenate([[True], inside[1:] != inside[:-1]])
        starts = np.flatnonzero(new)
        windows = np.diff(np.append(starts, len(anchors)))
        real = inside[starts]
        start, windows = starts[real], windows[real]
        parts = -(-windows // MOST)  # a long run is cut, so that one byte repeated without end makes no long segment
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(start, parts) + k * MOST
        self.windows = np.minimum(np.repeat(windows, parts) - k * MOST, MOST)
        self.anchor = spread(anchors[self.start])
        self.doc = np.searchsorted(self.at, self.start, side="right") - 1  # the last of texts that start here: the others are empty

    def content(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.start[i] + self.windows[i] + LENGTH - 1]


def _rows(table) -> tuple[list[int], list[bytes]]:
    """doc_ids (null: after all others) and texts in an order that any task finds again: by id, then text."""
    ids = [NO_ID if x is None else x for x in table.column("doc_id").to_pylist()]
    texts = [x.encode() for x in table.column("text").to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]


def _block(table) -> Block:
    return Block(*_rows(table))


def _keys(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 40-bit key of anchors. Two anchors with one key cost needless work, never a wrong result."""
    return (anchor & np.uint64(0xFFFFFF)).astype(np.int64) % buckets, (anchor >> np.uint64(24)).astype(np.int64)


def _to_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    return out.view("<i8").ravel()


def _slices(sorted_keys: np.ndarray):
    """(key, from, to) of the runs of a sorted array."""
    cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)], strict=True):
        if b > a:
            yield int(sorted_keys[a]), a, b


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(x.astype("<i8").tobytes() for x in columns))


def _unpack(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype="<i8").reshape(columns, -1)


def list_anchors(block_id: int, block: Block, buckets: int):
    """(bucket, block, keys, in_two, counts) rows: the block's distinct keys, which of them two of its own documents hold, and their segments."""
    bucket, key = _keys(block.anchor, buckets)
    order = np.lexsort((block.doc, key, bucket))
    bucket, key, doc = bucket[order], key[order], block.doc[order]
    if not len(key):
        return
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(doc))
    two = doc[starts] != doc[ends - 1]
    for b, lo, hi in _slices(bucket[starts]):
        yield b, block_id, _to_bytes(key[starts[lo:hi]]), np.packbits(two[lo:hi]).tobytes(), zstandard.compress((ends - starts)[lo:hi].astype("<u4").tobytes())


def shared_anchors(bucket: int, blocks: list[int], keys: list[bytes], in_two: list[bytes], counts: list[bytes], hot: int):
    """(block, bucket, keys, hot_keys) rows: those of a block's keys that two documents hold; hot where over ``hot`` segments do."""
    own = [_from_bytes(k) for k in keys]
    sizes = np.array([len(k) for k in own])
    every = np.concatenate(own)
    two = np.concatenate([np.unpackbits(np.frombuffer(t, dtype=np.uint8))[:n].astype(bool) for t, n in zip(in_two, sizes.tolist(), strict=True)])
    segments = np.concatenate([np.frombuffer(zstandard.decompress(c), dtype="<u4") for c in counts])
    _, place, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = (count > 1) | (np.bincount(place, weights=two) > 0)
    take, much = shared[place], (np.bincount(place, weights=segments) > hot)[place]
    at = 0
    for block, n in zip(blocks, sizes.tolist(), strict=True):
        part, mine = every[at : at + n], take[at : at + n]
        over = much[at : at + n] & mine
        if mine.any():
            yield block, bucket, _to_bytes(part[mine & ~over]), _to_bytes(part[over])
        at += n


def hot_pieces(content: bytes):
    """(first window, windows, common string) of the pieces that a segment of a hot anchor is cut to.

    Where the anchor lies in a window follows from the window, and so does the string: equal windows meet in one bucket.
    """
    grams = np.lib.stride_tricks.sliding_window_view(gram_hashes(np.frombuffer(content, dtype=np.uint8)), LENGTH - GRAM + 1)
    place = grams.argmin(axis=1)
    core = np.arange(len(place)) + place % STEP
    cuts = [0, *(np.flatnonzero(np.diff(core)) + 1).tolist(), len(core)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, b - a, content[core[a] : core[a] + LENGTH - STEP + 1]


def list_segments(block_id: int, block: Block, buckets: int, shared: list[tuple[int, bytes, bytes]]):
    """(to, block, segments, lengths, least, most) rows: distinct contents of segments with a shared anchor for bucket ``to``,
    with the smallest and the largest document that hold each; and, for the block itself (``to`` -1 - block), where they occur.
    """
    bucket, key = _keys(block.anchor, buckets)
    own = key * buckets + bucket
    plain, hot = (np.concatenate([np.zeros(0, np.int64), *(_from_bytes(x[i]) * buckets + x[0] for x in shared)]) for i in (1, 2))
    picked = np.flatnonzero(np.isin(own, plain))
    todo: list[tuple[int, int, int, bytes]] = list(zip(bucket[picked].tolist(), block.doc[picked].tolist(), block.start[picked].tolist(), map(block.content, picked.tolist()), strict=True))
    for i in np.flatnonzero(np.isin(own, hot)).tolist() if len(hot) else []:
        content, start = block.content(i), int(block.start[i])
        for at, n, core in hot_pieces(content):
            todo.append((int.from_bytes(hashlib.blake2b(core, digest_size=6).digest(), "big") % buckets, int(block.doc[i]), start + at, content[at : at + n + LENGTH - 1]))
    if not todo:
        return
    by_bucket: dict[int, dict[bytes, int]] = {}
    which = np.fromiter((known.setdefault(x[3], len(known)) for x in todo for known in (by_bucket.setdefault(x[0], {}),)), dtype=np.int64, count=len(todo))
    to, doc, start = (np.fromiter((x[i] for x in todo), dtype=np.int64, count=len(todo)) for i in range(3))
    number = block.doc_ids[doc]
    order = np.lexsort((start, number, which, to))
    spot = to << 32 | which
    starts = np.flatnonzero(np.diff(spot[order], prepend=-1))
    ends = np.append(starts[1:], len(order)) - 1
    least, most = number[order[starts]], number[order[ends]]
    for b, lo, hi in _slices(to[order[starts]]):
        known = by_bucket[b]
        yield b, block_id, zstandard.compress(b"".join(known)), np.fromiter(map(len, known), dtype="<i4", count=len(known)).tobytes(), least[lo:hi].astype("<i8").tobytes(), most[lo:hi].astype("<i8").tobytes()
    yield -1 - block_id, block_id, _pack(*(x[order] for x in (spot, doc, start - block.at[doc]))), b"", b"", b""


def smallest_holders(bucket: int, blocks: list[int], texts: list[bytes], lengths: list[bytes], least: list[bytes], most: list[bytes]):
    """(block, bucket, runs) rows: for windows that also start in a smaller document than the largest of the block, which
    content and windows they are and their smallest document. A block's own row passes on with bucket -1."""
    if bucket < 0:
        for block, text in zip(blocks, texts, strict=True):
            yield block, -1, text
        return
    known: dict[bytes, int] = {}
    segment, low, high, at_block, index = [], [], [], [], []
    for block, text, length, a, b in zip(blocks, texts, lengths, least, most, strict=True):
        text, ends = zstandard.decompress(text), np.cumsum(np.frombuffer(length, dtype="<i4")).tolist()
        segment.append(np.array([known.setdefault(text[x:y], len(known)) for x, y in zip([0, *ends], ends, strict=False)], dtype=np.int64))
        low.append(np.frombuffer(a, dtype="<i8"))
        high.append(np.frombuffer(b, dtype="<i8"))
        at_block.append(np.full(len(ends), block))
        index.append(np.arange(len(ends)))
    segment, low, high, at_block, index = (np.concatenate(x) for x in (segment, low, high, at_block, index))
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
    text = np.frombuffer(b"\xff".join(known) + b"\xff", dtype=np.uint8)  # no UTF-8 text holds this byte
    begin = np.cumsum(sizes + 1) - sizes - 1
    smallest = np.full(len(known), NO_ID, dtype=np.int64)
    np.minimum.at(smallest, segment, low)
    order = suffix_array(text, LENGTH)
    group = np.cumsum(~common_prefixes_reach(text, order, LENGTH))
    holder = np.repeat(np.arange(len(known)), sizes + 1)
    runs = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    first = np.empty(len(text), dtype=np.int64)
    first[order] = np.repeat(np.minimum.reduceat(smallest[holder[order]], runs), np.diff(np.append(runs, len(order))))
    windows = sizes[segment] - LENGTH + 1
    owner = np.repeat(np.arange(len(segment)), windows)
    k = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    holds = first[begin[segment[owner]] + k]
    gone = np.flatnonzero(holds < high[owner])
    if not len(gone):
        return
    owner, k, holds = owner[gone], k[gone], holds[gone]
    a = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (k[1:] != k[:-1] + 1) | (holds[1:] != holds[:-1])]))
    b = np.append(a[1:], len(k)) - 1
    owner, holds, begins, ends = owner[a], holds[a], k[a], k[b] + LENGTH
    by = np.argsort(at_block[owner], kind="stable")
    for block, lo, hi in _slices(at_block[owner[by]]):
        pick = by[lo:hi]
        yield block, bucket, _pack(np.int64(bucket) << 32 | index[owner[pick]], holds[pick], begins[pick], ends[pick])


def own_ranges(doc_ids: list[int], rows: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, from and to of the byte ranges that have to go, from a block's (bucket, runs) rows."""
    none = np.zeros(0, dtype=np.int64)
    places = [_unpack(data, 3) for bucket, data in rows if bucket < 0]
    runs = [_unpack(data, 4) for bucket, data in rows if bucket >= 0]
    if not places or not runs:
        return none, none, none
    spot, row, start = (np.concatenate(x) for x in zip(*places, strict=True))
    of, holder, begins, ends = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(of, kind="stable")
    of, holder, begins, ends = of[order], holder[order], begins[order], ends[order]
    lo, n = np.searchsorted(of, spot, side="left"), np.searchsorted(of, spot, side="right")
    n -= lo
    place = np.repeat(np.arange(len(spot)), n)
    run = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    later = np.array(doc_ids, dtype=np.int64)[row[place]] > holder[run]
    place, run = place[later], run[later]
    return row[place], start[place] + begins[run], start[place] + ends[run]


def cut_ranges(texts: list[bytes], ranges: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """(n_bytes, n_removed, n_spans, kept) of each text after its ranges are cut out."""
    order = np.argsort(ranges[0], kind="stable")
    row, low, high = (x[order] for x in ranges)
    by_row = {number: (low[a:b], high[a:b]) for number, a, b in _slices(row)}
    for number, text in enumerate(texts):
        own = by_row.get(number)
        if not own:
            yield len(text), 0, 0, text
            continue
        depth = np.subtract(*(np.bincount(x, minlength=len(text) + 1)[: len(text) + 1] for x in own))
        gone = np.cumsum(depth)[: len(text)] > 0
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        yield len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept


def partitions_of(blocks: int, least: int) -> int:
    """Partitions of ``blocks`` blocks, ``least`` at least: as many up to ``SPREAD``, from there growing with the root.

    Each shuffle has a piece for each pair of partitions. With a partition a block these pieces grow with the input's square;
    as it is with the input. A partition's groups pass one by one, so a task still holds one block or bucket.
    """
    return max(least, min(blocks, math.isqrt(SPREAD * blocks)))


def remove_repeats(docs: DataFrame, block_bytes: int = 3_500_000, hot: int = 1 << 15, blocks: int | None = None, with_kept: bool = False) -> DataFrame:
    """Cut every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) on demand. Null text counts as empty; a null
    doc_id is larger than any other; rows that share a doc_id, or have none, never cut one another, and each is cut by what
    smaller ones hold. An empty table gives none. ``block_bytes`` of text make a block and bound a task's memory; anchors
    with over ``hot`` segments are dealt in pieces.
    """
    import pyarrow as pa

    n = blocks or max(1, -(-text_bytes(docs) // block_bytes))
    buckets = max(1, min(1 << 22, n // 2))
    tasks = partitions_of(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = F.col("doc_id").cast("long")
    dealt = docs.select(number.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.when(number.isNull(), F.xxhash64("text")).otherwise(F.xxhash64(number)), F.lit(n)).alias("block")).repartition(tasks, "block")

    def table(rows, names: list[str], kinds: list):
        rows = list(rows)
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    int64, data = pa.int64(), pa.binary()

    def anchors(group: pa.Table) -> pa.Table:
        return table(list_anchors(group.column("block")[0].as_py(), _block(group), buckets), ["bucket", "block", "keys", "in_two", "counts"], [int64, int64, data, data, data])

    def shared(group: pa.Table) -> pa.Table:
        return table(shared_anchors(group.column("bucket")[0].as_py(), *(group.column(c).to_pylist() for c in ("block", "keys", "in_two", "counts")), hot), ["block", "bucket", "keys", "hot_keys"], [int64, int64, data, data])

    names = ["to", "block", "segments", "lengths", "least", "most"]

    def segments(group: pa.Table, found: pa.Table) -> pa.Table:
        rows = ()
        if group.num_rows and found.num_rows:
            rows = list_segments(group.column("block")[0].as_py(), _block(group), buckets, list(zip(*(found.column(c).to_pylist() for c in ("bucket", "keys", "hot_keys")), strict=True)))
        return table(rows, names, [int64, int64, *[data] * 4])

    def holders(group: pa.Table) -> pa.Table:
        return table(smallest_holders(group.column("to")[0].as_py(), *(group.column(c).to_pylist() for c in names[1:])), ["block", "bucket", "runs"], [int64, int64, data])

    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def cut(group: pa.Table, found: pa.Table) -> pa.Table:
        ids, texts = _rows(group)
        out = cut_ranges(texts, own_ranges(ids, list(zip(*(found.column(c).to_pylist() for c in ("bucket", "runs")), strict=True))))
        rows = [(None if i == NO_ID else i, size, gone, spans, hashlib.sha256(kept).hexdigest(), kept) for i, (size, gone, spans, kept) in zip(ids, out, strict=True)]
        return table(rows, result, [int64, int64, int64, int64, pa.string(), data][: len(result)])

    listed = dealt.groupBy("block").applyInArrow(anchors, "bucket long, block long, keys binary, in_two binary, counts binary")
    both = listed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(shared, "block long, bucket long, keys binary, hot_keys binary")
    sent = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(segments, "to long, block long, segments binary, lengths binary, least binary, most binary")
    gone = sent.repartition(tasks, "to").groupBy("to").applyInArrow(holders, "block long, bucket long, runs binary")
    return dealt.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
