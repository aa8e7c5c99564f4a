"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most three of 64 bits agree wholly on three of six bit ranges, so each distinct fingerprint
goes to a bucket for each of the twenty choices of three ranges. Within buckets, fingerprints are stored as bit planes (one
machine word holds the same bit of 64 fingerprints); the distances of all lanes grow plane by plane in two-bit carry-save
counters with a sticky overflow, and a block is given up once every lane has overflowed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, sub_batches, write_table
from .components import connected

RADIUS, RANGES, AGREE = 3, (11, 11, 11, 11, 10, 10), 3


def range_masks() -> list[int]:
    """A 64-bit mask for each choice of ``AGREE`` bit ranges."""
    starts = np.cumsum((0, *RANGES))[:-1].tolist()
    own = [((1 << n) - 1) << s for n, s in zip(RANGES, starts, strict=True)]
    return [sum(x) for x in combinations(own, AGREE)]


# ---------------------------------------------------------------- fingerprints


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Unsigned fingerprints: majority bits of XXH64 (seed 42) over 3-word shingles, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split() if text else []  # bytes: lowers A-Z alone, splits at ASCII white space
        if not words:
            continue
        before = len(hashes)
        if len(words) < 3:
            hashes.append(digest(b" ".join(words), 42))
        else:
            joined, ends, at = b" ".join(words), [], -1
            for n in map(len, words):
                at += n + 1
                ends.append(at)
            hashes.append(digest(joined[: ends[2]], 42))
            hashes += [digest(joined[a + 1 : b], 42) for a, b in zip(ends, ends[3:], strict=False)]
        counts[k] = len(hashes) - before
    out = np.zeros(len(texts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = _majority(np.array(hashes, dtype=np.uint64), counts[full])
    return out


def _majority(hashes: np.ndarray, counts: np.ndarray, rows: int = 1 << 17) -> np.ndarray:
    """Bits set in over half of each run of ``counts`` hashes. Bytes count bits of up to 255 hashes before they widen."""
    totals = np.zeros((len(counts), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), rows):
        part, own = hashes[at : at + rows], owner[at : at + rows]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        new = np.flatnonzero(np.diff(own, prepend=-1))
        cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(new, [*new[1:], len(part)], strict=True)])
        sums = np.add.reduceat(bits, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
        docs = own[cuts]
        first = np.flatnonzero(np.diff(docs, prepend=-1))
        totals[docs[first]] += np.add.reduceat(sums.astype(np.int64), first, axis=0)
    majority = (2 * totals > counts[:, None]).astype(np.uint8)
    return np.packbits(majority, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed long, for every whole text (null: fingerprint zero)."""

    def run(batches):
        import pyarrow as pa

        for batch in sub_batches(batches):
            found = fingerprints_of(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "print"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, print long")


# ---------------------------------------------------------------- bit-sliced comparison


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint i is bit i % 64 of planes[b, i // 64]. Unused lanes repeat the first fingerprint."""
    padded = np.full(-(-len(prints) // 64) * 64, prints[0], dtype=np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def within_radius(differences, alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes of ``alive`` with at most ``radius`` set among the planes that ``differences`` yields.

    Each lane has a carry-save counter, one word for each of its bits; it starts so high that difference ``radius`` + 1
    overflows, which clears the lane for good. The planes end early when no lane is left.
    """
    bits = radius.bit_length()
    head = (1 << bits) - 1 - radius
    counters = [np.full_like(alive, FULL if head >> b & 1 else 0) for b in range(bits)]
    alive = alive.copy()
    for k, x in enumerate(differences):
        for counter in counters:
            carry = counter & x
            counter ^= x
            x = carry
        alive &= ~x
        if k & 7 == 7 and not alive.any():
            break
    return alive


def near_lanes(planes: np.ndarray, ask: int, open_lanes: np.ndarray, radius: int = RADIUS, block: int = 64) -> np.ndarray:
    """Those of ``open_lanes`` (words) within the radius of ``ask``: in blocks of ``block`` words, each given up on its own."""
    out = np.zeros_like(open_lanes)
    for at in range(0, len(open_lanes), block):
        now = slice(at, at + block)
        if open_lanes[now].any():
            out[now] = within_radius((planes[b, now] ^ FULL if ask >> b & 1 else planes[b, now] for b in range(64)), open_lanes[now], radius)
    return out


def lane_words(flags: np.ndarray) -> np.ndarray:
    """Flags of lanes as words."""
    padded = np.zeros(-(-len(flags) // 64) * 64, dtype=np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def link_bucket(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links (as positions) that connect what is connected within the radius: each found lane is asked once, against lanes not found yet."""
    left, links = np.arange(len(prints)), []
    while len(left) > 1:
        planes, free = bit_planes(prints[left]), np.ones(len(left), dtype=bool)
        while 2 * free.sum() > len(left):  # planes are laid out anew when half of the lanes are found
            queue = [int(free.argmax())]
            free[queue[0]] = False
            while queue and free.any():
                q = queue.pop()
                found = np.flatnonzero(_lanes(near_lanes(planes, int(prints[left[q]]), lane_words(free)), len(left))).tolist()
                links += [(int(left[q]), int(left[x])) for x in found]
                queue += found
                free[found] = False
        left = left[free]
    return links


def link_small_buckets(prints: np.ndarray, bucket: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in many buckets of up to ``most`` lanes at once: all lanes against themselves shifted by 1, 2, ... lanes."""
    a, b = [], []
    for shift in range(1, most):
        same = np.flatnonzero(bucket[shift:] == bucket[:-shift])
        if not len(same):
            break
        left, right = bit_planes(prints[same]), bit_planes(prints[same + shift])
        near = _lanes(within_radius((left[k] ^ right[k] for k in range(64)), np.full(left.shape[1], FULL)), len(same))
        a.append(same[near])
        b.append(same[near] + shift)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(n: int, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """A star to the smallest position for each component of the links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    keys = list(parent)
    return keys, [root(x) for x in keys]


SMALL = 12


def bucket_links(prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars over linked positions, for rows sorted by bucket."""
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
    sizes = np.diff(np.append(starts, len(bucket)))
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    at = np.flatnonzero(small)
    a, b = link_small_buckets(prints[at], bucket[at], SMALL) if len(at) else (at, at)
    a, b = at[a].tolist(), at[b].tolist()
    for k in np.flatnonzero(sizes > SMALL).tolist():
        for x, y in link_bucket(prints[starts[k] : starts[k] + sizes[k]]):
            a.append(int(starts[k]) + x)
            b.append(int(starts[k]) + y)
    x, y = _forest(len(prints), a, b)
    return np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)


def print_links(prints: DataFrame) -> DataFrame:
    """Links among distinct fingerprints (column ``print``) within the radius, as few as keep the components: a, b.

    A bucket holds distinct fingerprints that agree on about half of their bits, so its size is bounded by the rest, and
    copies of a text, however many, are one row in it.
    """
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in range_masks()])
    keyed = prints.select("print", F.posexplode(masks).alias("choice", "mask")).select("choice", F.col("print").bitwiseAND(F.col("mask")).alias("part"), "print")
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        def links(choice, part, fp):
            bucket = np.cumsum(np.concatenate([[0], (np.diff(choice) != 0) | (np.diff(part) != 0)]))
            a, b = bucket_links(fp.view(np.uint64), bucket)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        held = None
        for batch in batches:
            got = [np.asarray(batch.column(i)) for i in range(3)]
            held = [np.concatenate(x) for x in zip(held, got, strict=True)] if held else got
            if not len(held[0]):
                held = None
                continue
            # the last bucket may go on in the next batch
            cut = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1]) + 1 if (held[0][0], held[1][0]) != (held[0][-1], held[1][-1]) else 0
            if cut:
                yield links(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held:
            yield links(*held)

    return keyed.repartition(n, "choice", "part").sortWithinPartitions("choice", "part").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of at most three bits.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows return repeated rows; a null doc_id
    never names a component unless all of it is null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    marked, _ = write_table(fingerprint_table(docs), "prints")
    distinct, path = write_table(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-prints")
    root = connected(print_links(distinct.select("print")))
    named = distinct.join(root, distinct["print"] == root["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print, _ = write_table(named.join(least, "root").select("print", "component_id"), "print-components")
    delete_path(spark, path)
    return marked.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
