"""Near-duplicates by the Jaccard similarity of five-word shingle sets, as the pipeline's SimHash stage takes them.

Two texts with a similarity of 0.8 differ in about ten of a SimHash's 64 bits, where no few agreeing ranges of bits are
certain. So a text's SimHash has ``WORDS`` times 64 bits here, and ``BANDS`` ranges of ``BITS`` of them, four shuffles of all
bits cut in a row, name its buckets: a pair at the threshold differs in 15 % of the bits and shares none with a probability of
3e-5, a closer pair with less. Within buckets every text is compared with every other one bit-sliced, over two of the words;
only texts within ``RADIUS_2`` bits go on. What they tie over all buckets is a cluster, and every link in one is checked on the
whole shingle sets.

Each cluster is first checked as a star around one text, which settles large groups in as many pairs as they have texts. What a cluster then still holds in different components is compared where
the cluster is: the texts outside its largest component are a stated query set against all of its texts, bit-sliced and in
blocks of bounded size, and only links found leave the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, kept, sub_batches, write_table
from .components import connected
from .simhash import FULL, _lanes, _majority, bit_planes, lane_words, near_lanes, within_radius

WIDTH, SIMILARITY, RADIUS, RADIUS_2 = 5, 0.8, 22, 36  # bits of one word, of two
WORDS, BITS, SHUFFLES = 8, 14, 4
#: Shingles of the texts in one block of a bucket.
BLOCK = 500_000
#: Lanes of a bucket from which its first texts gather their neighbours, and words compared at once.
LARGE, SLICE = 1024, 1 << 15
_RANDOM = np.random.default_rng(42)
_RANGES = np.concatenate([_RANDOM.permutation(64 * WORDS)[: 64 * WORDS // BITS * BITS].reshape(-1, BITS) for _ in range(SHUFFLES)])
BANDS = len(_RANGES)


def shingles_of(text: str | None) -> np.ndarray:
    """Distinct hashes (XXH64, seed 42) of five-word shingles; a shorter text is one shingle, one without words none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode().lower().split() if text else []  # as in simhash.fingerprints_of
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, ends, at = b" ".join(words), [], -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
    begins = [0, *(x + 1 for x in ends)]
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(begins, ends[WIDTH - 1 :] or ends[-1:], strict=False)], dtype=np.uint64))


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, WORDS) SimHashes: majority bits of the shingles' hashes, and of hashes mixed from them; zero for an empty set."""
    out, full = np.zeros((len(sets), WORDS), dtype=np.uint64), [i for i, x in enumerate(sets) if len(x)]
    if full:
        flat, counts = np.concatenate([sets[i] for i in full]), np.array([len(sets[i]) for i in full])
        for word in range(WORDS):
            mixed = flat
            if word:
                mixed = (flat ^ flat >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(word * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                mixed ^= mixed >> np.uint64(31)
            out[full, word] = _majority(mixed, counts)
    return out


def buckets_of(prints: np.ndarray) -> np.ndarray:
    """(texts, BANDS) numbers of buckets: the band and its bits."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    out = np.tile(np.arange(BANDS, dtype=np.int32) << BITS, (len(prints), 1))
    for k in range(BITS):
        out |= bits[:, _RANGES[:, k]].astype(np.int32) << k
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of its text (null as empty)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def print_table(docs: DataFrame) -> DataFrame:
    """doc_id, key and the wide SimHash, for every whole text."""

    def run(batches):
        import pyarrow as pa

        kept("near", bool)  # what other operators left in this worker goes
        for batch in sub_batches(batches):
            found = wide_prints([shingles_of(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "key", "prints"])

    return _keyed(docs).mapInArrow(run, "doc_id long, key binary, prints binary")


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the links (a, b) connect one label, the smallest of theirs; labels are positions."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(labels, high[apart], low[apart])
        while not np.array_equal(after := labels[labels], labels):
            labels[:] = after


def near_clusters(bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """For rows sorted by bucket the position of the first row that each is tied to, over pairs of a bucket within the radius.

    ``prints``: (2, rows). Every lane is asked against all words of its bucket, many at once; in large buckets one of
    the first lanes gathers its neighbours before, which need no asking: they are tied, and all others are asked against them.
    """
    out = np.arange(len(bucket))
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
    sizes = np.diff(np.append(starts, len(bucket)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return out
    rows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())  # lanes in a row, buckets side by side in words
    ends = np.cumsum(sizes)
    before = ends - sizes
    first, words = before // 64, (ends - 1) // 64 - before // 64 + 1
    of = np.repeat(np.arange(len(sizes)), sizes)
    planes = [bit_planes(p[rows]) for p in prints]

    def ask(who: np.ndarray, word: np.ndarray) -> np.ndarray:
        low, high = np.maximum(before[of[who]], 64 * word), np.minimum(ends[of[who]], 64 * word + 64)
        alive = (FULL >> (64 - high + low).astype(np.uint64)) << (low - 64 * word).astype(np.uint64)  # lanes of the bucket
        own = who // 64 == word
        alive[own] &= ~(np.uint64(1) << (who[own] % 64).astype(np.uint64))
        mine = [p[rows[who]] for p in prints]
        alive = within_radius((plane[b][word] ^ np.negative(p >> np.uint64(b) & np.uint64(1)) for plane, p in zip(planes, mine, strict=True) for b in range(64)), alive, RADIUS_2)
        hit = np.flatnonzero(alive)
        at, bit = np.nonzero(np.unpackbits(alive[hit].view(np.uint8), bitorder="little").reshape(-1, 64))
        found = rows[64 * word[hit[at]] + bit]
        _merge(out, rows[who[hit[at]]], found)
        return found

    asking = np.ones(len(rows), dtype=bool)
    for k in np.flatnonzero(sizes > LARGE).tolist():
        for seed in range(before[k], before[k] + 8):
            found = ask(np.full(words[k], seed), first[k] + np.arange(words[k]))
            if 16 * len(found) >= sizes[k]:
                asking[before[k] + found - starts[k]] = False
                break
    n = np.where(asking, words[of], 0)
    asked, at = np.cumsum(n), 0
    while at < len(rows):
        done = asked[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(asked, done + SLICE, side="right")))
        who = np.repeat(np.arange(at, to), n[at:to])
        if len(who):
            ask(who, first[of[who]] + np.arange(len(who)) - np.repeat(asked[at:to] - n[at:to] - done, n[at:to]))
        at = to
    return out


def print_clusters(nodes: DataFrame) -> DataFrame:
    """bucket (the smallest node) and node: clusters of texts tied by SimHashes within the radius in shared buckets.

    Columns of ``nodes``: node (long), prints. A text is in one cluster; texts that nothing is tied to are in none.
    """

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
                columns = [buckets_of(prints).ravel(), *(np.repeat(x, BANDS) for x in (np.asarray(part.column(0)), prints[:, 0].view(np.int64), prints[:, 1].view(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bucket", "node", "low", "high"])

    def run(batches):
        import pyarrow as pa

        def links(bucket, node, low, high):
            first = near_clusters(bucket, np.stack([low, high]).view(np.uint64))
            tied = np.flatnonzero(first != np.arange(len(first)))
            return pa.RecordBatch.from_arrays([pa.array(node[first[tied]]), pa.array(node[tied])], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([np.asarray(batch.column(i)) for i in range(4)])
            n += batch.num_rows
            if n >= 1 << 16:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on in the next batch
                if cut:
                    yield links(*(x[:cut] for x in rows))
                held, n = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if n:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("node", "prints").mapInArrow(deal, "bucket int, node long, low long, high long")
    links = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long").distinct()
    found = connected(links)
    return found.select(F.col("root").alias("bucket"), "node").unionByName(found.select(F.col("root").alias("bucket"), F.col("root").alias("node")).distinct())


def prints_of(sets: list[np.ndarray]) -> np.ndarray:
    """SimHashes of shingle sets: majority bits of the shingles' hashes; zero for an empty set."""
    out, full = np.zeros(len(sets), dtype=np.uint64), [i for i, x in enumerate(sets) if len(x)]
    if full:
        out[full] = _majority(np.concatenate([sets[i] for i in full]), np.array([len(sets[i]) for i in full]))
    return out


def shingle_table(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, SimHash and shingle set of the text of each (doc_id, key) in ``keys``."""

    def run(batches):
        import pyarrow as pa

        for batch in sub_batches(batches):
            sets = [shingles_of(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(prints_of(sets).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat)], ["key", "print", "shingles"])

    texts, wanted = _keyed(docs), keys.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"))
    found = texts.join(wanted, (texts["key"] == wanted["of_key"]) & texts["doc_id"].eqNullSafe(wanted["of"]), "left_semi").select("doc_id", "text", "key")
    return found.mapInArrow(run, "key binary, print long, shingles array<long>").groupBy("key").agg(F.first("print").alias("print"), F.first("shingles").alias("shingles"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets reach the similarity."""
    one, other = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"of_{k}")) for k in ("a", "b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    # in whole numbers: common / (all - common) >= 4 / 5; two empty sets are equal
    return pairs.join(one, "a").join(other, "b").filter(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


class Lanes:
    """Texts of one block of a bucket: bit planes of their SimHashes, and which of them hold each shingle."""

    def __init__(self, keys: list[bytes], roots: list[bytes], prints: list[int], sets: list[np.ndarray]):
        self.keys, self.roots = keys, roots
        self.numbers = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        self.of = np.array([self.numbers[r] for r in roots])
        self.planes = bit_planes(np.array(prints, dtype=np.int64).view(np.uint64))
        self.sizes = np.array([len(x) for x in sets])
        flat, holder = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.holder = holder[order]
        self.values, self.at = np.unique(flat[order], return_index=True)
        self.at = np.append(self.at, len(flat))
        self.tops = np.arange(len(self.numbers))  # each root's component, as found so far

    def links(self, key: bytes, root: bytes, fingerprint: int, own: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Links of a text to texts here, one for each component that it is tied to anew."""
        if root not in self.numbers:
            self.numbers[root] = len(self.tops)
            self.tops = np.append(self.tops, len(self.tops))
        mine = self.tops[self.numbers[root]]
        near = _lanes(near_lanes(self.planes, fingerprint & (1 << 64) - 1, lane_words(self.tops[self.of] != mine), RADIUS), len(self.keys))
        if not near.any():
            return []
        spot = np.searchsorted(self.values, own)
        hit = spot[spot < len(self.values)]
        hit = hit[self.values[hit] == own[: len(hit)]]  # both are sorted: only the largest of own lie beyond all values
        begin, n = self.at[hit], self.at[hit + 1] - self.at[hit]
        places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(self.holder[places], minlength=len(self.keys))
        out = []
        for i in np.flatnonzero(near & (9 * common >= 4 * (len(own) + self.sizes))).tolist():
            other = self.tops[self.of[i]]
            if other != mine:
                self.tops[self.tops == other] = mine
                out.append((key, self.keys[i]))
        return out


def bucket_links(buckets: DataFrame) -> DataFrame:
    """Links (a, b) between components within the blocks of buckets.

    Columns of ``buckets``: bucket, block, ask, key, root, print, shingles. Rows with ``ask`` are asked against the
    others of their block; they pass one by one, so a task holds a block at a time.
    """

    def run(batches):
        import pyarrow as pa

        kept("near", bool)
        here, gathered, lanes = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block, ask = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys, roots, prints = (batch.column(i).to_pylist() for i in (3, 4, 5))
            offsets, flat = np.asarray(batch.column(6).offsets), np.asarray(batch.column(6).values).view(np.uint64)
            found = []
            for i in range(batch.num_rows):
                spot = (bucket[i], block[i])
                if spot != here:
                    here, gathered, lanes = spot, [], None
                own = flat[offsets[i] : offsets[i + 1]]
                if not ask[i]:
                    gathered.append((keys[i], roots[i], prints[i], own.copy()))
                    continue
                if gathered and lanes is None:
                    lanes = Lanes(*map(list, zip(*gathered, strict=True)))
                    gathered = [None]
                if lanes is not None:
                    found += lanes.links(keys[i], roots[i], prints[i], own)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets.select("bucket", "block", "ask", "key", "root", "print", F.array_sort("shingles").alias("shingles"))
    return dealt.repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "ask").mapInArrow(run, "a binary, b binary")


def key_roots(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """node and root for each text key whose component has a smaller key."""
    spark = docs.sparkSession
    each = prints.groupBy("key").agg(F.first("prints").alias("prints"), F.min("doc_id").alias("doc_id"))
    nodes, all_path = write_table(each.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    clusters, clusters_path = write_table(print_clusters(nodes), "near-clusters")
    sized = clusters.join(clusters.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
    members, members_path = write_table(sized.join(nodes.select("node", "key", "doc_id"), "node").select("bucket", "key", "doc_id", "n"), "near-buckets")
    wanted = members.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("met"))
    met, met_path = write_table(wanted, "near-keys")
    sets, sets_path = write_table(shingle_table(docs, met), "near-shingles")
    centres = members.join(met.select("key", "met"), "key").groupBy("bucket").agg(F.max_by("key", F.struct("met", "key")).alias("centre"))
    stars = _ordered(members.join(centres, "bucket").select(F.col("key").alias("a"), F.col("centre").alias("b")))
    links, links_path = write_table(similar(stars, sets), "near-links")
    roots, roots_path = write_table(connected(links), "near-roots")
    # what one bucket still holds in different components
    named = members.join(roots, members["key"] == roots["node"], "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    named, named_path = write_table(named.join(sets.select("key", F.size("shingles").cast("long").alias("size")), "key"), "near-named")
    parts = named.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max_by("root", F.struct("n", "root")).alias("main")).filter("parts > 1")
    blocks = F.ceil(F.greatest(F.col("all"), F.lit(1)) / BLOCK).cast("int")
    own = F.array(F.struct(F.pmod(F.xxhash64("key"), blocks).cast("int").alias("block"), F.lit(False).alias("ask")))
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.struct(i.alias("block"), F.lit(True).alias("ask")))
    dealt = named.join(mixed, "bucket").select("bucket", "key", "root", F.explode(F.when(F.col("root") == F.col("main"), own).otherwise(F.concat(own, every))).alias("to")).join(sets, "key")
    more, more_path = write_table(bucket_links(dealt.select("*", "to.block", "to.ask")), "near-links")
    ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b")]
    across = more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    over = connected(_ordered(across))
    merged = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("over")), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    out, _ = write_table(merged.unionByName(over.select("node", "root")), "near-merged")
    delete_path(spark, all_path, clusters_path, members_path, met_path, sets_path, links_path, roots_path, named_path, more_path)
    return out


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, key and root (a key) of every row."""
    prints, path = write_table(print_table(docs), "near-texts")
    roots = key_roots(docs, prints)
    out, _ = write_table(prints.select("doc_id", "key").join(roots, prints["key"] == roots["node"], "left").select("doc_id", "key", F.coalesce("root", "key").alias("root")), "near-rows")
    delete_path(docs.sparkSession, path)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over texts with a similarity of 0.8 at least.

    Texts without words link to each other. Repeated rows return repeated rows; a null doc_id never names a component unless
    all of it is null. An empty table gives an empty result; other columns are ignored.
    """
    marked = _marked(docs)
    least = marked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return marked.join(least, "root").select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: that with the smallest doc_id (null: after all others), then text hash.

    Of rows that are equal in doc_id and text any one stays. An empty table stays empty.
    """
    marked = _marked(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    counted = marked.groupBy("root", "doc_id", "key").agg(F.count("*").alias("rows"))
    chosen, path = write_table(counted.groupBy("root").agg(first.alias("first"), F.min_by("rows", F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("near_rows")).select(F.col("first.doc_id").alias("near_id"), F.col("first.key").alias("near_key"), "near_rows"), "near-chosen")
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    kept = docs.join(chosen, (key == chosen["near_key"]) & docs["doc_id"].cast("long").eqNullSafe(chosen["near_id"]))
    once = kept.filter("near_rows = 1").select(*[docs[c] for c in docs.columns])
    if chosen.filter("near_rows > 1").isEmpty():
        return once
    again = kept.filter("near_rows > 1").dropDuplicates(["near_key", "near_id"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(again)
