"""Line dedup, repeats, SimHash and decontamination against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspar.llm import lines, simhash, spans, templates
from marlspar.llm.components import connected
from marlspar.llm.suffixes import common_prefixes_reach, suffix_array


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---------------------------------------------------------------- suffix arrays and repeats


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80).map(lambda b: bytes(x % 4 for x in b)))
def test_suffix_array_sorts(text):
    order = suffix_array(np.frombuffer(text, dtype=np.uint8), 80).tolist()
    assert order == sorted(range(len(text)), key=lambda i: text[i:])


def test_common_prefixes():
    text = np.frombuffer(b"abcabcabx" * 9, dtype=np.uint8)
    order = suffix_array(text, 88)
    raw = text.tobytes()
    for length in (1, 7, 8, 9, 20):
        want = [False] + [raw[a : a + length] == raw[b : b + length] and max(a, b) + length <= len(raw) for a, b in zip(order, order[1:], strict=False)]
        if length >= 8:
            assert common_prefixes_reach(text, order, length).tolist() == want


def brute_repeats(rows):
    first, out = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, spans.NO_ID), spans.NO_ID if i is None else i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (spans.NO_ID if i is None else i):
                gone[k : k + 50] = True
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [0, 4096])
def test_repeats_across_blocks(documents, hot):
    rng = random.Random(4)
    pool = ["".join(rng.choices("abcd ", k=rng.randint(5, 200))) for _ in range(8)] + ["a" * 300, "é中😀" * 40]
    rows = [(i, "".join(rng.choices(pool, k=rng.randint(0, 4))), "en", "s") for i in rng.sample(range(10_000), 60)]
    assert rows_of(spans.remove_repeats(documents(rows, extra=True), hot=hot, blocks=7)) == brute_repeats(rows)


def licensed(n, rng):
    line = "this one licence line stands in every document of the whole table, whatever it says. " * 2
    return [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(20, 120))) + line + "".join(rng.choices("abcdefgh ", k=rng.randint(20, 120))), "en", "s") for i in range(n)]


def test_a_line_in_every_document(documents):
    rows = licensed(300, random.Random(6))
    want = brute_repeats(rows)
    for hot in (20, 1 << 15):
        assert rows_of(spans.remove_repeats(documents(rows), hot=hot, blocks=5)) == want


def test_rows_without_an_id_or_with_the_same_one(documents):
    """Texts that differ under one id, or none, are cut each by itself."""
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcdefgh ", k=90)) for _ in range(6)]
    rows = [(rng.choice([None, None, 5, 6, 7, 8]), rng.choice(pool) + "".join(rng.choices("xyz", k=rng.randint(1, 30))) + rng.choice(pool), "en", "s") for _ in range(60)]
    for hot in (0, 1 << 15):
        assert rows_of(spans.remove_repeats(documents(rows), hot=hot, blocks=4)) == brute_repeats(rows)


def test_shuffle_pieces_grow_with_the_blocks(documents):
    """A shuffle's pieces (pairs of partitions) follow the number of blocks, not its square, and results stay."""
    plan = spans.remove_repeats(documents([(1, "a", "en", "a")]), blocks=1600)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan)]
    assert dealt and all(n * n <= 64 * 1600 for n in dealt)
    rng = random.Random(5)
    rows = licensed(30, rng)
    assert rows_of(spans.remove_repeats(documents(rows), blocks=150)) == brute_repeats(rows)


def test_hot_segments_spread_over_buckets():
    rows = licensed(2000, random.Random(7))
    block = spans.Block([r[0] for r in rows], [r[1].encode() for r in rows])
    buckets = 64
    listed = list(spans.list_anchors(0, block, buckets))

    def loads(hot):
        shared = [row for b, _, *x in listed for row in spans.shared_anchors(b, [0], *([v] for v in x), hot)]
        sent = spans.list_segments(0, block, buckets, [(b, k, h) for _, b, k, h in shared])
        return sorted(sum(np.frombuffer(x[3], dtype="<i4").tolist()) for x in sent if x[0] >= 0)

    assert loads(100)[-1] < loads(1 << 15)[-1] / 3


def test_repeats_in_awkward_rows(documents, awkward):
    assert rows_of(spans.remove_repeats(documents(awkward, extra=True), blocks=3)) == brute_repeats(awkward)
    assert spans.remove_repeats(documents([])).count() == 0


# ---------------------------------------------------------------- SimHash


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest position reachable over links of three bits."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    texts = [None, "", " \n", "Ab", "a B", "a\x0bb\x0cc d e", "É é x y z", "the same words " * 300]
    assert simhash.fingerprints_of(texts).tolist() == [brute_print(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(2, 60))
def test_bit_sliced_links_keep_components(seed, n):
    rng = random.Random(seed)
    prints = list({rng.getrandbits(64)} | {0})
    while len(prints) < n:
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 6)):
            p ^= 1 << b
        prints = list(dict.fromkeys([*prints, p]))
    array = np.array(prints, dtype=np.uint64)
    want = brute_components(prints)
    for bucket in (np.zeros(n, np.int64), None):
        if bucket is None:
            a, b = zip(*simhash.link_bucket(array), strict=True) if simhash.link_bucket(array) else ((), ())
        else:
            a, b = (x.tolist() for x in simhash.bucket_links(array, bucket))
        parent = list(range(n))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a, b, strict=True):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        assert [root(i) for i in range(n)] == want


def test_every_close_pair_shares_a_bucket():
    rng, masks = random.Random(1), simhash.range_masks()
    assert len(masks) == 20
    for _ in range(500):
        p = rng.getrandbits(64)
        q = p
        for b in rng.sample(range(64), 3):
            q ^= 1 << b
        assert any(p & m == q & m for m in masks)


def test_near_duplicates(documents, awkward):
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefg", k=5)) for _ in range(400)]
    rows = [*awkward]
    for i in range(100, 140):
        own = list(base) if i % 4 else ["".join(rng.choices("hijk", k=6)) for _ in range(50)]
        own[rng.randrange(len(own))] = f"x{i}"
        rows.append((i, " ".join(own), "en", "a"))
    got = simhash.near_duplicates(documents(rows, extra=True)).collect()
    prints = [brute_print(r[1]) for r in rows]
    roots = brute_components(prints)
    names = collections.defaultdict(list)
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            names[root].append(r[0])
    want = sorted(((r[0], f"{p:016x}", min(names[root], default=None)) for r, p, root in zip(rows, prints, roots, strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(documents([])).count() == 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, 500)]
    found = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = {x for e in edges for x in e}
    assert found == {x: root(x) for x in nodes if root(x) != x}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- lines


def brute_lines(rows, least):
    sites, first = collections.defaultdict(set), {}
    for i, t, _, s in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                sites[line].add(s or "")
                at = (i is not None, i or 0, pos)
                first[line] = min(first.get(line, at), at)
    out = []
    for i, t, _, _ in rows:
        parts = (t or "").split("\n")
        cut = [len(sites[x]) >= least and first[x] != (i is not None, i or 0, pos) if x.strip(" ") else False for pos, x in enumerate(parts)]
        kept = None if t is None else "\n".join(x for x, c in zip(parts, cut, strict=True) if not c)
        out.append((i, kept, len(parts), sum(cut)))
    return sorted(out, key=str)


def test_lines_near_and_far_from_the_threshold(documents):
    rng = random.Random(9)
    common = {f"common line {k}": k for k in range(1, 40)}
    rows, i = [], 0
    for line, k in common.items():
        for s in range(k):
            rows.append((i, "\n".join(rng.sample([line, f"own {i}", "", f"other {i}"], 4)), "en", f"site{s}"))
            i += 1
    docs = documents(rows, extra=True)
    got = lines.dedup_lines(docs, min_sites=20)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert rows_of(got.select("doc_id", "text", "n_lines", "n_removed")) == brute_lines(rows, 20)


def test_lines_of_awkward_rows(documents, awkward):
    got = rows_of(lines.dedup_lines(documents(awkward, extra=True), min_sites=2).select("doc_id", "text", "n_lines", "n_removed"))
    assert got == brute_lines(awkward, 2)
    assert lines.dedup_lines(documents([])).count() == 0


# ---------------------------------------------------------------- decontamination


def brute_template(text):
    text = re.sub(r"(?<=\d)[.,](?=\d)", "", text or "")
    raw = [w for w in re.split(r"[\W_]+", text) if w]
    named = re.sub(r"(?<=[a-zß-öø-ÿ,;] )[A-ZÀ-ÖØ-Þ][^\W\d_]*", templates.NAME, text)
    numbered = re.sub(r"\d+", templates.NUMBER, named)
    units = "|".join(sorted(templates.UNITS.split(), key=len, reverse=True))
    return [w for w in re.split(r"[\W_]+", re.sub(rf"(?<={templates.NUMBER})( ?)(?:{units})(?![^\W_])", rf"\1{templates.UNIT}", numbered).lower()) if w], raw


ITEMS = [
    (1, "A train leaves at 9 and travels 120 km to reach, says Anna, the old harbour before the evening tide comes in"),
    (2, "the quick brown fox jumps over the lazy dog while seven sleepy cats watch from the garden wall"),
    (3, "short one"),
    (4, None),
    (5, "12 34 56 78 90"),
]


def leak_ids(spark, documents, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    return {(r["doc_id"], r["item_id"]): r for r in templates.leaks(documents(rows, extra=True), items).collect()}


def test_leaks(spark, documents, awkward):
    plain = ITEMS[1][1]
    rows = [
        *awkward,
        (20, f"before it all. {plain} and after", "en", "a"),
        (21, f"Before. {plain.upper()} after", "en", "a"),
        (22, "some text. A train leaves at 14 and travels 75 km to reach, says Bruno, the old harbour before the evening tide comes in and more", "en", "a"),
        (23, " ".join(plain.split()[:9]) + " stops here", "en", "a"),
        (24, "nothing of the kind is in here at all but words", "en", "a"),
        (25, "short one", "en", "a"),
        (26, "12 34 56 78 90", "en", "a"),
        (27, f"{plain} {plain}", "en", "a"),
    ]
    found = leak_ids(spark, documents, rows)
    assert set(found) == {(20, 2), (21, 2), (22, 1), (25, 3), (27, 2)}
    assert found[22, 1]["n_changed"] >= 3 and found[20, 2]["n_changed"] == 0


def test_slots_must_be_filled_consistently(spark, documents):
    item = "if Anna gives Bruno 5 apples and, later, Anna takes 3 apples back from, say, Bruno how many apples has he left"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    consistent = item.replace("Anna", "Clara").replace("Bruno", "David").replace("5", "7")
    confused = item.replace("Anna", "Clara", 1).replace("Bruno", "David")
    found = templates.leaks(documents([(1, "now, " + consistent, "en", "a"), (2, "now, " + confused, "en", "a")]), items).collect()
    assert [r["doc_id"] for r in found] == [1]


def test_template_windows_against_brute_force(spark, documents):
    rng = random.Random(5)
    words = "alpha beta gamma delta Anna Bruno 12 3.5 km kg, run. Walk and; the".split()
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 14)))) for i in range(12)]
    rows = []
    for i in range(40):
        body = rng.choice(items)[1] if i % 2 else " ".join(rng.choices(words, k=12))
        rows.append((i, " ".join(rng.choices(words, k=4)) + " . " + body + " . " + " ".join(rng.choices(words, k=4)), "en", "a"))
    found = {(r["doc_id"], r["item_id"]) for r in templates.leaks(documents(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def windows(ws):
        return [(p, tuple(ws[p : p + 5])) for p in range(max(1, len(ws) - 4))] if ws else []

    want = set()
    for item, text in items:
        t, raw = brute_template(text)
        real = [(p, w) for p, w in windows(t) if sum(not x.startswith("ǁ") for x in w) >= min(2, len(w))]
        need = len({w for _, w in real})
        for doc, body, *_ in rows:
            td, rd = brute_template(body)
            by = collections.defaultdict(list)
            for q, w in windows(td):
                for p, v in real:
                    if v == w:
                        by[q - p].append((p, q, w))
            matched = set()
            for hits in by.values():
                filled = {(raw[p + k].lower(), rd[q + k].lower()) for p, q, w in hits for k in range(len(w)) if w[k].startswith("ǁ")}
                if len(filled) == len({a for a, _ in filled}):
                    matched |= {w for _, _, w in hits}
            if need and len(matched) >= np.ceil(0.8 * need):
                want.add((doc, item))
    assert found == want and want


def test_no_leaks_in_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert templates.leaks(documents([]), items).count() == 0
    assert templates.leaks(documents([(1, "the quick brown fox", "en", "a")]), items.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 7, 22])
def test_bit_sliced_distances_against_counts(radius):
    """Blocks of lanes, closed lanes and every radius, against distances counted one by one."""
    rng = np.random.default_rng(radius)
    base = int(rng.integers(0, 1 << 63))
    prints = np.array([base ^ sum(1 << int(b) for b in rng.choice(64, size=int(rng.integers(0, 30)), replace=False)) for _ in range(9000)], dtype=np.uint64)
    free = rng.random(len(prints)) < 0.7
    free[4096:8192] = False  # whole blocks without an open lane
    words = simhash.near_lanes(simhash.bit_planes(prints), base, simhash.lane_words(free), radius, block=16)
    got = np.unpackbits(words.view(np.uint8), bitorder="little")[: len(prints)].astype(bool)
    assert np.array_equal(got, free & (np.bitwise_count(prints ^ np.uint64(base)) <= radius))


def test_large_buckets_are_linked_whole():
    rng = np.random.default_rng(4)
    prints = np.unique(np.array([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in rng.integers(0, 1 << 63, 40) for a, b in rng.integers(0, 64, (60, 2))], dtype=np.uint64))
    rng.shuffle(prints)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = np.arange(len(prints))
    while True:
        least = np.where(near, want[None, :], len(prints)).min(axis=1)
        if np.array_equal(least, want):
            break
        want = least
    parent = np.arange(len(prints))
    for a, b in simhash.link_bucket(prints):
        assert near[a, b]
        parent[parent == max(parent[a], parent[b])] = min(parent[a], parent[b])
    assert np.array_equal(np.unique(parent, return_inverse=True)[1], np.unique(want, return_inverse=True)[1])
