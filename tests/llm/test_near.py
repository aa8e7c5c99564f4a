"""Near-duplicates by five-word shingles against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from marlspar.llm import near


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return not a and not b or len(a & b) / max(1, len(a | b)) >= 0.8


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def brute_components(rows):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, t, *_) in enumerate(rows):
        for j in range(i):
            if similar(t, rows[j][1]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def near_rows():
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(rng.choice([60, 200, 400])))
        for _ in range(8):
            rows.append((100 + len(rows), edited(rng, base, rng.randint(0, len(base.split()) // 30)), "en", "a"))
    return rows


def test_links_and_components_against_brute_force(documents, awkward):
    rows = [*awkward, *near_rows()]
    got = near.near_duplicates(documents(rows, extra=True)).collect()
    roots = brute_components(rows)
    names = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            names[root] = min(names.get(root, r[0]), r[0])
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], names.get(root)) for r, root in zip(rows, roots, strict=True)), key=str)
    assert len(set(roots)) < len(rows) - 40
    assert near.near_duplicates(documents([])).count() == 0


def test_large_group_of_near_copies(documents):
    rng = random.Random(12)
    base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(100))
    rows = [(i, edited(rng, base, 1), "en", "a") for i in range(300)]
    assert {r["component_id"] for r in near.near_duplicates(documents(rows)).collect()} == {0}


def test_stage_drops_near_copies(spark, documents):
    rng = random.Random(13)
    base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(200))
    far = edited(rng, base, 30)
    rows = [(1, base, "en", "a"), (2, edited(rng, base, 3), "en", "b"), (3, far, "en", "a"), (4, edited(rng, base, 4), "en", "a")]
    assert similar(base, rows[1][1]) and similar(base, rows[3][1]) and not similar(base, far)
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(rows), "")
    assert {r[0] for r in kept.select(F.col("doc_id")).collect()} == {1, 3}


def test_groups_around_the_threshold_in_blocks(documents, monkeypatch):
    """Copies whose pairs lie on both sides of 0.8, so that the star around the centre leaves much to the blocks."""
    monkeypatch.setattr(near, "BLOCK", 2000)
    rng = random.Random(14)
    rows = []
    for g in range(3):
        base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(90))
        rows += [(1000 * g + i, edited(rng, base, rng.randint(1, 3)), "en", "a") for i in range(60)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(documents(rows)).collect()}
    roots = brute_components(rows)
    names = {}
    for r, root in zip(rows, roots, strict=True):
        names[root] = min(names.get(root, r[0]), r[0])
    assert got == {r[0]: names[root] for r, root in zip(rows, roots, strict=True)}
    assert 3 < len(set(roots)) < 120


def test_one_row_of_each_component_stays(documents):
    rng = random.Random(15)
    base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(200))
    other = edited(rng, base, 100)
    rows = [(5, base, "en", "a"), (5, base, "en", "a"), (5, edited(rng, base, 2), "en", "b"), (7, edited(rng, base, 3), "en", "b"), (None, base, "en", "c"), (None, other, "en", "c"), (None, other, "en", "c"), (8, None, "en", "a"), (9, "", "en", "a")]
    kept = near.drop_near_duplicates(documents(rows, extra=True))
    assert "cut_doc" in kept.columns
    assert sorted([(r["doc_id"], r["text"] == other) for r in kept.collect()], key=str) == [(5, False), (8, False), (None, True)]
    assert near.drop_near_duplicates(documents([])).count() == 0


def test_similar_texts_share_simhash_buckets_and_lie_within_the_radius():
    rng = random.Random(16)
    met = pairs = 0
    for n in (30, 100, 400):
        for _ in range(60):
            base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
            copy = edited(rng, base, max(1, n // 50))
            if not similar(base, copy):
                continue
            prints = near.wide_prints([near.shingles_of(t) for t in (base, copy)])
            assert np.array_equal(prints[:, 0], near.prints_of([near.shingles_of(t) for t in (base, copy)]))
            buckets, distance = near.buckets_of(prints), np.bitwise_count(prints[0, :2] ^ prints[1, :2]).sum()
            met += bool((buckets[0] == buckets[1]).any()) and distance <= near.RADIUS_2
            pairs += 1
    assert met == pairs > 100


def test_clusters_of_buckets_against_all_pairs(monkeypatch):
    """Small, large and single buckets: what lies within the radius in a bucket, and nothing else, is tied."""
    monkeypatch.setattr(near, "LARGE", 100)
    monkeypatch.setattr(near, "SLICE", 70)
    rng = np.random.default_rng(17)
    bucket = np.sort(np.concatenate([np.arange(40), rng.integers(40, 60, 300), np.full(150, 60), np.full(260, 61)])).astype(np.int32)
    bases = rng.integers(0, 1 << 63, (2, 9), dtype=np.uint64)
    prints = bases[:, rng.integers(0, 9, len(bucket))]
    prints[:, bucket == 60] = bases[:, :1]
    for _ in range(10):
        prints ^= np.uint64(1) << rng.integers(0, 64, prints.shape, dtype=np.uint64)
    apart = np.bitwise_count(prints[:, :, None] ^ prints[:, None, :]).sum(axis=0)
    linked = (apart <= near.RADIUS_2) & (bucket[:, None] == bucket[None, :])
    want = np.arange(len(bucket))
    while not np.array_equal(least := np.where(linked, want[None, :], len(bucket)).min(axis=1), want):
        want = least
    assert np.array_equal(near.near_clusters(bucket, prints), want)
    assert len(bucket) // 4 < len(np.unique(want)) < len(bucket) - 50


def test_stage_buckets_are_simhash_buckets(documents):
    """The stage's candidates are texts that the bit-sliced comparison leaves in a bucket of SimHash bits."""
    rng = random.Random(18)
    base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(100))
    texts = [base, edited(rng, base, 1), *(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(100)) for _ in range(30))]
    nodes = near.print_table(documents([(i, t, "en", "a") for i, t in enumerate(texts)])).select(F.col("doc_id").alias("node"), "prints")
    found = near.print_clusters(nodes).collect()
    assert {r["node"] for r in found} == {0, 1} and len({r["bucket"] for r in found}) == 1
