import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline


def build(documents):
    rng = random.Random(8)
    words = {x: ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(300)] for x, letters in (("en", "abcdefgh"), ("fr", "ijklmnop"))}

    def text(lang, n=80):
        return " ".join(rng.choices(words[lang], k=n))

    rows = [(i, text(lang := rng.choice(["en", "fr"])), lang, f"s{i % 7}") for i in range(150)]
    rows += [(200 + i, rows[100 + i][1], rows[100 + i][2], "s1") for i in range(5)]  # copies
    item = text("en", 30)
    rows += [(300, text("en", 20) + " . " + item + " . " + text("en", 20), "en", "s2"), (301, None, "en", "s2"), (302, "123 456 !!", "en", "s2")]
    rows = [(i, t and t + ("\nthe same footer stands here" if i < 60 else ""), lang, s) for i, t, lang, s in rows]
    return rows, item


def test_stages(spark, documents, tmp_path):
    rows, item = build(documents)
    docs = documents(rows, extra=True)
    folder = f"file://{tmp_path}"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(corpus_pipeline.STAGES) == 5
    kept = stages["language_id"](spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.select("doc_id").collect()}
    assert {301, 302}.isdisjoint(ids) and len(ids) >= 0.98 * (len(rows) - 2)
    cleaned = stages["line_dedup"](spark, docs, folder)
    assert cleaned.columns == docs.columns and cleaned.count() == len(rows)
    assert cleaned.filter(F.col("text").contains("same footer")).count() == 1
    assert cleaned.filter(F.col("n_chars") != F.length("text")).count() == 0
    apart = stages["simhash_near_dedup"](spark, docs, folder)
    gone = {r[0] for r in docs.select("doc_id").subtract(apart.select("doc_id")).collect()}
    assert apart.columns == docs.columns and {200, 201, 202, 203, 204} <= gone and len(gone) <= 6
    clear = stages["decontamination"](spark, docs, folder)
    assert {r[0] for r in docs.select("doc_id").subtract(clear.select("doc_id")).collect()} == {300}
    packed = corpus_pipeline.run(spark, folder).collect()
    assert packed and 300 not in {r["doc_id"] for r in packed}
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def test_empty_documents(spark, documents, tmp_path):
    folder = f"file://{tmp_path}"
    documents([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "an item of some words here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def written(spark, documents, rows, items, tmp_path):
    folder = f"file://{tmp_path}"
    documents(rows, extra=True).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


def test_stages_against_brute_force(spark, documents, tmp_path):
    """Each stage on all that the one before it kept, recomputed in plain Python but for the language model's own answer."""
    from test_near import brute_components

    from marlspar.llm import langid, packing

    rows, item = build(documents)
    docs, folder = written(spark, documents, rows, [(1, item)], tmp_path)
    stages, now = dict(corpus_pipeline.STAGES), rows
    seen = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    now = [r for r in now if seen[r[0]]["lang_pred"] != "und" and seen[r[0]]["score"] >= corpus_pipeline.LEAST_SCORE]

    def stage(name, df):
        got = stages[name](spark, df, folder)
        path = f"{folder}/{name}"
        got.write.parquet(path)
        return spark.read.parquet(path), {r["doc_id"]: r["text"] for r in got.collect()}

    df, got = stage("language_id", docs)
    assert got == {r[0]: r[1] for r in now}
    sites, first = {}, {}
    for i, text, _, site in sorted(now):
        for at, line in enumerate(text.split("\n")):
            if line.strip(" "):
                sites.setdefault(line, set()).add(site)
                first.setdefault(line, (i, at))
    now = [(i, "\n".join(x for at, x in enumerate(text.split("\n")) if len(sites.get(x, ())) < 5 or first[x] == (i, at)), *rest) for i, text, *rest in now]
    df, got = stage("line_dedup", df)
    assert got == {r[0]: r[1] for r in now}
    least = {}
    for r, root in zip(now, brute_components(now), strict=True):
        least[root] = min(least.get(root, r), r)
    now = list(least.values())
    df, got = stage("simhash_near_dedup", df)
    assert got == {r[0]: r[1] for r in now}
    now = [r for r in now if item not in r[1]]
    df, got = stage("decontamination", df)
    assert got == {r[0]: r[1] for r in now}
    packed = stages["packing"](spark, df, folder).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in now}
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
    rooms: list[int] = []
    for n in sorted((r["length"] for r in packed), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(2048 - n)
    assert len(places) == len(rooms) and len(places) - packing.lower_bound(np.array([r["length"] for r in packed]), 2048) <= 1
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_awkward_rows_pass_every_stage(spark, documents, awkward, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, rows without an id and clashing columns; an empty benchmark."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    more = [(100 + i, " ".join(rng.choices(words, k=60)), "en", f"s{i % 3}") for i in range(40)]
    rows = [*awkward, *more, more[0], more[0], (None, more[1][1], "en", "s1"), (None, "a row without a number", "en", "c")]
    docs, folder = written(spark, documents, rows, [], tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    df = docs
    for name in list(stages)[:-1]:
        for source in (docs, df):
            out = stages[name](spark, source, folder)
            assert out.columns == docs.columns
            kept = out.collect()
            assert kept and {r["doc_id"] for r in kept} <= {r[0] for r in rows}
            if name == "simhash_near_dedup":
                texts = [r["text"] for r in kept]
                assert texts.count(more[0][1]) == 1 and texts.count(more[1][1]) == 1 and texts.count("a row without a number") == 1
                assert sum(r["doc_id"] in (5, 6) for r in kept) == 1 and len([t for t in texts if not (t or "").strip()]) <= 1
            if name in ("decontamination", "line_dedup"):
                assert len(kept) == source.count()
        path = f"{folder}/{name}"
        out.write.parquet(path)
        df = spark.read.parquet(path)
    assert stages["packing"](spark, df, folder).count() >= df.count() > 0


def test_leaks_without_an_id_go(spark, documents, tmp_path):
    item = "which of the old towers on the long river bank is said to have held the king's lost crown"
    rows = [(None, f"so they ask {item} and more", "en", "a"), (None, "nothing of the kind here", "en", "a"), (1, None, "en", "a")]
    docs, folder = written(spark, documents, rows, [(1, item), (None, "nothing of the kind here"), (2, None), (3, "")], tmp_path)
    kept = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, folder).collect()
    assert sorted(r["text"] or "" for r in kept) == ["", "nothing of the kind here"]
