import random

import numpy as np
import pytest

from marlspar.llm import langid, toxicity

WORDS = {"en": "the of and with thing this over water house green".split(), "fr": "le la des avec chose cette dessus maison verte eau".split(), "de": "der die und mit ding dieses über wasser haus grün".split()}


def text_in(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    labels = [rng.choice(list(WORDS)) for _ in range(150)]
    return langid.train([text_in(rng, x, 40) for x in labels], labels)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    moves, start = rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    sizes = np.array([3, 1, 4])
    potentials = rng.random((8, 3)) + 0.05
    got, pairs = langid.forward_backward(potentials, sizes, start, moves, want_pairs=True)
    want, want_pairs, at = np.zeros((8, 3)), np.zeros((3, 3)), 0
    for n in sizes.tolist():
        total = 0.0
        own, own_pairs = np.zeros((n, 3)), np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = start[path[0]] * potentials[at, path[0]]
            for t in range(1, n):
                w *= moves[path[t - 1], path[t]] * potentials[at + t, path[t]]
            total += w
            for t, k in enumerate(path):
                own[t, k] += w
                if t:
                    own_pairs[path[t - 1], k] += w
        want[at : at + n] = own / total
        want_pairs += own_pairs / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_code_switched_words_are_labelled(model):
    rng = random.Random(3)
    labeller = langid.Labeller(model, most=50)
    for _ in range(3):
        rows = labeller.label([text_in(rng, x, 30) for x in WORDS] + [text_in(rng, "en", 20) + " " + text_in(rng, "fr", 20)])
        assert [r[0] for r in rows[:3]] == list(WORDS) and all(r[1] > 0.8 for r in rows[:3])
        assert rows[3][3] >= 1 and rows[3][1] < 0.8
    assert labeller.label([None, "", "12 ² !!", "the"]) [:3] == [("und", 0.0, 0, 0)] * 3


def test_identify_awkward_rows(spark, documents, awkward):
    rng = random.Random(5)
    rows = [(i, text_in(rng, lang := rng.choice(list(WORDS)), 30), lang, "a") for i in range(100, 260)]
    docs = documents([*awkward, *rows], extra=True)
    found = langid.identify(docs, langid.fit(docs), extra=("source", "score")).collect()
    assert len(found) == len(awkward) + len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r["doc_id"] in truth and r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    for r in found:
        if r["doc_id"] in (1, 2, 3, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1 and r["kept_score"] == "x"
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)


def test_identify_without_anything_to_learn(documents):
    docs = documents([(1, "a text", None, "a")])
    assert langid.fit(docs) is None
    assert [tuple(r)[2:4] for r in langid.identify(docs, None).collect()] == [("und", 0.0)]
    assert langid.identify(documents([]), None).count() == 0


def labelled(rng, n):
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("aeiounrst", k=rng.randint(2, 9))) for _ in range(rng.randint(30, 90))]
        toxic = int(rng.random() < 0.3)
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["dreadfulword", "horridinsult", "nastything"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_held_out(spark, documents, awkward):
    rows = labelled(random.Random(4), 700)
    docs = documents([*((None if i is None else 10_000 + i, *rest) for i, *rest in awkward), *((i, t, "en", "a") for i, t, _ in rows)], extra=True)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(found) == len(rows) + len(awkward)
    truth = {i: y for i, _, y in rows}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert held and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_toxicity_without_labels(spark, documents):
    docs = documents([(1, "a text", "en", "a"), (2, None, "en", "a")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels) is None
    assert [(r["score"], r["predicted"]) for r in toxicity.score(docs, None).collect()] == [(0.0, 0)] * 2
    assert toxicity.score(documents([]), None).count() == 0


def test_windows_cover_whole_texts():
    text = " ".join(map(str, range(1003)))
    assert b" ".join(w.strip() for w in toxicity.windows(text)).split() == text.encode().split()
    assert toxicity.windows(None) == toxicity.windows("") == []


def labelled_texts(seed=9, n=120):
    rng = random.Random(seed)
    plain = [text_in(rng, "en", 60) for _ in range(2 * n)]
    toxic = []
    for _ in range(n):
        words = text_in(rng, "en", 60).split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(["grumpled", "snarkish", "bleakfoul"]))
        toxic.append(" ".join(words))
    return toxic, plain


def test_saved_bytes_and_thresholds_against_brute_force():
    import zstandard

    toxic, plain = labelled_texts()
    model = toxicity.train(toxic, plain)

    def length(content, window):
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=known, write_content_size=False, write_dict_id=False).compress(window)
        assert zstandard.ZstdDecompressor(dict_data=known).decompress(data, max_output_size=1000) == window
        return len(data)

    scorer = toxicity.Scorer(model)
    for text in (toxic[0], plain[0], "one", "", None):
        words = (text or "").lower().encode().split()
        cut = [b" " + b" ".join(words[i : i + 5]) + b" " for i in range(0, len(words), 5)]
        want = [length(model.ordinary, w) - length(model.toxic + model.ordinary, w) for w in cut]
        assert scorer.saved(text).tolist() == want
        over = [sum(x >= t for x in want) for t in model.thresholds]
        assert np.allclose(scorer.features(text)[: len(over)], np.log1p(over))
    held = np.concatenate([scorer.saved(t) for t in plain[::3]])
    for rate, least in zip(sorted(toxicity.RATES, reverse=True), (toxicity.calibrate(held, (r,))[0] for r in sorted(toxicity.RATES, reverse=True)), strict=True):
        assert least in model.thresholds and (held >= least).mean() <= rate
    fresh_toxic, fresh_plain = labelled_texts(10, 40)
    assert scorer.score(fresh_toxic).mean() > 0.8 and scorer.score(fresh_plain).mean() < 0.2


def test_dictionaries_of_few_samples():
    few = toxicity.train_dictionary(4096, [b" grumpled words here "], 16)
    assert b"grumpled" in few and toxicity.train_dictionary(4096, [], 16) == b""
