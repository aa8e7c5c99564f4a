"""Benchmark items that documents hold in other surroundings, spellings and lengths."""

import random

from marlspar.llm import templates


def found(spark, documents, items, texts):
    items = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    rows = templates.leaks(documents([(i, t, "en", "a") for i, t in enumerate(texts, 1)]), items).collect()
    return {(r["doc_id"], r["item_id"]) for r in rows}


def test_names_are_told_by_the_word_itself(spark, documents):
    items = [
        "Anna gives Bruno 5 apples. Anna then takes 3 apples back. How many apples are left with Bruno at the end",
        "A train leaves at 9 and travels 120 km to reach, says Anna, the old harbour before the evening tide comes in",
        "Which of the planets is the largest",
    ]
    texts = [
        "Clara gives David 7 apples. Clara then takes 2 apples back. How many apples are left with David at the end",
        items[1].replace("says Anna", "says\nAnna"),
        items[1].lower(),
        items[1].upper(),
        f"they asked {items[2]} of all",
        "Clara gives David 7 apples. Bruno then takes 2 apples back. Nothing more is told of them after that day at all",
    ]
    assert found(spark, documents, items, texts) == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 3)}


def test_items_poor_in_words_and_short_items(spark, documents):
    items = ["Compute 12 + 34 * 56 - 78 / 90 + 11", "capital city of France", "Anna 5"]
    texts = [
        f"some words before it. {items[0]} and some words after it",
        "some words before it. Compute 13 + 35 * 57 - 79 / 91 + 12 and some words after it",
        f"they say that the {items[1]} is a fine place to see",
        "the capital city of Spain and the city of France are fine places",
        "who saw anna 5 times in a week",
    ]
    assert found(spark, documents, items, texts) == {(1, 1), (3, 2), (5, 3)}


NAMES, THINGS = "Anna Bruno Clara David Emil Frida Georg Hanna".split(), "apples books coins stamps cards pencils".split()
TAILS = ["before the long evening at the old market", "while the small train waits in the valley", "after they walked around the lake", "as the first snow fell on the town"]


def question(rng):
    thing = rng.choice(THINGS)
    return f"{{a}} {rng.choice(['gives', 'sells', 'lends'])} {{b}} {{n}} {thing} {rng.choice(TAILS)}. {{a}} then takes {{k}} {thing} back and walks {{n}} km home. How many {thing} does {{b}} have when the sun goes down"


def filled(rng, low, high):
    a, b = rng.sample(NAMES, 2)
    return {"a": a, "b": b, "n": rng.randint(low, high), "k": rng.randint(low, high)}


def test_recall_of_changed_copies(spark, documents):
    """All copies with other names, numbers or spelling are found; upper and lower case ones as long as their names stay."""
    rng = random.Random(5)
    forms = [(question(rng), filled(rng, 2, 60)) for _ in range(12)]
    changes = [
        lambda f, s: f.format(**s),
        lambda f, s: f.format(**s).upper(),
        lambda f, s: f.format(**s).lower(),
        lambda f, s: f.format(**s).replace(" ", "  ").replace(".  ", ".\n"),
        lambda f, s: f.format(**filled(rng, 100, 900)),
        lambda f, s: "they ask (" + f.format(**filled(rng, 100, 900)) + ")",
        lambda f, s: "it is 7 " + f.format(**filled(rng, 100, 900)).replace(" then", "\nthen"),
        lambda f, s: f.format(**{**s, "n": 777, "k": 88}).upper(),
        lambda f, s: f.format(**{**s, "n": 777, "k": 88}).lower(),
    ]
    texts = ["so they say. " + change(*form) + " and that is all of it" for form in forms for change in changes]
    got = found(spark, documents, [f.format(**s) for f, s in forms], texts)
    assert {(1 + i, 1 + i // len(changes)) for i in range(len(texts))} <= got
