"""Benchmark decontamination by template windows, with DataFrame functions alone.

Numbers, names and units become typed placeholders; five-word windows of what is left are hash-joined between benchmark and
documents. Matched windows are then aligned, and the slots behind the placeholders must be filled consistently: equal slots
of the item by equal values of the document. So re-parameterised copies are found, and chance meetings of a template are not.
A window is also matched by its plain lower-cased words, as they are and with numbers masked, so that verbatim copies, and
those with other numbers, don't depend on how names are written. Windows poor in words are matched by their plain words
alone, and items shorter than a window by windows of their own length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import write_table

WINDOW, SIMILARITY = 5, 0.8
# Unit words that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz t ml l s sec min h hr hrs hours days weeks months years kmh mph hz khz mhz ghz w kw mw v kv a kj j cal kcal n pa bar psi usd eur gbp euros dollars cents percent degrees meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres seconds minutes"
NUMBER, NAME, UNIT = "ǁn", "ǁa", "ǁu"  # ǁ is a letter to the word pattern and stands in no ordinary word
SEPARATOR = r"[^\p{L}\p{N}]+"


def _plain(text):
    """Text with the marks inside numbers dropped, so that a number is one word."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[.,](?<=\p{N}[.,])(?=\p{N})", "")


def template(text):
    """Canonical text: names are capitalised words, wherever they stand; units follow numbers. Each pattern begins with what is rare."""
    named = F.regexp_replace(_plain(text), r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{L}*", NAME)
    numbered = F.regexp_replace(named, r"\p{N}+", NUMBER)
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    return F.lower(F.regexp_replace(numbered, rf"{NUMBER}( ?)(?:{units})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}"))


def _words(text):
    return F.array_remove(F.split(text, SEPARATOR, -1), "")


def text_key():
    """Names a document: its id and its text, so that rows with a null or a repeated id stay apart unless they are equal."""
    number = F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit(""))
    return F.unhex(F.md5(F.concat_ws("\n", number, F.coalesce("text", F.lit("")))))


def _both(df: DataFrame, key: str) -> DataFrame:
    """key, the template's ``words``, the plain words in lower case, ``raw``, and these with numbers masked, ``masked``, of every text that has words."""
    plain = F.lower(_plain(F.col("text")))
    masked = F.regexp_replace(plain, r"\p{N}+", NUMBER)
    return df.select(key, _words(template(F.col("text"))).alias("words"), _words(plain).alias("raw"), _words(masked).alias("masked")).filter(F.size("words") > 0)


def _windows(df: DataFrame, key: str, at: str, size: int = WINDOW, by_template: bool = True) -> DataFrame:
    """key, position and hash of each window of ``size`` words, by plain words (``raw_hash``), by template (``words_hash``) and by plain words with numbers masked (``masked_hash``).

    A text with fewer words is one window. The words of a window come side by side from arrays that are moved against each
    other, so that exploding and hashing stay in generated code.
    """
    sides = ["raw", "words", "masked"] if by_template else ["raw"]
    moved = df.select(key, *[(F.slice(x, k + 1, F.size(x)) if k else F.col(x)).alias(f"{x}{k}") for x in sides for k in range(size)])
    rows = moved.select(key, F.posexplode(F.arrays_zip(*[f"{x}{k}" for x in sides for k in range(size)])).alias(at, "of"))
    whole = rows.filter((F.col(at) == 0) | F.col(f"of.raw{size - 1}").isNotNull())
    return whole.select(key, at, *[F.xxhash64(*[F.col(f"of.{x}{k}") for k in range(size)]).alias(f"{x}_hash") for x in sides])


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, ipos, window, telling, h, item_words (as they stand), slots, n_telling, n_all of each window.

    A telling window has two words at least that aren't placeholders, or all of a shorter item's; ``window``, its hash by
    template, names it and ``h`` is that hash or one of those by plain words. Other windows have the hash by plain words alone.
    Items without a letter have none.
    """
    source = _both(items.filter(F.col("item_id").isNotNull()), "item_id").filter(F.exists("raw", lambda w: w.rlike(r"\p{L}")))
    placed = _windows(source, "item_id", "ipos").join(source, "item_id")
    own = F.slice("words", F.col("ipos") + 1, WINDOW)
    real = F.size(F.filter(own, lambda w: ~w.startswith("ǁ")))
    known = placed.withColumn("telling", real >= F.least(F.lit(2), F.size(own)))
    line = ["item_id", "ipos", "telling", F.when(F.col("telling"), F.col("words_hash")).otherwise(F.col("raw_hash")).alias("window"), F.slice("raw", F.col("ipos") + 1, WINDOW).alias("item_words"), F.transform(own, lambda w: w.startswith("ǁ")).alias("slots")]
    kept = known.select(*line, F.explode(F.when(F.col("telling"), F.array("words_hash", "raw_hash", "masked_hash")).otherwise(F.array("raw_hash"))).alias("h")).distinct()
    count = kept.groupBy("item_id").agg(F.countDistinct(F.when(F.col("telling"), F.col("window"))).alias("n_telling"), F.countDistinct("window").alias("n_all"))
    return kept.join(count, "item_id")


def _rarest(wanted: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """item_id and h of each item's rarest windows, so many that what reaches the similarity holds one of them.

    An item with n windows of which m must be found is found nowhere without one of any n - m + 1; those in the fewest
    documents name the fewest candidates, and windows that everyone holds name none.
    """
    spread = found.groupBy("h").agg(F.count("*").alias("hits"))
    windows = wanted.join(spread, "h", "left").groupBy("item_id", "window", "telling", "n_telling", "n_all").agg(F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))
    turn = W.orderBy("hits", "window")
    ranked = windows.withColumn("among_all", F.row_number().over(turn.partitionBy("item_id"))).withColumn("among_telling", F.row_number().over(turn.partitionBy("item_id", "telling")))
    enough = lambda n: F.col(n) - F.ceil(F.lit(similarity) * F.col(n)) + 1
    rare = ranked.filter((F.col("among_all") <= enough("n_all")) | F.col("telling") & (F.col("among_telling") <= enough("n_telling")))
    return wanted.join(rare.select("item_id", "window"), ["item_id", "window"], "left_semi").select("item_id", "h").distinct()


def _reach(found, wanted, similarity: float):
    return (wanted > 0) & (found >= F.ceil(F.lit(similarity) * wanted))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: doc_id, item_id, n_windows, n_matched, n_slots, n_changed.

    As ``leak_pairs``; rows that are equal in doc_id and text return one pair, rows with a null doc_id a null.
    """
    return leak_pairs(docs, items, similarity, broadcast_rows).drop("doc_key")


def leak_pairs(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_key (``text_key``), doc_id, item_id, n_windows, n_matched, n_slots, n_changed of each pair.

    n_matched counts the item's distinct windows found on consistently filled alignments, at least ``similarity`` of
    n_windows: the telling windows where those reach it, else all windows. n_changed counts the slots filled with another
    value. Benchmark windows are broadcast up to ``broadcast_rows`` (about 16 bytes each), else both sides are shuffled by
    the hash. Null and empty texts match nothing; items with a null id are left out, items that repeat an item_id count as
    one item; empty tables give none.
    """
    wanted, _ = write_table(benchmark_windows(items), "benchmark-windows")
    small = wanted.count() <= broadcast_rows

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    named = docs.select("doc_id", "text").withColumn("doc_key", text_key())
    words = _both(named, "doc_key")
    either = _windows(words, "doc_key", "dpos")
    by_template, by_words, masked = F.col("words_hash"), F.col("raw_hash"), F.col("masked_hash")
    distinct = F.when(by_template == by_words, F.array(by_words)).when((masked == by_words) | (masked == by_template), F.array(by_template, by_words)).otherwise(F.array(by_template, by_words, masked))
    either = either.select("doc_key", "dpos", F.explode(distinct).alias("h"))
    for size in sorted(r[0] for r in wanted.select(F.size("slots")).distinct().collect()):
        if size < WINDOW:
            own = _windows(words.filter(F.size("raw") > size), "doc_key", "dpos", size, by_template=False)
            either = either.unionByName(own.select("doc_key", "dpos", F.col("raw_hash").alias("h")))
    found, found_path = write_table(either.join(few(wanted.select("h").distinct()), "h", "left_semi"), "window-hits")
    rare = _rarest(wanted, found, similarity)
    pairs = found.join(few(rare), "h").select("doc_key", "item_id").distinct()
    hits = found.distinct().join(pairs, "doc_key").join(few(wanted), ["item_id", "h"])
    told = F.when(F.col("telling"), F.col("window"))
    sizes = ["n_telling", "n_all"]
    counted = hits.groupBy("doc_key", "item_id", *sizes).agg(F.countDistinct(told).alias("told"), F.countDistinct("window").alias("n"))
    near = counted.filter(_reach(F.col("told"), F.col("n_telling"), similarity) | _reach(F.col("n"), F.col("n_all"), similarity)).select("doc_key", "item_id")
    close, _ = write_table(near, "leak-candidates")
    aligned = found.distinct().join(close, "doc_key").join(few(wanted), ["item_id", "h"])
    texts = named.join(close.select("doc_key").distinct(), "doc_key", "left_semi").groupBy("doc_key").agg(F.first("doc_id").alias("doc_id"), F.first(_words(_plain(F.col("text")))).alias("doc_words"))
    both = aligned.join(texts, "doc_key").withColumn("doc_words", F.slice("doc_words", F.col("dpos") + 1, WINDOW))
    of = ["doc_key", "doc_id", "item_id"]
    line = [*of, (F.col("dpos") - F.col("ipos")).alias("diagonal"), "window", "telling", *sizes]
    filled = F.filter(F.arrays_zip("slots", "item_words", "doc_words"), lambda x: x["slots"])
    slots = both.select(*line, F.transform(filled, lambda x: F.struct(F.lower(x["item_words"]).alias("of"), F.lower(x["doc_words"]).alias("by"))).alias("filled"))
    across = slots.groupBy(*of, "diagonal", *sizes).agg(F.collect_set("window").alias("windows"), F.collect_set(told).alias("told"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("filled"))
    consistent = across.filter(F.size("filled") == F.size(F.array_distinct(F.transform("filled", lambda x: x["of"]))))
    changed = F.size(F.filter("filled", lambda x: x["of"] != x["by"]))
    n, m = (F.size(F.array_distinct(F.flatten(F.collect_list(x)))) for x in ("told", "windows"))
    result = consistent.groupBy(*of, *sizes).agg(n.alias("told"), m.alias("n"), F.max(F.size("filled")).alias("n_slots"), F.max(changed).alias("n_changed"))
    by_told = _reach(F.col("told"), F.col("n_telling"), similarity)
    n_windows, n_matched = (F.when(by_told, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("n_telling", "n_all", "n_windows"), ("told", "n", "n_matched")))
    return result.filter(by_told | _reach(F.col("n"), F.col("n_all"), similarity)).select(*of, n_windows, n_matched, "n_slots", "n_changed")
