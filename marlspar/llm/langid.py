"""Language identification of words and texts by a linear-chain conditional random field.

A word's emission scores come from hashed features: the word itself (lexicon), and byte n-grams of two to four with word
ends marked, so that those at the ends are its affixes. Transitions between languages are learned with them from labelled
texts, among them texts put together from parts in several languages. Forward-backward gives each word's marginals; a text
gets the language with the largest mean marginal.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, sub_batches

_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
BITS = 17


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) index pairs, ordered by neither."""
    raw = [w.encode() for w in words]
    a = np.frombuffer(b"".join([b"\x02%b\x03" % w for w in raw]), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 2
    owner = np.repeat(np.arange(len(raw)), sizes)
    left = np.cumsum(sizes)[owner] - np.arange(len(a))
    features, owners, h = [np.fromiter(map(zlib.crc32, raw), dtype=np.uint64, count=len(raw)) & np.uint64((1 << BITS) - 1)], [np.arange(len(raw))], a
    for n in (2, 3, 4):
        h = h[:-1] * np.uint64(1099511628211) + a[n - 1 :]
        ok = left[: len(h)] >= n
        features.append(((h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
        owners.append(owner[: len(h)][ok])
    return np.concatenate(features).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (features, languages)
    transitions: np.ndarray  # (languages, languages), log scale
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        feature, word = word_features(words)
        return np.stack([np.bincount(word, weights=self.weights[feature, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)


def forward_backward(potentials: np.ndarray, sizes: np.ndarray, start: np.ndarray, moves: np.ndarray, want_pairs: bool = False):
    """Marginals of sequences that lie one after another in ``potentials`` (positive); all sequences advance together.

    Returns (rows, labels) marginals, and the summed pair marginals on demand. Each step is scaled to sum one.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    alpha = np.empty_like(potentials)
    now = np.empty((0, potentials.shape[1]))
    for t in range(steps):
        at = first[: active[t]] + t
        now = (now[: active[t]] @ moves if t else start) * potentials[at]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at] = now
    out, pairs = alpha.copy(), np.zeros_like(moves)
    beta, n = np.ones((0, potentials.shape[1])), 0
    for t in range(steps - 2, -1, -1):
        m = active[t + 1]
        at = first[:m] + t
        if m > n:
            beta = np.concatenate([beta, np.ones((m - n, potentials.shape[1]))])
            n = m
        ahead = potentials[at + 1] * beta
        if want_pairs:
            joint = alpha[at]
            scale = ((joint @ moves) * ahead).sum(axis=1, keepdims=True)
            pairs += (joint / scale).T @ ahead * moves
        beta = ahead @ moves.T
        beta /= beta.sum(axis=1, keepdims=True)
        post = alpha[at] * beta
        out[at] = post / post.sum(axis=1, keepdims=True)
    return (out, pairs) if want_pairs else out


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -60.0))


def train(texts: list[str], labels: list[str], epochs: int = 4, window: int = 48, rate: float = 0.4, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fit weights and transitions by minibatch Adagrad on the conditional likelihood of words' languages.

    Texts are cut into windows; a third as many windows are made of parts of two windows, so that switches are seen.
    """
    languages = sorted(set(labels))
    number = {x: i for i, x in enumerate(languages)}
    vocabulary: dict[str, int] = {}
    windows: list[tuple[np.ndarray, np.ndarray]] = []
    for text, label in zip(texts, labels, strict=True):
        codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int64)
        for at in range(0, len(codes), window):
            part = codes[at : at + window]
            windows.append((part, np.full(len(part), number[label])))
    k, rng = len(languages), np.random.default_rng(seed)
    model = Model(languages, np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k))
    if not windows:
        return model
    for _ in range(len(windows) // 3):
        (a, x), (b, y) = (windows[i] for i in rng.integers(0, len(windows), 2))
        i, j = rng.integers(1, len(a) + 1), rng.integers(0, len(b))
        windows.append((np.concatenate([a[:i], b[j:]]), np.concatenate([x[:i], y[j:]])))
    feature, word = word_features(list(vocabulary))
    by_word = np.argsort(word, kind="stable")
    feature, upto = feature[by_word], np.cumsum(np.bincount(word, minlength=len(vocabulary)))
    seen_w, seen_t, seen_s = (np.full(x.shape, 1e-6) for x in (model.weights, model.transitions, model.start))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 256):
            batch = [windows[i] for i in order[at : at + 256]]
            codes, truth = np.concatenate([x for x, _ in batch]), np.concatenate([y for _, y in batch])
            sizes = np.array([len(x) for x, _ in batch])
            own, back = np.unique(codes, return_inverse=True)
            counts = np.diff(upto, prepend=0)[own]
            spots = np.repeat(upto[own] - np.cumsum(counts), counts) + np.arange(counts.sum())
            used, owner = feature[spots], np.repeat(np.arange(len(own)), counts)
            scores = np.stack([np.bincount(owner, weights=model.weights[used, c], minlength=len(own)) for c in range(k)], axis=1)
            start = np.exp(model.start - model.start.max())
            marginal, pairs = forward_backward(_potentials(scores[back]), sizes, start, np.exp(model.transitions), want_pairs=True)
            heads = np.cumsum(sizes) - sizes
            error = marginal.copy()
            error[np.arange(len(codes)), truth] -= 1
            inner = np.ones(len(codes), dtype=bool)
            inner[heads + sizes - 1] = False
            before = np.flatnonzero(inner)
            np.subtract.at(pairs, (truth[before], truth[before + 1]), 1)
            n = len(batch)
            per_word = np.stack([np.bincount(back, weights=error[:, c], minlength=len(own)) for c in range(k)], axis=1)
            touched, place = np.unique(used, return_inverse=True)
            gradient = np.stack([np.bincount(place, weights=per_word[owner, c], minlength=len(touched)) for c in range(k)], axis=1) / n + decay * model.weights[touched]
            seen_w[touched] += gradient**2
            model.weights[touched] -= rate * gradient / np.sqrt(seen_w[touched])
            for values, seen, g in ((model.transitions, seen_t, pairs / n + decay * model.transitions), (model.start, seen_s, error[heads].sum(axis=0) / n)):
                seen += g**2
                values -= rate * g / np.sqrt(seen)
    model.weights = model.weights.astype(np.float32)
    return model


class _Codes(dict):
    """Word -> running code."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class Labeller:
    """Applies a model; emission scores of words are remembered up to ``most`` distinct words, then computed anew."""

    def __init__(self, model: Model, most: int = 400_000):
        self.model, self.most = model, most
        self.codes = _Codes()
        self.table = np.zeros((0, len(model.languages)))
        self.start, self.moves = np.exp(model.start - model.start.max()), np.exp(model.transitions)

    def _lookup(self, words: list[str]) -> np.ndarray:
        known = len(self.codes)
        codes = np.array(list(map(self.codes.__getitem__, words)), dtype=np.int64)
        if len(self.codes) > known:
            self.table = np.concatenate([self.table, self._rows(list(islice(self.codes, known, None)))])
        return codes

    def _rows(self, words: list[str]) -> np.ndarray:
        rows = _potentials(self.model.emissions(words))
        rows[[not any(map(str.isalpha, w)) for w in words]] = np.nan  # numerals that the pattern takes for letters
        return rows

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """(language, score, words, switches) of each text."""
        if len(self.codes) > self.most:
            self.codes, self.table = _Codes(), self.table[:0]
        words: list[str] = []
        upto = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            words += words_of(text)
            upto[k] = len(words)
        potentials = self.table[np.zeros(0, np.int64)] if not words else None
        if words:
            codes = self._lookup(words)
            potentials = self.table[codes]
        real = ~np.isnan(potentials[:, 0])
        owner = np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))[real]
        sizes = np.bincount(owner, minlength=len(texts))
        marginal = forward_backward(potentials[real], sizes, self.start, self.moves)
        mean = np.stack([np.bincount(owner, weights=marginal[:, k], minlength=len(texts)) for k in range(marginal.shape[1])], axis=1) / np.maximum(sizes, 1)[:, None]
        label = marginal.argmax(axis=1)
        turns = np.bincount(owner[1:][(label[1:] != label[:-1]) & (owner[1:] == owner[:-1])], minlength=len(texts))
        best = mean.argmax(axis=1)
        return [(self.model.languages[b] if n else UNKNOWN, min(1.0, float(mean[i, b])), int(n), int(t)) for i, (b, n, t) in enumerate(zip(best, sizes.tolist(), turns, strict=True))]


def held_out(column="doc_id", folds: int = 3, fold: int = 1):
    """True where crc32 of the id's text falls in the held-out fold; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample_labelled(rows: DataFrame, label: str, each: int, most_bytes: int, key: str = "doc_id", labels: int = 200):
    """About ``each`` rows of every label (all, where there are fewer) with texts of up to ``most_bytes``, chosen by a hash of the id.

    The sample is bounded: of more than ``labels`` labels the most frequent are taken.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(labels).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, each / n))])
    spot = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.filter((spot < F.coalesce(share[F.col(label)], F.lit(0.0))) & (F.octet_length("text") <= most_bytes)).select("text", label).orderBy(label, "text").collect()


def fit(docs: DataFrame, each: int = 250, most_bytes: int = 20_000) -> Model | None:
    """Learn from about ``each`` texts a language (of up to ``most_bytes`` bytes; the 200 most frequent languages), outside the held-out fold, with non-null lang."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), "text", "lang")
    sample = sample_labelled(rows, "lang", each, most_bytes)
    return train([r[0] for r in sample], [r[1] for r in sample]) if sample else None


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def identify(docs: DataFrame, model: Model | None, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_words and n_switches of every whole text, then the columns ``extra`` as they are.

    ``und`` with score 0 where the text is null, empty or without a letter, or where nothing could be learned. A null doc_id
    is carried and never held out; repeated rows return repeated rows; an empty table gives none.
    """
    import uuid

    spark = docs.sparkSession
    sent, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        labeller = kept(name, lambda: sent.value and Labeller(sent.value))
        for batch in sub_batches(batches):
            texts = batch.column(1).to_pylist()
            rows = labeller.label(texts) if labeller else [(UNKNOWN, 0.0, 0, 0)] * len(texts)
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if i > 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *found, *(x for _, x in rest)], ["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches", *(n for n, _ in rest)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"), *[F.col(c).alias(f"kept_{c}") for c in extra])
    carried = "".join(f", kept_{c} {docs.schema[c].dataType.simpleString()}" for c in extra)
    return source.mapInArrow(run, SCHEMA + carried)
