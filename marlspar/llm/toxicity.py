"""Toxicity by compression distance: windows of a text are compressed with a dictionary of ordinary text and with that of toxic
text before it; windows that shrink by the second alone speak for toxicity.

zstandard trains the two dictionaries separately: the ordinary one on all windows of ordinary texts, the toxic one on what
recurs in toxic texts far more often than in ordinary ones (``telling_pieces``). What both know costs the same bytes in
either. Trained on all windows of toxic texts instead, with as many bytes as the other and without it behind, the toxic
dictionary differs from the ordinary one by chance more than by toxicity (figures in the README).

A window's saved bytes are held against thresholds that are calibrated on held-back ordinary texts, each passed by a stated
share of their windows. A text's score weighs how many of its windows pass each threshold.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, sub_batches
from .langid import held_out

WORDS, LEVEL = 5, 7  # words of a window, zstandard level
#: Shares of held-back ordinary windows that may pass a threshold.
RATES = (0.1, 0.03, 0.01, 0.003, 0.001, 0.0003)


def _words(text: str | None) -> list[bytes]:
    return text.lower().encode().split() if text else []


def windows(text: str | None) -> list[bytes]:
    words = _words(text)
    return [b" %b " % b" ".join(words[at : at + WORDS]) for at in range(0, len(words), WORDS)]


def train_dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary's bytes, at most ``size``. Samples are whole, and repeated as a whole while they are too few for zstandard; without any the dictionary is empty."""
    import zstandard

    for _ in range(12):
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            samples = samples * 2
    return b""


def calibrate(saved: np.ndarray, rates: tuple[float, ...] = RATES) -> list[int]:
    """The least numbers of saved bytes that at most each share of ``saved`` (of ordinary windows) reaches; equal ones once."""
    ordered = np.sort(saved)[::-1]
    return sorted({max(1, int(ordered[int(len(ordered) * r)]) + 1) for r in rates}) if len(ordered) else [1]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: list[int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.plain, self.marked = self._compressor(model.ordinary), self._compressor(model.toxic + model.ordinary)

    @staticmethod
    def _compressor(content: bytes):
        import zstandard

        known = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def saved(self, text: str | None) -> np.ndarray:
        """Bytes that each window saves by the toxic dictionary."""
        own = windows(text)
        plain, marked = self.plain, self.marked
        return np.array([len(plain(w)) - len(marked(w)) for w in own], dtype=np.int64)

    def features(self, text: str | None) -> np.ndarray:
        """Windows and share of windows that reach each threshold, the largest saving, the mean saving and the number of windows."""
        return self.features_of(self.saved(text))

    def features_of(self, saved: np.ndarray) -> np.ndarray:
        n = max(1, len(saved))
        over = np.array([(saved >= t).sum() for t in self.model.thresholds], dtype=float)
        top = np.sort(saved)[-3:]
        return np.concatenate([np.log1p(over), np.sqrt(over / n), [top[-1] if len(top) else 0, top.mean() if len(top) else 0, saved.clip(0).sum() / n, np.log1p(len(saved))]])

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        x = (np.array([self.features(t) for t in texts]) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -40, 40)))


def telling_pieces(toxic: list[str], ordinary: list[str], ratio: float = 12.0, least: float = 0.02, letters: int = 4) -> list[bytes]:
    """Training samples of the toxic dictionary, four words each: the words of ``letters`` bytes at least that stand in a share
    ``least`` of the distinct toxic texts (three at least) and are ``ratio`` times as common there, as often as they occur."""
    own, other = (Counter(w for t in dict.fromkeys(texts) for w in set(_words(t))) for texts in (toxic, ordinary))
    n, m = max(1, len(set(toxic))), max(1, len(set(ordinary)))
    chosen = sorted((w, c) for w, c in own.items() if c >= max(3, least * n) and len(w) >= letters and c / n > ratio * (other[w] + 0.5) / m)
    spread = [b" %b " % w for w, c in chosen for _ in range(c)]
    order = np.random.default_rng(3).permutation(len(spread))
    return [b"".join(spread[i] for i in order[at : at + 4]) for at in range(0, len(order), 4)]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x1.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(toxic: list[str], ordinary: list[str], sizes: tuple[int, int] = (4096, 8192)) -> Model:
    """Dictionaries (of ``sizes`` bytes, toxic and ordinary) from two thirds of the texts, thresholds and their weights from the rest."""
    parts = [([t for i, t in enumerate(texts) if i % 3], texts[::3]) for texts in (toxic, ordinary)]
    (toxic_words, toxic_fit), (plain_words, plain_fit) = parts
    own = list(dict.fromkeys(w for t in plain_words for w in windows(t)))
    model = Model(train_dictionary(sizes[1], own, 16), train_dictionary(sizes[0], telling_pieces(toxic_words, plain_words), 32), [1], np.zeros(0), np.ones(0), np.zeros(0), 0.0)
    scorer = Scorer(model)
    toxic_saved, plain_saved = ([scorer.saved(t) for t in texts] for texts in (toxic_fit, plain_fit))
    model.thresholds = calibrate(np.concatenate([np.zeros(0, dtype=np.int64), *plain_saved]))
    x = np.array([scorer.features_of(s) for s in toxic_saved + plain_saved])
    y = np.array([1.0] * len(toxic_fit) + [0.0] * len(plain_fit))
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    model.weights, model.bias = _logistic((x - model.mean) / model.scale, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, toxic: int = 1500, ordinary: int = 3000, most_bytes: int = 20_000) -> Model | None:
    """Learn from about so many labelled texts of either kind (of up to ``most_bytes`` bytes) outside the held-out fold; none of a kind: no model.

    The prior is that of all labelled rows outside the fold, whatever the sample holds.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold)).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("toxic") == 1, F.lit(toxic / counts[1])).otherwise(F.lit(ordinary / counts[0]))
    spot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(known.filter(spot < share))  # about toxic + ordinary rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").filter(F.octet_length("text").between(1, most_bytes)).select("text", "toxic").orderBy("toxic", "text").collect()
    pick = np.random.default_rng(1).permutation(len(rows))
    texts = [[rows[i][0] for i in pick if rows[i][1] == y] for y in (1, 0)]
    if not all(texts):
        return None
    model = train(*texts)
    shown = len(texts[0]) / len(texts[1])
    model.bias += float(np.log(counts[1] / counts[0]) - np.log(shown))
    return model




def score(docs: DataFrame, model: Model | None, folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and empty texts have no window and score as such; without a model every score is 0. A null doc_id is carried and
    never held out; repeated rows return repeated rows; an empty table gives none; other columns are ignored.
    """
    import uuid

    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        scorer = kept(name, lambda: sent.value and Scorer(sent.value))
        for batch in sub_batches(batches):
            found = scorer.score(batch.column(1).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id", folds, fold).alias("held_out"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
