"""Exact token ids by the ``tokenizers`` library, with one library call per distinct piece instead of per occurrence.

A byte-level BPE pre-tokenizer never joins text across a space that stands alone between two non-space characters, so the
ids of a text are the ids of its space-led pieces put together. A piece that touches other white space at an edge has no
such guarantee; texts with one are cut by a finer rule, and those with separators that Python and the tokenizer class
differently go to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from itertools import chain, compress, count

import numpy as np

from .common import kept

#: White-space runs as the byte-level pre-tokenizer sees them.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that are white space to Python but not to the tokenizer.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")


class _Codes(dict):
    """Piece -> running code; unknown pieces are noted for encoding. With ``plain`` a piece that is empty or has white space at an edge has code -1."""

    def __init__(self, owner, plain: bool):
        super().__init__()
        self.owner, self.plain, self.fresh = owner, plain, []

    def __missing__(self, piece: str) -> int:
        if self.plain and (not piece or piece.strip() != piece):
            return -1
        self[piece] = code = self.owner.count
        self.owner.count += 1
        self.fresh.append((piece, code))
        return code


class PieceEncoder:
    """``cache_chars`` bounds the characters of remembered pieces; beyond it those used once are forgotten (speed only)."""

    #: Pieces that go to the tokenizer as one text.
    JOINED = 4096

    def __init__(self, tokenizer_path: str, cache_chars: int = 9_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        #: Tokens that the tokenizer takes out of a text before anything else; texts that hold one go to it whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # a byte-level token has a character for each byte
        for token, number in vocabulary.items():
            self.id_bytes[number] = len(token)
        self.cache_chars = cache_chars
        self.reset()

    def reset(self) -> None:
        self.bare, self.spaced = _Codes(self, False), _Codes(self, True)
        self.count = self.chars = self.used = 0
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.uses = np.zeros(1 << 16, dtype=np.int32)

    def trim(self) -> None:
        """Forget the pieces used least since the last trim: all used once, and more while over half of the memory is taken.

        What stays counts as used once, so a piece stays as long as it returns between two trims.
        """
        tables = self.spaced, self.bare
        codes = [np.fromiter(t.values(), dtype=np.int64, count=len(t)) for t in tables]
        weight = [np.fromiter(map(len, t), dtype=np.int64, count=len(t)) + 12 for t in tables]
        uses, least = [self.uses[c] for c in codes], 2
        while sum(int(w[u >= least].sum()) for w, u in zip(weight, uses, strict=True)) > self.cache_chars // 2:
            least *= 2
        kept = [u >= least for u in uses]
        old, flat, starts, sizes = np.concatenate([c[k] for c, k in zip(codes, kept, strict=True)]), self.flat, self.starts, self.sizes
        self.reset()
        for new, t, k in zip((self.spaced, self.bare), tables, kept, strict=True):
            new.update(zip(compress(t, k), count(self.count), strict=False))
            self.count += int(k.sum())
        self.chars = sum(int(w[k].sum()) for w, k in zip(weight, kept, strict=True))
        n = sizes[old]
        self._put(np.arange(len(old)), flat[np.repeat(starts[old] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)
        self.uses[: len(old)] = 1

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.starts) < self.count:
            self.starts, self.sizes, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.uses))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[codes], self.sizes[codes] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)

    def _settle(self) -> None:
        """Encode the noted pieces. Space-led ones go many to a text, and the bytes of each id tell where a piece ends."""
        spaced, self.spaced.fresh = self.spaced.fresh, []
        if spaced:
            pieces = [x[0] for x in spaced]
            groups = self.direct([" " + " ".join(pieces[at : at + self.JOINED]) for at in range(0, len(pieces), self.JOINED)])
            ids = np.fromiter(chain.from_iterable(groups), dtype=np.uint32, count=sum(map(len, groups)))
            piece_ends = np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), dtype=np.int64, count=len(pieces)) + 1)
            last = np.searchsorted(np.cumsum(self.id_bytes[ids]), piece_ends, side="left") + 1
            self._put(np.fromiter((x[1] for x in spaced), dtype=np.int64, count=len(spaced)), ids, np.diff(last, prepend=0))
            self.chars += int(piece_ends[-1]) + 12 * len(pieces)
        bare, self.bare.fresh = self.bare.fresh, []
        if bare:
            groups = self.direct([x[0] for x in bare])
            ids = np.array([x for one in groups for x in one], dtype=np.uint32)
            self._put(np.array([x[1] for x in bare]), ids, np.array([len(x) for x in groups]))
            self.chars += sum(len(x[0]) + 12 for x in bare)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (a list or an Arrow array) in one array, and where each text's ids end. Null counts as empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if self.chars > self.cache_chars:
            self.trim()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        parts = pc.split_pattern(texts, " ")
        starts = np.asarray(parts.offsets, dtype=np.int64) - parts.offsets[0].as_py()
        pieces = parts.flatten()
        coded = pieces.dictionary_encode()  # a look-up for each distinct piece of the batch
        known = np.fromiter(map(self.spaced.__getitem__, coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        codes = known[np.asarray(coded.indices)]
        starts, ends = starts[:-1], starts[1:]
        first = pieces.take(pa.array(starts)).to_pylist()
        codes[starts] = [self.bare[x] if x and x.strip() == x else -1 for x in first]
        apart = np.logical_or.reduceat(codes < 0, starts)
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= np.asarray(pc.match_substring(texts, token))
        rows, upto, at = [], ends.copy(), 0
        for k in np.flatnonzero(apart | whole).tolist():
            text = texts[k].as_py()
            own = [self.bare[x] for x in ([text] if whole[k] or _SEPARATORS.search(text) else _CHUNK.findall(text))]
            rows += [codes[at : starts[k]], np.array(own, dtype=np.int64)]
            upto[k:] += len(own) - int(ends[k] - starts[k])
            at = ends[k]
        codes = np.concatenate([*rows, codes[at:]])
        self._settle()
        if not len(codes):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        seen = np.bincount(codes)
        self.uses[: len(seen)] += seen.astype(np.int32)
        sizes = self.sizes[codes]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[codes] - (after - sizes), sizes) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after])[upto]


def encoder(tokenizer_path: str, cache_chars: int = 9_000_000) -> PieceEncoder:
    """One encoder for each Python worker, kept between tasks. Nine million characters take about 200 MB, twenty million 330."""
    return kept(("encoder", tokenizer_path, cache_chars), lambda: PieceEncoder(tokenizer_path, cache_chars))
