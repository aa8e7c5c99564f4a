"""Suffix arrays by two-stage sorting (Itoh and Tanaka, 1999), in whole-array steps.

Suffixes smaller than their successors are sorted directly, eight bytes at a time. All others are induced: buckets of a first
byte are scanned in ascending order, and each scanned suffix puts its predecessor, if that is larger than it, at the next
place of the predecessor's bucket.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. The last suffix is larger than the empty one."""
    n = len(text)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    rising = text[:-1] < text[1:]
    differs = text[:-1] != text[1:]
    # equal neighbours take the answer of the next place where neighbours differ
    at = np.where(differs, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    ok = nxt < n
    out[:-1][ok] = rising[nxt[ok]]
    return out


def _sort_directly(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of their suffixes' first ``depth`` bytes; ties stay in the order of position."""
    padded = np.concatenate([text, np.zeros(depth + 16, dtype=np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype=">u8", buffer=padded, strides=(1,))
    order = starts[np.argsort(words[starts].astype(np.uint64), kind="stable")]
    group = np.concatenate([[False], words[order[1:]] == words[order[:-1]]]) if len(order) else np.zeros(0, bool)
    for at in range(8, depth, 8):
        # runs of equal prefixes are sorted on by their next word, all of them at once
        member = group.copy()
        member[:-1] |= group[1:]
        spots = np.flatnonzero(member)
        if not len(spots):
            break
        run = np.cumsum(~group[spots])
        own = order[spots]
        word = words[own + at].astype(np.uint64)
        inner = np.lexsort((word, run))
        order[spots] = own[inner]
        word = word[inner]
        tie = np.concatenate([[False], (word[1:] == word[:-1]) & (run[1:] == run[:-1])])
        group[spots] = tie
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in order of their first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    small = smaller_than_next(text)
    direct = _sort_directly(text, np.flatnonzero(small), depth)
    first = text[direct]
    direct_ends = np.searchsorted(first, np.arange(257))
    sizes = np.bincount(text, minlength=256)
    out = np.empty(n, dtype=np.int64)
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    done = 0
    for c in np.flatnonzero(sizes).tolist():
        queue, k = induced[c], 0
        waves: list[np.ndarray] = []
        while k < len(queue) or waves is not None:
            if k < len(queue):  # all that has been put here so far, in its order
                part, k = np.concatenate(queue[k:]), len(queue)
            else:  # larger suffixes come first in a bucket, then the directly sorted ones
                part, waves = direct[direct_ends[c] : direct_ends[c + 1]], None
            out[done : done + len(part)] = part
            done += len(part)
            before = part[part > 0] - 1
            before = before[~small[before]]
            if not len(before):
                continue
            key = text[before]
            by = np.argsort(key, kind="stable")
            before, key = before[by], key[by]
            cuts = np.flatnonzero(np.diff(key)) + 1
            for piece in np.split(before, cuts):
                induced[text[piece[0]]].append(piece)
    return out


def common_prefixes_reach(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order, whether it shares ``length`` bytes at least with the one before it in order."""
    out = np.zeros(len(order), dtype=bool)
    padded = np.concatenate([text, np.zeros(length + 8, dtype=np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    alive = np.flatnonzero(np.maximum(order[1:], order[:-1]) + length <= len(text)) + 1
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alive = alive[words[order[alive] + at] == words[order[alive - 1] + at]]
    out[alive] = True
    return out
