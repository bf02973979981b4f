"""Suffix order of an integer string by the difference cover of period three.

Positions 1 and 2 modulo 3 are sampled. Their triples are sorted and named by rank; if
names repeat, the string of names is ordered the same way, which orders the sampled suffixes.
The remaining suffixes are one character before a sampled suffix, so they sort by
(character, sampled rank), and merge with the sampled ones because any two suffixes reach
sampled positions after the same one or two characters. All steps are whole-array sorts.

A caller that compares bounded prefixes passes ``reach``: recursion ends where the names
span that many characters, and suffixes equal so far may come in any order.
"""

from __future__ import annotations

import numpy as np


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal values share one."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
    return out


def suffix_order(text: np.ndarray, reach: int, span: int = 1) -> np.ndarray:
    """Positions of ``text`` (values from 0, under 2^31) in suffix order."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64) + 1, np.zeros(3, np.int64)])
    chars = int(t.max()) + 1
    pair = t[:-1] * chars + t[1:]
    if 3 * chars.bit_length() > 62 or 2 * chars.bit_length() + n.bit_length() > 62:
        pair = _dense(pair)
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    names = _dense(pair[sample] * chars + t[sample + 2])
    if span * 3 < reach and names.max() < len(sample):
        # the zero between both halves ends every suffix of the first
        order = suffix_order(np.concatenate([names[:len(one)], [0], names[len(one):]]), reach, span * 3)
        order = order[order != len(one)]
        order = sample[order - (order > len(one))]
    else:
        order = sample[np.argsort(names, kind="stable")]
    rank = np.zeros(n + 3, np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    ranks = len(order) + 1
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * ranks + rank[rest + 1], kind="stable")]
    first, second = order[order % 3 == 1], order[order % 3 == 2]

    def short(i: np.ndarray) -> np.ndarray:
        return t[i] * ranks + rank[i + 1]

    def long(i: np.ndarray) -> np.ndarray:
        return pair[i] * ranks + rank[i + 2]

    place = np.searchsorted(short(first), short(rest)) + np.searchsorted(long(second), long(rest))
    both = np.concatenate([rest, order])
    return both[np.argsort(np.concatenate([2 * place, 2 * np.arange(len(order)) + 1]), kind="stable")]


def equal_windows(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For every start the smallest start whose ``width`` characters are the same.

    ``starts`` ascend and their windows lie within ``text``.
    """
    if not len(starts):
        return starts
    at = np.full(len(text), -1)
    at[starts] = np.arange(len(starts))
    order = at[suffix_order(text, width)]
    order = order[order >= 0]
    sorted_starts, steps = starts[order], np.arange(width)
    differs = np.ones(len(order), bool)
    for k in range(1, len(order), 1 << 15):
        rows = sorted_starts[k - 1:k + (1 << 15)]
        windows = text[rows[:, None] + steps]
        differs[k:k + len(rows) - 1] = (windows[1:] != windows[:-1]).any(1)
    heads = np.flatnonzero(differs)
    least = np.minimum.reduceat(sorted_starts, heads)
    out = np.empty(len(starts), starts.dtype)
    out[order] = np.repeat(least, np.diff(np.append(heads, len(order))))
    return out
