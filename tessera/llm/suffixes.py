"""Suffix arrays by the difference cover modulo 3, in numpy: sort sampled triples, recurse on their names, merge the rest."""

from __future__ import annotations

import numpy as np

PACKED = 1 << 21


def _order(columns: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order of rows of small numbers, and where a row differs from the one before it."""
    if most < PACKED:
        key = columns[0]
        for c in columns[1:]:
            key = key << 21 | c
        order = np.argsort(key, kind="stable")
        key = key[order]
        return order, np.concatenate([[True], key[1:] != key[:-1]])
    order = np.lexsort(columns[::-1])
    differs = np.zeros(len(order), bool)
    differs[0] = True
    for c in columns:
        s = c[order]
        differs[1:] |= s[1:] != s[:-1]
    return order, differs


def _before(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """For each row of b, how many rows of a (ascending, none equal) are smaller."""
    if most < PACKED:
        ka, kb = a[0], b[0]
        for x, y in zip(a[1:], b[1:]):
            ka, kb = ka << 21 | x, kb << 21 | y
        return np.searchsorted(ka, kb)
    order, _ = _order([np.concatenate([x, y]) for x, y in zip(a, b)], most)
    from_a = order < len(a[0])
    count = np.cumsum(from_a)
    out = np.empty(len(b[0]), np.int64)
    out[order[~from_a] - len(a[0])] = count[~from_a]
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The places of t (numbers of 1 and more) in the order of the suffixes that begin there."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    s = np.concatenate([t.astype(np.int64), [0, 0, 0, 0]])
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    order, differs = _order([s[sample], s[sample + 1], s[sample + 2]], int(s.max()))
    names = np.cumsum(differs)
    rank = np.zeros(n + 4, np.int64)
    if names[-1] < len(sample):
        named = np.empty(len(sample), np.int64)
        named[order] = names
        order = suffix_array(named)
    sample = sample[order]
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    most = max(int(s.max()), len(rank))
    rest = np.arange(0, n, 3)
    rest = rest[_order([s[rest], rank[rest + 1]], most)[0]]
    one, two = sample[sample % 3 == 1], sample[sample % 3 == 2]
    place = np.arange(len(rest)) + _before([s[one], rank[one + 1]], [s[rest], rank[rest + 1]], most) + _before([s[two], s[two + 1], rank[two + 2]], [s[rest], s[rest + 1], rank[rest + 2]], most)
    out = np.empty(n, np.int64)
    is_rest = np.zeros(n, bool)
    is_rest[place] = True
    out[place] = rest
    out[~is_rest] = sample
    return out


def equal_prefixes(raw: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order, whether each begins with the same `length` bytes as the one before it."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw), "<u8", padded, strides=(1,))
    same = np.ones(len(order), bool)
    same[:1] = False
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        x = eight[order + k]
        same[1:] &= x[1:] == x[:-1]
    return same
