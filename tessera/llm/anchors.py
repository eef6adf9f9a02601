"""Winnowed anchors: of any two equal strings of WINDOW bytes the same place is chosen, by its bytes alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tessera.llm.common import GOLD, eights, mix64

WINDOW, GRAM, SEGMENT = 50, 20, 1 << 20


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of raw[i : i + gram] (8 bytes at least) for every i that has so many bytes."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight, out = eights(raw), np.full(n, np.uint64(gram))
    for k in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        out ^= eight[k : k + n]
        out *= GOLD
        out ^= out >> np.uint64(32)
    return mix64(out)


def chosen(raw: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that choose one anchor: the anchors' places and hashes, the first and the last window's place.

    A window chooses the gram with the smallest upper half of its hash in it, the first of several. Windows end with
    their text; runs come in order.
    """
    none = np.zeros(0, np.int64)
    h = gram_hashes(raw, gram)
    places = len(raw) - window + 1
    if places <= 0:
        return none, none.astype(np.uint64), none, none
    key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    width, low = window - gram + 1, key
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    place = (low[:places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(places + 1, np.int8)
    # Windows over the end of a text are out: those that begin in the last window - 1 bytes of it.
    outs = np.repeat(at[1:], window - 1) - np.tile(np.arange(1, window), len(at) - 1)
    outs = outs[(outs >= np.repeat(at[:-1], window - 1)) & (outs < places)]
    inside[outs] = 1
    valid = inside[:places] == 0
    starts = np.flatnonzero(valid & np.concatenate([[True], (place[1:] != place[:-1]) | ~valid[:-1]]))
    ends = np.flatnonzero(valid & np.concatenate([(place[1:] != place[:-1]) | ~valid[1:], [True]]))
    return place[starts], h[place[starts]], starts, ends


def runs_of(raw: np.ndarray, at: np.ndarray, segment: int = SEGMENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """chosen() over `segment` windows at a time; at most a run that goes over such a border comes in two."""
    for low in range(0, max(1, len(raw) - WINDOW + 1), segment):
        high = min(len(raw), low + segment + WINDOW - 1)
        first, after = np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high)
        place, h, start, end = chosen(raw[low:high], np.clip(at[first : after + 1], low, high) - low)
        yield place + low, h, start + low, end + low
