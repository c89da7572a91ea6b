"""Suffix order and longest-previous-factor arrays of byte strings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Places of equal keys in their order, equal ones alike."""
    order = np.argsort(keys, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(np.r_[0, keys[order][1:] != keys[order][:-1]])
    return ranks


def suffix_array(text: bytes) -> np.ndarray:
    """Starts of the suffixes in their order."""
    n = len(text)
    ranks, done = np.frombuffer(text, np.uint8).astype(np.int64), 1
    ranks = _ranks(ranks) if n else ranks
    while n and ranks.max() < n - 1:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - done)] = ranks[done:] + 1
        ranks = _ranks(ranks * (n + 1) + behind)
        done *= 2
    return np.argsort(ranks, kind="stable")


def _previous(places: Sequence[int], between: Sequence[int]) -> list[int]:
    """For each suffix in suffix order the length that it shares with the nearest one before it whose place is smaller; 0 if there is none."""
    out, stack = [], []
    for k, place in enumerate(places):
        low = between[k - 1] if k else 0
        while stack and stack[-1][0] > place:
            low = min(low, stack.pop()[1])
        out.append(low if stack else 0)
        stack.append((place, low))
    return out


def previous_factors(places: Sequence[int], between: Sequence[int]) -> list[int]:
    """Longest previous factors of suffixes given in suffix order.

    ``places`` are their places in the text and ``between`` the lengths that neighbours in the order share. The longest match with an earlier place
    is with the nearest smaller place on one of both sides: with the previous or the next smaller one.
    """
    before = _previous(places, between)
    after = _previous(places[::-1], between[::-1])[::-1]
    return list(map(max, before, after))


def longest_factors(between: Sequence[int]) -> list[int]:
    """For suffixes in suffix order the length that each shares with any other: with its neighbour on one of both sides."""
    return list(map(max, [0, *between], [*between, 0]))


def longest_previous(text: bytes) -> np.ndarray:
    """For each place of a text the length of the longest string that starts there and also at an earlier place."""
    order = suffix_array(text).tolist()
    n = len(order)

    def common(a: int, b: int) -> int:
        k = 0
        while max(a, b) + k < n and text[a + k] == text[b + k]:
            k += 1
        return k

    out = np.zeros(n, np.int64)
    out[order] = previous_factors(order, [common(a, b) for a, b in zip(order, order[1:])])
    return out
