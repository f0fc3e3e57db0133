"""Suffix arrays by induced sorting, in numpy steps (inside tasks)."""

from __future__ import annotations

import numpy as np

from textsignal.llm.textarrays import _power, mixed


def classify(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one (S); the last character is the smallest."""
    d = np.sign(t[1:].astype(np.int64) - t[:-1])
    n = len(t)
    at = np.where(d != 0, np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.concatenate([np.concatenate([d, [1]])[at] > 0, [True]])


def _deal(found: np.ndarray, chars: np.ndarray, parts: list[list[np.ndarray]]) -> None:
    """Append positions to their characters' buckets, in order."""
    if len(found):
        order = np.argsort(chars, kind="stable")
        found, chars = found[order], chars[order]
        edge = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1], [True]]))
        for lo, hi in zip(edge[:-1], edge[1:]):
            parts[chars[lo]].append(found[lo:hi])


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """All suffixes from leftmost-smaller (LMS) positions in sorted order.  Buckets are visited in order
    of their character; the positions of a bucket induce their predecessors in one numpy step, and again
    as long as a bucket grows by itself."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    large: list[list[np.ndarray]] = [[] for _ in range(k)]
    small: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(lms, t[lms], seeds)
    for c in range(k):
        i = 0
        while i < len(large[c]):
            p = large[c][i] - 1
            p = p[p >= 0]
            p = p[~s[p]]
            _deal(p, t[p], large)
            i += 1
        for part in seeds[c]:
            p = part - 1
            p = p[p >= 0]
            p = p[~s[p]]
            _deal(p, t[p], large)
    for c in range(k - 1, -1, -1):      # from the right; the parts of ``small`` are in falling order
        i = 0
        while i < len(small[c]):
            p = small[c][i] - 1
            p = p[p >= 0]
            p = p[s[p]]
            _deal(p, t[p], small)
            i += 1
        for part in reversed(large[c]):
            p = part[::-1] - 1
            p = p[p >= 0]
            p = p[s[p]]
            _deal(p, t[p], small)
    small[t[-1]].append(np.array([len(t) - 1]))   # the last position has no successor that induces it
    return np.concatenate([x for c in range(k) for x in (*large[c], *[y[::-1] for y in reversed(small[c])])])


def ranks(names: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes of a reduced string by their first ``most`` names at least.  Its alphabet
    is too large for bucket steps: ranks are refined by the ranks at doubling distances, where ties remain."""
    n, reach = len(names), 1
    order = np.argsort(names, kind="stable")
    rank = names.astype(np.int64)
    while True:
        start = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
        first = np.flatnonzero(start)
        rank[order] = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        tied = np.flatnonzero(~(start & np.concatenate([start[1:], [True]])))
        if not len(tied) or reach >= min(n, most):
            return order
        own = order[tied]
        after = np.where(own + reach < n, rank[np.minimum(own + reach, n - 1)], -1)
        again = np.lexsort((after, rank[own]))
        order[tied] = own[again]
        after, held = after[again], rank[order[tied]]
        fresh = np.concatenate([[True], (held[1:] != held[:-1]) | (after[1:] != after[:-1])])
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        reach *= 2


def prefix_hashes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power(len(t) + 1)
    return np.concatenate([[np.uint64(0)], np.cumsum((t.astype(np.uint64) + np.uint64(1)) * up[:len(t)])]), down


def span_hash(run: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mixed((run[hi] - run[lo]) * down[lo])


def suffix_array(t: np.ndarray, k: int, most: int = 1 << 62) -> np.ndarray:
    """Suffixes of ``t`` sorted by their first ``most`` characters at least (characters below ``k``; the
    last is smaller than all others)."""
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        rough = induce(t, s, lms, k)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        order = rough[is_lms[rough]]                      # LMS substrings in sorted order
        ends = np.full(len(t), len(t), np.int64)
        ends[lms[:-1]] = lms[1:] + 1
        run, down = prefix_hashes(t)
        size = ends[order] - order
        own = span_hash(run, down, order, ends[order])
        name = np.empty(len(t), np.int64)
        name[order] = np.concatenate([[0], np.cumsum((own[1:] != own[:-1]) | (size[1:] != size[:-1]))])
        reduced = name[lms]
        if reduced.max() + 1 < len(lms):                  # equal substrings: sort the reduced string
            lms = lms[ranks(reduced, most)]
        else:
            lms = order
    return induce(t, s, lms, k)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text position, the common prefix with the preceding suffix of the sorted order, up to ``most``."""
    run, down = prefix_hashes(t)
    a, b = sa[1:], sa[:-1]
    room = np.minimum(len(t) - np.maximum(a, b), most)
    lo, hi = np.zeros(len(a), np.int64), room.astype(np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = span_hash(run, down, a, a + mid) == span_hash(run, down, b, b + mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    out = np.zeros(len(t), np.int64)
    out[a] = lo
    return out
