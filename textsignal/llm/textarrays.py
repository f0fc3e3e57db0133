"""Words and shingles of many texts at once, as numpy arrays (inside tasks)."""

from __future__ import annotations

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_B, inverse)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z only) words of all texts in order, and each text's first
    position in them (one more entry at the end)."""
    return word_spans(texts)[:2]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """``word_hashes``, and the lower-cased bytes of all texts with the words' starts and ends in them."""
    raw = [t.encode().lower() for t in texts]
    joined = b" " + b" ".join(raw) + b" "
    data = np.frombuffer(joined, np.uint8)
    gap = data - np.uint8(9) < 5                    # tab to carriage return
    gap |= data == 32
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    hashes = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), 1 << 15)), len(starts)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):     # few words at a time, so that their sums stay at hand
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power(hi - lo + 1)
        run = np.zeros(hi - lo + 1, np.uint64)
        run[1:] = data[lo:hi]
        run[1:] += np.uint64(1)
        run[1:] *= up[:hi - lo]
        np.cumsum(run, out=run)
        begin = starts[i:j] - lo
        hashes[i:j] = (run[ends[i:j] - lo] - run[begin]) * down[begin]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64))
    edges = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return hashes, np.searchsorted(starts, edges + 1), joined, starts, ends


def shingle_sets(texts: list[str], size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: ``size`` words, or all words of a shorter text."""
    words, first = word_hashes(texts)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    n = len(words)
    whole = np.zeros(n, np.uint64)
    for k in range(size):
        whole = mixed(whole * np.uint64(3) + padded[k:n + k] + np.uint64(k + 1))
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        count = hi - lo
        if count >= size:
            out.append(np.unique(whole[lo:hi - size + 1]))
        elif count:
            h = np.array([count], np.uint64)
            for k in range(lo, hi):
                h = mixed(h * np.uint64(5) + words[k:k + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def blocks(texts: list[str], most: int = 1 << 21):
    """Index ranges of consecutive texts with about ``most`` characters together (at least one text)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)
