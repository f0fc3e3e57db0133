"""Scores of a causal self-attention language model on subword ids, and a smoothed word baseline.

Documents whose ``crc32(doc_id as text) mod 7`` is 2 are held out; all others train both models.  Texts are
lower-cased (A-Z); their words and one end each are the tokens of the baseline.

Model.  The words, each behind a space, are spelt in subword ids: the first SUBWORDS entries of a public
byte-level BPE vocabulary, and one id for the end.  An id's *value* is its distribution of next ids, with
one table for the id right before the target and one for those up to REACH ids before it; the phrases of
the last two and three ids have values as well (all that occur, smoothed by
the shorter one).  The values are counted over all training texts.  The last id is the query; it attends to
the ids of its context, itself included, to the two phrases, and to a sink whose value is the overall
distribution of ids:

    p(next) = sum over context j of attention(last, j) * value_j(next)

with attention the softmax of ``query . key + bias of the distance`` (of a phrase: a bias by how often it
was seen).  Queries, keys and biases are trained
in numpy by gradient steps on the log-likelihood.  Every group of documents trains on its own training
texts, from the same start: they are halved by a hash of the text, and each half's places are all targets
under tables of the other half; the groups' parameters are averaged by their number of targets.  So every
place of every training text is a target, save in a group of a single one, which has no other half.  Contexts are windows that overlap by all but one place, masked at the
text's start; each token is scored once, in batches.

Work.  Documents are dealt to groups by a hash.  A group sends its vocabulary with training counts,
packed by word hash, and all phrases with next ids of its texts (those of held-out texts with count 0),
packed by phrase; the sums over all groups come back to the groups that asked, so no task ever holds the
whole vocabulary or all phrases, and no count depends on the grouping.  The tables (bounded by SUBWORDS
squared) are added up in rounds of FAN groups and broadcast.

Defined results: null and empty texts have one token, the end; a null id is training; ``base_score``
and ``score`` are log10 probabilities; without training documents counts are 0 and the tables uniform;
repeated rows count and are scored each; an empty table gives an empty result.  Other columns, whatever their names, are neither read nor returned.
Words are 64-bit hashes.
"""

from __future__ import annotations

import base64
import functools
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import buckets, stash, text_or_empty
from textsignal.llm.textarrays import blocks, mixed, word_spans

MODULUS, HELD = 7, 2        # fixed by the contract
SUBWORDS = 512
REACH = 8                   # ids of context
WIDTH = 16                  # of queries and keys
STEPS_OF = 8192             # targets of a gradient step
RATE, SEED = 0.1, 7
PRIOR = (4.0, 40.0)         # weight of the overall distribution in the two tables
FAN = 16                    # groups that are added up at a time
LENGTHS = (2, 3)            # of the phrases, in ids
DISCOUNT = 0.75             # what smoothing takes from each count of a phrase
LEVEL_BITS = 4
LEVELS = 1 << LEVEL_BITS    # of the bias of a phrase
SIZE = SUBWORDS + 1
BITS = SIZE.bit_length()    # of an id
TOGETHER = 63 // BITS       # ids that are read at a time
AHEAD = REACH // TOGETHER * TOGETHER
SCORED = 3                  # blocks of texts whose values are looked up together


def default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def subwords(path: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=r" [^ ]{0,64}|[^ ]{1,64}", special_tokens={},
                             mergeable_ranks={k: v for k, v in ranks.items() if v < SUBWORDS})


def spelt_blocks(texts: list[str], path: str):
    """By block of texts: the hashes of its distinct words, which of them each word is, the texts' first words (and
    the total), their subword ids, each text with its end, and the number of ids of each text.  Words are spelt
    independently, so each distinct word is spelt once, those that are new in a block in one call."""
    encoding = subwords(path)
    spaced = np.array([encoding.decode_single_token_bytes(i)[:1] == b" " for i in range(SUBWORDS)])
    known, where, sizes, spellings = np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64), np.zeros(0, np.int32)
    for lo, hi in blocks(texts):
        hashes, first, raw, starts, ends = word_spans(texts[lo:hi])
        words, word, at = distinct(hashes)
        seen = np.searchsorted(known, words)
        new = np.append(known, np.uint64(0))[seen] != words
        new[seen == len(known)] = True
        spelt = behind_spaces(raw, starts[at[new]], ends[at[new]])
        flat = encoding.encode_to_numpy(spelt).astype(np.int32)
        begin = np.append(np.flatnonzero(spaced[flat]), len(flat))
        known, where, sizes = (np.insert(x, seen[new], y) for x, y in (
            (known, words[new]), (where, len(spellings) + begin[:-1]), (sizes, np.diff(begin))))
        spellings = np.concatenate([spellings, flat])
        own, flat = np.searchsorted(known, words), np.append(spellings, np.int32(SUBWORDS))    # the last is the end
        begin, every = np.append(where[own], len(spellings)), np.append(sizes[own], 1)
        order = np.insert(word, first[1:], len(words))
        length, begin = every[order], begin[order]
        upto = np.cumsum(length)
        ids = flat[np.repeat(begin - (upto - length), length) + np.arange(upto[-1])]
        yield words, word, first, ids, np.diff(upto[first[1:] + np.arange(hi - lo)], prepend=0)


def behind_spaces(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words of these bytes (each behind some byte), each behind a space."""
    length = ends - starts + 1
    upto = np.cumsum(length)
    out = np.frombuffer(raw, np.uint8)[np.repeat(starts - 1 - (upto - length), length) + np.arange(length.sum())]
    out[upto - length] = 32
    return out.tobytes().decode()


def firsts(sizes: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def ids_of(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of all texts, each with its end, and the texts' first places (and the total)."""
    *_, ids, sizes = zip(*spelt_blocks(texts, path))
    return np.concatenate(ids), firsts(sizes)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, which of them each key is, and the place of the first of each."""
    if len(keys):
        # key and place are sorted as one number, without an index; where both don't fit, by the key's leading bits
        bits = (len(keys) - 1).bit_length()
        drop = max(int(keys.max()).bit_length() + bits - 64, 0)
        both = keys.astype(np.uint64)
        both >>= np.uint64(drop)
        both <<= np.uint64(bits)
        both |= np.arange(len(keys), dtype=np.uint64)
        both.sort()
        place = (both & np.uint64((1 << bits) - 1)).view(np.int64)
        both >>= np.uint64(bits)
        new = np.append(True, both[1:] != both[:-1])
        which = np.empty(len(keys), np.int32)
        which[place] = np.cumsum(new, dtype=np.int32) - 1
        new = np.flatnonzero(new)
        at = place[new]
        words = keys[at] if drop else both[new].astype(keys.dtype)
        if drop == 0 or (words[which] == keys).all():       # no two keys share their leading bits
            return words, which, at
    words, at, which = np.unique(keys, return_index=True, return_inverse=True)
    return words, which, at


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and which of them each key is."""
    new = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
    return keys[new], np.cumsum(new) - 1


def grams(ids: np.ndarray, base: int, n: int = 4) -> np.ndarray:
    """Each id with the n - 1 before it, as one number to this base (those before the first are 0)."""
    if n == 1:
        return ids.astype(np.int64)
    back = n - n // 2
    out = grams(ids, base, back)
    before = out if n % 2 == 0 else grams(ids, base, n // 2)
    before = before[:max(len(ids) - back, 0)] * base ** back
    out[back:] += before
    return out


def occurring(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(ids, minlength=SIZE))


def numbered(ids: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The ids as places in ``own``."""
    place = np.zeros(SIZE, np.int16)
    place[own] = np.arange(len(own))
    return place[ids]


def pair_counts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of (id, target): rows 0 of the nearest id, rows 1 of the farther ones; row 2 of targets."""
    own = occurring(ids)
    n, wide, size = len(own), len(own) + 1, 1 << 18
    out, seen = np.zeros((3, SIZE * SIZE), np.int64), np.zeros((2, wide, wide), np.int64)
    # texts stand apart by REACH places of a number of its own, so that no pair crosses them
    apart = np.full(len(ids) + REACH * len(first), n, np.int16)
    apart[np.arange(len(ids)) + np.repeat(REACH * np.arange(len(first) - 1), np.diff(first))] = numbered(ids, own)
    for lo in range(0, len(apart) - REACH, size):
        some = apart[lo:lo + size + REACH].astype(np.int64)
        rows = some[:-REACH] * wide
        for lag in range(1, REACH + 1):
            seen[int(lag > 1)] += np.bincount(rows + some[lag:lag + len(rows)], minlength=wide * wide).reshape(wide, wide)
    for k in (0, 1):
        out[k].reshape(SIZE, SIZE)[np.ix_(own, own)] = seen[k, :n, :n]
    out[2, :SIZE] = np.bincount(ids, minlength=SIZE)
    return out


def values(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value tables (nearest, farther) and the overall distribution."""
    overall = (counts[2, :SIZE] + 1.0) / (counts[2, :SIZE].sum() + SIZE)
    tables = []
    for k in (0, 1):
        n = counts[k].reshape(SIZE, SIZE)
        tables.append((n + PRIOR[k] * overall) / (n.sum(axis=1, keepdims=True) + PRIOR[k]))
    return np.stack(tables).astype(np.float32), overall.astype(np.float32)


def phrase_counts(ids: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of (phrase, next id) inside texts, and their counts."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys = ids[:len(ids) - length].astype(np.int64)
    for k in range(1, length + 1):
        keys = keys * SIZE + ids[k:len(ids) - length + k]
    return np.unique(keys[text[length:] == text[:len(text) - length]], return_counts=True)


def joined_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at, _ = distinct(np.concatenate([k for k, _ in parts]))
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def gram_counts(keys: np.ndarray, which: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``phrase_counts`` of both lengths from the distinct ``grams`` and which of them each place has."""
    early = [(first[:-1] + k)[np.diff(first) > k] for k in range(3)]      # places with k ids of their text before them
    counts = np.bincount(which, minlength=len(keys)) - np.bincount(which[np.concatenate(early)], minlength=len(keys))
    keys, counts, second = keys[counts > 0], counts[counts > 0], keys[which[early[2]]]
    return {2: joined_counts([(keys % SIZE ** 3, counts), (second % SIZE ** 3, np.ones(len(second), np.int64))]),
            3: (keys, counts)}


class Places:
    """Places of keys among sorted ones."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys.take(at) == keys, at, -1)


class Phrases:
    """Values of the phrases of one length: counts of the next ids, their sum and number by phrase."""

    def __init__(self, length: int, keys: np.ndarray, counts: np.ndarray, phrases: tuple | None = None):
        """``keys``: sorted; ``phrases``: sorted ids, sums and numbers of next ids, where these are not all their pairs."""
        self.pairs, self.counts = Places(keys), counts.astype(np.float32)
        if phrases is None:
            phrase, at = runs(keys // SIZE)
            phrases = phrase, np.bincount(at, counts, minlength=len(phrase)), np.bincount(at, minlength=len(phrase))
        phrase, total, kinds = phrases
        # where the phrase is two ids, their product is small enough for a plain table of places
        if length > 2:
            self.phrases = Places(phrase)
        else:
            self.phrases = np.full(SIZE ** 2, -1, np.int32)
            self.phrases[phrase] = np.arange(len(phrase))
        self.total = np.append(total, 0).astype(np.float32)
        self.kinds = np.append(kinds, 0).astype(np.float32)

    def value(self, phrase: np.ndarray, target: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed probability of the targets, and the level of the phrases (0: never seen)."""
        at = self.phrases.find(phrase) if isinstance(self.phrases, Places) else self.phrases[phrase]
        total, kinds, pair = self.total[at], self.kinds[at], np.full(len(at), -1, np.int32)
        seen = np.flatnonzero(at >= 0)
        pair[seen] = self.pairs.find(phrase[seen] * SIZE + target[seen])
        own = np.where(pair >= 0, self.counts[pair] - DISCOUNT, 0) if len(self.counts) else np.zeros(len(at))
        value = np.where(total > 0, (own + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)
        return value, np.minimum(np.log2(total + 1).astype(np.int64), LEVELS - 1)


def start_parameters() -> dict[str, np.ndarray]:
    random = np.random.default_rng(SEED)
    near = np.zeros(REACH)
    near[0] = 2.0
    level = np.minimum(np.arange(LEVELS), 6.0) / 2
    return {"query": 0.1 * random.standard_normal((SIZE, WIDTH)), "key": 0.1 * random.standard_normal((SIZE, WIDTH)),
            "bias": near, "sink": np.zeros(SIZE), "level2": level + 1, "level3": level + 2}


class Lookup:
    """What does not depend on the parameters, for all places of some texts: values and levels of the distinct
    (phrase of three ids, target), which of them each place has, how many ids (up to REACH) precede it, and the
    ids around it.  With ``own``, the ids that occur, all of these are numbered among them, and the parameters that
    are used with this are theirs alone.  ``found``: the distinct ``grams`` and which of them each place has."""

    def __init__(self, model: tuple, ids: np.ndarray, first: np.ndarray, places: np.ndarray | None = None,
                 found: tuple[np.ndarray, np.ndarray] | None = None, own: np.ndarray | None = None):
        table, overall, books = model
        self.size, self.far, self.overall, small = SIZE, table[1].ravel(), overall, ids
        if own is not None:
            self.size, self.far, self.overall, small = len(own), table[1][np.ix_(own, own)].ravel(), overall[own], numbered(ids, own)
        self.around = grams(np.append(np.zeros(AHEAD, small.dtype), small), 1 << BITS, TOGETHER)
        if found is None:
            keys = grams(ids, SIZE)
            found = distinct(keys if places is None else keys[places])
        keys, self.at = found[:2]
        if places is None:
            self.before = np.full(len(ids), REACH, np.int8)
            for k in range(REACH):
                self.before[(first[:-1] + k)[np.diff(first) > k]] = k
        else:
            self.before = np.minimum(places - first[np.searchsorted(first, places, side="right") - 1], REACH)
        self.values = np.empty((len(keys), 4), np.float32)      # of the nearest id, the two phrases, and both their levels
        for lo in range(0, len(keys), 1 << 18):
            phrase, target = np.divmod(keys[lo:lo + (1 << 18)], SIZE)
            v = self.values[lo:lo + (1 << 18)]
            v[:, 0] = table[0].ravel().take(phrase % SIZE * SIZE + target)
            v[:, 1], level = books[2].value(phrase % SIZE ** 2, target, v[:, 0])
            v[:, 2], higher = books[3].value(phrase, target, v[:, 1])
            v[:, 3] = level + LEVELS * higher

    def window(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The REACH ids before each place, nearest first, one row for each distance, and the ids at the places."""
        lo, n, backs = int(places[0]) if len(places) else 0, len(places), range(0, REACH + 1, TOGETHER)
        if n and int(places[-1]) - lo == n - 1:              # a range of places
            some = [self.around[lo + AHEAD - back:lo + AHEAD - back + n] for back in backs]
        else:
            some = [self.around.take(places + (AHEAD - back), mode="wrap") for back in backs]
        out = np.empty((REACH + 1, n), np.int64)
        for k in range(REACH + 1):
            np.right_shift(some[k // TOGETHER], BITS * (k % TOGETHER), out=out[k])
        out &= (1 << BITS) - 1
        return out[1:], out[0]


def down(x: np.ndarray) -> np.ndarray:
    """Sums of the columns, added up as numpy adds up a row of as many (so that roundings are those of a row)."""
    total = ((x[0] + x[1]) + (x[2] + x[3])) + ((x[4] + x[5]) + (x[6] + x[7]))
    for row in x[8:]:
        total += row
    return total


def attend(logits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Softmax, down each column, over the sink (first), the context places that exist and the phrases that do."""
    short = np.flatnonzero(before < REACH)
    if len(short):
        there = np.arange(REACH)[:, None] < before[short]
        exists = np.concatenate([np.ones((1, len(short)), bool), there, there[1:3]])
        logits[:, short] = np.where(exists, logits[:, short], -np.inf)
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= down(logits)
    return logits


def mixture(p: dict[str, np.ndarray], model: tuple | Lookup, ids: np.ndarray, first: np.ndarray, places: np.ndarray,
            scores: np.ndarray | None = None):
    """Attention, values of the targets, places of their (last id, context id) in a square table, levels of the phrases.
    ``model``: tables and phrases, or what was looked up for all places of ``ids``."""
    known, at = (model, places) if isinstance(model, Lookup) else (Lookup(model, ids, first, places), slice(None))
    if scores is None:
        scores = (p["query"] @ p["key"].T).astype(np.float32)
    context, target = known.window(places)
    last, key = context[0].copy(), known.at[at] if isinstance(at, slice) else known.at.take(at)
    pairs = context + last * known.size
    one = known.values.take(key, axis=0)
    level = one[:, 3].astype(np.int64)
    level = np.stack((level & (LEVELS - 1), level >> LEVEL_BITS))
    logits = np.empty((REACH + 3, len(places)), np.float32)
    logits[0] = p["sink"].astype(np.float32).take(last)
    # all numbers are places in the tables: no bounds are checked
    scores.ravel().take(pairs, mode="wrap", out=logits[1:REACH + 1])
    logits[1:REACH + 1] += p["bias"].astype(np.float32)[:, None]
    for k in (2, 3):
        logits[REACH + k - 1] = p[f"level{k}"].astype(np.float32).take(level[k - 2])
    value = np.empty_like(logits)
    value[0], value[1], value[REACH + 1], value[REACH + 2] = known.overall.take(target), *one.T[:3]
    context *= known.size
    context += target
    known.far.take(context[1:], mode="wrap", out=value[2:REACH + 1])
    return attend(logits, known.before[at]).T, value.T, pairs, last, level


def train(ids: np.ndarray, first: np.ndarray, half: int, counts: dict, others: dict | None = None,
          pairs: list[np.ndarray] | None = None, found: list[tuple] | None = None) -> tuple[dict[str, np.ndarray], int]:
    """Parameters after one pass over a group's training texts, and the number of targets: all places of the
    texts before ``half`` under the values of the others, and the other way round (``counts`` and ``others``:
    the phrases of the two halves; those of the others are counted where they are not given; ``pairs``, ``found``: the
    pair counts and distinct ``grams`` of the two halves, where the caller has them)."""
    p = start_parameters()
    if not 0 < half < len(first) - 1:
        return p, 0
    cut, power = first[half], {k: np.full_like(v, 1e-6) for k, v in p.items()}
    sides = (ids[:cut], first[:half + 1]), (ids[cut:], first[half:] - cut)
    others = others or {k: phrase_counts(*sides[1], k) for k in counts}
    pairs = pairs or [pair_counts(*side) for side in sides]
    found = found or [None, None]
    for pair, (to, starts), phrases, keys in ((pairs[0], sides[1], counts, found[1]), (pairs[1], sides[0], others, found[0])):
        model = (*values(pair), {k: Phrases(k, *x) for k, x in phrases.items()})
        learn(p, power, model, to, starts, keys)
    return p, len(ids)


def narrowed(p: dict[str, np.ndarray], own: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters of some ids."""
    return {k: v[own] if len(v) == SIZE else v for k, v in p.items()}


def learn(p: dict[str, np.ndarray], power: dict[str, np.ndarray], model: tuple, ids: np.ndarray, first: np.ndarray,
          found: tuple | None = None) -> None:
    """Gradient steps over all places, in random order.  Those of ids that don't occur are 0, so that only the
    parameters of the others take part."""
    own = occurring(ids)
    known, places = Lookup(model, ids, first, found=found, own=own), np.random.default_rng(SEED).permutation(len(ids))
    every, p, n = (p, power), narrowed(p, own), len(own)
    power = narrowed(power, own)
    for lo in range(0, len(places), STEPS_OF):
        some = np.sort(places[lo:lo + STEPS_OF])
        a, v, pairs, last, level = mixture(p, known, ids, first, some, (p["query"] @ p["key"].T).astype(np.float32))
        a, v = a.T, v.T
        prob = down(a * v)
        up = v - prob                                       # gradient of the mean log-likelihood in the logits
        up *= a
        up /= prob
        up /= len(some)
        near, g = up[1:REACH + 1], {}
        g["bias"] = np.add.accumulate(near, axis=1)[:, -1]
        g["sink"] = np.bincount(last, up[0], minlength=n)
        for k in (2, 3):
            g[f"level{k}"] = np.bincount(level[k - 2], up[REACH + k - 1], minlength=LEVELS)
        # sums by (query id, key id) turn the gradients of queries and keys into two matrix products
        pair = np.bincount(pairs.ravel(), near.ravel(), minlength=n * n).reshape(n, n)
        g["query"], g["key"] = pair @ p["key"], pair.T @ p["query"]
        for k in p:
            power[k] += g[k] ** 2
            p[k] += RATE * g[k] / np.sqrt(power[k])
    for whole, part in zip(every, (p, power)):
        for k, v in whole.items():
            v[own if len(v) == SIZE else slice(None)] = part[k]


def score_ids(p: dict[str, np.ndarray], model: tuple, ids: np.ndarray, first: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """log10 probability of each text."""
    own = occurring(ids)
    logs, known = np.empty(len(ids)), Lookup(model, ids, first, own=own)
    p, scores = narrowed(p, own), scores[np.ix_(own, own)]
    for lo in range(0, len(ids), 1 << 13):
        places = np.arange(lo, min(lo + (1 << 13), len(ids)))
        a, v, *_ = mixture(p, known, ids, first, places, scores)
        logs[places] = np.log10(down((a * v).T).astype(np.float64))
    return np.add.reduceat(logs, first[:-1])


def packed(numbers: np.ndarray) -> bytes:
    """Integers of up to 63 bits, none negative, by byte plane, without the planes above the largest."""
    width = max(-(-int(numbers.max(initial=0)).bit_length() // 8), 1)
    planes = np.ascontiguousarray(numbers.astype(np.int64)).view(np.uint8).reshape(-1, 8).T[:width]
    return struct.pack("<BQ", width, len(numbers)) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    width, n = struct.unpack_from("<BQ", raw)
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd"), np.uint8).reshape(width, n).T
    return out.view(np.int64).ravel()


def squeeze(counts: np.ndarray, p: dict[str, np.ndarray], n: int) -> bytes:
    flat = np.concatenate([p[k].ravel() for k in sorted(p)]) * n
    return zlib.compress(counts.tobytes() + np.append(flat, float(n)).tobytes(), 1)


def loosen(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(raw)
    edge = 3 * SIZE * SIZE * 8
    return np.frombuffer(data[:edge], np.int64).reshape(3, -1), np.frombuffer(data[edge:])


def averaged(flat: np.ndarray) -> dict[str, np.ndarray]:
    p, at = start_parameters(), 0
    if flat[-1] == 0:
        return p
    for k in sorted(p):
        p[k] = (flat[at:at + p[k].size] / flat[-1]).reshape(p[k].shape)
        at += p[k].size
    return p


def learn_group(n: int, path: str):
    """A group's vocabulary with training counts (kind 0, by bucket), its tables and parameters (kind 1), and
    the phrases of its texts with training counts (kinds LENGTHS, by bucket)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts, trains = group["text"].tolist(), ~group["held_out"].to_numpy(bool)
        # halves by a hash of the text, equal in size, whatever order the rows arrive in
        own = sorted((t for t, x in zip(texts, trains) if x), key=lambda t: (zlib.crc32(t.encode()), t))
        asked, ids, sizes, seen_words, left = [t for t, x in zip(texts, trains) if not x], [], [], [], len(own)
        for words, word, begin, some, size in spelt_blocks(own + asked, path):     # no word is spelt twice
            seen_words.append((words, np.bincount(word[:begin[min(left, len(size))]], minlength=len(words))))
            ids.append(some)
            sizes.append(size)
            left = max(left - len(size), 0)
        ids, first = np.concatenate(ids), firsts(sizes)
        end = first[len(own)]
        words, at, _ = distinct(np.concatenate([w for w, _ in seen_words]))
        counts = np.bincount(at, np.concatenate([c for _, c in seen_words]), minlength=len(words)).astype(np.uint32)
        to = (mixed(words) % np.uint64(n)).astype(np.min_scalar_type(n))
        order = np.argsort(to, kind="stable")
        words, counts, to = words[order], counts[order], to[order]
        edge = np.searchsorted(to, np.arange(n + 1))
        out = [(0, int(b), words[i:j].tobytes(), counts[i:j].tobytes())
               for b, i, j in zip(range(n), edge[:-1], edge[1:]) if j > i]
        total, parameters, targets = np.zeros((3, SIZE * SIZE), np.int64), start_parameters(), 0
        parts = []
        if own:
            half = len(own) // 2
            cut = first[half]
            sides = (ids[:cut], first[:half + 1]), (ids[cut:end], first[half:len(own) + 1] - cut)
            found = [distinct(grams(to, SIZE))[:2] for to, _ in sides]
            parts = [gram_counts(*keys, starts) for keys, (_, starts) in zip(found, sides)]
            pairs = [pair_counts(*side) for side in sides]
            total = pairs[0] + pairs[1]
            parameters, targets = train(ids[:end], first[:len(own) + 1], half, *parts, pairs, found)
        if asked:
            others = gram_counts(*distinct(grams(ids[end:], SIZE))[:2], first[len(own):] - end)
            parts.append({k: (keys, np.zeros(len(keys), np.int64)) for k, (keys, _) in others.items()})
        for k in LENGTHS:
            keys, seen = joined_counts([x[k] for x in parts])
            to = (mixed((keys // SIZE).astype(np.uint64)) % np.uint64(n)).astype(np.min_scalar_type(n))
            order = np.argsort(to, kind="stable")
            keys, seen, to = keys[order], seen[order], to[order]
            edge = np.searchsorted(to, np.arange(n + 1))
            out += [(k, int(b), packed(np.diff(keys[i:j], prepend=0)), packed(seen[i:j]))
                    for b, i, j in zip(range(n), edge[:-1], edge[1:]) if j > i]
        out.append((1, 0, squeeze(total, parameters, targets), b""))
        return pd.DataFrame(out, columns=["kind", "bucket", "a", "b"]).assign(g=group["g"].iloc[0])

    return run


def add_phrases(bucket: pd.DataFrame) -> pd.DataFrame:
    """Summed training counts of a bucket's phrases of one length, sent back to each group for its own: the
    (phrase, next id) pairs seen, their counts, the phrases seen, their sums and numbers of next ids."""
    sent = [np.cumsum(unpacked(a)) for a in bucket["a"]]
    keys, at, _ = distinct(np.concatenate(sent))
    count = np.bincount(at, np.concatenate([unpacked(b) for b in bucket["b"]]), minlength=len(keys)).astype(np.int64)
    phrase, of = runs(keys // SIZE)
    total = np.bincount(of, count, minlength=len(phrase)).astype(np.int64)
    kinds = np.bincount(of, count > 0, minlength=len(phrase)).astype(np.int64)
    edge, rows = np.concatenate([[0], np.cumsum([len(x) for x in sent])]), []
    for g, i, j in zip(bucket["g"].tolist(), edge[:-1], edge[1:]):
        pair, own = at[i:j][count[at[i:j]] > 0], runs(of[at[i:j]])[0]
        own = own[total[own] > 0]
        rows.append((g, int(bucket["kind"].iloc[0]), packed(np.diff(keys[pair], prepend=0)), packed(count[pair]),
                     packed(np.diff(phrase[own], prepend=0)), packed(total[own]), packed(kinds[own])))
    return pd.DataFrame(rows, columns=["g", "kind", "a", "b", "c", "d", "e"])


def known_phrases(known: pd.DataFrame) -> dict[int, Phrases]:
    """The phrases that came back to a group."""
    none, out = np.zeros(0, np.int64), {}
    for k in LENGTHS:
        rows = known[known["kind"] == k]
        keys, phrase = (np.concatenate([none, *[np.cumsum(unpacked(x)) for x in rows[c]]]) for c in "ac")
        count, total, kinds = (np.concatenate([none, *map(unpacked, rows[c])]) for c in "bde")
        keys, _, at = distinct(keys)                        # each is in one bucket
        phrase, _, own = distinct(phrase)
        out[k] = Phrases(k, keys, count[at], (phrase, total[own], kinds[own]))
    return out


def add_counts(bucket: pd.DataFrame) -> pd.DataFrame:
    """Summed training counts of a bucket's words, sent back to each group in its own order; a row of
    group -1 has the number of words seen in training and of their tokens."""
    words = [np.frombuffer(a, np.uint64) for a in bucket["a"]]
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(b, np.uint32) for b in bucket["b"]]), minlength=len(every))
    edge = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    rows = [(g, w.tobytes(), total[at[i:j]].astype(np.int64).tobytes(), 0, 0)
            for g, w, i, j in zip(bucket["g"].tolist(), words, edge[:-1], edge[1:])]
    rows.append((-1, b"", b"", int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(rows, columns=["g", "a", "b", "v", "n"])


def add_models(group: pd.DataFrame) -> pd.DataFrame:
    parts = [loosen(a) for a in group["a"]]
    counts, flat = sum(x[0] for x in parts), sum(x[1] for x in parts)
    return pd.DataFrame({"g": [int(group["g"].min()) // FAN], "a": [zlib.compress(counts.tobytes() + flat.tobytes(), 1)]})


def lm_scores(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords."""
    path, n = path or default_ranks(), buckets(docs)
    name = F.col(doc_id).cast("string")
    held = F.coalesce(F.pmod(F.crc32(name), F.lit(MODULUS)) == HELD, F.lit(False))
    # ids travel as strings: pandas would turn integers with nulls into floats
    d = docs.select(name.alias("doc_id"), text_or_empty(text).alias("text"), held.alias("held_out"))
    d = d.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    learnt = stash(d.groupBy("g").applyInPandas(learn_group(n, path), "kind int, bucket int, a binary, b binary, g int"), "lm-learnt")
    counted = stash(learnt.filter("kind = 0").groupBy("bucket").applyInPandas(
        add_counts, "g int, a binary, b binary, v long, n long"), "lm-counts")
    models, left = learnt.filter("kind = 1").select("g", "a"), n
    while left > 1:
        models = models.withColumn("to", F.floor(F.col("g") / FAN)).groupBy("to").applyInPandas(add_models, "g int, a binary")
        left = -(-left // FAN)
    model = models.first()                                   # bounded by the size of the tables
    counts, flat = loosen(model["a"]) if model else (np.zeros((3, SIZE * SIZE), np.int64), np.zeros(1))
    phrases = learnt.filter("kind > 1").groupBy("kind", "bucket").applyInPandas(
        add_phrases, "g int, kind int, a binary, b binary, c binary, d binary, e binary")
    words, tokens = counted.filter("g = -1").agg(F.sum("v"), F.sum("n")).first()
    ends = int(counts[2, SUBWORDS])                          # training documents
    v, total = (words or 0) + (ends > 0), (tokens or 0) + ends
    sent = docs.sparkSession.sparkContext.broadcast((averaged(flat), *values(counts)))

    def run(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        p, table, overall = sent.value
        model = (table, overall, known_phrases(known))
        known = known[known["kind"] == 0]
        pairs = (p["query"] @ p["key"].T).astype(np.float32)
        words = np.concatenate([np.frombuffer(a, np.uint64) for a in known["a"]] or [np.zeros(0, np.uint64)])
        count = np.concatenate([np.frombuffer(b, np.int64) for b in known["b"]] or [np.zeros(0, np.int64)])
        order = np.argsort(words)
        words, count = words[order], count[order]
        logs = np.log10((count + 1) / (total + v + 1))
        end = np.log10((ends + 1) / (total + v + 1))
        out, spelt = [], []
        for own, word, first, ids, sizes in spelt_blocks(group["text"].tolist(), path):
            at = np.searchsorted(words, own)
            log = logs[at][word]
            spelt.append((ids.astype(np.int16), sizes))
            run_known = np.concatenate([[0], np.cumsum((count[at] > 0)[word])])
            out.append(pd.DataFrame({
                "n_tokens": np.diff(first) + 1, "n_known": run_known[first[1:]] - run_known[first[:-1]] + (ends > 0),
                "base_score": [float(log[i:j].sum()) + end for i, j in zip(first[:-1], first[1:])],
                "n_subwords": sizes}))
        scored = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["n_tokens", "n_known", "base_score", "n_subwords"])
        score = [np.zeros(0)]
        for i in range(0, len(spelt), SCORED):
            ids, sizes = zip(*spelt[i:i + SCORED])
            score.append(score_ids(p, model, np.concatenate(ids), firsts(sizes), pairs))
        return scored.assign(score=np.concatenate(score), doc_id=group["doc_id"].to_numpy(), held_out=group["held_out"].to_numpy(), train_tokens=total)

    own = counted.filter("g >= 0").select("g", F.lit(0).alias("kind"), "a", "b").unionByName(phrases, allowMissingColumns=True)
    out = d.groupBy("g").cogroup(own.groupBy("g")).applyInPandas(
        run, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
             "score double, n_subwords long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
