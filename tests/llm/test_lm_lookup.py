"""What the language model looks up once for many places (own rows)."""

from collections import Counter

import numpy as np
import pandas as pd

from textsignal.llm import op2_lm_scoring as lm
from textsignal.llm.textarrays import word_hashes

PATH = lm.default_ranks()


def _group():
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcde"), 3)) for _ in range(30)]
    return [" ".join(r.choice(words, n)) for n in (0, 1, 2, 3, 40, 7, 90, 60)]


def test_distinct_keys_of_any_size():
    for keys in (np.array([5, 2, 5, 9, 2], np.int64), np.array([2 ** 64 - 1, 7, 2 ** 63, 7], np.uint64), np.array([7], np.uint64), np.zeros(0, np.int64)):
        own, which, at = lm.distinct(keys)
        assert own.dtype == keys.dtype and own.tolist() == sorted(set(keys.tolist()))
        assert own[which].tolist() == keys.tolist() and keys[at].tolist() == own.tolist()
        assert at.tolist() == [keys.tolist().index(x) for x in own.tolist()]


def test_pairs_do_not_cross_texts():
    ids, first = lm.ids_of(_group(), PATH)
    want = np.zeros((3, lm.SIZE, lm.SIZE), np.int64)
    for i, j in zip(first[:-1], first[1:]):
        for t in range(i, j):
            want[2, 0, ids[t]] += 1
            for lag in range(1, min(lm.REACH, t - i) + 1):
                want[int(lag > 1), ids[t - lag], ids[t]] += 1
    assert (lm.pair_counts(ids, first).reshape(want.shape) == want).all()


def test_words_of_earlier_blocks_are_not_spelt_again(monkeypatch):
    texts, calls = _group(), []
    whole = lm.ids_of(texts, PATH)
    encoding = lm.subwords(PATH)

    class Counted:
        decode_single_token_bytes = staticmethod(encoding.decode_single_token_bytes)

        @staticmethod
        def encode_to_numpy(text):
            calls.extend(text.split())
            return encoding.encode_to_numpy(text)

    monkeypatch.setattr(lm, "subwords", lambda path: Counted)
    monkeypatch.setattr(lm, "blocks", lambda texts: ((i, i + 1) for i in range(len(texts))))
    ids, first = lm.ids_of(texts, PATH)
    assert len(calls) == len(set(calls)) == len({w for t in texts for w in t.split()})
    assert (ids == whole[0]).all() and (first == whole[1]).all()


def test_looked_up_mixture_is_that_of_each_place_alone():
    """The same attention and values as spelt out place by place, phrases and text starts included."""
    ids, first = lm.ids_of(_group(), PATH)
    counts = {k: lm.phrase_counts(ids, first, k) for k in lm.LENGTHS}
    model = (*lm.values(lm.pair_counts(ids, first)), {k: lm.Phrases(k, *x) for k, x in counts.items()})
    r = np.random.default_rng(4)
    p = {k: v + 0.1 * r.standard_normal(v.shape) for k, v in lm.start_parameters().items()}
    a, v, *_ = lm.mixture(p, lm.Lookup(model, ids, first), ids, first, np.arange(len(ids)))
    table, overall, _ = model
    for t in range(1, len(ids)):
        own = ids[first[np.searchsorted(first, t, side="right") - 1]:t][::-1][:lm.REACH].tolist()     # nearest first
        last, y = int(ids[t - 1]), int(ids[t])
        logits, value = [p["sink"][last]], [overall[y]]
        for d, c in enumerate(own):
            logits.append(p["query"][last] @ p["key"][c] + p["bias"][d])
            value.append(table[int(d > 0), c, y])
        lower = table[0, last, y]
        for k in lm.LENGTHS:
            if len(own) < k:
                continue
            phrase = sum(c * lm.SIZE ** d for d, c in enumerate(own[:k]))
            seen = {int(x % lm.SIZE): int(n) for x, n in zip(*counts[k]) if x // lm.SIZE == phrase}
            total = sum(seen.values())
            lower = (seen[y] - lm.DISCOUNT + lm.DISCOUNT * len(seen) * lower) / total
            logits.append(p[f"level{k}"][min(int(np.log2(total + 1)), lm.LEVELS - 1)])
            value.append(lower)
        e = np.exp(logits)
        assert np.isclose((a[t] * v[t]).sum(), (e / e.sum() * value).sum(), rtol=1e-4)


def test_steps_are_taken_over_the_ids_that_occur(monkeypatch):
    """Scores and gradients are as large as the ids that occur, with the parameters of a plain step over all ids."""
    ids, first = lm.ids_of(_group(), PATH)
    counts = {k: lm.phrase_counts(ids, first, k) for k in lm.LENGTHS}
    model = (*lm.values(lm.pair_counts(ids, first)), {k: lm.Phrases(k, *x) for k, x in counts.items()})
    sizes, mixture = [], lm.mixture

    def watched(p, known, ids, first, places, scores=None):
        sizes.append(scores.shape)
        return mixture(p, known, ids, first, places, scores)

    monkeypatch.setattr(lm, "mixture", watched)
    p = lm.start_parameters()
    power = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    lm.learn(p, power, model, ids, first)
    assert set(sizes) == {(len(np.unique(ids)),) * 2}
    want = lm.start_parameters()
    a, v, _, last, _ = mixture(want, lm.Lookup(model, ids, first), ids, first, np.arange(len(ids)))
    up = a * (v - (a * v).sum(axis=1, keepdims=True)) / (a * v).sum(axis=1, keepdims=True) / len(ids)
    g = {k: np.zeros_like(want[k]) for k in ("query", "key", "sink")}
    for t in range(len(ids)):
        g["sink"][last[t]] += up[t, 0]
        for d in range(min(lm.REACH, t)):
            c = ids[t - 1 - d]
            g["query"][last[t]] += up[t, 1 + d] * want["key"][c]
            g["key"][c] += up[t, 1 + d] * want["query"][last[t]]
    assert len(ids) <= lm.STEPS_OF
    for k, x in g.items():
        assert np.allclose(p[k], want[k] + lm.RATE * x / np.sqrt(x ** 2 + 1e-6), atol=1e-4)
        assert np.allclose(power[k], x ** 2 + 1e-6, rtol=1e-3)


def test_gram_counts_are_the_phrase_counts():
    ids, first = lm.ids_of(_group(), PATH)
    got = lm.gram_counts(*lm.distinct(lm.grams(ids, lm.SIZE))[:2], first)
    for k in lm.LENGTHS:
        assert [x.tolist() for x in got[k]] == [x.tolist() for x in lm.phrase_counts(ids, first, k)]
    for size in (0, 1, 2, 5, 20):
        own = ids[:size]
        assert lm.grams(own, 1000, 6).tolist() == [sum(int(own[t - d]) * 1000 ** d for d in range(min(6, t + 1))) for t in range(size)]


def test_keys_that_share_their_leading_bits_stay_apart():
    keys = np.array([2 ** 63, 2 ** 63 + 1, 2 ** 63, 5, 4, 2 ** 64 - 1], np.uint64)
    own, which, at = lm.distinct(keys)
    assert own.tolist() == sorted(set(keys.tolist())) and own[which].tolist() == keys.tolist() and at.tolist() == [4, 3, 0, 1, 5]


def test_packed_numbers_come_back():
    for numbers in ([], [0, 0], [1, 255, 256], [2 ** 62, 0, 3]):
        assert lm.unpacked(lm.packed(np.array(numbers, np.int64))).tolist() == numbers
    assert len(lm.packed(np.arange(200))) < 300


def test_no_word_of_a_group_is_spelt_twice(monkeypatch):
    """Held-out texts and training texts share what is spelt."""
    texts, calls, encoding = _group(), [], lm.subwords(PATH)

    class Counted:
        decode_single_token_bytes = staticmethod(encoding.decode_single_token_bytes)

        @staticmethod
        def encode_to_numpy(text):
            calls.extend(text.split(" ")[1:])
            return encoding.encode_to_numpy(text)

    monkeypatch.setattr(lm, "subwords", lambda path: Counted)
    group = pd.DataFrame({"text": [t.replace(" ", "\t", 1) for t in texts], "held_out": [i % 3 == 0 for i in range(len(texts))], "g": 0})
    out = lm.learn_group(4, PATH)(group)
    assert sorted(calls) == sorted({w for t in texts for w in t.split()})
    sent = {int(w): int(c) for a, b in out[out["kind"] == 0][["a", "b"]].to_numpy()
            for w, c in zip(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint32))}
    want = Counter(int(h) for i, t in enumerate(texts) if i % 3 for h in word_hashes([t])[0])
    assert {w: c for w, c in sent.items() if c} == dict(want) and len(sent) == len(calls)
