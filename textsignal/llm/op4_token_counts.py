"""Token counts from a compiled finite-state transducer, without running the tokenizer.

Method.  A merge-based (BPE) piece vocabulary is compiled into a deterministic transducer over
characters.  The encoding of a prefix has a unique last piece: the piece ``w`` that ends there
and is compatible with the last piece ``p`` of the prefix before it, which means that the two
together encode to exactly ``[p, w]``.  What can matter later is bounded by the longest tail that
still begins some piece, so a state is that tail together with the last piece and the relative token
count at each position of the tail.  A transition is annotated with the number of tokens that it adds
(negative when pieces fuse); the sum over a text is its token count.  States and transitions are
compiled when first met and kept per Python worker (up to a bound, then compiled afresh).

Chunks.  No piece continues from a non-space to a space, from a Latin letter to another character, nor over
a character outside the vocabulary's alphabet (checked on the vocabulary), so a chunk that starts there has a constant state map: whatever
state enters, it starts afresh.  Such chunks are summarised once and looked up afterwards.  A longer
stretch is cut into pieces that run in order, each entered with the state the previous one left, so their
maps have that one entry; ``prefix_scan`` then only adds up known counts.

Defined results: null and empty texts have 0 tokens; repeated rows are counted one by one; ids may
be null or repeat; an empty table gives an empty result.  Whole texts are counted.  Other columns, whatever their
names, are neither read nor returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import text_or_empty
from textsignal.llm.pieces import SPACE, Pieces, default_model, pieces

TOKEN_LIMIT = 4096       # fixed by the contract
MAX_STATES = 250_000     # compiled states kept by a worker
MAX_CHUNKS = 500_000     # chunk summaries kept by a worker
LONG = 2048              # a stretch beyond this many characters is cut into several maps


class Transducer:
    """Deterministic transducer of a piece vocabulary: ``step[state][char] = (state, tokens added)``."""

    def __init__(self, vocabulary: Pieces):
        self.v = vocabulary
        self.heads = {p[:k] for p in vocabulary.scores for k in range(1, len(p))} | {""}
        self.fits: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        start = ("", ((None, 0),))
        self.keys, self.number, self.step = [start], {start: 0}, [{}]

    def merge(self, text: str) -> list[str]:
        """Plain merging by best score, leftmost first; only ever run on two adjacent pieces."""
        score, parts = self.v.scores, list(text)
        while True:
            at, best = -1, None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    at, best = i, s
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, p: str | None, w: str) -> bool:
        fit = self.fits.get((p, w))
        if fit is None:
            fit = self.fits[p, w] = self.merge(w) == [w] if p is None else self.merge(p + w) == [p, w]
        return fit

    def compile(self, state: int, char: str) -> tuple[int, int]:
        tail, last = self.keys[state]
        grown, last = tail + char, (*last, *[None] * (len(tail) + 1 - len(last)))
        for size in range(1, len(grown) + 1):
            w = grown[-size:]
            if (size == 1 or w in self.v.scores) and last[size - 1] and self.compatible(last[size - 1][0], w):
                break
        else:
            raise ValueError(f"no piece ends after {grown!r}")
        added = last[size - 1][1] + 1
        while grown and grown not in self.heads:
            grown = grown[1:]
        # a position counts only while the characters after it still begin some piece
        n = len(grown)
        key = (grown, ((w, 0), *[(x[0], x[1] - added) if x and grown[n - 1 - j:] in self.heads else None
                                 for j, x in enumerate(last[:n])]))
        if key not in self.number:
            self.number[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
        self.step[state][char] = out = (self.number[key], added)
        return out

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """The state map of ``text`` at one entry state: (exit state, tokens added)."""
        n, step, here = 0, self.step, self.step[state]
        for c in text:
            out = here.get(c)
            if out is None:
                if c in self.v.alphabet:
                    out = self.compile(state, c)
                else:                      # spelt as its bytes; nothing fuses across it
                    out = here[c] = (0, len(c.encode()))
            state, added = out
            here = step[state]
            n += added
        return state, n

    def chunk(self, text: str) -> int:
        """Tokens of a chunk that starts afresh."""
        n = self.chunks.get(text)
        if n is not None:
            return n
        if len(self.keys) > MAX_STATES:
            self.clear()
        marked = text.replace(" ", SPACE)
        if len(text) <= LONG:
            n = self.run(marked)[1]
        else:
            state, maps = 0, []
            for i in range(0, len(text), LONG):
                exit_state, n = self.run(marked[i:i + LONG], state)
                maps.append({state: (exit_state, n)})
                state = exit_state
            n = prefix_scan(maps)[-1][0][1]
        if len(text) <= 64:
            if len(self.chunks) >= MAX_CHUNKS:
                self.chunks.clear()
            self.chunks[text] = n
        return n


def compose(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The map of chunk ``a`` followed by chunk ``b``: entry -> (exit, tokens)."""
    return {s: (b[e][0], n + b[e][1]) for s, (e, n) in a.items()}


def prefix_scan(maps: list[dict[int, tuple[int, int]]]) -> list[dict[int, tuple[int, int]]]:
    """All prefixes' maps, in rounds of doubling reach; the compositions of a round are independent."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = [compose(out[i - reach], m) if i >= reach else m for i, m in enumerate(out)]
        reach *= 2
    return out


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(pieces(path))


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Token counts of whole texts.  The chunks of all texts have constant maps, for which the scan
    over the batch is a running sum; a text's count is its difference at the text's two ends."""
    t = transducer(path)
    find, known = t.v.segments.findall, t.chunks
    counts: list[int] = []
    ends = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            chunks = find(" " + text.replace(SPACE, " "))
            got = list(map(known.get, chunks))
            if None in got:
                got = [t.chunk(s) if n is None else n for s, n in zip(chunks, got)]
            counts += got
        ends[i + 1] = len(counts)
    scan = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    return scan[ends[1:]] - scan[ends[:-1]]


def token_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text",
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = path or default_model()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i:i + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": part["n_bytes"],
                                    "n_tokens": count_texts(part["text"].tolist(), path)})

    # ids travel as strings: pandas would turn integers with nulls into floats
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text_or_empty(text).alias("text"))
    own = own.withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = own.mapInPandas(count, "doc_id string, n_bytes long, n_tokens long")
    out = out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
