"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

Method.  The automaton holds every ordinary piece of the model.  One pass over the characters
yields, at each position, the pieces that end there (the automaton follows its output links); each
relaxes the best score of that position from the best score of the position where the piece starts.
The encoding is the segmentation with the largest sum of piece scores; of equal sums the one with the
longer last piece wins, recursively.  A character that ends no piece is spelt as its UTF-8 byte
pieces, at a penalty below every ordinary score.  Spaces become the model's space mark, with one
added in front; a literal space mark in a text is spelt as bytes, so decoding returns the text itself.

No piece continues from a non-space to a space or from a Latin letter to another character (checked on the
vocabulary), so the best segmentation splits there; such stretches are encoded once per worker (bounded table) and looked up afterwards.

Defined results: null and empty texts encode to no ids; very long texts and words are encoded whole;
repeated rows and null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import text_or_empty
from textsignal.llm.pieces import SPACE, Pieces, default_model, pieces

PENALTY = 10.0          # a byte-spelt character scores this much below the worst ordinary piece
MAX_KNOWN = 300_000     # stretches whose encoding a worker keeps


class Encoder:
    def __init__(self, vocabulary: Pieces):
        import ahocorasick
        self.v = vocabulary
        ordinary = [s for s in vocabulary.scores.values() if s > -1e8]
        self.unknown = min(ordinary, default=0.0) - PENALTY
        self.machine = ahocorasick.Automaton()
        for p, i in vocabulary.ids.items():
            self.machine.add_word(p, (len(p), vocabulary.scores[p], i))
        self.machine.make_automaton()
        self.known: dict[str, tuple[bytes, float]] = {}
        mark = SPACE.encode()
        self.spelling = [p.encode().replace(mark, b" ") for p in vocabulary.names]
        for b, i in enumerate(vocabulary.byte_ids):
            self.spelling[i] = bytes([b])

    def viterbi(self, text: str) -> tuple[list[int], float]:
        """Ids and score of a stretch; spaces stand as the space mark, a literal mark as U+FFFF."""
        n, dead = len(text), float("-inf")
        best, back = [0.0] + [dead] * n, [(0, -1)] * (n + 1)
        at = 0                         # positions up to here are final
        for end, (size, score, i) in self.machine.iter(text):
            end += 1
            while at < end - 1:
                at += 1
                if best[at] == dead:   # no piece ends here
                    best[at], back[at] = best[at - 1] + self.unknown, (1, -1)
            s = best[end - size] + score
            if s > best[end] or s == best[end] and size > back[end][0]:
                best[end], back[end] = s, (size, i)
        while at < n:
            at += 1
            if best[at] == dead:
                best[at], back[at] = best[at - 1] + self.unknown, (1, -1)
        out: list[int] = []
        while n:
            size, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                c = text[n - 1].replace("￿", SPACE)
                out.extend(self.v.byte_ids[b] for b in reversed(c.encode()))
            n -= size
        return out[::-1], best[-1]

    def stretch(self, text: str) -> tuple[bytes, float]:
        found = self.known.get(text)
        if found is None:
            ids, score = self.viterbi(text.replace(" ", SPACE))
            found = (np.array(ids, np.int32).tobytes(), score)
            if len(text) <= 64:
                if len(self.known) >= MAX_KNOWN:
                    self.known.clear()
                self.known[text] = found
        return found

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids of a whole text as packed int32, and its score."""
        if not text:
            return b"", 0.0
        if "￿" in text or SPACE in text:   # keep both literal: spell them as bytes
            return self._marked(text)
        cut = self.v.segments.findall(" " + text)
        parts = list(map(self.known.get, cut))
        if None in parts:
            parts = [self.stretch(s) if p is None else p for s, p in zip(cut, parts)]
        return b"".join([p[0] for p in parts]), sum([p[1] for p in parts])

    def _marked(self, text: str) -> tuple[bytes, float]:
        out, score, rest = [], 0.0, " " + text
        while rest:
            cut = min((k for k in (rest.find("￿"), rest.find(SPACE)) if k >= 0), default=len(rest))
            for s in self.v.segments.findall(rest[:cut]):
                ids, part = self.stretch(s)
                out.append(ids)
                score += part
            if cut < len(rest):
                out.append(np.array([self.v.byte_ids[b] for b in rest[cut].encode()], np.int32).tobytes())
                score += self.unknown
            rest = rest[cut + 1:]
        return b"".join(out), score

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of packed or listed ids: the added first space is taken off."""
        numbers = np.frombuffer(ids, np.int32) if isinstance(ids, bytes) else ids
        spelling = self.spelling
        return b"".join([spelling[i] for i in numbers.tolist()])[1:].decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(pieces(path))


def encode(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids, n_pieces, score, round_trip (decoding gives the text back),
    decoded_sha256 (of the decoded text)."""
    path = path or default_model()
    own = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = part.column(1).to_pylist()
                got = [e.encode(t) for t in texts]
                sizes = np.array([len(g[0]) // 4 for g in got], np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([g[0] for g in got]), np.int32)))
                back = [e.decode(g[0]) for g in got]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), ids, pa.array(sizes), pa.array([float(g[1]) for g in got], pa.float64()),
                    pa.array([x == t for x, t in zip(back, texts)], pa.bool_()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                ], names=["doc_id", "ids", "n_pieces", "score", "round_trip", "decoded_sha256"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_pieces long, score double, "
                               "round_trip boolean, decoded_sha256 string")


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` plus ``decoded``: the text of each row's ids (null ids: null)."""
    path = path or default_model()

    @F.pandas_udf("string")
    def text_of(column):
        e = encoder(path)
        return column.map(lambda x: None if x is None else e.decode(np.asarray(x, np.int64)))

    return rows.withColumn("decoded", text_of(F.col(ids)))
