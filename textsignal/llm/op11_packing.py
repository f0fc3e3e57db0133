"""Best-fit packing of tokenised documents by exact-complement hashing.

Method.  Every document is tokenised and cut into pieces of at most ``SIZE`` tokens; only the number of pieces of each
length (a table of at most ``SIZE`` rows, whatever the corpus holds) reaches the driver.  There the bins are planned
on counts: sums of single lengths, of pairs and of triples are indexed, and for the longest length left a combination
is looked up that fills the gap exactly (where none does, the longest length that fits goes in and the rest is looked
up again).  A combination is consumed as often as the counts of all its lengths allow, so each one uses up a length.
Several orders of consumption are planned (``VARIANTS``) and the one with the fewest bins is kept.
What has no exact filling goes best-fit, longest first, into the bin with the smallest sufficient gap.  The plan is a
short list of bin patterns with multiplicities.  The pieces are then numbered within their length, spread over buckets
of bounded size, and piece number r of a length takes the r-th place that the plan has for it.

Token ids are the library's.  White space always parts tokens in this vocabulary, so words between ASCII white space
are looked up in a bounded cache; a new word of printable ASCII and common Latin letters is parted by the vocabulary's
own pattern and given to the library's merge model, any other goes through the whole library, as does a text that holds
a special string.

Defined results: a null text is empty; an empty text is one piece that holds the end id alone.  Repeated rows and rows
without an id are documents of their own.  An empty table gives an empty result.  Other columns of the input, whatever
their names, are neither read nor returned.  Texts are tokenised whole, however long.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from textsignal.llm.common import stash, text_or_empty

SIZE = 4096            # tokens of a sequence (fixed by the contract)
END = 1                # id after every document (fixed by the contract)
CACHE = 600_000        # words a Python worker remembers before it starts anew
VARIANTS = ((3, True), (3, False), (2, False), (1, False))   # ways of consuming combinations; the fewest bins win
RANKED = 8192          # pieces of one length that are numbered in one bucket, about

#: Words of printable ASCII and of Latin letters that stay single characters in every step of the vocabulary.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
# The vocabulary's parts of such a word, after lower-casing.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-zß-öø-ſ0-9]+")


def byte_letters() -> dict[int, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(own)))}


BYTES = byte_letters()


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Ids of words, as little-endian unsigned 32-bit bytes; filled on demand."""

    def __init__(self, path: str, room: int = CACHE):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library, self.room, self.parts = Tokenizer.from_file(path), room, {}
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)).encode()) if added else None

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(BYTES)
            ids = self.parts[part] = array("I", [t.id for t in self.library.model.tokenize(spelt)]).tobytes()
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if word.isalpha():
            ids = self.part(text.lower())
        elif PLAIN.fullmatch(text):
            ids = b"".join(map(self.part, PARTS.findall(text.lower())))
        else:
            ids = self.whole(text)
        if len(word) <= 64:          # long words are rare and would fill the memory
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if self.special and self.special.search(text):
            return self.whole(text.decode())
        if len(self) > self.room or len(self.parts) > self.room:
            self.clear()
            self.parts.clear()
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def tokenised(docs: DataFrame, path: str, size: int, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    end = array("I", [END]).tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = words(path)
        for batch in batches:
            rows, held = [], 0
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = vocabulary.encode(data) + end
                for piece, lo in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[lo:lo + 4 * size]
                    row = (doc, piece, lo // 4, len(part) // 4, zlib.crc32(part))
                    rows.append(row + (np.frombuffer(part, "<i4"),) if keep_ids else row)
                held += len(ids)
                if held > 1 << 24 and keep_ids:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return own.mapInArrow(run, ddl)


class Sums:
    """Index of the sums of one, two and three lengths that still have pieces."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.size = counts, len(counts) - 1
        self.pair = np.full(self.size + 1, -1)       # the longer length of a pair, -1: not looked up, 0: none
        self.no_triple = np.zeros(self.size + 1, bool)

    def lengths(self, upto: int) -> np.ndarray:
        return np.flatnonzero(self.counts[:upto + 1])

    def pair_of(self, total: int) -> tuple[int, int] | None:
        """Two lengths in stock with this sum.  Counts only fall, so 'none' stays true."""
        a = int(self.pair[total])
        if a == 0:
            return None
        c = self.counts
        if a > 0 and c[a] and c[total - a] > (total == 2 * a):
            return a, total - a
        at = np.arange((total + 1) // 2, total)
        fits = at[(c[at] > 0) & (c[total - at] > (2 * at == total))]
        a = self.pair[total] = fits[-1] if len(fits) else 0
        return (int(a), total - int(a)) if a else None

    def exact(self, gap: int, most: int = 3) -> tuple[int, ...] | None:
        """At most ``most`` lengths in stock that fill the gap exactly, the longest first."""
        c = self.counts
        if c[gap]:
            return (gap,)
        found = self.pair_of(gap) if gap > 1 and most > 1 else None
        if found or gap < 3 or most < 3 or self.no_triple[gap]:
            return found
        first = self.lengths(gap - 2)
        for a in first[self.pair[gap - first] != 0][::-1].tolist():
            c[a] -= 1
            rest = self.pair[gap - a] != 0 and self.pair_of(gap - a)
            c[a] += 1
            if rest:
                return tuple(sorted((a, *rest), reverse=True))
        self.no_triple[gap] = True
        return None


def exact_bins(counts: np.ndarray, most: int = 3, longer: bool = True) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of full bins and how often each is used; ``counts`` keeps what none of them takes.  ``most`` lengths
    are looked up at once; ``longer`` patterns put in the longest length that fits where no combination fills."""
    size, sums, bins = len(counts) - 1, Sums(counts), []
    for length in range(size, 0, -1):
        while counts[length]:
            pattern, gap, full = [length], size - length, None
            counts[length] -= 1
            while gap and not (full := sums.exact(gap, most)):
                fits = sums.lengths(gap) if longer else ()
                if not len(fits):
                    break
                pattern.append(int(fits[-1]))        # no combination yet: the longest that fits, then look again
                counts[fits[-1]] -= 1
                gap -= int(fits[-1])
            for x in pattern:
                counts[x] += 1
            if gap and not full:
                break
            pattern += full or ()
            need = Counter(pattern)
            times = min(int(counts[x]) // n for x, n in need.items())
            if not times:                            # the combination needs a length more often than it is left
                break
            for x, n in need.items():
                counts[x] -= n * times
            bins.append((tuple(sorted(pattern, reverse=True)), times))
    return bins


def best_fit_bins(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal bins are handled together."""
    size = len(counts) - 1
    gaps, open_bins, done = [], {}, []

    def put(pattern: tuple[int, ...], times: int, gap: int) -> None:
        if not gap:
            done.append((pattern, times))
            return
        if gap not in open_bins:
            bisect.insort(gaps, gap)
            open_bins[gap] = []
        open_bins[gap].append((pattern, times))

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                most = size // length
                if left >= most:
                    put((length,) * most, left // most, size - most * length)
                if left % most:
                    put((length,) * (left % most), 1, size - left % most * length)
                break
            gap = gaps[at]
            pattern, times = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap], gaps[at]
            used = min(times, left)
            if times > used:
                put(pattern, times - used, gap)
            put(pattern + (length,), used, gap - length)
            left -= used
    return done + [b for gap in gaps for b in open_bins[gap]]


def plan(histogram: Mapping[int, int], size: int = SIZE) -> np.ndarray:
    """Places for the pieces of each length, as rows (length, first piece, pieces a round, first sequence, offset),
    sorted by length and first piece: piece r of a length belongs to the last row with first piece <= r, takes the
    sequence ``first sequence + (r - first) % pieces`` and lies ``(r - first) // pieces`` lengths after ``offset``."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    bins = None
    for most, longer in VARIANTS:
        left = counts.copy()
        tried = exact_bins(left, most, longer)
        tried += best_fit_bins(left)
        if bins is None or sum(n for _, n in tried) < sum(n for _, n in bins):
            bins = tried
    taken, sequence, rows = np.zeros(size + 1, np.int64), 0, []
    for pattern, times in bins:
        offset = 0
        for length, copies in Counter(pattern).items():
            rows.append((length, taken[length], times, sequence, offset))
            taken[length] += times * copies
            offset += length * copies
        sequence += times
    assert (taken == counts).all()
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placer(places: np.ndarray, biggest: int):
    """A Spark function (length, number within the length) -> (sequence_id, offset)."""
    step = biggest + 1
    keys = places[:, 0] * step + places[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        row = places[np.searchsorted(keys, length * step + number, side="right") - 1]
        round_, within = np.divmod(number - row[:, 1], row[:, 2])
        return pd.DataFrame({"sequence_id": row[:, 3] + within, "offset": row[:, 4] + round_ * length})
    return place


def numbered(pieces: DataFrame, histogram: Mapping[int, int]) -> DataFrame:
    """``pieces`` (with a unique ``row``) with ``number``: 0, 1, ... within each length.  A length that many pieces
    have is spread over buckets, numbered there, and moved up by the sizes of the buckets before."""
    many = {length: -(-n // RANKED) for length, n in histogram.items() if n > RANKED}
    spread: Column = F.lit(1)
    if many:
        of = F.create_map(*[F.lit(int(x)) for kv in many.items() for x in kv])     # at most SIZE entries
        spread = F.coalesce(F.element_at(of, F.col("length").cast("int")), F.lit(1))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), spread))
    sizes = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row"))
    return pieces.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn(
        "number", F.col("before") + F.col("inside") - 1).drop("inside", "before", "bucket")


def placed(pieces: DataFrame, size: int) -> DataFrame:
    pieces = stash(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= size rows
    place = placer(plan(histogram, size), max(histogram.values(), default=0))
    return numbered(pieces, histogram).withColumn("place", place("length", "number")).select(
        *[c for c in pieces.columns if c != "row"], "place.sequence_id", "place.offset")


def pack(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): the place of every piece."""
    return placed(tokenised(docs, tokenizer or default_tokenizer(), size, doc_id, text), size)


def sequences(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets): the packed sequences themselves; each holds at most ``size`` ids."""
    pieces = placed(tokenised(docs, tokenizer or default_tokenizer(), size, doc_id, text, keep_ids=True), size)
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.offset").alias("offsets"))
