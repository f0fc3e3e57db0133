"""Removal of repeated passages by suffix arrays that are built by induced sorting.

Every byte that a 200-byte string covers that also starts anywhere else (in any text, the same one
included) is removed.  Texts are UTF-8 bytes; matches stay inside a text.

Shards.  A window of 200 bytes has an *anchor*: the 48-byte gram in it with the least hash.  Equal windows
have equal anchors at the same offset, so a shard per anchor gram holds all windows that could be equal.
Consecutive windows of a text with the same anchor form a run; its context is the bytes they cover.

1. Runs go to buckets by gram, as hashes only.  A context that occurs twice is a repeat as a whole (this
   settles copies and the inside of long passages).  Each task sends one entry per context, with its
   number, and settles its own copies, so a hot passage sends at most one entry per task.  A gram with one
   context has no repeats.
2. Grams with several contexts of which some are unique stay open: the context's bytes are fetched and
   dealt to shards by gram.  A shard's text is its contexts behind separators.  Its suffixes are classified,
   leftmost-smaller substrings are sorted and named, the reduced string is ordered, and all suffixes
   are induced from it; permuted common prefixes with the two neighbours in the order tell which windows
   repeat.
3. A gram with more than SHARD_LIMIT open contexts (a passage in very many places) would be too large a
   shard.  Its windows are counted by hash instead, which pre-aggregates in every task: the exact way
   for the rest.
4. The windows found are gathered by text, merged to spans and cut out.

Equal texts are handled once and joined back.  Contexts, windows and texts are identified by 64-bit
hashes.  Defined results: null and empty texts have nothing to remove; a text shorter than 200 bytes never
loses a byte; every copy of a repeated row loses its repeated bytes (no copy is spared); null ids are kept;
an empty table gives an empty result.  Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import buckets, stash, text_or_empty
from textsignal.llm.suffixes import permuted_common_prefixes, suffix_array
from textsignal.llm.textarrays import _power, mixed

LENGTH = 200            # fixed by the contract
GRAM = 48               # bytes of an anchor
STEP = (LENGTH - GRAM) // 4     # a window holds a stretch of GRAM + 3 STEP bytes that starts 0, 1, 2 or 3 STEP before its anchor
SHARD_LIMIT = 4096      # open contexts of a gram that are sorted together
SHARD_BYTES = 2 << 20   # contexts of a shard, about
BATCH = 1 << 20         # bytes of texts that are worked on together
_POS = np.uint64((1 << 21) - 1)
RUN = np.dtype([("gram", "<u8"), ("context", "<u8"), ("unit", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("times", "<u2"),
                ("around", "<u4", (4,))])
FOUND = "unit long, lo long, n long, gram long, hot boolean"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, x.max(), x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def runs_of(raw: list[bytes], units: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The runs of windows of some texts, all of at least LENGTH bytes."""
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(r) for r in raw])
    first = np.concatenate([[0], np.cumsum(sizes)])
    up, down = _power(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * down[:len(data) - GRAM + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    # a minimum carries its place (leftmost of equal grams); places restart where a batch could not reach
    least = sliding_min((grams & ~_POS) | (at & _POS), LENGTH - GRAM + 1)
    anchor = (least & _POS).astype(np.int64) + (np.arange(len(least)) & ~int(_POS))
    anchor = np.where(anchor < np.arange(len(least)), anchor + int(_POS) + 1, anchor)
    text = np.repeat(np.arange(len(raw)), sizes)[:len(least)]
    inside = np.arange(len(least)) + LENGTH <= first[text + 1]
    start = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    lo = np.flatnonzero(start)
    last = np.concatenate([np.flatnonzero(inside & np.concatenate([start[1:] | ~inside[1:], [True]]))])
    out = np.zeros(len(lo), RUN)
    out["gram"] = grams[anchor[lo]]
    content = mixed((total[last + LENGTH] - total[lo]) * down[lo])
    out["context"] = mixed(content + np.uint64(1000003) * (anchor[lo] - lo).astype(np.uint64) + (last - lo).astype(np.uint64))
    out["unit"], out["lo"], out["n"], out["times"] = units[text[lo]], lo - first[text[lo]], last - lo + 1, times[text[lo]]
    p, begin, end = anchor[lo], first[text[lo]], first[text[lo] + 1]
    for k in range(4):
        a, b = p - k * STEP, p + GRAM + (3 - k) * STEP
        there = (a >= begin) & (b <= end)                # 0: no window of this text reaches so far
        a, b = np.where(there, a, 0), np.where(there, b, 0)
        out["around"][:, k] = np.where(there, mixed((total[b] - total[a]) * down[a]) >> np.uint64(32) | np.uint64(1), 0)
    return out


def meets(gram: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Contexts with one of the stretches around their gram in common with another one."""
    out = np.zeros(len(gram), bool)
    for k in range(4):
        key = gram.astype(np.uint64) << np.uint64(32) | around[:, k].astype(np.uint64)
        _, group, counts = np.unique(key, return_inverse=True, return_counts=True)
        out |= (counts[group] > 1) & (around[:, k] > 0)
    return out


def pack(keys: np.ndarray, rows: np.ndarray, base: int = 0) -> pd.DataFrame:
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    return pd.DataFrame({"bucket": (keys[edge[:-1]] + base).astype(np.int32),
                         "rows": [rows[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:])]})


def once(rows: np.ndarray, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one of each ``key`` (its times summed up to 2), and the others, whose key is repeated."""
    rows = rows[np.argsort(rows[key], kind="stable")]
    first = np.concatenate([[True], rows[key][1:] != rows[key][:-1]])
    group = np.cumsum(first) - 1
    total = np.minimum(np.bincount(group, rows["times"], minlength=group[-1] + 1 if len(group) else 0), 2)
    rows["times"] = total[group].astype(np.uint16)
    return rows[first], rows[~first]


def run_entries(docs: DataFrame, n: int) -> DataFrame:
    """Packed runs: entries to buckets below ``n`` by gram; repeats that a task settles itself beyond."""
    def send(ready: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        one, more = once(np.concatenate(ready), "context")
        yield pack((mixed(one["gram"]) % np.uint64(n)).astype(np.int64), one)
        if len(more):
            yield pack((mixed(more["unit"].view(np.uint64) if more["unit"].flags["C_CONTIGUOUS"] else
                              np.ascontiguousarray(more["unit"]).view(np.uint64)) % np.uint64(n)).astype(np.int64), more, n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = {}
        ready: list[np.ndarray] = []
        for b in batches:
            fresh: dict[int, list] = {}
            for unit, text in zip(b["unit"].tolist(), b["text"].tolist()):
                if unit in fresh:
                    fresh[unit][1] = 2
                elif seen.get(unit, 0) < 2:           # a second sight in another batch tells of the repeat
                    fresh[unit] = [text, 1]
                    seen[unit] = seen.get(unit, 0) + 1
            some, size = [], 0
            for unit, (text, times) in fresh.items():
                raw = text.encode()
                if len(raw) >= LENGTH:
                    some.append((raw, unit, times))
                    size += len(raw)
                    if size > BATCH:
                        ready.append(_runs(some))
                        some, size = [], 0
            if some:
                ready.append(_runs(some))
            if sum(map(len, ready)) > 1_000_000:
                yield from send(ready)
                ready = []
        if ready:
            yield from send(ready)

    return docs.select("unit", "text").mapInPandas(run, "bucket int, rows binary")


def _runs(some: list[tuple[bytes, int, int]]) -> np.ndarray:
    return runs_of([x[0] for x in some], np.array([x[1] for x in some], np.int64), np.array([x[2] for x in some]))


def settle(n: int):
    """A bucket's repeated runs, and its open ones with their gram."""
    def table(r: np.ndarray, gram: bool, hot=False) -> pd.DataFrame:
        return pd.DataFrame({"unit": r["unit"], "lo": r["lo"].astype(np.int64), "n": r["n"].astype(np.int64),
                             "gram": r["gram"].astype(np.uint64).view(np.int64) if gram else None, "hot": hot})

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        r = np.frombuffer(b"".join(bucket["rows"]), RUN)
        if bucket["bucket"].iloc[0] >= n:
            return table(r, False)
        r = r[np.lexsort((r["context"], r["gram"]))]
        new_gram = np.concatenate([[True], r["gram"][1:] != r["gram"][:-1]])
        new = new_gram | np.concatenate([[True], r["context"][1:] != r["context"][:-1]])
        context, gram = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
        repeated = (np.bincount(context, r["times"]) >= 2)[context]
        contexts = np.bincount(gram, new)                    # of each gram
        unique = np.bincount(gram, new & ~repeated)
        is_open = new & (contexts[gram] > 1) & (unique[gram] > 0)
        # contexts with a common window have one of the stretches around its gram in common, too
        at = np.flatnonzero(is_open)
        is_open[at] = meets(gram[at], r["around"][at])
        contexts = np.bincount(gram, is_open)
        return pd.concat([table(r[repeated], False), table(r[is_open], True, contexts[gram][is_open] > SHARD_LIMIT)])

    return run


def fetch(docs: DataFrame, open_runs: DataFrame) -> DataFrame:
    """The bytes of the open contexts: (gram, hot, unit, lo, bytes)."""
    wanted = open_runs.groupBy("unit").agg(F.collect_list(F.struct("gram", "hot", "lo", "n")).alias("runs"))
    some = docs.select("unit", "text").join(wanted, "unit").dropDuplicates(["unit"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for unit, text, runs in zip(b["unit"], b["text"], b["runs"]):
                raw = text.encode()
                out += [(r["gram"], r["hot"], unit, r["lo"], raw[r["lo"]:r["lo"] + r["n"] - 1 + LENGTH]) for r in runs]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=["gram", "hot", "unit", "lo", "bytes"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["gram", "hot", "unit", "lo", "bytes"])

    return some.mapInPandas(run, "gram long, hot boolean, unit long, lo long, bytes binary")


def as_runs(unit: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Windows (unit, place) as runs of consecutive places."""
    order = np.lexsort((at, unit))
    unit, at = unit[order], at[order]
    new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return pd.DataFrame({"unit": unit[first], "lo": at[first], "n": np.diff(np.concatenate([first, [len(at)]]))})


def sort_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """The windows of a shard's contexts that occur twice in it, from its suffix array."""
    raw = list(shard["bytes"])
    sizes = np.array([len(x) for x in raw])
    t = np.concatenate([np.frombuffer(b"\0".join(raw), np.uint8).astype(np.int64) + 2, [0]])
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t[first[1:] - 1] = 1                                      # separators
    sa = suffix_array(t, 258, LENGTH)
    common = permuted_common_prefixes(t, sa, LENGTH)
    most = common.copy()                                      # with either neighbour
    most[sa[:-1]] = np.maximum(most[sa[:-1]], common[sa[1:]])
    context = np.repeat(np.arange(len(raw)), sizes + 1)
    place = np.arange(len(context)) - first[context]
    hit = np.flatnonzero((most[:len(context)] >= LENGTH) & (place + LENGTH <= sizes[context]))
    return as_runs(shard["unit"].to_numpy()[context[hit]], shard["lo"].to_numpy()[context[hit]] + place[hit])


WINDOW = np.dtype([("hash", "<u8"), ("unit", "<i8"), ("at", "<u4"), ("times", "<u2")])


def hot_windows(contexts: DataFrame, n: int) -> DataFrame:
    """Windows of the grams with too many contexts, counted by hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2000):
                part, rows = b.iloc[i:i + 2000], []
                for unit, lo, raw in zip(part["unit"], part["lo"], part["bytes"]):
                    data = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
                    up, down = _power(len(data) + 1)
                    total = np.concatenate([[np.uint64(0)], np.cumsum(data * up[:len(data)])])
                    k = len(data) - LENGTH + 1
                    w = np.zeros(k, WINDOW)
                    w["hash"] = mixed((total[LENGTH:] - total[:-LENGTH]) * down[:k])
                    w["unit"], w["at"], w["times"] = unit, lo + np.arange(k), 1
                    rows.append(w)
                one, more = once(np.concatenate(rows), "hash")
                yield pack((mixed(one["hash"].copy()) % np.uint64(n)).astype(np.int64), one)
                if len(more):
                    yield pack((mixed(more["unit"].copy().view(np.uint64)) % np.uint64(n)).astype(np.int64), more, n)

    def settle_windows(bucket: pd.DataFrame) -> pd.DataFrame:
        w = np.frombuffer(b"".join(bucket["rows"]), WINDOW)
        if bucket["bucket"].iloc[0] < n:
            _, group = np.unique(w["hash"], return_inverse=True)
            w = w[(np.bincount(group, w["times"]) >= 2)[group]]
        return as_runs(w["unit"], w["at"].astype(np.int64))

    packed = contexts.select("unit", "lo", "bytes").mapInPandas(run, "bucket int, rows binary")
    return packed.groupBy("bucket").applyInPandas(settle_windows, "unit long, lo long, n long")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(unit, lo, n): runs of windows that occur anywhere else, for rows (unit, text)."""
    n = buckets(docs)
    runs = stash(run_entries(docs, n).groupBy("bucket").applyInPandas(settle(n), FOUND), "suffix-runs")
    contexts = stash(fetch(docs, runs.filter("gram is not null")), "suffix-contexts")
    size = contexts.filter("not hot").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 1
    sorted_ = contexts.filter("not hot").withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy(
        "shard").applyInPandas(sort_shard, "unit long, lo long, n long")
    return runs.filter("gram is null").select("unit", "lo", "n").union(sorted_).union(
        hot_windows(contexts.filter("hot"), n))


def cut(raw: bytes, lo: np.ndarray, n: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The kept bytes and the removed spans."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(lo[order] + n[order] - 1 + LENGTH)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    spans = list(zip(start[first].tolist(), end[np.concatenate([first[1:] - 1, [len(end) - 1]])].tolist()))
    kept, at = [], 0
    for lo_, hi_ in spans:
        kept.append(raw[at:lo_])
        at = hi_
    return b"".join([*kept, raw[at:]]), spans


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    t = text_or_empty(text)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("unit"), t.alias("text"))
    found = repeated_runs(own.filter(F.octet_length("text") >= LENGTH))
    per = found.groupBy("unit").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    touched = own.select("unit", "text").join(per, "unit").dropDuplicates(["unit"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for unit, text_, runs in zip(b["unit"], b["text"], b["runs"]):
                raw = text_.encode()
                kept, spans = cut(raw, np.array([r["lo"] for r in runs]), np.array([r["n"] for r in runs]))
                out.append((unit, len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["unit", "n_removed", "n_spans", "kept_sha256"])

    done = stash(touched.mapInPandas(run, "unit long, n_removed long, n_spans long, kept_sha256 string"), "suffix-cut")
    every = own.select("doc_id", "unit", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return every.join(done, "unit", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
