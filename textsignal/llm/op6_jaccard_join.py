"""N-gram Jaccard self-join in the metric space of the Jaccard distance.

Documents are sets of distinct five-word shingles (64-bit hashes); two link when
``100 * intersection >= 75 * union``, that is at a distance of at most TAU = 1/4.  Equal texts are one
element from the start.

Regions.  Almost all distances between documents are exactly 1, so document pivots alone would
replicate everything everywhere.  The first pivots are therefore single shingles, in a fixed global order
(frequent ones last): a document's home is its first shingle, and its window is the prefix of shingles
that any document within TAU must meet: the first ``size - ceil(3/4 size) + 1``.  A document is
replicated to the regions of its window and nowhere else.  Regions with the same members are one.

Sketches (parities of the numbers of shingles by some of their bits) carry a metric of their own: with ``x`` the larger of their Hamming
distance and the difference of the sizes, ``2 x / (a + b + x)`` is a metric and never more than the Jaccard distance: each bit
that differs takes a shingle that only one set has.
All regions are split and searched in that metric, inside tasks that hold sketches only:

* the members of a region within TAU of its first member are linked with it, if their sets confirm it;
* a region with more than CELL members that still holds several components is split around drawn document pivots: a member
  within RADIUS of its nearest pivot goes to that Voronoi cell; it, and every other member, is replicated to each further
  cell within the triangle window (``d(x, p) <= RADIUS + TAU``, and for members with a cell of their own ``<= d(x, own
  pivot) + 2 TAU``); what is near no pivot stays an outer region.  This recurs (DEPTH) while regions are larger than CELL;
  a region that the pivots don't divide (near copies of one text: each is near every pivot, so that each cell would be the region
  again) is not copied to cells, but compared in blocks: CELL members, and the members that seek partners in all blocks;
* inside a cell members seek partners of other components, best bound first: one each, then BEST more, then all that the bound
  allows.  The candidates are compared exactly by their sets; found links join components, and only pairs of different
  components are sought further.  Links inside one found component can't change any component and are not sought.

Components come from alternating star steps.

Order.  Any order gives the same links.  It comes from counts over all documents of the shingles' leading
32 bits, which tasks send packed and summed up; the HOT_LIST largest counts (a fixed bound) from FREQUENT
on go last, by count, so that a passage shared by many documents opens no large region.

Defined results: null, empty and blank texts have no shingles and are linked with nothing, not
even each other; a text of fewer than five words has the whole sequence as its shingle; repeated rows and
equal texts share a component; a null id never names a component that has another id; an empty
table gives an empty result.  Other columns, whatever their names, are not read; ``one_of_each`` returns whole rows
as they came.  Shingles and texts are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import TEXTS, WORD, buckets, stash, text_or_empty
from textsignal.llm.components import components
from textsignal.llm.textarrays import blocks, mixed, shingle_sets

WORDS = 5              # fixed by the contract
TAU = 0.25             # distance of a similarity of 0.75 (fixed by the contract)
CELL = 2048            # members of a region that one task compares
PIVOTS = 16            # document pivots of a larger region
RADIUS = 0.35          # largest distance from a cell's pivot to its own members
DEPTH = 3              # levels of cells; larger regions are then compared in blocks
SEEKING = 16_384       # members that seek partners in one block at once
BEST = (1, 8, None)    # partners that a member seeks in each round; the last round seeks all
HELD = 500_000         # shingles or entries that a task gathers before it packs them
FREQUENT = 4
HOT_LIST = 1 << 20
SKETCH = 256           # bytes of a set's sketch
PAIRED = 48            # up to this many members a region's pairs are checked by place
FEW_UNITS = 4_000_000  # so many wanted units (64 MB) are broadcast, so that only their texts are shuffled; beyond, all texts are
MORE = np.dtype([("key", "<u4"), ("n", "<u2")])
ENTRY = np.dtype([("s", "<u8"), ("unit", "<i8"), ("size", "<u4"), ("place", "<u2")])


def units_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = text_or_empty(text)
    # ids travel as strings: pandas would turn integers with nulls into floats
    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.xxhash64(t).alias("unit"), t.alias("text"))


def census(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, unit, n_shingles, sketch) of all documents, and packed shingle counts for ``n``
    buckets.  A sketch holds the parities of the numbers of a set's shingles by some of their bits; a task sends that
    of equal texts once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        kept: list[np.ndarray] = []
        for b in batches:
            texts, units = b["text"].tolist(), b["unit"].to_numpy()
            sizes, sketches = np.zeros(len(b), np.int64), [None] * len(b)
            for lo, hi in blocks(texts):
                sets = shingle_sets(texts[lo:hi], WORDS)
                sizes[lo:hi] = [len(s) for s in sets]
                fresh = [i for i in range(hi - lo) if units[lo + i] not in seen and not seen.add(units[lo + i])]
                kept += [sets[i] for i in fresh]
                for i in fresh:
                    sketches[lo + i] = sketch(sets[i])
                if sum(map(len, kept)) > HELD:
                    yield _counts(kept, n)
                    kept = []
            yield pd.DataFrame({"doc_id": b["doc_id"], "unit": units, "n_shingles": sizes, "sketch": sketches}).assign(bucket=None, steps=None, more=None)
        if kept:
            yield _counts(kept, n)

    return docs.mapInPandas(run, "doc_id string, unit long, n_shingles long, sketch binary, bucket int, steps binary, more binary")


def sketch(shingles: np.ndarray) -> bytes:
    # the bits after those that order the windows' prefixes: what the documents of a region share there says nothing
    counts = np.bincount(((shingles >> np.uint64(20)) % np.uint64(8 * SKETCH)).astype(np.int64), minlength=8 * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


FAR = 65535            # a step that leads to no key


def _counts(sets: list[np.ndarray], n: int) -> pd.DataFrame:
    """The leading 32 bits of the shingles of some sets, by bucket (a range of them): the sorted distinct
    keys as 16-bit steps, and the keys seen more than once with their further counts."""
    keys, counts = np.unique(np.concatenate(sets) >> np.uint64(32), return_counts=True)
    edges = np.searchsorted(keys, (np.arange(n + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n))
    rows = []
    for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if j > i:
            step = np.diff(keys[i:j].astype(np.int64), prepend=(b << 32) // n)
            far, rest = np.divmod(step, FAR)
            out = np.full(len(step) + int(far.sum()), FAR, np.uint16)
            out[np.cumsum(far + 1) - 1] = rest
            many = counts[i:j] > 1
            more = np.empty(int(many.sum()), MORE)
            more["key"], more["n"] = keys[i:j][many], np.minimum(counts[i:j][many] - 1, 65535)
            rows.append((b, out.tobytes(), more.tobytes()))
    none = {c: None for c in ("doc_id", "unit", "n_shingles", "sketch")}
    return pd.DataFrame(rows, columns=["bucket", "steps", "more"]).assign(**none)


def frequent_keys(n: int):
    """A bucket's summed counts: the largest from FREQUENT on (all buckets together keep HOT_LIST)."""
    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        b = int(bucket["bucket"].iloc[0])
        parts = []
        for raw in bucket["steps"]:
            step = np.frombuffer(raw, np.uint16).astype(np.int64)
            parts.append(((b << 32) // n + np.cumsum(step))[step != FAR])
        more = np.frombuffer(b"".join(bucket["more"]), MORE)
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        counts = counts + np.bincount(np.searchsorted(keys, more["key"]), more["n"], minlength=len(keys)).astype(np.int64)
        best = np.lexsort((keys, -counts))[:HOT_LIST // n]
        best = best[counts[best] >= FREQUENT]
        return pd.DataFrame({"keys": [keys[best].astype(np.uint32).tobytes()], "counts": [counts[best].tobytes()]})

    return run


def prefix_length(size: int) -> int:
    return size - (3 * size + 3) // 4 + 1


def window(shingles: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The prefix of a sorted set: rare shingles by hash, then the frequent ones (``hot`` has their sorted
    keys and counts) from the least frequent."""
    n = prefix_length(len(shingles))
    keys, counts = hot
    if len(keys):
        lead = (shingles >> np.uint64(32)).astype(np.uint32)
        at = np.searchsorted(keys, lead)
        at[at == len(keys)] = 0
        found = keys[at] == lead
        if found.any():
            late = shingles[found][np.argsort(counts[at[found]], kind="stable")]
            return np.concatenate([shingles[~found], late])[:n]
    return shingles[:n]


def entries(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], n: int) -> DataFrame:
    """Packed (shingle, unit, size) entries of all windows, dealt to ``n`` buckets by shingle."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        ready: list[np.ndarray] = []
        for b in batches:
            texts, units = b["text"].tolist(), b["unit"].tolist()
            for lo, hi in blocks(texts):
                fresh = [i for i in range(lo, hi) if units[i] not in seen and not seen.add(units[i])]
                for i, s in zip(fresh, shingle_sets([texts[i] for i in fresh], WORDS)):
                    if len(s):
                        w = window(s, sent.value)
                        e = np.empty(len(w), ENTRY)
                        e["s"], e["unit"], e["size"] = w, units[i], len(s)
                        e["place"] = np.minimum(np.arange(len(w)), 65535)
                        ready.append(e)
                if sum(map(len, ready)) > HELD:
                    yield packed(ready, n)
                    ready = []
        if ready:
            yield packed(ready, n)

    return docs.select("unit", "text").mapInPandas(run, "bucket int, entries binary")


def packed(ready: list[np.ndarray], n: int) -> pd.DataFrame:
    e = np.concatenate(ready)
    to = (mixed(e["s"]) % np.uint64(n)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    e, to = e[order], to[order]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
    return pd.DataFrame({"bucket": to[at[:-1]], "entries": [e[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]})


def regions(bucket: pd.DataFrame) -> pd.DataFrame:
    """The regions of a bucket with two members or more: rows (region, unit, size, pivot, pivot_size).
    A region's name is a hash of its members, so equal regions of all buckets become one."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("region", "unit", "size", "pivot", "pivot_size")})
    e = np.frombuffer(b"".join(bucket["entries"]), ENTRY)
    e = e[np.lexsort((e["unit"], e["s"]))]
    fresh = np.concatenate([[True], (e["s"][1:] != e["s"][:-1]) | (e["unit"][1:] != e["unit"][:-1])])
    e = e[fresh]                                   # equal texts come from many tasks
    edge = np.flatnonzero(np.concatenate([[True], e["s"][1:] != e["s"][:-1], [True]]))
    sizes = np.diff(edge)
    many = sizes > 1
    if not many.any():
        return empty
    keep = np.repeat(many, sizes)
    e, sizes = e[keep], sizes[many]
    viable = in_reach(e, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)[viable]
    e, sizes = e[viable], np.bincount(group, minlength=len(sizes))
    sizes = sizes[sizes > 0]
    if not len(e):
        return empty
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    name = np.add.reduceat(mixed(e["unit"].view(np.uint64)), first) + sizes.astype(np.uint64)
    _, one = np.unique(name, return_index=True)
    chosen = np.zeros(len(sizes), bool)
    chosen[one] = True
    rows = np.repeat(chosen, sizes)
    pivot = np.repeat(first, sizes)
    return pd.DataFrame({"region": np.repeat(name.view(np.int64), sizes)[rows], "unit": e["unit"][rows],
                         "size": e["size"][rows].astype(np.int64), "pivot": e["unit"][pivot][rows],
                         "pivot_size": e["size"][pivot][rows].astype(np.int64)})


def in_reach(e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Members that have a partner in their region for which this could be the first common shingle: what
    follows in both sets must suffice for the overlap ``3/7 (a + b)`` that a similarity of 3/4 needs.
    A pair that fails here is found in the region of its first common shingle, or is no link."""
    out = np.ones(len(e), bool)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for lo, m in zip(first[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist()):
        out[lo:lo + m] = in_reach_of_any(e["size"][lo:lo + m].astype(np.int64), e["place"][lo:lo + m])
    for m in np.unique(sizes[sizes <= PAIRED]):
        starts = first[sizes == m]
        for lo in range(0, len(starts), max(1, (1 << 20) // int(m * m))):
            at = starts[lo:lo + max(1, (1 << 20) // int(m * m)), None] + np.arange(m)
            size = e["size"][at].astype(np.int64)
            rest = size - e["place"][at]
            need = 3 * (size[:, :, None] + size[:, None, :])
            pair = (7 * np.minimum(rest[:, :, None], rest[:, None, :]) >= need) & ~np.eye(m, dtype=bool)
            out[at] = pair.any(axis=2)
    return out


def in_reach_of_any(size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """``in_reach`` for one region of any size: by size, the members that one could pair with come first, and the largest of
    their own limits tells if one of them could pair with it."""
    order = np.argsort(size, kind="stable")
    own = 3 * size[order]
    limit = 7 * (size - place)[order] - own              # three times the largest partner
    most = np.maximum.accumulate(limit)
    second = np.maximum.accumulate(np.minimum(limit, np.concatenate([[np.iinfo(np.int64).min], most[:-1]])))
    n = np.searchsorted(own, limit, side="right")
    at = np.maximum(n - 1, 0)
    other = np.where((own <= limit) & (limit == most[at]), second[at], most[at])   # of the others
    out = np.empty(len(size), bool)
    out[order] = (n > 0) & (other >= own)
    return out


def lows(sketches: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """The sketch metric of all ``sketches`` against all ``others``: a lower bound of the Jaccard distance."""
    x = np.empty((len(sizes), len(other_sizes)), np.int64)
    step = max(1, (1 << 20) // max(1, others.size))
    for lo in range(0, len(sizes), step):
        x[lo:lo + step] = np.bitwise_count(sketches[lo:lo + step, None] ^ others[None]).sum(axis=2, dtype=np.int64)
    x = np.maximum(x, np.abs(sizes[:, None] - other_sizes[None]))
    return 2 * x / (sizes[:, None] + other_sizes[None] + x)


def unpacked(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint64).reshape(-1, SKETCH // 8)


PAIR = "a long, b long"


def paired(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    a, b = np.concatenate(a), np.concatenate(b)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def by_region(members: DataFrame) -> DataFrame:
    """The members of each region in one task.  They are dealt by a hash of the region's name: a plain ``repartition("region")`` after a
    join by region would be optimized away, and the join may then become a broadcast one that leaves the members where they are."""
    return members.repartition(F.xxhash64("region"))


def around_first(members: DataFrame) -> DataFrame:
    """Candidates between the first member of a region, its pivot, and the others; a task keeps no more than the pivot of the
    region that it reads."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        region = unit = size = sketch = None
        for b in batches:
            k, sizes, units, regions = unpacked(b["sketch"]), b["size"].to_numpy(), b["unit"].to_numpy(), b["region"].to_numpy()
            if region is not None:                # the pivot of the region that goes on
                k, sizes = np.concatenate([sketch, k]), np.concatenate([size, sizes])
                units, regions = np.concatenate([unit, units]), np.concatenate([region, regions])
            starts = np.flatnonzero(np.concatenate([[True], regions[1:] != regions[:-1]]))
            pivot = np.repeat(starts, np.diff(np.append(starts, len(units))))
            x = np.bitwise_count(k ^ k[pivot]).sum(axis=1, dtype=np.int64)
            x = np.maximum(x, np.abs(sizes - sizes[pivot]))
            near = (7 * x <= sizes + sizes[pivot]) & (pivot != np.arange(len(units)))
            if near.any():
                yield paired([units[near]], [units[pivot[near]]])
            last = slice(starts[-1], starts[-1] + 1)
            region, unit, size, sketch = regions[last], units[last], sizes[last], k[last]

    order = ["region", "unit"]
    return by_region(members.select(*order, "size", "sketch")).sortWithinPartitions(*order).mapInPandas(run, PAIR)


def candidates(members: DataFrame, best: int | None) -> DataFrame:
    """Candidates between members of different components in one cell, at least one of them at home there; each member gives its
    ``best`` ones (all if None).  Members of the cell's largest component need no turn of their own; in a block (side 1) the members
    that seek come beside it (side 2)."""
    def pairs_of(k, sizes, units, comps, home, side):
        if side.any():
            of, seek, there = comps, np.flatnonzero(side == 2), np.flatnonzero(side == 1)
        else:
            _, of, counts = np.unique(comps, return_inverse=True, return_counts=True)
            seek, there = np.flatnonzero(of != counts.argmax()), np.arange(len(units))
        seek, there = (x[np.argsort(sizes[x], kind="stable")] for x in (seek, there))
        for lo in range(0, len(seek), 256):
            at = seek[lo:lo + 256]
            near = slice(*np.searchsorted(sizes[there], [sizes[at[0]] * (1 - TAU) - 1, sizes[at[-1]] / (1 - TAU) + 1]))
            to = there[near]                             # sizes of others are beyond TAU
            d = lows(k[at], sizes[at], k[to], sizes[to])
            ok = (d <= TAU + 1e-9) & (of[at][:, None] != of[to][None]) & (home[at][:, None] | home[to][None])
            if best is not None and len(to) > best:
                d = np.where(ok, d, 2.0)
                ok &= d <= np.partition(d, best - 1, axis=1)[:, best - 1:best]
                ok &= np.cumsum(ok, axis=1) <= best
            i, j = np.nonzero(ok)
            if len(i):
                yield units[at[i]], units[to[j]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out, n = None, ([], []), 0
        for b in _ended(batches):
            if b is None:
                now = rest
            else:
                now = [unpacked(b["sketch"]), *[b[c].to_numpy() for c in ("size", "unit", "component", "home", "side", "region")]]
                now = now if rest is None else [np.concatenate(p) for p in zip(rest, now)]
            if now is None:
                break
            region = now[-1]
            edges = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
            whole = edges if b is None else edges[:-1]       # the last region may go on
            for lo, hi in zip(whole[:-1].tolist(), whole[1:].tolist()):
                for i, j in pairs_of(*[c[lo:hi] for c in now[:-1]]):
                    out[0].append(i)
                    out[1].append(j)
                    n += len(i)
            rest = [c[whole[-1]:] for c in now]
            if n > 50_000:
                yield paired(*out)
                out, n = ([], []), 0
        if n:
            yield paired(*out)

    return by_region(members).sortWithinPartitions("region").mapInPandas(run, PAIR)


def _ended(batches):
    yield from batches
    yield None


CELLS = "region long, unit long, size long, component long, sketch binary, home boolean"
MEMBER = ["region", "unit", "size", "component", "sketch", "home"]


def single_cells(m: DataFrame) -> DataFrame:
    """Regions that are one cell each."""
    return m.withColumn("home", F.lit(True)).withColumn("side", F.lit(0))


def cells(m: DataFrame) -> DataFrame:
    """The members of regions of at most CELL members, with ``home`` and ``side``; larger regions are split into Voronoi cells, and
    what these don't divide into blocks."""
    m = m.withColumn("home", F.lit(True))
    small, large = [], []
    for depth in range(DEPTH):
        sizes = m.groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
        sizes = stash(sizes, "jaccard-large")
        if not sizes.limit(1).count():
            break
        small.append(m.join(sizes, "region", "left_anti"))
        near = stash(near_pivots(m.join(sizes, "region"), depth), "jaccard-near")
        split = stash(divided(near, sizes), "jaccard-divided")
        large.append(near.join(split, "region", "left_anti").select(*MEMBER))
        m = stash(voronoi(near.join(split, "region", "left_semi"), depth), "jaccard-cells")
    large.append(m)
    out = in_blocks(united(large))
    return out if not small else out.unionByName(united(small).withColumn("side", F.lit(0)))


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_blocks(m: DataFrame) -> DataFrame:
    """Regions of up to CELL members as they are (side 0).  Of a larger one each block holds about CELL of its members (side 1) and, at most
    SEEKING at once, those outside the region's largest component, which seek partners there (side 2): other pairs are not sought."""
    each = m.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    of = each.groupBy("region").agg(F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("seeking"),
                                    F.max_by("component", F.struct("n", "component")).alias("largest")).filter(F.col("n") > CELL)
    of = stash(of.select("region", "largest", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"),
                         F.ceil(F.col("seeking") / SEEKING).cast("int").alias("turns")), "jaccard-blocks")
    big = m.join(of.filter("turns > 0"), "region")
    dealt = lambda name, into: F.pmod(F.xxhash64("unit", F.lit(name)), F.col(into)).cast("int")
    every = lambda into: F.explode(F.sequence(F.lit(0), F.col(into) - 1))
    there = big.withColumn("block", dealt("block", "blocks")).withColumn("turn", every("turns")).withColumn("side", F.lit(1))
    seek = big.filter("component != largest").withColumn("turn", dealt("turn", "turns")).withColumn("block", every("blocks")).withColumn("side", F.lit(2))
    split = there.unionByName(seek).withColumn("region", F.xxhash64("region", "block", "turn")).select(*MEMBER, "side")
    return m.join(of, "region", "left_anti").withColumn("side", F.lit(0)).unionByName(split)


def near_pivots(m: DataFrame, depth: int) -> DataFrame:
    """The members (with ``n``, the size of their region), each with its ``own`` cell and all ``cells`` that it is replicated to: those of
    about PIVOTS pivots drawn per region, and the outer region (-1)."""
    few = F.pmod(F.xxhash64("unit", "region", F.lit(depth)), F.greatest(F.lit(1), F.floor(F.col("n") / (2 * PIVOTS)))) == 0
    drawn = m.filter(few & F.col("home")).groupBy("region").agg(F.slice(F.array_sort(F.collect_list(F.struct(
        "unit", "size", "sketch"))), 1, PIVOTS).alias("p"), F.first("n").alias("n"))             # about 2 PIVOTS are drawn
    salts = F.ceil(F.col("n") / CELL)
    drawn = drawn.select(F.col("region").alias("of"), F.col("p.size").alias("p_size"), F.col("p.sketch").alias("p_sketch"),
                         F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))).alias("part"))
    m = m.withColumn("salt", F.pmod(F.xxhash64("unit"), salts).cast("int"))

    def run(part: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        part = part[MEMBER]
        if not len(part) or not len(pivots):
            return part.assign(own=-1, cells=[[-1]] * len(part))
        home, p = part["home"].to_numpy(bool), pivots.iloc[0]
        d = lows(unpacked(part["sketch"]), part["size"].to_numpy(), unpacked(p["p_sketch"]), np.asarray(p["p_size"], np.int64))
        near, own = d.min(axis=1), d.argmin(axis=1)
        inside = near <= RADIUS
        reach = np.where(inside, np.minimum(near + 2 * TAU, RADIUS + TAU), RADIUS + TAU) + 1e-9
        # members that are at home elsewhere may have a partner in the outer region, which finds them nowhere else
        outer = ~inside | (~home & (near > RADIUS - TAU - 1e-9))
        at, cell = np.nonzero(np.column_stack([outer, d <= reach[:, None]]))
        lists = np.split(cell - 1, np.cumsum(np.bincount(at, minlength=len(part)))[:-1])
        return part.assign(own=np.where(inside, own, -1), cells=lists)

    return m.groupBy("region", "salt").cogroup(drawn.groupBy("of", "part")).applyInPandas(run, CELLS + ", own int, cells array<int>")


def divided(near: DataFrame, sizes: DataFrame) -> DataFrame:
    """The regions whose cells hold at most half of their pairs, and so less than three rows of each member on average."""
    each = near.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count(F.lit(1)).cast("double").alias("k"))
    after = each.groupBy("region").agg(F.sum(F.col("k") * F.col("k")).alias("pairs"))
    return after.join(sizes, "region").filter(2 * F.col("pairs") <= F.col("n") * F.col("n").cast("double")).select("region")


def voronoi(near: DataFrame, depth: int) -> DataFrame:
    """The members in their cells: at home in their own one, or in the outer region if they have none."""
    m = near.withColumn("cell", F.explode("cells"))
    return m.withColumn("home", F.col("home") & (F.col("cell") == F.col("own"))).withColumn(
        "region", F.xxhash64("region", F.lit(depth), "cell")).select(*MEMBER)


def only(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted units, which are broadcast where they are few, so that no other row is shuffled."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW_UNITS else wanted, "unit", "left_semi")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, shingles) of the wanted units (a stashed table), read again from their texts."""
    some = only(docs.select("unit", "text"), wanted).dropDuplicates(["unit"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for lo, hi in blocks(texts, 1 << 20):
                yield pd.DataFrame({"unit": b["unit"].iloc[lo:hi].to_numpy(),
                                    "shingles": [s.view(np.int64) for s in shingle_sets(texts[lo:hi], WORDS)]})

    return some.mapInPandas(run, "unit long, shingles array<long>")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, both) of the pairs: exact sizes of the intersection and the union."""
    side = lambda c: sets.select(F.col("unit").alias(c), F.col("shingles").alias(f"s{c}"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - F.col("common")).alias("both"))


def linked(d: DataFrame) -> DataFrame:
    return d.filter(100 * F.col("common") >= 75 * F.col("both")).select("a", "b")


def labelled(members: DataFrame, joined: DataFrame) -> DataFrame:
    label = joined.select(F.col("node").alias("unit"), "component")
    return members.join(label, "unit", "left").withColumn("component", F.coalesce("component", "unit"))


def still_open(m: DataFrame) -> DataFrame:
    """(region, n): regions whose ``n`` members belong to several components."""
    return m.groupBy("region").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter(
        "lo < hi").select("region", "n")


def grown(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: those found before enter as stars, which join the same units by fewer
    links and in fewer rounds."""
    stars = joined.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(stars.union(links))


def unit_components(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """(node, component) of all units that are linked with others."""
    n = buckets(docs)
    top = counted.filter("bucket is not null").select("bucket", "steps", "more").groupBy("bucket").applyInPandas(
        frequent_keys(n), "keys binary, counts binary").collect()                 # packed, bounded by HOT_LIST
    keys = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(r["keys"], np.uint32) for r in top]])
    counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r["counts"], np.int64) for r in top]])
    hot = keys[np.argsort(keys)], counts[np.argsort(keys)]
    found = entries(docs, hot, n).groupBy("bucket").applyInPandas(
        regions, "region long, unit long, size long, pivot long, pivot_size long")
    members = stash(found.dropDuplicates(["region", "unit"]), "jaccard-regions", rows=TEXTS)
    sketches = counted.filter("sketch is not null").select("unit", "sketch", "n_shingles").dropDuplicates(["unit"])
    sketches = stash(sketches.join(members.select("unit").distinct(), "unit", "left_semi"), "jaccard-sketches")

    sketches = sketches.select("unit", "sketch")

    sets = joined = checked = None
    for best in ("first", *BEST):
        if best == "first":
            pairs = around_first(members.select("region", "unit", "size").join(sketches, "unit"))
        else:
            m = labelled(members.select("region", "unit", "size"), joined)
            open_ = stash(still_open(m), "jaccard-open")
            largest = open_.agg(F.max("n")).first()[0]
            if largest is None:
                break
            # sketches come last, so that labels and open regions are found without moving them
            m = m.join(open_, "region", "left_semi").join(sketches, "unit").select("region", "unit", "size", "component", "sketch")
            pairs = candidates(cells(stash(m, "jaccard-open-members")) if largest > CELL else single_cells(m), best)
        pairs = pairs.distinct()
        pairs = stash(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
        wanted = stash(pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct(), "jaccard-wanted")
        new = wanted if sets is None else stash(wanted.join(sets.select("unit"), "unit", "left_anti"), "jaccard-new")
        fresh = stash(sets_of(docs, new), "jaccard-sets", rows=TEXTS)
        sets = fresh if sets is None else sets.union(fresh)
        # the links are few: gathered anew, they fill few files, not one for each task that compared sets
        links = stash(linked(distances(pairs, only(sets, wanted))).repartition("a"), "jaccard-links")
        if joined is None:
            joined = components(links)
        elif links.limit(1).count():             # else the components stay
            joined = grown(joined, links)
        checked = pairs if checked is None else checked.union(pairs)
    return joined


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, unit (of its text), n_shingles, component (a unit)."""
    units = units_of(docs, doc_id, text)
    counted = stash(census(units, buckets(units)), "jaccard-census", rows=TEXTS)
    label = unit_components(units, counted).select(F.col("node").alias("unit"), "component")
    d = counted.filter("unit is not null").select(
        F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "unit", "n_shingles")
    return d.join(label, "unit", "left").withColumn("component", F.coalesce("component", "unit"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    d = classes(docs, doc_id, text)
    least = d.filter("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    return d.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each component: the one with the least id (null last).  Documents
    without shingles are linked with nothing and all stay."""
    d = classes(docs, doc_id, text).filter("n_shingles > 0")
    rows = d.groupBy("component", "unit", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    best = rows.groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "unit", "copies")).alias("x"))
    chosen = stash(best.select(F.col("x.doc_id").alias("jj_id"), F.col("x.unit").alias("jj_unit"),
                               F.col("x.copies").alias("jj_copies")), "jaccard-chosen")
    t = text_or_empty(text)
    blank = docs.filter(~t.rlike(WORD))
    # whole rows beside the keys, so that no name of the input can clash
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(t).alias("jj_own"), F.col(doc_id).alias("jj_doc"))
    same = (F.col("jj_own") == F.col("jj_unit")) & F.col("jj_doc").eqNullSafe(F.col("jj_id"))
    one = keyed.join(chosen.filter("jj_copies = 1"), same, "left_semi").select("row.*")
    again = keyed.join(chosen.filter("jj_copies > 1"), same, "left_semi").dropDuplicates(
        ["jj_own", "jj_doc"]).select("row.*")      # repeated rows
    return one.union(again).union(blank)
