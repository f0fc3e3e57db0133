"""Large regions of the Jaccard join: their work grows with their members, and every pair is still sought."""

import numpy as np
import pytest

from textsignal.llm import op6_jaccard_join as join

MEMBERS = "region long, unit long, size long, component long, sketch binary"


def copies(r, n, size, changes, region, start):
    """Members of a region: the sets of ``n`` near copies of one text, four to a component at most."""
    base = r.integers(0, 2 ** 63, size).astype(np.uint64)
    out = []
    for i in range(n):
        s = base.copy()
        s[r.integers(0, size, changes)] = r.integers(0, 2 ** 63, changes).astype(np.uint64)
        s = np.unique(s)
        out.append((region, int(r.integers(0, 2 ** 62)), len(s), start + i - i % int(r.integers(1, 5)), bytearray(join.sketch(s))))
    return out


def wanted(rows):
    """Pairs of different components in a region that the sketches allow."""
    k, size = join.unpacked([bytes(x[4]) for x in rows]), np.array([x[2] for x in rows])
    near = join.lows(k, size, k, size) <= join.TAU
    return {(a[1], b[1]) for i, a in enumerate(rows) for j, b in enumerate(rows) if near[i, j] and a[1] < b[1] and a[3] != b[3]}


def sought(m):
    return {(r["a"], r["b"]) for r in join.candidates(m, None).distinct().collect()}


@pytest.mark.parametrize("seeking", [16_384, 50])
def test_regions_that_pivots_do_not_divide(spark, monkeypatch, seeking):
    """Near copies of one text are all near every pivot: they are not copied to every cell, level after level."""
    monkeypatch.setattr(join, "CELL", 64)
    monkeypatch.setattr(join, "SEEKING", seeking, raising=False)
    rows = copies(np.random.default_rng(5), 320, 400, 40, 7, 0)
    rows = [(g, u, n, 1000 if c < 240 else c, k) for g, u, n, c, k in rows]       # one large component, as after the first round
    m = join.stash(join.cells(spark.createDataFrame(rows, MEMBERS).repartition(3)), "test-cells")
    q = sum(c != 1000 for _, _, _, c, _ in rows)
    assert m.count() == 320 * -(-q // seeking) + q * 5
    found = sought(m)
    assert wanted(rows) <= found and found


def test_regions_that_pivots_divide(spark, monkeypatch):
    """Families of near copies in one region part into cells, and no pair is lost between them, at either level."""
    monkeypatch.setattr(join, "CELL", 24)
    r, rows = np.random.default_rng(6), []
    for f in range(12):
        rows += copies(r, 25, 300, (6, 20, 30)[f % 3], 7, 100 * f)
    m = join.stash(join.cells(spark.createDataFrame(rows, MEMBERS).repartition(3)), "test-cells")
    most = m.groupBy("region").count().agg({"count": "max"}).first()[0]
    assert most < 150                            # of 300: cells, not one region in blocks
    assert wanted(rows) == sought(m)


def test_reach_of_large_regions_is_that_of_its_pairs():
    """Members that could have no first common shingle with another one leave a region of any size."""
    r = np.random.default_rng(7)
    for spread in (1, 10, 200):
        for n in (2, 3, 49, 130):
            size = r.integers(100, 100 + spread, n)
            place = r.integers(0, size // 4)
            rest = size - place
            pair = 7 * np.minimum(rest[:, None], rest[None]) >= 3 * (size[:, None] + size[None])
            np.fill_diagonal(pair, False)
            assert (join.in_reach_of_any(size, place) == pair.any(axis=1)).all()
    e = np.zeros(60, join.ENTRY)
    e["size"], e["place"] = 100, [20] * 50 + [2] * 10       # an earlier shingle is the first common one of the fifty
    assert join.in_reach(e, np.array([60])).tolist() == [False] * 50 + [True] * 10
