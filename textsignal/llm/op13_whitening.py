"""Embedding whitening by mixed-precision eigenvectors.

Method.  Entries become integers.  The distinct vectors (the fit list) give exact sums, then the products of centred
vectors, both added up in tasks and joined over two levels; a matrix of (dimension x dimension) is all that reaches the
driver.  Its eigenvectors are found in float32 and corrected by Ogita-Aishima iterations, which are matrix
multiplications in double precision: with R = I - X'X and S = X'VX, eigenvalues are s_ii / (1 - r_ii), and X moves by
X E, where e_ij = (s_ij + l_j r_ij) / (l_j - l_i) for separated eigenvalues and r_ij / 2 for others.  Eigenvalues that
float32 could not separate form clusters; each is solved again on its own subspace (shifted and projected in double
precision) and then corrected as above.  Every row is projected and divided by the root of the eigenvalue.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries, or entries beyond +-2^40, take
no part.  Vectors of different lengths are fitted separately, each length on its own.  Components without variance
(eigenvalue at most 1e-11 of the largest) can't be whitened and have no rows, so a single distinct vector gives none.
Repeated rows stay and count once in the fit; rows without id stay.  ``deviation`` is null where it exceeds a long.
An empty table gives an empty result.  Other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import stash

COMPONENTS = 16            # components returned (fixed by the contract)
LIMIT = float(1 << 40)     # entries beyond take no part
GROUPS = 64                # partial matrices meet in so many groups before the last sum
ROUNDS = 12                # corrections at most; two or three are usual
LEAST = 1e-11              # share of the largest eigenvalue below which a component has no variance


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Groups of positions whose sorted eigenvalues follow each other within ``gap``; single ones left out."""
    order = np.argsort(-values)
    parts = np.split(order, np.flatnonzero(-np.diff(values[order]) > gap) + 1)
    return [p for p in parts if len(p) > 1]


def correct(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: (eigenvalues, corrected vectors, distance moved)."""
    r = np.eye(len(a)) - x.T @ x
    s = x.T @ a @ x
    s, r = (s + s.T) / 2, (r + r.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    apart = 2 * (np.linalg.norm(off) + np.linalg.norm(a) * np.linalg.norm(r))
    gap = values[None, :] - values[:, None]
    wide = np.abs(gap) > apart
    e = np.where(wide, (s + values[None, :] * r) / np.where(wide, gap, 1.0), r / 2)
    return values, x + x @ e, float(np.abs(e).max(initial=0.0))


def solve_cluster(a: np.ndarray, x: np.ndarray, at: np.ndarray, middle: float) -> None:
    """Turns the vectors of a cluster onto the eigenvectors of the shifted matrix in their subspace."""
    q = np.linalg.qr(x[:, at])[0]
    inner = q.T @ (a @ q - middle * q)
    x[:, at] = q @ np.linalg.eigh((inner + inner.T) / 2)[1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors in double precision, from float32 ones."""
    a = (a + a.T) / 2
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    size = np.linalg.norm(a)
    single = np.finfo(np.float32).eps * size * len(a)       # what float32 could not tell apart
    for _ in range(2):
        x = correct(a, x)[1]
        values = np.diag(x.T @ a @ x)
        for at in clusters(values, single):
            solve_cluster(a, x, at, float(values[at].mean()))
    last = np.inf
    for _ in range(ROUNDS):
        _, moved, step = correct(a, x)
        if step > last / 2:                                 # rounding is all that still moves
            break
        x, last = moved, step
    x = x + x @ (np.eye(len(a)) - x.T @ x) / 2
    values = np.diag(x.T @ a @ x) / (x * x).sum(axis=0)
    x = x / np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


@dataclass
class Fit:
    """The fit of one vector length."""
    n: int
    sums: np.ndarray        # exact, Python integers
    base: np.ndarray        # whole part of the means
    mean: np.ndarray        # means above the base
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - self.mean

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        shift = [int(s) - self.n * int(b) for s, b in zip(self.sums, self.base)]
        y = x - self.base
        widest = max(self.n * int(np.abs(y).max(initial=0)) + max(map(abs, shift)), 1)
        if len(shift) * widest * widest < 1 << 63:
            d = self.n * y - np.array(shift, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, shift)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]


def integers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x, len): the rows that take part, with their integer vectors."""
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0))
    sound = F.forall("v", lambda c: F.coalesce(F.abs(c) <= F.lit(LIMIT), F.lit(False)))    # false for null, NaN, infinite
    return own.filter(sound).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * F.lit(64.0)) + F.lit(1_000_000)).alias("x"), F.size("v").alias("len"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, pd.DataFrame]]:
    for batch in batches:
        for dim, rows in batch.groupby("len"):
            yield int(dim), np.stack(rows["x"].to_list()).astype(np.int64), rows


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """n and the exact sum of every dimension, per length."""
    high, low = F.shiftright("c", 20), F.col("c").bitwiseAND(F.lit((1 << 20) - 1))
    sums = fit.select("len", F.posexplode("x").alias("d", "c")).groupBy("len", "d").agg(
        F.count(F.lit(1)).alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low")).collect()     # one row per dimension
    out = {}
    for r in sums:
        n, total = out.setdefault(r["len"], (r["n"], np.zeros(r["len"], object)))
        total[r["d"]] = (int(r["high"]) << 20) + int(r["low"])
    return out


def summed(fit: DataFrame, product) -> dict[int, np.ndarray]:
    """Sum over all rows of ``product(dim, x)``, a square matrix per length: in tasks, in groups, then at all."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for dim, x, _ in _blocks(batches):
            m = product(dim, x)
            held[dim] = held[dim] + m if dim in held else m
        for dim, m in ((dim, m) for dim, m in held.items() if len(m)):
            yield pd.DataFrame({"len": dim, "i": np.arange(len(m)), "m": list(m)})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"len": rows["len"].iloc[:1], "i": rows["i"].iloc[:1], "m": [np.stack(rows["m"].to_list()).sum(axis=0)]})

    ddl = "len int, i int, m array<double>"
    parts = fit.mapInPandas(partial, ddl).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    parts = parts.groupBy("len", "i", "g").applyInPandas(lambda rows: add(rows), ddl).groupBy("len", "i").applyInPandas(add, ddl)
    out: dict[int, dict[int, list[float]]] = {}
    for r in parts.collect():                               # one matrix per length
        out.setdefault(r["len"], {})[r["i"]] = r["m"]
    return {dim: np.array([m[i] for i in sorted(m)]) for dim, m in out.items()}


def fits(fit: DataFrame, components: int) -> dict[int, Fit]:
    """The components of every vector length, from its distinct vectors."""
    means = {}
    for dim, (n, total) in exact_sums(fit).items():
        base = np.array([int(s) // n for s in total], np.int64)
        means[dim] = n, total, base, np.array([(int(s) - n * int(b)) / n for s, b in zip(total, base)])

    def products(dim: int, x: np.ndarray) -> np.ndarray:
        _, _, base, mean = means[dim]
        y = (x - base).astype(np.float64) - mean
        return y.T @ y

    out = {}
    for dim, m in summed(fit, products).items():
        n, total, base, mean = means[dim]
        values, vectors = eigen(m / n)
        keep = min(components, int((values > LEAST * max(float(values[0]), 0.0)).sum()) if values[0] > 0 else 0)
        out[dim] = Fit(n, total, base, mean, values[:keep], vectors[:, :keep], float(np.trace(m / n)))

    def white(dim: int, x: np.ndarray) -> np.ndarray:
        z = out[dim].whitened(x)
        return z.T @ z

    for dim, m in summed(fit, white).items():
        out[dim].identity_error = float(np.abs(m / out[dim].n - np.eye(len(m))).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part."""
    rows = integers(vectors, vec_id, embedding)
    fitted = fits(stash(rows.select("x", "len").distinct(), "fit"), components)
    shared = vectors.sparkSession.sparkContext.broadcast(fitted)       # (dimension x components) numbers per length

    @F.pandas_udf("n long, deviation long, z array<double>, share array<double>, identity_error double")
    def projected(x: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(index=x.index, columns=["n", "deviation", "z", "share", "identity_error"], dtype=object)
        for dim, mine in x.groupby(x.map(len)):
            f, rows = shared.value[dim], np.stack(mine.to_list()).astype(np.int64)
            out.loc[mine.index, "n"] = f.n
            out.loc[mine.index, "identity_error"] = f.identity_error
            out.loc[mine.index, "deviation"] = pd.Series(f.deviation(rows), mine.index, dtype=object)
            out.loc[mine.index, "z"] = pd.Series(list(f.whitened(rows)), mine.index, dtype=object)
            out.loc[mine.index, "share"] = pd.Series([f.values / f.trace] * len(rows), mine.index, dtype=object)
        return out.astype({"n": "int64", "deviation": "Int64", "identity_error": "float64"})

    return rows.select("vec_id", projected("x").alias("p")).select("vec_id", "p.*").select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("z", "share")).alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.z").alias("whitened"),
        F.col("c.share").alias("explained"), "identity_error")
