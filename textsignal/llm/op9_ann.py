"""Approximate nearest neighbours with randomly rotated one-bit codes.

Method.  A vector is normalised and turned by a seeded random rotation; its code is the sign of each
coordinate, packed into bits, with one correction scalar: the inner product of the vector and the unit
vector that its signs spell.  The inner product with a (rotated, unit) query is estimated from the packed
bits as ``<signs, query> / scalar``; its error is at most ``EPSILON * sqrt((1 - scalar^2) / scalar^2 /
(dim - 1))`` but for a very small probability.  In each block the best estimates are computed exactly
first; every further vector whose upper bound reaches the K-th exact value so far is computed as well
(reranked), all others are left out.

Work is dealt by (candidate block, query block): the stated query set meets all rows in blocks of
bounded size, each of which yields at most K rows per query; a ranking per query joins them.

Defined results: vectors that are null, zero, empty or hold null or non-finite components take no
part, neither do rows without an id.  Rows with equal id and vector count once.  Vectors are compared
with those of their own length.  A query never meets rows of its own id.  Equal scores go to the smaller
id.  A query without candidates gives no rows; an empty table gives an empty result.  Other
columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

K = 5                  # fixed by the contract
EVERY = 50             # queries are the rows whose id is divisible by this (fixed by the contract)
BLOCK = 8192           # candidates of a block, about
QUERIES = 2048         # queries of a block, about
EPSILON = 3.0          # width of the error bound
FIRST = 32             # estimates that are computed exactly before the bounds choose
SEED = 11


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1 (exact, cosines stay)."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors, and the correction scalars."""
    turned = (x / norms(x)[:, None]) @ rotation(x.shape[1])
    positive = turned > 0
    scalar = np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(positive, axis=1), scalar


def estimates(bits: np.ndarray, scalar: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x vectors) and the error bound of each vector."""
    dim = queries.shape[1]
    turned = ((queries / norms(queries)[:, None]) @ rotation(dim)).astype(np.float32)
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    est = (turned @ signs.T) / (scalar * np.sqrt(dim)).astype(np.float32)
    err = EPSILON * np.sqrt(np.maximum(1 - scalar ** 2, 0) / scalar ** 2 / max(dim - 1, 1))
    return est, err.astype(np.float32) + np.float32(1e-5)


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int = K):
    """(query row, id, cosine) of the best ``k`` of a block for each query."""
    x, q = scaled(x), scaled(q)
    nx, nq = norms(x), norms(q)
    bits, scalar = codes(x)
    out = []
    for lo in range(0, len(q), 256):
        est, err = estimates(bits, scalar, q[lo:lo + 256])
        for j in range(len(est)):
            row, e = lo + j, est[j]
            e[ids == query_ids[row]] = -np.inf
            exact = lambda at: (x[at] * q[row]).sum(axis=1) / (nx[at] * nq[row])
            first = np.argpartition(-e, FIRST)[:FIRST] if len(e) > FIRST else np.arange(len(e))
            first = first[np.isfinite(e[first])]
            score = exact(first)
            floor = np.sort(score)[-k] if len(score) >= k else -np.inf
            more = np.nonzero(e + err >= floor)[0]
            chosen = np.union1d(first, more[np.isfinite(e[more])])
            score = exact(chosen)
            best = np.lexsort((ids[chosen], -score))[:k]
            out.append((np.full(len(best), row), ids[chosen][best], score[best]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)]


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
           block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors`` found for each row of ``queries``."""
    own = lambda d: d.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    ).dropDuplicates(["vec_id", "v"])
    x, q = own(vectors), own(queries)
    n_blocks, n_queries = max(1, -(-x.count() // block)), max(1, -(-q.count() // query_block))
    part = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.withColumn("b", part(n_blocks)).withColumn("q", each(n_queries))
    q = q.withColumn("q", part(n_queries)).withColumn("key", F.xxhash64("vec_id", "v")).withColumn("b", each(n_blocks))

    def run(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "key": [], "vec_id": [], "score": []})]
        if len(xs) and len(qs):
            xs, qs = xs.assign(dim=xs["v"].map(len)), qs.assign(dim=qs["v"].map(len))
            for dim, mine in qs.groupby("dim"):
                there = xs[xs["dim"] == dim]
                if len(there):
                    row, ids, score = search_block(there["vec_id"].to_numpy(), np.stack(there["v"].to_list()),
                                                   mine["vec_id"].to_numpy(), np.stack(mine["v"].to_list()), k)
                    found.append(pd.DataFrame({"query_id": mine["vec_id"].to_numpy()[row], "key": mine["key"].to_numpy()[row],
                                               "vec_id": ids, "score": score}))
        return pd.concat(found).astype({"query_id": "int64", "key": "int64", "vec_id": "int64", "score": "float64"})

    near = x.groupBy("b", "q").cogroup(q.groupBy("b", "q")).applyInPandas(
        run, "query_id long, key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
