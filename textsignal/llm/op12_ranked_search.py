"""Ranked lexical search over impact vectors in norm buckets.

Method.  A document is a sparse vector of impacts (term frequency against its length), weighted by how rare the terms
are; an item is the set of its terms, so that a score is an inner product.  The documents of a task are taken in
chunks of bounded size, ordered by the length (norm) of their vectors and cut into buckets.  Per bucket, longest
first, and item:

* Cauchy-Schwarz drops the whole bucket if its longest vector cannot reach the item's k-th best score so far;
* inside, terms in order of their largest coordinate in the bucket: those whose coordinates together cannot reach that
  score need no look-up of their own, so that only documents with another of the item's terms are candidates; a
  candidate stays if its known coordinates, and the bound of the remaining ones (the sum of the bucket's largest
  coordinates, or Cauchy-Schwarz on what is left of the vector, whichever is less), reach it;
* the survivors are scored again exactly, in integers.

The k-th best score of all documents among the longest vectors of every chunk is the first threshold everywhere, and it
rises further inside a chunk.  Items are
handled in blocks of bounded bytes, whose terms are all that is kept of a document; each block meets all documents.

Defined results: documents whose text is null or holds no term count for nothing and are never found, items without
terms have no rows.  Items equal in id and text count once; repeated documents are documents of their own, each with
its own rank; a document without id counts and, at equal scores, comes after those that have one.  Empty tables give
an empty result.  Other columns, whatever their names, are neither read nor returned.  Whole texts are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from textsignal.llm.common import stash

K = 10                     # documents of an item (fixed by the contract)
ITEM_BYTES = 4 << 20       # text of the items of a block, about
BUCKET = 2048              # documents of a norm bucket
CHUNK = 1_000_000          # coordinates that a task holds at once, about
FIRST = 512                # longest vectors of a chunk that give the first thresholds

#: [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ (fixed by the contract) on UTF-8 bytes whose A-Z are lower-cased.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return TERM.findall(data.lower())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """(doc_id, nameless, n, term, tf) of every document with a term; only terms of the vocabulary are listed."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)      # bounded by the bytes of an item block

    @F.pandas_udf("n long, term array<int>, tf array<long>")
    def counted(texts: pd.Series) -> pd.DataFrame:
        number, rows = known.value.get, []
        for data in texts:
            found = terms(data)
            tf = Counter(map(number, found))
            tf.pop(None, None)
            rows.append((len(found), np.fromiter(tf.keys(), np.int32, len(tf)), np.fromiter(tf.values(), np.int64, len(tf))))
        return pd.DataFrame(rows, columns=["n", "term", "tf"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return own.filter(F.col("text").isNotNull()).select(
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("nameless"), counted("text").alias("c")
    ).select("doc_id", "nameless", "c.*").filter(F.col("n") > 0)


class Search:
    """The items of a block and the weights of their terms; scores chunks of documents."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = items, weights, n_docs, n_terms, k

    def coordinates(self, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Weighted impacts, as integers."""
        m = 10 + (90 * n * self.n_docs) // self.n_terms
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))

    def norms(self, row: np.ndarray, x: np.ndarray, n_rows: int) -> np.ndarray:
        return np.sqrt(np.bincount(row, weights=x.astype(float) ** 2, minlength=n_rows))

    def best(self, doc: np.ndarray, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray,
             floors: np.ndarray, most: int | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(item, documents, scores) of the best k of a chunk that reach the item's floor; ``doc`` has a row
        (nameless, id) per document.  ``most`` keeps to that many of the longest vectors."""
        x = self.coordinates(n, sizes, term, tf)
        row = np.repeat(np.arange(len(doc)), sizes)
        norm = self.norms(row, x, len(doc))
        longest = np.argsort(-norm, kind="stable")         # documents in order of their norm
        place = np.empty(len(doc), np.int64)
        place[longest] = np.arange(len(doc))
        row, doc, norm = place[row], doc[longest][:most], norm[longest][:most]
        if most is not None:
            term, x, row = term[row < most], x[row < most], row[row < most]
        order = np.lexsort((row, term, row // BUCKET))
        row, term, x = row[order], term[order], x[order]
        floors, kept = floors.copy(), {}
        for lo in range(0, len(doc), BUCKET):
            cut = slice(*np.searchsorted(row // BUCKET, [lo // BUCKET, lo // BUCKET + 1]))
            self.bucket(lo, norm[lo:lo + BUCKET], row[cut] - lo, term[cut], x[cut], doc, floors, kept)
        return [(i, *v) for i, v in kept.items() if len(v[0])]

    def bucket(self, lo, norm, row, term, x, doc, floors, kept) -> None:
        start = np.searchsorted(term, np.arange(len(self.weights) + 1))
        top = np.zeros(len(self.weights))
        used = start[:-1] < start[1:]
        if len(x):
            top[used] = np.maximum.reduceat(x, start[:-1][used])
        longest = float(norm[0]) * (1 + 1e-9)
        for i, own in enumerate(self.items):
            floor = max(floors[i], 1)
            if math.sqrt(len(own)) * longest < floor:      # Cauchy-Schwarz: no vector of the bucket is long enough
                continue
            own = own[top[own] > 0]
            own = own[np.argsort(top[own], kind="stable")]
            rest = np.minimum(np.cumsum(top[own]), np.sqrt(np.arange(1, len(own) + 1)) * longest)
            common = int(np.searchsorted(rest, floor))     # so many terms together stay below the floor
            if common == len(own):
                continue
            known, square = np.zeros(len(norm)), np.zeros(len(norm))
            for t in own[common:]:
                at, value = row[start[t]:start[t + 1]], x[start[t]:start[t + 1]].astype(float)
                known[at] += value
                square[at] += value * value
            found = np.flatnonzero(known)
            if common:
                left = np.sqrt(common * np.maximum(norm[found] ** 2 - square[found], 0)) + 1e-9 * longest
                bound = known[found] + np.minimum(left, rest[common - 1])
                found = found[bound * (1 + 1e-9) >= floor]
            else:
                found = found[known[found] * (1 + 1e-9) >= floor]
            if not len(found):
                continue
            score = np.zeros(len(found), np.int64)         # exactly, in integers
            for t in own:
                at, value = row[start[t]:start[t + 1]], x[start[t]:start[t + 1]]
                pos = np.minimum(np.searchsorted(at, found), len(at) - 1)
                hit = at[pos] == found
                score[hit] += value[pos[hit]]
            good = score >= floor
            ids, score = doc[lo + found[good]], score[good]
            if i in kept:
                ids, score = np.concatenate([kept[i][0], ids]), np.concatenate([kept[i][1], score])
            order = np.lexsort((ids[:, 1], ids[:, 0], -score))[:self.k]
            kept[i] = ids[order], score[order]
            if len(order) == self.k:
                floors[i] = max(floors[i], int(score[order[-1]]))


def chunks(batches: Iterator[pd.DataFrame], most: int = CHUNK):
    """Arrays (doc, n, sizes, term, tf) of bounded size."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(batch["term"].map(len).sum()) + len(batch)
        if size >= most:
            yield joined(pd.concat(held, ignore_index=True))
            held, size = [], 0
    if size:
        yield joined(pd.concat(held, ignore_index=True))


def flat(lists: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)


def joined(rows: pd.DataFrame):
    doc = np.stack([rows["nameless"].to_numpy(np.int64), rows["doc_id"].to_numpy(np.int64)], axis=1)
    return doc, rows["n"].to_numpy(np.int64), rows["term"].map(len).to_numpy(np.int64), flat(rows["term"]), flat(rows["tf"])


def search_block(docs: DataFrame, items: list[list[bytes]], doc_id: str, text: str, k: int) -> DataFrame:
    """(item, nameless, doc_id, score): the best ``k`` of every chunk of the documents, for the items of one block."""
    sc = docs.sparkSession.sparkContext
    names = sorted({t for own in items for t in own})
    vocabulary = {t: j for j, t in enumerate(names)}
    found = stash(frequencies(docs, vocabulary, doc_id, text), "impacts")
    total = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(names), np.int64)
    for r in found.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r["t"]] = r["df"]                                # one row per term of the block
    weights = np.array([weight(total["docs"], int(x)) for x in df], np.int64)
    own = [np.array([vocabulary[t] for t in ts], np.int64) for ts in items]
    shared = sc.broadcast(Search(own, weights, total["docs"], max(total["terms"], 1), k))

    def best(floors: np.ndarray, most: int | None = None) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for chunk in chunks(batches):
                for i, ids, score in shared.value.best(*chunk, floors, most):
                    yield pd.DataFrame({"item": i, "nameless": ids[:, 0] > 0, "doc_id": ids[:, 1], "score": score})
        return found.mapInPandas(run, "item int, nameless boolean, doc_id long, score long")

    floors = np.zeros(len(own), np.int64)
    nth = Window.partitionBy("item").orderBy(F.desc("score"))
    for r in best(floors, FIRST).withColumn("r", F.row_number().over(nth)).filter(F.col("r") == k).collect():
        floors[r["item"]] = r["score"]                      # one row per item of the block
    return best(floors)


def rank(docs: DataFrame, items: DataFrame, k: int = K, item_bytes: int = ITEM_BYTES, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 for every item."""
    spark = docs.sparkSession
    queries = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter(
        F.col("text").isNotNull()).distinct()
    size = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // item_bytes))
    queries = stash(queries.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "items") if n_blocks > 1 \
        else queries.withColumn("block", F.lit(0))
    id_type = queries.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "nameless", "doc_id")
    for block in range(n_blocks):
        rows = queries.filter(F.col("block") == block).select("item_id", "text").collect()      # about item_bytes
        own = [(r["item_id"], ts) for r in rows if (ts := sorted(set(terms(r["text"]))))]
        if own:
            ids = spark.createDataFrame([(i, key) for i, (key, _) in enumerate(own)], f"item int, item_id {id_type.simpleString()}")
            near = search_block(docs, [ts for _, ts in own], doc_id, text, k).withColumn("rank", F.row_number().over(order))
            out = out.unionByName(near.filter(F.col("rank") <= k).join(F.broadcast(ids), "item").select(
                "item_id", "rank", F.when(~F.col("nameless"), F.col("doc_id")).alias("doc_id"), "score"))
    return out
