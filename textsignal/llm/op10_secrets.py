"""Secret scans: candidate strings, judged by a random forest that removes false positives.

Candidates are runs of 16 or more characters of the key alphabets that hold a letter and also a digit or a
known key prefix, or stand behind a telling name (which may end in ``_id`` and the like), values of eight or more characters behind a telling name and ``=`` or ``:``, and private-key blocks.

Method.  Each candidate has features: its length, its character transitions (log-likelihood under letter
transitions of ordinary words, changes between character classes, entropy), its coverage by dictionary
words, whether it looks like a path or address, and the neighbouring words (telling names, names of harmless
hashes and ids, quotes, assignments).  A random forest of Gini trees (bootstrap rows, random feature
subsets) is trained in numpy from labelled findings, ``labelled_findings``: a fixed number of
contexts and values made by rule.  A candidate is a secret if the mean vote of the trees reaches THRESHOLD.

Defined results: null and empty texts have no candidates; whole texts are scanned; offsets are code
points, end exclusive; repeated rows and null ids are kept; an empty table gives an empty result.
The report reads no other column, whatever its name.
``redact`` keeps every document and all its columns, writes MASK over each secret and brings an integer
``n_chars`` column, where there is one, up to date; null texts stay null.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import text_or_empty

MASK = "[SECRET]"
THRESHOLD = 0.5
TREES, DEPTH, SEED = 40, 8, 5
PER_CONTEXT = 14        # labelled values made for each labelled context
SHORTEST = 16
DIGIT = re.compile(r"[0-9]")
KEY_RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % SHORTEST)
LETTER = re.compile(r"[A-Za-z]")
# fixed values: names that tell of a secret, and names of harmless hashes and ids
TELLING = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth",
           "credential", "private", "bearer", "key", "aws", "signature")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision",
            "build", "isbn", "doi", "order", "version", "file", "image", "page", "id", "ref", "http", "https", "url")
ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credentials?)[\"']?[ \t]*[:=][ \t]*[\"']?"
                      r"([^\s\"',;]{8,})")
TOLD = re.compile(r"(?i)(?:%s)s?(?:[_-][A-Za-z0-9]+)*[\"']?[ \t]*(?:[:=]{1,2}>?)?[ \t]*[\"']?$" % "|".join(TELLING))
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:.*?-----END [A-Z ]*PRIVATE KEY-----)?", re.S)
PREFIXES = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|eyJ|AIza|glpat-)")
# fixed values: common words for the dictionary coverage
WORDS = """the and for that this with from have not are was were will would there their which about other into more
time only some could them than then its also over such our two may first new any like people these most must
where after back even through year come well way world life still should own under last right think might great
while another those never before between same tell does set three state until off turn here night without again
high every home house place part number point system program question work government file image page user name
data value type index table model report version build test config main list string object server client service
request response error message list update create delete select default format path local remote source target
""".split()


def candidates(text: str) -> list[tuple[int, int]]:
    """Non-overlapping (start, end) in order; an earlier or longer candidate wins."""
    found = []
    if "-----BEGIN" in text:
        found += [m.span() for m in BLOCK.finditer(text)]
    if "=" in text or ":" in text:
        found += [m.span(1) for m in ASSIGNED.finditer(text)]
    for m in KEY_RUN.finditer(text):
        lo, run = m.start(), m[0]
        left, right = len(run) - len(run.lstrip(".=-")), len(run) - len(run.rstrip(".-"))
        # name=value: the value is the candidate
        cut = run.rstrip("=").rfind("=", left)
        left = cut + 1 if cut >= 0 else left
        if len(run) - left - right >= SHORTEST and LETTER.search(run, left) and (
                DIGIT.search(run, left) or PREFIXES.search(run, left) or TOLD.search(text[max(0, lo + left - 60):lo + left])):
            found.append((lo + left, m.end() - right))
    out: list[tuple[int, int]] = []
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


@functools.lru_cache(maxsize=1)
def transitions() -> np.ndarray:
    """Log-probabilities of letter pairs in the dictionary words."""
    counts = np.full((27, 27), 0.2)
    for w in WORDS:
        codes = [26, *(ord(c) - 97 for c in w if "a" <= c <= "z"), 26]
        np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def coverage(text: str) -> float:
    """Share of the characters that dictionary words of three or more letters cover."""
    low, covered = text.lower(), bytearray(len(text))
    vocabulary, i = _vocabulary(), 0
    while i < len(low):
        size = next((n for n in range(min(12, len(low) - i), 2, -1) if low[i:i + n] in vocabulary), 0)
        covered[i:i + size] = b"\1" * size
        i += max(size, 1)
    return sum(covered) / max(len(text), 1)


@functools.lru_cache(maxsize=1)
def _vocabulary() -> frozenset:
    return frozenset(WORDS)


def features(text: str, start: int, end: int) -> list[float]:
    value = text[start:end]
    n = len(value)
    kinds = ["d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "o" for c in value]
    share = Counter(kinds)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    codes = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in value.lower()]
    pairs = transitions()[codes[:-1], codes[1:]] if n > 1 else np.zeros(1)
    before = text[max(0, start - 60):start]
    near = [w.lower().strip("\"'`([{<:=,") for w in before.split()[-3:]]
    after = text[end:end + 1]
    tell = lambda names: sum(any(x in w for x in names) for w in near)
    last = re.split(r"[\s\"'=:(]+", before.rstrip(" \"'=:("))[-1].lower() if before else ""
    return [
        math.log(n), n % 4 == 0, n in (32, 40, 64), share["d"] / n, share["l"] / n, share["u"] / n, share["o"] / n,
        changes / n, entropy, float(pairs.mean()), coverage(value),
        value.count("/") + value.count("."), value.count("-") + value.count("_"),
        any(x in before[-12:] for x in ("://", "www.", "/")) or value.startswith(("/", "./", "www.")),
        re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None,
        re.fullmatch(r"[0-9a-f]+", value) is not None, PREFIXES.match(value) is not None, value.startswith("-----BEGIN"),
        tell(TELLING), any(x in last for x in TELLING), any(last == x or last.endswith("_" + x) for x in HARMLESS),
        sum(w in HARMLESS for w in near), before.rstrip(" \t\"'")[-1:] in ("=", ":") and before != "",
        before[-1:] in ("\"", "'") and before != "" and after == before[-1:],
    ]


def labelled_findings() -> list[tuple[str, int, int, int]]:
    """The labelled findings: (text, start, end, is a secret).  Contexts and value kinds are paired by
    hand, the values are made from hashes of their number."""
    def raw(*of) -> bytes:
        return hashlib.sha512("|".join(map(str, of)).encode()).digest()

    def value(kind: str, i: int) -> str:
        r = raw(kind, i)
        h, b = r.hex(), base64.b64encode(r).decode()
        words = [WORDS[x % len(WORDS)] for x in r]
        return {
            "hex": h[:(32, 40, 64)[i % 3]], "b64": b[:(24, 32, 44, 64)[i % 4]], "aws": "AKIA" + base64.b32encode(r).decode()[:16],
            "hub": "ghp_" + re.sub("[+/=]", "a", b)[:36], "sk": "sk-" + re.sub("[+/=]", "x", b)[:32],
            "jwt": "eyJ" + b[:30].replace("/", "_") + "." + b[30:60].replace("/", "-"),
            "word": words[0].title() + words[1] + str(r[2]) + "!#$"[r[3] % 3] + words[4],
            "pem": "-----BEGIN RSA PRIVATE KEY-----" + b[:64] + "-----END RSA PRIVATE KEY-----",
            "uuid": f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}",
            "path": "/".join(words[:4]) + f"/{words[5]}{r[6]}.txt", "camel": "".join(w.title() for w in words[:4]) + str(r[7] % 10),
            "snake": "_".join(words[:4]) + f"_{r[8] % 100}", "kebab": "-".join(words[:4]) + f"-{r[9]}",
            "host": f"{words[0]}{r[1] % 9}.{words[2]}.example.com/{words[3]}", "date": f"20{r[1] % 25:02d}-0{r[2] % 9 + 1}-1{r[3] % 9}T10:{r[4] % 50 + 10}Z-build{r[5]}",
            "long": "".join(words[:5]) + "2", "plain": "".join(words[:4]), "dashed": "-".join(words[:4]), "under": "_".join(words[:4]),
            "letters": re.sub("[^A-Za-z]", "", b)[:32], "awsl": "AKIA" + re.sub("[2-7=]", "", base64.b32encode(r).decode())[:16], "var": "process.env." + "_".join(words[:3]).upper() + "_2",
        }[kind]

    table = [  # context, value kinds, is a secret
        ('the token = "{}" of', "hex b64 hub sk jwt", 1), ("api_key: {} and", "hex b64 sk", 1), ("password = {}\n", "word b64", 1),
        ("export AWS_ACCESS_KEY_ID={}", "aws", 1), ("secret '{}' was", "hex b64", 1), ("use {} here", "aws hub sk jwt", 1),
        ("Authorization: Bearer {}", "jwt b64 hex", 1), ("client_secret={}&", "b64 hex", 1), ("{}", "pem aws hub", 1),
        ('"auth_token": "{}",', "hex b64 jwt", 1), ("passwd: {} ;", "word", 1), ("and the {} of", "b64", 1),
        ("commit {} fixed", "hex", 0), ("sha256: {} ok", "hex b64", 0), ("md5 {} of the file", "hex", 0), ("checksum {} matches", "hex b64", 0),
        ("uuid {} was", "uuid", 0), ("see https://{} for", "host path", 0), ("in /usr/{} there", "path", 0), ("call {} now", "camel snake kebab", 0),
        ("the file {} is", "path kebab snake", 0), ("on {} we", "date", 0), ("id {} in", "uuid kebab", 0), ("word {} end", "long camel", 0),
        ("password = {}\n", "var", 0), ("token: {} ", "var snake", 0), ("digest {} and", "hex", 0), ("the {} of", "long snake path host uuid kebab date", 0),
        ("image {} shown", "path kebab", 0), ("revision {} is", "hex", 0), ('etag = "{}" in', "hex", 0), ("and {} was", "camel snake long", 0),
        ("use {} here", "awsl", 1), ("export AWS_ACCESS_KEY_ID={}", "awsl", 1), ("{}", "awsl", 1), ("the token_id = \"{}\" of", "letters", 1),
        ("signing_key: {} and", "letters", 1), ("Authorization: Bearer {}", "letters", 1), ("the key {} of", "plain dashed", 0),
        ("token: {} ", "dashed under plain", 0), ("a private {} was", "plain dashed under", 0), ("the risk {} of", "dashed under", 0),
    ]
    out = []
    for k, (context, kinds, label) in enumerate(table):
        for i in range(PER_CONTEXT):
            for kind in kinds.split():
                v = value(kind, 1000 * k + i)
                start = context.index("{}")
                out.append((context.replace("{}", v), start, start + len(v), label))
    return out


class Forest:
    """Gini trees as arrays: feature (-1 in a leaf), cut, children, and the share of secrets in a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        self.random = np.random.default_rng(seed)
        self.trees = [self.grow(x[rows], y[rows], depth) for rows in
                      (self.random.integers(0, len(x), len(x)) for _ in range(trees))]

    def grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
        nodes: list[list] = []

        def split(rows: np.ndarray, left: int) -> int:
            at, share = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0.0, at, at, share])
            if left and 0 < share < 1:
                best = None
                for f in self.random.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
                    order = rows[np.argsort(x[rows, f], kind="stable")]
                    v, hits = x[order, f], np.cumsum(y[order])
                    n = np.arange(1, len(order))
                    valid = v[1:] > v[:-1]
                    if valid.any():
                        a, b = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(order) - n)
                        cost = np.where(valid, n * a * (1 - a) + (len(order) - n) * b * (1 - b), np.inf)
                        i = int(cost.argmin())
                        if best is None or cost[i] < best[0]:
                            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
                if best:
                    low = x[rows, best[1]] <= best[2]
                    nodes[at][:2] = best[1:]
                    nodes[at][2] = split(rows[low], left - 1)
                    nodes[at][3] = split(rows[~low], left - 1)
            return at

        split(np.arange(len(x)), depth)
        f, cut, lo, hi, share = map(np.array, zip(*nodes))
        return f.astype(int), cut, lo.astype(int), hi.astype(int), share

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, cut, lo, hi, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                below = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
                at = np.where(f[at] < 0, at, np.where(below, lo[at], hi[at]))
            total += share[at]
        return total / len(self.trees)


def trained(rows: list[tuple[str, int, int, int]] | None = None) -> Forest:
    rows = rows or labelled_findings()
    return Forest(np.array([features(t, s, e) for t, s, e, _ in rows], float), np.array([y for *_, y in rows]))


def scan(texts: list[str], forest: Forest) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of all candidates of each text; their scores come from one batch."""
    found = [candidates(t) for t in texts]
    x = [features(t, s, e) for t, own in zip(texts, found) for s, e in own]
    score = iter(forest.predict(np.array(x, float)).tolist() if x else [])
    return [[(s, e, next(score)) for s, e in own] for own in found]


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_candidates, n_secrets, spans of the secrets (``start:end``, comma-joined) and
    the largest score (0 without candidates)."""
    forest = trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo:lo + 500]
                got = scan(part["text"].tolist(), forest)
                secret = [[x for x in own if x[2] >= THRESHOLD] for own in got]
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "n_candidates": [len(own) for own in got],
                    "n_secrets": [len(own) for own in secret],
                    "secret_spans": [",".join(f"{s}:{e}" for s, e, _ in own) for own in secret],
                    "max_score": [round(max((x[2] for x in own), default=0.0), 6) for own in got]})

    # ids travel as strings: pandas would turn integers with nulls into floats
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text_or_empty(text).alias("text"))
    out = own.mapInPandas(run, "doc_id string, n_candidates long, n_secrets long, secret_spans string, max_score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents with MASK over every secret, in their own columns."""
    forest = trained()

    @F.pandas_udf("string")
    def masked(column: pd.Series) -> pd.Series:
        out = column.copy()
        for lo in range(0, len(column), 500):
            part = column.iloc[lo:lo + 500]
            for i, t, own in zip(part.index, part, scan([t or "" for t in part], forest)):
                pieces, at = [], 0
                for s, e, score in own:
                    if score >= THRESHOLD:
                        pieces += [t[at:s], MASK]
                        at = e
                if pieces:
                    out.loc[i] = "".join([*pieces, t[at:]])
        return out

    done = docs.withColumn(text, masked(F.col(text)))
    if n_chars in docs.columns and docs.schema[n_chars].dataType.typeName() in ("long", "integer"):
        size = F.coalesce(F.char_length(text).cast(docs.schema[n_chars].dataType), F.col(n_chars))
        done = done.withColumn(n_chars, size)
    return done.select(*docs.columns)
