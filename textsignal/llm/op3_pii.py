"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

Base.  Emails, IP addresses, card numbers (Luhn) and phone numbers by the fixed patterns, leftmost and
non-overlapping per kind; a match that fails its check is dropped and not retried.

Method.  A linear-chain CRF labels words as O, email, ip, card or phone.  Its features are the word's
shape (runs of letters and digits, sizes), the shapes beside it and the words before it; it is trained
in numpy by gradient ascent on the regularised log-likelihood (forward-backward) over a small labelled
table, ``labelled_rows``.  Texts are decoded by Viterbi in numpy batches.  Only words with a digit or an
``@`` may carry a label, so a stretch without such words is all O, and decoding the neighbourhoods of such
words, with O at both ends, gives the same labels as decoding the whole text.  A run of equal labels is a
span (outer punctuation cut off); it is added if it overlaps no base span and passes its kind's check (Luhn
for cards, parts for addresses, digits for phones).  Base spans always stay.

Defined results: null and empty texts have no spans; whole texts are scanned; offsets are code points;
repeated rows and null ids are kept; an empty table gives an empty result.  Other columns, whatever their
names, are neither read nor returned.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textsignal.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone")     # in the order of the contract
EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive parts and the look-behind change no match; they keep long digit runs linear
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMERAL = re.compile(r"[0-9]")
CLUE = re.compile(r"[0-9@]")
SPACE = frozenset(" \t\n\x0b\x0c\r")
CONTEXT = 3            # words beside a clue that are decoded with it
EPOCHS, RATE, DECAY = 80, 0.5, 1e-3


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def is_address(text: str) -> bool:
    parts = [p.lstrip("0") for p in text.split(".")]
    return len(parts) == 4 and all(not p or p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns."""
    found: list[tuple[int, str, int]] = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and EMAIL_LEFT.match(text[start - 1]):
                start -= 1
            m = EMAIL_RIGHT.match(text, at) if start < at else None
            if m:
                found.append((start, "email", done := m.end()))
            at = text.find("@", at + 1)
    if NUMERAL.search(text):
        for m in IP.finditer(text):
            if is_address(m[0]):
                found.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NUMERAL.findall(m[0])) <= 15:
                    found.append((m.start(), "phone", m.end()))
    return sorted(found, key=in_order)


def in_order(span: tuple[int, str, int]):
    return span[0], KINDS.index(span[1]), span[2]


def shape(word: str) -> str:
    """Letter and digit runs as classes with sizes, e.g. ``9[3]-9[4]`` for 555-1234."""
    s = re.sub(r"[0-9]+", lambda m: f"9[{min(len(m[0]), 20)}]", word)
    return re.sub(r"[^\W\d_](?:[^\W\d_])*(?!\])", "a", s)


def features(words: list[str], i: int) -> list[str]:
    w, digits = words[i], NUMERAL.findall(words[i])
    beside = lambda j: shape(words[j]) if 0 <= j < len(words) else "|"
    before = lambda j: words[j].lower().strip(".,:;#()<>\"'") if j >= 0 else "|"
    out = [f"s={shape(w)}", f"l={beside(i - 1)}", f"r={beside(i + 1)}", f"d={min(len(digits), 20)}",
           f"w1={before(i - 1)}", f"w2={before(i - 2)}", f"p={w[:1] if not w[:1].isalnum() else 'x'}",
           f"dots={min(w.count('.'), 4)}", f"dash={min(w.count('-'), 4)}", "bias"]
    if "@" in w:
        out.append("at")
    if len(digits) * 2 < len(w):
        out.append("letters")
    return out


def labelled_rows() -> list[list[tuple[str, int]]]:
    """The small labelled table: sentences as (word, label); label 0 is O, then KINDS from 1.
    Values in braces are personal data of the named kind."""
    table = """
mail {email bob@example.com} today | write to {email <ann.lee@mail.org>} soon | contact {email x_y+z@host.co.uk,} or me
my address is {email jo@localhost} there | email: {email sam99@inbox.net.} thanks | send it to {email "kim@post.de"} now
server {ip 10.0.0.1} is down | host {ip 192.168.1.254:8080} answered | from ip {ip 172.16.4.9,} twice | ping {ip 8.8.8.8} works
login from address {ip 203.0.113.77.} failed | gateway ({ip 10.1.2.3}) changed
card {card 4111111111111111} expires | visa {card 4012 8888 8888 1881} was charged | credit card number {card 5555-5555-5555-4444.} ok
pay with card {card 378282246310005} please | mastercard {card 5105105105105100} declined | card: {card 6011 1111 1111 1117} approved
call {phone 555-123-4567} now | phone {phone (443) 555-5793} today | tel: {phone 0044 20 7946 0958} office | ring {phone 443.555.0199} later
mobile {phone 0171 5550199} please | fax {phone (212) 555-0143,} again | reach me at {phone 617-555-0182.} anytime | phone: {phone +1 (656) 555-6669} home
call {phone +44 20 7946 0018} soon | text {phone 800-555-0100} now | the {phone +1 (102) 555-3320} of | her {phone (555) 123-9876} and
in 2024 the price rose | costs 3.50 euros each | version 3.1.4 was out | page 12 of 200 pages | on 2024-01-15 we met
at 10:30 or 11:45 we left | licensed under CC BY-NC 4.0. | license, version 3. applies | about 1,000,000 people | 50% of 300 users
isbn 9781234567897 of the book | order 4365873117289653 was sent | the 9859476043669043 of it | and 0810992847249404 the end | id 7841447338341023 in list
token = "40afc083d1d966a2b1c4" here | commit 5e884898da28047151d0 done | sha c80fd45a66f8564ae706 ok | value 98112345671234 of | a 4200000000000 b
score 5-4 and 3-2 wins | between 1990-1995 and 2001-2003 there | from 10-12 to 14-18 | section 4.2.1.3.5 says | build 10.15.7 works | area 51 and route 66
room 555-12 upstairs | room 101 or 102 | 12 555 people | model 2000-1500-10 ready | serial 12-345-6789-01 fits | step 1. then 2. then 3.
@home and @work tags | meet @ noon | user @anna wrote | a @ b means | see a@b there | price @ 5 each | x 100 200 300 y | 1 2 3 4 5 6
the 1234567890123456 on | er 4036519212512712 und | la 5472476151044309 de | 7 8 9 | 1984 was | 99 of 100 | no. 7 at 9 | 2.5 to 3.5 | 404 not found
"""
    rows = []
    for sentence in re.split(r"[|\n]", table):
        row, label = [], 0
        for m in re.finditer(r"[^\s{}]+|[{}]", sentence):
            if m[0] == "{":
                label = -1
            elif m[0] == "}":
                label = 0
            elif label == -1:
                label = 1 + KINDS.index(m[0])
            else:
                row.append((m[0], label))
        if row:
            rows.append(row)
    return rows


def allowed(word: str) -> bool:
    return CLUE.search(word) is not None


class Crf:
    """Weights of a linear-chain CRF: ``emit`` (features x labels) and ``move`` (labels x labels)."""

    def __init__(self, rows: list[list[tuple[str, int]]]):
        n = len(KINDS) + 1
        listed = [[features([w for w, _ in row], i) for i in range(len(row))] for row in rows]
        self.index = {f: k for k, f in enumerate(sorted({f for r in listed for fs in r for f in fs}))}
        self.emit, self.move = np.zeros((len(self.index), n)), np.zeros((n, n))
        seen = [(self.columns(fs), np.array([y for _, y in row]), self.barred([w for w, _ in row]))
                for fs, row in zip(listed, rows)]
        for epoch in range(EPOCHS):
            up_emit, up_move = -DECAY * self.emit, -DECAY * self.move
            for columns, labels, bars in seen:
                node, edge = self.marginals(self.scores(columns) + bars)
                node[np.arange(len(labels)), labels] -= 1
                for t, c in enumerate(columns):
                    up_emit[c] -= node[t] / len(seen)
                up_move -= edge / len(seen)
                np.add.at(up_move, (labels[:-1], labels[1:]), 1 / len(seen))
            rate = RATE * 8 / (1 + epoch / 50)
            self.emit += rate * up_emit
            self.move += rate * up_move

    def columns(self, listed: list[list[str]]) -> list[np.ndarray]:
        return [np.array([self.index[f] for f in fs if f in self.index], int) for fs in listed]

    def barred(self, words: list[str]) -> np.ndarray:
        bars = np.zeros((len(words), len(KINDS) + 1))
        for t, w in enumerate(words):
            if not allowed(w):
                bars[t, 1:] = -1e9
        return bars

    def scores(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.array([self.emit[c].sum(axis=0) for c in columns])

    def marginals(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: label probabilities of each word, and the summed ones of neighbours."""
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True), m.squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis)))[1]
        n, k = score.shape
        f, b = np.zeros((n, k)), np.zeros((n, k))
        f[0] = score[0]
        for t in range(1, n):
            f[t] = score[t] + lse(f[t - 1][:, None] + self.move, 0)
        for t in range(n - 2, -1, -1):
            b[t] = lse(self.move + (score[t + 1] + b[t + 1])[None, :], 1)
        z = lse(f[-1], 0)
        edge = np.zeros((k, k))
        for t in range(1, n):
            edge += np.exp(f[t - 1][:, None] + self.move + (score[t] + b[t])[None, :] - z)
        return np.exp(f + b - z), edge

    def decode(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over a batch: one numpy step per word position for all sentences that reach it."""
        if not sentences:
            return []
        order = np.argsort([-len(s) for s in sentences], kind="stable")
        sizes = np.array([len(sentences[i]) for i in order])
        k = len(KINDS) + 1
        score = np.zeros((len(order), sizes[0], k))
        for r, i in enumerate(order):
            s = sentences[i]
            score[r, :len(s)] = self.scores(self.columns([features(s, t) for t in range(len(s))])) + self.barred(s)
        back = np.zeros(score.shape, np.int8)
        best = score[:, 0].copy()
        for t in range(1, sizes[0]):
            live = int((sizes > t).sum())
            paths = best[:live, :, None] + self.move[None]
            back[:live, t] = paths.argmax(axis=1)
            best[:live] = paths.max(axis=1) + score[:live, t]
        out: list[np.ndarray] = [np.zeros(0, int)] * len(order)
        for r, i in enumerate(order):
            labels = np.zeros(sizes[r], int)
            labels[-1] = best[r].argmax()
            for t in range(sizes[r] - 1, 0, -1):
                labels[t - 1] = back[r, t, labels[t]]
            out[i] = labels
        return out


def neighbourhoods(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) around the words that have a clue; near ones are joined."""
    out: list[list[tuple[int, int]]] = []
    n, at = len(text), 0
    while m := CLUE.search(text, at):
        lo, hi = m.start(), m.end()
        while lo > 0 and text[lo - 1] not in SPACE:
            lo -= 1
        while hi < n and text[hi] not in SPACE:
            hi += 1
        word, before, e = (lo, hi), [], lo
        stop = out[-1][-1][1] if out else 0
        for _ in range(CONTEXT):
            while e > stop and text[e - 1] in SPACE:
                e -= 1
            s = e
            while s > stop and text[s - 1] not in SPACE:
                s -= 1
            if s == e:
                break
            before.append((s, e))
            e = s
        joined = out and (e <= stop or not text[stop:e].strip(" \t\n\x0b\x0c\r"))
        if joined:
            out[-1] += [*before[::-1], word]
        else:
            out.append([*before[::-1], word])
        at = hi
    for words in out:      # the words after the last clue
        e = words[-1][1]
        for _ in range(CONTEXT):
            while e < n and text[e] in SPACE:
                e += 1
            s = e
            while e < n and text[e] not in SPACE:
                e += 1
            if s == e:
                break
            words.append((s, e))
    return out


def added_spans(text: str, runs: list[list[tuple[int, int]]], labels: list[np.ndarray],
                base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Runs of equal labels that pass their kind's check and touch no base span, nor each other.  ``taken`` holds the covered places
    as disjoint spans in order; base spans of different kinds may overlap and are merged there."""
    out: list[tuple[int, str, int]] = []
    taken: list[tuple[int, int]] = []
    for s, _, e in sorted(base):
        if taken and s < taken[-1][1]:
            taken[-1] = taken[-1][0], max(e, taken[-1][1])
        else:
            taken.append((s, e))

    def free(start: int, end: int) -> bool:
        at = bisect.bisect_left(taken, (end,))          # the spans before ``at`` start before ``end``
        return at == 0 or taken[at - 1][1] <= start
    for words, ys in zip(runs, labels):
        t = 0
        while t < len(ys):
            y, u = ys[t], t
            while u + 1 < len(ys) and ys[u + 1] == y:
                u += 1
            if y:
                piece = text[words[t][0]:words[u][1]]
                core = piece.strip(".,;:!?<>\"'[]{}=*#$%&|/")
                start = words[t][0] + piece.find(core)
                end, kind, digits = start + len(core), KINDS[y - 1], len(NUMERAL.findall(core))
                fits = {"email": "@" in core[1:-1], "ip": is_address(core),
                        "card": 12 <= digits <= 19 and luhn("".join(NUMERAL.findall(core))), "phone": 9 <= digits <= 15}
                if core and fits[kind] and free(start, end):
                    out.append((start, kind, end))
                    bisect.insort(taken, (start, end))
            t = u + 1
    return out


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=in_order))


def find(texts: list[str], crf: Crf) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text; the texts' neighbourhoods are decoded together."""
    base = [base_spans(t) for t in texts]
    runs = [neighbourhoods(t) for t in texts]
    flat = [[t[s:e] for s, e in words] for t, own in zip(texts, runs) for words in own]
    labels: list[np.ndarray] = []
    for lo in range(0, len(flat), 2000):
        labels += crf.decode(flat[lo:lo + 2000])
    out, at = [], 0
    for t, b, own in zip(texts, base, runs):
        out.append((b, added_spans(t, own, labels[at:at + len(own)], b)))
        at += len(own)
    return out


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans, and how many the CRF added."""
    crf = Crf(labelled_rows())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.iloc[lo:lo + 500]
                got = find(part["text"].tolist(), crf)
                counts = {f"n_{k}": [sum(s[1] == k for s in base) for base, _ in got] for k in KINDS}
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), **counts,
                    "base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got],
                    "spans": [written([*base, *more]) for base, more in got],
                    "n_added": [len(more) for _, more in got]})

    # ids travel as strings: pandas would turn integers with nulls into floats
    own = docs.select(F.col(doc_id).cast("string").alias("doc_id"), text_or_empty(text).alias("text"))
    out = own.mapInPandas(run, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, "
                               "base_sha256 string, spans string, n_added long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
