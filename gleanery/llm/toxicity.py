"""Toxicity of whole texts: noisy-channel deobfuscation, then a linear score.

Channel. A written word may hold leetspeak (a digit or sign for a letter), be
spaced out (single letters with separators between them) or have letters repeated
three times or more. Each such span is a lattice of what its characters may stand
for; Viterbi decoding finds the cheapest path under a character trigram model plus
the channel's costs. The trigram counts cover the texts of all documents.

Score. Logistic regression over the words of the restored text and their
beginnings, fitted on a bounded sample of labelled rows that are not held out
(max_per_class of each label, chosen by a hash of the id); its intercept is set to
the labels' rate over all learning rows. The features kept are those whose
presence tells most between the classes.

Null and empty texts have no features and get the score of the intercept. Without
any label every score is as good as 0 (under 1e-12). Of repeated labels of one id the
largest counts. Rows are scored where they are, so repeated rows come
back as often as they are there; a row with a null id counts as held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekernel import buffers, hashes, mix, spans
from .common import text_batches
from .langid_cnn import held_out

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
#: Signs between the letters of a spaced-out word.
SEPARATORS = " .-_*,/"
_GAP = re.compile(r"[ .\-_*,/]+")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_N = 28  # boundary, a-z, any other letter
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
#: Bytes of a word: letters, and all of UTF-8 beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_TO_CODE = np.zeros(256, np.int64)
for _c in range(26):
    _TO_CODE[0x41 + _c] = _TO_CODE[0x61 + _c] = _c + 1
_TO_CODE[0x80:] = 27

_leet_class = re.escape("".join(LEET))
#: A span that the channel may have made: a word with a sign before a letter or with
#: one or two as its last characters, three or more single characters with separators
#: between them, a letter three times. Three signs after a word are punctuation.
SPAN = re.compile(
    rf"(?<![^\W_])(?P<spaced>[A-Za-z{_leet_class}](?:[ .\-_*,/]+[A-Za-z{_leet_class}]){{2,}})(?![^\W_])"
    rf"|(?P<leet>(?:[A-Za-z]+|(?<![\w{_leet_class}]))[{_leet_class}]{{1,3}}[A-Za-z](?:[A-Za-z]|[{_leet_class}](?=[A-Za-z{_leet_class}]*[A-Za-z])|[0-9@$]{{1,2}}(?![\w{_leet_class}]))*"
    rf"|(?:[A-Za-z]{{2,}}[0-9@$]{{1,2}}|[A-Za-z](?:[@$][0-9@$]|[0-9][@$]))(?![\w{_leet_class}]))"
    r"|(?P<repeat>[A-Za-z]*([A-Za-z])(?i:\4)(?i:\4)[A-Za-z]*)"
)
#: Longest span whose reading is remembered; longer ones are decoded each time.
_REMEMBERED = 48


@dataclass
class Channel:
    """Viterbi decoding of one span; lm[x, y, z] is the cost of z after x, y."""

    lm: np.ndarray
    kept: float = 6.0  # a sign that stands for itself
    sign: float = 0.7
    dropped: float = 1.0  # a repeated letter that is one
    again: float = 2.5  # one of three or more equal letters that is kept
    pair: float = 8.0  # one of just two equal letters that is dropped
    gap: float = 6.0  # a separator that ends a word within a spaced-out span

    @classmethod
    def of_counts(cls, counts: np.ndarray, smooth: float = 20.0) -> Channel:
        c3 = counts.reshape(_N, _N, _N).astype(float)
        c2 = c3.sum(axis=0)
        c1 = c2.sum(axis=0)
        p1 = (c1 + 1) / (c1.sum() + _N)
        p2 = (c2 + smooth * p1) / (c2.sum(axis=1, keepdims=True) + smooth)
        p3 = (c3 + smooth * p2[None]) / (c3.sum(axis=2, keepdims=True) + smooth)
        return cls((-np.log(p3)).tolist())

    def decode(self, span: str) -> str:
        """The cheapest reading of a span, in lower case."""
        lm, text = self.lm, span.lower()
        spaced = sum(c in SEPARATORS for c in text) >= 2 and all(c in SEPARATORS for c in text[1:2])
        bare = "".join(c for c in text if c not in SEPARATORS or c in LEET)
        runs = [len(m[0]) for m in re.finditer(r"(.)\1*", bare) for _ in m[0]]
        long = iter([n > 2 for n in runs])
        # state: last two codes, last written letter -> (cost, output as (all before, last sign))
        states: dict = {(0, 0, ""): (0.0, None)}
        gaps = list(_GAP.finditer(text))
        usual = max((g[0] for g in gaps), key=Counter(g[0] for g in gaps).__getitem__, default="")
        wide = {g.start() for g in gaps if len(g[0]) > len(usual) or (" " in g[0] and " " not in usual)}
        for i, c in enumerate(text):
            new: dict = {}
            stretched = next(long) if c not in SEPARATORS or c in LEET else False

            def put(key, cost, out, new=new):
                if key not in new or cost < new[key][0]:
                    new[key] = (cost, out)

            for (x, y, last), (cost, out) in states.items():
                if c in SEPARATORS and c not in LEET:
                    # a gap wider than those between letters ends a word
                    put((x, y, last), cost + (self.gap if i in wide else 0.0), out)
                    if spaced and y:
                        put((y, 0, ""), cost + (0.0 if i in wide else self.gap) + lm[x][y][0], (out, " "))
                    continue
                if c in _CODE:
                    k = _CODE[c]
                    put((y, k, c), cost + lm[x][y][k] + (self.again if c == last and stretched else 0.0), (out, c))
                    if c == last:
                        put((x, y, last), cost + (self.dropped if stretched else self.pair), out)
                    continue
                for a in LEET.get(c, ""):
                    k = _CODE[a]
                    put((y, k, a), cost + self.sign + lm[x][y][k], (out, a))
                    if a == last:
                        put((x, y, last), cost + self.sign + (self.dropped if stretched else self.pair), out)
                put((y, 0, ""), cost + self.kept + lm[x][y][0], (out, c))
            states = new
        ends = [(cost + lm[x][y][0], out) for (x, y, _), (cost, out) in states.items()]
        out, read = min(ends, key=lambda e: e[0])[1], []
        while out:
            out, c = out
            read.append(c)
        return "".join(reversed(read))

    def restore(self, text: str) -> str:
        """text with every span of the channel in its cheapest reading."""
        return SPAN.sub(lambda m: _cached(self, m[0]) if len(m[0]) <= _REMEMBERED else self.decode(m[0]), text)


@lru_cache(200_000)
def _decode(channel_id: int, span: str) -> str:
    return _channels[channel_id].decode(span)


_channels: dict[int, Channel] = {}


def _cached(channel: Channel, span: str) -> str:
    if id(channel) not in _channels:
        _channels.clear()
        _decode.cache_clear()
        _channels[id(channel)] = channel
    return _decode(id(channel), span.lower())


def suspicious(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span of the channel; none that does is left out."""
    n = len(data)
    if not n:
        return np.zeros(len(offsets) - 1, bool)
    letter, sign = _ASCII_LETTER[data], _SIGN[data]
    after = lambda a, k: np.concatenate([a[k:], np.zeros(min(k, n), a.dtype)])[:n]
    mark = (sign & after(letter, 1)) | (letter & after(sign, 1) & ~after(_SIGN[data] & (data == 0x21), 1))
    low = data | 0x20
    mark |= letter & (low == after(low, 1)) & (low == after(low, 2))
    either = letter | sign
    alone = either & ~np.concatenate([[False], either[:-1]]) & ~after(either, 1)
    # a single character with gaps around it, then a character that may start and one that may end such a span
    alnum = letter | (data >= 0x80) | ((data >= 0x30) & (data < 0x3A))
    before, behind = np.concatenate([[False], alnum[:-1]]), after(alnum, 1)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = behind[inner - 1] = False
    solid = np.flatnonzero(either | (data >= 0x80))
    first, last = (either & ~before)[solid], (either & ~behind)[solid]
    mark[solid[1:-1]] |= alone[solid[1:-1]] & first[:-2] & last[2:]
    total = np.concatenate([[0], np.cumsum(mark)])
    return total[offsets[1:]] > total[offsets[:-1]]


def restore_array(texts: pa.Array, channel: Channel) -> pa.Array:
    rows = np.flatnonzero(suspicious(*buffers(texts))).tolist()
    if not rows:
        return texts
    out = texts.to_pylist()
    for i in rows:
        out[i] = channel.restore(out[i])
    return pa.array(out, pa.large_string())


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of each text and of the stems, of some bytes, of longer words."""
    data, offsets = buffers(texts)
    starts, ends, firsts = spans(data, offsets, _WORD)
    row = np.repeat(np.arange(len(texts)), np.diff(firsts))
    rows, out = [row], [hashes(data, starts, ends)]
    for n in _STEMS:
        some = ends - starts > n
        rows.append(row[some])
        out.append(mix(hashes(data, starts[some], starts[some] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(out)


_STEMS = (4, 5, 6, 7)


@dataclass
class Scorer:
    channel: Channel
    keys: np.ndarray  # sorted feature hashes
    maybe: np.ndarray  # by the low 20 bits: may a hash be a key?
    once: np.ndarray  # weights of a feature that occurs
    again: np.ndarray  # further weights of one that occurs more than once
    intercept: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        restored = restore_array(texts, self.channel)
        row, h = features(restored)
        h = h & ~np.uint64(1)
        z = np.full(len(texts), self.intercept)
        if len(self.keys):
            some = self.maybe[(h & np.uint64(0xFFFFF)).astype(np.int64)]
            row, h = row[some], h[some]
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == h
            pairs, times = np.unique(row[hit] * len(self.keys) + at[hit], return_counts=True)
            key = pairs % len(self.keys)
            np.add.at(z, pairs // len(self.keys), self.once[key] + np.where(times > 1, self.again[key], 0.0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def trigram_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Counts of all character trigrams of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for _, texts in text_batches(batches, "t"):
            data, offsets = buffers(texts)
            # two boundaries before each text and after the last: no trigram holds letters of two texts
            code = np.zeros(len(data) + 2 * len(texts) + 2, np.int64)
            code[np.arange(len(data)) + 2 * np.repeat(np.arange(1, len(texts) + 1), np.diff(offsets))] = _TO_CODE[data]
            total += np.bincount((code[:-2] * _N + code[1:-1]) * _N + code[2:], minlength=_N**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    out = np.zeros(_N**3, np.int64)
    for r in docs.select(F.col(text).alias("t")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["k"]] = r["n"]
    return out


def fit_logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, width: int, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on 0/1 features by accelerated gradient descent."""
    w, b = np.zeros(width), 0.0
    v, vb = w.copy(), b
    per_row = np.bincount(row, minlength=len(y))
    rate = 4.0 / (1 + per_row.max(initial=0)) * 4
    for t in range(steps):
        z = np.bincount(row, v[col], minlength=len(y)) + vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        gw = np.bincount(col, g[row], minlength=width) / len(y) * 10 + l2 * v
        gb = g.mean()
        nw, nb = v - rate * gw, vb - rate * gb
        m = t / (t + 3)
        v, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", max_per_class: int = 2500, max_features: int = 1500, seed: int = 5) -> Scorer:
    channel = Channel.of_counts(trigram_counts(docs, text))
    spark = docs.sparkSession
    own = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out("i")).groupBy("i").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    empty = Scorer(channel, np.zeros(0, np.uint64), np.zeros(1 << 20, bool), np.zeros(0), np.zeros(0), -30.0)
    if not counts.get(1) or not counts.get(0):
        return empty
    unit, keep = 1 << 30, F.lit(0)
    for k in (0, 1):
        keep = F.when(F.col("y") == k, min(unit, int(max_per_class / counts[k] * unit))).otherwise(keep)
    some = own.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(unit)) < keep)
    # the sample has a proven bound, about twice max_per_class rows
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).join(F.broadcast(some), "i")
    shared = spark.sparkContext.broadcast(channel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t"):
            row, h = features(restore_array(texts, shared.value))
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            times = np.diff(np.append(np.flatnonzero(new), len(h)))
            # the lowest bit tells a feature that occurs from one that occurs again
            h = h[new] & ~np.uint64(1)
            row = np.concatenate([row[new], row[new][times > 1]])
            h = np.concatenate([h, h[times > 1] | np.uint64(1)])
            order = np.argsort(row, kind="stable")
            row, h = row[order], h[order]
            cut = np.searchsorted(row, np.arange(len(texts) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["i", "y", "h"])

    got = sorted((r["i"], r["y"], bytes(r["h"])) for r in rows.select("i", "t", "y").mapInArrow(run, f"i {docs.schema[id_col].dataType.simpleString()}, y int, h binary").toLocalIterator())
    if not got:
        return empty
    y = np.array([r[1] for r in got], float)
    h = np.frombuffer(b"".join(r[2] for r in got), np.uint64)
    row = np.repeat(np.arange(len(got)), [len(r[2]) // 8 for r in got])
    del got
    keys, col, df = np.unique(h, return_inverse=True, return_counts=True)
    toxic = np.bincount(col, y[row], minlength=len(keys))
    n1, n0 = y.sum(), (1 - y).sum()
    a, b = toxic + 0.5, df - toxic + 0.5
    # a one-sided z score of the difference of the two rates
    p1, p0 = a / (n1 + 1), b / (n0 + 1)
    z = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    z[(df < 4)] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:max_features]
    best = np.sort(best[np.abs(z[best]) > 3])
    place = np.full(len(keys), -1)
    place[best] = np.arange(len(best))
    used = place[col] >= 0
    w, c = fit_logistic(row[used], place[col[used]], y, len(best), 0.02)
    rate, own_rate = counts[1] / (counts[0] + counts[1]), n1 / (n0 + n1)
    c += np.log(rate / (1 - rate)) - np.log(own_rate / (1 - own_rate))
    bases, at = np.unique(keys[best] & ~np.uint64(1), return_inverse=True)
    kind = (keys[best] & np.uint64(1)).astype(bool)
    once, again = np.zeros(len(bases)), np.zeros(len(bases))
    once[at[~kind]], again[at[kind]] = w[~kind], w[kind]
    maybe = np.zeros(1 << 20, bool)
    maybe[(bases & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return Scorer(channel, bases, maybe, once, again, float(c))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t"):
            s = shared.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def restore(docs: DataFrame, channel: Channel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and the restored text of every row; null texts are restored as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(channel)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column(0), restore_array(texts, shared.value).cast(pa.string())], names=[id_col, "restored"])

    return docs.select(F.col(id_col), F.col(text).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, restored string")
