"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths run over fixed-length windows, each
filter's largest response in a window goes through a rectifier into a softmax
layer. A text's windows, all of them and short of none of its bytes, are predicted
in batches; their log-probabilities are averaged by bytes.

The network is fitted on a bounded sample of labelled rows (max_docs, dealt evenly
over the languages, chosen by a hash of the id; up to windows_per_doc windows of
each). Rows held out are never in it.

Null texts and texts without a letter are `und` with score 0, and so is every text
when no labelled row exists. Rows are predicted where they are: repeated rows come
back as often as they are there. A row with a null id counts as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekernel import buffers
from .common import text_batches

WINDOW = 256
_WIDTHS = (2, 3, 4)
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def held_out(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (bytes + 1, 0 beyond a text's end), the text of
    each, and its bytes."""
    n = np.diff(offsets)
    count = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + inside * WINDOW
    size = np.minimum(WINDOW, offsets[1:][text] - start)
    at = start[:, None] + np.arange(WINDOW)
    out = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int16) + 1 if len(data) else np.zeros((0, WINDOW), np.int16)
    out[np.arange(WINDOW) >= size[:, None]] = 0
    return out, text, size


@dataclass
class ByteCnn:
    langs: list[str]
    embed: np.ndarray  # 257 x e, row 0 stays 0
    filters: np.ndarray  # (widest * e) x f; rows beyond a filter's width stay 0
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], e: int = 8, per_width: int = 10, seed: int = 0) -> ByteCnn:
        rng, k = np.random.default_rng(seed), max(_WIDTHS)
        mask = np.concatenate([np.repeat((np.arange(k) < w)[:, None], per_width, 1) for w in _WIDTHS], axis=1).repeat(e, 0)
        f = per_width * len(_WIDTHS)
        embed = rng.normal(0, 0.5, (257, e))
        embed[0] = 0
        net = cls(langs, embed.astype(np.float32), (rng.normal(0, 0.3, (k * e, f)) * mask).astype(np.float32), np.zeros(f, np.float32), rng.normal(0, 0.1, (f, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32))
        net._mask = mask.astype(np.float32)
        return net

    def _patches(self, x: np.ndarray) -> np.ndarray:
        k, e = max(_WIDTHS), self.embed.shape[1]
        flat = np.zeros((len(x), WINDOW + k - 1, e), np.float32)
        flat[:, :WINDOW] = self.embed[x]
        s = flat.strides
        return np.lib.stride_tricks.as_strided(flat, (len(x), WINDOW, k * e), (s[0], s[1], s[2])).reshape(len(x) * WINDOW, k * e)

    def forward(self, x: np.ndarray):
        patches = self._patches(x)
        response = (patches @ self.filters).reshape(len(x), WINDOW, -1)
        return patches, response

    def log_probs(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        out = np.zeros((len(x), len(self.langs)), np.float32)
        for lo in range(0, len(x), step):
            _, response = self.forward(x[lo : lo + step])
            hidden = np.maximum(response.max(axis=1) + self.bias, 0)
            z = hidden @ self.out + self.out_bias
            z -= z.max(axis=1, keepdims=True)
            out[lo : lo + step] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 1) -> ByteCnn:
        rng = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        m1 = {k: np.zeros_like(getattr(self, k)) for k in names}
        m2 = {k: np.zeros_like(getattr(self, k)) for k in names}
        weight = len(y) / (len(self.langs) * np.maximum(np.bincount(y, minlength=len(self.langs)), 1))
        step, e = 0, self.embed.shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                xb, yb = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
                patches, response = self.forward(xb)
                best = response.argmax(axis=1)
                pre = np.take_along_axis(response, best[:, None], 1)[:, 0] + self.bias
                hidden = np.maximum(pre, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= weight[yb][:, None].astype(np.float32) / len(yb)
                d_pre = (p @ self.out.T) * (pre > 0)
                at = best + np.arange(len(xb))[:, None] * WINDOW
                d_filters = np.zeros_like(self.filters)
                d_embed = np.zeros_like(self.embed)
                for f in range(self.filters.shape[1]):
                    d_filters[:, f] = d_pre[:, f] @ patches[at[:, f]]
                padded = np.concatenate([xb, np.zeros((len(xb), max(_WIDTHS)), xb.dtype)], axis=1)
                for j in range(max(_WIDTHS)):
                    d = d_pre[:, :, None] * self.filters[j * e : (j + 1) * e].T[None]
                    np.add.at(d_embed, np.take_along_axis(padded, best + j, 1).reshape(-1), d.reshape(-1, e))
                d_embed[0] = 0
                grads = {"embed": d_embed, "filters": d_filters * self._mask, "bias": d_pre.sum(axis=0), "out": hidden.T @ p, "out_bias": p.sum(axis=0)}
                step += 1
                for k, g in grads.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    getattr(self, k)[...] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def sample_windows(docs: DataFrame, text: str, id_col: str, lang: str, max_docs: int, windows_per_doc: int, seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows and labels of at most about max_docs learning rows."""
    own = docs.select(F.col(id_col).alias("i"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t")).where(~held_out("i") & F.col("lang").isNotNull() & F.col("t").isNotNull())
    counts = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, WINDOW), np.int16), np.zeros(0, np.int64)
    each, unit = max(1, max_docs // len(langs)), 1 << 30
    keep = F.lit(0)
    for k in langs:
        keep = F.when(F.col("lang") == k, min(unit, int(each / counts[k] * unit))).otherwise(keep)
    some = own.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(unit)) < keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t"):
            data, offsets = buffers(texts)
            x, at, size = windows(data, offsets)
            cut = np.searchsorted(at, np.arange(len(texts) + 1))
            rows = sorted({int(a + (b - a - 1) * j // max(windows_per_doc - 1, 1)) for a, b in zip(cut[:-1], cut[1:]) if b > a for j in range(windows_per_doc)})
            ids = batch.column(0).to_pylist()
            names = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([str(ids[at[r]]) for r in rows], pa.string()), pa.array([names[at[r]] for r in rows], pa.string()), pa.array([x[r].astype(np.int16).tobytes() for r in rows], pa.binary())], names=["i", "lang", "x"])

    got = sorted((r["lang"], r["i"], bytes(r["x"])) for r in some.mapInArrow(run, "i string, lang string, x binary").toLocalIterator())
    x = np.frombuffer(b"".join(r[2] for r in got), np.int16).reshape(-1, WINDOW)
    return langs, x, np.array([langs.index(r[0]) for r in got], np.int64)


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", max_docs: int = 3000, windows_per_doc: int = 3, seed: int = 11) -> ByteCnn | None:
    langs, x, y = sample_windows(docs, text, id_col, lang, max_docs, windows_per_doc, seed)
    return ByteCnn.new(langs).fit(x, y) if len(x) else None


def predict(net: ByteCnn | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text of a large_string array without nulls."""
    data, offsets = buffers(texts)
    n = len(texts)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = letters[offsets[1:]] > letters[offsets[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
        has[i] = any(c.isalpha() for c in texts[i].as_py())
    if net is None or not has.any():
        return ["und"] * n, [0.0] * n
    x, at, size = windows(data, offsets)
    logs = net.log_probs(x) * size[:, None]
    total = np.zeros((n, len(net.langs)))
    np.add.at(total, at, logs)
    total /= np.maximum(np.diff(offsets), 1)[:, None]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [net.langs[b] if h else "und" for b, h in zip(best, has)], [float(p[i, b]) if h else 0.0 for i, (b, h) in enumerate(zip(best, has))]


def identify(docs: DataFrame, net: ByteCnn | None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, held_out, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "t"):
            names, scores = predict(shared.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def drop_unidentified(docs: DataFrame, net: ByteCnn | None, text: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of docs, whole, whose text has a language (not `und`) with at least
    min_score, in one pass and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, text):
            names, scores = predict(shared.value, texts)
            yield batch.filter(pa.array([n != "und" and s >= min_score for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
