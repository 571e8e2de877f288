"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of them. Each passage is
encoded by its make-up (kinds of bytes, capitals, runs of signs, words repeated one
after another or within the passage, word lengths), then by a learned layer. Gated
attention, a softmax over tanh(Vh) * sigmoid(Uh), weighs the passages of a document;
the score is a logistic unit on the weighted mean of their representations. Labels are
of documents only; which passages matter is learned.

Training is numpy on the driver over a bounded sample of labelled rows (``most``
documents, those of ``longest`` bytes or less).

Defined results: a null or empty text is one passage without words; rows with a null
id are never learned from and aren't held out; repeated ids of labels count as good if
any is; without labels all scores are 0. Equal texts get equal scores; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.textbytes import buffers, chunks, words

PASSAGE = 64
THRESHOLD = 0.7
HIDDEN = 16
GATE = 8


def _kinds() -> np.ndarray:
    """Class of each byte: small, capital, digit, blank, line end, stop, mark, bar, other sign, beyond ASCII."""
    out = np.full(256, 8)
    out[[*range(97, 123)]], out[[*range(65, 91)]], out[[*range(48, 58)]] = 0, 1, 2
    out[[9, 32]], out[[10, 11, 12, 13]] = 3, 4
    out[[ord(c) for c in ".,;:'\"()-"]] = 5
    out[[ord(c) for c in "!?"]] = 6
    out[ord("|")] = 7
    out[128:] = 9
    return out


KINDS = _kinds()
N_KINDS = 10
N_FEATURES = N_KINDS + 8


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text of each."""
    raw, at = buffers(texts)
    n = len(texts)
    doc, (h,), _ = words(raw, at)
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    per = np.maximum(1, -(-counts // PASSAGE))
    base = np.cumsum(per) - per
    passage = base[doc] + (np.arange(len(doc)) - first[doc]) // PASSAGE
    total = int(per.sum())
    owner = np.repeat(np.arange(n), per)
    x = np.zeros((total, N_FEATURES), np.float32)
    n_words = np.bincount(passage, minlength=total).astype(np.float32)

    # A passage's bytes run from its first word to the next passage's; they are counted segment by segment.
    kind = KINDS[raw] if len(raw) < 1 << 16 else KINDS.astype(np.int8)[raw]
    start = np.zeros(total + 1, np.int64)
    start[base] = at[:-1]
    start[-1] = at[-1]
    inner = np.flatnonzero(np.diff(owner, prepend=-1) == 0)
    if len(inner):
        begins = word_starts(raw, at)
        start[inner] = begins[np.searchsorted(passage, inner)]
    sizes = np.maximum(1, np.diff(start)).astype(np.float32)
    for k in range(N_KINDS):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        x[:, k] = (sums[start[1:]] - sums[start[:-1]]) / sizes
    signs = (kind >= 5) & (kind <= 8)
    after = np.concatenate([[False], signs[1:] & signs[:-1]]) if len(raw) else np.zeros(0, bool)
    after[at[:-1][at[:-1] < len(raw)]] = False  # a text's first sign follows none of another
    runs = np.concatenate([[0], np.cumsum(after, dtype=np.int64)])
    x[:, N_KINDS] = (runs[start[1:]] - runs[start[:-1]]) / sizes

    w = np.maximum(1, n_words)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    x[:, N_KINDS + 1] = np.bincount(passage[again], minlength=total) / w
    order = np.lexsort((h, passage))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    x[:, N_KINDS + 2] = np.bincount(passage[order][new], minlength=total) / w
    x[:, N_KINDS + 3] = sizes / w / 16
    x[:, N_KINDS + 4] = np.log1p(n_words) / 4
    x[:, N_KINDS + 5] = n_words == 0
    x[:, N_KINDS + 6] = x[:, 1] / np.maximum(x[:, 0] + x[:, 1], 1e-3)
    x[:, N_KINDS + 7] = np.sqrt(x[:, 6:9].sum(axis=1))
    return x, owner


def word_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    from docloom.llm.textbytes import SPACE

    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    first[edge] = inside[edge]
    return np.flatnonzero(first)


class Net:
    def __init__(self, seed: int = 13):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float64)
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.p = [make(N_FEATURES, HIDDEN), np.zeros(HIDDEN), make(HIDDEN, GATE), make(HIDDEN, GATE), make(GATE) * 0.1, make(HIDDEN) * 0.1, np.zeros(1)]

    def forward(self, x: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> tuple:
        w, c, v, u, a, o, b = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w + c)
        t, g = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * g) @ a
        e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
        weight = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
        return x, h, t, g, weight, z, 1 / (1 + np.exp(-(z @ o + b[0])))

    def step(self, x: np.ndarray, owner: np.ndarray, starts: np.ndarray, y: np.ndarray, balance: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean weighted log-loss."""
        w, _, v, u, a, o, _ = self.p
        x, h, t, g, weight, z, s = self.forward(x, owner, starts)
        d = balance * (s - y) / balance.sum()
        dz = d[:, None] * o
        dw = (dz[owner] * h).sum(axis=1)
        mean = np.add.reduceat(weight * dw, starts)
        de = weight * (dw - mean[owner])
        dt, dg = de[:, None] * a * g * (1 - t * t), de[:, None] * a * t * g * (1 - g)
        dh = (weight[:, None] * dz[owner] + dt @ v.T + dg @ u.T) * (1 - h * h)
        return [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, ((t * g).T @ de), z.T @ d, np.array([d.sum()])]


def train(texts: list[str], labels: list[int], steps: int = 400, rate: float = 0.03) -> Net | None:
    y = np.array(labels, np.float64)
    if not len(y):
        return None
    net = Net()
    x, owner = encode(pa.array(texts, pa.string()))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    net.mean, net.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    good = min(max(y.mean(), 0.05), 0.95)
    balance = np.where(y > 0, 1 / good, 1 / (1 - good))
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for k in range(steps):
        for i, g in enumerate(net.step(x, owner, starts, y, balance)):
            g = g + 1e-4 * net.p[i]
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            net.p[i] -= rate * (m[i] / (1 - 0.9 ** (k + 1))) / (np.sqrt(v[i] / (1 - 0.99 ** (k + 1))) + 1e-8)
    return net


def score(net: Net, texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    x, owner = encode(texts)
    return net.forward(x, owner, np.flatnonzero(np.diff(owner, prepend=-1)))[-1]


def sample(docs: DataFrame, labels: DataFrame, most: int, longest: int, fold: int, of: int) -> list:
    """Labelled rows outside the held-out fold, the first ones by a hash of the id."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"))
    marks = marks.where(F.crc32(F.col("l_id").cast("string")) % of != fold).orderBy(F.xxhash64("l_id", F.lit("quality")), "l_id").limit(most)
    own = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    rows = own.join(F.broadcast(marks), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "quality")
    # Rows that repeat an id count as any other, up to most in all.
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id", F.xxhash64("text")).limit(most).collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.text or ""))


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, longest: int = 1 << 16, fold: int = 2, of: int = 4) -> Net | None:
    rows = sample(docs, labels, most, longest, fold, of)
    return train([r.text or "" for r in rows], [int(r.quality > 0) for r in rows])


def classify(spark: SparkSession, docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, score and predicted (score >= THRESHOLD), in one pass without a shuffle."""
    model = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for part in chunks(batch, 1):
                s = score(net, part.column(1)) if net else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(s >= THRESHOLD).cast(pa.int32())], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
