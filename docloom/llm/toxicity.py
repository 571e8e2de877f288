"""Toxicity by a convolutional network over hashed word embeddings.

A word is its letters and digits. Its vector is the sum of rows of one table, looked up
by hashes of the word and of its first bytes (as many as ``PREFIXES`` say), twice each
with different hashes, so that two words share all rows only if they share a stem.
Filters of several widths slide over the words, the largest response of each over the
whole text goes through a rectifier into a logistic unit.

Training is numpy on the driver: a bounded sample of labelled rows (``most`` documents,
those of ``longest`` bytes or less), embeddings begun from shrunken class log-odds of
their hashes and tuned with all filters by AdaGrad. Rows of the table that no training
text touched stay zero. Thresholds for the ``flagged`` column are calibrated by
language on a part of the sample that the network wasn't trained on; a language with
few positives gets the common one. They don't enter the score.

Defined results: null and empty texts are scored as texts without words; rows with a
null id are never learned from and aren't held out; repeated ids of labels count as
toxic if any is; without labels all scores are 0. Equal texts get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.textbytes import SIGN, buffers, chunks, mix, words

PREFIXES = (4, 5, 6)
TABLE = 1 << 20
DIM = 4
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Empty places behind each text; filters may stand on the first two and see none of the next text.
PAD = 4
COMMON = 0.3


def rows_of(hashes: list[np.ndarray]) -> np.ndarray:
    """Rows of the table for each word."""
    out = np.empty((len(hashes[0]), 2 * len(hashes)), np.int32)
    for k, h in enumerate(hashes):
        g = mix(h + np.uint64(k * 0x51ED27))
        out[:, 2 * k] = (g & np.uint64(TABLE - 1)).astype(np.int32)
        out[:, 2 * k + 1] = (g >> np.uint64(40) & np.uint64(TABLE - 1)).astype(np.int32)
    return out


class Net:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = np.zeros((TABLE, DIM), np.float32)
        self.filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0] += 0.6 / len(f)
        self.shift = [np.full(FILTERS, -0.2, np.float32) for _ in WIDTHS]
        self.out = np.full(len(WIDTHS) * FILTERS, 0.5, np.float32)
        self.bias = np.float32(-3.0)
        self.thresholds: dict[str, float] = {}

    def packed(self) -> dict:
        """The network with the used rows of its table only."""
        used = np.flatnonzero(self.table.any(axis=1))
        return self.__dict__ | {"table": (used, self.table[used])}

    @classmethod
    def unpacked(cls, state: dict) -> Net:
        net = cls()
        used, own = state["table"]
        net.__dict__ |= state | {"table": np.zeros((TABLE, DIM), np.float32)}
        net.table[used] = own
        return net

    def responses(self, rows: np.ndarray, doc: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each width at each place, two of them behind a text's words. And where each text starts."""
        counts = np.bincount(doc, minlength=n)
        starts = np.concatenate([[0], np.cumsum(counts + PAD)])[:-1]
        x = np.zeros((len(rows) + PAD * n + 2, DIM), np.float32)
        vectors = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            vectors += self.table[rows[:, k]]
        x[np.arange(len(rows)) + PAD * doc] = vectors
        size = len(rows) + PAD * n
        got = [sum(x[k : k + size] @ f[k] for k in range(len(f))) + s for f, s in zip(self.filters, self.shift, strict=True)]
        for g in got:
            g[np.concatenate([starts + counts + 2, starts + counts + 3])] = -np.inf
        return got, starts

    def logits(self, rows: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        got, starts = self.responses(rows, doc, n)
        pooled = np.concatenate([np.maximum.reduceat(g, starts, axis=0) for g in got], axis=1)
        return np.maximum(pooled, 0) @ self.out + self.bias


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, at = buffers(texts)
    doc, hashes, _ = words(raw, at, SIGN, PREFIXES)
    return rows_of(hashes), doc


def score(net: Net, texts: pa.Array) -> np.ndarray:
    if not len(texts):
        return np.zeros(0)
    rows, doc = tokens(texts)
    return 1 / (1 + np.exp(-net.logits(rows, doc, len(texts)).astype(np.float64)))


def train(texts: list[str], labels: list[int], langs: list[str | None], epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 2) -> Net | None:
    """Every fifth text calibrates the thresholds."""
    y = np.array(labels, np.float32)
    if not len(y):
        return None
    net, rng = Net(), np.random.default_rng(seed)
    own: list[np.ndarray] = []
    for k in range(0, len(y), 256):
        part, doc = tokens(pa.array(texts[k : k + 256], pa.string()))
        own += np.split(part, np.searchsorted(doc, np.arange(1, len(texts[k : k + 256]))))
    fitted = np.flatnonzero(np.arange(len(y)) % 5 != 4) if len(y) >= 50 else np.arange(len(y))

    counts = np.zeros((2, TABLE), np.float32)
    for i in fitted:
        counts[int(y[i])][np.unique(own[i])] += 1
    total = counts.sum(0)
    n = np.array([(y[fitted] == c).sum() for c in (0, 1)], np.float32)
    odds = np.log((counts[1] + 0.2) / (n[1] + 0.4)) - np.log((counts[0] + 0.2) / (n[0] + 0.4))
    net.table[:, 0] = np.where(total > 0, odds * total / (total + 4) / own[0].shape[1], 0)
    net.table[:, 1:] = np.where(total[:, None] > 0, rng.normal(0, 0.02, (TABLE, DIM - 1)), 0)

    squares = {"table": np.full(TABLE, 1e-2, np.float32), "out": 1e-2, "bias": 1e-2, "filters": [1e-2] * len(WIDTHS)}
    for _ in range(epochs):
        order = rng.permutation(fitted)
        for i in range(0, len(order), batch):
            part = order[i : i + batch]
            mine = np.concatenate([own[d] for d in part])
            at = np.repeat(np.arange(len(part)), [len(own[d]) for d in part])
            got, starts = net.responses(mine, at, len(part))
            stops = np.append(starts[1:], len(mine) + PAD * len(part))
            where = [np.stack([g[a:b].argmax(axis=0) + a for a, b in zip(starts, stops, strict=True)]) for g in got]
            pooled = np.concatenate([np.take_along_axis(g, w, 0) for g, w in zip(got, where, strict=True)], axis=1)
            hidden = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-(hidden @ net.out + net.bias)))
            back = (p - y[part]) / len(part)
            grad = (back[:, None] * net.out) * (pooled > 0)
            place = np.full(len(mine) + PAD * len(part) + 3, -1)
            place[np.arange(len(mine)) + PAD * at] = np.arange(len(mine))
            touched, amounts = [], []
            for f, w in enumerate(WIDTHS):
                g = grad[:, f * FILTERS : (f + 1) * FILTERS]
                change = np.zeros_like(net.filters[f])
                for k in range(w):
                    word = place[where[f] + k]
                    ok = word >= 0
                    d, j = np.nonzero(ok)
                    at_rows = mine[word[ok]]
                    vec = net.table[at_rows].sum(axis=1)
                    np.add.at(change[k].T, j, vec * g[d, j][:, None])
                    touched.append(at_rows)
                    amounts.append(g[d, j][:, None] * net.filters[f][k].T[j])
                squares["filters"][f] = squares["filters"][f] + change**2
                net.filters[f] -= rate * change / np.sqrt(squares["filters"][f])
                net.shift[f] -= rate * g.sum(0)
            where_rows = np.concatenate(touched)
            amount = np.repeat(np.concatenate(amounts), where_rows.shape[1], axis=0)
            flat, inverse = np.unique(where_rows.ravel(), return_inverse=True)
            sums = np.zeros((len(flat), DIM), np.float32)
            np.add.at(sums, inverse, amount)
            squares["table"][flat] += (sums**2).sum(1)
            net.table[flat] -= rate * sums / np.sqrt(squares["table"][flat])[:, None]
            change = hidden.T @ back
            squares["out"] = squares["out"] + change**2
            squares["bias"] = squares["bias"] + back.sum() ** 2
            net.out = np.maximum(net.out - rate * change / np.sqrt(squares["out"]), 0).astype(np.float32)
            net.bias = np.float32(net.bias - rate * back.sum() / np.sqrt(squares["bias"]))

    rest = np.setdiff1d(np.arange(len(y)), fitted)
    s = 1 / (1 + np.exp(-np.array([net.logits(own[i], np.zeros(len(own[i]), np.int64), 1)[0] for i in rest])))
    for lang in sorted({x for x in langs if x}):
        mask = np.array([langs[i] == lang for i in rest], bool) if len(rest) else np.zeros(0, bool)
        net.thresholds[lang] = calibrate(s[mask], y[rest][mask]) if mask.any() and y[rest][mask].sum() >= 5 else COMMON
    return net


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap below the threshold with the best F1."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(labels[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + labels.sum())
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def sample(docs: DataFrame, labels: DataFrame, most: int, longest: int, fold: int, of: int) -> list:
    """Labelled rows outside the held-out fold, the first ones by a hash of the id."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    marks = marks.where(F.crc32(F.col("l_id").cast("string")) % of != fold).orderBy(F.xxhash64("l_id", F.lit("toxic")), "l_id").limit(most)
    own = docs.select("doc_id", "text", "lang").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest)
    rows = own.join(F.broadcast(marks), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "lang", "toxic")
    # Rows that repeat an id count as any other, up to most in all.
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id", F.xxhash64("text"), "lang").limit(most).collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.text or "", r.lang or ""))


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, longest: int = 1 << 16, fold: int = 2, of: int = 4) -> Net | None:
    rows = sample(docs, labels, most, longest, fold, of)
    return train([r.text or "" for r in rows], [int(r.toxic > 0) for r in rows], [r.lang for r in rows])


def classify(spark: SparkSession, docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, score, predicted (score >= COMMON), flagged (score >= its language's threshold)."""
    model = spark.sparkContext.broadcast(net.packed() if net else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net.unpacked(model.value) if model.value else None
        for batch in batches:
            for part in chunks(batch, 1):
                s = score(net, part.column(1)) if net else np.zeros(len(part))
                limit = np.array([(net.thresholds if net else {}).get(x, COMMON) for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array(s >= COMMON).cast(pa.int32()), pa.array(s >= limit).cast(pa.int32())], ["doc_id", "score", "predicted", "flagged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "lang").mapInArrow(run, f"doc_id {kind}, score double, predicted int, flagged int")
