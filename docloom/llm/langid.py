"""Language identification by a convolutional network over bytes.

Texts are cut into windows of ``WINDOW`` bytes, all of them, and each window runs
through filters of several widths over one-hot bytes; each filter's largest response
in the window goes through a rectifier into a softmax. A document's class is that of
the mean of its windows' log-probabilities, weighted by their lengths.

The network is trained with numpy on the driver, on passages of a bounded sample of
labelled rows (``per_lang`` documents of each language, ``passage`` characters of each, of the
``most_langs`` commonest languages);
the sample is drawn by a hash of the id, so that reruns agree. Filters over one-hot
bytes are tables, and pairs of bytes are looked up at once.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so do
all texts if no labelled row may be learned from. Rows with a null id are never
learned from and aren't held out. Equal texts get equal results; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.textbytes import buffers, chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bytes with A-Z as a-z.
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


class Net:
    """tables: for each width an array (offset, byte, filter)."""

    def __init__(self, langs: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pairs(self) -> list[list[np.ndarray]]:
        """Each width's tables, two offsets in one wherever there are two."""
        out = []
        for t in self.tables:
            own = [(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) for k in range(0, len(t) - 1, 2)]
            out.append(own + ([t[-1]] if len(t) % 2 else []))
        return out

    def pooled(self, grid: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Largest responses in each row of bytes; rows are padded with zeros."""
        two = grid[:, :-1].astype(np.int32) << 8 | grid[:, 1:]
        out = []
        for w, tables in zip(WIDTHS, pairs, strict=True):
            n = grid.shape[1] - w + 1
            got = None
            for k, t in enumerate(tables):
                part = t.take(two[:, 2 * k : 2 * k + n] if len(t) == 65536 else grid[:, 2 * k : 2 * k + n], axis=0)
                got = part if got is None else np.add(got, part, out=got)
            out.append(got.max(axis=1))
        return np.concatenate(out, axis=1)

    def log_probs(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def grid_of(parts: list[bytes], width: int = WINDOW) -> np.ndarray:
    out = np.zeros((len(parts), width), np.uint8)
    for i, p in enumerate(parts):
        out[i, : min(width, len(p))] = np.frombuffer(p[:width], np.uint8)
    return out


def train(rows: list[tuple[str, str]], steps: int = 500, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Net | None:
    """rows: text and language."""
    rows = [(t.encode().lower(), g) for t, g in rows if t]
    langs = sorted({g for _, g in rows})
    if not langs:
        return None
    rng, net = np.random.default_rng(seed), Net(langs)
    by = [[t for t, g in rows if g == x] for x in langs]
    params = [*net.tables, net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(steps):
        y = rng.integers(0, len(langs), batch)
        parts = []
        for c in y:
            t = by[c][rng.integers(len(by[c]))]
            n = int(rng.integers(8, WINDOW + 1)) if rng.random() < 0.5 else WINDOW
            i = int(rng.integers(0, max(1, len(t) - n)))
            parts.append(t[i : i + n])
        grid = grid_of(parts)
        responses, where = [], []
        for w, t in zip(WIDTHS, net.tables, strict=True):
            n = WINDOW - w + 1
            got = sum(t[k].take(grid[:, k : k + n], axis=0) for k in range(w))
            at = got.argmax(axis=1)
            where.append(at)
            responses.append(np.take_along_axis(got, at[:, None], 1)[:, 0])
        pooled = np.concatenate(responses, axis=1)
        hidden = np.maximum(pooled, 0)
        p = np.exp(net.log_probs(pooled))
        p[np.arange(batch), y] -= 1
        p /= batch
        grads = [np.zeros_like(t) for t in net.tables]
        back = (p @ net.out.T) * (pooled > 0)
        for f, w in enumerate(WIDTHS):
            g = back[:, f * FILTERS : (f + 1) * FILTERS]
            for k in range(w):
                b = np.take_along_axis(grid, where[f] + k, 1)
                np.add.at(grads[f][k], (b, np.arange(FILTERS)[None].repeat(batch, 0)), g)
        for i, (x, g) in enumerate(zip(params, [*grads, hidden.T @ p, p.sum(0)], strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            x -= rate * (m[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[i] / (1 - 0.999 ** (step + 1))) + 1e-6)
        for t in net.tables:
            t[:, 0] = 0  # padding says nothing
    return net


def sample(docs: DataFrame, per_lang: int, passage: int, fold: int, of: int, most_langs: int = 1000) -> list[tuple[str, str]]:
    """Passages of about per_lang documents of each language outside the held-out fold; of the commonest most_langs languages."""
    known = docs.select("doc_id", "text", "lang").where(F.crc32(F.col("doc_id").cast("string")) % of != fold).where("lang is not null and text is not null and length(text) > 0")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not counts:
        return []
    rate = F.create_map(*[x for g, n in sorted(counts.items()) for x in (F.lit(g), F.lit(min(1.0, per_lang / n)))])
    h = F.xxhash64("doc_id", F.lit("langid"))
    at = F.pmod(h, F.greatest(F.lit(1), F.length("text") - passage)).cast("int") + 1
    # Who has an id many times over is drawn with it; the order by the hash makes the limit that bounds this definite.
    drawn = known.where(F.pmod(h, F.lit(1 << 20)) < F.coalesce(F.try_element_at(rate, F.col("lang")), F.lit(0.0)) * (1 << 20))
    drawn = drawn.select("doc_id", F.substring(F.col("text"), at, F.lit(passage)).alias("t"), "lang", h.alias("h"))
    rows = drawn.orderBy("h", "doc_id", "t", "lang").limit(2 * per_lang * len(counts)).collect()
    return [(r.t, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.t, r.lang))]


def predict(net: Net | None, texts: pa.Array, pairs: list[list[np.ndarray]] | None, block: int = 256) -> tuple[list[str], np.ndarray]:
    raw, at = buffers(texts)
    n = len(texts)
    letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    if net is None:
        return ["und"] * n, np.zeros(n)
    sizes = np.diff(at)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(n), per)
    start = at[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * WINDOW
    size = np.minimum(WINDOW, at[1:][owner] - start)
    padded = np.concatenate([LOWER[raw], np.zeros(WINDOW, np.uint8)])
    sums = np.zeros((n, len(net.langs)))
    for i in range(0, len(owner), block):
        grid = padded[start[i : i + block, None] + np.arange(WINDOW)]
        grid[np.arange(WINDOW) >= size[i : i + block, None]] = 0
        np.add.at(sums, owner[i : i + block], net.log_probs(net.pooled(grid, pairs)) * size[i : i + block, None])
    mean = sums / np.maximum(sizes, 1)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [net.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1), 0.0)


def fit(docs: DataFrame, per_lang: int = 800, passage: int = 600, fold: int = 1, of: int = 3) -> Net | None:
    return train(sample(docs, per_lang, passage, fold, of))


def identify(spark: SparkSession, docs: DataFrame, net: Net | None, added: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """docs with the language and its score, in one pass without a shuffle; they replace columns of these names."""
    model = spark.sparkContext.broadcast(net)
    docs = docs.drop(*added)
    names = [*docs.columns, *added]
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        pairs = net.pairs() if net else None
        for batch in batches:
            for part in chunks(batch, k):
                langs, scores = predict(net, part.column(k), pairs)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{added[0]}` string, `{added[1]}` double")


def keep_known(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """Rows of docs whose language is known; those without a letter go."""
    return identify(spark, docs, fit(docs, **how), ("docloom_lang", "docloom_score")).where("docloom_lang <> 'und'").select(*docs.columns)
