"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled by the largest length and given one more component that makes their
length 1; queries are scaled to length 1 with 0 there. The nearest by distance are then
those of the largest inner product. Each of ``tables`` tables hashes a vector by ``width``
-wide cells along random normal (2-stable) directions, as many as the binary logarithm of
the number of vectors, so that cells grow finer with the table and the share of rows that
a query visits falls. A query visits perturbed cells in the order of their estimated
success, which falls with the squared distance from the query's projections to the cell,
up to a bound. The bound isn't guessed: for a bounded sample of queries the exact
neighbours are found in blocks over all rows, and the bound is taken that reaches
``recall`` of them in some table.

Cells are dealt to blocks by the codes of their first ``route`` directions; what lies in
more than ``block`` rows of a code is spread over several, so that no cell meets in one
task. All codes whose distance in these directions is within the bound, however many
steps away, are generated in ascending order, and the query goes to their blocks; there
cells are visited by the distance in all directions. Only rows of visited cells are its
candidates. They are reranked by the exact product in double precision, and the best of
all blocks and tables are merged. Queries that found fewer than ``k`` rows though there
are more, as outliers of clustered vectors and all of small tables do, are then answered
exactly in blocks over all rows.

Defined results: vectors that are null, zero, or have null or non-finite components take
no part, nor do those of another length than the commonest; null ids neither. Rows that
repeat an id are one, with the least vector. Of equal vectors the smallest ``k`` + 1
ids are kept, which no result can tell from all, for ties go to smaller ids. Fewer
candidates than k give fewer rows. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.storage import save, scope

#: Codes that lie in several blocks are told to all executors; blocks grow so that there are no more.
MOST_LARGE = 100_000


class Hash:
    """Codes of all tables; offsets are drawn once."""

    def __init__(self, size: int, longest: float, tables: int, dims: int, width: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.longest, self.width = longest, width
        self.lines = rng.normal(size=(tables, size + 1, dims))
        self.shift = rng.uniform(0, width, (tables, dims))

    def places(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of cells: (table, row, direction)."""
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            x = np.concatenate([x / norm, np.zeros_like(norm)], axis=1)
        else:
            x = np.concatenate([x / self.longest, np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))], axis=1)
        return (x @ self.lines + self.shift[:, None]) / self.width

    @staticmethod
    def gaps(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distance from each place to each cell, in cells: places (q, d), codes (c, d)."""
        out = np.zeros((len(places), len(codes)), np.float32)
        for p, c in zip(places.T.astype(np.float32), codes.T.astype(np.float32), strict=True):
            far = np.abs(p[:, None] - (c + np.float32(0.5))[None]) - np.float32(0.5)
            np.maximum(far, 0, out=far)
            out += far * far
        return out


def probes(place: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """All codes within the bound of one place and their squared distances, nearest first.

    Directions are taken one after another; what exceeds the bound already goes, so that
    only codes that some direction more can lead to a result are kept.
    """
    cost, codes = np.zeros(1), np.zeros((1, 0), np.int16)
    for p in place:
        steps = np.arange(np.floor(p - np.sqrt(bound)), np.floor(p + np.sqrt(bound)) + 1)
        far = np.maximum(np.abs(p - (steps + 0.5)) - 0.5, 0) ** 2
        every = cost[:, None] + far[None]
        i, j = np.nonzero(every <= bound)
        cost, codes = every[i, j], np.concatenate([codes[i], steps[j, None].astype(np.int16)], axis=1)
    order = np.argsort(cost, kind="stable")
    return codes[order], cost[order]


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def valid(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """vec_id, v: one row for each id that takes part; and the vectors' length."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(fine).select("vec_id", v.alias("v"))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = size.n if size else 0
    return own.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v")), size


def distinct(rows: DataFrame, k: int, salt: int = 16) -> DataFrame:
    """Of equal vectors the k + 1 smallest ids, by parts first."""
    some = rows.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(salt)))
    for key in (["v", "s"], ["v"]):
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return some.select("vec_id", "v")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    few = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return few[np.lexsort((ids[few], -scores[few]))][:k]


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of one vector with rows, each summed in the same order wherever it is computed."""
    return (x * q).sum(axis=1)


def nearest(name: int, q: np.ndarray, row: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block for one query; row holds rounded products, -inf for what isn't a candidate."""
    row[ids == name] = -np.inf
    # A few more than k, so that rounding in the block product decides nothing.
    at = best(row, ids, k + 12)
    at = at[row[at] > -np.inf]
    s = exact(q, x[at])
    at, s = at[np.lexsort((ids[at], -s))[:k]], np.sort(-s)[:k] * -1
    return pd.DataFrame({"query_id": np.full(len(at), name), "vec_id": ids[at], "score": s})


def together(out: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def ranked(met: DataFrame, k: int) -> DataFrame:
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exhaustive(queries: DataFrame, some: int, rows: DataFrame, n: int, k: int, block: int, together_of: int = 1024) -> DataFrame:
    """query_id, vec_id, score of the k best of each block of rows: every block of queries meets every block of rows."""
    q_blocks, r_blocks = -(-some // together_of), -(-n // block)

    def dealt(df: DataFrame, name: str, own: str, of: int, other: str, others: int) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.select(F.col("vec_id").alias(name), "v", F.pmod(F.xxhash64("vec_id"), F.lit(of)).cast("int").alias(own), spread)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            q, x = (np.array(side["v"].tolist(), np.float64) for side in (left, right))
            ids, names = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            for i in range(0, len(q), 64):
                g = q[i : i + 64] @ x.T
                out += [nearest(name, q[i + j], g[j], ids, x, k) for j, name in enumerate(names[i : i + 64])]
        return together(out)

    left = dealt(queries, "query_id", "qb", q_blocks, "rb", r_blocks).groupBy("qb", "rb")
    right = dealt(rows, "vec_id", "rb", r_blocks, "qb", q_blocks).groupBy("qb", "rb")
    return left.cogroup(right).applyInPandas(meet, "query_id long, vec_id long, score double")


def truth(spark: SparkSession, rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """Exact neighbours of few queries, in blocks over all rows."""
    sent = spark.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for batch in batches:
            own, x = batch.column(0).to_numpy(), vectors(batch.column(1))
            g = q @ x.T
            g[ids[:, None] == own[None]] = -np.inf
            found = [best(row, own, k) for row in g]
            at = np.concatenate(found)
            who = np.repeat(np.arange(len(ids)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), batch.column(0).take(pa.array(at)), pa.array(g[who, at]), batch.column(1).take(pa.array(at))], ["query_id", "vec_id", "score", "v"])

    out = rows.mapInArrow(run, f"query_id long, vec_id long, score double, v {rows.schema['v'].dataType.simpleString()}")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.where("score > double('-Infinity')").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toPandas()


def search(
    spark: SparkSession,
    embeddings: DataFrame,
    every: int = 20,
    k: int = 20,
    tables: int = 2,
    dims: int | None = None,
    width: float = 1.0,
    recall: float = 0.96,
    sampled: int = 100,
    block: int = 8192,
    route: int = 5,
    tell: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each row whose id is divisible by ``every``.

    dims: directions of a table, the binary logarithm of the number of vectors (at least 6) if
    None. tell: filled with bound, dims, and the queries that were answered exactly.
    """
    with scope(spark) as own:
        return own.keep(save(spark, _searched(spark, embeddings, every, k, tables, dims, width, recall, sampled, block, route, {} if tell is None else tell), "neighbours"))


def _searched(spark: SparkSession, embeddings: DataFrame, every: int, k: int, tables: int, dims: int | None, width: float, recall: float, sampled: int, block: int, route: int, tell: dict) -> DataFrame:
    kind = "query_id long, rank int, vec_id long, score double"
    rows, size = valid(embeddings, k)
    rows = save(spark, rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), "vectors")
    index = save(spark, distinct(rows, k), "index")
    n = index.count()
    if not n:
        return spark.createDataFrame([], kind)
    # Vectors travel in the precision that they have.
    exact_as = np.float64 if "double" in index.schema["v"].dataType.simpleString() else np.float32
    longest = float(index.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0]) * (1 + 1e-12)
    how = Hash(size, longest, tables, dims or max(6, round(np.log2(n))), width)
    route = min(route, how.lines.shape[2])

    queries = rows.where(F.col("vec_id") % every == 0)
    some = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sampled).toPandas().sort_values("vec_id")
    bound = 0.0
    if len(some):
        q = np.array(some["v"].tolist(), np.float64)
        near = truth(spark, index, some["vec_id"].to_numpy(np.int64), q, k)
        if len(near):
            at = np.searchsorted(some["vec_id"].to_numpy(), near["query_id"].to_numpy())
            p, c = how.places(q, True)[:, at], np.floor(how.places(np.array(near["v"].tolist(), np.float64), False))
            far = ((np.maximum(np.abs(p - (c + 0.5)) - 0.5, 0)) ** 2).sum(axis=2).min(axis=0)
            bound = float(np.quantile(far, recall)) + 1e-4
    # So that no more codes than MOST_LARGE lie in several blocks.
    block = max(block, -(-n * tables // MOST_LARGE))
    blocks = max(1, -(-n // block))
    tell |= {"bound": bound, "dims": how.lines.shape[2], "vectors": n, "exact": 0}
    kept = spark.sparkContext.broadcast((how, bound))

    def codes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, _ = kept.value
        for batch in batches:
            x = vectors(batch.column(1))
            for t, p in enumerate(how.places(x, False)):
                codes = np.floor(p).astype(np.int16)
                pack = lambda c: pa.array([r.tobytes() for r in c], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pack(np.ascontiguousarray(codes[:, :route])), pack(codes), batch.column(0), pack(x.astype(exact_as))], ["t", "head", "code", "vec_id", "x"])

    coded = save(spark, index.mapInArrow(codes_of, "t int, head binary, code binary, vec_id long, x binary"), "coded")
    large = coded.groupBy("t", "head").count().where(F.col("count") > block).collect()
    spread = spark.sparkContext.broadcast({(r.t, bytes(r["head"])): -(-r["count"] // block) for r in large})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = spread.value
        for batch in batches:
            t, heads, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            b = [(zlib.crc32(c) + (i % parts.get((a, c), 1))) % blocks for a, c, i in zip(t, heads, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b, pa.int32()), *batch.columns[2:]], ["t", "b", "code", "vec_id", "x"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how, bound = kept.value
        parts = spread.value
        for batch in batches:
            x = vectors(batch.column(1))
            who, table, to = [], [], []
            for t, places in enumerate(how.places(x, True)):
                for i, p in enumerate(places):
                    goal: dict[int, None] = {}
                    for m in probes(p[:route], bound)[0] if blocks > 1 else ():
                        name = m.tobytes()
                        for j in range(parts.get((t, name), 1)):
                            goal[(zlib.crc32(name) + j) % blocks] = None
                        if len(goal) == blocks:
                            break
                    goal = goal or {0: None}
                    who += [i] * len(goal)
                    table += [t] * len(goal)
                    to += goal
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(to, pa.int32()), batch.column(0).take(pa.array(who, pa.int64())), pa.array([x[i].astype(exact_as).tobytes() for i in who], pa.binary())], ["t", "b", "query_id", "x"])

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        how, bound = kept.value
        out = []
        if len(left) and len(right):
            x = np.stack([np.frombuffer(r, exact_as) for r in right["x"]]).astype(np.float64)
            ids = right["vec_id"].to_numpy()
            names, cell = np.unique(right["code"].to_numpy(), return_inverse=True)
            codes = np.stack([np.frombuffer(c, np.int16) for c in names])
            q = np.stack([np.frombuffer(r, exact_as) for r in left["x"]]).astype(np.float64)
            places = how.places(q, True)[key[0]]
            for i in range(0, len(q), 64):
                seen = (Hash.gaps(places[i : i + 64], codes) <= bound)[:, cell]
                g = np.where(seen, q[i : i + 64] @ x.T, -np.inf)
                out += [nearest(name, q[i + j], g[j], ids, x, k) for j, name in enumerate(left["query_id"].to_numpy()[i : i + 64])]
        return together(out)

    left = queries.mapInArrow(visits, "t int, b int, query_id long, x binary").groupBy("t", "b")
    right = coded.mapInArrow(dealt, "t int, b int, code binary, vec_id long, x binary").groupBy("t", "b")
    met = left.cogroup(right).applyInPandas(meet, "query_id long, vec_id long, score double")
    probed = save(spark, ranked(met, k), "probed")
    # All rows but a query's own are its candidates; the index tells as much of them as k rows can show.
    full = min(k, rows.count() - 1)
    counts = probed.groupBy("query_id").count()
    short = queries.join(counts, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("count", F.lit(0)) < full).select("vec_id", "v")
    short = save(spark, short, "short")
    tell["exact"] = some = short.count()
    if not some:
        return probed
    return ranked(probed.drop("rank").unionByName(exhaustive(short, some, index, n, k, block)), k)
