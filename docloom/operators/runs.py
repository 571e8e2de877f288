"""Runs of rows in order: islands, ordered folds, nearest neighbours."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], order: list[str], same: Column, name: str = "run") -> DataFrame:
    """rows with the number of their run; a run goes on while ``same`` keeps its value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(same).over(w).eqNullSafe(same) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("docloom_new", new).withColumn(name, F.sum("docloom_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("docloom_new")


def fold(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An ordered state machine that needs a whole group at once; groups are those of one document or element."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(order, kind="stable"))

    return rows.groupBy(*keys).applyInPandas(run, schema)


def scan(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], machine: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """rows with a column that a state machine gives each in the order of its group.

    machine() makes a step for a group, a function of the inputs. Rows are dealt by the keys,
    sorted, and read once in Arrow batches; of a group only the machine's state is held, so
    that a long one takes no memory.
    """
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    to = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, machine()
        for batch in batches:
            out = []
            given = zip(*[batch.column(c).to_pylist() for c in inputs], strict=True)
            for key, values in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), given, strict=True):
                if key != at:
                    at, step = key, machine()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, to)], [*names, name])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{schema}, `{name}` {kind}")


def anchor(tolerance: float) -> Callable[[], Callable[[float], int]]:
    """Runs of values within tolerance of their first, numbered from 1."""

    def machine() -> Callable[[float], int]:
        first, run = None, 0

        def step(v: float) -> int:
            nonlocal first, run
            if first is None or not abs(v - first) <= tolerance:
                first, run = v, run + 1
            return run

        return step

    return machine


def sieve(tolerance: float) -> Callable[[], Callable[..., bool]]:
    """Whether a point is farther than tolerance from all accepted before it in some direction.

    Accepted points lie in bins of the tolerance's width, of which one holds few; a point
    is compared with those of its own and the next bins only.
    """

    def machine() -> Callable[..., bool]:
        bins: dict[tuple[int, ...], list[tuple[float, ...]]] = {}

        def step(*point: float) -> bool:
            own = tuple(int(v // tolerance) for v in point)
            for near in itertools.product(*[(b - 1, b, b + 1) for b in own]):
                if any(max(abs(x - y) for x, y in zip(point, q, strict=True)) <= tolerance for q in bins.get(near, ())):
                    return False
            bins.setdefault(own, []).append(point)
            return True

        return step

    return machine


def rungs(same: float = 2, step: float = 10) -> Callable[[], Callable[[float], int]]:
    """Levels of left edges: within ``same`` of a rung is that rung, ``step`` beyond the last opens one, if it matches the first step."""

    def machine() -> Callable[[float], int]:
        held: list[float] = []
        size = None

        def take(e: float) -> int:
            nonlocal size
            while len(held) > 1 and e < held[-1] - same:
                held.pop()
            if not held:
                held.append(e)
            elif e - held[-1] >= step and (size is None or abs(e - held[-1] - size) <= same):
                size = e - held[-1] if size is None else size
                held.append(e)
            return len(held) - 1

        return take

    return machine


def heading() -> Callable[[int | None, float], int | None]:
    """Heading levels: one H1 a scope, no skipped level; None where a row is no heading or opens too deep.

    A step takes the rank of a row's size, None for body text, and the size. A gap lowers the size and all smaller ones.
    """
    shift: dict[float, int] = {}
    prev, had_h1 = 0, False

    def step(rank: int | None, size: float) -> int | None:
        nonlocal prev, had_h1
        if rank is None:
            return None
        level = max(1, rank - sum(s for at, s in shift.items() if size <= at))
        if level == 1:
            level, had_h1 = (2, True) if had_h1 else (1, True)
        if level > prev + 1:
            if prev == 0:
                return None
            shift[size] = shift.get(size, 0) + level - prev - 1
            level = prev + 1
        prev = level
        return level

    return step


def anchored(values: list[float], tolerance: float) -> list[int]:
    step = anchor(tolerance)()
    return [step(v) for v in values]


def accepted(points: list[tuple[float, ...]], tolerance: float) -> list[bool]:
    step = sieve(tolerance)()
    return [step(*p) for p in points]


def ladder(edges: list[float], same: float = 2, step: float = 10) -> list[int]:
    take = rungs(same, step)()
    return [take(e) for e in edges]


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Each left row's nearest right row of its keys by column ``at``; backward wins ties.

    Both sides go through one window by key: the last right row before and the first after.
    left: keys, id, at. right: keys, id, at, unique by (keys, at).
    """
    both = left.select(*keys, at, F.col("id").alias("l_id"), F.lit(None).cast(right.schema["id"].dataType).alias("r_id")).unionByName(
        right.select(*keys, at, F.lit(None).cast(left.schema["id"].dataType).alias("l_id"), F.col("id").alias("r_id"))
    )
    w = Window.partitionBy(*keys).orderBy(at, F.col("r_id").isNull())
    mark = F.when(F.col("r_id").isNotNull(), F.struct(F.col("r_id").alias("id"), F.col(at).alias("at")))
    back = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    fore = F.first(mark, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("b", back).withColumn("f", fore).where("l_id is not null")
    nearer = F.col("f").isNotNull() & (F.col("b").isNull() | (F.col("f.at") - F.col(at) < F.col(at) - F.col("b.at")))
    pick = F.when(nearer, F.col("f")).otherwise(F.col("b"))
    return both.withColumn("pick", pick).where("pick is not null").select(*keys, F.col("l_id").alias("id"), F.col(at), F.col("pick.id").alias("near_id"), F.col("pick.at").alias("near_at"))
