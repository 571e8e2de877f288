"""Sharding by extendible hashing.

A row's 60-bit hash is read from its highest bit on. A shard is a prefix of bits;
only a prefix whose rows exceed the byte limit is split on one more bit. Sums of
bytes are taken once at a depth some bits beyond the expected one; shorter prefixes
are summed upwards from those, four levels at a time, and only prefixes that are
still too large at that depth are summed again deeper.

Defined results: null text counts 0 bytes; ties can't arise (a row's hash covers id
and text); equal rows share a hash, and where their group alone exceeds the limit it
goes to overflow pages that hold as many copies as fit; a single row beyond the limit
gets a page of its own, the only shard that may exceed the limit. An empty table
gives an empty result. Columns of docs are kept; outputs named shard, shard_depth
and shard_bytes replace such columns of the input.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.storage import save, scope

BITS = 60
#: Directories up to this many cells are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_CELLS = 200_000


def row_digest(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def prefix(h: Column, depth: int | Column) -> Column:
    return F.shiftrightunsigned(h, BITS - depth) if isinstance(depth, int) else F.expr(f"shiftrightunsigned(h, int({BITS} - d))")


def summed(spark: SparkSession, cells: DataFrame, depth: int, top: int) -> list[DataFrame]:
    """d, p, bytes of all prefixes from ``top`` bits to ``depth``, from cells (p, bytes) at ``depth``.

    Four levels at a time are summed from the level below, so that at most 16 rows meet at a key.
    """
    out = [cells.select(F.lit(depth).alias("d"), "p", "bytes")]
    while depth > top:
        up = max(top, depth - 4)
        steps = cells.select("bytes", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.shiftrightunsigned("p", depth - d).alias("p")) for d in range(up, depth)])).alias("x"))
        level = save(spark, steps.groupBy("x.d", "x.p").agg(F.sum("bytes").alias("bytes")), "level")
        out.append(level)
        cells, depth = level.where(F.col("d") == up).select("p", "bytes"), up
    return out


def directory(spark: SparkSession, rows: DataFrame, limit: int, spare: int = 4) -> tuple[list[tuple[int, DataFrame]], bool]:
    """For each round the depth of its cells and a table of cell, shard, shard_depth, shard_bytes.

    rows: h, bytes. The second result tells whether rows in no cell are left, which need overflow pages.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, top, rounds = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + spare), 0, []
    while True:
        cells = save(spark, rows.groupBy(F.shiftrightunsigned("h", BITS - depth).alias("p")).agg(F.sum("bytes").alias("bytes")), "cells")
        # From the second round on the prefixes above are known to exceed the limit.
        nodes = reduce(DataFrame.unionByName, summed(spark, cells, depth, max(0, top - 1)))
        fits = nodes.where((F.col("bytes") <= limit) & (F.col("d") >= top))
        over = nodes.where(F.col("bytes") > limit).select((F.col("d") + 1).alias("o_d"), F.explode(F.array(F.col("p") * 2, F.col("p") * 2 + 1)).alias("o_p"))
        # A leaf fits and the prefix above it doesn't.
        split = fits.where("d > 0").join(over, (F.col("d") == F.col("o_d")) & (F.col("p") == F.col("o_p"))).select("d", "p", "bytes").unionByName(fits.where("d = 0"))
        leaves = save(spark, split, "leaves")
        deep = leaves.agg(F.max("d")).first()[0]
        if deep is not None:
            bits = F.expr("if(d = 0, '', lpad(bin(p), d, '0'))")
            # Each leaf as its cells at the depth of the deepest.
            spread = F.explode(F.expr(f"sequence(shiftleft(p, {deep} - d), shiftleft(p + 1, {deep} - d) - 1)"))
            rounds.append((deep, save(spark, leaves.select(spread.alias("cell"), bits.alias("shard"), F.col("d").alias("shard_depth"), F.col("bytes").alias("shard_bytes")), "directory")))
        large = cells.where(F.col("bytes") > limit).select("p")
        some = not large.isEmpty()
        if depth == BITS or not some:
            return rounds, some
        rows = save(spark, rows.withColumn("p", F.shiftrightunsigned("h", BITS - depth)).join(large, "p", "left_semi").drop("p"), "oversized")
        top, depth = depth + 1, min(BITS, depth + 12)


def shard(spark: SparkSession, docs: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """docs with shard (its bits, and the page of an overflow), shard_depth and shard_bytes."""
    cols = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")]
    digest = row_digest(F.col("doc_id"), F.col("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    with scope(spark) as own:
        rounds, some = directory(spark, save(spark, docs.select(h.alias("h"), size.alias("bytes")), "hashes"), limit)
        for _, leaves in rounds:
            own.keep(leaves)
    out = docs.select(*cols, F.struct(h.alias("h"), size.alias("bytes"), digest.alias("digest")).alias("docloom_row"))
    for k, (depth, leaves) in enumerate(rounds):
        small = leaves.count() <= BROADCAST_CELLS
        leaves = leaves.select(F.col("cell").alias(f"docloom_cell{k}"), F.struct("shard", "shard_depth", "shard_bytes").alias(f"docloom_leaf{k}"))
        out = out.join(F.broadcast(leaves) if small else leaves, F.shiftrightunsigned(F.col("docloom_row.h"), BITS - depth) == F.col(f"docloom_cell{k}"), "left").drop(f"docloom_cell{k}")
    no_leaf = F.lit(None).cast("struct<shard:string,shard_depth:int,shard_bytes:bigint>")
    out = out.withColumn("docloom_leaf", F.coalesce(no_leaf, *[F.col(f"docloom_leaf{k}") for k in range(len(rounds))]))
    placed = out.where("docloom_leaf is not null").select(*cols, "docloom_leaf.shard", "docloom_leaf.shard_depth", "docloom_leaf.shard_bytes")
    if not some:
        return placed
    # What is left are groups of equal rows beyond the limit.
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("docloom_row.bytes"))).cast("long")
    rest = out.where("docloom_leaf is null")
    pages = rest.groupBy(*cols, "docloom_row").agg(F.count("*").alias("docloom_n")).withColumn("docloom_fit", fit)
    pages = pages.withColumn("docloom_page", F.explode(F.expr("sequence(0L, (docloom_n - 1) div docloom_fit)")))
    pages = pages.withColumn("docloom_here", F.expr("least(docloom_fit, docloom_n - docloom_page * docloom_fit)")).withColumn("docloom_copy", F.explode(F.expr("sequence(1L, docloom_here)")))
    bits = F.expr(f"concat(lpad(bin(docloom_row.h), {BITS}, '0'), '.', substring(docloom_row.digest, 16), '.', docloom_page)")
    return placed.unionByName(pages.select(*cols, bits.alias("shard"), F.lit(BITS).alias("shard_depth"), F.expr("docloom_row.bytes * docloom_here").alias("shard_bytes")))
