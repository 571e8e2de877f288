"""Mixing sources to target weights by weighted sampling without replacement.

Each document draws an exponential key -ln(u)/w (Efraimidis and Spirakis), where u
comes from a hash of its id and w is its quality weight. A source that needs more
words than it has is taken in complete epochs first; the rest of its target is
filled by documents in key order until a prefix sum of sizes reaches it.

The order within a source is never sorted in one task: the logarithm of the key is cut
into ranges of 1 / ``buckets``, the sums of ranges are scanned (some thirty times
``buckets`` rows a source at most), and only rows of one (source, range) meet in a
window. The logarithm of an exponential key has no density above 0.37, whatever the
weights are, so that a range holds one in 2.7 * ``buckets`` of a source's rows at most.
Sources themselves are ordered over all tasks, too (running()).

Defined results: null text has size 0 and takes 0 words; null sources form one
source, the last; rows with equal ids draw equal keys and are ordered by size; a
source without words has target 0; an empty table gives an empty result. Extra
input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.storage import Scope, save, scope

WORD = r"[^\x20\x09-\x0D]+"
JUNK = r"[^\p{L}\p{N}\s]{2,}"
#: Tables of sources up to this many rows are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def running(spark: SparkSession, rows: DataFrame, order: list[str], sums: dict[str, Column], backwards: dict[str, Column] | None = None) -> DataFrame:
    """rows with sums of expressions over all rows before each in order, and others over it and all after it.

    Rows are dealt by ranges of the order; what meets in one task is a range, or the
    ranges' totals. The sums must be of whole numbers to be the same in any order.
    """
    backwards = backwards or {}
    cut = save(spark, rows.repartitionByRange(*order).withColumn("docloom_at", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("docloom_at").agg(*[F.sum(e).alias(f"docloom_{n}") for n, e in (sums | backwards).items()])
    up, down = Window.partitionBy(F.lit(0)).orderBy("docloom_at").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0)).orderBy("docloom_at").rowsBetween(1, Window.unboundedFollowing)
    # As many rows as there are partitions.
    totals = totals.select("docloom_at", *[F.coalesce(F.sum(f"docloom_{n}").over(up), F.lit(0)).alias(f"docloom_{n}") for n in sums], *[F.coalesce(F.sum(f"docloom_{n}").over(down), F.lit(0)).alias(f"docloom_{n}") for n in backwards])
    own = Window.partitionBy("docloom_at").orderBy(*order)
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
    here = {n: F.coalesce(F.sum(e).over(before), F.lit(0)) for n, e in sums.items()} | {n: F.sum(e).over(after) for n, e in backwards.items()}
    out = cut.join(F.broadcast(totals), "docloom_at").withColumns(here)
    return out.withColumns({n: F.col(n) + F.col(f"docloom_{n}") for n in here}).select(*rows.columns, *here)


def targets(spark: SparkSession, per_source: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Target words of each source by water-filling.

    per_source: sn (source is null), sk, source_size. Sources are capped in order of
    cap/weight; the level at which the first one isn't capped serves all others.
    """
    ranked = running(spark, per_source, ["sn", "sk"], {"i": F.lit(1)})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    t = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    t = save(spark, running(spark, t, ["ratio", "i"], {"capped": F.col("cap")}, {"rest": F.col("w")}), "levels")
    all_size = t.agg(F.sum("source_size")).first()[0] or 0
    t = t.withColumn("level", (F.lit(float(all_size)) * float(share) - F.col("capped")) / F.col("rest"))
    held = t.where("ratio > level").agg(F.min(F.struct("ratio", "i", "level"))).first()[0]
    return t.select("sn", "sk", "source_size", (F.col("cap") if held is None else F.least("cap", F.col("w") * held.level)).alias("target"))


def quality_weight(text: Column) -> Column:
    """From 1/9 to 1: the fewer runs of symbols a word, the higher."""
    n = words(text).cast("double")
    junk = F.coalesce(F.regexp_count(text, F.lit(JUNK)), F.lit(0)).cast("double")
    return 1.0 / (1.0 + 8.0 * F.least(F.lit(1.0), junk / F.greatest(n, F.lit(1.0))))


def draw(docs: DataFrame, weight: Column | None, seed: int, buckets: int) -> DataFrame:
    """docs and docloom_size, docloom_sn, docloom_sk, docloom_key, docloom_bucket."""
    key = -F.ln(uniform(F.col("doc_id"), seed)) / (quality_weight(F.col("text")) if weight is None else weight)
    out = docs.withColumns({"docloom_size": words(F.col("text")), "docloom_sn": F.col("source").isNull(), "docloom_sk": F.coalesce("source", F.lit("")), "docloom_key": key})
    return out.withColumn("docloom_bucket", F.floor(F.ln("docloom_key") * buckets).cast("int"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    weight: Column | None = None,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    buckets: int = 1024,
    split: bool = True,
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, key, taken, one row for each input row.

    weight: an expression above 0 over docs, quality_weight() of the text if None. split:
    the document that straddles a target is taken in part; else it is taken whole if at
    least half of it fits. epochs: how often the whole source is taken before the rest.
    """
    with scope(spark) as own:
        return _mixed(spark, docs, weight, weights, share, most, seed, buckets, split, own)


def _mixed(spark: SparkSession, docs: DataFrame, weight: Column | None, weights: tuple[int, ...], share: float, most: float, seed: int, buckets: int, split: bool, own: Scope) -> DataFrame:
    keyed = draw(docs.select("*"), weight, seed, buckets)
    keyed = own.keep(save(spark, keyed.select("doc_id", "source", F.col("docloom_size").alias("size"), F.col("docloom_sn").alias("sn"), F.col("docloom_sk").alias("sk"), F.col("docloom_key").alias("key"), F.col("docloom_bucket").alias("bucket")), "mix"))

    # Beyond its whole repeats a document has room for its size once more, or for the rest of a fractional limit.
    top = int(most)
    tail = F.floor(F.col("size") * float(most)) - F.col("size") * top
    room = {"size": F.col("size"), "tail": tail}
    sums = keyed.groupBy("sn", "sk", "bucket").agg(*[F.sum(x).alias(f"bucket_{n}") for n, x in room.items()])
    before = Window.partitionBy("sn", "sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sn", "sk", "bucket", *[F.coalesce(F.sum(f"bucket_{n}").over(before), F.lit(0)).alias(f"offset_{n}") for n in room])
    plan = targets(spark, keyed.groupBy("sn", "sk").agg(F.sum("size").alias("source_size")), weights, share, most)
    sums = own.keep(save(spark, sums.join(plan, ["sn", "sk"]), "sums"))

    here = Window.partitionBy("sn", "sk", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = keyed.withColumns({f"here_{n}": F.coalesce(F.sum(x).over(here), F.lit(0)) for n, x in room.items()}).join(sums, ["sn", "sk", "bucket"])
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    last = full >= top
    own_room = F.when(last, tail).otherwise(F.col("size"))
    taken = F.when(last, F.col("offset_tail") + F.col("here_tail")).otherwise(F.col("offset_size") + F.col("here_size"))
    left = F.round(F.col("target")).cast("long") - full * F.col("source_size") - taken
    part = F.greatest(F.lit(0), F.least(left, own_room)) if split else F.when(2 * left >= F.col("size"), own_room).otherwise(F.lit(0))
    return out.select("doc_id", "source", "size", "source_size", "target", full.alias("epochs"), "key", F.least(F.col("size") * full + part, F.floor(F.col("size") * float(most))).cast("long").alias("taken"))


def apply_mix(spark: SparkSession, docs: DataFrame, weight: Column | None = None, seed: int = 7, buckets: int = 1024, **how) -> DataFrame:
    """The mixed corpus: each row of docs as often as the mix takes it whole.

    What the mix decides is, for each source, its epochs and the last key of the
    fractional part, so only that table meets the texts and they aren't shuffled.
    Documents without words cost nothing and stay once.
    """
    order = F.struct("key", "doc_id", "size")
    with scope(spark) as own:
        taken = mix(spark, docs, weight, seed=seed, buckets=buckets, split=False, **how)
        cut = taken.groupBy(F.col("source").isNull().alias("docloom_c_sn"), F.coalesce("source", F.lit("")).alias("docloom_c_sk")).agg(
            F.max("epochs").alias("docloom_c_full"), F.max(F.when(F.col("taken") > F.col("size") * F.col("epochs"), order)).alias("docloom_c_last")
        )
        cut = own.keep(save(spark, cut, "cuts"))
    rows = draw(docs, weight, seed, buckets)
    on = (F.col("docloom_sn") == F.col("docloom_c_sn")) & (F.col("docloom_sk") == F.col("docloom_c_sk"))
    rows = rows.join(F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut, on, "left")
    within = F.coalesce(F.struct(F.col("docloom_key").alias("key"), "doc_id", F.col("docloom_size").alias("size")) <= F.col("docloom_c_last"), F.lit(False))
    n = F.when(F.col("docloom_size") == 0, 1).otherwise(F.col("docloom_c_full") + within.cast("int")).cast("int")
    return rows.withColumn("docloom_n", n).where("docloom_n > 0").withColumn("docloom_copy", F.explode(F.sequence(F.lit(1), F.col("docloom_n")))).select(*docs.columns)
