"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame expressions only.

Words are runs of letters and digits in lower case; shingles are k of them (a shorter
item is one shingle of all its words). Shingles that a document shares with items tell
regions: a window of an item's size that is as similar as asked holds a share of shingles
of items of that size, in whatever order. Every window that holds so many is
fingerprinted, and beside them each in which a shared shingle stands at the item's own
place; texts without benchmark shingles cost one look each. A
fingerprint's 64 bits are cut into ``BLOCKS`` blocks; fingerprints within ``radius``
bits agree in some block up to radius / BLOCKS bits, so items are listed under all
block values that near, and an equi-join finds every pair within the radius. Pairs
are then verified by their exact weighted similarity: the sum of the smaller over
that of the larger counts of all shingles of window and item.

The fingerprint's angle estimates the similarity; at a similarity of 0.8 the distance
is 9.7 bits on average with a deviation of 2.9, so the radius of 16 leaves out one in
a hundred windows just at the threshold and far fewer above it.

Only shingles of items travel to the executors (behind a check of their number). Equal
windows, known by a 64-bit hash of their shingles, are fingerprinted and verified once; a
very common passage costs a row a document, and its documents are never gathered.

Defined results: null and empty texts match nothing, nor do items without words; items
of one word sequence are one item, named by its smallest id; rows that repeat an id are
matched each and give one row a document id and item, the most similar and then
first window; a row whose id is null is reported under null; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.lookup import look_up
from docloom.llm.storage import save, scope

BLOCKS = 4
#: Tables of up to so many rows are sent to all executors; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
WORDS = r"filter(split(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), w -> w <> '')"

#: Words as their hashes: all that follows compares shingles of these.
HASHED = f"transform({WORDS}, w -> xxhash64(w))"


def grams(words: str, k: int) -> str:
    """Hashes of all runs of k words, in order, from the words' hashes."""
    return f"CASE WHEN size({words}) >= {k} THEN transform(sequence(1, size({words}) - {k - 1}), i -> xxhash64(slice({words}, i, {k}), {k})) ELSE cast(array() AS array<bigint>) END"


def simhash(hashes: str) -> Column:
    """Bit b is set if more of the hashes have it than not, repeats counted."""
    bit = f"aggregate({hashes}, 0L, (n, h) -> n + 2L * (shiftrightunsigned(h, b) & 1L) - 1L) > 0"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | IF({bit}, shiftleft(1L, b), 0L))")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def items_of(spark: SparkSession, benchmark: DataFrame, k: int) -> DataFrame:
    """ikey, item_id, n (words), g (words a shingle), hs, fp."""
    words = benchmark.select("item_id", F.expr(HASHED).alias("words")).where("size(words) > 0")
    words = words.groupBy("words").agg(F.min("item_id").alias("item_id")).withColumn("n", F.size("words")).withColumn("g", F.least("n", F.lit(k)))
    own = "CASE " + " ".join(f"WHEN g = {j} THEN {grams('words', j)}" for j in range(1, k + 1)) + " END"
    items = words.select(F.xxhash64("words").alias("ikey"), "item_id", "n", "g", F.expr(own).alias("hs"))
    return save(spark, items.withColumn("fp", simhash("hs")), "items")


def block(fp: str, b: int) -> str:
    width = 64 // BLOCKS
    return f"shiftrightunsigned({fp}, {width * b}) & {(1 << width) - 1}L"


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 5, least: float = 0.8, radius: int = 16) -> DataFrame | None:
    """doc_id, t (hash of the text), ikey, item_id, s, n, similarity, distance of windows; None without items."""
    items = items_of(spark, benchmark, k)
    lengths = sorted(r.g for r in items.select("g").distinct().collect())
    if not lengths:
        return None
    keyed = docs.select("doc_id", text_hash().alias("t"), "text")
    places = small(items.select("n", "g", F.posexplode("hs").alias("j", "h")).select("n", "g", "j", "h").distinct())

    worded = keyed.select("doc_id", "t", F.expr(HASHED).alias("words"))
    every = [worded.select("doc_id", "t", F.size("words").alias("size"), F.lit(g).alias("dg"), F.posexplode(F.expr(grams("words", g))).alias("i", "dh")) for g in lengths]
    seen = every[0]
    for other in every[1:]:
        seen = seen.unionByName(other)
    hits = seen.join(places, (F.col("dh") == F.col("h")) & (F.col("dg") == F.col("g"))).select("doc_id", "t", "size", "g", "n", "i", F.expr("greatest(0, least(i - j, size - n))").alias("s"))
    hits = hits.groupBy("doc_id", "t", "size", "g", "n").agg(F.sort_array(F.collect_set("i")).alias("at"), F.collect_set("s").alias("own"))
    # A window of w shingles and an item of n - g + 1 share least * (w + n - g + 1) / (1 + least) of them or more.
    hits = hits.withColumn("w", F.expr("least(n, size) - g + 1")).withColumn("need", F.expr(f"greatest(1, cast(ceil({least}d / (1 + {least}d) * (w + n - g + 1) - 1e-9) AS int))"))
    # Starts of windows whose first hit is the m-th and that hold as many as needed.
    low = "greatest(0, get(at, m + need - 1) - w + 1, IF(m = 0, 0, get(at, m - 1) + 1))"
    spans = f"transform(sequence(0, size(at) - need), m -> struct({low} AS lo, least(get(at, m), greatest(0, size - n)) AS hi))"
    dense = f"CASE WHEN size(at) >= need THEN flatten(transform(filter({spans}, x -> x.lo <= x.hi), x -> sequence(x.lo, x.hi))) ELSE cast(array() AS array<int>) END"
    starts = save(spark, hits.select("doc_id", "t", "g", "n", F.explode(F.array_union("own", F.expr(dense))).alias("s")), "starts")

    # Texts of documents with windows are read once more and cut.
    own = starts.groupBy("doc_id", "t").agg(F.collect_set(F.struct("g", "n", "s")).alias("cuts")).withColumnsRenamed({"doc_id": "docloom_w_id", "t": "w_t"})
    own = save(spark, own, "cuts")
    texts = keyed.join(small(own), F.col("doc_id").eqNullSafe(F.col("docloom_w_id")) & (F.col("t") == F.col("w_t"))).dropDuplicates(["doc_id", "t"])
    cut = texts.select("doc_id", "t", F.expr(HASHED).alias("words"), "cuts").select("doc_id", "t", "words", F.explode("cuts").alias("c"))
    cut = cut.select("doc_id", "t", "c.*", F.expr("slice(words, c.s + 1, c.n)").alias("win"))
    hashes = "CASE " + " ".join(f"WHEN g = {g} THEN {grams('win', g)}" for g in lengths) + " ELSE cast(array() AS array<bigint>) END"
    windows = cut.select("doc_id", "t", "g", "n", "s", F.expr(hashes).alias("ws")).where("size(ws) > 0").withColumn("wk", F.xxhash64("ws", "g"))
    windows = save(spark, windows, "windows")
    # What many documents share is fingerprinted and verified once.
    contents = windows.groupBy("wk").agg(F.first("g").alias("g"), F.first("n").alias("n"), F.first("ws").alias("ws"), F.count("*").alias("rows")).withColumn("wf", simhash("ws"))
    contents = save(spark, contents, "contents")

    near = [x for x in range(1 << (64 // BLOCKS)) if x.bit_count() <= radius // BLOCKS]
    listed = items.select("ikey", F.col("n").alias("i_n"), F.col("g").alias("i_g"), "fp", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.expr(block("fp", b)).alias("v")) for b in range(BLOCKS)])).alias("x"))
    listed = listed.select("ikey", "i_n", "i_g", "fp", "x", F.explode(F.lit(near)).alias("flip")).select("ikey", "i_n", "i_g", "fp", "x.b", F.expr("x.v ^ flip").alias("v"))
    looked = contents.select("wk", "g", "n", "wf", F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.expr(block("wf", b)).alias("v")) for b in range(BLOCKS)])).alias("y")).select("wk", "g", "n", "wf", F.col("y.b").alias("wb"), F.col("y.v").alias("wv"))
    alike = (F.col("wb") == F.col("b")) & (F.col("wv") == F.col("v")) & (F.col("g") == F.col("i_g"))
    pairs = looked.join(listed.hint("merge"), alike).withColumn("distance", F.bit_count(F.expr("wf ^ fp"))).where(F.col("distance") <= radius)
    # Sizes beyond the threshold can't be similar enough.
    pairs = pairs.where(F.expr(f"least(n, i_n) - g + 1 >= {least} * (greatest(n, i_n) - g + 1)"))
    pairs = save(spark, pairs.select("wk", "ikey", "distance").distinct(), "pairs")

    counts = items.select("ikey", F.explode("hs").alias("h")).groupBy("ikey", "h").agg(F.count("*").alias("c")).withColumnsRenamed({"ikey": "c_key", "h": "c_h"})
    grown = contents.select("wk", "ws").join(pairs, "wk").select("wk", "ikey", "distance", F.size("ws").alias("w_all"), F.explode("ws").alias("h"))
    grown = grown.groupBy("wk", "ikey", "distance", "w_all", "h").agg(F.count("*").alias("m"))
    both = grown.join(small(counts), (F.col("ikey") == F.col("c_key")) & (F.col("h") == F.col("c_h")))
    inter = both.groupBy("wk", "ikey", "distance", "w_all").agg(F.sum(F.least("m", "c")).alias("inter"))
    about = items.select(F.col("ikey").alias("a_key"), "item_id", F.size("hs").alias("i_all"))
    sure = inter.join(small(about), F.col("ikey") == F.col("a_key")).withColumn("similarity", F.expr("inter / double(w_all + i_all - inter)")).where(F.col("similarity") >= least)
    sure = sure.groupBy("wk").agg(F.collect_list(F.struct("ikey", "item_id", "similarity", "distance")).alias("hit")).join(contents.select("wk", "rows"), "wk").withColumnRenamed("wk", "own")
    found = look_up(windows.select("doc_id", "t", "s", "n", "wk"), save(spark, sure, "sure"), "wk", "own", "rows", "s").where("hit is not null")
    return found.select("doc_id", "t", "s", "n", F.explode("hit").alias("x")).select("doc_id", "t", "x.ikey", "x.item_id", "s", "n", "x.similarity", "x.distance")


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, start (words before the window), n_words, similarity, distance."""
    with scope(spark) as own:
        found = matches(spark, docs, benchmark, **how)
        if found is not None:
            found = own.keep(save(spark, found, "found"))
    result = "doc_id, item_id, start, n_words, similarity, distance"
    if found is None:
        ids = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
        return spark.createDataFrame([], f"{ids}, start int, n_words int, similarity double, distance int")
    found = found.groupBy("doc_id", "ikey").agg(F.max("item_id").alias("item_id"), F.max_by(F.struct(F.col("s").alias("start"), F.col("n").alias("n_words"), "similarity", "distance"), F.struct("similarity", -F.col("s"), "t")).alias("best"))
    return found.select("doc_id", "item_id", "best.*").selectExpr(*result.split(", "))


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of docs that hold no benchmark item; rows are told apart by id and text."""
    with scope(spark) as own:
        found = matches(spark, docs, benchmark, **how)
        if found is None:
            return docs
        gone = own.keep(save(spark, found.select(F.col("doc_id").alias("docloom_gone"), F.col("t").alias("docloom_t")).distinct(), "gone"))
    return docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col("docloom_gone")) & (text_hash() == F.col("docloom_t")), "left_anti")
