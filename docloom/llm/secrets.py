"""Secret scans with linking of credentials whose parts stand apart.

Certain parts, found on their own: ``assign`` (a name, a sign and a value of 12
characters or more), ``access`` (AKIA identifiers of 18 or more) and ``hex`` (16 or
more). Weak parts are reported only beside complementary ones:

* ``id``: an assigned user, client, account or access-key identifier;
* ``key``: a bare token of 24 characters or more that holds a letter and a digit;
* ``endpoint``: a URL of any scheme with a host, also behind ``jdbc:``, or a dotted host,
  an address or localhost with a port;
* ``short``: as ``assign``, with a value of less than 12 characters.

A scope is the ``scope`` characters from a part's end on to another part's start. A
``key`` is reported if an ``id`` or ``access`` is within scope; a ``short`` if one of
these or an ``endpoint`` is; an ``id`` if a secret (``key``, ``short``, ``assign`` or
``hex``) is; an ``endpoint`` if both an identifier and a secret are, be it in its own
query. A weak part that overlaps a certain one is that part seen again and isn't
reported, except that an endpoint may hold one.

Everything is a DataFrame expression. Positions come from splitting a text at its
matches: gaps and matches add up. Parts are linked by a band join: scopes are binned
by position, so that a part meets those of its own and the next bins only.

Defined results: null text is empty; rows that repeat an id or a text are told apart by
id and text, and equal rows get equal results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.storage import save

# No group repeats: Java would take a stack frame for each of its turns. Patterns by kind; a match of assign counts if its value has 12 characters or more.
PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "id": r"""([Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr]([Nn][Aa][Mm][Ee])?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "key": r"[A-Za-z0-9+/_=-]{24,}",
    "endpoint": r"""(?<![A-Za-z0-9+.-])([Jj][Dd][Bb][Cc]:)?[A-Za-z0-9+.-]++://([^\x20\x09-\x0D"'<>/@]*+@)?[A-Za-z0-9.-]+(:[0-9]+)?([/;?][^\x20\x09-\x0D"'<>]*)?|(?<![A-Za-z0-9+.-])([Ll][Oo][Cc][Aa][Ll][Hh][Oo][Ss][Tt]|(?=[A-Za-z0-9-]++\.)(?![A-Za-z0-9.-]*?\.\.)[A-Za-z0-9.-]++(?<!\.)):[0-9]{2,5}(?![0-9])""",
}
BASE = ("assign", "access", "hex")
#: Names of kinds; the last has no pattern of its own.
KINDS = (*PATTERNS, "short")


def pieces(text: Column, kind: str) -> Column:
    """Matches and the lengths of the gaps before each, or null without a match."""
    p = F.lit(PATTERNS[kind])
    found = F.struct(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.transform(F.split(text, PATTERNS[kind], -1), F.length).alias("g"))
    return F.when(F.regexp_like(text, p), found)


def parts(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, rid, size) of docs, and their parts: the same, kind, start, stop."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("rid"), F.length(text).alias("size"), *[pieces(text, k).alias(k) for k in PATTERNS])
    found = save(spark, found, "pieces")
    some = found.where(" or ".join(f"`{k}` is not null" for k in PATTERNS)).dropDuplicates(["doc_id", "rid", "size"])
    each = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), F.col(f"{k}.m").alias("m"), F.col(f"{k}.g").alias("g")) for k in PATTERNS])
    flat = some.select("doc_id", "rid", "size", F.explode(each).alias("x")).where("x.m is not null")
    flat = flat.select("doc_id", "rid", "size", "x.kind", F.posexplode(F.arrays_zip("x.m", F.slice("x.g", F.lit(1), F.size("x.m"))).alias("p")).alias("i", "p"))
    flat = flat.select("doc_id", "rid", "size", "kind", "i", F.col("p.m").alias("m"), F.col("p.1").alias("g")).withColumn("n", F.length("m"))
    w = Window.partitionBy("doc_id", "rid", "size", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("stop", F.sum(F.col("g") + F.col("n")).over(w).cast("long")).withColumn("start", F.col("stop") - F.col("n"))
    value = F.length(F.regexp_extract("m", PATTERNS["assign"], 2))
    flat = flat.withColumn("kind", F.when((F.col("kind") == 0) & (value < 12), KINDS.index("short")).otherwise(F.col("kind")))
    holds = (F.col("kind") == 4) & F.col("m").rlike("[0-9]") & F.col("m").rlike("[A-Za-z]") | F.col("kind").isin(0, 1, 2, 3, 5, 6)
    return found.select("doc_id", "rid", "size"), flat.where(holds).select("doc_id", "rid", "size", "kind", "start", "stop")


def scan(spark: SparkSession, docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, spans: array of (start, kind, stop) by start and kind, one row for each row of docs."""
    rows, found = parts(spark, docs)
    found = save(spark, found, "parts")
    own = ["doc_id", "rid", "size"]
    weak = found.where("kind >= 3").withColumn("bin", F.explode(F.expr(f"sequence((start - {scope}) div {scope}, (stop + {scope}) div {scope})")))
    other = found.select(*own, F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
    # A part longer than a scope lies in all bins that it touches, so that none within reach is missed.
    other = other.withColumn("bin", F.explode(F.expr(f"sequence(o_start div {scope}, o_stop div {scope})")))
    on = [weak[c].eqNullSafe(other[c]) for c in own] + [weak["bin"] == other["bin"], F.col("o_start") <= F.col("stop") + scope, F.col("start") <= F.col("o_stop") + scope]
    near = weak.join(other.select(*[F.col(c) for c in other.columns]), on).select(*[weak[c] for c in own], "kind", "start", "stop", "o_kind", "o_start", "o_stop")
    cross = (F.col("o_start") < F.col("stop")) & (F.col("start") < F.col("o_stop"))
    # What stands in an endpoint, such as its query, isn't the endpoint seen again.
    inside = lambda a, b: (F.col(f"{a}kind") == 5) & (F.col(f"{a}start") <= F.col(f"{b}start")) & (F.col(f"{b}stop") <= F.col(f"{a}stop")) & (F.col(f"{b}kind") != 5)
    apart = ~cross | inside("", "o_") | inside("o_", "")
    near = near.groupBy(*own, "kind", "start", "stop").agg(
        F.max(~apart & F.col("o_kind").isin(0, 1, 2)).alias("again"),
        F.max(apart & F.col("o_kind").isin(1, 3)).alias("by_id"),
        F.max(apart & F.col("o_kind").isin(0, 2, 4, 6)).alias("by_key"),
        F.max(apart & (F.col("o_kind") == 5)).alias("by_endpoint"),
    )
    linked = near.where("not again and (kind = 3 and by_key or kind = 4 and by_id or kind = 5 and by_id and by_key or kind = 6 and (by_id or by_endpoint))")
    kept = found.where("kind < 3").unionByName(linked.select(*own, "kind", "start", "stop"))
    spans = kept.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("spans"))
    spans = spans.select(*[F.col(c).alias(f"s_{c}") for c in own], "spans")
    out = rows.join(spans, [rows[c].eqNullSafe(F.col(f"s_{c}")) for c in own], "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")).alias("spans"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
