"""N-gram Jaccard join by T-occurrence search.

Two documents link if the Jaccard similarity of their sets of k-word shingles reaches
num/den. Exact copies are one class, known by a digest of the set. For the others a
document's inverted lists are split as DivideSkip does: the L lists that are likely to be
longest are set aside, so that any linked document stands in T - L = ``least`` of the
others, the short ones. Those are merged first, over all documents, and lead to
families: documents that are connected through short lists. Within a family each document searches those
before it: short lists are merged by counting, the long ones are probed in the sets of those found,
and documents that reach the required overlap T are retained.

Only components and no pairs are wanted, so a search runs against leaders. A document
links to a leader, or else becomes one. As Jaccard distance is a metric, a document can
link to a leader's follower only if the leader is within twice the allowed distance;
followers of such leaders are tried until one links. No link between components is lost,
and a family of near copies costs a search each, not its square.

How it stays whole and bounded:

* Frequencies: shingle hashes of all documents are shuffled as packed arrays by ranges of
  the hash and counted; those in more than ``common`` documents (raised by doubling
  until ``most_common`` of them remain) are ordered last, by frequency, the others by
  length, since long words are rarer. That order only decides which lists are short; any
  order gives the same links.
* Lists: one of up to ``star`` documents counts its pairs, of which those seen in
  ``least`` lists stay; a longer one connects its members to its smallest at once, which
  is linear in its length and loses none. Equal sets count once in each.
* Families: where the shingles of one exceed ``family``, it is cut into parts by hash
  and each two parts are searched together, so that a task holds two parts at most; parts
  are dealt apart, by family and pair.

Defined results: null, empty and blank texts have no shingles and link with nothing;
rows that repeat an id have one component, that of their texts' links and of the id;
a null id keeps its size and has a null component; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.graph import components
from docloom.llm.lookup import look_up
from docloom.llm.shingles import shingle_sets
from docloom.llm.storage import Scope, save, scope
from docloom.llm.textbytes import chunks

#: Ids up to this many are sent to all executors to pick their documents; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(inter: int, a: int, b: int, num: int, den: int) -> bool:
    return den * inter >= num * (a + b - inter)


def short_length(n: int, num: int, den: int) -> int:
    """How many of a set's n shingles are sure to meet any linked set: n - ceil(n * num / den) + 1."""
    return n - -(-n * num // den) + 1


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, digest, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                sets = shingle_sets(part.column(1), k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, digest long")


def frequent(spark: SparkSession, docs: DataFrame, k: int, total: int, common: int, most_common: int, slice_size: int = 2_000_000) -> np.ndarray:
    """Hashes in more than ``common`` documents as (hash, count) sorted by hash; common doubles until they are few enough."""
    slices = max(8, -(-total // slice_size))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            # The highest 32 bits are the name under which a shingle is counted.
            names = np.sort((np.concatenate(held) >> np.uint64(32)).astype(np.uint32))
            at = (names.astype(np.uint64) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(at, np.arange(slices + 1))
            own = [s for s in range(slices) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([names[cuts[s] : cuts[s + 1]].tobytes() for s in own], pa.binary())], ["slice", "names"])

        for batch in batches:
            for part in chunks(batch, 0):
                sets = [s for s in shingle_sets(part.column(0), k) if len(s)]
                held += sets
                size += sum(map(len, sets))
                if size >= 1_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["names"]]))
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        n = np.diff(np.append(first, len(names)))
        own = n > common
        return pd.DataFrame({"name": names[first][own].astype(np.int64), "n": n[own].astype(np.int64)})

    counted = docs.select("text").mapInArrow(spread, "slice long, names binary").groupBy("slice").applyInPandas(count, "name long, n long")
    counted = save(spark, counted, "frequent")
    while counted.where(F.col("n") > common).count() > most_common:
        common *= 2
    rows = counted.where(F.col("n") > common).toPandas().sort_values("name")
    return rows["name"].to_numpy(np.uint32), rows["n"].to_numpy(np.int64)


def short_edges(spark: SparkSession, docs: DataFrame, k: int, num: int, den: int, often: tuple[np.ndarray, np.ndarray], total: int, least: int, star: int, slice_size: int = 500_000) -> DataFrame:
    """u, v: digests that stand together in ``least`` short lists, or in one that is longer than ``star``."""
    slices = max(8, -(-total // 5 // slice_size))
    model = spark.sparkContext.broadcast(often)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = model.value
        known: set[int] = set()
        for batch in batches:
            for part in chunks(batch, 0):
                tokens, owners, sizes = [], [], []
                for s, long in shingle_sets(part.column(0), k, sizes=True):
                    if not len(s):
                        continue
                    d = digest(s)
                    if d in known:
                        continue
                    if len(known) < 200_000:  # equal sets that slip through are met by meet()
                        known.add(d)
                    p = min(len(s), short_length(len(s), num, den) + least - 1)
                    rank = np.zeros(len(s), np.int64)
                    if len(names):
                        own = (s >> np.uint64(32)).astype(np.uint32)
                        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
                        rank = np.where(names[at] == own, counts[at], 0)
                    # By rank, then the longest, then by hash, by which s is sorted.
                    tokens.append(s[np.argsort((rank << 32) - long, kind="stable")[:p]])
                    owners.append(np.full(p, d, np.int64))
                    sizes.append(np.full(p, len(s), np.int32))
                if not tokens:
                    continue
                t, d, n = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
                at = ((t >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                t, d, n = t[order], d[order], n[order]
                cuts = np.searchsorted(at[order], np.arange(slices + 1))
                own = [x for x in range(slices) if cuts[x] < cuts[x + 1]]
                pack = lambda a, own=own, cuts=cuts: pa.array([a[cuts[x] : cuts[x + 1]].tobytes() for x in own], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pack(t), pack(d), pack(n)], ["slice", "t", "d", "n"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        t, d, n = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("t", np.uint64), ("d", np.int64), ("n", np.int32)))
        order = np.lexsort((d, t))
        t, d, n = t[order], d[order], n[order].astype(np.int64)
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
        t, d, n = t[new], d[new], n[new]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        length = np.diff(np.append(start, len(t)))
        u, v, need = [], [], []
        for m in np.unique(length[length > 1]):
            at = start[length == m]
            if m > star:
                for i in at:
                    u.append(d[i + 1 : i + m])
                    v.append(np.full(m - 1, d[i]))
                    need.append(np.zeros(m - 1, np.int64))
                continue
            i, j = np.triu_indices(m, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            fits = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
            a, b = a[fits], b[fits]
            u.append(d[b])
            v.append(d[a])
            need.append(np.minimum(least, -(-np.minimum(n[a], n[b]) * num // den)))
        if not u:
            return pd.DataFrame({"u": [], "v": [], "seen": [], "need": []}, dtype=np.int64)
        out = pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v), "need": np.concatenate(need)})
        return out.groupby(["u", "v"], as_index=False).agg(seen=("need", "size"), need=("need", "min"))[["u", "v", "seen", "need"]]

    lists = docs.select("text").mapInArrow(spread, "slice long, t binary, d binary, n binary")
    met = lists.groupBy("slice").applyInPandas(meet, "u long, v long, seen long, need long")
    return met.groupBy("u", "v").agg(F.sum("seen").alias("seen"), F.min("need").alias("need")).where("seen >= need").select("u", "v")


class Index:
    """Inverted lists of leaders; a search gives those that reach the overlap T, with their overlaps."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.sets: list[frozenset[int]] = []

    def add(self, tokens: list[int]) -> int:
        n = len(self.sets)
        for t in tokens:
            self.lists.setdefault(t, []).append(n)
        self.sets.append(frozenset(tokens))
        return n

    def search(self, tokens: list[int], t: int) -> list[tuple[int, int]]:
        """Leaders in at least t of the lists of tokens."""
        lists = self.lists
        found = [i for i in tokens if i in lists]
        if len(found) < t:
            return []
        found.sort(key=lambda i: len(lists[i]))
        # DivideSkip: the t - 1 longest lists are set aside; who is in t lists is in one of the others.
        rest = len(found) - max(0, t - 1)
        long = set(found[rest:])
        merged = Counter(chain.from_iterable([lists[i] for i in found[:rest]]))
        # A leader is in a long list if the list's token is in its set.
        near = [(x, n + len(self.sets[x] & long)) for x, n in merged.items() if n + len(long) >= t]
        return sorted((x, m) for x, m in near if m >= t)


def search_family(names: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect whatever links connect; see the module's text."""
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out: list[tuple[int, int]] = []

    def join(a: int, b: int) -> None:
        a_, b_ = root(a), root(b)
        if a_ != b_:
            parent[max(a_, b_)] = min(a_, b_)
            out.append((names[a], names[b]))

    # Twice the distance: similarity of 1 - 2 * (1 - num / den).
    wide = max(0, 2 * num - den)
    index, leaders, followers = Index(), [], []
    for x in sorted(range(len(names)), key=lambda i: (len(sets[i]), names[i])):
        own, n = sets[x].tolist(), len(sets[x])
        near = index.search(own, max(1, -(-n * wide // den)))
        led = False
        for r, inter in near:
            lead = leaders[r]
            m = len(sets[lead])
            if linked(inter, n, m, num, den):
                join(x, lead)
                # The first leader that it links to follows it up; others are joined as well.
                if not led:
                    followers[r].append(x)
                    led = True
        for r, inter in near:
            if linked(inter, n, len(sets[leaders[r]]), num, den) or not linked(inter, n, len(sets[leaders[r]]), wide, den):
                continue
            for f in followers[r]:
                m = len(sets[f])
                if root(f) == root(x) or den * min(n, m) < num * max(n, m):
                    continue
                if linked(overlap(sets[f], sets[x]), n, m, num, den):
                    join(x, f)
        if not led:
            index.add(own)
            leaders.append(x)
            followers.append([])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def search(spark: SparkSession, docs: DataFrame, members: DataFrame, k: int, num: int, den: int, family: int) -> DataFrame:
    """u, v: links of digests. members: doc_id, digest, root, one document of each class in a family."""
    small = members.count() <= BROADCAST_IDS
    own = members.select(F.col("doc_id").alias("docloom_m_id"), "digest", "root")
    rows = docs.select("doc_id", "text").join(F.broadcast(own) if small else own, F.col("doc_id") == F.col("docloom_m_id")).select("root", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                sets = shingle_sets(part.column(2), k)
                # A document with the id of another has another set.
                keep = [i for i, (s, d) in enumerate(zip(sets, part.column(1).to_pylist(), strict=True)) if len(s) and digest(s) == d]
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["root", "digest", "n", "s"])

    packed = save(spark, rows.mapInArrow(run, "root long, digest long, n long, s binary"), "sets")
    sizes = packed.groupBy("root").agg(F.sum("n").alias("all")).where(F.col("all") > family)
    cut = save(spark, sizes.select(F.col("root").alias("r"), F.ceil(F.col("all") / family).cast("int").alias("parts"), "all"), "cut")
    # Only families of several parts are looked up; there is one at most in so many shingles.
    dealt = look_up(packed, cut, "root", "r", "all", "digest")
    # Part p of c meets each other one: pairs (a, b) with a < b that p is one of; a family of one part is the pair (0, 0).
    dealt = dealt.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("digest", F.lit(6)), F.col("parts")).cast("int"))
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("p"))))
    dealt = dealt.select("root", "digest", "s", "p", other.alias("o")).select("root", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b"), "digest", "s")
    dealt = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come family by family; one pair of parts is held at a time."""
        at, held, out = None, {}, []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "a", "b", "digest", "s")]
            for *key, name, s in zip(*columns, strict=True):
                if key != at:
                    out += search_family(list(held), list(held.values()), num, den)
                    at, held = key, {}
                if name not in held:
                    held[name] = np.frombuffer(s, np.uint64)
            if len(out) > 10_000:
                yield told()
                out = []
        out += search_family(list(held), list(held.values()), num, den)
        yield told()

    return dealt.mapInArrow(meet, "u long, v long")


def join(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, common: int = 16, most_common: int = 1 << 21, least: int = 4, star: int = 32, family: int = 60_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), one row for each row of docs."""
    with scope(spark) as own:
        return _joined(spark, docs, k, num, den, common, most_common, least, star, family, own)


def _joined(spark: SparkSession, docs: DataFrame, k: int, num: int, den: int, common: int, most_common: int, least: int, star: int, family: int, own: Scope) -> DataFrame:
    known = own.keep(save(spark, sets_of(docs, k), "known"))
    total = known.agg(F.sum("n")).first()[0] or 0
    often = frequent(spark, docs, k, total, common, most_common)
    edges = save(spark, short_edges(spark, docs, k, num, den, often, total, least, star), "short")
    families = save(spark, components(spark, edges), "families")
    classes = known.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    members = save(spark, classes.join(families, F.col("digest") == F.col("node")).select("doc_id", "digest", "root"), "members")
    links = save(spark, search(spark, docs, members, k, num, den, family), "links")

    # Rows of one id with several texts connect their classes.
    ids = known.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("v"), F.max("digest").alias("m"))
    twice = known.where("digest is not null").join(ids.where("v <> m").select("doc_id", "v"), "doc_id").select(F.col("digest").alias("u"), "v")
    roots = components(spark, links.unionByName(twice))
    rooted = classes.join(roots, F.col("digest") == F.col("node"), "left").select("digest", F.coalesce("root", "digest").alias("root"), "doc_id", "rows")
    rooted = save(spark, rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("doc_id").alias("least"))
    # Only classes of several rows or with a link are looked up; any other row is its own component.
    named = rooted.join(first, "root").where("rows > 1 or doc_id <> least").select(F.col("digest").alias("c_digest"), "least", "rows")
    out = look_up(known, own.keep(save(spark, named, "named")), "digest", "c_digest", "rows", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """One row of each group, that of the smallest id, null ids last; rows without shingles stay. Rows are known by id and text."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit("")))
    with scope(spark) as own:
        found = join(spark, docs.select(key.alias("doc_id"), "text"), **how).where("n_shingles > 0").groupBy(F.col("doc_id").alias("row"), "component_id").agg(F.count("*").alias("n"))
        ids = docs.select(key.alias("row"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", text.alias("t")).alias("place")).distinct()
        found = save(spark, found.join(ids, "row"), "rows")
        # Rows alone in their component and in the table are kept as they are.
        first = found.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("in_all")).where("in_all > 1").withColumnRenamed("component_id", "c")
        told = look_up(found, save(spark, first, "first"), "component_id", "c", "in_all", "row").withColumn("kept", F.col("first").isNull() | F.col("place").eqNullSafe(F.col("first")))
        told = own.keep(save(spark, told.where("not kept or n > 1").select(F.col("row").alias("docloom_row"), "kept"), "told"))

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_IDS else df

    # Kept rows that repeat id and text are read once more and told to one.
    once = docs.join(sent(told), key == F.col("docloom_row"), "left_anti")
    more = docs.join(sent(told.where("kept")), key == F.col("docloom_row"), "left_semi").withColumn("docloom_row", key).dropDuplicates(["docloom_row"])
    return once.unionByName(more.drop("docloom_row"))
