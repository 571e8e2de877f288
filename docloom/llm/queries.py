"""Queries of this subpackage for the driver contract, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import mixing

    out = mixing.mix(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import sharding

    return sharding.shard(spark, table(spark, sf_dir, "documents")).select("doc_id", "shard", "shard_depth", "shard_bytes")


def op2_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import secrets

    spans = F.col("spans")
    # A second argument of a filter's function, even one with a default, would be the element's place.
    of = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    count = [of(k).alias(f"n_{name}") for k, name in enumerate(secrets.BASE)]
    base = secrets.joined(F.filter(spans, lambda s: s["kind"] < len(secrets.BASE)))
    out = secrets.scan(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", *count, F.sha2(base, 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op5_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import pii

    return pii.scan(table(spark, sf_dir, "documents"))


def held_out(of: int, fold: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False)).alias("held_out")


def op3_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import mil_quality

    docs = table(spark, sf_dir, "documents")
    net = mil_quality.fit(docs, table(spark, sf_dir, "labels"))
    return mil_quality.classify(spark, docs, net).select("doc_id", held_out(4, 2), "score", "predicted")


def op6_join_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import ngram_join

    return ngram_join.join(spark, table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_search_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import ann

    return ann.search(spark, table(spark, sf_dir, "embeddings"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import decontam

    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(spark, docs, net).select("doc_id", held_out(4, 2), "score", "predicted", "flagged")


def op10_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import langid

    docs = table(spark, sf_dir, "documents")
    out = langid.identify(spark, docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", held_out(3, 1), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_scan_secrets, op4_shard_documents, op5_find_pii, op3_score_quality, op6_join_ngrams, op7_search_neighbours, op8_decontaminate, op9_score_toxicity, op10_identify_language)}

ORACLES = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(len(regexp_extract_all(text, '[^\p{L}\p{N}\s]{2,}')), 0)::DOUBLE AS junk,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), keyed AS (
  SELECT *, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 8.0::DOUBLE * least(1.0::DOUBLE, junk / greatest(size::DOUBLE, 1.0::DOUBLE)))) AS key FROM sized
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM keyed GROUP BY source
), capped AS (
  SELECT *, [3.0, 1.0, 2.0][i % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM per_source
), levels AS (
  SELECT *, cap / w AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
         sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), held AS (
  SELECT arg_min(level, (ratio, i)) AS level FROM levels WHERE ratio > level
), plan AS (
  SELECT source, source_size, (CASE WHEN h.level IS NULL THEN cap ELSE least(cap, w * h.level) END)::DOUBLE AS target
  FROM levels LEFT JOIN held h ON true
), placed AS (
  SELECT k.doc_id, k.source, k.size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size) ELSE 0 END::BIGINT AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       least(size * epochs + greatest(0, least(round(target)::BIGINT - epochs * source_size - before, size)), size * 2)::BIGINT AS taken, source, epochs
FROM placed
"""

ORACLES["op4_shard_documents"] = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), sums AS (
  SELECT d, h >> (60 - d) AS p, sum(bytes)::BIGINT AS shard_bytes FROM hashed, range(0, 31) t(d) GROUP BY d, p
), leaf AS (
  SELECT h.doc_id, arg_min(struct_pack(d := s.d, p := s.p, b := s.shard_bytes), s.d) AS x
  FROM hashed h JOIN sums s ON s.p = (h.h >> (60 - s.d)) AND s.shard_bytes <= 8388608 GROUP BY h.doc_id, h.h
)
SELECT doc_id, CASE WHEN x.d = 0 THEN '' ELSE lpad(bin(x.p), x.d::INT, '0') END AS shard, x.d::INT AS shard_depth, x.b AS shard_bytes FROM leaf
"""

ORACLES["op6_join_ngrams"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * x >= 85 * (a.n + b.n - x)
), both_ways AS (
  SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.v FROM reach r JOIN both_ways t ON t.u = r.b
)
SELECT a AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) LEFT JOIN n ON n.doc_id = a
"""
