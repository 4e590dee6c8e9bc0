"""The corpus operators as named queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, toxicity
from tessera.llm.common import documents
from tessera.llm.line_dedup import line_dedup
from tessera.llm.minhash import classes, fingerprint_pairs
from tessera.llm.mixing import mix
from tessera.llm.packing import pack
from tessera.llm.sharding import shard_by_bytes
from tessera.llm.simhash import near_duplicates
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.topk_search import search


def _crc_mod(n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n, F.lit(0))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), length=200)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir), 16)


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), F.col("doc_id") % 100 == 0, k=10)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), capacity=1024)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (_crc_mod(5) == 0).alias("held_out"))
    model = langid.train(docs.where("not held_out and lang is not null"))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (_crc_mod(4) == 2).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.where("not held_out"), labels.where(_crc_mod(4) != 2))
    scored = toxicity.score(docs.select("doc_id", "text", "held_out"), model)
    return scored.select("doc_id", "held_out", F.col("__score").alias("score"), (F.col("__score") >= toxicity.CUT).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir), min_chars=40, min_docs=5).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = classes(fingerprint_pairs(docs), docs).drop("text_hash", "set_hash")
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_simhash, op3_sharding, op4_topk_search, op5_packing, op6_mixing, op7_language_id, op8_toxicity, op9_line_dedup, op10_fingerprints, pipeline)
}

OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS word FROM documents),
t AS (SELECT doc_id, word, count(*)::DOUBLE AS tf FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(tf) AS n FROM t GROUP BY doc_id),
c AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS docs, (SELECT sum(n) FROM l)::DOUBLE / (SELECT count(*) FROM documents)::DOUBLE AS mean),
f AS (SELECT word, ln(1 + (any_value(docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM t, c GROUP BY word),
s AS (
  SELECT q.doc_id AS query_id, t.doc_id,
         sum(round(f.idf * (t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.n / c.mean))) * 1000000::DOUBLE)::BIGINT)::BIGINT AS points
  FROM t AS q JOIN t ON q.word = t.word JOIN f ON f.word = t.word JOIN l ON l.doc_id = t.doc_id, c
  WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS rank FROM s WHERE points > 0)
SELECT query_id, rank::INT AS rank, doc_id, points::DOUBLE / 1000000::DOUBLE AS score FROM r WHERE rank <= 10
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN length(coalesce(text, '')) = 0 THEN 1.0::DOUBLE
              ELSE length(translate(text, '#$%&*+<=>@[]^_{|}~', ''))::DOUBLE / length(text)::DOUBLE END AS prose,
         (('0x' || md5('mix-1|' || doc_id::VARCHAR)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE, prose * prose) AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size)::DOUBLE * 2.0::DOUBLE AS cap,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM k GROUP BY source),
w AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
         (sum(weight) OVER ()) - (sum(weight) OVER f) + weight AS rest_weight, (sum(cap) OVER f) - cap AS gone
  FROM s WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, (total - gone) / rest_weight AS level FROM w),
m AS (SELECT *, (SELECT level FROM l WHERE level * weight <= cap ORDER BY cap / weight, level LIMIT 1) AS lv FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(lv * weight, cap)) AS target FROM m),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN target - passes * source_size > 0 AND upto - size / 2.0::DOUBLE <= target - passes * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, parts[pos] AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS r(pos)),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id < c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

ORACLE_SQL = {"op4_topk_search": OP4_SQL, "op6_mixing": OP6_SQL, "op9_line_dedup": OP9_SQL}
