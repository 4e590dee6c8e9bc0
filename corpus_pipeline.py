"""A training-data pipeline: each stage applies one corpus operator to all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next one's ``docs``. All but the last return the columns of ``docs``, whatever further
columns there are. Empty tables, null ids, texts, languages and sources, and repeated rows go
through every stage; what becomes of them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import langid
from tessera.llm.common import NULL_ID, discard, documents, fresh, named, spool
from tessera.llm.line_dedup import ADDED, line_dedup
from tessera.llm.mixing import mix, word_count
from tessera.llm.packing import pack
from tessera.llm.simhash import near_duplicates

#: SQL can't express training the language profiles, so the pipeline is tested against brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null text, or no letter) go; a null ``lang`` is filled in with the prediction.

    The profiles are learned from all rows with a ``lang``. If there are none, nothing can be told and all rows stay.
    """
    model = langid.train(docs.where("lang is not null"))
    if not model[0]:
        return docs
    lang, _ = fresh(docs.columns, *langid.ADDED)
    found = langid.identify(docs, model).where(F.col(lang) != "und")
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*map(named, docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by many documents stay in one of them; ``n_chars`` follows. A document that loses all its lines stays, empty."""
    _, dropped = fresh(docs.columns, *ADDED)
    out = line_dedup(docs)
    n = F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*map(named, docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (a null id is smaller than others; of several texts under that id, one).

    Candidates come from the SimHash index and from bands of MinHash lanes; they are
    copies if their sets of five-word shingles are alike by 0.8 or more. Rows are told apart by id and text: rows of one id, or without one, that
    have unlike texts all stay, and of rows equal in both, one.
    """
    k, t = fresh(docs.columns, "__k", "__t")
    stay = near_duplicates(docs, width=3, max_bits=2, alike=0.8, alike_width=5).where("leads")
    stay = stay.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(k), F.col("text_hash").alias(t)).distinct()
    keyed = docs.withColumns({k: F.coalesce("doc_id", F.lit(NULL_ID)), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(stay, [k, t], "left_semi").dropDuplicates([k, t]).drop(k, t)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Texts without a word are not taken."""
    k, s, n, rows_of, times, copy = fresh(docs.columns, "__k", "__s", "__n", "__rows", "__times", "__copy")
    copies = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    takes = mix(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(k), F.col("size").alias(s), copies.alias(n)).groupBy(k, s).agg(F.sum(n).alias(n), F.count("*").alias(rows_of))
    rows = docs.withColumns({k: F.coalesce("doc_id", F.lit(NULL_ID)), s: word_count(F.col("text"))}).join(takes.where(F.col(n) > 0), [k, s])
    nth = F.row_number().over(Window.partitionBy(k, s).orderBy(s))  # rows of one id share its copies
    each = (F.floor(F.col(n) / F.col(rows_of)) + (nth <= F.col(n) % F.col(rows_of)).cast("long")).cast("int")
    return rows.withColumn(times, each).select(*map(named, docs.columns), F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(copy)).drop(copy)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; see ``pack``."""
    return pack(docs, capacity=1024)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written before the next one reads them, and deleted when that one's are written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage_{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
