"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a budget of tokens. Whole passes over a source (complete epochs) come
first; what is left of the budget is drawn without replacement: every document gets the
exponential key ``-ln(u) / quality``, documents are sorted by key within their source,
and the prefix sum of their sizes is cut at the budget. Keys come from a hash of the id,
so reruns agree. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import offsets, range_spool, spool

WORD = r"[^\x20\x09-\x0D]+"
#: Signs that prose has few of.
SIGNS = "#$%&*+<=>@[]^_{|}~"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prose_share(text: Column) -> Column:
    """1 for text without ``SIGNS``, falling to 0.05 with the square of their share."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    kept = F.char_length(F.translate(t, SIGNS, ""))
    share = F.when(n > 0, kept / n).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.05), share * share)


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` of all
    sizes; none gets more than ``epochs`` times its size, and what it can't take goes to the
    others by weight. The end of that sharing is target = min(cap, level * weight) with one
    level for all, found by sorting the sources by cap / weight. ``sizes`` has a row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.get(turn, (rank % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * float(epochs))
    everything = Window.partitionBy(F.lit(0))
    full = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    upto = full.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("total", F.sum("source_size").over(everything) * float(share))
    # the level if this source and all later ones are not at their caps
    rest_weight = F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")
    rest_total = F.col("total") - (F.sum("cap").over(upto) - F.col("cap"))
    t = t.withColumn("level", rest_total / rest_weight)
    t = t.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    epochs: float = 2.0,
    quality: Column | None = None,
    seed: str = "mix-1|",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` is a whole number of copies: the source's complete epochs, plus one more for the
    documents drawn. The document at the cut is drawn if at least half of it fits, so a source's
    sum is off its target by half a document at most. Null text has size 0 and takes nothing;
    a null source is a source; documents with a null or repeated id are each drawn by
    themselves (ties in the key go by id and size; equal rows are interchangeable).
    An empty table gives an empty result. Other columns don't matter.

    ``quality``: a positive weight made from ``docs``' columns, by default ``prose_share``.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text).alias("size"),
        (-F.ln(uniform(seed, F.col(id_col))) / (prose_share(text) if quality is None else quality)).alias("key"),
    )
    order = [F.asc_nulls_last("source"), F.asc("key"), F.asc_nulls_first("doc_id"), F.asc("size")]
    rows = range_spool(spool(base, "mix_base"), order, "mix")  # texts are read once, not again to find the ranges
    parts = rows.groupBy("source", "__pid").agg(F.sum("size").alias("size"))
    before = offsets(parts, ["size"], ["source"])
    plan = targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, epochs=epochs)
    plan = (
        plan.join(before.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
        .select(F.col("s"), F.col("__pid").alias("p"), "source_size", "target", "passes", "left", "before_size")
    )
    run = Window.partitionBy("__pid", "source").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("before_size") + F.col("run")
    drawn = (end - F.col("size") / 2 <= F.col("left")) & (F.col("left") > 0)
    return (
        rows.withColumn("run", F.sum("size").over(run))
        .join(plan, (F.col("__pid") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + drawn.cast("long"))).cast("long").alias("taken"))
    )
