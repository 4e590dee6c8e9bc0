"""Contiguous shards of near-equal bytes, by global prefix sums.

Documents are put in one global order dealt out by range. Every range sums its sizes;
the running sums of those totals say where each range begins, and a running sum inside
the range says where each document begins. Shards are cuts at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import offsets, range_spool, spool


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The order is that of ids, except that documents with equal texts follow the first of them.
    A document goes to the shard that holds its middle byte. A group of equal texts that is no
    larger than the largest single document goes as a whole to the shard of its middle byte, which
    bounds the imbalance as a single document would; larger groups are cut like any documents.
    ``slot`` counts from 0 in each shard, in the global order.

    A null text has size 1 and CRC 0 and is a text of its own kind; null ids come first; repeated
    ids are separate documents (equal rows are interchangeable). An empty table gives an empty
    result. Other columns don't matter.
    """
    text = F.col(text_col)
    whole = F.coalesce(text, F.lit(""))
    base = spool(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(F.when(text.isNotNull(), F.concat(F.lit("t"), text)).otherwise(F.lit("n")), 256)).alias("same"),
        ),
        "shard_base",
    )
    # a table of its own, so that the join can split the rows of a hot text
    groups = spool(base.groupBy("same").agg(F.min("doc_id").alias("lead"), F.sum("size").alias("group_size")), "shard_groups")
    placed = base.join(groups, "same")
    order = [F.asc_nulls_first(c) for c in ("lead", "same", "doc_id", "size")]
    rows = range_spool(placed, order, "shard_ranges")

    totals = rows.groupBy("__pid").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = offsets(totals, ["bytes", "rows"])
    whole_corpus = rows.agg(F.sum("size").alias("all_bytes"), F.max("size").alias("largest"))
    run = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        rows.withColumns({"run_bytes": F.sum("size").over(run), "run_rows": F.row_number().over(run)})
        .join(F.broadcast(before), "__pid")  # a row per partition
        .crossJoin(F.broadcast(whole_corpus))  # one row
        .withColumn("start", F.col("before_bytes") + F.col("run_bytes") - F.col("size"))
        .withColumn("index", F.col("before_rows") + F.col("run_rows") - 1)
        .withColumn("whole", F.col("group_size") <= F.col("largest"))
    )
    # small groups only share a key here; members of large ones stand alone
    kin = Window.partitionBy("same", F.when(~F.col("whole"), F.col("index")))
    middle = F.when(F.col("whole"), F.min("start").over(kin) + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.col("all_bytes"))).cast("int")
    rows = spool(rows.select("doc_id", "size", "text_crc32", "index", shard.alias("shard")), "shard_rows")
    first = rows.groupBy("shard").agg(F.min("index").alias("first"))  # a row per shard
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
