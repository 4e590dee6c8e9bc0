"""Relational operators from DataFrame to DataFrame.

They declare what is asked for and leave order, pushdown, join choice and sharing to Catalyst and adaptive
execution; no operator repartitions or broadcasts on its own account, and none but ``skip`` runs before it is asked for.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import avg_truncated, compare

#: Aggregate functions by name. ``avg`` truncates, ``mean`` doesn't.
AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": avg_truncated, "mean": F.avg}


def seq_scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, predicate: Column | None = None, n: int | None = None, offset: int = 0) -> DataFrame:
    """A Parquet table; predicate and columns reach the scan."""
    df = spark.read.parquet(path)
    df = df if predicate is None else df.filter(predicate)
    return limit(df if columns is None else df.select(*columns), n, offset)


def index_scan(df: DataFrame, key: str, op: str, value: object, ordered: bool = False) -> DataFrame:
    """Rows by a comparison of the key. Files sorted by it are skipped by their statistics; the order is given if asked for.

    Unlike a tree probe, ``!=`` is answered as well.
    """
    found = df.filter(compare(op, F.col(key), F.lit(value)))
    return found.orderBy(F.asc_nulls_first(key)) if ordered else found


def values(spark: SparkSession, rows: Sequence[Sequence[object]], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def project(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true; null drops them."""
    return df.filter(predicate)


def hash_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, residual: Column | None = None, hint: str | None = None) -> DataFrame:
    """Inner equi-join, null keys match nothing. ``hint`` may ask for a shape (``shuffle_hash``, ``merge``); by default
    sizes decide, and adaptive execution splits skewed keys."""
    on = left_key == right_key
    return left.join(right.hint(hint) if hint else right, on if residual is None else on & residual, "inner")


def theta_join(left: DataFrame, right: DataFrame, predicate: Column) -> DataFrame:
    """Inner join on any predicate. Equalities in it are used as keys; one without any compares all pairs."""
    return left.join(right, predicate, "inner")


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def aggregate(df: DataFrame, keys: Mapping[str, Column], aggs: Mapping[str, tuple[str, Column | None]]) -> DataFrame:
    """Group by expressions (null keys form a group) with named aggregates: name -> (function, argument); ``count`` of None counts rows.

    Without keys there is one row, with counts of 0 and nulls if there is no input. Partial sums are made before the shuffle.
    """
    made = [AGGREGATES[f](F.lit(1) if arg is None else arg).alias(n) for n, (f, arg) in aggs.items()]
    grouped = df.groupBy(*[k.alias(n) for n, k in keys.items()])
    return grouped.agg(*made) if made else distinct_keys(df, keys)


def distinct_keys(df: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    return project(df, keys).distinct()


def having(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.filter(predicate)


def sort_keys(keys: Sequence[tuple[Column, bool]]) -> list[Column]:
    """(expression, ascending) -> sort orders with the place of nulls spelled out: first ascending, last descending."""
    return [k.asc_nulls_first() if up else k.desc_nulls_last() for k, up in keys]


def order_by(df: DataFrame, keys: Sequence[tuple[Column, bool]], tie: Sequence[str] = ()) -> DataFrame:
    """A total order: ranges are dealt out and sorted in place. ``tie``: columns that settle ties, where stability matters."""
    return df.orderBy(*sort_keys(keys), *[F.asc_nulls_first(c) for c in tie])


def sort_partitions(df: DataFrame, keys: Sequence[tuple[Column, bool]]) -> DataFrame:
    """Order within partitions only, without a shuffle, as files to be skipped by statistics want it."""
    return df.sortWithinPartitions(*sort_keys(keys))


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """The first ``n`` rows after ``offset``. An offset without a limit moves no row to another task: see ``skip``."""
    if offset < 0 or n is not None and n < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
    if n is None:
        return skip(df, offset) if offset else df
    return (df.offset(offset) if offset else df).limit(n)


def skip(df: DataFrame, offset: int) -> DataFrame:
    """All rows but the first ``offset``, left in their partitions and in order.

    The rows are written once, as a checkpoint, so that each has a place that stays; with the partitions' counts (two numbers each) it is
    known which of them lose rows. This runs ``df`` when it is called.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():  # no spark.checkpoint.dir: one machine
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    part, place = (name + "_" * max(map(len, df.columns), default=0) for name in ("__part", "__place"))
    numbered = df.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).checkpoint()
    rest = offset
    for p, n in sorted(tuple(r) for r in numbered.groupBy(part).count().collect()):
        if rest < n:
            return numbered.where((F.col(part) > p) | ((F.col(part) == p) & (F.col(place) >= rest))).drop(part, place)
        rest -= n
    return numbered.limit(0).drop(part, place)


def top_k(df: DataFrame, keys: Sequence[tuple[Column, bool]], k: int, offset: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """The first k rows of an order after an offset: each task keeps k + offset rows, no full sort."""
    return limit(order_by(df, keys, tie), k, offset)
