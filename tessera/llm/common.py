"""Helpers shared by the corpus operators: shared storage, global ordering, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands for a null id inside an operator. A null id and the least of all longs are one id to those that use it.
NULL_ID = -(2**63)

#: So much Spark hands to Python at a time while it writes a step.
BATCH_BYTES = "16m"
_own_dir: str | None = None
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (``spark.checkpoint.dir``).

    Only where the session names none (tests on one machine) a temporary folder
    of this process is used and removed at exit.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if path not in _kept:
        fs, at = _file_system(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _kept.add(path)
    return path


@contextmanager
def setting(spark: SparkSession, key: str, value: Callable[[str], str]) -> Iterator[str]:
    """A setting of the session made from what it is now, for the time being."""
    before = spark.conf.get(key)
    spark.conf.set(key, value(before))
    try:
        yield spark.conf.get(key)
    finally:
        spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[str]:
    """Executions that end within this leave no shuffle files behind: what they have written takes their place."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", lambda _: "true")


def spool(df: DataFrame, tag: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs no more than a reread. The files stay until ``discard``, or the end of the application.
    With ``files``, partitions beyond that number are written one after another by the tasks of so many.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{tag}"
    df = df.coalesce(files) if files else df
    with shuffles_dropped(spark), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", lambda _: BATCH_BYTES):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.spooled = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def discard(*spools: DataFrame) -> None:
    """Delete what ``spool`` wrote, once all that is made from it has been written itself."""
    for df in spools:
        delete(df.sparkSession, df.spooled.rpartition("/")[0])


def fresh(columns: Sequence[str], *names: str) -> list[str]:
    """``names`` with as many underscores behind them as it takes until none of them is among ``columns``, in any case."""
    taken, more = {c.lower() for c in columns}, ""
    while any((n + more).lower() in taken for n in names):
        more += "_"
    return [n + more for n in names]


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def range_spool(df: DataFrame, keys: Sequence[Column], tag: str, part: str = "__pid") -> DataFrame:
    """Global sort order as a table: ranges of ``keys`` in partitions numbered by ``part``.

    The order within a partition is that of ``keys``; ``part`` follows the order of
    the ranges. No single task holds more than one range.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return spool(dealt.withColumn(part, F.spark_partition_id()), tag)


def offsets(totals: DataFrame, columns: Sequence[str], group: Sequence[str] = (), part: str = "__pid") -> DataFrame:
    """Per-partition totals -> what lies before each partition: ``before_<column>``.

    ``totals`` has one row per partition (and group), so its size is bound by the
    number of partitions, not by the rows.
    """
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *group, part, *[F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(f"before_{c}") for c in columns]
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, to bound what is made of whole texts at a time. Spark bounds the batches' bytes."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``u``, ``v`` -> ``node``, ``component`` by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    for k in range(0, len(nodes), 1 << 16):
        some = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], ["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc", one_task: int = 500_000) -> DataFrame:
    """Connected components of an edge list: ``node``, ``component`` (its smallest node).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is
    two aggregations on node ids, edges never grow, and the number of rounds is
    logarithmic in the longest path. What a round joins is a table, so that joins can split the edges of a hot
    node; every round is spooled, so the lineage stays short. No more than ``one_task`` edges are joined by one task
    instead (some 100 MB at most), which spares the rounds. Nodes without an edge are not returned.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = spool(e, f"{tag}_0")
    if e.count() <= one_task:
        out = spool(e.coalesce(1).mapInArrow(_united, "node long, component long"), tag)
        discard(e)
        return out
    for k in range(1, 1000):
        # done when each node points to one other that points to none
        ends = e.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out + in > 1").isEmpty():
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = spool(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}_low{k}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = spool(large, f"{tag}_large{k}")
        # small star: each node points to smaller ones; they and the node meet at the smallest
        lows = spool(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}_lows{k}")
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, e = e, spool(small, f"{tag}_{k}")
        discard(before, low, large, lows)
    else:
        raise RuntimeError("The components' edges still change")
    leads = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(leads.select("node", F.col("node").alias("component")))
