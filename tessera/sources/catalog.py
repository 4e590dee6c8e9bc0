"""Tables as versioned sets of Parquet segments under numbered manifests.

A table's state is a list of segments (folders of Parquet files, all of them or some), named in a manifest. A commit makes the manifest of
the next number, which only one writer can; another one, in this process or elsewhere, starts anew from what that one left. Nothing is
ever overwritten, so a reader of an old manifest keeps its snapshot, and
a crash leaves either the old state or the new one. Every row carries its identity in two
hidden columns: the batch it came in and its number there.
"""

from __future__ import annotations

import copy
import json
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CatalogError
from tessera.sources.files import Store

Made = TypeVar("Made")
ROW = ("__batch", "__row")
#: The dialect's type names and Spark's.
TYPES = {"INTEGER": "int", "INT": "int", "BIGINT": "bigint", "FLOAT": "double", "DOUBLE": "double", "BOOLEAN": "boolean", "VARCHAR": "string", "TEXT": "string", "DATE": "date", "TIMESTAMP": "timestamp"}
SHOWN = {"int": "INTEGER", "bigint": "BIGINT", "double": "FLOAT", "float": "FLOAT", "boolean": "BOOLEAN", "string": "VARCHAR"}


def type_name(spark_type: str) -> str:
    return SHOWN.get(spark_type, spark_type.upper())


@dataclass(frozen=True)
class TableInfo:
    id: int
    name: str
    columns: tuple[tuple[str, str], ...]  # name, Spark type

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T.StructType.fromDDL(f"x {t}").fields[0].dataType) for n, t in self.columns])

    def stored(self, i: int) -> str:
        """A column's name in files, where names that differ in case only would clash."""
        return f"c{i}"

    @property
    def key(self) -> str:
        """The stored column that files are sorted by."""
        return self.stored(0)


class External(dict):
    """Read-only tables by name: DataFrames, or functions that make them when first asked for."""

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if not isinstance(found, DataFrame):
            found = self[name] = found()
        return found


class Catalog:
    """``root`` is a folder, by any path or address that Spark takes, that the driver and all executors share."""

    #: So many manifests are kept before the latest.
    HISTORY = 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.lock = threading.RLock()
        self.external = External()
        self.store = Store(spark, f"{self.root}/manifests")
        if not self._versions():
            self._publish({"next_id": 1, "version": 0, "tables": {}})

    # the manifest

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.store.names() if n.endswith(".json") and not n.startswith("."))

    @staticmethod
    def _name(version: int) -> str:
        return f"{version:012d}.json"

    def _publish(self, manifest: dict) -> bool:
        return self.store.create(self._name(manifest["version"]), json.dumps(manifest))

    def manifest(self) -> dict:
        return json.loads(self.store.read(self._name(self._versions()[-1])))

    def change(self, apply: Callable[[dict], Made]) -> Made:
        """Commit what ``apply`` makes of the latest manifest. It is applied anew if another writer was first."""
        with self.lock:
            while True:
                m = self.manifest()
                made = apply(m)
                m["version"] += 1
                if self._publish(m):
                    for v in self._versions():
                        if v < m["version"] - self.HISTORY:
                            self.store.delete(self._name(v))
                    return made

    # tables

    def create_table(self, name: str, columns: list[tuple[str, str]]) -> TableInfo:
        """Columns as (name, type), with the dialect's or Spark's type names."""
        if not columns:
            raise CatalogError("A table needs a column")
        known = [[n, TYPES.get(t.upper(), t)] for n, t in columns]
        TableInfo(0, name, tuple(map(tuple, known))).schema  # fails on an unknown type

        def apply(m: dict) -> None:
            if name in m["tables"] or name in self.external:
                raise CatalogError(f"Table already exists: {name}")
            m["tables"][name] = {"id": m["next_id"], "columns": known, "segments": []}
            m["next_id"] += 1

        self.change(apply)
        return self.get_table(name)

    def drop_table(self, name: str) -> None:
        """The files stay for readers of older snapshots, until ``vacuum``."""

        def apply(m: dict) -> None:
            if m["tables"].pop(name, None) is None:
                raise CatalogError(f"Unknown table: {name}")

        self.change(apply)

    def vacuum(self) -> int:
        """Delete segments and change sets that the latest manifest doesn't name: of dropped tables, aborted transactions and older snapshots.

        Nothing may be reading or changing the tables meanwhile. Gives the number of folders deleted.
        """
        with self.lock:
            used = {s["path"].rpartition("/")[2] for t in self.manifest()["tables"].values() for s in t["segments"]}
            gone = 0
            for table in Store(self.spark, self.root).names():
                if table.isdigit():
                    folder = Store(self.spark, f"{self.root}/{table}")
                    for name in folder.names():
                        if name not in used:
                            folder.delete(name)
                            gone += 1
            return gone

    def get_table(self, name: str, manifest: dict | None = None) -> TableInfo:
        t = (manifest or self.manifest())["tables"].get(name)
        if t is None:
            raise CatalogError(f"Unknown table: {name}")
        return TableInfo(t["id"], name, tuple(map(tuple, t["columns"])))

    def list_tables(self) -> list[str]:
        return sorted([*self.manifest()["tables"], *self.external])

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame]) -> None:
        """A read-only table that lives elsewhere, or what opens it when first asked for."""
        self.external[name] = df

    # segments

    def write(self, info: TableInfo, df: DataFrame) -> str:
        """A new segment; its rows are sorted by the key in each file, so scans skip by statistics."""
        path = f"{self.root}/{info.id}/{uuid.uuid4().hex}"
        df.sortWithinPartitions(F.asc_nulls_first(info.key)).write.parquet(path)
        return path

    def with_rows(self, info: TableInfo, df: DataFrame) -> DataFrame:
        """Typed columns and a new identity for each row."""
        batch = uuid.uuid4().int >> 65
        named = df.toDF(*[info.stored(i) for i in range(len(info.columns))])
        typed = [F.col(info.stored(i)).cast(t).alias(info.stored(i)) for i, (_, t) in enumerate(info.columns)]
        return named.select(F.lit(batch).cast("long").alias(ROW[0]), F.monotonically_increasing_id().alias(ROW[1]), *typed)

    def row_schema(self, info: TableInfo) -> T.StructType:
        """Identities and stored columns."""
        return T.StructType([*(T.StructField(c, T.LongType()) for c in ROW), *(T.StructField(info.stored(i), f.dataType) for i, f in enumerate(info.schema.fields))])

    def read(self, info: TableInfo, segments: list[dict]) -> DataFrame:
        """Rows as stored, with their identity."""
        paths = [p for s in segments for p in ([s["path"]] if s["files"] is None else [f"{s['path']}/{f}" for f in s["files"]])]
        schema = self.row_schema(info)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """The committed rows, as of a manifest."""
        if name in self.external:
            return self.external[name]
        m = manifest or self.manifest()
        info = self.get_table(name, m)
        return self.shown(info, self.read(info, m["tables"][name]["segments"]))

    def shown(self, info: TableInfo, rows: DataFrame) -> DataFrame:
        return rows.drop(*ROW).toDF(*[n for n, _ in info.columns])

    def rebase(self, info: TableInfo, segments: list[dict], change: DataFrame) -> list[dict]:
        """Segments after a change set (identity, stored columns, ``__gone``): only files that hold one of its rows are written anew."""
        segments = copy.deepcopy(segments)
        ids = change.select(*ROW)
        file = F.col("_metadata.file_path")
        hit = self.read(info, segments).select(*ROW, file.alias("file")).join(ids, list(ROW), "left_semi").select("file").distinct()
        files = [r.file for r in hit.collect()]  # at most the table's files
        fresh = change.where(~F.col("__gone")).drop("__gone")
        if files:
            fresh = self.spark.read.schema(self.row_schema(info)).parquet(*files).join(ids, list(ROW), "left_anti").unionByName(fresh)
        names = {os.path.basename(f) for f in files}
        for s in segments:
            listed = s["files"] if s["files"] is not None else [os.path.basename(f) for f in self.spark.read.parquet(s["path"]).inputFiles()]
            if names & set(listed):
                s["files"] = [f for f in listed if f not in names]
        kept = [s for s in segments if s["files"] != []]
        return [*kept, {"path": self.write(info, fresh), "files": None}]
