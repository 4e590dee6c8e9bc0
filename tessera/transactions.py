"""Snapshot-isolated transactions over the catalog.

A transaction reads the tables as they were when it began, with its own writes on top. Its writes are
change sets, written beside the tables and unseen by others. Commit puts them on the latest committed state (the last
writer of a row wins) as a new manifest, anew if another driver was first; abort forgets them. A row that another open
transaction has changed can't be changed: updates and deletes skip it and don't count it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import EngineError, TransactionError
from tessera.functions.scalar import null_safe_predicate
from tessera.sources.catalog import ROW, Catalog, TableInfo


@dataclass
class Delta:
    table: TableInfo
    path: str
    insert: bool


@dataclass
class Transaction:
    id: int
    manifest: dict
    deltas: list[Delta] = field(default_factory=list)
    #: Called with the manifest that the commit builds on; what one raises ends the transaction.
    checks: list[Callable[[dict], None]] = field(default_factory=list)
    state: str = "active"


class TransactionManager:
    def __init__(self, catalog: Catalog):
        self.catalog, self.numbers = catalog, itertools.count(1)
        self.active: dict[int, Transaction] = {}

    def begin(self) -> Transaction:
        with self.catalog.lock:
            t = Transaction(next(self.numbers), self.catalog.manifest())
            self.active[t.id] = t
        return t

    def _end(self, t: Transaction, state: str) -> None:
        if t.state != "active":
            raise TransactionError(f"Transaction {t.id} is {t.state}")
        t.state = state
        self.active.pop(t.id, None)

    def abort(self, t: Transaction) -> None:
        self._end(t, "aborted")

    def commit(self, t: Transaction) -> None:
        def apply(m: dict) -> None:
            for check in t.checks:
                check(m)
            for d in t.deltas:
                entry = m["tables"].get(d.table.name)
                if entry is None or entry["id"] != d.table.id:
                    continue  # dropped meanwhile
                if d.insert:
                    entry["segments"].append({"path": d.path, "files": None})
                else:
                    entry["segments"] = self.catalog.rebase(d.table, entry["segments"], self._read(d))

        with self.catalog.lock:
            if t.deltas and t.state == "active":
                try:
                    self.catalog.change(apply)
                except EngineError:
                    self._end(t, "aborted")
                    raise
            self._end(t, "committed")

    # reads

    def _read(self, d: Delta) -> DataFrame:
        schema = self.catalog.row_schema(d.table)
        return self.catalog.spark.read.schema(schema if d.insert else schema.add("__gone", "boolean")).parquet(d.path)

    def rows(self, t: Transaction, name: str) -> DataFrame:
        """What the transaction sees, as stored, with identities."""
        self._check(t)
        info = self.catalog.get_table(name, t.manifest)
        df = self.catalog.read(info, t.manifest["tables"][name]["segments"])
        for d in t.deltas:
            if d.table.id == info.id:
                own = self._read(d)
                df = df.unionByName(own) if d.insert else df.join(own.select(*ROW), list(ROW), "left_anti").unionByName(own.where(~F.col("__gone")).drop("__gone"))
        return df

    def without_changed(self, t: Transaction, info: TableInfo, rows: DataFrame) -> DataFrame:
        """Rows of a table, as stored, that the transaction has neither changed nor deleted."""
        for d in t.deltas:
            if d.table.id == info.id and not d.insert:
                rows = rows.join(self._read(d).select(*ROW), list(ROW), "left_anti")
        return rows

    def table(self, t: Transaction, name: str) -> DataFrame:
        self._check(t)
        if name in self.catalog.external:
            return self.catalog.external[name]
        return self.catalog.shown(self.catalog.get_table(name, t.manifest), self.rows(t, name))

    def _check(self, t: Transaction) -> None:
        if t.state != "active":
            raise TransactionError(f"Transaction {t.id} is {t.state}")

    # writes; each gives the number of rows

    def insert(self, t: Transaction, name: str, df: DataFrame) -> int:
        self._check(t)
        info = self.catalog.get_table(name, t.manifest)
        d = Delta(info, self.catalog.write(info, self.catalog.with_rows(info, df)), True)
        t.deltas.append(d)
        return self._read(d).count()

    def update(self, t: Transaction, name: str, sets: Sequence[tuple[str, Column]], where: Column | None = None) -> int:
        """Settings and predicate are on stored columns. All values come from the old row; the first setting of a column holds."""
        info = self.catalog.get_table(name, t.manifest)
        new = dict(reversed(list(sets)))
        stored = [info.stored(i) for i in range(len(info.columns))]
        return self._change(t, info, where, [new.get(c, F.col(c)).cast(k).alias(c) for c, (_, k) in zip(stored, info.columns, strict=True)], False)

    def delete(self, t: Transaction, name: str, where: Column | None = None) -> int:
        info = self.catalog.get_table(name, t.manifest)
        return self._change(t, info, where, [F.col(info.stored(i)) for i in range(len(info.columns))], True)

    def hit(self, t: Transaction, info: TableInfo, where: Column | None) -> DataFrame:
        """The rows a change would hit, as stored: those the predicate holds for, without those that another open transaction has changed."""
        found = self.rows(t, info.name)
        found = found if where is None else found.filter(null_safe_predicate(where))
        others = [self._read(d).select(*ROW) for o in self.active.values() if o is not t for d in o.deltas if d.table.id == info.id and not d.insert]
        return found.join(reduce(DataFrame.unionByName, others), list(ROW), "left_anti") if others else found

    def _change(self, t: Transaction, info: TableInfo, where: Column | None, columns: list[Column], gone: bool) -> int:
        with self.catalog.lock:
            hit = self.hit(t, info, where)
            d = Delta(info, self.catalog.write(info, hit.select(*ROW, *columns, F.lit(gone).alias("__gone"))), False)
            n = self._read(d).count()
            if n:
                t.deltas.append(d)
            return n
