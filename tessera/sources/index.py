"""A table's key as an index: lookups, ranges in order, unique insertion and removal.

There is no tree. Segments are sorted by the key, so a comparison of the key skips files and row groups by their statistics;
that answers what a tree would, for any number of keys at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.errors import EngineError
from tessera.operators.relational import index_scan, order_by

if TYPE_CHECKING:
    from tessera.engine import Engine
    from tessera.transactions import Transaction


class KeyIndex:
    """Over the first column of a table. With a transaction it sees and changes what that does."""

    def __init__(self, engine: Engine, table: str, txn: Transaction | None = None):
        self.engine, self.name, self.txn = engine, table, txn
        self.info = engine.catalog.get_table(table)
        self.key = self.info.columns[0][0]

    @property
    def rows(self) -> DataFrame:
        return self.engine.transactions.table(self.txn, self.name) if self.txn else self.engine.table(self.name)

    def is_empty(self) -> bool:
        return self.rows.isEmpty()

    def get(self, key: object) -> Row | None:
        return index_scan(self.rows, self.key, "=", key).first()

    def _between(self, low: object, high: object) -> DataFrame:
        df = self.rows.where(F.col(f"`{self.key}`").isNotNull())
        df = df if low is None else index_scan(df, self.key, ">=", low)
        return df if high is None else index_scan(df, self.key, "<=", high)

    def scan(self, low: object = None, high: object = None, descending: bool = False) -> DataFrame:
        """Rows in key order, from ``low`` to ``high``, both included and either left open; or from ``high`` down."""
        return order_by(self._between(low, high), [(F.col(f"`{self.key}`"), not descending)])

    def insert(self, row: Sequence[object]) -> None:
        """A key that is there already is refused: at once, or when the commit finds that another writer was first."""

        def absent(rows: DataFrame, key: str) -> None:
            if not index_scan(rows, key, "=", row[0]).isEmpty():
                raise EngineError(f"Duplicate key: {row[0]}")

        def at_commit(manifest: dict) -> None:
            entry = manifest["tables"].get(self.name)
            if entry and entry["id"] == self.info.id:
                rows = self.engine.catalog.read(self.info, entry["segments"])
                absent(self.engine.transactions.without_changed(own, self.info, rows), self.info.key)

        absent(self.rows, self.key)
        own = self.txn or self.engine.begin()
        own.checks.append(at_commit)
        self.engine.insert_from(self.name, self.engine.spark.createDataFrame([tuple(row)], self.info.schema), own)
        if self.txn is None:
            self.engine.commit(own)

    def remove(self, key: object) -> bool:
        """Whether the key was there."""
        return self.remove_between(key, key) > 0

    def remove_between(self, low: object = None, high: object = None) -> int:
        """The number of keys there were from ``low`` to ``high``, both included and either left open."""
        stored = F.col(self.info.key)
        where = stored.isNotNull()
        where = where if low is None else where & (stored >= F.lit(low))
        where = where if high is None else where & (stored <= F.lit(high))
        own = self.txn or self.engine.begin()
        n = self.engine.transactions.delete(own, self.name, where)
        if self.txn is None:
            self.engine.commit(own)
        return n
