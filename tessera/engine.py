"""The engine: statements in, results out."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import BindError, CatalogError, EngineError
from tessera.functions import scalar as S
from tessera.plans.explain import explain
from tessera.plans.statistics import TableStatistics, table_statistics
from tessera.sources.catalog import Catalog, type_name
from tessera.sql import nodes as N
from tessera.sql.binder import Binder, Bound, Field, Scope
from tessera.sql.parser import parse
from tessera.transactions import Transaction, TransactionManager


@dataclass
class Result:
    """``kind``: rows, message or explain. Columns are (name, type) with the dialect's type names."""

    success: bool = True
    error: str = ""
    kind: str = "rows"
    columns: list[tuple[str, str]] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    message: str = ""


@dataclass
class Prepared:
    statement: N.Statement
    kinds: list[str]


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.transactions = TransactionManager(self.catalog)
        self.prepared: dict[str, Prepared] = {}

    # API

    def begin(self) -> Transaction:
        return self.transactions.begin()

    def commit(self, t: Transaction) -> None:
        self.transactions.commit(t)

    def abort(self, t: Transaction) -> None:
        self.transactions.abort(t)

    def table(self, name: str) -> DataFrame:
        return self.catalog.table(name)

    def register_parquet(self, name: str, path: str) -> None:
        """A read-only table of Parquet files, opened when a statement first names it."""
        self.catalog.register(name, lambda: self.spark.read.parquet(path))

    def statistics(self, name: str) -> TableStatistics:
        return table_statistics(self.table(name))

    def query(self, text: str, arguments: list | None = None, txn: Transaction | None = None) -> DataFrame:
        """The DataFrame of a SELECT or VALUES statement; nothing runs before it is asked for."""
        s = parse(text)
        if not isinstance(s, (N.Select, N.Values)):
            raise BindError("Only SELECT and VALUES are queries")
        return self._query(s, self._binder(txn, arguments if arguments is not None else []))

    def pages(self, text: str, size: int = 10_000, txn: Transaction | None = None) -> Iterator[list[tuple]]:
        """The rows of a query in lists of ``size``, fetched as they are asked for; the driver holds no more than a partition's."""
        rows = self.query(text, txn=txn).toLocalIterator(prefetchPartitions=True)
        while page := [tuple(r) for r in itertools.islice(rows, size)]:
            yield page

    def execute(self, text: str, txn: Transaction | None = None) -> Result:
        """Run one statement. Without a transaction it is one of its own. A query's rows come as a whole, as far as Spark's
        ``spark.driver.maxResultSize`` goes; ``query`` and ``pages`` are for larger ones."""
        return self._run(parse(text), txn)

    def try_execute(self, text: str) -> Result:
        """As ``execute``, with any failure as a result."""
        try:
            return self.execute(text)
        except Exception as e:
            return Result(False, _short(e))

    # statements

    def _binder(self, txn: Transaction | None, arguments: list | None) -> Binder:
        def table(name: str) -> DataFrame:
            try:
                return self.transactions.table(txn, name) if txn else self.catalog.table(name)
            except CatalogError as e:
                raise BindError(str(e)) from None

        return Binder(self.spark, table, arguments)

    def _run(self, s: N.Statement, txn: Transaction | None, arguments: list | None = None) -> Result:
        arguments = arguments if arguments is not None else []
        if isinstance(s, N.Explain):
            return self._explain(s, txn, arguments)
        if isinstance(s, N.Prepare):
            self.prepared[s.name] = Prepared(s.statement, self._parameter_kinds(s.statement, txn))
            return Result(kind="message", message="Statement prepared.")
        if isinstance(s, N.Deallocate):
            self.prepared.pop(s.name, None)
            return Result(kind="message", message="Statement deallocated.")
        if isinstance(s, N.Execute):
            return self._run(*self._prepared(s, txn))
        if isinstance(s, N.CreateTable):
            self.catalog.create_table(s.table, list(s.columns))
            return Result(kind="message", message="Table created.")
        if isinstance(s, N.DropTable):
            self.catalog.drop_table(s.table)
            return Result(kind="message", message="Table dropped.")
        if isinstance(s, (N.Select, N.Values)):
            df = self._query(s, self._binder(txn, arguments))
            return Result(columns=[(f.name, type_name(f.dataType.simpleString())) for f in df.schema.fields], rows=[tuple(r) for r in df.collect()])
        return Result(columns=[("count", "INTEGER")], rows=[(self._change(s, txn, arguments),)])

    def _prepared(self, s: N.Execute, txn: Transaction | None) -> tuple[N.Statement, Transaction | None, list]:
        p = self.prepared.get(s.name)
        if p is None:
            raise BindError(f"Prepared statement not found: {s.name}")
        if len(p.kinds) != len(s.arguments):
            raise BindError(f"Parameter count mismatch for {s.name}")
        binder, found = self._binder(txn, []), []
        for e, kind in zip(s.arguments, p.kinds, strict=True):
            given = binder.bind(e, Scope([])).kind
            if S.NULL not in (given, kind) and S.family(given) != S.family(kind):
                raise BindError("Type mismatch for parameter")
            found.append(binder.evaluate(e))
        return p.statement, txn, found

    def _query(self, s: N.Select | N.Values, b: Binder) -> DataFrame:
        return b.select(s) if isinstance(s, N.Select) else b.values(s)

    def _parameter_kinds(self, s: N.Statement, txn: Transaction | None) -> list[str]:
        """Bind without values: that checks the statement and infers its parameters' types."""
        b = self._binder(txn, None)
        if isinstance(s, (N.Select, N.Values)):
            self._query(s, b)
        elif isinstance(s, (N.Insert, N.Update, N.Delete)):
            self._bind_change(s, b, txn)
        else:
            raise BindError("Only queries and changes can be prepared")
        return [b.parameter_kinds[i] for i in sorted(b.parameter_kinds)]

    # changes

    def _change(self, s: N.Statement, txn: Transaction | None, arguments: list) -> int:
        own = txn or self.begin()
        try:
            n = self._bind_change(s, self._binder(own, arguments), own)[0](own)
            if txn is None:
                self.commit(own)
            return n
        finally:
            if txn is None and own.state == "active":
                self.abort(own)

    def _bind_change(self, s: N.Statement, b: Binder, txn: Transaction | None) -> tuple[Callable[[Transaction], int], Callable[[Transaction], DataFrame]]:
        """What makes the change and counts its rows, and what gives the rows it would hit."""
        if s.table in self.catalog.external:
            raise BindError(f"Table is read-only: {s.table}")
        try:
            info = self.catalog.get_table(s.table, txn.manifest if txn else None)
        except CatalogError as e:
            raise BindError(str(e)) from None
        columns = list(info.columns)
        if isinstance(s, N.Insert):
            b.step("VALUES", f"rows: {len(s.source.rows)}")
            b.step("INSERT", f"table: {s.table}")
            rows = []
            for row in s.source.rows:
                if len(row) != len(columns):
                    raise BindError(f"INSERT into {s.table} needs {len(columns)} values, got {len(row)}")
                values = b.checked_row(row, columns, Scope([]), "INSERT")
                rows.append(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]))
            df = self.spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))
            return lambda t: self.transactions.insert(t, s.table, df), lambda t: df
        scope = Scope([Field((s.table,), n, Bound(F.col(info.stored(i)), S.kind_of(f.dataType), type=t if t == "int" else None)) for i, ((n, t), f) in enumerate(zip(columns, info.schema.fields, strict=True))])
        where = None if s.where is None else b.predicate(s.where, scope, "WHERE")
        hit = lambda t: self.transactions.hit(t, info, where)
        b.step("SEQ_SCAN", f"table: {s.table}")
        if s.where is not None:
            b.step("FILTER", str(s.where))
        if isinstance(s, N.Delete):
            b.step("DELETE", f"table: {s.table}")
            return lambda t: self.transactions.delete(t, s.table, where), hit
        places, sets = {n: i for i, (n, _) in enumerate(columns)}, []
        for name, e in s.sets:
            if name not in places:
                raise BindError(f"Unknown column in SET clause: {name}")
            sets.append((info.stored(places[name]), b.checked_row([e], [columns[places[name]]], scope, "SET")[0]))
        b.step("UPDATE", f"table: {s.table}")
        return lambda t: self.transactions.update(t, s.table, sets, where), hit

    def insert_from(self, name: str, df: DataFrame, txn: Transaction | None = None) -> int:
        """Load a DataFrame, column by position."""
        own = txn or self.begin()
        try:
            n = self.transactions.insert(own, name, df)
            if txn is None:
                self.commit(own)
            return n
        finally:
            if txn is None and own.state == "active":
                self.abort(own)

    # explain

    def _explain(self, e: N.Explain, txn: Transaction | None, arguments: list) -> Result:
        """ANALYZE runs a query for its figures; a change's rows are looked up for them, and then it is made."""
        s = e.statement
        if isinstance(s, N.Execute):
            s, txn, arguments = self._prepared(s, txn)
        if isinstance(s, (N.Select, N.Values)):
            b = self._binder(txn, arguments)
            found = explain(self._query(s, b), b.steps, analyze=e.analyze)
        elif isinstance(s, (N.Insert, N.Update, N.Delete)):
            own = txn or self.begin()
            try:
                b = self._binder(own, arguments)
                change, hit = self._bind_change(s, b, own)
                found = explain(hit(own), b.steps, analyze=e.analyze, change=b.steps[-1])
                if e.analyze:
                    found.changed(change(own))
                    if txn is None:
                        self.commit(own)
            finally:
                if txn is None and own.state == "active":
                    self.abort(own)
        else:
            raise BindError("Only queries and changes can be explained")
        return Result(kind="explain", message=found.text(), columns=[("plan", "VARCHAR")], rows=[(found.text(),)])


def _short(e: Exception) -> str:
    """The first line of what happened, without the JVM's stack."""
    return str(e).split("\n\nJVM stacktrace")[0].strip().split("\n")[0] if not isinstance(e, EngineError) else str(e)
