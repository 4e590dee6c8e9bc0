"""Syntax trees. ``str`` gives the statement's text back, with every operation in parentheses."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    def children(self) -> tuple[Expr, ...]:
        return ()


@dataclass(frozen=True)
class Literal(Expr):
    value: object

    def __str__(self) -> str:
        if isinstance(self.value, str):
            return "'" + self.value.replace("'", "''") + "'"
        return {None: "NULL", True: "TRUE", False: "FALSE"}.get(self.value, str(self.value)) if self.value is None or isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Name(Expr):
    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Star(Expr):
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Parameter(Expr):
    index: int

    def __str__(self) -> str:
        return "?"


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr

    def children(self) -> tuple[Expr, ...]:
        return (self.operand,)

    def __str__(self) -> str:
        return f"({self.op}{' ' * (self.op == 'NOT')}{self.operand})"


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self) -> tuple[Expr, ...]:
        return self.left, self.right

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Aggregate(Expr):
    """``argument`` is None for COUNT(*)."""

    function: str
    argument: Expr | None

    def children(self) -> tuple[Expr, ...]:
        return () if self.argument is None else (self.argument,)

    def __str__(self) -> str:
        return f"{self.function}({'*' if self.argument is None else self.argument})"


class Statement:
    pass


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.name} AS {self.alias}" if self.alias else self.name


@dataclass(frozen=True)
class Join:
    table: TableRef
    on: Expr | None

    def __str__(self) -> str:
        return f"JOIN {self.table}" + (f" ON {self.on}" if self.on else "")


@dataclass(frozen=True)
class Select(Statement):
    items: tuple[Expr, ...]
    source: TableRef | None = None
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[tuple[Expr, bool], ...] = ()
    limit: Expr | None = None
    offset: Expr | None = None

    def __str__(self) -> str:
        parts = ["SELECT " + _list(self.items)]
        if self.source:
            parts += [f"FROM {self.source}", *map(str, self.joins)]
        for word, e in (("WHERE", self.where), ("GROUP BY", _list(self.group_by)), ("HAVING", self.having), ("ORDER BY", ", ".join(f"{e} {'ASC' if up else 'DESC'}" for e, up in self.order_by)), ("LIMIT", self.limit), ("OFFSET", self.offset)):
            if e is not None and e != "":
                parts.append(f"{word} {e}")
        return " ".join(parts)


@dataclass(frozen=True)
class Values(Statement):
    rows: tuple[tuple[Expr, ...], ...]

    def __str__(self) -> str:
        return "VALUES " + ", ".join(f"({_list(r)})" for r in self.rows)


@dataclass(frozen=True)
class Insert(Statement):
    table: str
    source: Values

    def __str__(self) -> str:
        return f"INSERT INTO {self.table} {self.source}"


@dataclass(frozen=True)
class Update(Statement):
    table: str
    sets: tuple[tuple[str, Expr], ...]
    where: Expr | None = None

    def __str__(self) -> str:
        return f"UPDATE {self.table} SET " + ", ".join(f"{n} = {e}" for n, e in self.sets) + (f" WHERE {self.where}" if self.where else "")


@dataclass(frozen=True)
class Delete(Statement):
    table: str
    where: Expr | None = None

    def __str__(self) -> str:
        return f"DELETE FROM {self.table}" + (f" WHERE {self.where}" if self.where else "")


@dataclass(frozen=True)
class CreateTable(Statement):
    table: str
    columns: tuple[tuple[str, str], ...]

    def __str__(self) -> str:
        return f"CREATE TABLE {self.table} (" + ", ".join(f"{n} {t}" for n, t in self.columns) + ")"


@dataclass(frozen=True)
class DropTable(Statement):
    table: str

    def __str__(self) -> str:
        return f"DROP TABLE {self.table}"


@dataclass(frozen=True)
class Explain(Statement):
    statement: Statement
    analyze: bool = False

    def __str__(self) -> str:
        return f"EXPLAIN {'ANALYZE ' * self.analyze}{self.statement}"


@dataclass(frozen=True)
class Prepare(Statement):
    name: str
    statement: Statement

    def __str__(self) -> str:
        return f"PREPARE {self.name} AS {self.statement}"


@dataclass(frozen=True)
class Execute(Statement):
    name: str
    arguments: tuple[Expr, ...] = field(default=())

    def __str__(self) -> str:
        return f"EXECUTE {self.name}" + (f"({_list(self.arguments)})" if self.arguments else "")


@dataclass(frozen=True)
class Deallocate(Statement):
    name: str

    def __str__(self) -> str:
        return f"DEALLOCATE {self.name}"


def _list(items: tuple) -> str:
    return ", ".join(map(str, items))


def walk(e: Expr):
    yield e
    for c in e.children():
        yield from walk(c)
