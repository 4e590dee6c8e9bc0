"""Syntax trees to DataFrames: names are resolved, types are checked strictly, and the result is one Catalyst plan.

The dialect differs from Spark SQL where it must: identifiers are case-sensitive, a table's own name stays usable beside its
alias, operands of different families are refused instead of cast, integer division truncates, and unnamed
outputs are called ``expr<position>``. Every table's columns get internal names while a query is bound, so
joins of a table with itself and clashing names need no care.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import BindError
from tessera.functions import scalar as S
from tessera.operators import relational as R
from tessera.sql import nodes as N


@dataclass(frozen=True)
class Bound:
    column: Column
    kind: str
    constant: bool = False
    type: str | None = None  # of a plain integer column, to give division its type back


@dataclass(frozen=True)
class Field:
    tables: tuple[str, ...]  # names it may be qualified with
    name: str
    bound: Bound
    number: int = 0  # of its table in the FROM clause


class Scope:
    """What names can mean; after grouping also what whole expressions stand for."""

    def __init__(self, fields: Sequence[Field], made: dict[tuple, Bound] | None = None, grouped: bool = False):
        self.fields, self.made, self.grouped = list(fields), made or {}, grouped

    def find(self, name: N.Name) -> Field:
        known = [f for f in self.fields if name.table is None or name.table in f.tables]
        if name.table is not None:
            if not known:
                raise BindError(f"Unknown table or alias: {name.table}")
            if len({f.number for f in known}) > 1:
                raise BindError(f"Ambiguous column: {name.column}")
        hits = [f for f in known if f.name == name.column]
        if not hits:
            raise BindError(f"Unknown column: {name.column}")
        if len(hits) > 1:
            raise BindError(f"Ambiguous column: {name.column}")
        return hits[0]


Log = Callable[[str, str], None]


class Binder:
    """Binds one statement. ``arguments``: values for its parameters; without them parameters are only typed."""

    def __init__(self, spark: SparkSession, table: Callable[[str], DataFrame], arguments: Sequence[object] | None = None):
        self.spark, self.table, self.arguments = spark, table, arguments
        self.parameter_kinds: dict[int, str] = {}
        #: The statement's operators from the scan up for EXPLAIN: name, details, and for a join what it joins.
        self.steps: list[tuple[str, str, str | None]] = []

    # expressions

    def bind(self, e: N.Expr, scope: Scope, expected: str | None = None) -> Bound:
        key = self.key(e, scope)
        if key in scope.made:
            return scope.made[key]
        if isinstance(e, N.Literal):
            return self.literal(e.value)
        if isinstance(e, N.Parameter):
            return self.parameter(e, expected)
        if isinstance(e, N.Name):
            field = scope.find(e)
            if scope.grouped:
                raise BindError(f"Column must appear in GROUP BY or in an aggregate: {e.column}")
            return field.bound
        if isinstance(e, N.Unary):
            return self.unary(e, scope)
        if isinstance(e, N.Binary):
            return self.binary(e, scope)
        if isinstance(e, N.Aggregate):
            raise BindError(f"Aggregate not allowed here: {e}")
        raise BindError(f"Not an expression: {e}")

    def key(self, e: N.Expr, scope: Scope) -> tuple:
        """The expression with its names resolved, to compare it by."""
        if isinstance(e, N.Name):
            try:
                return ("name", scope.fields.index(scope.find(e)))
            except BindError:
                return ("name", e)
        if isinstance(e, N.Literal):
            return ("literal", type(e.value), e.value)
        if isinstance(e, N.Parameter):
            return ("parameter", e.index)
        return (type(e), getattr(e, "op", getattr(e, "function", None)), *(self.key(c, scope) for c in e.children()))

    def literal(self, v: object) -> Bound:
        kind = S.NULL if v is None else S.BOOLEAN if isinstance(v, bool) else S.INT if isinstance(v, int) else S.FLOAT if isinstance(v, (float, Decimal)) else S.STRING
        column = F.lit(v)
        if kind == S.INT:
            column = column.cast("int" if -(2**31) <= v < 2**31 else "bigint")
        return Bound(column, kind, True, "int" if kind == S.INT and -(2**31) <= v < 2**31 else None)

    def parameter(self, p: N.Parameter, expected: str | None) -> Bound:
        kind = self.parameter_kinds.setdefault(p.index, expected or S.NULL)
        if kind == S.NULL and expected:
            kind = self.parameter_kinds[p.index] = expected
        if self.arguments is not None:
            return replace(self.literal(self.arguments[p.index]), constant=False)
        types = {S.INT: "int", S.FLOAT: "double", S.STRING: "string", S.BOOLEAN: "boolean", S.TEMPORAL: "timestamp"}
        return Bound(F.lit(None).cast(types[kind]) if kind in types else F.lit(None), kind)

    def unary(self, e: N.Unary, scope: Scope) -> Bound:
        x = self.bind(e.operand, scope, S.BOOLEAN if e.op == "NOT" else S.INT)
        if e.op == "NOT":
            if x.kind not in (S.BOOLEAN, S.NULL):
                raise BindError(f"NOT needs a boolean: {e.operand}")
            return Bound(~x.column.cast("boolean"), S.BOOLEAN, x.constant)
        if S.family(x.kind) not in ("numeric", S.NULL):
            raise BindError(f"Unary {e.op} needs a number: {e.operand}")
        return x if e.op == "+" or x.kind == S.NULL else replace(x, column=S.negate(x.column))

    def binary(self, e: N.Binary, scope: Scope) -> Bound:
        logical = e.op in ("AND", "OR")
        if isinstance(e.left, N.Parameter) and not logical:
            b = self.bind(e.right, scope)
            a = self.bind(e.left, scope, b.kind)
        else:
            a = self.bind(e.left, scope, S.BOOLEAN if logical else None)
            b = self.bind(e.right, scope, S.BOOLEAN if logical else a.kind)
        if S.family(a.kind) != S.family(b.kind) and S.NULL not in (a.kind, b.kind):
            raise BindError(f"Type mismatch in {e}: {a.kind} and {b.kind}")
        constant = a.constant and b.constant
        kind = a.kind if a.kind != S.NULL else b.kind
        if logical:
            if kind not in (S.BOOLEAN, S.NULL):
                raise BindError(f"{e.op} needs booleans: {e}")
            x, y = a.column.cast("boolean"), b.column.cast("boolean")
            return Bound(x & y if e.op == "AND" else x | y, S.BOOLEAN, constant)
        if e.op in S.COMPARISONS:
            return Bound(S.compare(e.op, a.column, b.column), S.BOOLEAN, constant)
        if S.family(kind) not in ("numeric", S.NULL):
            raise BindError(f"{e.op} needs numbers: {e}")
        return self.arithmetic(e.op, a, b, constant)

    def arithmetic(self, op: str, a: Bound, b: Bound, constant: bool) -> Bound:
        if S.NULL in (a.kind, b.kind):
            kind = a.kind if a.kind != S.NULL else b.kind
            return Bound(F.lit(None).cast("int" if kind in (S.INT, S.NULL) else "double"), S.INT if kind == S.NULL else kind, constant)
        kind = S.FLOAT if S.FLOAT in (a.kind, b.kind) else S.INT
        both = "int" if a.type == b.type == "int" else None
        if op in "+-*":
            made = {"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column}[op]
            return Bound(made, kind, constant, both)
        divide = S.int_modulo if op == "%" else S.int_divide if kind == S.INT else (lambda x, y: x / y)
        if constant:  # a constant division by zero is null, any other an error
            made = F.call_function("try_divide" if kind == S.FLOAT and op == "/" else "try_mod" if op == "%" else "div", a.column, b.column if op == "%" or kind == S.FLOAT else F.nullif(b.column, F.lit(0)))
        else:
            made = divide(a.column, b.column)
        return Bound(made.cast("int") if both and op == "/" else made, kind, constant, both)

    def predicate(self, e: N.Expr, scope: Scope, clause: str) -> Column:
        found = self.bind(e, scope, S.BOOLEAN)
        if found.kind not in (S.BOOLEAN, S.NULL):
            raise BindError(f"{clause} must be boolean: {e}")
        return found.column.cast("boolean")

    def step(self, name: str, detail: str, joined: str | None = None) -> None:
        self.steps.append((name, detail, joined))

    def joins_by_equality(self, e: N.Expr, scope: Scope, number: int) -> bool:
        """Whether a condition that must hold equates something of table ``number`` with something of those before it."""
        if not isinstance(e, N.Binary):
            return False
        if e.op == "AND":
            return self.joins_by_equality(e.left, scope, number) or self.joins_by_equality(e.right, scope, number)
        sides = [{scope.find(x).number for x in N.walk(side) if isinstance(x, N.Name)} for side in (e.left, e.right)]
        return e.op == "=" and all(sides) and {number} in sides and any(number not in side for side in sides)

    # queries

    def scan(self, ref: N.TableRef, number: int) -> tuple[DataFrame, list[Field]]:
        df = self.table(ref.name)
        fields = []
        for i, f in enumerate(df.schema.fields):
            column = F.col(f"__{number}_{i}")
            fields.append(Field((ref.name, ref.alias) if ref.alias else (ref.name,), f.name, Bound(column, S.kind_of(f.dataType), type="int" if f.dataType.simpleString() == "int" else None), number))
        return df.toDF(*[f"__{number}_{i}" for i in range(len(fields))]), fields

    def source(self, s: N.Select) -> tuple[DataFrame, Scope]:
        if s.source is None:
            return self.spark.range(1).select(), Scope([])
        df, fields = self.scan(s.source, 0)
        self.step("SEQ_SCAN", f"table: {s.source.name}")
        for k, j in enumerate(s.joins):
            other, more = self.scan(j.table, k + 1)
            fields = [*fields, *more]
            scope = Scope(fields)
            df = R.cross_join(df, other) if j.on is None else R.theta_join(df, other, self.predicate(j.on, scope, "ON"))
            equal = j.on is not None and self.joins_by_equality(j.on, scope, k + 1)
            self.step("HASH_JOIN" if equal else "NESTED_LOOP_JOIN", "" if j.on is None else f"on: {j.on}", f"table: {j.table.name}")
        return df, Scope(fields)

    def select(self, s: N.Select) -> DataFrame:
        df, scope = self.source(s)
        if s.where is not None:
            df = R.filter_rows(df, self.predicate(s.where, scope, "WHERE"))
            self.step("FILTER", str(s.where))
        asked = [*s.items, *([s.having] if s.having is not None else []), *[e for e, _ in s.order_by]]
        calls = [x for e in asked for x in N.walk(e) if isinstance(x, N.Aggregate)]
        if calls or s.group_by or s.having is not None:
            df, scope = self.aggregate(df, scope, s.group_by, calls)
        if s.having is not None:
            df = R.having(df, self.predicate(s.having, scope, "HAVING"))
            self.step("HAVING", str(s.having))

        outputs: list[tuple[str, Bound]] = []
        for item in s.items:
            if isinstance(item, N.Star):
                if not scope.fields or scope.grouped:
                    raise BindError("* needs a FROM clause and no grouping")
                outputs += [(f.name, f.bound) for f in scope.fields]
            else:
                outputs.append((item.column if isinstance(item, N.Name) else f"expr{len(outputs)}", self.bind(item, scope)))
        if s.order_by:
            df = R.order_by(df, [(self.sort_key(e, scope, s.items, outputs), up) for e, up in s.order_by])
            self.step("ORDER_BY", ", ".join(str(e) for e, _ in s.order_by))
        if s.limit is not None or s.offset is not None:
            n, skip = self.count(s.limit, "LIMIT"), self.count(s.offset, "OFFSET") or 0
            df = R.limit(df, n, skip)
            top = s.order_by and n is not None
            if top:
                self.steps.pop()
            self.step("TOP_K" if top else "LIMIT", f"{n if n is not None else 'all'} offset {skip}")
        self.step("PROJECTION", ", ".join(n for n, _ in outputs))
        return df.select(*[b.column.alias(n) for n, b in outputs])

    def sort_key(self, e: N.Expr, scope: Scope, items: tuple[N.Expr, ...], outputs: list[tuple[str, Bound]]) -> Column:
        """An output's name comes before the names of the tables."""
        if isinstance(e, N.Name) and e.table is None:
            hits = [b for n, b in outputs if n == e.column]
            if len(hits) == 1:
                return hits[0].column
        return self.bind(e, scope).column

    def count(self, e: N.Expr | None, clause: str) -> int | None:
        if e is None:
            return None
        if isinstance(e, N.Parameter):
            self.parameter(e, S.INT)
            if self.arguments is None:
                return 0
        v = self.evaluate(e)
        if not isinstance(v, int) or isinstance(v, bool) or v < 0:
            raise BindError(f"{clause} must be a whole number and not negative: {e}")
        return v

    def evaluate(self, e: N.Expr) -> object:
        """The value of an expression without columns, which needs no job."""
        if isinstance(e, N.Literal):
            return e.value
        if isinstance(e, N.Parameter) and self.arguments is not None:
            return self.arguments[e.index]
        return self.spark.range(1).select(self.bind(e, Scope([])).column).first()[0]

    def aggregate(self, df: DataFrame, scope: Scope, keys: tuple[N.Expr, ...], calls: list[N.Aggregate]) -> tuple[DataFrame, Scope]:
        made: dict[tuple, Bound] = {}
        by: dict[str, Column] = {}
        for e in keys:
            b = self.bind(e, scope)
            name = f"group_by_{len(by)}"
            by[name] = b.column
            made[self.key(e, scope)] = replace(b, column=F.col(name))
        aggs: dict[str, tuple[str, Column | None]] = {}
        for call in calls:
            key = self.key(call, scope)
            if key in made:
                continue
            f, argument, kind, kept = call.function.lower(), None, S.INT, None
            if call.argument is not None:
                if any(isinstance(x, N.Aggregate) for x in N.walk(call.argument)):
                    raise BindError(f"Aggregates can't be nested: {call}")
                arg = self.bind(call.argument, scope)
                if f in ("sum", "avg") and S.family(arg.kind) not in ("numeric", S.NULL):
                    raise BindError(f"{call.function} needs numbers: {call}")
                argument = arg.column.cast("int") if arg.kind == S.NULL else arg.column
                kind, kept = (S.INT, None) if f == "count" else (arg.kind, arg.type if f in ("min", "max") else None)
                f = "mean" if f == "avg" and arg.kind == S.FLOAT else f
            name = f"agg_{len(aggs)}"
            aggs[name] = (f, argument)
            made[key] = Bound(F.col(name), kind, type=kept)
        self.step("AGGREGATION", ", ".join(map(str, [*keys, *dict.fromkeys(calls)])))
        return R.aggregate(df, by, aggs), Scope(scope.fields, made, grouped=True)

    def values(self, v: N.Values) -> DataFrame:
        rows = [[self.bind(e, Scope([])) for e in row] for row in v.rows]
        if len({len(r) for r in rows}) > 1:
            raise BindError("VALUES rows differ in length")
        kinds = []
        for column in zip(*rows, strict=True):
            found = {S.family(b.kind) for b in column} - {S.NULL}
            if len(found) > 1:
                raise BindError("Type mismatch in VALUES")
            kinds.append(found.pop() if found else S.NULL)
        self.step("VALUES", f"rows: {len(rows)}")
        one = self.spark.range(1)
        struct = lambda row: F.struct(*[(b.column if b.kind != S.NULL else b.column.cast({"numeric": "int"}.get(k, k if k != S.NULL else "string"))).alias(f"val{i}") for i, (b, k) in enumerate(zip(row, kinds, strict=True))])
        return one.select(F.inline(F.array(*[struct(r) for r in rows])))

    def checked_row(self, exprs: Sequence[N.Expr], columns: Sequence[tuple[str, str]], scope: Scope, where: str) -> list[Column]:
        """Values for a table's columns (name, Spark type); families must agree."""
        out = []
        for e, (name, data_type) in zip(exprs, columns, strict=True):
            kind = S.kind_of(_type(data_type))
            b = self.bind(e, scope, kind)
            if b.kind != S.NULL and S.family(b.kind) != S.family(kind):
                raise BindError(f"Type mismatch in {where} for column {name}: {b.kind} is not {kind}")
            out.append(b.column.cast(data_type))
        return out


def _type(name: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(f"x {name}").fields[0].dataType
