"""Table statistics, and estimates of how many rows a predicate keeps. Advice only: Catalyst plans by itself."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sql import nodes as N

#: Fixed value: the share of rows that an unknown predicate is taken to keep.
UNKNOWN = 0.33


@dataclass(frozen=True)
class ColumnStatistics:
    distinct: int
    nulls: int
    min: object = None
    max: object = None


@dataclass(frozen=True)
class TableStatistics:
    rows: int
    columns: dict[str, ColumnStatistics] = field(default_factory=dict)


def table_statistics(df: DataFrame, *, exact: bool = True) -> TableStatistics:
    """Counts and extremes in one aggregation. Distinct counts are exact by a distinct set of each column's values, reduced in each task before it is
    shuffled, one column at a time, so no row is multiplied; ``exact=False`` estimates them in the one aggregation."""
    asked = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        asked += [F.approx_count_distinct(x).alias(f"d{i}"), F.count_if(x.isNull()).alias(f"z{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    r = df.agg(*asked).first()
    if exact:
        parts = [df.select(F.col(f"`{c}`").alias("x")).where("x is not null").distinct().agg(F.lit(i).alias("i"), F.count("*").alias("n")) for i, c in enumerate(df.columns)]
        distinct = {x.i: x.n for x in reduce(DataFrame.union, parts).collect()} if parts else {}
    else:
        distinct = {i: r[f"d{i}"] for i in range(len(df.columns))}
    return TableStatistics(r["n"], {c: ColumnStatistics(distinct[i], r[f"z{i}"], r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(df.columns)})


def selectivity(e: N.Expr, stats: TableStatistics) -> float:
    """Estimated share of rows: equality by distinct values, ranges by their place between the least and the greatest number."""
    if isinstance(e, N.Literal) and isinstance(e.value, bool):
        return float(e.value)
    if isinstance(e, N.Unary) and e.op == "NOT":
        return 1 - selectivity(e.operand, stats)
    if not isinstance(e, N.Binary):
        return UNKNOWN
    if e.op in ("AND", "OR"):
        a, b = selectivity(e.left, stats), selectivity(e.right, stats)
        return a * b if e.op == "AND" else a + b - a * b
    mirror = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    name, literal, op = (e.left, e.right, e.op) if isinstance(e.left, N.Name) else (e.right, e.left, mirror.get(e.op, e.op))
    if not isinstance(name, N.Name) or not isinstance(literal, N.Literal) or name.column not in stats.columns:
        return UNKNOWN
    c = stats.columns[name.column]
    if op in ("=", "!="):
        share = 1 / c.distinct if c.distinct else UNKNOWN
        return share if op == "=" else 1 - share
    v = literal.value
    if op not in mirror or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (v, c.min, c.max)):
        return UNKNOWN
    if c.max == c.min:
        holds = {"<": c.min < v, "<=": c.min <= v, ">": c.min > v, ">=": c.min >= v}[op]
        return float(holds)
    below = min(1.0, max(0.0, (v - c.min) / (c.max - c.min)))
    return below if op in ("<", "<=") else 1 - below


def join_selectivity(left: ColumnStatistics, right: ColumnStatistics) -> float:
    """Share of all pairs that an equality of two columns keeps."""
    n = max(left.distinct, right.distinct)
    return 1 / n if n else UNKNOWN
