"""Costs of operators in rows touched, to compare plans by hand. Advice only: sizes and adaptive execution decide at run time."""

from __future__ import annotations

import math
from dataclasses import dataclass

from tessera.plans.statistics import TableStatistics


@dataclass(frozen=True)
class Estimate:
    cost: float
    rows: float


@dataclass(frozen=True)
class CostModel:
    #: Rows of a table without statistics, and the cost of an index scan.
    default_rows: float = 1000
    index_cost: float = 100

    def seq_scan(self, stats: TableStatistics | None = None) -> Estimate:
        n = float(stats.rows) if stats else self.default_rows
        return Estimate(n, n)

    def index_scan(self) -> Estimate:
        return Estimate(self.index_cost, self.index_cost)

    def filter(self, child: Estimate, share: float = 1.0) -> Estimate:
        return Estimate(child.cost + child.rows, child.rows * share)

    def nested_loop_join(self, left: Estimate, right: Estimate) -> Estimate:
        pairs = left.rows * right.rows
        return Estimate(left.cost + right.cost + pairs, pairs)

    def hash_join(self, left: Estimate, right: Estimate) -> Estimate:
        return Estimate(left.cost + right.cost + left.rows + right.rows, max(left.rows, right.rows))

    def sort(self, child: Estimate) -> Estimate:
        return Estimate(child.cost + child.rows * math.log2(max(child.rows, 2)), child.rows)

    def top_k(self, child: Estimate, k: int) -> Estimate:
        return Estimate(child.cost + child.rows * math.log2(max(k, 2)), min(child.rows, k))

    def better_join(self, left: Estimate, right: Estimate) -> str:
        """A tie keeps the nested loop."""
        return "hash" if self.hash_join(left, right).cost < self.nested_loop_join(left, right).cost else "nested_loop"
