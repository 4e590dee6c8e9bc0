"""EXPLAIN and EXPLAIN ANALYZE: the statement's own operators, and what Catalyst made of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Node:
    name: str
    children: list[Node] = field(default_factory=list)
    rows: int | None = None
    micros: int | None = None

    def time(self) -> int:
        """Microseconds that Spark's metrics have of the node and of all below it."""
        return (self.micros or 0) + sum(c.time() for c in self.children)

    def text(self, prefix: str = "", last: bool = True) -> str:
        told = ""
        if self.rows is not None:
            rows_in = sum(c.rows or 0 for c in self.children)
            told = f" (rows_in={rows_in}, rows_out={self.rows}, time={self.time()}us)"
        lines = [f"{prefix}{'└── ' if last else '├── '}{self.name}{told}\n"]
        below = prefix + ("    " if last else "│   ")
        return "".join(lines + [c.text(below, c is self.children[-1]) for c in self.children])


@dataclass
class Explained:
    logical: Node
    optimized: Node
    physical: Node
    schema: str
    rules: list[str]

    def changed(self, rows: int) -> None:
        """The number of rows a change has hit, at the top of the plan that ran."""
        self.physical.rows = rows

    def text(self) -> str:
        return (
            f"=== LOGICAL PLAN ===\n{self.logical.text()}\n=== OPTIMIZED LOGICAL PLAN ===\n{self.optimized.text()}\n=== PHYSICAL PLAN ===\n{self.physical.text()}\n"
            f"=== OUTPUT SCHEMA ===\n{self.schema}\n\n=== OPTIMIZER RULES APPLIED ===\n" + "".join(f"{r}\n" for r in self.rules or ["(None)"])
        )


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _logical(plan) -> Node:
    name = re.sub(r"#\d+L?", "", plan.simpleString(12))
    return Node(name[:160], [_logical(c) for c in _seq(plan.children())])


def _physical(plan, measured: bool) -> Node:
    name = plan.nodeName()
    inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "TableCacheQueryStage": "plan", "ResultQueryStage": "plan"}.get(name)
    if inner:
        return _physical(getattr(plan, inner)(), measured)
    if name.startswith(("WholeStageCodegen", "InputAdapter", "AQEShuffleRead", "ColumnarToRow")):
        return _physical(plan.children().apply(0), measured)
    node = Node(re.sub(r"#\d+L?", "", plan.simpleString(12))[:160], [_physical(c, measured) for c in _seq(plan.children())])
    if measured:
        metrics = plan.metrics()
        value = lambda k: metrics.apply(k).value() if metrics.contains(k) else None
        node.rows = value("numOutputRows")
        if node.rows is None:  # operators that pass rows on as they are
            node.rows = sum(c.rows or 0 for c in node.children)
        node.micros = sum(u * (value(k) or 0) for k, u in (("scanTime", 1000), ("sortTime", 1000), ("aggTime", 1000), ("buildTime", 1000), ("pipelineTime", 1000), ("fetchWaitTime", 1000)))
    return node


def _rules(execution) -> list[str]:
    """Optimizer rules that changed the plan."""
    found, rules = [], execution.tracker().rules().iterator()
    while rules.hasNext():
        pair = rules.next()
        if pair._2().numEffectiveInvocations() > 0:
            found.append(pair._1().rsplit(".", 1)[-1].rstrip("$"))
    return sorted(found)


def _operators(steps: list[tuple[str, str, str | None]]) -> Node:
    """The statement's own operators; a join has what it joins as its second child."""
    node: Node | None = None
    for name, detail, joined in steps:
        below = [node] if node else []
        node = Node(f"{name} ({detail})" if detail else name, [*below, Node(f"SEQ_SCAN ({joined})")] if joined else below)
    return node or Node("VALUES")


def explain(df: DataFrame, steps: list[tuple[str, str, str | None]], *, analyze: bool = False, change: tuple[str, str, str | None] | None = None) -> Explained:
    """``steps``: the statement's operators, from the scan up. ``analyze`` runs the query and adds what each operator gave and took.
    With a ``change``, ``df`` has the rows it hits, and it stands on top of the plans."""
    execution = df._jdf.queryExecution()
    optimized = _logical(execution.optimizedPlan())
    if analyze:
        execution.toRdd().count()  # runs the plan and leaves its rows where they are
    physical = _physical(execution.executedPlan(), analyze)
    if change:
        top = f"{change[0]} ({change[1]})"
        optimized, physical = Node(top, [optimized]), Node(top, [physical])
    return Explained(_operators(steps), optimized, physical, f"Schema({'count' if change else ', '.join(df.columns)})", _rules(execution))
