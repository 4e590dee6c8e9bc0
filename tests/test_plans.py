import math

import pytest

from tessera.plans import ColumnStatistics, CostModel, TableStatistics, join_selectivity, selectivity, table_statistics
from tessera.plans.cost import Estimate
from tessera.sql import parse_expression

STATS = TableStatistics(100, {"a": ColumnStatistics(10, 0, 0, 100)})


def test_table_statistics(spark):
    df = spark.createDataFrame([(1, True, "Alice"), (2, False, "Bob"), (3, True, "Charlie"), (3, True, "Charlie2"), (None, None, None)], "id int, active boolean, name string")
    s = table_statistics(df)
    assert s.rows == 5 and s.columns["id"] == ColumnStatistics(3, 1, 1, 3)
    assert s.columns["active"].distinct == 2 and s.columns["name"] == ColumnStatistics(4, 1, "Alice", "Charlie2")
    assert table_statistics(df, exact=False).columns["name"].distinct == 4
    assert table_statistics(df.limit(0)).columns["id"] == ColumnStatistics(0, 0, None, None)


@pytest.mark.parametrize(
    "text, expected",
    [("a = 3", 0.1), ("a != 3", 0.9), ("a < 25", 0.25), ("a >= 25", 0.75), ("25 > a", 0.25), ("a > 200", 0.0), ("a = 3 AND a < 25", 0.025), ("a = 3 OR a < 25", 0.325), ("NOT a = 3", 0.33), ("NOT (a = 3)", 0.9), ("b = 1", 0.33), ("true", 1.0), ("a = a", 0.33)],
)
def test_selectivity(text, expected):
    assert selectivity(parse_expression(text), STATS) == pytest.approx(expected)


def test_join_selectivity():
    assert join_selectivity(ColumnStatistics(50, 0), ColumnStatistics(200, 0)) == 0.005


def test_costs():
    m = CostModel()
    scan = m.seq_scan()
    assert scan.cost == 1000 and m.seq_scan(TableStatistics(500)).cost == 500 and m.index_scan().cost == 100
    assert m.filter(scan).cost == 2000
    assert m.nested_loop_join(scan, scan).cost == 1_002_000 and m.hash_join(scan, scan).cost == 4000
    one = m.seq_scan(TableStatistics(1))
    assert (m.nested_loop_join(one, one).cost, m.hash_join(one, one).cost) == (3, 4)
    assert m.better_join(one, one) == "nested_loop" and m.better_join(scan, scan) == "hash"
    assert m.sort(scan).cost == 1000 + 1000 * math.log2(1000) and m.top_k(scan, 16).cost == 5000
    assert m.top_k(scan, 16) == Estimate(5000, 16)
