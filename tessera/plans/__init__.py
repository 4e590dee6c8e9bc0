from tessera.plans.cost import CostModel
from tessera.plans.explain import explain
from tessera.plans.statistics import ColumnStatistics, TableStatistics, join_selectivity, selectivity, table_statistics

__all__ = ["ColumnStatistics", "CostModel", "TableStatistics", "explain", "join_selectivity", "selectivity", "table_statistics"]
