from tessera.operators.relational import (
    aggregate,
    cross_join,
    distinct_keys,
    filter_rows,
    hash_join,
    having,
    index_scan,
    limit,
    order_by,
    project,
    seq_scan,
    sort_partitions,
    theta_join,
    top_k,
    values,
)

__all__ = [
    "aggregate",
    "cross_join",
    "distinct_keys",
    "filter_rows",
    "hash_join",
    "having",
    "index_scan",
    "limit",
    "order_by",
    "project",
    "seq_scan",
    "sort_partitions",
    "theta_join",
    "top_k",
    "values",
]
