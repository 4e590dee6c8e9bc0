import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import operators as R
from tessera.functions import avg_truncated, compare, int_divide, int_modulo, null_safe_predicate

C = F.col


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def make(spark):
    return lambda data, schema: R.values(spark, data, schema)


@pytest.fixture
def grouped(make):
    return make([(1, 10), (1, 20), (2, 50), (2, 50), (2, 20)], "g int, v int")


def test_values(make):
    data = [(1, True, "hello"), (2, False, "world")]
    assert rows(make(data, "a int, b boolean, c string")) == data
    assert rows(make([], "a int")) == []


def test_aggregate(grouped):
    v = C("v")
    df = R.aggregate(grouped, {"g": C("g")}, {"n": ("count", None), "s": ("sum", v), "hi": ("max", v), "lo": ("min", v), "a": ("avg", v)})
    assert sorted(rows(df)) == [(1, 2, 30, 20, 10, 15), (2, 3, 120, 50, 20, 40)]
    assert "HashAggregate" in plan(df) and "partial_" in plan(df)


def test_aggregate_empty(grouped):
    none = grouped.filter(F.lit(False))
    asked = {"n": ("count", None), "s": ("sum", C("v")), "a": ("avg", C("v"))}
    assert rows(R.aggregate(none, {}, asked)) == [(0, None, None)]
    assert rows(R.aggregate(none, {"g": C("g")}, asked)) == []


def test_null_keys_form_a_group_and_nulls_are_skipped(make):
    df = make([(None, 1), (None, None), (1, -7), (1, 0)], "g int, v int")
    found = rows(R.aggregate(df, {"g": C("g")}, {"n": ("count", None), "c": ("count", C("v")), "a": ("avg", C("v"))}))
    assert sorted(found, key=str) == [(1, 2, 2, -3), (None, 2, 1, 1)]


def test_group_without_aggregates(grouped):
    assert sorted(rows(R.aggregate(grouped, {"g": C("g")}, {}))) == [(1,), (2,)]


def test_hash_join(make):
    left, right = make([(1,), (2,), (3,), (2,), (None,)], "l int"), make([(2,), (4,), (2,), (1,), (None,)], "r int")
    df = R.hash_join(left, right, C("l"), C("r"))
    assert df.columns == ["l", "r"] and sorted(rows(df)) == [(1, 1), (2, 2), (2, 2), (2, 2), (2, 2)]
    assert "ShuffledHashJoin" in plan(R.hash_join(left, right, C("l"), C("r"), hint="shuffle_hash"))


def test_join_residual(make):
    data = [(1, 10), (2, 20), (2, 30)]
    df = R.hash_join(make(data, "a int, x int"), make(data, "b int, y int"), C("a"), C("b"), residual=C("x") != C("y"))
    assert sorted(rows(df)) == [(2, 20, 2, 30), (2, 30, 2, 20)]


def test_theta_and_cross_join(make):
    left, right = make([(1, 10), (2, 20)], "a int, x int"), make([(1, 5), (2, 15)], "b int, y int")
    df = R.theta_join(left, right, C("x") > C("y"))
    assert sorted(rows(df.select("x", "y"))) == [(10, 5), (20, 5), (20, 15)] and any(n in plan(df) for n in ("BroadcastNestedLoopJoin", "CartesianProduct"))
    assert len(rows(R.cross_join(left, right))) == 4
    assert len(rows(R.limit(R.cross_join(left, right), 3))) == 3


def test_having(make):
    df = make([(1, 5), (2, 15), (3, 8)], "id int, n int")
    assert rows(R.having(df, C("n") > 10)) == [(2, 15)]
    assert len(rows(R.having(df, None))) == 3
    assert rows(R.limit(R.having(df, C("n") > 6), 0)) == []


def test_order(make):
    df = make([(1, 20), (2, 10), (1, 10), (2, 20), (None, 1)], "a int, b int")
    assert rows(R.order_by(df, [(C("a"), True), (C("b"), False)])) == [(None, 1), (1, 20), (1, 10), (2, 20), (2, 10)]
    assert [r[0] for r in rows(R.order_by(df, [(C("a"), False)]))][-1] is None


@pytest.mark.parametrize("n, offset, expected", [(2, 0, [0, 1]), (5, 2, [2, 3, 4]), (0, 0, []), (5, 10, []), (2, 2, [2, 3]), (None, 3, [3, 4])])
def test_limit(make, n, offset, expected):
    df = R.order_by(make([(i,) for i in range(5)], "a int"), [(C("a"), True)])
    assert [r[0] for r in rows(R.limit(df, n, offset))] == expected


def test_limit_rejects_negative(grouped):
    with pytest.raises(ValueError):
        R.limit(grouped, -1)


def test_top_k_is_sort_and_slice(make):
    data = [((i * 7919) % 1000, i) for i in range(200)]
    df = R.top_k(make(data, "id int, v int"), [(C("id"), True)], 10, 5, tie=["v"])
    assert rows(df) == sorted(data)[5:15] and "TakeOrderedAndProject" in plan(df)


def test_index_scan(make):
    df = make([(1, 10), (5, 50), (10, 100), (15, 150)], "id int, v int")
    for op, n in (("=", 1), (">", 2), (">=", 3), ("<", 1), ("<=", 2), ("!=", 3)):
        assert len(rows(R.index_scan(df, "id", op, 5 if op in ("=", "!=", ">", ">=") else 5))) == n
    assert [r[0] for r in rows(R.index_scan(df, "id", ">", 1, ordered=True))] == [5, 10, 15]


def test_scan_pushes_down(spark):
    df = R.seq_scan(spark, "/root/testdata/sf0.001/orders.parquet", ["o_custkey"], C("o_orderkey") > 10)
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,10)]" in text and "o_totalprice" not in text.split("== Physical")[1]


def test_project(make):
    df = R.project(make([(10, 20), (30, 40)], "a int, b int"), {"s": C("a") + C("b"), "k": F.lit(100)})
    assert df.columns == ["s", "k"] and rows(df) == [(30, 100), (70, 100)]


def test_scalar_functions(make):
    df = make([(-7, 2), (7, -2), (None, 1)], "a int, b int")
    assert rows(df.select(int_divide(C("a"), C("b"), "int"), int_modulo(C("a"), C("b")))) == [(-3, -1), (-3, 1), (None, None)]
    assert rows(df.select(compare("<", C("a"), C("b")))) == [(True,), (False,), (None,)]
    assert rows(df.select(~null_safe_predicate(C("a") > 0))) == [(True,), (False,), (True,)]
    assert rows(df.agg(avg_truncated(C("a")))) == [(0,)]
    with pytest.raises(PySparkException):
        df.select(int_divide(C("a"), F.lit(0))).collect()
