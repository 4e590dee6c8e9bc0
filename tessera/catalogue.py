"""Named queries over the test tables, by the operators and by the SQL dialect, each with SQL that says the same to DuckDB."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import operators as R
from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.functions import avg_truncated, compare, int_divide, int_modulo, negate
from tessera.plans import CostModel, selectivity, table_statistics
from tessera.shell import split_statements
from tessera.sources import KeyIndex
from tessera.sources.files import Store
from tessera.sql import parse_expression

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The tables there are.
TABLES = "region nation customer supplier part orders lineitem events".split()


def query(oracle: str | None = None) -> Callable[[Callable], Callable]:
    """Register a function of a table reader under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: R.seq_scan(spark, f"{sf_dir}/{t}.parquet"))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


K, C = F.col, lambda *names: {n: F.col(n) for n in names}


def mod3():
    """A column with nulls, made from one without."""
    return F.nullif(int_modulo(K("p_size"), F.lit(3)), F.lit(0))


@query("select n_nationkey, n_name, n_regionkey from nation")
def seq_scan(t):
    return R.project(t("nation"), C("n_nationkey", "n_name", "n_regionkey"))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity >= 30 and l_returnflag = 'R'")
def filter_conj(t):
    return R.project(R.filter_rows(t("lineitem"), (K("l_quantity") >= 30) & (K("l_returnflag") == "R")), C("l_orderkey", "l_linenumber"))


@query("select p_partkey, p_size from part where not (p_size < 10 or p_size > 40)")
def or_not(t):
    return R.project(R.filter_rows(t("part"), ~((K("p_size") < 10) | (K("p_size") > 40))), C("p_partkey", "p_size"))


@query("select p_partkey, m from (select p_partkey, nullif(p_size % 3, 0) as m from part) where m <> 1")
def null_filter(t):
    return R.filter_rows(R.project(t("part"), {"p_partkey": K("p_partkey"), "m": mod3()}), K("m") != 1)


@query("select p_partkey, p_size + 1 as a, p_size - 25 as b, p_size * 2 as c, (p_size - 25) // 4 as d, (p_size - 25) % 4 as e, -p_size as f from part")
def arith(t):
    p, q = K("p_size"), K("p_size") - 25
    return R.project(t("part"), {"p_partkey": K("p_partkey"), "a": p + 1, "b": q, "c": p * 2, "d": int_divide(q, F.lit(4), "int"), "e": int_modulo(q, F.lit(4)), "f": negate(p)})


@query("select o_orderkey, o_custkey from orders where o_orderkey = 42")
def index_eq(t):
    return R.project(R.index_scan(t("orders"), "o_orderkey", "=", 42), C("o_orderkey", "o_custkey"))


@query("select o_orderkey, o_custkey from orders where o_orderkey >= 100 and o_orderkey < 200")
def index_range(t):
    return R.project(R.index_scan(R.index_scan(t("orders"), "o_orderkey", ">=", 100), "o_orderkey", "<", 200, ordered=True), C("o_orderkey", "o_custkey"))


@query("select o_orderkey, o_custkey from orders where o_orderkey <> 42")
def index_not_equal(t):
    return R.project(R.index_scan(t("orders"), "o_orderkey", "!=", 42), C("o_orderkey", "o_custkey"))


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def hash_join(t):
    return R.project(R.hash_join(t("orders"), t("customer"), K("o_custkey"), K("c_custkey")), C("o_orderkey", "c_name"))


@query("select p_partkey, n_name from (select p_partkey, nullif(p_size % 5, 0) as k from part) join nation on k = n_nationkey")
def null_key_join(t):
    p = R.project(t("part"), {"p_partkey": K("p_partkey"), "k": F.nullif(int_modulo(K("p_size"), F.lit(5)), F.lit(0))})
    return R.project(R.hash_join(p, t("nation"), K("k"), K("n_nationkey")), C("p_partkey", "n_name"))


@query("select count(*) as n from lineitem join orders on l_orderkey = o_orderkey and l_shipdate > o_orderdate")
def join_residual(t):
    j = R.hash_join(t("lineitem"), t("orders"), K("l_orderkey"), K("o_orderkey"), residual=K("l_shipdate") > K("o_orderdate"))
    return R.aggregate(j, {}, {"n": ("count", None)})


@query("select a.n_name as x, b.n_name as y from nation a join nation b on a.n_nationkey < b.n_nationkey")
def theta_join(t):
    a = R.project(t("nation"), {"i": K("n_nationkey"), "x": K("n_name")})
    b = R.project(t("nation"), {"j": K("n_nationkey"), "y": K("n_name")})
    return R.project(R.theta_join(a, b, K("i") < K("j")), C("x", "y"))


@query("select r_name, n_name from region cross join nation")
def cross_join(t):
    return R.project(R.cross_join(t("region"), t("nation")), C("r_name", "n_name"))


@query("select r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name")
def join3(t):
    j = R.hash_join(R.hash_join(t("customer"), t("nation"), K("c_nationkey"), K("n_nationkey")), t("region"), K("n_regionkey"), K("r_regionkey"))
    return R.aggregate(j, C("r_name"), {"n": ("count", None)})


@query("select p_brand, count(*) as n, count(p_size) as c, cast(sum(p_size) as bigint) as s, min(p_size) as lo, max(p_size) as hi, cast(sum(p_size) as bigint) // count(p_size) as a from part group by p_brand")
def agg_all(t):
    p = K("p_size")
    return R.aggregate(t("part"), C("p_brand"), {"n": ("count", None), "c": ("count", p), "s": ("sum", p), "lo": ("min", p), "hi": ("max", p), "a": ("avg", p)})


@query("select nullif(p_size % 3, 0) as m, count(*) as n, count(nullif(p_size % 3, 0)) as c from part group by nullif(p_size % 3, 0)")
def agg_null_group(t):
    return R.aggregate(t("part"), {"m": mod3()}, {"n": ("count", None), "c": ("count", mod3())})


@query("select count(*) as n, cast(sum(p_size) as bigint) as s, min(p_size) as lo, max(p_size) as hi, cast(sum(p_size) as bigint) // nullif(count(p_size), 0) as a from part where p_size < 0")
def agg_global_empty(t):
    p = K("p_size")
    return R.aggregate(R.filter_rows(t("part"), p < 0), {}, {"n": ("count", None), "s": ("sum", p), "lo": ("min", p), "hi": ("max", p), "a": ("avg", p)})


@query("select p_brand, count(*) as n from part where p_size < 0 group by p_brand")
def agg_grouped_empty(t):
    return R.aggregate(R.filter_rows(t("part"), K("p_size") < 0), C("p_brand"), {"n": ("count", None)})


@query("select c_mktsegment, min(c_name) as lo, max(c_name) as hi from customer group by c_mktsegment")
def agg_minmax_str(t):
    return R.aggregate(t("customer"), C("c_mktsegment"), {"lo": ("min", K("c_name")), "hi": ("max", K("c_name"))})


@query("select event_type, min(value > 50.0) as lo, max(value > 50.0) as hi from events group by event_type")
def agg_minmax_bool(t):
    v = K("value") > 50.0
    return R.aggregate(t("events"), C("event_type"), {"lo": ("min", v), "hi": ("max", v)})


@query("select p_size % 7 as k, count(*) as n from part group by p_size % 7")
def group_expr(t):
    return R.aggregate(t("part"), {"k": int_modulo(K("p_size"), F.lit(7))}, {"n": ("count", None)})


@query("select o_orderstatus, o_orderpriority from orders group by o_orderstatus, o_orderpriority")
def group_noagg(t):
    return R.aggregate(t("orders"), C("o_orderstatus", "o_orderpriority"), {})


@query("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 15")
def having(t):
    return R.having(R.aggregate(t("orders"), C("o_custkey"), {"n": ("count", None)}), K("n") > 15)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")
def topk(t):
    return R.project(R.top_k(t("orders"), [(K("o_totalprice"), False), (K("o_orderkey"), True)], 10, 5), C("o_orderkey", "o_totalprice"))


@query("select n_nationkey, n_name from nation order by n_nationkey offset 20")
def order_offset_only(t):
    return R.project(R.limit(R.order_by(t("nation"), [(K("n_nationkey"), True)]), None, 20), C("n_nationkey", "n_name"))


@query("select p_partkey, p_brand, p_size from part")
def sort(t):
    return R.project(R.order_by(t("part"), [(K("p_brand"), True), (K("p_size"), False)], tie=["p_partkey"]), C("p_partkey", "p_brand", "p_size"))


@query("select p_partkey, p_brand from part")
def sort_within(t):
    return R.project(R.sort_partitions(t("part"), [(K("p_brand"), True)]), C("p_partkey", "p_brand"))


@query("select n_nationkey from nation limit 0")
def limit0(t):
    return R.project(R.limit(t("nation"), 0), C("n_nationkey"))


@query("select event_id from events where (value > 50.0) > false")
def bool_cmp(t):
    return R.project(R.filter_rows(t("events"), compare(">", K("value") > 50.0, F.lit(False))), C("event_id"))


@query("select p_partkey, case when p_size > 40 then 0 else p_size end as p_size from part")
def update_sim(t):
    return R.project(t("part"), {"p_partkey": K("p_partkey"), "p_size": F.when(F.coalesce(K("p_size") > 40, F.lit(False)), F.lit(0)).otherwise(K("p_size"))})


@query("select p_partkey, p_size from part where not coalesce(nullif(p_size % 3, 0) = 1, false)")
def delete_sim(t):
    return R.project(R.filter_rows(t("part"), ~F.coalesce(mod3() == 1, F.lit(False))), C("p_partkey", "p_size"))


@query("select cast(sum(p_size) as bigint) // count(p_size) as a, avg(p_size) as mean from part")
def averages(t):
    return t("part").agg(avg_truncated(K("p_size")).alias("a"), F.avg("p_size").alias("mean"))


@query(
    """select c_mktsegment, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as qty from lineitem
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    where l_quantity > 10 group by c_mktsegment having count(*) > 100 order by qty desc, c_mktsegment limit 3"""
)
def flagship(t):
    j = R.hash_join(R.filter_rows(t("lineitem"), K("l_quantity") > 10), t("orders"), K("l_orderkey"), K("o_orderkey"))
    j = R.hash_join(j, t("customer"), K("o_custkey"), K("c_custkey"))
    g = R.having(R.aggregate(j, C("c_mktsegment"), {"n": ("count", None), "qty": ("sum", K("l_quantity").cast("bigint"))}), K("n") > 100)
    return R.top_k(g, [(K("qty"), False), (K("c_mktsegment"), True)], 3)


# queries that need a session of their own


def _register(f: Callable[[SparkSession, str], DataFrame], name: str, oracle: str | None) -> None:
    QUERIES[name] = f
    if oracle:
        ORACLE_SQL[name] = oracle


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.values(spark, [(1, "hello"), (2, "world")], "val0 int, val1 string")


def _col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table_statistics(R.seq_scan(spark, f"{sf_dir}/part.parquet", ["p_size"]))
    c = s.columns["p_size"]
    return R.values(spark, [(s.rows, c.distinct, c.nulls, c.min, c.max)], "n long, d long, z long, lo int, hi int")


_register(_values, "values", "select * from (values (1, 'hello'), (2, 'world')) as v(val0, val1)")
_register(_col_stats, "col_stats", "select count(*) as n, count(distinct p_size) as d, count(*) filter (p_size is null) as z, min(p_size) as lo, max(p_size) as hi from part")


@contextmanager
def _engine(spark: SparkSession, sf_dir: str) -> Iterator[Engine]:
    """An engine over the test tables, with its own tables in a folder that is removed: a shared one, where the session names it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    root = Store(spark, f"{shared.rstrip('/')}/tessera-engine-{uuid.uuid4().hex}")
    e = Engine(spark, root.root)
    for t in TABLES:
        e.register_parquet(t, f"{sf_dir}/{t}.parquet")
    try:
        yield e
    finally:
        root.delete()


def _sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark, sf_dir) as e:
        return e.query(text)


#: The same by SQL text: the dialect's statement, and DuckDB's if it differs.
STATEMENTS: dict[str, tuple[str, str | None]] = {
    "sql_project": ("SELECT n_name, n_nationkey * 2 + 1, 7 FROM nation", "select n_name, n_nationkey * 2 + 1 as expr1, 7 as expr2 from nation"),
    "sql_star_alias": ("SELECT n.n_name, nation.n_regionkey FROM nation AS n WHERE n.n_nationkey >= 5 AND nation.n_nationkey < 9", "select n_name, n_regionkey from nation where n_nationkey >= 5 and n_nationkey < 9"),
    "sql_division": ("SELECT p_partkey, (p_size - 25) / 4, (p_size - 25) % 4, -p_size FROM part", "select p_partkey, (p_size - 25) // 4 as expr1, (p_size - 25) % 4 as expr2, -p_size as expr3 from part"),
    "sql_not_binds_tight": ("SELECT event_id FROM events WHERE NOT (value > 50.0) = true", "select event_id from events where (not (value > 50.0)) = true"),
    "sql_chained": ("SELECT r_name FROM region WHERE 1 = 1 = true", "select r_name from region"),
    "sql_join": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 100000"),
    "sql_join_reversed": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON c_custkey = o_custkey", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey"),
    "sql_theta_self": ("SELECT a.n_name, b.n_nationkey FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey", "select a.n_name, b.n_nationkey from nation a join nation b on a.n_nationkey > b.n_nationkey"),
    "sql_cross": ("SELECT r_name, n_name FROM region JOIN nation", "select r_name, n_name from region cross join nation"),
    "sql_join3": ("SELECT r_name, COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "select r_name, count(*) as expr1 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name"),
    "sql_aggregates": ("SELECT p_brand, COUNT(*), COUNT(p_size), SUM(p_size), MIN(p_size), MAX(p_name), AVG(p_size), SUM(p_size) + 1 FROM part GROUP BY p_brand", "select p_brand, count(*) as expr1, count(p_size) as expr2, cast(sum(p_size) as bigint) as expr3, min(p_size) as expr4, max(p_name) as expr5, cast(sum(p_size) as bigint) // count(p_size) as expr6, cast(sum(p_size) as bigint) + 1 as expr7 from part group by p_brand"),
    "sql_group_expr": ("SELECT p_size % 7, COUNT(*) FROM part GROUP BY p_size % 7", "select p_size % 7 as expr0, count(*) as expr1 from part group by p_size % 7"),
    "sql_having": ("SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND SUM(o_orderkey) > 100", "select o_custkey, count(*) as expr1 from orders group by o_custkey having count(*) > 15 and sum(o_orderkey) > 100"),
    "sql_order_limit": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10 offset 5"),
    "sql_offset_only": ("SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 20", "select n_name from nation order by n_nationkey offset 20"),
    "sql_no_from": ("SELECT 1, 'a', true, 7 / 0", "select 1 as expr0, 'a' as expr1, true as expr2, cast(null as int) as expr3"),
    "sql_values": ("VALUES (1, 'x'), (2, 'y')", "select * from (values (1, 'x'), (2, 'y')) as v(val0, val1)"),
}
for _name, (_text, _oracle) in STATEMENTS.items():
    _register(partial(_sql, _text), _name, _oracle)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark, sf_dir) as e:
        e.execute("PREPARE big AS SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > ? AND o_orderstatus = ? ORDER BY o_orderkey LIMIT ?")
        r = e.execute("EXECUTE big(40 + 60, 'F', 20)")
    return R.values(spark, r.rows, "o_orderkey long, o_custkey long")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, insert, update (swapping two columns) and delete, then read."""
    with _engine(spark, sf_dir) as e:
        e.execute("CREATE TABLE t (k INTEGER, a INTEGER, b INTEGER)")
        e.insert_from("t", e.query("SELECT n_nationkey, n_regionkey, n_nationkey * 10 FROM nation"))
        e.execute("INSERT INTO t VALUES (100, 1, NULL), (101, NULL, 2)")
        e.execute("UPDATE t SET a = b, b = a WHERE k > 10 AND b < 5000")
        e.execute("DELETE FROM t WHERE k % 4 = 1")
        rows = e.execute("SELECT k, a, b FROM t").rows
    return R.values(spark, rows, "k int, a int, b int")


def _explained(analyze: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole text of EXPLAIN, whose last sections Spark words."""
    with _engine(spark, sf_dir) as e:
        text = e.execute(f"EXPLAIN {analyze}SELECT c_mktsegment, COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment").message
    return R.values(spark, [(i, line) for i, line in enumerate(text.splitlines())], "line int, plan string")


_register(_prepared, "prepared", "select o_orderkey, o_custkey from orders where o_orderkey > 100 and o_orderstatus = 'F' order by o_orderkey limit 20")
_register(
    _changes,
    "dml_round_trip",
    """with t as (select n_nationkey as k, n_regionkey as a, n_nationkey * 10 as b from nation union all values (100, 1, null), (101, null, 2))
    select k, case when k > 10 and coalesce(b < 5000, false) then b else a end as a, case when k > 10 and coalesce(b < 5000, false) then a else b end as b from t where k % 4 <> 1""",
)
_register(partial(_explained, ""), "explain", None)
_register(partial(_explained, "ANALYZE "), "explain_analyze", None)


# what stands in no table: order, plans, estimates, transactions


def _numbered(df: DataFrame) -> DataFrame:
    """The rows of a short result with their places in it."""
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(df.collect())], f"place long, {', '.join(f'{c} {t}' for c, t in df.dtypes)}")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = R.seq_scan(spark, f"{sf_dir}/nation.parquet")
    return _numbered(R.project(R.order_by(nation, [(K("n_regionkey"), False), (K("n_name"), True)]), C("n_regionkey", "n_name")))


def _ordered_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = R.project(R.seq_scan(spark, f"{sf_dir}/nation.parquet"), {"k": F.nullif(int_modulo(K("n_nationkey"), F.lit(4)), F.lit(0)), "n_name": K("n_name")})
    return _numbered(R.order_by(nation, [(K("k"), True), (K("n_name"), False)]))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = R.seq_scan(spark, f"{sf_dir}/orders.parquet")
    return _numbered(R.project(R.top_k(orders, [(K("o_totalprice"), False), (K("o_orderkey"), True)], 20, 3), C("o_orderkey")))


def _sql_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    with _engine(spark, sf_dir) as e:
        return _numbered(e.query("SELECT n_name FROM nation ORDER BY n_regionkey DESC, n_name OFFSET 6"))


def _explain_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statement's own operators."""
    with _engine(spark, sf_dir) as e:
        text = e.execute("EXPLAIN SELECT n_name, COUNT(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey > r_regionkey WHERE c_custkey < 99 GROUP BY n_name ORDER BY n_name LIMIT 3").message
    lines = text.split("=== OPTIMIZED")[0].splitlines()[1:-1]
    return R.values(spark, [(i, len(x) - len(x.lstrip(" ├└│─")), x.lstrip(" ├└│─")) for i, x in enumerate(lines)], "line int, depth int, node string")


def _selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table_statistics(R.seq_scan(spark, f"{sf_dir}/part.parquet", ["p_size"]))
    asked = ["p_size = 7", "p_size != 7", "p_size < 26", "26 < p_size", "p_size >= 13 AND p_size < 26", "NOT (p_size = 7)", "p_size = 1 OR p_size = 2"]
    return R.values(spark, [(x, round(selectivity(parse_expression(x), stats), 9)) for x in asked], "predicate string, share double")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the rows there are: the joins of two tables, and what a sort and a top-k of one take."""
    m = CostModel()
    nation, region = (m.seq_scan(table_statistics(R.seq_scan(spark, f"{sf_dir}/{t}.parquet"))) for t in ("nation", "region"))
    rows = [("hash", m.hash_join(nation, region).cost), ("loop", m.nested_loop_join(nation, region).cost), ("filter", m.filter(nation).cost), ("sort", m.sort(nation).cost), ("top 8", m.top_k(nation, 8).cost), ("index", m.index_scan().cost)]
    return R.values(spark, [(n, round(float(c), 6)) for n, c in rows], "operator string, cost double")


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "VALUES ('a;b'); -- c;\nVALUES (1);;\n/* ; */ SELECT 2"
    return R.values(spark, [(i, s.strip()) for i, s in enumerate(split_statements(script))], "i int, statement string")


def _key_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key refused, keys removed one by one and by range, and the rest from a key down."""
    with _engine(spark, sf_dir) as e:
        e.execute("CREATE TABLE t (k INTEGER, name VARCHAR)")
        e.insert_from("t", e.query("SELECT n_nationkey, n_name FROM nation"))
        index = KeyIndex(e, "t")
        index.insert((100, "new"))
        try:
            index.insert((5, "again"))
        except EngineError:
            index.insert((101, "refused"))
        index.remove(7)
        index.remove_between(12, 20)
        return _numbered(R.values(spark, [tuple(r) for r in index.scan(low=3, descending=True).collect()], "k int, name string"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an older transaction, a changing one and others see, before and after its commit."""
    with _engine(spark, sf_dir) as e:
        e.execute("CREATE TABLE t (k INTEGER, v INTEGER)")
        e.insert_from("t", e.query("SELECT n_nationkey, n_regionkey FROM nation"))
        count = lambda txn=None: e.execute("SELECT COUNT(*), SUM(v) FROM t", txn).rows[0]
        old, new = e.begin(), e.begin()
        e.execute("DELETE FROM t WHERE k < 10", new)
        e.execute("UPDATE t SET v = v + 100 WHERE k >= 20", new)
        seen = [("old before", *count(old)), ("own", *count(new)), ("others before", *count())]
        e.commit(new)
        seen += [("old after", *count(old)), ("others after", *count())]
    return R.values(spark, seen, "who string, n long, s long")


_register(_ordered, "ordered", "select row_number() over (order by n_regionkey desc, n_name) - 1 as place, n_regionkey, n_name from nation")
_register(
    _ordered_nulls,
    "ordered_nulls",
    "with t as (select nullif(n_nationkey % 4, 0) as k, n_name from nation) select row_number() over (order by k nulls first, n_name desc) - 1 as place, k, n_name from t",
)
_register(_best, "best", "select row_number() over (order by o_totalprice desc, o_orderkey) - 4 as place, o_orderkey from orders qualify place between 0 and 19")
_register(_sql_ordered, "sql_ordered", "select row_number() over (order by n_regionkey desc, n_name) - 7 as place, n_name from nation qualify place >= 0")
_register(
    _explain_joins,
    "explain_joins",
    """select cast(line as int) as line, cast(depth as int) as depth, node from (values
    (0, 4, 'PROJECTION (n_name, expr1)'), (1, 8, 'TOP_K (3 offset 0)'), (2, 12, 'AGGREGATION (n_name, COUNT(*))'), (3, 16, 'FILTER ((c_custkey < 99))'),
    (4, 20, 'NESTED_LOOP_JOIN (on: (n_regionkey > r_regionkey))'), (5, 24, 'HASH_JOIN (on: (c_nationkey = n_nationkey))'),
    (6, 28, 'SEQ_SCAN (table: customer)'), (7, 28, 'SEQ_SCAN (table: nation)'), (8, 24, 'SEQ_SCAN (table: region)')) as v(line, depth, node)""",
)
_register(
    _selectivity,
    "selectivity",
    """with s as (select count(distinct p_size)::double as d, min(p_size)::double as lo, max(p_size)::double as hi from part)
    select unnest(['p_size = 7', 'p_size != 7', 'p_size < 26', '26 < p_size', 'p_size >= 13 AND p_size < 26', 'NOT (p_size = 7)', 'p_size = 1 OR p_size = 2']) as predicate,
    unnest([round(1 / d, 9), round(1 - 1 / d, 9), round((26 - lo) / (hi - lo), 9), round(1 - (26 - lo) / (hi - lo), 9), round((1 - (13 - lo) / (hi - lo)) * ((26 - lo) / (hi - lo)), 9), round(1 - 1 / d, 9), round(1 / d + 1 / d - 1 / d * (1 / d), 9)]) as share from s""",
)
_register(
    _costs,
    "costs",
    """with t as (select (select count(*) from nation)::double as n, (select count(*) from region)::double as r)
    select unnest(['hash', 'loop', 'filter', 'sort', 'top 8', 'index']) as operator,
    unnest([round(2 * (n + r), 6), round(n + r + n * r, 6), round(2 * n, 6), round(n + n * log2(n), 6), round(n + n * 3, 6), 100.0::double]) as cost from t""",
)
_register(_statements, "statements", "select cast(i as int) as i, statement from (values (0, 'VALUES (''a;b'');'), (1, '-- c;' || chr(10) || 'VALUES (1);'), (2, '/* ; */ SELECT 2')) as v(i, statement)")
_register(
    _key_index,
    "key_index",
    """with t as (select n_nationkey as k, n_name as name from nation where n_nationkey <> 7 and n_nationkey not between 12 and 20 union all values (100, 'new'), (101, 'refused'))
    select row_number() over (order by k desc) - 1 as place, cast(k as int) as k, name from t where k >= 3""",
)
_register(
    _snapshots,
    "snapshots",
    """with a as (select count(*) as n, cast(sum(n_regionkey) as bigint) as s from nation),
    b as (select count(*) as n, cast(sum(n_regionkey + case when n_nationkey >= 20 then 100 else 0 end) as bigint) as s from nation where n_nationkey >= 10)
    select 'old before' as who, n, s from a union all select 'own', n, s from b union all select 'others before', n, s from a union all select 'old after', n, s from a union all select 'others after', n, s from b""",
)
