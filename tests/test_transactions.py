import pytest

from tessera.errors import CatalogError, TransactionError


def read(engine, txn=None, text="SELECT k, v FROM t ORDER BY k, v"):
    return engine.execute(text, txn).rows


@pytest.fixture
def db(engine):
    engine.execute("CREATE TABLE t (k INTEGER, v INTEGER)")
    engine.execute("INSERT INTO t VALUES (1, 10), (2, 20)")
    return engine


def test_round_trip(db):
    assert db.execute("INSERT INTO t VALUES (3, 30), (4, NULL)").rows == [(2,)]
    assert db.execute("UPDATE t SET v = 15 WHERE k = 1").rows == [(1,)]
    assert db.execute("DELETE FROM t WHERE k = 2").rows == [(1,)]
    assert read(db) == [(1, 15), (3, 30), (4, None)]
    assert db.execute("DELETE FROM t").rows == [(3,)] and read(db) == []
    assert db.execute("UPDATE t SET v = 1").rows == [(0,)]


def test_update_reads_the_old_row(db):
    assert db.execute("UPDATE t SET k = v, v = k, v = 99").rows == [(2,)]
    assert read(db) == [(10, 1), (20, 2)]


def test_null_predicate_leaves_a_row(db):
    db.execute("INSERT INTO t VALUES (3, NULL)")
    assert db.execute("DELETE FROM t WHERE v > 5").rows == [(2,)]
    assert read(db) == [(3, None)]


def test_only_touched_files_are_rewritten(db):
    db.execute("INSERT INTO t VALUES (7, 70)")
    before = db.catalog.manifest()["tables"]["t"]["segments"]
    db.execute("UPDATE t SET v = 71 WHERE k = 7")
    after = db.catalog.manifest()["tables"]["t"]["segments"]
    assert before[0] == after[0] and len(after) == 2 and read(db)[-1] == (7, 71)


def test_own_writes_and_isolation(db):
    a, b = db.begin(), db.begin()
    db.execute("INSERT INTO t VALUES (3, 30)", a)
    db.execute("UPDATE t SET v = 11 WHERE k = 1", a)
    assert read(db, a) == [(1, 11), (2, 20), (3, 30)]
    assert read(db, b) == read(db) == [(1, 10), (2, 20)]
    db.commit(a)
    assert read(db) == [(1, 11), (2, 20), (3, 30)]
    assert read(db, b) == [(1, 10), (2, 20)]  # its snapshot
    db.commit(b)
    assert read(db, db.begin()) == [(1, 11), (2, 20), (3, 30)]


def test_old_snapshot_sees_deleted_rows(db):
    a = db.begin()
    db.execute("DELETE FROM t WHERE k = 1")
    assert read(db, a) == [(1, 10), (2, 20)] and read(db) == [(2, 20)]


def test_abort(db):
    a = db.begin()
    db.execute("INSERT INTO t VALUES (3, 30)", a)
    db.execute("UPDATE t SET v = 0", a)
    db.execute("DELETE FROM t WHERE k = 2", a)
    assert read(db, a) == [(1, 0), (3, 0)]
    db.abort(a)
    assert read(db) == [(1, 10), (2, 20)]
    with pytest.raises(TransactionError):
        db.execute("DELETE FROM t", a)


def test_rows_of_another_open_transaction_are_skipped(db):
    a = db.begin()
    assert db.execute("UPDATE t SET v = 11 WHERE k = 1", a).rows == [(1,)]
    assert db.execute("UPDATE t SET v = v + 5").rows == [(1,)]
    assert db.execute("DELETE FROM t WHERE k = 1").rows == [(0,)]
    db.commit(a)
    assert read(db) == [(1, 11), (2, 25)]


def test_last_writer_wins(db):
    a = db.begin()
    db.execute("UPDATE t SET v = 12 WHERE k = 1")
    assert db.execute("UPDATE t SET v = 13 WHERE k = 1", a).rows == [(1,)]
    db.commit(a)
    assert read(db) == [(1, 13), (2, 20)]


def test_durable(db, spark):
    from tessera.engine import Engine

    again = Engine(spark, db.catalog.root)
    assert read(again) == [(1, 10), (2, 20)] and again.catalog.list_tables() == ["t"]


def test_failed_statement_changes_nothing(db):
    assert not db.try_execute("UPDATE t SET v = v / (k - 1)").success
    assert read(db) == [(1, 10), (2, 20)] and not db.transactions.active


def test_catalog(db, spark):
    with pytest.raises(CatalogError):
        db.catalog.create_table("t", [("a", "INTEGER")])
    info = db.catalog.create_table("u", [("a", "FLOAT"), ("b", "VARCHAR")])
    assert info.columns == (("a", "double"), ("b", "string")) and info.id == 2
    assert db.catalog.list_tables() == ["t", "u"]
    db.execute("DROP TABLE u")
    with pytest.raises(CatalogError):
        db.catalog.get_table("u")
    db.register_parquet("nation", "/root/testdata/sf0.001/nation.parquet")
    assert db.execute("SELECT COUNT(*) FROM nation").rows == [(25,)]
    assert "read-only" in db.try_execute("DELETE FROM nation").error


def test_stream(db, spark, tmp_path):
    from tessera.streaming import append_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(5, 50), (6, 60)], "k int, v int").write.parquet(src)
    q = append_stream(db, spark.readStream.schema("k int, v int").parquet(src), "t", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert read(db) == [(1, 10), (2, 20), (5, 50), (6, 60)]


def test_key_index(db):
    from tessera.errors import EngineError
    from tessera.sources import KeyIndex

    index = KeyIndex(db, "t")
    assert not index.is_empty() and tuple(index.get(2)) == (2, 20) and index.get(9) is None
    index.insert((5, 50))
    with pytest.raises(EngineError, match="Duplicate key: 5"):
        index.insert((5, 51))
    assert [r.k for r in index.scan().collect()] == [1, 2, 5] and [r.k for r in index.scan(2, 4).collect()] == [2] and [r.k for r in index.scan(high=1).collect()] == [1]
    assert index.remove(1) and not index.remove(1) and [r.k for r in index.scan(0).collect()] == [2, 5]
    a = db.begin()
    KeyIndex(db, "t", a).remove(2)
    assert KeyIndex(db, "t", a).get(2) is None and index.get(2) is not None
    db.abort(a)


def test_two_engines_on_one_folder(db, spark):
    from tessera.engine import Engine
    from tessera.errors import EngineError
    from tessera.sources import KeyIndex

    other = Engine(spark, f"file://{db.catalog.root}")
    a, b = db.begin(), other.begin()
    db.execute("INSERT INTO t VALUES (3, 30)", a)
    other.execute("UPDATE t SET v = 21 WHERE k = 2", b)
    KeyIndex(other, "t", b).insert((4, 40))
    db.commit(a)
    other.commit(b)
    assert read(db) == read(other) == [(1, 10), (2, 21), (3, 30), (4, 40)]
    a, b = db.begin(), other.begin()
    KeyIndex(db, "t", a).insert((9, 1))
    KeyIndex(other, "t", b).insert((9, 2))
    other.commit(b)
    with pytest.raises(EngineError, match="Duplicate key: 9"):
        db.commit(a)
    assert a.state == "aborted" and read(db)[-1] == (9, 2)


def test_a_number_is_given_once(db):
    m = db.catalog.manifest()
    assert not db.catalog._publish(m) and db.catalog.manifest() == m


def test_vacuum(db):
    a = db.begin()
    db.execute("DELETE FROM t WHERE k = 1", a)
    db.abort(a)
    db.execute("UPDATE t SET v = 0 WHERE k = 2")
    assert db.catalog.vacuum() >= 2 and db.catalog.vacuum() == 0
    assert read(db) == [(1, 10), (2, 0)]


def test_key_ranges(db):
    from tessera.sources import KeyIndex

    index = KeyIndex(db, "t")
    for k in (5, 7, 9):
        index.insert((k, k))
    assert [r.k for r in index.scan(2, 8, descending=True).collect()] == [7, 5, 2]
    assert index.remove_between(2, 5) == 2 and index.remove_between(8) == 1 and index.remove_between(100) == 0
    a = db.begin()
    own = KeyIndex(db, "t", a)
    assert own.remove(7)
    own.insert((7, 70))
    db.commit(a)
    assert read(db) == [(1, 10), (7, 70)]
