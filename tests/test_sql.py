import pytest

from tessera.errors import BindError, EngineError, ParseError
from tessera.sql import parse, parse_expression, tokenize


def kinds(text):
    return [t.kind for t in tokenize(text)]


def test_lexer_words_and_signs():
    assert kinds("") == ["end of input"]
    assert kinds("SeLeCt FROM t WHERE id = 1;") == ["SELECT", "FROM", "identifier", "WHERE", "identifier", "=", "integer", ";", "end of input"]
    assert kinds("+ - * / % = != < <= > >= ( ) ; . , ?")[:-1] == "+ - * / % = != < <= > >= ( ) ; . , ?".split()
    assert [t.text for t in tokenize("TRUE false NuLl")][:-1] == ["TRUE", "false", "NuLl"] and kinds("TRUE false NuLl")[:-1] == ["boolean", "boolean", "null"]


def test_lexer_strings_comments_positions():
    assert [t.text for t in tokenize("'hello world' 'hello ''world'''")][:-1] == ["hello world", "hello 'world'"]
    bad = tokenize("'unfinished")
    assert [t.kind for t in bad] == ["invalid", "end of input"] and bad[0].text == "Unterminated string"
    assert kinds("SELECT -- c\n1 /* a\nb */ FROM") == ["SELECT", "integer", "FROM", "end of input"]
    assert [(t.line, t.column) for t in tokenize("SELECT\n  id\nFROM")][:3] == [(1, 1), (2, 3), (3, 1)]
    t = tokenize("SELECT @;")[1]
    assert (t.kind, t.line, t.column) == ("invalid", 1, 8)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT b.boat, sails * 2 FROM boats AS b", "SELECT b.boat, (sails * 2) FROM boats AS b"),
        ("select boat from boats where sails != 0 or not sunk order by sails desc, boat asc limit 3", "SELECT boat FROM boats WHERE ((sails != 0) OR (NOT sunk)) ORDER BY sails DESC, boat ASC LIMIT 3"),
        ("SELECT boat FROM boats OFFSET 4", None),
        ("SELECT MIN(sails), Max(sails), avg(sails), COUNT(boat) FROM boats GROUP BY port, sails % 2", "SELECT MIN(sails), MAX(sails), AVG(sails), COUNT(boat) FROM boats GROUP BY port, (sails % 2)"),
        ("SELECT * FROM boats b JOIN ports ON b.port = ports.port JOIN crews HAVING SUM(sails) < 9", "SELECT * FROM boats AS b JOIN ports ON (b.port = ports.port) JOIN crews HAVING (SUM(sails) < 9)"),
        ("INSERT boats VALUES (NULL, 'it''s')", "INSERT INTO boats VALUES (NULL, 'it''s')"),
        ("update boats set sails = sails - 1, sunk = true", "UPDATE boats SET sails = (sails - 1), sunk = TRUE"),
        ("DELETE boats", "DELETE FROM boats"),
        ("VALUES (1.5, -2), (NULL, false);", "VALUES (1.5, (-2)), (NULL, FALSE)"),
        ("EXPLAIN DELETE FROM boats", None),
        ("PREPARE refit AS UPDATE boats SET sails = ? WHERE (boat = ?)", None),
        ("EXECUTE refit(3 + 1, 'Ida')", "EXECUTE refit((3 + 1), 'Ida')"),
        ("deallocate prepare refit", "DEALLOCATE refit"),
    ],
)
def test_statements_give_their_text_back(text, expected):
    assert str(parse(text)) == (expected or text)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("7 - 2 - 1", "((7 - 2) - 1)"),
        ("a % 2 + b / 4 * c", "((a % 2) + ((b / 4) * c))"),
        ("- - x * y", "((-(-x)) * y)"),
        ("+x - -3 < 2 * y", "(((+x) - (-3)) < (2 * y))"),
        ("p OR q AND r OR s", "((p OR (q AND r)) OR s)"),
        ("a < b < c", "((a < b) < c)"),
        ("a <= 1 AND (b >= 2 OR NOT c != 3)", "((a <= 1) AND ((b >= 2) OR ((NOT c) != 3)))"),
    ],
)
def test_precedence(text, expected):
    assert str(parse_expression(text)) == expected


@pytest.mark.parametrize("text", ["SELECT FROM", "SELECT 1 2 3", "SELECT 1; SELECT 2", "SELECT a FROM t WHERE", "SELECT f(x) FROM t", "SELECT 'open", "SELECT @", "FROM t", "INSERT INTO t VALUES ()"])
def test_parse_errors(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.fixture
def users(engine):
    engine.execute("CREATE TABLE users (id INTEGER, name VARCHAR, active BOOLEAN)")
    engine.execute("INSERT INTO users VALUES (1, 'Alice', true), (2, 'Bob', false), (3, NULL, NULL)")
    engine.execute("CREATE TABLE pay (id INTEGER, Id INTEGER, amount INTEGER)")
    engine.execute("INSERT INTO pay VALUES (1, 7, 100), (1, 8, -7), (3, 9, 50)")
    return engine


def run(engine, text):
    return engine.execute(text).rows


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT * FROM users WHERE id < 3", [(1, "Alice", True), (2, "Bob", False)]),
        ("SELECT u.id, users.name FROM users AS u WHERE active", [(1, "Alice")]),
        ("SELECT Id FROM pay WHERE amount = 50", [(9,)]),
        ("SELECT users.id, amount FROM users JOIN pay ON users.id = pay.id WHERE amount > 0", [(1, 100), (3, 50)]),
        ("SELECT amount / 2, amount % 4 FROM pay WHERE amount < 0", [(-3, -3)]),
        ("SELECT COUNT(*), COUNT(name), SUM(id) + 1, AVG(id), MIN(name), MAX(active) FROM users", [(3, 2, 7, 2, "Alice", True)]),
        ("SELECT pay.id, SUM(amount), SUM(Id) FROM pay GROUP BY id HAVING SUM(amount) > 50", [(1, 93, 15)]),
        ("SELECT id + 1 FROM pay GROUP BY id + 1", [(2,), (4,)]),
        ("SELECT COUNT(*) FROM users WHERE id > 99", [(0,)]),
        ("SELECT SUM(id), AVG(id), MIN(id) FROM users WHERE id > 99", [(None, None, None)]),
        ("SELECT name FROM users ORDER BY id DESC LIMIT 1 OFFSET 1", [("Bob",)]),
        ("SELECT id FROM users WHERE active = NULL", []),
        ("SELECT id FROM users WHERE NOT active", [(2,)]),
        ("SELECT id FROM users WHERE active OR true", [(1,), (2,), (3,)]),
        ("SELECT id FROM users WHERE 1 / 0 = 1", []),
        ("SELECT id FROM users WHERE false", []),
        ("SELECT 1 + 2, 'x', NULL", [(3, "x", None)]),
        ("SELECT 1 / 0, 1 % 0, 7 / 2", [(None, None, 3)]),
        ("SELECT 1.5 + 1", None),
        ("SELECT 3000000000", [(3000000000,)]),
        ("VALUES (1, 'a'), (NULL, 'b')", [(1, "a"), (None, "b")]),
        ("SELECT a.id, b.id FROM users a JOIN users b ON a.id > b.id", [(2, 1), (3, 1), (3, 2)]),
    ],
)
def test_queries(users, text, expected):
    found = run(users, text)
    assert expected is None or sorted(found, key=str) == sorted(expected, key=str)


def test_output_names(users):
    assert [n for n, _ in users.execute("SELECT id, id + 1, 'a', COUNT(*) FROM users GROUP BY id").columns] == ["id", "expr1", "expr2", "expr3"]
    assert [n for n, _ in users.execute("VALUES (1, true)").columns] == ["val0", "val1"]
    assert users.execute("SELECT * FROM users").columns == [("id", "INTEGER"), ("name", "VARCHAR"), ("active", "BOOLEAN")]


@pytest.mark.parametrize(
    "text, message",
    [
        ("SELECT * FROM foo", "Unknown table: foo"),
        ("SELECT foo FROM users", "Unknown column: foo"),
        ("SELECT ID FROM users", "Unknown column: ID"),
        ("SELECT x.id FROM users", "Unknown table or alias: x"),
        ("SELECT id FROM users JOIN pay ON users.id = pay.id", "Ambiguous column: id"),
        ("SELECT users.id FROM users JOIN users ON true", "Ambiguous column: id"),
        ("SELECT * FROM users WHERE id", "boolean"),
        ("SELECT * FROM users WHERE id = '1'", "Type mismatch"),
        ("SELECT id + name FROM users", "Type mismatch"),
        ("SELECT 1 AND 2", "booleans"),
        ("SELECT NOT 1", "boolean"),
        ("SELECT -name FROM users", "number"),
        ("SELECT name + name FROM users", "numbers"),
        ("SELECT name, COUNT(*) FROM users GROUP BY id", "GROUP BY"),
        ("SELECT id FROM users WHERE COUNT(*) > 1", "Aggregate not allowed"),
        ("SELECT SUM(COUNT(*)) FROM users", "nested"),
        ("SELECT id FROM users LIMIT -1", "LIMIT"),
        ("SELECT id FROM users LIMIT NULL", "LIMIT"),
        ("INSERT INTO users VALUES (true, 'a', false)", "Type mismatch"),
        ("INSERT INTO users VALUES (1, 'a')", "needs 3 values"),
        ("UPDATE users SET foo = 1", "Unknown column in SET clause: foo"),
        ("UPDATE users SET id = 'x'", "Type mismatch"),
        ("DELETE FROM users WHERE id", "boolean"),
        ("EXECUTE nothing", "Prepared statement not found: nothing"),
    ],
)
def test_bind_errors(users, text, message):
    with pytest.raises(BindError, match=message):
        users.execute(text)


def test_division_by_zero_of_a_column_fails(users):
    assert not users.try_execute("SELECT id / (id - id) FROM users").success


def test_prepared(users):
    users.execute("PREPARE p AS SELECT id, COUNT(*) FROM pay WHERE amount > ? GROUP BY id HAVING SUM(amount) > ? ORDER BY id LIMIT ?")
    assert users.prepared["p"].kinds == ["int", "int", "int"]
    assert run(users, "EXECUTE p(0, 10 * 5, 5)") == [(1, 1)]
    assert run(users, "EXECUTE p(-100, 49, 5)") == [(1, 2), (3, 1)]
    with pytest.raises(BindError, match="Parameter count mismatch for p"):
        users.execute("EXECUTE p(1)")
    with pytest.raises(BindError, match="Type mismatch for parameter"):
        users.execute("EXECUTE p('a', 1, 1)")
    users.execute("PREPARE ins AS INSERT INTO users VALUES (?, ?, ?)")
    assert run(users, "EXECUTE ins(9, 'Zoe', NULL)") == [(1,)]
    users.execute("PREPARE upd AS UPDATE users SET name = ? WHERE id = ?")
    assert run(users, "EXECUTE upd('Eve', 9)") == [(1,)] and run(users, "SELECT name FROM users WHERE id = 9") == [("Eve",)]
    users.execute("DEALLOCATE p")
    users.execute("DEALLOCATE p")
    with pytest.raises(EngineError):
        users.execute("EXECUTE p(1, 2, 3)")


def test_explain(users):
    r = users.execute("EXPLAIN SELECT id, name FROM users WHERE id > 1;")
    for head in ("=== LOGICAL PLAN ===", "=== OPTIMIZED LOGICAL PLAN ===", "=== PHYSICAL PLAN ===", "=== OUTPUT SCHEMA ===\nSchema(id, name)", "=== OPTIMIZER RULES APPLIED ==="):
        assert head in r.message
    assert "SEQ_SCAN (table: users)" in r.message and "└── PROJECTION" in r.message and "rows_in=" not in r.message
    assert "TOP_K" in users.execute("EXPLAIN SELECT id FROM users ORDER BY id LIMIT 1").message
    assert "rows_out=2" in users.execute("EXPLAIN ANALYZE SELECT id FROM users WHERE id > 1").message


def logical(engine, text):
    return engine.execute(f"EXPLAIN {text}").message.split("=== OPTIMIZED")[0].splitlines()[1:-1]


def test_explained_joins(users):
    assert logical(users, "SELECT amount FROM users JOIN pay ON active AND pay.id = users.id WHERE amount > 1") == [
        "└── PROJECTION (amount)",
        "    └── FILTER ((amount > 1))",
        "        └── HASH_JOIN (on: (active AND (pay.id = users.id)))",
        "            ├── SEQ_SCAN (table: users)",
        "            └── SEQ_SCAN (table: pay)",
    ]
    for on in ("users.id = 5 AND amount > users.id", "users.id = 1 OR users.id = pay.id", "amount = 50", "users.id < pay.id"):
        assert "NESTED_LOOP_JOIN" in logical(users, f"SELECT amount FROM users JOIN pay ON {on}")[1], on
    assert "NESTED_LOOP_JOIN" in logical(users, "SELECT amount FROM users JOIN pay")[1]


def test_explained_figures(users):
    text = users.execute("EXPLAIN ANALYZE SELECT COUNT(*) FROM users JOIN pay ON users.id = pay.id").message.split("=== PHYSICAL PLAN ===")[1].split("=== OUTPUT")[0]
    lines = [x for x in text.splitlines() if x.strip()]
    assert all("rows_in=" in x and "rows_out=" in x for x in lines)
    times = [int(x.rsplit("time=", 1)[1].removesuffix("us)")) for x in lines]
    assert times[0] == max(times)
    assert any("Join" in x and "rows_out=3" in x for x in lines)


def test_explained_changes(users):
    plain = users.execute("EXPLAIN UPDATE users SET name = 'x' WHERE id > 1").message
    sections = plain.split("===")
    assert len({sections[2], sections[4], sections[6]}) == 3 and all("UPDATE (table: users)" in x for x in (sections[2], sections[4], sections[6])) and "rows_out" not in plain
    assert len(run(users, "SELECT * FROM users WHERE name = 'x'")) == 0 and not users.transactions.active
    done = users.execute("EXPLAIN ANALYZE DELETE FROM users WHERE id > 1").message
    assert "DELETE (table: users) (rows_in=2, rows_out=2" in done and run(users, "SELECT id FROM users") == [(1,)]
    assert "INSERT (table: users) (rows_in=1, rows_out=1" in users.execute("EXPLAIN ANALYZE INSERT INTO users VALUES (7, 'g', NULL)").message


@pytest.mark.parametrize("offset", [0, 1, 7, 39, 40, 99])
def test_offset_keeps_the_order(engine, spark, offset):
    engine.catalog.register("numbers", spark.range(0, 40, 1, 6).selectExpr("(id * 7) % 40 as n"))
    assert [r[0] for r in engine.query(f"SELECT n FROM numbers ORDER BY n DESC OFFSET {offset}").collect()] == list(range(39 - offset, -1, -1))
