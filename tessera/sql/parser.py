"""Tokens to syntax trees: statements by rule, expressions by operator precedence."""

from __future__ import annotations

from decimal import Decimal

from tessera.errors import ParseError
from tessera.sql import nodes as N
from tessera.sql.lexer import BOOL, DECIMAL, EOF, IDENT, INTEGER, INVALID, NULL, STRING, Token, tokenize

#: Binding strength of the binary operators, all left-associative. Prefix operators, NOT too, bind tighter than any.
STRENGTH = {"OR": 1, "AND": 2, "=": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")


class Parser:
    def __init__(self, source: str):
        self.tokens, self.at, self.parameters = tokenize(source), 0, 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, expected: str) -> ParseError:
        t = self.now
        what = t.text if t.kind == INVALID else f"Expected {expected}, found {t.text or t.kind}"
        return ParseError(what, t.line, t.column)

    def accept(self, *kinds: str) -> Token | None:
        if self.now.kind in kinds:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def expect(self, kind: str) -> Token:
        found = self.accept(kind)
        if not found:
            raise self.fail(kind)
        return found

    def several(self, rule) -> tuple:
        found = [rule()]
        while self.accept(","):
            found.append(rule())
        return tuple(found)

    def end(self) -> None:
        self.accept(";")
        self.expect(EOF)

    # expressions

    def expression(self, least: int = 1) -> N.Expr:
        left = self.prefix()
        while (s := STRENGTH.get(self.now.kind, 0)) >= least:
            op = self.accept(self.now.kind).kind
            left = N.Binary(op, left, self.expression(s + 1))
        return left

    def prefix(self) -> N.Expr:
        if op := self.accept("NOT", "-", "+"):
            return N.Unary(op.kind, self.prefix())
        return self.primary()

    def primary(self) -> N.Expr:
        if t := self.accept(INTEGER):
            return N.Literal(int(t.text))
        if t := self.accept(DECIMAL):
            return N.Literal(Decimal(t.text))
        if t := self.accept(STRING):
            return N.Literal(t.text)
        if t := self.accept(BOOL):
            return N.Literal(t.text.upper() == "TRUE")
        if self.accept(NULL):
            return N.Literal(None)
        if self.accept("?"):
            self.parameters += 1
            return N.Parameter(self.parameters - 1)
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        if t := self.accept(IDENT):
            if self.accept("."):
                return N.Name(self.expect(IDENT).text, t.text)
            if self.now.kind == "(":
                return self.call(t)
            return N.Name(t.text)
        raise self.fail("an expression")

    def call(self, name: Token) -> N.Aggregate:
        f = name.text.upper()
        if f not in AGGREGATES:
            raise ParseError(f"Unknown function: {name.text}", name.line, name.column)
        self.expect("(")
        argument = None if f == "COUNT" and self.accept("*") else self.expression()
        self.expect(")")
        return N.Aggregate(f, argument)

    # statements

    def statement(self) -> N.Statement:
        rules = {
            "SELECT": self.select, "VALUES": self.values, "INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete,
            "EXPLAIN": self.explain, "PREPARE": self.prepare, "EXECUTE": self.execute, "DEALLOCATE": self.deallocate,
            "CREATE": self.create, "DROP": self.drop,
        }
        rule = rules.get(self.now.kind)
        if not rule:
            raise self.fail("a statement")
        return rule()

    def select(self) -> N.Select:
        self.expect("SELECT")
        items = self.several(lambda: N.Star() if self.accept("*") else self.expression())
        source, joins = None, []
        if self.accept("FROM"):
            source = self.table()
            while self.now.kind in ("JOIN", "INNER"):
                self.accept("INNER")
                self.expect("JOIN")
                joins.append(N.Join(self.table(), self.expression() if self.accept("ON") else None))
        return N.Select(
            items,
            source,
            tuple(joins),
            where=self.optional("WHERE"),
            group_by=self.several(self.expression) if self.words("GROUP", "BY") else (),
            having=self.optional("HAVING"),
            order_by=self.several(self.sort_key) if self.words("ORDER", "BY") else (),
            limit=self.optional("LIMIT"),
            offset=self.optional("OFFSET"),
        )

    def words(self, first: str, second: str) -> bool:
        return bool(self.accept(first) and self.expect(second))

    def optional(self, word: str) -> N.Expr | None:
        return self.expression() if self.accept(word) else None

    def table(self) -> N.TableRef:
        name = self.expect(IDENT).text
        alias = self.expect(IDENT) if self.accept("AS") else self.accept(IDENT)
        return N.TableRef(name, alias.text if alias else None)

    def sort_key(self) -> tuple[N.Expr, bool]:
        e = self.expression()
        way = self.accept("ASC", "DESC")
        return e, way is None or way.kind == "ASC"

    def values(self) -> N.Values:
        self.expect("VALUES")
        return N.Values(self.several(self.row))

    def row(self) -> tuple[N.Expr, ...]:
        self.expect("(")
        found = self.several(self.expression)
        self.expect(")")
        return found

    def insert(self) -> N.Insert:
        self.expect("INSERT")
        self.accept("INTO")
        return N.Insert(self.expect(IDENT).text, self.values())

    def update(self) -> N.Update:
        self.expect("UPDATE")
        name = self.expect(IDENT).text
        self.expect("SET")
        return N.Update(name, self.several(self.set_clause), self.optional("WHERE"))

    def set_clause(self) -> tuple[str, N.Expr]:
        column = self.expect(IDENT).text
        self.expect("=")
        return column, self.expression()

    def delete(self) -> N.Delete:
        self.expect("DELETE")
        self.accept("FROM")
        return N.Delete(self.expect(IDENT).text, self.optional("WHERE"))

    def explain(self) -> N.Explain:
        self.expect("EXPLAIN")
        return N.Explain(analyze=bool(self.accept("ANALYZE")), statement=self.statement())

    def prepare(self) -> N.Prepare:
        self.expect("PREPARE")
        name = self.expect(IDENT).text
        self.expect("AS")
        return N.Prepare(name, self.statement())

    def execute(self) -> N.Execute:
        self.expect("EXECUTE")
        name = self.expect(IDENT).text
        return N.Execute(name, self.row() if self.now.kind == "(" else ())

    def deallocate(self) -> N.Deallocate:
        self.expect("DEALLOCATE")
        self.accept("PREPARE")
        return N.Deallocate(self.expect(IDENT).text)

    def create(self) -> N.CreateTable:
        self.expect("CREATE")
        self.expect("TABLE")
        name = self.expect(IDENT).text
        self.expect("(")
        columns = self.several(lambda: (self.expect(IDENT).text, self.expect(IDENT).text.upper()))
        self.expect(")")
        return N.CreateTable(name, columns)

    def drop(self) -> N.DropTable:
        self.expect("DROP")
        self.expect("TABLE")
        return N.DropTable(self.expect(IDENT).text)


def parse(source: str) -> N.Statement:
    """One statement, with or without a semicolon; anything after it is an error."""
    p = Parser(source)
    found = p.statement()
    p.end()
    return found


def parse_expression(source: str) -> N.Expr:
    p = Parser(source)
    found = p.expression()
    p.end()
    return found
