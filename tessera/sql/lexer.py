"""Text to tokens, by one regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The dialect's reserved words.
KEYWORDS = frozenset(
    """SELECT FROM WHERE INSERT INTO VALUES UPDATE SET DELETE JOIN INNER ON GROUP BY HAVING ORDER ASC DESC LIMIT OFFSET
    AS AND OR NOT EXPLAIN ANALYZE PREPARE EXECUTE DEALLOCATE CREATE DROP TABLE""".split()
)

IDENT, INTEGER, DECIMAL, STRING, BOOL, NULL, INVALID, EOF = "identifier", "integer", "decimal", "string", "boolean", "null", "invalid", "end of input"

_SHAPES = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<decimal>\d+\.\d+)
      | (?P<integer>\d+)
      | (?P<string>'(?:[^']|'')*')
      | (?P<open>'.*|/\*.*)
      | (?P<sign>!=|<=|>=|[-+*/%=<>(),;.?])
      | (?P<other>.)""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    """``kind`` is the upper-case word of a keyword, the sign itself, or one of the names above."""

    kind: str
    text: str
    line: int
    column: int


def tokenize(source: str) -> list[Token]:
    """All tokens and an EOF. What can't be read becomes an INVALID token whose text says why."""
    tokens, line, bol = [], 1, 0
    for m in _SHAPES.finditer(source):
        shape, text = m.lastgroup, m.group()
        column = m.start() - bol + 1
        if shape == "word":
            upper = text.upper()
            kind = upper if upper in KEYWORDS else BOOL if upper in ("TRUE", "FALSE") else NULL if upper == "NULL" else IDENT
            tokens.append(Token(kind, text, line, column))
        elif shape == "string":
            tokens.append(Token(STRING, text[1:-1].replace("''", "'"), line, column))
        elif shape == "open":
            tokens.append(Token(INVALID, "Unterminated string" if text[0] == "'" else "Unterminated comment", line, column))
        elif shape == "other":
            tokens.append(Token(INVALID, f"Unexpected character: {text}", line, column))
        elif shape != "skip":
            tokens.append(Token({"decimal": DECIMAL, "integer": INTEGER}.get(shape, text), text, line, column))
        if breaks := text.count("\n"):
            line, bol = line + breaks, m.start() + text.rindex("\n") + 1
    return [*tokens, Token(EOF, "", line, len(source) - bol + 1)]
