from tessera.sql.binder import Binder
from tessera.sql.lexer import tokenize
from tessera.sql.parser import parse, parse_expression

__all__ = ["Binder", "parse", "parse_expression", "tokenize"]
