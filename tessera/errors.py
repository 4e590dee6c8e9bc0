"""Errors that the engine reports to its users."""


class EngineError(Exception):
    """Anything a statement can fail with."""


class ParseError(EngineError):
    """Bad text; says where."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


class BindError(EngineError):
    """A name or a type that doesn't fit."""


class CatalogError(EngineError):
    """A table that is there already, or isn't."""


class TransactionError(EngineError):
    """A transaction that has ended already."""
