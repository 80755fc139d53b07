"""Errors that the engine raises itself; Spark's own analysis errors pass through."""


class EngineError(Exception):
    """Base of all."""


class ParseError(EngineError):
    """The statement text isn't of the dialect, or goes on after its end."""


class SchemaError(EngineError):
    """A table or column is missing, or exists already."""


class ConstraintError(EngineError):
    """A row breaks NOT NULL, UNIQUE, PRIMARY KEY or CHECK."""


class TransactionError(EngineError):
    """BEGIN, COMMIT, ROLLBACK or RELEASE without its counterpart."""


class NoRowError(EngineError):
    """A query for one row found none."""
