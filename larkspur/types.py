"""Column affinity, storage kinds and truth, mapped to Spark's static types."""

from __future__ import annotations

from pyspark.sql import types as T

#: The first rule whose words occur in the declared type decides.
_RULES = (
    (("INT",), "INTEGER"),
    (("CHAR", "CLOB", "TEXT"), "TEXT"),
    (("BLOB",), "BLOB"),
    (("REAL", "FLOA", "DOUB"), "REAL"),
)
_SPARK = {"INTEGER": T.LongType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(), "REAL": T.DoubleType(), "NUMERIC": T.DoubleType()}


def affinity(declared: str | None) -> str:
    """INTEGER, TEXT, BLOB, REAL or NUMERIC; a column without a type is BLOB."""
    name = (declared or "").strip().upper()
    if not name:
        return "BLOB"
    return next((kind for marks, kind in _RULES if any(m in name for m in marks)), "NUMERIC")


def spark_type(declared: str | None, args: tuple[int, ...] = ()) -> T.DataType:
    """The type of a column declared so; DECIMAL(p, s) keeps its precision, no type means text."""
    kind = affinity(declared)
    if kind == "NUMERIC" and args and (declared or "").strip().upper() in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(args[0], args[1] if len(args) > 1 else 0)
    return T.StringType() if not (declared or "").strip() else _SPARK[kind]


def storage_kind(data_type: T.DataType) -> str:
    """integer, real, text, blob or null: what ``typeof`` says of a non-null value."""
    if isinstance(data_type, (T.IntegralType, T.BooleanType)):
        return "integer"
    if isinstance(data_type, T.FractionalType):
        return "real"
    if isinstance(data_type, T.BinaryType):
        return "blob"
    return "null" if isinstance(data_type, T.NullType) else "text"


def truth(expression: str, data_type: T.DataType) -> str:
    """SQL for the truth of a value: null is false, numbers by being non-zero, text by being non-empty."""
    kind = storage_kind(data_type)
    if isinstance(data_type, T.BooleanType):
        return f"coalesce({expression}, false)"
    if kind in ("integer", "real"):
        return f"coalesce(({expression}) <> 0, false)"
    return f"coalesce(length({expression}) > 0, false)" if kind != "null" else "false"
