"""The dialect's functions as SQL over Spark built-ins, by name.

Each entry takes its arguments as SQL text and gives SQL text, so that all stay in whole-stage
code generation; ``call`` makes a Column of one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseError
from . import aggregates, dates, json, scalar, strings

TEMPLATES: dict[str, Callable[..., str]] = {**scalar.TEMPLATES, **strings.TEMPLATES, **dates.TEMPLATES, **json.TEMPLATES, **aggregates.TEMPLATES}


def render(name: str, args: list[str]) -> str:
    """SQL text of a call, or None where Spark's own function of that name serves."""
    make = TEMPLATES.get(name.lower())
    if make is None:
        return f"{name}({', '.join(args)})"
    try:
        return make(*args)
    except TypeError as e:
        raise ParseError(f"wrong number of arguments to function {name}()") from e


def call(name: str, *args: object) -> Column:
    """A Column of a dialect function; strings are SQL text, other values literals."""
    return F.expr(render(name, [a if isinstance(a, str) else "NULL" if a is None else str(a) for a in args]))
