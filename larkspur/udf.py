"""User functions: scalar, aggregate and table functions by name, usable from the dialect's SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, function: Callable[..., Any], returns: str) -> None:
    """A function of values, called once for each row of an Arrow batch."""

    def batched(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*(None if pd.isna(v) else v for v in row)) for row in zip(*columns, strict=True)], dtype=object)

    batched.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    spark.udf.register(name, F.pandas_udf(batched, returns, functionType=F.PandasUDFType.SCALAR))


def vectorised(spark: SparkSession, name: str, function: Callable[..., pd.Series], returns: str) -> None:
    """A function of whole columns of a batch, the faster kind."""
    spark.udf.register(name, F.pandas_udf(function, returns, functionType=F.PandasUDFType.SCALAR))


def aggregate(spark: SparkSession, name: str, state: Callable[[], Any], returns: str) -> None:
    """An aggregate from an object with ``step(*values)`` and ``finalize()``.

    Such objects can't be merged, so each group is evaluated in one task; built-in aggregates,
    which combine before the shuffle, are to be preferred for large groups.
    """

    def grouped(*columns: pd.Series) -> Any:
        acc = state()
        for row in zip(*columns, strict=True):
            acc.step(*(None if pd.isna(v) else v for v in row))
        return acc.finalize()

    spark.udf.register(name, F.pandas_udf(grouped, returns, functionType=F.PandasUDFType.GROUPED_AGG))


def table_function(spark: SparkSession, name: str, rows: Callable[..., Iterator[tuple]], returns: str) -> None:
    """A function that yields rows, for FROM and LATERAL."""

    class Rows:
        def eval(self, *args: Any) -> Iterator[tuple]:
            yield from rows(*args)

    spark.udtf.register(name, F.udtf(Rows, returnType=returns))
