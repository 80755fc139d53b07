"""Window frames that Spark's parser has not: GROUPS, and EXCLUDE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..errors import ParseError


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the peer groups from ``start`` to ``end`` around each row's own.

    The rank of a row's peers is a number without gaps, so a RANGE over it is a frame of groups.
    Both windows need one partitioning and one order, so the rows are shuffled once.
    """
    rank = "__peers"
    out = df.withColumn(rank, F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy(rank).rangeBetween(start, end)
    return out.select("*", *[a.over(frame).alias(n) for n, a in aggregates.items()]).drop(rank)


def excluded(column: str, frame: WindowSpec, peers: WindowSpec, exclude: str, kind: str = "sum") -> Column:
    """``sum`` or ``count`` of a column over a frame that holds the row and all its peers, without some.

    ``peers`` is the frame of the row's peers.  Both aggregates can be undone, so what is left
    out is taken off again instead of collecting the frame.
    """
    x = F.col(column)
    whole, group = (F.sum(x).over(frame), F.sum(x).over(peers)) if kind == "sum" else (F.count(x).over(frame), F.count(x).over(peers))
    zero = F.coalesce
    own = zero(x, F.lit(0)) if kind == "sum" else x.isNotNull().cast("long")
    out = {"no others": whole, "current row": zero(whole, F.lit(0)) - own, "group": zero(whole, F.lit(0)) - zero(group, F.lit(0)), "ties": zero(whole, F.lit(0)) - zero(group, F.lit(0)) + own}.get(exclude.lower())
    if out is None:
        raise ParseError(f"unknown EXCLUDE {exclude}")
    if kind == "count" or exclude.lower() == "no others":
        return out
    n, m, one = F.count(x).over(frame), F.count(x).over(peers), x.isNotNull().cast("long")
    left = {"current row": n - one, "group": n - m, "ties": n - m + one}[exclude.lower()]
    return F.when(left > 0, out)
