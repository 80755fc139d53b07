"""As-of and range joins without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, take: list[str]) -> DataFrame:
    """Each left row with the last right row of its key at or before it, or nulls.

    Both sides are put in one order in one shuffle, and a running last value carries the right
    side's columns to the left rows; so a key costs its rows, not their product.
    """
    a = left.select("*", F.col(left_on).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType).alias("__take"))
    b = right.select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.struct(*take).alias("__take"))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__take", ignorenulls=True).over(before)).where("__side = 1")
    return carried.select(*left.columns, *[F.col(f"__last.{c}").alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with every range that holds them (low <= point < high), by cells of ``width``.

    A range is dealt to the cells it touches and a point to its own, so the join is on equal cells.
    """
    a = points.withColumn("__cell", F.floor(F.col(point) / width))
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    b = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(cells))
    return a.join(b, "__cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__cell")
