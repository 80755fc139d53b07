"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A table at ``path``; text formats should be given a schema, which saves a pass over the data."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "append", by: list[str] | None = None, **options: str) -> None:
    """Append to (or with ``mode`` replace) a table, in folders by the values of ``by``."""
    writer = df.write.format(form).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def piped(df: DataFrame) -> DataFrame:
    """Each row as text: columns joined by |, null empty."""
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def scan(df: DataFrame, key: str, low: object = None, high: object = None, reverse: bool = False, ordered: bool = True) -> DataFrame:
    """Rows whose key is from ``low`` to ``high``, in key order; the bounds reach the file reader."""
    if low is not None:
        df = df.where(F.col(key) >= F.lit(low))
    if high is not None:
        df = df.where(F.col(key) <= F.lit(high))
    return df.orderBy(F.col(key).desc() if reverse else F.col(key)) if ordered else df


def seek(df: DataFrame, key: str, how: str, value: object) -> DataFrame:
    """The one row that a cursor would stop at: how is ge, gt, le or lt."""
    c, v = F.col(key), F.lit(value)
    test = {"ge": c >= v, "gt": c > v, "le": c <= v, "lt": c < v}[how]
    return df.where(test).orderBy(c if how in ("ge", "gt") else c.desc()).limit(1)
