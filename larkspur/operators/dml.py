"""Changes to immutable tables as new DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ConstraintError


def updated(df: DataFrame, sets: dict[str, str], where: str) -> tuple[DataFrame, DataFrame]:
    """The new table, and its changed rows; every expression reads the old row."""
    low = {c.lower(): v for c, v in sets.items()}
    missing = set(low) - {c.lower() for c in df.columns}
    if missing:
        raise ConstraintError(f"no such column: {sorted(missing)[0]}")
    new = {f.name: F.expr(low[f.name.lower()]).cast(f.dataType) for f in df.schema.fields if f.name.lower() in low}
    test = F.expr(where)
    out = df.select(*[F.when(test, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])
    changed = df.where(test).select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
    return out, changed


def deleted(df: DataFrame, where: str) -> tuple[DataFrame, DataFrame]:
    """The new table, and the rows that went; a null test keeps a row."""
    test = F.coalesce(F.expr(where), F.lit(False))
    return df.where(~test), df.where(test)


def latest(new: DataFrame, key: tuple[str, ...], first: bool = False) -> DataFrame:
    """Of rows with the same key the last, or the first; a null in the key is like no other."""
    order = F.col("__at") if first else F.col("__at").desc()
    rows = new.withColumn("__at", F.monotonically_increasing_id())
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    # Rows without a whole key are spread by their place, each a group of its own.
    own = F.when(~known, F.col("__at"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key, own).orderBy(order)))
    return rows.where("__n = 1").drop("__n", "__at")


def merged(df: DataFrame, new: DataFrame, keys: tuple[tuple[str, ...], ...], conflict: str) -> tuple[DataFrame, DataFrame]:
    """The table with ``new`` appended, and what was: REPLACE drops rows before with the same key, IGNORE the new ones."""
    for key in keys:
        new = latest(new, key, first=conflict == "ignore")
        if conflict == "ignore":
            new = new.join(df.select(*key), list(key), "left_anti").select(df.columns)
    if conflict == "replace":
        for key in keys:
            df = df.join(new.select(*key), list(key), "left_anti").select(df.columns)
    return df.unionByName(new), new


def numbered(new: DataFrame, column: str, old: DataFrame) -> DataFrame:
    """``new`` with its null row ids filled, in order, from the greatest id of both plus one.

    Rows are numbered within their tasks; the tasks' counts, one row each, are added up.
    """
    empty = new.where(F.col(column).isNull())
    if empty.isEmpty():
        return new
    top = max(new.agg(F.max(column)).first()[0] or 0, old.agg(F.max(column)).first()[0] or 0)
    rows = new.withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.shiftright("__at", 33))
    counts = rows.where(F.col(column).isNull()).groupBy("__task").agg(F.count("*").alias("__many"))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__task", F.coalesce(F.sum("__many").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__task", F.col(column).isNull()).orderBy("__at"))
    filled = rows.join(F.broadcast(offsets), "__task", "left").withColumn(column, F.coalesce(F.col(column), F.lit(top) + F.col("__before") + place))
    return filled.orderBy("__at").select(new.columns)


def upserted(df: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the new one where there is one.  One shuffle on the key."""
    both = df.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in df.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "__new").alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest]).select(df.columns)
