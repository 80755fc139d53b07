"""Change capture: a log of changes, change sets, table differences."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "op string, table_name string, rowid long"


@dataclass
class Session:
    """Records changes while it is enabled."""

    enabled: bool = True
    pending: list[tuple[str, str, int]] = field(default_factory=list)

    def record(self, op: str, table: str, rowid: int) -> None:
        if self.enabled:
            self.pending.append((op, table, rowid))

    def changeset(self, spark: SparkSession) -> DataFrame:
        """What was recorded since the last change set, which it ends."""
        rows, self.pending = self.pending, []
        return spark.createDataFrame(rows, SCHEMA)


def diff(old: DataFrame, new: DataFrame, key: list[str], table: str = "t") -> DataFrame:
    """(op, table_name, key, old_*, new_*): the rows to insert, update or delete.  One shuffle of each side."""
    rest = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("o"))
    b = new.select(*key, F.struct(*rest).alias("n"))
    both = a.join(b, key, "full")
    op = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").when(~F.col("o").eqNullSafe(F.col("n")), "update")
    out = both.withColumn("op", op).where("op IS NOT NULL")
    return out.select("op", F.lit(table).alias("table_name"), *key, *[F.col(f"o.{c}").alias(f"old_{c}") for c in rest], *[F.col(f"n.{c}").alias(f"new_{c}") for c in rest])


def apply(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The old rows with a difference applied."""
    rest = [c for c in old.columns if c not in key]
    kept = old.join(changes.select(*key), key, "left_anti")
    put = changes.where("op <> 'delete'").select(*key, *[F.col(f"new_{c}").alias(c) for c in rest])
    return kept.select(old.columns).unionByName(put)
