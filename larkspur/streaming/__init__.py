"""Structured Streaming over the engine's tables: windows, deduplication, change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.dml import upserted


def files(spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet", per_batch: int = 0) -> DataFrame:
    """A stream of the files that appear in a folder."""
    reader = spark.readStream.format(form).schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)


def tumbling(events: DataFrame, at: str, width: str, late: str, by: list[str], aggregates: dict[str, object], slide: str | None = None) -> DataFrame:
    """Aggregates in event-time windows; rows later than ``late`` behind the newest are dropped from state."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    out = events.withWatermark(at, late).groupBy(window.alias("w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggregates)


def sessions(events: DataFrame, at: str, gap: str, late: str, by: list[str], aggregates: dict[str, object]) -> DataFrame:
    """Aggregates over runs of events with pauses of less than ``gap``."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *aggregates)


def unique(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """The first event of each key; state for a key goes with the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def change_feed(changes: DataFrame, target: str, key: list[str], checkpoint: str, version: Callable[[int], str] | None = None, order: str | None = None, op: str | None = None) -> StreamingQuery:
    """Merge each micro-batch of rows into a versioned table under ``target``: <target>/v<batch>.

    Of a batch's rows with one key the last by ``order`` counts (without it, any one).  Where the
    column ``op`` says ``delete``, the key's row goes; that column is not kept.  A batch that runs
    again after a failure writes the same version anew.
    """
    place = version or (lambda n: f"{target}/v{n}")

    def put(batch: DataFrame, n: int) -> None:
        rest = [c for c in batch.columns if c not in key]
        new = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*") if order and rest else batch.dropDuplicates(key)
        gone = F.coalesce(F.lower(F.col(op)) == "delete", F.lit(False)) if op else F.lit(False)
        put_ = new.where(~gone).drop(*([op] if op else []))
        if n:
            old = batch.sparkSession.read.parquet(place(n - 1))
            old = old.join(new.where(gone).select(*key), key, "left_anti").select(old.columns) if op else old
            put_ = upserted(old, put_.select(old.columns), key)
        put_.write.mode("overwrite").parquet(place(n))

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def joined(left: DataFrame, right: DataFrame, at: tuple[str, str], late: tuple[str, str], on: str, within: str) -> DataFrame:
    """Inner join of two streams on ``on`` where the right event is at most ``within`` after the left; state goes with the watermarks."""
    a, b = left.withWatermark(at[0], late[0]), right.withWatermark(at[1], late[1])
    return a.join(b, F.expr(f"{on} AND {at[1]} >= {at[0]} AND {at[1]} <= {at[0]} + INTERVAL {within}"))
