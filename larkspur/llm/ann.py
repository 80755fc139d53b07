"""Approximate nearest neighbours by shifted Hilbert curves.

Each curve projects the vectors at random to a few dimensions, shifts them, and orders them by
the Hilbert index of their grid cell.  A curve's order is range-partitioned; every vector gets
its place in it.  A query is compared with the vectors whose places lie within a window around
its own on any of the curves; the windows' best are merged and reranked by the exact distance.

The curves carry a byte for each component in place of a double, with the length of what that
rounding lost.  It bounds the exact distance from both sides, so a window leaves out only what
cannot be among its k nearest, and the vectors themselves are joined to the few that remain.

The window is a share of the index, the same at every size: on vectors without structure the
neighbours of a point spread along a curve in proportion to all points, so a window of a fixed
number of places would lose recall as the index grows.

Copies of a vector are one entry with the few smallest of their ids, which is all that a result
of ``k`` can need; so a vector that a third of the rows share costs one place.

Defined results: vectors that are null, zero, hold null or non-finite components, or have not the
most frequent length take no part; ties go to the smaller id; with fewer than k others all are
returned; an empty table gives no rows; a null id takes no part; rows that repeat with one id
are one candidate; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, table

CURVES = 28
DIMENSIONS = 10
BITS = 6
#: Places on each side of a query, as a share of the index, and at least.
WINDOW = 0.02
LEAST = 256
SEED = 11
#: More than what arithmetic on doubles adds to a distance, as a share of it.
ROUNDING = 1e-9


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of non-negative integers below 2 ** bits.

    Gray-code coordinates are untwisted from the highest bit down, and their bits interleaved.
    """
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    d = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(d):
            up = (x[i] >> level & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    out = np.zeros(x.shape[1], dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            out = out << 1 | (x[i] >> level & 1)
    return out


def curve(c: int, size: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection and the shift (as a share of the grid) of a curve."""
    rng = np.random.default_rng([seed, c, size])
    m = min(dimensions, size)
    return np.linalg.qr(rng.normal(size=(size, m)))[0], rng.random(m)


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row as bytes, their unit, and the length of the difference."""
    unit = np.abs(x).max(axis=1, initial=0.0) / 127
    code = np.rint(x / np.where(unit > 0, unit, 1.0)[:, None]).astype(np.int8)
    return code, unit, np.sqrt(((x - code * unit[:, None]) ** 2).sum(axis=1))


def valid(vectors: DataFrame, vector: str, key: str) -> tuple[DataFrame, int]:
    """(id, vec: little-endian doubles) of the vectors that take part, and their length."""
    v = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(good).select(F.col(key).cast("long").alias("id"), v.alias("vec"))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = common["n"] if common else 0
    return rows.where(F.size("vec") == size), size


def search(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id", curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, window: float = WINDOW, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that ``is_query`` (over ``id``) marks."""
    spark = vectors.sparkSession
    rows, size = valid(vectors, vector, key)
    # Spark limits each task's rows of a vector before it shuffles them.
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = rows.distinct().withColumn("n", first).where(F.col("n") <= k + 1)
    entries = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("entry", F.element_at("ids", 1))
    asked = rows.where(is_query).select("vec", F.col("id").alias("query_id")).distinct()
    entries = durable(entries.join(asked.select("vec").distinct().withColumn("asked", F.lit(True)), "vec", "left").select("entry", "ids", "vec", F.coalesce("asked", F.lit(False)).alias("asked")), "entries")
    n = entries.count()
    sides = entries.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")).orderBy("i").collect()
    middle = np.array([r["mean"] for r in sides])
    offset = float(np.sqrt((middle**2).sum()))
    # The grid spans three standard deviations on each side; cells beyond it are clipped.
    scale = 6 * float(np.sqrt(np.mean([r["var"] for r in sides]))) if sides else 1.0

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [curve(c, size, dimensions, seed) for c in range(curves)]
        for batch in batches:
            v = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            x = v - middle
            code, unit, lost = coded(x)
            asked_ = batch.column("asked").to_numpy(zero_copy_only=False)
            rest = [batch.column("entry"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(unit), pa.array(lost), pa.array([r if a else None for a, r in zip(asked_, x, strict=True)], pa.list_(pa.float64()))]
            for c, (axes, shift) in enumerate(made):
                y = (x @ axes) / (scale or 1.0) + 0.5  # about 0 to 1
                cells = np.clip(((y + shift) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, dtype=np.int32)), pa.array(hilbert(cells, bits)), *rest], names=["curve", "key", *kinds])

    kinds = ("entry", "code", "unit", "lost", "asked")
    kind = "entry long, code binary, unit double, lost double, asked array<double>"
    keyed = entries.mapInArrow(keys, f"curve int, key long, {kind}") if n else spark.createDataFrame([], f"curve int, key long, {kind}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.repartitionByRange(parts, "curve", "key", "entry").sortWithinPartitions("curve", "key", "entry")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(curves, dtype=np.int64)
        for batch in batches:
            c = batch.column("curve").to_numpy()
            start = np.searchsorted(c, np.arange(curves))
            row = np.arange(len(c)) - start[c] + seen[c]
            seen += np.bincount(c, minlength=curves)
            yield pa.RecordBatch.from_arrays([batch.column("curve"), pa.array(np.full(len(c), part, dtype=np.int32)), pa.array(row), *(batch.column(i) for i in kinds)], names=["curve", "part", "row", *kinds])

    ordered = durable(ordered.mapInArrow(number, f"curve int, part int, row long, {kind}"), "curves")
    # One row for each partition and curve.
    sizes = ordered.groupBy("curve", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.join(F.broadcast(sizes.select("curve", "part", before.alias("before"))), ["curve", "part"]).withColumn("place", F.col("before") + F.col("row"))
    wide = max(least, int(np.ceil(window * n)))
    block = F.floor(F.col("place") / wide)
    held = placed.select(F.col("curve").alias("c"), block.alias("b"), F.col("place").alias("p"), F.col("entry").alias("e"), "code", "unit", "lost")
    reached = placed.where("asked IS NOT NULL").select("curve", F.explode(F.array(block - 1, block, block + 1)).alias("block"), "place", "entry", "asked")

    def near(queries: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),) * 2]
        if queries.num_rows and found.num_rows:
            code = np.frombuffer(b"".join(found.column("code").to_pylist()), dtype=np.int8).reshape(found.num_rows, size)
            x = code * found.column("unit").to_numpy()[:, None]
            lost = found.column("lost").to_numpy()
            places, others = found.column("p").to_numpy(), found.column("e").to_numpy()
            q = queries.column("asked").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(queries.num_rows, size)
            for i, (entry, place) in enumerate(zip(queries.column("entry").to_pylist(), queries.column("place").to_pylist(), strict=True)):
                at = np.flatnonzero(np.abs(places - place) <= wide)
                if not len(at):
                    continue
                about = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                slack = lost[at] + ROUNDING * (about + lost[at] + offset)
                # What overflows is bounded by nothing.
                least_, most = np.nan_to_num(about - slack, nan=0.0), np.nan_to_num(about + slack, nan=np.inf, posinf=np.inf)
                # Each entry has an id at least, and one may be the query's own.
                limit = np.partition(most, k)[k] if len(at) > k else np.inf
                kept = np.flatnonzero(least_ <= limit)
                out.append((np.full(len(kept), entry), others[at[kept]], least_[kept], most[kept]))
        return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], names=["entry", "other", "least", "most"])

    pairs = reached.groupBy("curve", "block").cogroup(held.groupBy("c", "b")).applyInArrow(near, "entry long, other long, least double, most double")
    pairs = pairs.groupBy("entry", "other").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    # The k + 1 smallest upper bounds of an entry's candidates bound what can be among its nearest.
    ahead = F.row_number().over(Window.partitionBy("entry").orderBy("most", "other"))
    limit = F.max(F.when(F.col("n") == k + 1, F.col("most"))).over(Window.partitionBy("entry"))
    pairs = pairs.withColumn("n", ahead).withColumn("limit", limit).where("limit IS NULL OR least <= limit").select("entry", "other")
    theirs = entries.select(F.col("entry").alias("other"), "ids", F.col("vec").alias("there"))
    here = entries.where("asked").select("entry", F.col("vec").alias("here"))
    exact = F.sqrt(F.aggregate(F.zip_with("here", "there", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda total, d: total + d))
    scored = pairs.join(theirs, "other").join(here, "entry").select("entry", F.explode("ids").alias("vec_id"), exact.alias("score"))
    best = F.row_number().over(Window.partitionBy("entry").orderBy("score", "vec_id"))
    top = scored.withColumn("n", best).where(F.col("n") <= k + 1).drop("n")
    who = asked.join(entries.where("asked").select("vec", "entry"), "vec").select("query_id", "entry")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out = who.join(top, "entry").where("query_id <> vec_id").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


QUERIES = {"op10_hilbert_ann": op10_hilbert_ann}
