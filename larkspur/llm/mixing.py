"""Mixing sources to target weights by cube-method balanced sampling.

Each source gets a target size by weight, at most ``max_repeat`` times its own.  With
f = target / size, every document of the source is taken floor(f) times, and once more with
inclusion probability f - floor(f).  The extra copies are drawn by the cube method: among three
undecided documents the probabilities move along the null space of the two balancing
constraints (words and documents) until one of them reaches 0 or 1.  Blocks of a source run
apart; the two or three documents that each leaves undecided meet in further rounds, and the
last ones are landed on the choice nearest to the target.  Landing may also turn up to ``TURNS``
decided documents of the last block, each the one that brings the words nearest to the target:
a large document among the last ones would else miss it by its size.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source
of its own, last in order; a table whose sizes are all 0 has targets 0; an empty table gives no
rows; rows that share an id are drawn apart, and of rows that repeat wholly, any may be the one
taken; a very long text is one document as any other; of sources with equal sizes the first in
order comes first; ``mix`` carries the id and the source alone, ``keep_mix`` all columns,
whatever their names.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import durable, fresh, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0
#: Documents that one flight handles.
BLOCK = 5_000
#: Sources up to which their table is broadcast.
FEW_SOURCES = 50_000
#: Decided documents that landing may turn, at most.
TURNS = 64


def n_words(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives 0."""
    # Each word becomes one letter, which makes no array of a long text's words.
    letters = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def placed(sizes: DataFrame, by: str) -> DataFrame:
    """``sizes`` with ``place``, from 0 on in the order of ``by``, nulls last; sorted in ranges, not in one task."""
    rows = durable(sizes.orderBy(F.col(by).asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "placed")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    # One row for each range: its number of rows, and by a window over these few rows those before it.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(offsets), "range").withColumn("place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "range", "before")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``sizes(source, source_size)`` with each source's target.

    A source is capped at ``max_repeat`` times its size; what it can't take is shared among the
    others by weight until none is above.  Each round finds the level at which the sources that
    are not capped share the rest by weight, and caps those whose cap is below it.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    rows = placed(sizes, "source").withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(max_repeat))
    total = float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, n_capped = 0.0, -1
    while True:
        capped = (F.lit(level) * F.col("w") >= F.col("cap")) if n_capped >= 0 else F.lit(False)
        n, taken, free = rows.agg(F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        if n == n_capped:
            break
        n_capped = n
        level = max(total - (taken or 0.0), 0.0) / free if free else float("inf")
    return rows.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, seed: str) -> np.ndarray:
    """Probabilities after the flight: all but two at most are 0 or 1; their words and number keep."""
    p, eps = p.copy(), 1e-9
    undecided = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    rng = np.random.default_rng(xxhash.xxh32_intdigest(seed))
    hand: list[int] = []
    todo = iter(undecided)
    while True:
        while len(hand) < 3:
            i = next(todo, None)
            if i is None:
                return p
            hand.append(i)
        a, b, c = hand
        # Null space of the rows (sizes) and (ones): their cross product.
        u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(hand, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(hand, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(hand, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] < eps or p[i] > 1 - eps:
                p[i] = round(p[i])
        hand = [i for i in hand if 0 < p[i] < 1]


def land(size: np.ndarray, p: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The few probabilities that a flight leaves become the 0s and 1s nearest in words, then in number.

    A large document may be among them; then single draws among ``free`` (the documents that
    the flight drew) are turned, the best first, as long as that brings the words nearer.
    """
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    error = 0.0
    if len(left):
        s, q = size[left], p[left]
        choice = min(product((0.0, 1.0), repeat=len(left)), key=lambda c: (abs(float(((np.array(c) - q) * s).sum())), abs(float((np.array(c) - q).sum())), c))
        p[left] = choice
        error = float(((np.array(choice) - q) * s).sum())
    for _ in range(TURNS if len(free) else 0):
        turned = np.abs(error + np.where(p[free] > 0.5, -size[free], size[free]))
        best = int(np.argmin(turned))
        if turned[best] >= abs(error):
            break
        i = free[best]
        error += -size[i] if p[i] > 0.5 else size[i]
        p[i] = 1 - p[i]
    return p


def _fly(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that the few that stay undecided are small.
        rows = rows.sort_values(["size", "h", "tie"], ascending=[False, True, True], kind="stable")
        size = rows["size"].to_numpy(dtype=float)
        before = rows["p"].to_numpy(dtype=float)
        p = flight(size, before, f"{rows['h'].iloc[0]} {len(rows)} {int(size.sum())}")
        return rows.assign(p=land(size, p, np.flatnonzero((before > 0) & (before < 1))) if last else p)

    return run


def ties(sized: DataFrame) -> DataFrame:
    """``sized(h, row)`` with ``tie``, which numbers rows of one ``h`` from 0 on; a hot ``h`` is numbered in many tasks."""
    many = sized.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    if many.isEmpty():
        return sized.withColumn("tie", F.lit(0).cast("long"))
    some = sized.select("h", "row").join(many, "h", "left_semi").withColumn("task", F.shiftright("row", 33))
    before = Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = some.groupBy("h", "task").agg(F.count("*").alias("n")).select("h", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("h", "task").orderBy("row")) - 1
    numbered = some.withColumn("inside", inside).join(offsets, ["h", "task"]).select("row", (F.col("before") + F.col("inside")).alias("tie"))
    return sized.join(numbered, "row", "left").withColumn("tie", F.coalesce("tie", F.lit(0).cast("long")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(id, row, source, size, source_size, target, copies) for every row of ``docs``.

    ``row`` tells apart rows that share an id: the column of that name, if given (numbers as of
    ``monotonically_increasing_id``), else a number of its own.
    """
    sized = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("h"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    sized = durable(sized, "sizes")
    sums = durable(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat), "targets")
    n_sources = sums.count()
    sums = sums.withColumnRenamed("source", "s")
    side = F.broadcast(sums) if n_sources <= FEW_SOURCES else sums
    rows = ties(sized).join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(f + 1e-12).cast("long")).withColumn("p", F.greatest(f - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("p", F.when((F.col("size") == 0) | (F.col("p") < 1e-9), 0.0).otherwise(F.col("p")))
    most = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    schema = T.StructType([*rows.schema.fields])
    done, now = [], rows
    while True:
        last = most <= block
        n = 1 if last else -(-most // block)
        now = now.groupBy("source", F.pmod(F.xxhash64("h", "tie"), F.lit(n)).alias("b")).applyInPandas(_fly(last), schema)
        if last:
            done.append(now)
            break
        now = durable(now, "flight")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(now.where(~undecided))
        now = now.where(undecided)
        most = 3 * n
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("id", "row", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(F.lit(0)).cast("long").alias("copies"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it.

    Each row is drawn apart, so of repeated rows each stays as often as it was drawn; columns of
    any name are kept; see the module for nulls, empty and long texts and an empty table.
    """
    row = fresh(docs, "row")
    rows = durable(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    drawn = mix(rows, row=row).where("copies > 0").select(F.col("row").alias(row), F.array_repeat(F.lit(0), F.col("copies").cast("int")).alias(fresh(docs, "copies")))
    joined = rows.join(drawn, row)
    return joined.withColumn(fresh(docs, "copy"), F.explode(drawn.columns[1])).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op1_mixing": op1_mixing}
