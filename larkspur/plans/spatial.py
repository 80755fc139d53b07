"""Boxes: arrays of (lo, hi), one for each dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box(*sides: tuple) -> Column:
    """A box of pairs of columns, numbers or names."""
    as_ = lambda x: (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.array(*[F.struct(as_(a).alias("lo"), as_(b).alias("hi")) for a, b in sides])


def volume(b: Column) -> Column:
    """The product of the sides; a side that ends before it starts counts 0."""
    return F.aggregate(b, F.lit(1.0), lambda acc, s: acc * F.greatest(s["hi"] - s["lo"], F.lit(0.0)))


def contains(outer: Column, inner: Column) -> Column:
    """Is every side of ``inner`` within that of ``outer``?  False for different dimensions."""
    sides = F.zip_with(outer, inner, lambda o, i: (i["lo"] >= o["lo"]) & (i["hi"] <= o["hi"]))
    return (F.size(outer) == F.size(inner)) & F.forall(sides, lambda x: F.coalesce(x, F.lit(False)))


def overlaps(a: Column, b: Column) -> Column:
    """Do the boxes share a point?"""
    sides = F.zip_with(a, b, lambda x, y: (x["lo"] <= y["hi"]) & (y["lo"] <= x["hi"]))
    return (F.size(a) == F.size(b)) & F.forall(sides, lambda x: F.coalesce(x, F.lit(False)))


#: Rows of a side that meet in one block of ``overlap_join``, about.
BLOCK = 8192
#: Rows with equal boxes that travel in one list at most, if the result has one column of theirs; an eighth if more.
LIST = 128


def overlap_join(
    left: DataFrame, right: DataFrame, a: str, b: str, cell: float | tuple[float, ...], sides: int | None = None, keep: tuple[list[str], list[str]] | None = None
) -> DataFrame:
    """Pairs of overlapping boxes, each once, by a grid on the first dimensions: one for each size in ``cell``.

    Rows of a side with equal boxes travel as one entry, a list, and become pairs only when their boxes
    have met.  Both sides are dealt to the cells they touch; a pair counts in the cell of the greater starts.
    Where entries of more than ``BLOCK`` rows touch a cell each side is cut by a hash of its entries, and every
    cut meets every cut of the other side in a block of its own, so no task holds a whole crowded
    cell.  With ``sides`` only boxes of so many sides take part, whose test is then generated code.
    The result has the columns named in ``keep`` of the left and the right, or else all.
    """
    sizes = cell if isinstance(cell, tuple) else (cell,)
    flat = range(len(sizes) if sides is None else sides)
    cells = [f"__c{d}" for d in range(len(sizes))]
    kept = keep or (left.columns, right.columns)
    name = lambda c: F.col(f"`{c.replace('`', '``')}`")

    def dealt(df: DataFrame, box_: str, s: str, columns: list[str]) -> DataFrame:
        plain = [name(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        df = df if sides is None else df.where(F.size(box_) == sides)
        ends = {f"__{end}{s}{d}": F.get(box_, F.lit(d))[end] for d in flat for end in ("lo", "hi")}
        whole = ends if sides is not None else {f"__box{s}": F.col(box_)}
        # Fields go by place, as a name may hold anything.
        row = F.struct(*[name(c).alias(str(i)) for i, c in enumerate(columns)])
        df = df.select(*[c.alias(n) for n, c in whole.items()], F.xxhash64(*plain).alias("__hash"), row.alias("__row"))
        df = df.where(" AND ".join(f"{n} IS NOT NULL" for n in whole))
        # At most one box for each BLOCK rows, so few enough to send to all.
        common = F.broadcast(df.groupBy(*whole).agg(F.ceil(F.count("*") / BLOCK).alias("__lists")).where("__lists > 1"))
        lists = df.join(common, list(whole), "left").withColumn("__list", F.expr("pmod(__hash, coalesce(__lists, 1L))"))
        lists = lists.groupBy(*whole, "__list").agg(F.collect_list("__row").alias("__all"))
        rows = F.col("__all")["0"] if len(columns) == 1 else F.col("__all")
        # Generated code holds a list with each box it meets in a block, so lists are cut, in equal parts.
        most = LIST if len(columns) == 1 else LIST // 8
        df = lists.withColumns({"__n": F.size("__all"), "__of": F.ceil(F.size("__all") / most).cast("int")}).withColumn("__part", F.explode(F.expr("sequence(0, __of - 1)")))
        start = lambda k: F.floor((F.col("__part") + k) * F.col("__n").cast("long") / F.col("__of")).cast("int")
        part = F.when(F.col("__of") == 1, rows).otherwise(F.slice(rows, start(0) + 1, start(1) - start(0)))
        df = df.select(*whole, part.alias(f"__rows{s}"), F.xxhash64(*whole, "__list", "__part").alias(f"__hash{s}"))
        if sides is None:
            df = df.withColumns({n: F.get(f"__box{s}", F.lit(d))[end] for d in flat for end in ("lo", "hi") for n in [f"__{end}{s}{d}"]})
        for d, size in enumerate(sizes):
            df = df.withColumn(cells[d], F.explode(F.sequence(F.floor(F.col(f"__lo{s}{d}") / size), F.floor(F.col(f"__hi{s}{d}") / size))))
        return df

    one, two = dealt(left, a, "l", kept[0]), dealt(right, b, "r", kept[1])
    cuts = lambda df, s: df.groupBy(*cells).agg(F.ceil(F.sum(F.size(f"__rows{s}")) / BLOCK).alias(f"__cuts{s}"))
    # At most one cell for each BLOCK rows, so few enough to send to all.
    crowded = F.broadcast(cuts(one, "l").join(cuts(two, "r"), cells).where("__cutsl > 1 OR __cutsr > 1"))

    def blocks(df: DataFrame, s: str, other: str) -> DataFrame:
        df = df.join(crowded, cells, "left").withColumn(f"__at{s}", F.expr(f"pmod(__hash{s}, coalesce(__cuts{s}, 1L))"))
        df = df.withColumn(f"__at{other}", F.explode(F.expr(f"sequence(0L, coalesce(__cuts{other}, 1L) - 1)")))
        return df.drop(f"__hash{s}", "__cutsl", "__cutsr")

    session = left.sparkSession
    block = [*cells, "__atl", "__atr"]
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    # Few bytes make very many pairs, so tasks are neither merged by bytes nor one side sent to all.
    pairs = blocks(one, "l", "r").repartition(tasks, *block).hint("merge").join(blocks(two, "r", "l").repartition(tasks, *block), block)
    test = F.lit(True)
    for d in flat:
        test = test & (F.col(f"__lol{d}") <= F.col(f"__hir{d}")) & (F.col(f"__lor{d}") <= F.col(f"__hil{d}"))
    for d, size in enumerate(sizes):
        test = test & (F.col(cells[d]) == F.floor(F.greatest(f"__lol{d}", f"__lor{d}") / size))
    if sides is None:
        test = test & overlaps(F.col("__boxl"), F.col("__boxr"))
    # Row by row of the left list: runs of one row beside a list that returns are small in columnar files.
    # The copy of the left list keeps its rows out of generated code, which would hold all pairs of a box before it hands on one.
    pairs = pairs.where(test).select(F.explode(F.transform("__rowsl", lambda x: x)).alias("l"), "__rowsr").select("l", F.explode("__rowsr").alias("r"))
    return pairs.select(*[(F.col(s) if len(columns) == 1 else F.col(s)[str(i)]).alias(c) for s, columns in zip("lr", kept, strict=True) for i, c in enumerate(columns)])


def linear_split(entries: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """A node's entries (id, [(lo, hi), ...]) in two nodes: seeds at the ends of the first side, the rest to the smaller."""
    if len(entries) < 2:
        return list(entries), []
    low = min(range(len(entries)), key=lambda i: entries[i][1][0][0])
    high = max((i for i in range(len(entries)) if i != low), key=lambda i: entries[i][1][0][1])
    one, two = [entries[low]], [entries[high]]
    for i, e in enumerate(entries):
        if i not in (low, high):
            (one if len(one) <= len(two) else two).append(e)
    return one, two
