import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.functions import call
from larkspur.operators.joins import asof_join, range_join
from larkspur.operators.windows import excluded, groups_frame
from larkspur.plans import changes, fts, spatial
from larkspur.sources import piped, read, scan, seek, sqlite, write


def test_groups_frame(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 5), (4, 9), (5, 9)], "id int, k int")
    got = groups_frame(df, [], [F.col("k")], -1, 0, {"s": F.sum("id")})
    assert {r.id: r.s for r in got.collect()} == {1: 3, 2: 3, 3: 6, 4: 12, 5: 12}


@pytest.mark.parametrize(("how", "want"), [("no others", [3, 3, 6]), ("current row", [2, 1, 3]), ("group", [None, None, 3]), ("ties", [1, 2, 6])])
def test_exclude(spark, how, want):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 5)], "id long, k long")
    w = Window.orderBy("k")
    got = df.select("id", excluded("id", w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, 0), how).alias("s"))
    assert [r.s for r in got.orderBy("id").collect()] == want


def test_asof(spark):
    a = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9)], "k string, at int")
    b = spark.createDataFrame([("x", 2, 20), ("x", 5, 50), ("z", 1, 1)], "k string, t int, v int")
    got = {(r.k, r.at): r.v for r in asof_join(a, b, ["k"], "at", "t", ["v"]).collect()}
    assert got == {("x", 5): 50, ("x", 1): None, ("y", 9): None}


def test_range_join(spark):
    p = spark.createDataFrame([(1.0,), (2.5,), (9.0,)], "p double")
    r = spark.createDataFrame([(0, 0.0, 2.0), (1, 2.0, 9.0), (2, 5.0, 5.0)], "i int, a double, b double")
    assert sorted((x.p, x.i) for x in range_join(p, r, "p", "a", "b", 1.5).collect()) == [(1.0, 0), (2.5, 1)]


def test_fts(spark):
    docs = spark.createDataFrame([(1, "Hello, World! café"), (2, "hello hello"), (3, None)], "id int, text string")
    assert [(r.token, r.start, r.end) for r in fts.token_table(docs.where("id = 1"), "id", "text").orderBy("pos").collect()] == [("hello", 0, 5), ("world", 7, 12), ("caf", 14, 17)]
    index = fts.Index.build(docs, "id", "text")
    ranked = [r.doc for r in index.match(["HELLO"]).orderBy(F.desc("score")).collect()]
    assert ranked == [2, 1]
    assert [r.doc for r in index.match(["hello", "world"], every=True).collect()] == [1]
    one = spark.range(1).select(fts.bm25(F.lit(3), F.lit(100), F.lit(150), F.lit(1000), F.lit(50)).alias("s")).first().s
    assert one > 0


def test_spatial_join_crowded(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 8, raising=False)
    rows = [(k, [(0.5 + k % 3 / 10, 1.0), (k % 11 * 1.0, k % 11 + k % 4 * 1.0)]) for k in range(60)]
    rows += [(60, [(0.0, 9.0)]), (61, [(None, 1.0), (0.0, 9.0)]), (62, [(0.0, 9.0), (0.0, 9.0), (0.0, 9.0)]), (63, [(-7.0, 12.0), (-3.0, 30.0)]), (64, [(0.0, 1.0), (None, 9.0)])]
    rows += [(63, [(-7.0, 12.0), (-3.0, 30.0)]), (65, None), (66, [(0.0, 9.0), (0.0, 9.0), (20.0, 30.0)])]
    df = spark.createDataFrame(rows, "k int, b array<struct<lo: double, hi: double>>")
    left, right = df.select(F.col("k").alias("i"), F.col("b").alias("x")), df.select(F.col("k").alias("j"), F.col("b").alias("y"))
    meet = lambda p, q: bool(p and q) and len(p) == len(q) and all(None not in (*s, *t) and s[0] <= t[1] and t[0] <= s[1] for s, t in zip(p, q, strict=True))
    want = sorted((i, j) for i, p in rows for j, q in rows if meet(p, q))
    got = spatial.overlap_join(left, right, "x", "y", 5.0).select("i", "j", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.i, r.j) for r in got) == want
    assert len({r.task for r in got if r.i < 60 and r.j < 60}) > 1  # the pairs of a crowded cell are dealt to several tasks
    same = spatial.overlap_join(left.withColumn("a.c", F.lit(1)), right.withColumn("a.c", F.lit(2)), "x", "y", 5.0)
    assert same.columns == ["i", "x", "a.c", "j", "y", "a.c"] and same.count() == len(want)
    two = lambda p: p is not None and len(p) == 2
    for cell in (5.0, (5.0, 2.0)):
        got = spatial.overlap_join(left, right, "x", "y", cell, sides=2).select("i", "j").collect()
        assert sorted((r.i, r.j) for r in got) == sorted((i, j) for i, p in rows for j, q in rows if two(p) and meet(p, q))


def test_spatial_join_equal_boxes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spatial, "BLOCK", 1024)
    rows = [(k, [(k % 5 * 2.0, k % 5 * 2.0 + 3.0), (k % 2 * 1.0, k % 2 + 0.5)]) for k in range(4000)]
    df = spark.createDataFrame(rows, "k int, b array<struct<lo: double, hi: double>>")
    left, right = df.select(F.col("k").alias("i"), F.col("b").alias("x")), df.select(F.col("k").alias("j"), F.col("b").alias("y"))

    def sent() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))

    before, out = sent(), tmp_path / "pairs"
    spatial.overlap_join(left, right, "x", "y", (5.0, 5.0), sides=2).select("i", "j").write.parquet(str(out))
    assert sent() - before < 4000  # boxes travel, not their rows
    meet = lambda p, q: all(s[0] <= t[1] and t[0] <= s[1] for s, t in zip(p, q, strict=True))
    of = lambda n: [k for k in range(4000) if k % 10 == n]
    boxes = [(of(n), of(m)) for n in range(10) for m in range(10) if meet(rows[n][1], rows[m][1])]
    got = spark.read.parquet(str(out)).agg(F.count("*"), F.count_distinct("i", "j"), F.sum(F.col("i").cast("long") * F.col("j"))).first()
    assert tuple(got) == (n := sum(len(p) * len(q) for p, q in boxes), n, sum(sum(p) * sum(q) for p, q in boxes))
    monkeypatch.setattr(spatial, "LIST", 64, raising=False)
    got = spatial.overlap_join(left, right, "x", "y", (5.0, 5.0), sides=2, keep=(["i"], ["j"]))
    assert got.columns == ["i", "j"] and got.where("i < 400 AND j >= 3600").count() == sum(sum(k < 400 for k in p) * sum(k >= 3600 for k in q) for p, q in boxes)
    # Rows equal in all columns, nulls, nothing to split them by.
    same = spark.createDataFrame([(None if k % 3 else 1, "v", rows[0][1]) for k in range(1500)], "k int, v string, b array<struct<lo: double, hi: double>>")
    monkeypatch.setattr(spatial, "BLOCK", 64)
    for sides in (2, None):
        got = spatial.overlap_join(same, same, "b", "b", (5.0, 5.0), sides=sides, keep=(["k"], ["v"]))
        assert sorted(tuple(r) for r in got.groupBy("k", "v").count().na.fill(0, ["k"]).collect()) == [(0, "v", 1000 * 1500), (1, "v", 500 * 1500)]


def test_spatial(spark):
    df = spark.range(1).select(
        spatial.volume(spatial.box((0, 2), (0, 3))).alias("v"),
        spatial.contains(spatial.box((0, 10), (0, 10)), spatial.box((2, 4), (2, 4))).alias("a"),
        spatial.contains(spatial.box((3, 10), (0, 10)), spatial.box((2, 4), (2, 4))).alias("b"),
        spatial.contains(spatial.box((0, 10)), spatial.box((2, 4), (2, 4))).alias("c"),
        spatial.overlaps(spatial.box((0, 3)), spatial.box((3, 5))).alias("d"),
    )
    assert tuple(df.first()) == (6.0, True, False, False, True)
    one, two = spatial.linear_split([(i, [(i, i + 1)]) for i in range(5)])
    assert one[0][0] == 0 and two[0][0] == 4 and len(one) + len(two) == 5


def test_changes(spark):
    s = changes.Session()
    s.record("insert", "t", 1)
    s.record("update", "t", 1)
    assert s.changeset(spark).count() == 2 and s.changeset(spark).count() == 0
    s.enabled = False
    s.record("delete", "t", 1)
    assert s.changeset(spark).count() == 0
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "id int, v string")
    d = changes.diff(old, new, ["id"])
    assert sorted((r.op, r.id) for r in d.collect()) == [("delete", 3), ("insert", 4), ("update", 2)]
    assert sorted(map(tuple, changes.apply(old, d, ["id"]).collect())) == sorted(map(tuple, new.collect()))


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("substr", "'hello world'", 7, -3), "lo "),
        (("trim", "'xxhelloxx'", "'x'"), "hello"),
        (("sign", -42), -1),
        (("date", "'2023-01-01'"), "2023-01-01"),
        (("date", "'2024-02-28'", "'+2 days'"), "2024-03-01"),
        (("julianday", "'2023-01-01'"), 2459945.5),
        (("datetime", 1672531200), "2023-01-01 00:00:00"),
        (("datetime", "2451545.0D"), "2000-01-01 12:00:00"),
        (("date", "'nonsense'"), None),
        (("strftime", "'%Y|%j|%w|%%'", "'2024-03-01'"), "2024|061|5|%"),
        (("json_extract", "'{\"a\":{\"b\":42}}'", "'$.a.b'"), "42"),
        (("json_valid", "'{bad json'"), 0),
        (("json_type", "'[1]'"), "array"),
        (("min", "1", "NULL"), None),
        (("quote", "'a''b'"), "'a''b'"),
    ],
)
def test_functions(spark, args, want):
    assert spark.range(1).select(call(*args).alias("x")).first().x == want


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for form in ("parquet", "orc", "json", "csv"):
        write(df, f"{tmp_path}/{form}", form)
        assert read(spark, f"{tmp_path}/{form}", form, "k int, v string").count() == 2
    assert [r.line for r in piped(df).orderBy("line").collect()] == ["1|a", "2|"]
    assert [r.k for r in scan(df, "k", reverse=True).collect()] == [2, 1]
    assert seek(df, "k", "gt", 1).first().k == 2 and seek(df, "k", "lt", 1).count() == 0


def test_database_file(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE users (id INTEGER PRIMARY KEY, name TEXT, score REAL)")
        db.executemany("INSERT INTO users VALUES (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(1, 8)])
    sqlite.register(spark)
    df = spark.read.format("dbfile").option("table", "users").option("partitions", "3").load(str(tmp_path / "x.db"))
    assert df.count() == 7 and df.where("id = 4").first().score == 2.0


def test_spatial_join_all(spark, tmp_path):
    from larkspur import queries as q

    parts = [(k, k * 7 % 50 + 1) for k in range(1, 121)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    boxes = [(k, x, x + 3, k % 50, k % 50 + k % 7 - 1) for k, x in parts if k % 7]
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[2] and b[1] <= a[2] and a[3] <= b[4] and b[3] <= a[4])
    got = sorted((r.a, r.b) for r in q.queries()["spatial_overlap_join"](spark, str(tmp_path)).collect())
    assert got == want and any(a % 20 for a, _ in got)
