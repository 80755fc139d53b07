from pyspark.sql import functions as F

from larkspur import streaming


def rows(spark, query, name):
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_windows_and_unique(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id AS int),0) AS ts, cast(id % 2 AS int) AS k, id FROM range(20)")
    df.write.parquet(f"{tmp_path}/in")
    stream = streaming.files(spark, f"{tmp_path}/in", df.schema)
    out = streaming.tumbling(stream, "ts", "5 minutes", "10 minutes", ["k"], {"n": F.count("*")})
    got = rows(spark, out.writeStream.outputMode("complete").format("memory").queryName("tumbling_out").start(), "tumbling_out")
    assert got.count() == 8 and got.agg(F.sum("n")).first()[0] == 20
    one = streaming.unique(stream, "ts", "1 hour", ["k"])
    assert rows(spark, one.writeStream.format("memory").queryName("unique_out").start(), "unique_out").count() == 2


def test_sessions(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) AS ts, 'a' AS k FROM VALUES (0), (3), (30), (31) AS v(m)")
    df.write.parquet(f"{tmp_path}/in")
    out = streaming.sessions(streaming.files(spark, f"{tmp_path}/in", df.schema), "ts", "10 minutes", "5 minutes", ["k"], {"n": F.count("*")})
    got = rows(spark, out.writeStream.outputMode("complete").format("memory").queryName("sessions_out").start(), "sessions_out")
    assert sorted(r.n for r in got.collect()) == [2, 2]


def test_change_feed(spark, tmp_path):
    for i, data in enumerate([[(1, "a"), (2, "b")], [(2, "c"), (3, "d")]]):
        spark.createDataFrame(data, "k int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.createDataFrame([], "k int, v string").schema
    for i in range(2):
        stream = streaming.files(spark, f"{tmp_path}/in/{i}", schema)
        target = f"{tmp_path}/out{i}"
        streaming.change_feed(stream, target, ["k"], f"{tmp_path}/cp{i}").awaitTermination()
        assert spark.read.parquet(f"{target}/v0").count() == 2


def test_change_feed_merges_batches(spark, tmp_path):
    kind = "k int, v string, op string, at int"
    schema = spark.createDataFrame([], kind).schema

    def feed():
        stream = streaming.files(spark, f"{tmp_path}/in", schema)
        streaming.change_feed(stream, f"{tmp_path}/out", ["k"], f"{tmp_path}/cp", order="at", op="op").awaitTermination()

    spark.createDataFrame([(1, "a", "put", 1), (2, "b", "put", 1), (1, "aa", "put", 2)], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    feed()
    spark.createDataFrame([(2, "x", "delete", 3), (3, "c", "put", 3), (1, "z", "put", 3)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out/v0").collect()) == [(1, "aa"), (2, "b")]
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out/v1").collect()) == [(1, "z"), (3, "c")]


def test_streams_join(spark, tmp_path):
    a = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) AS ta, m AS ka FROM VALUES (0), (10), (20) AS v(m)")
    b = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m + d,0) AS tb, m AS kb FROM VALUES (0, 3), (10, 30), (20, -5) AS v(m, d)")
    for n, df in (("a", a), ("b", b)):
        df.write.parquet(f"{tmp_path}/{n}")
    out = streaming.joined(streaming.files(spark, f"{tmp_path}/a", a.schema), streaming.files(spark, f"{tmp_path}/b", b.schema), ("ta", "tb"), ("1 hour", "1 hour"), "ka = kb", "5 minutes")
    got = rows(spark, out.writeStream.format("memory").queryName("joined_out").start(), "joined_out")
    assert [r.ka for r in got.collect()] == [0]
