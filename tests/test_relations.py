from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import spans
from textloom.operators.asof import asof_join
from textloom.operators.retrieval import cosine, hashed_terms, having, most_named, pooled, search
from textloom.operators.running import running_ids
from textloom.streaming import stream


def test_spans(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 8, 9), (2, 0, 3)], "d int, start int, end int")
    b = spark.createDataFrame([(1, 4, 6, "x"), (1, 0, 3, "y"), (2, 3, 4, "z")], "d int, start int, end int, v string")
    assert sorted(tuple(r) for r in spans.without_overlap(a, b, ["d"]).collect()) == [(1, 8, 9), (2, 0, 3)]
    assert sorted((r.d, r.start, r.v) for r in spans.best_cover(a, b, ["d"], "v").collect()) == [(1, 0, "y"), (1, 8, None), (2, 0, None)]
    p = spark.createDataFrame([(1, 4), (1, 7)], "d int, at int")
    assert [(r.at, r.v) for r in spans.covered(p, b, ["d"], "at").collect()] == [(4, "x")]
    i = spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 5, 6)], "d int, start int, end int")
    assert [r.island for r in spans.islands(i, ["d"]).orderBy("start").collect()] == [0, 0, 1]


def test_asof(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (3, None)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (2, 10, "z")], "k int, t int, v string")
    assert sorted(((r.k, r.t, r.v) for r in asof_join(a, b, ["k"], "t", ["v"]).collect()), key=str) == [(1, 1, None), (1, 5, "y"), (2, 9, None), (3, None, None)]


def test_running_ids(spark):
    df = spark.range(1000).withColumn("k", F.col("id") * 7919 % 1000)
    assert all(r.k == r.n for r in running_ids(df, ["k"], "n").collect())
    assert running_ids(df.limit(0), ["k"], "n").count() == 0


def test_search_equals_every_pair(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    found = {(r.q, r.vec_id) for r in search(q, e, 5).collect()}
    every = q.crossJoin(e).select("q", "vec_id", F.round(cosine(F.col("v"), F.col("embedding")), 6).alias("s")).collect()
    by: dict = {}
    for r in every:
        by.setdefault(r.q, []).append((-r.s, r.vec_id))
    assert found == {(k, i) for k, v in by.items() for _, i in sorted(v)[:5]}
    assert search(q.limit(0), e, 5).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 4.0])], "k int, v array<double>")
    assert [round(x, 6) for x in pooled(df, ["k"], "v").first().v] == [0.6, 0.8]
    t = spark.createDataFrame([("a b c",), ("a b c",), ("x y",), (None,)], "t string")
    v = [r[0] for r in t.select(hashed_terms(64)(F.col("t"))).collect()]
    assert v[0] == v[1] != v[2] and abs(sum(x * x for x in v[0]) - 1) < 1e-5 and not any(v[3])
    c = spark.createDataFrame([(["A", "B"],), (["B"],)], "entities array<string>")
    assert having(c, "A").count() == 1 and [(r.entity, r.n) for r in most_named(c, 1).collect()] == [("B", 2)]


def test_streams(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    s = stream.text_stream(spark, str(tmp_path / "in"))
    for part in range(2):
        stream.numbered(s, ["doc_id"], "n", out, str(tmp_path / "c")).awaitTermination()
        assert sorted(r.n for r in spark.read.parquet(out).collect()) == list(range(20 + 10 * part))
        if not part:
            docs.limit(40).exceptAll(docs.limit(20)).limit(10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream.each_batch(stream.annotate_stream(s), lambda b: b, str(tmp_path / "ann"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ann")).count() == stream.annotate_stream(spark.read.parquet(str(tmp_path / "in"))).count()


def test_event_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    s = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    for name, f in (("t", stream.tumbling), ("s", stream.sessions)):
        out = str(tmp_path / name)
        f(s).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", out + "c").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out).count()
        assert 0 < rows <= f(events).count()
