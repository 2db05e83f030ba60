"""Read and write paths, the manifest, and streams against batch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyplan import schema
from rallyplan.operators import gaps, relational
from rallyplan.plans import manifest
from rallyplan.sources import files, sinks
from rallyplan.streaming import rallies as S


def test_contract_and_slice(spark, tmp_path):
    rows = [(0.0, 100.4, 50.0, 1), (0.5, 110.6, 51.0, 1), (9.99, 120.0, 52.0, 1), (10.0, 130.0, 53.0, 2), (12.0, 140.0, 54.0, 2)]
    spark.createDataFrame(rows, "t double, x float, y float, track int").write.parquet(str(tmp_path / "ball"))
    ball = files.contract(spark, str(tmp_path / "ball"), schema.BALL, ["t", "x", "track", "strength"])
    first = files.time_slice(ball, 0, 10).orderBy("t").select("t", F.rint("x").cast("int").alias("x")).collect()
    assert [tuple(r) for r in first] == [(0.0, 100), (0.5, 111), (9.99, 120)]
    assert files.time_slice(ball, 10, 10_000).count() == 2
    plan = files.time_slice(ball.select("t"), 0, 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(t,0.0)" in plan and "ReadSchema: struct<t:double>" in plan


def test_label_files(spark, tmp_path):
    (tmp_path / "strokes.csv").write_text("# by hand\nt,player,stroke\n\n1:02,self,forehand\n# gap\n3.5,other,serve\n")
    rows = files.labels(spark, str(tmp_path / "strokes.csv")).collect()
    assert [(r.t, r.player, r.stroke) for r in rows] == [(62.0, "self", "forehand"), (3.5, "other", "serve")]


def test_documents_and_arrays(spark, tmp_path):
    (tmp_path / "court.json").write_text('{"found": true,\n "quality": 0.94, "extra": 1}')
    doc = files.documents(spark, str(tmp_path / "court.json"), "found boolean, quality double, lines array<int>").first()
    assert tuple(doc) == (True, 0.94, None)
    np.save(tmp_path / "envelope.npy", np.array([0.5, 1.5], np.float32))
    env = files.long_envelope(files.arrays(spark, str(tmp_path / "envelope.npy")))
    assert [(r.t, r.strength) for r in env.collect()] == [(0.0, 0.5), (0.005, 1.5)]


def test_library(spark, tmp_path):
    (tmp_path / "a.mp4").write_text("xx")
    (tmp_path / "b.mp4.part").write_text("x")
    path = spark.read.format("binaryFile").load(str(tmp_path / "a.mp4")).first().path
    used = spark.createDataFrame([(path, 7), (path, 3)], "path string, session_id long")
    rows = files.library(spark, str(tmp_path), used).collect()
    assert [(r.length, r.sessions) for r in rows] == [(2, [3, 7])]


def test_write_only_on_change(spark, tmp_path):
    kind = T.StructType([T.StructField("x", T.DoubleType())])
    path = str(tmp_path / "t")
    make = lambda *v: spark.createDataFrame([(x,) for x in v], kind)
    assert sinks.write_if_changed(make(None, math.nan), path)
    assert not sinks.write_if_changed(make(math.nan, None), path)
    assert sinks.write_if_changed(make(math.nan, math.nan), path)
    assert sinks.write_if_changed(make(math.nan), path)
    a, b = sinks.digest(make(None, math.nan)).first(), sinks.digest(make(math.nan, None)).first()
    assert tuple(a) == tuple(b) != tuple(sinks.digest(make(math.nan, math.nan)).first())


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "shots")
    make = lambda rows: spark.createDataFrame(rows, "session_id long, v int")
    sinks.replace_partitions(make([(1, 1), (1, 2), (2, 3)]), path)
    sinks.replace_partitions(make([(1, 9)]), path)
    assert sorted((r.session_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 9), (2, 3)]


def test_provenance_merge_and_json(spark, tmp_path):
    df = spark.createDataFrame([({"a": 1}, {"b": 2, "a": 3}), (None, {"a": 1}), ({"a": 1}, None)], "old map<string,int>, new map<string,int>")
    got = df.select(sinks.merge_document(F.col("old"), F.col("new")).alias("m")).collect()
    assert [r.m for r in got] == [{"a": 3, "b": 2}, {"a": 1}, {"a": 1}]
    assert sinks.with_provenance(spark.range(1), stage="hits", version="2").first().rallyplan_stage == "hits"
    sinks.as_json(spark.range(3), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert {(r.name, r.value) for r in sinks.metrics_long(spark.createDataFrame([(1, {"x": 2.0})], "id int, m map<string,double>"), "id", "m").collect()} == {("x", 2.0)}


def test_manifest(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b")], "key int, digest string")
    done = manifest.stamped(inputs, "hits", 3, {"x": 1, "y": 2})
    assert manifest.stale(manifest.stamped(inputs, "hits", 3, {"y": 2, "x": 1}), done).count() == 0
    assert manifest.stale(manifest.stamped(inputs, "hits", 4, {"y": 2, "x": 1}), done).count() == 2
    changed = spark.createDataFrame([(1, "a"), (2, "c")], "key int, digest string")
    assert [r.key for r in manifest.stale(manifest.stamped(changed, "hits", 3, {"y": 2, "x": 1}), done).collect()] == [2]


def test_pointer_chains_end(spark):
    """Long chains, a loop with a tail, a pointer to itself, one out of the table."""
    rows = [(1, None), (5, 6), (6, 5), (7, 6), (8, 7), (9, 9), (10, 999), (11, 10), *((i, i - 1) for i in range(101, 400)), (100, None)]
    got = {r.id: r.root for r in relational.chase(spark.createDataFrame(rows, "id long, into long"), "id", "into").collect()}
    assert got == {1: 1, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9, 10: 10, 11: 11} | dict.fromkeys(range(100, 400), 100)


HITS = [(1, i, t, s, k) for i, (t, s, k) in enumerate([(0.0, -1, "serve"), (1.0, 1, "forehand"), (5.5, 1, "forehand"), (10.0, -1, "backhand"), (13.0, 1, "forehand"), (14.0, -1, "serve"), (40.0, 1, "forehand")])]


@pytest.fixture
def stream(spark, tmp_path):
    kind = "session_id long, shot_id long, t double, side int, stroke string, hit_score double, at timestamp"
    df = spark.createDataFrame([(*r, 0.1 * r[1], None) for r in HITS], kind).withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long") + 1_704_067_200_000_000))
    for n, part in enumerate((df.where("t < 12"), df.where("t >= 12"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    return df, source, tmp_path


def drained(spark, out, tmp_path, name, mode):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stateful_stream_as_batch(spark, stream):
    df, source, tmp = stream
    got = sorted((r.rally, r.start_s, r.end_s, r.shot_count) for r in drained(spark, S.stateful_rallies(source), tmp, "full_rallies", "append").collect())
    batch = gaps.sessionize(df, ["session_id"], "t", "shot_id", "side", F.col("stroke") == "serve").groupBy("rally").agg(F.min("t"), F.max("t"), F.count("*"))
    want = sorted(tuple(r) for r in batch.collect())
    assert got == want[:-1]  # the last rally is still open


def test_fixed_gap_stream_as_batch(spark, stream):
    df, source, tmp = stream
    got = {(r.start_s, r.shot_count) for r in drained(spark, S.fixed_gap_rallies(source), tmp, "gap_rallies", "complete").collect()}
    assert got == {(0.0, 2), (5.5, 1), (10.0, 3), (40.0, 1)}


def test_slices_as_batch(spark, stream):
    df, source, tmp = stream
    got = {(r.start.second, r.n) for r in drained(spark, S.slices(source), tmp, "slices10", "complete").collect()}
    assert got == {(0, 3), (10, 3), (40, 1)}
