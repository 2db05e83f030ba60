"""What showed up only on larger tables: sums whose order decides, folders, shuffles, files."""

import datetime
import random
from pathlib import Path

import numpy as np
import oracle
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G
from rallyplan.functions.signals import find_lag
from rallyplan.operators import clock
from rallyplan.operators import stretches as S
from rallyplan.plans import registry
from rallyplan.plans.clock_queries import made_up_sound
from rallyplan.session import checkpoint_folder
from rallyplan.sources import sinks, tracking

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def events(spark, tmp_path, ids, user=lambda i: 1):
    """An events table in order of its ids, ten minutes apart; its folder."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=10 * k), user(i), "view", 1.0) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("descending", [False, True])
def test_a_mean_at_the_limit_is_that_of_the_sum_in_order(spark, tmp_path, monkeypatch, descending):
    """Six scores with mean 0.15: added in order of shot_id they are over it, the other way round not."""
    sf = events(spark, tmp_path, [1622, 2116, 2472, 2626, 3424, 3430])
    real = tracking.table
    monkeypatch.setattr(tracking, "table", lambda s, d, t: real(s, d, t).coalesce(1).sortWithinPartitions("event_id", ascending=not descending))
    con = oracle.connection("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    assert oracle.compare("strongest_tracklet", registry.QUERIES["strongest_tracklet"](spark, sf), con, registry.ORACLES["strongest_tracklet"]) == 1


def written(folder):
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file())


def test_sound_is_neither_written_nor_copied_for_each_pair(spark):
    """45 envelopes of 60 KB: none in the checkpoint folder, none behind a shuffle; in the operator one row of three for three videos."""
    before = written(checkpoint_folder(spark))
    registry.QUERIES["session_clock"](spark, "/root/testdata/sf0.001").collect()
    assert written(checkpoint_folder(spark)) - before < 500_000
    lags = clock.lags_within(made_up_sound(spark, "/root/testdata/sf0.001"))
    assert lags._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[0].count("Exchange") == 0
    videos = spark.createDataFrame([(i, i // 3, float(i), 10.0) for i in range(6)], "id long, session_id long, recorded_s double, duration_s double")
    envelopes = spark.createDataFrame([(i, 50.0, 0.0, [0.0] * 10) for i in range(6)], "video_id long, rate double, start_s double, envelope array<float>")
    assert sorted(sorted(r.ids) for r in clock.gathered(videos, envelopes).collect()) == [[0, 1, 2], [3, 4, 5]]


def test_lags_of_many_videos_are_those_of_each_pair(spark):
    """Nine videos are three blocks: every pair comes once, as find_lag has it; other rates and missing sound have none."""
    pick, rate = np.random.default_rng(8), 20.0
    full = (pick.random(4000) < 0.03) + pick.random(4000) * 0.05
    sound = {i: (full[150 * i : 150 * i + 1500] + pick.random(1500) * 0.05).astype(np.float32) for i in range(9)}
    videos = spark.createDataFrame([(i, 5, float(i), 75.0) for i in range(12)], "id long, session_id long, recorded_s double, duration_s double")
    rows = [(i, rate, i / 4, e.tolist()) for i, e in sound.items()] + [(9, 30.0, 0.0, [0.0] * 1500), (10, rate, 0.0, None), (11, None, 0.0, [0.0] * 9)]
    got = clock.pair_lags(videos, spark.createDataFrame(rows, "video_id long, rate double, start_s double, envelope array<float>")).collect()
    want = {(a, b): find_lag(sound[a], sound[b], rate) for a in range(9) for b in range(a + 1, 9)}
    assert len(got) == len(want) and sum(x[1] > 0 for x in want.values()) > 20
    assert {(r.earlier, r.later): (r.lag_s, r.confidence) for r in got} == {(a, b): (by + (a / 4 - b / 4), sure) for (a, b), (by, sure) in want.items()}


def test_slices_of_many_videos_have_a_folder_for_each_slice(spark, tmp_path, monkeypatch):
    """40 videos with six slices: 240 folders before."""
    monkeypatch.setattr(sinks, "FOLDERS", 100, raising=False)
    rows = [(v, t * 2.5, v * t) for v in range(40) for t in range(24)]
    sinks.write_slices(spark.createDataFrame(rows, "video_id long, t double, x long"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == [f"slice={k}" for k in range(6)]
    part = sinks.read_slices(spark, str(tmp_path / "s"), F.col("video_id") % 3 == 1, 12.5, 37.25)
    assert sorted((r.video_id, r.t, r.x) for r in part.collect()) == [x for x in rows if x[0] % 3 == 1 and 12.5 <= x[1] < 37.25]
    assert {r.f.split("slice=")[1][0] for r in part.select(F.input_file_name().alias("f")).distinct().collect()} == {"1", "2", "3"}


def test_replaced_sessions_have_no_folder_each(spark, tmp_path):
    """60 sessions: 61 folders before."""
    folder = Path(checkpoint_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("*"))
    sf = events(spark, tmp_path, range(240), lambda i: i // 4)
    rows = registry.QUERIES["replaced_sessions"](spark, sf).collect()
    assert sorted((r.session_id, r.shot_id, r.state) for r in rows) == [(i // 4, i, "new" if i // 4 % 2 == 0 else "old") for i in range(240)]
    assert sum(p.is_dir() for p in set(folder.rglob("*")) - before) < 20


@pytest.mark.parametrize("name, explodes", [("stroke_classes", 1), ("technique_measures", 2)])
def test_swing_samples_are_made_once_and_not_shuffled(spark, name, explodes):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == explodes and "ObjectHashAggregate" not in plan
    above = plan.split("MapInArrow")[1].split("Generate")[0]
    assert "Window" in above and "Exchange" not in above


@pytest.mark.parametrize("rows_a_batch", ["7", "10000"])
def test_stretches_are_as_sparks_own_aggregates(spark, rows_a_batch):
    """Random samples with null and NaN, a swing of nulls and one of a single sample; batches that end within swings."""
    pick = random.Random(11)
    number = lambda: pick.choice([None, float("nan"), *[pick.uniform(-50, 50)] * 30])
    rows = [(h, k / 30.0, *(None if h == 5 else number() for _ in range(6))) for h in range(20) for k in range(-21, 10 if h != 6 else -20)]
    pick.shuffle(rows)
    s = spark.createDataFrame([*rows, (None, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "hit_id long, rel double, ax double, ay double, bx double, by double, cx double, cy double")
    names = ["ax", "ay", "bx", "by", "cx", "cy"]
    moments = (-0.5, -0.3, 0.15, 0.25)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        wanted = {"m": S.Mean("ax", -0.2, 0.05), "t": S.Top("by", -0.3, 0.15), "b": S.Bend((tuple(names),), -0.45, 0.0, 0.1, 4), "p": S.Pace("ax", "ay", -0.35, 0.05, 0.9, 3), "w": S.Turn("ax", "ay", "bx", "by", moments, 0.03, -0.05, 0.1)}
        got = {r.hit_id: r for r in S.by_swing(s, {n: F.col(n) for n in names}, wanted).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    w = Window.partitionBy("hit_id").orderBy("rel").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("rel").between(-0.35, 0.05) & F.col("ax").isNotNull(), F.struct(F.col("rel").alias("t"), "ax", "ay"))
    r = s.withColumn("at", at).withColumn("was", F.last("at", ignorenulls=True).over(w))
    r = r.withColumn("pace", F.sqrt((F.col("at.ax") - F.col("was.ax")) ** 2 + (F.col("at.ay") - F.col("was.ay")) ** 2) / F.greatest(F.col("at.t") - F.col("was.t"), F.lit(1e-3)))
    angle = F.when(F.col("rel").between(-0.45, 0.0), G.angle(*map(F.col, names)))
    width = lambda m: F.hypot(*[F.avg(F.when(F.abs(F.col("rel") - m) <= 0.03, F.col(f"b{a}"))) - F.avg(F.when(F.abs(F.col("rel") - m) <= 0.03, F.col(f"a{a}"))) for a in "xy"])
    want = r.groupBy("hit_id").agg(
        F.avg(F.when(F.abs(F.col("rel") + 0.2) <= 0.05, F.col("ax"))).alias("m"), F.max(F.when(F.col("rel").between(-0.3, 0.15), F.col("by"))).alias("t"),
        F.when(F.count(angle) >= 4, F.percentile(angle, F.lit(0.1))).alias("b"), F.when(F.count("at") >= 3, F.percentile("pace", F.lit(0.9))).otherwise(0.0).alias("p"), *[width(m).alias(f"w{i}") for i, m in enumerate(moments)],
    )
    early = [f"w{i}" for i in (0, 1)]
    want = want.withColumns({"w_n": F.size(F.array_compact(F.array(*early))).cast("double"), "w_drawn": F.least(*early), "w_turned": F.greatest("w2", "w3")}).collect()
    assert len(got) == len(want) == 21
    for x in want:
        for c in ("m", "t", "b", "p", "w_n", "w_drawn", "w_turned"):
            a, b = got[x.hit_id][c], x[c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, nan_ok=True, abs=1e-9)), (x.hit_id, c, a, b)
