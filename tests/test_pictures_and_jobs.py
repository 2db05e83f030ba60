"""Backgrounds, looks, sliced tables, and the job queue against plain versions."""

import colorsys
import datetime
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyplan.operators import pictures as P
from rallyplan.session import checkpoint_folder
from rallyplan.sources import sinks
from rallyplan.streaming import jobs as Q


def test_background_is_the_median_of_each_pixel(spark):
    pick = np.random.default_rng(1)
    frames = [(v, pick.integers(0, 256, 12).tolist()) for v in (1, 2) for _ in range(7 + v)]
    frames.append((1, [None] * 12))
    got = {r.video: r.background for r in P.background(spark.createDataFrame(frames, "video long, pixels array<int>"), ["video"], "pixels").collect()}
    for v in (1, 2):
        assert got[v] == np.median([f for w, f in frames if w == v and f[0] is not None], axis=0).astype(np.uint8).tolist()


def test_hues_are_those_of_the_colours(spark):
    pick = random.Random(2)
    colours = [(0, 0, 0), (255, 255, 255), (0, 0, 255), (0, 255, 0), (255, 0, 0), (10, 10, 11)] + [tuple(pick.randrange(256) for _ in range(3)) for _ in range(200)]
    got = spark.createDataFrame(colours, "b int, g int, r int").select("b", "g", "r", *[c.alias(n) for n, c in zip("hsv", P.hsv(F.col("b"), F.col("g"), F.col("r")))]).collect()
    for x in got:
        h, s, v = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        assert x.v == round(v * 255) and abs(x.s - s * 255) <= 0.5 + 1e-9 and (abs(x.h - h * 180) <= 0.5 + 1e-9 or abs(x.h + 180 - h * 180) <= 0.5 + 1e-9)


def test_looks(spark):
    red, dark, grey = (0, 0, 200), (5, 10, 20), (120, 120, 125)
    rows = [(1, [red] * 6 + [dark] * 2 + [grey] * 2), (2, [red] * 3), (3, []), (4, None), (5, [red] * 4 + [(None, 1, 2)])]
    crops = spark.createDataFrame(rows, "track long, pixels array<struct<b: int, g: int, r: int>>")
    got = {r.track: r.look for r in P.looks(crops, "track").collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(len(x) == P.LOOK for x in got.values())
    assert got[1][3] == 0.6 and got[1][-2:] == [0.2, 0.2] and abs(sum(got[1]) - 1) < 1e-12
    assert got[2] == got[3] == got[4] == [0.0] * P.LOOK and got[5][3] == 1.0
    assert P.looks(crops.limit(0), "track").count() == 0


def test_a_slice_opens_its_own_folders(spark):
    path = f"{checkpoint_folder(spark)}/slices-{uuid.uuid4().hex}"
    rows = [(v, t / 2, v * t) for v in (1, 2, 3) for t in range(120)]
    sinks.write_slices(spark.createDataFrame(rows, "video_id long, t double, x long"), path)
    part = sinks.read_slices(spark, path, F.col("video_id") == 2, 12.0, 20.0)
    assert sorted(r.t for r in part.collect()) == [t / 2 for t in range(24, 40)]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(video_id" in plan and "slice" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    files = {r.f for r in part.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 1 and "video_id=2/slice=1" in files.pop()


def instant(s):
    return datetime.datetime.fromtimestamp(1_704_067_200 + s, datetime.timezone.utc).replace(tzinfo=None)


def plain(events, end):
    """[(job, at, kind, worker, progress)] -> rows to tell, by one pass over each job's events and a last look at its lease."""
    out = []
    for job in sorted({e[0] for e in events}):
        status, holder, tries, until, told, share = None, None, 0, 0.0, -1e18, 0.0
        for _, at, kind, worker, progress in sorted((e for e in events if e[0] == job), key=lambda e: (e[1], Q.ORDER.index(e[2]))) + [(job, end, "end", None, None)]:
            if status == "running" and at > until:
                status, holder, tries, share, told = "queued", None, tries + 1, 0.0, until
                out.append((job, until, status, holder, tries, share))
            before = status, share
            if kind == "queued" and status is None:
                status, tries = "queued", 1
            elif kind == "claimed" and status == "queued":
                status, holder, until = "running", worker, at + 30
            elif kind == "cancelled" and status in ("queued", "running"):
                status = "cancelled"
            elif status == "running" and worker == holder and kind == "progress":
                until = at + 30
                if progress is not None:
                    share = progress
                    if at - told >= 0.5:
                        told = at
                        out.append((job, at, status, holder, tries, share))
                continue
            elif status == "running" and worker == holder and kind in ("done", "failed"):
                status, share = kind, 1.0 if kind == "done" else share
            if (status, share) != before or (kind == "claimed" and before[0] == "queued"):
                told = at
                out.append((job, at, status, holder, tries, share))
    return sorted(out, key=str)


def crash_scenario(seed):
    """Workers that claim jobs, tell progress every quarter second, and now and then vanish."""
    pick, events = random.Random(seed), []
    for job in range(12):
        at = float(pick.randrange(20))
        events.append((job, at, "queued", None, None))
        for _ in range(pick.randrange(1, 4)):
            worker = f"w{pick.randrange(3)}"
            at += pick.randrange(1, 8) / 4
            events.append((job, at, "claimed", worker, None))
            for k in range(pick.randrange(6)):
                at += 0.25
                events.append((job, at, "progress", pick.choice([worker, worker, worker, "thief"]), pick.choice([k / 8, None])))
            if pick.random() < 0.4:
                events.append((job, at + 0.25, pick.choice(["done", "failed", "cancelled"]), worker, None))
                break
            at += 31.0  # lost
    return events


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 3), (3, 6)])
def test_lost_workers_lose_their_leases(spark, tmp_path, seed, parts):
    events = crash_scenario(seed)
    events += [(99, 500.0, "queued", None, None), (99, 600.0, "cancelled", None, None)]  # time goes on
    frame = spark.createDataFrame([(j, instant(at), k, w, p) for j, at, k, w, p in events], Q.EVENTS)
    edges = np.linspace(0, 400, parts + 1)[1:-1].tolist() + [400.0, 550.0, 1000.0]
    for n, (a, b) in enumerate(zip([-1.0, *edges], edges)):
        frame.where((F.col("at") >= F.lit(instant(a))) & (F.col("at") < F.lit(instant(b)))).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03d}"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = Q.job_statuses(source).writeStream.format("memory").queryName(f"jobs{seed}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted(((r.job_id, r.at_s - 1_704_067_200, r.status, r.worker, r.attempt, r.progress) for r in spark.table(f"jobs{seed}").collect()), key=str)
    want = plain(events, 600.0)
    assert got == want and any(r[4] > 1 for r in got) and {r[2] for r in got} >= {"queued", "running"}


def test_progress_is_told_twice_a_second_at_most():
    job, told = Q.Job(), []
    for at, kind, progress in [(0, "queued", None), (1, "claimed", None), *[(1 + k / 10, "progress", k / 50) for k in range(1, 40)], (6, "done", None)]:
        told += list(job.take(float(at), kind, "w", progress))
    steps = [t[0] for t in told if t[1] == "running"]
    assert min(np.diff(steps)) >= Q.TELL_S - 1e-9 and len(steps) == 8 and told[-1][1:] == ("done", "w", 1, 1.0)
