"""Onsets and tracklets: the same for any cut into chunks and triggers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyplan.operators import onsets as O
from rallyplan.operators.tracking import BallLinker, link_ball
from rallyplan.streaming.onsets import ball_stream, onset_stream

CHUNKS = "video_id long, start long, samples array<double>"
HOP = 16


def sound(seed, n=1500):
    pick = np.random.default_rng(seed)
    x = pick.normal(0, 0.01, n)
    for at in pick.integers(0, n - 40, 6):
        x[at : at + 30] += pick.normal(0, 1, 30) * pick.uniform(0.2, 2)
    return x.tolist()


def cut(x, pick, most):
    out, at = [], 0
    while at < len(x):
        n = pick.randrange(1, most)
        out.append((at, x[at : at + n]))
        at += n
    return out


def plain(x, hop=HOP):
    """Frames, strengths and thresholds of onsets, from the whole sound."""
    d = np.diff(np.array(x), prepend=x[0])
    level = np.array([O._rounded(10 * np.log10(max(float(np.mean(d[a : a + hop] ** 2)), 1e-12))) for a in range(0, len(d), hop)])
    s = np.array([O._rounded(v) for v in np.maximum(np.diff(level, prepend=level[0]), 0)])
    out = []
    for i, v in enumerate(s):
        around = s[max(0, i - O.HALF) : i + O.HALF + 1]
        t = np.median(around) + O.K * max(np.median(np.abs(around - np.median(around))), O.LEAST_MAD)
        if v > t and all(v > y for y in s[max(0, i - O.APART) : i]) and all(v >= y for y in s[i + 1 : i + 1 + O.APART]):
            out.append((i, v, O._rounded(t)))
    return out


@pytest.mark.parametrize("most", [2, 7, 40, 333, 5000])
def test_chunks_of_any_length(spark, most):
    rows, want = [], []
    for v in range(4):
        x = sound(v)
        rows += [(v, a, part) for a, part in cut(x, random.Random(v), most)]
        want += [(v, *o) for o in plain(x)]
        picker = O.Picker(HOP)
        told = [o for a, part in cut(x, random.Random(v + 9), most) for o in picker.feed(a, part)] + list(picker.close())
        assert [o[0] for o in told] == [o[0] for o in plain(x)] and np.allclose(np.array(told), np.array(plain(x)), atol=2e-6)
    got = sorted(map(tuple, O.onsets(O.levels(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), CHUNKS), HOP)).collect()))
    assert len(want) > 10 and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose(np.array(got), np.array(want), atol=2e-6)


def test_odd_sound(spark):
    rows = [(1, 0, [None, None, 1.0, None]), (1, 4, []), (2, 0, [0.0] * 500), (3, 1000, [0.5] * 64), (3, 2000, [1.5] * 64)]
    levels = O.levels(spark.createDataFrame(rows, CHUNKS), HOP)
    assert sorted(r.frame for r in levels.where("video_id = 3").collect()) == [62, 63, 64, 65, 66, 125, 126, 127, 128]
    assert {r.level_db for r in levels.where("video_id > 1").collect()} == {-120.0}  # after a gap the first difference is zero
    assert O.onsets(levels).where("video_id > 1").count() == 0 and O.onsets(levels.limit(0)).count() == 0


def drained(spark, frame, stream, tmp_path, triggers, name):
    for n, part in enumerate(triggers):
        frame.where(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:03d}"))
    source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = stream(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name).collect()


@pytest.mark.parametrize("edges", [[1600], [200, 640, 650, 1600]])
def test_onset_stream_as_batch(spark, tmp_path, edges):
    rows = [(v, a, part, a + len(part) == 1500) for v in (1, 2) for a, part in cut(sound(v), random.Random(v), 90)]
    frame = spark.createDataFrame(rows, f"{CHUNKS}, last boolean")
    triggers = [f"start >= {a} AND start < {b}" for a, b in zip([0, *edges], edges)]
    got = drained(spark, frame, lambda s: onset_stream(s, HOP), tmp_path, triggers, f"onsets{len(edges)}")
    want = [(v, *o) for v in (1, 2) for o in plain(sound(v))]
    assert sorted((r.video_id, r.frame) for r in got) == [w[:2] for w in want]


def candidates(seed, n=60):
    """Two balls that cross, noise, and frames without any."""
    pick, out = random.Random(seed), {}
    for f in range(n):
        own = [(10.0 * f, 300 + 4.0 * f, 0.9, False), (600 - 9.0 * f, 50 + 6.0 * f, 0.7, False)] if f % 11 else []
        own += [(pick.uniform(0, 640), pick.uniform(0, 480), pick.random(), pick.random() < 0.3) for _ in range(pick.randrange(3))]
        out[f] = pick.sample(own, len(own))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_linker_goes_on_after_any_frame(seed):
    frames = candidates(seed)
    pick, linker, done = random.Random(seed), BallLinker(3), []
    for f in sorted(frames):
        done += linker.frame(f, frames[f])
        if pick.random() < 0.3:
            linker = BallLinker.restored(linker.saved())
    done += linker.close()
    want = link_ball(frames, 3)
    assert len(want) >= 2 and [(k.id, k.frames, k.xy) for k in done if k.usable] == [(k.id, k.frames, k.xy) for k in want]


@pytest.mark.parametrize("edges", [[60], [1, 17, 44, 60]])
def test_ball_stream_as_batch(spark, tmp_path, edges):
    rows = [(v, f, f == 59, [tuple(c) for c in own]) for v in (1, 2) for f, own in candidates(v).items()]
    frame = spark.createDataFrame(rows, "video_id long, frame long, last boolean, candidates array<struct<x: double, y: double, score: double, on_person: boolean>>")
    triggers = [f"frame >= {a} AND frame < {b}" for a, b in zip([0, *edges], edges)]
    got = drained(spark, frame, lambda s: ball_stream(s, 3), tmp_path, triggers, f"balls{len(edges)}")
    want = [(v, k.id, f, *xy) for v in (1, 2) for k in link_ball(candidates(v), 3) for f, xy in zip(k.frames, k.xy)]
    assert sorted((r.video_id, r.tracklet, r.frame, r.x, r.y) for r in got) == sorted(want)
