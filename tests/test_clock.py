"""One clock for a session's videos: lags out of sound, placement against a plain version."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyplan.operators import clock

VIDEOS = "id long, session_id long, recorded_s double, duration_s double"
LAGS = "session_id long, earlier long, later long, lag_s double, confidence double"


def plain(videos, lags, least=1.6):
    """{id: (offset, method, hangs on)} video by video."""
    out = {}
    for session in {v[1] for v in videos}:
        own = sorted((v for v in videos if v[1] == session), key=lambda v: (v[2] is None, v[2] or 0, v[0]))
        first = next((v[2] for v in own if v[2] is not None), None)
        placed, end = {}, 0.0
        for i, (key, _, recorded, seconds) in enumerate(own):
            best = None
            for other in placed:
                lag, sure = lags.get((other, key), (0, 0))
                if sure >= least and (best is None or sure > best[0]):
                    best = sure, placed[other][0] + lag, other
            if i == 0:
                placed[key] = (0.0, "creation_time", None)
            elif best:
                placed[key] = (best[1], "audio", best[2])
            else:
                placed[key] = (recorded - first if recorded is not None else end, "creation_time", None)
            end = max(end, placed[key][0] + (seconds or 0))
        least_offset = min(x[0] for x in placed.values())
        out |= {k: (round(x - least_offset, 4), "single" if len(own) == 1 else m, h) for k, (x, m, h) in placed.items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_placement_against_a_plain_version(spark, seed):
    pick = random.Random(seed)
    videos, lags = [], {}
    for session in range(25):
        ids = [session * 10 + j for j in range(pick.randrange(1, 7))]
        videos += [(i, session, pick.choice([None, float(pick.randrange(100))]), pick.choice([None, float(pick.randrange(60))])) for i in ids]
        lags |= {(a, b): (pick.randrange(-400, 400) / 8, pick.choice([0.0, 1.0, 1.6, 2.0, 2.0, 3.5])) for a in ids for b in ids if a != b and pick.random() < 0.6}
    rows = clock.place(spark.createDataFrame(videos, VIDEOS), spark.createDataFrame([(a // 10, a, b, *x) for (a, b), x in lags.items()], LAGS)).collect()
    assert {r.id: (r.offset_s, r.sync_method, r.hangs_on) for r in rows} == plain(videos, lags)


def test_sound_places_three_videos_to_a_hundredth_of_a_second(spark):
    """Two cameras that overlap a long one, one that hears something else, one without sound, one at another rate."""
    pick, rate = np.random.default_rng(4), 200.0
    full = pick.random(int(300 * rate)) * 0.05
    full[pick.integers(0, len(full), 300)] += 1 + pick.random(300)
    part = lambda start: full[int(start * rate) : int((start + 100) * rate)] + pick.random(int(100 * rate)) * 0.05
    sound = [(1, rate, 0.0, full), (2, rate, 0.5, part(37.215)), (3, rate, None, part(151.4)), (4, rate, 0.0, pick.random(int(90 * rate))), (6, 100.0, 0.0, full)]
    envelopes = spark.createDataFrame([(i, r, s, [float(x) for x in e]) for i, r, s, e in sound], "video_id long, rate double, start_s double, envelope array<float>")
    videos = spark.createDataFrame([(i, 1, None if i == 6 else 10.0 * i, 300.0 if i == 1 else 100.0) for i in range(1, 7)], VIDEOS)
    got = {r.id: r for r in clock.one_clock(videos, envelopes).collect()}
    assert abs(got[2].offset_s - (37.215 - 0.5)) < 0.01 and abs(got[3].offset_s - 151.4) < 0.01
    assert [got[i].sync_method for i in range(1, 7)] == ["creation_time", "audio", "audio", "creation_time", "creation_time", "creation_time"]
    assert (got[1].offset_s, got[4].offset_s, got[5].offset_s, got[6].offset_s) == (0.0, 30.0, 40.0, 300.0)


def test_each_pair_is_a_row_of_its_own_task(spark):
    videos = spark.createDataFrame([(i, 1, float(i), 10.0) for i in range(6)], VIDEOS)
    envelopes = spark.createDataFrame([(i, 50.0, 0.0, [0.0] * 10) for i in range(6)], "video_id long, rate double, start_s double, envelope array<float>")
    lags = clock.pair_lags(videos, envelopes)
    assert sorted((r.earlier, r.later) for r in lags.collect()) == [(a, b) for a in range(6) for b in range(a + 1, 6)]
    assert "hashpartitioning(session_id" in lags._jdf.queryExecution().executedPlan().toString()


def test_no_videos(spark):
    empty = clock.place(spark.createDataFrame([], VIDEOS), spark.createDataFrame([], LAGS))
    assert empty.count() == 0 and empty.columns == ["id", "session_id", "offset_s", "sync_method", "hangs_on"]


def test_shots_of_two_cameras_meet_on_the_clock_that_their_sound_gives(spark):
    """The stage takes envelopes: one shot that two cameras saw 5 s apart is one."""
    from rallyplan.plans.shots_stage import shots_stage

    t, rate = np.arange(2.0, 60.0, 3.7), 50.0
    noise = np.random.default_rng(1)
    clicks = lambda s: [float(x) for x in np.bincount(((t + s) * rate).astype(int), minlength=int(80 * rate)) + noise.random(int(80 * rate)) * 0.05]
    t = np.sort(noise.random(25)) * 60
    envelopes = spark.createDataFrame([(1, rate, 0.0, clicks(0)), (2, rate, 0.0, clicks(5))], "video_id long, rate double, start_s double, envelope array<float>")
    videos = spark.createDataFrame([(1, 7, None, 80.0), (2, 7, None, 80.0)], VIDEOS.replace("recorded_s", "recorded_s"))
    side = lambda i: -1 if i % 2 else 1
    hits = [(v * 100 + i, v, float(x + 5 * (v == 2)), side(i), 1 if i % 2 else 2, 0.5, ["sound"]) for v in (1, 2) for i, x in enumerate(np.arange(5.0, 25.0, 2.0))]
    h = spark.createDataFrame(hits, "hit_id long, video_id long, t double, side int, track long, score double, sources array<string>")
    people = spark.createDataFrame([(v, k, float(s) / 2 + 5 * (v == 2), 1.0, -11.0 if k == 1 else 11.0) for v in (1, 2) for k in (1, 2) for s in range(60)], "video_id long, track_id long, t double, court_x double, court_y double")
    motion = spark.createDataFrame([], "video_id long, track long, t double, kp_x array<double>, kp_y array<double>, kp_c array<double>, height double")
    ball = spark.createDataFrame([], "video_id long, t double, x double, y double")
    labels = spark.createDataFrame([(v, k, "AB"[k - 1]) for v in (1, 2) for k in (1, 2)], "video_id long, track_id long, label string")
    players = spark.createDataFrame([(7, "A", 1), (7, "B", 2)], "session_id long, label string, player_id long")
    shots, _, _ = shots_stage(h, people, motion, ball, labels, players, videos, envelopes=envelopes)
    rows = shots.collect()
    assert len(rows) == 10 and {r.views for r in rows} == {2} and sorted(round(r.t - 5, 1) for r in rows) == pytest.approx(np.arange(5.0, 25.0, 2.0), abs=0.1)
