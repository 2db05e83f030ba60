"""Stages and the read API, end to end on a small made-up library."""

import math

import numpy as np
from pyspark.sql import functions as F

from rallyplan import api, schema
from rallyplan.plans import stages


def make_video(spark, rng=np.random.default_rng(0)):
    """Twelve hits, by turns from both ends, each with a click and a fast wrist; near is track 1, far track 2."""
    times = np.concatenate([1 + 1.3 * np.arange(6), 20 + 1.3 * np.arange(6)])
    frames = np.arange(0, 32, 1 / 25)
    onsets = [(1, float(t), 1.0, -20.0, 10.0) for t in times] + [(1, float(t + 0.6), 1.0, -35.0, 4.0) for t in times[:3]]
    motion, people = [], []
    for track, side in ((1, -1), (2, 1)):
        own = times[::2] if side < 0 else times[1::2]
        wrist = np.zeros(len(frames))
        for h in own:
            wrist += 60 * np.tanh((frames - h) / 0.05)
        for f, t in enumerate(frames):
            kp_x = [100.0] * 17
            kp_x[10] = float(200 + wrist[f])
            motion.append((1, int(f), float(t), track, kp_x, [100.0] * 17, [0.9] * 17, 100.0))
            if f % 3 == 0 and (f or side < 0):
                people.append((1, int(f), float(t), track, 0.5 * side, 11.5 * side, [1.0, 0.0] if side < 0 else [0.0, 1.0]))
    o = spark.createDataFrame(onsets, "video_id long, t double, strength float, peak_db float, prominence_db float")
    m = spark.createDataFrame(motion, "video_id long, frame_idx long, t double, track int, kp_x array<float>, kp_y array<float>, kp_c array<float>, height float")
    p = spark.createDataFrame(people, "video_id long, frame_idx long, t double, track_id int, court_x float, court_y float, appearance array<float>")
    return times, o, m, p


def test_from_cues_to_score(spark):
    times, onsets, motion, people = make_video(spark)
    ball = spark.createDataFrame([], "video_id long, t double, x float, y float")
    sides = spark.createDataFrame([(1, 1, -1), (1, 2, 1)], "video_id long, track int, side int")
    hits = stages.detect_hits(onsets, ball, motion, sides).cache()
    rows = hits.orderBy("t").collect()
    assert len(rows) == 12 and np.abs(np.array([r.t for r in rows]) - times).max() < 0.1
    assert [r.side for r in rows] == [-1, 1] * 6 and all("audio" in r.sources for r in rows)
    videos = spark.createDataFrame([(1, 9, 100.0)], "id long, session_id long, offset_s double")
    labels = stages.session_identities(people, hits, videos)
    assert {(r.track_id, r.label, r.concurrent) for r in labels.collect()} == {(1, "A", 2), (2, "B", 2)}
    players = spark.createDataFrame([(9, "A", 50), (9, "B", 60)], "session_id long, label string, player_id long")
    numbered = hits.withColumn("hit_id", F.monotonically_increasing_id()).withColumn("stroke", F.lit("forehand")).cache()
    flights = numbered.select("hit_id", F.lit(1.0).alias("bounce_x"), (-F.col("side") * 5.0).alias("bounce_y"), F.lit(100.0).alias("speed_kmh"))
    shots = stages.build_shots(numbered, people, labels, players, videos, flights).cache()
    got = shots.orderBy("t").collect()
    assert len(got) == 12 and [r.player_id for r in got] == [50, 60] * 6 and got[0].t > 100
    assert [r.stroke for r in got].count("serve") == 2 and {r.serve_by for r in got} == {None, "position"}
    assert [r.rally for r in got] == [0] * 6 + [1] * 6 and all(r.in_court for r in got)
    kinds = stages.session_kinds(shots).first()
    assert (kinds.kind, kinds.serves, kinds.kind_confidence) == ("unknown", 0, 0.5)
    score = stages.match_scores(shots, players).orderBy("rally").collect()
    assert [r.server for r in score] == [50, 50] and score[0].score_before == "0-0, 0-0" and score[0].how == "winner"
    s = {r.player_id: r for r in stages.summaries(shots).collect()}
    assert s[50].shots == 6 and s[50].by_stroke == {"serve": 2, "forehand": 4} and s[50].in_pct == 1.0
    assert stages.profiles(shots).where("player_id = 60 AND stroke = 'forehand'").first().n == 6


def test_read_api(spark, tmp_path):
    root = str(tmp_path)
    put = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{root}/{name}")
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    put("session", [(1, "match", day(2), day(5)), (2, "training", day(9), None)], "id long, kind string, created_at timestamp, recorded_at timestamp")
    put("job", [(1, 1, "failed", 0.1), (2, 1, "done", 1.0)], "id long, session_id long, status string, progress double")
    put("player", [(1, "Ann", None), (2, "Player 2", 1)], "id long, name string, merged_into long")
    put("session_player", [(1, 1, "A"), (2, 1, "A")], "session_id long, player_id long, label string")
    put("rally", [(1, 1, 1, 0.0), (2, 1, 0, 0.0)], "id long, session_id long, index long, start_s double")
    put("shot", [(1, 1, 1, 5.0, "serve", 0.0, 6.4, False, None), (2, 1, 1, 6.0, "forehand", None, None, None, False)], "id long, session_id long, player_id long, t double, stroke string, bounce_x double, bounce_y double, in_court boolean, crosses_net boolean")
    put("shot_metric", [(1, "recovery_m", 1.5)], "shot_id long, name string, value double")
    lib = api.Library(spark, root)
    assert [(r.id, r.job_status) for r in lib.sessions().collect()] == [(2, None), (1, "done")]
    assert [(r.outcome, r.metrics) for r in lib.shots(1).collect()] == [("out", {"recovery_m": 1.5}), ("net", None)]
    assert [r.id for r in lib.rallies(1).collect()] == [2, 1]
    assert [r.session_id for r in lib.player(2).collect()] == [1, 2]
    assert [(r.id, r.shots, r.strokes) for r in lib.players().collect()] == [(1, 2, {"forehand": 1, "serve": 1})]


def test_track_slices(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, t, x, y, k) for t, x, y, k in [(0.0, 100.4, 50.0, 1), (0.5, 110.6, 51.0, 1), (9.99, 120.0, 52.0, 1), (10.0, 130.0, 53.0, 2), (12.0, 140.0, 54.0, 2)]], "video_id long, t double, x float, y float, track int").write.parquet(f"{root}/ball")
    kp, conf = [10.0] * 16 + [math.nan], [0.9] * 17
    conf[1] = 0.1
    spark.createDataFrame([(1, 12.0, 3, kp, kp, conf), (1, 1.0, 3, kp, kp, conf)], "video_id long, t double, track int, kp_x array<float>, kp_y array<float>, kp_c array<float>").write.parquet(f"{root}/motion")
    spark.createDataFrame([(1, 1.0, 3, 900.0, 800.0, 1.234, -11.0), (1, 2.0, 3, 910.0, 805.0, math.nan, math.nan)], "video_id long, t double, track_id int, foot_px float, foot_py float, court_x float, court_y float").write.parquet(f"{root}/people")
    ball, pose, feet = api.Library(spark, root).tracks(1, 0, 10)
    assert [tuple(r) for r in ball.collect()] == [(0.0, 100, 50, 1), (0.5, 111, 51, 1), (9.99, 120, 52, 1)]
    only = pose.collect()
    assert len(only) == 1 and only[0].kp_x == [10, None, *[10] * 14, None]
    assert [tuple(r) for r in feet.collect()] == [(1.0, 3, 900, 800, 1.23, -11.0), (2.0, 3, 910, 805, None, None)]


def test_evaluation(spark):
    labels = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0)], "v long, label_id long, t double")
    found = spark.createDataFrame([(1, 1, 10.1), (1, 2, 20.9), (1, 3, 25.0), (1, 4, 99.0)], "v long, found_id long, t double")
    r = api.evaluate_hits(labels, found, "v", offset=0.0, resolution=1.0).first()
    assert (r.labels, r.detections, r.matched) == (3, 3, 2)
    points = spark.createDataFrame([(1, 5.0, "0-0, 0-0"), (1, 50.0, "1-2, 15-0")], "v long, t double, score string")
    checks = spark.createDataFrame([(1, 40.0, 2, 1), (1, 60.0, 6, 3)], "v long, t double, self int, other int")
    final = spark.createDataFrame([(1, "3-6")], "v long, final string")
    e = api.evaluate_games(points, checks, final, "v").first()
    assert (e.checkpoints, e.exact, e.error_games, e.self_first) == (2, 2, 0.0, False)


def test_contracts_name_each_column_once():
    for s in (schema.PEOPLE, schema.SHOT, schema.HITS, schema.RALLY):
        assert len(set(s.names)) == len(s.names)


def test_whole_profiles_of_a_few_shots(spark):
    """Least support, sessions without a date first, technique as a map, rules."""
    from rallyplan.plans.profile_stage import player_profiles

    rows = [(s, 10 * s + i, 7, "forehand" if i % 2 else "serve", 100.0 + i, i % 3 > 0, 0.5, 1.0) for s in (1, 2, 3) for i in range(8 if s < 3 else 2)]
    shots = spark.createDataFrame(rows, "session_id long, shot_id long, player_id long, stroke string, speed_kmh double, in_court boolean, net_clearance_m double, contact_height_m double")
    metrics = spark.createDataFrame([(r[1], n, v) for r in rows if r[0] < 3 for n, v in (("knee_bend_deg", 120.0 + r[1]), ("elbow_contact_deg", 150.0))], "shot_id long, name string, value double")
    sessions = spark.createDataFrame([(1, 50.0, "match"), (2, None, None), (3, 20.0, "practice"), (4, 1.0, "match")], "session_id long, recorded_s double, kind string")
    of = {k: v.collect() for k, v in player_profiles(shots, metrics, sessions).items()}
    assert [(r.session_id, r.kind) for r in sorted(of["trend"], key=lambda r: r.place)] == [(2, None), (3, "practice"), (1, "match")]
    first = {r.session_id: r for r in of["trend"]}
    assert first[1].forehand_kmh == 104.0 and first[3].forehand_kmh is None and first[1].in_pct == 0.625 and first[3].in_pct is None and first[3].knee_bend_deg is None
    assert {r.name: (r.n, r.median) for r in of["technique"]} == {"knee_bend_deg": (16, 138.5), "elbow_contact_deg": (16, 150.0)}
    strokes = {r.stroke: r for r in of["strokes"]}
    assert strokes["forehand"].technique == {"elbow_contact_deg": 150.0, "knee_bend_deg": 139.0} and strokes["serve"].n == 9 and strokes["serve"].n_in == 9
    assert {r.text for r in of["insights"]} >= {"Serve speed"} and all(r.player_id == 7 for r in of["insights"])
