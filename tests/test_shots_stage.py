"""The whole shots stage on made-up poses and flights."""

import numpy as np
from test_models import camera, pose

from rallyplan.functions import physics
from rallyplan.operators import swings
from rallyplan.plans import shots_stage

FRAMES = np.arange(0, 9, 1 / 30)
HITS = [(1, 1, 1.0, -1), (2, 2, 2.3, 1), (3, 1, 3.6, -1), (4, 2, 4.9, 1)]


def made_up(spark):
    """Two players hit by turns; near ones (track 1) serve first, then play a forehand, far ones (track 2) backhands."""
    motion = []
    for track in (1, 2):
        kp = np.zeros((len(FRAMES), 17, 3))
        for n, (hit, own, t, _) in enumerate(HITS):
            if own != track:
                continue
            part = (FRAMES > t - 0.65) & (FRAMES <= t + 0.65)
            rel = FRAMES[part] - t
            if n == 0:
                figure = pose(rel, r_wrist=lambda x: (10, -130))
            else:  # near to the right of the picture; the far player's right is the picture's left
                figure = pose(rel, r_wrist=lambda x: (40 - 150 * x, -60 - 120 * x), l_wrist=lambda x: (-15 - 150 * x, -45))
            kp[part] = figure
        motion += [(1, k, float(t), track, kp[k, :, 0].tolist(), kp[k, :, 1].tolist(), kp[k, :, 2].tolist(), 100.0) for k, t in enumerate(FRAMES)]
    people = [(1, k, float(t), track, 0.5, y) for track, y in ((1, -11.0), (2, 11.0)) for k, t in enumerate(FRAMES)]
    cam, ball, flown = camera(), [], {}
    for hit, _, t, side in HITS:
        place, speed = np.array([0.5, side * 11.0, 2.6 if hit == 1 else 1.0]), np.array([0.5, -side * (30.0 if hit == 1 else 24.0), 0.5 if hit == 1 else 4.0])
        path, _, _ = physics.fly(place[None], speed[None], 1.3)
        seen = FRAMES[(FRAMES > t + 0.03) & (FRAMES < t + 1.2)]
        px = cam.project(path[0, np.round((seen - t) / physics.STEP_S).astype(int)])
        ball += [(1, float(a), float(x), float(y)) for a, (x, y) in zip(seen, px, strict=True)]
        flown[hit] = float(np.linalg.norm(speed) * 3.6)
    k = np.array([[1400.0, 0, 960], [0, 1400.0, 540], [0, 0, 1]])
    h = k @ np.column_stack([cam.rotation[:, 0], cam.rotation[:, 1], cam.shift])
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    return (
        frame([(i, 1, track, t, side, 0.9, ["audio"]) for i, track, t, side in HITS], "hit_id long, video_id long, track int, t double, side int, score double, sources array<string>"),
        frame(people, "video_id long, frame_idx long, t double, track_id int, court_x float, court_y float"),
        frame(motion, "video_id long, frame_idx long, t double, track int, kp_x array<float>, kp_y array<float>, kp_c array<float>, height float"),
        frame(ball, "video_id long, t double, x double, y double"),
        frame([(1, 1, "A"), (1, 2, "B")], "video_id long, track_id int, label string"),
        frame([(9, "A", 50), (9, "B", 60)], "session_id long, label string, player_id long"),
        frame([(1, 9, 100.0)], "id long, session_id long, offset_s double"),
        frame([(1, (h / h[2, 2]).ravel().tolist(), 1920, 1080)], "video_id long, homography array<double>, width int, height int"),
    ), flown


def test_from_hits_to_shots(spark):
    (hits, people, motion, ball, labels, players, videos, cameras), flown = made_up(spark)
    shots, metrics, hands = shots_stage.shots_stage(hits, people, motion, ball, labels, players, videos, cameras)
    rows = shots.orderBy("t").collect()
    assert [(r.shot_id, r.stroke, r.player_id, r.rally, r.pos) for r in rows] == [(1, "serve", 50, 0, 0), (2, "backhand", 60, 0, 1), (3, "forehand", 50, 0, 2), (4, "backhand", 60, 0, 3)]
    assert [r.spin for r in rows] == [None, "topspin", "topspin", "topspin"] and [r.serve_by for r in rows] == ["swing", None, None, None]
    assert all(abs(r.speed_kmh - flown[r.shot_id]) < 0.08 * flown[r.shot_id] and r.crosses_net and r.flight_rms_px < 4 for r in rows)
    assert rows[2].in_court and rows[2].depth in ("mid", "deep") and {r.views for r in rows} == {1}
    told = {(r.shot_id, r.name) for r in metrics.collect()}
    assert {(i, "knee_bend_deg") for i in (1, 2, 3, 4)} <= told and hands.count() == 0
    votes = {r.hit_id: r.vote for r in swings.cues(swings.around_hits(hits, motion)).collect()}
    assert votes == {1: "right", 2: None, 3: None, 4: None}
    bare, _, _ = shots_stage.shots_stage(hits, people, motion, ball, labels, players, videos)
    assert {(r.speed_kmh, r.in_court) for r in bare.collect()} == {(None, None)}


def test_racket_hands_need_votes(spark):
    votes = [("a", "left")] * 4 + [("a", "right")] * 2 + [("b", "right")] * 2 + [("c", "left"), ("c", "right"), ("c", None), ("c", "left"), ("c", "right")] + [("d", "right")] * 3
    got = {r.p: r.hand for r in swings.racket_hands(spark.createDataFrame(votes, "p string, vote string"), ["p"]).collect()}
    assert got == {"a": "left", "b": None, "c": None, "d": "right"}


def test_two_cameras_see_one_shot(spark):
    rows = [(9, 1, 1, 10.0, "A", "forehand", 0.9, ["audio"], 90.0, -5.0, 0, 0), (9, 2, 2, 10.1, "A", "unknown", 0.8, ["pose"], None, -5.0, 0, 1), (9, 3, 1, 12.0, "B", "backhand", 0.9, ["audio"], None, 5.0, 0, 2), (8, 4, 3, 1.0, "A", "serve", 0.9, ["audio"], None, 5.0, 0, 0)]
    kind = "session_id long, shot_id long, video_id long, t double, label string, stroke string, score double, sources array<string>, speed_kmh double, hit_y double, rally long, pos long"
    got = [(r.shot_id, r.sources, r.rally, r.pos, r.views) for r in shots_stage.one_view(spark.createDataFrame(rows, kind)).orderBy("session_id", "t").collect()]
    assert got == [(4, ["audio"], 0, 0, 1), (1, ["audio", "pose"], 0, 0, 2), (3, ["audio"], 0, 1, 1)]
