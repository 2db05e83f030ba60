"""Movement out of poses: scenarios, and plain versions in Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import camera, pose

from rallyplan.operators import movement as M
from rallyplan.schema import KEYPOINTS

MOTION = "video_id long, track int, t double, kp_x array<double>, kp_y array<double>, kp_c array<double>, height double"


def rows_of(t, kp, track=1, height=100.0):
    return [(1, track, float(a), kp[k, :, 0].tolist(), kp[k, :, 1].tolist(), kp[k, :, 2].tolist(), height) for k, a in enumerate(t)]


def samples(spark, swings):
    """{hit_id: (t, kp)} as swing samples."""
    rows = [(i, float(a), kp[k, :, 0].tolist(), kp[k, :, 1].tolist(), kp[k, :, 2].tolist()) for i, (t, kp) in swings.items() for k, a in enumerate(t)]
    return spark.createDataFrame(rows, "hit_id long, rel double, kp_x array<double>, kp_y array<double>, kp_c array<double>")


def test_technique(spark):
    t = np.arange(-0.6, 0.35, 1 / 30)
    turned = pose(t, r_wrist=lambda x: (40 + 300 * x, -60), r_shoulder=lambda x: (10 if x > 0 else 2, -80), l_shoulder=lambda x: (-10 if x > 0 else -2, -80))
    bent = pose(t, r_knee=lambda x: (18, -25), l_knee=lambda x: (-7 + 25 * (x < -0.2), -25))
    unsure = pose(t)
    unsure[:, :, 2] = 0.1
    told = {}
    for r in M.technique(samples(spark, {1: (t, turned), 2: (t, bent), 3: (t, unsure), 4: (t[18:19], pose(t[18:19]))})).collect():
        told.setdefault(r.shot_id, {})[r.name] = r.value
    assert told[1]["knee_bend_deg"] == 180.0 and told[1]["shoulder_turn"] == 0.8 and told[1]["racket_arm_speed"] > 2
    assert told[2]["knee_bend_deg"] == 90.0 and told[2]["shoulder_turn"] == 0.0
    assert 3 not in told, told[3]
    assert "knee_bend_deg" not in told[4] and "shoulder_turn" not in told.get(4, {})
    legs = {s: turned[0, [KEYPOINTS.index(f"{s}_{j}") for j in ("shoulder", "elbow", "wrist")], :2] for s in "lr"}
    assert legs and 0 < told[1]["elbow_contact_deg"] <= 180


def ankles(t, hop, sure=0.9):
    kp = pose(t)
    for n in ("l_ankle", "r_ankle"):
        kp[:, KEYPOINTS.index(n), 1] = hop
        kp[:, KEYPOINTS.index(n), 2] = sure
    return kp


def test_split_steps(spark):
    """Label B answers A's shot at 10 s: with a hop, without, out of sight, with too few frames; rallies and labels decide who answers."""
    t = np.arange(9.0, 10.4, 1 / 30)
    hop, flat = np.where((t > 9.7) & (t < 10.0), -5.0, 0.0), np.zeros(len(t))
    cases = {"hop": (t, ankles(t, hop)), "flat": (t, ankles(t, flat)), "small": (t, ankles(t, hop / 2.5)), "unsure": (t, ankles(t, hop, 0.2)), "few": (t[30:36], ankles(t[30:36], hop[30:36]))}
    found = {}
    for name, (at, kp) in cases.items():
        motion = spark.createDataFrame(rows_of(at, kp, 2), MOTION)
        shots = spark.createDataFrame([(1, 1, "A", 0, 10.0), (2, 1, "B", 0, 11.5), (3, 1, "B", 0, 12.0), (4, 1, "A", 1, 20.0), (5, 1, None, 1, 21.0)], "shot_id long, video_id long, label string, rally long, t double")
        labels = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "video_id long, track_id int, label string")
        found[name] = [tuple(r) for r in M.split_steps(shots, motion, labels).collect()]
    assert found == {"hop": [(2, 1.0)], "flat": [(2, 0.0)], "small": [(2, 0.0)], "unsure": [], "few": []}


def test_ground_line_is_the_highest_ankle_without_frames_before(spark):
    t = np.arange(9.56, 10.2, 1 / 30)
    motion = spark.createDataFrame(rows_of(t, ankles(t, np.where(t < 9.8, -5.0, 0.0)), 2), MOTION)
    shots = spark.createDataFrame([(1, 1, "A", 0, 10.0), (2, 1, "B", 0, 11.5)], "shot_id long, video_id long, label string, rally long, t double")
    labels = spark.createDataFrame([(1, 2, "B")], "video_id long, track_id int, label string")
    assert [tuple(r) for r in M.split_steps(shots, motion, labels).collect()] == [(2, 1.0)]


def test_recoveries(spark):
    people = spark.createDataFrame([(1, 1, 11.15, -2.346), (1, 1, 11.3, 9.0), (1, 3, 11.21, 1.5), (1, 2, 21.6, 3.0), (1, 1, 31.2, float("nan"))], "video_id long, track_id int, t double, court_x double")
    labels = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "A")], "video_id long, track_id int, label string")
    shots = spark.createDataFrame([(1, 1, "A", 10.0), (2, 1, "B", 20.0), (3, 1, "A", 30.0), (4, 1, None, 10.0)], "shot_id long, video_id long, label string, t double")
    assert [tuple(r) for r in M.recoveries(shots, people, labels).collect()] == [(1, 1.5)]


def cameras(spark):
    cam = camera()
    k = np.array([[1400.0, 0, 960], [0, 1400.0, 540], [0, 0, 1]])
    h = k @ np.column_stack([cam.rotation[:, 0], cam.rotation[:, 1], cam.shift])
    return cam, spark.createDataFrame([(1, (h / h[2, 2]).ravel().tolist(), 1920, 1080), (2, np.eye(3).ravel().tolist(), 1920, 1080)], "video_id long, homography array<double>, width int, height int")


def test_rays_go_through_what_the_camera_shows(spark):
    cam, table = cameras(spark)
    rows = M.eyes(table).collect()
    assert [r.video_id for r in rows] == [1] and np.allclose(rows[0].eye, cam.place)
    points = np.array([[1.0, 3.0, 0.5], [-3.0, 9.0, 1.0]])
    for p, (px, py) in zip(points, cam.project(points)):
        d = np.array(rows[0].way).reshape(3, 3) @ [px, py, 1.0]
        assert np.linalg.norm(np.cross(d / np.linalg.norm(d), (p - cam.place) / np.linalg.norm(p - cam.place))) < 1e-9


@pytest.mark.parametrize("n, seen", [(200, True), (49, False)])
def test_height_is_recovered(spark, n, seen):
    cam, table = cameras(spark)
    pick = np.random.default_rng(3)
    at = np.column_stack([pick.uniform(-4, 4, n), pick.uniform(-12, -6, n)])
    motion = []
    for i, (x, y) in enumerate(at):
        kp = np.zeros((17, 3))
        for name, place in (("nose", (x, y, 0.935 * 1.83)), ("l_ankle", (x, y, 0.08)), ("r_ankle", (x, y, 0.08))):
            kp[KEYPOINTS.index(name)] = (*cam.project(np.array([place]))[0], 0.9)
        motion.append((1, 1, float(i), kp[:, 0].tolist(), kp[:, 1].tolist(), kp[:, 2].tolist(), 100.0))
    labels = spark.createDataFrame([(1, 1, "A")], "video_id long, track_id int, label string")
    got = M.standing_heights(spark.createDataFrame(motion, MOTION), labels, M.eyes(table)).collect()
    assert [tuple(r) for r in got] == ([(1, "A", 1.83)] if seen else [])


def test_movement_reaches_the_shots_stage(spark):
    from test_shots_stage import made_up

    from rallyplan.plans import shots_stage

    (h, people, motion, ball, labels, players, videos, cams), _ = made_up(spark)
    _, metrics, _ = shots_stage.shots_stage(h, people, motion, ball, labels, players, videos, cams)
    names = {}
    for r in metrics.collect():
        names.setdefault(r.name, set()).add(r.shot_id)
    assert names["recovery_m"] == {1, 2, 3, 4} and names["knee_bend_deg"] == {1, 2, 3, 4} and names.get("split_step", set()) <= {2, 3, 4}


def test_nothing_in_nothing_out(spark):
    motion = spark.createDataFrame([], MOTION)
    labels = spark.createDataFrame([], "video_id long, track_id int, label string")
    shots = spark.createDataFrame([], "shot_id long, video_id long, label string, rally long, t double")
    _, table = cameras(spark)
    assert M.split_steps(shots, motion, labels).count() == M.standing_heights(motion, labels, M.eyes(table)).count() == 0
    assert M.technique(motion.selectExpr("video_id AS hit_id", "t AS rel", "kp_x", "kp_y", "kp_c")).count() == 0
