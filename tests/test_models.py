"""Geometry, flights, sound, poses, identities: parameter recovery and scenarios."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G, physics, signals
from rallyplan.operators import identity, tracking
from rallyplan.schema import KEYPOINTS


def camera():
    place, pitch = np.array([0.0, -20.0, 6.0]), np.radians(105)
    c, s = np.cos(pitch), np.sin(pitch)
    rotation = np.array([[1, 0, 0], [0, c, -s], [0, s, c]])
    return physics.Camera(1400.0, rotation, -rotation @ place)


def test_rays_go_through_their_points():
    cam = camera()
    points = np.array([[1.0, 3.0, 0.5], [-3.0, 9.0, 1.0]])
    centre, d = cam.rays(cam.project(points))
    for p, ray in zip(points, d, strict=True):
        assert np.linalg.norm(np.cross(ray, (p - centre) / np.linalg.norm(p - centre))) < 1e-9


def test_camera_is_recovered():
    cam = camera()
    k = np.array([[1400.0, 0, 960], [0, 1400.0, 540], [0, 0, 1]])
    h = k @ np.column_stack([cam.rotation[:, 0], cam.rotation[:, 1], cam.shift])
    got = physics.camera_from_homography(h / h[2, 2])
    assert abs(got.focal - 1400) < 1e-6 and np.allclose(got.place, cam.place)
    points = np.array([[1.0, 3.0, 0.5], [-3.0, 9.0, 1.0]])
    assert np.allclose(got.project(points), cam.project(points))
    assert physics.camera_from_homography(np.eye(3)) is None


@pytest.mark.parametrize("speed, toward", [((1.5, 24.0, 4.0), 1.0), ((-2.0, 30.0, 2.5), 1.0), ((0.5, -22.0, 5.0), -1.0)])
def test_flight_is_recovered(speed, toward):
    cam = camera()
    contact = np.array([0.5, -toward * 11.0, 1.0])
    places, _, bounce = physics.fly(contact[None], np.array([speed]), 1.4)
    t = np.arange(0.04, 1.35, 1 / 30)
    at = np.round(t / physics.STEP_S).astype(int)
    px = cam.project(places[0, at]) + np.random.default_rng(1).normal(0, 0.5, (len(t), 2))
    px[5] += 60
    px[17] -= 80
    fit = physics.fit_flight(cam, contact + [0.1, 0.0, 0.1], t, px, toward, 1.4)
    true = np.linalg.norm(speed) * 3.6
    assert abs(fit["speed_kmh"] - true) / true < 0.08 and fit["rms_px"] < 4
    assert np.hypot(fit["bounce"][0] - places[0, bounce[0], 0], fit["bounce"][1] - places[0, bounce[0], 1]) < 1.0
    assert physics.fit_flight(cam, contact, t[:3], px[:3], toward) is None
    assert physics.last_shot(cam, contact, t, px, toward) is not None


@pytest.mark.parametrize("start", [0.0, 37.215, 400.5])
def test_lag_is_recovered(start):
    pick, rate = np.random.default_rng(4), 200.0
    full = pick.random(int(700 * rate)) * 0.05
    full[pick.integers(0, len(full), 500)] += 1 + pick.random(500)
    b = full[int(start * rate) : int(start * rate) + int(120 * rate)] + pick.random(int(120 * rate)) * 0.05
    lag, sure = signals.find_lag(full, b, rate)
    assert abs(lag - start) < 0.01 and sure > signals.LEAST_RATIO
    other = pick.random(int(120 * rate))
    assert signals.find_lag(full, other, rate)[0] == 0.0
    assert signals.find_lag(full[:100], b, rate) == (0.0, 0.0)


def test_onsets():
    x = np.random.default_rng(0).random(2000) * 0.1
    x[[300, 303, 900, 1500]] = [2.0, 3.0, 2.0, 2.0]
    assert signals.onset_peaks(x, 100.0, 2.0, 8.0, 0.1).tolist() == [303, 900, 1500]
    assert signals.own_hits(np.array([-30.0, -30.0, -10.0]), 6.0).tolist() == [False, False, True]
    assert signals.peak_rms_db(np.zeros(100), 1000, 50, 0.01) == -120.0


def test_column_geometry(spark):
    row = spark.createDataFrame([(1.0, 2.0, [1.0, 0.0, -3.0], [0.0, 0.0, 0.0], [1.0, 3.0, 0.0])], "x double, y double, a array<double>, e array<double>, b array<double>")
    one = lambda c: row.select(c).first()[0]
    assert one(G.hellinger(F.col("a"), F.col("e"))) == 1.0
    assert abs(one(G.hellinger(F.col("a"), F.col("b"))) - identity.look_distance(np.array([1, 0, -3.0]), np.array([1, 3.0, 0]))) < 1e-12
    h = [60.0, 12.0, 960.0, 3.0, -40.0, 540.0, 0.002, 0.015, 1.0]
    px, py = G.homography(h, F.col("x"), F.col("y"))
    bx, _ = G.homography(G.inverse3(h), px, py)
    assert abs(one(bx) - 1.0) < 1e-9
    assert one(G.net_height(F.lit(0.0))) == 0.914 and one(G.net_height(F.lit(9.0))) == 1.07
    assert abs(one(G.angle(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 0.0, 1.0)))) - 90) < 1e-9
    assert one(G.angle(*map(F.lit, (0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))) is None


def test_placement(spark):
    ask = lambda bx, hx: spark.range(1).select(G.direction(F.lit(bx), F.lit(hx))).first()[0]
    assert [ask(1.0, 3.0), ask(3.0, 3.0), ask(-3.0, 3.0), ask(3.0, 0.2)] == ["middle", "line", "cross", "middle"]
    land = lambda stroke, x, y: spark.range(1).select(G.in_court(F.lit(stroke), F.lit(x), F.lit(y), F.lit(1))).first()[0]
    assert [land("serve", 1.0, 6.4), land("serve", 1.0, 6.5), land("forehand", 4.115, 11.885), land("forehand", 4.2, 5.0), land("forehand", 0.0, -3.0)] == [True, False, True, False, False]


def pose(t, **moves):
    """A standing figure of height 100 px whose named points move as functions of time."""
    base = {"nose": (0, -90), "l_shoulder": (-10, -80), "r_shoulder": (10, -80), "l_elbow": (-15, -60), "r_elbow": (15, -60), "l_wrist": (-15, -45), "r_wrist": (15, -45), "l_hip": (-7, -50), "r_hip": (7, -50), "l_knee": (-7, -25), "r_knee": (7, -25), "l_ankle": (-7, 0), "r_ankle": (7, 0)}
    kp = np.zeros((len(t), 17, 3))
    for name, place in base.items():
        kp[:, KEYPOINTS.index(name), :2] = np.array([moves[name](x) for x in t]) if name in moves else place
        kp[:, KEYPOINTS.index(name), 2] = 0.9
    return kp


def track(i, start, end, y, x=0.0, look=None, video=1, hits=0):
    t = np.arange(start, end + 1e-9, 0.1)
    return identity.Track(video, i, t, np.stack([np.full(len(t), x), np.full(len(t), float(y))], axis=1), np.array(look or [1.0, 1.0]), hits)


def label_of(people):
    return [sorted(t.id for t in p.tracks) for p in people]


def test_broken_tracks_are_two_people():
    tracks = [track(1, 0, 50, -11), track(2, 1, 40, 11), track(3, 41, 90, 11), track(4, 51, 90, -11), track(5, 92, 93, -11)]
    people, n = identity.find_players(tracks)
    assert n == 2 and label_of(people) == [[1, 4, 5], [2, 3]]


def test_changeover():
    red, blue = [1.0, 0.0], [0.0, 1.0]
    tracks = [track(1, 0, 60, -11, look=red), track(2, 0.1, 60, 11, look=blue), track(3, 100, 160, 11, look=red), track(4, 100, 160, -11, look=blue), track(5, 200, 260, -11, look=red), track(6, 200, 260, 11, look=blue)]
    people, _ = identity.find_players(tracks)
    assert label_of(people) == [[1, 3, 5], [2, 4, 6]]


def test_doubles_and_bench():
    looks = [[1, 0, 0, 0.0], [0, 1, 0, 0.0], [0, 0, 1, 0.0], [0, 0, 0, 1.0]]
    tracks = [track(k, 0.1 * k, 100, -11 if k < 2 else 11, x=2.0 * (k % 2), look=looks[k], hits=20) for k in range(4)] + [track(k + 4, 101, 150, 11, look=looks[k], hits=5) for k in range(4)]
    people, n = identity.find_players([*tracks, track(9, 0, 150, 0, x=-8.5, look=[1, 1, 1, 1.0])])
    assert n == 4 and label_of(people) == [[0, 4], [1, 5], [2, 6], [3, 7]]


def test_two_cameras_see_one_person():
    tracks = [track(1, 0, 50, -11, video=1), track(2, 0.1, 50, 11, video=1), track(3, 5, 50, -11.2, video=2), track(4, 5, 50, 11.1, video=2)]
    assert label_of(identity.two_players(tracks)) == [[1, 3], [2, 4]]


def test_profiles():
    a = {"hand": "right", "height_m": 1.80, "limbs": [0.5, 0.6], "appearance": [1.0, 0.0]}
    b = {"hand": "left", "height_m": 1.65, "limbs": [0.4, 0.5], "appearance": [0.0, 1.0]}
    assert identity.assign_profiles({"A": b, "B": a}, {1: a, 2: b}) == {"A": 2, "B": 1}
    stranger = {"hand": "left", "height_m": 2.05, "limbs": [0.9, 0.9], "appearance": [0.0, 1.0]}
    assert identity.assign_profiles({"A": stranger}, {1: a}) == {"A": None}
    assert identity.signature_distance({}, {}) == pytest.approx(1.9) and identity.assign_profiles({}, {1: a}) == {}
    both = identity.combined([{"hand": "left", "height_m": 1.79}, {"hand": "left", "height_m": 1.81, "appearance": [1.0]}, {"hand": "right"}])
    assert both == {"hand": "left", "height_m": 1.8, "appearance": [1.0]}


def test_people_tracker():
    box = lambda x: np.array([x, 0.0, x + 1, 2.0])
    t, red, blue = tracking.PeopleTracker(), np.array([1.0, 0.0]), np.array([0.0, 1.0])
    at = lambda x, y: np.array([x, y], float)
    assert t.frame(0.0, [(at(0, -10), box(0), red), (at(0, 10), box(50), blue)]) == [0, 1]
    assert t.frame(0.1, [(at(0.1, 10), box(50), blue), (at(0.1, -10), box(0), red)]) == [1, 0]
    assert t.frame(5.0, [(at(0, -10), box(0), red)]) == [2]


def test_ball_tracklets():
    frames = {f: [(10.0 * f, 5.0 * f, 0.8, False)] + ([(500.0, 500.0, 0.9, False)] if f % 2 else []) for f in range(20) if f not in (7, 8)}
    found = tracking.link_ball(frames, 3)
    assert len(found) == 1 and found[0].frames == [f for f in range(20) if f not in (7, 8)]
    assert tracking.strongest(found)[3] == (30.0, 15.0, found[0].id)


def brute_looks(tracks):
    """Join the closest allowed pair of groups, all pairs anew each time."""
    groups = [[t] for t in tracks]
    apart = {(tracks[i].id, tracks[j].id) for (i, j), s in identity.seen_together(tracks).items() if s > identity.TOGETHER_S}
    look = lambda g: np.average([t.look for t in g], axis=0, weights=[len(t.times) for t in g])
    while True:
        pairs = [(identity.look_distance(look(a), look(b)), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j and not any((x.id, y.id) in apart or (y.id, x.id) in apart for x in a for y in b)]
        if not pairs or min(pairs)[0] > identity.LOOK_LIMIT:
            return sorted(sorted(t.id for t in g) for g in groups)
        _, i, j = min(pairs)
        groups[i] += groups.pop(j)


@pytest.mark.parametrize("seed", range(6))
def test_groups_by_looks_as_by_brute_force(seed):
    pick = np.random.default_rng(seed)
    centres = pick.random((4, 12)) ** 4
    tracks = [track(i, (start := pick.random() * 60), start + pick.random() * 12, 11, look=np.clip(centres[i % 4] + pick.normal(0, 0.08, 12), 0, None).tolist(), video=int(pick.integers(1, 3))) for i in range(40)]
    tracks.append(track(99, 0, 1, 11, look=[0.0] * 12))
    assert sorted(label_of(identity.by_looks(tracks))) == brute_looks(tracks)


def test_three_thousand_tracks_are_grouped_in_seconds():
    pick = np.random.default_rng(1)
    centres = pick.random((4, 50)) ** 4
    tracks = [track(i, 2.0 * i, 2.0 * i + 1.5, 11, look=np.clip(centres[i % 4] + pick.normal(0, 0.05, 50), 0, None).tolist()) for i in range(3000)]
    began = time.perf_counter()
    groups = identity.by_looks(tracks)
    assert sum(len(g.tracks) for g in groups) == 3000 and len(groups) < 40 and time.perf_counter() - began < 60


@pytest.mark.parametrize("seed", range(5))
def test_distances_of_cameras_against_one_at_a_time(seed):
    pick = np.random.default_rng(seed)

    def seen(i, video):
        t = np.sort(pick.uniform(0, 20, pick.integers(5, 60)))
        xy = pick.normal(0, 3, (len(t), 2)) + i
        xy[pick.random(len(t)) < 0.1] = np.nan
        return identity.Track(video, i, t, xy, np.ones(2))

    own, others = seen(0, 1), [seen(i, 2) for i in range(1, 9)] + [identity.Track(2, 9, np.arange(3.0), np.full((3, 2), np.nan), np.ones(2))]
    for other, d in zip(others, identity.distances_apart(own, others)):
        known = np.isfinite(other.xy).all(axis=1)
        m = (own.times >= other.start) & (own.times <= other.end) & np.isfinite(own.xy).all(axis=1)
        if min(m.sum(), known.sum()) < 10:
            assert d == np.inf
            continue
        there = np.stack([np.interp(own.times[m], other.times[known], other.xy[known, k]) for k in (0, 1)], axis=1)
        assert abs(d - np.median(np.linalg.norm(own.xy[m] - there, axis=1))) < 1e-9
