"""Court search: cameras are recovered out of made-up segments."""

import numpy as np
import pytest

from rallyplan.functions import physics
from rallyplan.operators import court as C

SIZE = (1920, 1080)
ROWS = "video_id long, x1 double, y1 double, x2 double, y2 double, width int, height int"


def looking(place, at):
    """Homography of a camera at a place that looks at a point, without roll."""
    forward = np.subtract(at, place) / np.linalg.norm(np.subtract(at, place))
    right = np.cross(forward, [0, 0, 1.0])
    right /= np.linalg.norm(right)
    rotation = np.stack([right, np.cross(forward, right), forward])
    k = np.array([[1300.0, 0, SIZE[0] / 2], [0, 1300.0, SIZE[1] / 2], [0, 0, 1]])
    h = k @ np.column_stack([rotation[:, 0], rotation[:, 1], -rotation @ place])
    return h / h[2, 2]


VIEWS = {"behind": looking([0.5, -21.0, 6.0], [0, -2, 0]), "right": looking([19.0, 1.0, 9.0], [0, 0.5, 0]), "left": looking([-19.0, -1.0, 9.0], [0, 0, 0])}


def bent(points, k1):
    """Distortion of straight points, the inverse of ``straightened``."""
    middle, unit = np.array(SIZE) / 2, np.hypot(*SIZE) / 2
    p = (points - middle) / unit
    return middle + unit * p * (1 + k1 * (p**2).sum(axis=-1, keepdims=True))


def segments(h, k1=0.0, seed=1, noise=6):
    """Pieces of the court's lines as a detector sees them, and some that aren't."""
    pick = np.random.default_rng(seed)
    places = C.along(C.LINES, 13)
    pieces = np.concatenate([places[:, i : i + 2].reshape(-1, 2, 2) for i in range(0, 12)]) if k1 else C.LINES.reshape(-1, 2, 2)
    seen = C.mapped(h[None], pieces.reshape(-1, 2))[0].reshape(-1, 2, 2)
    seen = bent(seen, k1) + pick.normal(0, 0.5, seen.shape)
    seen = seen[((seen > -200) & (seen < np.array(SIZE) + 200)).all(axis=(1, 2))]
    return np.concatenate([seen.reshape(-1, 4), pick.uniform(0, 1, (noise, 4)) * [*SIZE, *SIZE]])


def off(found, h):
    """Largest distance in pixels of what both show of the court inside the picture, turned by half a circle or not."""
    points = C.along(C.LINES).reshape(-1, 2)
    a, b = C.mapped(found[None], points)[0][0], C.mapped(h[None], points)[0][0]
    c = C.mapped((found @ np.diag([-1.0, -1, 1]))[None], points)[0][0]
    inside = ((b > 0) & (b < np.array(SIZE))).all(axis=1)
    return float(min(np.linalg.norm(x - b, axis=1)[inside].max() for x in (a, c)))


def test_corners_are_met_exactly():
    pick = np.random.default_rng(3)
    quads = np.array([[0, 0], [1, 0], [1, 1], [0, 1.0]]) * 100 + pick.normal(0, 15, (50, 4, 2))
    boxes = np.tile([-2.0, -3.0, 4.0, 5.0], (50, 1))
    h = C.of_corners(quads, boxes)
    corners = np.array([[-2.0, -3.0], [4.0, -3.0], [4.0, 5.0], [-2.0, 5.0]])
    assert np.allclose(C.mapped(h, corners)[0], quads)


@pytest.mark.parametrize("k1", C.BENT)
def test_straightened_is_the_inverse_of_bent(k1):
    points = np.random.default_rng(1).uniform(0, 1, (200, 2)) * SIZE
    assert np.allclose(C.straightened(bent(points, k1), k1, SIZE), points, atol=1.0 if k1 > -0.3 else 30.0)  # so much distortion folds the far corners


@pytest.mark.parametrize("view", VIEWS)
def test_views_are_recovered(view):
    h = VIEWS[view]
    assert C.plausible(h[None], SIZE)[0]
    own = segments(h)
    starts = C.best(own, SIZE)
    got = C.refined(own, [(0.0, x) for _, x in starts], SIZE)
    assert off(got[1], h) < 6 and abs(got[0]) < 0.02 and got[2] > 0.5


def test_mirrored_and_tiny_courts_are_not_plausible():
    h = VIEWS["behind"]
    assert not C.plausible((h @ np.diag([-1.0, 1, 1]))[None], SIZE)[0]
    assert not C.plausible((np.diag([0.05, 0.05, 1]) @ h)[None], SIZE)[0]


def test_courts_of_several_pictures(spark):
    """One straight, one bent picture with lines in pieces, one with too few lines."""
    told = {1: (VIEWS["behind"], 0.0), 2: (VIEWS["behind"], -0.16)}
    rows = [(v, *map(float, s), *SIZE) for v, (h, k1) in told.items() for s in segments(h, k1, v)]
    rows += [(3, 0.0, 0.0, 100.0, 5.0, *SIZE), (3, 7.0, 7.0, 7.0, 7.0, *SIZE)]
    got = {r.video_id: r for r in C.find_courts(spark.createDataFrame(rows, ROWS)).collect()}
    assert set(got) == {1, 2}
    assert off(np.array(got[1].homography).reshape(3, 3), VIEWS["behind"]) < 6
    assert abs(got[2].k1 + 0.16) < 0.08 and off(np.array(got[2].homography).reshape(3, 3), VIEWS["behind"]) < 25
    assert C.find_courts(spark.createDataFrame([], ROWS)).count() == 0
    camera = physics.camera_from_homography(np.array(got[1].homography), SIZE)
    assert np.linalg.norm(camera.place - [0.5, -21.0, 6.0]) < 1.0
