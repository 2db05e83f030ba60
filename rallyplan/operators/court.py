"""The court in a picture, out of its line segments.

Segments (from any line detector) are the input; what is found is the radial distortion
and the homography from court to picture. A hypothesis takes two segments for images of
two lines across the court and two for images of two lines along it: four crossings fix
the homography. All hypotheses of a picture are one table of arrays, solved and scored in
blocks:

* pieces of one line count as one line, from end to end, once distortion is out;
* plausible ones have the whole court before the camera and its lines in the right order;
* how much of the court's lines inside the picture lies on segments, times how much of the
  segments lies on court lines, both as shares of sample points, is the score.

Hypotheses are made for each distortion of ``BENT``, a task for each picture and distortion;
the best few of all of them are refined together by robust least squares of the segments'
points, distortion included, and the best of those is the picture's court.

A court looks the same turned by half a circle, so which end is which is open (the near
end is the one with negative y where the view is from behind a baseline).

Defined results: pictures with fewer than two segments across and two along, or without a
plausible hypothesis, have no row; segments of no length are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyplan.schema import HALF_DOUBLES, HALF_LENGTH, HALF_SINGLES, SERVICE_LINE

# Court lines across (y, from far to near) and along (x, from left to right), the distortions that are tried.
ACROSS = (HALF_LENGTH, SERVICE_LINE, -SERVICE_LINE, -HALF_LENGTH)
ALONG = (-HALF_DOUBLES, -HALF_SINGLES, 0.0, HALF_SINGLES, HALF_DOUBLES)
BENT = (0.0, -0.08, -0.16, -0.24, -0.32)
#: Longest segments of each direction that hypotheses are made of, degrees up to which one runs across, hypotheses that are refined.
LONGEST, LEVEL_DEG, BEST = 7, 40.0, 5
#: Hypotheses that are scored at once; points of a court line and of a segment; pixels (of a picture 1280 wide) within which a point lies on a line.
BLOCK, POINTS, NEAR_PX = 2048, 9, 5.0
FOUND = "k1 double, homography array<double>, score double"

#: Ends of all court lines: x, y, x, y. The centre line ends at the service lines, singles lines and baselines go all the way.
LINES = np.array(
    [(-HALF_DOUBLES, y, HALF_DOUBLES, y) if abs(y) == HALF_LENGTH else (-HALF_SINGLES, y, HALF_SINGLES, y) for y in ACROSS]
    + [(x, -HALF_LENGTH, x, HALF_LENGTH) if x else (0.0, -SERVICE_LINE, 0.0, SERVICE_LINE) for x in ALONG]
)


def along(lines: np.ndarray, n: int = POINTS) -> np.ndarray:
    """(lines, n, 2): points at equal distances from end to end."""
    share = np.linspace(0, 1, n)[:, None]
    return lines[:, None, :2] * (1 - share) + lines[:, None, 2:] * share


def straightened(points: np.ndarray, k1: float | np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Where points would be without distortion, by fixed-point steps on the radius; the unit is half the picture's diagonal."""
    middle, unit = np.array(size) / 2, np.hypot(*size) / 2
    bent = (points - middle) / unit
    r = np.linalg.norm(bent, axis=-1)
    straight = r.copy()
    for _ in range(20):
        straight = r / np.maximum(1 + k1 * straight**2, 0.2)
    return middle + unit * bent * np.where(r > 0, straight / np.maximum(r, 1e-12), 1.0)[..., None]


def mapped(h: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (n, 2) through homographies (..., 3, 3): (..., n, 2), and the depths (..., n)."""
    out = points @ np.swapaxes(h[..., :2], -1, -2) + h[..., None, :, 2]
    depth = out[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return out[..., :2] / depth[..., None], depth


def of_corners(quads: np.ndarray, rectangles: np.ndarray) -> np.ndarray:
    """Homographies that take a rectangle (x1, y1, x2, y2) to a quadrangle (corners x1y1, x2y1, x2y2, x1y2), for rows of both."""
    a, b, c, d = (quads[:, i] for i in range(4))
    (s, t), (u, v) = (b - c).T, (d - c).T
    w = a - b + c - d
    with np.errstate(divide="ignore", invalid="ignore"):
        det = s * v - u * t
        g, k = (w[:, 0] * v - u * w[:, 1]) / det, (s * w[:, 1] - w[:, 0] * t) / det
    square = np.stack([b - a + g[:, None] * b, d - a + k[:, None] * d, a], axis=2)
    square = np.concatenate([square, np.stack([g, k, np.ones_like(g)], axis=1)[:, None]], axis=1)
    wide, high = rectangles[:, 2] - rectangles[:, 0], rectangles[:, 3] - rectangles[:, 1]
    to_square = np.zeros((len(quads), 3, 3))
    to_square[:, 0, 0], to_square[:, 1, 1], to_square[:, 2, 2] = 1 / wide, 1 / high, 1
    to_square[:, 0, 2], to_square[:, 1, 2] = -rectangles[:, 0] / wide, -rectangles[:, 1] / high
    return square @ to_square


def crossings(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Where lines through segments p (n, 4) meet those through q, row by row."""
    homogeneous = lambda s: np.cross(np.c_[s[:, :2], np.ones(len(s))], np.c_[s[:, 2:], np.ones(len(s))])
    x = np.cross(homogeneous(p), homogeneous(q))
    with np.errstate(divide="ignore", invalid="ignore"):
        return x[:, :2] / x[:, 2:]


def whole_lines(segments: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Segments that lie on one line as one, from end to end; the longest pieces first."""
    near, out = 1.5 * NEAR_PX * size[0] / 1280, np.zeros((0, 4))
    for s in segments[np.argsort(-np.hypot(*(segments[:, 2:] - segments[:, :2]).T), kind="stable")]:
        way = out[:, 2:] - out[:, :2]
        unit = way / np.linalg.norm(way, axis=1, keepdims=True)
        ends = s.reshape(2, 2)[None] - out[:, None, :2]
        aside = np.abs(ends[..., 0] * unit[:, None, 1] - ends[..., 1] * unit[:, None, 0]).max(axis=1)
        k = int(aside.argmin()) if len(out) else -1
        if k < 0 or aside[k] > near:
            out = np.concatenate([out, s[None]])
            continue
        # the ends that are furthest apart along the line
        points = np.concatenate([out[k].reshape(2, 2), s.reshape(2, 2)])
        at = (points - points[0]) @ unit[k]
        out[k] = np.concatenate([points[at.argmin()], points[at.argmax()]])
    return out


def hypotheses(segments: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Homographies of all choices of two segments across and two along, and of the court lines that they may be."""
    way = segments[:, 2:] - segments[:, :2]
    length, tilt = np.hypot(*way.T), np.degrees(np.abs(np.arctan2(way[:, 1], way[:, 0])))
    level = np.minimum(tilt, 180 - tilt) < LEVEL_DEG
    longest = np.argsort(-length, kind="stable")
    rows, columns = (segments[longest[of[longest]][:LONGEST]] for of in (level, ~level))
    # from top to bottom and from left to right, where they cross the picture's middle lines
    middle = np.array([[size[0] / 2, 0, size[0] / 2, size[1]], [0, size[1] / 2, size[0], size[1] / 2]], float)
    rows = rows[np.argsort(crossings(rows, np.repeat(middle[:1], len(rows), axis=0))[:, 1])]
    columns = columns[np.argsort(crossings(columns, np.repeat(middle[1:], len(columns), axis=0))[:, 0])]
    out = [np.zeros((0, 3, 3))]
    # from behind a baseline rows of the picture are lines across; from the side they are lines along
    if len(rows) < 2 or len(columns) < 2:
        return out[0]
    for side in (0, 1, -1):
        up, lo = (np.array(i) for i in zip(*combinations(range(len(rows)), 2), strict=True))
        le, ri = (np.array(i) for i in zip(*combinations(range(len(columns)), 2), strict=True))
        a, b = np.repeat(np.arange(len(up)), len(le)), np.tile(np.arange(len(le)), len(up))
        corner = {(y, x): crossings(rows[ys[a]], columns[xs[b]]) for y, ys in (("u", up), ("l", lo)) for x, xs in (("l", le), ("r", ri))}
        quads = np.stack([corner["l", "l"], corner["l", "r"], corner["u", "r"], corner["u", "l"]], axis=1)
        if side:  # from the right (1) or the left (-1): the upper row is the far side, and the left end the near or the far one
            boxes = np.array([(x1, y1, x2, y2) for x1, x2 in combinations(ALONG[::side], 2) for y1, y2 in combinations(ACROSS[::-side], 2)])
            quads = np.roll(quads, 1, axis=1)
        else:
            boxes = np.array([(x1, y1, x2, y2) for y2, y1 in combinations(ACROSS, 2) for x1, x2 in combinations(ALONG, 2)])
        i, j = np.repeat(np.arange(len(quads)), len(boxes)), np.tile(np.arange(len(boxes)), len(quads))
        out.append(of_corners(quads[i], boxes[j]))
    h = np.concatenate(out)
    return h[np.isfinite(h).all(axis=(1, 2))]


def plausible(h: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Is the whole court before the camera, seen from above (not mirrored), large enough and not far larger than the picture?"""
    corners = np.array([[-HALF_DOUBLES, -HALF_LENGTH], [HALF_DOUBLES, -HALF_LENGTH], [HALF_DOUBLES, HALF_LENGTH], [-HALF_DOUBLES, HALF_LENGTH]])
    at, depth = mapped(h, corners)
    x, y = np.moveaxis(at, 2, 0)
    area = -0.5 * (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)  # the picture's y grows downwards
    whole = size[0] * size[1]
    same_side = (depth > 0).all(axis=1) | (depth < 0).all(axis=1)
    return same_side & np.isfinite(at).all(axis=(1, 2)) & (area > 0.02 * whole) & (area < 6 * whole)


def apart(points: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Distance of each point (..., 2) to the nearest segment."""
    a, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
    rel = points[..., None, :] - a
    share = np.clip((rel * d).sum(axis=-1) / np.maximum((d * d).sum(axis=-1), 1e-12), 0, 1)
    return np.sqrt(((rel - share[..., None] * d) ** 2).sum(axis=-1).min(axis=-1))


def scores(h: np.ndarray, segments: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Share of the court's points inside the picture that lie on segments, times the share of the segments' points that lie on court lines."""
    near = NEAR_PX * size[0] / 1280
    court = along(LINES).reshape(-1, 2)
    at, _ = mapped(h, court)
    inside = ((at >= 0) & (at <= np.array(size))).all(axis=2)
    told = np.where(inside, apart(np.where(np.isfinite(at), at, -1e6), segments) <= near, False).sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
    own = along(segments).reshape(-1, 2)
    ends, _ = mapped(h, LINES.reshape(-1, 2))
    lines = ends.reshape(len(h), -1, 4)
    explained = np.stack([apart(own, x) <= near for x in lines]).mean(axis=1)
    return np.where(inside.sum(axis=1) >= 0.4 * len(court), told * explained, 0.0)


def best(segments: np.ndarray, size: tuple[int, int], most: int = BEST) -> list[tuple[float, np.ndarray]]:
    """(score, homography) of the best hypotheses for segments without distortion."""
    lines = whole_lines(segments, size)
    h = hypotheses(lines, size)
    h = h[plausible(h, size)]
    if not len(h):
        return []
    told = np.concatenate([scores(h[i : i + BLOCK], lines, size) for i in range(0, len(h), BLOCK)])
    first = np.argsort(-told, kind="stable")[:most]
    return [(float(told[i]), h[i] / h[i, 2, 2]) for i in first if told[i] > 0]


def refined(segments: np.ndarray, starts: list[tuple[float, np.ndarray]], size: tuple[int, int]) -> tuple[float, np.ndarray, float] | None:
    """(k1, homography, score) out of starts (k1, homography), all solved together: the points of the segments move onto the court lines that they are nearest to."""
    from rallyplan.functions.physics import soft_least_squares

    points = along(segments).reshape(-1, 2)
    near = 4 * NEAR_PX * size[0] / 1280
    chosen = []
    for k1, h in starts:
        ends = mapped(h[None], LINES.reshape(-1, 2))[0].reshape(-1, 4)
        there = straightened(points, k1, size)
        each = np.stack([apart(there, line[None]) for line in ends], axis=1)
        chosen.append((each.argmin(axis=1), each.min(axis=1) <= near))
    which, counts = (np.array(x) for x in zip(*chosen, strict=True))
    across = np.arange(len(LINES)) < len(ACROSS)

    def residuals(x: np.ndarray, problem: np.ndarray) -> np.ndarray:
        h = np.concatenate([x[:, :8], np.ones((len(x), 1))], axis=1).reshape(-1, 3, 3)
        there = straightened(points[None], x[:, 8:9], size)
        to_court = np.linalg.inv(h)
        flat = np.einsum("qij,qnj->qni", to_court, np.concatenate([there, np.ones((*there.shape[:2], 1))], axis=2))
        court = flat[..., :2] / flat[..., 2:]
        line = which[problem]
        on = np.where(across[line][..., None], np.stack([court[..., 0], LINES[line, 1]], axis=-1), np.stack([LINES[line, 0], court[..., 1]], axis=-1))
        back = np.einsum("qij,qnj->qni", h, np.concatenate([on, np.ones((*on.shape[:2], 1))], axis=2))
        off = np.linalg.norm(back[..., :2] / back[..., 2:] - there, axis=2)
        return np.where(counts[problem], np.nan_to_num(off, nan=1e3, posinf=1e3), 0.0)

    begin = np.array([[*(h / h[2, 2]).ravel()[:8], k1] for k1, h in starts])
    x, _ = soft_least_squares(residuals, begin, NEAR_PX * size[0] / 1280, 60)
    out = None
    for row in x:
        h, k1 = np.append(row[:8], 1.0).reshape(3, 3), float(row[8])
        straight = straightened(segments.reshape(-1, 2), k1, size).reshape(-1, 4)
        if np.isfinite(h).all() and plausible(h[None], size)[0] and (out is None or scores(h[None], straight, size)[0] > out[2]):
            out = k1, h, float(scores(h[None], straight, size)[0])
    return out


def find_courts(segments: DataFrame, by: str = "video_id") -> DataFrame:
    """by, k1, homography (court to straightened picture, row by row), score. segments: by, x1, y1, x2, y2, width, height (of the picture)."""
    kind = dict(segments.dtypes)[by]
    own = segments.select(by, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], "width", "height").where("x1 <> x2 OR y1 <> y2")
    tries = own.withColumn("k1", F.explode(F.array(*map(F.lit, BENT))))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        size, k1 = (int(rows.width.iloc[0]), int(rows.height.iloc[0])), float(rows.k1.iloc[0])
        straight = straightened(rows[["x1", "y1", "x2", "y2"]].to_numpy(float).reshape(-1, 2), k1, size).reshape(-1, 4)
        return pd.DataFrame([(rows[by].iloc[0], k1, h.ravel().tolist(), s) for s, h in best(straight, size)], columns=[by, "k1", "homography", "score"])

    found = tries.groupBy(by, "k1").applyInPandas(search, f"`{by}` {kind}, {FOUND}")
    starts = found.groupBy(by).agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "k1", "homography")), False), 1, BEST).alias("starts"))  # BEST a distortion at most
    lines = own.groupBy(by).agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("lines"), F.first("width").alias("width"), F.first("height").alias("height"))

    def refine(frames):
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                size = (int(r.width), int(r.height))
                got = refined(np.array([list(x) for x in r.lines], float), [(s["k1"], np.array(s["homography"]).reshape(3, 3)) for s in r.starts], size)
                if got:
                    rows.append((getattr(r, by), got[0], got[1].ravel().tolist(), got[2]))
            yield pd.DataFrame(rows, columns=[by, "k1", "homography", "score"])

    return lines.join(starts, by).mapInPandas(refine, f"`{by}` {kind}, {FOUND}")
