"""Geometry as column expressions, so that it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyplan.schema import HALF_DOUBLES, HALF_LENGTH, HALF_SINGLES, NET_CENTRE, NET_POST, NET_POST_X, SERVICE_LINE


def sign(x: Column) -> Column:
    return F.signum(x)


def on_court(x: Column, y: Column) -> Column:
    """On the court or its run-off."""
    return (F.abs(x) <= HALF_DOUBLES + 5.0) & (F.abs(y) <= HALF_LENGTH + 8.0)


def in_court(stroke: Column, bx: Column, by: Column, toward: Column, doubles: bool = False) -> Column:
    """Did the ball land in? Serves have the service box; null without a bounce."""
    beyond = by * toward > 0
    box = beyond & (F.abs(by) <= SERVICE_LINE) & (F.abs(bx) <= HALF_SINGLES)
    court = beyond & (F.abs(by) <= HALF_LENGTH) & (F.abs(bx) <= (HALF_DOUBLES if doubles else HALF_SINGLES))
    return F.when(bx.isNotNull() & by.isNotNull(), F.when(stroke == "serve", box).otherwise(court))


def depth(by: Column) -> Column:
    d = F.abs(by)
    return F.when(d < SERVICE_LINE, "short").when(d > HALF_LENGTH - 3.0, "deep").when(d.isNotNull(), "mid")


def direction(bx: Column, hx: Column) -> Column:
    """middle, line or cross, from where it was hit and where it landed."""
    along = (sign(bx) == sign(hx)) | (F.abs(hx) < 0.5)
    return F.when(F.abs(bx) < 1.4, "middle").when(bx.isNotNull() & along, F.when(F.abs(hx) >= 0.5, "line").otherwise("middle")).when(bx.isNotNull(), "cross")


def zone(hy: Column) -> Column:
    """0 at the net, 1 mid-court, 2 baseline, 3 behind it."""
    d = F.abs(hy)
    return F.when(d < SERVICE_LINE, 0).when(d < HALF_LENGTH - 1.4, 1).when(d < HALF_LENGTH + 1, 2).when(d.isNotNull(), 3)


def net_height(x: Column) -> Column:
    """Height of the net at x: it sags linearly from the posts to the centre."""
    return F.when(F.abs(x) >= NET_POST_X, F.lit(NET_POST)).otherwise(NET_CENTRE + (NET_POST - NET_CENTRE) * F.abs(x) / NET_POST_X)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle ABC in degrees, null if a side has no length."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    n = F.hypot(ux, uy) * F.hypot(vx, vy)
    return F.when(n > 0, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ux * vx + uy * vy) / n)))))


def homography(h: list[float], x: Column, y: Column) -> tuple[Column, Column]:
    """Point (x, y) through the row-major 3 x 3 matrix h."""
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def inverse3(h: list[float]) -> list[float]:
    """Inverse of a row-major 3 x 3 matrix."""
    a, b, c, d, e, f, g, i, j = h
    det = a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)
    return [x / det for x in (e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d)]


def distort(x: Column, y: Column, k1: float, k2: float) -> tuple[Column, Column]:
    """Radial distortion of a point in units of the image's half diagonal, from its centre."""
    r2 = x * x + y * y
    f = 1 + k1 * r2 + k2 * r2 * r2
    return x * f, y * f


def undistort(x: Column, y: Column, k1: float, k2: float, turns: int = 12) -> tuple[Column, Column]:
    """Inverse of ``distort`` by fixed-point iteration on the radius (one number, so the expression stays small)."""
    rd2 = x * x + y * y

    def step(q2: Column, _: Column) -> Column:
        f = 1 + k1 * q2 + k2 * q2 * q2
        return rd2 / (f * f)

    q2 = F.aggregate(F.sequence(F.lit(1), F.lit(turns)), rd2, step)
    f = 1 + k1 * q2 + k2 * q2 * q2
    return x / f, y / f


def hellinger(a: Column, b: Column) -> Column:
    """Distance of two histograms (negative entries count as zero); 1 if one is empty."""
    clip = lambda v: F.transform(v, lambda x: F.greatest(F.lit(0.0), x.cast("double")))
    total = lambda v: F.aggregate(clip(v), F.lit(0.0), lambda s, x: s + x)
    both = F.aggregate(F.zip_with(clip(a), clip(b), lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    sa, sb = total(a), total(b)
    return F.when((sa > 0) & (sb > 0), F.sqrt(F.greatest(F.lit(0.0), 1 - both / F.sqrt(sa * sb)))).otherwise(F.lit(1.0))


def foot_point(lx: Column, ly: Column, lc: Column, rx: Column, ry: Column, rc: Column, box: tuple[Column, ...], least: float = 0.3) -> tuple[Column, Column]:
    """Middle and lower of both ankles if both are seen, else the box's bottom centre."""
    seen = (lc >= least) & (rc >= least)
    return F.when(seen, (lx + rx) / 2).otherwise((box[0] + box[2]) / 2), F.when(seen, F.greatest(ly, ry)).otherwise(box[3])


def ray_contact(feet_y: Column, centre: tuple[Column, ...], ray: tuple[Column, ...]) -> tuple[Column, Column]:
    """(x, z) where a ray from ``centre`` meets the depth feet_y; null if it runs along."""
    s = F.when(F.abs(ray[1]) >= 1e-6, (feet_y - centre[1]) / ray[1])
    return centre[0] + s * ray[0], centre[2] + s * ray[2]
