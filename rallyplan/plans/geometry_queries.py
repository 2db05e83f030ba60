"""Court geometry, camera, hit scores, looks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G
from rallyplan.operators.robust import half_even
from rallyplan.plans.base import query, table
from rallyplan.sources.tracking import HITS_SQL, hits

#: A camera behind the near baseline, as a homography court -> picture.
COURT_TO_PICTURE = [60.0, 12.0, 960.0, 3.0, -40.0, 540.0, 0.002, 0.015, 1.0]


@query(f"WITH {HITS_SQL} SELECT shot_id FROM H WHERE abs(hit_x * 2.5) <= 10.485 AND abs(hit_y * 1.5) <= 19.885")
def on_court_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on the court or its run-off."""
    h = hits(spark, sf_dir)
    return h.where(G.on_court(F.col("hit_x") * 2.5, F.col("hit_y") * 1.5)).select("shot_id")


@query(f"WITH {HITS_SQL} SELECT shot_id FROM H WHERE player_id NOT IN (SELECT player_id FROM H GROUP BY 1 HAVING median(abs(hit_x)) > 2.8)")
def bystanders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of players whose usual place isn't far out: aggregate, then anti join."""
    h = hits(spark, sf_dir)
    out = h.groupBy("player_id").agg(F.median(F.abs("hit_x")).alias("m")).where("m > 2.8").select("player_id")
    return h.join(out, "player_id", "left_anti").select("shot_id")


@query(f"WITH {HITS_SQL} SELECT shot_id, round_even(CASE WHEN abs(hit_x * 2) >= 6.4 THEN 1.07 ELSE 0.914 + 0.156 * abs(hit_x * 2) / 6.4 END, 6) AS net FROM H")
def net_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height of the net where each ball crosses it."""
    return hits(spark, sf_dir).select("shot_id", half_even(G.net_height(F.col("hit_x") * 2), 6).alias("net"))


@query(f"""WITH {HITS_SQL}, PJ AS (SELECT shot_id, hit_x AS x, hit_y AS y, 60 * hit_x + 12 * hit_y + 960 AS a, 3 * hit_x - 40 * hit_y + 540 AS b, 0.002::DOUBLE * hit_x + 0.015::DOUBLE * hit_y + 1 AS w FROM H) SELECT shot_id, round_even(a / w, 4) AS px, round_even(b / w, 4) AS py, round_even(x, 6) AS back_x, round_even(y, 6) AS back_y FROM PJ""")
def homography_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court to picture, and back by the inverse."""
    px, py = G.homography(COURT_TO_PICTURE, F.col("hit_x"), F.col("hit_y"))
    p = hits(spark, sf_dir).select("shot_id", px.alias("px"), py.alias("py"))
    bx, by = G.homography(G.inverse3(COURT_TO_PICTURE), F.col("px"), F.col("py"))
    return p.select("shot_id", half_even(F.col("px"), 4).alias("px"), half_even(F.col("py"), 4).alias("py"), half_even(bx, 6).alias("back_x"), half_even(by, 6).alias("back_y"))


@query(f"WITH {HITS_SQL} SELECT shot_id, round_even(hit_x / 12, 6) AS x, round_even(hit_y / 24, 6) AS y FROM H")
def undistort_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radial distortion and its inverse: the points come back."""
    x, y = G.distort(F.col("hit_x") / 12, F.col("hit_y") / 24, -0.12, 0.03)
    d = hits(spark, sf_dir).select("shot_id", x.alias("dx"), y.alias("dy"))  # names that the output doesn't have: inside a lambda an output's name would win
    ux, uy = G.undistort(F.col("dx"), F.col("dy"), -0.12, 0.03, 60)
    return d.select("shot_id", half_even(ux, 6).alias("x"), half_even(uy, 6).alias("y"))


@query(f"""WITH {HITS_SQL}, RY AS (SELECT shot_id, hit_x, hit_y, bounce_x / 100 AS dx, CAST(1 AS DOUBLE) AS dy, (net_clearance_m - 2) / 20 AS dz FROM H WHERE bounce_x IS NOT NULL AND net_clearance_m IS NOT NULL), RZ AS (SELECT shot_id, hit_x, (hit_y + 18) / dy AS s, dx, dz FROM RY)
SELECT shot_id, round_even(s * dx, 6) AS x, round_even(4.6 + s * dz, 6) AS z, abs(s * dx - hit_x) <= 2.5 AND 4.6 + s * dz > 0.1 AND 4.6 + s * dz < 3.4 AS plausible FROM RZ""")
def ray_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact point: the wrist's ray at the player's depth, from a camera 18 m behind the net and 4.6 m up."""
    h = hits(spark, sf_dir).where("bounce_x IS NOT NULL AND net_clearance_m IS NOT NULL")
    x, z = G.ray_contact(F.col("hit_y"), (F.lit(0.0), F.lit(-18.0), F.lit(4.6)), (F.col("bounce_x") / 100, F.lit(1.0), (F.col("net_clearance_m") - 2) / 20))
    good = (F.abs(x - F.col("hit_x")) <= 2.5) & (z > 0.1) & (z < 3.4)
    return h.select("shot_id", half_even(x, 6).alias("x"), half_even(z, 6).alias("z"), good.alias("plausible"))


@query(f"""WITH {HITS_SQL}, BX AS (SELECT shot_id, session_id, t, hit_x AS x1, hit_y AS y1, hit_x + 1 + hit_score AS x2, hit_y + 2 AS y2 FROM H), PR AS (SELECT shot_id, x1, y1, x2, y2, LAG(x1) OVER w AS a1, LAG(y1) OVER w AS b1, LAG(x2) OVER w AS a2, LAG(y2) OVER w AS b2 FROM BX WINDOW w AS (PARTITION BY session_id ORDER BY t, shot_id)),
IT AS (SELECT *, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS i FROM PR WHERE a1 IS NOT NULL) SELECT shot_id, round_even(i / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - i), 6) AS iou FROM IT""")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each box with the one before."""
    b = hits(spark, sf_dir).select("shot_id", "session_id", "t", F.array(F.col("hit_x"), F.col("hit_y"), F.col("hit_x") + 1 + F.col("hit_score"), F.col("hit_y") + 2).alias("b"))
    p = b.withColumn("a", F.lag("b").over(Window.partitionBy("session_id").orderBy("t", "shot_id"))).where("a IS NOT NULL")
    box = lambda c: tuple(F.col(c)[i] for i in range(4))
    return p.select("shot_id", half_even(G.iou(box("b"), box("a")), 6).alias("iou"))


@query(f"""WITH {HITS_SQL}, MB AS (SELECT a.shot_id, b.shot_id AS other, greatest(0, least(a.hit_x, b.hit_x) + 2 - greatest(a.hit_x, b.hit_x)) * greatest(0, least(a.hit_y, b.hit_y) + 4 - greatest(a.hit_y, b.hit_y)) AS i FROM H a JOIN H b ON a.session_id = b.session_id AND floor(a.t / 10) = floor(b.t / 10) AND a.side = -1 AND b.side = 1)
SELECT shot_id, arg_max(other, {{'i': i / (16 - i), 'o': -other}}) AS other FROM MB WHERE i / (16 - i) > 0.15 GROUP BY 1""")
def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection of the same frame (10 s stand in) that overlaps most, above 0.15."""
    h = hits(spark, sf_dir).withColumn("frame", F.floor(F.col("t") / 10))
    box = F.array(F.col("hit_x"), F.col("hit_y"), F.col("hit_x") + 2, F.col("hit_y") + 4)
    a = h.where("side = -1").select("shot_id", "session_id", "frame", box.alias("a"))
    b = h.where("side = 1").select(F.col("shot_id").alias("other"), "session_id", "frame", box.alias("b"))
    of = lambda c: tuple(F.col(c)[i] for i in range(4))
    p = a.join(b, ["session_id", "frame"]).withColumn("iou", G.iou(of("a"), of("b"))).where("iou > 0.15")
    return p.groupBy("shot_id").agg(F.max_by("other", F.struct("iou", -F.col("other"))).alias("other"))


@query(f"WITH {HITS_SQL}, AN AS (SELECT shot_id, hit_x - bounce_x AS ux, hit_y - bounce_y AS uy, -bounce_x AS vx, -bounce_y AS vy FROM H WHERE bounce_x IS NOT NULL) SELECT shot_id, CASE WHEN sqrt(ux ** 2 + uy ** 2) * sqrt(vx ** 2 + vy ** 2) > 0 THEN round_even(degrees(acos(least(1, greatest(-1, (ux * vx + uy * vy) / (sqrt(ux ** 2 + uy ** 2) * sqrt(vx ** 2 + vy ** 2)))))), 4) END AS angle FROM AN")
def joint_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle at the middle of three points."""
    zero = F.lit(0.0)
    a = G.angle(F.col("hit_x"), F.col("hit_y"), F.col("bounce_x"), F.col("bounce_y"), zero, zero)
    return hits(spark, sf_dir).where("bounce_x IS NOT NULL").select("shot_id", half_even(a, 4).alias("angle"))


@query(f"WITH {HITS_SQL} SELECT shot_id, CASE WHEN hit_score >= 0.3 AND (shot_id * 7) % 10 >= 3 THEN round_even((hit_x + hit_x + 1) / 2, 6) ELSE round_even(hit_x + 0.5, 6) END AS x, CASE WHEN hit_score >= 0.3 AND (shot_id * 7) % 10 >= 3 THEN greatest(hit_y, COALESCE(bounce_y, hit_y)) ELSE hit_y + 2 END AS y FROM H")
def foot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a person stands: the lower of both ankles, or the bottom of the box."""
    x, y = F.col("hit_x"), F.col("hit_y")
    fx, fy = G.foot_point(x, y, F.col("hit_score"), x + 1, F.coalesce("bounce_y", y), ((F.col("shot_id") * 7) % 10) / 10, (x, y, x + 1, y + 2))
    return hits(spark, sf_dir).select("shot_id", half_even(fx, 6).alias("x"), fy.alias("y"))


@query(f"""WITH {HITS_SQL}, CU AS (SELECT shot_id, CASE WHEN side = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS sound, hit_score AS loudness, least(1, greatest(0, (abs(hit_x) - 1) / 4)) AS swing, least(1, greatest(0, 1 - abs(hit_x) / 5)) AS timing, CASE WHEN bounce_x IS NOT NULL THEN 1 ELSE 0 END AS seen, least(1, greatest(0, 1 - (abs(bounce_x) - 0.45) / 5)) AS near, abs(bounce_y) / 14 AS turn FROM H)
SELECT shot_id, round_even(0.55 * swing * (0.5 + 0.5 * timing) + 0.35 * sound * (0.6 + 0.4 * loudness) + CASE WHEN seen = 1 THEN 0.35 * near + 0.1 * turn ELSE 0.12 END, 6) AS reliable, round_even(0.55 * swing * (0.5 + 0.5 * timing) + 1.6 * 0.35 * sound * (0.6 + 0.4 * loudness), 6) AS unreliable FROM CU""")
def hit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues of a hit as one score, with and without a ball that can be trusted."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    swing, timing = clip((F.abs("hit_x") - 1) / 4), clip(1 - F.abs("hit_x") / 5)
    base = 0.55 * swing * (0.5 + 0.5 * timing)
    sound = 0.35 * F.when(F.col("side") == 1, 1.0).otherwise(0.0) * (0.6 + 0.4 * F.col("hit_score"))
    ball = F.when(F.col("bounce_x").isNotNull(), 0.35 * clip(1 - (F.abs("bounce_x") - 0.45) / 5) + 0.1 * F.abs("bounce_y") / 14).otherwise(0.12)
    return hits(spark, sf_dir).select("shot_id", half_even(base + sound + ball, 6).alias("reliable"), half_even(base + 1.6 * sound, 6).alias("unreliable"))


@query("""WITH V AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, x::DOUBLE)) AS v FROM embeddings), W AS (SELECT a.vec_id, list_sum(list_transform(generate_series(1, 64), lambda i: sqrt(a.v[i] * b.v[i]))) AS bc, list_sum(a.v) AS sa, list_sum(b.v) AS sb FROM V a JOIN V b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round_even(CASE WHEN sa > 0 AND sb > 0 THEN sqrt(greatest(0, 1 - bc / sqrt(sa * sb))) ELSE 1 END, 6) AS distance FROM W""")
def hellinger_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each look to the next one's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", half_even(G.hellinger(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query(f"WITH {HITS_SQL} SELECT shot_id, hit_score >= median(hit_score) OVER (PARTITION BY session_id) + 0.2 AS own FROM H")
def own_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets clearly louder than the session's median."""
    return hits(spark, sf_dir).select("shot_id", (F.col("hit_score") >= F.expr("median(hit_score) OVER (PARTITION BY session_id)") + 0.2).alias("own"))


@query(f"""WITH RECURSIVE {HITS_SQL}, FL AS (SELECT shot_id, 0 AS k, hit_x AS x, hit_y AS y, 1::DOUBLE AS z, 0::DOUBLE AS vx, -side * least(60, greatest(4, speed_kmh / 3.6::DOUBLE)) AS vy, 3::DOUBLE AS vz, sqrt(power(least(60, greatest(4, speed_kmh / 3.6::DOUBLE)), 2) + 9) AS f FROM H WHERE speed_kmh IS NOT NULL
 UNION ALL SELECT shot_id, k + 1, x + ux * 0.005::DOUBLE, y + uy * 0.005::DOUBLE, z + uz * 0.005::DOUBLE, ux, uy, uz, sqrt(ux * ux + uy * uy + uz * uz) FROM (SELECT *, vx - c * f * vx * 0.005::DOUBLE AS ux, vy - c * f * vy * 0.005::DOUBLE AS uy, vz + (-c * f * vz - 9.81::DOUBLE) * 0.005::DOUBLE AS uz FROM (SELECT *, 0.5::DOUBLE * 1.21 * 0.55 * pi() * power(0.0335::DOUBLE, 2) / 0.057 AS c FROM FL WHERE k < 600 AND (z >= 0 OR vz >= 0)))),
LA AS (SELECT shot_id, arg_max(x, k) AS x, arg_max(y, k) AS y, arg_max(z, k) AS z, arg_max(vz, k) AS vz, max(k) AS k FROM FL GROUP BY 1)
SELECT shot_id, CASE WHEN z < 0 AND vz < 0 THEN round_even(x, 4) END AS x, CASE WHEN z < 0 AND vz < 0 THEN round_even(y, 4) END AS y, CASE WHEN z < 0 AND vz < 0 THEN round_even(k * 0.005::DOUBLE, 4) END AS seconds FROM LA""")
def flight_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each hit's ball first lands, by simulation; a batch of flights is stepped at once."""

    @F.pandas_udf("x double, y double, seconds double")
    def land(x: pd.Series, y: pd.Series, v: pd.Series, side: pd.Series) -> pd.DataFrame:
        from rallyplan.functions.physics import STEP_S, fly

        place = np.stack([x, y, np.ones(len(x))], axis=1)
        pace = np.clip(v.to_numpy(float) / 3.6, 4.0, 60.0)
        places, _, bounce = fly(place, np.stack([np.zeros(len(x)), -side * pace, np.full(len(x), 3.0)], axis=1), 3.0)
        at = places[np.arange(len(x)), bounce]
        none = bounce < 0
        return pd.DataFrame({"x": np.where(none, np.nan, at[:, 0]), "y": np.where(none, np.nan, at[:, 1]), "seconds": np.where(none, np.nan, bounce * STEP_S)})

    h = hits(spark, sf_dir).where("speed_kmh IS NOT NULL")
    return h.select("shot_id", land("hit_x", "hit_y", "speed_kmh", "side").alias("l")).select("shot_id", *[half_even(F.col(f"l.{c}"), 4).alias(c) for c in ("x", "y", "seconds")])
