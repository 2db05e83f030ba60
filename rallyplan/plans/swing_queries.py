"""Strokes out of poses: the classification of every hit, over made-up poses that follow from the hit's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.operators import swings
from rallyplan.operators.robust import half_even
from rallyplan.plans.base import query
from rallyplan.sources.tracking import HITS_SQL, hits

# A standing figure, x and y of each keypoint in pixels (y grows downwards).
FIGURE_X = [0, -2, 2, -4, 4, -10, 10, -15, 15, -15, 15, -7, 7, -7, 7, -7, 7]
FIGURE_Y = [-90, -92, -92, -90, -90, -80, -80, -60, -60, -45, -45, -50, -50, -25, -25, 0, 0]
#: Frames before and after a hit, 30 a second.
FRAMES = (-21, 9)


#: Fixed value: swings that a task sorts the samples of.
SWINGS = 20_000


def made_up_swings(h: DataFrame) -> DataFrame:
    """Swing samples of each hit: every keypoint moves steadily, some wrists are up, some keypoints unsure.

    Hits are dealt out by their id before they become samples, so those need no shuffle.
    """
    tasks = max(int(h.sparkSession.conf.get("spark.sql.shuffle.partitions")), h.count() // SWINGS + 1)
    frames = h.select("shot_id").repartition(tasks, "shot_id").select("shot_id", F.explode(F.sequence(F.lit(FRAMES[0]), F.lit(FRAMES[1]))).alias("k"))
    i, k = F.col("shot_id"), F.col("k")
    raised = {9: (i % 4 == 0) & (i % 8 == 0), 10: (i % 4 == 0) & (i % 8 != 0)}
    x = lambda j: F.lit(FIGURE_X[j]) + ((i * 7 + j * 13) % 31 - 15) * k / 10.0 + (i % 97 + 1) * k * 0.013
    up = lambda j: F.when(raised[j], -60.0).otherwise(0.0) if j in raised else F.lit(0.0)
    y = lambda j: F.lit(FIGURE_Y[j]) + ((i * 11 + j * 17) % 29 - 14) * k / 5.0 + up(j)
    c = lambda j: ((i + j * 3 + (k + 30) * 5) % 10) / 10.0
    rel = F.get(F.transform(F.array(k), lambda x: x / 30.0), 0)  # transform has no generated code: so all of this stays out of one long method that the JVM wouldn't compile
    return frames.select(i.alias("hit_id"), rel.alias("rel"), *[F.array(*map(f, range(17))).alias(n) for n, f in (("kp_x", x), ("kp_y", y), ("kp_c", c))])


def _at(j: int, axis: str, at: float, within: float) -> str:
    return f"avg(v{axis}) FILTER (j = {j} AND abs(rel - ({at}e0)) <= {within}e0)"


def _vote(at: float) -> str:
    y = lambda j: _at(j, "y", at, 0.02)
    head, feet, left, right = f"least({y(0)}, {y(1)}, {y(2)})", f"greatest({y(15)}, {y(16)})", y(9), y(10)
    return f"CASE WHEN {left} IS NOT NULL AND {right} IS NOT NULL AND least({left}, {right}) < {head} - 0.05e0 * ({feet} - {head}) AND abs({left} - {right}) > 0.2e0 * ({feet} - {head}) THEN CASE WHEN {left} < {right} THEN 'left' ELSE 'right' END END"


def _between(at: float, a: str) -> str:
    middle = lambda p, q: f"COALESCE(({_at(p, a, at, 0.05)} + {_at(q, a, at, 0.05)}) / 2, {_at(p, a, at, 0.05)}, {_at(q, a, at, 0.05)})"
    return f"({middle(9, 10)} - {middle(11, 12)})"


STROKES_SQL = f"""WITH {HITS_SQL}, S AS (
  SELECT shot_id, k, k / 30e0 AS rel, j, ({FIGURE_X})[j + 1] + ((shot_id * 7 + j * 13) % 31 - 15) * k / 10e0 + (shot_id % 97 + 1) * k * 0.013e0 AS x,
    ({FIGURE_Y})[j + 1] + ((shot_id * 11 + j * 17) % 29 - 14) * k / 5e0 + CASE WHEN shot_id % 4 = 0 AND j = CASE WHEN shot_id % 8 = 0 THEN 9 ELSE 10 END THEN -60e0 ELSE 0e0 END AS y, ((shot_id + j * 3 + (k + 30) * 5) % 10) / 10e0 AS c
  FROM H, (SELECT unnest(range({FRAMES[0]}, {FRAMES[1] + 1})) AS k), (SELECT unnest(range(0, 17)) AS j)
), V AS (SELECT *, CASE WHEN c >= 0.3e0 THEN x END AS vx, CASE WHEN c >= 0.3e0 THEN y END AS vy FROM S),
LIFTS AS (SELECT shot_id, max(up) FILTER (rel >= -0.3e0 AND rel <= 0.15e0) AS lift FROM (SELECT shot_id, rel, min(vy) FILTER (j IN (0, 1, 2)) - min(vy) FILTER (j IN (9, 10)) AS up FROM V GROUP BY 1, 2) GROUP BY 1),
STEPS AS (SELECT shot_id, j, sqrt((x - LAG(x) OVER w) ** 2 + (y - LAG(y) OVER w) ** 2) / greatest(rel - LAG(rel) OVER w, 0.001e0) AS pace FROM V WHERE j IN (9, 10) AND vx IS NOT NULL AND rel >= -0.35e0 AND rel <= 0.05e0 WINDOW w AS (PARTITION BY shot_id, j ORDER BY k)),
PACES AS (SELECT shot_id, COALESCE(max(q) FILTER (j = 9), 0) AS l_speed, COALESCE(max(q) FILTER (j = 10), 0) AS r_speed FROM (SELECT shot_id, j, CASE WHEN count(*) >= 3 THEN quantile_cont(pace, 0.9e0) END AS q FROM STEPS GROUP BY 1, 2) GROUP BY 1),
CUES AS (SELECT shot_id, (greatest({", ".join(_at(j, "y", 0.0, 0.2) for j in (15, 16, 13, 14))}) - least({", ".join(_at(j, "y", 0.0, 0.2) for j in (0, 5, 6))})) * 1.15e0 AS body,
    {_between(-0.25, "x")} - {_between(0.25, "x")} AS way, {", ".join(f"{_at(j, 'y', at, within)} AS {s}_{n}" for s, j in (("l", 9), ("r", 10)) for n, at, within in (("drawn", -0.2, 0.05), ("met", 0.0, 0.03)))},
    COALESCE({", ".join(map(_vote, swings.HAND_AT))}) AS vote FROM V GROUP BY 1),
J AS (SELECT H.shot_id, abs(hit_y) AS from_net, H.shot_id % 5 = 0 AS first_in_rally, body, lift, vote, CASE WHEN r_speed >= l_speed THEN r_drawn - r_met ELSE l_drawn - l_met END / body AS rise,
    way * side * CASE WHEN H.shot_id % 3 = 0 THEN 1 ELSE -1 END / body AS across FROM H JOIN CUES USING (shot_id) JOIN LIFTS USING (shot_id) LEFT JOIN PACES USING (shot_id)),
T AS (SELECT *, COALESCE(lift > 0.15e0 * body, false) AS overhead, COALESCE(from_net < 6, false) AS volley, CASE WHEN across > 0 THEN 'forehand' ELSE 'backhand' END AS hand_side FROM J)
SELECT shot_id, vote, CASE WHEN body IS NULL OR body <= 0 THEN 'unknown' WHEN overhead THEN CASE WHEN first_in_rally OR from_net > 10.5e0 THEN 'serve' ELSE 'overhead' END WHEN across IS NULL THEN 'unknown' WHEN volley THEN 'volley_' || hand_side ELSE hand_side END AS stroke,
  CASE WHEN body > 0 AND NOT overhead AND (across IS NULL OR NOT volley) THEN CASE WHEN rise > 0.12e0 THEN 'topspin' WHEN rise < -0.08e0 THEN 'slice' WHEN rise IS NOT NULL THEN 'flat' END END AS spin,
  round_even(CASE WHEN body IS NULL OR body <= 0 THEN 0 WHEN overhead THEN 0.8e0 WHEN across IS NULL THEN 0.2e0 ELSE least(greatest(abs(across) / 0.3e0, 0.3e0), 1) END, 6) AS confidence,
  round_even(CASE WHEN body > 0 AND NOT overhead AND across IS NOT NULL THEN across ELSE 0 END, 6) AS across FROM T"""


@query(STROKES_SQL)
def stroke_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stroke, spin, surety and direction of every swing, and the hand that an overhead swing votes for."""
    h = hits(spark, sf_dir)
    i = F.col("shot_id")
    known = h.select(i.alias("hit_id"), F.when(i % 3 == 0, "left").otherwise("right").alias("hand"), (-F.col("side")).cast("double").alias("right_x"), F.lit(0.0).alias("right_y"), (i % 5 == 0).alias("first_in_rally"), F.abs("hit_y").alias("from_net_m"))
    out = swings.classified(swings.cues(made_up_swings(h)).join(known, "hit_id"))
    return out.select(F.col("hit_id").alias("shot_id"), "vote", "stroke", "spin", half_even(F.col("confidence"), 6).alias("confidence"), half_even(F.col("across"), 6).alias("across"))
