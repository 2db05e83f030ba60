"""Movement out of poses: technique of swings, split steps, recoveries, standing heights, contact points, over made-up poses that follow from the hit's id."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.operators import movement
from rallyplan.operators.robust import half_even
from rallyplan.plans.base import query
from rallyplan.plans.shots_stage import with_contact
from rallyplan.plans.swing_queries import STROKES_SQL, made_up_swings
from rallyplan.schema import KEYPOINTS
from rallyplan.sources.tracking import HITS_SQL, SHOTS_SQL, hits, shots

J = {n: KEYPOINTS.index(n) for n in KEYPOINTS}
#: A camera 18 m before the net and 4.6 m up that looks level along the court: its place, and what turns (px, py, 1) into a ray.
EYE, WAY = [0.0, -18.0, 4.6], [1.0, 0.0, -960.0, 0.0, 0.0, 1400.0, 0.0, -1.0, 540.0]
#: Frames around each hit in which the opponent's ankles are made up, 30 a second.
FRAMES = (-25, 10)


def _angle(a: str, b: str, c: str) -> str:
    """Angle ABC in SQL of points named <p>x, <p>y."""
    n = f"sqrt(({a}x - {b}x) ** 2 + ({a}y - {b}y) ** 2) * sqrt(({c}x - {b}x) ** 2 + ({c}y - {b}y) ** 2)"
    return f"CASE WHEN {n} > 0 THEN degrees(acos(least(1e0, greatest(-1e0, (({a}x - {b}x) * ({c}x - {b}x) + ({a}y - {b}y) * ({c}y - {b}y)) / ({n}))))) END"


_MOMENTS = ", ".join(repr(float(m)) + "::DOUBLE" for m in np.arange(*movement.TURN_AT))
_LEG = ", ".join(f"max(v{a}) FILTER (j = {J[f'{s}_{n}']}) AS {s}{n[0]}{a}" for s in "lr" for n in ("hip", "knee", "ankle") for a in "xy")
_ARM = ", ".join(f"avg(v{a}) FILTER (j = {J[f'{s}_{n}']} AND abs(rel) <= 0.04e0) AS {s}{n[0]}{a}" for s in "lr" for n in ("shoulder", "elbow", "wrist") for a in "xy")
TECHNIQUE_SQL = STROKES_SQL[: STROKES_SQL.rindex("),\nT AS (")] + f"""),
LEGS AS (SELECT shot_id, k, {_LEG} FROM V WHERE rel >= -0.45e0 AND rel <= 0e0 GROUP BY 1, 2),
KNEES AS (SELECT shot_id, quantile_cont(a, 0.1e0) AS v FROM (SELECT shot_id, {_angle("lh", "lk", "la")} AS a FROM LEGS UNION ALL SELECT shot_id, {_angle("rh", "rk", "ra")} FROM LEGS) WHERE a IS NOT NULL GROUP BY 1 HAVING count(*) >= 4),
ARMS AS (SELECT shot_id, {_ARM} FROM V GROUP BY 1),
ELBOWS AS (SELECT shot_id, CASE WHEN COALESCE(r_speed, 0) >= COALESCE(l_speed, 0) THEN {_angle("rs", "re", "rw")} ELSE {_angle("ls", "le", "lw")} END AS v FROM ARMS LEFT JOIN PACES USING (shot_id)),
WIDTHS AS (SELECT shot_id, m, sqrt((avg(vx) FILTER (j = {J["r_shoulder"]}) - avg(vx) FILTER (j = {J["l_shoulder"]})) ** 2 + (avg(vy) FILTER (j = {J["r_shoulder"]}) - avg(vy) FILTER (j = {J["l_shoulder"]})) ** 2) AS w FROM V, (SELECT unnest([{_MOMENTS}]) AS m) WHERE abs(rel - m) <= 0.03e0 GROUP BY 1, 2),
TURNS AS (SELECT shot_id, least(1e0, greatest(0e0, 1 - min(w) FILTER (m < -0.05e0) / max(w) FILTER (m > 0.1e0))) AS v FROM WIDTHS GROUP BY 1 HAVING count(w) FILTER (m < -0.05e0) >= 2 AND max(w) FILTER (m > 0.1e0) > 0),
SPEEDS AS (SELECT shot_id, CASE WHEN body > 0 THEN greatest(COALESCE(l_speed, 0), COALESCE(r_speed, 0)) / body END AS v FROM CUES LEFT JOIN PACES USING (shot_id))
SELECT shot_id, 'knee_bend_deg' AS name, round_even(v, 1) AS value FROM KNEES UNION ALL SELECT shot_id, 'elbow_contact_deg', round_even(v, 1) FROM ELBOWS WHERE v IS NOT NULL
UNION ALL SELECT shot_id, 'shoulder_turn', round_even(v, 3) FROM TURNS WHERE v IS NOT NULL UNION ALL SELECT shot_id, 'racket_arm_speed', round_even(v, 3) FROM SPEEDS WHERE v IS NOT NULL"""


@query(TECHNIQUE_SQL)
def technique_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knee bend, elbow at contact, shoulder turn and arm speed of every swing."""
    return movement.technique(made_up_swings(hits(spark, sf_dir)))


def made_up_opponents(h: DataFrame) -> DataFrame:
    """motion (video_id, track, t, kp_x, kp_y, kp_c, height) of the player who doesn't hit, around each hit: some hop, some ankles are unsure."""
    i = F.col("shot_id")
    rows = h.select("session_id", i, F.col("t").alias("hit_t"), (2 * F.col("session_id") + 1 - F.col("video")).alias("track"), F.explode(F.sequence(F.lit(FRAMES[0]), F.lit(FRAMES[1]))).alias("k"))
    hop = F.when((i % 3 == 0) & F.col("k").between(-8, -3), ((i % 7) + 1).cast("double")).otherwise(0.0)
    y = 500.0 + (i % 13) + ((i * 7 + F.col("k") * 11 + 400) % 5) / 4.0 - hop
    sure = F.when((i + F.col("k")) % 6 != 0, 0.9).otherwise(0.2)
    place = lambda of, j: F.when((j == J["l_ankle"]) | (j == J["r_ankle"]), of).otherwise(F.lit(0.0))
    every = F.sequence(F.lit(0), F.lit(16))
    arrays = {"kp_x": lambda j: place(F.lit(100.0), j), "kp_y": lambda j: place(F.col("y"), j), "kp_c": lambda j: place(F.col("sure"), j)}
    return rows.withColumns({"y": y, "sure": sure}).select(F.col("session_id").alias("video_id"), "track", (F.col("hit_t") + F.col("k") / 30.0).alias("t"), *[F.transform(every, f).alias(n) for n, f in arrays.items()], (90.0 + F.col("shot_id") % 20).alias("height"))


def own_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shot_id, video_id, label, rally, t: the sessions stand in for videos, player ids for labels and tracks."""
    return shots(spark, sf_dir).select("shot_id", F.col("session_id").alias("video_id"), F.col("player_id").cast("string").alias("label"), "rally", "t")


def own_labels(rows: DataFrame, track: str) -> DataFrame:
    return rows.select("video_id", F.col(track).alias("track_id"), F.col(track).cast("string").alias("label")).distinct()


@query(f"""WITH {SHOTS_SQL}, M AS (SELECT session_id, 2 * session_id + 1 - video AS player_id, t + k / 30e0 AS mt, 90e0 + shot_id % 20 AS height,
  500e0 + shot_id % 13 + ((shot_id * 7 + k * 11 + 400) % 5) / 4e0 - CASE WHEN shot_id % 3 = 0 AND k BETWEEN -8 AND -3 THEN CAST(shot_id % 7 + 1 AS DOUBLE) ELSE 0e0 END AS y
  FROM H, (SELECT unnest(range({FRAMES[0]}, {FRAMES[1] + 1})) AS k) WHERE (shot_id + k) % 6 <> 0),
SP AS (SELECT shot_id, session_id, player_id, rally, LAG(t) OVER w AS pt, LAG(player_id) OVER w AS other, LAG(rally) OVER w AS before FROM S WINDOW w AS (PARTITION BY session_id ORDER BY t, shot_id)),
NR AS (SELECT shot_id, y, height, mt - pt AS rel FROM SP JOIN M USING (session_id, player_id) WHERE other <> player_id AND before = rally AND mt >= pt - 0.8e0 AND mt <= pt + 0.3e0),
HP AS (SELECT shot_id, count(*) AS n, count(*) FILTER (rel >= -0.45e0 AND rel <= 0.25e0) AS hops, median(height) AS height,
  COALESCE(median(y) FILTER (rel >= -0.8e0 AND rel <= -0.45e0), max(y) FILTER (rel >= -0.45e0 AND rel <= 0.25e0)) - min(y) FILTER (rel >= -0.45e0 AND rel <= 0.25e0) AS rise FROM NR GROUP BY 1)
SELECT shot_id, CASE WHEN rise / height > 0.025e0 THEN 1e0 ELSE 0e0 END AS split_step FROM HP WHERE n >= 8 AND hops >= 6 AND height > 0""")
def split_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did the player hop as the opponent hit, before each shot that answers one?"""
    motion = made_up_opponents(hits(spark, sf_dir))
    return movement.split_steps(own_shots(spark, sf_dir), motion, own_labels(motion, "track"))


@query(f"""WITH {HITS_SQL}, N AS (SELECT a.shot_id, b.hit_x, ROW_NUMBER() OVER (PARTITION BY a.shot_id ORDER BY abs(b.t - (a.t + 1.2e0)), b.t, abs(b.hit_x)) AS r FROM H a JOIN H b ON a.session_id = b.session_id AND a.player_id = b.player_id AND abs(b.t - (a.t + 1.2e0)) <= 0.3e0)
SELECT shot_id, round_even(abs(hit_x), 2) AS recovery_m FROM N WHERE r = 1""")
def recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far from the middle the hitter is 1.2 s later (hits stand in for feet)."""
    people = hits(spark, sf_dir).select(F.col("session_id").alias("video_id"), F.col("player_id").alias("track_id"), "t", F.col("hit_x").alias("court_x"))
    return movement.recoveries(own_shots(spark, sf_dir), people, own_labels(people, "track_id"))


def seen_at(x: str, y: str, z: str) -> tuple[str, str]:
    """Where the camera EYE, WAY shows a place, in SQL that both engines take."""
    return f"960e0 + 1400e0 * ({x}) / (({y}) + 18e0)", f"540e0 + 1400e0 * (4.6e0 - ({z})) / (({y}) + 18e0)"


#: A nose between 1.4 and 2.02 m in four frames a hit, every 17th far too high.
NOSE = "CASE WHEN shot_id % 17 = 0 THEN 2.8e0 ELSE 1.4e0 + (shot_id % 60 + k) / 100e0 END"


@query(f"""WITH {HITS_SQL}, N AS (SELECT session_id AS video_id, player_id, {NOSE} AS z FROM H, (SELECT unnest(range(0, 4)) AS k) WHERE shot_id % 9 <> 0)
SELECT video_id, CAST(player_id AS VARCHAR) AS label, round_even(quantile_cont(z / 0.935e0, 0.9e0) FILTER (z > 0.8e0 AND z < 2.3e0), 3) AS height_m FROM N GROUP BY 1, 2 HAVING count(*) >= 50 AND count(*) FILTER (z > 0.8e0 AND z < 2.3e0) >= 30""")
def standing_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of the players, out of pixels of nose and ankles in a known camera; the SQL knows how high each nose was."""
    (ax, ay), (nx, ny) = seen_at("hit_x", "hit_y", "0.08e0"), seen_at("hit_x", "hit_y", NOSE)
    seen = hits(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr("session_id AS video_id", "player_id AS track", f"{ax} AS ax", f"{ay} AS ay", f"{nx} AS nx", f"{ny} AS ny", "CASE WHEN shot_id % 9 <> 0 THEN 0.9e0 ELSE 0.4e0 END AS sure")
    of = lambda nose, ankle: F.transform(F.sequence(F.lit(0), F.lit(16)), lambda j: F.when(j == J["nose"], nose).when(j == J["l_ankle"], ankle - 3.0).when(j == J["r_ankle"], ankle + 3.0).otherwise(0.0))
    motion = seen.select("video_id", "track", of(F.col("nx"), F.col("ax")).alias("kp_x"), of(F.col("ny"), F.col("ay")).alias("kp_y"), F.transform(F.sequence(F.lit(0), F.lit(16)), lambda _: F.col("sure")).alias("kp_c"))
    eyes = motion.select("video_id").distinct().withColumns({"eye": F.array(*map(F.lit, EYE)), "way": F.array(*map(F.lit, WAY))})
    return movement.standing_heights(motion, own_labels(motion, "track"), eyes)


@query(f"""WITH {HITS_SQL}, W AS (SELECT shot_id, stroke, hit_x, hit_y, stroke IN ('serve', 'overhead') AS over, shot_id % 4 <> 0 AS l, shot_id % 5 <> 0 AS r, hit_x + (shot_id % 7) - 3 AS lx, (shot_id % 38) / 10e0 + 0.05e0 AS lz, hit_x + (shot_id % 5) - 2 AS rx, (shot_id % 29) / 10e0 + 0.03e0 AS rz FROM H),
C AS (SELECT *, CASE WHEN l AND (NOT r OR NOT over OR lz >= rz) THEN lx WHEN r THEN rx END AS x, CASE WHEN l AND (NOT r OR NOT over OR lz >= rz) THEN lz WHEN r THEN rz END AS z FROM W),
D AS (SELECT *, COALESCE(z > 0.1e0 AND z < 3.4e0 AND abs(x - hit_x) <= 2.5e0, false) AS reached FROM C)
SELECT shot_id, round_even(CASE WHEN reached THEN x ELSE hit_x END, 4) AS contact_x, hit_y AS contact_y, round_even(CASE WHEN reached THEN least(3.3e0, z + CASE WHEN over THEN 0.35e0 ELSE 0.1e0 END) WHEN over THEN 2.6e0 ELSE 1e0 END, 4) AS contact_z FROM D""")
def contact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each ball was hit, out of the pixels of the wrists in a known camera; the SQL knows where the wrists were."""
    (lx, ly), (rx, ry) = seen_at("hit_x + (shot_id % 7) - 3", "hit_y", "(shot_id % 38) / 10e0 + 0.05e0"), seen_at("hit_x + (shot_id % 5) - 2", "hit_y", "(shot_id % 29) / 10e0 + 0.03e0")
    shown = lambda when, x: f"CASE WHEN {when} THEN {x} END"
    rows = hits(spark, sf_dir).selectExpr("shot_id AS hit_id", "session_id AS video_id", "stroke", "hit_x", "hit_y", *[f"{shown('shot_id % 4 <> 0', v)} AS {n}" for n, v in (("l_x", lx), ("l_y", ly))], *[f"{shown('shot_id % 5 <> 0', v)} AS {n}" for n, v in (("r_x", rx), ("r_y", ry))])
    eyes = rows.select("video_id").distinct().withColumns({"eye": F.array(*map(F.lit, EYE)), "way": F.array(*map(F.lit, WAY))})
    return with_contact(rows, eyes).select(F.col("hit_id").alias("shot_id"), half_even(F.col("contact_x"), 4).alias("contact_x"), "contact_y", half_even(F.col("contact_z"), 4).alias("contact_z"))
