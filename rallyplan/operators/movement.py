"""How players move: technique of a swing, split step, recovery, standing height; all swings, shots and players at once.

Everything is an aggregate over pose samples that a join by time has brought to the
swing, the opponent's hit or the player; rays through pixels are columns, from one
narrow row a camera. Nothing is collected and no group is held in memory.

Defined results: what can't be told (too few samples, keypoints unsure, no camera) is
left out, never guessed; a player without a label has no movement; empty tables give
empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G
from rallyplan.operators import swings, timejoin
from rallyplan.operators.robust import half_even
from rallyplan.operators.stretches import Bend, Turn
from rallyplan.schema import KEYPOINTS

# Surety of keypoints (movement, height); knees are looked at so many seconds around the hit, at least so many angles.
SURE, SURE_OF_HEIGHT = 0.3, 0.5
KNEE_S, LEAST_KNEES, KNEE_SHARE = (-0.45, 0.0), 4, 0.1
# Shoulders are measured every STEP seconds (first, last), within so many; before and after which moment they are drawn and turned.
TURN_AT, TURN_WITHIN, DRAWN, TURNED, LEAST_DRAWN = (-0.6, 0.31, 0.05), 0.03, -0.05, 0.1, 2
# Seconds around the opponent's hit: all, of the hop, of the ground line; samples of each; part of the body's height that is a hop.
STEP_S, HOP_S, GROUND_S, LEAST_STEP, LEAST_HOP, HOP = (-0.8, 0.3), (-0.45, 0.25), (-0.8, -0.45), 8, 6, 0.025
# When, and how near to that, the place of recovery is looked up.
RECOVERED_S, RECOVERED_WITHIN = 1.2, 0.3
# Ankles over the ground, the nose's part of the height, heights of a nose that count, frames seen and used at least.
ANKLE_M, NOSE_SHARE, NOSE_M, LEAST_SEEN, LEAST_HEIGHTS = 0.08, 0.935, (0.8, 2.3), 50, 30


def _point(name: str, least: float = SURE) -> tuple[Column, Column]:
    """A keypoint of a sample; null where it isn't sure."""
    i = F.lit(KEYPOINTS.index(name))
    return tuple(F.when(F.get("kp_c", i) >= least, F.get(f"kp_{a}", i).cast("double")) for a in "xy")


def technique(samples: DataFrame) -> DataFrame:
    """(shot_id, name, value): knee_bend_deg, elbow_contact_deg, shoulder_turn, racket_arm_speed of each swing.

    samples: hit_id, rel, kp_x, kp_y, kp_c (``swings.around_hits``).
    """
    c = swings.Cues()
    corners = tuple(tuple(c.value(a, f"{s}_{j}") for j in ("hip", "knee", "ankle") for a in "xy") for s in "lr")
    knee = half_even(c.ask(Bend(corners, *KNEE_S, KNEE_SHARE, LEAST_KNEES)), 1)

    body, left, right = c.body(), c.speed("l"), c.speed("r")
    own = lambda j, a: F.when(right >= left, c.mean(a, f"r_{j}", 0.0, 0.04)).otherwise(c.mean(a, f"l_{j}", 0.0, 0.04))
    elbow = G.angle(*[own(j, a) for j in ("shoulder", "elbow", "wrist") for a in "xy"])
    speed = F.when(body > 0, half_even(F.greatest(left, right) / body, 3))

    # a sample counts for the moments that it is near to; of each moment the mean places of the shoulders, of those the widths
    shoulders = [c.value(a, f"{s}_shoulder") for s in "lr" for a in "xy"]
    c.wanted["turn"] = Turn(*shoulders, tuple(map(float, np.arange(*TURN_AT))), TURN_WITHIN, DRAWN, TURNED)
    turn = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("turn_drawn") / F.col("turn_turned")))
    turn = F.when((F.col("turn_n") >= LEAST_DRAWN) & (F.col("turn_turned") > 0), half_even(turn, 3))

    measures = {"knee_bend_deg": knee, "elbow_contact_deg": half_even(elbow, 1), "shoulder_turn": turn, "racket_arm_speed": speed}
    told = c.told(samples).select(F.col("hit_id").alias("shot_id"), *[x.alias(n) for n, x in measures.items()])
    return told.select("shot_id", F.explode(F.create_map(*[x for n in measures for x in (F.lit(n), F.col(n))])).alias("name", "value")).where("value IS NOT NULL")


def split_steps(shots: DataFrame, motion: DataFrame, labels: DataFrame) -> DataFrame:
    """(shot_id, split_step): did the player leave the ground (1 or 0) around the opponent's hit before this shot?

    shots: shot_id, video_id, label, rally, t (video clock); motion: video_id, track, t,
    kp_x, kp_y, kp_c, height; labels: video_id, track_id, label.
    """
    w = Window.partitionBy("video_id").orderBy("t", "shot_id")
    s = shots.withColumns({"at": F.lag("t").over(w), "other": F.lag("label").over(w), "before": F.lag("rally").over(w)})
    s = s.where("label IS NOT NULL AND other <> label AND before = rally")
    spans = s.select("shot_id", "video_id", "label", "at", (F.col("at") + STEP_S[0]).alias("lo"), (F.col("at") + STEP_S[1]).alias("hi"))
    ankles = (_point("l_ankle")[1] + _point("r_ankle")[1]) / 2
    who = labels.select("video_id", F.col("track_id").alias("track"), "label")
    poses = motion.select("video_id", "track", "t", ankles.alias("ankle"), F.col("height").cast("double").alias("height")).where("ankle IS NOT NULL").join(who, ["video_id", "track"])
    near = timejoin.interval(poses, spans, ["video_id", "label"], "t", "lo", "hi", 4.0).withColumn("rel", F.col("t") - F.col("at"))
    hop, ground = F.col("rel").between(*HOP_S), F.col("rel").between(*GROUND_S)
    line = F.coalesce(F.median(F.when(ground, F.col("ankle"))), F.max(F.when(hop, F.col("ankle"))))  # the picture's y grows downwards
    rise = (line - F.min(F.when(hop, F.col("ankle")))) / F.median("height")
    told = near.groupBy("shot_id").agg(F.count("*").alias("n"), F.count_if(hop).alias("hops"), F.median("height").alias("height"), rise.alias("rise"))
    return told.where((F.col("n") >= LEAST_STEP) & (F.col("hops") >= LEAST_HOP) & (F.col("height") > 0)).select("shot_id", F.when(F.col("rise") > HOP, 1.0).otherwise(0.0).alias("split_step"))


def recoveries(shots: DataFrame, people: DataFrame, labels: DataFrame) -> DataFrame:
    """(shot_id, recovery_m): how far from the court's middle line the player is RECOVERED_S after the shot.

    shots: shot_id, video_id, label, t (video clock); people: video_id, track_id, t, court_x.
    """
    feet = people.join(labels.select("video_id", "track_id", "label"), ["video_id", "track_id"]).select("video_id", "label", "t", F.abs(F.col("court_x").cast("double")).alias("off"))
    at = shots.where("label IS NOT NULL").select("shot_id", "video_id", "label", (F.col("t") + RECOVERED_S).alias("t"))
    near = timejoin.nearest(at, feet, ["video_id", "label"], "t", ["off"], RECOVERED_WITHIN, "shot_id")
    return near.where(F.col("off").isNotNull() & ~F.isnan("off")).select("shot_id", half_even(F.col("off"), 2).alias("recovery_m"))


def eyes(cameras: DataFrame) -> DataFrame:
    """(video_id, eye: centre x, y, z; way: 9 numbers, row by row): the ray through a pixel goes from eye along way * (px, py, 1).

    cameras: video_id, homography (court to picture, row by row), width, height; those without a pinhole camera are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from rallyplan.functions import physics

        for frame in frames:
            rows = []
            for c in frame.itertuples():
                camera = physics.camera_from_homography(np.array(c.homography, float), (int(c.width), int(c.height)))
                if camera is not None:
                    lens = np.array([[1, 0, -c.width / 2], [0, 1, -c.height / 2], [0, 0, camera.focal]]) / camera.focal
                    rows.append((c.video_id, camera.place.tolist(), (np.asarray(camera.rotation).T @ lens).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["video_id", "eye", "way"])

    return cameras.select("video_id", "homography", "width", "height").mapInPandas(run, f"video_id {dict(cameras.dtypes)['video_id']}, eye array<double>, way array<double>")


def ray(px: Column, py: Column) -> tuple[Column, Column, Column]:
    """Direction of the ray through a pixel, for rows with ``way``."""
    m = lambda i: F.get("way", F.lit(i))
    return tuple(m(3 * r) * px + m(3 * r + 1) * py + m(3 * r + 2) for r in range(3))


def eye() -> tuple[Column, Column, Column]:
    return tuple(F.get("eye", F.lit(i)) for i in range(3))


def standing_heights(motion: DataFrame, labels: DataFrame, eyes_: DataFrame) -> DataFrame:
    """(video_id, label, height_m): body height from the frames that show nose and ankles, all of them.

    Where the ray through the ankles is ANKLE_M over the ground, the player stands; the
    nose is where its ray comes nearest to the vertical line there.
    """
    (nx, ny), (lx, ly), (rx, ry) = (_point(n, SURE_OF_HEIGHT) for n in ("nose", "l_ankle", "r_ankle"))
    who = labels.select("video_id", F.col("track_id").alias("track"), "label")
    seen = motion.select("video_id", "track", nx.alias("nx"), ny.alias("ny"), ((lx + rx) / 2).alias("ax"), ((ly + ry) / 2).alias("ay")).where("nx IS NOT NULL AND ax IS NOT NULL")
    rows = seen.join(who, ["video_id", "track"]).join(eyes_, "video_id")
    (ex, ey, ez), a, d = eye(), ray(F.col("ax"), F.col("ay")), ray(F.col("nx"), F.col("ny"))
    down = F.when(a[2] != 0, (ANKLE_M - ez) / a[2])
    rows = rows.withColumns({"fx": down * a[0], "fy": down * a[1], "dx": d[0], "dy": d[1], "dz": d[2], "ez": ez})
    level = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    nose = F.col("ez") + F.when(level > 0, (F.col("fx") * F.col("dx") + F.col("fy") * F.col("dy")) / level) * F.col("dz")
    rows = rows.withColumn("nose", nose).withColumn("good", (F.col("nose") > NOSE_M[0]) & (F.col("nose") < NOSE_M[1]))
    height = half_even(F.percentile(F.when(F.col("good"), F.col("nose") / NOSE_SHARE), F.lit(0.9)), 3)
    told = rows.groupBy("video_id", "label").agg(F.count("*").alias("seen"), F.count_if("good").alias("used"), height.alias("height_m"))
    return told.where((F.col("seen") >= LEAST_SEEN) & (F.col("used") >= LEAST_HEIGHTS)).select("video_id", "label", "height_m")
