"""What speaks for a hit: moments out of sound, ball and wrists, and the cues around them, as windows and joins by time.

Wrist speeds are one window by (video, track); everything around a moment comes
from interval joins by video and time bucket with one aggregate each, so a long
video spreads over many tasks. Only two steps carry state from row to row and run
by video over few, narrow rows: moments that fall together, and the best chain.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyplan.operators import gaps, sequence, timejoin
from rallyplan.schema import HITS, KEYPOINTS

# Seconds around a moment in which a player, the ball, a turn and a swing are looked for.
NEAR_S, BALL_S, TURN_S = 0.1, 0.05, 0.15
PEAK_S, AROUND_S = (-0.12, 0.08), (-0.4, 0.3)
# Surety of a keypoint, longest step between frames, share of a fast swing that makes a peak.
SURE, STEP_S, PEAK_SHARE = 0.25, 0.1, 0.6
# Sharpness, least way in pixels, longest span and least pause of a turn of the ball.
SHARP, TURN_PX, TURN_SPAN_S, TURN_PAUSE_S = 0.25, 4.0, 0.3, 0.1
# Reach of a racket in body heights, weights of the cues.
REACH, REACH_SLACK = 0.45, 0.5
WEIGHTS = {"swing": 0.55, "sound": 0.35, "near": 0.35, "turn": 0.1, "lost_ball": 0.12, "no_ball": 1.6}
WRISTS = {"l": KEYPOINTS.index("l_wrist"), "r": KEYPOINTS.index("r_wrist")}


def unit(x: Column) -> Column:
    """x within 0 to 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def bend(ux: Column, uy: Column, vx: Column, vy: Column, least: float) -> Column:
    """0 for two steps in one direction, 1 for back; null where one is shorter than ``least``."""
    n, m = length(ux, uy), length(vx, vy)
    return F.when((n >= least) & (m >= least), (1 - (ux * vx + uy * vy) / (n * m)) / 2)


def wrist_samples(motion: DataFrame, sides: DataFrame) -> DataFrame:
    """Every pose of a track with a side: wrists, speed of the faster one (heights a second, median of three), the track's usual and fast speed."""
    own = motion.join(sides, ["video_id", "track"])
    cell = lambda c, k: F.get(F.col(c), F.lit(k)).cast("double")
    rows = own.select("video_id", "track", "side", "t", F.greatest(F.col("height").cast("double"), F.lit(1.0)).alias("height"), *[cell(f"kp_{a}", k).alias(f"{a}_{w}") for w, k in WRISTS.items() for a in "xyc"])
    track = ["video_id", "track"]
    w, whole = gaps.ordered(track, ["t"]), Window.partitionBy(*track)
    dt = F.col("t") - F.lag("t").over(w)

    def pace(k: str) -> Column:
        step = length(*[F.col(f"{a}_{k}") - F.lag(f"{a}_{k}").over(w) for a in "xy"])
        seen = (F.col(f"c_{k}") >= SURE) & (F.lag(f"c_{k}").over(w) >= SURE) & (dt < STEP_S)
        return F.when(seen, step / F.greatest(dt, F.lit(1e-3)) / F.col("height")).otherwise(0.0)

    rows = rows.withColumns({"raw": F.greatest(*map(pace, WRISTS)), "samples": F.count("*").over(whole)})
    three = F.sort_array(F.array(F.coalesce(F.lag("raw").over(w), "raw"), "raw", F.coalesce(F.lead("raw").over(w), "raw")))
    rows = rows.withColumn("speed", F.when(F.col("samples") >= 3, three[1]).otherwise(0.0)).drop("raw")
    share = lambda p: F.percentile("speed", F.lit(p)).over(whole)
    rows = rows.withColumns({"usual": share(0.5), "fast": share(0.97)}).withColumn("fast", F.greatest("fast", F.col("usual") + 1e-3))
    top = (F.col("speed") >= F.lag("speed").over(w)) & (F.col("speed") >= F.lead("speed").over(w)) & (F.col("speed") > PEAK_SHARE * F.col("fast"))
    return rows.withColumn("is_peak", F.coalesce(top, F.lit(False)))


def ball_turns(ball: DataFrame) -> DataFrame:
    """(video_id, t): samples of the ball between whose neighbours at three steps its way turns by over 60 degrees."""
    w = gaps.ordered(["video_id"], ["t"])
    ahead, back = lambda c: F.lead(c, 3).over(w), lambda c: F.lag(c, 3).over(w)
    sharp = bend(F.col("x") - back("x"), F.col("y") - back("y"), ahead("x") - F.col("x"), ahead("y") - F.col("y"), TURN_PX) > SHARP
    short = ahead("t") - back("t") <= TURN_SPAN_S
    return ball.select("video_id", "t", (sharp & short & (F.count("*").over(Window.partitionBy("video_id")) >= 8)).alias("ok")).where("ok").select("video_id", "t")


def moments(onsets: DataFrame, ball: DataFrame, samples: DataFrame) -> DataFrame:
    """(video_id, moment, t, loudness, sources): when something speaks for a hit; what falls together is one moment."""
    by_loudness = Window.partitionBy("video_id").orderBy("peak_db", "t")
    rank = (F.row_number().over(by_loudness) - 1) / F.greatest(F.count("*").over(Window.partitionBy("video_id")) - 1, F.lit(1))
    row = lambda source, loudness: [F.col("video_id"), F.col("t").cast("double").alias("t"), F.lit(source).alias("source"), loudness.cast("double").alias("loudness")]
    rows = onsets.select(*row("audio", rank)).unionByName(ball_turns(ball).select(*row("ball", F.lit(0.0)))).unionByName(samples.where("is_peak").select(*row("pose", F.lit(0.0))))

    def f(own: pd.DataFrame) -> pd.DataFrame:
        turns = (own.source == "ball").to_numpy()
        keep = ~turns
        keep[turns] = sequence.suppress_after(own.t.to_numpy()[turns], TURN_PAUSE_S)
        own = own[keep]
        found = sequence.merge_moments(own.t.to_numpy(), own.source.tolist(), own.loudness.to_numpy())
        return pd.DataFrame({"video_id": own.video_id.iloc[0], "moment": range(len(found)), "t": [m["t"] for m in found], "loudness": [m["loudness"] for m in found], "sources": [sorted(m["sources"]) for m in found]})

    return sequence.per_group(rows, ["video_id"], ["t", "source"], f, "video_id long, moment long, t double, loudness double, sources array<string>")


def around(spans: DataFrame, samples: DataFrame, before: float, after: float) -> DataFrame:
    """moments x the video's samples (their time is ``s``) from ``before`` (negative) to ``after``."""
    wide = spans.select("video_id", "moment", F.col("t").alias("at"), (F.col("t") + before).alias("lo"), (F.col("t") + after).alias("hi"))
    return timejoin.interval(samples.withColumnRenamed("t", "s"), wide, ["video_id"], "s", "lo", "hi", 4 * (after - before))


def ball_cues(spans: DataFrame, ball: DataFrame) -> DataFrame:
    """(video_id, moment, place, turn): where the ball is, and how much its way bends; null where that can't be told."""
    several = ball.withColumn("n", F.count("*").over(Window.partitionBy("video_id"))).where("n > 1")
    near = around(spans, several.select("video_id", F.col("t").cast("double").alias("t"), F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("xy")), -TURN_S, TURN_S)
    way = F.abs(F.col("s") - F.col("at"))
    before, after = F.col("s") < F.col("at"), (F.col("s") >= F.col("at")) & (F.col("s") < F.col("hi"))
    ends = {f"{side}_{which}": F.min_by("xy", F.when(half, F.col("s") * sign)) for side, half in (("a", before), ("b", after)) for which, sign in (("first", 1), ("last", -1))}
    found = near.groupBy("video_id", "moment").agg(
        F.min_by("xy", F.when(way <= BALL_S, F.struct(way.alias("w"), F.col("s").alias("s")))).alias("place"), F.count_if(before).alias("n_a"), F.count_if(after).alias("n_b"), *[c.alias(k) for k, c in ends.items()],
    )
    step = lambda side: [F.col(f"{side}_last.{c}") - F.col(f"{side}_first.{c}") for c in "xy"]
    return found.select("video_id", "moment", "place", F.when((F.col("n_a") >= 2) & (F.col("n_b") >= 2), bend(*step("a"), *step("b"), 3.0)).alias("turn"))


def swing_cues(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """(video_id, moment, track, pose, swing, timing) of every track that has a pose within NEAR_S of the moment."""
    near = around(spans, samples.where("samples > 1"), *AROUND_S)
    way, here = F.abs(F.col("s") - F.col("at")), (F.col("s") >= F.col("at") + PEAK_S[0]) & (F.col("s") <= F.col("at") + PEAK_S[1])
    pose = F.struct("side", "height", *[f"{a}_{w}" for w in WRISTS for a in "xyc"])
    found = near.groupBy("video_id", "moment", "track").agg(
        F.min_by(pose, F.when(way <= NEAR_S, F.struct(way.alias("w"), F.col("s").alias("s")))).alias("pose"),
        F.max(F.when(here, F.struct(F.col("speed").alias("v"), (F.col("at") - F.col("s")).alias("early")))).alias("peak"), F.count_if(here).alias("n_peak"),
        F.max("speed").alias("widest"), F.count("*").alias("n_wide"), F.first("usual").alias("usual"), F.first("fast").alias("fast"),
    ).where("pose IS NOT NULL")
    sure = F.col("n_peak") >= 2
    elsewhere = (F.col("n_wide") >= 2) & (F.col("widest") > 1.15 * F.col("peak.v"))  # the swing is at its fastest at another moment
    swing = unit((F.col("peak.v") - F.col("usual")) / (F.col("fast") - F.col("usual"))) * F.when(elsewhere, 0.5).otherwise(1.0)
    return found.select("video_id", "moment", "track", "pose", F.when(sure, swing).otherwise(0.0).alias("swing"), F.when(sure, unit(1 - F.abs("peak.early") / 0.1)).otherwise(0.0).alias("timing"))


def scored(spans: DataFrame, swings: DataFrame, balls: DataFrame, with_ball: DataFrame) -> DataFrame:
    """For each moment and side the player for whom most speaks: the columns of HITS. with_ball: video_id of videos that have a ball."""
    rows = spans.join(swings, ["video_id", "moment"]).join(balls, ["video_id", "moment"], "left").join(with_ball.withColumn("has_ball", F.lit(True)), "video_id", "left")
    wrist = lambda w: F.when(F.col(f"pose.c_{w}") >= SURE, length(F.col(f"pose.x_{w}") - F.col("place.x"), F.col(f"pose.y_{w}") - F.col("place.y")))
    apart = F.least(*map(wrist, WRISTS)) / F.col("pose.height")
    cues = {
        "sound": F.array_contains("sources", "audio").cast("double"), "near": F.coalesce(unit(1 - (apart - REACH) / REACH_SLACK), F.lit(0.0)),
        "turn": F.coalesce("turn", F.lit(0.0)), "ball_seen": F.col("place").isNotNull().cast("double"),
    }
    rows = rows.withColumns(cues)
    heard = WEIGHTS["sound"] * F.col("sound") * (0.6 + 0.4 * F.col("loudness"))
    seen = F.when(F.col("ball_seen") > 0, WEIGHTS["near"] * F.col("near") + WEIGHTS["turn"] * F.col("turn")).otherwise(WEIGHTS["lost_ball"])
    confirmed = F.when(F.col("has_ball"), heard + seen).otherwise(WEIGHTS["no_ball"] * heard)
    rows = rows.withColumn("score", WEIGHTS["swing"] * F.col("swing") * (0.5 + 0.5 * F.col("timing")) + confirmed)
    told = [c for c in HITS.names if c != "side"]
    best = F.max_by(F.struct(*told), F.struct(F.col("score"), -F.col("track")))
    return rows.groupBy("video_id", "moment", F.col("pose.side").alias("side")).agg(best.alias("b")).select("video_id", "moment", "side", "b.*")


def chained(options: DataFrame) -> DataFrame:
    """The options of the best chain of each video: video_id and the columns of HITS."""

    def f(own: pd.DataFrame) -> pd.DataFrame:
        return own.loc[sequence.best_hits(*(own[c].to_numpy(np.float64) for c in ("t", "side", "score")))]

    rows = options.select("video_id", "moment", *[F.col(c.name).cast(c.dataType if c.name != "score" else "double").alias(c.name) for c in HITS.fields])
    out = sequence.per_group(rows, ["video_id"], ["t", "side"], f, rows.schema)
    return out.select("video_id", *[F.col(c.name).cast(c.dataType).alias(c.name) for c in HITS.fields])


def detect(onsets: DataFrame, ball: DataFrame, motion: DataFrame, sides: DataFrame) -> DataFrame:
    """The hits of all videos."""
    samples = wrist_samples(motion, sides)
    spans = moments(onsets, ball, samples)
    return chained(scored(spans, swing_cues(spans, samples), ball_cues(spans, ball), ball.select("video_id").distinct()))
