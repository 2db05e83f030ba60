"""What kind of stroke a swing was, out of the hitter's poses around the hit, by aggregates over pose samples.

A swing sample is (hit_id, rel: seconds after the hit, kp_x, kp_y, kp_c). Every cue
is an aggregate over a stretch of rel, so all swings of all videos are judged by
one pass by hit (``stretches``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyplan.operators import stretches, timejoin
from rallyplan.operators.stretches import Mean, Pace, Top
from rallyplan.schema import KEYPOINTS, LIMITS

# Surety of a keypoint; seconds around the hit (before, after) in which things are looked at.
SURE = 0.3
OVERHEAD_S, FAST_S, SWING_S = (-0.3, 0.15), (-0.35, 0.05), 0.25
# Fixed values, in body heights: wrist over head, rise of the wrist that is topspin or (fall) slice, hands travelling across that is sure.
OVERHEAD, TOPSPIN, SLICE, ACROSS = 0.15, 0.12, -0.08, 0.3
#: Fixed value: metres from the net within which a stroke is a volley.
VOLLEY_M = 6.0
# Votes that make a racket hand, and their share.
LEAST_VOTES, VOTE_SHARE = 3, 0.65
#: Moments, and seconds around them, at which the higher hand of an overhead swing is looked for, the first that tells.
HAND_AT = (0.0, -0.03, -0.07)


def around_hits(hits: DataFrame, motion: DataFrame) -> DataFrame:
    """Swing samples (hit_id, rel, kp_x, kp_y, kp_c) from 0.7 s before to 0.35 s after each hit of its own track."""
    spans = hits.select("hit_id", "video_id", "track", F.col("t").alias("at"), (F.col("t") - 0.7).alias("lo"), (F.col("t") + 0.35).alias("hi"))
    poses = motion.select("video_id", "track", "t", "kp_x", "kp_y", "kp_c")
    return timejoin.interval(poses, spans, ["video_id", "track"], "t", "lo", "hi", 4.0).select("hit_id", (F.col("t") - F.col("at")).alias("rel"), "kp_x", "kp_y", "kp_c")


def _cell(axis: str, name: str) -> Column:
    """A keypoint's coordinate, null where it isn't sure."""
    i = F.lit(KEYPOINTS.index(name))
    return F.when(F.get("kp_c", i) >= SURE, F.get(f"kp_{axis}", i).cast("double"))


def mean_of(axis: str, name: str, at: float, within: float) -> Column:
    """Mean of a keypoint's coordinate around a moment; null where it wasn't seen."""
    return F.avg(F.when(F.abs(F.col("rel") - at) <= within, _cell(axis, name)))


def _middle(a: Column, b: Column) -> Column:
    return F.coalesce((a + b) / 2, a, b)


class Cues:
    """Cues as columns over what ``stretches`` tells; ``values`` and ``wanted`` take down what that has to be asked."""

    def __init__(self) -> None:
        self.values: dict[str, Column] = {}
        self.wanted: dict[str, stretches.Wanted] = {}

    def value(self, axis: str, name: str) -> str:
        self.values[f"{name}_{axis}"] = _cell(axis, name)
        return f"{name}_{axis}"

    def ask(self, wanted: stretches.Wanted) -> Column:
        """The column that a wanted aggregate (of one column) comes in."""
        known = {x: n for n, x in self.wanted.items()}
        name = known.get(wanted, f"told_{len(known)}")
        self.wanted[name] = wanted
        return F.col(name)

    def mean(self, axis: str, name: str, at: float, within: float) -> Column:
        """Mean of a keypoint's coordinate around a moment; null where it wasn't seen."""
        return self.ask(Mean(self.value(axis, name), at, within))

    def body(self) -> Column:
        """Height in pixels."""
        edge = lambda f, *names: f(*[self.mean("y", n, 0.0, 0.2) for n in names])
        return (edge(F.greatest, "l_ankle", "r_ankle", "l_knee", "r_knee") - edge(F.least, "nose", "l_shoulder", "r_shoulder")) * 1.15

    def speed(self, s: str) -> Column:
        """Speed of a wrist, from step to step between samples in which it was seen."""
        return self.ask(Pace(self.value("x", f"{s}_wrist"), self.value("y", f"{s}_wrist"), *FAST_S, 0.9, 3))

    def hand_vote(self) -> Column:
        """``left`` or ``right``: the one hand that is above the head at an overhead hit."""

        def at(moment: float) -> Column:
            y = lambda n: self.mean("y", n, moment, 0.02)
            head, feet = F.least(y("nose"), y("l_eye"), y("r_eye")), F.greatest(y("l_ankle"), y("r_ankle"))
            left, right = y("l_wrist"), y("r_wrist")
            height = feet - head
            clear = (F.least(left, right) < head - 0.05 * height) & (F.abs(left - right) > 0.2 * height)
            return F.when(left.isNotNull() & right.isNotNull() & clear, F.when(left < right, "left").otherwise("right"))

        return F.coalesce(*map(at, HAND_AT))

    def told(self, samples: DataFrame) -> DataFrame:
        return stretches.by_swing(samples, self.values, self.wanted)


def cues(samples: DataFrame) -> DataFrame:
    """One row a swing: seen (a sample near the hit), body (height in pixels), lift (wrist over head at most), wrist_y and wrist speeds, hands before and after, vote."""
    c = Cues()
    c.values["here"], c.values["lift"] = F.lit(1.0), F.least(*[_cell("y", n) for n in ("nose", "l_eye", "r_eye")]) - F.least(_cell("y", "l_wrist"), _cell("y", "r_wrist"))
    hands = [
        (_middle(c.mean(a, "l_wrist", at, 0.05), c.mean(a, "r_wrist", at, 0.05)) - _middle(c.mean(a, "l_hip", at, 0.05), c.mean(a, "r_hip", at, 0.05))).alias(f"{when}_{a}")
        for when, at in (("before", -SWING_S), ("after", SWING_S)) for a in "xy"
    ]
    wrists = [F.when(c.mean("x", f"{s}_wrist", at, within).isNotNull(), c.mean("y", f"{s}_wrist", at, within)).alias(f"{s}_{when}") for s in "lr" for when, at, within in (("drawn", -0.2, 0.05), ("met", 0.0, 0.03))]
    paces = [c.speed(s).alias(f"{s}_speed") for s in "lr"]
    seen, lift = c.ask(Mean("here", 0.0, 0.1)).isNotNull().alias("seen"), c.ask(Top("lift", *OVERHEAD_S)).alias("lift")
    out = ["hit_id", seen, c.body().alias("body"), lift, *hands, *wrists, *paces, c.hand_vote().alias("vote")]
    return c.told(samples).select(*out)


def racket_hands(votes: DataFrame, by: list[str]) -> DataFrame:
    """by and ``hand``: what LEAST_VOTES votes say by VOTE_SHARE; null otherwise. votes: by and vote (null: none)."""
    left, n = F.count_if(F.col("vote") == "left"), F.count("vote")
    most = F.greatest(left, n - left)
    hand = F.when((n >= LEAST_VOTES) & (most >= VOTE_SHARE * n), F.when(left > n - left, "left").otherwise("right"))
    return votes.groupBy(*by).agg(hand.alias("hand"))


def classified(swings: DataFrame) -> DataFrame:
    """swings (cues, hand, right_x, right_y, first_in_rally, from_net_m) with stroke, spin, confidence and across (body heights).

    hand: null counts as right. right_x, right_y: the player's right in the picture
    as they face the net. from_net_m: null where the feet weren't seen.
    """
    known = F.coalesce(F.col("seen") & (F.col("body") > 0), F.lit(False))
    overhead = F.coalesce(F.col("lift") > OVERHEAD * F.col("body"), F.lit(False))
    behind = F.col("first_in_rally") | F.coalesce(F.col("from_net_m") > LIMITS.serve_min_depth_m, F.lit(False))
    right = F.col("r_speed") >= F.col("l_speed")
    rise = (F.when(right, F.col("r_drawn")).otherwise(F.col("l_drawn")) - F.when(right, F.col("r_met")).otherwise(F.col("l_met"))) / F.col("body")
    spin = F.when(rise > TOPSPIN, "topspin").when(rise < SLICE, "slice").when(rise.isNotNull(), "flat")
    way = reduce(Column.__add__, [(F.col(f"before_{a}") - F.col(f"after_{a}")) * F.col(f"right_{a}") for a in "xy"]) / F.col("body")
    across = F.when(F.coalesce("hand", F.lit("right")) == "right", way).otherwise(-way)
    side = F.when(across > 0, "forehand").otherwise("backhand")
    volley = F.coalesce(F.col("from_net_m") < VOLLEY_M, F.lit(False))
    ground = known & ~overhead
    stroke = F.when(~known, "unknown").when(overhead, F.when(behind, "serve").otherwise("overhead")).when(across.isNull(), "unknown").when(volley, F.concat(F.lit("volley_"), side)).otherwise(side)
    sure = F.when(~known, 0.0).when(overhead, 0.8).when(across.isNull(), 0.2).otherwise(F.least(F.greatest(F.abs(across) / ACROSS, F.lit(0.3)), F.lit(1.0)))
    return swings.withColumns({
        "stroke": stroke, "spin": F.when(ground & (across.isNull() | ~volley), spin), "confidence": sure, "across": F.when(ground & across.isNotNull(), across).otherwise(0.0),
    })
