"""The stages of an analysis, each from DataFrames to DataFrames, for all videos and sessions at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G
from rallyplan.operators import gaps, hitcues, identity, sequence, timejoin
from rallyplan.operators.robust import half_even
from rallyplan.plans.rally_queries import kind_evidence
from rallyplan.schema import LIMITS, STROKES
from rallyplan.sources.tracking import points, rallies


def detect_hits(onsets: DataFrame, ball: DataFrame, motion: DataFrame, sides: DataFrame) -> DataFrame:
    """(video_id and the columns of HITS). All inputs have video_id; ``sides``: track, side."""
    return hitcues.detect(onsets, ball, motion, sides)


def session_identities(people: DataFrame, hits: DataFrame, videos: DataFrame) -> DataFrame:
    """(session_id, video_id, track_id, label, concurrent): who the tracks are. ``videos``: id, session_id, offset_s."""
    v = videos.select(F.col("id").alias("video_id"), "session_id", "offset_s")
    seen = people.join(v, "video_id").select("session_id", "video_id", F.col("track_id").cast("long").alias("track_id"), (F.col("t") + F.col("offset_s")).alias("t"), F.col("court_x").cast("double").alias("x"), F.col("court_y").cast("double").alias("y"), F.transform("appearance", lambda a: a.cast("double")).alias("look"))
    n = hits.groupBy("video_id", F.col("track").cast("long").alias("track_id")).agg(F.count("*").alias("hits"))
    rows = seen.join(n, ["video_id", "track_id"], "left").fillna(0, ["hits"])

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        tracks = []
        for (video, track), r in rows.groupby(["video_id", "track_id"]):
            if len(r) >= 5:
                tracks.append(identity.Track(int(video), int(track), r.t.to_numpy(), r[["x", "y"]].to_numpy(float), np.median(np.array(r["look"].tolist(), float), axis=0), int(r.hits.iloc[0])))
        people, number = identity.find_players(tracks)
        found = [(rows.session_id.iloc[0], t.video, t.id, "ABCD"[k], number) for k, p in enumerate(people[:4]) for t in p.tracks]
        return pd.DataFrame(found, columns=["session_id", "video_id", "track_id", "label", "concurrent"])

    return sequence.per_group(rows, ["session_id"], ["t", "video_id", "track_id"], f, "session_id long, video_id long, track_id long, label string, concurrent int")


def build_shots(hits: DataFrame, people: DataFrame, labels: DataFrame, players: DataFrame, videos: DataFrame, flights: DataFrame | None = None) -> DataFrame:
    """Shots on the session clock with hitter, feet, rally and placement.

    hits: HITS with video_id, hit_id and stroke; labels: video_id, track_id, label;
    players: session_id, label, player_id; flights: hit_id and what was measured.
    """
    feet = people.where(F.col("court_x").isNotNull() & ~F.isnan("court_x")).select("video_id", F.col("track_id").alias("track"), "t", F.col("court_x").cast("double").alias("hit_x"), F.col("court_y").cast("double").alias("hit_y"))
    near = timejoin.nearest(hits.select("hit_id", "video_id", "track", "t"), feet, ["video_id", "track"], "t", ["hit_x", "hit_y"], 0.5, "hit_id").select("hit_id", "hit_x", "hit_y")
    v = videos.select(F.col("id").alias("video_id"), "session_id", "offset_s")
    who = labels.select("video_id", F.col("track_id").alias("track"), "label")
    s = hits.join(near, "hit_id", "left").join(v, "video_id").join(who, ["video_id", "track"], "left").join(players.select("session_id", "label", "player_id"), ["session_id", "label"], "left")
    s = s.withColumn("t", F.col("t") + F.col("offset_s")).withColumnRenamed("hit_id", "shot_id")
    w = gaps.ordered(["session_id"], ["t", "shot_id"])
    gap = F.col("t") - F.lag("t").over(w)
    first = gap.isNull() | ~gaps.continues_rally(gap, F.col("side"), F.lag("side").over(w))
    s = s.withColumns({"gap": gap, "first": first})
    smash = (F.col("stroke") == "serve") & ~F.col("first") & (F.abs("hit_y") < LIMITS.serve_min_depth_m)
    pause = F.coalesce(F.col("gap") >= LIMITS.serve_pause_s, F.lit(True))
    placed = F.coalesce(pause & (F.abs("hit_y") >= LIMITS.serve_min_depth_m) & (F.abs("hit_x") <= LIMITS.serve_max_x_m), F.lit(False))
    s = s.withColumn("serve_by", F.when(smash, None).when(F.col("stroke") == "serve", "swing").when(placed, "position"))
    s = s.withColumn("stroke", F.when(F.col("serve_by").isNotNull(), "serve").when(smash, "overhead").otherwise(F.col("stroke"))).drop("gap", "first")
    s = gaps.sessionize(s, ["session_id"], "t", "shot_id", "side", F.col("stroke") == "serve")
    return with_flights(s, flights)


def with_flights(shots: DataFrame, flights: DataFrame | None) -> DataFrame:
    """The shots with what their flights (hit_id, ...) measured, and where they landed."""
    kinds = {c: "double" for c in ("bounce_x", "bounce_y", "speed_kmh", "net_clearance_m", "contact_height_m")} | {"crosses_net": "boolean"}
    measured = [c for c in flights.columns if c != "hit_id"] if flights is not None else []
    s = shots.drop("in_court", "depth", "direction", *kinds, *measured)
    if flights is not None:
        s = s.join(flights.withColumnRenamed("hit_id", "shot_id"), "shot_id", "left")
    s = s.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in measured})
    landed = G.in_court(F.col("stroke"), F.col("bounce_x"), F.col("bounce_y"), -F.col("side"))
    return s.withColumns({"in_court": landed, "depth": G.depth(F.col("bounce_y")), "direction": G.direction(F.col("bounce_x"), F.col("hit_x"))})


def session_kinds(shots: DataFrame) -> DataFrame:
    """kind, p_match, kind_confidence and evidence by session; serves seen in the swing alone count."""
    swung = shots.withColumn("stroke", F.when(F.col("serve_by") == "position", "unknown").otherwise(F.col("stroke"))) if "serve_by" in shots.columns else shots
    k = kind_evidence(rallies(swung))
    return k.withColumn("kind_confidence", F.when(F.col("kind") == "match", F.col("p_match")).otherwise(1 - F.col("p_match")))


def match_scores(shots: DataFrame, players: DataFrame) -> DataFrame:
    """(session_id, rally, server, p, how, faults, winner, score_before, score): points of sessions with two players, decoded.

    players: session_id, label, player_id.
    """
    two = players.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by("player_id", "label").alias("p0"), F.max_by("player_id", "label").alias("p1")).where("n = 2").drop("n")
    p = points(rallies(shots)).where("role <> 'fault'").join(two, "session_id")
    p = p.select("session_id", F.col("rally").cast("long").alias("rally"), "server", "p0", "p1", F.when(F.col("server") == F.col("p0"), 0).otherwise(1).alias("who"), "p", "how", "faults", "end", "court")

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        from rallyplan.operators import scoring

        d = scoring.decode([scoring.Observed(int(w), float(p), int(e), int(c)) for w, p, e, c in zip(rows.who, rows.p, rows["end"], rows.court, strict=True)])
        ids = (int(rows.p0.iloc[0]), int(rows.p1.iloc[0]))
        out = rows[["session_id", "rally", "server", "p", "how", "faults"]].copy()
        out["winner"] = pd.array([None if w is None else ids[w] for w in d.winners], "Int64")
        out["score_before"], out["score"] = d.before, d.text()
        return out

    return sequence.per_group(p, ["session_id"], ["rally"], f, "session_id long, rally long, server long, p double, how string, faults int, winner long, score_before string, score string")


def summaries(shots: DataFrame) -> DataFrame:
    """Counts and means by session and player: strokes as a map, speeds, share in, depths, directions."""
    tally = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    by = ["session_id", "player_id"]
    maps = [shots.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(*by, c).agg(F.count("*").alias("n")).groupBy(*by).agg(tally(c).alias(f"by_{c}")) for c in ("stroke", "depth", "direction")]
    out = shots.groupBy(*by).agg(
        F.count("*").alias("shots"), half_even(F.avg("speed_kmh"), 1).alias("speed_avg"), half_even(F.max("speed_kmh"), 1).alias("speed_max"),
        half_even(F.avg(F.when(F.col("stroke") != "serve", F.col("net_clearance_m"))), 2).alias("net_clearance_avg_m"), half_even(F.avg(F.col("in_court").cast("double")), 3).alias("in_pct"),
    )
    for m in maps:
        out = out.join(m, by, "left")
    return out


def profiles(shots: DataFrame) -> DataFrame:
    """Rows (player_id, stroke, ...) of profiles across sessions, for the strokes of the report."""
    return shots.where(F.col("stroke").isin(*STROKES)).groupBy("player_id", "stroke").agg(
        F.count("*").alias("n"), half_even(F.avg("speed_kmh"), 1).alias("speed_avg"), half_even(F.max("speed_kmh"), 1).alias("speed_max"), F.count("speed_kmh").alias("n_speed"), F.count("in_court").alias("n_in"),
        half_even(F.avg(F.col("in_court").cast("double")), 3).alias("in_pct"), half_even(F.avg("net_clearance_m"), 2).alias("net_clearance_avg"), F.count("net_clearance_m").alias("n_clear"), half_even(F.median("contact_height_m"), 2).alias("contact_height_m"),
    )
