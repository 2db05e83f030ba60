"""Queries that carry state from row to row, by session; and evaluation against labels, identities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.operators import identity, sequence, timejoin
from rallyplan.operators.robust import half_even
from rallyplan.plans.base import query, table
from rallyplan.plans.insight_queries import ENRICHED_SQL, rally_ends
from rallyplan.sources.tracking import HITS_SQL, hits, points, rallies, shots


def _ids(rows: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    return rows.loc[at, ["session_id", "shot_id"]]


@query(f"""WITH RECURSIVE {HITS_SQL}, US AS (SELECT session_id, shot_id, t, side, hit_score - 0.5e0 AS gain, CASE WHEN t - LAG(t) OVER w >= 4 THEN 1 ELSE 0 END AS cut_here FROM H WHERE hit_score > 0.6e0 * 0.5e0 WINDOW w AS (PARTITION BY session_id ORDER BY t, shot_id)),
PT AS (SELECT *, sum(cut_here) OVER (PARTITION BY session_id ORDER BY t, shot_id) AS part FROM US), EV AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, part ORDER BY t, shot_id) AS j FROM PT),
ST AS (SELECT session_id, part, 1::BIGINT AS j, [{{'t': t, 'side': side, 'tot': gain, 'came': 0::BIGINT}}] AS s FROM EV WHERE j = 1
 UNION ALL SELECT session_id, part, j, list_append(s, {{'t': t, 'side': side, 'tot': CASE WHEN near + gain > far + gain THEN near + gain ELSE far + gain END, 'came': CASE WHEN near + gain > far + gain THEN near_at ELSE far_at END}}) FROM (
  SELECT *, CASE WHEN far_max > 0 THEN far_max ELSE 0e0 END AS far, CASE WHEN far_max > 0 THEN list_position(list_transform(s, lambda x: CASE WHEN x.t <= t - 4 THEN x.tot END), far_max) ELSE 0 END AS far_at,
    list_position(list_transform(s, lambda x: CASE WHEN x.t > t - 4 AND t - x.t >= 0.55e0 AND x.side <> side THEN x.tot END), near) AS near_at FROM (
   SELECT k.session_id, k.part, e.j, e.t, e.side, e.gain, k.s, list_max(list_transform(list_filter(k.s, lambda x: x.t <= e.t - 4), lambda x: x.tot)) AS far_max,
     list_max(list_transform(list_filter(k.s, lambda x: x.t > e.t - 4 AND e.t - x.t >= 0.55e0 AND x.side <> e.side), lambda x: x.tot)) AS near FROM ST k JOIN EV e ON e.session_id = k.session_id AND e.part = k.part AND e.j = k.j + 1))),
LS AS (SELECT session_id, part, arg_max(s, j) AS s FROM ST GROUP BY 1, 2), BK AS (SELECT session_id, part, s, list_position(list_transform(s, lambda x: x.tot), list_max(list_transform(s, lambda x: x.tot)))::BIGINT AS j FROM LS WHERE list_max(list_transform(s, lambda x: x.tot)) > 0
 UNION ALL SELECT session_id, part, s, s[j].came FROM BK WHERE s[j].came > 0)
SELECT EV.session_id, EV.shot_id FROM BK JOIN EV ON EV.session_id = BK.session_id AND EV.part = BK.part AND EV.j = BK.j""")
def hit_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chain of hits of each session."""
    f = lambda r: _ids(r, sequence.best_hits(r.t.to_numpy(), r.side.to_numpy(), r.hit_score.to_numpy()))
    return sequence.per_group(hits(spark, sf_dir).select("session_id", "shot_id", "t", "side", "hit_score"), ["session_id"], ["t", "shot_id"], f, "session_id long, shot_id long")


@query()
def match_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winner of every point and the score before it, decoded for the whole session at once."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        from rallyplan.operators import scoring

        seen = [scoring.Observed(int(s) % 2, float(p), int(e), int(c)) for s, p, e, c in zip(rows.server, rows.p, rows["end"], rows.court, strict=True)]
        d = scoring.decode(seen)
        return pd.DataFrame({"session_id": rows.session_id, "rally": rows.rally, "winner": pd.array(d.winners, "Int64"), "score_before": d.before})

    p = points(rallies(shots(spark, sf_dir))).where("role <> 'fault'").select("session_id", F.col("rally").cast("long").alias("rally"), "server", "p", "end", "court")
    return sequence.per_group(p, ["session_id"], ["rally"], f, "session_id long, rally long, winner long, score_before string")


@query(f"""WITH RECURSIVE {HITS_SQL}, EV AS (SELECT session_id, shot_id, t, video, hit_score, speed_kmh, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS i FROM H),
ST AS (SELECT session_id, i, 1 AS g, shot_id, t, video, hit_score, speed_kmh, 1::BIGINT AS views FROM EV WHERE i = 1
 UNION ALL SELECT session_id, i, CASE WHEN same THEN g ELSE g + 1 END, CASE WHEN stays THEN a.shot_id ELSE b.shot_id END, CASE WHEN stays THEN a.t ELSE b.t END, CASE WHEN stays THEN a.video ELSE b.video END, CASE WHEN stays THEN a.hit_score ELSE b.hit_score END,
  CASE WHEN NOT same THEN b.speed_kmh WHEN stays THEN COALESCE(a.speed_kmh, b.speed_kmh) ELSE COALESCE(b.speed_kmh, a.speed_kmh) END, CASE WHEN same THEN 2::BIGINT ELSE 1::BIGINT END FROM (
  SELECT *, same AND (a.speed_kmh IS NOT NULL, a.hit_score) >= (b.speed_kmh IS NOT NULL, b.hit_score) AS stays FROM (
   SELECT k.session_id, e.i, k.g, k AS a, e AS b, k.video <> e.video AND e.t - k.t <= 2 AS same FROM ST k JOIN EV e ON e.session_id = k.session_id AND e.i = k.i + 1)))
SELECT session_id, arg_max(shot_id, i) AS shot_id, arg_max(views, i) AS views, (arg_max({{'v': speed_kmh}}, i)).v AS speed_kmh FROM ST GROUP BY session_id, g""")
def merge_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots seen by both cameras (even and odd ids) within 2 s, as one."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        records = [{**{k: (None if pd.isna(v) else v) for k, v in r.items()}, "label": None, "sources": set(), "metrics": {}} for r in rows.to_dict("records")]
        merged = sequence.merge_views(records, 2.0)
        return pd.DataFrame([(m["session_id"], m["shot_id"], m["views"], m["speed_kmh"]) for m in merged], columns=["session_id", "shot_id", "views", "speed_kmh"])

    h = hits(spark, sf_dir).select("session_id", "shot_id", "t", "video", "stroke", "hit_score", "speed_kmh", "bounce_x", "bounce_y")
    return sequence.per_group(h, ["session_id"], ["t", "shot_id"], f, "session_id long, shot_id long, views long, speed_kmh double")


@query(f"""WITH RECURSIVE {HITS_SQL}, LB AS (SELECT session_id, shot_id, t - 1.5 AS lo, t + 2.5 AS hi, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS i FROM H WHERE stroke = 'forehand'), DT AS (SELECT session_id, shot_id, t, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS j FROM H WHERE stroke = 'backhand'),
ST AS (SELECT session_id, 0 AS i, 0::BIGINT AS used, NULL::BIGINT AS label_id FROM LB WHERE i = 1
 UNION ALL SELECT n.session_id, n.i, CASE WHEN n.j IS NOT NULL THEN n.j ELSE n.used END, CASE WHEN n.j IS NOT NULL THEN n.shot_id END FROM (SELECT k.session_id, b.i, k.used, b.shot_id, min(d.j) AS j FROM ST k JOIN LB b ON b.session_id = k.session_id AND b.i = k.i + 1 LEFT JOIN DT d ON d.session_id = k.session_id AND d.j > k.used AND d.t >= b.lo AND d.t <= b.hi GROUP BY 1, 2, 3, 4) n)
SELECT ST.session_id, label_id, DT.shot_id AS found_id FROM ST JOIN DT ON DT.session_id = ST.session_id AND DT.j = ST.used WHERE label_id IS NOT NULL""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (forehands) one to one with detections (backhands) in their windows."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.stroke == "forehand"], rows[rows.stroke == "backhand"]
        pairs = sequence.greedy_match(a.t.to_numpy() - 1.5, a.t.to_numpy() + 2.5, b.t.to_numpy())
        return pd.DataFrame([(int(rows.session_id.iloc[0]), int(a.shot_id.iloc[i]), int(b.shot_id.iloc[j])) for i, j in pairs], columns=["session_id", "label_id", "found_id"])

    return sequence.per_group(hits(spark, sf_dir).select("session_id", "shot_id", "t", "stroke"), ["session_id"], ["t", "shot_id"], f, "session_id long, label_id long, found_id long")


@query(f"""WITH RECURSIVE {HITS_SQL}, EV AS (SELECT session_id, t, hit_score AS s, CASE shot_id % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'ball' ELSE 'pose' END AS source, CASE shot_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS r, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS i FROM H),
ST AS (SELECT session_id, i, 1 AS g, t AS mt, r AS best, s, source FROM EV WHERE i = 1
 UNION ALL SELECT e.session_id, e.i, CASE WHEN e.t - k.mt <= 1 THEN k.g ELSE k.g + 1 END, CASE WHEN e.t - k.mt <= 1 AND e.r <= k.best THEN k.mt ELSE e.t END, CASE WHEN e.t - k.mt <= 1 THEN greatest(k.best, e.r) ELSE e.r END, e.s, e.source FROM ST k JOIN EV e ON e.session_id = k.session_id AND e.i = k.i + 1)
SELECT session_id, arg_max(mt, i) AS t, max(s) AS loudness, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM ST GROUP BY session_id, g""")
def merged_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate moments of three sources as one list: what is within a second is the same."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        m = sequence.merge_moments(rows.t.to_numpy(), rows.source.tolist(), rows.hit_score.to_numpy(), 1.0)
        return pd.DataFrame({"session_id": int(rows.session_id.iloc[0]), "t": [x["t"] for x in m], "loudness": [x["loudness"] for x in m], "sources": [",".join(sorted(x["sources"])) for x in m]})

    source = F.when(F.col("shot_id") % 3 == 0, "audio").when(F.col("shot_id") % 3 == 1, "ball").otherwise("pose")
    return sequence.per_group(hits(spark, sf_dir).select("session_id", "shot_id", "t", "hit_score", source.alias("source")), ["session_id"], ["t", "shot_id"], f, "session_id long, t double, loudness double, sources string")


@query(f"""WITH RECURSIVE {HITS_SQL}, EV AS (SELECT session_id, shot_id, t, hit_score AS s, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS i FROM H),
ST AS (SELECT session_id, i, shot_id AS last_id, t AS last_t, s AS last_s, NULL::BIGINT AS dropped FROM EV WHERE i = 1
 UNION ALL SELECT e.session_id, e.i, CASE WHEN e.t - k.last_t >= 2 OR e.s > k.last_s THEN e.shot_id ELSE k.last_id END, CASE WHEN e.t - k.last_t >= 2 OR e.s > k.last_s THEN e.t ELSE k.last_t END, CASE WHEN e.t - k.last_t >= 2 OR e.s > k.last_s THEN e.s ELSE k.last_s END,
  CASE WHEN e.t - k.last_t >= 2 THEN NULL WHEN e.s > k.last_s THEN k.last_id ELSE e.shot_id END FROM ST k JOIN EV e ON e.session_id = k.session_id AND e.i = k.i + 1)
SELECT session_id, shot_id FROM EV WHERE shot_id NOT IN (SELECT dropped FROM ST WHERE dropped IS NOT NULL)""")
def separated_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of onsets closer than 2 s the stronger."""
    f = lambda r: _ids(r, np.flatnonzero(sequence.keep_apart(r.t.to_numpy(), r.hit_score.to_numpy(), 2.0)))
    return sequence.per_group(hits(spark, sf_dir).select("session_id", "shot_id", "t", "hit_score"), ["session_id"], ["t", "shot_id"], f, "session_id long, shot_id long")


@query(f"""WITH RECURSIVE {HITS_SQL}, EV AS (SELECT session_id, shot_id, t, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS i FROM H WHERE crosses_net),
NX AS (SELECT a.session_id, a.shot_id, a.i, min(b.i) AS nxt FROM EV a LEFT JOIN EV b ON a.session_id = b.session_id AND b.t - a.t >= 5 AND b.i > a.i GROUP BY 1, 2, 3),
KE AS (SELECT session_id, shot_id, nxt FROM NX WHERE i = 1 UNION ALL SELECT NX.session_id, NX.shot_id, NX.nxt FROM KE JOIN NX ON NX.session_id = KE.session_id AND NX.i = KE.nxt) SELECT session_id, shot_id FROM KE""")
def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at least 5 s after the last kept one."""
    f = lambda r: _ids(r, np.flatnonzero(sequence.suppress_after(r.t.to_numpy(), 5.0)))
    return sequence.per_group(hits(spark, sf_dir).where("crosses_net").select("session_id", "shot_id", "t"), ["session_id"], ["t", "shot_id"], f, "session_id long, shot_id long")


@query(f"""WITH RECURSIVE {HITS_SQL}, EV AS (SELECT session_id, side, shot_id, t, hit_x AS x, ROW_NUMBER() OVER (PARTITION BY session_id, side ORDER BY t, shot_id) AS i, COUNT(*) OVER (PARTITION BY session_id, side) AS n FROM H),
BOTH_WAYS AS (SELECT 1 AS way, session_id, side, i AS k, t, x FROM EV UNION ALL SELECT -1, session_id, side, n + 1 - i, -t, x FROM EV),
ST AS (SELECT way, session_id, side, k, t, x AS value, 0e0 AS slope FROM BOTH_WAYS WHERE k = 1
 UNION ALL SELECT way, session_id, side, k, t, CASE WHEN dt > 0 THEN value + 1e0 / (1e0 + 1e0 / (2 * pi() * (1e0 + 0.05e0 * abs(bent)) * dt)) * (x - value) ELSE value END, bent FROM (
  SELECT *, CASE WHEN dt > 0 THEN slope + 1e0 / (1e0 + 1e0 / (2 * pi() * 1e0 * dt)) * ((x - value) / dt - slope) ELSE slope END AS bent FROM (
   SELECT e.way, e.session_id, e.side, e.k, e.t, e.x, s.value, s.slope, e.t - s.t AS dt FROM ST s JOIN BOTH_WAYS e ON e.way = s.way AND e.session_id = s.session_id AND e.side = s.side AND e.k = s.k + 1))),
EU AS (SELECT EV.shot_id, (f.value + b.value) / 2 AS euro FROM EV JOIN ST f ON f.way = 1 AND f.session_id = EV.session_id AND f.side = EV.side AND f.k = EV.i JOIN ST b ON b.way = -1 AND b.session_id = EV.session_id AND b.side = EV.side AND b.k = EV.n + 1 - EV.i),
WN AS (SELECT *, least(greatest(i, 4), n - 3) AS c FROM EV), SG AS (SELECT a.shot_id, sum(b.x * (1 / 7e0 + (a.i - c) * (b.i - c) / 28e0 + ((a.i - c) ** 2 - 4) * ((b.i - c) ** 2 - 4) / 84e0)) AS savgol FROM WN a JOIN EV b ON b.session_id = a.session_id AND b.side = a.side AND abs(b.i - c) <= 3 WHERE a.n >= 7 GROUP BY 1)
SELECT EV.shot_id, round_even(euro, 6) AS euro, round_even(COALESCE(savgol, x), 6) AS savgol FROM EV JOIN EU USING (shot_id) LEFT JOIN SG USING (shot_id)""")
def smoothed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by the One Euro filter, there and back, and by Savitzky-Golay (seven samples, second order)."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        t, x = rows.t.to_numpy(), rows.hit_x.to_numpy(float)
        return pd.DataFrame({"shot_id": rows.shot_id, "euro": sequence.one_euro(t, x, zero_phase=True), "savgol": sequence.savitzky_golay(x, 7, 2)})

    out = sequence.per_group(hits(spark, sf_dir).select("session_id", "side", "shot_id", "t", "hit_x"), ["session_id", "side"], ["t", "shot_id"], f, "shot_id long, euro double, savgol double")
    return out.select("shot_id", half_even(F.col("euro"), 6).alias("euro"), half_even(F.col("savgol"), 6).alias("savgol"))


@query(f"""WITH RECURSIVE {HITS_SQL}, EV AS (SELECT session_id, shot_id, hit_x, hit_y, bounce_x, bounce_y, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS i FROM H),
ST AS (SELECT session_id, i, shot_id, hit_x AS ax, hit_y AS ay, bounce_x AS bx, bounce_y AS by_, false AS swapped FROM EV WHERE i = 1
 UNION ALL SELECT session_id, i, shot_id, CASE WHEN sw THEN cx ELSE hx END, CASE WHEN sw THEN cy ELSE hy END, CASE WHEN sw THEN hx ELSE cx END, CASE WHEN sw THEN hy ELSE cy END, sw FROM (
  SELECT e.session_id, e.i, e.shot_id, e.hit_x AS hx, e.hit_y AS hy, e.bounce_x AS cx, e.bounce_y AS cy, COALESCE(sqrt((e.bounce_x - k.ax) ** 2 + (e.bounce_y - k.ay) ** 2) + sqrt((e.hit_x - k.bx) ** 2 + (e.hit_y - k.by_) ** 2) < 0.8::DOUBLE * (sqrt((e.hit_x - k.ax) ** 2 + (e.hit_y - k.ay) ** 2) + sqrt((e.bounce_x - k.bx) ** 2 + (e.bounce_y - k.by_) ** 2)), false) AS sw
  FROM ST k JOIN EV e ON e.session_id = k.session_id AND e.i = k.i + 1))
SELECT shot_id, ax AS x, swapped FROM ST""")
def swap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right keypoints (hit and bounce stand in) with swaps undone."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, s = sequence.repair_swaps(rows[["hit_x", "hit_y"]].to_numpy(float), rows[["bounce_x", "bounce_y"]].to_numpy(float), 0.2)
        return pd.DataFrame({"shot_id": rows.shot_id, "x": a[:, 0], "swapped": s})

    return sequence.per_group(hits(spark, sf_dir).select("session_id", "shot_id", "t", "hit_x", "hit_y", "bounce_x", "bounce_y"), ["session_id"], ["t", "shot_id"], f, "shot_id long, x double, swapped boolean")


def _tracks(rows: pd.DataFrame) -> list[identity.Track]:
    out = []
    for (video, i), r in rows.groupby(["video", "track"], sort=True):
        look = np.bincount(r.shot_id.to_numpy() % 12, minlength=12).astype(float)
        out.append(identity.Track(int(video), int(i), r.t.to_numpy(), np.stack([r.x.to_numpy(float), r.y.to_numpy(float)], axis=1), look, int((r.hit_score > 0.8).sum())))
    return out


def _track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.floor(F.col("t") / 40) * 2 + F.when(F.col("side") > 0, 1).otherwise(0)
    return hits(spark, sf_dir).select("session_id", "shot_id", F.lit(0).alias("video"), track.cast("long").alias("track"), "t", (F.col("hit_x") / 2).alias("x"), F.col("hit_y").alias("y"), "hit_score")


def _people(solve) -> object:
    def f(rows: pd.DataFrame) -> pd.DataFrame:
        people = solve(_tracks(rows))
        found = [(int(rows.session_id.iloc[0]), t.id, "ABCD"[k]) for k, p in enumerate(people[:4]) for t in p.tracks]
        return pd.DataFrame(found, columns=["session_id", "track", "label"])

    return f


@query()
def two_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of each session as two players."""
    return sequence.per_group(_track_rows(spark, sf_dir), ["session_id"], ["t", "shot_id"], _people(identity.two_players), "session_id long, track long, label string")


@query()
def cluster_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of each session grouped by looks."""
    return sequence.per_group(_track_rows(spark, sf_dir), ["session_id"], ["t", "shot_id"], _people(identity.by_looks), "session_id long, track long, label string")


@query("""WITH E AS (SELECT vec_id, vec_id // 8 AS g, list_transform(embedding, lambda v: abs(v::DOUBLE)) AS v, vec_id % 2 AS hand, 1.6e0 + 0.02e0 * (vec_id % 9) AS h, ROW_NUMBER() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS k FROM embeddings),
C AS (SELECT p.g, p.k - 4 AS r, q.k AS c, p.vec_id AS player, q.vec_id AS profile, CASE WHEN p.hand <> q.hand THEN 3e0 ELSE 0e0 END + least(4e0, abs(p.h - q.h) / 0.06e0) + 0.5e0
  + 0.8e0 * sqrt(greatest(0e0, 1 - list_sum(list_transform(list_zip(p.v, q.v), lambda z: sqrt(z[1] / list_sum(p.v) * z[2] / list_sum(q.v)))))) AS cost FROM E p JOIN E q ON q.g = p.g AND p.k >= 4 AND q.k < 4),
P4 AS (SELECT a.g, a.c AS c0, b.c AS c1, d.c AS c2, e.c AS c3, a.cost + b.cost + d.cost + e.cost AS total FROM C a JOIN C b ON b.g = a.g AND b.r = 1 AND b.c <> a.c JOIN C d ON d.g = a.g AND d.r = 2 AND d.c NOT IN (a.c, b.c) JOIN C e ON e.g = a.g AND e.r = 3 AND e.c NOT IN (a.c, b.c, d.c) WHERE a.r = 0),
B AS (SELECT g, arg_min([c0, c1, c2, c3], total) AS best FROM P4 GROUP BY 1)
SELECT C.player, CASE WHEN C.cost <= 2.2e0 THEN C.profile END AS profile FROM B JOIN C ON C.g = B.g AND C.c = B.best[C.r + 1]""")
def assign_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four looks of every group of embeddings against the four before, all together."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        looks = {int(i): {"appearance": np.abs(np.asarray(v, float)), "hand": "right" if i % 2 else "left", "height_m": 1.6 + 0.02 * (i % 9)} for i, v in zip(rows.vec_id, rows.embedding, strict=True)}
        ids = list(looks)
        got = identity.assign_profiles({str(i): looks[i] for i in ids[4:]}, {i: looks[i] for i in ids[:4]})
        return pd.DataFrame([(int(p), q) for p, q in got.items()], columns=["player", "profile"]).astype({"player": "int64", "profile": "Int64"})

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 8).alias("g"))
    return sequence.per_group(e, ["g"], ["vec_id"], f, "player long, profile long")


@query()
def people_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track ids of detections, frame by frame."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        from rallyplan.operators.tracking import PeopleTracker

        tracker, ids = PeopleTracker(), []
        for frame, r in rows.groupby("frame", sort=True):
            people = [(np.array([x, y]), np.array([x, y, x + 1, y + 2]), np.bincount([i % 5], minlength=5).astype(float)) for x, y, i in zip(r.hit_x, r.hit_y, r.shot_id, strict=True)]
            ids += list(zip(r.shot_id, tracker.frame(frame / 2, people), strict=True))
        return pd.DataFrame(ids, columns=["shot_id", "track"])

    h = hits(spark, sf_dir).select("session_id", "shot_id", "hit_x", "hit_y", F.floor("t").alias("frame"))
    return sequence.per_group(h, ["session_id"], ["frame", "shot_id"], f, "shot_id long, track long")


@query()
def ball_tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracklets out of ball candidates."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        from rallyplan.operators.tracking import link_ball, strongest

        frames = {int(k): [(float(x) * 4, float(y) * 4, float(s), False) for x, y, s in zip(r.hit_x, r.hit_y, r.hit_score, strict=True)] for k, r in rows.groupby("frame")}
        best = strongest(link_ball(frames, 3))
        return pd.DataFrame([(int(rows.session_id.iloc[0]), k, *v) for k, v in sorted(best.items())], columns=["session_id", "frame", "x", "y", "track"])

    h = hits(spark, sf_dir).select("session_id", "shot_id", "hit_x", "hit_y", "hit_score", F.floor("t").alias("frame"))
    return sequence.per_group(h, ["session_id"], ["frame", "shot_id"], f, "session_id long, frame long, x double, y double, track long")


@query("SELECT DISTINCT user_id AS session_id, -3.7e0 AS lag_s, true AS sure FROM events")
def audio_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag between two recordings of each session: its own clicks, and the same ones 3.7 s later with noise."""

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        from rallyplan.functions.signals import find_lag

        rate, t = 50.0, rows.t.to_numpy()
        n = int(rate * (t.max() + 40))
        noise = np.random.default_rng(int(rows.session_id.iloc[0]))
        a, b = noise.random(n) * 0.05, noise.random(n) * 0.05
        a[(t * rate).astype(int)] += 1
        b[((t + 3.7) * rate).astype(int)] += 1
        lag, sure = find_lag(a, b, rate)
        return pd.DataFrame({"session_id": [int(rows.session_id.iloc[0])], "lag_s": [round(lag, 2)], "sure": [sure > 0]})

    return sequence.per_group(hits(spark, sf_dir).select("session_id", "shot_id", "t"), ["session_id"], ["t", "shot_id"], f, "session_id long, lag_s double, sure boolean")


# --- tracks and evaluation, in SQL ----------------------------------------------------------------


@query(f"WITH {HITS_SQL} SELECT session_id, video, player_id, min(t) AS start_s, max(t) AS end_s, count(*) AS samples, count(*) FILTER (hit_score > 0.5) AS hits, CASE WHEN median(hit_y) > 0 THEN 1 ELSE -1 END AS side FROM H GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def track_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a track is, from five samples on."""
    g = hits(spark, sf_dir).groupBy("session_id", "video", "player_id").agg(
        F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.count("*").alias("samples"), F.count_if(F.col("hit_score") > 0.5).alias("hits"), F.when(F.median("hit_y") > 0, 1).otherwise(-1).alias("side"),
    )
    return g.where("samples >= 5")


@query(f"WITH {HITS_SQL}, FR AS (SELECT session_id, CAST(floor(t) AS BIGINT) AS frame, count(DISTINCT stroke) AS n FROM H GROUP BY 1, 2) SELECT session_id, least(4, greatest(1, CAST(floor(quantile_cont(n, 0.9)) AS INT))) AS players FROM FR GROUP BY 1")
def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tracks a frame usually holds: the 90th percentile, 1 to 4."""
    n = hits(spark, sf_dir).groupBy("session_id", F.floor("t").alias("frame")).agg(F.count_distinct("stroke").alias("n"))
    return n.groupBy("session_id").agg(F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.percentile("n", 0.9)).cast("int"))).alias("players"))


@query(f"""WITH {HITS_SQL}, RS AS (SELECT shot_id, session_id, video, t, CASE WHEN hit_x > 0 THEN 1 ELSE -1 END AS s FROM H WHERE stroke = 'overhead'), VO AS (SELECT RS.shot_id, H.player_id, avg(CASE WHEN CASE WHEN H.hit_x > 0 THEN 1 ELSE -1 END = RS.s THEN 1.0 ELSE 0.0 END) AS share FROM RS JOIN H ON RS.session_id = H.session_id AND H.stroke <> 'overhead' AND H.t BETWEEN RS.t - 90 AND RS.t + 90 GROUP BY 1, 2),
WI AS (SELECT shot_id, player_id, share, LEAD(share) OVER (PARTITION BY shot_id ORDER BY share DESC, player_id) AS second, ROW_NUMBER() OVER (PARTITION BY shot_id ORDER BY share DESC, player_id) AS k FROM VO) SELECT shot_id, player_id, round_even(share, 6) AS share FROM WI WHERE k = 1 AND share >= 0.6 AND share > COALESCE(second, 0)""")
def side_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftover samples to the player who was on their side within 90 s, if that is clear."""
    h = hits(spark, sf_dir).withColumn("s", F.when(F.col("hit_x") > 0, 1).otherwise(-1))
    rest = h.where("stroke = 'overhead'").select("shot_id", "session_id", F.col("s").alias("own"), (F.col("t") - 90).alias("lo"), (F.col("t") + 90).alias("hi"))
    near = timejoin.interval(h.where("stroke <> 'overhead'").select("session_id", "player_id", "t", "s"), rest, ["session_id"], "t", "lo", "hi", 180.0)
    votes = near.groupBy("shot_id", "player_id").agg(F.avg((F.col("s") == F.col("own")).cast("double")).alias("share"))
    top = votes.groupBy("shot_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("v"), "player_id"))).alias("v"))
    first, second = F.col("v")[0], F.get("v", 1)
    clear = (-first["v"] >= 0.6) & (-first["v"] > F.coalesce(-second["v"], F.lit(0.0)))
    return top.where(clear).select("shot_id", first["player_id"].alias("player_id"), half_even(-first["v"], 6).alias("share"))


GROUPED = "CASE WHEN {0} LIKE 'volley%' THEN 'volley' ELSE {0} END"


@query(f"WITH {HITS_SQL}, CF AS (SELECT stroke AS truth, LEAD(stroke) OVER (PARTITION BY session_id ORDER BY t, shot_id) AS found FROM H) SELECT {GROUPED.format('truth')} AS truth, {GROUPED.format('found')} AS found, count(*) AS n FROM CF WHERE found IS NOT NULL GROUP BY 1, 2")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes as labelled against strokes as found (the next hit's stand in), volleys together; a pivot opened again."""
    from rallyplan.operators import gaps

    group = lambda c: F.when(F.col(c).startswith("volley"), "volley").otherwise(F.col(c))
    pairs = hits(spark, sf_dir).select(F.col("stroke").alias("truth"), F.lead("stroke").over(gaps.ordered(["session_id"], ["t", "shot_id"])).alias("found")).where("found IS NOT NULL")
    kinds = ["serve", "forehand", "backhand", "volley", "overhead"]
    grid = pairs.select(group("truth").alias("truth"), group("found").alias("found")).groupBy("truth").pivot("found", kinds).agg(F.count("truth"))
    return grid.unpivot(["truth"], kinds, "found", "n").where("n > 0")


@query(f"""WITH {HITS_SQL}, LB AS (SELECT session_id, count(*) FILTER (stroke = 'forehand') AS labels, count(*) FILTER (stroke = 'backhand') AS found, count(DISTINCT CASE WHEN stroke = 'forehand' THEN floor(t / 5) END) AS lw FROM H GROUP BY 1), MT AS (SELECT session_id, count(*) AS matched FROM (SELECT DISTINCT session_id, floor(t / 5) AS w FROM H WHERE stroke = 'forehand' INTERSECT SELECT DISTINCT session_id, floor(t / 5) FROM H WHERE stroke = 'backhand') GROUP BY 1)
SELECT session_id, labels, found, COALESCE(matched, 0) AS matched, CASE WHEN labels > 0 THEN round_even(COALESCE(matched, 0) / labels, 6) ELSE 0 END::DOUBLE AS recall, CASE WHEN found > 0 THEN round_even(COALESCE(matched, 0) / found, 6) ELSE 0 END::DOUBLE AS "precision" FROM LB LEFT JOIN MT USING (session_id)""")
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and detections that meet in the same window of 5 s."""
    h = hits(spark, sf_dir).select("session_id", "stroke", F.floor(F.col("t") / 5).alias("w"))
    of = lambda s: h.where(F.col("stroke") == s)
    n = h.groupBy("session_id").agg(F.count_if(F.col("stroke") == "forehand").alias("labels"), F.count_if(F.col("stroke") == "backhand").alias("found"))
    met = of("forehand").select("session_id", "w").distinct().join(of("backhand").select("session_id", "w"), ["session_id", "w"], "left_semi").groupBy("session_id").agg(F.count("*").alias("matched"))
    both = n.join(met, "session_id", "left").fillna(0, ["matched"])
    rate = lambda c: F.when(F.col(c) > 0, half_even(F.col("matched") / F.col(c), 6)).otherwise(0.0)
    return both.select("session_id", "labels", "found", "matched", rate("labels").alias("recall"), rate("found").alias("precision"))


@query(f"""WITH {HITS_SQL}, CK AS (SELECT session_id, shot_id, t, shot_id % 7 AS a, shot_id % 5 AS b FROM H WHERE stroke = 'serve'), SC AS (SELECT session_id, t, CAST(shot_id % 7 AS BIGINT) AS fa, CAST(shot_id % 6 AS BIGINT) AS fb FROM H WHERE stroke = 'overhead'), NX AS (SELECT CK.*, COALESCE(SC.fa, 3) AS fa, COALESCE(SC.fb, 3) AS fb FROM CK ASOF LEFT JOIN SC ON CK.session_id = SC.session_id AND CK.t <= SC.t),
ER AS (SELECT session_id, count(*) AS checkpoints, sum(abs(fa - a) + abs(fb - b)) AS e1, sum(abs(fb - a) + abs(fa - b)) AS e2, count(*) FILTER (fa = a AND fb = b) AS x1, count(*) FILTER (fb = a AND fa = b) AS x2 FROM NX GROUP BY 1)
SELECT session_id, checkpoints, (CASE WHEN e1 <= e2 THEN x1 ELSE x2 END)::BIGINT AS exact, round_even(least(e1, e2) / checkpoints, 6) AS error_games, e1 <= e2 AS self_first FROM ER""")
def game_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games off at checkpoints: the score before the next point, else the final one, for the better order of players."""
    h = hits(spark, sf_dir)
    k = F.col("shot_id")
    check = h.where("stroke = 'serve'").select("session_id", "t", "shot_id", (k % 7).alias("a"), (k % 5).alias("b"))
    score = h.where("stroke = 'overhead'").select("session_id", "t", (k % 7).alias("fa"), (k % 6).alias("fb"))
    n = timejoin.asof(check, score, ["session_id"], "t", ["fa", "fb"], forward=True).fillna(3, ["fa", "fb"])
    off = lambda x, y: F.abs(F.col(x) - F.col("a")) + F.abs(F.col(y) - F.col("b"))
    hit = lambda x, y: F.count_if((F.col(x) == F.col("a")) & (F.col(y) == F.col("b")))
    e = n.groupBy("session_id").agg(F.count("*").alias("checkpoints"), F.sum(off("fa", "fb")).alias("e1"), F.sum(off("fb", "fa")).alias("e2"), hit("fa", "fb").alias("x1"), hit("fb", "fa").alias("x2"))
    first = F.col("e1") <= F.col("e2")
    return e.select("session_id", "checkpoints", F.when(first, F.col("x1")).otherwise(F.col("x2")).alias("exact"), half_even(F.least("e1", "e2") / F.col("checkpoints"), 6).alias("error_games"), first.alias("self_first"))


@query(f"""WITH {ENRICHED_SQL}, GP2 AS (SELECT *, rally - ROW_NUMBER() OVER (PARTITION BY session_id, end_reason = 'not_a_point' ORDER BY rally) AS g FROM RE) SELECT session_id, min(rally)::BIGINT AS first_rally, max(rally)::BIGINT AS last_rally, arg_min(end_reason, rally) AS first_reason, arg_max_null(winner, rally) AS winner, count(*) FILTER (end_reason = 'fault') AS faults FROM GP2 WHERE end_reason <> 'not_a_point' GROUP BY session_id, g""")
def grouped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbroken stretches of points: first and last, who won the last, faults in between."""
    from rallyplan.operators import gaps

    e = rally_ends(spark, sf_dir).withColumn("idle", F.col("end_reason") == "not_a_point")
    g = gaps.islands(e, ["session_id"], ["rally"], "idle").where("NOT idle").groupBy("session_id", "island")
    return g.agg(F.min("rally").cast("long").alias("first_rally"), F.max("rally").cast("long").alias("last_rally"), F.min_by("end_reason", "rally").alias("first_reason"), F.max_by(F.struct("winner"), "rally")["winner"].alias("winner"), F.count_if(F.col("end_reason") == "fault").alias("faults")).drop("island")


@query(f"""WITH {HITS_SQL}, TK AS (SELECT session_id, side, CAST(floor(t / 20) AS BIGINT) AS k, count(*) AS n, avg(hit_score) AS score, avg(CASE WHEN bounce_x IS NULL THEN 1.0 ELSE 0.0 END) AS inside FROM H GROUP BY 1, 2, 3), US AS (SELECT * FROM TK WHERE n >= 4 AND inside < 0.7 AND score > 0.15) SELECT session_id, k, arg_max(side, {{'s': round_even(n * score, 6), 'd': side}}) AS side FROM US GROUP BY 1, 2""")
def strongest_tracklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable tracklets (20 s of a side stand in), and the strongest at each time.

    Scores are added in order of shot_id: where their mean is 0.15, the last bit of the sum decides.
    """
    scores = F.array_sort(F.collect_list(F.struct("shot_id", "hit_score"))).alias("scores")
    t = hits(spark, sf_dir).groupBy("session_id", "side", F.floor(F.col("t") / 20).alias("k")).agg(F.count("*").alias("n"), scores, F.avg(F.col("bounce_x").isNull().cast("double")).alias("inside"))
    long = t.where("n >= 4 AND inside < 0.7D").withColumn("score", F.aggregate("scores", F.lit(0.0), lambda s, x: s + x["hit_score"]) / F.col("n"))
    good = long.where("score > 0.15D")
    return good.groupBy("session_id", "k").agg(F.max_by("side", F.struct(half_even(F.col("n") * F.col("score"), 6), "side")).alias("side"))
