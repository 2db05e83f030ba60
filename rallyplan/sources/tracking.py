"""Tracking facts out of the ``events`` table: the adapter that the queries read.

Every user is one recorded session; 10,000 s of event time are one second of
play. All other columns follow from event_id by fixed arithmetic, so that the
oracle can say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G
from rallyplan.operators import gaps
from rallyplan.plans.base import table
from rallyplan.schema import LIMITS

EPOCH_US = 1704067200000000


def _mod(factor: int, by: int, shift: int = 0) -> Column:
    return ((F.col("event_id") * factor) % by - shift).cast("double") / 100


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each hit."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    k = F.col("event_id")
    side = F.when(k % 2 == 0, -1).otherwise(1)
    strokes = F.when(F.col("event_type") == "signup", "serve").when(F.col("event_type") == "view", "forehand").when(F.col("event_type") == "click", "backhand").when(F.col("event_type") == "purchase", "volley_forehand").otherwise("overhead")
    seen = k % 3 != 0
    return e.select(
        k.alias("shot_id"), F.col("user_id").alias("session_id"), (k % 2).alias("video"), ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US).cast("double") / F.lit(1e10)).alias("t"),
        side.alias("side"), strokes.alias("stroke"), (F.col("user_id") * 2 + k % 2).alias("player_id"), F.when(k % 4 != 0, F.col("value")).alias("speed_kmh"),
        _mod(37, 1097, 548).alias("hit_x"), (side * _mod(53, 1400)).alias("hit_y"), F.when(seen, _mod(71, 1300, 650)).alias("bounce_x"), F.when(seen, -side * _mod(29, 1400)).alias("bounce_y"),
        F.when(k % 7 == 0, False).when(k % 7 != 1, True).alias("crosses_net"), _mod(17, 101).alias("hit_score"), F.when(k % 5 != 0, _mod(13, 250)).alias("net_clearance_m"), (_mod(11, 180) + 0.5).alias("contact_height_m"),
        F.when(k % 3 == 0, (k % 4 < 3).cast("double")).alias("split_step"), F.when(k % 2 == 0, _mod(41, 400)).alias("recovery_m"), F.when(k % 4 == 1, (_mod(19, 9000) + 90)).alias("knee_bend_deg"), F.when(k % 5 == 2, _mod(23, 100)).alias("shoulder_turn"),
    )


HITS_SQL = """H AS (
  SELECT event_id AS shot_id, user_id AS session_id, event_id % 2 AS video, CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 1e10 AS t,
    CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END AS side,
    CASE event_type WHEN 'signup' THEN 'serve' WHEN 'view' THEN 'forehand' WHEN 'click' THEN 'backhand' WHEN 'purchase' THEN 'volley_forehand' ELSE 'overhead' END AS stroke,
    2 * user_id + event_id % 2 AS player_id, CASE WHEN event_id % 4 <> 0 THEN value END AS speed_kmh,
    CAST((event_id * 37) % 1097 - 548 AS DOUBLE) / 100 AS hit_x, CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END * (CAST((event_id * 53) % 1400 AS DOUBLE) / 100) AS hit_y,
    CASE WHEN event_id % 3 <> 0 THEN CAST((event_id * 71) % 1300 - 650 AS DOUBLE) / 100 END AS bounce_x,
    CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (CAST((event_id * 29) % 1400 AS DOUBLE) / 100) END AS bounce_y,
    CASE WHEN event_id % 7 = 0 THEN false WHEN event_id % 7 = 1 THEN NULL ELSE true END AS crosses_net,
    CAST((event_id * 17) % 101 AS DOUBLE) / 100 AS hit_score, CASE WHEN event_id % 5 <> 0 THEN CAST((event_id * 13) % 250 AS DOUBLE) / 100 END AS net_clearance_m,
    CAST((event_id * 11) % 180 AS DOUBLE) / 100 + CAST(0.5 AS DOUBLE) AS contact_height_m,
    CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 4 < 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS split_step,
    CASE WHEN event_id % 2 = 0 THEN CAST((event_id * 41) % 400 AS DOUBLE) / 100 END AS recovery_m,
    CASE WHEN event_id % 4 = 1 THEN CAST((event_id * 19) % 9000 AS DOUBLE) / 100 + 90 END AS knee_bend_deg,
    CASE WHEN event_id % 5 = 2 THEN CAST((event_id * 23) % 100 AS DOUBLE) / 100 END AS shoulder_turn
  FROM events)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with rally, place in the rally, and placement."""
    out = gaps.sessionize(hits(spark, sf_dir), ["session_id"], "t", "shot_id", "side", F.col("stroke") == "serve")
    bx, by, toward = F.col("bounce_x"), F.col("bounce_y"), -F.col("side")
    return out.withColumns({
        "in_court": G.in_court(F.col("stroke"), bx, by, toward), "depth": G.depth(by), "direction": G.direction(bx, F.col("hit_x")), "outcome": outcome(),
    })


def outcome() -> Column:
    """net if the ball is known not to cross, else in or out, null if unmeasured."""
    landed = G.in_court(F.col("stroke"), F.col("bounce_x"), F.col("bounce_y"), -F.col("side"))
    return F.when(~F.col("crosses_net"), "net").when(landed, "in").when(~landed, "out")


SHOTS_SQL = HITS_SQL + """, G AS (
  SELECT *, t - LAG(t) OVER w AS gap, LAG(side) OVER w AS side_before FROM H WINDOW w AS (PARTITION BY session_id ORDER BY t, shot_id)
), B AS (
  SELECT *, gap IS NULL OR NOT (gap <= 3 OR (gap <= 5 AND side = side_before)) AS first FROM G
), N AS (
  SELECT *, SUM(CASE WHEN first OR stroke = 'serve' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t, shot_id ROWS UNBOUNDED PRECEDING) - 1 AS rally FROM B
), L AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, rally ORDER BY t, shot_id) - 1 AS pos,
    CASE WHEN bounce_x IS NULL THEN NULL WHEN bounce_y * -side <= 0 THEN false
         WHEN stroke = 'serve' THEN abs(bounce_y) <= 6.4 AND abs(bounce_x) <= 4.115 ELSE abs(bounce_y) <= 11.885 AND abs(bounce_x) <= 4.115 END AS in_court,
    CASE WHEN bounce_y IS NULL THEN NULL WHEN abs(bounce_y) < 6.4 THEN 'short' WHEN abs(bounce_y) > 8.885 THEN 'deep' ELSE 'mid' END AS depth,
    CASE WHEN bounce_x IS NULL THEN NULL WHEN abs(bounce_x) < 1.4 THEN 'middle'
         WHEN sign(bounce_x) = sign(hit_x) OR abs(hit_x) < 0.5 THEN CASE WHEN abs(hit_x) >= 0.5 THEN 'line' ELSE 'middle' END ELSE 'cross' END AS direction
  FROM N
), S AS (
  SELECT *, CASE WHEN crosses_net = false THEN 'net' WHEN in_court THEN 'in' WHEN NOT in_court THEN 'out' END AS outcome FROM L)"""


def rallies(shots_: DataFrame) -> DataFrame:
    """One row for each rally, with its first and last shot."""
    ends = ["stroke", "player_id", "side", "hit_x", "hit_y", "in_court", "crosses_net"]
    edge = lambda f, p: f(F.struct(*ends), F.struct("t", "shot_id")).alias(p)
    out = shots_.groupBy("session_id", "rally").agg(
        (F.min("t") - LIMITS.pad_before_s).alias("start_s"), (F.max("t") + LIMITS.pad_after_s).alias("end_s"), F.count("*").alias("shot_count"), edge(F.min_by, "a"), edge(F.max_by, "z"),
    )
    flat = [F.col(f"{p}.{c}").alias(f"{n}_{c}") for p, n in (("a", "first"), ("z", "last")) for c in ends]
    return out.select("session_id", "rally", "start_s", "end_s", "shot_count", *flat).withColumn("server", F.when(F.col("first_stroke") == "serve", F.col("first_player_id")))


RALLIES_SQL = SHOTS_SQL + """, R AS (
  SELECT session_id, rally, min(t) - 0.5 AS start_s, max(t) + 1.5 AS end_s, count(*) AS shot_count,
    """ + ", ".join(f"{f}({c}, {{'t': t, 'i': shot_id}}) AS {n}_{c}" for f, n in (("arg_min_null", "first"), ("arg_max_null", "last")) for c in ("stroke", "player_id", "side", "hit_x", "hit_y", "in_court", "crosses_net")) + """,
    CASE WHEN arg_min(stroke, {'t': t, 'i': shot_id}) = 'serve' THEN arg_min(player_id, {'t': t, 'i': shot_id}) END AS server
  FROM S GROUP BY session_id, rally)"""


def box() -> Column:
    """The side of the centre mark that the server stood on: -1, 1, null if unclear."""
    return F.when(F.abs("first_hit_x") >= LIMITS.centre_mark_m, F.signum("first_hit_x").cast("int"))


def end() -> Column:
    """The server's end: -1 near, 1 far, 0 unknown."""
    return F.coalesce(F.signum("first_hit_y").cast("int"), F.lit(0))


def points(rallies_: DataFrame) -> DataFrame:
    """Points of a match: serve rallies, faults folded into the serve that follows.

    In a run of faults every second one is a double fault, a point of its own; what
    is left over counts as the fault of the rally that closes the run.
    """
    return judged(rallies_.where(F.col("server").isNotNull()), ["session_id"])


def judged(served: DataFrame, by: list[str]) -> DataFrame:
    """fault, role, p, how, faults, box, end, court of serve rallies, one row each within ``by``; windows only."""
    order = ["rally"]
    w = gaps.ordered(by, order)
    served = served.withColumns({"box": box(), "end": end()})
    nxt = lambda c: F.lead(c).over(w)
    same = nxt("server").eqNullSafe(F.col("server")) & (nxt("start_s") - F.col("end_s") < LIMITS.fault_gap_s)
    boxes = F.when(F.col("box").isNull() | nxt("box").isNull(), F.col("shot_count") == 1).otherwise(F.col("box") == nxt("box"))
    fault = F.coalesce(same & (F.col("shot_count") <= LIMITS.fault_max_shots) & ~F.coalesce("first_in_court", F.lit(False)) & boxes, F.lit(False))
    flagged = served.withColumn("fault", fault)
    before = w.rowsBetween(-(2**31), -1)
    runs = flagged.withColumn("run", F.coalesce(F.sum(F.when(F.col("fault"), 0).otherwise(1)).over(before), F.lit(0)))
    runs = runs.withColumn("place", F.row_number().over(gaps.ordered([*by, "run"], order)))
    double = F.col("fault") & (F.col("place") % 2 == 0)
    runs = runs.withColumn("role", F.when(double, "double_fault").when(F.col("fault"), "fault").otherwise("point"))
    served_last = F.col("last_stroke") == "serve"
    p = F.when(~F.col("last_crosses_net"), 0.12).when(~F.col("last_in_court"), 0.2).when(F.col("last_in_court"), 0.8).when(served_last, 0.3).otherwise(0.25)
    how = F.when(~F.col("last_crosses_net"), "net").when(~F.col("last_in_court"), "out").when(F.col("last_in_court"), F.when(served_last, "ace").otherwise("winner")).otherwise("unknown")
    own = F.col("last_player_id") == F.col("server")
    return runs.withColumns({
        "p": F.when(F.col("role") == "double_fault", 0.08).when(own, p).otherwise(1 - p), "how": F.when(F.col("role") == "double_fault", "double_fault").otherwise(how),
        "faults": F.when(F.col("role") == "double_fault", 2).otherwise((F.col("place") - 1) % 2).cast("int"),
        "court": F.when(F.col("box").isNotNull() & (F.col("end") != 0), -F.col("box") * F.col("end")).otherwise(0),
    })


POINTS_SQL = RALLIES_SQL + """, V AS (
  SELECT *, CASE WHEN abs(first_hit_x) >= 0.2 THEN CAST(sign(first_hit_x) AS INT) END AS box, COALESCE(CAST(sign(first_hit_y) AS INT), 0) AS "end" FROM R WHERE server IS NOT NULL
), W AS (
  SELECT *, LEAD(server) OVER w AS nserver, LEAD(start_s) OVER w AS nstart, LEAD(box) OVER w AS nbox FROM V WINDOW w AS (PARTITION BY session_id ORDER BY rally)
), X AS (
  SELECT *, COALESCE(nserver = server AND nstart - end_s < 25 AND shot_count <= 2 AND first_in_court IS DISTINCT FROM true
    AND CASE WHEN box IS NULL OR nbox IS NULL THEN shot_count = 1 ELSE box = nbox END, false) AS fault FROM W
), Y AS (
  SELECT *, COALESCE(SUM(CASE WHEN fault THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY rally ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM X
), Z AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, run ORDER BY rally) AS place FROM Y
), Q AS (
  SELECT *, CASE WHEN fault AND place % 2 = 0 THEN 'double_fault' WHEN fault THEN 'fault' ELSE 'point' END AS role,
    CASE WHEN last_crosses_net = false THEN CAST(0.12 AS DOUBLE) WHEN last_in_court = false THEN 0.2 WHEN last_in_court THEN 0.8 WHEN last_stroke = 'serve' THEN 0.3 ELSE 0.25 END AS p_hitter,
    CASE WHEN last_crosses_net = false THEN 'net' WHEN last_in_court = false THEN 'out' WHEN last_in_court THEN CASE WHEN last_stroke = 'serve' THEN 'ace' ELSE 'winner' END ELSE 'unknown' END AS how_last FROM Z
), P AS (
  SELECT *, CASE WHEN role = 'double_fault' THEN CAST(0.08 AS DOUBLE) WHEN last_player_id = server THEN p_hitter ELSE 1 - p_hitter END AS p,
    CASE WHEN role = 'double_fault' THEN 'double_fault' ELSE how_last END AS how, CASE WHEN role = 'double_fault' THEN 2 ELSE CAST((place - 1) % 2 AS INT) END AS faults,
    CASE WHEN box IS NOT NULL AND "end" <> 0 THEN -box * "end" ELSE 0 END AS court FROM Q)"""
