"""The whole stage of player profiles: rows by stroke, technique, trend over sessions, and what the numbers say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyplan.operators.robust import half_even, least_support
from rallyplan.plans.base import query
from rallyplan.plans.insight_queries import METRICS, METRICS_SQL, RULES, rules_that_hold
from rallyplan.plans.insight_queries import metrics as long_metrics
from rallyplan.plans.stages import profiles
from rallyplan.schema import STROKES
from rallyplan.sources.tracking import shots

PROFILE = "player_id long, part string, item string, name string, value double"


def player_profiles(shots: DataFrame, metrics: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Tables ``strokes``, ``technique``, ``trend`` and ``insights`` of all players at once.

    shots: session_id, shot_id, player_id, stroke, speed_kmh, in_court, net_clearance_m,
    contact_height_m; metrics: shot_id, name, value; sessions: session_id, recorded_s, kind.
    Medians of technique need five values, mean speeds of the trend three, its shares five.
    """
    own = shots.select("shot_id", "player_id", "session_id", "stroke")
    told = metrics.join(own, "shot_id")
    median = half_even(F.median("value"), 3)
    by_stroke = told.where(F.col("stroke").isin(*STROKES)).groupBy("player_id", "stroke", "name").agg(least_support(5, "value", median).alias("median")).where("median IS NOT NULL")
    by_stroke = by_stroke.groupBy("player_id", "stroke").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "median")))).alias("technique"))
    strokes = profiles(shots).join(by_stroke, ["player_id", "stroke"], "left")

    technique = told.groupBy("player_id", "name").agg(F.count("value").alias("n"), least_support(5, "value", median).alias("median"))

    wide = told.where(F.col("name").isin(*METRICS)).groupBy("shot_id").pivot("name", list(METRICS)).agg(F.first("value"))
    all_ = shots.join(wide, "shot_id", "left")
    of = lambda stroke: F.when(F.col("stroke") == stroke, F.col("speed_kmh"))
    rows = all_.withColumns({s: of(s) for s in ("forehand", "backhand", "serve")}).groupBy("player_id", "session_id").agg(
        F.count("*").alias("shots"), *[least_support(3, s, half_even(F.avg(s), 1)).alias(f"{s}_kmh") for s in ("forehand", "backhand", "serve")],
        least_support(5, "in_court", half_even(F.avg(F.col("in_court").cast("double")), 3)).alias("in_pct"),
        least_support(5, "knee_bend_deg", half_even(F.median("knee_bend_deg"), 1)).alias("knee_bend_deg"), least_support(5, "split_step", half_even(F.avg("split_step"), 3)).alias("split_step_pct"),
    )
    oldest = Window.partitionBy("player_id").orderBy(F.col("recorded_s").asc_nulls_first(), "session_id")
    trend = rows.join(sessions.select("session_id", "recorded_s", "kind"), "session_id").withColumn("place", F.row_number().over(oldest) - 1)

    return {"strokes": strokes, "technique": technique, "trend": trend, "insights": rules_that_hold(all_)}


STROKE_VALUES = {"count": "n", "speed_avg": "speed_avg", "speed_max": "speed_max", "n_speed": "n_speed", "in_pct": "in_pct", "n_in": "n_in", "net_clearance_avg": "net_clearance_avg", "n_clear": "n_clear", "contact_height_m": "contact_height_m"}
TREND_VALUES = ("place", "shots", "forehand_kmh", "backhand_kmh", "serve_kmh", "in_pct", "knee_bend_deg", "split_step_pct")
#: When a session was recorded, in SQL that both engines take; some aren't known.
RECORDED = "CASE WHEN session_id % 4 <> 0 THEN CAST((session_id * 37) % 101 AS DOUBLE) END"


def long_profiles(of: dict[str, DataFrame]) -> DataFrame:
    """The four tables as one (player_id, part, item, name, value), null values left out."""
    cells = lambda pairs: F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value")) for n, c in pairs])).alias("x")
    part = lambda rows, name, item, pairs: rows.select("player_id", F.lit(name).alias("part"), F.col(item).cast("string").alias("item"), cells(pairs)).select("player_id", "part", "item", "x.*")
    strokes = part(of["strokes"], "stroke", "stroke", STROKE_VALUES.items())
    technique = of["strokes"].select("player_id", F.lit("stroke").alias("part"), F.col("stroke").alias("item"), F.explode("technique").alias("name", "value"))
    every = part(of["technique"], "technique", "name", [("n", "n"), ("median", "median")])
    trend = part(of["trend"], "trend", "session_id", [(c, c) for c in TREND_VALUES])
    said = of["insights"].select("player_id", F.lit("insight").alias("part"), F.col("text").alias("item"), F.col("level").alias("name"), F.col("place").cast("double").alias("value"))
    return strokes.unionByName(technique).unionByName(every).unionByName(trend).unionByName(said).where("value IS NOT NULL")


def _cells(pairs: dict[str, str]) -> str:
    return "unnest([" + ", ".join(f"{{'name': '{n}', 'value': CAST({e} AS DOUBLE)}}" for n, e in pairs.items()) + "])"


_SHARE = "avg(CASE WHEN in_court THEN 1e0 WHEN NOT in_court THEN 0e0 END)"
_SAID = " UNION ALL ".join(f"SELECT player_id, '{t}' AS item, '{level}' AS name, {i} AS value FROM IW WHERE {c}" for i, (c, t, level) in enumerate(RULES))


@query(f"""WITH {METRICS_SQL}, Q AS (SELECT * FROM S WHERE stroke IN {STROKES}),
PA AS (SELECT player_id, stroke, {_cells({"count": "count(*)", "speed_avg": "round_even(avg(speed_kmh), 1)", "speed_max": "round_even(max(speed_kmh), 1)", "n_speed": "count(speed_kmh)", "in_pct": f"round_even({_SHARE}, 3)", "n_in": "count(in_court)", "net_clearance_avg": "round_even(avg(net_clearance_m), 2)", "n_clear": "count(net_clearance_m)", "contact_height_m": "round_even(median(contact_height_m), 2)"})} AS x FROM Q GROUP BY player_id, stroke),
PB AS (SELECT Q.player_id, stroke, name, round_even(median(value), 3) AS value FROM Q JOIN M USING (shot_id) GROUP BY 1, 2, 3 HAVING count(*) >= 5),
PC AS (SELECT player_id, name AS item, {_cells({"n": "count(value)", "median": "CASE WHEN count(value) >= 5 THEN round_even(median(value), 3) END"})} AS x FROM M GROUP BY player_id, name),
TR AS (SELECT player_id, session_id, count(*) AS shots, {", ".join(f"CASE WHEN count(speed_kmh) FILTER (stroke = '{s}') >= 3 THEN round_even(avg(speed_kmh) FILTER (stroke = '{s}'), 1) END AS {s}_kmh" for s in ("forehand", "backhand", "serve"))},
  CASE WHEN count(in_court) >= 5 THEN round_even({_SHARE}, 3) END AS in_pct, CASE WHEN count(knee_bend_deg) >= 5 THEN round_even(median(knee_bend_deg), 1) END AS knee_bend_deg, CASE WHEN count(split_step) >= 5 THEN round_even(avg(split_step), 3) END AS split_step_pct FROM S GROUP BY 1, 2),
TP AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY {RECORDED} NULLS FIRST, session_id) - 1 AS place FROM TR),
PD AS (SELECT player_id, session_id, {_cells({c: c for c in TREND_VALUES})} AS x FROM TP),
IW AS (SELECT player_id, round_even(avg(speed_kmh) FILTER (stroke = 'forehand'), 1) AS fs, round_even(avg(speed_kmh) FILTER (stroke = 'backhand'), 1) AS bs, round_even(avg(speed_kmh) FILTER (stroke = 'serve'), 1) AS sv, count(in_court) FILTER (stroke = 'forehand') AS fh_n_in, round_even({_SHARE} FILTER (stroke = 'forehand'), 3) AS fh_in,
  count(net_clearance_m) FILTER (stroke = 'forehand') AS fh_n_clear, round_even(avg(net_clearance_m) FILTER (stroke = 'forehand'), 2) AS fh_clear, count(knee_bend_deg) AS knee_n, round_even(median(knee_bend_deg), 6) AS knee, count(shoulder_turn) AS turn_n, round_even(median(shoulder_turn), 6) AS turn,
  count(split_step) AS split_n, round_even(avg(split_step), 6) AS split, count(recovery_m) AS rec_n, round_even(median(recovery_m), 6) AS rec FROM S GROUP BY 1)
SELECT player_id, 'stroke' AS part, stroke AS item, x.name AS name, x.value AS value FROM PA WHERE x.value IS NOT NULL UNION ALL SELECT player_id, 'stroke', stroke, name, value FROM PB
UNION ALL SELECT player_id, 'technique', item, x.name, x.value FROM PC WHERE x.value IS NOT NULL UNION ALL SELECT player_id, 'trend', CAST(session_id AS VARCHAR), x.name, x.value FROM PD WHERE x.value IS NOT NULL
UNION ALL SELECT player_id, 'insight', item, name, CAST(value AS DOUBLE) FROM ({_SAID})""")
def whole_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every player's profile, one a row."""
    s = shots(spark, sf_dir)
    sessions = s.select("session_id").distinct().withColumns({"recorded_s": F.expr(RECORDED), "kind": F.lit("match")})
    return long_profiles(player_profiles(s.drop(*METRICS), long_metrics(s).drop("player_id"), sessions))
