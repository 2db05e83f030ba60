"""Shots with their errors, rate cards, tables of errors, statistics of players, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G
from rallyplan.operators import gaps
from rallyplan.operators.robust import half_even, least_support, upper_median
from rallyplan.plans.base import query
from rallyplan.schema import LIMITS, STROKES
from rallyplan.sources.tracking import POINTS_SQL, SHOTS_SQL, judged, shots

METRICS = ("split_step", "recovery_m", "knee_bend_deg", "shoulder_turn")


def with_rally_ends(s: DataFrame) -> DataFrame:
    """Shots with their rally's shot_count, start_s, end_s, end_reason (a point's, ``fault``, ``not_a_point``) and winner.

    Everything is a window within a session, so the one shuffle by session that
    numbered the rallies is enough: the rally's facts stand on its first shot, where
    serve rallies are judged, and go from there to the others.
    """
    ends = ["stroke", "player_id", "side", "hit_x", "hit_y", "in_court", "crosses_net"]
    of_rally = Window.partitionBy("session_id", "rally")
    last = F.max_by(F.struct(*ends), F.struct("t", "shot_id")).over(of_rally)
    h = s.withColumns({"shot_count": F.count("*").over(of_rally), "start_s": F.min("t").over(of_rally) - LIMITS.pad_before_s, "end_s": F.max("t").over(of_rally) + LIMITS.pad_after_s, "z": last})
    h = h.withColumns({f"first_{c}": F.col(c) for c in ends} | {f"last_{c}": F.col(f"z.{c}") for c in ends} | {"server": F.when((F.col("pos") == 0) & (F.col("stroke") == "serve"), F.col("player_id"))})
    j = judged(h.withColumn("served", F.col("server").isNotNull()), ["session_id", "served"])
    reason = F.when(~F.col("served"), "not_a_point").when(F.col("role") == "fault", "fault").otherwise(F.col("how"))
    winner = F.when(F.col("served") & (F.col("role") != "fault"), F.when(F.col("p") > 0.5, F.col("server")).otherwise(F.col("session_id") * 4 + 1 - F.col("server")))
    told = F.max(F.when(F.col("pos") == 0, F.struct(reason.alias("end_reason"), winner.alias("winner")))).over(of_rally)
    return j.withColumn("told", told).select(*s.columns, "shot_count", "start_s", "end_s", "told.*")


def rally_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each rally: shot_count, start_s, end_s, end_reason, winner."""
    return with_rally_ends(shots(spark, sf_dir)).where("pos = 0").select("session_id", "rally", "shot_count", "start_s", "end_s", "end_reason", "winner")


def shot_error() -> Column:
    """The error that a shot was; a serve's is a fault."""
    missed = F.col("outcome").isin("net", "out")
    served = F.when(F.col("end_reason") == "double_fault", "double_fault").when((F.col("end_reason") == "fault") | missed, "fault")
    return F.when(F.col("stroke") == "serve", served).otherwise(F.when(missed, F.col("outcome")))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots with their rally, error kind, zone, and the ball they answer."""
    s = with_rally_ends(shots(spark, sf_dir))
    w = gaps.ordered(["session_id", "rally"], ["t", "shot_id"])
    before = F.lag(F.struct("player_id", "depth", "speed_kmh")).over(w)
    out = s.withColumn("error", shot_error()).withColumn("zone", G.zone(F.col("hit_y"))).withColumn("before", before)
    return out.withColumn("incoming", F.when(F.col("before.player_id") != F.col("player_id"), F.col("before"))).drop("before")


ENRICHED_SQL = POINTS_SQL + """, RE AS (
  SELECT R.session_id, R.rally, CASE WHEN P.role IS NULL THEN 'not_a_point' WHEN P.role = 'fault' THEN 'fault' ELSE P.how END AS end_reason, R.shot_count AS rally_shots,
    CASE WHEN P.role IN ('point', 'double_fault') THEN CASE WHEN P.p > 0.5 THEN P.server ELSE 4 * R.session_id + 1 - P.server END END AS winner
  FROM R LEFT JOIN P ON R.session_id = P.session_id AND R.rally = P.rally
), E0 AS (
  SELECT S.*, end_reason, winner, rally_shots, LAG(player_id) OVER w AS bplayer, LAG(S.depth) OVER w AS bdepth, LAG(speed_kmh) OVER w AS bspeed
  FROM S LEFT JOIN RE USING (session_id, rally) WINDOW w AS (PARTITION BY S.session_id, S.rally ORDER BY t, shot_id)
), E AS (
  SELECT *, CASE WHEN stroke = 'serve' THEN CASE WHEN end_reason = 'double_fault' THEN 'double_fault' WHEN end_reason = 'fault' OR outcome IN ('net', 'out') THEN 'fault' END
      WHEN outcome IN ('net', 'out') THEN outcome END AS error,
    CASE WHEN abs(hit_y) < 6.4 THEN 0 WHEN abs(hit_y) < 10.485 THEN 1 WHEN abs(hit_y) < 12.885 THEN 2 ELSE 3 END AS zone,
    CASE WHEN bplayer <> player_id THEN bdepth END AS idepth, CASE WHEN bplayer <> player_id THEN bspeed END AS ispeed FROM E0)"""


@query(f"WITH {SHOTS_SQL} SELECT shot_id, outcome FROM S")
def shot_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """net, in, out, or null where it wasn't measured."""
    return shots(spark, sf_dir).select("shot_id", "outcome")


@query(f"WITH {ENRICHED_SQL} SELECT shot_id, error, zone::INT AS zone FROM E")
def shot_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error that each shot was, after a left join with its rally."""
    return enriched(spark, sf_dir).select("shot_id", "error", F.col("zone").cast("int").alias("zone"))


@query(f"""WITH {SHOTS_SQL} SELECT shot_id, CASE WHEN bounce_x IS NULL OR outcome IS DISTINCT FROM 'out' THEN NULL WHEN abs(bounce_y) > CASE WHEN stroke = 'serve' THEN 6.4 ELSE 11.885 END THEN 'long' ELSE 'wide' END AS side FROM S""")
def miss_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a ball that went out missed."""
    limit = F.when(F.col("stroke") == "serve", 6.4).otherwise(11.885)
    side = F.when(F.col("bounce_x").isNotNull() & (F.col("outcome") == "out"), F.when(F.abs("bounce_y") > limit, "long").otherwise("wide"))
    return shots(spark, sf_dir).select("shot_id", side.alias("side"))


@query(f"WITH {SHOTS_SQL} SELECT shot_id, in_court, depth, direction FROM S")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each ball landed."""
    return shots(spark, sf_dir).select("shot_id", "in_court", "depth", "direction")


@query(f"WITH {SHOTS_SQL} SELECT shot_id, gap >= 5 AND abs(hit_y) >= 10.5 AND abs(hit_x) <= 4.5 AS by_position, CASE WHEN stroke = 'serve' AND NOT first AND abs(hit_y) < 10.5 THEN 'overhead' ELSE stroke END AS stroke FROM S WHERE gap IS NOT NULL")
def serve_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serves by where they were hit from; a serve from inside the court in mid-rally is a smash."""
    s = shots(spark, sf_dir).where(F.col("gap").isNotNull())
    by_position = (F.col("gap") >= 5.0) & (F.abs("hit_y") >= 10.5) & (F.abs("hit_x") <= 4.5)
    smash = (F.col("stroke") == "serve") & ~F.col("first") & (F.abs("hit_y") < 10.5)
    return s.select("shot_id", by_position.alias("by_position"), F.when(smash, "overhead").otherwise(F.col("stroke")).alias("stroke"))


LOW_SQL = "CASE stroke WHEN 'serve' THEN 60 WHEN 'overhead' THEN 40 WHEN 'forehand' THEN 30 WHEN 'backhand' THEN 30 ELSE 20 END"
HIGH_SQL = "CASE stroke WHEN 'serve' THEN 230 WHEN 'overhead' THEN 200 WHEN 'forehand' THEN 180 WHEN 'backhand' THEN 170 ELSE 140 END"


@query(f"WITH {SHOTS_SQL} SELECT shot_id, CASE WHEN speed_kmh BETWEEN {LOW_SQL} AND {HIGH_SQL} THEN speed_kmh END AS speed_kmh FROM S")
def plausible_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeds outside their stroke's range are dropped; the ranges are a five-row lookup."""
    ranges = [("serve", 60.0, 230.0), ("overhead", 40.0, 200.0), ("forehand", 30.0, 180.0), ("backhand", 30.0, 170.0), ("volley_forehand", 20.0, 140.0)]
    look = spark.createDataFrame(ranges, "stroke string, lo double, hi double")
    s = shots(spark, sf_dir).join(F.broadcast(look), "stroke", "left")  # five rows
    return s.select("shot_id", F.when(F.col("speed_kmh").between(F.col("lo"), F.col("hi")), F.col("speed_kmh")).alias("speed_kmh"))


def _rates(df: DataFrame, bucket: str, wanted: list) -> DataFrame:
    """player_id, bucket, n, errors for every player and every bucket of the list, 0 where there is none; one aggregate."""
    inside = lambda w: F.col(bucket) == w
    cell = lambda w: F.struct(F.lit(w).alias("bucket"), F.count_if(inside(w)).alias("n"), F.count_if(inside(w) & F.col("error").isNotNull()).alias("errors"))
    return df.groupBy("player_id").agg(F.array(*map(cell, wanted)).alias("x")).select("player_id", F.inline("x"))


RATE_SQL = "WITH {ctes}, D AS (SELECT DISTINCT player_id FROM E WHERE stroke <> 'serve'), K AS (SELECT unnest({buckets}) AS bucket) SELECT D.player_id, K.bucket, count(E.shot_id) AS n, count(E.error) AS errors FROM D CROSS JOIN K LEFT JOIN E ON E.player_id = D.player_id AND E.stroke <> 'serve' AND {expr} = K.bucket GROUP BY 1, 2"


@query(RATE_SQL.format(ctes=ENRICHED_SQL, buckets="[0, 1, 2, 3]", expr="E.zone"))
def zone_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by how far from the net a ball was hit."""
    return _rates(enriched(spark, sf_dir).where("stroke <> 'serve'"), "zone", [0, 1, 2, 3])


@query(RATE_SQL.format(ctes=ENRICHED_SQL, buckets="['short', 'mid', 'deep']", expr="E.idepth"))
def incoming_depth_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by the depth of the ball that was answered."""
    s = enriched(spark, sf_dir).where("stroke <> 'serve'").withColumn("d", F.col("incoming.depth"))
    return _rates(s, "d", ["short", "mid", "deep"])


@query(RATE_SQL.format(ctes=ENRICHED_SQL, buckets="['slow', 'medium', 'fast']", expr="CASE WHEN ispeed >= 90 THEN 'fast' WHEN ispeed >= 60 THEN 'medium' WHEN ispeed >= 0 THEN 'slow' END"))
def incoming_speed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by the speed of the ball that was answered."""
    v = F.col("incoming.speed_kmh")
    band = F.when(v >= 90, "fast").when(v >= 60, "medium").when(v >= 0, "slow")
    return _rates(enriched(spark, sf_dir).where("stroke <> 'serve'").withColumn("d", band), "d", ["slow", "medium", "fast"])


@query(f"""WITH {ENRICHED_SQL}, PL AS (SELECT DISTINCT session_id, player_id FROM S), GB AS (SELECT session_id, winner, CASE WHEN rally_n <= 4 THEN '1-4' WHEN rally_n <= 8 THEN '5-8' ELSE '9+' END AS band FROM (SELECT *, rally_shots AS rally_n FROM (SELECT DISTINCT session_id, rally, winner, rally_shots FROM E0) WHERE winner IS NOT NULL))
SELECT player_id, band, count(*) AS n, sum(CASE WHEN winner = player_id THEN 1 ELSE 0 END)::BIGINT AS won FROM PL JOIN GB USING (session_id) GROUP BY 1, 2""")
def points_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points won by the number of shots."""
    n = F.col("shot_count")
    players = F.collect_set("player_id").over(Window.partitionBy("session_id"))  # a handful
    points_ = with_rally_ends(shots(spark, sf_dir)).withColumn("players", players).where("pos = 0 AND winner IS NOT NULL")
    band = F.when(n <= 4, "1-4").when(n <= 8, "5-8").otherwise("9+")
    each = points_.select(F.explode("players").alias("player_id"), band.alias("band"), "winner")
    return each.groupBy("player_id", "band").agg(F.count("*").alias("n"), F.count_if(F.col("winner") == F.col("player_id")).alias("won"))


@query(f"""WITH {ENRICHED_SQL} SELECT player_id, CASE WHEN abs(bounce_x) < 8.23 / 6 THEN 'T' WHEN abs(bounce_x) < 8.23 / 3 THEN 'body' ELSE 'wide' END AS target, count(*) AS n, count(*) FILTER (error IS NULL) AS landed,
  count(*) FILTER (error IS NULL AND winner IS NOT NULL) AS played, count(*) FILTER (error IS NULL AND winner = player_id) AS won FROM E WHERE stroke = 'serve' AND bounce_x IS NOT NULL GROUP BY 1, 2""")
def serve_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serves by the third of the box that they were aimed at."""
    d, third = F.abs("bounce_x"), 8.23 / 6
    s = enriched(spark, sf_dir).where((F.col("stroke") == "serve") & F.col("bounce_x").isNotNull())
    good = F.col("error").isNull()
    return s.groupBy("player_id", F.when(d < third, "T").when(d < 8.23 / 3, "body").otherwise("wide").alias("target")).agg(
        F.count("*").alias("n"), F.count_if(good).alias("landed"), F.count_if(good & F.col("winner").isNotNull()).alias("played"), F.count_if(good & (F.col("winner") == F.col("player_id"))).alias("won"),
    )


@query(f"""WITH {SHOTS_SQL} SELECT player_id, count(split_step) AS splits, round_even(avg(CASE WHEN split_step >= 0.5 THEN 1.0 WHEN split_step IS NOT NULL THEN 0.0 END), 6) AS split_rate,
  list_sort(list(recovery_m) FILTER (recovery_m IS NOT NULL))[CAST(floor(count(recovery_m) / 2.0) AS BIGINT) + 1] AS recovery_median, round_even(avg(CASE WHEN recovery_m <= 1.5 THEN 1.0 WHEN recovery_m IS NOT NULL THEN 0.0 END), 6) AS recovered FROM S GROUP BY 1""")
def movement_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split steps and recovery; the median is the upper one."""
    share = lambda c, hit: half_even(F.avg(F.when(F.col(c).isNotNull(), hit.cast("double"))), 6)
    return shots(spark, sf_dir).groupBy("player_id").agg(
        F.count("split_step").alias("splits"), share("split_step", F.col("split_step") >= 0.5).alias("split_rate"), upper_median("recovery_m").alias("recovery_median"), share("recovery_m", F.col("recovery_m") <= 1.5).alias("recovered"),
    )


@query(f"""WITH {ENRICHED_SQL} SELECT player_id, stroke, count(*) FILTER (error = 'net') AS net, count(*) FILTER (error = 'out') AS "out", count(*) FILTER (error = 'fault') AS fault, count(*) FILTER (error = 'double_fault') AS double_fault, count(*) AS shots, round_even(count(error) / count(*), 6) AS share FROM E GROUP BY 1, 2 HAVING count(error) > 0""")
def error_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each player by stroke and kind, with the share of shots."""
    kinds = ["net", "out", "fault", "double_fault"]
    g = enriched(spark, sf_dir).groupBy("player_id", "stroke").agg(*[F.count_if(F.col("error") == k).alias(k) for k in kinds], F.count("*").alias("shots"), F.count("error").alias("e"))
    return g.where("e > 0").withColumn("share", half_even(F.col("e") / F.col("shots"), 6)).drop("e")


@query(f"WITH {ENRICHED_SQL} SELECT player_id, stroke, error, count(*) AS n, grouping(player_id, stroke, error)::INT AS level FROM E WHERE error IS NOT NULL GROUP BY CUBE (player_id, stroke, error)")
def error_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors at every grain of player, stroke and kind."""
    return enriched(spark, sf_dir).where(F.col("error").isNotNull()).cube("player_id", "stroke", "error").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query(f"""WITH {SHOTS_SQL} SELECT player_id, stroke, count(*) AS shots, round_even(avg(speed_kmh), 1) AS speed_avg, round_even(max(speed_kmh), 1) AS speed_max, count(speed_kmh) AS speed_n, round_even(avg(CASE WHEN in_court THEN 1.0 WHEN NOT in_court THEN 0.0 END), 3) AS in_pct FROM S GROUP BY 1, 2""")
def stroke_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, speeds and share in by player and stroke."""
    return shots(spark, sf_dir).groupBy("player_id", "stroke").agg(
        F.count("*").alias("shots"), half_even(F.avg("speed_kmh"), 1).alias("speed_avg"), half_even(F.max("speed_kmh"), 1).alias("speed_max"), F.count("speed_kmh").alias("speed_n"), half_even(F.avg(F.col("in_court").cast("double")), 3).alias("in_pct"),
    )


@query(f"""WITH {SHOTS_SQL} SELECT session_id, player_id, count(*) AS shots, round_even(avg(net_clearance_m) FILTER (stroke <> 'serve'), 2) AS net_clearance_avg_m, count(*) FILTER (depth = 'short') AS short, count(*) FILTER (depth = 'mid') AS mid, count(*) FILTER (depth = 'deep') AS deep, count(*) FILTER (direction = 'cross') AS "cross", count(*) FILTER (direction = 'line') AS line, count(*) FILTER (direction = 'middle') AS middle FROM S GROUP BY 1, 2""")
def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player's counts in a session; empty depths and directions don't count."""
    n = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return shots(spark, sf_dir).groupBy("session_id", "player_id").agg(
        F.count("*").alias("shots"), half_even(F.avg(F.when(F.col("stroke") != "serve", F.col("net_clearance_m"))), 2).alias("net_clearance_avg_m"),
        *[n("depth", v) for v in ("short", "mid", "deep")], *[n("direction", v) for v in ("cross", "line", "middle")],
    )


@query(f"""WITH {ENRICHED_SQL}, KM AS (SELECT session_id, session_id % 2 = 0 AS is_match FROM S GROUP BY 1), PS AS (SELECT DISTINCT session_id FROM RE WHERE end_reason NOT IN ('not_a_point'))
SELECT E.session_id, count(*) AS shots, count(DISTINCT rally) AS rallies FROM E JOIN KM USING (session_id) LEFT JOIN PS ON PS.session_id = E.session_id WHERE NOT is_match OR PS.session_id IS NULL OR end_reason <> 'not_a_point' GROUP BY 1""")
def playing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots and rallies of a session; in a match (here: even sessions) only points count, if there are any."""
    point = F.col("end_reason") != "not_a_point"
    any_ = F.max(point).over(Window.partitionBy("session_id"))
    kept = with_rally_ends(shots(spark, sf_dir)).withColumn("any", any_).where((F.col("session_id") % 2 != 0) | ~F.col("any") | point)
    return kept.groupBy("session_id").agg(F.count("*").alias("shots"), F.count_if(F.col("pos") == 0).alias("rallies"))


@query(f"WITH {ENRICHED_SQL} SELECT player_id, count(*) AS shots FROM E WHERE end_reason IS DISTINCT FROM 'not_a_point' GROUP BY 1")
def playing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots for a profile: those of rallies that weren't points don't count."""
    return with_rally_ends(shots(spark, sf_dir)).where("end_reason <> 'not_a_point'").groupBy("player_id").agg(F.count("*").alias("shots"))


@query(f"""WITH {ENRICHED_SQL} SELECT session_id, rally::BIGINT AS rally, end_reason, sum(CASE WHEN end_reason NOT IN ('not_a_point', 'fault') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY rally)::BIGINT AS point_number FROM RE WHERE end_reason NOT IN ('not_a_point', 'fault')""")
def playing_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the order of play, numbered without what wasn't one."""
    p = rally_ends(spark, sf_dir).where(~F.col("end_reason").isin("not_a_point", "fault"))
    return p.select("session_id", F.col("rally").cast("long").alias("rally"), "end_reason", F.row_number().over(gaps.ordered(["session_id"], ["rally"])).cast("long").alias("point_number"))


@query(f"""WITH {SHOTS_SQL} SELECT player_id, stroke, count(*) AS n, round_even(avg(speed_kmh), 1) AS speed_avg, count(in_court) AS n_in, round_even(avg(CASE WHEN in_court THEN 1.0 WHEN NOT in_court THEN 0.0 END), 3) AS in_pct, round_even(avg(net_clearance_m), 2) AS net_clearance_avg, count(net_clearance_m) AS n_clear,
  round_even(median(contact_height_m), 2) AS contact_height_m, CASE WHEN count(knee_bend_deg) >= 5 THEN round_even(median(knee_bend_deg), 3) END AS knee_bend_deg FROM S WHERE stroke IN {STROKES} GROUP BY 1, 2""")
def profile_by_stroke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's row for each stroke that the player has."""
    s = shots(spark, sf_dir).where(F.col("stroke").isin(*STROKES))
    return s.groupBy("player_id", "stroke").agg(
        F.count("*").alias("n"), half_even(F.avg("speed_kmh"), 1).alias("speed_avg"), F.count("in_court").alias("n_in"), half_even(F.avg(F.col("in_court").cast("double")), 3).alias("in_pct"), half_even(F.avg("net_clearance_m"), 2).alias("net_clearance_avg"), F.count("net_clearance_m").alias("n_clear"),
        half_even(F.median("contact_height_m"), 2).alias("contact_height_m"), least_support(5, "knee_bend_deg", half_even(F.median("knee_bend_deg"), 3)).alias("knee_bend_deg"),
    )


@query(f"""WITH {SHOTS_SQL} SELECT player_id, date_trunc('day', make_timestamp(CAST(round_even(t * 10000, 0) AS BIGINT) * 1000000))::DATE::VARCHAR AS day, count(*) AS shots, CASE WHEN count(speed_kmh) FILTER (stroke = 'forehand') >= 3 THEN round_even(avg(speed_kmh) FILTER (stroke = 'forehand'), 1) END AS forehand_kmh,
  CASE WHEN count(speed_kmh) FILTER (stroke = 'serve') >= 3 THEN round_even(avg(speed_kmh) FILTER (stroke = 'serve'), 1) END AS serve_kmh, CASE WHEN count(in_court) >= 5 THEN round_even(avg(CASE WHEN in_court THEN 1.0 WHEN NOT in_court THEN 0.0 END), 3) END AS in_pct, CASE WHEN count(split_step) >= 5 THEN round_even(avg(split_step), 3) END AS split_step_pct FROM S GROUP BY 1, 2""")
def profile_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's row for each day of play; a value needs its least number of shots."""
    day = F.timestamp_seconds(F.bround(F.col("t") * 10000, 0)).cast("date").cast("string")
    speed = lambda stroke: F.when(F.col("stroke") == stroke, F.col("speed_kmh"))
    s = shots(spark, sf_dir).withColumns({"day": day, "fh": speed("forehand"), "sv": speed("serve")})
    return s.groupBy("player_id", "day").agg(
        F.count("*").alias("shots"), least_support(3, "fh", half_even(F.avg("fh"), 1)).alias("forehand_kmh"), least_support(3, "sv", half_even(F.avg("sv"), 1)).alias("serve_kmh"),
        least_support(5, "in_court", half_even(F.avg(F.col("in_court").cast("double")), 3)).alias("in_pct"), least_support(5, "split_step", half_even(F.avg("split_step"), 3)).alias("split_step_pct"),
    )


def metrics(s: DataFrame) -> DataFrame:
    """shot_id, player_id, name, value: the metrics as a long table."""
    return s.select("shot_id", "player_id", *METRICS).unpivot(["shot_id", "player_id"], list(METRICS), "name", "value").where(F.col("value").isNotNull())


METRICS_SQL = SHOTS_SQL + ", M AS (" + " UNION ALL ".join(f"SELECT shot_id, player_id, '{m}' AS name, {m} AS value FROM S WHERE {m} IS NOT NULL" for m in METRICS) + ")"


@query(f"WITH {METRICS_SQL}, PP AS (SELECT DISTINCT player_id FROM S), NN AS (SELECT unnest({list(METRICS)}) AS name) SELECT PP.player_id, NN.name, count(M.value) AS n, CASE WHEN count(M.value) >= 5 THEN round_even(median(M.value), 3) END AS median FROM PP CROSS JOIN NN LEFT JOIN M ON M.player_id = PP.player_id AND M.name = NN.name GROUP BY 1, 2")
def profile_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of every player, with its median from five values on."""
    cell = lambda m: F.struct(F.lit(m).alias("name"), F.count(m).alias("n"), least_support(5, m, half_even(F.median(m), 3)).alias("median"))
    return shots(spark, sf_dir).groupBy("player_id").agg(F.array(*map(cell, METRICS)).alias("x")).select("player_id", F.inline("x"))


@query(f"WITH {METRICS_SQL} SELECT S.shot_id, M.name, M.value FROM S LEFT JOIN M USING (shot_id)")
def shots_with_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots with their metrics as a map, which is opened again here."""
    s = shots(spark, sf_dir)
    nested = metrics(s).groupBy("shot_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics"))
    return s.select("shot_id").join(nested, "shot_id", "left").select("shot_id", F.explode_outer("metrics").alias("name", "value"))


# Fixed values: (condition on the profile columns, text, level), in order of the report.
RULES = [
    ("fs > bs * 1.15", "The forehand is the weapon", "info"), ("bs > fs * 1.1", "The backhand is faster than the forehand", "work"), ("fs <= bs * 1.15 AND bs <= fs * 1.1", "Forehand and backhand are balanced", "good"),
    ("fh_n_in >= 10 AND fh_in < 0.6", "Few measured forehands landed in", "work"), ("fh_n_in >= 10 AND fh_in > 0.8", "Most measured forehands landed in", "good"),
    ("fh_n_clear >= 10 AND fh_clear < 0.4", "The forehand passes the net low", "work"), ("fh_n_clear >= 10 AND fh_clear > 1.3", "The forehand clears the net safely", "info"),
    ("knee_n >= 5 AND knee > 155", "Legs stay fairly straight", "work"), ("knee_n >= 5 AND knee < 135", "Good leg bend", "good"), ("turn_n >= 5 AND turn < 0.25", "Little shoulder turn", "work"), ("turn_n >= 5 AND turn > 0.45", "A full shoulder turn", "good"),
    ("split_n >= 10 AND split < 0.5", "Few split steps", "work"), ("split_n >= 10 AND split >= 0.5", "Split steps", "good"), ("rec_n >= 5 AND rec > 1.8", "Slow recovery to the centre", "work"), ("sv IS NOT NULL AND sv <> 0", "Serve speed", "info"),
]
INSIGHT_COLUMNS = """round_even(avg(speed_kmh) FILTER (stroke = 'forehand'), 1) AS fs, round_even(avg(speed_kmh) FILTER (stroke = 'backhand'), 1) AS bs, round_even(avg(speed_kmh) FILTER (stroke = 'serve'), 1) AS sv,
  count(in_court) FILTER (stroke = 'forehand') AS fh_n_in, round_even(avg(CASE WHEN in_court THEN 1.0 WHEN NOT in_court THEN 0.0 END) FILTER (stroke = 'forehand'), 3) AS fh_in, count(net_clearance_m) FILTER (stroke = 'forehand') AS fh_n_clear, round_even(avg(net_clearance_m) FILTER (stroke = 'forehand'), 2) AS fh_clear,
  count(knee_bend_deg) AS knee_n, round_even(median(knee_bend_deg), 6) AS knee, count(shoulder_turn) AS turn_n, round_even(median(shoulder_turn), 6) AS turn, count(split_step) AS split_n, round_even(avg(split_step), 6) AS split, count(recovery_m) AS rec_n, round_even(median(recovery_m), 6) AS rec"""


def rules_that_hold(shots: DataFrame) -> DataFrame:
    """player_id, place, text, level of each rule that holds for a player; shots with the metrics as columns."""
    on = lambda stroke, c: F.when(F.col("stroke") == stroke, F.col(c))
    landed = F.col("in_court").cast("double")
    p = shots.groupBy("player_id").agg(
        half_even(F.avg(on("forehand", "speed_kmh")), 1).alias("fs"), half_even(F.avg(on("backhand", "speed_kmh")), 1).alias("bs"), half_even(F.avg(on("serve", "speed_kmh")), 1).alias("sv"),
        F.count(on("forehand", "in_court")).alias("fh_n_in"), half_even(F.avg(F.when(F.col("stroke") == "forehand", landed)), 3).alias("fh_in"), F.count(on("forehand", "net_clearance_m")).alias("fh_n_clear"), half_even(F.avg(on("forehand", "net_clearance_m")), 2).alias("fh_clear"),
        *[x for c, n in (("knee_bend_deg", "knee"), ("shoulder_turn", "turn"), ("recovery_m", "rec")) for x in (F.count(c).alias(f"{n}_n"), half_even(F.median(c), 6).alias(n))], F.count("split_step").alias("split_n"), half_even(F.avg("split_step"), 6).alias("split"),
    )
    said = [F.when(F.expr(c), F.struct(F.lit(i).alias("place"), F.lit(text).alias("text"), F.lit(level).alias("level"))) for i, (c, text, level) in enumerate(RULES)]
    return p.select("player_id", F.explode(F.array_compact(F.array(*said))).alias("x")).select("player_id", "x.*")


@query(f"WITH {SHOTS_SQL}, I AS (SELECT player_id, {INSIGHT_COLUMNS} FROM S GROUP BY 1) " + " UNION ALL ".join(f"SELECT player_id, {i} AS place, '{text}' AS text, '{level}' AS level FROM I WHERE {c}" for i, (c, text, level) in enumerate(RULES)))
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a profile's numbers say: each rule that holds, in the order of the report."""
    return rules_that_hold(shots(spark, sf_dir))


@query(f"""WITH {SHOTS_SQL}, SEC AS (SELECT session_id, side, t, hit_x, hit_y, ROW_NUMBER() OVER (PARTITION BY session_id, side, floor(t) ORDER BY t, hit_x, hit_y) AS k FROM S), ST AS (SELECT session_id, side, t - LAG(t) OVER w AS gap, sqrt((hit_x - LAG(hit_x) OVER w) ** 2 + (hit_y - LAG(hit_y) OVER w) ** 2) AS step FROM SEC WHERE k = 1 WINDOW w AS (PARTITION BY session_id, side ORDER BY t))
SELECT session_id, side, round_even(COALESCE(sum(step) FILTER (step < 1.5 * gap AND gap <= 2), 0), 1) AS distance_m FROM ST GROUP BY 1, 2""")
def distance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres between the first positions of successive seconds; jumps and pauses don't count."""
    second = Window.partitionBy("session_id", "side", F.floor("t")).orderBy("t", "hit_x", "hit_y")
    w = Window.partitionBy("session_id", "side").orderBy("t")
    first = shots(spark, sf_dir).withColumn("k", F.row_number().over(second)).where("k = 1")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    steps = first.select("session_id", "side", d("t").alias("gap"), F.sqrt(d("hit_x") * d("hit_x") + d("hit_y") * d("hit_y")).alias("step"))
    run = F.when((F.col("step") < 1.5 * F.col("gap")) & (F.col("gap") <= 2), F.col("step"))
    return steps.groupBy("session_id", "side").agg(half_even(F.coalesce(F.sum(run), F.lit(0.0)), 1).alias("distance_m"))


@query(f"WITH {ENRICHED_SQL} SELECT shot_id, error, stroke, player_id FROM E WHERE error IS NOT NULL AND stroke = 'forehand' AND error = 'out'")
def error_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faceted list of errors: a facet that is ``all`` doesn't filter."""
    return faceted(enriched(spark, sf_dir).where(F.col("error").isNotNull()), player_id="all", stroke="forehand", error="out").select("shot_id", "error", "stroke", "player_id")


def faceted(df: DataFrame, **facets: object) -> DataFrame:
    """Rows that fit every facet; ``all`` fits anything."""
    return reduce(lambda d, f: d if f[1] == "all" else d.where(F.col(f[0]) == F.lit(f[1])), facets.items(), df)
