"""Rallies, serves, points, session kind and score statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyplan.operators import gaps
from rallyplan.operators.robust import half_even
from rallyplan.plans.base import query
from rallyplan.sources.tracking import POINTS_SQL, RALLIES_SQL, SHOTS_SQL, points, rallies, shots


@query(f"WITH {SHOTS_SQL} SELECT session_id, shot_id, CAST(rally AS BIGINT) AS rally, CAST(pos AS BIGINT) AS pos, first FROM S")
def rally_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rally of every hit by the gap rule."""
    return shots(spark, sf_dir).select("session_id", "shot_id", F.col("rally").cast("long").alias("rally"), F.col("pos").cast("long").alias("pos"), "first")


@query(f"WITH {RALLIES_SQL} SELECT session_id, CAST(rally AS BIGINT) AS rally, round_even(start_s, 6) AS start_s, round_even(end_s, 6) AS end_s, shot_count, server, first_stroke FROM R")
def rally_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each rally, padded in time."""
    r = rallies(shots(spark, sf_dir))
    return r.select("session_id", F.col("rally").cast("long").alias("rally"), half_even(F.col("start_s"), 6).alias("start_s"), half_even(F.col("end_s"), 6).alias("end_s"), "shot_count", "server", "first_stroke")


@query(f"""WITH {RALLIES_SQL}, A AS (SELECT session_id, rally, server, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY rally) - ROW_NUMBER() OVER (PARTITION BY session_id, server ORDER BY rally) AS grp FROM R WHERE server IS NOT NULL)
SELECT session_id, server, min(rally)::BIGINT AS first_rally, count(*) AS n FROM A GROUP BY session_id, server, grp""")
def serve_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rallies served by one player."""
    served = rallies(shots(spark, sf_dir)).where(F.col("server").isNotNull())
    runs = gaps.islands(served, ["session_id"], ["rally"], "server")
    return runs.groupBy("session_id", "server", "island").agg(F.min("rally").cast("long").alias("first_rally"), F.count("*").alias("n")).drop("island")


def kind_evidence(r: DataFrame) -> DataFrame:
    """What tells a match from training, by session; windows within a session and one aggregate.

    Serve rallies are looked at among themselves (``served``): gaps between them, and
    runs of one server, each counted at the first rally of the run.
    """
    by = ["session_id", "served"]
    w = gaps.ordered(by, ["rally"])
    s = gaps.islands(r.withColumn("served", F.col("server").isNotNull()), by, ["rally"], "server", "run")
    run = gaps.ordered([*by, "run"], ["rally"])
    length = F.count("*").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumns({"gap": F.when(F.col("served"), F.col("start_s") - F.lag("start_s").over(w)), "length": F.when(F.col("served") & (F.row_number().over(run) == 1), length)})
    out = s.groupBy("session_id").agg(
        F.count("*").alias("rallies"), F.avg((F.col("shot_count") >= 12).cast("double")).alias("long_share"), F.count("server").alias("serves"), F.median("gap").alias("serve_gap"),
        F.count("length").alias("runs"), F.avg(F.when(F.col("length").isNotNull(), F.col("length").between(3, 16).cast("double"))).alias("game_like"),
    )
    game = F.when(F.col("runs") >= 2, F.col("game_like")).otherwise(F.lit(0.0))
    share = F.col("serves") / F.col("rallies")
    gap = F.coalesce("serve_gap", F.lit(0.0))
    enough = 3.0 * (game - 0.3) + F.when(gap.between(12.0, 90.0), 1.5).otherwise(-1.0) + 2.0 * (F.least(share, F.lit(0.6)) - 0.2)
    z = F.lit(-1.0) + F.when(F.col("serves") >= 6, enough).otherwise(0.0) - 3.0 * F.greatest(F.lit(0.0), F.col("long_share") - 0.25)
    p = F.when(F.col("rallies") >= 6, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.5))
    kind = F.when(F.col("rallies") < 6, "unknown").when(p >= 0.6, "match").when(p <= 0.4, "training").otherwise("unknown")
    return out.select("session_id", "rallies", "serves", share.alias("serve_share"), gap.alias("serve_gap"), "long_share", game.alias("game_like"), p.alias("p_match"), kind.alias("kind"))


@query(f"""WITH {RALLIES_SQL}, T AS (SELECT session_id, rally, server, start_s - LAG(start_s) OVER (PARTITION BY session_id ORDER BY rally) AS gap,
  ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY rally) - ROW_NUMBER() OVER (PARTITION BY session_id, server ORDER BY rally) AS grp FROM R WHERE server IS NOT NULL),
U AS (SELECT session_id, count(*) AS serves, median(gap) AS gap FROM T GROUP BY 1), C AS (SELECT session_id, server, grp, count(*) AS n FROM T GROUP BY 1, 2, 3),
D AS (SELECT session_id, CASE WHEN count(*) >= 2 THEN avg(CASE WHEN n BETWEEN 3 AND 16 THEN 1.0 ELSE 0.0 END) ELSE 0 END AS game FROM C GROUP BY 1),
E AS (SELECT session_id, count(*) AS rallies, avg(CASE WHEN shot_count >= 12 THEN 1.0 ELSE 0.0 END) AS long_share FROM R GROUP BY 1),
F AS (SELECT E.session_id, rallies, COALESCE(serves, 0) AS serves, COALESCE(gap, 0) AS gap, COALESCE(game, 0) AS game, long_share FROM E LEFT JOIN U USING (session_id) LEFT JOIN D USING (session_id)),
K AS (SELECT *, CASE WHEN rallies < 6 THEN 0.5 ELSE 1 / (1 + exp(-(-1.0 + CASE WHEN serves >= 6 THEN 3.0 * (game - 0.3) + CASE WHEN gap BETWEEN 12 AND 90 THEN 1.5 ELSE -1.0 END + 2.0 * (least(serves / rallies, 0.6) - 0.2) ELSE 0 END - 3.0 * greatest(0, long_share - 0.25)))) END AS p FROM F)
SELECT session_id, rallies, serves, round_even(serves / rallies, 3) AS serve_share, round_even(gap, 1) AS serve_gap_s, round_even(long_share, 3) AS long_rally_share, round_even(game, 3) AS game_like, round_even(p, 3) AS p_match,
  CASE WHEN rallies < 6 THEN 'unknown' WHEN p >= 0.6 THEN 'match' WHEN p <= 0.4 THEN 'training' ELSE 'unknown' END AS kind FROM K""")
def session_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match or training, with the evidence."""
    k = kind_evidence(rallies(shots(spark, sf_dir)))
    r = lambda c, n, a: half_even(F.col(c), n).alias(a)
    return k.select("session_id", "rallies", "serves", r("serve_share", 3, "serve_share"), r("serve_gap", 1, "serve_gap_s"), r("long_share", 3, "long_rally_share"), r("game_like", 3, "game_like"), r("p_match", 3, "p_match"), "kind")


@query(f"""WITH {POINTS_SQL} SELECT session_id, rally::BIGINT AS rally, fault, role FROM P""")
def fault_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which serve rallies were faults."""
    return points(rallies(shots(spark, sf_dir))).select("session_id", F.col("rally").cast("long").alias("rally"), "fault", "role")


@query(f"""WITH {POINTS_SQL} SELECT session_id, rally::BIGINT AS rally, server, round_even(p, 6) AS p, how, faults::INT AS faults, "end"::INT AS "end", court::INT AS court FROM P WHERE role <> 'fault'""")
def match_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with who served, who probably won, and how they ended."""
    p = points(rallies(shots(spark, sf_dir))).where("role <> 'fault'")
    return p.select("session_id", F.col("rally").cast("long").alias("rally"), "server", half_even(F.col("p"), 6).alias("p"), "how", "faults", "end", "court")


@query(f"""WITH {POINTS_SQL}, AA AS (SELECT *, CASE WHEN p > 0.5 THEN server ELSE 4 * session_id + 1 - server END AS winner FROM P WHERE role <> 'fault'),
BB AS (SELECT session_id, server AS player_id, count(*) AS service_points, sum(CASE WHEN faults = 0 THEN 1 ELSE 0 END) AS first_in, sum(CASE WHEN how = 'ace' AND winner = server THEN 1 ELSE 0 END) AS aces, sum(CASE WHEN how = 'double_fault' THEN 1 ELSE 0 END) AS dfs, 0 AS won FROM AA GROUP BY 1, 2
 UNION ALL SELECT session_id, winner, 0, 0, 0, 0, count(*) FROM AA GROUP BY 1, 2)
SELECT session_id, player_id, sum(won)::BIGINT AS points_won, sum(service_points)::BIGINT AS service_points, CASE WHEN sum(service_points) > 0 THEN round_even(sum(first_in) / sum(service_points), 3) END AS first_serve_in_pct, sum(aces)::BIGINT AS aces, sum(dfs)::BIGINT AS double_faults FROM BB GROUP BY 1, 2""")
def scoring_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points won, serves, aces and double faults by player; the likelier side won each point."""
    p = points(rallies(shots(spark, sf_dir))).where("role <> 'fault'")
    p = p.withColumn("winner", F.when(F.col("p") > 0.5, F.col("server")).otherwise(F.col("session_id") * 4 + 1 - F.col("server")))
    both = p.select("session_id", "faults", "how", "winner", "server", F.explode(F.array(F.struct(F.col("server").alias("id"), F.lit(True).alias("serves")), F.struct(F.col("winner").alias("id"), F.lit(False).alias("serves")))).alias("x"))
    serves, n = F.col("x.serves"), lambda c: F.count_if(c)
    out = both.groupBy("session_id", F.col("x.id").alias("player_id")).agg(
        n(~serves).alias("points_won"), n(serves).alias("service_points"), n(serves & (F.col("faults") == 0)).alias("first_in"),
        n(serves & (F.col("how") == "ace") & (F.col("winner") == F.col("server"))).alias("aces"), n(serves & (F.col("how") == "double_fault")).alias("double_faults"),
    )
    share = F.when(F.col("service_points") > 0, half_even(F.col("first_in") / F.col("service_points"), 3))
    return out.select("session_id", "player_id", "points_won", "service_points", share.alias("first_serve_in_pct"), "aces", "double_faults")
