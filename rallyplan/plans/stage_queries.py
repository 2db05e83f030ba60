"""Sources, sinks and stages as queries: what is written comes back through the read paths, stages run over the made-up shots.

What they write lies in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyplan import api
from rallyplan.operators.robust import half_even
from rallyplan.plans import stages
from rallyplan.plans.base import query, table
from rallyplan.session import checkpoint_folder
from rallyplan.sources import files, sinks, versions
from rallyplan.sources.tracking import HITS_SQL, SHOTS_SQL, hits, shots


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as gzipped JSON and read with their schema."""
    c, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), scratch(spark, "json")
    sinks.as_json(c, path)
    return files.json_rows(spark, path, c.schema)


@query("SELECT event_id, round_even(CAST(event_id % 7200 AS DOUBLE) / 4, 2) AS t, event_type AS label FROM events WHERE event_id % 3 <> 0")
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (two of three events; the others are written as comments) as CSV with clock times, read as seconds."""
    path = scratch(spark, "labels")
    quarter = F.col("event_id") % 7200
    clock = F.concat_ws(":", F.floor(quarter / 240).cast("string"), F.format_string("%05.2f", (quarter % 240) / 4))
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("# skipped "), "event_id")).alias("event_id"), clock.alias("t"), F.col("event_type").alias("label"))
    rows.write.option("header", True).option("comment", "~").csv(path)  # else the writer would quote the comments
    return files.labels(spark, path).select(F.col("event_id").cast("long").alias("event_id"), half_even(F.col("t"), 2).alias("t"), "label")


@query(f"WITH {HITS_SQL} SELECT session_id, shot_id, CASE WHEN session_id % 2 = 0 THEN 'new' ELSE 'old' END AS state FROM H WHERE session_id % 2 = 1 OR stroke <> 'serve'")
def replaced_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions are put in place; then the even ones anew, without serves, and the others stay."""
    h, store = hits(spark, sf_dir).select("session_id", "shot_id", "stroke"), versions.Store(spark, scratch(spark, "sessions"))
    state = lambda rows, s: rows.select("session_id", "shot_id", F.lit(s).alias("state"))
    store.commit({"shots": state(h, "old")})
    store.commit({"shots": state(h.where("session_id % 2 = 0 AND stroke <> 'serve'"), "new")})
    return store.read("shots")


@query(f"""WITH {SHOTS_SQL}, LV AS (SELECT *, session_id % 2 = 0 OR session_id % 5 = 0 AS anew FROM S)
SELECT session_id, CASE WHEN anew THEN 'new' ELSE 'old' END AS state, count(*) AS shots, count(*) AS metrics, sum(length(stroke))::DOUBLE AS value, count(DISTINCT rally) AS rallies
FROM LV WHERE NOT anew OR (session_id % 5 <> 0 AND stroke <> 'serve') GROUP BY 1, 2""")
def committed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots, metrics and rallies of sessions after three commits: all of them; the even ones anew without serves and every fifth one without results; one that fails when two of its three tables are written."""
    s, store = shots(spark, sf_dir).select("session_id", "shot_id", "rally", "stroke"), versions.Store(spark, scratch(spark, "store"))
    every = s.select("session_id").distinct()

    def save(rows: DataFrame, state: str, sessions: DataFrame, n: Column) -> None:
        metrics = rows.select("shot_id", F.lit("letters").alias("name"), F.length("stroke").cast("double").alias("value"))
        versions.save_analysis(store, rows.withColumn("state", F.lit(state)), metrics, rows.groupBy("session_id", "rally").agg(n.alias("n")), sessions)

    save(s, "old", every, F.count("*"))
    save(s.where("session_id % 2 = 0 AND session_id % 5 <> 0 AND stroke <> 'serve'"), "new", every.where("session_id % 2 = 0 OR session_id % 5 = 0"), F.count("*"))
    try:
        save(s, "lost", every, F.raise_error(F.concat(F.lit("lost "), F.max("shot_id").cast("string"))).cast("long"))
    except Exception as e:
        if "lost" not in str(e):
            raise
    count = lambda t, *c: store.read(t).groupBy("session_id").agg(*c)
    out = count("shots", F.max("state").alias("state"), F.count("*").alias("shots")).join(count("metrics", F.count("*").alias("metrics"), F.sum("value").alias("value")), "session_id", "full")
    return out.join(count("rallies", F.count("n").alias("rallies")), "session_id", "full")


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, true)) AS w(step, wrote)")
def changed_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is written at first, not again in another order, and again when a row is gone."""
    s, path = table(spark, sf_dir, "supplier"), scratch(spark, "supplier")
    steps = [s, s.orderBy(F.desc("s_suppkey")), s.where("s_suppkey > 1")]
    return spark.createDataFrame([(i, sinks.write_if_changed(x, path)) for i, x in enumerate(steps, 1)], "step int, wrote boolean")


@query("SELECT s_nationkey, count(*) AS n, 'suppliers' AS stage, '3' AS version, CAST(NULL AS DOUBLE) AS rating FROM supplier GROUP BY 1")
def contract_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with its provenance, read by a contract that has a column which the file lacks."""
    path = scratch(spark, "contract")
    sinks.with_provenance(table(spark, sf_dir, "supplier"), stage="suppliers", version="3").write.parquet(path)
    kinds = {"s_suppkey": T.LongType(), "s_nationkey": T.IntegerType(), "rating": T.DoubleType(), "rallyplan_stage": T.StringType(), "rallyplan_version": T.StringType()}
    rows = files.contract(spark, path, T.StructType([T.StructField(*x) for x in kinds.items()]), ["s_nationkey", "rating", "rallyplan_stage", "rallyplan_version"])
    return rows.groupBy("s_nationkey", F.col("rallyplan_stage").alias("stage"), F.col("rallyplan_version").alias("version")).agg(F.count("*").alias("n"), F.max("rating").alias("rating"))


@query(f"""WITH {SHOTS_SQL}, P AS (SELECT session_id, player_id, count(*) AS shots, round_even(avg(speed_kmh), 1) AS speed_avg, round_even(max(speed_kmh), 1) AS speed_max, round_even(avg(net_clearance_m) FILTER (stroke <> 'serve'), 2) AS net_clearance_avg_m,
  round_even(avg(CASE WHEN in_court THEN 1e0 WHEN NOT in_court THEN 0e0 END), 3) AS in_pct FROM S GROUP BY 1, 2),
M AS (SELECT session_id, player_id, {", ".join(f"string_agg(k || '=' || n, ',' ORDER BY k) FILTER (what = '{c}') AS by_{c}" for c in ("stroke", "depth", "direction"))} FROM (
  {" UNION ALL ".join(f"SELECT session_id, player_id, '{c}' AS what, {c} AS k, count(*) AS n FROM S WHERE {c} IS NOT NULL AND {c} <> '' GROUP BY 1, 2, 4" for c in ("stroke", "depth", "direction"))}) GROUP BY 1, 2)
SELECT P.*, by_stroke, by_depth, by_direction FROM P LEFT JOIN M USING (session_id, player_id)""")
def summary_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of session summaries, its maps as text."""
    out = stages.summaries(shots(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.withColumns({c: text(c) for c in out.columns if c.startswith("by_")})


@query(f"""WITH {SHOTS_SQL} SELECT player_id, stroke, count(*) AS n, round_even(avg(speed_kmh), 1) AS speed_avg, round_even(max(speed_kmh), 1) AS speed_max, count(speed_kmh) AS n_speed, count(in_court) AS n_in,
  round_even(avg(CASE WHEN in_court THEN 1e0 WHEN NOT in_court THEN 0e0 END), 3) AS in_pct, round_even(avg(net_clearance_m), 2) AS net_clearance_avg, count(net_clearance_m) AS n_clear, round_even(median(contact_height_m), 2) AS contact_height_m
  FROM S WHERE stroke IN ('serve', 'forehand', 'backhand', 'volley_forehand', 'volley_backhand', 'overhead') GROUP BY 1, 2""")
def profile_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of profiles across sessions."""
    return stages.profiles(shots(spark, sf_dir))


@query(f"""WITH RECURSIVE {HITS_SQL}, SP AS (SELECT session_id, count(*) AS labels, min(t) - 0.25e0 - 2 AS lo, max(t) + 1 + 0.25e0 + 2 AS hi FROM H WHERE stroke = 'forehand' GROUP BY 1),
DT AS (SELECT H.session_id, H.t, ROW_NUMBER() OVER (PARTITION BY H.session_id ORDER BY t, shot_id) AS j FROM H JOIN SP ON SP.session_id = H.session_id AND t BETWEEN lo AND hi WHERE stroke = 'backhand'),
LB AS (SELECT session_id, t - 0.25e0 AS lo, t + 1 + 0.25e0 AS hi, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, shot_id) AS i FROM H WHERE stroke = 'forehand'),
ST AS (SELECT session_id, 0 AS i, 0::BIGINT AS used, 0 AS met FROM LB WHERE i = 1
 UNION ALL SELECT session_id, i, COALESCE(j, used), CASE WHEN j IS NULL THEN 0 ELSE 1 END FROM (SELECT k.session_id, b.i, k.used, min(d.j) AS j FROM ST k JOIN LB b ON b.session_id = k.session_id AND b.i = k.i + 1 LEFT JOIN DT d ON d.session_id = k.session_id AND d.j > k.used AND d.t >= b.lo AND d.t <= b.hi GROUP BY 1, 2, 3)),
MT AS (SELECT session_id, sum(met)::BIGINT AS matched FROM ST GROUP BY 1), ND AS (SELECT session_id, count(*) AS detections FROM DT GROUP BY 1)
SELECT session_id, labels, COALESCE(detections, 0)::BIGINT AS detections, matched, round_even(matched / labels, 6) AS recall, round_even(CASE WHEN detections > 0 THEN matched / detections ELSE 0 END, 6) AS precision FROM SP JOIN MT USING (session_id) LEFT JOIN ND USING (session_id)""")
def hits_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that holds detections (backhands) against labels (forehands, to the second)."""
    h = hits(spark, sf_dir).select("session_id", "shot_id", "t", "stroke")
    part = lambda stroke, name: h.where(F.col("stroke") == stroke).select("session_id", F.col("shot_id").alias(name), "t")
    out = api.evaluate_hits(part("forehand", "label_id"), part("backhand", "found_id"), "session_id", resolution=1.0)
    return out.withColumns({"recall": half_even(F.col("recall"), 6), "precision": half_even(F.col("precision"), 6)})
