"""Pictures as array columns: backgrounds and looks of made-up pixels; tables laid out by slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.operators import pictures
from rallyplan.operators.robust import half_even
from rallyplan.plans.base import query, table
from rallyplan.plans.stage_queries import scratch
from rallyplan.sources import sinks
from rallyplan.sources.tracking import HITS_SQL, hits

PIXEL = {c: f"(k * {a} + shot_id * {b}) % {m}" for c, a, b, m in (("b", 37, 11, 256), ("g", 53, 7, 251), ("r", 29, 3, 241))}


@query("""SELECT label, i - 1 AS at, CAST(floor(median(CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 800) AS INT) % 256)) AS INT) AS value FROM embeddings, generate_series(1, 64) g(i) WHERE label IS NOT NULL GROUP BY 1, 2""")
def median_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of every pixel over the frames of a video (vectors stand in for frames, labels for videos)."""
    frames = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("label", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 800).cast("int") % 256).alias("pixels"))
    found = pictures.background(frames, ["label"], "pixels")
    return found.select("label", F.posexplode("background").alias("at", "value")).select("label", F.col("at").cast("long").alias("at"), "value")


@query(f"""WITH {HITS_SQL}, P AS (SELECT shot_id, {", ".join(f"CAST({e} AS INT) AS {c}" for c, e in PIXEL.items())} FROM H, (SELECT unnest(range(0, 24)) AS k) WHERE k < shot_id % 25),
V AS (SELECT *, greatest(b, g, r) AS top, CAST(greatest(b, g, r) - least(b, g, r) AS DOUBLE) AS span FROM P),
W AS (SELECT *, CASE WHEN span = 0 THEN 0e0 WHEN top = r THEN 30 * (g - b) / span WHEN top = g THEN 60 + 30 * (b - r) / span ELSE 120 + 30 * (r - g) / span END AS h0, CASE WHEN top = 0 THEN 0 ELSE floor(255 * span / top + 0.5e0) END AS sat FROM V),
X AS (SELECT *, floor(CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END + 0.5e0) % 180 AS hue FROM W),
B AS (SELECT shot_id, CAST(CASE WHEN top < 50 THEN 48 WHEN sat < 40 THEN 49 ELSE floor(hue / 15) * 4 + floor((sat - 40) / 54) END AS BIGINT) AS bin FROM X),
N AS (SELECT shot_id, count(*) AS n FROM B GROUP BY 1 HAVING count(*) >= 4)
SELECT shot_id, bin, round_even(count(*) / n, 9) AS share FROM B JOIN N USING (shot_id) GROUP BY shot_id, bin, n""")
def clothing_looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour histograms of made-up crops, the bins that aren't empty."""
    k = F.sequence(F.lit(0), F.lit(23))
    pixels = F.transform(F.filter(k, lambda i: i < F.col("shot_id") % 25), lambda i: F.struct(*[((i * a + F.col("shot_id") * b) % m).alias(c) for c, a, b, m in (("b", 37, 11, 256), ("g", 53, 7, 251), ("r", 29, 3, 241))]))
    found = pictures.looks(hits(spark, sf_dir).select("shot_id", pixels.alias("pixels")), "shot_id")
    return found.select("shot_id", F.posexplode("look").alias("bin", "share")).where("share > 0").select("shot_id", F.col("bin").cast("long").alias("bin"), half_even(F.col("share"), 9).alias("share"))


@query(f"WITH {HITS_SQL} SELECT session_id, shot_id, t, hit_x, hit_y FROM H WHERE session_id % 3 = 1 AND t >= 12.5e0 AND t < 37.25e0")
def sliced_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretch of some videos out of a table that is laid out by slice of ten seconds (and video, if there are few): only the folders of those slices are opened."""
    path = scratch(spark, "slices")
    sinks.write_slices(hits(spark, sf_dir).select("session_id", "shot_id", "t", "hit_x", "hit_y"), path, "session_id")
    return sinks.read_slices(spark, path, F.col("session_id") % 3 == 1, 12.5, 37.25).select(F.col("session_id").cast("long").alias("session_id"), "shot_id", "t", "hit_x", "hit_y")
