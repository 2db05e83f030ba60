"""Onsets of made-up sound that comes in chunks of uneven length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.operators import onsets as O
from rallyplan.plans.base import query, table

HOP = 40
#: A hum with a burst every 487 samples, in SQL that both engines take.
SAMPLE = "((i * 37 + video_id * 11) % 101 - 50) / 1000e0 + CASE WHEN i % 487 < 20 THEN ((i * 13) % 29 - 14) / 10e0 * (1 + floor(i / 487) % 5) ELSE 0e0 END"


def made_up_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound of a video for each user, 3,000 samples and more, cut into chunks whose length follows from the user."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    cut = users.withColumns({"n": 3000 + (F.col("video_id") % 7) * 111, "size": 60 + (F.col("video_id") * 29) % 500})
    c = cut.select("video_id", "n", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.col("size")))).alias("k"))
    c = c.withColumns({"start": F.col("k") * F.col("size"), "stop": F.least((F.col("k") + 1) * F.col("size"), F.col("n"))})
    return c.select("video_id", "start", F.expr(f"transform(sequence(start, stop - 1), i -> {SAMPLE})").alias("samples"))


@query(f"""WITH N AS (SELECT DISTINCT user_id AS video_id, 3000 + (user_id % 7) * 111 AS n FROM events), X AS (SELECT video_id, i, {SAMPLE} AS x FROM N, (SELECT unnest(range(0, 3700)) AS i) WHERE i < n),
D AS (SELECT video_id, i, COALESCE(x - LAG(x) OVER (PARTITION BY video_id ORDER BY i), 0e0) AS d FROM X),
LV AS (SELECT video_id, i // {HOP} AS frame, round_even(10 * log10(greatest(sum(d * d) / count(*), 1e-12)), 6) AS level_db FROM D GROUP BY 1, 2),
ST AS (SELECT video_id, frame, round_even(greatest(level_db - COALESCE(LAG(level_db) OVER (PARTITION BY video_id ORDER BY frame), level_db), 0e0), 6) AS s FROM LV),
AR AS (SELECT *, list(s) OVER (w ROWS BETWEEN {O.HALF} PRECEDING AND {O.HALF} FOLLOWING) AS around, max(s) OVER (w ROWS BETWEEN {O.APART} PRECEDING AND 1 PRECEDING) AS earlier, max(s) OVER (w ROWS BETWEEN 1 FOLLOWING AND {O.APART} FOLLOWING) AS later FROM ST WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
MD AS (SELECT *, list_median(around) AS m FROM AR),
TH AS (SELECT *, m + {O.K} * greatest(list_median(list_transform(around, lambda v: abs(v - m))), {O.LEAST_MAD}) AS threshold FROM MD)
SELECT video_id, frame, s AS strength, round_even(threshold, 6) AS threshold FROM TH WHERE s > COALESCE(earlier, -1) AND s >= COALESCE(later, -1) AND s > threshold""")
def chunked_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets of every video, out of chunks; the SQL sees the sound whole."""
    return O.onsets(O.levels(made_up_chunks(spark, sf_dir), HOP))
