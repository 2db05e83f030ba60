"""The smaller reads: jobs, formats, boxes, trails, groups of tracks, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyplan.functions import geometry as G
from rallyplan.functions import text as X
from rallyplan.operators import gaps, relational, timejoin
from rallyplan.operators.robust import half_even, least_support
from rallyplan.plans.base import query, table
from rallyplan.sources.tracking import HITS_SQL, RALLIES_SQL, SHOTS_SQL, hits, rallies, shots

# --- jobs -----------------------------------------------------------------------------------------


@query("SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued and running jobs of each session."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).groupBy("o_custkey").agg(F.count("*").alias("active"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus IN ('O', 'P'))")
def enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that get a new job: those without an active one, so asking twice makes one job."""
    busy = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(busy, "c_custkey", "left_anti")


# --- shots ----------------------------------------------------------------------------------------


@query(f"WITH {HITS_SQL} SELECT shot_id, bounce_x, bounce_y FROM H WHERE bounce_x IS NOT NULL AND stroke = 'serve'")
def bounces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where serves landed, as far as it is known."""
    return hits(spark, sf_dir).where("bounce_x IS NOT NULL AND stroke = 'serve'").select("shot_id", "bounce_x", "bounce_y")


@query(f"WITH {SHOTS_SQL} SELECT session_id, 'depth' AS what, depth AS value, count(*) AS n FROM S WHERE depth <> '' GROUP BY 1, 3 UNION ALL SELECT session_id, 'direction', direction, count(*) FROM S WHERE direction <> '' GROUP BY 1, 3 UNION ALL SELECT session_id, 'stroke', stroke, count(*) FROM S GROUP BY 1, 3")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by depth, direction and stroke in one pass; missing depths and directions don't count."""
    s = shots(spark, sf_dir).select("session_id", "depth", "direction", "stroke").unpivot(["session_id"], ["depth", "direction", "stroke"], "what", "value")
    return s.where("value IS NOT NULL AND value <> ''").groupBy("session_id", "what", "value").agg(F.count("*").alias("n"))


@query(f"WITH {RALLIES_SQL} SELECT session_id, sum(shot_count)::BIGINT AS shots, count(*) AS rallies, max(shot_count) AS longest FROM R GROUP BY 1")
def session_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots and rallies of each session."""
    return rallies(shots(spark, sf_dir)).groupBy("session_id").agg(F.sum("shot_count").alias("shots"), F.count("*").alias("rallies"), F.max("shot_count").alias("longest"))


@query(f"WITH {RALLIES_SQL} SELECT session_id, rally::BIGINT AS rally, first_player_id, last_player_id, first_stroke, last_stroke FROM R")
def rally_ends_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last shot of every rally."""
    return rallies(shots(spark, sf_dir)).select("session_id", F.col("rally").cast("long").alias("rally"), "first_player_id", "last_player_id", "first_stroke", "last_stroke")


@query(f"""WITH {HITS_SQL}, SD AS (SELECT session_id, shot_id, t, stroke, CASE WHEN bounce_y IS NULL THEN NULL WHEN bounce_y < 0 THEN -1 ELSE 1 END AS s FROM H), BR AS (SELECT *, t - LAG(t) OVER w AS gap, LAG(s) OVER w AS b FROM SD WINDOW w AS (PARTITION BY session_id ORDER BY t, shot_id))
SELECT shot_id, (sum(CASE WHEN gap IS NULL OR stroke = 'serve' OR NOT (gap <= 3 OR (gap <= 5 AND s IS NOT NULL AND s IS NOT DISTINCT FROM b)) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t, shot_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS rally FROM BR""")
def resegmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rallies on one clock with sides from positions: an unknown position is no side, exactly 0 the far one."""
    h = hits(spark, sf_dir).withColumn("s", F.when(F.col("bounce_y") < 0, -1).when(F.col("bounce_y").isNotNull(), 1))
    return gaps.sessionize(h, ["session_id"], "t", "shot_id", "s", F.col("stroke") == "serve").select("shot_id", F.col("rally").cast("long").alias("rally"))


@query(f"""WITH {HITS_SQL} SELECT shot_id, (sum(CASE WHEN dt IS NULL OR dt > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, side ORDER BY t, shot_id ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS segment FROM (SELECT *, t - LAG(t) OVER (PARTITION BY session_id, side ORDER BY t, shot_id) AS dt FROM H)""")
def trail_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails of a track, broken where it wasn't seen for a while."""
    w = gaps.ordered(["session_id", "side"], ["t", "shot_id"])
    h = hits(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(w))
    return gaps.number_groups(h, ["session_id", "side"], ["t", "shot_id"], F.col("dt").isNull() | (F.col("dt") > 4), "segment").select("shot_id", F.col("segment").cast("long").alias("segment"))


@query(f"""WITH {HITS_SQL}, RG AS (SELECT shot_id, hit_x - first_value(hit_x) OVER a AS ux, hit_y - first_value(hit_y) OVER a AS uy, last_value(hit_x) OVER b - hit_x AS vx, last_value(hit_y) OVER b - hit_y AS vy FROM H WINDOW a AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING))
SELECT shot_id, round_even((1 - (ux * vx + uy * vy) / (sqrt(ux ** 2 + uy ** 2) * sqrt(vx ** 2 + vy ** 2))) / 2, 6) AS turn FROM RG WHERE sqrt(ux ** 2 + uy ** 2) >= 3 AND sqrt(vx ** 2 + vy ** 2) >= 3""")
def turn_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sharply the path turns between what lies 4 s before and after, by range frames."""
    edge = lambda f, c, frame: F.expr(f"{f}({c}) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN {frame})")
    before, after = "4D PRECEDING AND CURRENT ROW", "CURRENT ROW AND 4D FOLLOWING"
    d = hits(spark, sf_dir).select(
        "shot_id", (F.col("hit_x") - edge("first", "hit_x", before)).alias("ux"), (F.col("hit_y") - edge("first", "hit_y", before)).alias("uy"), (edge("last", "hit_x", after) - F.col("hit_x")).alias("vx"), (edge("last", "hit_y", after) - F.col("hit_y")).alias("vy")
    )
    nu, nv = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2), F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    return d.where((nu >= 3) & (nv >= 3)).select("shot_id", half_even((1 - (F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")) / (nu * nv)) / 2, 6).alias("turn"))


# --- boxes and tracks -----------------------------------------------------------------------------


@query(f"""WITH {HITS_SQL}, A1 AS (SELECT shot_id, session_id, t FROM H WHERE side = -1), B1 AS (SELECT session_id, t, hit_x, shot_id AS o FROM H WHERE side = 1), PV AS (SELECT A1.*, B1.t AS bt, B1.hit_x AS bx FROM A1 ASOF LEFT JOIN B1 ON A1.session_id = B1.session_id AND A1.t >= B1.t), PN AS (SELECT PV.*, B1.t AS nt, B1.hit_x AS nx FROM PV ASOF LEFT JOIN B1 ON PV.session_id = B1.session_id AND PV.t <= B1.t)
SELECT shot_id, round_even(CASE WHEN nt > bt THEN bx + (nx - bx) * ((t - bt) / (nt - bt)) ELSE bx END, 6) AS x FROM PN WHERE bt IS NOT NULL AND nt IS NOT NULL AND (t - bt <= 3 OR nt - t <= 3)""")
def interpolated_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track's box between its sightings, if one of them is near enough."""
    h = hits(spark, sf_dir)
    a, b = h.where("side = -1").select("shot_id", "session_id", "t"), h.where("side = 1").select("session_id", "t", F.col("hit_x").alias("x"))
    p = timejoin.asof(a, b, ["session_id"], "t", ["x"]).withColumnsRenamed({"r_time": "bt", "x": "bx"})
    n = timejoin.asof(p, b, ["session_id"], "t", ["x"], forward=True).withColumnsRenamed({"r_time": "nt", "x": "nx"})
    near = n.where("bt IS NOT NULL AND nt IS NOT NULL AND (t - bt <= 3 OR nt - t <= 3)")
    x = F.when(F.col("nt") > F.col("bt"), F.col("bx") + (F.col("nx") - F.col("bx")) * ((F.col("t") - F.col("bt")) / (F.col("nt") - F.col("bt")))).otherwise(F.col("bx"))
    return near.select("shot_id", half_even(x, 6).alias("x"))


@query(f"""WITH {HITS_SQL}, FB AS (SELECT shot_id, session_id, CAST(floor(t / 20) AS BIGINT) AS f, side, hit_x, hit_y FROM H) SELECT shot_id FROM FB a WHERE side = -1 OR NOT EXISTS (SELECT 1 FROM FB b WHERE b.session_id = a.session_id AND b.f = a.f AND b.side = -1
  AND greatest(0, least(a.hit_x, b.hit_x) + 4 - greatest(a.hit_x, b.hit_x)) * greatest(0, least(a.hit_y, b.hit_y) + 8 - greatest(a.hit_y, b.hit_y)) / (64 - greatest(0, least(a.hit_x, b.hit_x) + 4 - greatest(a.hit_x, b.hit_x)) * greatest(0, least(a.hit_y, b.hit_y) + 8 - greatest(a.hit_y, b.hit_y))) >= 0.4)""")
def deduplicated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of the close-up that the whole picture doesn't have already: overlap below 0.4 in the same frame."""
    h = hits(spark, sf_dir).select("shot_id", "session_id", F.floor(F.col("t") / 20).alias("f"), "side", F.array(F.col("hit_x"), F.col("hit_y"), F.col("hit_x") + 4, F.col("hit_y") + 8).alias("box"))
    whole, close = h.where("side = -1"), h.where("side = 1")
    of = lambda c: tuple(F.col(c)[i] for i in range(4))
    same = close.join(whole.select("session_id", "f", F.col("box").alias("other")), ["session_id", "f"]).where(G.iou(of("box"), of("other")) >= 0.4).select("shot_id")
    return whole.select("shot_id").unionByName(close.join(same, "shot_id", "left_anti").select("shot_id"))


@query(f"WITH {HITS_SQL} SELECT player_id, arg_max(shot_id, {{'a': hit_score * contact_height_m, 'i': -shot_id}}) AS shot_id FROM H WHERE hit_score >= 0.5 GROUP BY 1")
def largest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's largest sure box, for a picture."""
    return hits(spark, sf_dir).where("hit_score >= 0.5D").groupBy("player_id").agg(F.max_by("shot_id", F.struct(F.col("hit_score") * F.col("contact_height_m"), -F.col("shot_id"))).alias("shot_id"))


@query(f"WITH {HITS_SQL} SELECT shot_id, k FROM (SELECT shot_id, ROW_NUMBER() OVER (PARTITION BY session_id, floor(t / 10) ORDER BY hit_score DESC, shot_id) AS k FROM H) WHERE k <= 4")
def frame_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four largest people of a frame (10 s stand in), with their rank."""
    f = hits(spark, sf_dir).withColumn("f", F.floor(F.col("t") / 10))
    return relational.top_k(f, ["session_id", "f"], [F.desc("hit_score"), F.asc("shot_id")], 4).select("shot_id", F.col("rank").alias("k"))


@query(f"""WITH {HITS_SQL}, GS AS (SELECT session_id, stroke, count(*) FILTER (hit_score > 0.5) AS hits, max(t) - min(t) AS seconds, min(t) AS first_t FROM H GROUP BY 1, 2), TG AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY hits DESC, seconds DESC) AS k FROM GS)
SELECT session_id, stroke, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY first_t) AS label FROM TG WHERE k <= 4""")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four groups with most hits, then time, labelled by who is seen first."""
    g = hits(spark, sf_dir).groupBy("session_id", "stroke").agg(F.count_if(F.col("hit_score") > 0.5).alias("hits"), (F.max("t") - F.min("t")).alias("seconds"), F.min("t").alias("first_t"))
    four = relational.top_k(g, ["session_id"], [F.desc("hits"), F.desc("seconds")], 4)
    return four.select("session_id", "stroke", F.row_number().over(Window.partitionBy("session_id").orderBy("first_t")).cast("long").alias("label"))


@query(f"WITH {HITS_SQL} SELECT session_id, side, arg_min(shot_id, {{'d': abs(t - 50), 't': t}}) AS shot_id FROM H WHERE t BETWEEN 45 AND 55 GROUP BY 1, 2")
def nearest_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's pose nearest to a moment, within a tolerance."""
    return hits(spark, sf_dir).where("t BETWEEN 45 AND 55").groupBy("session_id", "side").agg(F.min_by("shot_id", F.struct(F.abs(F.col("t") - 50), F.col("t"))).alias("shot_id"))


@query(f"WITH {HITS_SQL} SELECT session_id, side, count(*) AS samples FROM H GROUP BY 1, 2 HAVING count(*) >= 5 AND max(t) - min(t) >= 1")
def long_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with enough samples over enough time."""
    g = hits(spark, sf_dir).groupBy("session_id", "side").agg(F.count("*").alias("samples"), (F.max("t") - F.min("t")).alias("s"))
    return g.where("samples >= 5 AND s >= 1").select("session_id", "side", "samples")


# --- signatures -----------------------------------------------------------------------------------


@query(f"WITH {HITS_SQL} SELECT player_id, CASE WHEN count(bounce_x) >= 10 THEN round_even(median(abs(bounce_x) / (abs(hit_y) + 1)), 4) END AS forearm, CASE WHEN count(bounce_x) >= 10 THEN round_even(median(abs(bounce_y) / (abs(hit_y) + 1)), 4) END AS thigh FROM H WHERE bounce_x IS NOT NULL GROUP BY 1")
def limb_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median lengths against the torso's, from ten samples on."""
    torso = F.abs("hit_y") + 1
    p = hits(spark, sf_dir).where("bounce_x IS NOT NULL").select("player_id", (F.abs("bounce_x") / torso).alias("a"), (F.abs("bounce_y") / torso).alias("b"))
    return p.groupBy("player_id").agg(least_support(10, "a", half_even(F.median("a"), 4)).alias("forearm"), least_support(10, "b", half_even(F.median("b"), 4)).alias("thigh"))


@query("""WITH HN AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 'left' ELSE 'right' END AS hand, count(*) AS n FROM embeddings GROUP BY 1, 2) SELECT E.label, any_value(HM.hand) AS hand, round_even(median(1.6::DOUBLE + 0.01::DOUBLE * (vec_id % 40)), 3) AS height_m, round_even(arg_max(embedding[1], vec_id), 5) AS look0 FROM embeddings E JOIN (SELECT label, arg_max(hand, {'n': n, 'h': hand = 'left'}) AS hand FROM HN GROUP BY 1) HM ON E.label = HM.label GROUP BY 1""")
def profile_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile's signature: most frequent hand, median height, latest look."""
    k = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("hand", F.when(k % 3 == 0, "left").otherwise("right"))
    left = F.count_if(F.col("hand") == "left")
    return e.groupBy("label").agg(F.when(left * 2 >= F.count("*"), "left").otherwise("right").alias("hand"), half_even(F.median(1.6 + 0.01 * (k % 40)), 3).alias("height_m"), half_even(F.max_by("embedding", "vec_id")[0], 5).alias("look0"))


@query(f"WITH {HITS_SQL}, PN AS (SELECT player_id, stroke, count(*) AS n FROM H GROUP BY 1, 2), PT AS (SELECT player_id, max(session_id) AS last_session, count(*) AS shots FROM H GROUP BY 1) SELECT PT.player_id, last_session, shots, stroke, n FROM PT JOIN PN USING (player_id)")
def players_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player's shots by stroke, all in one grouped plan."""
    n = hits(spark, sf_dir).groupBy("player_id", "stroke").agg(F.count("*").alias("n"), F.max("session_id").alias("s"))
    w = Window.partitionBy("player_id")
    return n.select("player_id", F.max("s").over(w).alias("last_session"), F.sum("n").over(w).alias("shots"), "stroke", "n")


@query(f"WITH {HITS_SQL} SELECT shot_id, CASE WHEN side < 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS plain_x, round_even(dx / sqrt(dx ** 2 + dy ** 2), 6) AS x, round_even(dy / sqrt(dx ** 2 + dy ** 2), 6) AS y FROM (SELECT shot_id, side, (60 * (hit_x - side * 0.5::DOUBLE) + 12 * hit_y + 960) / (0.002::DOUBLE * (hit_x - side * 0.5::DOUBLE) + 0.015::DOUBLE * hit_y + 1) - (60 * hit_x + 12 * hit_y + 960) / (0.002::DOUBLE * hit_x + 0.015::DOUBLE * hit_y + 1) AS dx, (3 * (hit_x - side * 0.5::DOUBLE) - 40 * hit_y + 540) / (0.002::DOUBLE * (hit_x - side * 0.5::DOUBLE) + 0.015::DOUBLE * hit_y + 1) - (3 * hit_x - 40 * hit_y + 540) / (0.002::DOUBLE * hit_x + 0.015::DOUBLE * hit_y + 1) AS dy FROM H)")
def right_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture's direction to a hitter's right, as they face the net."""
    from rallyplan.plans.geometry_queries import COURT_TO_PICTURE

    ax, ay = G.homography(COURT_TO_PICTURE, F.col("hit_x"), F.col("hit_y"))
    bx, by = G.homography(COURT_TO_PICTURE, F.col("hit_x") - F.col("side") * 0.5, F.col("hit_y"))
    n = F.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
    return hits(spark, sf_dir).select("shot_id", F.when(F.col("side") < 0, 1.0).otherwise(-1.0).alias("plain_x"), half_even((bx - ax) / n, 6).alias("x"), half_even((by - ay) / n, 6).alias("y"))


# --- texts and arrays -----------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id < 1000 THEN CAST(event_id AS VARCHAR) || ' B' WHEN event_id < 1000000 THEN format('{:.1f} kB', event_id / 1000.0) ELSE format('{:.1f} MB', event_id / 1000000.0) END AS size, CASE WHEN value >= 60 THEN format('{} h {} min', CAST(floor(value) AS BIGINT) // 60, CAST(floor(value) AS BIGINT) % 60) ELSE format('{} min', CAST(floor(value) AS BIGINT)) END AS duration FROM events")
def format_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and durations as text."""
    return table(spark, sf_dir, "events").select("event_id", X.size_text(F.col("event_id")).alias("size"), X.duration_text(F.col("value")).alias("duration"))


@query("SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') AS stem, regexp_extract(url, '[^.]*$') AS ext, starts_with(url, 'https') AS secure FROM pages WHERE contains(url, '.')")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names cut at their last dot, and a prefix test."""
    u = F.col("url")
    ext = F.substring_index(u, ".", -1)
    return table(spark, sf_dir, "pages").where("contains(url, '.')").select("page_id", F.substring(u, F.lit(1), F.length(u) - F.length(ext) - 1).alias("stem"), ext.alias("ext"), u.startswith("https").alias("secure"))


@query("SELECT event_id, CAST(event_id * 100 AS BIGINT) AS pts, round_even(event_id / 25.0::DOUBLE, 4) AS pts_time FROM events")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame times out of a decoder's log lines."""
    line = F.format_string("[info] n:%5d pts:%7d pts_time:%s duration: 1", F.col("event_id"), F.col("event_id") * 100, (F.col("event_id") / 25.0).cast("string"))
    part = lambda p: F.regexp_extract(F.col("line"), p, 1)
    return table(spark, sf_dir, "events").select("event_id", line.alias("line")).select("event_id", part(r"pts:\s*(\d+)").cast("long").alias("pts"), half_even(part(r"pts_time:([0-9.E]+)").cast("double"), 4).alias("pts_time"))


@query(f"WITH {HITS_SQL} SELECT shot_id, k::INT AS keypoint, CASE WHEN (shot_id * (k + 3)) % 101 >= 30 THEN hit_x + k END AS x, hit_y - k AS y FROM H, generate_series(0, 2) g(k)")
def zipped_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays as one array of points, unsure ones masked."""
    k = F.sequence(F.lit(0), F.lit(2))
    xs, ys = F.transform(k, lambda i: F.col("hit_x") + i), F.transform(k, lambda i: F.col("hit_y") - i)
    cs = F.transform(k, lambda i: (F.col("shot_id") * (i + 3)) % 101)
    p = hits(spark, sf_dir).select("shot_id", F.posexplode(F.arrays_zip(xs.alias("px"), ys.alias("py"), cs.alias("pc"))).alias("keypoint", "p"))
    return p.select("shot_id", "keypoint", F.when(F.col("p.pc") >= 30, F.col("p.px")).alias("x"), F.col("p.py").alias("y"))
