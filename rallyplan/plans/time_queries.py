"""Joins by time, windows over time, and robust statistics of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyplan.operators import gaps, timejoin
from rallyplan.operators.robust import half_even, majority, nearest_rank
from rallyplan.plans.base import query
from rallyplan.sources.tracking import HITS_SQL, RALLIES_SQL, SHOTS_SQL, hits, rallies, shots

CLICKS_SQL = HITS_SQL + ", C AS (SELECT shot_id, session_id, t FROM H WHERE stroke = 'backhand'), F AS (SELECT session_id, t, shot_id AS fore FROM H WHERE stroke = 'forehand')"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = hits(spark, sf_dir)
    return h.where("stroke = 'backhand'").select("shot_id", "session_id", "t"), h.where("stroke = 'forehand'").select("session_id", "t", F.col("shot_id").alias("fore"))


@query(f"WITH {CLICKS_SQL} SELECT C.shot_id, F.fore FROM C ASOF LEFT JOIN F ON C.session_id = F.session_id AND C.t >= F.t")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last forehand at or before each backhand."""
    a, b = _sides(spark, sf_dir)
    return timejoin.asof(a, b, ["session_id"], "t", ["fore"], tie="fore").select("shot_id", "fore")


@query(f"WITH {CLICKS_SQL}, LAST AS (SELECT session_id, arg_max(fore, t) AS fore FROM F GROUP BY 1) SELECT C.shot_id, COALESCE(F.fore, LAST.fore) AS fore FROM C ASOF LEFT JOIN F ON C.session_id = F.session_id AND C.t <= F.t LEFT JOIN LAST ON LAST.session_id = C.session_id")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forehand at or after each backhand; beyond the last one, the last one."""
    a, b = _sides(spark, sf_dir)
    last = b.groupBy("session_id").agg(F.max_by("fore", "t").alias("last"))
    return timejoin.asof(a, b, ["session_id"], "t", ["fore"], forward=True, tie="fore").join(last, "session_id", "left").select("shot_id", F.coalesce("fore", "last").alias("fore"))


@query(f"""WITH {CLICKS_SQL}, N AS (SELECT C.shot_id, F.fore, ROW_NUMBER() OVER (PARTITION BY C.shot_id ORDER BY abs(F.t - C.t), F.t, F.fore) AS k FROM C JOIN F ON C.session_id = F.session_id AND F.t BETWEEN C.t - 2.5 AND C.t + 2.5)
SELECT shot_id, fore FROM N WHERE k = 1""")
def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest forehand within 2.5 s of each backhand; ties go to the earlier."""
    a, b = _sides(spark, sf_dir)
    return timejoin.nearest(a, b, ["session_id"], "t", ["fore"], 2.5, "shot_id").select("shot_id", "fore")


@query(f"""WITH {CLICKS_SQL}, N AS (SELECT C.shot_id, F.t AS ft, F.fore, C.t AS ct FROM C JOIN F ON C.session_id = F.session_id)
SELECT shot_id, arg_min(fore, {{'d': abs(ft - ct), 't': ft}}) AS fore FROM N GROUP BY 1""")
def nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest forehand at any distance: the nearer of the as-of neighbours on both sides, ties to the earlier."""
    a, b = _sides(spark, sf_dir)
    back = timejoin.asof(a, b, ["session_id"], "t", ["fore"], tie="fore").withColumnsRenamed({"r_time": "bt", "fore": "bf"})
    both = timejoin.asof(back, b, ["session_id"], "t", ["fore"], forward=True, tie="fore")
    nearer = F.col("bt").isNotNull() & (F.col("r_time").isNull() | (F.col("t") - F.col("bt") <= F.col("r_time") - F.col("t")))
    return both.select("shot_id", F.when(nearer, F.col("bf")).otherwise(F.col("fore")).alias("fore")).where(F.col("fore").isNotNull())


@query(f"WITH {HITS_SQL} SELECT a.shot_id, count(*) AS n, round_even(avg(b.hit_score), 6) AS mean FROM H a JOIN H b ON a.session_id = b.session_id AND a.side = b.side AND b.t >= a.t - 0.7 AND b.t <= a.t + 0.35 GROUP BY 1 HAVING count(*) >= 2")
def swing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same track around each hit, ends included, at least two."""
    h = hits(spark, sf_dir).select("shot_id", "session_id", "side", "t", "hit_score")
    spans = h.select("shot_id", "session_id", "side", (F.col("t") - 0.7).alias("lo"), (F.col("t") + 0.35).alias("hi"))
    near = timejoin.interval(h.drop("shot_id"), spans, ["session_id", "side"], "t", "lo", "hi", 2.0)
    return near.groupBy("shot_id").agg(F.count("*").alias("n"), half_even(F.avg("hit_score"), 6).alias("mean")).where("n >= 2")


@query(f"""WITH {SHOTS_SQL}, FL AS (SELECT shot_id, session_id, t + 0.02 AS lo, least(COALESCE(LEAD(t) OVER (PARTITION BY session_id ORDER BY t, shot_id) - 0.03, t + 2.2), t + 2.2) AS hi FROM S)
SELECT FL.shot_id, count(*) AS n FROM FL JOIN (SELECT session_id, t - 1.0 AS t FROM H) B ON FL.session_id = B.session_id AND B.t > FL.lo AND B.t < FL.hi GROUP BY 1""")
def flight_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ball sightings (hit times less 1 s stand in for them) strictly between a hit and the next."""
    s = shots(spark, sf_dir)
    nxt = F.lead("t").over(gaps.ordered(["session_id"], ["t", "shot_id"])) - 0.03
    flights = s.select("shot_id", "session_id", (F.col("t") + 0.02).alias("lo"), F.least(F.coalesce(nxt, F.col("t") + 2.2), F.col("t") + 2.2).alias("hi")).where("lo < hi")
    ball = s.select("session_id", (F.col("t") - 1.0).alias("bt"))
    pairs = timejoin.interval(ball, flights, ["session_id"], "bt", "lo", "hi", 2.0)
    return pairs.where("bt > lo AND bt < hi").groupBy("shot_id").agg(F.count("*").alias("n"))


@query(f"WITH {RALLIES_SQL} SELECT H.shot_id, min(R.rally)::BIGINT AS rally FROM H JOIN R ON H.session_id = R.session_id AND H.t + 1 BETWEEN R.start_s - 1.5 AND R.end_s + 2 GROUP BY 1")
def rally_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rally that is being played one second after each hit, with room on either side."""
    r = rallies(shots(spark, sf_dir)).select("session_id", "rally", (F.col("start_s") - 1.5).alias("lo"), (F.col("end_s") + 2).alias("hi"))
    h = hits(spark, sf_dir).select("shot_id", "session_id", (F.col("t") + 1).alias("at"))
    return timejoin.interval(h, r, ["session_id"], "at", "lo", "hi", 10.0).groupBy("shot_id").agg(F.min("rally").cast("long").alias("rally"))


@query(f"WITH {RALLIES_SQL} SELECT a.session_id, a.rally::BIGINT AS rally, b.rally::BIGINT AS other FROM R a JOIN R b ON a.session_id = b.session_id AND a.rally < b.rally AND a.end_s >= b.start_s AND a.start_s <= b.end_s")
def overlapping_rallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rallies whose padded times overlap."""
    r = rallies(shots(spark, sf_dir)).select("session_id", F.col("rally").cast("long").alias("rally"), "start_s", "end_s")
    o = r.select("session_id", F.col("rally").alias("other"), F.col("start_s").alias("s2"), F.col("end_s").alias("e2"))
    return timejoin.overlap(r, o, ["session_id"], 10.0, "start_s", "end_s", "s2", "e2").where("rally < other").select("session_id", "rally", "other")


@query(f"""WITH {RALLIES_SQL}, O AS (SELECT session_id, start_s, end_s, max(end_s) OVER (PARTITION BY session_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM R), I AS (SELECT *, sum(CASE WHEN seen IS NULL OR start_s > seen + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM O)
SELECT session_id, round_even(min(start_s), 6) AS start_s, round_even(max(end_s), 6) AS end_s, count(*) AS n FROM I GROUP BY session_id, g""")
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rallies joined where less than a second lies between them."""
    m = gaps.merge_intervals(rallies(shots(spark, sf_dir)).select("session_id", "start_s", "end_s"), ["session_id"], "start_s", "end_s", 1.0)
    return m.select("session_id", half_even(F.col("start_s"), 6).alias("start_s"), half_even(F.col("end_s"), 6).alias("end_s"), "n")


@query(f"""WITH {HITS_SQL}, A AS (SELECT session_id, side, CAST(floor(t) AS BIGINT) AS sec FROM H) SELECT a.session_id, a.stroke AS one, b.stroke AS other, count(*) AS seconds FROM (SELECT DISTINCT session_id, stroke, CAST(floor(t) AS BIGINT) AS sec FROM H) a JOIN (SELECT DISTINCT session_id, stroke, CAST(floor(t) AS BIGINT) AS sec FROM H) b ON a.session_id = b.session_id AND a.sec = b.sec AND a.stroke < b.stroke GROUP BY 1, 2, 3""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in which each pair of tracks (strokes stand in) was seen in the same frame: the few tracks of a frame are paired where they meet."""
    frame = hits(spark, sf_dir).groupBy("session_id", F.floor("t").alias("sec")).agg(F.sort_array(F.collect_set("stroke")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("one"), b.alias("other")))))
    return frame.select("session_id", F.inline(pairs)).groupBy("session_id", "one", "other").agg(F.count("*").alias("seconds"))


@query(f"""WITH {HITS_SQL}, NR AS (SELECT shot_id, session_id, t, hit_x FROM H WHERE side = -1), FR AS (SELECT session_id, t, hit_x FROM H WHERE side = 1),
BK AS (SELECT NR.*, FR.t AS bt, FR.hit_x AS bx FROM NR ASOF LEFT JOIN FR ON NR.session_id = FR.session_id AND NR.t >= FR.t), BO AS (SELECT BK.*, FR.t AS tt, FR.hit_x AS ax FROM BK ASOF LEFT JOIN FR ON BK.session_id = FR.session_id AND BK.t <= FR.t)
SELECT shot_id, round_even(CASE WHEN bt IS NULL THEN ax WHEN tt IS NULL THEN bx WHEN tt > bt THEN bx + (ax - bx) * ((t - bt) / (tt - bt)) ELSE bx END, 6) AS x FROM BO""")
def interpolate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The far player's place at each of the near player's hits, interpolated; clamped at the ends."""
    h = hits(spark, sf_dir)
    near, far = h.where("side = -1").select("shot_id", "session_id", "t"), h.where("side = 1").select("session_id", "t", F.col("hit_x").alias("x"))
    return timejoin.interpolate(near, far, ["session_id"], "t", "x").select("shot_id", half_even(F.col("x"), 6).alias("x"))


@query(f"""WITH {HITS_SQL}, K AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY hit_score, shot_id) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM H) SELECT shot_id, round_even(r / greatest(1, n - 1), 6) AS loudness FROM K""")
def percent_rank_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each onset's loudness in its video, 0 to 1, ties by order."""
    n = F.count("*").over(Window.partitionBy("session_id"))
    rank = (F.row_number().over(gaps.ordered(["session_id"], ["hit_score", "shot_id"])) - 1) / F.greatest(F.lit(1), n - 1)
    return hits(spark, sf_dir).select("shot_id", half_even(rank, 6).alias("loudness"))


def wrist_speeds(h: DataFrame) -> DataFrame:
    """Speed of each sample against the one before of its track; 0 after a gap or at low confidence."""
    w = gaps.ordered(["session_id", "side"], ["t", "shot_id"])
    dt = F.greatest(F.col("t") - F.lag("t").over(w), F.lit(1e-3))
    good = (F.col("t") - F.lag("t").over(w) < 4.0) & (F.col("hit_score") >= 0.25) & (F.lag("hit_score").over(w) >= 0.25)
    step = F.sqrt((F.col("hit_x") - F.lag("hit_x").over(w)) ** 2 + (F.col("hit_y") - F.lag("hit_y").over(w)) ** 2) / dt
    return h.withColumn("speed", F.when(good, step).otherwise(F.lit(0.0)))


WRIST_SQL = HITS_SQL + """, D AS (SELECT *, t - LAG(t) OVER w AS dt, LAG(hit_score) OVER w AS cb, hit_x - LAG(hit_x) OVER w AS dx, hit_y - LAG(hit_y) OVER w AS dy FROM H WINDOW w AS (PARTITION BY session_id, side ORDER BY t, shot_id)),
SP AS (SELECT *, CASE WHEN dt < 4 AND hit_score >= 0.25 AND cb >= 0.25 THEN sqrt(dx ** 2 + dy ** 2) / greatest(dt, 0.001) ELSE 0 END AS speed FROM D)"""


@query(f"WITH {WRIST_SQL} SELECT shot_id, round_even(speed, 6) AS speed FROM SP")
def wrist_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed by difference."""
    return wrist_speeds(hits(spark, sf_dir)).select("shot_id", half_even(F.col("speed"), 6).alias("speed"))


@query(f"WITH {WRIST_SQL}, E3 AS (SELECT shot_id, speed, COALESCE(LAG(speed) OVER w, speed) AS a, COALESCE(LEAD(speed) OVER w, speed) AS b FROM SP WINDOW w AS (PARTITION BY session_id, side ORDER BY t, shot_id)) SELECT shot_id, round_even(list_sort([a, speed, b])[2], 6) AS speed FROM E3")
def roll_median3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of three samples, the ends repeated."""
    w = gaps.ordered(["session_id", "side"], ["t", "shot_id"])
    s = F.col("speed")
    three = F.sort_array(F.array(F.coalesce(F.lag(s).over(w), s), s, F.coalesce(F.lead(s).over(w), s)))
    return wrist_speeds(hits(spark, sf_dir)).select("shot_id", half_even(F.element_at(three, 2), 6).alias("speed"))


@query(f"""WITH {WRIST_SQL}, PQ AS (SELECT session_id, side, quantile_cont(speed, 0.97) AS strong FROM SP GROUP BY 1, 2), PK AS (SELECT SP.*, LAG(speed) OVER w AS a, LEAD(speed) OVER w AS b FROM SP WINDOW w AS (PARTITION BY session_id, side ORDER BY t, shot_id))
SELECT PK.shot_id FROM PK JOIN PQ USING (session_id, side) WHERE speed >= a AND speed >= b AND speed > 0.6 * strong + 1e-9""")
def local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples no slower than both neighbours and faster than 0.6 of the track's 97th percentile."""
    w = gaps.ordered(["session_id", "side"], ["t", "shot_id"])
    s = wrist_speeds(hits(spark, sf_dir)).withColumns({"a": F.lag("speed").over(w), "b": F.lead("speed").over(w), "strong": F.expr("percentile(speed, 0.97) OVER (PARTITION BY session_id, side)")})
    return s.where("speed >= a AND speed >= b AND speed > 0.6D * strong + 1e-9D").select("shot_id")


@query(f"""WITH {HITS_SQL}, T3 AS (SELECT shot_id, t, hit_x, hit_y, LAG(hit_x, 3) OVER w AS ax, LAG(hit_y, 3) OVER w AS ay, LEAD(hit_x, 3) OVER w AS bx, LEAD(hit_y, 3) OVER w AS yb FROM H WINDOW w AS (PARTITION BY session_id ORDER BY t, shot_id)),
V3 AS (SELECT shot_id, hit_x - ax AS ux, hit_y - ay AS uy, bx - hit_x AS vx, yb - hit_y AS vy FROM T3) SELECT shot_id, round_even((1 - (ux * vx + uy * vy) / (sqrt(ux ** 2 + uy ** 2) * sqrt(vx ** 2 + vy ** 2))) / 2, 6) AS turn FROM V3 WHERE sqrt(ux ** 2 + uy ** 2) >= 4 AND sqrt(vx ** 2 + vy ** 2) >= 4""")
def turn_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sharply the path turns, from three samples before to three after: 0 straight, 1 back."""
    w = gaps.ordered(["session_id"], ["t", "shot_id"])
    x, y = F.col("hit_x"), F.col("hit_y")
    v = hits(spark, sf_dir).select("shot_id", (x - F.lag(x, 3).over(w)).alias("ux"), (y - F.lag(y, 3).over(w)).alias("uy"), (F.lead(x, 3).over(w) - x).alias("vx"), (F.lead(y, 3).over(w) - y).alias("vy"))
    nu, nv = F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2), F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2)
    return v.where((nu >= 4) & (nv >= 4)).select("shot_id", half_even((1 - (F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")) / (nu * nv)) / 2, 6).alias("turn"))


@query(f"WITH {HITS_SQL} SELECT shot_id, max(hit_score) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN 1.5 PRECEDING AND 1.0 FOLLOWING) AS peak, arg_max(shot_id, {{'s': hit_score, 't': -t, 'i': -shot_id}}) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN 1.5 PRECEDING AND 1.0 FOLLOWING) AS peak_id FROM H")
def range_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sample from 1.5 s before each hit to 1 s after."""
    best = F.expr("max(struct(hit_score AS s, -t AS t, -shot_id AS i)) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN 1.5D PRECEDING AND 1.0D FOLLOWING)")
    return hits(spark, sf_dir).withColumn("b", best).select("shot_id", F.col("b.s").alias("peak"), (-F.col("b.i")).alias("peak_id"))


@query(f"""WITH {HITS_SQL}, GR AS (SELECT session_id, unnest(generate_series(0, CAST(floor(mt / 5) AS BIGINT))) * 5 AS c FROM (SELECT session_id, max(t) AS mt FROM H GROUP BY 1)), WN AS (SELECT GR.session_id, c, hit_score AS v FROM GR JOIN H ON H.session_id = GR.session_id AND H.t >= c - 10 AND H.t <= c + 10), MD AS (SELECT session_id, c, median(v) AS med FROM WN GROUP BY 1, 2)
SELECT WN.session_id, WN.c::BIGINT AS c, round_even(any_value(med), 6) AS med, round_even(median(abs(v - med)), 6) AS mad FROM WN JOIN MD USING (session_id, c) GROUP BY 1, 2""")
def robust_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and median absolute deviation in a window around every point of a coarse grid."""
    h = hits(spark, sf_dir).select("session_id", "t", F.col("hit_score").alias("v"))
    grid = h.groupBy("session_id").agg(F.max("t").alias("mt")).select("session_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col("mt") / 5)), lambda k: k * 5)).alias("c"))
    spans = grid.select("session_id", "c", (F.col("c") - 10.0).alias("lo"), (F.col("c") + 10.0).alias("hi"))
    near = timejoin.interval(h, spans, ["session_id"], "t", "lo", "hi", 20.0)
    return near.groupBy("session_id", "c").agg(F.median("v").alias("med"), F.collect_list("v").alias("vs")).select(
        "session_id", "c", half_even(F.col("med"), 6).alias("med"), half_even(_median_of(F.transform("vs", lambda v: F.abs(v - F.col("med")))), 6).alias("mad")
    )


def _median_of(values: Column) -> Column:
    s = F.sort_array(values)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


@query(f"""WITH {HITS_SQL}, GP AS (SELECT session_id, t - LAG(t) OVER (PARTITION BY session_id ORDER BY t, shot_id) AS d FROM H), LS AS (SELECT session_id, list_sort(list(d)) AS v, count(*) AS n FROM GP WHERE d IS NOT NULL GROUP BY 1)
SELECT session_id, round_even(v[CAST(round_even((n - 1) * 0.01::DOUBLE, 0) AS BIGINT) + 1], 6) AS p01, round_even(v[CAST(round_even((n - 1) * 0.5::DOUBLE, 0) AS BIGINT) + 1], 6) AS p50, round_even(v[CAST(round_even((n - 1) * 0.99::DOUBLE, 0) AS BIGINT) + 1], 6) AS p99 FROM LS""")
def frame_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the time between frames, by nearest rank."""
    d = F.col("t") - F.lag("t").over(gaps.ordered(["session_id"], ["t", "shot_id"]))
    g = hits(spark, sf_dir).select("session_id", d.alias("d")).where("d IS NOT NULL").groupBy("session_id")
    return g.agg(*[half_even(nearest_rank("d", q), 6).alias(n) for n, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))])


@query(f"""WITH {HITS_SQL}, GP AS (SELECT session_id, t - LAG(t) OVER (PARTITION BY session_id ORDER BY t, shot_id) AS d FROM H), LS AS (SELECT session_id, list_sort(list(d)) AS v, count(*) AS n, avg(d) AS m FROM GP WHERE d IS NOT NULL GROUP BY 1)
SELECT session_id, abs(m / v[CAST(round_even((n - 1) * 0.5::DOUBLE, 0) AS BIGINT) + 1] - 1) > 0.01 OR (v[CAST(round_even((n - 1) * 0.99::DOUBLE, 0) AS BIGINT) + 1] - v[CAST(round_even((n - 1) * 0.01::DOUBLE, 0) AS BIGINT) + 1]) / v[CAST(round_even((n - 1) * 0.5::DOUBLE, 0) AS BIGINT) + 1] > 0.5 AS vfr FROM LS""")
def vfr_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the frame rate variable: nominal and average rate differ, or intervals spread?"""
    d = F.col("t") - F.lag("t").over(gaps.ordered(["session_id"], ["t", "shot_id"]))
    g = hits(spark, sf_dir).select("session_id", d.alias("d")).where("d IS NOT NULL").groupBy("session_id").agg(F.avg("d").alias("m"), *[nearest_rank("d", q).alias(n) for n, q in (("a", 0.01), ("b", 0.5), ("c", 0.99))])
    return g.select("session_id", ((F.abs(F.col("m") / F.col("b") - 1) > 0.01) | ((F.col("c") - F.col("a")) / F.col("b") > 0.5)).alias("vfr"))


@query(f"""WITH {HITS_SQL}, FX AS (SELECT session_id, t, shot_id, bounce_x AS v FROM H), NB AS (SELECT *, count(v) OVER (PARTITION BY session_id ORDER BY t, shot_id ROWS UNBOUNDED PRECEDING) AS g FROM FX),
AG AS (SELECT session_id, g, min(t) FILTER (v IS NOT NULL) AS bt, any_value(v) AS bv, count(*) - count(v) AS miss FROM NB GROUP BY 1, 2)
SELECT NB.shot_id, round_even(CASE WHEN NB.v IS NOT NULL THEN NB.v WHEN a.bt IS NOT NULL AND b.bt IS NOT NULL AND a.miss <= 1 THEN a.bv + (b.bv - a.bv) * ((NB.t - a.bt) / (b.bt - a.bt)) END, 6) AS x
FROM NB LEFT JOIN AG a ON NB.session_id = a.session_id AND NB.g = a.g LEFT JOIN AG b ON NB.session_id = b.session_id AND NB.g + 1 = b.g""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single missing bounces filled by interpolation over time; longer gaps and ends stay missing."""
    f = gaps.fill_gaps(hits(spark, sf_dir).select("session_id", "shot_id", "t", F.col("bounce_x").alias("v")), ["session_id"], "t", "v", 1)
    return f.select("shot_id", half_even(F.col("filled"), 6).alias("x"))


@query(f"WITH {HITS_SQL} SELECT shot_id, CASE WHEN count(*) FILTER (stroke = 'serve') OVER w >= 3 THEN round_even(avg(hit_x) OVER w, 6) END AS x FROM H WINDOW w AS (PARTITION BY player_id)")
def supported_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player's mean place, if at least three serves were seen."""
    w = Window.partitionBy("player_id")
    n = F.count_if(F.col("stroke") == "serve").over(w)
    return hits(spark, sf_dir).select("shot_id", F.when(n >= 3, half_even(F.avg("hit_x").over(w), 6)).alias("x"))


@query(f"WITH {HITS_SQL} SELECT session_id, CASE WHEN count(*) >= 3 AND greatest(count(*) FILTER (hit_x > 0), count(*) FILTER (hit_x <= 0)) >= 0.65 * count(*) THEN CASE WHEN count(*) FILTER (hit_x > 0) * 2 > count(*) THEN 'right' ELSE 'left' END END AS hand FROM H WHERE stroke = 'serve' GROUP BY 1")
def hand_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The racket hand by votes of serves: three at least, 65 % of them alike."""
    right, n = F.count_if(F.col("hit_x") > 0), F.count("*")
    sure = (n >= 3) & (F.greatest(right, n - right) >= 0.65 * n)
    return hits(spark, sf_dir).where("stroke = 'serve'").groupBy("session_id").agg(F.when(sure, F.when(right * 2 > n, "right").otherwise("left")).alias("hand"))


@query(f"WITH {HITS_SQL}, VT AS (SELECT player_id, stroke, count(*) AS n FROM H GROUP BY 1, 2) SELECT player_id, arg_max(stroke, {{'n': n, 's': -ascii(stroke) * 1000 - ascii(stroke[2])}}) AS stroke, max(n) AS votes FROM VT GROUP BY 1")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's most frequent stroke; ties go to the first in the alphabet."""
    return majority(hits(spark, sf_dir), ["player_id"], "stroke").select("player_id", "stroke", "votes")
