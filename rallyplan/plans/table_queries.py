"""Lookups, sets, writes as plans, strings, documents, arrays, over the relational tables and the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyplan.functions import text as X
from rallyplan.operators import relational as R
from rallyplan.operators.robust import half_even, vector_agg
from rallyplan.plans.base import query, table
from rallyplan.plans.insight_queries import METRICS_SQL, metrics
from rallyplan.sources.tracking import HITS_SQL, hits, shots

# --- order and top-k ------------------------------------------------------------------------------


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def latest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order (job) of each customer (session): one aggregate, no sort."""
    return R.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_orderstatus"]).select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest of each group."""
    return R.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").alias("k"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def newest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty (a top-k report): each task keeps fifty rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("SELECT o_orderpriority, min(o_orderkey) AS next_job FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def next_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First in, first out, in every queue."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("next_job"))


@query(f"""WITH {HITS_SQL}, CN AS (SELECT player_id, stroke, count(*) AS n FROM H WHERE stroke <> 'overhead' GROUP BY 1, 2), RK AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id ORDER BY n DESC, stroke) AS k FROM CN) SELECT player_id, stroke, n, k FROM RK WHERE k <= 3""")
def favourite_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent strokes of each player."""
    n = hits(spark, sf_dir).where("stroke <> 'overhead'").groupBy("player_id", "stroke").agg(F.count("*").alias("n"))
    return R.top_k(n, ["player_id"], [F.desc("n"), F.asc("stroke")], 3).select("player_id", "stroke", "n", F.col("rank").alias("k"))


@query("SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:6], ',') AS first_six, count(*) AS n FROM orders GROUP BY 1")
def first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six of a list, and how many there are."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    counts = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    six = R.top_k(o, ["o_custkey"], [F.asc("o_orderkey")], 6).groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))  # six at most
    return six.join(counts, "o_custkey").select("o_custkey", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("first_six"), "n")


@query(f"WITH {HITS_SQL} SELECT shot_id, recovery_m, ROW_NUMBER() OVER (ORDER BY recovery_m DESC, shot_id) AS place FROM H WHERE recovery_m > 2.5 ORDER BY recovery_m DESC, shot_id LIMIT 200")
def stranded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 worst recoveries (a top-k report), with their place."""
    worst = hits(spark, sf_dir).where("recovery_m > 2.5").select("shot_id", "recovery_m").orderBy(F.desc("recovery_m"), "shot_id").limit(200)
    return worst.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recovery_m"), "shot_id")).cast("long"))  # 200 rows


@query("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_orderkey) AS k FROM orders")
def order_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order within a session by date, unknown dates last, then id."""
    date = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(date.asc_nulls_last(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("k"))


# --- joins ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def inner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inner equi-joins."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n, max(o_orderdate) AS last_seen FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left equi-join with the right side counted first."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_seen"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "last_seen")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics (lines) of some sessions' shots (orders)."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(urgent, "l_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles (customers) that no session (order) uses."""
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(used, "c_custkey", "left_anti")


@query("""WITH RECURSIVE E AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 90 <> 0 THEN c_custkey - 1 WHEN c_custkey % 180 = 0 THEN c_custkey + 7 END AS merged_into FROM customer),
T AS (SELECT id AS start, id, merged_into, CAST([] AS BIGINT[]) AS seen FROM E UNION ALL SELECT T.start, E.id, E.merged_into, list_append(T.seen, T.id) FROM T JOIN E ON E.id = T.merged_into WHERE NOT list_contains(T.seen, T.id))
SELECT start AS id, CASE WHEN l.merged_into IS NULL OR list_contains(l.seen, l.id) THEN l.id ELSE start END AS root FROM (SELECT start, arg_max({'id': id, 'merged_into': merged_into, 'seen': seen}, len(seen)) AS l FROM T GROUP BY 1)""")
def merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles to the end of their chain of merges: chains of up to 89, loops of 8, and pointers out of the table."""
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 90 != 0, k - 1).when(k % 180 == 0, k + 7).alias("merged_into"))
    return R.chase(e, "id", "merged_into")


@query(f"""WITH {HITS_SQL}, A0 AS (SELECT shot_id, session_id, t, player_id FROM H WHERE stroke = 'backhand'), B0 AS (SELECT session_id, player_id, t, shot_id AS prev FROM H) SELECT A0.shot_id, max(B0.t)::DOUBLE AS last_other FROM A0 LEFT JOIN B0 ON A0.session_id = B0.session_id AND B0.player_id <> A0.player_id AND B0.t < A0.t AND B0.t > A0.t - 6 GROUP BY 1""")
def theta_in_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pairwise predicate inside a session, by time buckets instead of a cross join."""
    from rallyplan.operators import timejoin

    h = hits(spark, sf_dir)
    a = h.where("stroke = 'backhand'").select("shot_id", "session_id", "player_id", "t", (F.col("t") - 6).alias("lo"))
    b = h.select("session_id", F.col("player_id").alias("other"), F.col("t").alias("ot"))
    found = timejoin.interval(b, a, ["session_id"], "ot", "lo", "t", 6.0).where("other <> player_id AND ot < t AND ot > lo").groupBy("shot_id").agg(F.max("ot").alias("last_other"))
    return a.select("shot_id").join(found, "shot_id", "left")


# --- sets -----------------------------------------------------------------------------------------

SOURCES_SQL = HITS_SQL + ", U3 AS (SELECT session_id, CAST(floor(t) AS BIGINT) AS sec, 'audio' AS source FROM H WHERE hit_score > 0.5 UNION ALL SELECT session_id, CAST(floor(t) AS BIGINT), 'ball' FROM H WHERE bounce_x IS NOT NULL UNION ALL SELECT session_id, CAST(floor(t) AS BIGINT), 'pose' FROM H WHERE side = 1)"


def candidates(h: DataFrame) -> DataFrame:
    """Candidate moments from three sources."""
    sec = F.floor("t").alias("sec")
    parts = [h.where(c).select("session_id", sec, F.lit(n).alias("source")) for n, c in (("audio", "hit_score > 0.5D"), ("ball", "bounce_x IS NOT NULL"), ("pose", "side = 1"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {SOURCES_SQL} SELECT session_id, source, count(*) AS n FROM U3 GROUP BY 1, 2")
def union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of all three sources, counted."""
    return candidates(hits(spark, sf_dir)).groupBy("session_id", "source").agg(F.count("*").alias("n"))


@query(f"WITH {SOURCES_SQL} SELECT session_id, sec, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM U3 GROUP BY 1, 2")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that agree on a moment."""
    return candidates(hits(spark, sf_dir)).groupBy("session_id", "sec").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


@query(f"WITH {HITS_SQL}, FS AS (SELECT session_id, stroke, min(t) AS t FROM H GROUP BY 1, 2) SELECT session_id, stroke, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY t, stroke) AS place FROM FS")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's strokes in the order in which they first come."""
    first = hits(spark, sf_dir).groupBy("session_id", "stroke").agg(F.min("t").alias("t"))
    return first.select("session_id", "stroke", F.row_number().over(Window.partitionBy("session_id").orderBy("t", "stroke")).cast("long").alias("place"))


@query("SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftover tracks (parts): in one set and not in the other."""
    parts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    few = parts.where("l_quantity < 5").select("l_partkey")
    return parts.where("l_quantity > 45").select("l_partkey").distinct().join(few, "l_partkey", "left_anti")


@query("SELECT url, min(page_id) AS page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY 1")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose path isn't there yet, one for each path."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.join(p.where("page_id % 3 = 0").select("url"), "url", "left_anti").groupBy("url").agg(F.min("page_id").alias("page_id")).select("url", "page_id")


@query("SELECT DISTINCT k FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def touched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that either side touched."""
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    return a.union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_suppkey")).distinct()


# --- writes as plans ------------------------------------------------------------------------------


@query("""WITH N AS (SELECT c_custkey AS id, upper(c_name) AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 50 = 0), O AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0)
SELECT COALESCE(N.id, O.id) AS id, N.name AS name, CASE WHEN O.id IS NULL THEN 'insert' WHEN N.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM O FULL OUTER JOIN N ON O.id = N.id""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert what is new, update what is known, delete what has gone."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = c.where("id % 3 <> 0").withColumn("name", F.upper("name")).unionByName(c.where("id % 50 = 0").select((F.col("id") + 1000000).alias("id"), F.lit("new").alias("name")))
    return R.upsert(c.where("id % 5 <> 0"), new, "id").select("id", "name", "action")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after a delete that goes down to the children."""
    gone = table(spark, sf_dir, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 1 ELSE o_custkey END AS o_custkey FROM orders")
def merge_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys after profiles were merged: a left join with the map of ids."""
    ids = table(spark, sf_dir, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") - 1).alias("into"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(ids, "o_custkey", "left").select("o_orderkey", F.coalesce("into", "o_custkey").alias("o_custkey"))


@query("SELECT event_id, k, v FROM (SELECT event_id, 'k' AS k, CASE WHEN event_id % 2 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS v FROM events UNION ALL SELECT event_id, 'even', 1 FROM events WHERE event_id % 2 = 0)")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shallow merge of documents: the new one's keys win."""
    old = F.from_json("props", "map<string,long>")
    new = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit(-1).cast("long"), F.lit("even"), F.lit(1).cast("long")))
    both = F.when(new.isNull(), old).otherwise(R.merged_maps(old, new))
    return table(spark, sf_dir, "events").select("event_id", F.explode(both).alias("k", "v"))


@query(f"WITH {METRICS_SQL} SELECT name, count(*) AS n, round_even(sum(value), 6) AS total FROM M GROUP BY 1")
def metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics as a long table (entity, name, value)."""
    return metrics(shots(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"), half_even(F.sum("value"), 6).alias("total"))


@query("SELECT count(*) AS rows_only_old, count(*) AS rows_only_new FROM (SELECT * FROM supplier EXCEPT ALL SELECT * FROM supplier)")
def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Would a rewrite change the table? NaN equals NaN, null doesn't equal NaN."""
    s = table(spark, sf_dir, "supplier")
    return R.difference(s, s.orderBy(F.desc("s_suppkey")))


# --- strings and documents ------------------------------------------------------------------------

CLOCK_SQL = "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS VARCHAR) || ':' || CAST(event_id % 60 AS VARCHAR) || ':' || CAST(event_id % 59 AS VARCHAR) || '.5' WHEN event_id % 3 = 1 THEN CAST(event_id % 90 AS VARCHAR) || ':' || CAST(event_id % 60 AS VARCHAR) ELSE CAST(event_id % 1000 AS VARCHAR) || '.25' END"


@query(f"SELECT event_id, CASE len(string_split(c, ':')) WHEN 3 THEN (CAST(string_split(c, ':')[1] AS DOUBLE) * 60 + CAST(string_split(c, ':')[2] AS DOUBLE)) * 60 + CAST(string_split(c, ':')[3] AS DOUBLE) WHEN 2 THEN CAST(string_split(c, ':')[1] AS DOUBLE) * 60 + CAST(string_split(c, ':')[2] AS DOUBLE) ELSE CAST(c AS DOUBLE) END AS seconds FROM (SELECT event_id, {CLOCK_SQL} AS c FROM events)")
def parse_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock texts as seconds."""
    k = F.col("event_id")
    n = lambda m: (k % m).cast("string")
    text = F.when(k % 3 == 0, F.concat(n(5), F.lit(":"), n(60), F.lit(":"), n(59), F.lit(".5"))).when(k % 3 == 1, F.concat(n(90), F.lit(":"), n(60))).otherwise(F.concat(n(1000), F.lit(".25")))
    return table(spark, sf_dir, "events").select("event_id", X.clock_seconds(text).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN round_even(((event_id % 60) + 1) * 1000 / 1001.0::DOUBLE, 6) ELSE CAST(event_id % 60 + 1 AS DOUBLE) END AS rate FROM events")
def parse_rational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame rates out of rationals; 0/0 and junk are unknown."""
    k = F.col("event_id")
    n = (k % 60 + 1).cast("string")
    text = F.when(k % 4 == 0, "0/0").when(k % 4 == 1, F.concat(((k % 60 + 1) * 1000).cast("string"), F.lit("/1001"))).when(k % 4 == 2, n).otherwise("n/a")
    return table(spark, sf_dir, "events").select("event_id", half_even(X.rational(text), 6).alias("rate"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 2 THEN 0 ELSE 7 END + event_id % 5 AS INT) AS a, CAST(CASE WHEN event_id % 3 = 2 THEN 0 ELSE 6 END + event_id % 4 AS INT) AS b FROM events")
def parse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games out of score texts; parts that aren't numbers are skipped."""
    k = F.col("event_id")
    text = F.concat(F.when(k % 3 == 0, "7-6 ").when(k % 3 == 1, "x-y 7-6 ").otherwise("ret "), (k % 5).cast("string"), F.lit("-"), (k % 4).cast("string"), F.lit(", 30-15"))
    return table(spark, sf_dir, "events").select("event_id", X.games(text, 0).alias("a"), X.games(text, 1).alias("b"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN epoch_us(date_trunc('second', ts)) // 1000000 ELSE epoch_us(date_trunc('second', ts)) // 1000000 - 7200 END AS epoch FROM events")
def parse_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO times, naive ones in UTC; the year 1970 is a camera without a clock."""
    k = F.col("event_id")
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k % 3 == 0, "1970-01-01T00:00:00Z").when(k % 3 == 1, F.concat(iso, F.lit("Z"))).otherwise(F.concat(iso, F.lit("+02:00")))
    return table(spark, sf_dir, "events").select("event_id", F.unix_seconds(X.iso_time(text)).alias("epoch"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^\\.+', '') AS name, upper(substr(regexp_replace(url, '[^A-Za-z0-9]', '', 'g'), 1, 2)) AS initials FROM pages")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names and initials."""
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"), X.initials(F.col("url")).alias("initials"))


@query("""SELECT event_id, substr(sha256('{"fps":' || CAST(event_id % 60 AS VARCHAR) || ',"kind":"' || event_type || '"}'), 1, 16) AS hash FROM events""")
def config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings section's hash; the order in which its keys are given doesn't matter."""
    return table(spark, sf_dir, "events").select("event_id", X.config_hash(("kind", F.col("event_type")), ("fps", F.col("event_id") % 60)).alias("hash"))


@query("SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) IS NULL THEN 'unknown' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 THEN 'no' ELSE 'yes' END AS state FROM events")
def json_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag in a document: yes, no, or not measured."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.when(k.isNull(), "unknown").when(k % 2 == 0, "no").otherwise("yes").alias("state"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CAST(event_id % 9 AS VARCHAR) || '-' || CAST(event_id % 8 AS VARCHAR) WHEN event_id % 5 >= 3 AND event_id % 6 >= 3 THEN CASE WHEN event_id % 5 = event_id % 6 THEN 'deuce' WHEN event_id % 5 > event_id % 6 THEN 'advantage server' ELSE 'advantage receiver' END
  ELSE ['0', '15', '30', '40'][least(event_id % 5, 3) + 1] || '-' || ['0', '15', '30', '40'][least(event_id % 6, 3) + 1] END AS score FROM events""")
def point_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point scores as text."""
    k = F.col("event_id")
    tie = k % 11 == 0
    return table(spark, sf_dir, "events").select("event_id", X.point_text(F.when(tie, k % 9).otherwise(k % 5), F.when(tie, k % 8).otherwise(k % 6), tie).alias("score"))


@query("SELECT event_id, CASE WHEN value >= 360 THEN format('{}:{:02d}:{:02d}', CAST(floor(value * 10) AS BIGINT) // 3600, (CAST(floor(value * 10) AS BIGINT) // 60) % 60, CAST(floor(value * 10) AS BIGINT) % 60) ELSE format('{}:{:02d}', CAST(floor(value * 10) AS BIGINT) // 60, CAST(floor(value * 10) AS BIGINT) % 60) END AS clock FROM events")
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as clock texts."""
    return table(spark, sf_dir, "events").select("event_id", X.clock_text(F.col("value") * 10).alias("clock"))


@query("SELECT event_id, COALESCE(CASE WHEN event_id % 60 < 24 THEN 'low frame rate' END, CASE WHEN event_id % 7 = 0 THEN 'variable frame rate' END, CASE WHEN event_id % 60 > 50 THEN 'high frame rate' END) AS first_warning, (CASE WHEN event_id % 60 < 24 THEN 1 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 60 > 50 THEN 1 ELSE 0 END)::INT AS warnings FROM events")
def frame_rate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings about a recording, as an array."""
    k = F.col("event_id")
    all_ = F.array_compact(F.array(F.when(k % 60 < 24, "low frame rate"), F.when(k % 7 == 0, "variable frame rate"), F.when(k % 60 > 50, "high frame rate")))
    return table(spark, sf_dir, "events").select("event_id", F.get(all_, 0).alias("first_warning"), F.size(all_).alias("warnings"))


@query("SELECT l_orderkey, count(*) AS n, round_even(sum(l_quantity * CASE l_linestatus WHEN 'O' THEN 0.3 ELSE 1.0 END) / sum(l_quantity), 6) AS progress FROM lineitem GROUP BY 1")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of a job as a sum of weighted stages."""
    done = F.col("l_quantity") * F.when(F.col("l_linestatus") == "O", 0.3).otherwise(1.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), half_even(F.sum(done) / F.sum("l_quantity"), 6).alias("progress"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def serialised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as nested documents and back."""
    c = table(spark, sf_dir, "conversations")
    doc = c.select(F.to_json(F.struct("conv_id", "turn", F.struct("role", F.length("text").cast("long").alias("n")).alias("said"))).alias("j"))
    kind = f"conv_id {c.schema['conv_id'].dataType.simpleString()}, turn {c.schema['turn'].dataType.simpleString()}, said struct<role:string,n:long>"
    return doc.select(F.from_json("j", kind).alias("x")).select("x.conv_id", "x.turn", "x.said.role", "x.said.n")


# --- arrays and vectors ---------------------------------------------------------------------------


@query("SELECT label, i - 1 AS pos, round_even(median(embedding[i]), 6) AS v FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1, 2")
def vector_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise median of each group's vectors."""
    v = vector_agg(table(spark, sf_dir, "embeddings"), ["label"], "embedding", half_even(F.median(F.col("x").cast("double")), 6), "v")
    return v.select("label", F.posexplode("v").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), "v")


@query("SELECT label, i - 1 AS pos, round_even(sum(embedding[i]::DOUBLE * (vec_id % 5 + 1)) / sum(vec_id % 5 + 1), 5) AS v FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1, 2")
def vector_wmean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise weighted mean of each group's vectors."""
    w = (F.col("vec_id") % 5 + 1).cast("double")
    v = vector_agg(table(spark, sf_dir, "embeddings"), ["label"], "embedding", half_even(F.sum(F.col("x").cast("double") * w) / F.sum(w), 5), "v")
    return v.select("label", F.posexplode("v").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), "v")


@query(f"""WITH {HITS_SQL} SELECT shot_id, CASE WHEN hit_score >= 0.3 THEN CAST(round_even(hit_x, 0) AS INT) END AS x, CASE WHEN hit_score >= 0.3 THEN CAST(round_even(hit_y, 0) AS INT) END AS y FROM H WHERE t >= 10 AND t < 40""")
def track_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a time slice [10, 40) with unsure positions masked and the others rounded."""
    h = hits(spark, sf_dir).where((F.col("t") >= 10) & (F.col("t") < 40))
    points = F.transform(F.array("hit_x", "hit_y"), lambda v: F.when(F.col("hit_score") >= 0.3, F.rint(v).cast("int")))
    return h.select("shot_id", points[0].alias("x"), points[1].alias("y"))


@query(f"""WITH {HITS_SQL} SELECT session_id, k AS keypoint, round_even(avg(CASE WHEN (shot_id * (k + 3)) % 101 >= 30 THEN hit_x + k END), 6) AS x FROM H, generate_series(0, 2) g(k) WHERE pose_t(t) GROUP BY 1, 2""".replace(" WHERE pose_t(t)", ""))
def seen_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean place of each keypoint over the samples in which it was seen surely enough."""
    k = F.sequence(F.lit(0), F.lit(2))
    pose = F.transform(k, lambda i: F.struct((F.col("hit_x") + i).alias("x"), ((F.col("shot_id") * (i + 3)) % 101 >= 30).alias("seen")))
    flat = hits(spark, sf_dir).select("session_id", F.posexplode(pose).alias("keypoint", "p"))
    return flat.groupBy("session_id", F.col("keypoint").cast("long").alias("keypoint")).agg(half_even(F.avg(F.when(F.col("p.seen"), F.col("p.x"))), 6).alias("x"))


@query("SELECT user_id, event_type, max(event_id) AS label FROM events GROUP BY 1, 2")
def track_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested map (video -> track -> label) built and flattened again."""
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("label")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "label"))).alias("m"))
    return m.select("user_id", F.explode("m").alias("event_type", "label"))


