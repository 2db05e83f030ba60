"""What a user asks of stored sessions: every read of the application, as a DataFrame.

A library is a folder with one Parquet table for each relational contract of
``rallyplan.schema``, and one for each columnar one with a column video_id. Tables that
are committed together (``sources.versions``) are read from their store, in the version
that was the newest when the library was opened, so that all reads fit each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan import schema
from rallyplan.functions.text import clock_seconds, games
from rallyplan.operators import relational, sequence, timejoin
from rallyplan.sources import files
from rallyplan.sources.versions import Store


class Library:
    def __init__(self, spark: SparkSession, root: str, store: Store | None = None):
        self.spark, self.root, self.store = spark, root, store
        self.version = store.version() if store else 0
        self.stored = set(store.manifest(self.version)["tables"]) if store else set()

    def _table(self, name: str) -> DataFrame:
        kind = getattr(schema, name.upper())
        if name in self.stored:
            return files.fitted(self.store.read(name, self.version), kind)
        return files.contract(self.spark, f"{self.root}/{name}", kind)

    def _columnar(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def sessions(self) -> DataFrame:
        """Sessions, newest first, each with its latest job; one plan for all of them."""
        job = relational.latest(self._table("job"), ["session_id"], "id", ["status", "progress"]).select(F.col("session_id").alias("id"), F.col("status").alias("job_status"), "progress")
        return self._table("session").join(job, "id", "left").orderBy(F.coalesce("recorded_at", "created_at").desc(), F.desc("id"))

    def shots(self, session_id: int) -> DataFrame:
        """A session's shots in order, with outcome and metrics as a map."""
        s = self._table("shot").where(F.col("session_id") == session_id)
        m = self._table("shot_metric").join(s.select(F.col("id").alias("shot_id")), "shot_id", "left_semi").groupBy("shot_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics"))
        return s.join(m.withColumnRenamed("shot_id", "id"), "id", "left").withColumn("outcome", F.coalesce("outcome", _outcome())).orderBy("t", "id")

    def rallies(self, session_id: int) -> DataFrame:
        return self._table("rally").where(F.col("session_id") == session_id).orderBy("index")

    def player(self, player_id: int) -> DataFrame:
        """The profile that a player was merged into, with its sessions in order of date."""
        root = relational.chase(self._table("player"), "id", "merged_into").where(F.col("id") == player_id).select(F.col("root").alias("player_id"))
        s = self._table("session").select(F.col("id").alias("session_id"), "kind", F.coalesce("recorded_at", "created_at").alias("at"))
        return self._table("session_player").join(root, "player_id", "left_semi").join(s, "session_id").orderBy("at", "session_id")

    def players(self) -> DataFrame:
        """Profiles that weren't merged away, with shots by stroke and when they were last seen."""
        by = self._table("shot").groupBy("player_id", "stroke").agg(F.count("*").alias("n"), F.max("session_id").alias("last")).groupBy("player_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stroke", "n")))).alias("strokes"), F.sum("n").alias("shots"), F.max("last").alias("last_session"))
        return self._table("player").where("merged_into IS NULL").join(by.withColumnRenamed("player_id", "id"), "id", "left").fillna(0, ["shots"]).orderBy("id")

    def tracks(self, video_id: int, start: float, end: float) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ball, poses and feet of a time slice, rounded; unsure keypoints are null."""
        part = lambda name: files.time_slice(self._columnar(name).where(F.col("video_id") == video_id), start, end)
        whole = lambda c: F.when(~F.isnan(c), F.rint(c).cast("int"))
        sure = lambda c: F.transform(F.arrays_zip(F.col(c).alias("v"), F.col("kp_c").alias("c")), lambda z: F.when(z["c"] >= 0.3, whole(z["v"])))
        metres = lambda c: F.when(~F.isnan(c), F.bround(F.col(c).cast("double"), 2))
        ball = part("ball").select("t", whole(F.col("x")).alias("x"), whole(F.col("y")).alias("y"), "track").orderBy("t", "track")
        pose = part("motion").select("t", "track", sure("kp_x").alias("kp_x"), sure("kp_y").alias("kp_y")).orderBy("t", "track")
        feet = part("people").select("t", "track_id", whole(F.col("foot_px")).alias("foot_px"), whole(F.col("foot_py")).alias("foot_py"), metres("court_x").alias("court_x"), metres("court_y").alias("court_y")).orderBy("t", "track_id")
        return ball, pose, feet


def _outcome() -> Column:
    return F.when(~F.col("crosses_net"), "net").when(F.col("in_court"), "in").when(~F.col("in_court"), "out")


def match_labels(labels: DataFrame, found: DataFrame, by: str, offset: float = 0.0, resolution: float = 0.0, tolerance: float = 0.25) -> DataFrame:
    """(by, label_id, found_id): labels (by, label_id, t) one to one with detections (by, found_id, t) in their windows, in order of time."""
    import pandas as pd

    both = labels.select(by, F.col("label_id").alias("id"), "t", F.lit(True).alias("label")).unionByName(found.select(by, F.col("found_id").alias("id"), "t", F.lit(False).alias("label")))

    def f(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows.label], rows[~rows.label]
        pairs = sequence.greedy_match(a.t.to_numpy() + offset - tolerance, a.t.to_numpy() + offset + resolution + tolerance, b.t.to_numpy())
        return pd.DataFrame([(rows[by].iloc[0], a.id.iloc[i], b.id.iloc[j]) for i, j in pairs], columns=[by, "label_id", "found_id"])

    return sequence.per_group(both, [by], ["t", "id"], f, f"{by} long, label_id long, found_id long")


def evaluate_hits(labels: DataFrame, found: DataFrame, by: str, offset: float = 0.0, resolution: float = 0.0, tolerance: float = 0.25) -> DataFrame:
    """labels, detections (inside the labelled span, 2 s around), matched, recall, precision by group."""
    span = labels.groupBy(by).agg(F.count("*").alias("labels"), (F.min("t") + offset - tolerance - 2).alias("lo"), (F.max("t") + offset + resolution + tolerance + 2).alias("hi"))
    inside = found.join(span, by).where("t BETWEEN lo AND hi").select(by, "found_id", "t")
    n = inside.groupBy(by).agg(F.count("*").alias("detections"))
    met = match_labels(labels, inside, by, offset, resolution, tolerance).groupBy(by).agg(F.count("*").alias("matched"))
    out = span.select(by, "labels").join(n, by, "left").join(met, by, "left").fillna(0, ["detections", "matched"])
    share = lambda c: F.when(F.col(c) > 0, F.col("matched") / F.col(c)).otherwise(0.0)
    return out.withColumns({"recall": share("labels"), "precision": share("detections")})


def evaluate_games(points: DataFrame, checkpoints: DataFrame, final: DataFrame, by: str) -> DataFrame:
    """Games off at checkpoints (by, t, self, other): the score text before the first point (by, t, score) from then on, else final (by, final)."""
    shown = timejoin.asof(checkpoints, points, [by], "t", ["score"], forward=True).join(final, by, "left")
    text = F.coalesce("score", F.when(F.col("final") != "", F.col("final")))
    n = shown.select(by, "self", "other", games(text, 0).alias("a"), games(text, 1).alias("b"))
    off = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col("self")) + F.abs(F.col(y) - F.col("other")), F.col("self") + F.col("other"))
    hit = lambda x, y: F.count_if((F.col(x) == F.col("self")) & (F.col(y) == F.col("other")))
    e = n.groupBy(by).agg(F.count("*").alias("checkpoints"), F.sum(off("a", "b")).alias("e1"), F.sum(off("b", "a")).alias("e2"), hit("a", "b").alias("x1"), hit("b", "a").alias("x2"))
    first = F.col("e1") <= F.col("e2")
    return e.select(by, "checkpoints", F.when(first, F.col("x1")).otherwise(F.col("x2")).alias("exact"), (F.least("e1", "e2") / F.col("checkpoints")).alias("error_games"), first.alias("self_first"))


def label_times(df: DataFrame, offset: float = 0.0) -> DataFrame:
    """Clock texts in ``t`` as seconds of the video."""
    return df.withColumn("t", clock_seconds(F.col("t").cast("string")) + offset)
