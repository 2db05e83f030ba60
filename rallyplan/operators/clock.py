"""One clock for the videos of a session: lags between sound envelopes, and offsets out of lags.

``pair_lags`` compares the envelopes of each two videos of a session: ``gathered`` brings
the sound of a session into one row (of one with over BLOCK videos: of each two blocks),
so an envelope isn't copied for every pair that it is in, and ``lags_within`` compares
within rows; sound that comes by session goes there without a shuffle. ``place`` grows each session's
clock by rounds, all sessions at once: the first video (by time of recording, unknown
last, then id) is at 0; each next one hangs on the video placed before it to which its
lag is clearest, or, without a clear lag, on its time of recording, or else follows the
end of what is placed. Rounds are as many as a session has videos at most.

Defined results: a session with one video has it at 0; videos without an envelope, or of
another rate, have no lag; the clock starts with its earliest video; offsets are rounded
to four digits; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyplan.functions.signals import Recording, lag
from rallyplan.operators.robust import half_even
from rallyplan.session import checkpointed


def ordered(videos: DataFrame) -> DataFrame:
    """id, session_id, place (from 0, in order of recording), recorded_s, duration_s. videos: id, session_id, recorded_s, duration_s."""
    w = Window.partitionBy("session_id").orderBy(F.col("recorded_s").asc_nulls_last(), "id")
    return videos.select("id", "session_id", F.col("recorded_s").cast("double").alias("recorded_s"), F.col("duration_s").cast("double").alias("duration_s")).withColumn("place", F.row_number().over(w) - 1)


#: Fixed value: videos of a session that are compared in one row (of two blocks, if there are more).
BLOCK = 4
#: Columns of what was heard in the videos of a row, arrays in one order.
SOUND = ("ids", "places", "rates", "starts", "envelopes")


def gathered(videos: DataFrame, envelopes: DataFrame) -> DataFrame:
    """session_id, first, last (blocks) and ids, places, rates, starts, envelopes of their videos: a row for each two blocks of a session's videos.

    envelopes: video_id, rate, start_s (of the sound on the video's clock), envelope.
    """
    block = F.floor(F.col("place") / BLOCK)
    last = F.max(block).over(Window.partitionBy("session_id"))
    known = ordered(videos).select("session_id", "id", "place", block.alias("block"), last.alias("blocks"))
    v = envelopes.where("envelope IS NOT NULL").join(known.hint("shuffle_hash"), F.col("id") == F.col("video_id"))  # without a sort of envelopes
    sound = F.struct("id", "place", "rate", F.coalesce(F.col("start_s").cast("double"), F.lit(0.0)).alias("start_s"), F.col("envelope").cast("array<float>").alias("envelope"))
    both = v.select("session_id", sound.alias("sound"), "block", F.explode(F.sequence(F.lit(0), F.col("blocks"))).alias("other"))
    keyed = both.select("session_id", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("last"), "sound")
    rows = keyed.groupBy("session_id", "first", "last").agg(F.collect_list("sound").alias("s"))
    return rows.select("session_id", "first", "last", *(F.col(f"s.{c}").alias(n) for c, n in zip(("id", "place", "rate", "start_s", "envelope"), SOUND, strict=True)))


def lags_within(sessions: DataFrame, most: float | None = None) -> DataFrame:
    """session_id, earlier, later (ids), lag_s, confidence for each two videos in one row, the earlier of block ``first``, the later of ``last``.

    sessions: session_id, first, last, ids, places, rates, starts, envelopes (``gathered``).
    """

    def told(first: int, last: int, ids: list, places: list, rates: list, starts: list, envelopes: pa.Array) -> Iterator[tuple]:
        heard = [Recording(x.values.to_numpy(zero_copy_only=False), r) for x, r in zip(envelopes, rates, strict=True)]
        known = [k for k, r in enumerate(rates) if r is not None and r > 0]
        for i, j in product(known, known):
            if places[i] < places[j] and (places[i] // BLOCK, places[j] // BLOCK) == (first, last) and abs(rates[i] - rates[j]) <= 1e-6:
                by, sure = lag(heard[i], heard[j], most)
                yield ids[i], ids[j], by + (starts[i] - starts[j]), sure if sure > 0 else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            session, *narrow, envelopes = batch.columns
            rows = zip(*(c.to_pylist() for c in narrow), (x.values for x in envelopes), strict=True)
            found = [[*x, k] for k, row in enumerate(rows) for x in told(*row)]
            earlier, later, by, sure, at = zip(*found, strict=True) if found else [()] * 5
            id_type = narrow[2].type.value_type
            columns = [session.take(pa.array(at, pa.int32())), pa.array(earlier, id_type), pa.array(later, id_type), pa.array(by, pa.float64()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["session_id", "earlier", "later", "lag_s", "confidence"])

    rows = sessions.select("session_id", "first", "last", *SOUND)
    kind = rows.schema["ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(run, f"session_id {dict(rows.dtypes)['session_id']}, earlier {kind}, later {kind}, lag_s double, confidence double")


def pair_lags(videos: DataFrame, envelopes: DataFrame, most: float | None = None) -> DataFrame:
    """session_id, earlier, later (ids), lag_s (to add to the later one's times), confidence (0: not clear), for each two videos of a session.

    envelopes: video_id, rate, start_s (of the sound on the video's clock), envelope.
    """
    return lags_within(gathered(videos, envelopes), most)


def place(videos: DataFrame, lags: DataFrame, least: float = 1.6) -> DataFrame:
    """id, session_id, offset_s, sync_method (single, creation_time or audio), hangs_on (the video that an audio lag ties it to)."""
    own = checkpointed(ordered(videos))
    rounds = (own.agg(F.max("place")).first()[0] or 0) + 1
    start = own.groupBy("session_id").agg(F.min("recorded_s").alias("first_s"))
    clear = lags.where(F.col("confidence") >= least).select("earlier", F.col("later").alias("id"), "lag_s", "confidence")
    placed = own.where("place = 0").select("id", "session_id", "place", "duration_s", F.lit(0.0).alias("offset_s"), F.lit("creation_time").alias("sync_method"), F.lit(None).cast(dict(own.dtypes)["id"]).alias("hangs_on"))
    for k in range(1, rounds):
        now = own.where(F.col("place") == k)
        tied = clear.join(now.select("id"), "id").join(placed.select(F.col("id").alias("earlier"), F.col("offset_s").alias("base_s"), "place"), "earlier")
        best = tied.groupBy("id").agg(F.max_by(F.struct(F.col("earlier").alias("hangs_on"), (F.col("base_s") + F.col("lag_s")).alias("by_sound")), F.struct("confidence", -F.col("place"))).alias("x")).select("id", "x.*")
        ends = placed.groupBy("session_id").agg(F.max(F.col("offset_s") + F.coalesce("duration_s", F.lit(0.0))).alias("end_s"))
        now = now.join(best, "id", "left").join(ends, "session_id").join(start, "session_id")
        by_clock = F.coalesce(F.col("recorded_s") - F.col("first_s"), F.greatest("end_s", F.lit(0.0)))
        method = F.when(F.col("by_sound").isNotNull(), "audio").otherwise("creation_time")
        placed = checkpointed(placed.unionByName(now.select("id", "session_id", "place", "duration_s", F.coalesce("by_sound", by_clock).alias("offset_s"), method.alias("sync_method"), "hangs_on")))
    zero = placed.groupBy("session_id").agg(F.min("offset_s").alias("zero_s"), F.count("*").alias("n"))
    method = F.when(F.col("n") == 1, "single").otherwise(F.col("sync_method"))
    return placed.join(zero, "session_id").select("id", "session_id", half_even(F.col("offset_s") - F.col("zero_s"), 4).alias("offset_s"), method.alias("sync_method"), "hangs_on")


def one_clock(videos: DataFrame, envelopes: DataFrame) -> DataFrame:
    """The videos with offset_s and sync_method as their sound and times of recording tell them."""
    return by_lags(videos, pair_lags(videos, envelopes))


def by_lags(videos: DataFrame, lags: DataFrame) -> DataFrame:
    """The videos with offset_s and sync_method as these lags and their times of recording tell them."""
    found = place(videos, checkpointed(lags)).select("id", "offset_s", "sync_method")
    return videos.drop("offset_s", "sync_method").join(found, "id")
