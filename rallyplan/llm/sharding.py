"""Sharding by balanced label propagation (operator 4); DataFrame functions only.

Links: documents of equal text. The law is ``rows``: shard sizes in documents
differ by one at most. Every document starts with the label of its own hash. In
each round a linked unit (the documents of one text; a text with more documents
than 0.8 of a shard is dealt into units of at most about that) counts its members'
labels, less a penalty for full shards, and its members move to the best one;
of all who want into a shard, the share that its quota has room for moves. Rounds
go on until no unit is cut. Where ``PATIENCE`` rounds on end don't bring the number
of those who want to move down, cut units go as wholes into shards that have room for
them, and so do units that a shard has no quota for (``settle``); what fits nowhere stays cut. ``cut_copies`` tells for every document how many copies of its text lie in other shards.
Members that share unit and first label always move together, so the rounds join
small tables of (unit, first label, count, label), each cut into the checkpoint
folder. At the end a shard keeps its labelled documents up to its exact quota,
by whole units as far as they go, and documents without links fill what is left.

Ranks are counted by (shard, bucket): no task has to hold a shard, and the
table of bucket counts is bounded by 2 * shards * MOST_BUCKETS rows, summed by runs
of ``RUN`` buckets.

Defined results: null texts are linked with each other and have size 16 and
the crc of no bytes; rows with a null doc_id take part like others; repeated
rows each get a place of their own; ties (equal texts and keys) are in any order, their
places are the same set; a text counts by its digest, however long it is; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyplan.llm.common import FEW, cut

SHARDS = 40
#: Rounds without gain before cut units look elsewhere, and before they are left cut; units that a shard takes in such a round.
PATIENCE, ROAMING, TAKEN = 3, 4, 1000
#: Bytes that a document counts besides its text.
OVERHEAD = 16
#: Part of a shard that one unit may fill.
UNIT_SHARE = 0.8
#: Documents of one unit that a bucket takes at least.
LEAST_A_BUCKET = 16
LEAST_BUCKETS, MOST_BUCKETS, ROWS_A_BUCKET = 64, 8192, 500_000
#: Buckets whose counts are summed together.
RUN = 64


def _at(values: list, index: Column, kind: str = "long") -> Column:
    """values[index], as a literal array."""
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (index + 1).cast("int"))


def _unit01(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, size, text_crc32, g): g stands for the text."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(key).alias("k"), (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit("null").cast("binary")).alias("g"),
    )


def granted(wishes: dict[tuple[int, int], int], load: list[int], capacity: int) -> list[float]:
    """Share of the documents that want into each shard which may move, so that no quota is passed, counting those who leave."""
    shards = range(len(load))
    into = [sum(n for (_, v), n in wishes.items() if v == s) for s in shards]
    share = [1.0 if n else 0.0 for n in into]
    for _ in range(100):
        leave = [sum(n * share[v] for (u, v), n in wishes.items() if u == s) for s in shards]
        new = [min(share[s], max(0.0, capacity - load[s] + leave[s]) / into[s]) if into[s] else 0.0 for s in shards]
        if new == share:
            break
        share = new
    return share


def loads(state: DataFrame, shards: int) -> list[int]:
    """Linked documents of each shard."""
    out = [0] * shards
    for r in state.groupBy("label").agg(F.sum("n").alias("n")).collect():  # a row for each shard
        out[r.label] = r.n
    return out


def propagate(state: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Labels of the units' parts when the rounds are over. state: g, chunk, first, n, m, label."""
    least, idle, turn = float("inf"), 0, 0
    while idle <= PATIENCE:
        load = loads(state, shards)
        penalty = [1.0 - 0.5 * min(1.0, x / max(1, capacity)) for x in load]
        votes = state.groupBy("g", "chunk", "label").agg(F.sum("n").alias("n"))
        worth = F.struct((F.col("n") * _at(penalty, F.col("label"), "double")).alias("v"), F.xxhash64("g", "chunk", "label").alias("h"))
        wished = state.join(votes.groupBy("g", "chunk").agg(F.max_by("label", worth).alias("wish")), ["g", "chunk"])
        # a row for each pair of shards
        wishes = {(r.label, r.wish): r.n for r in wished.where("label <> wish").groupBy("label", "wish").agg(F.sum("n").alias("n")).collect()}
        waiting = sum(wishes.values())
        if not waiting:
            break
        least, idle = (waiting, 0) if waiting < least else (least, idle + 1)
        share = granted(wishes, load, capacity)
        goes = _unit01("g", "chunk", F.lit(turn)) < _at(share, F.col("wish"), "double")
        state = cut(wished.withColumn("label", F.when(goes, F.col("wish")).otherwise(F.col("label"))).drop("wish"))
        turn += 1
    return settle(state, shards, capacity)


def settle(state: DataFrame, shards: int, capacity: int) -> DataFrame:
    """Units that are cut, and those that a shard has no quota for, move as wholes into shards that have room for them.

    Of a shard over its quota the smallest units go that make up for the excess. Each
    unit draws one of the shards whose room holds it; of those who draw a shard the
    largest go in, as long as their sum fits (``TAKEN`` of them a round at most, so
    that no task holds more). Rounds end when all have a place, none fits anywhere, or
    ``ROAMING`` of them place nothing.
    """
    turn, idle = 0, 0
    while idle < ROAMING:
        load = loads(state, shards)
        votes = state.groupBy("g", "chunk", "label").agg(F.first("m").alias("m"))
        units = votes.groupBy("g", "chunk").agg(F.first("m").alias("m"), F.min("label").alias("label"), F.count("*").alias("spread"))
        cut_up = units.where("spread > 1").select("g", "chunk", "m")
        excess = _at([max(0, x - capacity) for x in load], F.col("label"))
        smallest = Window.partitionBy("label").orderBy("m", F.xxhash64("g", "chunk"))
        beyond = units.where(F.col("spread") == 1).withColumn("excess", excess).where("excess > 0").withColumn("rank", F.row_number().over(smallest)).where(F.col("rank") <= TAKEN)
        beyond = beyond.withColumn("sum", F.sum("m").over(smallest.rowsBetween(Window.unboundedPreceding, 0))).where("sum - m < excess").select("g", "chunk", "m")
        fits = F.filter(F.array(*[F.struct(F.lit(max(0, capacity - x)).cast("long").alias("room"), F.lit(s).alias("s")) for s, x in enumerate(load)]), lambda x: x["room"] >= F.col("m"))
        drawn = cut(cut_up.unionByName(beyond).select("g", "chunk", "m", fits.alias("fits")).where(F.size("fits") > 0))
        if drawn.isEmpty():
            break
        target = F.element_at("fits", (F.pmod(F.xxhash64("g", "chunk", F.lit(turn)), F.size("fits")) + 1).cast("int"))
        largest = Window.partitionBy("s").orderBy(F.col("m").desc(), F.xxhash64("g", "chunk"))
        first = drawn.select("g", "chunk", "m", target.alias("x")).select("g", "chunk", "m", "x.room", "x.s").withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= TAKEN)
        goes = cut(first.withColumn("sum", F.sum("m").over(largest.rowsBetween(Window.unboundedPreceding, 0))).where("sum <= room").select("g", "chunk", F.col("s").alias("to")))
        idle = idle + 1 if goes.isEmpty() else 0
        state = cut(state.join(F.broadcast(goes), ["g", "chunk"], "left").withColumn("label", F.coalesce("to", "label")).drop("to"))  # TAKEN rows a shard at most
        turn += 1
    return state


def with_cut_copies(placed: DataFrame) -> DataFrame:
    """The rows (g, shard, ...) with cut_copies: rows of the same g in other shards."""
    counts = placed.groupBy("g", "shard").agg(F.count("*").alias("n"))
    cut_up = counts.groupBy("g").agg(F.sum("n").alias("all"), F.count("*").alias("shards")).where("shards > 1")
    told = cut(counts.join(cut_up, "g").select("g", "shard", (F.col("all") - F.col("n")).alias("others")))
    told = F.broadcast(told) if told.count() <= FEW else told
    return placed.join(told, ["g", "shard"], "left").withColumn("cut_copies", F.coalesce("others", F.lit(0)).cast("long"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, cut_copies of every row."""
    base = cut(described(docs, key, text))
    total = base.count()
    capacity = max(1, total // shards)
    # fewer than 2.5 * shards + 1 texts have more than 0.8 * capacity documents
    large = base.groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > UNIT_SHARE * capacity)
    pieces = large.select("g", F.ceil(F.col("c") / (UNIT_SHARE * capacity)).alias("pieces"))
    units = base.withColumn("first", F.pmod(F.xxhash64("k"), F.lit(shards)).cast("int"))
    units = units.join(F.broadcast(pieces), "g", "left").withColumn("chunk", F.pmod(F.xxhash64("k", F.lit(1)), F.coalesce("pieces", F.lit(1))).cast("int")).drop("pieces")
    units = cut(units)
    parts = units.groupBy("g", "chunk", "first").agg(F.count("*").alias("n"))
    members = parts.groupBy("g", "chunk").agg(F.sum("n").alias("m")).where("m > 1")
    state = cut(parts.join(members, ["g", "chunk"]).withColumn("label", F.col("first")))
    state = propagate(state, shards, capacity)

    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, total // ROWS_A_BUCKET))
    placed = units.join(state.select("g", "chunk", "first", "m", "label"), ["g", "chunk", "first"], "left")
    # a unit with more documents than a bucket should have takes several buckets in a row
    wide = F.least(F.ceil(F.coalesce("m", F.lit(1)) / max(LEAST_A_BUCKET, total // (shards * buckets))), F.lit(buckets))
    # the documents without links are as many as several shards hold, and have as many buckets
    own = F.when(F.col("label").isNull(), F.lit(buckets * shards)).otherwise(F.lit(buckets))
    spread = F.pmod(F.xxhash64("g", "chunk"), own) + F.pmod(F.xxhash64("k", "text_crc32", F.lit(2)), wide)
    placed = placed.select("k", "size", "text_crc32", "g", "chunk", F.coalesce("label", F.lit(shards)).alias("at"), F.pmod(spread, own).cast("int").alias("bucket"))
    counts = cut(placed.groupBy("at", "bucket").agg(F.count("*").alias("n")))
    load = [0] * (shards + 1)
    for r in counts.groupBy("at").agg(F.sum("n").alias("n")).collect():  # a row for each shard, and one
        load[r["at"]] = r.n
    counts = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    before = lambda *of: Window.partitionBy(*of).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("at", "run").agg(F.sum("n").alias("n")).select("at", "run", F.coalesce(F.sum("n").over(before("at").orderBy("run")), F.lit(0)).alias("base"))
    inside_run = F.coalesce(F.sum("n").over(before("at", "run").orderBy("bucket")), F.lit(0))
    offsets = counts.withColumn("skip", inside_run).join(F.broadcast(runs), ["at", "run"]).select("at", "bucket", (F.col("skip") + F.col("base")).alias("skip"))
    inside = Window.partitionBy("at", "bucket").orderBy("g", "chunk", "k", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["at", "bucket"]).withColumn("rank", F.col("rank") + F.col("skip"))

    quota = [total // shards + (s < total % shards) for s in range(shards)]
    kept = [min(q, x) for q, x in zip(quota, load, strict=False)]
    over = [x - k for x, k in zip(load, kept, strict=False)]
    over_before = [load[shards] + sum(over[:s]) for s in range(shards)]
    free = [q - k for q, k in zip(quota, kept, strict=True)]
    free_before = [sum(free[:s]) for s in range(shards)]
    own = F.least(F.col("at"), F.lit(shards - 1))
    stays = (F.col("at") < shards) & (F.col("rank") < _at(kept, own))
    place = F.when(F.col("at") == shards, F.col("rank")).otherwise(F.col("rank") - _at(kept, own) + _at(over_before, own))
    moved = ranked.withColumn("place", F.when(~stays, place))
    ends = F.array(*[F.lit(b + f).cast("long") for b, f in zip(free_before, free, strict=True)])
    shard = F.when(stays, F.col("at")).otherwise(F.size(F.filter(ends, lambda x: x <= F.col("place"))))
    out = moved.withColumn("shard", shard.cast("int"))
    slot = F.when(stays, F.col("rank")).otherwise(_at(kept, F.col("shard")) + F.col("place") - _at(free_before, F.col("shard")))
    out = with_cut_copies(cut(out.select("k", "size", "text_crc32", "g", "shard", slot.cast("long").alias("slot"))))
    return out.select(F.col("k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cut_copies")
