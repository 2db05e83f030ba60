"""Lookups, merges and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyplan.session import checkpointed


def latest(df: DataFrame, by: list[str], order: str, payload: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each group, by one aggregate."""
    best = df.groupBy(*by).agg(F.max(order).alias(order), F.max_by(F.struct(*payload), order).alias("__p"))
    return best.select(*by, order, "__p.*")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark keeps k rows a group in each task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def chase(df: DataFrame, key: str, pointer: str) -> DataFrame:
    """(id, root): where each chain of pointers ends, by doubling, however long it is.

    A chain that runs into a loop ends where it enters it (a key of a loop at
    itself); one that leads out of the table ends where it began. Each round is cut
    into the checkpoint folder, so that plans don't double as well; only keys that
    point on take part.
    """
    hop = df.select(F.col(key).alias("id"), F.coalesce(pointer, key).alias("root"))
    while True:
        done, first = hop.where("id = root"), checkpointed(hop.where("id <> root"))
        # on: the root points on itself; that is carried along, so a round is one join
        moving = first.select(F.col("id").alias("root"), F.lit(True).alias("on"))
        last, before = checkpointed(first.join(moving, "root", "left").select("id", "root", F.coalesce("on", F.lit(False)).alias("on"))), -1
        while True:
            size = last.where("on").agg(F.countDistinct("root")).first()[0]
            if size in (0, before):
                break
            onward, before = last.select(F.col("id").alias("root"), F.col("root").alias("next"), F.col("on").alias("next_on")), size
            last = checkpointed(last.drop("on").join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.coalesce("next_on", F.lit(False)).alias("on")))
        if not size:
            found = done.unionByName(last.drop("on"))
            known = df.select(F.col(key).alias("root"), F.lit(True).alias("known"))
            return found.join(known, "root", "left").select("id", F.when(F.col("known"), F.col("root")).otherwise(F.col("id")).alias("root"))
        # as many keys as half as many steps on are still pointed at, so the steps only turn them round: they are keys of loops and become ends
        loops = last.where("on").select(F.col("root").alias("id")).distinct().withColumn("loop", F.lit(True))
        hop = checkpointed(hop.join(loops, "id", "left").select("id", F.when(F.col("loop"), F.col("id")).otherwise(F.col("root")).alias("root")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer join of old and new rows: new columns, and action insert, update or delete."""
    o = old.select(F.col(key).alias("__old"))
    both = o.join(new, F.col("__old") == F.col(key), "full")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col(key).isNull(), "delete").otherwise("update")
    return both.withColumn("action", action).withColumn(key, F.coalesce(key, "__old")).drop("__old")


def merged_maps(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; the new one's entries win."""
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows only one side has, counting repeats; both 0: the same content. NaN equals NaN, null equals null; one shuffle."""
    sign = "__sign"
    both = a.withColumn(sign, F.lit(1)).unionByName(b.withColumn(sign, F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum(sign).alias("n"))
    total = lambda n: F.coalesce(F.sum(F.greatest(F.lit(0).cast("long"), n)), F.lit(0).cast("long"))
    return left.agg(total(F.col("n")).alias("rows_only_old"), total(-F.col("n")).alias("rows_only_new"))
