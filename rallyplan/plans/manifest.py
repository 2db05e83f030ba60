"""Which stages have to run again: a stamp of version, settings and inputs for each stage and key."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settings_hash(settings: dict) -> str:
    """First 16 hex digits of the sha256 of the settings as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def stale(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (stage, key, version, settings, inputs) without the same stamp in ``done``.

    ``inputs`` is a digest of what the stage reads, so a change upstream makes it stale.
    """
    stamp = ["stage", "key", "version", "settings", "inputs"]
    return wanted.join(done.select(*stamp), stamp, "left_anti")


def stamped(df: DataFrame, stage: str, version: int, settings: dict, inputs: str = "digest") -> DataFrame:
    """(stage, key, version, settings, inputs) for rows (key, inputs)."""
    return df.select(F.lit(stage).alias("stage"), "key", F.lit(version).alias("version"), F.lit(settings_hash(settings)).alias("settings"), F.col(inputs).cast("string").alias("inputs"))
