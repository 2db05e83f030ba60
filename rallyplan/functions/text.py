"""Strings and documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(text: Column) -> Column:
    """``h:mm:ss.s``, ``m:ss`` or seconds as seconds."""
    return F.aggregate(F.split(F.trim(text), ":"), F.lit(0.0), lambda s, x: s * 60 + x.cast("double"))


def rational(text: Column) -> Column:
    """``120000/1001`` as a number; null for 0/0, junk and what isn't positive."""
    parts = F.split(text, "/")
    rate = F.try_divide(F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1), F.lit("1")).try_cast("double"))
    return F.when((rate > 0) & (F.size(parts) <= 2), rate)


def iso_time(text: Column) -> Column:
    """ISO time (naive: UTC) as a timestamp; null before 2000, when cameras without a clock think they are."""
    t = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.when(F.year(t) >= 2000, t)


def games(text: Column, side: int) -> Column:
    """Games of one side in a score such as ``7-6 4-3, 30-15``; parts that aren't numbers are skipped."""
    parts = F.split(F.trim(F.get(F.split(text, ","), 0)), r"\s+")
    good = F.filter(parts, lambda p: F.contains(p, F.lit("-")) & F.get(F.split(p, "-", 2), 0).try_cast("int").isNotNull() & F.get(F.split(p, "-", 2), 1).try_cast("int").isNotNull())
    return F.aggregate(good, F.lit(0), lambda s, p: s + F.get(F.split(p, "-", 2), side).try_cast("int"))


def safe_name(text: Column) -> Column:
    """A file name with only letters, digits, dots, dashes and underscores, no dots in front."""
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^\.+", "")


def initials(name: Column) -> Column:
    return F.upper(F.substring(F.regexp_replace(name, r"[^A-Za-z0-9]", ""), 1, 2))


def config_hash(*fields: tuple[str, Column]) -> Column:
    """First 16 hex digits of the sha256 of the fields as JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])])), 256), 1, 16)


def point_text(a: Column, b: Column, tiebreak: Column) -> Column:
    """The point score of a game, server first."""
    names = F.array(*[F.lit(x) for x in ("0", "15", "30", "40")])
    name = lambda n: F.element_at(names, F.least(n, F.lit(3)).cast("int") + 1)
    plain = F.concat(name(a), F.lit("-"), name(b))
    late = F.when(a == b, "deuce").when(a > b, "advantage server").otherwise("advantage receiver")
    return F.when(tiebreak, F.concat(a.cast("string"), F.lit("-"), b.cast("string"))).when((a >= 3) & (b >= 3), late).otherwise(plain)


def clock_text(seconds: Column) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def size_text(n: Column) -> Column:
    """Bytes as B, kB or MB; the quotient's exact value is rounded, ties to even (%.1f rounds its shortest decimal text, ties up)."""
    scaled = lambda by, unit: F.concat(F.call_function("format_number", n / by, F.lit("0.0")), F.lit(f" {unit}"))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1_000_000, scaled(1000.0, "kB")).otherwise(scaled(1e6, "MB"))


def duration_text(minutes: Column) -> Column:
    m = F.floor(minutes).cast("long")
    return F.when(m >= 60, F.format_string("%d h %d min", F.floor(m / 60), m % 60)).otherwise(F.format_string("%d min", m))
