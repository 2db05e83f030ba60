"""Operators that carry state from row to row: plain functions over sorted arrays, and a helper that runs them by group.

Groups are sessions or videos, so a group is bounded by a recording's length; the
rows of a group are sorted inside the function, as Spark doesn't promise an order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from rallyplan.schema import LIMITS

# Least gap between hits, silence that ends a rally, least score.
MIN_GAP_S, BREAK_S, THRESHOLD = 0.55, 4.0, 0.5


def per_group(df: DataFrame, by: list[str], order: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over each group's rows in order.

    Groups are dealt out to the session's number of shuffle partitions: their rows
    are few bytes but much work, so partitions that were joined by size would
    leave cores idle.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return f(rows.sort_values(order, kind="stable", ignore_index=True))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *by).groupBy(*by).applyInPandas(run, schema)


def best_hits(t: np.ndarray, side: np.ndarray, score: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Indexes of the best chain of hits, of options sorted by time.

    Each option gains its score less the threshold. The next hit of a chain comes
    from the other side at least MIN_GAP_S later, or from either side BREAK_S
    later. Options below 0.6 of the threshold don't take part. Silences of BREAK_S
    cut the problem into independent stretches: of each, the best chain counts if
    its gain is positive.
    """
    usable = np.flatnonzero(score > 0.6 * threshold)
    if not len(usable):
        return usable
    cuts = np.flatnonzero(np.diff(t[usable]) >= BREAK_S) + 1
    out = [_stretch(t[s], side[s], score[s] - threshold, s) for s in np.split(usable, cuts)]
    return np.concatenate(out).astype(np.int64)


def _stretch(t: np.ndarray, side: np.ndarray, gain: np.ndarray, ids: np.ndarray) -> np.ndarray:
    n = len(t)
    total, came = gain.copy(), np.full(n, -1)
    far = np.searchsorted(t, t - BREAK_S, side="right")  # those before far[j] are a rally earlier
    top, top_at, seen = 0.0, -1, 0
    for j in range(n):
        for i in range(seen, far[j]):
            if total[i] > top:
                top, top_at = total[i], i
        seen = max(seen, far[j])
        total[j], came[j] = top + gain[j], top_at
        near = np.arange(far[j], j)
        near = near[(t[j] - t[near] >= MIN_GAP_S) & (side[near] != side[j])]
        if len(near):
            i = near[np.argmax(total[near])]
            if total[i] + gain[j] > total[j]:
                total[j], came[j] = total[i] + gain[j], i
    j = int(np.argmax(total))
    chain: list[int] = []
    while total[int(np.argmax(total))] > 0 and j >= 0:
        chain.append(j)
        j = int(came[j])
    return ids[chain[::-1]] if chain else ids[:0]


def greedy_match(starts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> list[tuple[int, int]]:
    """(window, detection): each window, by start, takes the earliest free detection inside it."""
    order = np.argsort(times, kind="stable")
    free = list(order)
    out = []
    for w in np.argsort(starts, kind="stable"):
        at = next((k for k, d in enumerate(free) if times[d] >= starts[w]), None)
        if at is not None and times[free[at]] <= ends[w]:
            out.append((int(w), int(free.pop(at))))
    return out


def merge_moments(t: np.ndarray, source: list[str], loudness: np.ndarray, within: float = 0.08) -> list[dict]:
    """Moments at most ``within`` after the merged one's time are the same; a sound's time is taken over others', a ball's over a pose's."""
    rank = {"audio": 2, "ball": 1, "pose": 0}
    out: list[dict] = []
    for x, s, db in zip(t, source, loudness, strict=True):
        if out and x - out[-1]["t"] <= within:
            m = out[-1]
            best = max(rank[k] for k in m["sources"])
            if rank[s] > best:
                m["t"] = float(x)
            m["loudness"] = max(m["loudness"], float(db))
            m["sources"].add(s)
        else:
            out.append({"t": float(x), "sources": {s}, "loudness": float(db)})
    return out


def keep_apart(t: np.ndarray, strength: np.ndarray, gap: float) -> np.ndarray:
    """Mask of what is kept if of two moments closer than ``gap`` the stronger stays, from left to right."""
    keep = np.ones(len(t), bool)
    last = 0
    for i in range(1, len(t)):
        if t[i] - t[last] >= gap:
            last = i
        elif strength[i] > strength[last]:
            keep[last], last = False, i
        else:
            keep[i] = False
    return keep


def suppress_after(t: np.ndarray, quiet: float) -> np.ndarray:
    """Mask of events that come at least ``quiet`` after the last kept one."""
    keep, last = np.zeros(len(t), bool), -np.inf
    for i, x in enumerate(t):
        if x - last >= quiet:
            keep[i], last = True, x
    return keep


# What one view may take from another.
VIEW_FIELDS = ("speed_kmh", "hit_x", "hit_y", "bounce_x", "bounce_y", "in_court", "depth", "direction", "net_clearance_m", "contact_height_m", "crosses_net")


def merge_views(rows: list[dict], within: float = 0.2) -> list[dict]:
    """One shot seen by two cameras as one: the richer view stays and takes what it lacks from the other.

    rows are sorted by t and have video, t, label (or None), stroke, hit_score,
    sources (a set), metrics, and any of VIEW_FIELDS. A row is compared with the
    last merged one.
    """
    rich = lambda r: ((r.get("speed_kmh") is not None) + (r["stroke"] != "unknown"), r["hit_score"])
    out: list[dict] = []
    for r in rows:
        last = out[-1] if out else None
        fits = last is not None and last["video"] != r["video"] and r["t"] - last["t"] <= within
        if not fits or (last["label"] and r["label"] and last["label"] != r["label"]):
            out.append(dict(r, views=1))
            continue
        first, second = (last, r) if rich(last) >= rich(r) else (r, last)
        both = dict(first, views=2, label=first["label"] or second["label"], sources=set(first["sources"]) | set(second["sources"]), metrics=second["metrics"] | first["metrics"])
        both |= {k: second.get(k) for k in VIEW_FIELDS if first.get(k) is None}
        out[-1] = both
    return out


def one_euro(t: np.ndarray, x: np.ndarray, min_cutoff: float = 1.0, beta: float = 0.05, d_cutoff: float = 1.0, zero_phase: bool = False) -> np.ndarray:
    """One Euro filter over real times; missing values restart it. zero_phase: mean with the pass from the end."""
    smoothing = lambda dt, cutoff: 1.0 / (1.0 + 1.0 / (2 * np.pi * cutoff * dt))
    out = np.full(len(x), np.nan)
    value = slope = np.nan
    for i, y in enumerate(x):
        if not np.isfinite(y):
            value = np.nan
            continue
        dt = t[i] - t[i - 1] if i else 0.0
        if not np.isfinite(value):
            value, slope = y, 0.0
        elif dt > 0:
            slope += smoothing(dt, d_cutoff) * ((y - value) / dt - slope)
            value += smoothing(dt, min_cutoff + beta * abs(slope)) * (y - value)
        out[i] = value
    if zero_phase:
        out = (out + one_euro(-t[::-1], x[::-1], min_cutoff, beta, d_cutoff)[::-1]) / 2
    return out


def savitzky_golay(x: np.ndarray, window: int, order: int) -> np.ndarray:
    """Polynomial smoothing of each stretch of known values at least ``window`` long; its ends by the polynomial of the end windows."""
    out = np.array(x, float)
    half = window // 2
    base = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    fit = np.linalg.pinv(base)
    known = np.isfinite(out)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], known.astype(int), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a < window:
            continue
        part = np.array(x[a:b], float)
        out[a + half : b - half] = np.convolve(part, fit[0][::-1], mode="valid")
        out[a : a + half] = (base @ (fit @ part[:window]))[:half]
        out[b - half : b] = (base @ (fit @ part[-window:]))[half + 1 :]
    return out


def repair_swaps(left: np.ndarray, right: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right points (n, 2) with label swaps undone: a pair is swapped if that cuts the way from the last corrected frame by more than ``ratio``."""
    a, b = left.astype(float).copy(), right.astype(float).copy()
    swapped = np.zeros(len(a), bool)
    for i in range(1, len(a)):
        pair = np.concatenate([a[i - 1 : i + 1], b[i - 1 : i + 1]])
        if not np.isfinite(pair).all():
            continue
        stay = np.linalg.norm(a[i] - a[i - 1]) + np.linalg.norm(b[i] - b[i - 1])
        cross = np.linalg.norm(b[i] - a[i - 1]) + np.linalg.norm(a[i] - b[i - 1])
        if cross < (1 - ratio) * stay:
            swapped[i] = True
            a[i], b[i] = b[i].copy(), a[i].copy()
    return a, b, swapped


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost, by shortest augmenting paths, O(n^3)."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assignment(cost.T))
    rows, cols = cost.shape
    row_pot, col_pot = np.zeros(rows + 1), np.zeros(cols + 1)
    owner = np.zeros(cols + 1, int)
    for r in range(1, rows + 1):
        owner[0], column = r, 0
        slack, back, done = np.full(cols + 1, np.inf), np.zeros(cols + 1, int), np.zeros(cols + 1, bool)
        while True:
            done[column] = True
            open_ = ~done[1:]
            reduced = cost[owner[column] - 1] - row_pot[owner[column]] - col_pot[1:]
            better = open_ & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], column
            nxt = int(np.argmin(np.where(open_, slack[1:], np.inf))) + 1
            step = slack[nxt]
            row_pot[owner[done]] += step
            col_pot[done] -= step
            slack[~done] -= step
            column = nxt
            if not owner[column]:
                break
        while column:
            owner[column] = owner[back[column]]
            column = back[column]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, cols + 1) if owner[c])


def resegment(t: np.ndarray, hit_y: np.ndarray, serve: np.ndarray) -> np.ndarray:
    """Rally numbers on one clock; a hit at exactly 0 counts as the far side, a missing one as no side."""
    side = np.where(np.isnan(hit_y), 0, np.where(hit_y < 0, -1, 1))
    gap = np.diff(t, prepend=-np.inf)
    before = np.concatenate(([0], side[:-1]))
    goes_on = (gap <= LIMITS.rally_gap_s) | ((gap <= LIMITS.missed_hit_gap_s) & (side != 0) & (side == before))
    return np.cumsum(serve | ~goes_on) - 1 if len(t) else np.zeros(0, int)
