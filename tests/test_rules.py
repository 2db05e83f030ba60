"""Rules on small inputs: values that the reference results fix."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyplan.functions import text as X
from rallyplan.operators import gaps, robust, scoring, sequence, timejoin
from rallyplan.plans.rally_queries import kind_evidence
from rallyplan.sources.tracking import points


@pytest.mark.parametrize("gap, side, before, goes_on", [(2.0, -1, 1, True), (3.0, 1, -1, True), (4.5, -1, -1, True), (5.0, 1, 1, True), (4.5, -1, 1, False), (4.5, None, None, False), (7.0, -1, -1, False)])
def test_rally_continues(spark, gap, side, before, goes_on):
    row = spark.createDataFrame([(gap, side, before)], "g double, s int, b int")
    assert row.select(gaps.continues_rally(F.col("g"), F.col("s"), F.col("b"))).first()[0] is goes_on


def test_serve_runs(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0, 0, 0, 0, 1, 1, 1, 1, 1, 0])], "g int, i int, s int")
    assert [r.n for r in gaps.run_lengths(rows, ["g"], ["i"], "s").orderBy("island").collect()] == [4, 5, 1]


def rallies_of(spark, rows):
    return spark.createDataFrame([(1, i, s, s + 5, n, serve) for i, (s, n, serve) in enumerate(rows)], "session_id long, rally long, start_s double, end_s double, shot_count long, server long")


def test_kind(spark):
    match = rallies_of(spark, [(26.0 * i, 5, i // 5 % 2) for i in range(30)])
    training = rallies_of(spark, [(20.0 * i, 15, None) for i in range(30)])
    practice = rallies_of(spark, [(8.0 * i, 1, 0) for i in range(30)])
    few = rallies_of(spark, [(30.0 * i, 4, 0) for i in range(3)])
    m, t, p, u = (kind_evidence(x).first() for x in (match, training, practice, few))
    assert m.kind == "match" and m.p_match > 0.8
    assert t.kind == "training" and t.p_match < 0.2
    assert p.kind != "match" and u.kind == "unknown"


FAULTS = [((1.0, 1), 1.2, True), ((1.0, 2), 0.8, True), ((1.0, 1), -1.0, False), ((1.0, 4), 1.0, False), ((0.0, 1), 0.0, True), ((0.0, 2), 0.0, False)]


def serve_rallies(spark, rows):
    """(hit_x, shots, in_court) -> rallies 10 s apart, all served by one player."""
    full = [(1, i, 10.0 * i, 10.0 * i + 2, n, 7, x, 11.9, c, None, "serve", 7) for i, (x, n, c) in enumerate(rows)]
    return spark.createDataFrame(full, "session_id long, rally long, start_s double, end_s double, shot_count long, server long, first_hit_x double, first_hit_y double, first_in_court boolean, last_crosses_net boolean, last_stroke string, last_player_id long").withColumn("last_in_court", F.col("first_in_court"))


@pytest.mark.parametrize("serve, nxt, fault", FAULTS)
def test_fault(spark, serve, nxt, fault):
    p = points(serve_rallies(spark, [(*serve, None), (nxt, 9, None)])).orderBy("rally").collect()
    assert [r.fault for r in p] == [fault, False]


def test_serve_in_is_no_fault_and_last_is_none(spark):
    p = points(serve_rallies(spark, [(1.0, 1, True), (1.0, 1, None)])).orderBy("rally").collect()
    assert [r.fault for r in p] == [False, False]


@pytest.mark.parametrize("seed", range(4))
def test_fault_pairs_as_a_loop(spark, seed):
    pick = np.random.default_rng(seed)
    flags = pick.random(40) < 0.6
    flags[-1] = False
    rows = [(1.0, 1 if f else 9, None) for f in flags]
    got = points(serve_rallies(spark, rows)).orderBy("rally").collect()
    pending, want = False, []
    for f in flags:
        if f:
            want.append(("double_fault", 2) if pending else ("fault", None))
            pending = not pending
        else:
            want.append(("point", int(pending)))
            pending = False
    assert [(r.role, None if r.role == "fault" else r.faults) for r in got] == want


def test_hit_chains():
    t = lambda *x: np.array(x, float)
    side = np.array
    best = sequence.best_hits
    assert best(t(0, 1, 2), side([1, -1, 1]), t(0.9, 0.9, 0.9)).tolist() == [0, 1, 2]
    assert best(t(0, 0.3, 1), side([1, -1, -1]), t(0.9, 0.6, 0.9)).tolist() == [0, 2]
    assert best(t(0, 1, 2), side([1, -1, 1]), t(0.9, 0.45, 0.9)).tolist() == [0, 1, 2]
    assert best(t(0, 10), side([1, 1]), t(0.9, 0.9)).tolist() == [0, 1]
    assert best(t(0), side([1]), t(0.4)).tolist() == []
    assert best(t(), side([]), t()).tolist() == []


def naive_chain(t, side, gain):
    """Every chain by its gain."""
    n, best = len(t), 0.0
    stack = [(0.0, -1, 0)]
    while stack:
        total, last, at = stack.pop()
        best = max(best, total)
        for j in range(at, n):
            if last < 0 or t[j] - t[last] >= 4.0 or (t[j] - t[last] >= 0.55 and side[j] != side[last]):
                stack.append((total + gain[j], j, j + 1))
    return best


def test_hit_chains_by_brute_force():
    pick = np.random.default_rng(1)
    for _ in range(150):
        n = pick.integers(1, 12)
        t, side, score = np.sort(pick.random(n) * 14), pick.choice([-1, 1], n), pick.random(n) * 0.7 + 0.3
        got = sequence.best_hits(t, side, score)
        assert abs((score[got] - 0.5).sum() - naive_chain(t, side, score - 0.5)) < 1e-9
        for a, b in zip(got, got[1:], strict=False):
            assert t[b] - t[a] >= 4 or (t[b] - t[a] >= 0.55 and side[a] != side[b])


@pytest.mark.parametrize("a, b, tie, text", [(2, 1, False, "30-15"), (3, 3, False, "deuce"), (4, 3, False, "advantage server"), (3, 4, False, "advantage receiver"), (5, 3, True, "5-3"), (0, 0, False, "0-0")])
def test_point_text(spark, a, b, tie, text):
    row = spark.createDataFrame([(a, b, tie)], "a int, b int, t boolean")
    assert row.select(X.point_text(F.col("a"), F.col("b"), F.col("t"))).first()[0] == text


def simulate(seed, p_server=0.62, noise=0.0, miss=0.0):
    """A match with what would be observed of it."""
    pick = np.random.default_rng(seed)
    node, seen, won = scoring.Node((0, 0), (0, 0), (0, 0), 0, -1), [], []
    sets, games = [], 0
    while not scoring.finished(node):
        s = scoring.serving(node)
        w = s if pick.random() < p_server else 1 - s
        p = 0.85 if w == s else 0.15
        if pick.random() < noise:
            p = 1 - p
        end, box = node.end if s == 0 else -node.end, 1 if sum(node.points) % 2 == 0 else -1
        if pick.random() >= miss:
            seen.append(scoring.Observed(s if pick.random() >= noise / 2 else 1 - s, p, end, box if pick.random() >= noise / 2 else 0))
            won.append(w)
        node, over, done = scoring.after(node, w)
        games += over
        sets += [done] if done else []
    return seen, won, sets, games


@pytest.mark.parametrize("seed", range(3))
def test_match_is_decoded(seed):
    seen, won, sets, games = simulate(seed)
    d = scoring.decode(seen)
    assert np.mean([a == b for a, b in zip(d.winners, won, strict=True)]) > 0.9 and d.sets == sets
    seen, won, _, games = simulate(seed + 10, noise=0.1)
    d = scoring.decode(seen)
    assert np.mean([a == b for a, b in zip(d.winners, won, strict=True)]) > 0.8
    assert abs(sum(w is not None for _, w, _ in d.games) - games) <= 2


def test_short_matches():
    d = scoring.decode([scoring.Observed(0, 0.9, -1, 1), scoring.Observed(0, 0.9, -1, -1)])
    assert d.before == ["0-0, 0-0", "0-0, 15-0"] and d.winners == [0, 0]
    assert scoring.decode([]).text() == "0-0"


def test_tiebreak_rules():
    n = scoring.Node((0, 0), (6, 6), (0, 0), 0, -1)
    servers = []
    for _ in range(6):
        servers.append(scoring.serving(n))
        n, _, _ = scoring.after(n, len(servers) % 2)
    assert servers == [0, 1, 1, 0, 0, 1] and n.end == 1
    n = scoring.Node((0, 0), (6, 6), (6, 5), 0, -1)
    n, over, games = scoring.after(n, 0)
    assert over and games == (7, 6) and n.sets == (1, 0) and n.first == 1
    assert scoring.after(scoring.Node((0, 0), (0, 0), (3, 4), 0, -1), 0)[0].points == (3, 3)


def test_merge_views():
    row = lambda video, t, label, stroke, score, **k: {"video": video, "t": t, "label": label, "stroke": stroke, "hit_score": score, "sources": {"audio"}, "metrics": {}, **k}
    rows = [row(1, 0.0, "A", "serve", 0.9), row(2, 0.1, "A", "serve", 0.7, speed_kmh=150.0), row(1, 1.0, "B", "forehand", 0.8), row(2, 1.1, None, "unknown", 0.9), row(1, 5.0, "A", "backhand", 0.6)]
    out = sequence.merge_views(rows)
    assert len(out) == 3 and out[0]["speed_kmh"] == 150.0 and out[1]["stroke"] == "forehand" and [r["views"] for r in out] == [2, 2, 1]
    two = [row(1, 0.0, "A", "serve", 0.9), row(2, 0.1, "B", "serve", 0.7)]
    assert len(sequence.merge_views(two)) == 2
    keys = sequence.resegment(np.array([0.0, 1.0, 5.0]), np.array([-12.0, 12.0, -12.0]), np.array([True, False, False]))
    assert keys.tolist() == [0, 0, 1]


def test_greedy_match():
    got = sequence.greedy_match(np.array([0.0, 1.0, 5.0]), np.array([2.0, 3.0, 6.0]), np.array([1.5, 0.5, 2.5, 9.0]))
    assert got == [(0, 1), (1, 0)]


def test_assignment_by_brute_force():
    from itertools import permutations

    pick = np.random.default_rng(2)
    for shape in ((1, 1), (3, 3), (2, 4), (4, 2), (5, 5)):
        cost = pick.random(shape)
        small, large = min(shape), max(shape)
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        got = sequence.assignment(cost)
        assert len(got) == small and abs(sum(cost[i, j] for i, j in got) - best) < 1e-9


def test_frame_lookup(spark):
    frames = spark.createDataFrame([(1, t, i) for i, t in enumerate([0.0, 0.1, 0.2, 0.3])], "v int, t double, frame int")
    asked = spark.createDataFrame([(1, t) for t in (-1.0, 0.04, 0.05, 0.06, 0.24, 0.26, 9.0)], "v int, t double")
    back = timejoin.asof(asked, frames, ["v"], "t", ["frame"]).withColumnsRenamed({"r_time": "bt", "frame": "bf"})
    both = timejoin.asof(back, frames, ["v"], "t", ["frame"], forward=True)
    near = F.col("bt").isNotNull() & (F.col("r_time").isNull() | (F.col("t") - F.col("bt") <= F.col("r_time") - F.col("t")))
    assert [r[0] for r in both.orderBy("t").select(F.when(near, F.col("bf")).otherwise(F.col("frame"))).collect()] == [0, 0, 0, 1, 2, 3, 3]


def test_nearest_rank_and_upper_median(spark):
    for n, at in ((2, 0), (4, 2), (6, 2), (8, 4)):
        df = spark.createDataFrame([(float(i),) for i in range(n)], "x double")
        assert df.agg(robust.nearest_rank("x", 0.5)).first()[0] == at
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (3.0,), (4.0,)], "x double")
    assert df.agg(robust.upper_median("x")).first()[0] == 3.0


def test_filters():
    t = np.arange(30) / 30
    x = 3 + 2 * t + t**2
    assert np.allclose(sequence.savitzky_golay(x, 7, 2), x)
    y = x.copy()
    y[10:12] = np.nan
    out = sequence.savitzky_golay(y, 7, 2)
    assert np.isnan(out[10:12]).all() and np.allclose(out[:10], x[:10])
    noisy = 1 + np.random.default_rng(0).normal(0, 0.1, 300)
    smooth = sequence.one_euro(np.arange(300) / 30, noisy)
    assert smooth[50:].std() < noisy.std() / 2
    a, b, s = sequence.repair_swaps(np.array([[0, 0], [5, 0], [0, 0]], float), np.array([[5, 0], [0, 0], [5, 0]], float), 0.2)
    assert s.tolist() == [False, True, False] and a[1].tolist() == [0, 0]
    assert sequence.keep_apart(np.array([0.0, 0.1, 0.5]), np.array([1.0, 2.0, 1.0]), 0.3).tolist() == [False, True, True]


def test_gap_fill(spark):
    rows = [(1, float(t), v) for t, v in enumerate([None, 1.0, None, 3.0, None, None, 9.0, None])]
    df = spark.createDataFrame(rows, "g int, t double, v double")
    assert [r.filled for r in gaps.fill_gaps(df, ["g"], "t", "v", 1).orderBy("t").collect()] == [None, 1.0, 2.0, 3.0, None, None, 9.0, None]


@pytest.mark.parametrize("text, seconds", [("90", 90.0), ("1:30", 90.0), ("1:02:03.5", 3723.5), (" 0:07 ", 7.0)])
def test_clock(spark, text, seconds):
    assert spark.createDataFrame([(text,)], "s string").select(X.clock_seconds(F.col("s"))).first()[0] == seconds


def test_parsing(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]
    assert math.isclose(one("120000/1001", X.rational), 120000 / 1001)
    assert one("0/0", X.rational) is None and one("junk", X.rational) is None and one("30", X.rational) == 30
    assert one("7-6 4-3, 30-15", lambda c: X.games(c, 0)) == 11 and one("7-6 x-y", lambda c: X.games(c, 1)) == 6
    assert one("1970-01-01T00:00:00Z", X.iso_time) is None and one("2024-05-01T10:00:00", X.iso_time).year == 2024
    assert one("..a b/c.mp4", X.safe_name) == "a_b_c.mp4" and one("Ann Lee", X.initials) == "AN"


def test_every_row_is_serialised(spark):
    from rallyplan.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/conversations.parquet").selectExpr("conv_id", "turn", "role", "CAST(length(text) AS BIGINT) AS n")
    got = QUERIES["serialised_rows"](spark, d)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and got.where("turn > 0 AND turn % 2 = 0").count() > 0


def test_every_size_is_formatted(spark):
    from rallyplan.plans.registry import QUERIES

    d = "/root/testdata/sf0.01"
    got = {r.event_id: r.size for r in QUERIES["format_texts"](spark, d).collect()}
    ids = [r.event_id for r in spark.read.parquet(f"{d}/events.parquet").collect()]
    assert got == {i: f"{i} B" if i < 1000 else f"{i / 1000:.1f} kB" for i in ids} and [got[i] for i in (50, 1050, 1150, 1250)] == ["50 B", "1.1 kB", "1.1 kB", "1.2 kB"]
    large = spark.createDataFrame([(999_950,), (1_250_000,), (1_234_567_890,)], "n long")
    assert [r[0] for r in large.select(X.size_text(F.col("n"))).collect()] == ["1000.0 kB", "1.2 MB", "1234.6 MB"]


def test_scoreboard_texts_of_all_nodes(spark):
    """What the board shows of every node against the column function."""
    b = scoring.board()
    at = range(0, len(b.nodes), 7)
    rows = [(i, *n.games, n.points[n.first], n.points[1 - n.first], scoring.in_tiebreak(n)) for i in at for n in [b.nodes[i]]]
    text = F.concat(F.col("g0"), F.lit("-"), F.col("g1"), F.lit(", "), X.point_text(F.col("a"), F.col("b"), F.col("tie")))
    got = spark.createDataFrame(rows, "i int, g0 int, g1 int, a int, b int, tie boolean").select("i", text.alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: str(b.shown[i]) for i in at}


def plain_course(start, moves):
    """Sets, games, texts of a course, point by point."""
    node, sets, games, game, before, opener = start, [], [], [], [], start.first
    for missed, won in moves:
        for who, asked in ((missed, False), (won, True)):
            if asked:
                before.append(" ".join([*(f"{a}-{b}" for a, b in sets), str(scoring.board().shown[scoring.board().nodes.index(node)])]))
            if who is None:
                continue
            opener = opener if game else node.first
            game.append(who)
            node, over, done = scoring.after(node, who)
            if over:
                games.append((opener, who, tuple(game)))
                game = []
            sets += [done] if done else []
    return sets, games + ([(opener, None, tuple(game))] if game else []), before, node.games


@pytest.mark.parametrize("seed", range(5))
def test_course_as_arrays_against_point_by_point(seed):
    pick, b = random.Random(seed), scoring.board()
    here, moves, asked, rank, taken, by = pick.randrange(4), [], [], [], [], []
    start = b.nodes[here]
    for _ in range(pick.randrange(1, 160)):
        pair = (pick.choice([None, None, None, 0, 1]), pick.choice([0, 0, 1, None]))
        if not b.open[here] or (pair[0] is not None and not b.open[b.following[here][pair[0]]]):
            break
        moves.append(pair)
        for i, who in enumerate(pair):
            if i:
                asked.append(here)
                rank.append(len(by))
            if who is not None:
                taken.append(here)
                by.append(who)
                here = int(b.following[here][who])
    c = scoring.Course(asked, [m[1] for m in moves], rank, taken, by)
    sets, games, before, current = plain_course(start, moves)
    assert (c.sets, c.games, c.before, c.current) == (sets, games, before, current)
