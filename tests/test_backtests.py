"""Back-tests against plain loops, learners and pools on small cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtests as bt
from tidemark.operators import learners, orders, pools, templates


@pytest.fixture(scope="module")
def bars():
    r = np.random.default_rng(12)
    parts = []
    for name, n in (("a", 900), ("b", 60), ("c", 1)):
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.003, n)))
        opened = np.concatenate([[100.0], close[:-1]])
        parts.append(pd.DataFrame({
            "symbol": name, "bar_idx": np.arange(n), "open": opened, "high": np.maximum(opened, close) * 1.001, "low": np.minimum(opened, close) * 0.999, "close": close, "atr": close * r.choice([0.0001, 0.004, 0.03], n),
            "signal": r.choice([0, 0, 0, 1, -1], n), "long_score": r.random(n), "short_score": r.random(n),
        }))
    return pd.concat(parts)


def test_pool_trades_equal_a_plain_loop(spark, bars):
    got = bt.on_pool(spark.createDataFrame(bars)).toPandas().sort_values(["symbol", "entry_idx"])
    want = []
    for symbol, g in bars.groupby("symbol"):
        g, i = g.reset_index(drop=True), 1
        while i < len(g):
            s, ratio = g.signal[i - 1], g.atr[i - 1] / g.open[i]
            if not s or not 0.0004 <= ratio <= 0.012:
                i += 1
                continue
            entry = g.open[i]
            for j in range(i, len(g)):
                stop, goal = entry * (1 - s * 0.008), entry * (1 + s * 0.006)
                hit_stop = j - i > 2 and (g.low[j] <= stop if s > 0 else g.high[j] >= stop)
                hit_goal = not hit_stop and (g.high[j] >= goal if s > 0 else g.low[j] <= goal)
                if hit_stop or hit_goal or j - i >= 60 or j == len(g) - 1:
                    out, why = (stop, "stop") if hit_stop else (goal, "target") if hit_goal else (g.close[j], "timeout")
                    want.append((symbol, i, j, why, (s * (out - entry) / entry - 0.0008) * 100))
                    break
            i = j + 1
    assert [tuple(x) for x in got[["symbol", "entry_idx", "exit_idx", "reason"]].itertuples(index=False)] == [w[:4] for w in want] and len(want) > 40
    np.testing.assert_allclose(got["profit_pct"], [w[4] for w in want])


def test_score_trades_equal_a_plain_loop(spark, bars):
    """Without stops in reach, only scores and the longest hold open and close."""
    rules = bt.Rules(stop=0.9, target=0.9, lift_at=1e9, max_hold=7)
    got = bt.on_scores(spark.createDataFrame(bars), 0.8, 0.9, rules).toPandas().sort_values(["symbol", "entry_idx"])
    want = []
    for symbol, g in bars.groupby("symbol"):
        g, side, since = g.reset_index(drop=True), 0, 0
        for i in range(len(g)):
            if side and i - since >= 7:
                want.append((symbol, since, i, "timeout"))
                side = 0
                continue
            long, short = g.long_score[i], g.short_score[i]
            new = (1 if long > 0.8 and long > short else -1 if short > 0.9 and short > long else 0) if not side else (-1 if side > 0 and short > 0.9 else 1 if side < 0 and long > 0.8 else 0)
            if new:
                if side:
                    want.append((symbol, since, i, "signal"))
                side, since = new, i
        if side:
            want.append((symbol, since, len(g) - 1, "end"))
    assert [tuple(x) for x in got[["symbol", "entry_idx", "exit_idx", "reason"]].itertuples(index=False)] == want and len(want) > 90


def test_matrix_trades_skip_ahead(spark, bars):
    table = spark.createDataFrame(bars)
    scores = table.where("bar_idx % 10 = 0").select("symbol", "bar_idx", F.explode(F.array(F.struct(F.lit("LONG").alias("direction"), F.col("long_score").alias("score")), F.struct(F.lit("SHORT").alias("direction"), F.col("short_score").alias("score")))).alias("x"))
    got = bt.scored_matrix(table, scores.select("symbol", "bar_idx", "x.*"), 0.6).toPandas().sort_values(["symbol", "entry_idx"])
    want = []
    for symbol, g in bars.groupby("symbol"):
        g, i = g.reset_index(drop=True), 0
        while i < len(g) - 1:
            best, d = max((g.long_score[i], 1), (g.short_score[i], -1))
            if i % 10 or best < 0.6:
                i += 1
                continue
            entry, stop, goal = g.close[i], g.close[i] - d * 2 * g.atr[i], g.close[i] + d * 3 * g.atr[i]
            for j in range(i + 1, len(g)):
                lost, won = (g.low[j] <= stop, g.high[j] >= goal) if d > 0 else (g.high[j] >= stop, g.low[j] <= goal)
                if lost or won or j - i >= 60 or j == len(g) - 1:
                    break
            out = stop if lost else goal if won else g.close[j]
            want.append((symbol, i, j, (d * (out - entry) / entry - 0.0008) * 100))
            i = j + 1
    assert [tuple(x) for x in got[["symbol", "entry_idx", "exit_idx"]].itertuples(index=False)] == [w[:3] for w in want] and len(want) > 20
    np.testing.assert_allclose(got["profit_pct"], [w[3] for w in want])


def test_time_tightens_the_stop(spark):
    """A flat position leaves at the narrower stops of its age."""
    n = 80
    low = np.full(n, 99.95)
    low[40] = 99.75  # beyond the stop of 30 bars, not of the start
    b = pd.DataFrame({"symbol": "a", "bar_idx": np.arange(n), "high": 100.02, "low": low, "close": 100.0, "signal": [1] + [0] * (n - 1)})
    run = lambda decay: bt.on_signals(spark.createDataFrame(b), bt.Rules(decay=decay, slippage=0.0)).collect()
    assert [(t["exit_idx"], t["reason"]) for t in run(())] == [(n - 1, "end")]
    early = run(((60, -3.0), (30, -4.0)))
    assert [(t["exit_idx"], t["reason"]) for t in early] == [(40, "stop")] and early[0]["exit_price"] == pytest.approx(100 * (1 - 0.04 / 20))


def test_stop_orders_trigger_expire_and_cancel(spark):
    # bar: high, low, long_stop, short_stop
    rows = [
        (100.1, 99.9, 101.0, 99.0),  # both placed
        (101.5, 98.5, None, None),  # both hit: cancelled
        (101.5, 98.5, 102.0, None),  # nothing pending; long placed
        (100.5, 99.9, None, None), (100.5, 99.9, None, None), (100.5, 99.9, None, None),
        (103.0, 99.9, 104.0, None),  # expired (4 bars > 3); a new one
        (104.5, 103.5, None, None),  # opens at 104
        (104.2, 103.9, None, None),
    ]
    b = spark.createDataFrame([("a", i, h, lo, (h + lo) / 2, x, y) for i, (h, lo, x, y) in enumerate(rows)], "symbol string, bar_idx long, high double, low double, close double, long_stop double, short_stop double")
    got = bt.on_stop_orders(b, 3, bt.Rules(slippage=0.0)).collect()
    assert [(t["entry_idx"], t["exit_idx"], t["side"], t["entry_price"], t["reason"]) for t in got] == [(7, 8, "long", 104.0, "end")]


def test_covers_and_pruning(spark):
    names = {"a_loose": 1, "a_loose+b_loose": 2, "a_strict+b_loose": 2, "c_loose": 1}
    rows = [("pool1", "long", k, k.split("+"), n, 0.7, 80, 8) for k, n in names.items()]
    e = spark.createDataFrame(rows, "pool string, direction string, combo string, conditions array<string>, n_conditions int, overall_rate double, triggers long, rounds long")
    assert {(r["wide"], r["narrow"]) for r in pools.covers(e).collect()} == {("a_loose", "a_loose+b_loose"), ("a_loose", "a_strict+b_loose"), ("a_loose+b_loose", "a_strict+b_loose")}
    assert {r["combo"] for r in pools.pruned(e).collect()} == {"a_loose", "c_loose"}
    assert pools.pruned(e.where("false")).count() == 0


def test_thresholds_stop_at_their_bounds(spark):
    rows = [("g", -30.0, 5.0, -50.0, -10.0, "loosen"), ("h", 0.40, 0.02, 0.2, 0.5, "tighten"), ("i", -50.0, 5.0, -50.0, -10.0, "loosen"), ("j", 0.5, 0.02, 0.2, 0.5, "tighten"), ("k", 0.4, 0.02, 0.2, 0.5, "keep")]
    got = {r["gate"]: (r["new_value"], r["adjusted"]) for r in learners.stepped(spark.createDataFrame(rows, "gate string, value double, step double, low double, high double, suggestion string")).collect()}
    assert got == {"g": (-35.0, True), "h": (0.42, True), "i": (-50.0, False), "j": (0.5, False), "k": (0.4, False)}


def test_similarity_of_equal_and_opposite_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])]
    got = templates.similarities(spark.createDataFrame(rows, "x array<double>, y array<double>"), "x", "y").collect()
    assert [r["cosine"] for r in got] == pytest.approx([1, 0, 0, 0]) and got[0]["fused"] == pytest.approx(1.0)
    assert [r["distance"] for r in got] == pytest.approx([1, 1 - 2**0.5 / 200, 1 - 2 / 200, 1 - 1 / 200])


def test_nearest_bars_across_pieces(spark):
    ts = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    day = 86_400
    b = spark.createDataFrame(pd.DataFrame({"symbol": "a", "bar_idx": range(3), "ts": [ts(0), ts(5 * day), ts(5 * day + 60)]}))
    at = {1: -30 * day, 2: 2 * day, 3: 3 * day, 4: 5 * day + 30, 5: 5 * day + 31, 6: 40 * day}
    e = spark.createDataFrame(pd.DataFrame({"key": list(at), "symbol": "a", "at": [ts(s) for s in at.values()]}))
    assert {r["key"]: r["bar_idx"] for r in orders.nearest_bars(e, b, "key").collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2}
    assert orders.nearest_bars(e.withColumn("symbol", F.lit("other")), b, "key").first()["bar_idx"] is None
