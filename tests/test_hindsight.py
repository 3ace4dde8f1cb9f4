"""Quantiles and histograms against numpy, exits in hindsight against plain loops, dated weights."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distributions, hindsight, outlook, weights

SHARES = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def groups():
    r = np.random.default_rng(5)
    return {
        "hot": r.normal(0, 3, 4000).tolist(),
        "ties": r.integers(0, 3, 1500).astype(float).tolist(),
        "wide": [-1.7e308, 1.7e308, *np.exp(r.normal(0, 20, 900)).tolist()],
        "same": [2.5] * 700,
        "one": [-0.25],
        None: [1.0, 4.0, 2.0],
    }


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(k, x, "extra") for k, v in groups.items() for x in v]
    rows += [("hot", None, ""), ("hot", math.nan, ""), ("hot", math.inf, ""), ("none", None, "")]
    return spark.createDataFrame(rows, "name string, y double, x string").repartition(3)


@pytest.mark.parametrize("bins, sorted_rows", [(16, 20), (4096, 65536)])
def test_quantiles_equal_numpy(table, groups, bins, sorted_rows):
    got = {(r["name"], r["share"]): r["value"] for r in distributions.quantiles(table, ["name"], "y", SHARES, bins, sorted_rows).collect()}
    assert set(got) == {(k, s) for k in groups for s in SHARES}
    for (k, s), value in got.items():
        v, at = sorted(groups[k]), (len(groups[k]) - 1) * s
        low, high = v[math.floor(at)], v[math.ceil(at)]
        assert value == pytest.approx(low + (at - math.floor(at)) * (high - low), rel=1e-12, abs=1e-12)


def test_histograms_equal_numpy(table, groups):
    got = distributions.histograms(table.where("name <> 'wide' OR name IS NULL"), ["name"], "y").orderBy("bin").collect()
    for k, v in groups.items():
        if k != "wide":
            mine = [r for r in got if r["name"] == k]
            counts, edges = np.histogram(v, 20)
            assert [r["n"] for r in mine] == counts.tolist() and np.allclose([r["low"] for r in mine] + [mine[-1]["high"]], edges)
    assert {r["name"] for r in got} == set(groups) - {"wide"}


def test_distributions_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "name string, y double")
    assert distributions.quantiles(empty, ["name"], "y", SHARES).count() == 0 and distributions.histograms(empty, ["name"], "y").count() == 0


def test_other_exits_equal_plain_loops_over_pieces(spark):
    """A series of more than one piece, with trades at its seams and its end."""
    r = np.random.default_rng(8)
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.004, 4400)))
    high, low = close * (1 + r.random(4400) * 0.003), close * (1 - r.random(4400) * 0.003)
    bars = spark.createDataFrame([("s", i, float(high[i]), float(low[i]), float(close[i])) for i in range(4400)], "symbol string, bar_idx long, high double, low double, close double")
    made = []
    for i, (a, b) in enumerate([(0, 5), (4000, 4050), (4090, 4095), (4095, 4096), (4200, 4390), (4300, 4399), *[(int(x), int(x) + 20) for x in r.integers(0, 4300, 60)]]):
        way = 1 if i % 2 else -1
        made.append(("s", a, b, "long" if way > 0 else "short", float(close[a]), float(close[b]), float(way * (close[b] - close[a]) / close[a] * 100)))
    schema = "symbol string, entry_idx long, exit_idx long, side string, entry_price double, exit_price double, profit_pct double"
    trades = spark.createDataFrame([*made, made[0], ("s", None, 3, "long", 1.0, 1.0, 0.0)], schema)
    horizons = (1, 7, 64, 200)
    got = {(x["entry_idx"], x["exit_idx"], x["side"], x["horizon"]): x for x in hindsight.other_exits(trades, bars, horizons).collect()}
    assert len(got) == len(set(made)) * len(horizons)
    flags = set()
    for _, a, b, side, first, out, profit in made:
        way = 1 if side == "long" else -1
        for h in horizons:
            x, span = got[a, b, side, h], slice(b + 1, b + 1 + h)
            gain = lambda p: way * (p - first) / first * 100  # noqa: B023, E731
            if b + 1 >= 4400:
                assert (x["best"], x["worst"], x["held"], x["mean_after"], x["premature"]) == (None, None, None, None, False)
                continue
            top, bottom = high[span].max(), low[span].min()
            best = gain(top if way > 0 else bottom)
            assert x["best"] == pytest.approx(best) and x["worst"] == pytest.approx(gain(bottom if way > 0 else top))
            assert x["premature"] == (best > profit + 1.0)
            if b + h < 4400:
                mean = close[span].mean()
                assert x["held"] == pytest.approx(gain(close[b + h])) and x["mean_after"] == pytest.approx(mean)
                assert x["too_tight"] == (profit <= 0 and way * (mean - out) > out * 0.01)
                flags.add((x["premature"], x["too_tight"]))
            else:
                assert x["held"] is None and x["mean_after"] is None and not x["too_tight"]
    assert flags == {(True, True), (True, False), (False, False)}


def test_group_weights_reach_each_feature_once():
    places = sorted(i for members, _ in weights.GROUPS.values() for i in members)
    assert places == list(range(32)) and weights.group_of_feature()[:4] == ["rsi", "rsi", "macd", "momentum"]


def test_dated_weights(spark):
    rows = [("long", 10, "rsi", 3.0), ("long", 10, "adx", -1.0), ("long", 10, "other", 9.0), ("long", 5000, "macd", None), ("short", 20, "rsi", 1.0), ("short", 20, "rsi", 2.0)]
    versions = spark.createDataFrame(rows, "direction string, valid_from long, group string, weight double")
    got = {(r["direction"], r["valid_from"]): np.array(r["weights"]) for r in weights.expanded(versions).collect()}
    base = np.array([weights.GROUPS[g][1] for g in weights.group_of_feature()])

    def stated(**given):
        w = base.copy()
        for name, value in given.items():
            w[list(weights.GROUPS[name][0])] = value
        w = np.maximum(w, 0.01)
        return w / w.mean()

    assert np.allclose(got["long", 10], stated(rsi=3.0, adx=0.01)) and np.allclose(got["long", 5000], stated()) and np.allclose(got["short", 20], stated(rsi=2.0))
    times = spark.createDataFrame([(t,) for t in (9, 10, 11, 4999, 5000, 90000, 90000, None)], "at long")
    valid = {(r["direction"], r["at"]): r["valid_from"] for r in weights.valid_versions(times, versions, chunk=16).collect()}
    want = {9: (None, None), 10: (10, None), 11: (10, None), 4999: (10, 20), 5000: (5000, 20), 90000: (5000, 20)}
    assert valid == {(d, t): v[i] for t, v in want.items() for i, d in enumerate(("long", "short"))}
    v = np.random.default_rng(1).normal(size=(3, 32))
    vectors = spark.createDataFrame([("s", i, t, v[i].tolist()) for i, t in enumerate((9, 30, 6000))], "symbol string, bar_idx long, at long, v array<double>")
    scored = {(r["bar_idx"], r["direction"]): r["score"] for r in weights.scores(vectors, versions).collect()}
    assert scored[0, "long"] == pytest.approx(v[0] @ stated() / 32) and scored[1, "short"] == pytest.approx(v[1] @ stated(rsi=2.0) / 32)
    assert scored[1, "long"] == pytest.approx(v[1] @ stated(rsi=3.0, adx=0.01) / 32) and scored[2, "long"] == pytest.approx(v[2] @ stated() / 32)
    assert weights.valid_versions(times.where(F.lit(False)), versions).count() == 0


def plain_prices(close, highs, lows, atrs, rows):
    """One step after another, in plain numbers."""
    known = [x for x in atrs if x is not None and math.isfinite(x)]
    atr = float(np.median(known)) if known else 0.0
    if atr <= 0:
        atr = max((max(highs) - min(lows)) / len(highs), close * 0.001)
    out, highs, lows = [], list(highs), list(lows)
    for c0, c1, c2, c4, c5 in [[x or 0.0 for x in r] for r in rows]:
        hi, lo = max(highs), min(lows)
        width = max(hi - lo, close * 0.0005, 1e-6)
        unit = [min(1.0, max(0.0, c)) for c in (c0, c4, c5)]
        goal = np.dot([0.42, 0.22, 0.22, 0.07, 0.07], [lo + unit[0] * width, hi - max(0, c1) * atr, lo + max(0, c2) * atr, hi - (1 - unit[1]) * width, lo + (1 - unit[2]) * width])
        most = max(close * 0.01, 2.5 * atr)
        close += 0.65 * min(most, max(-most, goal - close))
        out.append(close)
        highs, lows = (highs + [close])[-20:], (lows + [close])[-20:]
    return out


def test_prices_ahead_equal_plain_loops(spark):
    r = np.random.default_rng(3)
    cases = []
    for n, steps in ((20, 5), (20, 30), (3, 5), (1, 2), (20, 0)):
        lows = (100 + r.random(n)).tolist()
        atrs = [None if x < 0.2 else math.nan if x < 0.3 else float(x) for x in r.random(n)]
        cases.append((float(lows[-1]), [x + 1 for x in lows], lows, atrs, [tuple(map(float, r.normal(0.5, 1, 5))) for _ in range(steps)]))
    cases.append((50.0, [50.0], [50.0], [None], [(None, 0.0, 9.0, None, 2.0)] * 3))
    row = "array<struct<c0: double, c1: double, c2: double, c4: double, c5: double>>"
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, close double, highs array<double>, lows array<double>, atrs array<double>, rows {row}")
    got = {x["i"]: x["p"] for x in df.select("i", outlook.prices_ahead("close", "highs", "lows", "atrs", "rows").alias("p")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == pytest.approx(plain_prices(*c), rel=1e-12)


def test_future_prices_over_the_seam_of_two_pieces(spark):
    r = np.random.default_rng(6)
    close = 100 + np.cumsum(r.normal(0, 0.2, 4200))
    rows = [("s", i, float(c + 0.3), float(c - 0.3), float(c), None if i < 13 else 0.4, *map(float, r.random(5))) for i, c in enumerate(close)]
    table = spark.createDataFrame(rows, "symbol string, bar_idx long, high double, low double, close double, atr double, c0 double, c1 double, c2 double, c4 double, c5 double")
    got = {(x["bar_idx"], x["step"]): x["price"] for x in outlook.future_prices(table).collect()}
    assert len(got) == 5 * 4200 - 15
    for i in (0, 5, 4090, 4093, 4095, 4096, 4110, 4197):
        past = rows[max(0, i - 19) : i + 1]
        want = plain_prices(rows[i][4], [x[2] for x in past], [x[3] for x in past], [x[5] for x in past], [x[6:] for x in rows[i + 1 : i + 6]])
        assert [got[i, s + 1] for s in range(len(want))] == pytest.approx(want)
    assert outlook.future_prices(table.limit(0)).count() == 0


def test_members_depend_on_seed_key_and_draw_alone(spark):
    rows = [("a", 12, 0.5, 2.0, 10.0), ("b", 90, 1.0, -1.0, 1.0), ("c", 2, 0.5, 1.0, 5.0), ("d", 3, 0.0, 1.5, 8.0), ("e", 9, None, 1.0, 4.0), (None, 9, 0.5, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "key string, member_count long, win_rate double, avg_profit_pct double, avg_hold double")
    got = sorted(map(tuple, outlook.synthesised_members(df, 3).collect()))
    assert got == sorted(map(tuple, outlook.synthesised_members(df.repartition(7), 3).collect())) and got != sorted(map(tuple, outlook.synthesised_members(df, 4).collect()))
    drawn = lambda key, i: int(hashlib.md5(f"3:{key}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    want = []
    for key, count, rate, profit, hold in (rows[0], rows[1], rows[3]):
        for m in range(min(30, max(5, count))):
            t, u, v = (drawn(key, 3 * m + i) for i in range(3))
            want.append((key, m, t < rate, profit * (0.5 + u) if t < rate else -abs(profit) * (0.2 + u * 0.5), max(2, int(hold * (0.4 + v * 1.2)))))
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])
