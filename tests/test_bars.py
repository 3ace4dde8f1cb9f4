"""Windows, indicators, outcomes and walks against plain pandas and Python."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows
from tidemark.operators import backtests, features, indicators, recurrences, signals, similarity, store, studies, swings, tracking
from tidemark.sources import bars as src


@pytest.fixture(scope="module")
def series():
    r = np.random.default_rng(42)
    parts = []
    for s in ("a", "b"):
        n = 300
        close = 100 * np.exp(np.cumsum(r.normal(0, 0.003, n)))
        opened = np.concatenate([[100.0], close[:-1]])
        high, low = np.maximum(opened, close) * (1 + abs(r.normal(0, 0.001, n))), np.minimum(opened, close) * (1 - abs(r.normal(0, 0.001, n)))
        parts.append(pd.DataFrame({"symbol": s, "bar_idx": np.arange(n), "open": opened, "high": high, "low": low, "close": close, "volume": r.integers(1, 100, n).astype(float)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def table(spark, series):
    df = spark.createDataFrame(series).withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 60))
    return indicators.indicators(df).cache()


def test_ewm_over_pieces_equals_the_recurrence(spark, series):
    for chunk, reach, tolerance in ((4096, 512, 1e-12), (64, 64, 1e-2)):
        held = windows.with_halo(spark.createDataFrame(series), min(reach, chunk), chunk=chunk)
        for step in windows.ewm({"e": ("close", 2 / 27, 0), "f": ("close", 1 / 3, 0)}, reach):
            held = held.selectExpr("*", *[f"{x} AS {n}" for n, x in step.items()])
        got = windows.only_own(held).toPandas().sort_values(["symbol", "bar_idx"])
        for s, g in series.groupby("symbol"):
            mine = got[got["symbol"] == s]
            np.testing.assert_allclose(mine["e"], g["close"].ewm(span=26, adjust=False).mean(), rtol=tolerance)
            np.testing.assert_allclose(mine["f"], g["close"].ewm(com=2, adjust=False).mean(), rtol=max(1e-10, tolerance / 1e9))


def test_running_sums_cross_pieces(spark, series):
    held = windows.with_halo(spark.createDataFrame(series), 20, chunk=32)
    got = windows.running(held, {"s": ("sum", "volume"), "m": ("max", "high")})
    lagged = windows.only_own(got.selectExpr("*", windows.lag("s", 15) + " AS s15")).toPandas().sort_values(["symbol", "bar_idx"])
    for s, g in series.groupby("symbol"):
        mine = lagged[lagged["symbol"] == s]
        np.testing.assert_allclose(mine["s"], g["volume"].cumsum())
        np.testing.assert_allclose(mine["m"], g["high"].cummax())
        np.testing.assert_allclose(mine["s15"].iloc[15:], g["volume"].cumsum().iloc[:-15])


def test_indicators_do_not_depend_on_pieces(spark, series, monkeypatch):
    """A long series in short pieces (the averages' reach is kept) is that of one piece."""
    long = pd.concat([series[series["symbol"] == "a"].assign(bar_idx=lambda d, k=k: d["bar_idx"] + 300 * k) for k in range(12)]).reset_index(drop=True)
    df = spark.createDataFrame(long).withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 60))
    names = indicators.NAMES
    whole = indicators.indicators(df).select("bar_idx", *names).toPandas().sort_values("bar_idx")
    monkeypatch.setattr(windows.with_halo, "__defaults__", (windows.HALO, 0, 1024))
    pieces = indicators.indicators(df).select("bar_idx", *names).toPandas().sort_values("bar_idx")
    np.testing.assert_allclose(pieces[names].astype(float), whole[names].astype(float), rtol=1e-9, atol=1e-9)


def test_longer_timeframes(spark, table, series):
    """The eight features of two longer timeframes against pandas over the aggregated indicator table."""
    df = spark.createDataFrame(series).withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 60))
    got = features.multi_timeframe(df, table, 3, 6).toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    base = table.toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    assert list(got.columns[2:]) == list(features.LONGER)
    for s in ("a", "b"):
        mine, own, at = got[got["symbol"] == s], base[base["symbol"] == s], {}
        for k in (3, 6):
            t = indicators.indicators(src.aggregate_bars(df, k)).where(F.col("symbol") == s).toPandas().sort_values("bar_idx").reset_index(drop=True)
            place = np.minimum(own["bar_idx"].to_numpy() // k, len(t) - 1)
            trend, force = np.tanh((t["ema12"] - t["ema26"]) / (t["ema26"] + 1e-9) * 100), (t["rsi"] - 50) / 50
            ma = t["atr"].rolling(20).mean()
            slope = np.tanh((t["ema12"] - t["ema12"].shift(3)) / (t["ema12"].shift(3) + 1e-9) * 100)
            at[k] = [x.fillna(0).to_numpy()[place] for x in (trend, force, slope, np.tanh((t["atr"] - ma) / (ma + 1e-9)))]
        own_trend, own_force = np.sign(own["ema12"] - own["ema26"]).to_numpy(), np.sign(own["rsi"].astype(float) - 50).to_numpy()
        align = lambda o, x, y: (o == np.sign(x)) * 1.0 + (o == np.sign(y)) - 1
        want = [*at[3], *at[6][:2], align(own_trend, at[3][0], at[6][0]), align(own_force, at[3][1], at[6][1])]
        for name, x in zip(features.LONGER, want):
            np.testing.assert_allclose(mine[name].to_numpy(), x, atol=1e-9, err_msg=name)
    whole = features.all_features(df, table, 3, 6)
    assert len(whole.columns) == 54 and whole.count() == 600
    labels = df.selectExpr("symbol", "bar_idx", "cast(bar_idx % 100 = 7 as int) AS label")
    assert features.at_labels(whole, labels).count() == 6


def test_halo_gives_windows_over_whole_series(spark, series):
    held = windows.with_halo(spark.createDataFrame(series), 10, 3, chunk=16)
    out = windows.only_own(held.selectExpr("*", windows.roll("avg", "close", 10) + " AS m", windows.lead("close", 2) + " AS l")).toPandas().sort_values(["symbol", "bar_idx"])
    assert len(out) == len(series)
    for s, g in series.groupby("symbol"):
        mine = out[out["symbol"] == s].reset_index(drop=True)
        np.testing.assert_allclose(mine["m"], g["close"].rolling(10).mean())
        np.testing.assert_allclose(mine["l"], g["close"].shift(-2))


def test_indicators_against_pandas(table, series):
    got = table.toPandas().sort_values(["symbol", "bar_idx"])
    for s, g in series.groupby("symbol"):
        g, mine = g.reset_index(drop=True), got[got["symbol"] == s].reset_index(drop=True)
        c, d = g["close"], g["close"].diff()
        up, down = d.clip(lower=0).fillna(0).rolling(14).mean(), (-d).clip(lower=0).fillna(0).rolling(14).mean()
        np.testing.assert_allclose(mine["rsi"], 100 - 100 / (1 + up / (down + 1e-9)), rtol=1e-9)
        assert mine["rsi"].first_valid_index() == 13 and mine["adx"].first_valid_index() == 26 and mine["obv"].first_valid_index() == 1
        std = c.rolling(20).std()
        np.testing.assert_allclose(mine["boll_width"], 4 * std / (c.rolling(20).mean() + 1e-9), rtol=1e-7)
        macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
        np.testing.assert_allclose(mine["macd_hist"], macd - macd.ewm(span=9, adjust=False).mean(), atol=1e-10)
        low, high = g["low"].rolling(9).min(), g["high"].rolling(9).max()
        k = ((c - low) / (high - low + 1e-9) * 100).ewm(com=2, adjust=False).mean()
        np.testing.assert_allclose(mine["j"], 3 * k - 2 * k.ewm(com=2, adjust=False).mean(), rtol=1e-9, equal_nan=True)
        np.testing.assert_allclose(mine["obv"], (g["volume"] * np.sign(d)).cumsum(), equal_nan=True)
        direction = np.sign(c - g["open"])
        runs = direction.groupby((direction != direction.shift()).cumsum()).cumcount() + 1
        np.testing.assert_allclose(mine["trend_count"], runs * direction)


def test_features_are_bounded_and_complete(table):
    got = features.features(table).toPandas()
    values = got.drop(columns=["symbol", "bar_idx"])
    assert values.shape[1] == 44 and values.notna().all().all() and (values.abs() <= 1).all().all()
    layered = features.layers(table)
    assert len(layered.columns) == 34 and features.coordinates(layered).count() == layered.count()


@pytest.mark.parametrize("direction", ["long", "short"])
def test_outcomes_against_a_loop(table, direction):
    got = signals.outcomes(table, direction).toPandas().sort_values(["symbol", "bar_idx"])
    tp, sl = signals.TAKE_PROFIT[direction], signals.STOP_LOSS[direction]
    for _, g in got.groupby("symbol"):
        g = g.reset_index(drop=True)
        for i in range(len(g)):
            want = (False, -1)
            if i + 1 < len(g):
                entry, atr = g["open"][i + 1], g["atr"][i]
                if not (atr > 0 and (atr / entry < 0.0004 or atr / entry > sl * 1.5)):
                    for j in range(i + 1, min(i + 61, len(g))):
                        win = g["high"][j] >= entry * (1 + tp) if direction == "long" else g["low"][j] <= entry * (1 - tp)
                        lose = g["low"][j] <= entry * (1 - sl) if direction == "long" else g["high"][j] >= entry * (1 + sl)
                        if win or lose:
                            want = (win and not lose, j - i - 1)
                            break
            assert (g["outcome"][i], g["hold"][i]) == want


def test_conditions_are_thirty_and_never_null(table):
    for direction in ("long", "short"):
        names = list(signals.conditions(direction))
        assert len(names) == 30
        got = signals.with_conditions(table, direction).select(*names, "mask").toPandas()
        assert got.notna().all().all()
        assert (sum((got[n].astype(int) * (1 << i) for i, n in enumerate(names))) == got["mask"]).all()
    assert all(len({signals.family(n) for n in c}) == 2 for c in signals.combos("long", 2))


def test_mining_counts_masks(table):
    marked = signals.outcomes(signals.with_conditions(table, "long"), "long").cache()
    pdf = marked.toPandas()
    for r in signals.mine(marked, "long", 2).limit(20).collect():
        a, b = r["combo"].split("+")
        hit = pdf[pdf[a] & pdf[b]]
        assert (r["triggers"], r["hits"]) == (len(hit), int(hit["outcome"].sum()))


def test_zigzag_alternates_and_best_trades_do_not_overlap(spark, table):
    z = recurrences.zigzag(table).toPandas().sort_values(["symbol", "bar_idx"])
    for _, g in z.groupby("symbol"):
        assert (g["is_high"].astype(int).diff().dropna() != 0).all()
    r = np.random.default_rng(1)
    rows = [("x", int(a), int(a + b), float(p)) for a, b, p in zip(r.integers(0, 40, 12), r.integers(1, 12, 12), r.integers(1, 20, 12))]
    got = recurrences.best_trades(spark.createDataFrame(rows, "k string, entry_idx long, exit_idx long, profit double"), "k").collect()
    best = 0.0
    for m in range(1 << 12):
        pick = sorted((rows[i][1], rows[i][2], rows[i][3]) for i in range(12) if m >> i & 1)
        if all(p[1] < q[0] for p, q in zip(pick, pick[1:])):
            best = max(best, sum(p[2] for p in pick))
    assert sum(g["profit"] for g in got) == best


def plain_zigzag(high, low, close, need, wide):
    """Turns of one series, read twice: once for the start, once for the walk."""
    n = len(close)
    if n < 24:
        return []
    start = next((i for i in range(14, min(64, n)) if wide[i]), None)
    up = start is None or close[start] > close[start - 1]
    at, price = (14, close[14]) if start is None else (start, high[start] if up else low[start])
    turns = []
    for i in range(at + 1, n):
        if (low[i] < price - need[i]) if up else (high[i] > price + need[i]):
            turns.append((at, up))
            at, price, up = i, low[i] if up else high[i], not up
        elif (high[i] > price) if up else (low[i] < price):
            at, price = i, high[i] if up else low[i]
    return turns + ([(at, up)] if at < n - 1 else [])


@pytest.mark.parametrize("spread", [0.0005, 0.05])
def test_walks_carry_their_state_over_long_series(spark, spread):
    r = np.random.default_rng(6)
    n = 9000
    close = 100 * np.exp(np.cumsum(r.normal(0, 0.001, n)))
    opened = np.concatenate([[100.0], close[:-1]])
    high, low = np.maximum(opened, close) * (1 + spread), np.minimum(opened, close) * (1 - spread)
    atr = close * 0.02
    signal = np.where(np.arange(n) % 45 == 5, 1, np.where(np.arange(n) % 45 == 25, -1, 0))
    b = pd.DataFrame({"symbol": "a", "bar_idx": np.arange(n), "open": opened, "high": high, "low": low, "close": close, "atr": atr, "signal": signal})
    df = spark.createDataFrame(pd.concat([b, *[b.head(k).assign(symbol=f"b{k}") for k in (700, 23, 40, 1)]])).repartition(5, "bar_idx")
    got = recurrences.zigzag(df).toPandas().sort_values("bar_idx")
    for symbol, k in (("a", n), ("b700", 700), ("b23", 23), ("b40", 40), ("b1", 1)):
        own = got[got["symbol"] == symbol]
        assert list(zip(own["bar_idx"], own["is_high"])) == plain_zigzag(high[:k], low[:k], close[:k], (2 * atr)[:k], (high - low > 2 * atr)[:k])
    far = backtests.Rules(target=0.5, stop=0.5, lift_at=1e9)
    trades = backtests.on_signals(df, far).toPandas().sort_values(["symbol", "entry_idx"])
    own = trades[trades["symbol"] == "a"]
    # Far targets: each position is turned by the opposite signal, and only the last bar closes one.
    assert own["entry_idx"].tolist() == [i for i in range(n) if signal[i]] and own["exit_idx"].tolist() == [*own["entry_idx"].tolist()[1:], n - 1]
    assert (own["reason"].iloc[:-1] == "signal").all() and trades[trades["symbol"] == "b700"]["exit_idx"].max() == 699


def test_swings_and_trades(table):
    points = swings.alternating(swings.swing_points(table)).toPandas().sort_values(["symbol", "bar_idx"])
    for _, g in points.groupby("symbol"):
        assert (g["is_high"].astype(int).diff().dropna() != 0).all()


def test_similarity_identities(spark):
    a = np.random.default_rng(0).normal(size=(60, 4))
    assert similarity.dtw(a, a) < 1e-9
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["id"]: r["score"] for r in similarity.top_k(v, v.where("vec_id = 1"), 3).collect()}
    assert got == pytest.approx({2: 1.0, 3: 0.0, 4: -1.0}, abs=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_top_k_goes_over_queries_in_blocks(spark, monkeypatch, metric):
    r = np.random.default_rng(8)
    v = spark.createDataFrame([(i, r.normal(size=5).tolist()) for i in range(90)], "vec_id long, embedding array<double>").repartition(3)
    want = sorted(map(tuple, similarity.top_k(v, v.where("vec_id % 3 = 0"), 4, metric).collect()))
    monkeypatch.setattr(similarity, "MAX_QUERIES", 7)
    got = sorted(map(tuple, similarity.top_k(v, v.where("vec_id % 3 = 0"), 4, metric).collect()))
    assert len(want) == 120 and [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want]
    np.testing.assert_allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-9)


def test_steps_and_streaks(spark):
    df = spark.createDataFrame([(-30.0, "loosen"), (0.4, "tighten"), (-50.0, "loosen"), (0.4, "keep")], "v double, a string")
    assert [r["next"] for r in tracking.bounded_step(df, "v", "a", 5.0, -50.0, 100.0).collect()] == [-35.0, 5.4, None, None]
    t = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False)], "key string, t int, won boolean")
    assert {r["key"]: (r["total"], r["wins"], r["loss_streak"]) for r in store.live_streak(t).collect()} == {"a": (3, 1, 2), "b": (1, 0, 1)}


def test_standardised_columns(spark):
    df = spark.createDataFrame([("1", "x", "3")], "Open string, High string, open_time string")
    got = src.standardise(df).first().asDict()
    assert got == {"open": 1.0, "high": None, "timestamp": "3"}


def test_latched_states_are_carried_over_pieces(spark):
    r = np.random.default_rng(3)
    states = r.choice(["BULL", "BEAR", "RANGE"], 200).tolist()
    states[40:150] = ["BULL", "BEAR", "RANGE"] * 36 + ["BULL", "BEAR"]  # nothing twice for pieces on end
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(states)], "symbol string, bar_idx long, state string")
    got, now = {x["bar_idx"]: x["latched"] for x in studies.latched(df, chunk=16).collect()}, "RANGE"
    for i, s in enumerate(states):
        now = s if i and states[i - 1] == s else now
        assert got[i] == now


def test_open_bars_and_buffers(spark, tmp_path):
    from tidemark.streaming import feed

    t = "symbol string, ts timestamp, close double, seq long"
    at = [datetime.datetime(2024, 1, 1, 0, i) for i in range(40)]
    closed = spark.createDataFrame([("a", at[0], 1.0, 1), ("a", at[1], 2.0, 5)], t)
    live = spark.createDataFrame([("a", at[1], 9.0, 9), ("a", at[2], 3.0, 1), ("a", at[2], 4.0, 2)], t)
    assert [(r["close"], r["is_closed"]) for r in feed.overlaid(closed, live).orderBy("ts").collect()] == [(1.0, True), (2.0, True), (4.0, False)]
    closes = np.random.default_rng(1).random(40) + 1
    spark.createDataFrame([("a", at[i], float(closes[i])) for i in range(40)], "symbol string, ts timestamp, close double").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = feed.buffered_features(spark.readStream.schema("symbol string, ts timestamp, close double").parquet(str(tmp_path / "in")), rows=25)
    out.writeStream.format("memory").queryName("buffered").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got, move = spark.table("buffered").first(), np.diff(closes)[-14:]
    assert got["bars"] == 40 and got["ma5"] == pytest.approx(closes[-5:].mean()) and got["ma20"] == pytest.approx(closes[-20:].mean())
    assert got["rsi"] == pytest.approx(100 - 100 / (1 + move.clip(0).mean() / (-move.clip(max=0).mean() + 1e-9)))
    marked = spark.createDataFrame([("a", 0, 0b111), ("a", 1, 0b100)], "symbol string, bar_idx long, mask long")
    pool = spark.createDataFrame([("x+y", 0b011, 3), ("z", 0b100, 2), ("new", 0b001, 1)], "combo string, bits long, rounds int")
    assert sorted(map(tuple, feed.triggered(marked, pool).collect())) == [("a", 0, "x+y"), ("a", 0, "z"), ("a", 1, "z")]


def test_closed_bars_once_in_a_stream(spark, tmp_path):
    from tidemark.streaming import feed

    t = 1_700_000_000
    rows = [("a", t, 1.0, True), ("a", t, 1.0, True), ("a", t + 3600, 2.0, False), ("a", t + 3600, 2.5, True), ("b", t, 9.0, True)]
    df = spark.createDataFrame(rows, "symbol string, s long, close double, is_closed boolean").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    stream = feed.closed_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("closed_bars").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["symbol"], r["s"]) for r in spark.table("closed_bars").collect()) == [("a", t), ("a", t + 3600), ("b", t)]
