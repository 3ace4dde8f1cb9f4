"""The driver's contract, and the queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["bar_files", "exit_advice", "label_backtest", "pool_metrics", "premium_pool", "pruned_combos", "signal_backtest", "template_prototypes", "threshold_steps", "zigzag_points", "bars_from_ticks", "moving_averages", "outcomes_long", "signal_hit_rate", "swing_points", "trade_statistics", "regime_statistics", "gate_scores", "cosine_top_k", "fill_aggregation", "live_streaks"]


def test_contract():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(catalog.QUERIES) > 50
    assert all(callable(f) for f in queries.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in columns]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert a == b


def test_forest_is_that_of_the_operator(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(catalog, "bars", lambda spark, sf_dir: spark.range(0).selectExpr("'a' AS symbol", "id AS bar_idx", "timestamp_seconds(id) AS ts", *[f"0D AS {c}" for c in catalog.OHLCV]))
    monkeypatch.setattr(catalog.learn, "importances", lambda table, names, label, **kw: asked.update(table=table, names=names, kw=kw))
    catalog.QUERIES["feature_importance"](spark, SF)
    assert len(asked["names"]) == 44 and set(asked["names"]) < set(asked["table"].columns) and asked["kw"] == {}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_trajectories_end_at_every_bar(spark):
    table = catalog.ind.window_indicators(catalog.bars(spark, SF)).where("bar_idx >= 20").selectExpr("symbol", "bar_idx", "rsi / 100 AS a", "boll_position AS b", "volume_ratio AS c").toPandas()
    want = set()
    for symbol, g in table.sort_values("bar_idx").groupby("symbol"):
        x, idx = g[["a", "b", "c"]].to_numpy(float), g["bar_idx"].tolist()
        d = [(min(1.0, catalog.sim.dtw(x[:20], x[i - 19 : i + 1]) / (20 * 3**0.5 * 2)), idx[i]) for i in range(20, len(x))]
        want |= {(symbol, i, n + 1, round(v, 9)) for n, (v, i) in enumerate(sorted(d)[:10])}
    got = {(r["symbol"], r["bar_idx"], r["rank"], round(r["dtw"], 9)) for r in catalog.QUERIES["trajectory_dtw"](spark, SF).collect()}
    assert got == want and any(i % 20 != 19 for _, i, _, _ in got)
