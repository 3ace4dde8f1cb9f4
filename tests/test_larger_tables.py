"""What larger and odd tables brought up: forests without rows, replays in many files, long groups."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import learning, orders, similarity, templates
from tidemark.plans import stream_queries
from tidemark.streaming import holding


def test_forest_without_rows_or_a_second_label(spark):
    one = spark.createDataFrame([(0.1 * i, 0.2 * i, 1) for i in range(20)], "a double, b double, y int")
    for table in (one, one.where("y = 0")):
        found = learning.importances(table, ["a", "b"], "y", trees=3, depth=2)
        assert found.dtypes == [("feature", "string"), ("importance", "double")]
        assert [tuple(r) for r in found.collect()] == [("a", 0.0), ("b", 0.0)]
    both = learning.importances(one.selectExpr("a", "0 * b AS b", "int(a > 1) AS y"), ["a", "b"], "y", trees=3, depth=2)
    assert [tuple(r) for r in both.collect()] == [("a", pytest.approx(1.0)), ("b", 0.0)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_top_k_holds_few_pairs_and_ranks_copies_by_id(spark, monkeypatch, metric):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 13))
    rows = [(int(i), base[i % 40].tolist()) for i in r.permutation(400)]  # ten copies of each
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    def scored(a, b):
        x, y = base[a % 40], base[b % 40]
        if metric == "euclidean":
            return -float(np.add.accumulate((x - y) ** 2)[-1]) ** 0.5
        total = lambda p: float(np.add.accumulate(p)[-1])
        return max(-1.0, min(1.0, total(x * y) / (total(x * x) * total(y * y)) ** 0.5))

    want = [(a, b, n + 1) for a in range(0, 400, 7) for n, (_, b) in enumerate(sorted((-scored(a, b), b) for b in range(400) if b != a)[:12])]
    for slab in (similarity.SLAB, 500):
        monkeypatch.setattr(similarity, "SLAB", slab)
        got = similarity.top_k(v, v.where("vec_id % 7 = 0"), 12, metric).select("query_id", "id", "rank").collect()
        assert sorted(map(tuple, got), key=lambda x: (x[0], x[2])) == want


def test_top_k_in_a_task_stays_small():
    """4,096 queries against a batch of 10,000 vectors: no matrix of all their pairs."""
    import tracemalloc

    r = np.random.default_rng(5)
    q, v, ids = r.normal(size=(4096, 8)), r.normal(size=(10_000, 8)), np.arange(4096)
    tracemalloc.start()
    rows = list(similarity._nearest(ids, q, 5, "cosine", "vec_id", "embedding")(iter([_frame(v)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows[0]) == 4096 * 5 and peak < 64 << 20


def _frame(v):
    import pandas as pd

    return pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v)})


def test_nearest_bars_has_no_frame_to_the_end(spark):
    """Such a frame goes over the rest of its piece for each row of it."""
    r, start = random.Random(6), datetime(2024, 1, 1)
    bars = [(s, start + timedelta(hours=h), i) for s in "xy" for i, h in enumerate(sorted(r.sample(range(200), 60)))]
    events = [(i, r.choice("xyz"), start + timedelta(minutes=r.randrange(-3000, 15_000))) for i in range(400)]
    b = spark.createDataFrame(bars, "symbol string, ts timestamp, bar_idx long")
    found = orders.nearest_bars(spark.createDataFrame(events, "key long, symbol string, at timestamp"), b, "key")
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    want = {k: min(((abs(at - ts), ts, i) for s, ts, i in bars if s == symbol), default=(None, None, None))[2] for k, symbol, at in events}
    assert {x["key"]: x["bar_idx"] for x in found.collect()} == want


@pytest.mark.parametrize("least", [0.2, 0.98])
def test_apart_prototypes_in_rounds_equal_the_fold(spark, monkeypatch, least):
    """One group was one row, and its fold one task with the square of its length."""
    monkeypatch.setattr(templates, "ROUND", 16)
    monkeypatch.setattr(templates, "SLAB", 64)
    r = np.random.default_rng(7)
    base = r.normal(size=(60, 6))
    vectors = [base[i % 60] + r.normal(size=6) * (0 if i % 3 else 0.3) for i in range(240)]
    rows = [(i, i % 2, None if i % 4 else "R", v.tolist(), float(i % 5), i % 7, 1.0) for i, v in enumerate(vectors)]
    rows += [(900, 0, None, None, 9.0, 1, 1.0), (901, 0, None, [1.0, None], 9.0, 1, 1.0), (902, 0, None, [1.0, 2.0], 9.0, 1, 1.0), (903, 0, None, [2.0, 4.0], 9.0, 1, 1.0)]
    schema = "id long, direction int, regime string, v array<double>, confidence double, members long, avg_profit double"
    got = templates.apart_prototypes(spark.createDataFrame(rows, schema).repartition(3), "id", "v", least).collect()
    want = {}
    for key, d, regime, v, *_ in sorted(rows, key=lambda x: (-x[4], -x[5], -x[6], x[0])):
        whole = v is not None and None not in v
        for other in (o for o in want if want[o][:2] == (d, regime)) if whole else ():
            w = want[other][2]
            if w is not None and None not in w and len(w) == len(v) and np.dot(v, w) >= least * np.linalg.norm(v) * np.linalg.norm(w):
                want[other][3][0] += 1
                break
        else:
            want[key] = (d, regime, v, [0])
    assert {x["id"]: (x["direction"], x["regime"], x["absorbed"]) for x in got} == {k: (d, g, n[0]) for k, (d, g, _, n) in want.items()}
    assert len(got) == len(want) > 16 or least < 0.5


def test_apart_prototypes_of_none(spark):
    schema = "id long, direction int, regime string, v array<double>, confidence double, members long, avg_profit double"
    assert templates.apart_prototypes(spark.createDataFrame([], schema), "id", "v").collect() == []


def test_replay_of_many_files_loses_no_row(spark):
    """A batch of 16 files was part of a slice of 40, or reached the end of a shorter log: the watermark
    then went over rows still to come."""
    start, hours = datetime(2024, 1, 1), 30 * 24
    bars = [(s, start + timedelta(hours=h), h, [float(h % 7), 1.0]) for s in "xy" for h in range(hours)]
    held = [(s, f"{s}{h}", h, h + 6) for s in "xy" for h in range(24, hours - 48, 30)]
    opened = [(s, start + timedelta(hours=a), a, i, [[1.0, 1.0]] * 5) for s, i, a, _ in held]
    closed = [(s, start + timedelta(hours=z), z, i) for s, i, _, z in held]
    logs = [
        spark.createDataFrame(bars, "symbol string, ts timestamp, bar_idx long, v array<double>").repartition(40),
        spark.createDataFrame(opened, "symbol string, ts timestamp, bar_idx long, id string, template array<array<double>>").coalesce(1),
        spark.createDataFrame(closed, "symbol string, ts timestamp, bar_idx long, id string").coalesce(1),
    ]
    found = stream_queries.finished(holding.divergences(*stream_queries.replayed(*logs), shards=2))
    got = sorted((r["id"], r["bar_idx"]) for r in found.collect())
    assert got == sorted((i, h) for _, i, a, z in held for h in range(a, z + 1))


@pytest.mark.parametrize("finish_turn", [False, True])
def test_merged_prototypes_of_a_large_group(spark, finish_turn):
    """600 prototypes of one group, many at the edge of being near, against a loop over all pairs."""
    r = np.random.default_rng(11)
    v = np.repeat(r.normal(size=(60, 4)), 10, axis=0) + r.normal(size=(600, 4)) * 0.15
    v[::50], v[7::50] = 0.0, v[6::50]
    n, sure = r.integers(0, 9, 600).tolist(), r.integers(0, 10, 600) / 10
    rows = [(i, "LONG", "A", v[i].tolist(), n[i], n[i] // 2, float(n[i] * (i % 3)), float(sure[i])) for i in range(600)]
    kinds = "proto_id long, direction string, regime string, v array<double>, members long, wins long, total_profit double, confidence double"
    found = templates.merged_prototypes(spark.createDataFrame(rows, kinds).repartition(3), 0.98, finish_turn).collect()

    members, total = list(n), [x[6] for x in rows]
    mean, into, gone = [t / m if m else 0.0 for t, m in zip(total, members, strict=True)], [[] for _ in rows], set()
    for i in range(600):
        for j in range(i + 1, 600 if i not in gone else 0):
            norm = np.linalg.norm(v[i]) * np.linalg.norm(v[j])
            if j in gone or not norm or v[i] @ v[j] / norm < 0.98:
                continue
            better = sure[i] >= sure[j] if abs(sure[i] - sure[j]) > 0.1 else (members[i], mean[i]) >= (members[j], mean[j])
            stays, goes = (i, j) if better else (j, i)
            gone.add(goes)
            members[stays], total[stays] = members[stays] + members[goes], total[stays] + total[goes]
            mean[stays] = total[stays] / members[stays] if members[stays] else mean[stays]
            into[stays] += [goes, *into[goes]]
            if goes == i and not finish_turn:
                break
    assert 200 < len(gone) < 590
    assert {x["proto_id"]: (x["members"], x["total_profit"], x["merged"]) for x in found} == {i: (members[i], total[i], sorted(into[i])) for i in range(600) if i not in gone}


def test_merged_prototypes_keeps_every_trade(spark):
    """The registered query, on the smallest tables: what it merges adds up to all templates."""
    from pyspark.sql import functions as F

    from tidemark.plans import template_queries

    found, per = template_queries.merged_prototypes(spark, "/root/testdata/sf0.001"), ["direction", "regime"]
    sums = found.groupBy(*per).agg(F.sum("members"), F.sum("wins"), F.round(F.sum("total_profit"), 3), F.sum(F.size(F.expr("filter(split(merged, ','), x -> x != '')")) + 1))
    t = template_queries.templates(spark, "/root/testdata/sf0.001")
    want = t.groupBy(*per).agg(F.count("*"), F.sum((F.col("profit_pct") > 1).cast("long")), F.round(F.sum("profit_pct"), 3), F.countDistinct("symbol", F.col("entry_idx") % 6))
    got = sorted(map(tuple, sums.collect()))
    assert got and got == sorted(map(tuple, want.collect()))
