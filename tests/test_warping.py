"""Nearest references against a full scan, rows of held positions against whole matrices, pairs by lot."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.operators import similarity as sim
from tidemark.operators import warping
from tidemark.streaming import holding

WIDTH = 3
_MATRIX = "array<array<double>>"


def walk(r, steps):
    return r.normal(size=(steps, WIDTH)).cumsum(0)


@pytest.fixture(scope="module")
def matrices():
    r = np.random.default_rng(3)
    windows = {i: walk(r, 12 if i % 3 else 9) for i in range(25)}
    references = {f"r{i:02}": walk(r, int(n)) for i, n in enumerate(r.integers(7, 16, 60))}
    references["r07"] = references["r31"].copy()  # a tie
    references["r50"] = np.zeros((1, WIDTH))
    return windows, references


def tables(spark, windows, references):
    odd = [None, [], [[1.0, 2.0]], [[1.0, 2.0, None]], [[1.0, 2.0, math.nan]], [None]]
    w = [(i, x.tolist(), "w") for i, x in windows.items()] + [(100 + i, x, "w") for i, x in enumerate(odd)]
    r = [(i, y.tolist(), "LONG", 0.5, "r") for i, y in references.items()] + [(f"z{i}", y, "LONG", 0.5, "r") for i, y in enumerate(odd)]
    return spark.createDataFrame(w, f"query_id long, x {_MATRIX}, warped string").repartition(3), spark.createDataFrame(r, f"ref_id string, y {_MATRIX}, direction string, confidence double, x string")


@pytest.mark.parametrize("radius", [0, 4, 20])
def test_bounds_are_below_distances(matrices, radius):
    for x in matrices[0].values():
        for y in matrices[1].values():
            low, high = warping.envelope(y, len(x), radius)
            assert warping._bounds(x[None], [(low, high)])[0, 0] <= sim.dtw(x, y, radius) + 1e-9


@pytest.mark.parametrize("bytes_", [warping.REFERENCE_BYTES, 20_000, 1])
def test_nearest_equals_a_full_scan(spark, matrices, monkeypatch, bytes_):
    monkeypatch.setattr(warping, "REFERENCE_BYTES", bytes_ if bytes_ > 1 else 9_000)
    monkeypatch.setattr(warping, "STACK_BYTES", warping.STACK_BYTES if bytes_ > 1 else 2_000)
    windows, references = matrices
    got = warping.nearest(*tables(spark, windows, references), WIDTH, 3, 4).collect()
    want = {}
    for i, x in windows.items():
        near = sorted((sim.dtw(x, y, 4), r) for r, y in references.items())[:3]
        want |= {(i, n + 1): (r, pytest.approx(d, abs=1e-9)) for n, (d, r) in enumerate(near)}
    assert {(r["query_id"], r["rank"]): (r["ref_id"], r["distance"]) for r in got} == want
    assert all(3 <= r["warped"] <= len(references) for r in got)
    if bytes_ == warping.REFERENCE_BYTES:
        assert np.mean([r["warped"] for r in got]) < len(references)


def test_few_or_no_references(spark, matrices):
    windows, references = tables(spark, matrices[0], matrices[1])
    two = warping.nearest(windows, references.where("ref_id IN ('r01', 'r02')"), WIDTH, 3, 4)
    assert two.count() == 2 * len(matrices[0])
    for w, r in ((windows.limit(0), references), (windows, references.limit(0)), (windows.limit(0), references.limit(0))):
        none = warping.nearest(w, r, WIDTH)
        assert none.count() == 0 and none.columns == two.columns


def test_fused_scores(spark, matrices):
    windows, references = tables(spark, *matrices)
    near = warping.nearest(windows, references, WIDTH, 3, 4)
    scored = warping.fused(near, windows, references, WIDTH)
    for r in scored.collect():
        x, y = matrices[0][r["query_id"]], matrices[1][r["ref_id"]]
        a, b = x.mean(0), y.mean(0)
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        cosine = 0 if norm < 1e-9 else max(0, a @ b / norm)
        warped = 1 - min(1, sim.dtw(x, y, 4) / (max(len(x), len(y)) * math.sqrt(WIDTH) * 2))
        assert r["score"] == pytest.approx(0.5 * (0.3 * cosine + 0.4 * (1 - min(1, np.linalg.norm(a - b) / 200)) + 0.3 * warped))
    best = warping.best_scores(scored, references).collect()
    assert len(best) == len(matrices[0]) and {r["direction"] for r in best} == {"LONG"}


@pytest.mark.parametrize("radius", [0, 2, 5])
@pytest.mark.parametrize("held, known", [(14, 14), (20, 9), (6, 15), (1, 1)])
def test_rows_equal_every_prefix(radius, held, known):
    r = np.random.default_rng(held * known + radius)
    x, y = walk(r, held), walk(r, known)
    row = holding.first_row(radius)
    for n in range(1, min(held, known) + 1):
        row = holding.next_row(row, n, x[n - 1].tolist(), y.reshape(-1).tolist())
        assert row[radius] == pytest.approx(sim.dtw(x[:n], y[:n], radius))


def test_held_positions_as_a_processor():
    r = np.random.default_rng(9)
    x, y = walk(r, 8), walk(r, 5)
    p, memory, out = holding.Holding(holding.LOG, holding._OPEN, holding.DIVERGENCES), [], []
    flat = y.reshape(-1).tolist()
    log = [(0, 0, "open", "a", 0, flat), (0, 0, "open", "none", 0, None)]
    log += [(i, 1, "bar", None, i, v.tolist()) for i, v in enumerate(x)]
    log += [(7, 1, "bar", None, 7, None), (7, 1, "bar", None, 7, [1.0, math.nan, 0.0]), (7, 2, "close", "a", 7, None), (8, 1, "bar", None, 8, x[0].tolist())]
    for event in log:
        memory = p.step(memory, event, out)
    mine = [o for o in out if o[0] == "a"]
    assert [o[1] for o in mine] == list(range(8))
    for i, o in enumerate(mine):
        n = min(i + 1, 5)
        d = min(1, sim.dtw(x[:n], y[:n], 5) / (n * math.sqrt(WIDTH) * 2))
        assert o[2] == pytest.approx(d) and o[3] == (d > holding.LIMIT)
    assert [(o[1], o[2], o[3]) for o in out if o[0] == "none"] == [(i, 0.0, False) for i in range(9)]


def lot(seed, i):
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("n, k", [(0, 5), (1, 5), (2, 5), (5, 10), (40, 10), (300, 25), (300, 3000)])
def test_pairs_are_those_of_least_draw(spark, n, k):
    rows = [(i * 7,) for i in range(n)] + [(0,)] * min(n, 3) + [(None,)]
    df = spark.createDataFrame(rows, "name long").repartition(5)
    got = [(r["draw"], r["a"], r["b"]) for r in warping.sampled_pairs(df, k, 4, "name").collect()]
    ids = [i * 7 for i in range(n)]
    want = sorted(((lot(4, a) + lot(4, b)) % 2**60, a, b) for a in ids for b in ids if a < b)[:k]
    assert sorted(got) == want


def test_too_narrow_lots_are_widened(spark, monkeypatch):
    df = spark.range(400).toDF("vec_id")
    whole = warping.sampled_pairs(df, 500, 1).collect()
    drawn, seen = warping._drawn, []

    def narrower(lots, shift):
        seen.append(shift)
        return drawn(lots, shift if len(seen) > 1 else shift - 6)

    monkeypatch.setattr(warping, "_drawn", narrower)
    again = warping.sampled_pairs(df, 500, 1).collect()
    assert len(seen) > 1 and sorted(again) == sorted(whole) and len(again) == 500


def prototypes(spark, rows):
    kinds = "proto_id long, direction string, regime string, v array<double>, members long, wins long, total_profit double, confidence double, extra string"
    return spark.createDataFrame([(*r, "x") for r in rows], kinds)


def test_merged_prototypes(spark):
    from tidemark.operators import templates as tpl

    east, near, north = [1.0, 0.0], [1.0, 0.01], [0.0, 1.0]
    rows = [
        # Confidences within .1: the larger stays; its mean profit is taken anew.
        (1, "LONG", "A", east, 3, 1, 3.0, 0.55, ),
        (2, "LONG", "A", near, 5, 4, 10.0, 0.50),
        (3, "LONG", "A", north, 9, 9, 9.0, 0.9),
        # Another regime, though the same place.
        (4, "LONG", "B", east, 1, 1, 1.0, 0.1),
        # Apart in confidence: the surer stays, however small.
        (5, "SHORT", "A", east, 50, 10, 5.0, 0.3),
        (6, "SHORT", "A", near, 2, 1, 1.0, 0.6),
        # Equal members: the more profitable, the earlier one at a tie.
        (7, "SHORT", "B", east, 4, 2, 4.0, 0.5),
        (8, "SHORT", "B", near, 4, 2, 8.0, 0.5),
        (9, "SHORT", "C", east, 4, 2, 4.0, 0.5),
        (10, "SHORT", "C", east, 4, 2, 4.0, 0.5),
        # Goes into 12, which then meets 13 with all it has.
        (11, "LONG", "D", east, 2, 1, 2.0, 0.5),
        (12, "LONG", "D", near, 3, 1, 3.0, 0.5),
        (13, "LONG", "D", east, 1, 1, 1.0, 0.5),
        # Nothing to compare.
        (14, "LONG", "E", None, 1, 0, 1.0, None),
        (15, "LONG", "E", [], None, None, None, 0.5),
        (16, "LONG", "E", [0.0, 0.0], 0, 0, 0.0, 0.5),
        (17, "LONG", "E", [1.0], 1, 1, 1.0, 0.5),
    ]
    got = {r["proto_id"]: (r["members"], r["wins"], r["total_profit"], r["avg_profit"], r["merged"]) for r in tpl.merged_prototypes(prototypes(spark, rows)).collect()}
    assert got == {
        2: (8, 5, 13.0, 1.625, [1]),
        3: (9, 9, 9.0, 1.0, []),
        4: (1, 1, 1.0, 1.0, []),
        6: (52, 11, 6.0, 6 / 52, [5]),
        8: (8, 4, 12.0, 1.5, [7]),
        9: (8, 4, 8.0, 1.0, [10]),
        12: (6, 3, 6.0, 1.0, [11, 13]),
        14: (1, 0, 1.0, 1.0, []),
        15: (0, 0, 0.0, 0.0, []),
        16: (0, 0, 0.0, 0.0, []),
        17: (1, 1, 1.0, 1.0, []),
    }
    assert tpl.merged_prototypes(prototypes(spark, [])).count() == 0
    through = {r["proto_id"]: r["members"] for r in tpl.merged_prototypes(prototypes(spark, rows), finish_turn=True).where("regime = 'D'").collect()}
    assert through == {12: 5}  # 11 took 13 after it had gone itself


def test_keep_and_remove(spark):
    from tidemark.operators import templates as tpl

    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "fingerprint string, n int")
    f = spark.createDataFrame([("a", 9), ("a", 9), ("c", 9), (None, 9)], "fingerprint string, n int")
    assert sorted(r["n"] for r in tpl.keep(t, f).collect()) == [1, 2]
    assert sorted(r["n"] for r in tpl.remove(t, f).collect()) == [3, 4]
