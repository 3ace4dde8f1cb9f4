"""Stateful streams, the paged source and documents of unknown encoding on small fixtures."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.sources import documents, paged
from tidemark.streaming import trackers

START = datetime(2024, 1, 1)
SPAN = trackers.HORIZON


def judge_by_loop(bars, log):
    """Verdicts by looking at the bars behind each decision."""
    out = {}
    for symbol, _, bar, kind, name, direction, price, profit, peak in log:
        later = [c for s, _, b, c in sorted(bars, key=lambda r: r[2]) if s == symbol and b > bar][:SPAN]
        if len(later) < SPAN:
            continue
        moves = [(c - price) / price * 100 * (1 if direction == "long" else -1) for c in later]
        out[symbol, name] = (moves[-1], max(0.0, max(moves)), max(0.0, -min(moves)), trackers.verdict(kind, moves[-1], max(0.0, max(moves)), profit, peak))
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_judgements_do_not_depend_on_batches(spark, tmp_path, shards):
    r = random.Random(4)
    bars, log = [], []
    for symbol in "xy":
        price = 100.0
        for i in range(90):
            price *= 1 + r.uniform(-0.004, 0.004)
            ts = START + timedelta(hours=i)
            bars.append((symbol, ts, i, price))
            for kind in ("rejection", "exit_timing", "stop", "near_miss", "early_exit"):
                if r.random() < 0.3:
                    log.append((symbol, ts, i, kind, f"{kind}{i}", r.choice(["long", "short"]), price, r.choice([None, 0.1, 0.9]) or 0.1, r.choice([None, 1.0, 0.0])))
    bar_schema, log_schema = "symbol string, ts timestamp, bar_idx long, close double", "symbol string, ts timestamp, bar_idx long, kind string, id string, direction string, price double, profit double, peak double"
    streams = []
    for name, rows, schema in (("bars", bars, bar_schema), ("log", log, log_schema)):
        trackers.recorded(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path / name), 4, 5_400_000)
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    result = trackers.judgements(*streams, shards=shards)
    trackers.started(result, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r["symbol"], r["id"]): (r["move"], r["best"], r["worst"], r["verdict"]) for r in spark.read.schema(result.schema).parquet(str(tmp_path / "out")).collect()}
    want = judge_by_loop(bars, log)
    assert set(got) == set(want) and len(want) > 50 and len({v[3] for v in want.values()}) >= 6
    for k, v in want.items():
        assert got[k][3] == v[3] and got[k][:3] == pytest.approx(v[:3])


def stepped(rows):
    """Verdicts of one symbol's log by the rules, row by row."""
    out, memory, machine = [], [], trackers.Candidates(trackers.MATCHES, trackers._LOCK, trackers.ENTRIES)
    for row in rows:
        memory = machine.step(memory, row, out)
    return out


def test_candidate_lives_and_dies():
    m = lambda bar, way, fp, passed: (bar, 0, "match", bar, way, fp, passed)
    close = lambda bar, way: (bar, 1, "close", bar, way, None, None)
    ttl = trackers.TTL_BARS
    assert stepped([m(0, "long", "a", False), m(ttl, "short", "b", False), m(ttl + 1, "short", "b", True)]) == [
        (0, "long", "a", "waits"),
        (ttl, "long", "a", "waits"),  # the candidate, not the new match
        (ttl + 1, "short", "b", "entered"),  # the old one has expired
    ]
    shut = trackers.SHUT_BARS
    got = stepped([m(0, "long", "a", False), close(1, "long"), m(2, "long", "c", True), m(1 + shut, "long", "d", True), m(2 + shut, "long", "e", True)])
    assert got == [(0, "long", "a", "waits"), (2, "long", "c", "shut"), (1 + shut, "long", "c", "entered"), (2 + shut, "long", "e", "entered")]
    assert stepped([close(0, "short"), m(1, "long", "x", True)]) == [(1, "long", "x", "entered")]


def pages_of(path, symbol, start, answers):
    where = path / f"symbol={symbol}"
    where.mkdir(parents=True, exist_ok=True)
    (where / f"{start}.json").write_text(json.dumps(answers))


def test_pages_are_tried_again_and_late_ones_read_once(spark, tmp_path):
    paged.register(spark)
    rows = lambda a, n: [[str(t), "1", "2", "0.5", "1.5", "10", str(t + 9)] for t in range(a, a + 10 * n, 10)]
    ok = lambda a, n: {"status": 200, "rows": rows(a, n)}
    path = tmp_path / "pages"
    pages_of(path, "x", 0, [{"status": 503}, {"status": 429}, ok(0, 3)])
    pages_of(path, "x", 60, [ok(60, 3)])
    pages_of(path, "y", 30, [ok(30, 1)])
    pages_of(path, "y", 60, [{"status": 200, "rows": []}])
    read = spark.read.format("paged_bars").options(path=str(path), pause="0", spanPages="1")
    got = sorted((r["symbol"], r["open_ms"], r["close"]) for r in read.load().collect())
    assert got == [("x", t, 1.5) for t in (0, 10, 20, 60, 70, 80)] + [("y", 30, 1.5)]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.format("paged_bars").options(path=str(path), pageMillis="30", pause="0").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["symbol"], r["open_ms"]) for r in spark.read.schema(paged.SCHEMA).parquet(out).collect())

    assert run() == [(s, t) for s, t, _ in got]
    pages_of(path, "x", 30, [ok(30, 3)])  # late, between two that are read
    pages_of(path, "z", 0, [ok(0, 1)])
    assert run() == sorted([(s, t) for s, t, _ in got] + [("x", 30), ("x", 40), ("x", 50), ("z", 0)])
    assert len(run()) == 11
    pages_of(path, "x", 90, [{"status": 500}])
    with pytest.raises(Exception, match="status 500"):
        read.load().collect()


def test_encodings_are_told_apart(spark, tmp_path):
    text = json.dumps({"a": 1, "b": "é漢字"}, ensure_ascii=False)
    for name, encoding in (("u8", "utf-8"), ("bom", "utf-8-sig"), ("u16", "utf-16"), ("le", "utf-16-le"), ("be", "utf-16-be")):
        (tmp_path / f"{name}.json").write_bytes(text.encode(encoding))
    (tmp_path / "be-bom.json").write_bytes(b"\xfe\xff" + text.encode("utf-16-be"))
    (tmp_path / "empty.json").write_bytes(b"")
    (tmp_path / "broken.json").write_bytes(b"\xff\xff\xff{")
    (tmp_path / "odd.json").write_bytes(b"\xff\xfe{\x00\x00")
    (tmp_path / "text.json").write_bytes(b"no json")
    found = documents.json_documents(spark, str(tmp_path), "a bigint, b string").withColumn("name", F.regexp_extract("path", "([^/]+)[.]json$", 1))
    got = {r["name"]: (r["encoding"], r["text"], r["document"] and (r["document"]["a"], r["document"]["b"])) for r in found.collect()}
    for name, encoding in (("u8", "UTF-8"), ("bom", "UTF-8"), ("u16", "UTF-16LE"), ("le", "UTF-16LE"), ("be", "UTF-16BE"), ("be-bom", "UTF-16BE")):
        assert got[name] == (encoding, text, (1, "é漢字")), name
    assert "empty" not in got and got["broken"][1] is None and got["odd"][1] is None
    assert got["text"][1] == "no json" and got["text"][2] in (None, (None, None))
