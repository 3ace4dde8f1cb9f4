"""Bars and decisions as streams: late and repeated bars, open bars, deferred evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_once(messages: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Each closed bar of a symbol once, whatever channels repeat it; bars later than the
    watermark are dropped, so that the state stays bounded."""
    closed = messages.where("is_closed").withWatermark("ts", delay)
    return closed.dropDuplicatesWithinWatermark(["symbol", "ts"])


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Bars of ticks(symbol, ts, event_id, price); open bars come out too in update mode."""
    at = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def later_moves(decisions: DataFrame, bars: DataFrame, horizon: str = "30 hours", delay: str = "2 hours") -> DataFrame:
    """Decisions joined to the close one horizon later: a stream-stream join whose state is bounded
    by both watermarks and the time range."""
    d = decisions.withWatermark("ts", delay).select("symbol", F.col("ts").alias("decided"), F.col("close").alias("then"))
    b = bars.withWatermark("ts", delay).select(F.col("symbol").alias("s"), F.col("ts").alias("later"), F.col("close").alias("now"))
    due = F.expr(f"decided + interval {horizon}")
    joined = d.join(b, (F.col("symbol") == F.col("s")) & (F.col("later") >= due) & (F.col("later") <= due))
    return joined.select("symbol", "decided", "later", ((F.col("now") / F.col("then") - 1) * 100).alias("move"))


def run_lengths(bars: DataFrame) -> DataFrame:
    """Signed run of rising or falling bars after each batch of a symbol, kept as two numbers of state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, seen = state.get if state.exists else (0, 0)
        for pdf in batches:
            for up in (pdf.sort_values("ts")["close"] >= pdf.sort_values("ts")["open"]).tolist():
                run = (run + 1 if run > 0 else 1) if up else (run - 1 if run < 0 else -1)
                seen += 1
        state.update((run, seen))
        yield pd.DataFrame({"symbol": [key[0]], "run": [run], "seen": [seen]})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, run long, seen long", "run long, seen long", "update", "NoTimeout")


def overlaid(closed: DataFrame, open_bars: DataFrame) -> DataFrame:
    """Closed bars and the latest state of the open one: of one symbol and time the last update stays,
    a closed bar before any open one."""
    both = closed.select("symbol", "ts", "close", "seq", F.lit(True).alias("is_closed")).unionByName(open_bars.select("symbol", "ts", "close", "seq", F.lit(False).alias("is_closed")))
    best = F.max_by(F.struct("close", "is_closed"), F.struct("is_closed", "seq"))
    return both.groupBy("symbol", "ts").agg(best.alias("b")).select("symbol", "ts", "b.*")


def buffered_features(bars: DataFrame, rows: int = 1000) -> DataFrame:
    """symbol, ts, bars, ma5, ma20 and rsi after each batch, from the last `rows` closes of a symbol,
    which are all the state there is."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        closes, seen = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        last = None
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            closes, seen, last = (closes + pdf["close"].tolist())[-rows:], seen + len(pdf), pdf["ts"].iloc[-1]
        state.update((closes, seen))
        c = pd.Series(closes)
        moves = c.diff().tail(14)
        gain, loss = moves.clip(lower=0).mean(), -moves.clip(upper=0).mean()
        rsi = 100 - 100 / (1 + gain / (loss + 1e-9)) if len(c) > 14 else None
        yield pd.DataFrame({"symbol": [key[0]], "ts": [last], "bars": [seen], "ma5": [c.tail(5).mean() if len(c) >= 5 else None], "ma20": [c.tail(20).mean() if len(c) >= 20 else None], "rsi": [rsi]})

    out = "symbol string, ts timestamp, bars long, ma5 double, ma20 double, rsi double"
    return bars.groupBy("symbol").applyInPandasWithState(step, out, "closes array<double>, seen long", "update", "NoTimeout")


def triggered(marked: DataFrame, pool: DataFrame, least_rounds: int = 2) -> DataFrame:
    """Bars of a stream (or table) with a condition mask, joined to the combinations(combo, bits, rounds)
    of a pool that hold on them; a pool is at most a few dozen rows and broadcast."""
    known = F.broadcast(pool.where(F.col("rounds") >= least_rounds).select("combo", "bits"))
    return marked.join(known, F.col("mask").bitwiseAND(F.col("bits")) == F.col("bits")).select("symbol", "bar_idx", "combo")
