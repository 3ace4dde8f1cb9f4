"""Order-dependent walks over bars or trades that no window expresses.

Walks over bars read a symbol's bars in order, batch by batch, and carry their small state from
each to the next: a task holds a batch and not a symbol's whole history, and symbols run side by
side.  Trades are chosen for each symbol as a pandas frame.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from tidemark.operators.backtests import Rules


def _walked(bars: DataFrame, columns: list[str], walk: Callable[[Iterator[tuple[tuple, bool]]], Iterator[tuple]], names: list[str], types: str) -> DataFrame:
    """What walk yields for the rows of each symbol in order, each with whether it is the last one.

    A symbol's rows come to one task by sorted Arrow batches; only the walk's own state and one
    row go from batch to batch."""
    types = f"symbol string, {types}"

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, tuple, bool]]:
        held = None
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if held is not None:
                    yield held[0], held[1:], held[0] != row[0]
                held = row
        if held is not None:
            yield held[0], held[1:], True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for symbol, rows in groupby(marked(batches), itemgetter(0)):
            for found in walk((row, last) for _, row, last in rows):
                out.append((symbol, *found))
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=["symbol", *names])
                    out = []
        yield pd.DataFrame(out, columns=["symbol", *names])

    return bars.select("symbol", *columns).repartition("symbol").sortWithinPartitions("symbol", "bar_idx").mapInPandas(run, types)


def zigzag(bars: DataFrame, factor: float = 2.0, warm_up: int = 14, search: int = 50) -> DataFrame:
    """symbol, bar_idx, price, is_high: turns by more than factor ATRs (1 % of the close without one).

    The walk starts at the first of the `search` bars after the warm-up whose range exceeds that, at its
    high if it closes above the bar before and else at its low, or, if there is none, at the warm-up
    bar's close as a high.  The last point is one as well, unless it is the last bar; symbols of fewer
    than warm_up + 10 bars have none.
    """

    def walk(rows: Iterator[tuple[tuple, bool]]) -> Iterator[tuple]:
        seen: list[tuple] = []  # bars kept until the start is known
        at = price = high_last = None
        n = 0

        def step(row: tuple) -> Iterator[tuple]:
            nonlocal at, price, high_last
            idx, high, low, close, atr = row
            need = atr * factor if atr is not None and atr * factor > 0 else close * 0.01
            beyond, further, here = (low < price - need, high > price, low) if high_last else (high > price + need, low < price, high)
            if beyond:
                yield at, price, high_last
                at, price, high_last = idx, here, not high_last
            elif further:
                at, price = idx, high if high_last else low

        wide = lambda row: row[4] is not None and row[1] - row[2] > row[4] * factor
        for row, last in rows:
            n += 1
            if at is not None:
                yield from step(row)
            else:
                seen.append(row)
                if n < warm_up + 10:
                    continue
                start = next((i for i in range(warm_up, min(n, warm_up + search)) if wide(seen[i])), None)
                if start is None and n < warm_up + search and not last:
                    continue
                idx, high, low, close, _ = seen[warm_up if start is None else start]
                high_last = start is None or close > seen[start - 1][3]
                at, price = idx, close if start is None else high if high_last else low
                for early in seen[(warm_up if start is None else start) + 1 :]:
                    yield from step(early)
            if last and at != row[0]:
                yield at, price, high_last

    return _walked(bars, ["bar_idx", "high", "low", "close", "atr"], walk, ["bar_idx", "price", "is_high"], "bar_idx long, price double, is_high boolean")


def best_trades(candidates: DataFrame, *keys: str) -> DataFrame:
    """The non-overlapping candidates(entry_idx, exit_idx, profit) of greatest total profit of each
    key: a trade may start only after the one before has ended."""
    names = ["entry_idx", "exit_idx", "profit"]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["exit_idx", "entry_idx"]).reset_index(drop=True)
        exits, best, took = pdf["exit_idx"].tolist(), [0.0], []
        for i, (entry, _, profit) in enumerate(pdf[names].itertuples(index=False)):
            before = bisect_left(exits, entry, 0, i)
            with_it = best[before] + profit
            took.append((with_it > best[-1], before))
            best.append(max(best[-1], with_it))
        chosen, i = [], len(took)
        while i:
            if took[i - 1][0]:
                chosen.append(i - 1)
                i = took[i - 1][1]
            else:
                i -= 1
        return pdf.iloc[chosen[::-1]]

    types = dict(candidates.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, *names))
    return candidates.select(*keys, *names).groupBy(*keys).applyInPandas(choose, schema)


def parameter_search(signals: DataFrame, grid: list[Rules], fold_length: int = 720) -> DataFrame:
    """trial, n, score: trades and the mean Sharpe-like ratio over folds of entries of every setting.

    All settings walk a symbol's bars in one pass, each with an account of its own; positions cross the
    folds' ends.
    """
    from tidemark.operators.backtests import Account

    def walk(rows: Iterator[tuple[tuple, bool]]) -> Iterator[tuple]:
        accounts = [Account(r) for r in grid]
        for (idx, high, low, close, signal), last in rows:
            for trial, account in enumerate(accounts):
                if account.side:
                    account.guard(idx, high, low)
                    if account.rules.max_hold and account.side and idx - account.since >= account.rules.max_hold:
                        account.close(idx, close, "timeout")
                account.follow(idx, close, int(signal))
                if last and account.side:
                    account.close(idx, close, "end")
                for t in account.trades:
                    yield trial, t[0], t[7]
                account.trades.clear()

    trades = _walked(
        signals,
        ["bar_idx", "high", "low", "close", "signal"],
        walk,
        ["trial", "entry_idx", "profit_pct"],
        "trial int, entry_idx long, profit_pct double",
    )
    folds = trades.withColumn("fold", F.expr(f"entry_idx div {fold_length}")).groupBy("trial", "fold").agg(
        F.count("*").alias("n"),
        F.avg("profit_pct").alias("mean"),
        F.stddev_pop("profit_pct").alias("sd"),
    )
    return folds.groupBy("trial").agg(F.sum("n").alias("n"), F.avg(F.when(F.col("sd") > 0, F.col("mean") / F.col("sd"))).alias("score"))
