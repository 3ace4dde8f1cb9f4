"""Back-tests of one position at a time, with fees, slippage, leverage and an exit ladder.

A walk reads a symbol's bars in order and carries an account from one to the next, so that a task
holds a batch of bars and not a symbol's history; symbols run side by side.  Each walk yields the
trades (a partial close is one of its own) or the equity after every bar.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.recurrences import _walked


@dataclass(frozen=True)
class Rules:
    """Defaults are fixed values of the back-test's configuration; percentages under leverage are
    marked so."""

    capital: float = 5000.0
    leverage: float = 20.0
    fee: float = 0.0004
    slippage: float = 0.0002
    share: float = 0.05
    target: float = 0.006
    stop: float = 0.008
    first_share: float = 0.70
    trail: float = 0.02
    lift_at: float = 6.0  # gain in percent under leverage from which the stop is lifted
    lift_to: float = -3.0
    decay: tuple[tuple[int, float], ...] = ()  # (bars held, stop in percent under leverage), longest first
    max_hold: int = 0  # 0: none


LABEL_RULES = Rules(leverage=10.0, share=1.0)
TRADE = "entry_idx long, exit_idx long, side string, entry_price double, exit_price double, size double, profit double, profit_pct double, hold long, reason string"
TRADE_NAMES = [c.split()[0] for c in TRADE.split(", ")]


@dataclass
class Account:
    """Capital and at most one position; side is 1 long, -1 short, 0 none."""

    rules: Rules
    capital: float = 0.0
    side: int = 0
    entry: float = 0.0
    since: int = 0
    size: float = 0.0
    stop: float = 0.0
    goal: float = 0.0
    trailing: bool = False
    best: float = 0.0  # the best gain so far in percent under leverage, then the best price
    lifted: bool = False
    avg_hold: int = 0
    trades: list[tuple] = field(default_factory=list)
    pending: dict[int, tuple[float, int]] = field(default_factory=dict)  # side: (price, bar) of a stop order

    def __post_init__(self):
        self.capital = self.rules.capital

    def equity(self, price: float) -> float:
        return self.capital + self.side * (price - self.entry) * self.size

    def open(self, idx: int, price: float, side: int, avg_hold: int = 0) -> None:
        r = self.rules
        self.side, self.since, self.entry, self.avg_hold = side, idx, price * (1 + side * r.slippage), avg_hold
        value = self.capital * r.share * r.leverage
        self.size = value / self.entry
        self.capital -= value * r.fee
        self.stop, self.goal = self.entry * (1 - side * r.stop), self.entry * (1 + side * r.target)
        self.trailing, self.best, self.lifted = False, 0.0, False

    def close(self, idx: int, price: float, reason: str, share: float = 1.0) -> None:
        out, size = price * (1 - self.side * self.rules.slippage), self.size * share
        profit = self.side * (out - self.entry) * size - out * size * self.rules.fee
        self.capital += profit
        gain = self.side * (out - self.entry) / self.entry * 100
        self.trades.append((self.since, idx, "long" if self.side > 0 else "short", self.entry, out, size, profit, gain, idx - self.since, reason))
        self.size -= size
        if share == 1.0:
            self.side, self.size = 0, 0.0

    def tighten(self, price: float) -> None:
        if self.side * (price - self.stop) > 0:
            self.stop = price

    def _lift(self, gain: float) -> bool:
        """Keeps the best gain; the first time it is enough, the stop goes up once and for all."""
        self.best = max(self.best, gain)
        if self.lifted or self.best < self.rules.lift_at:
            return False
        self.lifted = True
        self.tighten(self.entry * (1 + self.side * self.rules.lift_to / 100 / self.rules.leverage))
        return True

    def gain(self, price: float) -> float:
        return self.side * (price - self.entry) / self.entry * self.rules.leverage * 100

    def guard(self, idx: int, high: float, low: float) -> None:
        """The exit ladder on one bar: stop (lifted, or tightened with time), first target, trailing."""
        r, good, bad = self.rules, (high if self.side > 0 else low), (low if self.side > 0 else high)
        if self.trailing:
            self.best = good if self.side * (good - self.best) > 0 else self.best
            self.tighten(self.best * (1 - self.side * r.trail))
        elif not self._lift(self.gain(good)) and not self.lifted:
            bars = ((int(self.avg_hold * 0.7), int(self.avg_hold * 0.5)) if self.avg_hold >= 10 else [b for b, _ in r.decay]) if r.decay else ()
            for limit, (_, stop) in zip(bars, r.decay, strict=False):
                if idx - self.since > limit:
                    self.tighten(self.entry * (1 + self.side * stop / 100 / r.leverage))
                    break
        if self.side * (bad - self.stop) <= 0:
            self.close(idx, self.stop, "trailing" if self.trailing else "stop")
        elif not self.trailing and self.side * (good - self.goal) >= 0:
            self.close(idx, self.goal, "first_target", r.first_share)
            self.trailing, self.stop, self.best = True, self.entry, self.goal

    def follow(self, idx: int, price: float, signal: int) -> None:
        """Opens on a signal, or turns round on the opposite one."""
        if signal and self.side != signal:
            if self.side:
                self.close(idx, price, "signal")
            self.open(idx, price, signal)


def _run(bars: DataFrame, columns: list[str], rules: Rules, step, equity: bool) -> DataFrame:
    """Trades, or equity, of step(account, row) over each symbol's bars; row starts with bar_idx, high,
    low and close.  What is open at the end closes at the last close."""

    def walk(rows: Iterator[tuple[tuple, bool]]) -> Iterator[tuple]:
        account = Account(rules)
        for row, last in rows:
            marked = step(account, row)
            if equity and marked is not False:
                yield row[0], account.equity(row[3])
            if last and account.side:
                account.close(row[0], row[3], "end")
            if not equity:
                yield from account.trades
            account.trades.clear()

    names = ["bar_idx", "equity"] if equity else TRADE_NAMES
    return _walked(bars, ["bar_idx", "high", "low", "close", *columns], walk, names, "bar_idx long, equity double" if equity else TRADE)


def on_signals(bars: DataFrame, rules: Rules = Rules(), equity: bool = False) -> DataFrame:
    """Entries and reversals at the close of a bar with signal 1 (long) or -1 (short), after the exit
    ladder has looked at the bar."""

    def step(account: Account, row: tuple) -> None:
        idx, high, low, close, signal = row
        if account.side:
            account.guard(idx, high, low)
        account.follow(idx, close, int(signal))

    return _run(bars, ["signal"], rules, step, equity)


def on_labels(bars: DataFrame, rules: Rules = LABEL_RULES, equity: bool = False) -> DataFrame:
    """Label 1 and -1 enter long at the low and short at the high, 2 and -2 leave at the other end;
    there are no stops."""

    def step(account: Account, row: tuple) -> None:
        idx, high, low, _, label = row
        at = {1: low, 2: high, -1: high, -2: low}.get(label)
        if label in (1, -1):
            account.follow(idx, at, label)
        elif label in (2, -2) and account.side * 2 == label:
            account.close(idx, at, "signal")

    return _run(bars, ["label"], rules, step, equity)


def on_scores(bars: DataFrame, long_least: float, short_least: float, rules: Rules = Rules(max_hold=60), equity: bool = False) -> DataFrame:
    """Entries on long_score or short_score above its threshold and the other; a position turns round
    on the opposite threshold and closes after max_hold bars, a bar without equity."""

    def step(account: Account, row: tuple) -> bool | None:
        idx, high, low, close, long_score, short_score = row
        if account.side and idx - account.since >= rules.max_hold > 0:
            account.close(idx, close, "timeout")
            return False
        if account.side:
            if not account.trailing:
                account._lift(account.gain(close))
            account.guard(idx, high, low)
        if not account.side:
            side = 1 if long_score > long_least and long_score > short_score else -1 if short_score > short_least and short_score > long_score else 0
        else:
            side = -account.side if (short_score > short_least if account.side > 0 else long_score > long_least) else 0
        account.follow(idx, close, side)
        return None

    return _run(bars, ["long_score", "short_score"], rules, step, equity)


def on_pool(bars: DataFrame, target: float = 0.006, stop: float = 0.008, max_hold: int = 60, blind: int = 2, fee: float = 0.0004) -> DataFrame:
    """Trades of pool signals: entry at the open after a bar with signal, if that bar's ATR over the
    price lies within the gate; for `blind` bars the stop is off, a target counts only if the stop is not hit, and the
    trade ends after max_hold bars at the close."""
    least, most = 0.0004, stop * 1.5

    def walk(rows: Iterator[tuple[tuple, bool]]) -> Iterator[tuple]:
        side, entry, since, waiting, before = 0, 0.0, 0, 0, None
        for (idx, opened, high, low, close, atr, signal), last in rows:
            if not side and waiting and (not (before and before > 0) or least <= before / opened <= most):
                side, entry, since = waiting, opened, idx
            if side:
                held, bad, good = idx - since, (low if side > 0 else high), (high if side > 0 else low)
                stopped = held > blind and side * (bad - entry * (1 - side * stop)) <= 0
                reached = not stopped and side * (good - entry * (1 + side * target)) >= 0
                if stopped or reached or held >= max_hold or last:
                    out, reason = (entry * (1 - side * stop), "stop") if stopped else (entry * (1 + side * target), "target") if reached else (close, "timeout")
                    yield since, idx, "long" if side > 0 else "short", entry, out, (side * (out - entry) / entry - 2 * fee) * 100, idx - since, reason
                    side = 0
            waiting, before = (0 if side else int(signal)), atr

    names = ["entry_idx", "exit_idx", "side", "entry_price", "exit_price", "profit_pct", "hold", "reason"]
    kinds = "entry_idx long, exit_idx long, side string, entry_price double, exit_price double, profit_pct double, hold long, reason string"
    return _walked(bars, ["bar_idx", "open", "high", "low", "close", "atr", "signal"], walk, names, kinds)


def statistics(trades: DataFrame, *keys: str) -> DataFrame:
    """Counts, rates, gross sums, profit factor (null without losses), Sharpe ratio over trades times
    the root of 252 (0 without spread), by side too."""
    p, g = F.col("profit"), F.col("profit_pct")
    won = (p > 0).cast("long")
    of = lambda s, x: F.sum(F.when(F.col("side") == s, x).otherwise(0))
    sums = trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(won).alias("wins"), F.sum(p).alias("total_profit"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gross_profit"), F.sum(F.when(p > 0, 0.0).otherwise(-p)).alias("gross_loss"),
        F.avg(g).alias("avg_profit_pct"), F.stddev_pop(g).alias("sd"), F.avg("hold").alias("avg_hold"), of("long", F.lit(1)).alias("long_n"), of(
            "short",
            F.lit(1),
        ).alias("short_n"),
        of("long", won).alias("long_wins"), of("short", won).alias("short_wins"), of("long", p).alias("long_profit"), of("short", p).alias("short_profit"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.withColumns(
        {
            "win_rate": rate("wins", "n"), "long_win_rate": rate("long_wins", "long_n"), "short_win_rate": rate("short_wins", "short_n"),
            "profit_factor": F.when(F.col("gross_loss") > 0, F.col("gross_profit") / F.col("gross_loss")),
            "avg_win": rate("gross_profit", "wins"), "avg_loss": F.when(
                F.col("n") > F.col("wins"),
                F.col("gross_loss") / (F.col("n") - F.col("wins")),
            ).otherwise(0.0),
            "sharpe": F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("avg_profit_pct") / F.col("sd") * F.sqrt(F.lit(252.0))).otherwise(0.0),
        }
    ).drop("sd")


def simulated_statistics(trades: DataFrame, *keys: str) -> DataFrame:
    """Of simulated trades(t, profit_pct): the Sharpe ratio falls back to ten times the mean without
    spread, and to -10 without trades of one key at all; drawdown of the running sum of percents."""
    order = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    run = trades.withColumn("sum", F.sum("profit_pct").over(order)).withColumn("top", F.greatest(F.max("sum").over(order), F.lit(0.0)))
    g = F.col("profit_pct")
    found = run.groupBy(*keys).agg(
        F.count(g).alias("n"),
        F.avg((g > 0).cast("int")).alias("win_rate"),
        F.avg(g).alias("mean"),
        F.stddev_pop(g).alias("sd"),
        F.max(F.col("top") - F.col("sum")).alias("drawdown"),
    )
    sharpe = F.when(F.col("n") == 0, -10.0).when(F.col("sd") > 1e-9, F.col("mean") / F.col("sd")).otherwise(F.col("mean") * 10)
    return found.withColumn("sharpe", sharpe).drop("sd")


def drawdowns(equity: DataFrame, capital: float) -> DataFrame:
    """The greatest fall from the peak of each symbol's equity(symbol, bar_idx, equity), as a share, and
    the last equity; the peak starts at the capital."""

    def walk(rows: Iterator[tuple[tuple, bool]]) -> Iterator[tuple]:
        peak, fall, n = capital, 0.0, 0
        for (_, value), last in rows:
            peak, n = max(peak, value), n + 1
            fall = max(fall, (peak - value) / peak)
            if last:
                yield n, fall, value, (value / capital - 1) * 100

    return _walked(
        equity,
        ["bar_idx", "equity"],
        walk,
        ["bars", "max_drawdown", "equity", "return_pct"],
        "bars long, max_drawdown double, equity double, return_pct double",
    )


def scored_matrix(
    bars: DataFrame,
    scores: DataFrame,
    least: float,
    stop_atrs: float = 2.0,
    target_atrs: float = 3.0,
    max_hold: int = 60,
    fee: float = 0.0004,
) -> DataFrame:
    """Trades on scores(symbol, bar_idx, direction, score) against prototypes: at a bar with its best
    score at `least` or more a trade opens at the close, ends at ATR stops of that bar (stop first) or
    after max_hold bars, and the bars until then are skipped."""
    best = scores.groupBy("symbol", "bar_idx").agg(F.max_by("direction", F.struct("score", "direction")).alias("d"), F.max("score").alias("score"))
    rows = bars.join(best, ["symbol", "bar_idx"], "left")

    def walk(found: Iterator[tuple[tuple, bool]]) -> Iterator[tuple]:
        side, entry, since, risk = 0, 0.0, 0, 0.0
        for (idx, high, low, close, atr, d, score), last in found:
            if side:
                stop, goal = entry - side * stop_atrs * risk, entry + side * target_atrs * risk
                bad, good = (low, high) if side > 0 else (high, low)
                out = stop if side * (bad - stop) <= 0 else goal if side * (good - goal) >= 0 else close if idx - since >= max_hold or last else None
                if out is not None:
                    yield since, idx, "long" if side > 0 else "short", (side * (out - entry) / entry - 2 * fee) * 100
                    side = 0
                    continue
            if not side and score is not None and score >= least and atr and atr > 0 and not last:
                side, entry, since, risk = (1 if d == "LONG" else -1), close, idx, atr

    return _walked(
        rows,
        ["bar_idx", "high", "low", "close", "atr", "d", "score"],
        walk,
        ["entry_idx", "exit_idx", "side", "profit_pct"],
        "entry_idx long, exit_idx long, side string, profit_pct double",
    )


def on_stop_orders(bars: DataFrame, expiry: int = 5, rules: Rules = Rules()) -> DataFrame:
    """Trades of stop orders: long_stop and short_stop (null: none) are placed after a bar, replacing one
    of their side, and are good for `expiry` bars.  A bar that triggers both cancels both; one that
    triggers one opens at its price and cancels the other, and the exit ladder looks at later bars."""

    def step(account: Account, row: tuple) -> None:
        idx, high, low, _, long_stop, short_stop = row
        pending = account.pending
        for side in [s for s, (_, placed) in pending.items() if idx - placed > expiry]:
            del pending[side]
        if account.side:
            account.guard(idx, high, low)
        else:
            hit = [s for s, (price, _) in pending.items() if (high >= price if s > 0 else low <= price)]
            if len(hit) == 1:
                account.open(idx, pending[hit[0]][0], hit[0])
            if hit:
                pending.clear()
        if not account.side:
            pending.update({s: (p, idx) for s, p in ((1, long_stop), (-1, short_stop)) if p is not None and p == p})

    return _run(bars, ["long_stop", "short_stop"], rules, step, False)
