"""Closed and open orders: nearest bars, regime changes, exit advice, reasons, tables of results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.recurrences import _walked
from tidemark.operators.swings import REGIMES
from tidemark.operators.templates import BEARS, BULLS

STRONG, WEAK, SIDEWAYS = ("STRONG_BULL", "STRONG_BEAR"), ("WEAK_BULL", "WEAK_BEAR"), ("RANGE_BULL", "RANGE_BEAR")
DERAILED, SECOND_TARGET = 0.3, 10.0
#: Words of a closing text and the reason they stand for, first match first.
REASONS = (
    (
        "take profit hit",
        "TAKE_PROFIT",
    ), ("break even", "BREAK_EVEN"), ("locked", "LOCKED_GAIN"), ("trailing", "TRAILING"), ("staged", "STAGED"), ("partial", "PARTIAL"),
    ("stop loss", "STOP_LOSS"), ("derailed", "DERAILED"), ("reversal", "REVERSAL"), ("timeout", "TIMEOUT"),
)


# --- nearest bars


def nearest_bars(events: DataFrame, bars: DataFrame, key: str, piece: str = "DAY") -> DataFrame:
    """events(key, symbol, at) with the nearest bar(symbol, ts, bar_idx) of the symbol, the earlier of
    two equally near, and the seconds between.

    Bars and events are put in order within pieces of time; what the bars before and after a piece are
    comes from one row for each piece that has bars.
    """
    cut = lambda c: F.date_trunc(piece, c)
    b = bars.select("symbol", F.col("ts").alias("at"), F.lit(None).cast(dict(events.dtypes)[key]).alias(key), F.struct("ts", "bar_idx").alias("bar"))
    e = events.select("symbol", "at", key, F.lit(None).cast(dict(b.dtypes)["bar"]).alias("bar"))
    both = b.unionByName(e).withColumn("piece", cut("at"))
    ends = both.where("bar is not null").groupBy("symbol", "piece").agg(F.max("bar").alias("last"), F.min("bar").alias("first"))
    asked = both.select("symbol", "piece").distinct().join(ends, ["symbol", "piece"], "left")
    # What comes after is looked at from the other end: a frame to the end begins anew with every row.
    pieces = lambda o: Window.partitionBy("symbol").orderBy(o("piece")).rowsBetween(Window.unboundedPreceding, -1)
    carried = asked.select("symbol", "piece", F.last("last", True).over(pieces(F.asc)).alias("before_piece"), F.last("first", True).over(pieces(F.desc)).alias("after_piece"))
    inside = lambda o: Window.partitionBy("symbol", "piece").orderBy(o("at")).rangeBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"before": F.last("bar", True).over(inside(F.asc)), "after": F.last("bar", True).over(inside(F.desc))})
    near = near.where("bar is null").join(carried, ["symbol", "piece"], "left")
    before, after = F.coalesce("before", "before_piece"), F.coalesce("after", "after_piece")
    seconds = lambda c: F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(c["ts"].cast("timestamp"))) / 1e6
    earlier = after.isNull() | (seconds(before) <= seconds(after))
    bar = F.when(before.isNotNull() & earlier, before).otherwise(after)
    return near.withColumn("b", bar).select(key, "symbol", "at", F.col("b.bar_idx").alias("bar_idx"), seconds(F.col("b")).alias("seconds"))


# --- while a position is held


def regime_change(entry: str, now: str, side: str) -> Column:
    """SAME, WEAKENED or REVERSED, from the regimes at the entry and now and the side held."""
    e, n, long = F.coalesce(entry, F.lit("")), F.coalesce(now, F.lit("")), F.col(side) == "LONG"
    against = (long & n.isin(*BEARS)) | (~long & n.isin(*BULLS))
    weaker = (e.isin(*BULLS) & n.isin(*BULLS)) | (e.isin(*BEARS) & n.isin(*BEARS))
    weaker = weaker & ((e.isin(*STRONG) & ~n.isin(*STRONG)) | (e.isin(*WEAK) & n.isin(*SIDEWAYS)))
    known = (e != "") & (n != "") & (n != "UNKNOWN")
    return F.when(~known, "SAME").when(against, "REVERSED").when(n.isin(*SIDEWAYS) | weaker, "WEAKENED").otherwise("SAME")


def exit_advice(change: str, similarity: str, status: str, profit: str, peak: str) -> Column:
    """HOLD, TIGHTEN, PARTIAL or LEAVE: what is to be done with a position first."""
    c, s, p, top = F.col(change), F.col(similarity), F.col(profit), F.col(peak)
    given_back = (top >= 1.5) & ((top - p) / top >= 0.5) & (p >= 0.3)
    return (
        F.when((F.col(status) == "DERAIL") | (s < DERAILED), "TIGHTEN")
        .when(c == "REVERSED", F.when(p >= 1.0, "PARTIAL").otherwise("LEAVE"))
        .when((c == "WEAKENED") & (top >= SECOND_TARGET) & (p >= 0.5), "PARTIAL")
        .when((c == "WEAKENED") | ((F.col(status) == "ALERT") & (p >= 1.0)) | given_back, "TIGHTEN")
        .otherwise("HOLD")
    )


def exit_confirmed(hist: str, hist_before: str, j: str, j_before: str, side: str) -> Column:
    """Both the histogram and J have turned against the side; true where a value is missing."""
    h, hb, x, xb = (F.col(c) for c in (hist, hist_before, j, j_before))
    long = ((h < hb) | (h < 0)) & (x < xb)
    short = ((h > hb) | (h > 0)) & (x > xb)
    return F.coalesce(F.when(F.col(side) == "LONG", long).otherwise(short), F.lit(True))


def reversal_votes(regime: str, hist: str, hist_before: str, j: str, j_before: str, side: str) -> Column:
    """How many of regime, histogram and J speak against the side; two are a reversal."""
    h, hb, x, xb = (F.col(c) for c in (hist, hist_before, j, j_before))
    vote = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    down = vote(F.col(regime).isin(*BEARS)) + vote((h < 0) & (h < hb)) + vote((x < xb) & (x < 50))
    up = vote(F.col(regime).isin(*BULLS)) + vote((h > 0) & (h > hb)) + vote((x > xb) & (x > 50))
    return F.when(F.col(side) == "LONG", down).otherwise(up)


def counter_trend_allowed(state: str, side: str, rate: str, triggers: str) -> Column:
    """A long in a falling or a short in a rising state needs its rate there and ten triggers."""
    enough = F.col(triggers) >= 10
    return (
        F.when((F.col(state) == "BULL") & (F.col(side) == "short"), enough & (F.col(rate) >= 0.62))
        .when((F.col(state) == "BEAR") & (F.col(side) == "long"), enough & (F.col(rate) >= 0.74))
        .otherwise(F.lit(True))
    )


def fan_place(price: str, low: str, high: str, median: str, recent_range: str) -> Column:
    """inside the quartiles, edge up to twice the effective range beyond them, else outside."""
    p, lo, hi = F.col(price), F.col(low), F.col(high)
    width = F.greatest(hi - lo, F.abs(median) * 0.0012, F.col(recent_range) * 0.08)
    return F.when(
        lo.isNull() | hi.isNull() | F.col(median).isNull(),
        "unknown",
    ).when(p.between(lo, hi), "inside").when(p.between(lo - 2 * width, hi + 2 * width), "edge").otherwise("outside")


def fixed_exits(price: str, side: str, target: float = 0.006, stop: float = 0.008) -> list[Column]:
    """take_profit and stop_loss of an entry."""
    sign = F.when(F.col(side) == "LONG", 1).otherwise(-1)
    return [(F.col(price) * (1 + sign * target)).alias("take_profit"), (F.col(price) * (1 - sign * stop)).alias("stop_loss")]


# --- after it


def reason_of(text: str) -> Column:
    t, out = F.lower(F.coalesce(text, F.lit(""))), None
    for words, name in REASONS:
        out = F.when(t.contains(words), name) if out is None else out.when(t.contains(words), name)
    return out.otherwise("OTHER")


def peak_advice(reason: str, peak: str, profit: str) -> Column:
    """What the best gain that was not kept says: TAKE_PROFIT, WIDER_STOP or TRAIL_EARLIER."""
    r, top, p = F.col(reason), F.col(peak), F.col(profit)
    return (
        F.when(top <= 0, "")
        .when((top >= 1.2) & (p < top * 0.5) & (r != "TAKE_PROFIT"), "TAKE_PROFIT")
        .when((r == "STOP_LOSS") & (top > F.abs(p) * 0.3), "WIDER_STOP")
        .when((r == "TRAILING") & (p < top * 0.6) & (top >= 1.0), "TRAIL_EARLIER")
        .otherwise("")
    )


def by_reason(orders: DataFrame, last: int = 500) -> DataFrame:
    """Counts, gains, holds, what was lost from the peak and stops that turned, by reason, of the last
    orders by (closed, order_id)."""
    recent = orders.orderBy(F.desc("closed"), F.desc("order_id")).limit(last)
    p, top = F.col("profit_pct"), F.col("peak_pct")
    lost = F.when(top > 0, F.greatest(F.lit(0.0), top - p)).otherwise(0.0)
    turned = (F.col("reason") == "STOP_LOSS") & (top > F.abs(p) * 0.3)
    return recent.groupBy("reason").agg(
        F.count("*").alias("n"), F.sum((F.col("pnl") > 0).cast("long")).alias("wins"), F.sum("pnl").alias("pnl"), F.sum(p).alias("profit_pct"), F.avg("hold").alias("avg_hold"),
        F.avg(lost).alias("avg_peak_loss"), F.sum(turned.cast("long")).alias("turned"),
    )


def regime_table(orders: DataFrame) -> DataFrame:
    """Every side and regime with its orders, zeros kept; no gain is neither a win nor a loss."""
    spark = orders.sparkSession
    domain = F.broadcast(spark.createDataFrame([(s, r) for s in ("LONG", "SHORT") for r in REGIMES], "side string, regime string"))
    won, lost, p = F.col("pnl") > 0, F.col("pnl") < 0, F.col("profit_pct")
    counted = orders.groupBy("side", "regime").agg(
        F.count("*").alias("n"), F.sum(won.cast("long")).alias("wins"), F.sum(lost.cast("long")).alias("losses"), F.avg(F.when(won, p)).alias("avg_win"), F.avg(F.when(lost, p)).alias("avg_loss"), F.avg(p).alias("avg_all"), F.sum("pnl").alias("pnl")
    )
    names = ["n", "wins", "losses", "avg_win", "avg_loss", "avg_all", "pnl"]
    return domain.join(counted, ["side", "regime"], "left").fillna(0, names).withColumn(
        "win_rate",
        F.when(F.col("n") > 0, F.col("wins") / F.col("n")).otherwise(0.0),
    )


def strategy_table(orders: DataFrame) -> DataFrame:
    """Orders by strategy: sides, wins, what was gained, lost and left."""
    of = lambda s: F.sum((F.col("side") == s).cast("long"))
    part = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    return orders.groupBy("strategy").agg(
        F.count("*").alias("n"), of("LONG").alias("long"), of("SHORT").alias("short"), F.sum((F.col("pnl") > 0).cast("long")).alias("wins"),
        part(F.col("pnl") > 0, F.col("pnl")).alias("gained"), part(F.col("pnl") < 0, -F.col("pnl")).alias("lost"), F.sum("pnl").alias("net"),
    )


def accounts(orders: DataFrame, balance: float = 5000.0) -> DataFrame:
    """Balance, peak, greatest fall, sides, wins and streaks of each account(symbol) in order of
    (closed, order_id): a ledger is read in order, with a few numbers carried along."""

    def walk(rows: Iterator[tuple[tuple, bool]]) -> Iterator[tuple]:
        now = peak = balance
        fall = fall_pct = 0.0
        n = wins = longs = long_wins = lost_in_a_row = worst = 0
        for (_, side, pnl), last in rows:
            now, n, won, long = now + pnl, n + 1, pnl > 0, side == "LONG"
            peak = max(peak, now)
            if peak - now > fall:
                fall, fall_pct = peak - now, (peak - now) / peak * 100
            wins, longs, long_wins = wins + won, longs + long, long_wins + (won and long)
            lost_in_a_row = 0 if won else lost_in_a_row + 1
            worst = max(worst, lost_in_a_row)
            if last:
                yield n, wins, longs, long_wins, n - longs, wins - long_wins, now, peak, fall, fall_pct, lost_in_a_row, worst

    names = ["n", "wins", "longs", "long_wins", "shorts", "short_wins", "balance", "peak", "drawdown", "drawdown_pct", "loss_streak", "worst_streak"]
    kinds = ", ".join(f"{n} {'double' if n in ('balance', 'peak', 'drawdown', 'drawdown_pct') else 'long'}" for n in names)
    return _walked(orders.select("symbol", F.struct("closed", "order_id").alias("bar_idx"), "side", "pnl"), ["bar_idx", "side", "pnl"], walk, names, kinds)


def upserted(own: DataFrame, new: DataFrame) -> DataFrame:
    """Orders by key (side, opened, entry price to 8 places): a later version takes the place of the
    one before."""
    key = F.concat_ws("|", "side", F.col("opened").cast("string"), F.format_number("entry", 8))
    both = own.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1))).withColumn("trade_key", key)
    rank = F.row_number().over(Window.partitionBy("trade_key").orderBy(F.desc("__v"), F.desc("closed"), F.desc("order_id")))
    return both.withColumn("__r", rank).where("__r = 1").drop("__r", "__v")
