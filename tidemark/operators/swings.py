"""Swing points, labels, the trades they imply, regimes, and statistics of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import frame, only_own, with_halo

SPAN = 5
MIN_SWINGS, LAST_SWINGS = 3, 4
DIRECTION, STRENGTH = 0.003, 0.003
REGIMES = ("STRONG_BULL", "WEAK_BULL", "RANGE_BULL", "RANGE_BEAR", "WEAK_BEAR", "STRONG_BEAR", "UNKNOWN")


def swing_points(bars: DataFrame, span: int = SPAN) -> DataFrame:
    """symbol, bar_idx, price, is_high of bars that no bar within span exceeds; both kinds on one
    bar count as a high.  Looks ahead by span bars."""
    around = ("{0} PRECEDING".format(span), "{0} FOLLOWING".format(span))
    held = with_halo(bars, span + 1, span + 1).selectExpr(
        "symbol", "bar_idx", "high", "low", "own", "chunk", f"{frame('max', 'high', *around)} AS top", f"{frame('min', 'low', *around)} AS bottom", f"{frame('count', '*', *around)} AS seen"
    )
    full = only_own(held).where(f"seen = {2 * span + 1} AND (high >= top OR low <= bottom)")
    return full.selectExpr("symbol", "bar_idx", "high >= top AS is_high", "IF(high >= top, high, low) AS price")


def alternating(swings: DataFrame) -> DataFrame:
    """One point, the first most extreme, of every run of highs or of lows."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    turns = swings.withColumn("new", F.coalesce(F.lag("is_high").over(w) != F.col("is_high"), F.lit(True)).cast("int"))
    runs = turns.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by(F.struct("bar_idx", "price"), F.struct(F.when(F.col("is_high"), -F.col("price")).otherwise(F.col("price")), "bar_idx"))
    return runs.groupBy("symbol", "run", "is_high").agg(best.alias("p")).select("symbol", "run", "is_high", "p.bar_idx", "p.price")


def label_trades(points: DataFrame) -> DataFrame:
    """Trades that flip at each alternating point: long from a low, short from a high."""
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    exits = points.select(
        "symbol",
        "bar_idx",
        "is_high",
        "price",
        F.lead("bar_idx").over(w).alias("exit_idx"),
        F.lead("price").over(w).alias("exit_price"),
    ).where("exit_idx is not null")
    sign = F.when(F.col("is_high"), -1.0).otherwise(1.0)
    return exits.select(
        "symbol", F.col("bar_idx").alias("entry_idx"), "exit_idx", F.when(
            F.col("is_high"),
            "short",
        ).otherwise("long").alias("side"), F.col("price").alias("entry_price"), "exit_price",
        (sign * (F.col("exit_price") - F.col("price")) / F.col("price") * 100).alias("profit_pct"), (F.col("exit_idx") - F.col("bar_idx")).alias("hold"),
    )


def trade_stats(trades: DataFrame, *keys: str) -> DataFrame:
    """Win rate, profit factor (null without losses), averages, and the ratio of mean to deviation."""
    p = F.col("profit_pct")
    gain, loss = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, -p).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((p > 0).cast("int")).alias("win_rate"), gain.alias("gross_gain"), loss.alias("gross_loss"), F.when(
            loss > 0,
            gain / loss,
        ).alias("profit_factor"),
        F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), F.when(
            F.stddev_pop(p) > 0,
            F.avg(p) / F.stddev_pop(p),
        ).alias("sharpe"), F.avg("hold").alias("avg_hold"),
    )


def drawdown(trades: DataFrame) -> DataFrame:
    """Greatest fall of the running sum of profits from its peak, by symbol."""
    w = Window.partitionBy("symbol").orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    equity = trades.withColumn("equity", F.sum("profit_pct").over(w)).withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(0.0)))
    return equity.groupBy("symbol").agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"), F.max_by("equity", "entry_idx").alias("final_equity"))


def regimes(points: DataFrame, at: DataFrame) -> DataFrame:
    """at(symbol, bar_idx) with the regime told by the last four points before each.

    A point is good for the bars up to the next one, so that each bar takes the one interval
    it falls in, by an equi-join on coarse pieces of bar_idx and a range inside.
    """
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    last = w.rowsBetween(-(LAST_SWINGS - 1), 0)
    held = points.select(
        "symbol", "bar_idx", F.lead("bar_idx").over(w).alias("until"),
        F.collect_list(F.struct("bar_idx", "is_high", "price")).over(last).alias("l"),
    )
    trend = lambda high: f"(element_at(filter(l, x -> x.is_high = {high}), -1).price - filter(l, x -> x.is_high = {high})[0].price) / filter(l, x -> x.is_high = {high})[0].price"
    enough = f"size(l) >= {MIN_SWINGS} AND size(filter(l, x -> x.is_high)) >= 2 AND size(filter(l, x -> NOT x.is_high)) >= 2"
    moves = "aggregate(sequence(1, size(l) - 1), 0e0, (a, i) -> a + abs(l[i].price - l[i - 1].price)) / (size(l) - 1)"
    mean = "aggregate(l, 0e0, (a, x) -> a + x.price) / size(l)"
    told = held.selectExpr(
        "symbol",
        "bar_idx AS since",
        "until",
        f"IF({enough}, ({trend('true')} + {trend('false')}) / 2, null) AS direction",
        f"IF({enough}, ({moves}) / ({mean}), null) AS strength",
    )
    piece = 4096
    ends = at.groupBy("symbol").agg(F.max("bar_idx").alias("end"))
    told = told.join(ends, "symbol").withColumn("to", F.least(F.coalesce("until", "end"), F.col("end"))).where("to > since")
    spans = told.withColumn("piece", F.explode(F.expr(f"sequence((since + 1) div {piece}, to div {piece})")))
    bars = at.withColumn("piece", F.expr(f"bar_idx div {piece}"))
    joined = bars.alias("b").join(
        spans.alias("s"),
        (F.col("b.symbol") == F.col("s.symbol")) & (F.col("b.piece") == F.col("s.piece")) & (F.col("bar_idx") > F.col("since")) & (F.col("bar_idx") <= F.coalesce("until", F.lit(2**62))),
        "left",
    )
    return joined.selectExpr("b.symbol", "bar_idx", "direction", "strength", f"{regime_sql()} AS regime")


def regime_sql() -> str:
    strong = f"strength >= {STRENGTH}"
    return (
        f"CASE WHEN direction IS NULL THEN 'UNKNOWN' WHEN direction > {DIRECTION} THEN CASE WHEN {strong} THEN 'STRONG_BULL' ELSE 'WEAK_BULL' END "
        f"WHEN direction < -{DIRECTION} THEN CASE WHEN {strong} THEN 'STRONG_BEAR' ELSE 'WEAK_BEAR' END WHEN direction >= 0 THEN 'RANGE_BULL' ELSE 'RANGE_BEAR' END"
    )


def regime_stats(trades: DataFrame) -> DataFrame:
    """Counts and rates for every direction and regime, zeros kept."""
    spark = trades.sparkSession
    domain = F.broadcast(spark.createDataFrame([(s, r) for s in ("long", "short") for r in REGIMES], "side string, regime string"))
    counted = trades.groupBy("side", "regime").agg(
        F.count("*").alias("n"),
        F.sum((F.col("profit_pct") > 0).cast("long")).alias("wins"),
        F.avg("profit_pct").alias("avg_profit"),
    )
    out = domain.join(counted, ["side", "regime"], "left").fillna(0, ["n", "wins", "avg_profit"])
    return out.withColumn("win_rate", F.when(F.col("n") > 0, F.col("wins") / F.col("n")).otherwise(0.0))


def swing_pairs(points: DataFrame, atrs: DataFrame, least: int = 30, most: int = 480, ratio: float = 1.5) -> DataFrame:
    """symbol, side, entry_idx, exit_idx, entry_price, exit_price, profit: from each low to later highs
    (long) and from each high to later lows (short), least to most bars on, whose gain is ratio times
    the ATR at the entry or more (1 % of the price without one): a range join on pieces of `most` bars."""
    risk = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.col("price") * 0.01)
    known = points.join(atrs.select("symbol", "bar_idx", "atr"), ["symbol", "bar_idx"], "left")
    start = known.select(
        "symbol",
        F.col("is_high").alias("from_high"),
        F.col("bar_idx").alias("entry_idx"),
        F.col("price").alias("entry_price"),
        risk.alias("risk"),
    )
    dealt = start.withColumn("piece", F.explode(F.expr(f"sequence((entry_idx + {least}) div {most}, (entry_idx + {most}) div {most})")))
    end = points.select(
        "symbol",
        (~F.col("is_high")).alias("from_high"),
        F.col("bar_idx").alias("exit_idx"),
        F.col("price").alias("exit_price"),
        F.expr(f"bar_idx div {most}").alias("piece"),
    )
    joined = dealt.join(end, ["symbol", "from_high", "piece"]).where(F.col("exit_idx").between(F.col("entry_idx") + least, F.col("entry_idx") + most))
    profit = F.when(F.col("from_high"), F.col("entry_price") - F.col("exit_price")).otherwise(F.col("exit_price") - F.col("entry_price"))
    fit = joined.withColumn("profit", profit).where((F.col("profit") > 0) & (F.col("profit") / F.col("risk") >= ratio))
    return fit.select(
        "symbol",
        F.when(F.col("from_high"), "short").otherwise("long").alias("side"),
        "entry_idx",
        "exit_idx",
        "entry_price",
        "exit_price",
        "profit",
    )


def first_of_runs(points: DataFrame) -> DataFrame:
    """The first point of every run of highs or of lows."""
    before = F.lag("is_high").over(Window.partitionBy("symbol").orderBy("bar_idx"))
    return points.withColumn("__before", before).where("__before IS NULL OR __before <> is_high").drop("__before")
