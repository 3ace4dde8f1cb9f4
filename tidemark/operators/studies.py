"""Studies over indicators, trades and outcomes: contrasts, quantiles, fans, folds, gates, latches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import CHUNK, frame, lag, last_known, only_own, with_halo
from tidemark.operators.distributions import quantiles

CONTRASTED = ("rsi", "boll_position", "roc", "volume_ratio", "ma5_slope")


def contrast(trades: DataFrame, table: DataFrame, names=CONTRASTED) -> DataFrame:
    """feature, means and deviations at the entries of long and short trades, effect size, midpoint."""
    at = trades.select("symbol", F.col("entry_idx").alias("bar_idx"), "side").join(table.select("symbol", "bar_idx", *names), ["symbol", "bar_idx"])
    long_form = at.select(
        "side",
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])).alias("e"),
    ).select("side", "e.feature", "e.x")
    s = lambda f, side, name: f(F.when(F.col("side") == side, F.col("x"))).alias(name)
    stats = long_form.groupBy("feature").agg(
        s(F.avg, "long", "long_mean"),
        s(F.avg, "short", "short_mean"),
        s(F.stddev_pop, "long", "long_sd"),
        s(F.stddev_pop, "short", "short_sd"),
    )
    return stats.selectExpr(
        "*",
        "(long_mean - short_mean) / (sqrt((long_sd * long_sd + short_sd * short_sd) / 2) + 1e-9) AS effect",
        "(long_mean + short_mean) / 2 AS midpoint",
    )


def hold_quantiles(trades: DataFrame) -> DataFrame:
    """Exact, interpolated quantiles of holding times and profits by side."""
    shares, names = (0.1, 0.25, 0.5, 0.75, 0.9), ("hold", "profit_pct")
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in names])
    got = quantiles(trades.select("side", F.explode(measures).alias("m")).select("side", "m.*"), ["side", "measure"], "x", list(shares))
    one = lambda c, q: F.max(F.when((F.col("measure") == c) & (F.col("share") == q), F.col("value")))
    return got.groupBy("side").agg(*[one(c, q).alias(f"{c}_q{round(q * 100)}") for c in names for q in shares])


def fan(points: DataFrame, bars: DataFrame, length: int = 20) -> DataFrame:
    """offset, n, p25, median, p75 of the change in percent after swing lows."""
    start = points.where("NOT is_high").select("symbol", "bar_idx", "price", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("offset"))
    to = start.withColumn("bar_idx", F.col("bar_idx") + F.col("offset")).join(bars.select("symbol", "bar_idx", "close"), ["symbol", "bar_idx"])
    changes = to.select("offset", ((F.col("close") / F.col("price") - 1) * 100).alias("change"))
    named = ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))
    got = quantiles(changes, ["offset"], "change", [q for q, _ in named])
    wide = got.groupBy("offset").agg(*[F.max(F.when(F.col("share") == q, F.col("value"))).alias(name) for q, name in named])
    return changes.groupBy("offset").agg(F.count("*").alias("n")).join(wide, "offset")


def walk_forward_folds(bars: DataFrame, length: int, step: int, shares=(0.6, 0.2)) -> DataFrame:
    """symbol, fold, part, n, first and last bar of sliding train, validation and test ranges."""
    train, validate = int(length * shares[0]), int(length * (shares[0] + shares[1]))
    n = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))
    starts = n.where(F.col("n") >= length).select("symbol", F.explode(F.expr(f"sequence(0L, (n - {length}) div {step})")).alias("fold"))
    ranges = [("train", 0, train), ("validate", train, validate), ("test", validate, length)]
    rows = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for p, a, b in ranges])
    return starts.select("symbol", "fold", F.explode(rows).alias("r")).selectExpr(
        "symbol",
        "fold",
        "r.part AS part",
        f"fold * {step} + r.a AS first",
        f"fold * {step} + r.b - 1 AS last",
    )


def histogram_gate(table: DataFrame, bars: int = 5) -> DataFrame:
    """Slope of the MACD histogram over the last bars, and the side that it lets through."""
    over = f"OVER (PARTITION BY symbol, chunk ORDER BY bar_idx ROWS BETWEEN {bars - 1} PRECEDING AND CURRENT ROW)"
    held = with_halo(table.select("symbol", "bar_idx", "macd_hist"), 8).selectExpr(
        "*",
        f"CASE WHEN bar_idx >= {bars - 1} THEN regr_slope(macd_hist, cast(bar_idx AS double)) {over} END AS slope",
    )
    return only_own(held).selectExpr("symbol", "bar_idx", "slope", gate_sql())  # no slope: none


def gate_sql() -> str:
    return "CASE WHEN slope > 0 AND macd_hist > 0 THEN 'long' WHEN slope < 0 AND macd_hist < 0 THEN 'short' ELSE 'none' END AS side"


def latched(states: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A state that changes only after two equal readings in a row; RANGE before the first."""
    held = only_own(with_halo(states, 4).selectExpr("*", f"CASE WHEN state = {lag('state')} THEN state END AS latched"))
    return last_known(held, "latched", chunk).select("symbol", "bar_idx", "state", F.coalesce("latched", F.lit("RANGE")).alias("latched"))


def golden_cross(table: DataFrame, ahead: int = 30, goal: float = 1.0, stop: float = 0.5) -> DataFrame:
    """Outcome in percent of each crossing of J over D: the goal is looked at before the stop."""
    return crossings(table.withColumn("crossed", F.expr("j > d AND j_prev <= d_prev")), ahead, goal, stop)


def crossings(table: DataFrame, ahead: int = 30, goal: float = 1.0, stop: float = 0.5) -> DataFrame:
    """The same for every bar of table(symbol, bar_idx, close, high, low, crossed) that has crossed; bars
    with fewer than `ahead` after them are out."""
    after = ("1 FOLLOWING", f"{ahead} FOLLOWING")
    held = with_halo(table.select("symbol", "bar_idx", "close", "high", "low", "crossed"), 0, ahead + 1)
    wide = held.selectExpr(
        "*",
        f"{frame('max', 'high', *after)} AS top",
        f"{frame('min', 'low', *after)} AS bottom",
        f"{frame('count', '*', *after)} AS n",
        f"lead(close, {ahead}) OVER (PARTITION BY symbol, chunk ORDER BY bar_idx) AS last",
    )
    crossed = only_own(wide).where(f"n = {ahead} AND crossed")
    return crossed.selectExpr("symbol", "bar_idx", cross_sql(goal, stop))


def cross_sql(goal: float = 1.0, stop: float = 0.5) -> str:
    return f"CASE WHEN (top / close - 1) * 100 >= {goal}e0 THEN {goal}e0 WHEN (bottom / close - 1) * 100 <= -{stop}e0 THEN -{stop}e0 ELSE (last / close - 1) * 100 END AS outcome"


def feature_trends(table: DataFrame, names: list[str], last: int = 60) -> DataFrame:
    """Slope of each feature over a symbol's last bars, in deviations a bar."""
    ends = table.groupBy("symbol").agg(F.max("bar_idx").alias("end"))
    tail = table.join(F.broadcast(ends), "symbol").where(F.col("bar_idx") > F.col("end") - last)  # a row for each symbol
    long_form = tail.select(
        "symbol",
        F.col("bar_idx").cast("double").alias("t"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x")) for n in names])).alias("e"),
    )
    got = long_form.groupBy("symbol", F.col("e.feature").alias("feature")).agg(
        F.regr_slope(F.col("e.x"), F.col("t")).alias("slope"),
        F.stddev_pop("e.x").alias("sd"),
    )
    return got.select("symbol", "feature", (F.col("slope") / F.when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0)).alias("trend"))


def position_score_sql(long: bool) -> str:
    """How well a bar is placed for an entry, from -100 to 100: band, oversold, nearness to support or
    resistance, volume, reversal candle, and a discount for strong trends; missing values are neutral."""
    unit = lambda x: f"greatest(0e0, least(1e0, coalesce({x}, 0.5e0)))"
    band = unit("boll_position")
    parts = [
        f"(1 - {band}) * 50 - 25" if long else f"{band} * 50 - 25",
        f"CASE WHEN coalesce(rsi, 50) {'< 30' if long else '> 70'} THEN 20 ELSE 0 END",
        f"(1 - {unit('dist_to_support' if long else 'dist_to_resistance')}) * 40 - 20",
        f"CASE WHEN coalesce(obv_slope, 0) {'>' if long else '<'} 0 AND coalesce(volume_ratio, 1) > 1 THEN 15 ELSE 0 END",
        f"CASE WHEN (pin_bar = {1 if long else -1} OR engulfing = {1 if long else -1}) AND {band} {'< 0.4e0' if long else '> 0.6e0'} THEN 10 ELSE 0 END",
        "greatest(-10e0, least(10e0, (25 - coalesce(adx, 25)) * 0.5e0))",
    ]
    return "greatest(-100e0, least(100e0, " + " + ".join(f"({p})" for p in parts) + "))"


def holdout_ranges(bars: DataFrame, last: int = 300_000, share: float = 0.3, folds: int = 3) -> DataFrame:
    """symbol, part, first, last: of a symbol's last bars the closing share is held out, and what is
    before is cut into equal inner folds (the last takes the rest)."""
    ends = bars.groupBy("symbol").agg((F.max("bar_idx") + 1).alias("n"))
    sized = ends.select(
        "symbol",
        "n",
        F.greatest(F.col("n") - last, F.lit(0)).alias("start"),
    ).withColumn("cut", F.col("n") - F.floor((F.col("n") - F.col("start")) * share))
    size = "((cut - start) div {})".format(folds)
    rows = ", ".join(f"named_struct('part', 'fold {i + 1}', 'a', start + {i} * {size}, 'b', {'cut' if i == folds - 1 else f'start + {i + 1} * {size}'})" for i in range(folds))
    each = F.explode(F.expr(f"array({rows}, named_struct('part', 'holdout', 'a', cut, 'b', n))")).alias("r")
    return sized.select("symbol", each).selectExpr("symbol", "r.part AS part", "r.a AS first", "r.b - 1 AS last")


#: The trend gate's least slope, its allowance about zero, what a strong and a weak trend
#: may pull back, and the position score that rescues.
SLOPE_MIN, ZERO_FLOOR, STRONG_PULL, WEAK_PULL, RESCUE_SCORE = 0.003, 3.0, 20.0, 10.0, 40.0


def trend_gate(slope: str, hist: str, side: str, regime: str, score: str, window: int = 5) -> Column:
    """ok, bypass, rescued, slope, zero_axis or missing: how the slope of the MACD histogram lets a side in.

    With the regime's trend only a pull-back counts; else the slope must point along and the histogram
    lie within its allowance about zero, which a sideways regime or a good position waives.
    """
    way = F.when(F.col(side) == "LONG", 1.0).otherwise(-1.0)
    s, h, r = F.col(slope) * way, F.col(hist) * way, F.coalesce(F.col(regime), F.lit(""))
    own = F.when(F.col(side) == "LONG", "BULL").otherwise("BEAR")
    strong, weak = r == F.concat(F.lit("STRONG_"), own), r == F.concat(F.lit("WEAK_"), own)
    within = h >= -F.greatest(F.abs(F.col(slope)) * window, F.lit(ZERO_FLOOR))
    rescue = r.startswith("RANGE") | (F.coalesce(F.col(score), F.lit(0.0)) >= RESCUE_SCORE)
    pull = F.when(strong, STRONG_PULL).otherwise(WEAK_PULL)
    return (
        F.when(s.isNull() | h.isNull(), "missing")
        .when(strong | weak, F.when(h > -pull, "bypass").otherwise("slope"))
        .when(s <= SLOPE_MIN, "slope")
        .when(within, "ok")
        .when(rescue, "rescued")
        .otherwise("zero_axis")
    )


def first_failing(gates: dict[str, Column]) -> Column:
    """The code of the first gate whose condition is not true; null where all are."""
    return F.coalesce(*[F.when(~F.coalesce(c, F.lit(False)), code) for code, c in gates.items()])
