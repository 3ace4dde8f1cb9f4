"""Feature vectors: 44 own-timeframe features, 8 multi-timeframe ones, and the 32 layered ones.

Values are SQL over the indicator table; a null value becomes 0 after clipping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.bars import aggregate_bars

_rel = "({0} - {1}) / ({1} + 1e-9)"

#: Fixed values, here and below: the names by which models know the features.
TREND = {
    "trend_ma_cross_5_10": "tanh((ma5 - ma10) / (ma10 + 1e-9) * 100)",
    "trend_ma_cross_10_20": "tanh((ma10 - ma20) / (ma20 + 1e-9) * 100)",
    "trend_ma_cross_20_60": "tanh((ma20 - ma60) / (ma60 + 1e-9) * 100)",
    "trend_ema_slope_12": "tanh(coalesce((ema12 - ema12_5) / (ema12_5 + 1e-9) * 100, 0))",
    "trend_ema_slope_26": "tanh(coalesce((ema26 - ema26_5) / (ema26_5 + 1e-9) * 100, 0))",
    "trend_price_vs_ma5": "tanh(close_vs_ma5 / 5)",
    "trend_price_vs_ma20": "tanh(close_vs_ma20 / 5)",
    "trend_adx": "(adx - 25) / 25",
}
_RSI_MOVE = "coalesce(rsi - rsi_10, CASE WHEN bar_idx < 10 THEN 0 END)"
MOMENTUM = {
    "mom_rsi": "(rsi - 50) / 50",
    "mom_rsi_fast": "(rsi_fast - 50) / 50",
    "mom_rsi_divergence": f"CASE WHEN sign({_RSI_MOVE}) <> sign(coalesce(close - c10, 0)) THEN sign({_RSI_MOVE}) ELSE 0 * {_RSI_MOVE} END",
    "mom_macd": "tanh(macd / (close * 0.001e0 + 1e-9))",
    "mom_macd_hist": "tanh(macd_hist / (close * 0.0005e0 + 1e-9))",
    "mom_macd_cross": "coalesce(sign(macd - macd_signal) - sign(macd_prev - signal_prev), 0)",
    "mom_kdj_k": "(k - 50) / 50",
    "mom_kdj_j": "(j - 50) / 50",
    "mom_kdj_cross": "coalesce(sign(k - d) - sign(k_prev - d_prev), 0)",
    "mom_roc": "tanh(roc / 5)",
}
VOLATILITY = {
    "vol_atr_ratio": f"tanh({_rel.format('atr', 'atr_ma')})",
    "vol_boll_width": f"tanh({_rel.format('boll_width', 'boll_width_ma')})",
    "vol_boll_position": "boll_position * 2 - 1",
    "vol_amplitude": f"tanh({_rel.format('amplitude', 'amp_ma')})",
    "vol_expansion": "CASE WHEN atr > atr_ma * 1.5e0 THEN 1 ELSE 0 END",
    "vol_squeeze": "vol_squeeze",
    "vol_atr_percentile": "atr_rank50 * 2 - 1",
    "vol_range_ratio": "tanh((high - low - range_ma) / (range_ma + 1e-9))",
}
VOLUME = {
    "volm_ratio": "tanh((volume_ratio - 1) * 2)",
    "volm_trend": f"tanh({_rel.format('volume_ma5', 'volume_ma20')})",
    "volm_obv_slope": "tanh(obv_slope)",
    "volm_price_confirm": "CASE WHEN sign(coalesce(volume - pvolume, 0)) = sign(coalesce(close - pc, 0)) THEN 1 ELSE -1 END",
    "volm_climax": "volume_spike",
    "volm_dry_up": "CASE WHEN volume < volume_ma20 * 0.5e0 THEN 1 ELSE 0 END",
    "volm_vwap_position": "tanh(close_vs_vwap / 2)",
    "volm_accumulation": "tanh((ad - ad_ma) / (abs(ad_ma) + 1e-9))",
}
PRICE_ACTION = {
    "pa_body_ratio": "body_ratio * 2 - 1",
    "pa_shadow_ratio": "(upper_shadow + lower_shadow) / (high - low + 1e-9) * 2 - 1",
    "pa_trend_count": "tanh(trend_count / 5)",
    "pa_engulfing": "engulfing",
    "pa_pin_bar": "pin_bar",
    "pa_inside_bar": "inside_bar",
    "pa_dist_support": "1 - dist_to_support * 2",
    "pa_dist_resistance": "dist_to_resistance * 2 - 1",
    "pa_higher_high": "CASE WHEN bar_idx >= 20 AND high > prev_high20 THEN 1 ELSE 0 END",
    "pa_lower_low": "CASE WHEN bar_idx >= 20 AND low < prev_low20 THEN 1 ELSE 0 END",
}
GROUPS = {"trend": TREND, "momentum": MOMENTUM, "volatility": VOLATILITY, "volume": VOLUME, "price_action": PRICE_ACTION}


def clipped(x: str) -> str:
    """To [-1, 1]; null to 0."""
    return f"coalesce(CAST(CASE WHEN ({x}) > 1 THEN 1 WHEN ({x}) < -1 THEN -1 ELSE ({x}) END AS double), 0)"


#: Layer A, B and C: name, SQL, digits kept (half-even).
LAYER_A = (
    ("rsi", 3), ("rsi_fast", 3), ("macd_hist", 3), ("k", 3), ("j", 3), ("roc", 3), ("atr / (close + 1e-9)", 6), ("boll_width", 6), ("boll_position", 3),
    ("upper_shadow / (high - low + 1e-9)", 3), ("lower_shadow / (high - low + 1e-9)", 3), ("(close - ema12) / (ema12 + 1e-9) * 100", 3),
    ("(close - ema26) / (ema26 + 1e-9) * 100", 3), ("adx", 3), ("volume_ratio", 3), ("obv_slope", 3),
)
LAYER_B = (
    ("rsi - rsi_3", 3), ("rsi - rsi_5", 3), ("macd_hist - macd_hist_3", 3), ("macd_hist - macd_hist_5", 3), ("atr / (atr_5 + 1e-9)", 3), (
        "boll_width - boll_width_3",
        6,
    ),
    ("ema12_step - ema12_step_3", 3), ("ema26_step - ema26_step_3", 3), ("volume_ratio - volume_ratio_3", 3), ("adx - adx_5", 3),
)
_ATR = "CASE WHEN atr > 0 THEN atr ELSE 1 END"
LAYER_C = (
    ("(close - low20) / (high20 - low20 + 1e-9)", 3), (f"(high20 - close) / ({_ATR})", 3), (f"(close - low20) / ({_ATR})", 3), ("ups20 / (downs20 + 1e-9)", 3),
    ("1 - (high20 - close) / (high20 - low20 + 1e-9)", 3), ("1 - (close - low20) / (high20 - low20 + 1e-9)", 3),
)
LAYER_WEIGHTS = {"a": 1.5, "b": 1.2, "c": 1.0}


def layer_columns(half_even: str = "bround") -> dict[str, str]:
    """a0..a15, b0..b9, c0..c5 as SQL; half_even names the engine's function."""
    out = {}
    for letter, layer in (("a", LAYER_A), ("b", LAYER_B), ("c", LAYER_C)):
        for i, (x, digits) in enumerate(layer):
            out[f"{letter}{i}"] = f"coalesce({half_even}({x}, {digits}), 0)"
    return out


def atr_ranks(table: DataFrame) -> DataFrame:
    """atr_rank50: the share of the 50 bars before that have a smaller ATR; 0 before bar 50."""
    from tidemark.functions.windows import frame, only_own, with_halo

    rank = "CASE WHEN bar_idx >= 50 THEN coalesce(size(filter(before, x -> x < atr)), 0) / 50 ELSE 0 END"
    held = with_halo(table, 64).selectExpr("*", frame("collect_list", "atr", "50 PRECEDING", "1 PRECEDING") + " AS before")
    return only_own(held.selectExpr("*", f"{rank} AS atr_rank50").drop("before"))


def features(table: DataFrame, groups=tuple(GROUPS)) -> DataFrame:
    """symbol, bar_idx and the features of the groups."""
    ranked = atr_ranks(table) if "volatility" in groups else table
    return ranked.selectExpr("symbol", "bar_idx", *[f"{clipped(x)} AS {n}" for g in groups for n, x in GROUPS[g].items()])


def group_trend(bars: DataFrame, k: int, containing: bool = True) -> DataFrame:
    """symbol, bar_idx, group trend of bars of k: a bar looks at the group that holds it, or, where
    containing is False, at the last closed one, which does not see the future."""
    groups = aggregate_bars(bars, k)
    last = groups.groupBy("symbol").agg(F.max("bar_idx").alias("last"))
    w = Window.partitionBy("symbol").orderBy("bar_idx")
    ma = F.avg("close").over(w.rowsBetween(-4, 0))
    wide = groups.select(
        "symbol",
        F.col("bar_idx").alias("g"),
        F.col("close").alias("g_close"),
        F.when(F.row_number().over(w) >= 5, ma).alias("g_ma5"),
        (F.col("high") - F.col("low")).alias("g_range"),
    )
    place = F.expr(f"bar_idx div {k}") - (0 if containing else 1)
    placed = bars.join(F.broadcast(last), "symbol").withColumn("g", F.least(place, "last"))  # a row for each symbol
    return placed.join(wide, ["symbol", "g"], "left").select(
        "symbol", "bar_idx", "g", F.tanh((F.col("g_close") - F.col("g_ma5")) / (F.col("g_ma5") + 1e-9) * 100).alias("g_trend"), "g_range"
    )


#: Names of the features of two longer timeframes, and of their agreement.
LONGER = ("mtf_1h_trend", "mtf_1h_rsi", "mtf_1h_ema_slope", "mtf_1h_volatility", "mtf_4h_trend", "mtf_4h_rsi", "mtf_trend_align", "mtf_momentum_align")


def _longer(bars: DataFrame, table: DataFrame, k: int, names: dict[str, str], containing: bool) -> DataFrame:
    """table with columns of the indicators over bars of k: of the group that holds a bar, or, where
    containing is False, of the last closed one, which does not see the future."""
    from tidemark.functions.windows import lag, only_own, roll, with_halo
    from tidemark.operators.indicators import indicators

    groups = only_own(with_halo(indicators(aggregate_bars(bars, k)), 32).selectExpr("*", f"{lag('ema12', 3)} AS ema12_3", f"{roll('avg', 'atr', 20, 13)} AS atr_ma20"))
    last = groups.groupBy("symbol").agg(F.max("bar_idx").alias("__last"))
    place = F.expr(f"bar_idx div {k}") - (0 if containing else 1)
    placed = table.join(last, "symbol", "left").withColumn("__g", F.least(place, "__last"))
    wide = groups.selectExpr("symbol", "bar_idx AS __g", *[f"{x} AS {n}" for n, x in names.items()])
    return placed.join(wide, ["symbol", "__g"], "left").drop("__g", "__last")


def multi_timeframe(bars: DataFrame, table: DataFrame, k: int = 60, longer_k: int = 240, containing: bool = True) -> DataFrame:
    """symbol, bar_idx and LONGER, for the indicator table of bars and groups of k and longer_k bars."""
    trend, force = "tanh((ema12 - ema26) / (ema26 + 1e-9) * 100)", "(rsi - 50) / 50"
    first = {"__t1": trend, "__r1": force, "__s1": "tanh((ema12 - ema12_3) / (ema12_3 + 1e-9) * 100)", "__v1": "tanh((atr - atr_ma20) / (atr_ma20 + 1e-9))"}
    t = table.selectExpr("symbol", "bar_idx", f"{trend} AS __t0", f"{force} AS __r0")
    t = _longer(bars, _longer(bars, t, k, first, containing), longer_k, {"__t2": trend, "__r2": force}, containing)
    t = t.selectExpr("symbol", "bar_idx", "__t0", "__r0", *[f"coalesce({c}, 0e0) AS {c}" for c in ("__t1", "__r1", "__s1", "__v1", "__t2", "__r2")])
    align = lambda own, a, b: f"coalesce(IF(sign({own}) = sign({a}), 0.5e0, 0e0) + IF(sign({own}) = sign({b}), 0.5e0, 0e0), 0e0) * 2 - 1"
    values = ("__t1", "__r1", "__s1", "__v1", "__t2", "__r2", align("__t0", "__t1", "__t2"), align("__r0", "__r1", "__r2"))
    return t.selectExpr("symbol", "bar_idx", *[f"{clipped(x)} AS {n}" for n, x in zip(LONGER, values, strict=True)])


def all_features(bars: DataFrame, table: DataFrame, k: int = 60, longer_k: int = 240, containing: bool = True) -> DataFrame:
    """symbol, bar_idx and the 52 features in order, clipped and filled."""
    return features(table).join(multi_timeframe(bars, table, k, longer_k, containing), ["symbol", "bar_idx"])


def at_labels(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """The vectors of the bars with a label other than 0, and the label."""
    return vectors.join(labels.where("label <> 0").select("symbol", "bar_idx", "label"), ["symbol", "bar_idx"])


def layers(table: DataFrame) -> DataFrame:
    return table.selectExpr("symbol", "bar_idx", *[f"{x} AS {n}" for n, x in layer_columns().items()])


def coordinates(layered: DataFrame) -> DataFrame:
    """A, B, C: each layer's sum under its weight."""
    sums = {n: " + ".join(f"{n}{i}" for i in range(size)) for n, size in (("a", 16), ("b", 10), ("c", 6))}
    return layered.selectExpr("symbol", "bar_idx", *[f"round({LAYER_WEIGHTS[n]}D * ({s}), 3) AS {n}" for n, s in sums.items()])
