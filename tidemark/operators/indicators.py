"""Technical indicators of bars, as steps of SQL projections over ordered windows.

STEPS and AFTER_EWM hold the definitions, with {lag}-like helpers already written out for a given
partition key, so that the same text runs over pieces with halos here and over whole symbols
in a check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.windows import ewm, frame, lag, only_own, roll, running, with_halo

BARS = ["symbol", "bar_idx", "ts", "open", "high", "low", "close", "volume"]
#: Bars that windows look back at most, and exponential averages of the first and second order.
BACK, REACH = 160, (512, 256)
#: name: (input, alpha, first bar).  Spans 12, 26 and 9; com 2.
EWM_FIRST = {"ema12": ("close", 2 / 13, 0), "ema26": ("close", 2 / 27, 0), "k": ("rsv", 1 / 3, 8)}
EWM_SECOND = {"macd_signal": ("macd", 0.2, 0), "d": ("k", 1 / 3, 8)}
RUNNING = {
    "obv": ("sum", "volume * sign(close - pc)"),
    "__pv": ("sum", "(high + low + close) / 3 * volume"),
    "__v": ("sum", "volume"),
    "ad": ("sum", "((close - low) - (high - close)) / (high - low + 1e-9) * volume"),
    "__turn": ("max", "CASE WHEN bar_idx = 0 OR sign(pc - po) <> sign(close - open) THEN bar_idx END"),
}


def first_steps(by: str = "symbol, chunk") -> list[dict[str, str]]:
    """Columns that only look at neighbouring bars."""
    l = lambda x, n=1: lag(x, n, by)  # noqa: E731, E741
    return [
        {"pc": l("close"), "po": l("open"), "ph": l("high"), "pl": l("low"), "c10": l("close", 10)},
        {
            "tr": "greatest(high - low, abs(high - pc), abs(low - pc))",
            "gain": "greatest(coalesce(close - pc, 0), 0)",
            "loss": "greatest(coalesce(pc - close, 0), 0)",
            "pdm": "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END",
            "body": "close - open",
            "upper_shadow": "high - greatest(open, close)",
            "lower_shadow": "least(open, close) - low",
            "momentum": "close - c10",
            "roc": "(close - c10) / (c10 + 1e-9) * 100",
            "price_change": "close - pc",
            "price_change_pct": "(close / pc - 1) * 100",
            "amplitude": "(high - low) / (pc + 1e-9) * 100",
        },
        {
            "mdm": "CASE WHEN pl - low > pdm AND pl - low > 0 THEN pl - low ELSE 0 END",
            "body_ratio": "abs(body) / (high - low + 1e-9)",
            "engulfing": "CASE WHEN body > 0 AND pc - po < 0 AND close >= po AND open <= pc AND abs(body) > abs(pc - po) * 1.1e0 THEN 1.0e0 "
            "WHEN body < 0 AND pc - po > 0 AND close <= po AND open >= pc AND abs(body) > abs(pc - po) * 1.1e0 THEN -1.0e0 ELSE 0.0e0 END",
            "pin_bar": "CASE WHEN lower_shadow > 2 * abs(body) AND lower_shadow > 2 * upper_shadow AND body >= 0 THEN 1.0e0 "
            "WHEN upper_shadow > 2 * abs(body) AND upper_shadow > 2 * lower_shadow AND body <= 0 THEN -1.0e0 ELSE 0.0e0 END",
            "inside_bar": "CASE WHEN high <= ph AND low >= pl THEN 1.0e0 ELSE 0.0e0 END",
        },
    ]


def window_steps(by: str = "symbol, chunk") -> list[dict[str, str]]:
    """Rolling columns; needs first_steps and RUNNING."""
    r = lambda f, x, k, start=0: roll(f, x, k, start, by)
    l = lambda x, n: lag(x, n, by)  # noqa: E731, E741
    return [
        {
            "vwap": "__pv / (__v + 1e-9)",
            "trend_count": "cast((bar_idx - __turn + 1) * sign(body) AS double)",
            "__rsi_up": r("avg", "gain", 14),
            "__rsi_down": r("avg", "loss", 14),
            "__fast_up": r("avg", "gain", 6),
            "__fast_down": r("avg", "loss", 6),
            **{f"ma{k}": r("avg", "close", k) for k in (5, 10, 20, 60)},
            "boll_std": r("stddev_samp", "close", 20),
            "volume_ma5": r("avg", "volume", 5),
            "volume_ma20": r("avg", "volume", 20),
            "atr": r("avg", "tr", 14),
            "__pdm": r("avg", "pdm", 14),
            "__mdm": r("avg", "mdm", 14),
            "__low9": r("min", "low", 9),
            "__high9": r("max", "high", 9),
            "obv_ma": r("avg", "obv", 20, 1),
            "ad_ma": r("avg", "ad", 20),
            "amp_ma": r("avg", "amplitude", 20, 1),
            "range_ma": r("avg", "high - low", 20),
            "resistance": r("max", "high", 50),
            "support": r("min", "low", 50),
            "__obv5": l("obv", 5),
            "pvolume": l("volume", 1),
        },
        {
            "rsi": "100 - 100 / (1 + __rsi_up / (__rsi_down + 1e-9))",
            "rsi_fast": "100 - 100 / (1 + __fast_up / (__fast_down + 1e-9))",
            "rsv": "(close - __low9) / (__high9 - __low9 + 1e-9) * 100",
            "boll_mid": "ma20",
            "boll_upper": "ma20 + 2 * boll_std",
            "boll_lower": "ma20 - 2 * boll_std",
            "boll_width": "4 * boll_std / (ma20 + 1e-9)",
            "boll_position": "(close - (ma20 - 2 * boll_std)) / (4 * boll_std + 1e-9)",
            "volume_ratio": "volume / (volume_ma5 + 1e-9)",
            "plus_di": "100 * (__pdm / (atr + 1e-9))",
            "minus_di": "100 * (__mdm / (atr + 1e-9))",
            "close_vs_ma5": "(close - ma5) / (ma5 + 1e-9) * 100",
            "close_vs_ma20": "(close - ma20) / (ma20 + 1e-9) * 100",
            "close_vs_vwap": "(close - vwap) / (vwap + 1e-9) * 100",
            "obv_slope": "(obv - __obv5) / (abs(__obv5) + 1e-9)",
            "volume_spike": "CASE WHEN volume / (volume_ma20 + 1e-9) > 2 THEN 1.0e0 ELSE 0.0e0 END",
            "dist_to_resistance": "(resistance - close) / (resistance - support + 1e-9)",
            "dist_to_support": "(close - support) / (resistance - support + 1e-9)",
            "__ma5_5": l("ma5", 5),
            "__ma20_5": l("ma20", 5),
            "atr_ma": roll("avg", "atr", 20, 13, by),
        },
        {
            "dx": "100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-9)",
            "ma5_slope": "(ma5 - __ma5_5) / (__ma5_5 + 1e-9) * 100",
            "ma20_slope": "(ma20 - __ma20_5) / (__ma20_5 + 1e-9) * 100",
            "vol_squeeze": "CASE WHEN atr < atr_ma * 0.7e0 THEN 1.0e0 ELSE 0.0e0 END",
            "boll_width_ma": roll("avg", "boll_width", 20, 19, by),
            "rsi_10": l("rsi", 10),
            "atr_5": l("atr", 5),
            **{f"{c}_3": l(c, 3) for c in ("rsi", "boll_width", "volume_ratio")},
            "rsi_5": l("rsi", 5),
            "prev_high20": frame("max", "high", "20 PRECEDING", "1 PRECEDING", by),
            "prev_low20": frame("min", "low", "20 PRECEDING", "1 PRECEDING", by),
            "high20": frame("max", "high", "19 PRECEDING", "CURRENT ROW", by),
            "low20": frame("min", "low", "19 PRECEDING", "CURRENT ROW", by),
            "ups20": frame("sum", "gain", "19 PRECEDING", "CURRENT ROW", by),
            "downs20": frame("sum", "loss", "19 PRECEDING", "CURRENT ROW", by),
        },
        {"adx": roll("avg", "dx", 14, 13, by)},
        {"adx_5": l("adx", 5)},
    ]


def ewm_steps(by: str = "symbol, chunk") -> list[dict[str, str]]:
    """Columns that look back on exponential averages."""
    l = lambda x, n: lag(x, n, by)  # noqa: E731, E741
    return [
        {"macd_hist": "macd - macd_signal", "j": "3 * k - 2 * d"},
        {
            "macd_hist_prev": l("macd_hist", 1),
            "macd_hist_3": l("macd_hist", 3),
            "macd_hist_5": l("macd_hist", 5),
            "macd_prev": l("macd", 1),
            "signal_prev": l("macd_signal", 1),
            "k_prev": l("k", 1),
            "d_prev": l("d", 1),
            "j_prev": l("j", 1),
            **{f"ema{n}_{d}": l(f"ema{n}", d) for n in (12, 26) for d in (1, 5)},
        },
        {f"ema{n}_step": f"coalesce((ema{n} - ema{n}_1) / (ema{n}_1 + 1e-9) * 100, 0)" for n in (12, 26)},
        {f"ema{n}_step_3": l(f"ema{n}_step", 3) for n in (12, 26)},
    ]


#: The columns of the indicator table proper.
NAMES = (
    "ma5 ma10 ma20 ma60 ema12 ema26 macd macd_signal macd_hist rsi rsi_fast k d j boll_mid boll_std boll_upper boll_lower boll_width "
    "boll_position volume_ma5 volume_ma20 volume_ratio atr momentum roc adx plus_di minus_di price_change price_change_pct amplitude "
    "body upper_shadow lower_shadow body_ratio ma5_slope ma20_slope close_vs_ma5 close_vs_ma20 obv obv_ma obv_slope vwap close_vs_vwap "
    "engulfing pin_bar inside_bar trend_count volume_spike vol_squeeze resistance support dist_to_resistance dist_to_support"
).split()


def _apply(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.selectExpr("*", *[f"{x} AS {name}" for name, x in step.items()])
    return df


def _in_pieces(bars: DataFrame, halo: int) -> DataFrame:
    near = _apply(with_halo(bars.select(*BARS), halo), first_steps())
    return _apply(running(near, RUNNING), window_steps())


def window_indicators(bars: DataFrame) -> DataFrame:
    """All indicators but those from exponential averages."""
    return only_own(_in_pieces(bars, BACK))


def indicators(bars: DataFrame) -> DataFrame:
    """The whole indicator table, helper columns included: one exchange by symbol and piece, and one of
    a row for each piece."""
    first = _apply(_in_pieces(bars, BACK + sum(REACH)), [*ewm(EWM_FIRST, REACH[0]), {"macd": "ema12 - ema26"}])
    table = _apply(first, [*ewm(EWM_SECOND, REACH[1]), *ewm_steps()])
    return only_own(table.select([c for c in table.columns if not c[:3].strip("_").isdigit()]))


def kdj_variant(bars: DataFrame) -> DataFrame:
    """symbol, bar_idx, k, d, j and crossed: the stochastic with spans of 3, 50 where it has no value,
    and whether J rose through D."""
    steps = [{"__lo": roll("min", "low", 9), "__hi": roll("max", "high", 9)}, {"__rsv": "coalesce(try_divide(close - __lo, __hi - __lo) * 100, 50e0)"}]
    steps += [*ewm({"k": ("__rsv", 0.5, 0)}, 64), *ewm({"d": ("k", 0.5, 0)}, 64), {"j": "3 * k - 2 * d"}]
    steps.append({"crossed": f"coalesce({lag('j')} < {lag('d')} AND j > d, false)"})
    held = with_halo(bars.select("symbol", "bar_idx", "high", "low", "close"), 160)
    return only_own(_apply(held, steps)).select("symbol", "bar_idx", "k", "d", "j", "crossed")
