"""Conditions, outcomes of entries, and mining of condition combinations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.functions.windows import frame, lead, only_own, with_halo

TAKE_PROFIT = {"long": 0.006, "short": 0.008}
STOP_LOSS = {"long": 0.008, "short": 0.006}
MAX_HOLD = 60
MIN_ATR_RATIO, MAX_ATR_STOPS = 0.0004, 1.5
MIN_TRIGGERS = 8
STATES = ("BULL", "BEAR", "RANGE")
#: Least hit rate of each tier, by pool and direction.
TIERS = {"PREMIUM": 0.71, "QUALITY": 0.67, "CANDIDATE": 0.64}, {"PREMIUM": 0.59, "QUALITY": 0.55, "CANDIDATE": 0.52}

#: Names and thresholds of the conditions of both directions, of longs and of shorts.
_BOTH = (
    ("vol_ratio_loose", "volume_ratio > 1.3"),
    ("vol_ratio_strict", "volume_ratio > 1.8"),
    ("atr_ratio_loose", "(high - low) / (atr + 1e-9) > 1.2"),
    ("atr_ratio_strict", "(high - low) / (atr + 1e-9) > 1.8"),
    ("vol_ratio_mod_loose", "volume_ratio > 1.1"),
)
_LONG = (
    ("rsi_loose", "rsi < 40"),
    ("rsi_strict", "rsi < 30"),
    ("k_loose", "k < 35"),
    ("k_strict", "k < 25"),
    ("j_loose", "j < 25"),
    ("j_strict", "j < 15"),
    ("boll_pos_loose", "boll_position < 0.25"),
    ("boll_pos_strict", "boll_position < 0.15"),
    ("close_vs_ma5_loose", "close_vs_ma5 < -1.0"),
    ("close_vs_ma5_strict", "close_vs_ma5 < -1.5"),
    ("lower_shd_loose", "lower_shadow / (abs(body) + 1e-9) > 1.5"),
    ("lower_shd_strict", "lower_shadow / (abs(body) + 1e-9) > 2.5"),
    ("consec_bear_loose", "close < open AND bear_1 = 1"),
    ("consec_bear_strict", "close < open AND bear_1 = 1 AND bear_2 = 1"),
    ("rsi_mod_loose", "rsi < 50"),
    ("rsi_mod_strict", "rsi < 45"),
    ("boll_pos_mod_loose", "boll_position < 0.40"),
    ("boll_pos_mod_strict", "boll_position < 0.35"),
    ("macd_hist_turn_loose", "macd_hist > 0"),
    ("macd_hist_turn_strict", "macd_hist > 0 AND coalesce(macd_hist_prev, 0) <= 0"),
    ("close_vs_ma5_mod_loose", "close_vs_ma5 < -0.3"),
    ("close_vs_ma5_mod_strict", "close_vs_ma5 < -0.5"),
    ("ma5_slope_dir_loose", "ma5_slope < 0"),
    ("ma5_slope_dir_strict", "ma5_slope < -0.05"),
    ("obv_trend_loose", "obv > obv_ma"),
)
_SHORT = (
    ("rsi_loose", "rsi > 60"),
    ("rsi_strict", "rsi > 70"),
    ("k_loose", "k > 65"),
    ("k_strict", "k > 75"),
    ("j_loose", "j > 75"),
    ("j_strict", "j > 85"),
    ("boll_pos_loose", "boll_position > 0.75"),
    ("boll_pos_strict", "boll_position > 0.85"),
    ("close_vs_ma5_loose", "close_vs_ma5 > 1.0"),
    ("close_vs_ma5_strict", "close_vs_ma5 > 1.5"),
    ("upper_shd_loose", "upper_shadow / (abs(body) + 1e-9) > 1.5"),
    ("upper_shd_strict", "upper_shadow / (abs(body) + 1e-9) > 2.5"),
    ("consec_bull_loose", "close >= open AND bear_1 = 0"),
    ("consec_bull_strict", "close >= open AND bear_1 = 0 AND bear_2 = 0"),
    ("rsi_mod_loose", "rsi > 50"),
    ("rsi_mod_strict", "rsi > 55"),
    ("boll_pos_mod_loose", "boll_position > 0.60"),
    ("boll_pos_mod_strict", "boll_position > 0.65"),
    ("macd_hist_turn_loose", "macd_hist < 0"),
    ("macd_hist_turn_strict", "macd_hist < 0 AND coalesce(macd_hist_prev, 0) >= 0"),
    ("close_vs_ma5_mod_loose", "close_vs_ma5 > 0.3"),
    ("close_vs_ma5_mod_strict", "close_vs_ma5 > 0.5"),
    ("ma5_slope_dir_loose", "ma5_slope > 0"),
    ("ma5_slope_dir_strict", "ma5_slope > 0.05"),
    ("obv_trend_loose", "obv < obv_ma"),
)


def conditions(direction: str) -> dict[str, str]:
    """The 30 conditions as SQL that is false, never null, where an indicator is missing."""
    rows = (_LONG if direction == "long" else _SHORT) + _BOTH
    return {n: f"coalesce({x}, false)" for n, x in rows}


def family(name: str) -> str:
    return name.removesuffix("_loose").removesuffix("_strict")


def previous_bears(by: str) -> dict[str, str]:
    bear = "CASE WHEN close < open THEN 1 ELSE 0 END"
    return {f"bear_{n}": f"lag({bear}, {n}) OVER (PARTITION BY {by} ORDER BY bar_idx)" for n in (1, 2)}


MARKET_STATE = "CASE WHEN coalesce(adx > 25, false) THEN CASE WHEN ma5_slope > 0 THEN 'BULL' ELSE 'BEAR' END ELSE 'RANGE' END"


def with_conditions(table: DataFrame, direction: str) -> DataFrame:
    """The table with one boolean column for each condition, and mask, which packs them."""
    names = list(conditions(direction))
    held = only_own(with_halo(table, 8).selectExpr("*", *[f"{x} AS {n}" for n, x in previous_bears("symbol, chunk").items()]))
    out = held.selectExpr("*", *[f"{x} AS {n}" for n, x in conditions(direction).items()], f"{MARKET_STATE} AS state")
    return out.withColumn("mask", F.expr(" | ".join(f"shiftleft(cast({n} as bigint), {i})" for i, n in enumerate(names))))


def outcomes(table: DataFrame, direction: str, max_hold: int = MAX_HOLD) -> DataFrame:
    """table with outcome (boolean) and hold (bars to the first touch, -1 without one).

    Entry is at the next bar's open; the first bar of the next max_hold that touches target or
    stop decides, and one that touches both is a stop.  Bars whose ATR is too small or too large
    for the stop, and the last bar, do not enter.  Each bar looks ahead through its own frame of
    highs and lows, so that nothing is joined or multiplied.
    """
    tp, sl = TAKE_PROFIT[direction], STOP_LOSS[direction]
    up, down = (tp, sl) if direction == "long" else (sl, tp)
    ahead = frame("collect_list", "struct(high, low)", "1 FOLLOWING", f"{max_hold} FOLLOWING")
    held = with_halo(table, 0, max_hold + 1).selectExpr("*", f"{lead('open')} AS entry", f"{ahead} AS bars_ahead").where("own").drop("own", "chunk")
    gate = f"entry > 0 AND NOT coalesce(atr > 0 AND (atr / entry < {MIN_ATR_RATIO}D OR atr / entry > {sl * MAX_ATR_STOPS}D), false)"
    touch = f"x.high >= entry * (1 + {up}D) OR x.low <= entry * (1 - {down}D)"
    touched = f"filter(transform(bars_ahead, (x, i) -> IF({touch}, named_struct('i', i, 'high', x.high, 'low', x.low), null)), t -> t IS NOT NULL)"
    held = held.withColumn("first", F.expr(f"CASE WHEN {gate} THEN get({touched}, 0) END"))
    above, below = f"first.high >= entry * (1 + {up}D)", f"first.low <= entry * (1 - {down}D)"
    won = f"({above}) AND NOT ({below})" if direction == "long" else f"({below}) AND NOT ({above})"
    return held.selectExpr("*", f"coalesce({won}, false) AS outcome", "coalesce(first.i, -1) AS hold").drop("bars_ahead", "first", "entry")


def combos(direction: str, size: int) -> list[tuple[str, ...]]:
    """Combinations without two of one family."""
    return [c for c in combinations(conditions(direction), size) if len({family(n) for n in c}) == size]


def mine(marked: DataFrame, direction: str, size: int, by: tuple[str, ...] = (), min_triggers: int = MIN_TRIGGERS, without: tuple[str, ...] = ()) -> DataFrame:
    """combo, triggers, hits, hit_rate, tier over all bars of marked (conditions and outcomes), or
    over those of each value of the columns `by`; families that begin with one of `without` are out.

    Bars are first counted by their distinct masks.  Combinations then grow by one condition at a time
    within each mask, and only those with enough triggers grow on, as none with fewer can be part of a
    larger one: nothing is ever joined but a mask's own combinations with the counts of all.
    """
    names = list(conditions(direction))
    allowed = [i for i, n in enumerate(names) if not any(family(n).startswith(w) for w in without)]
    kin = [sum(1 << j for j, m in enumerate(names) if family(m) == family(n)) for n in names]
    keys, bit = [*by, "bits"], lambda i: f"shiftleft(1L, {i})"
    masks = stored(marked.groupBy(*by, "mask").agg(F.count("*").alias("n"), F.sum(F.col("outcome").cast("long")).alias("h")))
    listed = "array(" + ", ".join(map(str, allowed)) + ")"
    kin_of = "array(" + ", ".join(f"{k}L" for k in kin) + ")"
    rows = masks.selectExpr("*", f"explode(filter({listed}, i -> (mask & {bit('i')}) <> 0)) AS last").withColumn("bits", F.expr(bit("last")))
    for length in range(1, size + 1):
        counts = rows.groupBy(*keys).agg(F.sum("n").alias("triggers"), F.sum("h").alias("hits")).where(F.col("triggers") >= min_triggers)
        if length == size:
            break
        counts = stored(counts)
        grown = f"filter({listed}, i -> i > last AND (mask & {bit('i')}) <> 0 AND (bits & {kin_of}[i]) = 0)"
        more = rows.join(counts.select(*keys), keys, "left_semi").selectExpr(*by, "mask", "n", "h", "bits", f"explode({grown}) AS next")
        rows = stored(more.selectExpr(*by, "mask", "n", "h", f"bits | {bit('next')} AS bits", "next AS last"))
    text = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    combo = F.expr(f"array_join(sort_array(transform(filter({listed}, i -> (bits & {bit('i')}) <> 0), i -> {text}[i])), '+')")
    found = counts.select(*by, combo.alias("combo"), "triggers", "hits")
    return found.withColumn("hit_rate", F.col("hits") / F.col("triggers")).withColumn("tier", F.expr(tier("hit_rate", direction)))


def validated(marked: DataFrame, direction: str, size: int, head: float = 0.7) -> DataFrame:
    """Combinations of the first part of each symbol's bars that reach a tier there, with their
    triggers and hits in the rest, and whether they are QUALITY or better there too."""
    last = marked.groupBy("symbol").agg(F.max("bar_idx").alias("__last"))
    early = F.col("bar_idx") < F.floor((F.col("__last") + 1) * head)
    parts = stored(marked.join(last, "symbol").withColumn("__early", early).select("__early", "mask", "outcome"))
    found = mine(parts.where("__early"), direction, size).where("tier <> 'NONE'").select("combo", "hit_rate")
    again = mine(parts.where("not __early"), direction, size, min_triggers=1).select("combo", "triggers", "hits", "tier")
    out = found.join(again, "combo", "left").fillna(0, ["triggers", "hits"])
    return out.withColumn("kept", F.coalesce(F.col("tier").isin("PREMIUM", "QUALITY"), F.lit(False))).drop("tier")


def tier(rate: str, direction: str, pool: int = 1) -> str:
    limits = TIERS[0] if pool == 1 and direction == "long" else TIERS[1]
    return "CASE " + " ".join(f"WHEN {rate} >= {v} THEN '{n}'" for n, v in limits.items()) + " ELSE 'NONE' END"


def state_breakdown(triggers: DataFrame, keys: list[str]) -> DataFrame:
    """triggers, hits and rate of each key in each of the three states, zeros kept."""
    spark = triggers.sparkSession
    states = F.broadcast(spark.createDataFrame([(s,) for s in STATES], "state string"))
    counted = triggers.groupBy(*keys, "state").agg(F.count("*").alias("triggers"), F.sum(F.col("outcome").cast("long")).alias("hits"))
    domain = triggers.select(*keys).distinct().join(states)
    out = domain.join(counted, [*keys, "state"], "left").fillna(0, ["triggers", "hits"])
    return out.withColumn("rate", F.when(F.col("triggers") > 0, F.col("hits") / F.col("triggers")).otherwise(0.0))
