"""The registered queries over bars and tables, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch, stored
from tidemark.functions.windows import frame, only_own, with_halo
from tidemark.operators import features as feat
from tidemark.operators import indicators as ind
from tidemark.operators import learning as learn
from tidemark.operators import recurrences as rec
from tidemark.operators import signals as sig
from tidemark.operators import similarity as sim
from tidemark.operators import store, studies
from tidemark.operators import swings as swing
from tidemark.operators import tracking as track
from tidemark.operators.backtests import Rules
from tidemark.plans import sql
from tidemark.plans.registry import ORACLE, QUERIES, query, rounded
from tidemark.sources import bars as src
from tidemark.streaming import feed

KEYS = ["symbol", "bar_idx"]


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_ticks(spark, sf_dir)


OHLCV = ["open", "high", "low", "close", "volume"]


@query(sql.with_bars(f"SELECT symbol, bar_idx, ts, {sql.rounded(OHLCV)} FROM bars"))
def bars_from_ticks(spark, sf_dir):
    return rounded(bars(spark, sf_dir), [*KEYS, "ts"], OHLCV)


def _group_query(name: str, names: str, ewm: bool = False) -> None:
    columns = names.split()
    select = f"SELECT symbol, bar_idx, {sql.rounded(columns)} FROM {'i' if ewm else 'w'}"

    def run(spark, sf_dir):
        table = ind.indicators if ewm else ind.window_indicators
        return rounded(table(bars(spark, sf_dir)), KEYS, columns)

    run.__name__ = name
    query((sql.with_indicators if ewm else sql.with_windows)(select))(run)


_group_query("moving_averages", "ma5 ma10 ma20 ma60 ma5_slope ma20_slope close_vs_ma5 close_vs_ma20")
_group_query("rsi_and_momentum", "rsi rsi_fast momentum roc price_change price_change_pct amplitude")
_group_query("bands_and_range", "boll_mid boll_std boll_upper boll_lower boll_width boll_position atr vol_squeeze")
_group_query("volume_indicators", "volume_ma5 volume_ma20 volume_ratio obv obv_ma obv_slope vwap close_vs_vwap volume_spike")
_group_query("directional_movement", "plus_di minus_di adx")
_group_query("candle_patterns", "body upper_shadow lower_shadow body_ratio engulfing pin_bar inside_bar trend_count")
_group_query("support_and_resistance", "resistance support dist_to_resistance dist_to_support")
_group_query("exponential_averages", "ema12 ema26 macd macd_signal macd_hist k d j", ewm=True)
_group_query("all_indicators", " ".join(ind.NAMES), ewm=True)


# --- feature vectors and layers

RANKS = """r AS MATERIALIZED (SELECT *, CASE WHEN bar_idx >= 50 THEN len(list_filter(list(atr) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING),
  lambda x: x < atr)) / 50 ELSE 0 END AS atr_rank50 FROM i)"""


def _feature_query(group: str) -> None:
    exprs = feat.GROUPS[group]
    select = "SELECT symbol, bar_idx, " + ", ".join(f"round({feat.clipped(x)}, 6) + 0.0 AS {n}" for n, x in exprs.items()) + " FROM r"

    def run(spark, sf_dir):
        return rounded(feat.features(ind.indicators(bars(spark, sf_dir)), (group,)), KEYS, exprs)

    run.__name__ = f"{group}_features"
    query(sql.with_indicators(select.replace("FROM r", "FROM i") if group != "volatility" else select, *([RANKS] if group == "volatility" else [])))(run)


for _g in feat.GROUPS:
    _feature_query(_g)

LAYER_NAMES = list(feat.layer_columns())
# A value is rounded half to even at 3 or 6 digits; ties hang on the last bit, so means are compared.


@query(
    sql.with_indicators(
        "SELECT symbol, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) + 0.0 AS {c}" for c in LAYER_NAMES) + " FROM v GROUP BY symbol",
        "v AS MATERIALIZED (SELECT symbol, bar_idx, " + ", ".join(f"{x} AS {n}" for n, x in feat.layer_columns("round_even").items()) + " FROM i)",
    )
)
def layer_means(spark, sf_dir):
    v = feat.layers(ind.indicators(bars(spark, sf_dir)))
    return v.groupBy("symbol").agg(F.count("*").alias("n"), *[(F.round(F.avg(c), 4) + F.lit(0.0)).alias(c) for c in LAYER_NAMES])


@query(
    sql.with_bars(
        """, t AS (SELECT symbol, bar_idx // 4 AS g, min(ts) AS ts, arg_min(open, bar_idx) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_idx) AS close,
             sum(volume) AS volume FROM bars GROUP BY ALL HAVING count(*) = 4)
SELECT symbol, g AS bar_idx, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM t"""
    )
)
def multi_timeframe_bars(spark, sf_dir):
    return rounded(src.aggregate_bars(bars(spark, sf_dir), 4), [*KEYS, "ts"], OHLCV)


def _mtf_sql(shift: int) -> str:
    return sql.with_bars(
        f""", t AS (SELECT symbol, bar_idx // 4 AS g, max(high) - min(low) AS g_range, arg_max(close, bar_idx) AS g_close FROM bars GROUP BY ALL HAVING count(*) = 4),
m AS (SELECT *, CASE WHEN g >= 4 THEN avg(g_close) OVER (PARTITION BY symbol ORDER BY g ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS g_ma5, max(g) OVER (PARTITION BY symbol) AS last FROM t),
p AS (SELECT b.symbol, b.bar_idx, least(b.bar_idx // 4 - {shift}, l.last) AS g FROM bars b JOIN (SELECT DISTINCT symbol, last FROM m) l USING (symbol))
SELECT p.symbol, p.bar_idx, p.g, round(tanh((g_close - g_ma5) / (g_ma5 + 1e-9) * 100), 6) AS g_trend, round(g_range, 6) AS g_range
FROM p LEFT JOIN m ON m.symbol = p.symbol AND m.g = p.g"""
    )


@query(_mtf_sql(0))
def multi_timeframe_features(spark, sf_dir):
    return rounded(feat.group_trend(bars(spark, sf_dir), 4), [*KEYS, "g"], ["g_trend", "g_range"])


@query(_mtf_sql(1))
def multi_timeframe_features_closed(spark, sf_dir):
    return rounded(feat.group_trend(bars(spark, sf_dir), 4, containing=False), [*KEYS, "g"], ["g_trend", "g_range"])


# --- reading bars


@query(sql.with_bars("SELECT symbol, count(*) AS n_bars, round(min(low), 6) AS low, round(max(high), 6) AS high, sum(volume) AS volume, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol"))
def bar_info(spark, sf_dir):
    return src.info(bars(spark, sf_dir)).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(sql.with_bars("SELECT symbol, bar_idx - 100 AS bar_idx, round(close, 6) AS close FROM bars WHERE bar_idx BETWEEN 100 AND 299"))
def contiguous_sample(spark, sf_dir):
    return src.contiguous(bars(spark, sf_dir), 100, 200).select(*KEYS, F.round("close", 6).alias("close"))


@query(sql.with_bars("SELECT symbol, ts, round(open, 6) AS open, round(close, 6) AS close, volume, bar_idx % 2 = 0 AS is_closed FROM bars"))
def feed_messages(spark, sf_dir):
    b = bars(spark, sf_dir)
    num = lambda c: F.round(c, 6).cast("string").alias(c[0])
    k = F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        num("open"),
        num("high"),
        num("low"),
        num("close"),
        num("volume"),
        (F.col("bar_idx") % 2 == 0).alias("x"),
    )
    lines = b.select(F.to_json(F.struct(F.col("symbol").alias("s"), k.alias("k"))).alias("value"))
    return src.parse_stream(lines).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "close", "volume", "is_closed")


# --- conditions, outcomes, mining


def _outcome_sql(direction: str, source: str) -> str:
    tp, sl = sig.TAKE_PROFIT[direction], sig.STOP_LOSS[direction]
    up, down = (tp, sl) if direction == "long" else (sl, tp)
    win = "a.high >= e.entry * (1 + {0}) AND NOT a.low <= e.entry * (1 - {1})" if direction == "long" else "a.low <= e.entry * (1 - {1}) AND NOT a.high >= e.entry * (1 + {0})"
    return f"""
ent AS (SELECT symbol, bar_idx, atr, lead(open) OVER (PARTITION BY symbol ORDER BY bar_idx) AS entry FROM {source}),
f AS (SELECT e.symbol, e.bar_idx, min(a.bar_idx) AS first_idx, arg_min({win.format(up, down)}, a.bar_idx) AS won
      FROM ent e JOIN bars a ON a.symbol = e.symbol AND a.bar_idx BETWEEN e.bar_idx + 1 AND e.bar_idx + {sig.MAX_HOLD}
      WHERE e.entry > 0 AND NOT coalesce(e.atr > 0 AND (e.atr / e.entry < {sig.MIN_ATR_RATIO} OR e.atr / e.entry > {sl * sig.MAX_ATR_STOPS}), false)
        AND (a.high >= e.entry * (1 + {up}) OR a.low <= e.entry * (1 - {down}))
      GROUP BY ALL),
o AS MATERIALIZED (SELECT s.*, coalesce(f.won, false) AS outcome, coalesce(f.first_idx - s.bar_idx - 1, -1) AS hold FROM {source} s LEFT JOIN f USING (symbol, bar_idx))"""


def _condition_part(direction: str, source: str = "i") -> str:
    names = ", ".join(f"{x} AS {n}" for n, x in sig.conditions(direction).items())
    bears = ", ".join(f"{x} AS {n}" for n, x in sig.previous_bears("symbol").items())
    return f"cp AS (SELECT *, {bears} FROM {source}), cond AS MATERIALIZED (SELECT *, {names}, {sig.MARKET_STATE} AS state FROM cp)"


def marked(spark, sf_dir, direction: str) -> DataFrame:
    return sig.outcomes(sig.with_conditions(ind.indicators(bars(spark, sf_dir)), direction), direction)


def _direction_queries(direction: str) -> None:
    names = list(sig.conditions(direction))

    def add(name, oracle):
        def wrap(f):
            f.__name__ = f"{name}_{direction}"
            return query(oracle)(f)

        return wrap

    @add("conditions", sql.with_indicators(f"SELECT symbol, bar_idx, state, {', '.join(names)} FROM cond", _condition_part(direction)))
    def _(spark, sf_dir):
        return sig.with_conditions(ind.indicators(bars(spark, sf_dir)), direction).select(*KEYS, "state", *names)

    @add("outcomes", sql.with_windows("SELECT symbol, bar_idx, outcome, CAST(hold AS INTEGER) AS hold FROM o", _outcome_sql(direction, "w")))
    def _(spark, sf_dir):
        return sig.outcomes(ind.window_indicators(bars(spark, sf_dir)), direction).select(*KEYS, "outcome", F.col("hold").cast("int").alias("hold"))

    @add(
        "random_baseline",
        sql.with_windows("SELECT symbol, count(*) AS resolved, sum(outcome::INT)::BIGINT AS hits, avg(outcome::INT) AS baseline FROM o WHERE hold >= 0 GROUP BY symbol", _outcome_sql(direction, "w")),
    )
    def _(spark, sf_dir):
        o = sig.outcomes(ind.window_indicators(bars(spark, sf_dir)), direction).where("hold >= 0")
        return o.groupBy("symbol").agg(
            F.count("*").alias("resolved"),
            F.sum(F.col("outcome").cast("long")).alias("hits"),
            F.avg(F.col("outcome").cast("int")).alias("baseline"),
        )

    for size in (1, 2, 3):
        # Each combination counts the bars on which all its conditions hold.
        masks = "m AS (SELECT " + " + ".join(f"({n}::BIGINT << {i})" for i, n in enumerate(names)) + " AS mask, count(*) AS n, sum(outcome::INT)::BIGINT AS h FROM o GROUP BY ALL)"
        bits = {n: 1 << i for i, n in enumerate(names)}
        listed = ", ".join(f"('{'+'.join(sorted(c))}', {sum(bits[n] for n in c)})" for c in sig.combos(direction, size))
        oracle = sql.with_indicators(
            f"SELECT combo, triggers, hits, hits / triggers AS hit_rate, {sig.tier('hits / triggers', direction)} AS tier FROM g WHERE triggers >= {sig.MIN_TRIGGERS}",
            _condition_part(direction), _outcome_sql(direction, "cond"), masks, f"c(combo, bits) AS (VALUES {listed})",
            "g AS (SELECT combo, sum(n)::BIGINT AS triggers, sum(h)::BIGINT AS hits FROM c JOIN m ON m.mask & c.bits = c.bits GROUP BY combo)",
        )

        @add(f"combos_of_{size}", oracle)
        def _(spark, sf_dir, size=size):
            return sig.mine(marked(spark, sf_dir, direction), direction, size)


for _d in ("long", "short"):
    _direction_queries(_d)


@query(
    sql.with_windows(
        """
SELECT d.symbol, d.state, count(h.state) AS triggers, coalesce(sum(h.outcome::INT), 0)::BIGINT AS hits,
       CASE WHEN count(h.state) > 0 THEN sum(h.outcome::INT) / count(h.state) ELSE 0.0 END AS rate
FROM (SELECT DISTINCT symbol, s AS state FROM hit, (VALUES ('BULL'), ('BEAR'), ('RANGE')) v(s)) d LEFT JOIN hit h ON h.symbol = d.symbol AND h.state = d.state
GROUP BY d.symbol, d.state""",
        _outcome_sql("long", "w"),
        f"hit AS (SELECT symbol, {sig.MARKET_STATE} AS state, outcome FROM o WHERE rsi < 40 AND boll_position < 0.25)",
    )
)
def signal_hit_rate(spark, sf_dir):
    o = sig.outcomes(ind.window_indicators(bars(spark, sf_dir)), "long")
    hit = o.where("rsi < 40 AND boll_position < 0.25").selectExpr("symbol", f"{sig.MARKET_STATE} AS state", "outcome")
    return sig.state_breakdown(hit, ["symbol"])


# --- results over rounds


def history(spark, sf_dir, direction="long") -> DataFrame:
    """Triggers and hits of pairs of conditions in five stretches of each symbol's bars."""
    m = marked(spark, sf_dir, direction)
    last = m.groupBy("symbol").agg(F.max("bar_idx").alias("last"))
    rounds = m.join(F.broadcast(last), "symbol").withColumn("round", F.expr("bar_idx * 5 div (last + 1)"))
    return sig.mine(rounds, direction, 2, by=("round",)).select("combo", "round", "triggers", "hits")


def _history_part(direction: str = "long") -> tuple[str, ...]:
    names = list(sig.conditions(direction))
    bits = {n: 1 << i for i, n in enumerate(names)}
    listed = ", ".join(f"('{'+'.join(sorted(c))}', {sum(bits[n] for n in c)})" for c in sig.combos(direction, 2))
    masks = "m AS (SELECT bar_idx * 5 // (max(bar_idx) OVER (PARTITION BY symbol) + 1) AS round, " + " + ".join(f"({n}::BIGINT << {i})" for i, n in enumerate(names)) + " AS mask, outcome FROM o)"
    return (
        _condition_part(direction), _outcome_sql(
            direction,
            "cond",
        ), masks, "mc AS (SELECT round, mask, count(*) AS n, sum(outcome::INT) AS h FROM m GROUP BY ALL)", f"c(combo, bits) AS (VALUES {listed})",
        f"hist AS MATERIALIZED (SELECT combo, round, sum(n)::BIGINT AS triggers, sum(h)::BIGINT AS hits FROM c JOIN mc ON mc.mask & c.bits = c.bits GROUP BY ALL HAVING sum(n) >= {sig.MIN_TRIGGERS})",
        "cm AS (SELECT combo, count(*) AS rounds, avg(hits / triggers) AS avg_rate, stddev_pop(hits / triggers) AS rate_std, sum(triggers)::BIGINT AS triggers, sum(hits)::BIGINT AS hits, "
        "median(triggers) AS median_triggers, len(string_split(combo, '+')) AS n_conditions FROM hist GROUP BY combo)",
    )


METRICS = ["avg_rate", "rate_std", *store.metrics_sql("long")]
_metrics = ", ".join(f"{x} AS {n}" for n, x in store.metrics_sql("long").items())
_cum = "cum AS MATERIALIZED (SELECT *, " + _metrics + " FROM cm)"


@query(sql.with_indicators(f"SELECT combo, rounds, triggers, hits, median_triggers, n_conditions, {sql.rounded(METRICS)} FROM cum", *_history_part(), _cum))
def cumulative_metrics(spark, sf_dir):
    c = store.cumulative(history(spark, sf_dir), "long")
    return rounded(c, ["combo", "rounds", "triggers", "hits", "median_triggers", F.col("n_conditions").cast("long").alias("n_conditions")], METRICS)


@query(sql.with_indicators(f"SELECT combo, rounds, round(composite, 6) AS composite FROM cum WHERE {store.STABLE} ORDER BY cum.composite DESC, combo LIMIT 20", *_history_part(), _cum))
def stable_combos(spark, sf_dir):
    c = store.cumulative(history(spark, sf_dir), "long").where(store.STABLE)
    return c.orderBy(F.desc("composite"), "combo").limit(20).select("combo", "rounds", F.round("composite", 6).alias("composite"))


@query(sql.with_indicators("SELECT condition, count(*) AS n FROM (SELECT unnest(string_split(combo, '+')) AS condition FROM cum) GROUP BY condition", *_history_part(), _cum))
def condition_frequency(spark, sf_dir):
    c = store.cumulative(history(spark, sf_dir), "long")
    return c.select(F.explode(F.split("combo", r"\+")).alias("condition")).groupBy("condition").agg(F.count("*").alias("n"))


@query()
def diverse_combos(spark, sf_dir):
    c = store.cumulative(history(spark, sf_dir), "long").withColumn("tier", F.expr(sig.tier("overall_rate", "long", 2)))
    return store.diverse(c, "tier")


# --- swings, trades, regimes

SWINGS = """
sw0 AS (SELECT symbol, bar_idx, high, low, max(high) OVER n AS top, min(low) OVER n AS bottom, count(*) OVER n AS seen FROM bars
        WINDOW n AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
swings AS (SELECT symbol, bar_idx, high >= top AS is_high, CASE WHEN high >= top THEN high ELSE low END AS price FROM sw0 WHERE seen = 11 AND (high >= top OR low <= bottom)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY bar_idx) AS run FROM
  (SELECT *, coalesce(lag(is_high) OVER (PARTITION BY symbol ORDER BY bar_idx) <> is_high, true)::INT AS new FROM swings)),
points AS MATERIALIZED (SELECT symbol, bar_idx, is_high, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN is_high THEN -price ELSE price END, bar_idx) AS n FROM runs) WHERE n = 1),
trades AS MATERIALIZED (SELECT symbol, bar_idx AS entry_idx, exit_idx, CASE WHEN is_high THEN 'short' ELSE 'long' END AS side, price AS entry_price, exit_price,
  CASE WHEN is_high THEN -1.0::DOUBLE ELSE 1.0 END * (exit_price - price) / price * 100 AS profit_pct, exit_idx - bar_idx AS hold
  FROM (SELECT *, lead(bar_idx) OVER w AS exit_idx, lead(price) OVER w AS exit_price FROM points WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)) WHERE exit_idx IS NOT NULL)"""


def _swings_sql(select: str) -> str:
    return sql.with_bars("," + SWINGS + "\n" + select)


def points(spark, sf_dir) -> DataFrame:
    return swing.alternating(swing.swing_points(bars(spark, sf_dir)))


@query(_swings_sql("SELECT symbol, bar_idx, is_high, round(price, 6) AS price FROM swings"))
def swing_points(spark, sf_dir):
    return swing.swing_points(bars(spark, sf_dir)).select("symbol", "bar_idx", "is_high", F.round("price", 6).alias("price"))


@query(_swings_sql("SELECT symbol, bar_idx, CASE WHEN is_high THEN -1 ELSE 1 END AS label FROM points"))
def swing_labels(spark, sf_dir):
    return points(spark, sf_dir).select("symbol", "bar_idx", F.when(F.col("is_high"), -1).otherwise(1).alias("label"))


@query(_swings_sql("SELECT symbol, entry_idx, exit_idx, side, hold, round(profit_pct, 6) AS profit_pct FROM trades"))
def label_trades(spark, sf_dir):
    return swing.label_trades(points(spark, sf_dir)).select("symbol", "entry_idx", "exit_idx", "side", "hold", F.round("profit_pct", 6).alias("profit_pct"))


STATS = ["win_rate", "gross_gain", "gross_loss", "profit_factor", "avg_win", "avg_loss", "sharpe", "avg_hold"]


@query(
    _swings_sql(
        f"""SELECT symbol, side, n, {sql.rounded(STATS)} FROM (SELECT symbol, side, count(*) AS n, avg((profit_pct > 0)::INT) AS win_rate, sum(greatest(profit_pct, 0)) AS gross_gain, sum(greatest(-profit_pct, 0)) AS gross_loss,
  CASE WHEN sum(greatest(-profit_pct, 0)) > 0 THEN sum(greatest(profit_pct, 0)) / sum(greatest(-profit_pct, 0)) END AS profit_factor, avg(CASE WHEN profit_pct > 0 THEN profit_pct END) AS avg_win,
  avg(CASE WHEN profit_pct < 0 THEN profit_pct END) AS avg_loss, CASE WHEN stddev_pop(profit_pct) > 0 THEN avg(profit_pct) / stddev_pop(profit_pct) END AS sharpe, avg(hold) AS avg_hold FROM trades GROUP BY ALL)"""
    )
)
def trade_statistics(spark, sf_dir):
    return rounded(swing.trade_stats(swing.label_trades(points(spark, sf_dir)), "symbol", "side"), ["symbol", "side", "n"], STATS)


@query(
    _swings_sql(
        """, eq AS (SELECT symbol, entry_idx, sum(profit_pct) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY entry_idx)),
pk AS (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY entry_idx), 0) AS peak FROM eq)
SELECT symbol, round(max(peak - equity), 6) AS max_drawdown, round(arg_max(equity, entry_idx), 6) AS final_equity FROM pk GROUP BY symbol"""
    )
)
def trade_drawdown(spark, sf_dir):
    return rounded(swing.drawdown(swing.label_trades(points(spark, sf_dir))), ["symbol"], ["max_drawdown", "final_equity"])


_REGIMES = f"""
sp AS (SELECT symbol, bar_idx AS since, lead(bar_idx) OVER w AS until, list({{'h': is_high, 'p': price}}) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l
       FROM points WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
hl AS (SELECT *, list_filter(l, lambda x: x.h) AS hs, list_filter(l, lambda x: NOT x.h) AS ls FROM sp),
told AS (SELECT symbol, since, until,
  CASE WHEN len(l) >= {swing.MIN_SWINGS} AND len(hs) >= 2 AND len(ls) >= 2 THEN ((hs[-1].p - hs[1].p) / hs[1].p + (ls[-1].p - ls[1].p) / ls[1].p) / 2 END AS direction,
  list_sum(list_transform(range(2, len(l) + 1), lambda i: abs(l[i].p - l[i - 1].p))) / (len(l) - 1) / list_avg(list_transform(l, lambda x: x.p)) AS strength FROM hl),
rg AS (SELECT t.*, {swing.regime_sql()} AS regime FROM trades t LEFT JOIN told d ON d.symbol = t.symbol AND t.entry_idx > d.since AND (d.until IS NULL OR t.entry_idx <= d.until))"""


def trades_with_regime(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    trades = swing.label_trades(p)
    told = swing.regimes(p, trades.select("symbol", F.col("entry_idx").alias("bar_idx")))
    return trades.join(told.withColumnRenamed("bar_idx", "entry_idx"), ["symbol", "entry_idx"])


@query(_swings_sql("," + _REGIMES + " SELECT symbol, entry_idx, side, regime FROM rg"))
def trade_regimes(spark, sf_dir):
    return trades_with_regime(spark, sf_dir).select("symbol", "entry_idx", "side", "regime")


@query(
    _swings_sql(
        ","
        + _REGIMES
        + f""" SELECT d.side, d.regime, count(r.symbol) AS n, coalesce(sum((r.profit_pct > 0)::INT), 0)::BIGINT AS wins, round(coalesce(avg(r.profit_pct), 0), 6) AS avg_profit,
  CASE WHEN count(r.symbol) > 0 THEN sum((r.profit_pct > 0)::INT) / count(r.symbol) ELSE 0.0 END AS win_rate
FROM (SELECT side, regime FROM (VALUES ('long'), ('short')) a(side), (VALUES {', '.join(f"('{r}')" for r in swing.REGIMES)}) b(regime)) d LEFT JOIN rg r ON r.side = d.side AND r.regime = d.regime GROUP BY d.side, d.regime"""
    )
)
def regime_statistics(spark, sf_dir):
    return swing.regime_stats(trades_with_regime(spark, sf_dir)).withColumn("avg_profit", F.round("avg_profit", 6))


_ATR = """tr AS (SELECT symbol, bar_idx, greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0)) AS t FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx)),
at AS MATERIALIZED (SELECT symbol, bar_idx, CASE WHEN bar_idx >= 13 THEN avg(t) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM tr)"""


def _pairs(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir)
    return swing.swing_pairs(swing.alternating(swing.swing_points(b)), ind.window_indicators(b))


@query(
    _swings_sql(
        f""", {_ATR.replace('at AS', 'av AS')} SELECT p.symbol, CASE WHEN p.is_high THEN 'short' ELSE 'long' END AS side, p.bar_idx AS entry_idx, q.bar_idx AS exit_idx, round(abs(q.price - p.price), 6) AS profit
FROM points p JOIN av ON av.symbol = p.symbol AND av.bar_idx = p.bar_idx JOIN points q ON q.symbol = p.symbol AND q.is_high <> p.is_high AND q.bar_idx BETWEEN p.bar_idx + 30 AND p.bar_idx + 480
WHERE CASE WHEN p.is_high THEN p.price - q.price ELSE q.price - p.price END >= 1.5 * CASE WHEN av.atr > 0 THEN av.atr ELSE p.price * 0.01 END"""
    )
)
def swing_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("symbol", "side", "entry_idx", "exit_idx", F.round("profit", 6).alias("profit"))


# --- decisions and their judgements

_DECISIONS = """da AS (SELECT *, lead(close, 30) OVER (PARTITION BY symbol ORDER BY bar_idx) AS later, max(high) OVER a AS top, min(low) OVER a AS bottom, CASE WHEN ma5_slope > 0 THEN 1 ELSE -1 END AS way FROM w
  WINDOW a AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)),
dd AS (SELECT symbol, bar_idx, CASE way WHEN 1 THEN 'long' ELSE 'short' END AS direction, ['SCORE', 'MACD', 'KDJ'][1 + bar_idx % 3] AS gate, way * (later - close) / close * 100 AS move,
  CASE way WHEN 1 THEN top - close ELSE close - bottom END / close * 100 AS favourable, CASE way WHEN 1 THEN close - bottom ELSE top - close END / close * 100 AS adverse
  FROM da WHERE bar_idx % 7 = 0 AND ma5_slope IS NOT NULL AND later IS NOT NULL),
dj AS MATERIALIZED (SELECT *, CASE WHEN move >= 0.3 THEN 'wrong' ELSE 'correct' END AS rejection, CASE WHEN favourable > 0.5 THEN 'premature' WHEN favourable < 0.25 AND adverse > 0.5 THEN 'late' ELSE 'correct' END AS exit_timing,
  CASE WHEN move <= -0.5 THEN 'correct' WHEN move >= 0.5 THEN 'too_tight' ELSE 'neutral' END AS stop, CASE WHEN move < 0.3 THEN 'unprofitable' ELSE 'profitable' END AS near_miss FROM dd)"""


def decided(spark, sf_dir) -> DataFrame:
    """The table of decisions stands for a log: bars with bar_idx % 7 = 0, by the sign of ma5_slope."""
    table = ind.window_indicators(bars(spark, sf_dir))
    log = table.where("bar_idx % 7 = 0 AND ma5_slope IS NOT NULL").selectExpr(
        "symbol",
        "bar_idx",
        "array('SCORE', 'MACD', 'KDJ')[cast(bar_idx % 3 AS int)] AS gate",
        "IF(ma5_slope > 0, 'long', 'short') AS direction",
    )
    return track.judged(track.decisions(table, log))


_MOVES = ["move", "favourable", "adverse"]


@query(sql.with_windows(f"SELECT symbol, bar_idx, direction, gate, {', '.join(track.JUDGEMENTS)}, {sql.rounded(_MOVES)} FROM dj", _DECISIONS))
def judged_decisions(spark, sf_dir):
    return rounded(decided(spark, sf_dir), ["symbol", "bar_idx", "direction", "gate", *track.JUDGEMENTS], _MOVES)


@query(
    sql.with_windows(
        f"""SELECT gate, n, correct, accuracy, round(saved, 6) AS saved, round(missed, 6) AS missed, CASE WHEN accuracy < {track.LOOSEN} THEN 'loosen' WHEN accuracy > {track.TIGHTEN} THEN 'tighten' ELSE 'keep' END AS suggestion
FROM (SELECT gate, count(*) AS n, sum((rejection = 'correct')::INT)::BIGINT AS correct, sum((rejection = 'correct')::INT) / count(*) AS accuracy, sum(greatest(-move, 0)) AS saved, sum(greatest(move, 0)) AS missed FROM dj GROUP BY gate)""",
        _DECISIONS,
    )
)
def gate_scores(spark, sf_dir):
    g = track.gate_scores(decided(spark, sf_dir))
    return g.withColumns({"saved": F.round("saved", 6), "missed": F.round("missed", 6)})


def _share_query(name: str, by: str) -> None:
    @query(sql.with_windows(f"SELECT {by}, {name} AS verdict, count(*) AS n, round(avg(move), 6) AS avg_move FROM dj GROUP BY ALL", _DECISIONS))
    def _(spark, sf_dir):
        return decided(spark, sf_dir).groupBy(by, F.col(name).alias("verdict")).agg(F.count("*").alias("n"), F.round(F.avg("move"), 6).alias("avg_move"))

    QUERIES[f"{name}_scores"], ORACLE[f"{name}_scores"] = QUERIES.pop("_"), ORACLE.pop("_")


for _n in ("exit_timing", "stop", "near_miss"):
    _share_query(_n, "direction")


@query(sql.with_windows("SELECT symbol, gate, bar_idx, avg((rejection = 'correct')::INT) OVER (PARTITION BY symbol, gate ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS accuracy FROM dj", _DECISIONS))
def recent_gate_accuracy(spark, sf_dir):
    return track.recent_accuracy(decided(spark, sf_dir))


@query(
    sql.with_windows(
        f"""SELECT symbol, state, alpha, beta, round(m, 6) AS mean, round(greatest(0, least(1, m - (1 - m) / 0.75)), 6) AS kelly FROM (SELECT symbol, {sig.MARKET_STATE} AS state, sum(outcome::INT) + 1.0::DOUBLE AS alpha,
  sum(1 - outcome::INT) + 1.0::DOUBLE AS beta, (sum(outcome::INT) + 1) / (count(*) + 2) AS m FROM o WHERE hold >= 0 GROUP BY ALL)""",
        _outcome_sql("long", "w"),
    )
)
def hit_rate_posteriors(spark, sf_dir):
    o = sig.outcomes(ind.window_indicators(bars(spark, sf_dir)), "long").where("hold >= 0").selectExpr(
        "symbol",
        f"{sig.MARKET_STATE} AS state",
        "outcome",
        "0.75D AS ratio",
    )
    return rounded(track.posteriors(o, "symbol", "state"), ["symbol", "state", "alpha", "beta"], ["mean", "kelly"])


# --- vectors


def embeddings(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


_PAIRS = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS ve FROM embeddings)"


def _nearest_sql(score: str, k: int) -> str:
    return f"WITH {_PAIRS}, s AS (SELECT query_id, id, {score} AS score FROM q JOIN v ON id <> query_id), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT * FROM k WHERE rank <= {k}"


@query(f"SELECT query_id, id, round(score, 5) AS score, rank FROM ({_nearest_sql('list_cosine_similarity(qe, ve)', 5)})")
def cosine_top_k(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return sim.top_k(e, e.where("vec_id % 50 = 0"), 5).select("query_id", "id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT query_id, id, round(score, 5) AS score, rank FROM ({_nearest_sql('-list_distance(qe, ve)', 5)})")
def euclidean_top_k(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return sim.top_k(e, e.where("vec_id % 50 = 0"), 5, "euclidean").select(
        "query_id",
        "id",
        F.round("score", 5).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    f"""WITH n AS ({_nearest_sql('list_cosine_similarity(qe, ve)', 9)}), w AS (SELECT query_id, label, sum(score) AS weight FROM n JOIN embeddings e ON e.vec_id = n.id GROUP BY ALL)
SELECT query_id, arg_max(label, (weight, -label)) AS label, round(max(weight), 5) AS weight FROM w GROUP BY query_id"""
)
def neighbour_votes(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return sim.votes(sim.top_k(e, e.where("vec_id % 50 = 0"), 9), e).select("query_id", "label", F.round("weight", 5).alias("weight"))


_CENTROIDS = "p AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL), c AS (SELECT label, list(m ORDER BY i) AS centroid FROM p GROUP BY label)"


@query(f"WITH {_CENTROIDS} SELECT e.label, count(*) AS n, round(greatest(avg(list_distance(embedding::DOUBLE[], centroid)), 1e-9), 5) AS spread FROM embeddings e JOIN c USING (label) GROUP BY e.label")
def cloud_spread(spark, sf_dir):
    return sim.spread(embeddings(spark, sf_dir)).select("label", "n", F.round("spread", 5).alias("spread"))


@query(f"WITH {_CENTROIDS} SELECT vec_id, e.label, arg_max(c.label, (list_cosine_similarity(embedding::DOUBLE[], centroid), -c.label)) AS nearest FROM embeddings e, c GROUP BY vec_id, e.label")
def nearest_prototype(spark, sf_dir):
    return sim.nearest_centroid(embeddings(spark, sf_dir))


# --- trades as tables


@query("SELECT l_returnflag AS side, count(*) AS fills, round(sum(l_extendedprice) / sum(l_quantity), 6) AS vwap, round(sum(l_extendedprice * l_tax), 2) AS fees FROM lineitem GROUP BY l_returnflag")
def fill_aggregation(spark, sf_dir):
    fills = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return fills.groupBy(F.col("l_returnflag").alias("side")).agg(
        F.count("*").alias("fills"),
        F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("vwap"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("fees"),
    )


@query(
    """WITH last AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500)
SELECT o_orderpriority AS reason, count(*) AS n, sum((o_totalprice > 150000)::INT)::BIGINT AS wins, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average FROM last GROUP BY 1"""
)
def last_orders_by_reason(spark, sf_dir):
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)
    p = F.col("o_totalprice")
    return last.groupBy(F.col("o_orderpriority").alias("reason")).agg(
        F.count("*").alias("n"),
        F.sum((p > 150000).cast("long")).alias("wins"),
        F.round(F.sum(p), 2).alias("total"),
        F.round(F.avg(p), 4).alias("average"),
    )


@query(
    """WITH t AS (SELECT o_custkey AS key, o_orderkey AS t, o_totalprice > 150000 AS won FROM orders), w AS (SELECT key, max(t) AS w FROM t WHERE won GROUP BY key)
SELECT t.key, count(*) AS total, sum(won::INT)::BIGINT AS wins, sum((w IS NULL OR t > w)::INT)::BIGINT AS loss_streak FROM t LEFT JOIN w ON w.key = t.key GROUP BY t.key"""
)
def live_streaks(spark, sf_dir):
    return store.live_streak(spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_custkey AS key", "o_orderkey AS t", "o_totalprice > 150000 AS won"))


# --- walks, learning and streams: no SQL counterpart, tested against plain folds


@query(
    "WITH RECURSIVE " + sql.TICK_BARS + "," + _ATR.replace("at AS", "av AS")
    + """, zb AS MATERIALIZED (SELECT b.symbol, b.bar_idx, high, low, close, CASE WHEN atr > 0 THEN 2 * atr ELSE close * 0.01 END AS need, high - low > 2 * atr AS wide, lag(close) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx) AS before,
  max(b.bar_idx) OVER (PARTITION BY b.symbol) AS last FROM bars b JOIN av ON av.symbol = b.symbol AND av.bar_idx = b.bar_idx),
st AS (SELECT symbol, coalesce(min(bar_idx) FILTER (WHERE wide), 14) AS start, count(*) FILTER (WHERE wide) > 0 AS found FROM zb WHERE bar_idx BETWEEN 14 AND 63 AND last >= 23 GROUP BY symbol),
z AS (SELECT s.symbol, b.bar_idx, b.bar_idx AS p_idx, CASE WHEN NOT found THEN close WHEN close > before THEN high ELSE low END AS price, NOT found OR close > before AS up, NULL::BIGINT AS t_idx, NULL::DOUBLE AS t_price, NULL::BOOLEAN AS t_high FROM st s JOIN zb b ON b.symbol = s.symbol AND b.bar_idx = s.start
 UNION ALL SELECT symbol, bar_idx, CASE WHEN turns OR further THEN bar_idx ELSE p_idx END, CASE WHEN turns THEN CASE WHEN up THEN low ELSE high END WHEN further THEN CASE WHEN up THEN high ELSE low END ELSE price END, up <> turns,
   CASE WHEN turns THEN p_idx END, CASE WHEN turns THEN price END, CASE WHEN turns THEN up END
 FROM (SELECT b.symbol, b.bar_idx, b.high, b.low, z.p_idx, z.price, z.up, CASE WHEN z.up THEN b.low < z.price - b.need ELSE b.high > z.price + b.need END AS turns, CASE WHEN z.up THEN b.high > z.price ELSE b.low < z.price END AS further
   FROM z JOIN zb b ON b.symbol = z.symbol AND b.bar_idx = z.bar_idx + 1))
SELECT symbol, t_idx AS bar_idx, round(t_price, 6) AS price, t_high AS is_high FROM z WHERE t_idx IS NOT NULL
UNION ALL SELECT z.symbol, z.p_idx, round(z.price, 6), z.up FROM z JOIN zb ON zb.symbol = z.symbol AND zb.bar_idx = z.bar_idx AND zb.last = z.bar_idx WHERE z.p_idx < z.bar_idx"""
)
def zigzag_points(spark, sf_dir):
    return rec.zigzag(ind.window_indicators(bars(spark, sf_dir))).select("symbol", "bar_idx", F.round("price", 6).alias("price"), "is_high")


@query()
def best_swing_trades(spark, sf_dir):
    return rec.best_trades(_pairs(spark, sf_dir), "symbol")


def slope_signals(spark, sf_dir) -> DataFrame:
    """1 where the moving average turns up, -1 where it turns down, 0 elsewhere."""
    turn = "sign(coalesce(ma5_slope, 0)) - sign(coalesce(lag(ma5_slope) OVER (PARTITION BY symbol ORDER BY bar_idx), 0))"
    return ind.window_indicators(bars(spark, sf_dir)).selectExpr("*", f"CAST(CASE WHEN {turn} > 0 THEN 1 WHEN {turn} < 0 THEN -1 ELSE 0 END AS int) AS signal")


@query()
def walk_forward_search(spark, sf_dir):
    grid = [Rules(target=t, stop=s, max_hold=h) for t in (0.004, 0.006, 0.010) for s in (0.004, 0.008) for h in (30, 60)]
    return rec.parameter_search(slope_signals(spark, sf_dir), grid)


@query()
def embedding_prototypes(spark, sf_dir):
    return learn.prototypes(embeddings(spark, sf_dir), 10)


@query()
def feature_importance(spark, sf_dir):
    names = [n for group in feat.GROUPS.values() for n in group]
    table = stored(ind.indicators(bars(spark, sf_dir)))
    judged = sig.outcomes(table, "long").where("hold >= 0 AND adx IS NOT NULL").select(*KEYS, F.col("outcome").cast("int").alias("y"))
    return learn.importances(feat.features(table).join(judged, KEYS), names, "y")


@query()
def trajectory_dtw(spark, sf_dir):
    """The ten trajectories of 20 bars nearest to each symbol's first, by DTW over three features;
    a trajectory ends at every bar."""
    cols = frame("collect_list", "array(rsi / 100, boll_position, volume_ratio)", "19 PRECEDING", "CURRENT ROW") + " AS y"
    held = with_halo(ind.window_indicators(bars(spark, sf_dir)).where("bar_idx >= 20"), 19).selectExpr("symbol", "bar_idx", "own", "chunk", cols)
    t = only_own(held).where("size(y) = 20")
    first = t.groupBy("symbol").agg(F.min_by("y", "bar_idx").alias("x"), F.min("bar_idx").alias("first_idx"))
    scored = sim.dtw_pairs(t.join(F.broadcast(first), "symbol").where("bar_idx > first_idx"))
    return scored.withColumn(
        "rank",
        F.expr("row_number() OVER (PARTITION BY symbol ORDER BY dtw, bar_idx)"),
    ).where("rank <= 10").select("symbol", "bar_idx", "dtw", "rank")


@query("SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS volume, max(value) AS high, min(value) AS low FROM events GROUP BY ALL")
def streamed_bars(spark, sf_dir):
    """Ticks read as a stream to the end of what is there, bars kept up to date in a table."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ticks = spark.readStream.schema(schema).option(
        "pathGlobFilter",
        "events.parquet",
    ).parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    made = feed.bars_from_ticks(ticks.selectExpr("event_type AS symbol", "cast(ts AS timestamp) AS ts", "event_id", "value AS price"))
    path, done = scratch(spark), []

    def keep(batch: DataFrame, number: int) -> None:  # complete mode: the last batch has all bars
        batch.write.parquet(f"{path}/{number}")
        done.append(number)

    made.writeStream.foreachBatch(keep).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(f"{path}/{max(done)}") if done else spark.createDataFrame([], made.schema)
    return kept.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "volume", "high", "low")


def _is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


# --- studies

_CONTRAST = "(VALUES " + ", ".join(f"('{n}')" for n in studies.CONTRASTED) + ") f(feature)"
_X = "CASE f.feature " + " ".join(f"WHEN '{n}' THEN {n}" for n in studies.CONTRASTED) + " END"
_SIDES = ["long_mean", "short_mean", "long_sd", "short_sd"]


@query(
    sql.with_windows(
        f"""SELECT feature, {sql.rounded(_SIDES)}, round((long_mean - short_mean) / (sqrt((long_sd * long_sd + short_sd * short_sd) / 2) + 1e-9), 6) + 0.0 AS effect, round((long_mean + short_mean) / 2, 6) + 0.0 AS midpoint FROM
(SELECT feature, avg(x) FILTER (WHERE side = 'long') AS long_mean, avg(x) FILTER (WHERE side = 'short') AS short_mean, stddev_pop(x) FILTER (WHERE side = 'long') AS long_sd, stddev_pop(x) FILTER (WHERE side = 'short') AS short_sd
 FROM (SELECT t.side, f.feature, {_X} AS x FROM trades t JOIN w ON w.symbol = t.symbol AND w.bar_idx = t.entry_idx, {_CONTRAST}) GROUP BY feature)""",
        SWINGS,
    )
)
def side_contrast(spark, sf_dir):
    b = bars(spark, sf_dir)
    trades = swing.label_trades(swing.alternating(swing.swing_points(b)))
    return rounded(studies.contrast(trades, ind.window_indicators(b)), ["feature"], [*_SIDES, "effect", "midpoint"])


_QUANTILES = [f"{c}_q{n}" for c in ("hold", "profit_pct") for n in (10, 25, 50, 75, 90)]


@query(_swings_sql("SELECT side, " + ", ".join(f"round(quantile_cont({c}, 0.{n:02d}), 6) + 0.0 AS {c}_q{n}" for c in ("hold", "profit_pct") for n in (10, 25, 50, 75, 90)) + " FROM trades GROUP BY side"))
def trade_quantiles(spark, sf_dir):
    return rounded(studies.hold_quantiles(swing.label_trades(points(spark, sf_dir))), ["side"], _QUANTILES)


@query(
    _swings_sql(
        """, d AS (SELECT o.offset_ AS offset_, (b.close / p.price - 1) * 100 AS c FROM points p, (SELECT unnest(range(1, 21)) AS offset_) o JOIN bars b ON b.symbol = p.symbol AND b.bar_idx = p.bar_idx + o.offset_ WHERE NOT p.is_high)
SELECT CAST(offset_ AS INTEGER) AS "offset", count(*) AS n, round(quantile_cont(c, 0.25), 6) + 0.0 AS p25, round(quantile_cont(c, 0.5), 6) + 0.0 AS median, round(quantile_cont(c, 0.75), 6) + 0.0 AS p75 FROM d GROUP BY offset_"""
    )
)
def probability_fan(spark, sf_dir):
    b = bars(spark, sf_dir)
    return rounded(studies.fan(swing.alternating(swing.swing_points(b)), b), ["offset", "n"], ["p25", "median", "p75"])


@query(
    sql.with_bars(
        """, n AS (SELECT symbol, max(bar_idx) + 1 AS n FROM bars GROUP BY symbol), f AS (SELECT symbol, unnest(range(0, (n - 300) // 100 + 1)) AS fold FROM n WHERE n >= 300)
SELECT symbol, fold, part, fold * 100 + a AS first, fold * 100 + b - 1 AS last FROM f, (VALUES ('train', 0, 180), ('validate', 180, 240), ('test', 240, 300)) r(part, a, b)"""
    )
)
def walk_forward_folds(spark, sf_dir):
    return studies.walk_forward_folds(bars(spark, sf_dir), 300, 100)


@query(
    sql.with_indicators(
        f"SELECT symbol, bar_idx, round(slope, 6) + 0.0 AS slope, {studies.gate_sql()} FROM s",
        "s AS (SELECT *, CASE WHEN bar_idx >= 4 THEN regr_slope(macd_hist, bar_idx) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS slope FROM i)",
    )
)
def histogram_gate(spark, sf_dir):
    return studies.histogram_gate(ind.indicators(bars(spark, sf_dir))).select("symbol", "bar_idx", (F.round("slope", 6) + F.lit(0.0)).alias("slope"), "side")


@query(
    sql.with_windows(
        """SELECT symbol, bar_idx, state, coalesce(last_value(twice IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx), 'RANGE') AS latched
FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY symbol ORDER BY bar_idx) THEN state END AS twice FROM ms)""",
        f"ms AS (SELECT symbol, bar_idx, {sig.MARKET_STATE} AS state FROM w)",
    )
)
def latched_states(spark, sf_dir):
    return studies.latched(ind.window_indicators(bars(spark, sf_dir)).selectExpr("symbol", "bar_idx", f"{sig.MARKET_STATE} AS state"))


@query(
    sql.with_indicators(
        f"SELECT symbol, bar_idx, round(outcome, 6) + 0.0 AS outcome FROM (SELECT symbol, bar_idx, {studies.cross_sql()} FROM g WHERE n = 30 AND j > d AND j_prev <= d_prev)",
        "g AS (SELECT *, max(high) OVER a AS top, min(low) OVER a AS bottom, count(*) OVER a AS n, lead(close, 30) OVER (PARTITION BY symbol ORDER BY bar_idx) AS last FROM i "
        "WINDOW a AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING))",
    )
)
def golden_cross_study(spark, sf_dir):
    return rounded(studies.golden_cross(ind.indicators(bars(spark, sf_dir))), KEYS, ["outcome"])


@query(
    sql.with_windows(
        f"""SELECT symbol, feature, round(regr_slope(x, bar_idx) / CASE WHEN stddev_pop(x) > 1e-9 THEN stddev_pop(x) ELSE 1 END, 6) + 0.0 AS trend
FROM (SELECT w.symbol, w.bar_idx, f.feature, {_X} AS x FROM w JOIN (SELECT symbol, max(bar_idx) AS e FROM bars GROUP BY symbol) m ON m.symbol = w.symbol AND w.bar_idx > m.e - 60, {_CONTRAST}) GROUP BY ALL"""
    )
)
def feature_trends(spark, sf_dir):
    return rounded(studies.feature_trends(ind.window_indicators(bars(spark, sf_dir)), list(studies.CONTRASTED)), ["symbol", "feature"], ["trend"])


_SCORES = {"long_score": studies.position_score_sql(True), "short_score": studies.position_score_sql(False)}


@query(sql.with_windows("SELECT symbol, bar_idx, " + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in _SCORES.items()) + " FROM w"))
def position_scores(spark, sf_dir):
    table = ind.window_indicators(bars(spark, sf_dir)).selectExpr("*", *[f"{x} AS {n}" for n, x in _SCORES.items()])
    return rounded(table, KEYS, _SCORES)


# Modules that register further queries.
from tidemark.plans import (  # noqa: E402, F401
    backtest_queries,
    hindsight_queries,
    mining_queries,
    order_queries,
    pool_queries,
    report_queries,
    source_queries,
    stream_queries,
    template_queries,
    warping_queries,
)
