"""Back-tests over bars, and recursive SQL that walks the same bars one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.operators import backtests as bt
from tidemark.operators import indicators as ind
from tidemark.operators import swings as swing
from tidemark.plans import sql
from tidemark.plans.registry import query, rounded
from tidemark.sources import bars as src

_SIGNAL = "CASE WHEN close > open * 1.002 THEN 1 WHEN close < open * 0.997 THEN -1 ELSE 0 END"


def bars(spark, sf_dir) -> DataFrame:
    return src.bars_from_ticks(spark, sf_dir)


def signalled(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir).withColumn("signal", F.expr(_SIGNAL))


def labelled(spark, sf_dir) -> DataFrame:
    """Long at swing lows, short at swing highs, and an exit on every thirteenth bar."""
    b = bars(spark, sf_dir)
    at = swing.alternating(swing.swing_points(b)).select("symbol", "bar_idx", F.when(F.col("is_high"), -1).otherwise(1).alias("l"))
    out = F.when(F.col("l").isNotNull(), F.col("l")).when(F.col("bar_idx") % 13 == 0, 2).when(F.col("bar_idx") % 13 == 7, -2).otherwise(0)
    return b.join(at, ["symbol", "bar_idx"], "left").withColumn("label", out).drop("l")


def scored(spark, sf_dir) -> DataFrame:
    b = bars(spark, sf_dir)
    return b.withColumns({"long_score": (F.col("close") / F.col("open") - 1) * 100, "short_score": (F.col("open") / F.col("close") - 1) * 100 + 0.01})


# One bar after another: what the exit ladder makes of the bar, then the signal.
_WALK = """
bs AS MATERIALIZED (SELECT symbol, bar_idx, high, low, close, CASE WHEN close > open * 1.002 THEN 1 WHEN close < open * 0.997 THEN -1 ELSE 0 END AS signal, max(bar_idx) OVER (PARTITION BY symbol) AS last FROM bars),
w AS (
 SELECT symbol, -1::BIGINT AS bar_idx, 5000.0::DOUBLE AS capital, 0 AS side, 0.0::DOUBLE AS entry, 0::BIGINT AS since, 0.0::DOUBLE AS size, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS goal, false AS trails, 0.0::DOUBLE AS best, false AS lifted,
   0.0::DOUBLE AS equity, [{'since': 0::BIGINT, 'side': 0, 'entry': 0.0::DOUBLE, 'out': 0.0::DOUBLE, 'size': 0.0::DOUBLE, 'reason': ''}] AS done FROM bs WHERE bar_idx = 0
 UNION ALL
 SELECT symbol, bar_idx, capital - CASE WHEN opens THEN capital * 0.05 * 20 * 0.0004 ELSE 0 END, CASE WHEN opens THEN signal ELSE side END, CASE WHEN opens THEN close * (1 + signal * 0.0002) ELSE entry END,
   CASE WHEN opens THEN bar_idx ELSE since END, CASE WHEN opens THEN capital * 0.05 * 20 / (close * (1 + signal * 0.0002)) ELSE size END,
   CASE WHEN opens THEN close * (1 + signal * 0.0002) * (1 - signal * 0.008) ELSE stop END, CASE WHEN opens THEN close * (1 + signal * 0.0002) * (1 + signal * 0.006) ELSE goal END,
   trails AND NOT opens, CASE WHEN opens THEN 0 ELSE best END, lifted AND NOT opens,
   capital + CASE WHEN opens THEN - capital * 0.05 * 20 * 0.0004 + signal * (close - close * (1 + signal * 0.0002)) * capital * 0.05 * 20 / (close * (1 + signal * 0.0002)) ELSE side * (close - entry) * size END,
   CASE WHEN bar_idx = last AND (opens OR side <> 0) THEN list_append(done, {'since': CASE WHEN opens THEN bar_idx ELSE since END, 'side': CASE WHEN opens THEN signal ELSE side END, 'entry': CASE WHEN opens THEN close * (1 + signal * 0.0002) ELSE entry END,
     'out': close * (1 - CASE WHEN opens THEN signal ELSE side END * 0.0002), 'size': CASE WHEN opens THEN capital * 0.05 * 20 / (close * (1 + signal * 0.0002)) ELSE size END, 'reason': 'end'}) ELSE done END
 FROM (SELECT * EXCLUDE (side, size, capital, done), turns OR (side = 0 AND signal <> 0) AS opens, CASE WHEN turns THEN 0 ELSE side END AS side, CASE WHEN turns THEN 0.0 ELSE size END AS size,
     capital + CASE WHEN turns THEN side * (close * (1 - side * 0.0002) - entry) * size - close * (1 - side * 0.0002) * size * 0.0004 ELSE 0 END AS capital,
     CASE WHEN turns THEN list_append(done, {'since': since, 'side': side, 'entry': entry, 'out': close * (1 - side * 0.0002), 'size': size, 'reason': 'signal'}) ELSE done END AS done
   FROM (SELECT *, side <> 0 AND signal = -side AS turns FROM (
     SELECT symbol, bar_idx, close, signal, last, entry, since, goal, lifted2 AS lifted, trails OR hit_goal AS trails, CASE WHEN hit_goal THEN goal ELSE best2 END AS best, CASE WHEN hit_goal THEN entry ELSE stop2 END AS stop,
       CASE WHEN hit_stop THEN 0 ELSE side END AS side, CASE WHEN hit_stop THEN 0.0 WHEN hit_goal THEN size - size * 0.7 ELSE size END AS size,
       capital + CASE WHEN hit_stop THEN side * (stop2 * (1 - side * 0.0002) - entry) * size - stop2 * (1 - side * 0.0002) * size * 0.0004
                      WHEN hit_goal THEN side * (goal * (1 - side * 0.0002) - entry) * size * 0.7 - goal * (1 - side * 0.0002) * size * 0.7 * 0.0004 ELSE 0 END AS capital,
       CASE WHEN hit_stop THEN [{'since': since, 'side': side, 'entry': entry, 'out': stop2 * (1 - side * 0.0002), 'size': size, 'reason': CASE WHEN trails THEN 'trailing' ELSE 'stop' END}]
            WHEN hit_goal THEN [{'since': since, 'side': side, 'entry': entry, 'out': goal * (1 - side * 0.0002), 'size': size * 0.7, 'reason': 'first_target'}] ELSE [] END AS done
     FROM (SELECT *, side <> 0 AND side * (bad - stop2) <= 0 AS hit_stop, side <> 0 AND NOT trails AND side * (bad - stop2) > 0 AND side * (good - goal) >= 0 AS hit_goal FROM (
       SELECT *, CASE WHEN trails THEN CASE WHEN side * (best2 * (1 - side * 0.02) - stop) > 0 THEN best2 * (1 - side * 0.02) ELSE stop END
                      WHEN lifted2 AND NOT lifted AND side * (entry * (1 + side * (-3.0 / 100 / 20)) - stop) > 0 THEN entry * (1 + side * (-3.0 / 100 / 20)) ELSE stop END AS stop2 FROM (
         SELECT *, CASE WHEN side = 0 THEN best WHEN trails THEN CASE WHEN side * (good - best) > 0 THEN good ELSE best END ELSE greatest(best, side * (good - entry) / entry * 20 * 100) END AS best2,
           lifted OR (side <> 0 AND NOT trails AND greatest(best, side * (good - entry) / entry * 20 * 100) >= 6) AS lifted2
         FROM (SELECT b.symbol, b.bar_idx, b.close, b.signal, b.last, CASE WHEN w.side > 0 THEN b.high ELSE b.low END AS good, CASE WHEN w.side > 0 THEN b.low ELSE b.high END AS bad,
                 w.capital, w.side, w.entry, w.since, w.size, w.stop, w.goal, w.trails, w.best, w.lifted FROM w JOIN bs b ON b.symbol = w.symbol AND b.bar_idx = w.bar_idx + 1)))))))),
dn AS MATERIALIZED (SELECT symbol, exit_idx, d.since AS entry_idx, CASE WHEN d.side > 0 THEN 'long' ELSE 'short' END AS side, d.entry AS entry_price, d.out AS exit_price, d.size AS size,
  d.side * (d.out - d.entry) * d.size - d.out * d.size * 0.0004 AS profit, d.side * (d.out - d.entry) / d.entry * 100 AS profit_pct, exit_idx - d.since AS hold, d.reason AS reason
  FROM (SELECT symbol, bar_idx AS exit_idx, unnest(done) AS d FROM w WHERE bar_idx >= 0))"""


def _walked(select: str, *more: str) -> str:
    return f"WITH RECURSIVE {','.join([sql.TICK_BARS, _WALK, *more])}\n{select}"


_NUMBERS = ["entry_price", "exit_price", "size", "profit", "profit_pct"]


@query(_walked(f"SELECT symbol, entry_idx, exit_idx, side, hold, reason, {sql.rounded(_NUMBERS)} FROM dn"))
def signal_backtest(spark, sf_dir):
    return rounded(bt.on_signals(signalled(spark, sf_dir)), ["symbol", "entry_idx", "exit_idx", "side", "hold", "reason"], _NUMBERS)


@query(_walked("SELECT symbol, bar_idx, round(equity, 5) AS equity FROM w WHERE bar_idx >= 0"))
def signal_equity(spark, sf_dir):
    return rounded(bt.on_signals(signalled(spark, sf_dir), equity=True), ["symbol", "bar_idx"], ["equity"], 5)


@query(
    _walked(
        "SELECT symbol, count(*) AS bars, round(max((peak - equity) / peak), 6) AS max_drawdown, round(arg_max(equity, bar_idx), 5) AS equity, round((arg_max(equity, bar_idx) / 5000 - 1) * 100, 6) + 0.0 AS return_pct FROM "
        "(SELECT symbol, bar_idx, equity, greatest(5000, max(equity) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS peak FROM w WHERE bar_idx >= 0) GROUP BY symbol"
    )
)
def equity_metrics(spark, sf_dir):
    e = bt.on_signals(signalled(spark, sf_dir), equity=True)
    d = bt.drawdowns(e, 5000.0)
    return d.select(
        "symbol",
        "bars",
        F.round("max_drawdown", 6).alias("max_drawdown"),
        F.round("equity", 5).alias("equity"),
        (F.round("return_pct", 6) + F.lit(0.0)).alias("return_pct"),
    )


_STATS = [
    "total_profit",
    "gross_profit",
    "gross_loss",
    "avg_profit_pct",
    "avg_hold",
    "long_profit",
    "short_profit",
    "win_rate",
    "long_win_rate",
    "short_win_rate",
    "profit_factor",
    "avg_win",
    "avg_loss",
    "sharpe",
]


@query(
    _walked(
        f"""SELECT symbol, n, wins, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in _STATS)} FROM (SELECT symbol, count(*) AS n, sum((profit > 0)::INT)::BIGINT AS wins, sum(profit) AS total_profit, coalesce(sum(profit) FILTER (WHERE profit > 0), 0) AS gross_profit,
  coalesce(-sum(profit) FILTER (WHERE profit <= 0), 0) AS gross_loss, avg(profit_pct) AS avg_profit_pct, avg(hold) AS avg_hold, coalesce(sum(profit) FILTER (WHERE side = 'long'), 0) AS long_profit, coalesce(sum(profit) FILTER (WHERE side = 'short'), 0) AS short_profit,
  avg((profit > 0)::INT) AS win_rate, coalesce(avg((profit > 0)::INT) FILTER (WHERE side = 'long'), 0) AS long_win_rate, coalesce(avg((profit > 0)::INT) FILTER (WHERE side = 'short'), 0) AS short_win_rate,
  sum(profit) FILTER (WHERE profit > 0) / nullif(-sum(profit) FILTER (WHERE profit <= 0), 0) AS profit_factor, coalesce(avg(profit) FILTER (WHERE profit > 0), 0) AS avg_win, coalesce(-avg(profit) FILTER (WHERE profit <= 0), 0) AS avg_loss,
  CASE WHEN count(*) > 1 AND stddev_pop(profit_pct) > 0 THEN avg(profit_pct) / stddev_pop(profit_pct) * sqrt(252) ELSE 0 END AS sharpe FROM dn GROUP BY symbol)"""
    )
)
def backtest_statistics(spark, sf_dir):
    return rounded(bt.statistics(bt.on_signals(signalled(spark, sf_dir)), "symbol"), ["symbol", "n", "wins"], _STATS, 5)


@query(
    _walked(
        "SELECT symbol, reason, n, round(win_rate, 6) AS win_rate, round(mean, 6) + 0.0 AS mean, round(drawdown, 6) + 0.0 AS drawdown, round(CASE WHEN sd > 1e-9 THEN mean / sd ELSE mean * 10 END, 5) + 0.0 AS sharpe FROM ("
        "SELECT symbol, reason, count(*) AS n, avg((profit_pct > 0)::INT) AS win_rate, avg(profit_pct) AS mean, stddev_pop(profit_pct) AS sd, max(greatest(0, top) - s) AS drawdown FROM "
        "(SELECT *, max(s) OVER (PARTITION BY symbol, reason ORDER BY exit_idx) AS top FROM (SELECT *, sum(profit_pct) OVER (PARTITION BY symbol, reason ORDER BY exit_idx) AS s FROM dn)) GROUP BY symbol, reason)"
    )
)
def simulated_statistics(spark, sf_dir):
    t = bt.on_signals(signalled(spark, sf_dir)).withColumn("t", F.col("exit_idx"))
    s = bt.simulated_statistics(t, "symbol", "reason")
    return s.select(
        "symbol",
        "reason",
        "n",
        *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("win_rate", "mean", "drawdown")],
        (F.round("sharpe", 5) + F.lit(0.0)).alias("sharpe"),
    )


@query(
    f"""WITH RECURSIVE {sql.TICK_BARS},
sw AS (SELECT * FROM (SELECT symbol, bar_idx, high, low, max(high) OVER n AS top, min(low) OVER n AS bottom, count(*) OVER n AS seen FROM bars WINDOW n AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE seen = 11 AND (high = top OR low = bottom)),
sy AS (SELECT *, sum((g IS DISTINCT FROM h)::INT) OVER (PARTITION BY symbol ORDER BY bar_idx) AS run FROM (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY bar_idx) AS g FROM (SELECT symbol, bar_idx, high = top AS h, CASE WHEN high = top THEN high ELSE low END AS price FROM sw))),
sz AS (SELECT symbol, CASE WHEN any_value(h) THEN -1 ELSE 1 END AS l, CASE WHEN any_value(h) THEN arg_max(bar_idx, (price, -bar_idx)) ELSE arg_min(bar_idx, (price, bar_idx)) END AS bar_idx FROM sy GROUP BY symbol, run),
lb AS MATERIALIZED (SELECT b.symbol, b.bar_idx, high, low, close, coalesce(l, CASE WHEN b.bar_idx % 13 = 0 THEN 2 WHEN b.bar_idx % 13 = 7 THEN -2 ELSE 0 END) AS label, max(b.bar_idx) OVER (PARTITION BY b.symbol) AS last FROM bars b LEFT JOIN sz ON sz.symbol = b.symbol AND sz.bar_idx = b.bar_idx),
ev AS (SELECT *, CASE WHEN label IN (1, -2) THEN low ELSE high END AS at_price FROM lb),
w AS (SELECT symbol, -1::BIGINT AS bar_idx, 5000.0::DOUBLE AS capital, 0 AS side, 0.0::DOUBLE AS entry, 0::BIGINT AS since, 0.0::DOUBLE AS size, 0.0::DOUBLE AS out, 0.0::DOUBLE AS profit, 0.0::DOUBLE AS gain, 0::BIGINT AS was, '' AS how FROM ev WHERE bar_idx = 0
 UNION ALL
 SELECT symbol, bar_idx, c2 - CASE WHEN opens THEN c2 * 10 * 0.0004 ELSE 0 END, CASE WHEN opens THEN label WHEN leaves THEN 0 ELSE side END, CASE WHEN opens THEN at_price * (1 + label * 0.0002) ELSE entry END, CASE WHEN opens THEN bar_idx ELSE since END,
   CASE WHEN opens THEN c2 * 10 / (at_price * (1 + label * 0.0002)) WHEN leaves THEN 0 ELSE size END, o, CASE WHEN leaves THEN p END, side * (o - entry) / entry * 100, since, CASE WHEN leaves THEN CASE WHEN side > 0 THEN 'long' ELSE 'short' END END
 FROM (SELECT *, capital + CASE WHEN leaves THEN p ELSE 0 END AS c2 FROM (SELECT *, side * (o - entry) * size - o * size * 0.0004 AS p FROM (
   SELECT e.symbol, e.bar_idx, e.label, e.at_price, w.capital, w.side, w.entry, w.since, w.size, e.at_price * (1 - w.side * 0.0002) AS o, w.side <> 0 AND (e.label = -w.side OR e.label = 2 * w.side) AS leaves, e.label IN (1, -1) AND w.side <> e.label AS opens
   FROM w JOIN ev e ON e.symbol = w.symbol AND e.bar_idx = w.bar_idx + 1))))
SELECT symbol, was AS entry_idx, bar_idx AS exit_idx, how AS side, 'signal' AS reason, round(profit, 4) + 0.0 AS profit, round(gain, 6) + 0.0 AS profit_pct FROM w WHERE how <> ''
UNION ALL SELECT w.symbol, since, w.bar_idx, CASE WHEN side > 0 THEN 'long' ELSE 'short' END, 'end', round(side * (close * (1 - side * 0.0002) - entry) * size - close * (1 - side * 0.0002) * size * 0.0004, 4) + 0.0, round(side * (close * (1 - side * 0.0002) - entry) / entry * 100, 6) + 0.0
  FROM w JOIN ev ON ev.symbol = w.symbol AND ev.bar_idx = w.bar_idx AND ev.last = w.bar_idx WHERE side <> 0"""
)
def label_backtest(spark, sf_dir):
    t = bt.on_labels(labelled(spark, sf_dir))
    return t.select(
        "symbol",
        "entry_idx",
        "exit_idx",
        "side",
        "reason",
        (F.round("profit", 4) + F.lit(0.0)).alias("profit"),
        (F.round("profit_pct", 6) + F.lit(0.0)).alias("profit_pct"),
    )


@query()
def strategy_backtest(spark, sf_dir):
    return bt.on_scores(scored(spark, sf_dir), 0.15, 0.2)


@query()
def pool_backtest(spark, sf_dir):
    table = ind.window_indicators(bars(spark, sf_dir))
    return bt.on_pool(table.withColumn("signal", F.expr(_SIGNAL)))


@query()
def matrix_backtest(spark, sf_dir):
    """Trades on the scores of six made-up prototypes, four long and two short, of every tenth bar."""
    table = stored(ind.window_indicators(bars(spark, sf_dir)).select("symbol", "bar_idx", "high", "low", "close", "atr"))
    each = table.where("bar_idx % 10 = 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(5))))
    scores = each.select(
        "symbol",
        "bar_idx",
        F.when(F.col("p") < 4, "LONG").otherwise("SHORT").alias("direction"),
        (F.pmod(F.xxhash64("bar_idx", "p"), F.lit(1000)) / 1000).alias("score"),
    )
    return bt.scored_matrix(table, scores, 0.6)
