"""Orders and learners over tables made from `orders`, `lineitem` and `events`, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch
from tidemark.operators import indicators as ind
from tidemark.operators import learners as learn
from tidemark.operators import orders as od
from tidemark.operators import templates as tpl
from tidemark.plans import sql
from tidemark.plans.registry import query, rounded, table
from tidemark.sources import bars as src

_REGIMES = ("STRONG_BULL", "WEAK_BULL", "RANGE_BULL", "RANGE_BEAR", "WEAK_BEAR", "STRONG_BEAR", "UNKNOWN")
_TEXTS = (
    "Take profit hit at 1.2",
    "moved to break even",
    "gain LOCKED",
    "trailing stop",
    "staged exit 2",
    "partial close",
    "stop loss hit",
    "pattern derailed",
    "nothing known",
)


def closed(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    p = F.round((F.col("o_totalprice") - 150000) / 20000, 4)
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.concat(
            F.lit("account "),
            F.col("o_custkey") % 7,
        ).alias("symbol"), F.when(F.col("o_orderkey") % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        p.alias("profit_pct"), F.round(F.col("o_totalprice") - 150000, 2).alias("pnl"), F.round(
            p + (F.col("o_custkey") % 5) / 2,
            4,
        ).alias("peak_pct"), (F.col("o_orderkey") % 90).alias("hold"),
        at(_REGIMES, F.col("o_custkey") % 7).alias("regime"), at(
            _REGIMES,
            F.col("o_orderkey") % 7,
        ).alias("now"), (F.col("o_orderkey") % 100 / 100).alias("similarity"), at(_TEXTS, F.col("o_custkey") % 9).alias("text"),
        (F.col("o_custkey") % 50).alias("strategy"), F.col("o_orderdate").alias("closed"), F.col("o_orderdate").alias("opened"), F.col("o_totalprice").alias("entry"),
    )


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_ORDERS = f"""od AS MATERIALIZED (SELECT o_orderkey AS order_id, 'account ' || (o_custkey % 7) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, round((o_totalprice - 150000) / 20000, 4) AS profit_pct,
  round(o_totalprice - 150000, 2) AS pnl, round(round((o_totalprice - 150000) / 20000, 4) + (o_custkey % 5) / 2, 4) AS peak_pct, o_orderkey % 90 AS hold, {_list(_REGIMES)}[1 + o_custkey % 7] AS regime, {_list(_REGIMES)}[1 + o_orderkey % 7] AS now,
  o_orderkey % 100 / 100 AS similarity, {_list(_TEXTS)}[1 + o_custkey % 9] AS text, o_custkey % 50 AS strategy, o_orderdate AS closed, o_totalprice AS entry FROM orders),
rs AS MATERIALIZED (SELECT *, CASE text WHEN 'Take profit hit at 1.2' THEN 'TAKE_PROFIT' WHEN 'moved to break even' THEN 'BREAK_EVEN' WHEN 'gain LOCKED' THEN 'LOCKED_GAIN' WHEN 'trailing stop' THEN 'TRAILING' WHEN 'staged exit 2' THEN 'STAGED'
  WHEN 'partial close' THEN 'PARTIAL' WHEN 'stop loss hit' THEN 'STOP_LOSS' WHEN 'pattern derailed' THEN 'DERAILED' ELSE 'OTHER' END AS reason FROM od)"""


def _sql(select: str, *more: str) -> str:
    return f"WITH {','.join([_ORDERS, *more])}\n{select}"


def reasoned(spark, sf_dir) -> DataFrame:
    return closed(spark, sf_dir).withColumn("reason", od.reason_of("text"))


@query(
    _sql(
        """SELECT order_id, reason, CASE WHEN peak_pct <= 0 THEN '' WHEN peak_pct >= 1.2 AND profit_pct < peak_pct / 2 AND reason <> 'TAKE_PROFIT' THEN 'TAKE_PROFIT' WHEN reason = 'STOP_LOSS' AND peak_pct > abs(profit_pct) * 0.3 THEN 'WIDER_STOP'
  WHEN reason = 'TRAILING' AND profit_pct < peak_pct * 0.6 AND peak_pct >= 1 THEN 'TRAIL_EARLIER' ELSE '' END AS advice FROM rs"""
    )
)
def exit_reasons(spark, sf_dir):
    return reasoned(spark, sf_dir).select("order_id", "reason", od.peak_advice("reason", "peak_pct", "profit_pct").alias("advice"))


_CHANGE = """ch AS (SELECT *, CASE WHEN now = 'UNKNOWN' THEN 'SAME' WHEN side = 'LONG' AND now LIKE '%BEAR' OR side = 'SHORT' AND now LIKE '%BULL' THEN 'REVERSED' WHEN now LIKE 'RANGE%' THEN 'WEAKENED'
  WHEN right(regime, 4) = right(now, 4) AND (regime LIKE 'STRONG%' AND now NOT LIKE 'STRONG%' OR regime LIKE 'WEAK%' AND now LIKE 'RANGE%') THEN 'WEAKENED' ELSE 'SAME' END AS change,
  CASE WHEN similarity >= 0.7 THEN 'SAFE' WHEN similarity >= 0.5 THEN 'ALERT' WHEN similarity >= 0.3 THEN 'DANGER' ELSE 'DERAIL' END AS status FROM od)"""


@query(
    _sql(
        """SELECT order_id, change, status, CASE WHEN status = 'DERAIL' THEN 'TIGHTEN' WHEN change = 'REVERSED' AND profit_pct >= 1 THEN 'PARTIAL' WHEN change = 'REVERSED' THEN 'LEAVE' WHEN change = 'WEAKENED' AND peak_pct >= 10 AND profit_pct >= 0.5 THEN 'PARTIAL'
  WHEN change = 'WEAKENED' THEN 'TIGHTEN' WHEN status = 'ALERT' AND profit_pct >= 1 THEN 'TIGHTEN' WHEN peak_pct >= 1.5 AND (peak_pct - profit_pct) / peak_pct >= 0.5 AND profit_pct >= 0.3 THEN 'TIGHTEN' ELSE 'HOLD' END AS advice FROM ch""",
        _CHANGE,
    )
)
def exit_advice(spark, sf_dir):
    held = closed(spark, sf_dir).withColumn("change", od.regime_change("regime", "now", "side")).withColumn("status", tpl.health("similarity"))
    return held.select("order_id", "change", "status", od.exit_advice("change", "similarity", "status", "profit_pct", "peak_pct").alias("advice"))


@query(
    _sql(
        """SELECT reason, count(*) AS n, sum((pnl > 0)::INT)::BIGINT AS wins, round(sum(pnl), 2) AS pnl, round(sum(profit_pct), 4) AS profit_pct, round(avg(hold), 6) AS avg_hold, round(avg(CASE WHEN peak_pct > 0 THEN greatest(0, peak_pct - profit_pct) ELSE 0 END), 6) AS avg_peak_loss,
  sum((reason = 'STOP_LOSS' AND peak_pct > abs(profit_pct) * 0.3)::INT)::BIGINT AS turned FROM (SELECT * FROM rs ORDER BY closed DESC, order_id DESC LIMIT 500) GROUP BY reason"""
    )
)
def profit_by_reason(spark, sf_dir):
    r = od.by_reason(reasoned(spark, sf_dir))
    return r.select(
        "reason",
        "n",
        "wins",
        F.round("pnl", 2).alias("pnl"),
        F.round("profit_pct", 4).alias("profit_pct"),
        F.round("avg_hold", 6).alias("avg_hold"),
        F.round("avg_peak_loss", 6).alias("avg_peak_loss"),
        "turned",
    )


@query(
    _sql(
        f"""SELECT d.side, d.regime, count(o.pnl) AS n, coalesce(sum((pnl > 0)::INT), 0)::BIGINT AS wins, coalesce(sum((pnl < 0)::INT), 0)::BIGINT AS losses, round(coalesce(avg(profit_pct) FILTER (WHERE pnl > 0), 0), 6) AS avg_win,
  round(coalesce(avg(profit_pct) FILTER (WHERE pnl < 0), 0), 6) AS avg_loss, round(coalesce(avg(profit_pct), 0), 6) + 0.0 AS avg_all, round(coalesce(sum(pnl), 0), 2) AS pnl, round(coalesce(avg((pnl > 0)::INT), 0), 6) AS win_rate
FROM (SELECT s AS side, r AS regime FROM (SELECT unnest(['LONG', 'SHORT']) AS s), (SELECT unnest({_list(_REGIMES)}) AS r)) d LEFT JOIN od o ON o.side = d.side AND o.regime = d.regime AND o.strategy <> 3 GROUP BY ALL"""
    )
)
def regime_table(spark, sf_dir):
    r = od.regime_table(closed(spark, sf_dir).where("strategy <> 3"))
    return r.select(
        "side",
        "regime",
        "n",
        "wins",
        "losses",
        *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("avg_win", "avg_loss", "avg_all")],
        F.round("pnl", 2).alias("pnl"),
        F.round("win_rate", 6).alias("win_rate"),
    )


@query(
    _sql(
        "SELECT strategy, count(*) AS n, sum((side = 'LONG')::INT)::BIGINT AS long, sum((side = 'SHORT')::INT)::BIGINT AS short, sum((pnl > 0)::INT)::BIGINT AS wins, round(coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0), 2) AS gained, round(coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0), 2) AS lost, round(sum(pnl), 2) AS net FROM od GROUP BY strategy"
    )
)
def strategy_table(spark, sf_dir):
    return od.strategy_table(closed(spark, sf_dir)).withColumns({c: F.round(c, 2) for c in ("gained", "lost", "net")})


@query(
    _sql(
        """SELECT symbol, count(*) AS n, sum(won)::BIGINT AS wins, sum((side = 'LONG')::INT)::BIGINT AS longs, round(max(peak), 2) AS peak, round(arg_max(balance, pos), 2) AS balance, round(max(peak - balance), 2) AS drawdown, max(streak)::BIGINT AS worst_streak, arg_max(streak, pos)::BIGINT AS loss_streak
FROM (SELECT *, greatest(5000, max(balance) OVER (PARTITION BY symbol ORDER BY pos)) AS peak, pos - coalesce(max(CASE WHEN won = 1 THEN pos END) OVER (PARTITION BY symbol ORDER BY pos), 0) AS streak FROM
  (SELECT *, 5000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY pos) AS balance, (pnl > 0)::INT AS won FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY closed, order_id) AS pos FROM od))) GROUP BY symbol"""
    )
)
def account_statistics(spark, sf_dir):
    a = od.accounts(closed(spark, sf_dir))
    return a.select("symbol", "n", "wins", "longs", *[F.round(c, 2).alias(c) for c in ("peak", "balance", "drawdown")], "worst_streak", "loss_streak")


@query(_sql("SELECT order_id, pnl + CASE WHEN order_id % 3 = 0 THEN 1 ELSE 0 END AS pnl FROM od WHERE order_id % 2 = 0 OR order_id % 3 = 0"))
def upserted_orders(spark, sf_dir):
    """A history written as JSON, read with its schema, and brought up to date by newer versions."""
    c, path = closed(spark, sf_dir).withColumn("entry", F.col("order_id").cast("double")), scratch(spark)
    c.where("order_id % 2 = 0").write.json(path)
    own = spark.read.schema(c.schema).json(path)
    return od.upserted(own, c.where("order_id % 3 = 0").withColumn("pnl", F.col("pnl") + 1)).select("order_id", "pnl")


@query(
    sql.with_bars(
        """, e AS (SELECT event_id, event_type AS symbol, ts + INTERVAL 17 MINUTE AS at_ts FROM events WHERE user_id % 5 = 0), m AS (SELECT e.event_id, e.symbol, b.bar_idx, abs(epoch(b.ts) - epoch(e.at_ts)) AS seconds, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch(b.ts) - epoch(e.at_ts)), b.ts) AS r
FROM e JOIN bars b ON b.symbol = e.symbol AND b.ts BETWEEN e.at_ts - INTERVAL 30 DAY AND e.at_ts + INTERVAL 30 DAY) SELECT event_id, symbol, bar_idx, round(seconds / 10) AS seconds FROM m WHERE r = 1"""
    )
)
def nearest_bars(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id % 5 = 0").select(
        "event_id",
        F.col("event_type").alias("symbol"),
        F.expr("ts + interval 17 minutes").alias("at"),
    )
    return od.nearest_bars(e, src.bars_from_ticks(spark, sf_dir), "event_id").select(
        "event_id",
        "symbol",
        "bar_idx",
        F.round(F.col("seconds") / 10).alias("seconds"),
    )


_GATED = "g AS (SELECT *, lag(macd_hist) OVER w AS hb, lag(j) OVER w AS jb, CASE WHEN bar_idx % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS side, list_value('STRONG_BULL', 'RANGE_BEAR', 'UNKNOWN')[1 + bar_idx % 3] AS regime FROM i WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"


@query(
    sql.with_indicators(
        """SELECT symbol, bar_idx, coalesce(CASE side WHEN 'LONG' THEN (macd_hist < hb OR macd_hist < 0) AND j < jb ELSE (macd_hist > hb OR macd_hist > 0) AND j > jb END, true) AS confirmed,
  (CASE side WHEN 'LONG' THEN (regime = 'RANGE_BEAR')::INT + coalesce((macd_hist < 0 AND macd_hist < hb)::INT, 0) + coalesce((j < jb AND j < 50)::INT, 0) ELSE (regime = 'STRONG_BULL')::INT + coalesce((macd_hist > 0 AND macd_hist > hb)::INT, 0) + coalesce((j > jb AND j > 50)::INT, 0) END)::INT AS votes FROM g""",
        _GATED,
    )
)
def exit_gates(spark, sf_dir):
    from tidemark.functions.windows import only_own, with_halo

    before = lambda c: f"lag({c}) OVER (PARTITION BY symbol, chunk ORDER BY bar_idx)"
    t = only_own(with_halo(ind.indicators(src.bars_from_ticks(spark, sf_dir)), 2).selectExpr("symbol", "bar_idx", "macd_hist", "j", "own", "chunk", f"{before('macd_hist')} AS hb", f"{before('j')} AS jb"))
    t = t.selectExpr("*", "IF(bar_idx % 2 = 0, 'LONG', 'SHORT') AS side", "array('STRONG_BULL', 'RANGE_BEAR', 'UNKNOWN')[cast(bar_idx % 3 as int)] AS regime")
    return t.select(
        "symbol",
        "bar_idx",
        od.exit_confirmed("macd_hist", "hb", "j", "jb", "side").alias("confirmed"),
        od.reversal_votes("regime", "macd_hist", "hb", "j", "jb", "side").cast("int").alias("votes"),
    )


@query(
    _sql(
        """SELECT order_id, CASE WHEN regime LIKE '%BULL' AND side = 'SHORT' THEN similarity >= 0.62 AND hold >= 10 WHEN regime LIKE '%BEAR' AND side = 'LONG' THEN similarity >= 0.74 AND hold >= 10 ELSE true END AS allowed,
  CASE WHEN profit_pct BETWEEN -1 AND 1 THEN 'inside' WHEN profit_pct BETWEEN -1 - 2 * greatest(2, hold * 0.08) AND 1 + 2 * greatest(2, hold * 0.08) THEN 'edge' ELSE 'outside' END AS place,
  round(entry * CASE side WHEN 'LONG' THEN 1.006 ELSE 0.994 END, 4) AS take_profit, round(entry * CASE side WHEN 'LONG' THEN 0.992 ELSE 1.008 END, 4) AS stop_loss FROM od"""
    )
)
def entry_gates(spark, sf_dir):
    o = closed(spark, sf_dir).withColumns({"state": F.when(F.col("regime").endswith("BULL"), "BULL").when(F.col("regime").endswith("BEAR"), "BEAR").otherwise("RANGE"), "way": F.lower("side"), "lo": F.lit(-1.0), "hi": F.lit(1.0), "mid": F.lit(0.0), "range": F.col("hold").cast("double")})
    found = o.select(
        "order_id",
        od.counter_trend_allowed("state", "way", "similarity", "hold").alias("allowed"),
        od.fan_place("profit_pct", "lo", "hi", "mid", "range").alias("place"),
        *od.fixed_exits("entry", "side"),
    )
    return found.withColumns({c: F.round(c, 4) for c in ("take_profit", "stop_loss")})


# --- learners

_JUDGED = """jd AS MATERIALIZED (SELECT l_orderkey, l_linenumber, l_returnflag || (l_suppkey % 4) AS reason, l_returnflag AS kind, l_quantity / 50 - 0.02 AS similarity, 0.6::DOUBLE AS threshold, (l_quantity - 25) / 10 AS move, l_discount * 10 AS favourable, l_tax * 10 AS adverse,
  CASE WHEN l_discount > 0.05 THEN 'premature' WHEN l_tax > 0.06 THEN 'late' ELSE 'correct' END AS verdict, CASE WHEN l_quantity < 15 THEN 'too_tight' WHEN l_quantity > 35 THEN 'neutral' ELSE 'correct' END AS stop_verdict FROM lineitem)"""


def judged(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(
            "l_returnflag",
            F.col("l_suppkey") % 4,
        ).alias("reason"), F.col("l_returnflag").alias("kind"), (q / 50 - 0.02).alias("similarity"), F.lit(0.6).alias("threshold"), ((q - 25) / 10).alias("move"), (F.col("l_discount") * 10).alias("favourable"), (F.col("l_tax") * 10).alias("adverse"),
        F.when(
            F.col("l_discount") > 0.05,
            "premature",
        ).when(F.col("l_tax") > 0.06, "late").otherwise("correct").alias("verdict"), F.when(q < 15, "too_tight").when(q > 35, "neutral").otherwise("correct").alias("stop_verdict"),
    )


@query(
    f"""WITH {_JUDGED} SELECT band, count(*) AS n, round(avg((move > 0.3)::INT), 6) AS profitable_rate, round(coalesce(sum(abs(move)) FILTER (WHERE move > 0.3), 0), 4) AS gain, round(coalesce(sum(abs(move)) FILTER (WHERE NOT move > 0.3), 0), 4) AS loss FROM
(SELECT *, CASE WHEN threshold - similarity <= 0 THEN NULL WHEN threshold - similarity <= 0.02 THEN 'VERY_CLOSE' WHEN threshold - similarity <= 0.05 THEN 'CLOSE' ELSE 'MARGINAL' END AS band FROM jd) GROUP BY band"""
)
def near_miss_bands(spark, sf_dir):
    j = judged(spark, sf_dir).withColumns({"band": learn.near_miss_band("similarity", "threshold"), "profitable": F.col("move") > 0.3})
    return learn.near_miss_scores(j).select(
        "band",
        "n",
        F.round("profitable_rate", 6).alias("profitable_rate"),
        F.round("gain", 4).alias("gain"),
        F.round("loss", 4).alias("loss"),
    )


@query(
    f"""WITH {_JUDGED} SELECT *, CASE WHEN premature_rate > 0.5 THEN 'loosen' WHEN late_rate > 0.3 THEN 'tighten' ELSE 'keep' END AS suggestion FROM (SELECT reason, count(*) AS n, round(avg((verdict = 'premature')::INT), 6) AS premature_rate,
  round(avg((verdict = 'correct')::INT), 6) AS correct_rate, round(avg((verdict = 'late')::INT), 6) AS late_rate, round(coalesce(sum(favourable) FILTER (WHERE verdict = 'premature'), 0), 4) AS "left", round(coalesce(sum(adverse) FILTER (WHERE verdict = 'late'), 0), 4) AS given_back FROM jd GROUP BY reason)"""
)
def exit_reason_scores(spark, sf_dir):
    s = learn.exit_scores(judged(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("premature_rate", "correct_rate", "late_rate")} | {c: F.round(c, 4) for c in ("left", "given_back")})


@query(
    f"""WITH {_JUDGED} SELECT kind, count(*) AS n, sum((stop_verdict = 'correct')::INT)::BIGINT AS correct, sum((stop_verdict = 'too_tight')::INT)::BIGINT AS too_tight, round(coalesce(-sum(move) FILTER (WHERE stop_verdict = 'correct' AND move < 0), 0), 4) AS saved,
  round(coalesce(sum(abs(move)) FILTER (WHERE stop_verdict = 'too_tight'), 0), 4) AS missed, round(sum((stop_verdict = 'correct')::INT) / nullif(sum((stop_verdict <> 'neutral')::INT), 0), 6) AS accuracy FROM jd GROUP BY kind"""
)
def stop_accuracy(spark, sf_dir):
    s = learn.stop_scores(judged(spark, sf_dir).withColumn("verdict", F.col("stop_verdict")))
    return s.withColumns({"saved": F.round("saved", 4), "missed": F.round("missed", 4), "accuracy": F.round("accuracy", 6)})


_GATES = "gt AS (SELECT s_suppkey AS gate, s_nationkey % 10 / 10 AS rate, -40 + s_suppkey % 7 * 5 AS value, 5 AS step, -40 AS low, -10 AS high FROM supplier)"


@query(
    f"""WITH {_GATES} SELECT gate, suggestion, new_value, new_value <> value AS adjusted FROM (SELECT *, (greatest(low, least(high, value + CASE suggestion WHEN 'loosen' THEN -step WHEN 'tighten' THEN step ELSE 0 END)))::DOUBLE AS new_value FROM
(SELECT *, CASE WHEN rate < 0.4 THEN 'loosen' WHEN rate > 0.8 THEN 'tighten' ELSE 'keep' END AS suggestion FROM gt))"""
)
def threshold_steps(spark, sf_dir):
    return learn.stepped(_gates(spark, sf_dir)).select("gate", "suggestion", "new_value", "adjusted")


def _gates(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    g = s.select(
        F.col("s_suppkey").alias("gate"),
        (F.col("s_nationkey") % 10 / 10).alias("rate"),
        (-40.0 + F.col("s_suppkey") % 7 * 5).alias("value"),
        F.lit(5.0).alias("step"),
        F.lit(-40.0).alias("low"),
        F.lit(-10.0).alias("high"),
    )
    return g.withColumn("suggestion", learn.suggestion("rate"))


@query(f"WITH {_GATES} SELECT gate, CASE WHEN rate < 0.4 THEN 'loosen' ELSE 'tighten' END || printf(' %d %.4f -> %.4f', gate, value::DOUBLE, greatest(-40, least(-10, value + CASE WHEN rate < 0.4 THEN -5 ELSE 5 END))::DOUBLE) AS line FROM gt WHERE (rate < 0.4 AND value > -40) OR (rate > 0.8 AND value < -10)")
def adjustment_log(spark, sf_dir):
    return learn.audit(learn.stepped(_gates(spark, sf_dir)), "now").select("gate", "line")


@query(
    _sql(
        """SELECT key, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha / (alpha + beta), 6) AS mean, round(greatest(0, least(1, 2 * alpha / (alpha + beta) - 1)), 6) AS kelly FROM (
SELECT key, coalesce(n, 0) AS n, greatest(1, coalesce(wins * least(1, 10 / greatest(1, wins + losses)), 0) + coalesce(a, 0)) AS alpha, greatest(1, coalesce(losses * least(1, 10 / greatest(1, wins + losses)), 0) + coalesce(b, 0)) AS beta FROM
(SELECT n_nationkey AS key, n_nationkey AS wins, n_regionkey AS losses FROM nation) p FULL JOIN
(SELECT strategy AS key, count(*) AS n, sum(CASE WHEN pnl > 0 THEN w ELSE 0 END) AS a, sum(CASE WHEN pnl > 0 THEN 0 ELSE w END) AS b FROM (SELECT *, pow(0.95, hold // 24) * CASE WHEN order_id % 11 = 0 THEN CASE WHEN pnl > 0 THEN 2 ELSE 1.5 END ELSE 1 END AS w FROM od) GROUP BY strategy) s USING (key))"""
    )
)
def weighted_posteriors(spark, sf_dir):
    trades = closed(spark, sf_dir).select(
        F.col("strategy").alias("key"),
        (F.col("pnl") > 0).alias("won"),
        (F.col("order_id") % 11 == 0).alias("flipped"),
        F.col("hold").alias("hours"),
    )
    prior = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("key"),
        F.col("n_nationkey").alias("wins"),
        F.col("n_regionkey").alias("losses"),
    )
    return rounded(learn.posteriors(trades, prior), ["key", "n"], ["alpha", "beta", "mean", "kelly"])


@query(
    _sql(
        """SELECT signal, n, round(e, 6) AS estimate, round(CASE WHEN m >= 10 THEN p ELSE 1 END, 6) AS peak, CASE WHEN e >= 0.8 THEN 'EXIT' WHEN e >= 0.6 THEN 'PARTIAL' WHEN e >= 0.4 THEN 'TIGHTEN' ELSE 'IGNORE' END AS response FROM
(SELECT strategy AS signal, count(*) AS n, (sum((pnl > 0)::INT) + 1) / (count(*) + 2) AS e, quantile_cont(peak_pct, 0.75) FILTER (WHERE r <= 100) AS p, count(*) FILTER (WHERE r <= 100) AS m FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY order_id DESC) AS r FROM od) GROUP BY strategy)"""
    )
)
def exit_responses(spark, sf_dir):
    t = closed(spark, sf_dir).select(
        F.col("strategy").alias("signal"),
        F.col("order_id").alias("t"),
        (F.col("pnl") > 0).alias("good"),
        F.col("peak_pct").alias("peak"),
    )
    return learn.exit_learner(t).withColumns({"estimate": F.round("estimate", 6), "peak": F.round("peak", 6)})


@query(
    _sql(
        "SELECT strategy AS key, n >= 20 AND w / n >= 0.8 AS graduated, round(CASE WHEN n >= 20 AND w / n >= 0.8 THEN 0.7 ELSE greatest(0.5, 0.7 * pow(0.95, strategy // 7)) END, 6) AS relaxed FROM (SELECT strategy, count(*) AS n, sum((pnl > 0 OR strategy % 4 = 0)::INT) AS w FROM od GROUP BY strategy)"
    )
)
def cold_starts(spark, sf_dir):
    won = (F.col("pnl") > 0) | (F.col("strategy") % 4 == 0)
    s = closed(spark, sf_dir).groupBy(F.col("strategy").alias("key")).agg(F.count("*").alias("trades"), F.sum(won.cast("long")).alias("wins"))
    s = s.withColumns({"idle_hours": F.col("key") / 7, "threshold": F.lit(0.7), "floor": F.lit(0.5)})
    return learn.cold_start(s).select("key", "graduated", F.round("relaxed", 6).alias("relaxed"))


@query(
    _sql(
        """SELECT key, folds, round(mean_sharpe, 6) + 0.0 AS mean_sharpe, round(std_sharpe, 6) AS std_sharpe, profitable, round(profitable / folds, 6) AS consistency, mean_sharpe >= 0.02 AND folds >= 5 AND profitable / folds >= 0.4 AND std_sharpe <= 0.2 AS passed FROM (
SELECT strategy AS key, count(*) AS folds, avg(s) AS mean_sharpe, stddev_pop(s) AS std_sharpe, sum((p > 0)::INT)::BIGINT AS profitable FROM (SELECT strategy, order_id % 6 AS fold, avg(profit_pct) / stddev_pop(profit_pct) AS s, sum(pnl) AS p FROM od GROUP BY ALL HAVING count(*) > 1) GROUP BY strategy)"""
    )
)
def walk_forward_summaries(spark, sf_dir):
    o = closed(spark, sf_dir).groupBy(F.col("strategy").alias("key"), (F.col("order_id") % 6).alias("fold")).agg(
        F.count("*").alias("n"),
        (F.avg("profit_pct") / F.stddev_pop("profit_pct")).alias("sharpe"),
        F.sum("pnl").alias("profit"),
    )
    s = learn.walk_forward_summary(o.where("n > 1"))
    passed = learn.holdout_passed("mean_sharpe", "folds", "consistency", "std_sharpe", (0.02, 5, 0.4, 0.2))
    return rounded(s.withColumn("passed", passed), ["key", "folds", "profitable", "passed"], ["mean_sharpe", "std_sharpe", "consistency"])


@query("WITH w AS (SELECT s_nationkey AS key, s_suppkey AS grp, s_suppkey % 9 / 4 AS weight FROM supplier) SELECT key, grp, round(CASE WHEN t > 1e-12 THEN abs(weight - 1) / t ELSE 0 END, 6) AS importance FROM (SELECT *, sum(abs(weight - 1)) OVER (PARTITION BY key) AS t FROM w)")
def group_importances(spark, sf_dir):
    w = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("key"),
        F.col("s_suppkey").alias("grp"),
        (F.col("s_suppkey") % 9 / 4).alias("weight"),
    )
    return learn.group_importance(w).select("key", "grp", F.round("importance", 6).alias("importance"))


@query(
    _sql(
        "SELECT n_nationkey::BIGINT AS key, CASE WHEN m IS NULL THEN 'PENDING' WHEN m < 3 THEN 'WATCHED' WHEN r >= 0.6 AND p > 0 THEN 'GOOD' WHEN p > 0 THEN 'QUALIFIED' ELSE 'ELIMINATED' END AS grade FROM nation LEFT JOIN (SELECT strategy, count(*) AS m, avg((pnl > 0)::INT) AS r, avg(pnl) AS p FROM od WHERE strategy < 20 GROUP BY strategy) ON strategy = n_nationkey"
    )
)
def verified_prototypes(spark, sf_dir):
    r = closed(spark, sf_dir).where("strategy < 20").groupBy(F.col("strategy").alias("key")).agg(
        F.count("*").alias("matches"),
        F.avg((F.col("pnl") > 0).cast("int")).alias("win_rate"),
        F.avg("pnl").alias("avg_profit"),
    )
    return learn.verified(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key")), r).select("key", "grade")
