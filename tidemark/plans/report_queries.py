"""Reports over orders, pools and bars, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.operators import learners as learn
from tidemark.operators import orders as od
from tidemark.operators import pools
from tidemark.operators import reports as rep
from tidemark.plans import order_queries as oq
from tidemark.plans import pool_queries as pq
from tidemark.plans.registry import query, rounded, table


def _moved(spark, sf_dir):
    c = oq.closed(spark, sf_dir).withColumn("move", F.round(F.col("profit_pct") * 0.8 - F.col("hold") / 60, 4))
    return c.withColumn("right", rep.regime_right("regime", "side", "profit_pct", "move", "hold"))


_RIGHT = """rt AS MATERIALIZED (SELECT *, CASE WHEN regime LIKE 'RANGE%' THEN abs(move) < 2 OR hold < 60 WHEN regime LIKE '%BULL' THEN CASE side WHEN 'LONG' THEN profit_pct > 0.5 OR move > 0.5 ELSE profit_pct < -0.5 END
  WHEN regime LIKE '%BEAR' THEN CASE side WHEN 'SHORT' THEN profit_pct > 0.5 OR move < -0.5 ELSE profit_pct < -0.5 END END AS correct FROM (SELECT *, round(profit_pct * 0.8 - hold / 60, 4) AS move FROM od))"""


@query(
    oq._sql(
        "SELECT regime, count(*) AS n, sum(correct::INT)::BIGINT AS correct, round(avg(correct::INT), 6) AS accuracy, round(avg(correct::INT) FILTER (WHERE r <= 20), 6) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY closed DESC, order_id DESC) AS r FROM rt WHERE correct IS NOT NULL) GROUP BY regime",
        _RIGHT,
    )
)
def regime_accuracy(spark, sf_dir):
    return rep.regime_accuracy(_moved(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("accuracy", "recent")})


_SAMPLES = "sp AS (SELECT order_id AS key, regime, side AS direction, f AS feature, pnl > 0 AS won, CASE f WHEN 'peak' THEN peak_pct WHEN 'hold' THEN hold ELSE similarity END AS x FROM od, (SELECT unnest(['peak', 'hold', 'similarity']) AS f))"
_RANGES = """lr AS MATERIALIZED (SELECT regime, direction, feature, low, high FROM (SELECT regime, direction, feature, count(*) AS n, count(*) FILTER (WHERE won) AS w, count(*) FILTER (WHERE NOT won) AS l, quantile_cont(x, 0.25) FILTER (WHERE won) AS low,
  quantile_cont(x, 0.75) FILTER (WHERE won) AS high, quantile_cont(x, 0.5) FILTER (WHERE NOT won) AS m FROM sp GROUP BY ALL) WHERE n >= 10 AND w >= 5 AND (l < 5 OR m NOT BETWEEN low AND high))"""


def _samples(spark, sf_dir):
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("x")) for n, c in (("peak", "peak_pct"), ("hold", "hold"), ("similarity", "similarity"))])).alias("e")
    return oq.closed(spark, sf_dir).select(
        F.col("order_id").alias("key"),
        "regime",
        F.col("side").alias("direction"),
        (F.col("pnl") > 0).alias("won"),
        each,
    ).select("key", "regime", "direction", "won", "e.*")


@query(oq._sql("SELECT regime, direction, feature, round(low, 6) AS low, round(high, 6) AS high FROM lr", _SAMPLES, _RANGES))
def learned_ranges(spark, sf_dir):
    return rounded(rep.learned_ranges(_samples(spark, sf_dir)), ["regime", "direction", "feature"], ["low", "high"])


@query(oq._sql("SELECT key, round(coalesce(avg((x BETWEEN low AND high)::INT), 0.5), 6) AS quality FROM sp LEFT JOIN lr USING (regime, direction, feature) GROUP BY key", _SAMPLES, _RANGES))
def snapshot_quality(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return rounded(rep.quality(s, stored(rep.learned_ranges(s))), ["key"], ["quality"])


@query(
    oq._sql(
        """SELECT regime, n, round(compactness, 5) AS compactness, round(separation, 5) AS separation, round(nearness, 5) + 0.0 AS nearness, round(0.3 * compactness + 0.4 * separation + 0.3 * greatest(0, nearness), 5) AS fitness FROM
(SELECT regime, count(*) AS n, -corr(d, pnl) AS nearness FROM pd GROUP BY regime) JOIN (SELECT regime, avg(t) AS compactness FROM (SELECT regime, side, 1 / (avg(d) + 0.01) AS t FROM pd GROUP BY ALL) GROUP BY regime) USING (regime)
JOIN (SELECT l.regime, sqrt((l.a - s.a) ** 2 + (l.b - s.b) ** 2 + (l.c - s.c) ** 2) AS separation FROM ct l JOIN ct s ON s.regime = l.regime AND l.side = 'LONG' AND s.side = 'SHORT') USING (regime)""",
        "ct AS MATERIALIZED (SELECT regime, side, avg(peak_pct) AS a, avg(hold / 10) AS b, avg(similarity * 5) AS c FROM od GROUP BY ALL)",
        "pd AS MATERIALIZED (SELECT o.regime, o.side, o.pnl, sqrt((peak_pct - a) ** 2 + (hold / 10 - b) ** 2 + (similarity * 5 - c) ** 2) AS d FROM od o JOIN ct ON ct.regime = o.regime AND ct.side = o.side)",
    )
)
def weight_fitness(spark, sf_dir):
    p = oq.closed(spark, sf_dir).select(
        "regime",
        "side",
        F.col("peak_pct").alias("a"),
        (F.col("hold") / 10).alias("b"),
        (F.col("similarity") * 5).alias("c"),
        F.col("pnl").alias("profit"),
    )
    return rounded(rep.weight_fitness(p), ["regime", "n"], ["compactness", "separation", "nearness", "fitness"], 5)


@query(oq._sql("SELECT order_id, row_number() OVER (PARTITION BY strategy ORDER BY order_id) % 10 = 0 AS tried FROM od"))
def explored_candidates(spark, sf_dir):
    return rep.explored(oq.closed(spark, sf_dir).select("order_id", F.col("strategy").alias("key"), F.col("order_id").alias("t"))).select("order_id", "tried")


@query(
    oq._sql(
        "SELECT symbol, sum((side = 'LONG')::INT)::BIGINT AS longs, sum((side = 'SHORT')::INT)::BIGINT AS shorts, count(*) AS n, round(sum(pnl), 2) AS total_profit, round(avg(pnl), 4) + 0.0 AS avg_profit, round(avg(profit_pct), 6) + 0.0 AS avg_profit_pct, max(profit_pct) AS max_profit_pct, min(profit_pct) AS min_profit_pct, round(avg(hold), 6) AS avg_hold, max(hold) AS max_hold, min(hold) AS min_hold FROM od GROUP BY symbol"
    )
)
def label_statistics(spark, sf_dir):
    t = oq.closed(spark, sf_dir).withColumn("side", F.lower("side")).withColumn("profit", F.col("pnl"))
    s = rep.label_statistics(t, "symbol")
    return s.withColumns({"total_profit": F.round("total_profit", 2), "avg_profit": F.round("avg_profit", 4) + F.lit(0.0), "avg_profit_pct": F.round("avg_profit_pct", 6) + F.lit(0.0), "avg_hold": F.round("avg_hold", 6)})


@query(
    oq._sql(
        "SELECT symbol, max(fall) >= 20 AS limited FROM (SELECT symbol, (greatest(5000, max(b) OVER (PARTITION BY symbol ORDER BY pos)) - b) / greatest(5000, max(b) OVER (PARTITION BY symbol ORDER BY pos)) * 100 AS fall FROM (SELECT symbol, pos, 5000 + sum(pnl / 1000) OVER (PARTITION BY symbol ORDER BY pos) AS b FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY closed, order_id) AS pos FROM od))) GROUP BY symbol"
    )
)
def risk_limits(spark, sf_dir):
    a = od.accounts(oq.closed(spark, sf_dir).withColumn("pnl", F.col("pnl") / 1000))
    return a.select("symbol", (F.col("drawdown_pct") >= 20).alias("limited"))


@query(
    oq._sql(
        "SELECT key, n, round(mean, 6) AS mean FROM (SELECT strategy AS key, count(*) AS n, greatest(1, sum((pnl > 0)::INT)) / (greatest(1, sum((pnl > 0)::INT)) + greatest(1, sum((pnl <= 0)::INT))) AS mean FROM od GROUP BY strategy) WHERE n >= 3 ORDER BY mean DESC, n DESC, key LIMIT 10"
    )
)
def top_performers(spark, sf_dir):
    trades = oq.closed(spark, sf_dir).select(
        F.col("strategy").alias("key"),
        (F.col("pnl") > 0).alias("won"),
        F.lit(False).alias("flipped"),
        F.lit(0).alias("hours"),
    )
    none = table(spark, sf_dir, "nation").where("false").select(
        F.col("n_nationkey").cast("long").alias("key"),
        F.lit(0).alias("wins"),
        F.lit(0).alias("losses"),
    )
    return learn.top_performers(learn.posteriors(trades, none)).select("key", "n", F.round("mean", 6).alias("mean"))


@query(
    pq._sql(
        "SELECT pool, direction, combo FROM kf ANTI JOIN (SELECT * FROM br WHERE state = 'BEAR' AND direction = 'short' AND triggers >= 5 AND rate < 0.52) USING (pool, direction, combo)",
        "co AS (SELECT pool, direction, combo, list_distinct(list_transform(conditions, lambda c: regexp_replace(c, '_(mod_loose|mod_strict|loose|strict)$', ''))) AS f, row_number() OVER (PARTITION BY pool, direction ORDER BY composite DESC, combo) AS pos FROM cu)",
        """ff AS (SELECT pool, direction, 0::BIGINT AS pos, []::VARCHAR[] AS kept, []::VARCHAR[] AS used FROM co GROUP BY ALL
  UNION ALL SELECT x.pool, x.direction, o.pos, CASE WHEN ok THEN list_append(kept, combo) ELSE kept END, CASE WHEN ok THEN list_concat(used, f) ELSE used END FROM
  (SELECT ff.pool, ff.direction, o.pos, o.combo, o.f, ff.kept, ff.used, len(list_filter(o.f, lambda y: len(list_filter(ff.used, lambda z: z = y)) >= 20)) = 0 AS ok FROM ff JOIN co o ON o.pool = ff.pool AND o.direction = ff.direction AND o.pos = ff.pos + 1) x JOIN co o ON o.pool = x.pool AND o.direction = x.direction AND o.pos = x.pos)""",
        "kf AS (SELECT pool, direction, unnest(k) AS combo FROM (SELECT pool, direction, arg_max(kept, pos) AS k FROM ff GROUP BY ALL))",
        recursive=True,
    ).replace("CASE WHEN ok THEN list_append(kept, combo)", "CASE WHEN ok THEN list_append(kept, x.combo)").replace("list_concat(used, f)", "list_concat(used, x.f)")
)
def capped_families(spark, sf_dir):
    t = pq.triggers(spark, sf_dir)
    return rep.capped_families(stored(pools.cumulative(t)), pools.breakdowns(t))


_GATE = """gg AS (SELECT order_id, side, regime, similarity, hold, way * slope AS s, way * hist AS h, abs(slope) AS a, CASE side WHEN 'LONG' THEN 'BULL' ELSE 'BEAR' END AS own, score FROM
  (SELECT *, CASE side WHEN 'LONG' THEN 1 ELSE -1 END AS way, (hold - 45) / 200 AS slope, profit_pct * 3 AS hist, similarity * 60 AS score FROM od)),
gt AS (SELECT *, CASE WHEN regime = 'STRONG_' || own THEN CASE WHEN h > -20 THEN 'bypass' ELSE 'slope' END WHEN regime = 'WEAK_' || own THEN CASE WHEN h > -10 THEN 'bypass' ELSE 'slope' END WHEN s <= 0.003 THEN 'slope'
  WHEN h >= -greatest(5 * a, 3) THEN 'ok' WHEN regime LIKE 'RANGE%' OR score >= 40 THEN 'rescued' ELSE 'zero_axis' END AS gate FROM gg)"""


def _gated(spark, sf_dir):
    from tidemark.operators import studies

    c = oq.closed(spark, sf_dir).withColumns({"slope": (F.col("hold") - 45) / 200, "hist": F.col("profit_pct") * 3, "score": F.col("similarity") * 60})
    return c.withColumn("gate", studies.trend_gate("slope", "hist", "side", "regime", "score"))


@query(oq._sql("SELECT order_id, gate FROM gt", _GATE))
def trend_gates(spark, sf_dir):
    return _gated(spark, sf_dir).select("order_id", "gate")


@query(oq._sql("SELECT order_id, CASE WHEN regime = 'UNKNOWN' THEN 'REGIME' WHEN similarity < 0.4 THEN 'MATCH' WHEN hold < 3 THEN 'COOL_DOWN' WHEN gate IN ('slope', 'zero_axis') THEN 'MACD' WHEN score < 30 THEN 'SCORE' END AS failed FROM gt", _GATE))
def entry_cascade(spark, sf_dir):
    from tidemark.operators import studies

    gates = {
        "REGIME": F.col("regime") != "UNKNOWN",
        "MATCH": F.col("similarity") >= 0.4,
        "COOL_DOWN": F.col("hold") >= 3,
        "MACD": F.col("gate").isin("ok", "bypass", "rescued"),
        "SCORE": F.col("score") >= 30,
    }
    return _gated(spark, sf_dir).select("order_id", studies.first_failing(gates).alias("failed"))
