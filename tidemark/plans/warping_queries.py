"""Held-out windows against templates by warping, open positions against theirs, pairs by lot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.operators import backtests, warping
from tidemark.operators import indicators as ind
from tidemark.operators import templates as tpl
from tidemark.plans import stream_queries as streams
from tidemark.plans import template_queries as tq
from tidemark.plans.registry import query, rounded, table
from tidemark.sources import bars as src
from tidemark.streaming import holding

WIDTH, EVERY = 4, 5


def held_out(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Windows before every fifth bar of the last fifth of each symbol, and as references the
    trajectories before the entries of trades that ended earlier."""
    v = stored(tq.vectors(spark, sf_dir))
    starts = v.groupBy("symbol").agg(F.expr("(max(bar_idx) + 1) * 4 div 5").alias("start"))
    asked = v.join(starts, "symbol").where(f"bar_idx >= start AND bar_idx >= {tq.PRE} AND bar_idx % {EVERY} = 0")
    spans = asked.select("symbol", (F.col("bar_idx") - tq.PRE).alias("first"), F.col("bar_idx").alias("last"))
    windows = tpl.windows(v, spans).select(F.concat_ws("/", "symbol", "last").alias("query_id"), F.col("matrix").alias("x"))
    known = tq.templates(spark, sf_dir).join(starts, "symbol").where("exit_idx < start")
    confidence = 0.5 + F.col("entry_idx") % 10 / 20
    return stored(windows), stored(known.select(F.concat_ws("/", "symbol", "entry_idx").alias("ref_id"), F.col("pre").alias("y"), "direction", confidence.alias("confidence")))


def scores(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    windows, references = held_out(spark, sf_dir)
    near = warping.nearest(windows, references, WIDTH)
    return warping.fused(near, windows, references, WIDTH), references


_FAR = "1e300::DOUBLE"
_ROW = f"""list_reduce(range(1, {tq.PRE + 1}), lambda a, j: list_append(a, CASE WHEN abs(i - j) <= 10 THEN list_distance(x[i], y[j]) + least(r[j], r[j + 1], a[j]) ELSE {_FAR} END), [{_FAR}])"""


@query(
    tq._sql(
        """SELECT query_id, ref_id, rank, round(d, 6) + 0.0 AS distance, round(confidence * (0.3 * greatest(0, list_cosine_similarity(mx, my)) + 0.4 * (1 - least(1, list_distance(mx, my) / 200))
  + 0.3 * (1 - least(1, d / (20 * 4)))), 6) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id)::INT AS rank FROM dt) JOIN qs USING (query_id) JOIN rf USING (ref_id) WHERE rank <= 3""",
        "ho AS (SELECT symbol, (max(bar_idx) + 1) * 4 // 5 AS start FROM bars GROUP BY symbol)",
        f"""rf AS MATERIALIZED (SELECT symbol || '/' || entry_idx AS ref_id, 0.5 + (entry_idx % 10) / 20 AS confidence, list(v ORDER BY bar_idx) AS y, [avg(v[1]), avg(v[2]), avg(v[3]), avg(v[4])] AS my
  FROM tl JOIN ho USING (symbol) WHERE pre AND exit_idx < start GROUP BY symbol, entry_idx)""",
        f"""qs AS MATERIALIZED (SELECT b.symbol || '/' || b.bar_idx AS query_id, list(v.v ORDER BY v.bar_idx) AS x, [avg(v.v[1]), avg(v.v[2]), avg(v.v[3]), avg(v.v[4])] AS mx FROM vec b JOIN ho USING (symbol)
  JOIN vec v ON v.symbol = b.symbol AND v.bar_idx BETWEEN b.bar_idx - {tq.PRE} AND b.bar_idx - 1 WHERE b.bar_idx >= start AND b.bar_idx >= {tq.PRE} AND b.bar_idx % {EVERY} = 0 GROUP BY b.symbol, b.bar_idx)""",
        f"""dt AS MATERIALIZED (SELECT query_id, ref_id, list_reduce(range(1, {tq.PRE + 1}), lambda r, i: {_ROW}, list_concat([0.0::DOUBLE], list_transform(range(0, {tq.PRE}), lambda z: {_FAR})))[{tq.PRE + 1}] AS d FROM qs, rf)""",
    )
)
def holdout_matches(spark, sf_dir):
    """The three references nearest to each held-out window by warping, and their fused scores."""
    return rounded(scores(spark, sf_dir)[0], ["query_id", "ref_id", "rank"], ["apart", "score"]).withColumnRenamed("apart", "distance")


@query()
def holdout_trades(spark, sf_dir):
    """Trades on the best scores of the held-out windows."""
    best = warping.best_scores(*scores(spark, sf_dir))
    at = best.select(F.split_part("query_id", F.lit("/"), F.lit(1)).alias("symbol"), F.split_part("query_id", F.lit("/"), F.lit(2)).cast("long").alias("bar_idx"), "direction", "score")
    bars = ind.window_indicators(src.bars_from_ticks(spark, sf_dir)).select("symbol", "bar_idx", "high", "low", "close", "atr")
    return rounded(backtests.scored_matrix(bars, at, 0.5), ["symbol", "entry_idx", "exit_idx", "side"], ["profit_pct"])


_CELL = f"CASE WHEN k - 6 + o BETWEEN 1 AND m THEN list_distance(x[k], y[k - 6 + o]) + least(r[o], r[o + 1], a[o]) ELSE {_FAR} END"


@query(
    tq._sql(
        """SELECT symbol, id, entry_idx + t - 1 AS bar_idx, round(d, 6) + 0.0 AS divergence, d > 0.7 AS leaves
FROM (SELECT p.symbol, p.id, p.entry_idx, t, least(1, r[6] / (k * 4)) AS d FROM (SELECT *, unnest(range(1, n + 1)) AS t FROM ps) p JOIN dv ON dv.symbol = p.symbol AND dv.id = p.id AND dv.k = least(p.t, p.m))""",
        "he AS MATERIALIZED (SELECT symbol, entry_idx, direction, list(v ORDER BY bar_idx) AS x FROM tl WHERE NOT pre GROUP BY ALL)",
        """ps AS MATERIALIZED (SELECT *, len(x) AS n, len(y) AS m FROM (SELECT symbol, entry_idx, direction || '/' || entry_idx AS id, x, lag(x) OVER (PARTITION BY symbol, direction ORDER BY entry_idx) AS y FROM he) WHERE y IS NOT NULL)""",
        f"""dv AS (SELECT symbol, id, 0::BIGINT AS k, list_transform(range(1, 13), lambda o: CASE WHEN o = 6 THEN 0.0::DOUBLE ELSE {_FAR} END) AS r FROM ps
  UNION ALL SELECT symbol, id, k, list_append(list_reduce(range(1, 12), lambda a, o: list_append(a, {_CELL}), [{_FAR}])[2:12], {_FAR})
  FROM (SELECT dv.symbol, dv.id, dv.k + 1 AS k, dv.r, x, y, m FROM dv JOIN ps ON ps.symbol = dv.symbol AND ps.id = dv.id AND dv.k < least(n, m)))""",
        recursive=True,
    )
)
def streamed_divergences(spark, sf_dir):
    """Every trade that gained enough, while held, against the one before it on its side."""
    bars = streams.bars(spark, sf_dir)
    times = bars.select("symbol", "bar_idx", "ts")
    t = stored(tq.templates(spark, sf_dir).select("symbol", "entry_idx", "exit_idx", "direction", "held"))
    order = "lag(entry_idx) OVER (PARTITION BY symbol, direction ORDER BY entry_idx) AS before"
    before = t.select("symbol", "direction", F.col("entry_idx").alias("before"), F.col("held").alias("template"))
    p = t.drop("held").selectExpr("*", "concat_ws('/', direction, entry_idx) AS id", order).join(before, ["symbol", "direction", "before"])
    opened = p.withColumn("bar_idx", F.col("entry_idx")).join(times, ["symbol", "bar_idx"]).select("symbol", "ts", "bar_idx", "id", "template")
    closed = p.withColumn("bar_idx", F.col("exit_idx")).join(times, ["symbol", "bar_idx"]).select("symbol", "ts", "bar_idx", "id")
    each = tq.vectors(spark, sf_dir).join(times, ["symbol", "bar_idx"]).select("symbol", "ts", "bar_idx", "v")
    found = holding.divergences(*streams.replayed(*[stored(x) for x in (each, opened, closed)]), shards=2)
    return rounded(streams.finished(found), ["symbol", "id", "bar_idx", "leaves"], ["divergence"])


_LOT = "('0x' || substr(md5('42:' || vec_id::VARCHAR), 1, 15))::BIGINT"


@query(
    f"""WITH l AS (SELECT vec_id, embedding::DOUBLE[] AS e, {_LOT} AS lot FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b, (x.lot + y.lot) % 1152921504606846976 AS draw, x.e AS ea, y.e AS eb FROM l x JOIN l y ON x.vec_id < y.vec_id ORDER BY draw, a, b LIMIT 400)
SELECT a, b, draw, round(list_cosine_similarity(ea, eb), 6) + 0.0 AS cosine FROM p"""
)
def sampled_similarities(spark, sf_dir):
    """Cosines of 400 pairs of vectors drawn by lot."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = warping.sampled_pairs(e, 400, 42)
    both = pairs.join(e.select(F.col("vec_id").alias("a"), F.col("e").alias("ea")), "a").join(e.select(F.col("vec_id").alias("b"), F.col("e").alias("eb")), "b")
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0e0, (s, z) -> s + z)"
    return rounded(both.withColumn("cosine", F.expr(f"{dot('ea', 'eb')} / sqrt({dot('ea', 'ea')} * {dot('eb', 'eb')})")), ["a", "b", "draw"], ["cosine"])
