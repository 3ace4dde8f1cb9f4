"""Exits in hindsight, exact quantiles and histograms, scores under weights with dates, paths ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.functions.windows import only_own, with_halo
from tidemark.operators import distributions, hindsight, outlook, weights
from tidemark.operators import features as feat
from tidemark.operators import indicators as ind
from tidemark.operators import swings as swing
from tidemark.plans import sql
from tidemark.plans.registry import query, rounded, table
from tidemark.plans.template_queries import _POINTS
from tidemark.sources import bars as src

HORIZONS = (10, 45, 160)
SHARES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.999)

_TRADES = f"""{_POINTS},
tr AS MATERIALIZED (SELECT symbol, bar_idx AS entry_idx, lead(bar_idx) OVER w AS exit_idx, CASE WHEN h THEN 'short' ELSE 'long' END AS side, price AS entry_price, lead(price) OVER w AS exit_price
  FROM sz WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx) QUALIFY exit_idx IS NOT NULL),
tt AS MATERIALIZED (SELECT *, CASE side WHEN 'long' THEN 1 ELSE -1 END AS way, CASE side WHEN 'long' THEN 1 ELSE -1 END * (exit_price - entry_price) / entry_price * 100 AS profit_pct FROM tr)"""


def trades_and_bars(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    bars = stored(src.bars_from_ticks(spark, sf_dir))
    return swing.label_trades(swing.alternating(swing.swing_points(bars))), bars


_GAINS = ["best", "worst", "held", "mean_after"]


@query(
    f"""WITH {sql.TICK_BARS}, {_TRADES},
sp AS (SELECT t.symbol, t.entry_idx, t.exit_idx, t.side, t.way, t.entry_price, t.exit_price, t.profit_pct, h.horizon, max(b.high) AS top, min(b.low) AS bottom,
  CASE WHEN count(b.close) = max(h.horizon) THEN arg_max(b.close, b.bar_idx) END AS last, CASE WHEN count(b.close) = max(h.horizon) THEN avg(b.close) END AS mean_after
  FROM tt t JOIN (SELECT unnest({list(HORIZONS)})::BIGINT AS horizon) h ON true LEFT JOIN bars b ON b.symbol = t.symbol AND b.bar_idx BETWEEN t.exit_idx + 1 AND t.exit_idx + h.horizon GROUP BY ALL)
SELECT symbol, entry_idx, exit_idx, side, horizon, round(way * (CASE way WHEN 1 THEN top ELSE bottom END - entry_price) / entry_price * 100, 6) + 0.0 AS best,
  round(way * (CASE way WHEN 1 THEN bottom ELSE top END - entry_price) / entry_price * 100, 6) + 0.0 AS worst, round(way * (last - entry_price) / entry_price * 100, 6) + 0.0 AS held, round(mean_after, 6) + 0.0 AS mean_after,
  coalesce(way * (CASE way WHEN 1 THEN top ELSE bottom END - entry_price) / entry_price * 100 > profit_pct + 1, false) AS premature,
  coalesce(profit_pct <= 0 AND way * (mean_after - exit_price) > exit_price * 0.01, false) AS too_tight FROM sp"""
)
def other_exits(spark, sf_dir):
    trades, bars = trades_and_bars(spark, sf_dir)
    return rounded(hindsight.other_exits(trades, bars, HORIZONS), ["symbol", "entry_idx", "exit_idx", "side", "horizon", "premature", "too_tight"], _GAINS)


_CUT = "least(19, floor((x - lo) / (hi - lo) * 20))::INT"


@query(
    f"""WITH {sql.TICK_BARS}, {_TRADES},
lf AS (SELECT side, unnest(['hold', 'profit_pct']) AS measure, unnest([(exit_idx - entry_idx)::DOUBLE, profit_pct]) AS x FROM tt),
lo AS (SELECT side, measure, min(x) AS lo, max(x) AS hi FROM lf GROUP BY ALL),
nb AS (SELECT side, measure, {_CUT} AS bin, count(*) AS n FROM lf JOIN lo USING (side, measure) GROUP BY ALL)
SELECT l.side, l.measure, e.bin, round(lo + (hi - lo) * e.bin / 20, 6) + 0.0 AS low, round(lo + (hi - lo) * (e.bin + 1) / 20, 6) + 0.0 AS high, coalesce(nb.n, 0)::BIGINT AS n
FROM lo l JOIN (SELECT unnest(range(0, 20))::INT AS bin) e ON true LEFT JOIN nb ON nb.side = l.side AND nb.measure = l.measure AND nb.bin = e.bin"""
)
def trade_histograms(spark, sf_dir):
    trades, _ = trades_and_bars(spark, sf_dir)
    measures = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in ("hold", "profit_pct")])
    found = distributions.histograms(trades.select("side", F.explode(measures).alias("m")).select("side", "m.*"), ["side", "measure"], "x")
    return rounded(found, ["side", "measure", "bin", "n"], ["low", "high"])


@query(
    "SELECT l_returnflag, l_linestatus, s.share::DOUBLE AS share, round(q[s.place], 4) + 0.0 AS value FROM (SELECT l_returnflag, l_linestatus, "
    f"quantile_cont(l_extendedprice, {list(SHARES)}) AS q FROM lineitem GROUP BY ALL), (SELECT unnest({list(SHARES)}) AS share, unnest(range(1, {len(SHARES) + 1})) AS place) s"
)
def fill_quantiles(spark, sf_dir):
    """Prices of fills by flag and status, with intervals narrowed down to 1,024 rows before a sort."""
    by = ["l_returnflag", "l_linestatus"]
    found = distributions.quantiles(table(spark, sf_dir, "lineitem"), by, "l_extendedprice", list(SHARES), bins=64, sorted_rows=1024)
    return rounded(found, [*by, "share"], ["value"], 4)


# --- scores under weights that hold from a date on: each direction gets new ones in every week of bars

_HOURS = "timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"
_ORDERED = list(weights.GROUPS)
_MEMBERS = [_ORDERED.index(g) + 1 for g in weights.group_of_feature()]


def dated_bars(spark, sf_dir) -> DataFrame:
    return stored(src.bars_from_ticks(spark, sf_dir)).withColumn("at", F.expr(_HOURS))


def versions(bars: DataFrame) -> DataFrame:
    """From the second week on, and for shorts two days later; the last group states none."""
    weeks = bars.select(F.expr("at div 168").alias("week")).distinct().where(F.col("week") > bars.agg(F.min(F.expr("at div 168"))).first()[0])
    sides = weeks.select("week", F.posexplode(F.array(F.lit("long"), F.lit("short"))).alias("s", "direction"))
    each = sides.select("*", F.posexplode(F.array(*[F.lit(g) for g in _ORDERED[:-1]])).alias("g", "group"))
    return each.select("direction", F.expr("week * 168 + s * 48").alias("valid_from"), "group", F.expr("0.1 + (week + 7 * g + 3 * s) % 19 / 10D").alias("weight"))


_STEPS = f"""hb AS MATERIALIZED (SELECT *, epoch(ts)::BIGINT // 3600 AS hour_no FROM bars),
wk AS (SELECT DISTINCT hour_no // 168 AS week FROM hb WHERE hour_no // 168 > (SELECT min(hour_no // 168) FROM hb)),
gw AS (SELECT direction, s, week * 168 + s * 48 AS valid_from, list_transform(range(0, 8), lambda g: CASE WHEN g < 7 THEN 0.1 + (week + 7 * g + 3 * s) % 19 / 10.0 ELSE 1.2 END) AS w8
  FROM wk, (VALUES ('long', 0), ('short', 1)) d(direction, s)
  UNION ALL SELECT direction, s, NULL, [1.5, 1.5, 1.3, 1.5, 1.2, 1.3, 1.0, 1.2] FROM (VALUES ('long', 0), ('short', 1)) d(direction, s)),
ex AS MATERIALIZED (SELECT direction, valid_from, lead(valid_from, 1, 9223372036854775807) OVER (PARTITION BY direction ORDER BY valid_from NULLS FIRST) AS valid_to,
  list_transform(w32, lambda x: x / list_avg(w32)) AS w FROM (SELECT *, list_transform({_MEMBERS}, lambda i: greatest(w8[i], 0.01)::DOUBLE) AS w32 FROM gw))"""


@query(
    f"""WITH {sql.TICK_BARS}, {_STEPS}
SELECT hour_no, direction, valid_from, count(*) AS n, round(list_sum(any_value(list_transform(w, lambda x, i: x * i))), 6) + 0.0 AS weighted, round(any_value(w[14]), 6) + 0.0 AS adx_weight
FROM hb JOIN ex ON hour_no >= coalesce(valid_from, 0) AND hour_no < valid_to GROUP BY hour_no, direction, valid_from"""
)
def valid_weights(spark, sf_dir):
    """The weights of each hour: their sum times their places, and one of them."""
    bars = dated_bars(spark, sf_dir)
    v = versions(bars)
    valid = weights.valid_versions(bars, v).join(weights.expanded(v), ["direction", "valid_from"], "left").withColumn("weights", F.coalesce("weights", weights.default_weights()))
    placed = F.aggregate(F.transform("weights", lambda w, i: w * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    found = bars.groupBy("at").agg(F.count("*").alias("n")).join(valid, "at")
    return rounded(found.select(F.col("at").alias("hour_no"), "direction", "valid_from", "n", placed.alias("weighted"), F.col("weights")[13].alias("adx_weight")), ["hour_no", "direction", "valid_from", "n"], ["weighted", "adx_weight"])


@query(
    sql.with_indicators(
        """SELECT direction, valid_from, count(*) AS n, round(avg(score), 2) + 0.0 AS score FROM (SELECT ex.direction, ex.valid_from, list_dot_product(lv.v, ex.w) / 32 AS score
FROM lv JOIN hb USING (symbol, bar_idx) JOIN ex ON hour_no >= coalesce(ex.valid_from, 0) AND hour_no < ex.valid_to) GROUP BY ALL""",
        _STEPS,
        "lv AS MATERIALIZED (SELECT symbol, bar_idx, [" + ", ".join(f"({x})::DOUBLE" for x in feat.layer_columns("round_even").values()) + "] AS v FROM i)",
    )
)
def dated_scores(spark, sf_dir):
    bars = dated_bars(spark, sf_dir)
    layered = feat.layers(ind.indicators(bars.drop("at")))
    vectors = layered.select("symbol", "bar_idx", F.array(*[F.col(c).cast("double") for c in feat.layer_columns()]).alias("v"))
    found = weights.scores(vectors.join(bars.select("symbol", "bar_idx", "at"), ["symbol", "bar_idx"]), versions(bars))
    return rounded(found.groupBy("direction", "valid_from").agg(F.count("*").alias("n"), F.avg("score").alias("score")), ["direction", "valid_from", "n"], ["score"], 2)


# --- paths ahead

# Places in the range of twenty bars and distances from its ends, not rounded.
_RANGE = {
    "c0": "(close - low20) / (high20 - low20 + 1e-9)",
    "c1": "(high20 - close) / (CASE WHEN atr > 0 THEN atr ELSE 1 END)",
    "c2": "(close - low20) / (CASE WHEN atr > 0 THEN atr ELSE 1 END)",
    "c4": "1 - (high20 - close) / (high20 - low20 + 1e-9)",
    "c5": "1 - (close - low20) / (high20 - low20 + 1e-9)",
}


@query(
    f"""WITH RECURSIVE {sql.TICK_BARS}, {{atr}},
rg AS MATERIALIZED (SELECT b.*, a.atr, max(high) OVER w AS high20, min(low) OVER w AS low20 FROM bars b JOIN av a USING (symbol, bar_idx) WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fe AS MATERIALIZED (SELECT symbol, bar_idx, {", ".join(f"coalesce({x}, 0) AS {c}" for c, x in _RANGE.items())} FROM rg),
hs AS (SELECT symbol, bar_idx, close, list(high) OVER w AS highs, list(low) OVER w AS lows, median(atr) OVER w AS m FROM rg WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
st AS (SELECT *, CASE WHEN m > 0 THEN m ELSE greatest((list_max(highs) - list_min(lows)) / len(highs), close * 0.001) END AS atr FROM hs),
fp AS (
  SELECT symbol, bar_idx, 0 AS step, close AS price, highs, lows, atr FROM st
  UNION ALL
  SELECT symbol, bar_idx, step + 1, p, list_append(CASE WHEN len(highs) < 20 THEN highs ELSE highs[2:] END, p), list_append(CASE WHEN len(lows) < 20 THEN lows ELSE lows[2:] END, p), atr FROM (
    SELECT *, price + 0.65 * greatest(-most, least(most, target - price)) AS p FROM (
      SELECT z.*, greatest(price * 0.01, 2.5 * atr) AS most, 0.42 * (lo + least(1, greatest(0, c0)) * width) + 0.22 * (hi - greatest(0, c1) * atr) + 0.22 * (lo + greatest(0, c2) * atr)
        + 0.07 * (hi - (1 - least(1, greatest(0, c4))) * width) + 0.07 * (lo + (1 - least(1, greatest(0, c5))) * width) AS target
      FROM (SELECT *, greatest(hi - lo, price * 0.0005, 1e-6) AS width FROM (SELECT *, list_max(highs) AS hi, list_min(lows) AS lo FROM fp)) z JOIN fe ON fe.symbol = z.symbol AND fe.bar_idx = z.bar_idx + step + 1 WHERE step < 5)))
SELECT symbol, bar_idx, step, round(price, 6) + 0.0 AS price FROM fp WHERE step > 0""".replace(
        "{atr}",
        "tq AS (SELECT symbol, bar_idx, greatest(high - low, coalesce(abs(high - lag(close) OVER o), 0), coalesce(abs(low - lag(close) OVER o), 0)) AS t FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx)), "
        "av AS MATERIALIZED (SELECT symbol, bar_idx, CASE WHEN bar_idx >= 13 THEN avg(t) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr FROM tq)",
    )
)
def future_prices(spark, sf_dir):
    table_ = ind.window_indicators(src.bars_from_ticks(spark, sf_dir)).selectExpr("symbol", "bar_idx", "high", "low", "close", "atr")
    window = "OVER (PARTITION BY symbol, chunk ORDER BY bar_idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    ranged = only_own(with_halo(table_, 19).selectExpr("*", f"max(high) {window} AS high20", f"min(low) {window} AS low20"))
    featured = ranged.selectExpr("symbol", "bar_idx", "high", "low", "close", "atr", *[f"coalesce({x}, 0) AS {c}" for c, x in _RANGE.items()])
    return rounded(outlook.future_prices(featured), ["symbol", "bar_idx", "step"], ["price"])


_DRAW = "('0x' || substr(md5('7:' || key || ':' || (member * 3 + {})::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0"


@query(
    f"""WITH {sql.TICK_BARS}, {_TRADES},
pt AS (SELECT symbol || '/' || side AS key, count(*) AS member_count, avg((profit_pct > 0)::INT) AS win_rate, avg(profit_pct) AS avg_profit_pct, avg(exit_idx - entry_idx) AS avg_hold FROM tt GROUP BY ALL),
dr AS (SELECT *, {_DRAW.format(0)} AS t, {_DRAW.format(1)} AS u, {_DRAW.format(2)} AS v FROM (SELECT *, unnest(range(0, least(30, greatest(5, member_count))))::INT AS member FROM pt WHERE member_count >= 3))
SELECT key, member, t < win_rate AS won, round(CASE WHEN t < win_rate THEN avg_profit_pct * (0.5 + u) ELSE -abs(avg_profit_pct) * (0.2 + u * 0.5) END, 6) + 0.0 AS profit_pct,
  greatest(2, floor(avg_hold * (0.4 + v * 1.2))::BIGINT) AS hold FROM dr"""
)
def synthesised_members(spark, sf_dir):
    trades, _ = trades_and_bars(spark, sf_dir)
    means = trades.groupBy(F.concat_ws("/", "symbol", "side").alias("key")).agg(
        F.count("*").alias("member_count"),
        F.avg((F.col("profit_pct") > 0).cast("int")).alias("win_rate"),
        F.avg("profit_pct").alias("avg_profit_pct"),
        F.avg("hold").alias("avg_hold"),
    )
    return rounded(outlook.synthesised_members(means, 7), ["key", "member", "won", "hold"], ["profit_pct"])
