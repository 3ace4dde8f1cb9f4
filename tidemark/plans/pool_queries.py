"""Pools of combinations over a trigger log, and SQL for them that shares no expression with the
operators.

The log is made from `lineitem`, a row for each line: its conditions are two to four of fifteen
names, by its keys and line number, its hit follows from the quantity and the names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch, stored
from tidemark.operators import pools
from tidemark.plans.registry import query, rounded, table

_NAMES = (
    "rsi_loose", "rsi_strict", "k_loose", "k_strict", "j_loose", "boll_pos_loose",
    "vol_ratio_loose", "vol_ratio_strict", "macd_hist_turn_loose", "macd_hist_turn_strict", "ma5_slope_dir_loose",
    "obv_trend_loose", "atr_ratio_loose", "atr_ratio_strict", "close_vs_ma5_loose",
)
_LIST = ", ".join(f"'{n}'" for n in _NAMES)


def triggers(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    at = lambda i: F.element_at(F.array(*map(F.lit, _NAMES)), (i + 1).cast("int"))
    a, b, n = F.col("l_partkey") % 6, 6 + F.col("l_suppkey") % 5, F.col("l_linenumber")
    names = F.array_compact(F.array(at(a), at(b), F.when(n % 3 == 0, at(11 + n % 4)), F.when(n == 5, F.lit("rsi_loose"))))
    return lines.select(
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("direction"),
        F.when(F.col("l_suppkey") % 2 == 0, "pool1").otherwise("pool2").alias("pool"),
        F.array_sort(F.array_distinct(names)).alias("conditions"),
        (F.col("l_orderkey") % 8).alias("round"),
        F.when(F.col("l_returnflag") == "A", "BULL").when(F.col("l_returnflag") == "N", "BEAR").otherwise("RANGE").alias("state"),
        (F.col("l_quantity") <= 26 + a * 2 + (b - 6)).alias("hit"),
        F.when(F.col("l_quantity") == 50, -1).otherwise(F.round(F.col("l_discount") * 100 + F.col("l_tax") * 100)).cast("long").alias("hold"),
    )


_BASE = f"""
n AS (SELECT [{_LIST}] AS names),
tr AS MATERIALIZED (SELECT CASE l_linestatus WHEN 'O' THEN 'long' ELSE 'short' END AS direction, CASE WHEN l_suppkey % 2 = 0 THEN 'pool1' ELSE 'pool2' END AS pool,
  list_sort(list_distinct(list_filter([names[1 + l_partkey % 6], names[7 + l_suppkey % 5], CASE WHEN l_linenumber % 3 = 0 THEN names[12 + l_linenumber % 4] END, CASE WHEN l_linenumber = 5 THEN 'rsi_loose' END],
    lambda x: x IS NOT NULL))) AS conditions,
  l_orderkey % 8 AS round, CASE l_returnflag WHEN 'A' THEN 'BULL' WHEN 'N' THEN 'BEAR' ELSE 'RANGE' END AS state,
  l_quantity <= 26 + (l_partkey % 6) * 2 + l_suppkey % 5 AS hit, CASE WHEN l_quantity = 50 THEN -1 ELSE round(l_discount * 100 + l_tax * 100)::BIGINT END AS hold
  FROM lineitem, n),
ck AS MATERIALIZED (SELECT *, array_to_string(conditions, '+') AS combo FROM tr),
rr AS (SELECT pool, direction, combo, round, count(*) AS triggers, sum(hit::INT)::BIGINT AS hits, sum(hit::INT) / count(*) AS hit_rate, median(hold) FILTER (WHERE hold >= 0) AS median_hold FROM ck GROUP BY ALL),
bl AS (SELECT pool, direction, round, avg(hit::INT) AS baseline FROM ck WHERE hold >= 0 GROUP BY ALL),
hd AS (SELECT pool, direction, combo, median(hold) AS m, count(*) AS hold_samples FROM ck WHERE hold >= 0 GROUP BY ALL),
br AS MATERIALIZED (SELECT k.pool, k.direction, k.combo, k.state, count(c.hit) AS triggers, coalesce(sum(c.hit::INT), 0)::BIGINT AS hits, coalesce(round(sum(c.hit::INT) / count(c.hit), 6), 0.0) AS rate
  FROM (SELECT DISTINCT pool, direction, combo, s AS state FROM ck, (VALUES ('BULL'), ('BEAR'), ('RANGE')) v(s)) k LEFT JOIN ck c USING (pool, direction, combo, state) GROUP BY ALL),
cu0 AS (SELECT rr.pool, rr.direction, rr.combo, count(*) AS rounds, avg(hit_rate) AS avg_rate, sqrt(avg(hit_rate * hit_rate) - avg(hit_rate) * avg(hit_rate)) AS loose_std, stddev_pop(hit_rate) AS rate_std,
  sum(triggers)::BIGINT AS triggers, sum(hits)::BIGINT AS hits, coalesce(avg(baseline) FILTER (WHERE baseline > 0), 0) AS avg_baseline, len(string_split(rr.combo, '+')) AS n_conditions
  FROM rr LEFT JOIN bl USING (pool, direction, round) GROUP BY ALL),
cu1 AS (SELECT *, hits / triggers AS r, CASE WHEN pool = 'pool2' THEN 0.0094 WHEN direction = 'long' THEN 0.0054 ELSE 0.0074 END AS gain,
  CASE WHEN pool = 'pool2' OR direction = 'long' THEN 0.0086 ELSE 0.0066 END AS loss, CASE direction WHEN 'long' THEN (avg_rate - 0.61) / 0.14 ELSE (avg_rate - 0.47) / 0.18 END * 100 AS rs,
  (1 - rate_std / 0.08) * 100 AS ss, ln(rounds + 1) / ln(21) * 100 AS ns FROM cu0),
cu2 AS (SELECT cu1.*, coalesce(round_even(m, 0), 0)::BIGINT AS avg_hold, coalesce(hold_samples, 0) AS hold_samples, r * gain - (1 - r) * loss AS v,
  round(greatest(0, 0.3 * least(100, greatest(0, rs)) + 0.4 * least(100, greatest(0, ss)) * CASE WHEN rounds < 5 THEN rounds / 5 ELSE 1 END + 0.3 * least(100, ns) - CASE WHEN n_conditions > 3 THEN 3 * (n_conditions - 3) ELSE 0 END), 2) AS composite
  FROM cu1 LEFT JOIN hd USING (pool, direction, combo)),
cu AS MATERIALIZED (SELECT pool, direction, combo, string_split(combo, '+') AS conditions, rounds, avg_rate, rate_std, triggers, hits, avg_baseline, avg_hold, hold_samples, n_conditions, r AS overall_rate,
  avg_rate * (1 - rate_std) * ln(rounds + 1) AS stability, composite, v * 100 AS ev_percent, v * triggers * 100 AS pnl_percent, v / greatest(avg_hold, 1) AS ev_per_bar,
  CASE WHEN pool = 'pool1' AND direction = 'long' THEN CASE WHEN r >= 0.71 THEN 'PREMIUM' WHEN r >= 0.67 THEN 'QUALITY' WHEN r >= 0.64 THEN 'CANDIDATE' ELSE 'NONE' END
       WHEN r >= 0.59 THEN 'PREMIUM' WHEN r >= 0.55 THEN 'QUALITY' WHEN r >= 0.52 THEN 'CANDIDATE' ELSE 'NONE' END AS tier FROM cu2),
kp AS MATERIALIZED (SELECT * FROM cu WHERE ev_percent > 0 AND (tier IN ('PREMIUM', 'QUALITY') OR (tier = 'CANDIDATE' AND rate_std <= 0.05 AND rounds >= 5))),
si AS MATERIALIZED (SELECT * EXCLUDE (rk, combo, conditions, n_conditions, new), new AS combo, string_split(new, '+') AS conditions, len(string_split(new, '+')) AS n_conditions FROM
  (SELECT *, row_number() OVER (PARTITION BY pool, direction, new ORDER BY triggers DESC, combo DESC) AS rk FROM
    (SELECT *, array_to_string(list_filter(conditions, lambda c: NOT (c LIKE '%\\_loose' ESCAPE '\\' AND list_contains(conditions, replace(c, '_loose', '_strict')))), '+') AS new FROM kp)) WHERE rk = 1),
cv AS MATERIALIZED (SELECT a.pool, a.direction, a.combo AS wide, b.combo AS narrow FROM si a JOIN si b ON a.pool = b.pool AND a.direction = b.direction AND a.combo <> b.combo AND a.n_conditions <= b.n_conditions
  AND len(list_filter(a.conditions, lambda c: NOT (list_contains(b.conditions, c) OR (c LIKE '%\\_loose' ESCAPE '\\' AND list_contains(b.conditions, replace(c, '_loose', '_strict')))))) = 0)"""
_BASE = _BASE.replace("\\\\", "\\")


def _sql(select: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join([_BASE, *more])}\n{select}"


KEYS = ["pool", "direction", "combo"]
_RATES = ["avg_rate", "rate_std", "avg_baseline", "overall_rate", "stability", "composite", "ev_percent", "pnl_percent", "ev_per_bar"]
_DIGITS = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _RATES)


def cumulated(spark, sf_dir) -> DataFrame:
    return pools.cumulative(triggers(spark, sf_dir))


@query(_sql("SELECT pool, direction, combo, round, triggers, hits, median_hold, round(hit_rate, 6) AS hit_rate FROM rr"))
def trigger_rounds(spark, sf_dir):
    return pools.round_results(triggers(spark, sf_dir)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(_sql("SELECT * FROM br"))
def merged_breakdowns(spark, sf_dir):
    return pools.breakdowns(triggers(spark, sf_dir))


@query(_sql(f"SELECT pool, direction, combo, rounds, triggers, hits, avg_hold, hold_samples, n_conditions, tier, {_DIGITS} FROM cu"))
def pool_metrics(spark, sf_dir):
    c = cumulated(spark, sf_dir).withColumn("n_conditions", F.col("n_conditions").cast("long"))
    return rounded(c, [*KEYS, "rounds", "triggers", "hits", "avg_hold", "hold_samples", "n_conditions", "tier"], _RATES)


@query(_sql("SELECT pool, count(*) AS combos, sum((rounds >= 5 AND avg_rate >= 0.62 AND rate_std <= 0.05)::INT)::BIGINT AS stable, max(rounds) AS rounds FROM cu GROUP BY pool"))
def store_summary(spark, sf_dir):
    return pools.summary(cumulated(spark, sf_dir))


@query(
    _sql(
        "SELECT pool, direction, combo, round(avg_rate, 6) AS avg_rate, live_rate, round(avg_rate - live_rate, 6) AS decay FROM cu JOIN lv USING (pool, direction, combo) WHERE total >= 10 AND live_rate < avg_rate - 0.10",
        "lv AS (SELECT pool, direction, combo, triggers AS total, round(hits / triggers, 6) AS live_rate FROM rr WHERE round = 7)",
    )
)
def live_alerts(spark, sf_dir):
    t = triggers(spark, sf_dir)
    live = pools.round_results(t.where("round = 7")).select(*KEYS, F.col("triggers").alias("total"), "hits")
    found = pools.live_alerts(pools.cumulative(t), live)
    return found.withColumns({"avg_rate": F.round("avg_rate", 6), "decay": F.round("decay", 6)})


@query(_sql("SELECT pool, direction, combo, tier FROM kp"))
def kept_combos(spark, sf_dir):
    return pools.kept(cumulated(spark, sf_dir)).select(*KEYS, "tier")


@query(_sql("SELECT pool, direction, combo, triggers FROM si"))
def simplified_combos(spark, sf_dir):
    return pools.simplified(pools.kept(cumulated(spark, sf_dir))).select(*KEYS, "triggers")


@query(_sql("SELECT * FROM cv"))
def covered_combos(spark, sf_dir):
    return pools.covers(stored(pools.simplified(pools.kept(cumulated(spark, sf_dir))))).select("pool", "direction", "wide", "narrow")


_PRUNED = (
    "od AS (SELECT *, triggers / greatest(rounds, 1) AS often, row_number() OVER (PARTITION BY pool, direction ORDER BY n_conditions, overall_rate DESC, combo) AS pos FROM si)",
    """pd AS (SELECT b.pool, b.direction, b.combo, b.pos, coalesce(list(a.combo) FILTER (WHERE a.combo IS NOT NULL), []) AS by FROM od b LEFT JOIN
  (SELECT a.*, cv.narrow FROM cv JOIN od a ON a.pool = cv.pool AND a.direction = cv.direction AND a.combo = cv.wide) a
  ON a.pool = b.pool AND a.direction = b.direction AND a.narrow = b.combo AND a.pos < b.pos AND a.overall_rate + 1e-12 >= b.overall_rate AND a.often >= 0.8 * b.often GROUP BY ALL)""",
    """fo AS (SELECT pool, direction, 0::BIGINT AS pos, []::VARCHAR[] AS kept FROM od GROUP BY ALL
  UNION ALL SELECT f.pool, f.direction, p.pos, CASE WHEN len(list_intersect(f.kept, p.by)) = 0 THEN list_append(f.kept, p.combo) ELSE f.kept END
  FROM fo f JOIN pd p ON p.pool = f.pool AND p.direction = f.direction AND p.pos = f.pos + 1)""",
    "pr AS MATERIALIZED (SELECT si.* FROM (SELECT pool, direction, unnest(k) AS combo FROM (SELECT pool, direction, arg_max(kept, pos) AS k FROM fo GROUP BY ALL)) k JOIN si USING (pool, direction, combo))",
)


@query(_sql("SELECT pool, direction, combo FROM pr", *_PRUNED, recursive=True))
def pruned_combos(spark, sf_dir):
    return pools.pruned(stored(pools.simplified(pools.kept(cumulated(spark, sf_dir))))).select(*KEYS)


@query(
    _sql(
        "SELECT pool, direction, anchor, combo, main_state FROM ac",
        "ex AS (SELECT pool, direction, combo, unnest(conditions) AS condition FROM cu)",
        "fq AS (SELECT pool, direction, condition, count(*) AS n FROM ex GROUP BY ALL)",
        "an AS (SELECT pool, direction, combo, arg_min(condition, (-n, length(condition), condition)) AS anchor FROM ex JOIN fq USING (pool, direction, condition) GROUP BY ALL)",
        "ms AS (SELECT pool, direction, combo, arg_max(state, (triggers, CASE state WHEN 'BULL' THEN 3 WHEN 'BEAR' THEN 2 ELSE 1 END)) AS main_state FROM br WHERE triggers > 0 GROUP BY ALL)",
        "ao AS (SELECT *, row_number() OVER (PARTITION BY pool, direction, anchor ORDER BY composite DESC, combo) AS pos FROM cu JOIN an USING (pool, direction, combo) LEFT JOIN ms USING (pool, direction, combo))",
        # The first of each state stays; the others while fewer than four are kept before them.
        """af AS (SELECT pool, direction, anchor, 0::BIGINT AS pos, []::VARCHAR[] AS states, []::VARCHAR[] AS kept FROM ao GROUP BY ALL
  UNION ALL SELECT f.pool, f.direction, f.anchor, o.pos, CASE WHEN list_contains(f.states, o.main_state) THEN f.states ELSE list_append(f.states, o.main_state) END,
    CASE WHEN NOT list_contains(f.states, o.main_state) OR len(f.kept) < 4 THEN list_append(f.kept, o.combo) ELSE f.kept END
  FROM af f JOIN ao o ON o.pool = f.pool AND o.direction = f.direction AND o.anchor = f.anchor AND o.pos = f.pos + 1)""",
        "ac AS (SELECT a.pool, a.direction, a.anchor, a.combo, ao.main_state FROM (SELECT pool, direction, anchor, unnest(k) AS combo FROM (SELECT pool, direction, anchor, arg_max(kept, pos) AS k FROM af GROUP BY ALL)) a JOIN ao USING (pool, direction, anchor, combo))",
        recursive=True,
    )
)
def anchor_choice(spark, sf_dir):
    t = triggers(spark, sf_dir)
    return pools.anchor_choice(stored(pools.cumulative(t)), pools.breakdowns(t))


_POOL = (
    "ca AS (SELECT cu.*, br.state, br.rate AS state_rate, br.triggers AS state_triggers FROM br JOIN (SELECT * FROM cu QUALIFY row_number() OVER (PARTITION BY direction, combo ORDER BY pool DESC) = 1) cu USING (pool, direction, combo) WHERE br.triggers >= 5)",
    "fm AS (SELECT *, list_sort(list_distinct(list_transform(conditions, lambda c: regexp_replace(c, '_(loose|strict)$', '')))) AS families, len(list_filter(conditions, lambda c: c LIKE '%loose')) AS n_loose FROM ca)",
    """mg AS MATERIALIZED (SELECT state, direction, families, first(combo ORDER BY -(composite + 0.5 * n_loose), combo) AS combo, first(n_conditions ORDER BY -(composite + 0.5 * n_loose), combo) AS nc,
  first(composite ORDER BY -(composite + 0.5 * n_loose), combo) AS composite, first(state_rate ORDER BY -(composite + 0.5 * n_loose), combo) AS state_rate,
  first(state_triggers ORDER BY -(composite + 0.5 * n_loose), combo) AS state_triggers, sum(triggers)::BIGINT AS triggers, sum(hits)::BIGINT AS hits, count(*) AS merged FROM fm GROUP BY ALL)""",
)


def _apart(name: str, source: str, most: int, overlap: float) -> str:
    return f"""{name}o AS (SELECT *, row_number() OVER (PARTITION BY state, direction ORDER BY {{}}) AS pos FROM {source}),
{name}f AS (SELECT state, direction, 0::BIGINT AS pos, []::VARCHAR[][] AS fams, []::VARCHAR[] AS kept FROM {name}o GROUP BY ALL
  UNION ALL SELECT f.state, f.direction, o.pos,
    CASE WHEN len(f.kept) < {most} AND len(list_filter(f.fams, lambda y: len(list_intersect(y, o.families)) >= {overlap} * len(list_distinct(list_concat(y, o.families))))) = 0 THEN list_append(f.fams, o.families) ELSE f.fams END,
    CASE WHEN len(f.kept) < {most} AND len(list_filter(f.fams, lambda y: len(list_intersect(y, o.families)) >= {overlap} * len(list_distinct(list_concat(y, o.families))))) = 0 THEN list_append(f.kept, o.combo) ELSE f.kept END
  FROM {name}f f JOIN {name}o o ON o.state = f.state AND o.direction = f.direction AND o.pos = f.pos + 1),
{name} AS MATERIALIZED (SELECT state, direction, unnest(k) AS combo, unnest(range(1, len(k) + 1))::INT AS place FROM (SELECT state, direction, arg_max(kept, pos) AS k FROM {name}f GROUP BY ALL))"""


_FREQUENT = "state_rate DESC, state_triggers DESC, combo"
_PREMIUM = (
    *_POOL,
    _apart("pm", "(SELECT * FROM mg WHERE composite >= 80)", 6, 0.3).format("composite DESC, state_rate DESC, combo"),
    _apart(
        "tn",
        "(SELECT mg.* FROM mg ANTI JOIN pm USING (state, direction, combo) WHERE nc BETWEEN 2 AND 3 AND state <> 'RANGE' AND triggers >= 10 AND composite >= 70)",
        6,
        0.5,
    ).format(_FREQUENT),
    _apart(
        "sw",
        "(SELECT * FROM mg WHERE nc BETWEEN 2 AND 3 AND state = 'RANGE' AND state_triggers >= 5 AND state_rate >= CASE direction WHEN 'long' THEN 0.64 ELSE 0.52 END)",
        10,
        0.5,
    ).format(_FREQUENT),
    "pp AS MATERIALIZED (SELECT *, 'PREMIUM' AS tier FROM pm UNION ALL SELECT *, 'FREQUENT' FROM tn UNION ALL SELECT *, 'FREQUENT' FROM sw)",
)


@query(_sql("SELECT state, direction, combo, round(hits / triggers, 6) AS overall_rate, triggers, merged FROM mg", *_POOL))
def merged_families(spark, sf_dir):
    t = triggers(spark, sf_dir)
    in_state = pools.breakdowns(t).where("triggers >= 5").select(*KEYS, "state", F.col("rate").alias("state_rate"), F.col("triggers").alias("state_triggers"))
    c = stored(pools.cumulative(t))
    m = pools.merged_families(in_state.join(pools.merged_pools(c.where("pool = 'pool1'"), c.where("pool = 'pool2'")), KEYS))
    return m.select("state", "direction", "combo", F.round("overall_rate", 6).alias("overall_rate"), "triggers", "merged")


@query(_sql("SELECT state, direction, place, combo, tier FROM pp", *_PREMIUM, recursive=True))
def premium_pool(spark, sf_dir):
    t = triggers(spark, sf_dir)
    return pools.premium_pool(stored(pools.cumulative(t)), pools.breakdowns(t))


@query(
    _sql(
        "SELECT b.state, b.direction, b.tier, b.combo, round(overall_rate, 6) AS overall_rate FROM b JOIN (SELECT direction, combo, max(overall_rate) AS overall_rate FROM cu GROUP BY ALL) USING (direction, combo)",
        *_PREMIUM,
        "b AS (SELECT state, direction, first(tier ORDER BY tier = 'FREQUENT', place) AS tier, first(combo ORDER BY tier = 'FREQUENT', place) AS combo FROM pp GROUP BY ALL)",
        recursive=True,
    )
)
def best_for_state(spark, sf_dir):
    t = triggers(spark, sf_dir)
    c = stored(pools.cumulative(t))
    found = pools.best_for_state(stored(pools.premium_pool(c, pools.breakdowns(t))), c)
    return found.select("state", "direction", "tier", "combo", F.round("overall_rate", 6).alias("overall_rate"))


@query(
    _sql(
        "SELECT key, first(pool ORDER BY ev_per_bar DESC, n_conditions, combo, pool, direction) AS pool, first(direction ORDER BY ev_per_bar DESC, n_conditions, combo, pool, direction) AS direction, "
        "first(combo ORDER BY ev_per_bar DESC, n_conditions, combo, pool, direction) AS combo, round(max(ev_per_bar), 6) + 0.0 AS ev_per_bar FROM tk JOIN cu USING (pool, direction, combo) GROUP BY key",
        "tk AS (SELECT DISTINCT round * 1000 + hold AS key, pool, direction, combo FROM ck)",
    )
)
def best_triggers(spark, sf_dir):
    t = triggers(spark, sf_dir)
    on_bar = t.select((F.col("round") * 1000 + F.col("hold")).alias("key"), "pool", "direction", pools.key_of().alias("combo")).distinct()
    return rounded(pools.best_triggers(on_bar, pools.cumulative(t)), ["key", *KEYS], ["ev_per_bar"])


@query(_sql("SELECT pool, direction, combo, triggers FROM (SELECT * FROM cu WHERE pool = 'pool2' UNION ALL SELECT a.* FROM cu a WHERE a.pool = 'pool1' AND NOT EXISTS (FROM cu b WHERE b.pool = 'pool2' AND b.direction = a.direction AND b.combo = a.combo))"))
def merged_pools(spark, sf_dir):
    c = stored(cumulated(spark, sf_dir))
    return pools.merged_pools(c.where("pool = 'pool1'"), c.where("pool = 'pool2'")).select(*KEYS, "triggers")


@query(
    _sql(
        """SELECT direction, combo, trades, round(hit_rate, 6) AS hit_rate, round(stop_rate, 6) AS stop_rate, profit, round(known, 6) AS overall_rate,
  array_to_string(list_filter([CASE WHEN known IS NULL THEN 'UNKNOWN' END, CASE WHEN hit_rate < known - 0.1 THEN 'BELOW_HISTORY' END, CASE WHEN stop_rate >= 0.5 THEN 'STOPPED_OUT' END], lambda x: x IS NOT NULL), ',') AS issues
FROM fb LEFT JOIN (SELECT direction, combo, max(overall_rate) AS known FROM kp GROUP BY ALL) USING (direction, combo)""",
        "fb AS (SELECT direction, combo, count(*) AS trades, avg(hit::INT) AS hit_rate, avg((hold > 8)::INT) AS stop_rate, sum(hold)::BIGINT AS profit FROM (SELECT direction, unnest([combo, conditions[1]]) AS combo, hit, hold FROM ck) GROUP BY ALL)",
    )
)
def combo_feedback(spark, sf_dir):
    t = triggers(spark, sf_dir)
    trades = t.select(
        "direction",
        F.array(pools.key_of(), F.col("conditions")[0]).alias("keys"),
        "hit",
        (F.col("hold") > 8).alias("stopped"),
        F.col("hold").alias("profit"),
    )
    found = pools.feedback(trades, pools.kept(pools.cumulative(t)))
    return found.withColumns({c: F.round(c, 6) for c in ("hit_rate", "stop_rate", "overall_rate")})


@query(
    _sql(
        "SELECT pool, direction, combo, round, t AS triggers, round_even(t * rate, 0)::BIGINT AS hits FROM (SELECT pool, direction, combo, k AS round, CASE WHEN k = rounds THEN triggers - (triggers // rounds) * (rounds - 1) ELSE triggers // rounds END AS t, rate FROM "
        "(SELECT *, unnest(range(1, rounds + 1)) AS k, round(overall_rate * 100, 4) / 100 AS rate FROM cu))"
    )
)
def store_round_trip(spark, sf_dir):
    """The store written as tab-separated text and read back as rounds."""
    path = scratch(spark)
    pools.exported(cumulated(spark, sf_dir), path)
    return pools.imported(spark, path)


@query(
    _sql("SELECT pool, direction, combo, round, triggers, hits FROM rr WHERE round < 5 UNION ALL SELECT pool, direction, combo, round, triggers * 2, hits FROM rr WHERE round BETWEEN 5 AND 7")
)
def joined_histories(spark, sf_dir):
    """A store of rounds 0 to 4 takes over rounds 3 to 7 of another, written as JSON and read back."""
    r = stored(pools.round_results(triggers(spark, sf_dir)).select(*KEYS, "round", "triggers", "hits"))
    path = scratch(spark)
    r.where("round >= 3").withColumn("triggers", F.col("triggers") * 2).write.json(path)
    return pools.joined_histories(r.where("round < 5"), spark.read.schema(r.schema).json(path))
