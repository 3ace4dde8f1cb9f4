"""Templates, prototypes and matching, over vectors of four plain numbers a bar, and over the table
of embeddings where prototypes and windows are any vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch, stored
from tidemark.operators import features as feat
from tidemark.operators import indicators as ind
from tidemark.operators import similarity as sim
from tidemark.operators import swings as swing
from tidemark.operators import templates as tpl
from tidemark.plans import sql
from tidemark.plans.registry import query, rounded, table
from tidemark.sources import bars as src

PRE = 20


def vectors(spark, sf_dir) -> DataFrame:
    """Change, range, volume and place of the close of each bar."""
    b = src.bars_from_ticks(spark, sf_dir)
    v = F.array(
        (F.col("close") / F.col("open") - 1) * 100,
        (F.col("high") - F.col("low")) / F.col("close") * 100,
        F.log(F.col("volume") + 1),
        (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-9),
    )
    return b.select("symbol", "bar_idx", v.alias("v"))


def templates(spark, sf_dir) -> DataFrame:
    points = swing.alternating(swing.swing_points(src.bars_from_ticks(spark, sf_dir)))
    trades = swing.label_trades(points).withColumn(
        "regime",
        F.when(F.col("entry_idx") % 3 == 0, F.lit(None)).when(F.col("entry_idx") % 3 == 1, "UNKNOWN").otherwise("STRONG_BULL"),
    )
    return tpl.extract(trades, vectors(spark, sf_dir), PRE)


_VECTORS = "vec AS MATERIALIZED (SELECT symbol, bar_idx, [(close / open - 1) * 100, (high - low) / close * 100, ln(volume + 1), (close - low) / (high - low + 1e-9)] AS v FROM bars)"
_POINTS = """sw AS (SELECT * FROM (SELECT symbol, bar_idx, high, low, max(high) OVER n AS top, min(low) OVER n AS bottom, count(*) OVER n AS seen FROM bars
  WINDOW n AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE seen = 11 AND (high = top OR low = bottom)),
sx AS (SELECT symbol, bar_idx, high = top AS h, CASE WHEN high = top THEN high ELSE low END AS price FROM sw),
sy AS (SELECT *, sum((g IS DISTINCT FROM h)::INT) OVER (PARTITION BY symbol ORDER BY bar_idx) AS run FROM (SELECT *, lag(h) OVER (PARTITION BY symbol ORDER BY bar_idx) AS g FROM sx)),
sz AS (SELECT symbol, run, any_value(h) AS h, CASE WHEN any_value(h) THEN arg_max(bar_idx, (price, -bar_idx)) ELSE arg_min(bar_idx, (price, bar_idx)) END AS bar_idx, CASE WHEN any_value(h) THEN max(price) ELSE min(price) END AS price FROM sy GROUP BY symbol, run),
td AS (SELECT symbol, bar_idx AS entry_idx, lead(bar_idx) OVER w AS exit_idx, CASE WHEN h THEN 'SHORT' ELSE 'LONG' END AS direction, CASE WHEN h THEN price - lead(price) OVER w ELSE lead(price) OVER w - price END / price * 100 AS profit_pct
  FROM sz WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))"""
_TEMPLATES = f"""tp AS MATERIALIZED (SELECT *, CASE WHEN entry_idx % 3 = 2 THEN 'STRONG_BULL' WHEN direction = 'LONG' THEN 'RANGE_BULL' ELSE 'RANGE_BEAR' END AS regime FROM td WHERE exit_idx IS NOT NULL AND profit_pct >= 0.5 AND entry_idx >= {PRE}),
tl AS MATERIALIZED (SELECT t.*, v.bar_idx, v.v, v.bar_idx < entry_idx AS pre, v.bar_idx >= greatest(entry_idx, exit_idx - 29) AS post FROM tp t JOIN vec v ON v.symbol = t.symbol AND v.bar_idx BETWEEN entry_idx - {PRE} AND exit_idx)"""


def _sql(select: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join([sql.TICK_BARS, _VECTORS, _POINTS, _TEMPLATES, *more])}\n{select}"


KEYS = ["symbol", "entry_idx", "exit_idx"]


@query(_sql("SELECT symbol, entry_idx, exit_idx, direction, regime, round(profit_pct, 6) AS profit_pct, sum(pre::INT)::INT AS n_pre, sum((NOT pre)::INT)::INT AS n_held, sum(post::INT)::INT AS n_post FROM tl GROUP BY ALL"))
def trade_templates(spark, sf_dir):
    t = templates(spark, sf_dir)
    return t.select(
        *KEYS,
        "direction",
        "regime",
        F.round("profit_pct", 6).alias("profit_pct"),
        F.size("pre").alias("n_pre"),
        F.size("held").alias("n_held"),
        F.size("post").alias("n_post"),
    )


_STATS = ["mean", "std", "min", "max", "first", "last", "range", "trend", "early", "middle", "late"]


@query(
    _sql(
        f"""SELECT symbol, entry_idx, exit_idx, feature, {', '.join(f'round({c}, 5) + 0.0 AS "{c}"' for c in _STATS)} FROM (
SELECT symbol, entry_idx, exit_idx, f - 1 AS feature, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, arg_min(x, t) AS first, arg_max(x, t) AS last, max(x) - min(x) AS range,
  coalesce(regr_slope(x, t) / CASE WHEN stddev_pop(x) < 1e-9 THEN 1 ELSE stddev_pop(x) END, 0) AS trend,
  avg(x) FILTER (WHERE t * 3 // n = 0) AS early, avg(x) FILTER (WHERE t * 3 // n = 1) AS middle, avg(x) FILTER (WHERE t * 3 // n = 2) AS late
FROM (SELECT *, bar_idx - entry_idx + {PRE} AS t, {PRE} AS n, unnest(v) AS x, unnest([1, 2, 3, 4]) AS f FROM tl WHERE pre) GROUP BY ALL)"""
    )
)
def sequence_features(spark, sf_dir):
    found = tpl.sequence_features(templates(spark, sf_dir), "pre", *KEYS)
    return rounded(found, [*KEYS, "feature"], _STATS, 5)


_SUMMARY = """sm AS MATERIALIZED (SELECT t.symbol, t.entry_idx, t.exit_idx, t.direction, t.regime, t.profit_pct, t.exit_idx - t.entry_idx + 1 AS held_bars, list_concat(a, b, c, d, [(t.exit_idx - t.entry_idx + 1) / 200, t.profit_pct / 10]) AS summary FROM tp t JOIN
 (SELECT symbol, entry_idx, list(avg_pre ORDER BY f) AS a, list(avg_held ORDER BY f) AS b, list(std_held ORDER BY f) AS c, list(avg_post ORDER BY f) AS d FROM
  (SELECT symbol, entry_idx, f, avg(x) FILTER (WHERE pre) AS avg_pre, avg(x) FILTER (WHERE NOT pre) AS avg_held, stddev_pop(x) FILTER (WHERE NOT pre) AS std_held, avg(x) FILTER (WHERE post) AS avg_post
   FROM (SELECT *, unnest(v) AS x, unnest([1, 2, 3, 4]) AS f FROM tl) GROUP BY ALL) GROUP BY ALL) s ON s.symbol = t.symbol AND s.entry_idx = t.entry_idx)"""


@query(_sql("SELECT symbol, entry_idx, exit_idx, place::INT AS place, round(x, 5) + 0.0 AS x FROM (SELECT symbol, entry_idx, exit_idx, unnest(summary) AS x, unnest(range(0, 18)) AS place FROM sm)", _SUMMARY))
def template_summaries(spark, sf_dir):
    s = tpl.summaries(templates(spark, sf_dir)).select(*KEYS, F.posexplode("summary").alias("place", "x"))
    return rounded(s, [*KEYS, "place"], ["x"], 5)


def members(spark, sf_dir) -> DataFrame:
    """Templates dealt to four clusters of each direction by their entry, whatever their regime."""
    s = tpl.with_fingerprint(tpl.summaries(templates(spark, sf_dir))).withColumn("held_bars", F.size("held"))
    return s.select(
        "direction",
        F.lit("ANY").alias("regime"),
        F.col("regime").alias("member_regime"),
        (F.col("entry_idx") % 4).alias("cluster"),
        "summary",
        "profit_pct",
        "held_bars",
        "fingerprint",
        *KEYS,
    )


_PROTOS = (
    _SUMMARY,
    "pm AS MATERIALIZED (SELECT *, entry_idx % 4 AS cluster FROM sm)",
    """pt AS MATERIALIZED (SELECT direction, cluster, members, wins, avg_profit, avg_hold, wins / members AS win_rate, purity,
  greatest(0, least(1, 0.4 * wins / members + 0.3 * (1 - least(1, profit_std / 0.15)) + 0.2 * least(1, members / 10) + 0.1 * purity)) AS confidence FROM
  (SELECT direction, cluster, count(*) AS members, sum((profit_pct > 0)::INT)::BIGINT AS wins, avg(profit_pct) AS avg_profit, stddev_pop(profit_pct) AS profit_std, avg(held_bars) AS avg_hold FROM pm GROUP BY ALL HAVING count(*) >= 3)
  JOIN (SELECT direction, cluster, max(c) / sum(c) AS purity FROM (SELECT direction, cluster, regime, count(*) AS c FROM pm GROUP BY ALL) GROUP BY ALL) USING (direction, cluster))""",
)
_LEVEL = "CASE WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' WHEN confidence >= 0.3 THEN 'LOW' ELSE 'VERY_LOW' END"


@query(_sql(f"SELECT direction, cluster, members, wins, {sql.rounded(['avg_profit', 'avg_hold', 'win_rate', 'purity', 'confidence'])}, {_LEVEL} AS level FROM pt", *_PROTOS))
def template_prototypes(spark, sf_dir):
    p = tpl.prototypes(members(spark, sf_dir))
    return rounded(p, ["direction", "cluster", "members", "wins", "level"], ["avg_profit", "avg_hold", "win_rate", "purity", "confidence"])


@query(_sql("SELECT direction, cluster, place::INT AS place, round(x, 5) + 0.0 AS x FROM (SELECT direction, cluster, place, avg(x) AS x FROM (SELECT direction, cluster, unnest(summary) AS x, unnest(range(0, 18)) AS place FROM pm) GROUP BY ALL) JOIN (SELECT direction, cluster FROM pt) USING (direction, cluster)", *_PROTOS))
def prototype_centroids(spark, sf_dir):
    p = tpl.prototypes(members(spark, sf_dir)).select("direction", "cluster", F.posexplode("centroid").alias("place", "x"))
    return rounded(p, ["direction", "cluster", "place"], ["x"], 5)


@query(
    _sql(
        "SELECT direction, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, " + ", ".join(f"sum(({_LEVEL} = '{n}')::INT)::BIGINT AS {n.lower()}" for n in ("HIGH", "MEDIUM", "LOW", "VERY_LOW")) + " FROM pt GROUP BY GROUPING SETS ((), (direction))",
        *_PROTOS,
    )
)
def confidence_statistics(spark, sf_dir):
    return tpl.confidence_stats(tpl.prototypes(members(spark, sf_dir))).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query()
def clustered_templates(spark, sf_dir):
    """Members of each k-means cluster of template summaries within direction and regime."""
    c = tpl.clustered(templates(spark, sf_dir), 5)
    return c.groupBy("direction", "regime", "cluster").agg(F.count("*").alias("n"), F.round(F.avg("profit_pct"), 6).alias("avg_profit"))


@query(_sql("SELECT regime, direction, count(*) AS n, round(avg(profit_pct), 6) AS avg_profit, round(max(profit_pct), 6) AS max_profit FROM tp GROUP BY CUBE (regime, direction)"))
def memory_statistics(spark, sf_dir):
    m = tpl.memory_stats(templates(spark, sf_dir))
    return m.withColumns({c: F.round(c, 6) for c in ("avg_profit", "max_profit")})


@query(_sql("SELECT symbol, entry_idx FROM tp WHERE entry_idx % 2 = 0 OR entry_idx % 3 = 0"))
def joined_memories(spark, sf_dir):
    """Two overlapping memories written, read again and joined by fingerprint."""
    t, path = tpl.with_fingerprint(templates(spark, sf_dir)), scratch(spark)
    t.where("entry_idx % 3 = 0").write.parquet(path)
    return tpl.joined_memories(t.where("entry_idx % 2 = 0"), spark.read.parquet(path)).select("symbol", "entry_idx")


@query(_sql("SELECT symbol, entry_idx, direction, round(profit_pct, 6) AS profit_pct FROM tp WHERE entry_idx % 3 = 0 AND entry_idx % 2 = 1"))
def filtered_memories(spark, sf_dir):
    """A memory kept by the fingerprints of some entries, and rid of those of others."""
    t = stored(tpl.with_fingerprint(templates(spark, sf_dir)))
    left = tpl.remove(tpl.keep(t, t.where("entry_idx % 3 = 0")), t.where("entry_idx % 2 = 0"))
    return left.select("symbol", "entry_idx", "direction", F.round("profit_pct", 6).alias("profit_pct"))


@query(_sql("SELECT direction, regime, count(*) AS n, round(avg(profit_pct), 6) AS avg_profit FROM tp WHERE entry_idx > 100 AND profit_pct >= 0.8 AND (regime LIKE '%BULL') = (direction = 'LONG') GROUP BY ALL"))
def training_candidates(spark, sf_dir):
    return tpl.candidates(templates(spark, sf_dir), 100, 0.8).withColumn("avg_profit", F.round("avg_profit", 6))


@query(
    _sql(
        """SELECT symbol, first, CASE WHEN n <> 30 THEN 'LENGTH' WHEN zeros > n * 0.5 THEN 'ZERO_ROWS' ELSE 'OK' END AS verdict FROM (SELECT s.symbol, s.first, count(*) AS n, sum((v.v[1] = 0 AND v.v[2] = 0)::INT) AS zeros
FROM (SELECT symbol, bar_idx AS first FROM vec WHERE bar_idx % 25 = 0) s JOIN vec v ON v.symbol = s.symbol AND v.bar_idx BETWEEN s.first AND s.first + 29 GROUP BY ALL)"""
    )
)
def trajectory_verdicts(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("v", F.slice("v", 1, 2))
    spans = v.where("bar_idx % 25 = 0").select("symbol", F.col("bar_idx").alias("first"), (F.col("bar_idx") + 30).alias("last"))
    return tpl.windows(v, spans).select("symbol", "first", tpl.verdict("matrix", 30, 2).alias("verdict"))


# --- layers: weights, coordinates, group weights

_LAYERED = {"a": (0, 16, 1.5), "b": (16, 10, 1.2), "c": (26, 6, 1.0)}


@query(
    sql.with_indicators(
        "SELECT symbol, count(*) AS n, " + ", ".join(f"round(avg({n}), 2) + 0.0 AS {n}" for n in _LAYERED) + " FROM co GROUP BY symbol",
        "lv AS (SELECT symbol, bar_idx, [" + ", ".join(f"({x})::DOUBLE" for x in feat.layer_columns("round_even").values()) + "] AS v FROM i)",
        "co AS (SELECT symbol, " + ", ".join(f"round(list_sum(list_transform(v[{a + 1}:{a + k}], lambda x: x * {w})), 3) AS {n}" for n, (a, k, w) in _LAYERED.items()) + " FROM lv)",
    )
)
def layer_coordinates(spark, sf_dir):
    c = feat.coordinates(feat.layers(ind.indicators(src.bars_from_ticks(spark, sf_dir))))
    return rounded(c.groupBy("symbol").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in _LAYERED]), ["symbol", "n"], _LAYERED, 2)


# --- matching, over embeddings

_EMB = """em AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
pr AS (SELECT vec_id AS proto_id, CASE WHEN label % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE label % 3 WHEN 0 THEN 'STRONG_BULL' WHEN 1 THEN 'WEAK_BEAR' ELSE 'UNKNOWN' END AS regime, e AS v, 0.5 + label / 20 AS confidence FROM em WHERE vec_id % 50 = 7),
qu AS (SELECT vec_id AS query_id, CASE label % 4 WHEN 0 THEN 'STRONG_BULL' WHEN 1 THEN 'WEAK_BEAR' WHEN 2 THEN 'UNKNOWN' END AS regime, e AS q FROM em WHERE vec_id % 50 = 0),
ms AS MATERIALIZED (SELECT query_id, proto_id, direction, greatest(0, list_cosine_similarity(q, v)) AS cosine, 1 - least(1, list_distance(q, v) / greatest(200, sqrt(64) * 20)) AS distance, confidence FROM qu JOIN pr ON (qu.regime IS NULL OR qu.regime = pr.regime)
  AND CASE WHEN qu.regime LIKE '%BULL' THEN pr.direction = 'LONG' WHEN qu.regime LIKE '%BEAR' THEN pr.direction = 'SHORT' ELSE true END),
sc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, proto_id) AS rk FROM (SELECT *, (0.3 * cosine + 0.4 * distance) / 0.7 * confidence AS score FROM ms))"""


def _vectors_as(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), "label")
    regime = F.when(F.col("label") % 3 == 0, "STRONG_BULL").when(F.col("label") % 3 == 1, "WEAK_BEAR").otherwise("UNKNOWN")
    protos = e.where("vec_id % 50 = 7").select(
        F.col("vec_id").alias("proto_id"),
        F.when(F.col("label") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
        regime.alias("regime"),
        F.col("e").alias("v"),
        (0.5 + F.col("label") / 20).alias("confidence"),
    )
    state = F.when(F.col("label") % 4 == 0, "STRONG_BULL").when(F.col("label") % 4 == 1, "WEAK_BEAR").when(F.col("label") % 4 == 2, "UNKNOWN")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), state.alias("regime"), F.col("e").alias("q")), protos


@query(
    f"""WITH {_EMB} SELECT query_id, proto_id, direction, round(score, 6) AS score, vote_long, vote_short, round(CASE WHEN vote_long + vote_short > 0 THEN vote_long / (vote_long + vote_short) ELSE 0.5 END, 6) AS vote_ratio, score >= 0.5 AS matched, top
FROM sc JOIN (SELECT query_id, sum((direction = 'LONG' AND score >= 0.5)::INT)::BIGINT AS vote_long, sum((direction = 'SHORT' AND score >= 0.5)::INT)::BIGINT AS vote_short, array_to_string(list(proto_id ORDER BY rk) FILTER (WHERE rk <= 5), ',') AS top FROM sc GROUP BY query_id) USING (query_id) WHERE rk = 1"""
)
def prototype_matches(spark, sf_dir):
    m = tpl.matches(*_vectors_as(spark, sf_dir))
    return m.select(
        "query_id",
        "proto_id",
        "direction",
        F.round("score", 6).alias("score"),
        "vote_long",
        "vote_short",
        F.round("vote_ratio", 6).alias("vote_ratio"),
        "matched",
        F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"),
    )


@query(
    f"""WITH {_EMB} SELECT query_id, CASE WHEN b.proto_id <> o.proto_id AND b.score >= o.score + 0.15 THEN b.proto_id ELSE o.proto_id END AS kept_id, b.proto_id <> o.proto_id AND b.score >= o.score + 0.15 AS switched,
  CASE WHEN o.score >= 0.7 THEN 'SAFE' WHEN o.score >= 0.5 THEN 'ALERT' WHEN o.score >= 0.3 THEN 'DANGER' ELSE 'DERAIL' END AS status FROM sc b JOIN (SELECT query_id, arg_max(proto_id, rk) AS proto_id, arg_max(score, rk) AS score FROM sc GROUP BY query_id) o USING (query_id) WHERE b.rk = 1"""
)
def held_rematches(spark, sf_dir):
    """Positions on the worst prototype that their regime admits: do they move to the best?"""
    q, p = _vectors_as(spark, sf_dir)
    m = tpl.matches(q, p, details=1 << 20).withColumn("own_id", F.element_at("top", -1))
    own = tpl.similarities(
        m.join(q.select("query_id", "q"), "query_id").join(F.broadcast(p.select(F.col("proto_id").alias("own_id"), "v", "confidence")), "own_id"),
        "q",
        "v",
    )
    held = tpl.rematches(own.select("query_id", "own_id", (F.col("fused") * F.col("confidence")).alias("own_score"), F.col("proto_id").alias("best_id"), "score"))
    return held.select("query_id", "kept_id", "switched", tpl.health("own_score").alias("status"))


@query(
    """WITH RECURSIVE p AS (SELECT vec_id AS key, label % 2 AS d, embedding::DOUBLE[] AS v, 0.5 + label / 20 AS a, vec_id % 9 AS b FROM embeddings WHERE vec_id % 10 = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY a DESC, b DESC, key) AS pos FROM p),
f AS (SELECT d, 0::BIGINT AS pos, []::BIGINT[] AS kept, []::DOUBLE[][] AS vs FROM o GROUP BY d
  UNION ALL SELECT f.d, o.pos, CASE WHEN len(list_filter(f.vs, lambda y: list_cosine_similarity(y, o.v) >= 0.2)) = 0 THEN list_append(f.kept, o.key) ELSE f.kept END,
    CASE WHEN len(list_filter(f.vs, lambda y: list_cosine_similarity(y, o.v) >= 0.2)) = 0 THEN list_append(f.vs, o.v) ELSE f.vs END FROM f JOIN o ON o.d = f.d AND o.pos = f.pos + 1)
SELECT d::INT AS direction, unnest(k) AS vec_id FROM (SELECT d, arg_max(kept, pos) AS k FROM f GROUP BY d)"""
)
def apart_prototypes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id % 10 = 1")
    p = e.select(
        "vec_id",
        (F.col("label") % 2).cast("int").alias("direction"),
        F.lit("ANY").alias("regime"),
        "embedding",
        (0.5 + F.col("label") / 20).alias("confidence"),
        (F.col("vec_id") % 9).alias("members"),
        F.lit(1.0).alias("avg_profit"),
    )
    return tpl.apart_prototypes(p, "vec_id", "embedding", 0.2).select("direction", "vec_id")


@query()
def cosine_then_warping(spark, sf_dir):
    """The three of the ten cosine neighbours that are nearest by warping, vectors read as eight steps
    of eight."""
    e = table(spark, sf_dir, "embeddings")
    near = sim.top_k(e, e.where("vec_id % 50 = 0"), 10)
    steps = e.select("vec_id", F.expr("transform(sequence(0, 7), i -> transform(slice(embedding, 8 * i + 1, 8), x -> cast(x as double)))").alias("s"))
    pairs = near.join(
        steps.select(F.col("vec_id").alias("query_id"), F.col("s").alias("x")),
        "query_id",
    ).join(steps.select(F.col("vec_id").alias("id"), F.col("s").alias("y")), "id")
    ranked = sim.dtw_pairs(pairs.select("query_id", "id", "x", "y")).withColumn("place", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY dtw, id)"))
    return ranked.where("place <= 3").select("query_id", "id", "dtw", "place")


@query(
    """WITH r AS (SELECT l_suppkey % 40 AS f, CASE WHEN l_quantity > 25 THEN 1 ELSE -1 END * (l_quantity - 20) / 10 + (l_suppkey % 7) / 5 - 1.2 AS p FROM lineitem WHERE l_suppkey % 40 < 30 AND (l_suppkey % 40 > 3 OR l_linenumber = 7 AND l_quantity > 49)),
t AS (SELECT f, count(p) AS matches, coalesce(sum((p > 0)::INT), 0)::BIGINT AS wins, coalesce(avg(p), 0) AS avg_profit FROM (SELECT DISTINCT s_suppkey % 40 AS f FROM supplier) LEFT JOIN r USING (f) GROUP BY f),
s AS (SELECT *, CASE WHEN matches > 0 THEN wins / matches ELSE 0 END AS w FROM t),
g AS (SELECT *, CASE WHEN matches < 3 THEN 20 + 5 * matches WHEN avg_profit > 0 THEN least(100, 60 + least(25, 10 * avg_profit) + least(10, greatest(0, w - 0.4) * 50) + least(10, 2 * (matches - 3))) ELSE greatest(0, 30 * w + 10 * greatest(0, avg_profit)) END AS score FROM s)
SELECT f::VARCHAR AS fingerprint, matches, wins, round(avg_profit, 6) AS avg_profit, round(score, 6) AS score,
  CASE WHEN matches = 0 THEN 'PENDING' WHEN matches < 3 THEN 'WATCHED' WHEN avg_profit > 0 THEN CASE WHEN score >= 80 THEN 'GOOD' ELSE 'QUALIFIED' END ELSE 'ELIMINATED' END AS grade FROM g"""
)
def template_performances(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    f = F.col("l_suppkey") % 40
    profit = F.when(F.col("l_quantity") > 25, 1).otherwise(-1) * (F.col("l_quantity") - 20) / 10 + (F.col("l_suppkey") % 7) / 5 - 1.2
    results = lines.where((f < 30) & ((f > 3) | ((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 49)))).select(f.cast("string").alias("fingerprint"), profit.alias("profit_pct"))
    known = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).cast("string").alias("fingerprint"))
    found = tpl.performances(known, results)
    return found.select("fingerprint", "matches", "wins", F.round("avg_profit", 6).alias("avg_profit"), F.round("score", 6).alias("score"), "grade")


@query()
def merged_prototypes(spark, sf_dir):
    """Prototypes of trades by symbol, side and place in the order of entries, merged where their
    centroids are near; SQL has no fold that changes what it still has to look at."""
    s = tpl.summaries(templates(spark, sf_dir)).withColumn("place", F.concat_ws("/", "symbol", F.col("entry_idx") % 6))
    centre = s.select("direction", "regime", "place", F.posexplode("summary").alias("i", "x")).groupBy("direction", "regime", "place", "i").agg(F.avg("x").alias("x"))
    centre = centre.groupBy("direction", "regime", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    p = F.col("profit_pct")
    numbers = s.groupBy("direction", "regime", "place").agg(
        F.count("*").alias("members"), F.sum((p > 1).cast("long")).alias("wins"), F.sum(p).alias("total_profit"), F.least(F.lit(1.0), F.count("*") / 10).alias("confidence")
    )
    found = tpl.merged_prototypes(centre.join(numbers, ["direction", "regime", "place"]).withColumnRenamed("place", "proto_id"), 0.98)
    return rounded(found.withColumn("merged", F.array_join("merged", ",")), ["proto_id", "direction", "regime", "members", "wins", "merged"], ["total_profit", "win_rate", "avg_profit"])
