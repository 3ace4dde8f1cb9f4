"""Logs replayed through files as streams, against what a batch says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch, stored
from tidemark.plans import sql
from tidemark.plans.registry import query, rounded
from tidemark.sources import bars as src
from tidemark.streaming import trackers

KINDS = ("rejection", "exit_timing", "stop", "near_miss", "early_exit")
SLICES, DELAY_MS, FILES = 4, 5_400_000, 16


def bars(spark, sf_dir) -> DataFrame:
    return stored(src.bars_from_ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))


def replayed(*logs: DataFrame) -> list[DataFrame]:
    """Logs as streams of recorded files, each batch of which takes the same slice of all of them."""
    spark = logs[0].sparkSession
    ends = [log.agg(F.unix_millis(F.min("ts")), F.unix_millis(F.max("ts"))).first() for log in logs]
    ends = [e for e in ends if e[0] is not None] or [(0, 0)]
    span, streams = (min(e[0] for e in ends), max(e[1] for e in ends)), []
    for log in logs:
        path = scratch(spark)
        trackers.recorded(log, path, SLICES, DELAY_MS, FILES, span)
        streams.append(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", FILES).parquet(path))
    return streams


def finished(result: DataFrame) -> DataFrame:
    spark, path = result.sparkSession, scratch(result.sparkSession)
    trackers.started(result, path, scratch(spark)).awaitTermination()
    return spark.read.schema(result.schema).parquet(path)


_VERDICTS = """
, d AS (SELECT symbol, bar_idx, open, high, low, close, CASE WHEN close >= open THEN 1 ELSE -1 END AS way,
               lead(close, 30) OVER (PARTITION BY symbol ORDER BY bar_idx) AS later,
               max(close) OVER a AS top, min(close) OVER a AS bottom FROM bars
        WINDOW a AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)),
m AS (SELECT symbol, bar_idx, way, way * (later - close) / close * 100 AS move,
             greatest(0, CASE way WHEN 1 THEN top - close ELSE close - bottom END / close * 100) AS best,
             greatest(0, CASE way WHEN 1 THEN close - bottom ELSE top - close END / close * 100) AS worst,
             way * (close - open) / open * 100 AS profit,
             CASE way WHEN 1 THEN high - open ELSE open - low END / open * 100 AS peak FROM d WHERE later IS NOT NULL)
SELECT symbol, kind, bar_idx, CASE way WHEN 1 THEN 'long' ELSE 'short' END AS direction, round(move, 6) + 0.0 AS move,
       round(best, 6) + 0.0 AS best, round(worst, 6) + 0.0 AS worst,
       CASE kind WHEN 'rejection' THEN CASE WHEN move < 0.3 THEN 'correct' ELSE 'wrong' END
                 WHEN 'near_miss' THEN CASE WHEN move >= 0.3 THEN 'profitable' ELSE 'unprofitable' END
                 WHEN 'exit_timing' THEN CASE WHEN best > 0.5 THEN 'premature'
                      WHEN peak > 0 AND (peak - profit) / peak > 0.5 AND best < 0.25 THEN 'late' ELSE 'correct' END
                 ELSE CASE WHEN move >= 0.5 THEN CASE kind WHEN 'stop' THEN 'too_tight' ELSE 'too_aggressive' END
                           WHEN move <= -0.5 THEN 'correct' ELSE 'neutral' END END AS verdict
FROM m, (VALUES ('rejection'), ('exit_timing'), ('stop'), ('near_miss'), ('early_exit')) AS v(kind)"""


@query(sql.with_bars(_VERDICTS.lstrip()))
def streamed_judgements(spark, sf_dir):
    """At the close of every bar, a decision of each kind on a position opened at its open, in the way
    the bar went."""
    b = bars(spark, sf_dir)
    up = F.col("close") >= F.col("open")
    log = b.select(
        "symbol",
        "ts",
        "bar_idx",
        F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"),
        F.when(up, "long").otherwise("short").alias("direction"),
        F.col("close").alias("price"),
        (F.abs(F.col("close") - F.col("open")) / F.col("open") * 100).alias("profit"),
        (F.when(up, F.col("high") - F.col("open")).otherwise(F.col("open") - F.col("low")) / F.col("open") * 100).alias("peak"),
    ).withColumn("id", F.concat_ws("/", "kind", "bar_idx"))
    found = trackers.judgements(*replayed(b.select("symbol", "ts", "bar_idx", "close"), log), shards=2)
    return rounded(finished(found), ["symbol", "kind", "bar_idx", "direction", "verdict"], ["move", "best", "worst"])


_LOG = """
, l AS (SELECT *, lag(close) OVER w AS before, lag(high - low) OVER w AS width FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx)),
log AS (SELECT symbol, bar_idx, 0 AS ord, 'match' AS what, CASE WHEN close >= open THEN 'long' ELSE 'short' END AS direction,
               CASE WHEN high - low > width THEN 'wide' ELSE 'narrow' END AS fingerprint,
               (close >= open AND close > before) OR (close < open AND close < before) AS passed
        FROM l WHERE before IS NOT NULL
        UNION ALL SELECT symbol, bar_idx, 1, 'close', CASE WHEN close >= open THEN 'short' ELSE 'long' END, NULL, NULL
        FROM l WHERE before IS NOT NULL AND abs(close - open) / open > 0.004),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx, ord) AS i FROM log),
s AS (SELECT symbol, 0::BIGINT AS i, NULL::VARCHAR AS cd, NULL::VARCHAR AS cf, NULL::BIGINT AS cb, NULL::VARCHAR AS sd, NULL::BIGINT AS sb,
             NULL::BIGINT AS bar_idx, NULL::VARCHAR AS od, NULL::VARCHAR AS ofp, NULL::VARCHAR AS verdict FROM (SELECT DISTINCT symbol FROM n)
      UNION ALL
      SELECT symbol, i, CASE WHEN what = 'close' OR verdict = 'entered' THEN NULL ELSE d END,
             CASE WHEN what = 'close' OR verdict = 'entered' THEN NULL ELSE f END,
             CASE WHEN what = 'close' OR verdict = 'entered' THEN NULL ELSE b END,
             CASE WHEN what = 'close' THEN direction ELSE sd END, CASE WHEN what = 'close' THEN bar_idx ELSE sb END,
             bar_idx, d, f, CASE WHEN what = 'match' THEN verdict END
      FROM (SELECT *, CASE WHEN sd = d AND bar_idx - sb < 5 THEN 'shut' WHEN passed THEN 'entered' ELSE 'waits' END AS verdict
            FROM (SELECT n.symbol, n.i, n.what, n.bar_idx, n.direction, n.passed, s.sd, s.sb,
                         CASE WHEN s.cb IS NULL OR n.bar_idx > s.cb + 5 THEN n.direction ELSE s.cd END AS d,
                         CASE WHEN s.cb IS NULL OR n.bar_idx > s.cb + 5 THEN n.fingerprint ELSE s.cf END AS f,
                         CASE WHEN s.cb IS NULL OR n.bar_idx > s.cb + 5 THEN n.bar_idx ELSE s.cb END AS b
                  FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1)))
SELECT symbol, bar_idx, od AS direction, ofp AS fingerprint, verdict FROM s WHERE verdict IS NOT NULL"""


@query("WITH RECURSIVE " + sql.TICK_BARS + _LOG)
def candidate_locks(spark, sf_dir):
    """Every bar matches in the way it went; the gates pass where it went on from the bar before; bars
    that moved by over 0.4 percent close a position against them."""
    b = bars(spark, sf_dir)
    log = b.selectExpr(
        "symbol",
        "ts",
        "bar_idx",
        "close >= open AS up",
        "lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) AS before",
        "lag(high - low) OVER (PARTITION BY symbol ORDER BY bar_idx) AS width",
        "high - low AS range",
        "close",
        "abs(close - open) / open > 0.004D AS far",
    ).where("before IS NOT NULL")
    matches = log.selectExpr(
        "symbol",
        "ts",
        "0 AS ord",
        "'match' AS what",
        "bar_idx",
        "IF(up, 'long', 'short') AS direction",
        "IF(range > width, 'wide', 'narrow') AS fingerprint",
        "IF(up, close > before, close < before) AS passed",
    )
    closes = log.where("far").selectExpr(
        "symbol", "ts", "1 AS ord", "'close' AS what", "bar_idx", "IF(up, 'short', 'long') AS direction", "CAST(NULL AS string) AS fingerprint", "CAST(NULL AS boolean) AS passed"
    )
    found = finished(trackers.entries(*replayed(stored(matches.unionByName(closes)))))
    return found.select("symbol", "bar_idx", "direction", "fingerprint", "verdict")
