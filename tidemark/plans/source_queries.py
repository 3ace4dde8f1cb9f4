"""Bar files, feeds and versioned tables written and read again, and smaller studies over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch, stored
from tidemark.operators import indicators as ind
from tidemark.operators import studies
from tidemark.operators import swings as swing
from tidemark.plans import sql
from tidemark.plans.registry import query, rounded, table
from tidemark.sources import bars as src
from tidemark.sources import documents, paged, tables

_OHLCV = ["open", "high", "low", "close", "volume"]


@query(sql.with_bars(f"SELECT symbol, bar_idx, ts, {sql.rounded(_OHLCV)} FROM bars"))
def bar_files(spark, sf_dir):
    """Bars written by symbol, under other spellings of their columns, found behind a missing path, and
    numbered anew."""
    b, path = src.bars_from_ticks(spark, sf_dir), scratch(spark)
    src.write(
        b.select("symbol", F.col("ts").alias("Open_Time"), F.col("open").cast("string").alias("O"), F.col("high").alias("High"), F.col("low").alias("L"), F.col("close").alias("CLOSE"), F.col("volume").alias("vol")),
        path,
    )
    return rounded(src.scan(spark, f"{path}-missing", path), ["symbol", "bar_idx", "ts"], _OHLCV)


@query(sql.with_bars("SELECT ts, round(open, 6) AS open, round(close, 6) AS close, volume, epoch_ms(ts) + 3600000 <= epoch_ms(TIMESTAMP '2024-01-20') AS is_closed FROM bars"))
def rest_klines(spark, sf_dir):
    b = src.bars_from_ticks(spark, sf_dir)
    at, text = F.unix_millis(F.col("ts").cast("timestamp")), lambda c: F.round(c, 6).cast("string")
    lines = b.select(F.to_json(F.array(at.cast("string"), *[text(c) for c in _OHLCV], (at + 3_600_000).cast("string"))).alias("value"))
    return src.parse_rest(lines, 1_705_708_800_000).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "close", "volume", "is_closed")


@query("SELECT s_suppkey AS key, s_nationkey::BIGINT AS members, CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE END AS confidence FROM supplier WHERE s_suppkey % 2 = 0")
def library_versions(spark, sf_dir):
    """A library saved by an old and a new version of its columns; the newest is read by today's."""
    s, path = table(spark, sf_dir, "supplier"), scratch(spark)
    tables.save(s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("label")), path, 1)
    tables.save(
        s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("members"), F.lit(0.5).alias("confidence")),
        path,
        2,
    )
    return tables.load(spark, path, "key bigint, members bigint, confidence double")


_KDJ = (
    "WITH RECURSIVE " + sql.TICK_BARS + """, rv AS MATERIALIZED (SELECT symbol, bar_idx, CASE WHEN bar_idx >= 8 AND hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END AS rsv FROM
(SELECT symbol, bar_idx, close, min(low) OVER w AS lo, max(high) OVER w AS hi FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))),
e AS (SELECT symbol, bar_idx, rsv::DOUBLE AS k, rsv::DOUBLE AS d FROM rv WHERE bar_idx = 0 UNION ALL SELECT r.symbol, r.bar_idx, (r.rsv + e.k) / 2, ((r.rsv + e.k) / 2 + e.d) / 2 FROM e JOIN rv r ON r.symbol = e.symbol AND r.bar_idx = e.bar_idx + 1)"""
)


@query(_KDJ + " SELECT symbol, bar_idx, round(k, 5) AS k, round(d, 5) AS d, round(3 * k - 2 * d, 5) + 0.0 AS j FROM e")
def kdj_variant(spark, sf_dir):
    return rounded(ind.kdj_variant(src.bars_from_ticks(spark, sf_dir)), ["symbol", "bar_idx"], ["k", "d", "j"], 5)


@query(
    _KDJ
    + """, f AS (SELECT symbol, bar_idx, close, max(high) OVER a AS top, min(low) OVER a AS bottom, count(*) OVER a AS n, last_value(close) OVER a AS last FROM bars
  WINDOW a AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)),
x AS (SELECT symbol, bar_idx, k > d AND lag(k) OVER w < lag(d) OVER w AS crossed FROM e WINDOW w AS (PARTITION BY symbol ORDER BY bar_idx))
SELECT symbol, count(*) AS n, sum((outcome > 0)::INT)::BIGINT AS wins, round(avg(outcome), 6) + 0.0 AS avg_outcome, round(max(outcome), 6) + 0.0 AS best, round(min(outcome), 6) + 0.0 AS worst
FROM (SELECT symbol, CASE WHEN (top / close - 1) * 100 >= 1 THEN 1.0 WHEN (bottom / close - 1) * 100 <= -0.5 THEN -0.5 ELSE (last / close - 1) * 100 END AS outcome FROM x JOIN f USING (symbol, bar_idx) WHERE crossed AND n = 30) GROUP BY symbol"""
)
def kdj_cross_study(spark, sf_dir):
    """Crossings of the study's own stochastic (J over D is K over D), and what came of them."""
    bars = stored(src.bars_from_ticks(spark, sf_dir))
    marked = bars.join(ind.kdj_variant(bars).select("symbol", "bar_idx", "crossed"), ["symbol", "bar_idx"])
    o = F.col("outcome")
    found = studies.crossings(marked).groupBy("symbol").agg(F.count("*").alias("n"), F.sum((o > 0).cast("long")).alias("wins"), F.avg(o).alias("avg_outcome"), F.max(o).alias("best"), F.min(o).alias("worst"))
    return rounded(found, ["symbol", "n", "wins"], ["avg_outcome", "best", "worst"])


@query(
    sql.with_bars(
        """, s AS (SELECT symbol, bar_idx, high >= max(high) OVER n AS is_high, low <= min(low) OVER n AS is_low, count(*) OVER n AS c FROM bars WINDOW n AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
p AS (SELECT symbol, bar_idx, is_high, lag(is_high) OVER (PARTITION BY symbol ORDER BY bar_idx) AS g FROM s WHERE c = 11 AND (is_high OR is_low)) SELECT symbol, bar_idx, is_high FROM p WHERE g IS NULL OR g <> is_high"""
    )
)
def first_of_runs(spark, sf_dir):
    return swing.first_of_runs(swing.swing_points(src.bars_from_ticks(spark, sf_dir))).select("symbol", "bar_idx", "is_high")


@query(
    sql.with_bars(
        """, n AS (SELECT symbol, n, greatest(n - 500, 0) AS a, n - floor((n - greatest(n - 500, 0)) * 0.3)::BIGINT AS c FROM (SELECT symbol, max(bar_idx) + 1 AS n FROM bars GROUP BY symbol))
SELECT symbol, 'fold ' || i AS part, a + (i - 1) * ((c - a) // 3) AS first, CASE WHEN i = 3 THEN c ELSE a + i * ((c - a) // 3) END - 1 AS last FROM n, (SELECT unnest([1, 2, 3]) AS i) UNION ALL SELECT symbol, 'holdout', c, n - 1 FROM n"""
    )
)
def holdout_ranges(spark, sf_dir):
    return studies.holdout_ranges(src.bars_from_ticks(spark, sf_dir), 500)


HOUR_MS, PAGE_MS = 3_600_000, 48 * 3_600_000


@query(sql.with_bars(f"SELECT symbol, ts, {sql.rounded(_OHLCV)} FROM bars"))
def paged_bars(spark, sf_dir):
    """Bars recorded as pages, some of which answer only at the third attempt, and read back."""
    path = scratch(spark)
    paged.record(src.bars_from_ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), path, PAGE_MS, HOUR_MS, fails=5)
    paged.register(spark)
    found = paged.standard(spark.read.format("paged_bars").option("path", path).load())
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["symbol", "ts"], _OHLCV)


@query(sql.with_bars(f"SELECT symbol, ts, {sql.rounded(_OHLCV)} FROM bars"))
def paged_stream(spark, sf_dir):
    """The same pages as a stream: every third page comes late, when the stream has read those around
    it, and the stream goes on from its checkpoint."""
    path, out, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    bars = src.bars_from_ticks(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    paged.register(spark)
    late = F.expr(f"unix_millis(ts) div {PAGE_MS} % 3 = 0")
    for part in (bars.where(~late), bars.where(late)):
        paged.record(part, path, PAGE_MS, HOUR_MS, fails=4)
        stream = spark.readStream.format("paged_bars").options(path=path, pageMillis=PAGE_MS).load()
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()
    found = paged.standard(spark.read.schema(paged.SCHEMA).parquet(out))
    return rounded(found.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["symbol", "ts"], _OHLCV)


_ENCODINGS = ("utf-8", "utf-8-sig", "utf-16", "utf-16-be")


@query(
    """SELECT n_nationkey::BIGINT AS nation, n_name AS name, coalesce(suppliers, 0) AS suppliers, balance,
['UTF-8', 'UTF-8', 'UTF-16LE', 'UTF-16BE'][1 + n_nationkey % 4] AS encoding FROM nation LEFT JOIN
(SELECT s_nationkey, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier GROUP BY ALL) ON s_nationkey = n_nationkey"""
)
def encoded_documents(spark, sf_dir):
    """A JSON document a nation with its suppliers, in four encodings, read as one table."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).alias("s"))
    nations = table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.collect_list("s").alias("suppliers"))
    texts, path = nations.select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"), "suppliers")).alias("text")), scratch(spark)

    def write(rows) -> None:
        from pyarrow import fs

        for r in rows:
            where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            where.create_dir(root, recursive=True)
            with where.open_output_stream(f"{root}/{r['n_nationkey']}.json") as f:
                f.write(r["text"].encode(_ENCODINGS[r["n_nationkey"] % 4]))

    texts.foreachPartition(write)
    found = documents.json_documents(spark, path, "nation bigint, name string, suppliers array<struct<name: string, balance: double>>")
    sums = F.expr("aggregate(document.suppliers, 0D, (a, x) -> a + x.balance)")
    return found.select(
        "document.nation",
        "document.name",
        F.size("document.suppliers").cast("long").alias("suppliers"),
        F.when(F.size("document.suppliers") > 0, F.round(sums, 2)).alias("balance"),
        "encoding",
    )
