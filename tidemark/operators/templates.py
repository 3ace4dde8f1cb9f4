"""Trajectories of trades as templates, their prototypes, and matching of windows against them.

A vector table has (symbol, bar_idx, v), v an array of doubles of one length throughout.  A
trajectory is the array of a stretch's vectors in order of bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch, stored

PRE, POST, LEAST_PROFIT = 60, 30, 0.5
BULLS, BEARS = ("STRONG_BULL", "WEAK_BULL", "RANGE_BULL"), ("STRONG_BEAR", "WEAK_BEAR", "RANGE_BEAR")
#: Shares of cosine, distance and warping in the fused score, and the distance's bound.
COSINE, DISTANCE, WARPING, FARTHEST = 0.30, 0.40, 0.30, 200.0
#: Shares of win rate, stability, sample size and purity in the confidence.
CONFIDENCE = (0.40, 0.30, 0.20, 0.10)
FULL_SAMPLE, STD_BASE = 10, 0.15
#: Prototypes that a round settles in the driver, and pairs that a task compares at once.
ROUND, SLAB = 4096, 1 << 18
LEVELS = (("HIGH", 0.70), ("MEDIUM", 0.50), ("LOW", 0.30))


# --- extraction


def extract(trades: DataFrame, vectors: DataFrame, pre: int = PRE, post: int = POST, least: float = LEAST_PROFIT) -> DataFrame:
    """symbol, entry_idx, exit_idx, direction, regime, profit_pct and the trajectories before the entry
    (pre bars), while held, and before the exit (the last post bars held), of trades that gain `least`
    percent and have pre bars before them.

    An unknown regime becomes the sideways one of the trade's side.  A trade asks for its own bars by
    equality, so that bars are joined once for each trade they belong to.
    """
    side = F.upper("side")
    named = F.when(F.coalesce("regime", F.lit("UNKNOWN")) != "UNKNOWN", F.col("regime")).when(side == "LONG", "RANGE_BULL").otherwise("RANGE_BEAR")
    fit = trades.where((F.col("profit_pct") >= least) & (F.col("entry_idx") >= pre))
    keys = ["symbol", "entry_idx", "exit_idx", "direction", "regime", "profit_pct"]
    asked = fit.select(
        "symbol",
        "entry_idx",
        "exit_idx",
        side.alias("direction"),
        named.alias("regime"),
        "profit_pct",
        F.explode(F.sequence(F.col("entry_idx") - pre, F.col("exit_idx"))).alias("bar_idx"),
    )
    whole = asked.join(vectors.select("symbol", "bar_idx", "v"), ["symbol", "bar_idx"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bar_idx", "v"))).alias("l"))
    part = lambda begin, end: F.transform(F.filter("l", lambda x: (x["bar_idx"] >= begin) & (x["bar_idx"] < end)), lambda x: x["v"])
    entry, exit_ = F.col("entry_idx"), F.col("exit_idx")
    return whole.select(
        *keys,
        part(entry - pre, entry).alias("pre"),
        part(entry, exit_ + 1).alias("held"),
        part(F.greatest(entry, exit_ - post + 1), exit_ + 1).alias("post"),
    )


def windows(vectors: DataFrame, spans: DataFrame) -> DataFrame:
    """spans(symbol, first, last) with matrix: the vectors of the bars first <= bar_idx < last."""
    asked = spans.withColumn("bar_idx", F.explode(F.sequence(F.col("first"), F.col("last") - 1)))
    lists = asked.join(vectors, ["symbol", "bar_idx"]).groupBy("symbol", "first", "last").agg(F.array_sort(F.collect_list(F.struct("bar_idx", "v"))).alias("l"))
    return lists.select("symbol", "first", "last", F.transform("l", lambda x: x["v"]).alias("matrix"))


def with_fingerprint(templates: DataFrame) -> DataFrame:
    """fingerprint: equal for equal regime, direction, profit and trajectory before the entry, the same
    in every process."""
    return templates.withColumn("fingerprint", F.sha2(F.to_json(F.struct("regime", "direction", "profit_pct", "pre")), 256))


def verdict(matrix: str, length: int, width: int) -> Column:
    """OK, or the first thing wrong with a trajectory."""
    m = F.col(matrix)
    missing = F.exists(m, lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    zeros = F.size(F.filter(m, lambda v: ~F.exists(v, lambda x: x != 0)))
    return (
        F.when(m.isNull(), "MISSING").when(F.size(m) == 0, "EMPTY").when(F.exists(m, lambda v: F.size(v) != width), "WIDTH").when(F.size(m) != length, "LENGTH")
        .when(missing, "NAN").when(zeros > F.size(m) * 0.5, "ZERO_ROWS").otherwise("OK")
    )


def joined_memories(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both memories' templates, those of one fingerprint once."""
    return first.unionByName(second).dropDuplicates(["fingerprint"])


def keep(templates: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The templates of the given fingerprints, all of a repeated one; null is nobody's."""
    return templates.join(fingerprints.select("fingerprint"), "fingerprint", "left_semi")


def remove(templates: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The templates of no given fingerprint, those without any among them."""
    return templates.join(fingerprints.select("fingerprint"), "fingerprint", "left_anti")


def memory_stats(templates: DataFrame) -> DataFrame:
    """Templates and profits by regime and direction, with totals (null) of either and of all."""
    return templates.cube("regime", "direction").agg(F.count("*").alias("n"), F.avg("profit_pct").alias("avg_profit"), F.max("profit_pct").alias("max_profit"))


def candidates(templates: DataFrame, entry_idx_after: int = 0, least: float = LEAST_PROFIT) -> DataFrame:
    """What an incremental training takes up: new templates of enough profit whose regime fits their
    direction, and how many of each there are."""
    fits = F.when(F.col("regime").isin(*BULLS), "LONG").when(F.col("regime").isin(*BEARS), "SHORT") == F.col("direction")
    return templates.where((F.col("entry_idx") > entry_idx_after) & (F.col("profit_pct") >= least) & fits).groupBy("direction", "regime").agg(F.count("*").alias("n"), F.avg("profit_pct").alias("avg_profit"))


# --- numbers of a trajectory


def by_place(rows: DataFrame, matrix: str, *keys: str) -> DataFrame:
    """keys, feature (place in the vector), t (row of the trajectory), x."""
    each = rows.select(*keys, F.posexplode(matrix).alias("t", "v"))
    return each.select(*keys, "t", F.posexplode("v").alias("feature", "x"))


def sequence_features(rows: DataFrame, matrix: str, *keys: str) -> DataFrame:
    """Mean, population deviation, extremes, ends, range, normalised slope and the means of the three
    thirds of each feature of a trajectory."""
    flat = by_place(rows.withColumn("n", F.size(matrix)), matrix, *keys, "n")
    third = F.expr("least(2, t * 3 div n)")
    x = F.col("x")
    spread = F.when(F.stddev_pop("x") < 1e-9, 1.0).otherwise(F.stddev_pop("x"))
    found = flat.withColumn("third", third).groupBy(*keys, "feature").agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.min_by(x, "t").alias("first"), F.max_by(x, "t").alias("last"),
        F.coalesce(F.regr_slope(x, F.col("t")) / spread, F.lit(0.0)).alias("trend"), *[F.avg(F.when(F.col("third") == i, x)).alias(n) for i, n in enumerate(("early", "middle", "late"))],
    )
    return found.withColumn("range", F.col("max") - F.col("min"))


def _mean(matrix: str) -> Column:
    return F.expr(f"transform(sequence(0, size({matrix}[0]) - 1), i -> aggregate({matrix}, 0e0, (a, v) -> a + v[i]) / size({matrix}))")


def summaries(templates: DataFrame) -> DataFrame:
    """With summary: means before the entry, means and deviations while held, means before the exit,
    bars held / 200 and profit / 10."""
    t = templates.withColumns({"m_pre": _mean("pre"), "m_held": _mean("held"), "m_post": _mean("post")})
    std = "transform(m_held, (m, i) -> sqrt(aggregate(held, 0e0, (a, v) -> a + (v[i] - m) * (v[i] - m)) / size(held)))"
    t = t.withColumn("s_held", F.expr(std))
    return t.withColumn(
        "summary",
        F.concat("m_pre", "m_held", "s_held", "m_post", F.array(F.size("held") / 200.0, F.col("profit_pct") / 10.0)),
    ).drop("m_pre", "m_held", "s_held", "m_post")


# --- prototypes


def clustered(templates: DataFrame, k: int = 30, seed: int = 42) -> DataFrame:
    """With cluster, by k-means on summaries within each direction and regime (a fixed, small domain);
    groups of at most k are their own clusters."""
    rows = stored(summaries(templates) if "summary" not in templates.columns else templates)
    sizes = rows.groupBy("direction", "regime").agg(F.count("*").alias("n")).collect()  # at most 14 rows
    parts = []
    for r in sizes:
        group = rows.where((F.col("direction") == r["direction"]) & (F.col("regime") == r["regime"]))
        if r["n"] <= k:
            order = Window.partitionBy("direction", "regime").orderBy("symbol", "entry_idx", "exit_idx")
            parts.append(group.withColumn("cluster", F.row_number().over(order) - 1))
        else:
            vectors = group.withColumn("__features", array_to_vector("summary"))
            model = KMeans(k=k, seed=seed, maxIter=100, featuresCol="__features", predictionCol="cluster").fit(vectors)
            parts.append(model.transform(vectors).drop("__features"))
    out = parts[0] if parts else rows.withColumn("cluster", F.lit(0))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prototypes(members: DataFrame, least: int = 3) -> DataFrame:
    """One row for each (direction, regime, cluster) of `least` members(summary, profit_pct, held_bars,
    fingerprint, member_regime) or more: centroid, statistics, confidence, representative."""
    keys = ["direction", "regime", "cluster"]
    centre = members.select(*keys, F.posexplode("summary").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    centre = centre.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l")).select(*keys, F.transform("l", lambda p: p["x"]).alias("centroid"))
    apart = F.sqrt(F.aggregate(F.zip_with("summary", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    table = members.join(centre, keys).withColumn("apart", apart)
    purity = table.groupBy(*keys, "member_regime").agg(F.count("*").alias("c")).groupBy(*keys).agg((F.max("c") / F.sum("c")).alias("purity"))
    p = F.col("profit_pct")
    found = table.groupBy(*keys).agg(
        F.first("centroid").alias("centroid"), F.count("*").alias("members"), F.sum((p > 0).cast("long")).alias("wins"), F.sum(p).alias("total_profit"), F.avg(p).alias("avg_profit"),
        F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("profit_std"), F.avg("held_bars").alias("avg_hold"), F.min_by(
            "fingerprint",
            F.struct("apart", "fingerprint"),
        ).alias("representative"),
    )
    found = found.where(F.col("members") >= least).join(purity, keys).withColumn("win_rate", F.col("wins") / F.col("members"))
    return found.withColumn("confidence", confidence()).withColumn("level", level("confidence"))


def confidence() -> Column:
    """From win_rate, profit_std, members and purity, 0 to 1."""
    steady = 1 - F.least(F.col("profit_std") / STD_BASE, F.lit(1.0))
    parts = (F.col("win_rate"), steady, F.least(F.col("members") / FULL_SAMPLE, F.lit(1.0)), F.col("purity"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((w * x for w, x in zip(CONFIDENCE, parts, strict=True)), F.lit(0.0))))


def level(score: str) -> Column:
    out = None
    for name, least in LEVELS:
        out = F.when(F.col(score) >= least, name) if out is None else out.when(F.col(score) >= least, name)
    return out.otherwise("VERY_LOW")


def confidence_stats(protos: DataFrame) -> DataFrame:
    """Counts by level and the mean confidence, over all (direction null) and by direction."""
    of = lambda n: F.sum((F.col("level") == n).cast("long")).alias(n.lower())
    return protos.rollup("direction").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), *[of(n) for n, _ in LEVELS], of("VERY_LOW"))


def apart_prototypes(protos: DataFrame, key: str, vector: str, least: float = 0.98) -> DataFrame:
    """Within each direction and regime the prototypes without those whose cosine with a better kept
    one is `least` or more, better being more confident, then larger, then more profitable, then first;
    with absorbed, how many went into each.

    Taken in rounds: the first ROUND prototypes of all that are open are settled one by one, and the
    tasks then settle in one pass whatever is near to one of those kept.  One that an earlier round has
    kept would have taken it before, so that each goes to the first near one.  Null vectors, those that
    hold a null and those of another length are near to nothing.
    """
    spark, whole = protos.sparkSession, F.col(vector).cast("array<double>")
    base = stored(
        protos.select(
            "direction",
            "regime",
            key,
            F.to_json(F.struct("direction", "regime")).alias("__group"),
            (-F.col("confidence")).alias("__a"),
            (-F.col("members")).alias("__b"),
            (-F.col("avg_profit")).alias("__c"),
            F.when(~F.exists(whole, lambda x: x.isNull()), whole).alias("__v"),
            F.monotonically_increasing_id().alias("__id"),
        )
    )
    names, path = ["__group", "__a", "__b", "__c", key, "__v", "__id"], scratch(spark)
    left, counts = base.select(names), "__id long, n int"
    spark.createDataFrame([], counts).write.parquet(path)
    while first := left.orderBy(*names[1:]).limit(ROUND).collect():
        kept, taken = _settled(first, least)
        spark.createDataFrame([(i, n) for i, n in taken.items()], counts).write.mode("append").parquet(path)
        if len(first) < ROUND:
            break
        by = F.pandas_udf(_taking(kept, {r["__id"] for r in first}, least), "long")
        marked = stored(left.withColumn("__by", by("__group", "__v", "__id")))
        marked.where("__by >= 0").groupBy(F.col("__by").alias("__id")).agg(F.count("*").cast("int").alias("n")).write.mode("append").parquet(path)
        left = marked.where("__by IS NULL").select(names)
    absorbed = spark.read.schema(counts).parquet(path).groupBy("__id").agg(F.sum("n").cast("int").alias("absorbed"))
    return base.join(absorbed, "__id").select("direction", "regime", key, "absorbed")


def _total(products: np.ndarray) -> np.ndarray:
    """Sums of rows in the order of their terms."""
    return np.add.accumulate(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def _near(x: np.ndarray, y: np.ndarray, y_norms: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of x have a cosine of `least` or more with rows of y, what is no number counting as
    more; pairs at the edge are summed in the order of their terms."""
    with np.errstate(all="ignore"):
        norms = np.sqrt(_total(x * x))
        dot, bound = x @ y.T, least * y_norms * norms[:, None]
        near = np.isnan(dot) | (dot >= bound)
        i, j = np.nonzero(~(np.abs(dot - bound) > 1e-9 * y_norms * norms[:, None]))
        for begin in range(0, len(i), 4096):
            p, q = i[begin : begin + 4096], j[begin : begin + 4096]
            dots = _total(y[q] * x[p])
            near[p, q] = np.isnan(dots) | (dots >= least * y_norms[q] * norms[p])
    return near


def _settled(first: list, least: float) -> tuple[dict, dict]:
    """By group and length the ids, vectors and norms of those of first that are kept, in order, and by
    the id of each kept one how many of first it takes."""
    held: dict = {}
    taken: dict = {}
    for r in first:
        if r["__v"] is not None:
            v = np.array([r["__v"]])
            ids, vectors, norms = group = held.setdefault((r["__group"], v.shape[1]), [[], np.empty((16, v.shape[1])), np.empty(16)])
            n = len(ids)
            near = np.flatnonzero(_near(v, vectors[:n], norms[:n], least)[0])
            if len(near):
                taken[ids[near[0]]] += 1
                continue
            if n == len(vectors):
                group[1:] = vectors, norms = np.concatenate([vectors, vectors]), np.concatenate([norms, norms])
            ids.append(r["__id"])
            vectors[n], norms[n] = v[0], np.sqrt(_total(v * v))[0]
        taken[r["__id"]] = 0
    return {g: (np.array(ids), vectors[: len(ids)], norms[: len(ids)]) for g, (ids, vectors, norms) in held.items()}, taken


def _taking(kept: dict, settled: set, least: float):
    """For rows the id of the first kept one that is near, -1 for settled rows, else null."""

    def taken_by(group: pd.Series, vector: pd.Series, ids: pd.Series) -> pd.Series:
        by = np.full(len(ids), None, dtype=object)
        sizes = vector.map(lambda v: -1 if v is None else len(v))
        for one, at in pd.Series(range(len(ids))).groupby([group.to_numpy(), sizes.to_numpy()]).indices.items():
            if one not in kept:
                continue
            keys, vectors, norms = kept[one]
            for part in np.array_split(at, -(-len(at) * len(keys) // SLAB)):
                near = _near(np.stack([np.asarray(v, float) for v in vector.iloc[part]]), vectors, norms, least)
                found = near.any(axis=1)
                by[part[found]] = keys[near[found].argmax(axis=1)]
        by[ids.isin(settled).to_numpy()] = -1
        return pd.Series(pd.array(by, dtype="Int64"))

    return taken_by


#: Fixed value: confidences no further apart are taken as equal.
CONFIDENCE_TOLERANCE = 0.1


def _maybe_alike(vectors: list[np.ndarray], least: float):
    """For i the later places, in order, whose vectors are of its width and may have a cosine of `least`
    or more with it: all but those that are clearly below, found for a whole row at once."""
    widths = np.array([len(v) for v in vectors], int)
    of = {w: np.flatnonzero(widths == w) for w in set(widths.tolist()) - {0}}
    rows = {w: np.stack([vectors[i] for i in at]) for w, at in of.items()}
    norms = {w: np.linalg.norm(r, axis=1) for w, r in rows.items()}

    def found(i: int) -> list[int]:
        w = widths[i]
        if not w:
            return []
        first = np.searchsorted(of[w], i, side="right")
        with np.errstate(all="ignore"):
            norm = norms[w][first:] * np.linalg.norm(vectors[i])
            below = (rows[w][first:] @ vectors[i] < (least - 1e-9) * norm) & (norm > 1e-9)
        return of[w][first:][~below].tolist()

    return found


def merged_prototypes(protos: DataFrame, least: float = 0.98, finish_turn: bool = False) -> DataFrame:
    """proto_id, direction, regime, members, wins, total_profit, win_rate, avg_profit and merged (the ids
    that went in, sorted) of protos(proto_id, direction, regime, v, members, wins, total_profit,
    confidence) after those of one direction and regime with a cosine of `least` or more have been merged.

    Pairs come in order of proto_id.  The surer of two stays, by more than CONFIDENCE_TOLERANCE; else
    the larger; else the more profitable on average by then, the earlier one at a tie.  It takes over
    what the other counts, so that all counts together stay as they were.  With finish_turn, one that
    goes in its own turn still meets those after it, and counts are lost or taken twice.  Vectors that
    are null, empty or of unlike widths meet nobody, a vector of zeros has a cosine of 0; a null count
    is 0, a null confidence 0.

    A group is one task: it holds the prototypes of one direction and regime, as many as clusters.
    """
    keys = ["direction", "regime"]
    kinds = dict(protos.dtypes)
    ids = kinds["proto_id"]
    schema = f"proto_id {ids}, direction {kinds['direction']}, regime {kinds['regime']}, members long, wins long, total_profit double, win_rate double, avg_profit double, merged array<{ids}>"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("proto_id", ignore_index=True)
        vectors = [np.asarray(v, float) if v is not None else np.zeros(0) for v in rows["v"]]
        members, wins, total = (rows[c].fillna(0).tolist() for c in ("members", "wins", "total_profit"))
        sure = rows["confidence"].fillna(0.0).tolist()
        mean = [t / m if m else 0.0 for t, m in zip(total, members, strict=True)]
        gone: set[int] = set()
        merged: list[list] = [[] for _ in vectors]
        after = _maybe_alike(vectors, least)
        for i in range(len(vectors)):
            if i in gone:
                continue
            for j in after(i):
                if j in gone:
                    continue
                norm = float(np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j]))
                if (float(vectors[i] @ vectors[j]) / norm if norm > 1e-12 else 0.0) < least:
                    continue
                apart = abs(sure[i] - sure[j]) > CONFIDENCE_TOLERANCE
                order = (lambda x: sure[x]) if apart else (lambda x: (members[x], mean[x]))
                stays, goes = (i, j) if order(i) >= order(j) else (j, i)
                gone.add(goes)
                for counted in (members, wins, total):
                    counted[stays] += counted[goes]
                mean[stays] = total[stays] / members[stays] if members[stays] else mean[stays]
                merged[stays] += [rows["proto_id"][goes], *merged[goes]]
                if goes == i and not finish_turn:
                    break
        left = [i for i in range(len(vectors)) if i not in gone]
        of = lambda values: [values[i] for i in left]
        out = rows.loc[left, ["proto_id", *keys]].assign(members=[int(x) for x in of(members)], wins=[int(x) for x in of(wins)], total_profit=of(total), avg_profit=of(mean))
        return out.assign(win_rate=[w / m if m else 0.0 for w, m in zip(of(wins), of(members), strict=True)], merged=[sorted(x) for x in of(merged)])

    asked = protos.select("proto_id", *keys, "v", "members", "wins", "total_profit", "confidence")
    return asked.groupBy(*keys).applyInPandas(fold, schema)


# --- matching


def similarities(pairs: DataFrame, x: str, y: str, warping: Column | None = None) -> DataFrame:
    """pairs with cosine, distance and fused: the similarity of two vectors, each 0 to 1; without a
    warping similarity the other two weigh in proportion."""
    dot = lambda a, b: F.aggregate(
        F.zip_with(F.col(a), F.col(b), lambda p, q: p.cast("double") * q.cast("double")),
        F.lit(0.0),
        lambda s,
        z: s + z,
    )
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    cosine = F.when(norm < 1e-9, 0.0).otherwise(F.greatest(F.lit(0.0), dot(x, y) / norm))
    apart = F.sqrt(F.aggregate(F.zip_with(F.col(x), F.col(y), lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, z: s + z))
    bound = F.greatest(F.lit(FARTHEST), F.sqrt(F.size(x).cast("double")) * 20)
    out = pairs.withColumns({"cosine": cosine, "distance": 1 - F.least(F.lit(1.0), apart / bound)})
    if warping is None:
        return out.withColumn("fused", (COSINE * F.col("cosine") + DISTANCE * F.col("distance")) / (COSINE + DISTANCE))
    return out.withColumn("fused", COSINE * F.col("cosine") + DISTANCE * F.col("distance") + WARPING * warping)


def allowed_side(regime: str) -> Column:
    """The only direction that a bullish or bearish regime admits, else null."""
    return F.when(F.col(regime).isin(*BULLS), "LONG").when(F.col(regime).isin(*BEARS), "SHORT")


def matches(queries: DataFrame, protos: DataFrame, least: float = 0.5, details: int = 5) -> DataFrame:
    """For queries(query_id, regime, q): the best prototype(proto_id, direction, regime, v, confidence),
    its scores, the votes of either side at `least` or more, and the `details` best ones.

    Prototypes are those of the query's regime (all, where it is null) on the side that it admits; they
    are few and broadcast, their number being bounded by clusters, directions and regimes.
    """
    side = allowed_side("regime")
    asked = queries.withColumn("side", side)
    p = protos.select("proto_id", "direction", F.col("regime").alias("p_regime"), "v", "confidence")
    fits = (F.col("side").isNull() | (F.col("side") == F.col("direction"))) & (F.col("regime").isNull() | (F.col("regime") == F.col("p_regime")))
    scored = similarities(asked.join(F.broadcast(p), fits), "q", "v").withColumn("score", F.col("fused") * F.col("confidence"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "proto_id"))
    ranked = scored.withColumn("rank", rank)
    votes = lambda s: F.sum(((F.col("direction") == s) & (F.col("score") >= least)).cast("long"))
    best = F.max_by(F.struct("proto_id", "direction", "cosine", "distance", "score"), -F.col("rank"))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= details, F.struct("rank", "proto_id")))), lambda x: x["proto_id"])
    found = ranked.groupBy("query_id").agg(best.alias("b"), votes("LONG").alias("vote_long"), votes("SHORT").alias("vote_short"), top.alias("top"))
    total = F.col("vote_long") + F.col("vote_short")
    return found.select("query_id", "b.*", "vote_long", "vote_short", "top").withColumns({"vote_ratio": F.when(total > 0, F.col("vote_long") / total).otherwise(0.5), "matched": F.col("score") >= least})


def health(similarity: str, safe: float = 0.7, alert: float = 0.5, derail: float = 0.3) -> Column:
    s = F.col(similarity)
    return F.when(s >= safe, "SAFE").when(s >= alert, "ALERT").when(s >= derail, "DANGER").otherwise("DERAIL")


def rematches(held: DataFrame, gain: float = 0.15) -> DataFrame:
    """held(query_id, own_id, own_score, best_id, score): whether a position moves to the best
    prototype, which must beat its own by `gain`."""
    moves = (F.col("best_id") != F.col("own_id")) & (F.col("score") >= F.col("own_score") + gain)
    return held.withColumn("switched", moves).withColumn("kept_id", F.when(moves, F.col("best_id")).otherwise(F.col("own_id")))


# --- evaluation


def performances(templates: DataFrame, results: DataFrame, least: int = 3) -> DataFrame:
    """Every template with what results(fingerprint, profit_pct) say of it: counts, grade and score.

    Fewer than `least` matches are WATCHED; a positive mean profit is QUALIFIED, and GOOD from a score
    of 80 on; all else is ELIMINATED.  A template without results is PENDING.
    """
    p = F.col("profit_pct")
    seen = results.groupBy("fingerprint").agg(
        F.count("*").alias("matches"),
        F.sum((p > 0).cast("long")).alias("wins"),
        F.avg(p).alias("avg_profit"),
        F.max(p).alias("max_profit"),
        F.min(p).alias("max_loss"),
        F.sum(p).alias("total_profit"),
    )
    joined = templates.select("fingerprint").distinct().join(seen, "fingerprint", "left").fillna(
        0,
        ["matches", "wins", "avg_profit", "max_profit", "max_loss", "total_profit"],
    )
    rate = F.when(F.col("matches") > 0, F.col("wins") / F.col("matches")).otherwise(0.0)
    few, good = F.col("matches") < least, F.col("avg_profit") > 0
    bonus = F.least(F.lit(25.0), F.col("avg_profit") * 10) + F.least(
        F.lit(10.0),
        F.greatest(F.lit(0.0), F.col("win_rate") - 0.4) * 50,
    ) + F.least(F.lit(10.0), (F.col("matches") - least) * 2.0)
    low = F.greatest(F.lit(0.0), F.col("win_rate") * 30 + F.greatest(F.lit(0.0), F.col("avg_profit")) * 10)
    score = F.when(few, 20.0 + F.col("matches") * 5).when(good, F.least(F.lit(100.0), 60.0 + bonus)).otherwise(low)
    graded = joined.withColumn("win_rate", rate).withColumn("score", score)
    grade = F.when(F.col("matches") == 0, "PENDING").when(few, "WATCHED").when(
        good & (F.col("score") >= 80),
        "GOOD",
    ).when(good, "QUALIFIED").otherwise("ELIMINATED")
    return graded.withColumn("grade", grade)
