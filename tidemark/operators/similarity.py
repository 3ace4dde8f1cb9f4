"""Similarity of vectors and trajectories: exact top-k in blocks, votes, centroids, DTW."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch

MAX_QUERIES = 4096
#: Pairs of a query and a vector that a task holds scores of at once, and pairs scored exactly at once.
SLAB, EXACT = 1 << 18, 1 << 12
_LAST = np.iinfo(np.int64).max


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank of the k nearest other vectors of every query.

    Up to MAX_QUERIES queries are broadcast; every partition of the vectors keeps its own k best of
    each query, and only those are ranked together.  A matrix product over SLAB pairs at a time, with
    room for its last digits, says which of them can be among the best; these are scored term by term,
    so that equal vectors have equal scores wherever they stand, and go by id.  More queries go
    in blocks of about that many by the hash of their ids, one pass over the vectors for each, and
    the results are written to the shared folder: the driver holds one block at a time.
    """
    asked = queries.select(id_col, vec_col)
    held = asked.limit(MAX_QUERIES + 1).toPandas()
    if len(held) <= MAX_QUERIES:
        return _top_k(vectors, held, k, metric, id_col, vec_col)
    blocks, path = -(-asked.count() // MAX_QUERIES), scratch(vectors.sparkSession)
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == block).toPandas()
        found = _top_k(vectors, held, k, metric, id_col, vec_col)
        found.write.mode("append").parquet(path)
    return vectors.sparkSession.read.schema(found.schema).parquet(path)


def _top_k(vectors: DataFrame, held: pd.DataFrame, k: int, metric: str, id_col: str, vec_col: str) -> DataFrame:
    ids = held[id_col].to_numpy(np.int64)
    q = np.stack([np.asarray(v, np.float64) for v in held[vec_col]]) if len(held) else np.zeros((0, 1))
    found = vectors.select(id_col, vec_col).mapInPandas(_nearest(ids, q, k, metric, id_col, vec_col), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(ids: np.ndarray, q: np.ndarray, k: int, metric: str, id_col: str, vec_col: str):
    """What a task does: the k best of its vectors for each query."""
    square = np.einsum("ij,ij->i", q, q)
    wide = max(1, min(len(ids), SLAB // 64))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best_id, best_score = np.full((len(ids), k), _LAST), np.full((len(ids), k), -np.inf)
        for pdf in batches:
            for begin in range(0, len(pdf) if len(ids) else 0, SLAB // wide):
                part = pdf.iloc[begin : begin + SLAB // wide]
                v, own = np.stack([np.asarray(x, np.float64) for x in part[vec_col]]), part[id_col].to_numpy(np.int64)
                for a in range(0, len(ids), wide):
                    here = slice(a, a + wide)
                    at, col = _hopeful(q[here], square[here], v, ids[here, None] == own, best_score[here, -1], k, metric)
                    _merge(best_id, best_score, a + at, own[col], _scores(q, v, a + at, col, metric))
        held = best_id != _LAST
        yield pd.DataFrame({"query_id": np.repeat(ids, held.sum(1)), "id": best_id[held], "score": best_score[held]})

    return nearest


def _hopeful(q: np.ndarray, square: np.ndarray, v: np.ndarray, same: np.ndarray, least: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in q and v of the pairs, but those that are the same, whose score may be at least
    least[query], the k-th best so far; as long as there are no k, those that may be among the k best of v."""
    s, other = q @ v.T, np.einsum("ij,ij->i", v, v)
    if metric == "cosine":
        norms = np.sqrt(square[:, None] * other)
        s = np.divide(s, norms, out=np.zeros_like(s), where=norms > 0)
        room = 1e-9
    else:
        s *= 2
        s -= square[:, None]
        s -= other  # minus the squared distance, off by its last digits
        least, room = -(least**2), 1e-9 * (square[:, None] + other)
    if len(v) > k and np.isneginf(least).any():
        low = np.where(same, -np.inf, s - room)
        least = np.maximum(least, np.partition(low, len(v) - k, axis=1)[:, len(v) - k])
    return np.nonzero((s + room >= least[:, None]) & ~same)


def _scores(q: np.ndarray, v: np.ndarray, at: np.ndarray, col: np.ndarray, metric: str) -> np.ndarray:
    """Exact scores of q[at[i]] and v[col[i]], sums in the order of the terms."""
    out = np.empty(len(at))
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    for begin in range(0, len(at), EXACT):
        here = slice(begin, begin + EXACT)
        x, y = q[at[here]], v[col[here]]
        if metric == "cosine":
            norms = np.sqrt(total(x * x) * total(y * y))
            out[here] = np.clip(np.divide(total(x * y), norms, out=np.zeros(len(x)), where=norms > 0), -1, 1)
        else:
            out[here] = -np.sqrt(total((x - y) ** 2))
    return out


def _merge(best_id: np.ndarray, best_score: np.ndarray, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Puts pairs of query places `at` among the best, in place, ties to the least id."""
    places, k = np.unique(at), best_id.shape[1]
    rows = np.concatenate([np.repeat(places, k), at])
    ids, scores = np.concatenate([best_id[places].reshape(-1), ids]), np.concatenate([best_score[places].reshape(-1), scores])
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = nth < k
    best_id[rows[first], nth[first]], best_score[rows[first], nth[first]] = ids[first], scores[first]


def votes(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """The label with the greatest sum of similarities among each query's neighbours."""
    summed = neighbours.join(
        labels.select(F.col("vec_id").alias("id"), "label"),
        "id",
    ).groupBy("query_id", "label").agg(F.sum("score").alias("weight"), F.count("*").alias("n"))
    return summed.groupBy("query_id").agg(F.max_by("label", F.struct("weight", -F.col("label"))).alias("label"), F.max("weight").alias("weight"))


def centroids(vectors: DataFrame, key: str = "label", vec_col: str = "embedding") -> DataFrame:
    """key, n, centroid: means by place, summed before the shuffle."""
    places = vectors.select(key, F.posexplode(vec_col).alias("i", "x"))
    means = places.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def spread(vectors: DataFrame, key: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean distance of a key's vectors to their centroid."""
    c = centroids(vectors, key, vec_col)
    d = f"sqrt(aggregate(zip_with({vec_col}, centroid, (x, y) -> (x - y) * (x - y)), 0e0, (a, x) -> a + x))"
    joined = vectors.select(key, vec_col).join(c, key).selectExpr(key, "n", f"{d} AS d")
    return joined.groupBy(key).agg(F.max("n").alias("n"), F.greatest(F.avg("d"), F.lit(1e-9)).alias("spread"))


def nearest_centroid(vectors: DataFrame, key: str = "label", vec_col: str = "embedding") -> DataFrame:
    """vec_id and the key whose centroid has the greatest cosine; the centroids are one row a key."""
    c = F.broadcast(centroids(vectors, key, vec_col).agg(F.collect_list(F.struct(F.col(key).alias("key"), "centroid")).alias("cs")))
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0e0, (s, x) -> s + x)"
    scored = f"transform(cs, c -> struct({dot(vec_col, 'c.centroid')} / sqrt({dot('c.centroid', 'c.centroid')}) AS s, -c.key AS k))"
    return vectors.join(c).selectExpr("vec_id", key, f"-array_max({scored}).k AS nearest")


def dtw(a: np.ndarray, b: np.ndarray, radius: int = 10) -> float:
    """Dynamic time warping of two (steps, features) arrays under Euclidean cost, inside a band."""
    n, m = len(a), len(b)
    band = max(radius, abs(n - m))
    cost = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(n):
        new = np.full(m + 1, np.inf)
        lo, hi = max(0, i - band), min(m, i + band + 1)
        best = np.minimum(row[lo:hi], row[lo + 1 : hi + 1])
        left = np.inf
        for j, c in zip(range(lo, hi), cost[i, lo:hi], strict=True):
            left = c + min(best[j - lo], left)
            new[j + 1] = left
        row = new
    return float(row[m])


def _dtw_many(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """dtw of a[i] and b[i], arrays of (pairs, steps, features), all pairs side by side."""
    n, m = a.shape[1], b.shape[1]
    band = max(radius, abs(n - m))
    row = np.full((m + 1, len(a)), np.inf)
    row[0] = 0.0
    for i in range(n):
        new = np.full_like(row, np.inf)
        for j in range(max(0, i - band), min(m, i + band + 1)):
            new[j + 1] = np.sqrt(((a[:, i] - b[:, j]) ** 2).sum(1)) + np.minimum(np.minimum(row[j], row[j + 1]), new[j])
        row = new
    return row[m]


def dtw_pairs(pairs: DataFrame, radius: int = 10) -> DataFrame:
    """pairs with dtw over columns x and y, arrays of feature arrays; scaled to 0 (equal) to 1."""

    def scaled(x: pd.Series, y: pd.Series) -> pd.Series:
        out, alike = np.zeros(len(x)), {}
        for i, (a, b) in enumerate(zip(x, y, strict=True)):
            alike.setdefault((len(a), len(b)), []).append(i)
        stacked = lambda s, at: np.stack([np.stack([np.asarray(r, float) for r in s.iloc[i]]) for i in at])
        for (n, m), at in alike.items():
            p, q = stacked(x, at), stacked(y, at)
            d = _dtw_many(p, q, radius) / (max(n, m) * np.sqrt(p.shape[2]) * 2)
            out[at] = np.where(d < 1.0, d, 1.0)
        return pd.Series(out)

    return pairs.withColumn("dtw", F.pandas_udf(scaled, "double")("x", "y"))
