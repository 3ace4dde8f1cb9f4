"""Nearest references by dynamic time warping under a lower bound, scores on held-out bars, and samples
of pairs that no one has to form.

A matrix is an array of steps, each an array of `width` doubles.  Matrices that are null, empty, of
another width, or hold a null or NaN are out: such windows get no rows, such references are never met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import scratch, stored
from tidemark.operators import similarity as sim
from tidemark.operators import templates as tpl

#: What a task holds of the references at once, their envelopes included, and of stacked pairs.
REFERENCE_BYTES, STACK_BYTES = 48 << 20, 32 << 20


def usable(matrix: str, width: int) -> Column:
    bad = f"exists({matrix}, v -> v IS NULL OR size(v) <> {width} OR exists(v, e -> e IS NULL OR isnan(e)))"
    return F.expr(f"{matrix} IS NOT NULL AND size({matrix}) > 0 AND NOT coalesce({bad}, true)")


def envelope(reference: np.ndarray, steps: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest values that each of `steps` steps of a window can meet in its band."""
    m = len(reference)
    band = max(radius, abs(steps - m))
    spans = [(max(0, i - band), min(m, i + band + 1)) for i in range(steps)]
    return np.stack([reference[a:b].min(0) for a, b in spans]), np.stack([reference[a:b].max(0) for a, b in spans])


def _bounds(windows: np.ndarray, envelopes: list) -> np.ndarray:
    """For windows (q, n, d) and each reference's envelope: every step costs its distance to the box."""
    out = np.empty((len(windows), len(envelopes)))
    for r, (low, high) in enumerate(envelopes):
        gap = np.maximum(np.maximum(low - windows, windows - high), 0.0)
        out[:, r] = np.sqrt((gap**2).sum(-1)).sum(-1)
    return out


def _warped(windows: np.ndarray, references: list, at: np.ndarray, to: np.ndarray, radius: int) -> np.ndarray:
    """Distances of windows[at[i]] and references[to[i]], those of one length side by side."""
    out, sizes = np.empty(len(at)), np.array([len(references[r]) for r in to])
    for size in np.unique(sizes):
        mine = np.flatnonzero(sizes == size)
        each = max(1, STACK_BYTES // (8 * (windows.shape[1] + int(size)) * windows.shape[2]))
        for part in np.array_split(mine, -(-len(mine) // each)):
            out[part] = sim._dtw_many(windows[at[part]], np.stack([references[r] for r in to[part]]), radius)
    return out


def search(windows: np.ndarray, references: list, k: int, radius: int, envelopes: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances and places (q, k) of the k nearest references, ties to the first, and how many
    references each window was warped with.

    References come in the order of their bounds; one whose bound is over the k-th distance so far is
    out, and so are all after it.
    """
    n, k = len(windows), min(k, len(references))
    if envelopes is None:
        envelopes = [envelope(r, windows.shape[1], radius) for r in references]
    bound = _bounds(windows, envelopes)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    best, place, tried = np.full((n, k), np.inf), np.full((n, k), len(references)), np.zeros(n, np.int64)
    begin = 0
    while begin < len(references):
        end = min(begin + max(4, k), len(references))
        # A bound and a distance are sums in different orders: leave room for their last digits.
        open_ = bound[:, begin:end] <= best[:, -1:] * (1 + 1e-9) + 1e-12
        if not open_.any():
            break
        at, col = np.nonzero(open_)
        d = np.full(open_.shape, np.inf)
        d[at, col] = _warped(windows, references, at, order[at, begin + col], radius)
        tried += open_.sum(1)
        d, p = np.hstack([best, d]), np.hstack([place, np.where(open_, order[:, begin:end], len(references))])
        first = np.lexsort((p, d), axis=-1)[:, :k]
        best, place = np.take_along_axis(d, first, 1), np.take_along_axis(p, first, 1)
        begin = end
    return best, place, tried


def nearest(windows: DataFrame, references: DataFrame, width: int, k: int = 3, radius: int = 10) -> DataFrame:
    """query_id, ref_id, distance, rank, warped: for each of windows(query_id, x) the k nearest of
    references(ref_id, y) by warping, exactly, ties to the least ref_id; warped counts the references
    whose matrix had to be filled.

    Windows stay where they are.  References travel to every task, as many at a time as
    REFERENCE_BYTES hold; more of them go in blocks by the hash of their ids, each block one pass over
    the windows, and the k best of the blocks are ranked together.  Query ids and reference ids are
    distinct; further columns are not looked at.
    """
    asked = windows.select("query_id", "x").where(usable("x", width))
    held = references.select("ref_id", "y").where(usable("y", width))
    # A reference with two envelopes of the windows' length, at most three times the longer matrix.
    longest = asked.agg(F.max(F.size("x"))).first()[0] or 0
    bytes_, = held.agg(F.sum((F.size("y") + 2 * longest) * F.lit(8 * width))).first()
    blocks = max(1, -(-(bytes_ or 0) // REFERENCE_BYTES))
    if blocks == 1:
        return _ranked(_block(asked, held, width, k, radius), k)
    path = scratch(windows.sparkSession)
    for block in range(blocks):
        mine = held.where(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)) == block)
        found = _block(asked, mine, width, k, radius)
        found.write.mode("append").parquet(path)
    return _ranked(windows.sparkSession.read.schema(found.schema).parquet(path), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id")
    ranked = found.withColumns({"rank": F.row_number().over(by.orderBy("distance", "ref_id")), "warped": F.sum(F.when(F.col("first"), F.col("warped"))).over(by)})
    return ranked.where(F.col("rank") <= k).drop("first")


def _block(asked: DataFrame, mine: DataFrame, width: int, k: int, radius: int) -> DataFrame:
    rows = sorted(mine.collect(), key=lambda r: r["ref_id"])  # a block of at most about REFERENCE_BYTES
    ids = [r["ref_id"] for r in rows]
    references = [np.array(r["y"], float) for r in rows]
    kinds = dict(asked.dtypes) | dict(mine.dtypes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf) or not ids:
                continue
            for steps, group in pdf.groupby(pdf["x"].map(len)):
                if steps not in boxes:
                    boxes.clear()  # the envelopes of one length at a time
                    boxes[steps] = [envelope(r, steps, radius) for r in references]
                slab = max(1, STACK_BYTES // (8 * max(len(ids), steps * width)))
                for begin in range(0, len(group), slab):
                    part = group.iloc[begin : begin + slab]
                    x = np.stack([np.stack([np.asarray(v, float) for v in m]) for m in part["x"]])
                    d, p, tried = search(x, references, k, radius, boxes[steps])
                    n = d.shape[1]
                    yield pd.DataFrame(
                        {
                            "query_id": np.repeat(part["query_id"].to_numpy(), n),
                            "ref_id": [ids[i] for i in p.reshape(-1)],
                            "distance": d.reshape(-1),
                            "warped": np.repeat(tried, n),
                            "first": np.tile(np.arange(n) == 0, len(part)),
                        }
                    )

    return asked.mapInPandas(each, f"query_id {kinds['query_id']}, ref_id {kinds['ref_id']}, distance double, warped long, first boolean")


# --- scores on held-out bars


def alike(distance: str | Column, x: str, y: str, width: int) -> Column:
    """A warping distance as a similarity of 0 to 1."""
    d = F.col(distance) if isinstance(distance, str) else distance
    return 1 - F.least(F.lit(1.0), d / (F.greatest(F.size(x), F.size(y)) * F.lit(2 * float(np.sqrt(width)))))


def means(matrix: str) -> Column:
    return F.expr(f"transform(sequence(0, size({matrix}[0]) - 1), i -> aggregate({matrix}, 0e0, (a, v) -> a + v[i]) / size({matrix}))")


def fused(near: DataFrame, windows: DataFrame, references: DataFrame, width: int) -> DataFrame:
    """near with cosine, distance (of the means), warping and score of references(ref_id, y,
    confidence): .3, .4 and .3 of the three similarities, times the confidence (null: 0)."""
    pairs = near.withColumnRenamed("distance", "apart").join(windows.select("query_id", "x"), "query_id").join(references.select("ref_id", "y", "confidence"), "ref_id")
    pairs = pairs.withColumns({"m_x": means("x"), "m_y": means("y"), "warping": alike("apart", "x", "y", width)})
    return tpl.similarities(pairs, "m_x", "m_y", F.col("warping")).withColumn("score", F.col("fused") * F.coalesce("confidence", F.lit(0.0))).drop("x", "y", "m_x", "m_y")


def best_scores(scored: DataFrame, references: DataFrame) -> DataFrame:
    """query_id, ref_id, direction, score: the best of each window, ties to the least ref_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
    best = scored.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("query_id", "ref_id", "score")
    return best.join(references.select("ref_id", "direction"), "ref_id").select("query_id", "ref_id", "direction", "score")


# --- pairs by lot

_BITS = 60


def sampled_pairs(rows: DataFrame, k: int, seed: int, id_col: str = "vec_id") -> DataFrame:
    """a, b (a < b), draw: the k pairs of distinct ids with the least draw, ties to the least pair; all
    pairs where there are no more.

    An id's lot is the first 60 bits of md5(seed:id), a pair's draw the sum of two lots modulo 2^60.
    Draws of two pairs are independent and even, and the sample is the same however rows are
    partitioned.  A draw under 2^s means that one lot lies within 2^s over what the other lacks to
    2^60, so that such pairs meet in one of two buckets of lots of that width: an equality join, with
    s raised until k pairs are found.  Null ids are out, repeated ones count once.
    """
    lot = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    lots = stored(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct().withColumn("lot", lot))
    n = lots.count()
    pairs, shift = n * (n - 1) // 2, _BITS
    k = min(k, pairs)
    while shift > 0 and pairs * 2 ** (shift - 1) >= 4 * k * 2**_BITS:
        shift -= 1
    while True:
        found = stored(_drawn(lots, shift).orderBy("draw", "a", "b").limit(k))
        if shift == _BITS or found.count() >= k:
            return found
        shift = min(_BITS, shift + 2)


def _drawn(lots: DataFrame, shift: int) -> DataFrame:
    """All pairs with a draw under 2^shift."""
    whole = 1 << _BITS
    if shift == _BITS:  # then there are at most some eight times as many pairs as asked for
        asked = lots.select(F.col("id").alias("a"), F.col("lot").alias("lot_a"), F.lit(0).cast("long").alias("bucket"))
        met = lots.select(F.col("id").alias("b"), F.col("lot").alias("lot_b"), F.lit(0).cast("long").alias("bucket"))
    else:
        first = F.shiftright(F.pmod(F.lit(whole) - F.col("lot"), F.lit(whole)), shift)
        last = F.lit(1 << (_BITS - shift))
        buckets = F.array_distinct(F.array(first, F.pmod(first + 1, last)))
        asked = lots.select(F.col("id").alias("a"), F.col("lot").alias("lot_a"), F.explode(buckets).alias("bucket"))
        met = lots.select(F.col("id").alias("b"), F.col("lot").alias("lot_b"), F.shiftright("lot", shift).alias("bucket"))
    draw = F.pmod(F.col("lot_a") + F.col("lot_b"), F.lit(whole))
    return asked.join(met, "bucket").where("a < b").select("a", "b", draw.alias("draw")).where(F.col("draw") < F.lit(1 << shift))
