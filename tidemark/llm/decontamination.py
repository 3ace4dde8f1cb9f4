"""Benchmark passages in documents, by a prefix-filtered set join, in DataFrame operations only.

A window is WINDOW consecutive words of an item (all its words if it has fewer), seen as the set of
its shingles of SHINGLE words.  It occurs in a document only if all its shingles do, so that one
of them is a sufficient prefix: the one that is rarest among the documents.  Documents are joined
on the prefixes alone; a match stands only if the window it fixes lies within the document
(positional bound on its left, length bound on its right), and is then verified word by word.

Nothing of the documents but their ids, positions and hashes is shuffled, except for the texts of
documents that have candidates.  Tables made from the benchmark are broadcast only after a count of
their rows and bytes, and joined by a shuffle beyond that.

Null and empty texts have no words, neither as documents nor as items.  Items of one item_id are one
item; a null item_id counts as the item "".  Rows of documents are judged one by one, repeats alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, id_key, stored, text_key

WINDOW = 10
SHINGLE = 3
#: No more than so many rows and bytes of the benchmark's tables are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 1 << 26

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: str) -> Column:
    """The words of a column, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _BETWEEN, -1), "")


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def _shingles(size: int) -> str:
    """SQL: hash of the shingle of this many words at each position of the array ws."""
    at = ", ".join(f"ws[i + {j}]" for j in range(size))
    return f"if(size(ws) < {size}, array(), transform(sequence(0, size(ws) - {size}), i -> xxhash64({at})))"


def _sized(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df with a hint to broadcast it, if it is small enough."""
    rows, size_sum = df.agg(F.count("*"), F.sum(F.lit(16) if size is None else size)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size_sum or 0) <= BROADCAST_BYTES else df


def windows(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (wid, width, text: its words joined by blanks), and their items (wid, item)."""
    ws = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("ws"))
    cut = (
        ws.where("size(ws) > 0")
        .withColumn("width", F.expr(f"least(size(ws), {width})"))
        .select("item", "ws", "width", F.explode(F.expr("sequence(1, size(ws) - width + 1)")).alias("at"))
        .select("item", "width", F.expr("array_join(slice(ws, at, width), ' ')").alias("text"))
    )
    distinct = stored(cut.select("width", "text").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return distinct, stored(cut.join(distinct, ["width", "text"]).select("wid", "item").distinct())


def _occurrences(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """k, t, n, pos, h wherever a shingle of the benchmark stands in a document."""
    sizes = [r["size"] for r in shingles.select("size").distinct().collect()]  # SHINGLE at most
    keys = _sized(shingles.select("size", "h").distinct())
    of = docs.select(id_key().alias("k"), text_key().alias("t"), words("text").alias("ws"))
    parts = [
        of.select("k", "t", F.size("ws").alias("n"), F.posexplode(F.expr(_shingles(s))).alias("pos", "h"))
        .join(keys.where(F.col("size") == s).drop("size"), "h")
        .withColumn("size", F.lit(s))
        for s in sizes
    ]
    none = of.sparkSession.createDataFrame([], "h long, k long, t long, n int, pos int, size int")
    return stored(reduce(DataFrame.unionByName, parts, none))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """k, t, start, width, wid for each window that stands in a document, and the items of wid."""
    found, owners = windows(items, width)
    by_size = found.select("wid", "width", F.split("text", " ", -1).alias("ws"))
    cut = [
        by_size.where(f"least(width, {SHINGLE}) = {s}")
        .select("wid", "width", F.posexplode(F.expr(_shingles(s))).alias("off", "h"))
        .withColumn("size", F.lit(s))
        for s in range(1, SHINGLE + 1)
    ]
    shingles = stored(reduce(DataFrame.unionByName, cut))
    seen = _occurrences(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), shingles)
    rarity = seen.groupBy("size", "h").agg(F.count("*").alias("times"))
    prefixes = (
        shingles.join(rarity, ["size", "h"], "left")
        .groupBy("wid", "width", "size")
        .agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "off", "h")).alias("p"))
        .where("p.times > 0")  # else a shingle is nowhere, and so is the window
        .select("wid", "width", "size", "p.off", "p.h")
    )
    candidates = (
        seen.join(_sized(stored(prefixes)), ["size", "h"])
        .where("pos >= off and pos - off + width <= n")
        .groupBy("k", "t")
        .agg(F.collect_set(F.struct((F.col("pos") - F.col("off")).alias("start"), "width", "wid")).alias("c"))
    )
    placed = (
        docs.select(id_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
        .join(candidates, ["k", "t"])
        .select("k", "t", "c", words("text").alias("ws"))
        .select(
            "k",
            "t",
            F.explode(
                F.expr(
                    "transform(c, x -> struct(x.start as start, x.width as width, x.wid as wid,"
                    " array_join(slice(ws, x.start + 1, x.width), ' ') as text))"
                )
            ).alias("x"),
        )
        .select("k", "t", "x.*")
    )
    checked = _sized(found.drop("width"), F.octet_length("text"))
    return placed.join(checked, ["wid", "text"]).select("k", "t", "start", "width", "wid"), owners


#: Words under the sorted spans s.
_COVERED = (
    "aggregate(array_sort(s), struct(0L as n, 0 as e), (a, x) -> struct("
    "a.n + greatest(0, x.stop - greatest(x.start, a.e)) as n, greatest(a.e, x.stop) as e), a -> a.n)"
)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside windows), items (sorted ids of items with windows here)."""
    hits, owners = occurrences(docs, items, width)
    spans = F.struct("start", (F.col("start") + F.col("width")).alias("stop"))
    of_doc = stored(hits.groupBy("k", "t").agg(F.collect_set(spans).alias("s"), F.collect_set("wid").alias("w")))
    of_item = (
        of_doc.select("k", "t", F.explode("w").alias("wid"))
        .join(_sized(owners, F.octet_length("item")), "wid")
        .groupBy("k", "t")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    covered = of_doc.select("k", "t", F.expr(_COVERED).alias("n_hit")).join(of_item, ["k", "t"])
    return (
        docs.select("doc_id", id_key().alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), n_words("text").alias("n_words"))
        .join(covered, ["k", "t"], "left")
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs without the rows that hold a window; all columns kept, whatever their names."""
    hits, _ = occurrences(docs, items, width)
    bad = hits.select(F.col("k").alias("__k"), F.col("t").alias("__t")).distinct()
    keyed = docs.withColumns({"__k": id_key(), "__t": F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(bad, ["__k", "__t"], "left_anti").select(docs.columns)
