"""Corpus-wide line de-duplication that returns bitmaps, in DataFrame operations only.

Lines become 128-bit key hashes.  They are range-partitioned by (hash, salt) with a
secondary sort by document and position, and the first document of each run is streamed
by a window.  The salt deals a hot line over many ranges: a row behind the first document
of its own salt is dropped at once, and only the first document of each salt goes on to a
second, small pass over (hash), so that no task ever holds a frequent line whole.
The decisions come back as a compressed keep bitmap for each document, never as text: words of 64
lines, a set bit for a line that stays, words that are all set left out and equal neighbours as one
run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACES, UPPER, id_key, stored, text_key, texts

MIN_CHARS = 10
SALTS = 64


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", "text", id_key().alias("k"), text_key().alias("t"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """k, t (the keys of a row) and keep array<struct<word, times, bits>>, in order of word: bit i%64
    of bits is clear if line i goes, i/64 being one of the `times` words from `word` on.

    All lines of words that are in no run stay.  Rows without a dropped line are absent.  Rows that
    share a doc_id are one document; null ids are one document behind all others; empty texts have
    one empty line, which stays.
    """
    lines = (
        _keyed(docs)
        .select("k", "t", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("k", "t", "pos", F.translate(F.trim("line", F.lit(SPACES)), UPPER, LOWER).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("k", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
        .withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)))
    )
    lines = stored(lines)  # else choosing the ranges would split and hash every text once more
    streamed = Window.partitionBy("h1", "h2", "salt").orderBy("k", "pos")
    marked = lines.repartitionByRange("h1", "h2", "salt").withColumn("first", F.first("k").over(streamed))
    later = marked.where("k > first").select("k", "t", "pos")
    firsts = marked.where("k = first").groupBy("h1", "h2", "k").agg(F.collect_list(F.struct("t", "pos")).alias("at"))
    overall = Window.partitionBy("h1", "h2").orderBy("k")
    behind = (
        firsts.withColumn("first", F.first("k").over(overall))
        .where("k > first")
        .select("k", F.explode("at").alias("at"))
        .select("k", "at.t", "at.pos")
    )
    words = (
        later.unionByName(behind)
        .groupBy("k", "t", F.expr("pos div 64").alias("word"))
        .agg(F.expr("~bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    )
    alike = F.row_number().over(Window.partitionBy("k", "t").orderBy("bits", "word"))
    runs = (
        words.withColumn("run", F.col("word") - alike)  # the same along neighbours of equal bits
        .groupBy("k", "t", "bits", "run")
        .agg(F.min("word").alias("word"), F.count("*").alias("times"))
    )
    return runs.groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("word", "times", "bits"))).alias("keep"))


#: The words of a bitmap one by one, from the first to that of the last run.
_WORDS = (
    "flatten(transform(__keep, (r, j) -> concat("
    "array_repeat(-1L, cast(r.word - if(j = 0, 0L, __keep[j - 1].word + __keep[j - 1].times) as int)), "
    "array_repeat(r.bits, cast(r.times as int)))))"
)
_LINES = "split(coalesce(text, ''), '\\n', -1)"


def _marked(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with __kept, __n_lines and __n_dropped."""
    b = bitmaps.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("keep").alias("__keep"))
    stays = "coalesce(shiftrightunsigned(get(__words, i div 64), cast(i % 64 as int)) & 1L, 1L) = 1L"
    return (
        docs.withColumns({"__k": id_key(), "__t": F.xxhash64(F.coalesce("text", F.lit("")))})
        .join(b, ["__k", "__t"], "left")
        .withColumn("__words", F.expr(_WORDS))
        .withColumns(
            {
                "__n_lines": F.expr(f"cast(size({_LINES}) as bigint)"),
                "__n_dropped": F.expr("coalesce(aggregate(__keep, 0L, (a, r) -> a + r.times * (64 - bit_count(r.bits))), 0L)"),
                "__kept": F.expr(f"if(__keep is null, text, array_join(filter({_LINES}, (x, i) -> {stays}), '\\n'))"),
            }
        )
        .drop("__k", "__t", "__keep", "__words")
    )


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the lines that the bitmaps drop cut from text; all columns kept, whatever their
    names.  A text that loses nothing stays as it is, null too."""
    return _marked(docs, bitmaps).withColumn("text", F.col("__kept")).select(docs.columns)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int = SALTS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: each text without its repeated lines.

    A line that strips to fewer than min_chars code points always stays.
    """
    found = _marked(docs.select("doc_id", "text"), keep_bitmaps(docs, min_chars, salts))
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.coalesce("__kept", F.lit("")).alias("kept"))
