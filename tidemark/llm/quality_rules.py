"""Quality rules: a table of thresholds compiled into one Spark projection.

All statistics of a text are higher-order functions over its own words and lines, so there
is no shuffle and no user function.  RULES is data: (name, statistic as SQL, lowest, highest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, texts

#: Function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be this at from or are by an not have "
    "de la le les et des en un une du que est pour dans qui sur pas au par plus "
    "der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch "
    "el los las y del se por con una su para al lo como más o pero sus"
).split()

#: name, SQL over the statistics, least and greatest allowed value (None: open).
RULES = (
    ("word_length", "word_chars / n_words", 1.5, 25.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.3),
    ("repeated_lines", "n_dup_lines / n_text_lines", None, 0.5),
    ("stop_words", "n_stop_words / n_words", 0.01, None),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_WORDS = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')"
_TEXT_LINES = "filter(split(text, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"


def _repeat_words() -> str:
    """Words inside 3-word windows that occur twice or more: sort the windows' hashes with
    their places, keep the places whose neighbour is equal, add up their spans."""
    span = "aggregate(sequence(0, size(r) - 1), 0L, (a, j) -> a + least(3, coalesce(get(r, j + 1), r[j] + 3) - r[j]))"
    places = (
        "array_sort(transform(filter(sequence(0, size(p) - 1), j -> "
        "coalesce(get(p, j - 1).h = p[j].h, false) or coalesce(get(p, j + 1).h = p[j].h, false)), j -> p[j].i))"
    )
    places = places.replace("get(p, j - 1)", "get(p, if(j = 0, -1, j - 1))")
    ordered = let("array_sort(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))", "p", let(places, "r", span))
    some = f"if(size(array_distinct(hs)) = size(hs), 0L, {ordered})"
    hashes = "transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2]))"
    return f"if(size(ws) < 3, 0L, {let(hashes, 'hs', some)})"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that RULES refer to; null and empty texts count as no words."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    of_words = let(
        _WORDS,
        "ws",
        "named_struct('n_words', cast(size(ws) as bigint), "
        "'word_chars', cast(char_length(array_join(ws, '')) as bigint), "
        f"'n_stop_words', cast(size(filter(ws, w -> w in ({stops}))) as bigint), "
        f"'n_repeat_words', {_repeat_words()})",
    )
    of_lines = let(
        _TEXT_LINES, "ls", "named_struct('n_text_lines', cast(size(ls) as bigint), 'n_dup_lines', cast(size(ls) - size(array_distinct(ls)) as bigint))"
    )
    return (
        texts(docs)
        .select(
            "doc_id",
            F.expr(of_words).alias("w"),
            F.expr(of_lines).alias("l"),
            F.expr("cast(regexp_count(text, '[#*$%&|<>]') as bigint)").alias("n_symbols"),
        )
        .select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_stop_words", "l.n_text_lines")
    )


def compile_rules(rules=RULES) -> str:
    """One SQL condition that holds where every rule holds; statistics over nothing fail no rule."""
    parts = []
    for _, value, least, most in rules:
        for limit, sign in ((least, ">="), (most, "<=")):
            if limit is not None:
                top, bottom = value.split(" / ")
                parts.append(f"({bottom} = 0 or {top} {sign} {limit}D * {bottom})")
    return " and ".join(parts)


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed and kept, in one projection of each text."""
    failed = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return statistics(docs).withColumn("base_failed", F.expr(failed)).withColumn("kept", F.expr(f"not {failed} and {compile_rules(rules)}"))
