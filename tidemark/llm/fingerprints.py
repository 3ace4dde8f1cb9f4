"""Order-independent document fingerprints: a homomorphic multiset hash, in DataFrame operations only.

A text is the multiset of its paragraphs: its lines, cut further at the ends of sentences and
clauses, as many texts are one line.  Each paragraph is hashed to a wide vector of LANES zeros and
ones, and a fingerprint is the sum of its paragraphs' vectors modulo powers of two: three lanes of 20
bits share one long, kept modulo 2**60, so that a paragraph costs 20 shifts and masks a hash.  The
sum does not depend on the order, and adding or taking away paragraphs adds or subtracts their
vectors (insert(), delete()), however many there are.  Each lane reads a hash bit of its own, so that
lanes are independent fair signs.

Likeness has a vector of its own, as squared differences of sums would count a line that stands
fifty times 2,500-fold: it sums the first occurrences as above, and the k-th occurrence of a
paragraph under a hash of (paragraph, k).  So a multiset is a set of occurrences, and the mean squared
difference of two signed sums estimates the size of the multisets' symmetric difference.  Both vectors
share the sum of first occurrences, so that texts without repeats are summed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import id_key, texts

HASHES, SHIFTS, WIDTH = 2, 20, 20
LANES = 3 * HASHES * SHIFTS
_LOW, _TOP = 1 | 1 << WIDTH, 1 << (2 * WIDTH)
_MODULUS = (1 << (3 * WIDTH)) - 1
#: A paragraph ends at a line feed, or at blanks after a closing mark.
PARAGRAPH_END = r"\n|(?<=[.!?,;:])[ \t]+"


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH_END, -1), lambda p: p != "")


def vector_sums() -> list[Column]:
    """Aggregates for groupBy() over hashes h0, h1: the number of paragraphs, then the packed lanes.

    A null paragraph counts as none.  The top lane is summed apart, so that no sum leaves a long.
    """
    sums = [F.count("h0").alias("v0")]
    number = lambda x: F.lit(x).cast("long")
    for h in range(HASHES):
        hashed = F.coalesce(f"h{h}", number(0))
        for i in range(SHIFTS):
            bits = F.shiftrightunsigned(hashed, i)
            low, top = F.sum(bits.bitwiseAND(number(_LOW))), F.sum(F.shiftrightunsigned(bits, 2 * WIDTH).bitwiseAND(number(1)))
            both = F.shiftleft(top.bitwiseAND(number((1 << WIDTH) - 1)), 2 * WIDTH) + low.bitwiseAND(number(_MODULUS))
            sums.append(both.bitwiseAND(number(_MODULUS)).alias(f"v{len(sums)}"))
    return sums


def _parts(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, v: sums of each text's paragraphs p by part.

    Part 0 is the first occurrence of each paragraph, part 1 the further ones under the same hash, and
    part 2 the further ones under a hash of their own.  A null p counts as no paragraph.
    """
    hashes = [F.when(F.col("p").isNotNull(), F.xxhash64(F.lit(h), "p")).alias(f"h{h}") for h in range(HASHES)]
    counted = pieces.select(*keys, *hashes).groupBy(*keys, *[f"h{h}" for h in range(HASHES)]).agg(F.count("*").alias("m"))
    # m occurrences: 1 is the first, 2 to m are the others, and 2 - m to 0 the others once more
    each = counted.withColumn("t", F.explode(F.expr("sequence(2 - m, m)")))
    part = F.expr("if(t = 1, 0, if(t < 1, 1, 2))")
    own = [F.when(F.col("t") > 1, F.xxhash64(f"h{h}", "t")).otherwise(F.col(f"h{h}")).alias(f"h{h}") for h in range(HASHES)]
    return each.select(*keys, part.alias("part"), *own).groupBy(*keys, "part").agg(*vector_sums()).select(*keys, "part", packed().alias("v"))


def _of_part(part: int, where: str = "true") -> Column:
    none = F.array_repeat(F.lit(0).cast("long"), 1 + HASHES * SHIFTS)
    return F.coalesce(F.max(F.when(F.expr(where) & (F.col("part") == part), F.col("v"))), none)


def _vectors(where: str = "true") -> Column:
    """Aggregate over _parts(): v, the fingerprint, and o, the vector of occurrences."""
    return F.struct(insert(_of_part(0, where), _of_part(1, where)).alias("v"), insert(_of_part(0, where), _of_part(2, where)).alias("o"))


def packed(prefix: str = "v") -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(1 + HASHES * SHIFTS)])


def insert(fingerprint: Column, other: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.zip_with(fingerprint, other, lambda a, b: (a + b).bitwiseAND(F.lit(_MODULUS).cast("long")))


def delete(fingerprint: Column, other: Column) -> Column:
    """The fingerprint without the paragraphs of the other."""
    return F.zip_with(fingerprint, other, lambda a, b: (a - b).bitwiseAND(F.lit(_MODULUS).cast("long")))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common paragraphs (of both multisets' union) from vectors of occurrences, from
    0 to 1; equal vectors give 1 exactly.  From 2**20 paragraphs on lanes carry, and only equality tells."""
    na, nb = F.element_at(a, 1), F.element_at(b, 1)

    def squared(x: Column, y: Column) -> Column:
        def lane(i: int) -> Column:
            low = F.lit((1 << WIDTH) - 1).cast("long")
            d = F.shiftright(x, WIDTH * i).bitwiseAND(low) - F.shiftright(y, WIDTH * i).bitwiseAND(low)
            return F.pow(d * 2 - (na - nb), F.lit(2.0))

        return lane(0) + lane(1) + lane(2)

    longs = 1 + HASHES * SHIFTS
    squares = F.zip_with(F.slice(a, 2, longs - 1), F.slice(b, 2, longs - 1), squared)
    mean = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / LANES
    # Multisets differ by their sizes' difference at least, and by an even number more.
    apart = F.abs(na - nb) + 2 * F.greatest(F.lit(0.0), F.round((mean - F.abs(na - nb)) / 2))
    both = (na + nb).cast("double")
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - apart) / (both + apart))))


def _bucketed(docs: DataFrame, buckets: int) -> tuple[DataFrame, list[int]]:
    """docs with b: the range of ids that k lies in.  At most `buckets` quantiles reach the driver."""
    cuts = docs.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 4 * buckets)).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    step = 32
    coarse = F.array(*[F.lit(c).cast("long") for c in cuts[step - 1 :: step]]) if len(cuts) >= step else F.array().cast("array<bigint>")
    fine = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    at = F.size(F.filter(coarse, lambda c: c < F.col("k")))
    with_at = docs.withColumn("__at", at)
    near = F.slice(fine, F.col("__at") * step + 1, step)
    return with_at.withColumn("b", F.col("__at") * step + F.size(F.filter(near, lambda c: c < F.col("k")))).drop("__at"), cuts


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, next_text (of the next doc_id; after the last: of the first), b, rn, halo.

    Ids are dealt into ranges, and each range also gets the first row of the next one, so that
    one window a range sees every successor.  Rows of halo 1 are those copies.  Repeated ids
    are ordered by their texts' hashes; null ids come last.
    """
    spark = docs.sparkSession
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed, _ = _bucketed(texts(docs).withColumn("k", id_key()).withColumn("t", F.xxhash64("text")), buckets)
    firsts = keyed.groupBy("b").agg(F.min(F.struct("k", "t")).alias("f")).orderBy("b").collect()  # a row for each range
    before = [(r["f"]["k"], r["f"]["t"], firsts[i - 1]["b"]) for i, r in enumerate(firsts)]
    halo = spark.createDataFrame(before, "k long, t long, to int")
    copies = keyed.join(F.broadcast(halo), ["k", "t"]).select("doc_id", "text", "k", "t", F.col("to").alias("b"), F.lit(1).alias("halo"))
    rows = keyed.select("doc_id", "text", "k", "t", "b", F.lit(0).alias("halo")).unionByName(copies)
    order = Window.partitionBy("b").orderBy("halo", "k", "t")
    return rows.select("doc_id", "text", F.lead("text").over(order).alias("next_text"), "b", F.row_number().over(order).alias("rn"), "halo")


def edited_pairs(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, own, edited and next fingerprints of each row.

    The edited text has its last floor(n/4) code points replaced by the first as many (or all)
    of the next document.  A table of one document is its own successor; null text is empty.
    """
    quarter = "(char_length(text) div 4)"
    rows = with_next(docs, buckets).select(
        "b",
        "rn",
        "halo",
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        "text",
        F.expr(f"concat(substring(text, 1, cast(char_length(text) - {quarter} as int)), substring(coalesce(next_text, ''), 1, cast({quarter} as int)))").alias("edited"),
    )
    kinds = rows.select(
        "b", "rn", "halo", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"),
        F.explode(F.expr("if(halo = 1, array(named_struct('kind', 0, 'x', text)), array(named_struct('kind', 0, 'x', text), named_struct('kind', 1, 'x', edited)))")).alias("e"),
    )
    # A null paragraph before each text's own carries what is not summed, which the others lack.
    told = ["halo", "doc_id", "n_chars", "sha"]
    first = F.array(F.lit(None).cast("string"))
    pieces = kinds.select("b", "rn", *told, "e.kind", F.explode(F.concat(first, paragraphs(F.col("e.x")))).alias("p"))
    pieces = pieces.select("b", "rn", "kind", *[F.when(F.col("p").isNull(), F.col(c)).alias(c) for c in told], "p")
    # Buckets stay where they are: all groups below are within a b.
    both = _parts(pieces, ["b", "rn", "kind", *told]).groupBy("b", "rn").agg(
        *[F.max(c).alias(c) for c in told],
        _vectors("halo IS NULL AND kind = 0").alias("own"),
        _vectors("halo IS NULL AND kind = 1").alias("edited"),
    )
    order = Window.partitionBy("b").orderBy("rn")
    return both.withColumn("next", F.lead("own").over(order)).where("halo = 0").select(
        "doc_id",
        "n_chars",
        F.col("sha").alias("edited_sha256"),
        "own",
        "edited",
        "next",
    )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, v and o (the fingerprint and the vector of occurrences) of each row's text.

    Null is empty, and an empty text has only zeros.  Repeated rows each give a row.
    """
    keyed = texts(docs).select("doc_id", F.xxhash64("text").alias("t"), "text")
    once = keyed.groupBy("doc_id", "t").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    pieces = once.select("doc_id", "t", "n", F.explode_outer(paragraphs(F.col("text"))).alias("p"))
    sums = _parts(pieces, ["doc_id", "t", "n"]).groupBy("doc_id", "t", "n").agg(_vectors().alias("x"))
    repeated = sums.select("doc_id", "x.v", "x.o", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return repeated.select("doc_id", "v", "o")


def compare(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each text, its edited text, and the likeness of both and of the next text.

    Null is empty; two empty texts are alike (1).  Rows that repeat an id are each judged; a table of
    one row is its own successor, and an empty table gives no row.
    """
    pairs = edited_pairs(docs, buckets)
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own.v")).alias("fingerprint"),
        as_text(F.col("edited.v")).alias("edited_fingerprint"),
        likeness(F.col("own.o"), F.col("edited.o")).alias("near_edited"),
        likeness(F.col("own.o"), F.col("next.o")).alias("near_next"),
    )
