"""Mining of larger combinations, validation on later bars, and whole feature vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.operators import indicators as ind
from tidemark.operators import signals as sig
from tidemark.plans import catalog
from tidemark.plans.registry import QUERIES, query
from tidemark.plans import sql
from tidemark.sources import bars as src


def _true_conditions(direction: str) -> tuple[str, ...]:
    """Long form: a row for each bar and condition that holds on it, numbered by name."""
    names = sorted(sig.conditions(direction))
    each = ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in names)
    return (
        catalog._condition_part(direction), catalog._outcome_sql(direction, "cond"),
        f"tc AS MATERIALIZED (SELECT id, outcome, c, regexp_replace(c, '_(loose|strict)$', '') AS f FROM (SELECT row_number() OVER () AS id, outcome, unnest(list_filter([{each}], lambda x: x IS NOT NULL)) AS c FROM o))",
    )


def _grown_sql(direction: str, size: int) -> str:
    """Self-joins of the long form, one for each further condition, in order of names."""
    steps = ["l1 AS (SELECT id, outcome, c AS combo, c AS last, [f] AS fs FROM tc)"]
    for k in range(2, size + 1):
        steps.append(f"l{k} AS (SELECT a.id, a.outcome, a.combo || '+' || b.c AS combo, b.c AS last, list_append(a.fs, b.f) AS fs FROM l{k - 1} a JOIN tc b ON b.id = a.id AND b.c > a.last AND NOT list_contains(a.fs, b.f))")
    limits = (0.71, 0.67, 0.64) if direction == "long" else (0.59, 0.55, 0.52)
    tier = " ".join(f"WHEN hits / triggers >= {v} THEN '{n}'" for n, v in zip(("PREMIUM", "QUALITY", "CANDIDATE"), limits, strict=True))
    return sql.with_indicators(
        f"SELECT combo, triggers, hits, hits / triggers AS hit_rate, CASE {tier} ELSE 'NONE' END AS tier FROM (SELECT combo, count(*) AS triggers, sum(outcome::INT)::BIGINT AS hits FROM l{size} GROUP BY combo HAVING count(*) >= 8)",
        *_true_conditions(direction), *steps,
    )


def _larger(direction: str, size: int) -> None:
    def run(spark, sf_dir):
        return sig.mine(catalog.marked(spark, sf_dir, direction), direction, size)

    run.__name__ = f"combos_of_{size}_{direction}"
    query(_grown_sql(direction, size))(run)


#: Families left out, by how their names begin.
WITHOUT = ("rsi", "boll")


@query(_grown_sql("short", 3).replace("lambda x: x IS NOT NULL)) AS c", "lambda x: NOT (x LIKE 'rsi%' OR x LIKE 'boll%'))) AS c"))
def combos_without_families(spark, sf_dir):
    return sig.mine(catalog.marked(spark, sf_dir, "short"), "short", 3, without=WITHOUT)


for _direction in ("long", "short"):
    for _size in (4, 5):
        _larger(_direction, _size)


@query(
    sql.with_indicators(
        """SELECT f.combo, f.hits / f.triggers AS hit_rate, coalesce(s.triggers, 0) AS triggers, coalesce(s.hits, 0) AS hits, coalesce(s.hits / s.triggers >= 0.67, false) AS kept FROM
(SELECT combo, count(*) AS triggers, sum(outcome::INT) AS hits FROM l2 WHERE early GROUP BY combo HAVING count(*) >= 8 AND sum(outcome::INT) / count(*) >= 0.64) f LEFT JOIN
(SELECT combo, count(*) AS triggers, sum(outcome::INT)::BIGINT AS hits FROM l2 WHERE NOT early GROUP BY combo) s USING (combo)""",
        catalog._condition_part("long"), catalog._outcome_sql("long", "cond"),
        "tc AS MATERIALIZED (SELECT id, early, outcome, c, regexp_replace(c, '_(loose|strict)$', '') AS f FROM (SELECT row_number() OVER () AS id, bar_idx < floor((max(bar_idx) OVER (PARTITION BY symbol) + 1) * 0.7) AS early, outcome, unnest(list_filter(["
        + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in sorted(sig.conditions("long"))) + "], lambda x: x IS NOT NULL)) AS c FROM o))",
        "l2 AS (SELECT a.id, a.early, a.outcome, a.c || '+' || b.c AS combo FROM tc a JOIN tc b ON b.id = a.id AND b.c > a.c AND b.f <> a.f)",
    )
)
def validated_combos(spark, sf_dir):
    return sig.validated(catalog.marked(spark, sf_dir, "long"), "long", 2)


@query()
def feature_vectors(spark, sf_dir):
    """The 52 features of every bar, with longer timeframes of 4 and 16 bars."""
    b = src.bars_from_ticks(spark, sf_dir)
    table = feat.all_features(b, ind.indicators(b), 4, 16)
    return table.select("symbol", "bar_idx", *[F.round(c, 6).alias(c) for c in table.columns[2:]])


@query()
def labelled_vectors(spark, sf_dir):
    """Trend and momentum features of the bars with a swing label."""
    b = src.bars_from_ticks(spark, sf_dir)
    vectors = feat.features(ind.indicators(b), ("trend", "momentum"))
    return feat.at_labels(vectors, QUERIES["swing_labels"](spark, sf_dir))
