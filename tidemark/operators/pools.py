"""Pools of condition combinations, from single triggers to the choice that is traded.

A trigger is a row (direction, pool, conditions, round, state, hit, hold): the conditions that held
on a bar, sorted, and what came of it (hold -1: neither target nor stop was reached).  Everything
below is counted from such rows; a combination is known by its direction and its conditions joined
with `+`.  Greedy choices are folds over the combinations of one market state or joins in rounds;
their inputs are combinations, of which there are at most as many as subsets of conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scratch import stored
from tidemark.operators.store import NET, RATE_SPAN

STATES = ("BULL", "BEAR", "RANGE")
#: Least rates of the tiers, and what the cache and the stable list ask for.
TIER_RATES = {"long": (0.71, 0.67, 0.64), "short": (0.59, 0.55, 0.52)}
TIERS = ("PREMIUM", "QUALITY", "CANDIDATE")
CANDIDATE_STD, CANDIDATE_ROUNDS = 0.05, 5
STABLE_ROUNDS, STABLE_RATE, STABLE_STD = 5, 0.62, 0.05
LIVE_TOTAL, LIVE_DECAY = 10, 0.10


def key_of(conditions: str = "conditions") -> Column:
    return F.array_join(F.sort_array(F.col(conditions)), "+")


def family_of(condition: Column) -> Column:
    return F.regexp_replace(condition, "_(loose|strict)$", "")


def families(conditions: str = "conditions") -> Column:
    return F.sort_array(F.array_distinct(F.transform(F.col(conditions), family_of)))


def by_pool(values: dict[tuple[str, str], float]) -> Column:
    """A value for each pool and direction."""
    out = None
    for (pool, direction), v in values.items():
        fits = (F.col("pool") == pool) & (F.col("direction") == direction)
        out = F.when(fits, v) if out is None else out.when(fits, v)
    return out


def tier_of(rate: str = "overall_rate") -> Column:
    """By pool and direction; the second pool and shorts share their limits."""
    r, lax = F.col(rate), (F.col("pool") == "pool2") | (F.col("direction") == "short")
    name = lambda limits: F.when(r >= limits[0], TIERS[0]).when(r >= limits[1], TIERS[1]).when(r >= limits[2], TIERS[2]).otherwise("NONE")
    return F.when(lax, name(TIER_RATES["short"])).otherwise(name(TIER_RATES["long"]))


# --- counting


def round_results(triggers: DataFrame) -> DataFrame:
    """triggers, hits, hit_rate and median_hold of each combination in each round."""
    held = F.when(F.col("hold") >= 0, F.col("hold"))
    keyed = triggers.withColumn("combo", key_of())
    counted = keyed.groupBy("pool", "direction", "combo", "round").agg(
        F.count("*").alias("triggers"),
        F.sum(F.col("hit").cast("long")).alias("hits"),
        F.median(held).alias("median_hold"),
    )
    return counted.withColumn("hit_rate", F.col("hits") / F.col("triggers"))


def baselines(triggers: DataFrame) -> DataFrame:
    """The hit rate of all resolved triggers of a round, whatever their conditions."""
    resolved = triggers.where("hold >= 0").groupBy("pool", "direction", "round")
    return resolved.agg(F.avg(F.col("hit").cast("int")).alias("baseline"))


def breakdowns(triggers: DataFrame) -> DataFrame:
    """triggers, hits and rate of each combination in each of the states over all rounds, zeros kept."""
    counted = triggers.withColumn("combo", key_of()).groupBy("pool", "direction", "combo").pivot("state", list(STATES))
    wide = counted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("hit").cast("long")).alias("h"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.coalesce(f"{s}_n", F.lit(0)).alias("triggers"), F.coalesce(f"{s}_h", F.lit(0)).alias("hits")) for s in STATES])).alias("s")
    rate = F.when(F.col("triggers") > 0, F.round(F.col("hits") / F.col("triggers"), 6)).otherwise(0.0)
    return wide.select("pool", "direction", "combo", each).select("pool", "direction", "combo", "s.*").withColumn("rate", rate)


def cumulative(triggers: DataFrame) -> DataFrame:
    """One row a combination over all rounds: rates, stability, composite score, expected values.

    avg_hold is the median of the holds of all rounds; its halves round to even.  The composite
    loses 3 points for each condition beyond the third, down to zero.
    """
    rounds = round_results(triggers).join(baselines(triggers), ["pool", "direction", "round"], "left")
    keys = ["pool", "direction", "combo"]
    table = rounds.groupBy(*keys).agg(
        F.count("*").alias("rounds"),
        F.avg("hit_rate").alias("avg_rate"),
        F.stddev_pop("hit_rate").alias("rate_std"),
        F.sum("triggers").alias("triggers"),
        F.sum("hits").alias("hits"),
        F.coalesce(F.avg(F.when(F.col("baseline") > 0, F.col("baseline"))), F.lit(0.0)).alias("avg_baseline"),
    )
    holds = triggers.where("hold >= 0").withColumn("combo", key_of()).groupBy(*keys).agg(F.median("hold").alias("m"), F.count("*").alias("hold_samples"))
    table = table.join(holds, keys, "left").withColumns({"avg_hold": F.coalesce(F.bround("m", 0).cast("long"), F.lit(0)), "hold_samples": F.coalesce("hold_samples", F.lit(0))})
    part = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    low, high = F.when(
        F.col("direction") == "long",
        RATE_SPAN["long"][0],
    ).otherwise(RATE_SPAN["short"][0]), F.when(F.col("direction") == "long", RATE_SPAN["long"][1]).otherwise(RATE_SPAN["short"][1])
    turns = part(F.log(F.col("rounds") + 1.0) / F.log(F.lit(21.0)) * 100)
    steady = part((1 - F.col("rate_std") / 0.08) * 100) * F.least(F.lit(1.0), F.col("rounds") / 5.0)
    composite = 0.3 * part((F.col("avg_rate") - low) / (high - low) * 100) + 0.4 * steady + 0.3 * turns
    gain, loss = by_pool({k: v[0] for k, v in NET.items()}), by_pool({k: v[1] for k, v in NET.items()})
    conditions = F.split("combo", r"\+")
    table = table.drop("m").withColumn("conditions", conditions).withColumns({"overall_rate": F.col("hits") / F.col("triggers"), "n_conditions": F.size("conditions")})
    value = F.col("overall_rate") * gain - (1 - F.col("overall_rate")) * loss
    return table.withColumns(
        {
            "stability": F.col("avg_rate") * (1 - F.col("rate_std")) * F.log(F.col("rounds") + 1.0),
            "composite": F.round(F.greatest(F.lit(0.0), composite - 3.0 * F.greatest(F.lit(0), F.col("n_conditions") - 3)), 2),
            "ev_percent": value * 100,
            "pnl_percent": value * F.col("triggers") * 100,
            "ev_per_bar": value / F.greatest(F.col("avg_hold"), F.lit(1)),
            "tier": tier_of(),
        }
    )


def summary(cumulated: DataFrame, least_rate: float = STABLE_RATE, most_std: float = STABLE_STD, least_rounds: int = STABLE_ROUNDS) -> DataFrame:
    """Combinations, stable ones and the greatest number of rounds, by pool."""
    stable = (F.col("rounds") >= least_rounds) & (F.col("avg_rate") >= least_rate) & (F.col("rate_std") <= most_std)
    return cumulated.groupBy("pool").agg(F.count("*").alias("combos"), F.sum(stable.cast("long")).alias("stable"), F.max("rounds").alias("rounds"))


def live_alerts(cumulated: DataFrame, live: DataFrame) -> DataFrame:
    """Combinations whose live(pool, direction, combo, total, hits) rate fell well below their average."""
    rate = F.round(F.col("l.hits") / F.col("l.total"), 6)
    joined = cumulated.alias("c").join(live.alias("l"), ["pool", "direction", "combo"])
    found = joined.where((F.col("l.total") >= LIVE_TOTAL) & (rate < F.col("c.avg_rate") - LIVE_DECAY))
    return found.select("pool", "direction", "combo", "c.avg_rate", rate.alias("live_rate"), (F.col("c.avg_rate") - rate).alias("decay"))


# --- what the cache keeps


def kept(cumulated: DataFrame) -> DataFrame:
    """Positive expectation, and premium or quality, or a candidate that is steady."""
    steady = (F.col("tier") == TIERS[2]) & (F.col("rate_std") <= CANDIDATE_STD) & (F.col("rounds") >= CANDIDATE_ROUNDS)
    return cumulated.where((F.col("ev_percent") > 0) & (F.col("tier").isin(*TIERS[:2]) | steady))


def simplified(cumulated: DataFrame) -> DataFrame:
    """Without loose conditions whose strict form is there; of combinations that become equal the one
    of most triggers stays (then the greatest old key)."""
    strict = lambda c: F.concat(family_of(c), F.lit("_strict"))
    covered = lambda c: c.endswith("_loose") & F.array_contains("conditions", strict(c))
    shorter = cumulated.withColumn("conditions", F.filter("conditions", lambda c: ~covered(c))).withColumn("old", F.col("combo")).withColumn("combo", key_of())
    rank = F.row_number().over(Window.partitionBy("pool", "direction", "combo").orderBy(F.desc("triggers"), F.desc("old")))
    best = shorter.withColumn("rank", rank).where("rank = 1").drop("rank", "old")
    return best.withColumn("n_conditions", F.size("conditions"))


def covers(entries: DataFrame) -> DataFrame:
    """pool, direction, wide, narrow: pairs of which the first triggers whenever the second does.

    Each condition of the wide one is in the narrow one, itself or in its strict form.  A narrow one
    has at most 3 ** 5 wide ones, whose keys it is joined by; no two are compared otherwise.
    """
    start = F.array(F.array().cast("array<string>"))

    def options(c: Column) -> Column:
        loose = F.when(c.endswith("_strict"), F.array(F.concat(family_of(c), F.lit("_loose")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.lit(None).cast("string"), c), loose)

    def extended(found: Column, c: Column) -> Column:
        return F.flatten(F.transform(found, lambda f: F.transform(options(c), lambda o: F.when(o.isNull(), f).otherwise(F.array_union(f, F.array(o))))))

    wider = F.aggregate("conditions", start, extended)
    keys = F.array_distinct(F.transform(wider, lambda w: F.array_join(F.sort_array(w), "+")))
    narrow = entries.select("pool", "direction", F.col("combo").alias("narrow"), F.explode(keys).alias("wide")).where("wide <> '' and wide <> narrow")
    return narrow.join(entries.select("pool", "direction", F.col("combo").alias("wide")), ["pool", "direction", "wide"])


def pruned(entries: DataFrame) -> DataFrame:
    """entries without those that a kept, wider one replaces: its overall rate is as high, and its
    triggers a round are at least 0.8 times as many.

    Fewer conditions are judged first, then higher rates, then keys.  Whether one goes hangs on those
    before it, so that each round settles what has no unsettled one before it.
    """
    keys = ["pool", "direction"]
    rank = Window.partitionBy(*keys).orderBy("n_conditions", F.desc("overall_rate"), "combo")
    ranked = stored(entries.withColumn("at", F.row_number().over(rank)).withColumn("often", F.col("triggers") / F.greatest("rounds", F.lit(1))))
    by = lambda name: ranked.select(*keys, F.col("combo").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("overall_rate", "often", "at")])
    edges = covers(entries).join(by("wide"), [*keys, "wide"]).join(by("narrow"), [*keys, "narrow"])
    better = (F.col("wide_overall_rate") + 1e-12 >= F.col("narrow_overall_rate")) & (F.col("wide_often") >= 0.8 * F.col("narrow_often"))
    edges = stored(edges.where(better & (F.col("wide_at") < F.col("narrow_at"))).select(*keys, "wide", "narrow"))
    gone = edges.select(*keys, F.col("narrow").alias("combo")).limit(0)
    while True:
        # Wide ones that nothing replaces any more are kept, and what they cover is gone.
        left = edges.join(gone.withColumnRenamed("combo", "wide"), [*keys, "wide"], "left_anti").join(
            gone.withColumnRenamed("combo", "narrow"),
            [*keys, "narrow"],
            "left_anti",
        )
        first = left.join(left.select(*keys, F.col("narrow").alias("wide")).distinct(), [*keys, "wide"], "left_anti")
        more = stored(first.select(*keys, F.col("narrow").alias("combo")).distinct())
        if not more.limit(1).count():
            return ranked.drop("at", "often").join(gone, [*keys, "combo"], "left_anti")
        gone = stored(gone.unionByName(more))


def anchors(entries: DataFrame) -> DataFrame:
    """entries with anchor: the condition that most entries of the direction have (ties: shorter, then
    first by name)."""
    keys = ["pool", "direction"]
    each = entries.select(*keys, "combo", F.explode("conditions").alias("condition"))
    often = each.groupBy(*keys, "condition").agg(F.count("*").alias("n"))
    best = F.min_by("condition", F.struct(-F.col("n"), F.length("condition"), "condition"))
    return entries.join(
        each.join(often, [*keys, "condition"]).groupBy(*keys, "combo").agg(best.alias("anchor")),
        [*keys, "combo"],
        "left",
    ).fillna("", ["anchor"])


def main_states(breakdown: DataFrame) -> DataFrame:
    """The state in which a combination triggers most (ties: the first of STATES)."""
    order = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return breakdown.where("triggers > 0").groupBy("pool", "direction", "combo").agg(F.max_by("state", F.struct("triggers", -order)).alias("main_state"))


def anchor_choice(entries: DataFrame, breakdown: DataFrame, most: int = 4) -> DataFrame:
    """The best `most` of each anchor by composite, and beyond them the first of every main state.

    A fold over the entries of one direction and anchor in order of score."""
    keys = ["pool", "direction"]
    marked = anchors(entries).join(main_states(breakdown), [*keys, "combo"], "left")
    lists = marked.groupBy(*keys, "anchor").agg(F.array_sort(F.collect_list(F.struct((-F.col("composite")).alias("o"), "combo", "main_state"))).alias("l"))
    chosen = """aggregate(l, cast(array() as array<struct<o:double,combo:string,main_state:string>>), (a, x) ->
      IF((x.main_state IS NOT NULL AND NOT exists(a, y -> y.main_state <=> x.main_state)) OR size(a) < {most}, concat(a, array(x)), a))"""
    fold = F.expr(f"IF(size(l) <= {most}, l, {chosen.format(most=most)})")
    return lists.select(*keys, "anchor", F.explode(fold).alias("x")).select(*keys, "anchor", "x.combo", "x.main_state")


# --- the premium pool


def merged_pools(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both pools' entries; of a combination in both, the second pool's."""
    same = ["direction", "combo"]
    return first.join(second.select(*same), same, "left_anti").unionByName(second)


def merged_families(candidates: DataFrame) -> DataFrame:
    """One candidate for each state, direction and set of families: of those with the best score
    (half a point for each loose condition) the first key, with the group's counts."""
    loose = F.size(F.filter("conditions", lambda c: c.endswith("_loose")))
    best = F.min_by(F.struct("combo", "conditions", "composite", "state_rate", "state_triggers"), F.struct(-(F.col("composite") + 0.5 * loose), "combo"))
    grouped = candidates.withColumn("families", families()).groupBy("state", "direction", "families").agg(
        best.alias("b"), F.max("rounds").alias("rounds"), F.sum("triggers").alias("triggers"), F.sum("hits").alias("hits"), F.count("*").alias("merged")
    )
    return grouped.select(
        "state",
        "direction",
        "families",
        "b.*",
        "rounds",
        "triggers",
        "hits",
        "merged",
    ).withColumn("overall_rate", F.col("hits") / F.col("triggers"))


def chosen_apart(ranked: DataFrame, order: list[Column], most: int, overlap: float) -> DataFrame:
    """Of each state and direction up to `most` in the given order, none sharing `overlap` of its
    families (of both) or more with one chosen before; place from 1."""
    item = F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), "combo", "families")
    lists = ranked.groupBy("state", "direction").agg(F.array_sort(F.collect_list(item)).alias("l"))
    near = f"exists(a, y -> size(array_intersect(y.families, x.families)) >= {overlap}D * size(array_union(y.families, x.families)))"
    fold = f"aggregate(l, filter(l, x -> false), (a, x) -> IF(size(a) >= {most} OR {near}, a, concat(a, array(x))))"
    return lists.select(
        "state",
        "direction",
        F.posexplode(F.expr(fold)).alias("place", "x"),
    ).select("state", "direction", (F.col("place") + 1).alias("place"), "x.combo")


def premium_pool(cumulated: DataFrame, breakdown: DataFrame, most: int = 6, least_triggers: int = 5) -> DataFrame:
    """state, direction, tier, place, combo: a premium and a frequent layer for each state and side.

    Premium: composite of 80 and more, families overlapping by less than 0.3.  Frequent: two or three
    conditions overlapping by less than half, by rate in the state; outside RANGE a composite of 70, 10
    triggers and not in the premium layer, in RANGE up to ten with 5 triggers and the candidate's rate.
    """
    in_state = breakdown.select("pool", "direction", "combo", "state", F.col("rate").alias("state_rate"), F.col("triggers").alias("state_triggers"))
    both = merged_pools(cumulated.where("pool = 'pool1'"), cumulated.where("pool = 'pool2'"))
    candidates = in_state.where(F.col("state_triggers") >= least_triggers).join(both, ["pool", "direction", "combo"])
    merged = stored(merged_families(candidates))
    premium = stored(chosen_apart(merged.where("composite >= 80"), [-F.col("composite"), -F.col("state_rate"), F.col("combo")], most, 0.3))
    simple = merged.where(F.size("conditions").between(2, 3))
    order = [-F.col("state_rate"), -F.col("state_triggers"), F.col("combo")]
    trends = simple.where("state <> 'RANGE' and triggers >= 10 and composite >= 70").join(premium, ["state", "direction", "combo"], "left_anti")
    least = F.when(F.col("direction") == "long", TIER_RATES["long"][2]).otherwise(TIER_RATES["short"][2])
    sideways = simple.where((F.col("state") == "RANGE") & (F.col("state_triggers") >= 5) & (F.col("state_rate") >= least))
    frequent = chosen_apart(trends, order, most, 0.5).unionByName(chosen_apart(sideways, order, 10, 0.5))
    return premium.withColumn("tier", F.lit("PREMIUM")).unionByName(frequent.withColumn("tier", F.lit("FREQUENT")))


def best_for_state(pool: DataFrame, cumulated: DataFrame) -> DataFrame:
    """For each state and direction the first of the premium layer, else of the frequent one."""
    first = pool.groupBy("state", "direction").agg(F.min_by(F.struct("tier", "combo"), F.struct(F.when(F.col("tier") == "PREMIUM", 0).otherwise(1), "place")).alias("b"))
    rates = cumulated.groupBy("direction", "combo").agg(F.max("overall_rate").alias("overall_rate"))
    return first.select("state", "direction", "b.*").join(rates, ["direction", "combo"])


def best_triggers(triggered: DataFrame, cumulated: DataFrame) -> DataFrame:
    """Of the combinations that trigger on one bar(key), the one of most expected value a bar, then of
    fewest conditions, then the first key."""
    joined = triggered.join(cumulated.select("pool", "direction", "combo", "ev_per_bar", "n_conditions"), ["pool", "direction", "combo"])
    best = F.min_by(F.struct("pool", "direction", "combo", "ev_per_bar"), F.struct(-F.col("ev_per_bar"), "n_conditions", "combo", "pool", "direction"))
    return joined.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def feedback(trades: DataFrame, cumulated: DataFrame) -> DataFrame:
    """How trades(keys, hit, stopped, profit) of each combination went, beside what its history says.

    A trade counts for each of its keys; issue names what is off: a rate 0.1 below, half the trades
    stopped out, or a combination that the history does not know.
    """
    each = trades.withColumn("combo", F.explode("keys"))
    seen = each.groupBy("direction", "combo").agg(
        F.count("*").alias("trades"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"),
        F.avg(F.col("stopped").cast("int")).alias("stop_rate"),
        F.sum("profit").alias("profit"),
    )
    known = cumulated.groupBy("direction", "combo").agg(F.max("overall_rate").alias("overall_rate"))
    joined = seen.join(known, ["direction", "combo"], "left")
    issues = F.array_compact(
        F.array(
            F.when(F.col("overall_rate").isNull(), "UNKNOWN"),
            F.when(F.col("hit_rate") < F.col("overall_rate") - LIVE_DECAY, "BELOW_HISTORY"),
            F.when(F.col("stop_rate") >= 0.5, "STOPPED_OUT"),
        )
    )
    return joined.withColumn("issues", F.array_join(issues, ","))


# --- stores as files


def exported(cumulated: DataFrame, path: str) -> None:
    """Tab-separated lines with a header: the columns that imported() reads, rates in percent."""
    percent = lambda c: F.format_string("%.4f%%", F.col(c) * 100).alias(c)
    lines = cumulated.select(
        "pool",
        "direction",
        "combo",
        "tier",
        "rounds",
        percent("avg_rate"),
        percent("rate_std"),
        "triggers",
        "hits",
        percent("overall_rate"),
        "avg_hold",
    )
    lines.write.option("sep", "\t").option("header", True).csv(path)


def imported(spark, path: str) -> DataFrame:
    """One row for each round of the lines of an export: triggers are spread evenly over the rounds,
    the last taking the remainder, and hits follow the overall rate."""
    text = "pool string, direction string, combo string, tier string, rounds string, avg_rate string, rate_std string, triggers string, hits string, overall_rate string, avg_hold string"
    lines = spark.read.option("sep", "\t").option("header", True).schema(text).csv(path)
    number = lambda c: F.expr(f"coalesce(try_cast(regexp_replace({c}, '[^0-9]', '') as long), 0)")
    rate = F.expr("coalesce(try_cast(regexp_replace(overall_rate, '%', '') as double), 0e0) / 100")
    parsed = lines.select(
        "pool",
        "direction",
        "combo",
        F.greatest(number("rounds"), F.lit(1)).alias("rounds"),
        number("triggers").alias("total"),
        rate.alias("rate"),
    )
    spread = parsed.withColumn("round", F.explode(F.sequence(F.lit(1), F.col("rounds").cast("int")))).withColumn("share", F.expr("total div rounds"))
    last = F.when(F.col("round") == F.col("rounds"), F.col("total") - F.col("share") * (F.col("rounds") - 1)).otherwise(F.col("share"))
    return spread.withColumn("triggers", last).withColumn(
        "hits",
        F.bround(F.col("triggers") * F.col("rate"), 0).cast("long"),
    ).select("pool", "direction", "combo", "round", "triggers", "hits")


def joined_histories(own: DataFrame, other: DataFrame) -> DataFrame:
    """Rounds of two stores; a round that both have counts once, as the own store has it."""
    same = ["pool", "direction", "combo", "round"]
    return own.unionByName(other.join(own.select(*same), same, "left_anti"))
