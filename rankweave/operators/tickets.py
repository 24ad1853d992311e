"""Ordered-outcome tickets: expansion, probabilities, candidate sets, values and stakes.

A ticket is an ordered triple (a, b, c) of slots of one contest, kept as three
integers; its text form is made at the end only. A contest of six has 120.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.relative import clip01, normalise, rank_average, rank_min, rank_percent

CONTEST = "contest_id"


def complete_groups(df: DataFrame, size: int = 6, columns: Sequence[str] = ("slot", "position", "outcome_rank"), bad: Column | None = None) -> DataFrame:
    """Rows of contests with exactly `size` rows (63 at most) that hold 1..size in each column, and none of which is bad.

    A column's values set a bit each: of as many rows as bits, all bits are
    set if no value repeats. That is a window over the contest, which the
    view is sorted by already.
    """
    return with_completeness(df, "__whole", size, columns, bad).where("__whole").drop("__whole")


def with_completeness(df: DataFrame, out: str, size: int = 6, columns: Sequence[str] = ("slot", "position", "outcome_rank"), bad: Column | None = None) -> DataFrame:
    """df with whether `complete_groups` keeps the row."""
    contest = Window.partitionBy(CONTEST)
    whole = F.col(CONTEST).isNotNull() & (F.count("*").over(contest) == size)
    for c in columns:
        place = F.when(F.col(c).between(1, size) & (F.col(c) % 1 == 0), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(c) - 1).cast("int")))
        whole = whole & (F.bit_or(place).over(contest) == (1 << size) - 1)
    if bad is not None:
        whole = whole & ~F.bool_or(F.coalesce(bad, F.lit(False))).over(contest)
    return df.withColumn(out, whole)


def permutations(df: DataFrame, carry: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """A row for each ordered triple of distinct slots of a contest, with the carried columns as x_a, x_b, x_c.

    A contest's rows are gathered in one array (a contest is small) and
    expanded in place: one shuffle instead of a join of three sides.
    """
    entry = F.struct("slot", *carry)
    gathered = df.groupBy(CONTEST).agg(F.sort_array(F.collect_list(entry)).alias("all"), *[F.first(k).alias(k) for k in keep])
    out = gathered
    for name in "abc":
        out = out.withColumn(f"_{name}", F.explode("all"))
        for before in "abc"[: "abc".index(name)]:
            out = out.where(F.col(f"_{name}.slot") != F.col(f"_{before}.slot"))
    slots = [F.col(f"_{n}.slot").alias(n) for n in "abc"]
    return out.select(CONTEST, *keep, *slots, *[F.col(f"_{n}.{c}").alias(f"{c}_{n}") for c in carry for n in "abc"])


def ticket_text() -> Column:
    return F.concat_ws("-", "a", "b", "c")


def parse_ticket(text: str | Column) -> Column:
    """(a, b, c) of a ticket's text, null where it isn't three numbers."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(text, "-")
    a, b, c = (F.get(parts, F.lit(k)).try_cast("int") for k in range(3))
    return F.when((F.size(parts) == 3) & a.isNotNull() & b.isNotNull() & c.isNotNull(), F.struct(a.alias("a"), b.alias("b"), c.alias("c")))


def draw_probability(share: str, total: str | Column = "total", floor: float = 0.0) -> Column:
    """Probability of drawing a, b, c one after the other without putting back; columns share_a.. and the contest's total."""
    total = F.col(total) if isinstance(total, str) else total
    a, b, c = (F.col(f"{share}_{n}") for n in "abc")
    left = lambda x: F.greatest(x, F.lit(floor)) if floor else x
    return a / left(total) * (b / left(total - a)) * (c / left(total - a - b))


def place_weights(rank: str, win: str, top2: str, top3: str) -> dict[str, Column]:
    """Weights for first, second and third place: 0.7 of the exact place, 0.3 of the ranking share."""
    base = F.coalesce(F.col(rank), F.lit(0.0))
    w = F.coalesce(F.col(win), base)
    t2 = F.coalesce(F.col(top2), w)
    t3 = F.coalesce(F.col(top3), t2)
    low = lambda x: F.greatest(x, F.lit(1e-9))
    return {"first_w": 0.7 * low(w) + 0.3 * low(base), "second_w": 0.7 * low(t2 - w) + 0.3 * low(base), "third_w": 0.7 * low(t3 - t2) + 0.3 * low(base)}


def conditional_probability(first: str = "first_w", second: str = "second_w", third: str = "third_w") -> Column:
    """a by its first weight, then b by its second among the rest, then c by its third; totals are first_w_total and so on."""
    p1 = F.col(f"{first}_a") / F.col(f"{first}_total")
    p2 = F.col(f"{second}_b") / (F.col(f"{second}_total") - F.col(f"{second}_a"))
    p3 = F.col(f"{third}_c") / (F.col(f"{third}_total") - F.col(f"{third}_a") - F.col(f"{third}_b"))
    return p1 * p2 * p3


def order_of(p: str | Column):
    """Tickets by falling probability, ties in natural order."""
    return Window.partitionBy(CONTEST).orderBy((F.col(p) if isinstance(p, str) else p).desc(), "a", "b", "c")


def top_tickets(df: DataFrame, n: int, p: str = "probability", out: str = "nth") -> DataFrame:
    return df.withColumn(out, F.row_number().over(order_of(p))).where(F.col(out) <= n)


def restrict(df: DataFrame, n: int, by: str, normalised: Sequence[str]) -> DataFrame:
    """The n best tickets of each contest, their probabilities adding up to 1 again."""
    kept = top_tickets(df, n, by, "__nth").drop("__nth")
    return kept.withColumns({c: normalise(c) for c in normalised})


def blend(x: Column, y: Column, weight: float) -> Column:
    w = min(max(weight, 0.0), 1.0)
    return w * x + (1 - w) * y


def blend_ranks(base: str, update: str, weight: float, penalty: float = 0.0, start: int = 5) -> Column:
    """Blend of two rank scores; later base ranks cost the update `penalty`. An update that says nothing keeps the base."""
    n = F.count("*").over(Window.partitionBy(CONTEST))
    steps = F.greatest(n - 1, F.lit(1))
    base_score = 1 - (rank_average(base, ascending=False) - 1) / steps
    update_score = 1 - (rank_average(update, ascending=False) - 1) / steps
    if penalty > 0:
        overflow = clip01((F.row_number().over(order_of(base)) - start) / F.greatest(n - start, F.lit(1)))
        update_score = clip01(update_score - overflow * penalty)
    group = Window.partitionBy(CONTEST)
    flat = F.max(update).over(group) - F.min(update).over(group) <= 1e-8 + 1e-5 * F.abs(F.max(update).over(group))
    return F.when(flat, F.col(base)).otherwise(blend(base_score, update_score, weight))


def overlap(*pairs: tuple[Column, Sequence[Column]]) -> Column:
    """How many of the given slots are among the actual ones."""
    total = F.lit(0)
    for x, among in pairs:
        total = total + x.isin(*among).cast("int")
    return total


def training_candidates(n: int, p: str = "raw_probability") -> Column:
    """Tickets to learn from: the n best, the actual one, and those that share enough with it (columns x, y, z)."""
    a, b, c, x, y, z = (F.col(k) for k in "abcxyz")
    best = F.row_number().over(order_of(p)) <= n
    actual = (a == x) & (b == y) & (c == z)
    return best | actual | (a == x) | (overlap((a, (x, y)), (b, (x, y))) >= 2) | (overlap((a, (x, y, z)), (b, (x, y, z)), (c, (x, y, z))) >= 2)


# Sample weights by the closest match.
LABEL_WEIGHTS = {"exact_full": 1.0, "exact_top2": 0.75, "exact_first_with_two": 0.6, "exact_first": 0.5, "top2_overlap": 0.35, "top3_overlap": 0.2}


def training_targets(weights: dict[str, float] = LABEL_WEIGHTS) -> dict[str, Column]:
    """relevance 0..5 and sample_weight of a ticket against the actual x, y, z."""
    a, b, c, x, y, z = (F.col(k) for k in "abcxyz")
    two, three = overlap((a, (x, y)), (b, (x, y))), overlap((a, (x, y, z)), (b, (x, y, z)), (c, (x, y, z)))
    first, pair = a == x, (a == x) & (b == y)
    cases = [(pair & (c == z), 5, "exact_full"), (pair, 4, "exact_top2"), (first & (three >= 2), 3, "exact_first_with_two"), (first, 2, "exact_first"), (two >= 2, 1, "top2_overlap"), (three >= 2, 1, "top3_overlap")]
    relevance, weight = F.lit(0), F.lit(0.15)
    for condition, level, name in reversed(cases):
        relevance, weight = F.when(condition, level).otherwise(relevance), F.when(condition, weights[name]).otherwise(weight)
    return {"top2_overlap": two, "top3_overlap": three, "relevance": relevance, "sample_weight": weight + 0.03 * three}


def kelly(p: Column, odds: Column, cap: float = 0.02) -> Column:
    """Share of the bankroll, 0 where the odds pay nothing."""
    gain = odds - 1
    raw = (gain * p - (1 - p)) / gain
    return F.coalesce(F.when((odds > 1) & p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(cap), raw))), F.lit(0.0))


def value_columns(p: str = "probability", odds: str = "odds", threshold: float = 1.10, cap: float = 0.02) -> dict[str, Column]:
    p_, o = F.col(p), F.col(odds)
    return {"expected_value": p_ * o, "market_rank": rank_min(o, ascending=True), "is_value": F.coalesce(p_ * o >= threshold, F.lit(False)), "stake_fraction": kelly(p_, o, cap)}


def stake_amount(rank: Column, p: Column, odds: Column, top_n: int = 12, least_value: float = 1.0, least_odds: float = 12.0, bankroll: int = 10_000, unit: int = 100, most: int = 500, cap: float = 0.02) -> Column:
    """Amount in whole units, at least one for an eligible ticket, 0 for others."""
    eligible = F.coalesce((rank <= top_n) & (p * odds >= least_value) & (odds >= least_odds), F.lit(False))
    amount = F.floor(F.least(kelly(p, odds, cap) * bankroll, F.lit(float(most))) / unit) * unit
    return F.when(eligible, F.greatest(amount, F.lit(unit))).otherwise(0)


def buy_decision(hit: Column, rank: Column) -> dict[str, Column]:
    """buy, consider or skip by the hit probability, for the three best tickets."""
    label = F.when(hit >= 0.50, "high").when(hit >= 0.35, "middle").otherwise("low")
    buy, consider = (rank <= 3) & (label == "high"), (rank <= 3) & (label == "middle")
    return {"hit_label": label, "decision": F.when(buy, "buy").when(consider, "consider").otherwise("skip"), "amount": F.when(buy, 300).when(consider, 100).otherwise(0)}


def outer_mix() -> Column:
    """How far outside a ticket looks."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    on = lambda x: x.cast("double")
    return clip01(0.34 * on(a >= 4) + 0.24 * on(b >= 4) + 0.16 * on(c >= 4) + 0.16 * on(a != 1) + 0.10 * on((b == 1) | (c == 1)))


def longshot(upset: Column, fit: Column, p: Column, best: Column) -> Column:
    return clip01(0.34 * upset + 0.26 * outer_mix() + 0.22 * fit + 0.18 * clip01(1 - p / F.greatest(best, F.lit(1e-12))))


def longshot_with_odds(base: Column, odds: Column, value: Column) -> Column:
    zero = F.lit(0.0)
    return clip01(0.70 * F.coalesce(base, zero) + 0.18 * F.coalesce(clip01((odds - 10) / 40), zero) + 0.12 * clip01((F.coalesce(value, zero) - 0.8) / 0.7))


def priority(p: str, longshot_score: Column, fit: Column, value: Column | None = None) -> Column:
    value = F.lit(0.0) if value is None else F.coalesce(value, F.lit(0.0))
    return clip01(0.42 * rank_percent(p) + 0.28 * longshot_score + 0.18 * fit + 0.12 * clip01((value - 0.8) / 0.7))


def hint(longshot_score: Column, priority_score: Column, p: Column) -> Column:
    return F.when((longshot_score >= 0.70) & (priority_score >= 0.45), "value longshot").when(longshot_score >= 0.58, "longshot").when((p >= 0.08) | (priority_score >= 0.72), "main").otherwise("cover")


def upset_label(score: Column) -> Column:
    return F.when(score >= 0.72, "upset").when(score >= 0.55, "unsettled").when(score >= 0.38, "normal").otherwise("solid")


def mean_score(columns: Sequence[str]) -> Column:
    """The mean of the scores that several models gave a row, those that are there."""
    given = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return F.when(F.size(given) > 0, F.aggregate(given, F.lit(0.0), lambda s, x: s + x) / F.size(given))


def with_odds(tickets: DataFrame, odds: DataFrame, keys: Sequence[str] = (CONTEST, "a", "b", "c")) -> DataFrame:
    """Tickets with `odds`, the first column of the other table that is no key; null where it has no row.

    The odds of a contest (keys[0]) are one map that its tickets look into, so
    tables that lie by contest are joined where they lie. Slots are numbers of
    20 bits at most, three of them one long. Two rows for one ticket raise.
    """
    value = next(c for c in odds.columns if c not in keys)
    bits = lambda c, by: F.call_function("shiftleft", F.when(F.col(c).between(0, (1 << 20) - 1), F.col(c)).cast("long"), F.lit(by))
    number = bits(keys[1], 40) + bits(keys[2], 20) + bits(keys[3], 0)
    known = odds.select(keys[0], number.alias("__at"), F.col(value).cast("double").alias("__value")).dropna(subset=[keys[0], "__at"])
    by_contest = known.groupBy(keys[0]).agg(F.map_from_entries(F.collect_list(F.struct("__at", "__value"))).alias("__odds"))
    joined = tickets.join(by_contest, keys[0], "left")
    return joined.select(*tickets.columns, F.when(number.isNotNull(), F.try_element_at("__odds", number)).alias("odds"))
