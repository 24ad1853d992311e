"""How a contest may unfold: pressures of the slots, scenario scores and labels, and how tickets fit them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions.numbers import mapped
from rankweave.operators.relative import clip01, minmax

# Weights and biases of the challenge and pressure scores.
CHALLENGE = {"rank": 0.20, "top2": 0.16, "k2": 0.14, "k34": 0.22, "lead_adv": 0.08, "trial_adv": 0.05, "machine_adv": 0.04, "site2": 0.07, "site3": 0.04}
CHALLENGE_BIAS = {2: 0.07, 3: 0.10, 4: 0.12, 5: 0.06, 6: 0.04}
PRESSURE = {"rank": 0.17, "top2": 0.14, "lead_adv": 0.09, "trial_adv": 0.06, "machine_adv": 0.05}
ESCAPE = {"exact1": 0.29, "rank": 0.18, "k1": 0.21, "lead_adv": 0.07, "trial_adv": 0.05, "machine_adv": 0.06, "site_win": 0.09, "site2": 0.05}
SCENARIOS = ("S0", "S1", "S2", "S3", "S4", "S5", "S6")
NAMES = {"S0": "escape", "S1": "second slot inside", "S2": "second slot around", "S3": "third slot", "S4": "fourth slot", "S5": "outside", "S6": "mixed"}


def _sum(weights: dict[str, float], start: Column | None = None) -> Column:
    """Added up in the order of the table, k34 in its place: ties depend on the order."""
    total = F.lit(0.0) if start is None else start
    for name, w in weights.items():
        total = total + w * (F.greatest("k3", "k4") if name == "k34" else F.col(name))
    return total


def advantages(df: DataFrame) -> DataFrame:
    """lead_adv, trial_adv and machine_adv: scaled in the contest, 1 best, 0 without a value."""
    return df.withColumns({"lead_adv": minmax("lead", lower=True), "trial_adv": minmax("trial", lower=True), "machine_adv": minmax("machine")})


def _pressure(kind: str, site: str) -> Column:
    return clip01(_sum(PRESSURE, 0.42 * F.col(kind)) + 0.07 * F.col(site))


def challenge() -> Column:
    """How strongly a slot challenges the first one."""
    return clip01(_sum(CHALLENGE) + mapped(F.col("slot"), CHALLENGE_BIAS))


def context(slots: DataFrame, key: str = "contest_id") -> DataFrame:
    """One row for each contest with its scalars, from one aggregate over the slots.

    Slots have rank, top2, top3, exact1, k1..k4 (probabilities of the four
    styles), site_win, site2, site3 and the three advantages; missing slots
    count as 0.
    """
    df = slots.withColumns({
        "challenge": challenge(), "escape_base": _sum(ESCAPE), "p_k2_2": _pressure("k2", "site2"), "p_k3_2": _pressure("k3", "site2"), "p_k3_3": _pressure("k3", "site3"), "p_k4_3": _pressure("k4", "site3"),
    })
    at = lambda slot, c: F.coalesce(F.max(F.when(F.col("slot") == slot, F.col(c))), F.lit(0.0))
    among = lambda slots_, c: F.coalesce(F.max(F.when(F.col("slot").isin(*slots_), F.col(c))), F.lit(0.0))
    others = F.sort_array(F.collect_list(F.when(F.col("slot") != 1, F.struct("challenge", (-F.col("slot")).alias("back")))), asc=False)
    raw = df.groupBy(key).agg(
        others.alias("others"), at(1, "escape_base").alias("base1"), at(1, "top2").alias("top2_1"), at(1, "site2").alias("site2_1"), at(1, "site_win").alias("site_win_1"), F.max((F.col("slot") == 1).cast("int")).alias("has1"),
        at(2, "p_k2_2").alias("second_inside"), at(2, "p_k3_2").alias("second_around"), F.greatest(at(3, "p_k3_2"), at(3, "p_k4_3")).alias("third_pressure"), F.greatest(at(4, "p_k3_3"), at(4, "p_k4_3")).alias("fourth_pressure"),
        F.greatest(at(5, "p_k4_3"), at(6, "p_k4_3")).alias("outside_pressure"), among((3, 4, 5, 6), "p_k4_3").alias("sweep_pressure"), among((4, 5, 6), "challenge").alias("outer_challenge"), among((4, 5, 6), "top3").alias("outer_top3"), among((4, 5, 6), "site3").alias("outer_site3"),
    )
    nth = lambda k, c: F.try_element_at("others", F.lit(k))[c]
    c = F.col
    raw = raw.withColumns({"attack": F.coalesce(nth(1, "challenge"), F.lit(0.0)), "second_attack": F.coalesce(nth(2, "challenge"), F.lit(0.0)), "attack_slot": F.coalesce(-nth(1, "back"), F.lit(0))})
    raw = raw.withColumn("escape", F.when(c("has1") == 1, clip01(c("base1") * (1 - 0.30 * c("attack")))).otherwise(0.0))
    raw = raw.withColumn("sweep", clip01(0.36 * c("outer_challenge") + 0.28 * c("sweep_pressure") + 0.22 * c("outer_top3") + 0.14 * c("outer_site3")))
    raw = raw.withColumn("collapse", clip01((1 - c("escape")) * (0.36 + 0.26 * c("attack")) + 0.22 * F.greatest("second_around", "third_pressure", "fourth_pressure") + 0.10 * (1 - c("top2_1")) + 0.06 * (1 - c("site2_1"))))
    raw = raw.withColumn("margin", F.greatest(c("attack") - c("second_attack"), F.lit(0.0)))
    close = F.when((c("attack") >= 0.30) & (c("second_attack") >= 0.25), clip01((0.12 - c("margin")) / 0.12)).otherwise(0.0)
    chaos = clip01(0.34 * close + 0.24 * c("collapse") * c("attack") + 0.18 * F.greatest("third_pressure", "fourth_pressure", "outside_pressure") + 0.14 * c("sweep") + 0.10 * (1 - c("escape")) * c("attack"))
    return raw.withColumn("chaos", chaos).drop("others", "has1", "base1")


def scores(model: Sequence[str] | None = None) -> dict[str, Column]:
    """S0..S6 from the context; model columns, if all are there and not all 0, stand for them as shares."""
    c = F.col
    attack34 = F.greatest("third_pressure", "fourth_pressure")
    inside = F.greatest(c("second_inside") - 0.65 * c("second_around"), F.lit(0.0))
    around = F.greatest(c("second_around") - 0.75 * c("second_inside"), F.lit(0.0))
    rules = {
        "S0": 0.68 * c("escape") + 0.18 * (1 - c("collapse")) + 0.14 * (1 - c("attack")),
        "S1": 0.50 * inside + 0.20 * c("second_inside") + 0.14 * c("escape") + 0.14 * c("site2_1") + 0.02 * (1 - c("collapse")),
        "S2": 0.50 * around + 0.22 * c("second_around") + 0.16 * c("collapse") + 0.08 * c("attack") + 0.04 * (1 - c("escape")),
        "S3": 0.62 * c("third_pressure") + 0.12 * attack34 + 0.14 * c("collapse") + 0.12 * c("attack"),
        "S4": 0.64 * c("fourth_pressure") + 0.12 * c("sweep_pressure") + 0.12 * c("attack") + 0.12 * c("collapse"),
        "S5": 0.64 * c("outside_pressure") + 0.18 * c("sweep") + 0.10 * c("collapse") + 0.08 * c("outer_site3"),
        "S6": 0.58 * c("chaos") + 0.18 * c("collapse") + 0.14 * c("second_attack") + 0.10 * (1 - c("escape")) * c("attack"),
    }
    found = {k: clip01(x) for k, x in rules.items()}
    if model:
        positive = [F.greatest(F.col(x), F.lit(0.0)) for x in model]
        total = sum(positive, F.lit(0.0))
        there = F.lit(True)
        for x in model:
            there = there & F.col(x).isNotNull() & ~F.isnan(x)
        found = {k: F.when(there & (total > 0), p / total).otherwise(found[k]) for k, p in zip(SCENARIOS, positive, strict=True)}
    return found


def label() -> Column:
    """The best of S0..S5, or S6 in chaos, without a clear best, or when none is strong."""
    order = F.sort_array(F.array(*[F.struct(F.col(s).alias("score"), F.lit(-i).alias("back"), F.lit(s).alias("name")) for i, s in enumerate(SCENARIOS[:6])]), asc=False)
    best, second = order[0], order[1]
    mixed = (F.col("chaos") >= 0.65) | ((F.col("chaos") >= 0.55) & (best["score"] - second["score"] < 0.05)) | (best["score"] < 0.28)
    return F.when(mixed, "S6").otherwise(best["name"])


def flatness(p: str = "share", key: str = "contest_id") -> Column:
    """For use in an aggregate over the slots of a contest: how even the shares are."""
    top = F.max(p)
    second = F.coalesce(F.try_element_at(F.sort_array(F.collect_list(p), asc=False), F.lit(2)), F.lit(0.0))
    n = F.count(p)
    entropy = F.when(n > 1, -F.sum(F.col(p) * F.ln(F.greatest(p, F.lit(1e-12)))) / F.ln(n)).otherwise(0.0)
    return clip01(0.55 * clip01(entropy) + 0.25 * (1 - top) + 0.20 * (1 - F.greatest(top - second, F.lit(0.0))))


def subset_score() -> Column:
    """Upset score of the subsets, from context, scores and flatness."""
    outer = F.greatest("S3", "S4", "S5", "S6")
    return clip01(0.28 * F.col("collapse") + 0.24 * F.col("attack") + 0.20 * F.col("sweep") + 0.18 * outer + 0.10 * F.col("flat"))


def subset_label(tolerance: float = 1e-12) -> Column:
    """Attack, upset, stable or neutral by quantile columns named like attack_q70.

    Values that equal a quantile but for rounding reach it: of contests alike
    one may be the quantile itself.
    """
    reaches = lambda name, q: F.col(name) >= F.col(f"{name}_{q}") - tolerance
    attack = reaches("attack", "q70") | reaches("collapse", "q70")
    upset = reaches("upset", "q70") | reaches("flat", "q70")
    stable = reaches("escape", "q70") & (F.col("collapse") <= F.col("collapse_q50") + tolerance)
    return F.when(attack, "attack_or_collapse").when(upset, "upset_or_flat").when(stable, "stable_escape").otherwise("neutral")


def observed(df: DataFrame, key: str = "contest_id") -> DataFrame:
    """What happened: the winner's slot and style, how the favourite did, and the shape of the first three."""
    first = lambda c: F.max(F.when(F.col("outcome_rank") == 1, F.col(c)))
    favourite = F.max(F.when(F.col("slot") == 1, F.col("outcome_rank")))
    top3 = F.sort_array(F.collect_list(F.when(F.col("outcome_rank") <= 3, F.col("slot"))))
    rows = df.groupBy(key).agg(first("slot").alias("winner"), first("style").alias("style"), favourite.alias("favourite_rank"), top3.alias("top3"))
    outside = F.size(F.filter("top3", lambda s: s >= 4))
    status = F.when(F.col("favourite_rank") == 1, "won").when(F.col("favourite_rank") <= 3, "placed").when(F.col("favourite_rank").isNull(), "absent").otherwise("lost")
    shape = F.when(outside == 0, "inside").when(outside == 1, "one outside").otherwise("outside")
    return rows.select(key, "winner", "style", status.alias("favourite"), shape.alias("shape"), F.concat_ws("/", status, shape).alias("pattern"))


def outcome_scenario(inside_style: str) -> Column:
    """S0..S6 of `observed` rows: by the winner, for slot 2 by style and whether the favourite stayed in front, else by the shape."""
    winner = F.col("winner")
    second = F.when((F.col("style") == inside_style) & F.col("favourite").isin("won", "placed"), "S1").otherwise("S2")
    return F.when(winner == 2, second).when(winner == 1, "S0").when(winner.isin(3, 4), F.concat(F.lit("S"), winner)).when(winner.isin(5, 6) | (F.col("shape") == "outside"), "S5").otherwise("S6")


def line_fits() -> dict[str, Column]:
    """How a ticket (a, b, c) fits the context of its contest: six fits and a penalty for what it ignores."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    on = lambda x: x.cast("double")
    attack = F.col("attack_slot")
    inside = on((F.col("escape") > 0.45) & (a != 1)) * F.col("escape")
    falling = on((F.col("collapse") > 0.45) & (a == 1) & b.isin(2, 3)) * F.col("collapse")
    missed = on((F.col("attack") > 0.45) & ~((a == attack) | (b == attack) | (c == attack))) * F.col("attack")
    return {
        "fit_escape": on(a == 1) * F.col("escape"),
        "fit_second": on((a == 2) & b.isin(1, 3, 4)) * F.col("second_inside"),
        "fit_around": on(a.isin(2, 3, 4)) * F.greatest("second_around", "third_pressure", "fourth_pressure"),
        "fit_through": on(a.isin(3, 4, 5, 6) & (b <= 4)) * F.col("sweep_pressure"),
        "fit_outer": on((b >= 4) | (c >= 4)) * F.greatest("sweep", "outside_pressure"),
        "fit_attack": on((a == attack) | ((b == attack) & a.isin(1, 2))) * F.col("attack"),
        "mismatch": clip01(inside + falling + missed),
    }


def line_score() -> Column:
    """One number for a ticket's fit, for choosing candidates."""
    fits = ("fit_escape", "fit_second", "fit_around", "fit_through", "fit_outer", "fit_attack")
    return sum((F.col(f) for f in fits), F.lit(0.0)) - F.col("mismatch")
