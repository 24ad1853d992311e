"""Confidence scores of contests from their ticket probabilities, and the table that pulls probabilities to observed rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.core.shared import stored
from rankweave.operators.metrics import contest_fact
from rankweave.operators.relative import clip01, group, normalise
from rankweave.operators.tickets import CONTEST, order_of

HIGH, MIDDLE = 75.0, 60.0


def label(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MIDDLE, "middle").otherwise("low")


def ticket_count(label_col: Column, counts: tuple[int, int, int]) -> Column:
    """Recommended number of tickets for high, middle and low."""
    return F.when(label_col == "high", counts[0]).when(label_col == "middle", counts[1]).otherwise(counts[2])


TOP12_COUNTS, TOP3_COUNTS = (5, 8, 0), (3, 3, 0)


def _ranked(tickets: DataFrame, p: str) -> DataFrame:
    shares = tickets.withColumn("q", normalise(F.greatest(F.coalesce(F.col(p), F.lit(0.0)), F.lit(0.0))))
    return shares.withColumn("nth", F.row_number().over(order_of(F.round("q", 12))))


def _plain(x: Column) -> Column:
    return x


def _at(n: int, wrap=_plain) -> Column:
    return F.coalesce(wrap(F.max(F.when(F.col("nth") == n, F.col("q")))), F.lit(0.0))


def _mass(n: int, wrap=_plain) -> Column:
    return wrap(F.sum(F.when(F.col("nth") <= n, F.col("q")).otherwise(0.0)))


def _entropy(wrap=_plain) -> Column:
    n = wrap(F.count("*"))
    return F.when(n > 1, -wrap(F.sum(F.greatest("q", F.lit(1e-12)) * F.ln(F.greatest("q", F.lit(1e-12))))) / F.ln(n)).otherwise(0.0)


def _upset(tickets: DataFrame, wrap=_plain) -> Column:
    return F.coalesce(wrap(F.first("upset", ignorenulls=True)), F.lit(0.0)) if "upset" in tickets.columns else F.lit(0.0)


def _score(*terms: tuple[float, Column]) -> Column:
    total = F.lit(0.0)
    for weight, x in terms:
        total = total + weight * clip01(x)
    return F.round(F.round(clip01(total) * 100, 9), 1)


def _top12_facts(tickets: DataFrame, wrap=_plain) -> dict[str, Column]:
    """Masses and gaps of the twelve best tickets: aggregates, or windows where `wrap` makes them such."""
    return {"m12": _mass(12, wrap), "m5": _mass(5, wrap), **{f"q{n}": _at(n, wrap) for n in (1, 2, 12, 13)}, "conc": 1 - _entropy(wrap), "upset": _upset(tickets, wrap)}


def _top12_score() -> Column:
    return _score((0.45, (F.col("m12") - 0.10) / 0.45), (0.20, (F.col("m5") - 0.04) / 0.25), (0.15, (F.col("q1") - F.col("q2")) / 0.06), (0.10, (F.col("q12") - F.col("q13")) / 0.01), (0.10, F.col("conc") / 0.25), (-0.10, (F.col("upset") - 0.70) / 0.30))


def labelled(tickets: DataFrame, p: str = "probability", out: str = "top12_label") -> DataFrame:
    """Tickets with the confidence label of their contest, by windows over it: no join and no second expansion."""
    found = {f"__{k}": c for k, c in _top12_facts(tickets, lambda x: x.over(group())).items()}
    rows = _ranked(tickets, p).withColumns(found)
    kept = [F.col(c) for c in tickets.columns]
    facts = rows.select(*kept, *[F.col(f"__{k}").alias(k) for k in _top12_facts(tickets) if k not in tickets.columns])
    return facts.select(*kept, label(_top12_score()).alias(out))


def top12_confidence(tickets: DataFrame, p: str = "probability") -> DataFrame:
    """One row for each contest: how much of the mass the twelve best tickets hold, and how clearly."""
    facts = _ranked(tickets, p).groupBy(CONTEST).agg(*[c.alias(k) for k, c in _top12_facts(tickets).items()])
    score = _top12_score()
    out = facts.withColumn("top12_score", score).withColumn("top12_label", label(F.col("top12_score")))
    return out.select(CONTEST, "top12_score", "top12_label", ticket_count(F.col("top12_label"), TOP12_COUNTS).alias("tickets"), F.col("m12").alias("top12_mass"), F.col("m5").alias("top5_mass"), (F.col("q1") - F.col("q2")).alias("gap12"), (F.col("q12") - F.col("q13")).alias("margin12"), F.col("conc").alias("concentration"))


def _top3_facts(tickets: DataFrame) -> list[Column]:
    return [_mass(3).alias("m3"), _at(1).alias("q1"), _at(2).alias("q2"), _at(3).alias("q3"), _at(4).alias("q4"), _entropy().alias("entropy"), _upset(tickets).alias("upset")]


def _top3_score() -> Column:
    return _score((0.35, (F.col("m3") - 0.03) / 0.16), (0.20, (F.col("q1") - 0.01) / 0.08), (0.15, (F.col("q1") - F.col("q2")) / 0.035), (0.15, (F.col("q3") - F.col("q4")) / 0.012), (0.15, (1 - F.col("entropy")) / 0.25), (-0.08, (F.col("upset") - 0.75) / 0.25))


def top3_confidence(tickets: DataFrame, p: str = "probability", also: Sequence[Column] = ()) -> DataFrame:
    """One row for each contest: mass and structure of the three best tickets; also: aggregates of the ranked tickets, with nth."""
    ranked = _ranked(tickets, p)
    best = {c: [F.max(F.when(F.col("nth") == k, F.col(c))) for k in (1, 2, 3)] for c in "abc"}
    facts = ranked.groupBy(CONTEST).agg(
        *_top3_facts(tickets), *also,
        *[best[c][k].alias(f"{c}{k + 1}") for c in "abc" for k in range(3)],
    )
    score = _top3_score()
    three = lambda c: F.array(*[F.col(f"{c}{k}") for k in (1, 2, 3)])
    pairs = F.array(*[F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b")) for k in (1, 2, 3)])
    distinct = lambda x: F.size(F.array_distinct(x))
    # of three items the most common one has as many as 4 less the number of different ones
    shared = lambda x: (4 - distinct(x)) / 3.0
    slots = F.size(F.array_distinct(F.concat(three("a"), three("b"), three("c"))))
    out = facts.withColumns({"top3_score": score, "first_share": shared(three("a")), "pair_share": shared(pairs), "slots": slots, "seconds": distinct(three("b")), "firsts": distinct(three("a"))})
    tight = clip01(0.35 * F.col("first_share") + 0.35 * F.col("pair_share") + 0.15 * (1 - clip01((F.col("slots") - 3) / 3)) + 0.15 * (1 - clip01((F.col("seconds") - 1) / 2)))
    return out.select(CONTEST, "top3_score", label(F.col("top3_score")).alias("top3_label"), F.col("m3").alias("top3_mass"), F.col("q1").alias("top1"), (F.col("q1") - F.col("q2")).alias("gap12"), (F.col("q3") - F.col("q4")).alias("margin3"), "firsts", "seconds", "slots", "first_share", "pair_share", tight.alias("tightness"), "entropy", *facts.columns[8 : 8 + len(also)])


def _with_marginals(ranked: DataFrame) -> DataFrame:
    """Ranked tickets with the mass m of their first slot, that slot's place n by it, and whether they are the first ticket of their slot; windows over the contest only."""
    slot = Window.partitionBy(CONTEST, "a")
    rows = ranked.withColumns({"__m": F.sum("q").over(slot), "__one": F.row_number().over(slot.orderBy("nth")) == 1})
    return rows.withColumn("__place", F.dense_rank().over(Window.partitionBy(CONTEST).orderBy(F.round("__m", 12).desc(), "a")))


def _first_facts(tickets: DataFrame, slots: int) -> list[Column]:
    at = lambda k, c: F.max(F.when(F.col("__place") == k, F.col(c)))
    entropy = -F.sum(F.when(F.col("__one"), F.col("__m") * F.ln(F.greatest("__m", F.lit(1e-12))))) / F.ln(F.lit(float(slots)))
    tops = F.array(*[F.max(F.when(F.col("nth") == k, F.col("a"))) for k in (1, 2, 3)])
    return [at(1, "a").alias("first_slot"), at(1, "__m").alias("first_p"), F.coalesce(at(2, "__m"), F.lit(0.0)).alias("first_p2"), entropy.alias("first_entropy"), tops.alias("tops"), _upset(tickets).alias("first_upset")]


def _first_score(share3: Column) -> Column:
    return _score((0.45, (F.col("first_p") - 1 / 6) / 0.45), (0.25, (F.col("first_p") - F.col("first_p2")) / 0.25), (0.15, share3), (0.15, (1 - F.col("first_entropy")) / 0.45), (-0.08, (F.col("first_upset") - 0.75) / 0.25))


def _share3() -> Column:
    return F.size(F.filter("tops", lambda t: t == F.col("first_slot"))) / 3.0


def first_slot_confidence(tickets: DataFrame, p: str = "probability", slots: int = 6) -> DataFrame:
    """One row for each contest: which slot comes first by the ticket marginals, and how surely. Tickets are read once: marginals are windows."""
    both = _with_marginals(_ranked(tickets, p)).groupBy(CONTEST).agg(*_first_facts(tickets, slots)).withColumn("share3", _share3())
    out = both.withColumn("first_score", _first_score(F.col("share3")))
    return out.select(CONTEST, "first_score", label(F.col("first_score")).alias("first_label"), "first_slot", F.col("first_p").alias("first_probability"), (F.col("first_p") - F.col("first_p2")).alias("first_gap"), "share3", (1 - F.col("first_entropy")).alias("first_concentration"))


def labelled_fact(tickets: DataFrame, keep: Sequence[str], first: bool = False, p: str = "probability", slots: int = 6) -> DataFrame:
    """contest_fact with the best three's score and label, and the first slot's label on request: one aggregate of the tickets, no join."""
    rows = _ranked(tickets, p)
    if first:
        rows = _with_marginals(rows)
    fact = contest_fact(rows, p, keep, also=[*_top3_facts(tickets), *(_first_facts(tickets, slots) if first else ())])
    more = {"score": _top3_score(), **({"first_label": label(_first_score(_share3()))} if first else {})}
    kept = [c for c in fact.columns if c in (CONTEST, "tickets", "actuals", "actual_rank", "p_actual", "p_top", "brier", "first_hit", "covered", *keep)]
    return fact.withColumns(more).withColumn("label", label(F.col("score"))).select(*kept, *more, "label")


def first_slot_from_shares(slots: DataFrame, share: str = "share") -> DataFrame:
    """The same columns from the slots' own probabilities, with weights of their own; where both are there this one counts.

    Shares are cut at 0 and made to add up to 1. A column `upset` of the slots takes off what an unsettled contest does.
    """
    shares = slots.withColumn("m", normalise(F.greatest(F.coalesce(F.col(share), F.lit(0.0)), F.lit(0.0))))
    ranked = shares.withColumn("n", F.row_number().over(Window.partitionBy(CONTEST).orderBy(F.round("m", 12).desc(), "slot")))
    count = F.count("*")
    entropy = F.when(count > 1, -F.sum(F.col("m") * F.ln(F.greatest("m", F.lit(1e-12)))) / F.ln(count)).otherwise(0.0)
    facts = ranked.groupBy(CONTEST).agg(
        F.max(F.when(F.col("n") == 1, F.col("slot"))).alias("first_slot"), F.max(F.when(F.col("n") == 1, F.col("m"))).alias("p"), F.coalesce(F.max(F.when(F.col("n") == 2, F.col("m"))), F.lit(0.0)).alias("p2"),
        (1 / F.least(count, F.lit(3)).cast("double")).alias("share3"), entropy.alias("entropy"), _upset(slots).alias("upset"),
    )
    score = _score((0.50, (F.col("p") - 1 / 6) / 0.35), (0.35, (F.col("p") - F.col("p2")) / 0.20), (0.15, (1 - F.col("entropy")) / 0.45), (-0.08, (F.col("upset") - 0.75) / 0.25))
    out = facts.withColumn("first_score", score)
    return out.select(CONTEST, "first_score", label(F.col("first_score")).alias("first_label"), "first_slot", F.col("p").alias("first_probability"), (F.col("p") - F.col("p2")).alias("first_gap"), "share3", (1 - F.col("entropy")).alias("first_concentration"))


def rank_band(nth: Column) -> Column:
    return F.when(nth <= 1, "top1").when(nth <= 3, "top2_3").when(nth <= 6, "top4_6").when(nth <= 12, "top7_12").otherwise("outside")


def banded(tickets: DataFrame, p: str = "probability") -> DataFrame:
    """Tickets with rank band and the confidence label of their contest; windows over the contest, no join."""
    return labelled(tickets, p, "confidence").withColumn("band", rank_band(F.row_number().over(order_of(F.round(p, 12)))))


def fit_adjustment(tickets: DataFrame, p: str = "probability", actual: str = "is_actual", shrink: int = 300, low: float = 0.25, high: float = 2.0) -> DataFrame:
    """A factor for each confidence and rank band: observed over predicted, shrunk to 1 by the number of tickets."""
    table = banded(tickets, p).groupBy("confidence", "band").agg(F.count("*").alias("n"), F.count_distinct(CONTEST).alias("contests"), F.avg(p).alias("predicted"), F.avg(F.col(actual).cast("double")).alias("observed"))
    raw = F.when(F.col("predicted") > 0, F.col("observed") / F.col("predicted")).otherwise(1.0)
    factor = F.greatest(F.lit(low), F.least(F.lit(high), 1 + (raw - 1) * F.col("n") / (F.col("n") + shrink)))
    return table.select("confidence", "band", "n", "contests", "predicted", "observed", raw.alias("raw_factor"), factor.alias("factor"))


def apply_adjustment(tickets: DataFrame, table: DataFrame, p: str = "probability", out: str = "adjusted") -> DataFrame:
    """Probabilities times their factor (1 where the table has none), adding up to 1 again. The table has at most 15 rows."""
    with_factor = banded(tickets, p).join(F.broadcast(table.select("confidence", "band", "factor")), ["confidence", "band"], "left")
    scaled = with_factor.withColumn("factor", F.coalesce("factor", F.lit(1.0))).withColumn("__x", clip01(F.col(p) * F.col("factor")))
    return scaled.withColumn(out, normalise("__x")).drop("__x")


def window_search(tickets: DataFrame, windows: Sequence[int], share: float, p: str = "probability", day: str = "race_date", shrink: int = 300) -> DataFrame:
    """(days, contests, loss_before, loss_after): for each window of recent days, factors by rank band from its first days and the loss on the rest.

    Ranked tickets are written once for the calendar, the factors and the
    losses. The windows are an array beside each ticket; days are numbered on a
    calendar, and the factors are five rows for each window.
    """
    ranked = tickets.withColumn("band", rank_band(F.row_number().over(order_of(p))))
    ranked = stored(ranked.select(CONTEST, day, p, "is_actual", "band"), "ranked")
    last = ranked.agg(F.max(day).alias("__last"))
    rows = ranked.join(F.broadcast(last)).withColumn("days", F.explode(F.array(*[F.lit(w) for w in windows]))).where(F.col(day) > F.date_sub(F.col("__last"), F.col("days")))
    dates = ranked.select(day).distinct().join(F.broadcast(last)).withColumn("days", F.explode(F.array(*[F.lit(w) for w in windows])))
    calendar = dates.where(F.col(day) > F.date_sub(F.col("__last"), F.col("days"))).select("days", day)
    of_window = Window.partitionBy("days")
    calendar = calendar.select("days", day, (F.row_number().over(of_window.orderBy(day)) > F.floor(F.count("*").over(of_window) * share)).alias("held"))
    rows = rows.join(F.broadcast(calendar), ["days", day])
    table = rows.where("not held").groupBy("days", "band").agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col("is_actual").cast("double")).alias("observed"))
    raw = F.when(F.col("predicted") > 0, F.col("observed") / F.col("predicted")).otherwise(1.0)
    factors = table.select("days", "band", F.greatest(F.lit(0.25), F.least(F.lit(2.0), 1 + (raw - 1) * F.col("n") / (F.col("n") + shrink))).alias("factor"))
    held = rows.where("held").join(F.broadcast(factors), ["days", "band"], "left").withColumn("x", clip01(F.col(p) * F.coalesce("factor", F.lit(1.0))))
    mine = lambda c: F.max(F.when(F.col("is_actual"), F.col(c)))
    per = held.groupBy("days", CONTEST).agg(mine(p).alias("before"), (mine("x") / F.sum("x")).alias("after"))
    loss = lambda c: F.avg(-F.ln(F.greatest(F.col(c), F.lit(1e-15))))
    return per.groupBy("days").agg(F.count("*").alias("contests"), loss("before").alias("loss_before"), loss("after").alias("loss_after"))
