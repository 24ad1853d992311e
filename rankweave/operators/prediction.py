"""Predictions as a reader sees them: rankings, confidence, buy lists, favourite rows and rescored tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.relative import clip01, group
from rankweave.operators.tickets import CONTEST

# Weights of the confidence of a prediction, and where its labels begin.
TOP, LEAD, TICKET_LEAD = 0.5, 0.3, 0.2
HIGH, MIDDLE = 0.22, 0.16


def nth_largest(x: str, n: int) -> Column:
    """The n-th largest value of a group, 0 where there are fewer; for use in agg."""
    return F.coalesce(F.try_element_at(F.sort_array(F.collect_list(x), asc=False), F.lit(n)), F.lit(0.0))


def prediction_confidence(slots: DataFrame, tickets: DataFrame, share: str = "share", p: str = "probability") -> DataFrame:
    """(contest, confidence, label): how far the best slot and the best ticket are ahead."""
    best = slots.groupBy(CONTEST).agg(nth_largest(share, 1).alias("first"), nth_largest(share, 2).alias("second"))
    top = tickets.groupBy(CONTEST).agg(F.max(p).alias("t1"), nth_largest(p, 2).alias("t2"))  # a contest's tickets are few
    ahead = lambda x, y: F.greatest(F.col(x) - F.col(y), F.lit(0.0))
    score = clip01(TOP * F.col("first") + LEAD * ahead("first", "second") + TICKET_LEAD * ahead("t1", "t2"))
    out = best.join(top, CONTEST).select(CONTEST, score.alias("confidence"))
    return out.withColumn("label", F.when(F.col("confidence") >= HIGH, "high").when(F.col("confidence") >= MIDDLE, "middle").otherwise("low"))


def buy_list(tickets: DataFrame, amount: str, by: Sequence[str], n: int) -> DataFrame:
    """The n best tickets of each contest that are to be bought, or of all where none is."""
    any_bought = F.max((F.col(amount) > 0).cast("int")).over(group())
    order = Window.partitionBy(CONTEST).orderBy(*[F.desc(c) for c in by], "a", "b", "c")
    kept = tickets.withColumn("__any", any_bought).where((F.col(amount) > 0) | (F.col("__any") == 0))
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("__any")


def favourite_row(slots: DataFrame, own: Sequence[str], outside: Sequence[str], at_places: dict[str, tuple[int, str]], also: Sequence[Column] = ()) -> DataFrame:
    """One row for each contest: the favourite's values as own_x, the best outside as max_outer_x, and values at named places.

    The favourite is the entrant at place 1, else the one of slot 1, else the first slot. also: more aggregates of the contest.
    """
    rank = F.when(F.col("position") == 1, 0).when(F.col("slot") == 1, 1).otherwise(2)
    first = F.struct(rank.alias("rank"), "slot")
    place = F.coalesce("position", "slot")
    found = [F.min_by(c, first).alias(f"own_{c}") for c in own]
    found += [F.coalesce(F.max(F.when(place >= 2, F.col(c))), F.lit(0.0)).alias(f"max_outer_{c}") for c in outside]
    found += [F.coalesce(F.max(F.when(F.col("position") == k, F.col(c))), F.lit(0.0)).alias(name) for name, (k, c) in at_places.items()]
    return slots.groupBy(CONTEST).agg(*found, *also)


def favourite_rank() -> Column:
    """The favourite's outcome, for use in agg; null where there is no favourite or no outcome."""
    favourite = F.coalesce(F.max(F.when(F.col("position") == 1, F.struct((-F.col("slot")).alias("s"), "outcome_rank"))), F.max(F.when(F.col("slot") == 1, F.struct((-F.col("slot")).alias("s"), "outcome_rank"))))
    return favourite["outcome_rank"]


def favourite_outcome(rank: str) -> dict[str, Column]:
    return {"won": (F.col(rank) == 1).cast("int"), "collapsed": (F.col(rank) >= 3).cast("int")}


def favourite_target(slots: DataFrame) -> DataFrame:
    """(contest, won, collapsed) of the favourite; a contest without one, or without its outcome, has no row."""
    rows = slots.groupBy(CONTEST).agg(favourite_rank().alias("rank")).where("rank is not null")
    return rows.select(CONTEST, *[c.alias(k) for k, c in favourite_outcome("rank").items()])


def rescored(score: Column, second: Column, third: Column, floor: float = 1e-9) -> Column:
    """A ticket's score times the probabilities of its second and third slot, each 1 where unknown and never 0."""
    at_least = lambda x: F.greatest(F.coalesce(x, F.lit(1.0)), F.lit(floor))
    return score * at_least(second) * at_least(third)


def place_label(size: int = 6) -> Column:
    """For use in agg: whether all entrants start where their slot says; unknown in incomplete contests."""
    whole = (F.count("*") == size) & (F.count("slot") == size) & (F.count("position") == size) & (F.count_distinct("slot") == size) & (F.count_distinct("position") == size)
    return F.when(~whole, "unknown").when(F.bool_and(F.col("slot") == F.col("position")), "match").otherwise("mismatch")


def small_samples_merged(df: DataFrame, label: str, least: int, name: str = "__small_sample__") -> DataFrame:
    """df with labels of fewer than `least` rows put together."""
    few = df.groupBy(label).agg(F.count("*").alias("__n")).where(F.col("__n") < least).select(label, F.lit(True).alias("__few"))
    return df.join(few, label, "left").withColumn(label, F.when(F.col("__few"), name).otherwise(F.col(label))).drop("__few")
