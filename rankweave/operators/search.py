"""Searches over settings: candidates of a contest in one row, a grid expanded beside them, metrics of each grid point."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.operators.relative import clip01, group, rank_average
from rankweave.operators.sampling import even_sample
from rankweave.operators.tickets import CONTEST, order_of

# Weights of the tuning objective, and how much more log loss than the baseline's it lets pass.
OBJECTIVE = {"hit12": 0.40, "hit5": 0.15, "hit3": 0.15, "hit1": 0.15, "mrr": 0.15, "log_loss": -0.10}
GUARD = 0.03


def payloads(tickets: DataFrame, base: str, update: str, actual: str, n: int, start: int = 5) -> DataFrame:
    """One row for each contest: its n best tickets with both rank scores and how late they are, and whether the update says anything.

    Scores are 1 for the first and 0 for the last candidate; `late` rises from 0 at place `start` to 1 at the last.
    """
    best = tickets.withColumn("nth", F.row_number().over(order_of(base))).where(F.col("nth") <= n)
    steps = F.greatest(F.count("*").over(group()) - 1, F.lit(1))
    scored = best.withColumns({"x": 1 - (rank_average(base, ascending=False) - 1) / steps, "y": 1 - (rank_average(update, ascending=False) - 1) / steps, "late": clip01((F.col("nth") - start) / F.greatest(F.count("*").over(group()) - start, F.lit(1)))})
    entry = F.struct("nth", "x", "y", "late", F.col(actual).alias("actual"))
    flat = F.max(update) - F.min(update) <= 1e-8 + 1e-5 * F.abs(F.max(update))
    return scored.groupBy(CONTEST).agg(F.sort_array(F.collect_list(entry)).alias("candidates"), flat.alias("flat"))


def outcomes(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """(contest, weight, penalty, rank, p_actual) of each contest at each point of a small grid; nulls where the actual ticket is no candidate.

    The grid is put beside the rows as an array, so rows aren't shuffled for it.
    """
    points = grid.agg(F.collect_list(F.struct("weight", "penalty")).alias("points"))
    at = rows.join(F.broadcast(points)).withColumn("p", F.explode("points")).select(CONTEST, "candidates", "flat", "p.weight", "p.penalty")

    def score(c: Column) -> Column:
        mixed = F.col("weight") * c["x"] + (1 - F.col("weight")) * clip01(c["y"] - c["late"] * F.col("penalty"))
        return F.struct((-F.round(F.when(F.col("flat"), c["x"]).otherwise(mixed), 12)).alias("s"), c["nth"].alias("nth"), c["actual"].alias("actual"))

    at = at.withColumn("scored", F.transform("candidates", score))
    mine = F.try_element_at(F.filter("scored", lambda c: c["actual"]), F.lit(1))
    before = F.size(F.filter("scored", lambda c: F.struct(c["s"], c["nth"]) < F.struct(F.col("mine.s"), F.col("mine.nth"))))
    total = F.aggregate("scored", F.lit(0.0), lambda t, c: t - c["s"])
    at = at.withColumn("mine", mine)
    return at.select(CONTEST, "weight", "penalty", F.when(F.col("mine").isNotNull(), before + 1).alias("rank"), F.when(F.col("mine").isNotNull(), F.greatest(-F.col("mine.s") / total, F.lit(1e-15))).alias("p_actual"))


def point_metrics(found: DataFrame) -> DataFrame:
    """(weight, penalty, contests, covered, hit1.., mrr, log_loss): hits over all contests, the rest over covered ones."""
    hit = lambda k: F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")).alias(f"hit{k}")
    return found.groupBy("weight", "penalty").agg(F.count("*").alias("contests"), F.count("rank").alias("covered"), *[hit(k) for k in (1, 3, 5, 12)], F.avg(1 / F.col("rank")).alias("mrr"), F.avg(-F.ln("p_actual")).alias("log_loss"))


def judged(points: DataFrame, weight: float = 1.0, penalty: float = 0.0, objective: Mapping[str, float] = OBJECTIVE, guard: float = GUARD) -> DataFrame:
    """Grid points with the objective, the differences from the baseline point and whether they stay inside the guard."""
    every = Window.partitionBy(F.lit(1))  # as many rows as grid points; a join with the baseline's row would compute them all again
    is_base = (F.col("weight") == weight) & (F.col("penalty") == penalty)
    of_base = lambda c: F.max(F.when(is_base, F.col(c))).over(every)
    rows = points.withColumns({"base_loss": of_base("log_loss"), "base_hit12": of_base("hit12"), "__base": F.max(is_base).over(every)}).where("__base")
    excess = F.greatest(F.col("log_loss") - F.col("base_loss") - guard, F.lit(0.0))
    total = sum((w * F.col(c) for c, w in objective.items()), F.lit(0.0)) - excess
    return rows.select(*points.columns, F.round(total, 9).alias("objective"), (F.col("hit12") - F.col("base_hit12")).alias("hit12_delta"), (F.col("log_loss") - F.col("base_loss")).alias("log_loss_delta"), (excess <= 0).alias("inside_guard"))


def two_stage(rows: DataFrame, grid: DataFrame, days: DataFrame, sample: int, keep: int) -> DataFrame:
    """Every grid point on an even sample of contests, then the `keep` best ones and the baseline on all; rows are read twice and should be stored."""
    some = rows.join(even_sample(days, sample).select(CONTEST), CONTEST, "left_semi")
    best = judged(point_metrics(outcomes(some, grid))).orderBy(F.desc("objective"), F.desc("weight"), "penalty").limit(keep).select("weight", "penalty")
    baseline = grid.where("weight = 1 and penalty = 0").select("weight", "penalty")
    return judged(point_metrics(outcomes(rows, best.unionByName(baseline).distinct())))


def open_points(grid: DataFrame, done: DataFrame, contests: int) -> DataFrame:
    """Grid points that no saved result of the same number of contests covers: where a search goes on."""
    return grid.join(done.where(F.col("contests") == contests).select("weight", "penalty"), ["weight", "penalty"], "left_anti")


def sampled_trials(n: int) -> list[tuple[float, float, float]]:
    """Weights of three parts that add up to 1, spread evenly: a low-discrepancy sequence of points, cut at their two coordinates.

    The steps are those of the plane's additive recurrence: powers of the root of x**3 = x + 1.
    """
    root = 1.32471795724474602596
    points = [((0.5 + k / root) % 1, (0.5 + k / root**2) % 1) for k in range(1, n + 1)]
    return [(round(min(u, v), 6), round(abs(u - v), 6), round(1 - round(min(u, v), 6) - round(abs(u - v), 6), 6)) for u, v in points]


def halving(evaluate: Callable[[Sequence[int], int], Mapping[int, tuple[int, float]]], trials: int, folds: int, least: int = 1) -> list[tuple[int, int, float, int]]:
    """(trial, contests, value, folds seen) of every trial: after each fold the better half of those left goes on.

    evaluate(trials, fold) gives each trial's number of contests and mean
    value there; values are averaged by contests, ties go to the smaller trial.
    What the driver holds is a row for each trial.
    """
    left, seen = list(range(trials)), {k: (0, 0.0, 0) for k in range(trials)}
    for fold in range(folds):
        for k, (n, value) in evaluate(left, fold).items():
            count, total, rounds = seen[k]
            seen[k] = (count + n, total + n * value, rounds + 1)
        mean = {k: seen[k][1] / seen[k][0] if seen[k][0] else float("-inf") for k in left}
        left = sorted(left, key=lambda k, mean=mean: (-round(mean[k], 9), k))[: max(least, len(left) // 2)]
    return [(k, n, total / n if n else 0.0, rounds) for k, (n, total, rounds) in seen.items()]
