"""Queries over features relative to the contest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.operators import relative as r
from rankweave.operators.history import Feature, rolling_history
from rankweave.plans.history_queries import KEY, ORDER, guarded, rounded
from rankweave.plans.registry import on_view, query

G = "PARTITION BY contest_id"


@query(on_view(f"""
SELECT contest_id, slot,
       CASE WHEN trial_time IS NOT NULL THEN rank() OVER ({G} ORDER BY trial_time DESC NULLS LAST) END AS trial_rank,
       CASE WHEN lead_time IS NOT NULL THEN rank() OVER ({G} ORDER BY lead_time NULLS LAST) END AS lead_rank_low,
       row_number() OVER ({G} ORDER BY raw_score DESC NULLS LAST, slot) AS score_first,
       CASE WHEN trial_time IS NOT NULL THEN rank() OVER ({G} ORDER BY trial_time NULLS LAST) + (count(*) OVER ({G}, trial_time) - 1) / 2.0 END AS trial_average_rank,
       round(CASE WHEN trial_time IS NOT NULL THEN (rank() OVER ({G} ORDER BY trial_time NULLS LAST) + (count(*) OVER ({G}, trial_time) - 1) / 2.0) / count(trial_time) OVER ({G}) END, 9) AS trial_percent
FROM v
"""))
def ranks_in_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rank kinds: smallest, first, average and percent, nulls without a rank."""
    out = contest_view(spark, sf_dir).withColumns({"trial_rank": r.rank_min("trial_time"), "lead_rank_low": r.rank_min("lead_time", ascending=True), "score_first": r.rank_first("raw_score", "slot"), "trial_average_rank": r.rank_average("trial_time"), "trial_percent": F.round(r.rank_percent("trial_time"), 9)})
    return out.select(*KEY, "trial_rank", "lead_rank_low", "score_first", "trial_average_rank", "trial_percent")


@query(on_view(f"""
SELECT contest_id, slot,
       round(avg(lead_time) OVER ({G}), 9) AS lead_mean,
       round(stddev_samp(lead_time) OVER ({G}), 9) AS lead_std,
       round(lead_time - avg(lead_time) OVER ({G}), 9) AS lead_diff_mean,
       round(lead_time - min(lead_time) OVER ({G}), 9) AS lead_diff_best,
       round(raw_score - max(raw_score) OVER ({G}), 9) AS score_diff_best,
       round(CASE WHEN stddev_samp(raw_score) OVER ({G}) > 1e-9 THEN (raw_score - avg(raw_score) OVER ({G})) / stddev_samp(raw_score) OVER ({G}) END, 9) AS score_z,
       round(coalesce(CASE WHEN max(lead_time) OVER ({G}) > min(lead_time) OVER ({G}) THEN (max(lead_time) OVER ({G}) - lead_time) / (max(lead_time) OVER ({G}) - min(lead_time) OVER ({G})) END, 0), 9) AS lead_scaled,
       round(coalesce(CASE WHEN max(trial_time) OVER ({G}) > min(trial_time) OVER ({G}) THEN (max(trial_time) OVER ({G}) - trial_time) / (max(trial_time) OVER ({G}) - min(trial_time) OVER ({G})) END, 0), 9) AS trial_scaled
FROM v
"""))
def spread_in_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group mean, spread, distance to mean and best, z-score and scaling."""
    group = r.group()
    return rounded(contest_view(spark, sf_dir).withColumns({
        "lead_mean": F.avg("lead_time").over(group), "lead_std": r.spread("lead_time"), "lead_diff_mean": r.from_mean("lead_time"),
        "lead_diff_best": r.from_best("lead_time", lower=True), "score_diff_best": r.from_best("raw_score"),
        "score_z": F.when(r.spread("raw_score") > 1e-9, r.zscore("raw_score")), "lead_scaled": r.minmax("lead_time", lower=True), "trial_scaled": r.minmax("trial_time", lower=True),
    }), "lead_mean", "lead_std", "lead_diff_mean", "lead_diff_best", "score_diff_best", "score_z", "lead_scaled", "trial_scaled")


P = f"{G} ORDER BY position, slot"


@query(on_view(f"""
SELECT contest_id, slot,
       round(lead_time - lag(lead_time) OVER ({P}), 9) AS gap_inner,
       round(lead_time - lead(lead_time) OVER ({P}), 9) AS gap_outer,
       round(lead_time - avg(lead_time) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9) AS gap_inner_mean,
       round(lead_time - avg(lead_time) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9) AS gap_outer_mean,
       round(avg(CASE WHEN position <= 3 THEN lead_time END) OVER ({G}), 9) AS inner3_mean,
       round(avg(CASE WHEN position > 3 THEN lead_time END) OVER ({G}), 9) AS outer3_mean,
       CAST(position <= 3 AS INT) AS is_inner, CAST(position >= 5 AS INT) AS is_outer, position - slot AS moved
FROM v
"""))
def neighbours_in_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps to the neighbours, to all inside and outside, and to the two halves."""
    order = ("position", "slot")
    names = ["gap_inner", "gap_outer", "gap_inner_mean", "gap_outer_mean", "inner3_mean", "outer3_mean"]
    columns = [r.neighbour_gap("lead_time", 1, *order), r.neighbour_gap("lead_time", -1, *order), r.side_gap("lead_time", True, *order), r.side_gap("lead_time", False, *order), r.masked_mean("lead_time", F.col("position") <= 3), r.masked_mean("lead_time", F.col("position") > 3)]
    out = contest_view(spark, sf_dir).withColumns(dict(zip(names, columns, strict=True)))
    flags = [(F.col("position") <= 3).cast("int").alias("is_inner"), (F.col("position") >= 5).cast("int").alias("is_outer"), (F.col("position") - F.col("slot")).alias("moved")]
    return out.select(*KEY, *[F.round(n, 9).alias(n) for n in names], *flags)


@query(on_view(f"""
SELECT contest_id, slot, round(e / sum(e) OVER ({G}), 9) AS win_share, round(CASE WHEN sum(raw_score) OVER ({G}) > 0 THEN raw_score / sum(raw_score) OVER ({G}) ELSE 1.0 / count(*) OVER ({G}) END, 9) AS score_share,
       min(CASE WHEN raw_score = top AND raw_score > 0 AND position <> 1 THEN position END) OVER ({G}) AS candidate
FROM (SELECT *, exp(raw_score - max(raw_score) OVER ({G})) AS e, max(raw_score) OVER ({G}) AS top FROM v)
"""))
def shares_in_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax, shares of a sum, and the place of the largest score."""
    return contest_view(spark, sf_dir).select(*KEY, F.round(r.softmax("raw_score"), 9).alias("win_share"), F.round(r.normalise("raw_score"), 9).alias("score_share"), r.arg_max("raw_score", "position", F.col("position") != 1).alias("candidate"))


@query(on_view(f"""
SELECT contest_id, slot, round(CASE WHEN n > 1 THEN -sum(q * ln(q)) OVER ({G}) / ln(n) ELSE 0 END, 9) AS entropy
FROM (SELECT contest_id, slot, n, greatest(e / sum(e) OVER ({G}), 1e-12) AS q FROM (SELECT *, exp(raw_score - max(raw_score) OVER ({G})) AS e, count(*) OVER ({G}) AS n FROM v))
"""))
def entropy_in_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised entropy of the softmax shares."""
    shares = contest_view(spark, sf_dir).withColumn("share", r.softmax("raw_score"))
    return shares.select(*KEY, F.round(r.entropy("share"), 9).alias("entropy"))


SPANS = (5, 10, 30)


@query(on_view(f"""
SELECT contest_id, slot, round(low, 9) AS inner_mean, round(high, 9) AS outer_mean, round(high - low, 9) AS halves_gap, round(lead_time - low, 9) AS from_inner, round(lead_time - high, 9) AS from_outer,
       round(best, 9) AS best_before, round(worst, 9) AS worst_before, round(worst - best, 9) AS range_before, round(lead_time - best, 9) AS from_best_before
FROM (SELECT *, avg(CASE WHEN position <= 3 THEN lead_time END) OVER ({G}) AS low, avg(CASE WHEN position > 3 THEN lead_time END) OVER ({G}) AS high,
             least({', '.join(guarded('min', 'lead_time', 'entity_id', n, 3) for n in SPANS)}) AS best, greatest({', '.join(guarded('max', 'lead_time', 'entity_id', n, 3) for n in SPANS)}) AS worst FROM v)
"""))
def lead_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of the inner and outer places, and an entity's best and worst lead over several windows before."""
    bounds = [Feature(f"{how}{n}", "lead_time", n, 3, how) for n in SPANS for how in ("min", "max")]
    df = rolling_history(contest_view(spark, sf_dir), ["entity_id"], ORDER, bounds).withColumns(r.halves("lead_time", "position"))
    df = df.withColumns({"best_before": F.least(*[f"min{n}" for n in SPANS]), "worst_before": F.greatest(*[f"max{n}" for n in SPANS])})
    df = df.withColumns({"range_before": F.col("worst_before") - F.col("best_before"), "from_best_before": F.col("lead_time") - F.col("best_before")})
    return rounded(df, "inner_mean", "outer_mean", "halves_gap", "from_inner", "from_outer", "best_before", "worst_before", "range_before", "from_best_before")
