"""Queries over samples, splits and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.functions import numbers
from rankweave.operators import sampling as s
from rankweave.operators import statistics as st
from rankweave.operators.history import Feature, rolling_history
from rankweave.operators.tickets import complete_groups
from rankweave.plans.history_queries import KEY, ORDER, guarded
from rankweave.plans.registry import on_view, query


def hashed(x: str, seed: str = "") -> str:
    return f"CAST(('0x' || substr(sha256('{seed}' || CAST({x} AS VARCHAR)), 1, 8)) AS BIGINT)"


IDS = "SELECT contest_id, min(race_date) AS day, any_value(site) AS site, any_value(payout) AS payout FROM v GROUP BY contest_id"


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each contest that has an entrant."""
    return contest_view(spark, sf_dir).groupBy("contest_id").agg(F.min("race_date").alias("race_date"), F.first("site").alias("site"), F.first("payout").alias("payout"))


@query(on_view("SELECT contest_id, slot FROM v WHERE contest_id IN (SELECT contest_id FROM v GROUP BY contest_id HAVING count(*) = 6 AND count(DISTINCT slot) = 6 AND count(DISTINCT outcome_rank) = 6)"))
def complete_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_groups(contest_view(spark, sf_dir)).select(*KEY)


@query(on_view(f"SELECT contest_id, {hashed('contest_id')} % 5 AS fold, {hashed('contest_id', 'a')} < CAST(0.2 * 4294967296 AS BIGINT) AS is_valid FROM i", i=IDS))
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = s.random_split(contests(spark, sf_dir), 0.2, "a")
    return df.select("contest_id", s.fold("contest_id", 5).alias("fold"), "is_valid")


@query(on_view(f"SELECT contest_id, row_number() OVER (ORDER BY {hashed('contest_id', 's1')}, contest_id) <= greatest(1, floor(0.15 * count(*) OVER () + 0.5)) AS is_valid FROM i", i=IDS))
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.exact_split(contests(spark, sf_dir), 0.15, "s1").select("contest_id", "is_valid")


@query(on_view("SELECT contest_id, day >= CAST((SELECT max(day) FROM i) - INTERVAL 6 MONTH + INTERVAL 1 DAY AS DATE) AS is_final FROM i", i=IDS))
def hold_out_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.hold_out_months(contests(spark, sf_dir), 6).select("contest_id", "is_final")


@query(on_view("SELECT contest_id FROM (SELECT contest_id, row_number() OVER (ORDER BY day, contest_id) - 1 AS k, count(*) OVER () AS n FROM i) WHERE k IN (SELECT CAST(floor(g * ((SELECT count(*) FROM i) - 1) / 199.0) AS BIGINT) FROM range(200) AS r(g))", i=IDS))
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 contests spread evenly over time."""
    return s.even_sample(contests(spark, sf_dir), 200).select("contest_id")


CONTROLS = f"""
SELECT contest_id, is_case FROM (
    SELECT *, row_number() OVER (PARTITION BY month, site, is_case ORDER BY {hashed('contest_id', 'm')}, contest_id) AS r, count(*) FILTER (is_case) OVER (PARTITION BY month, site) AS cases
    FROM (SELECT *, CAST(date_trunc('month', day) AS DATE) AS month, payout >= 400000 AS is_case FROM i))
WHERE is_case OR r <= 2 * cases
"""


@query(on_view(CONTROLS, i=IDS))
def matched_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests of large payout, and twice as many others of the same month and site."""
    df = contests(spark, sf_dir).withColumn("month", F.trunc("race_date", "month"))
    return s.matched_controls(df, F.col("payout") >= 400_000, ["month", "site"], 2, "m").select("contest_id", "is_case")


@query(on_view("SELECT contest_id, block FROM i JOIN (SELECT day, ntile(7) OVER (ORDER BY day) AS block FROM (SELECT DISTINCT day FROM i)) USING (day)", i=IDS))
def chronological_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.chronological_blocks(contests(spark, sf_dir), 7).select("contest_id", "block")


@query(on_view("SELECT contest_id, round(CASE WHEN payout >= 100000 THEN 5.0 WHEN payout >= 50000 THEN 3.0 WHEN payout >= 10000 THEN 2.0 ELSE 1.0 END * CASE WHEN day >= DATE '1997-01-01' THEN 0.7 ELSE 0.3 END, 9) AS time_weight, CASE WHEN payout < 1000 THEN 0.7 WHEN payout < 5000 THEN 1.0 WHEN payout < 10000 THEN 1.3 WHEN payout < 30000 THEN 1.8 WHEN payout < 50000 THEN 1.2 ELSE 0.6 END AS payout_weight FROM i", i=IDS))
def training_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contests(spark, sf_dir).select("contest_id", F.round(s.time_weights("race_date", "payout", "1997-01-01"), 9).alias("time_weight"), s.payout_weights("payout").alias("payout_weight"))


NUMERIC = ["lead_time", "trial_time", "raw_score", "position", "payout"]
PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS present, round(1 - count({c}) / count(*), 9) AS missing_rate, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, coalesce(min({c}) = max({c}), true) AS is_constant FROM v" for c in NUMERIC)


@query(on_view(PROFILE))
def feature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.profile(contest_view(spark, sf_dir), NUMERIC)
    return out.select("column", "rows", "present", F.round("missing_rate", 9).alias("missing_rate"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "is_constant")


PAIRS = [(x, y) for x in NUMERIC[:4] for y in ("outcome_rank", "payout")]


@query(on_view(" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)), 9) AS pearson FROM v WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in PAIRS)))
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.correlations(contest_view(spark, sf_dir), PAIRS)
    return out.select("x", "y", "n", F.round("pearson", 9).alias("pearson"))


UPPER = [(x, y) for i, x in enumerate(NUMERIC) for y in NUMERIC[i + 1 :]]


@query(on_view("SELECT x, y, n, round(r, 9) AS pearson FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS r FROM v WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in UPPER) + ") WHERE abs(r) >= 0.001 ORDER BY abs(r) DESC, x, y LIMIT 5"))
def strongest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report of correlated columns."""
    out = st.strongest_pairs(contest_view(spark, sf_dir), NUMERIC, 0.001, 5)
    return out.select("x", "y", "n", F.round("pearson", 9).alias("pearson"))


@query(on_view("SELECT round(corr(rx, ry), 9) AS spearman, count(*) AS n FROM (SELECT rank() OVER (ORDER BY lead_time) + (count(*) OVER (PARTITION BY lead_time) - 1) / 2.0 AS rx, rank() OVER (ORDER BY payout) + (count(*) OVER (PARTITION BY payout) - 1) / 2.0 AS ry FROM v)"))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation over the table; ranks come from counts of values, not from one sort of all rows."""
    v = contest_view(spark, sf_dir).select("lead_time", "payout")
    ranked = st.average_ranks(st.average_ranks(v, "lead_time", "rx"), "payout", "ry")
    return ranked.agg(F.round(F.corr("rx", "ry"), 9).alias("spearman"), F.count("*").alias("n"))


RANKED = ("lead_time", "raw_score", "position", "outcome_rank", "payout")
RANK_PAIRS = [(x, y) for x in RANKED[:3] for y in RANKED[3:]]
AVERAGE_RANKS = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in RANKED) + " FROM v"


@query(on_view(" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, count(*) AS n, round(corr({x}, {y}), 9) AS spearman FROM r" for x, y in RANK_PAIRS), r=AVERAGE_RANKS))
def spearman_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of every input with every target."""
    df = contest_view(spark, sf_dir).select(*RANKED)
    for c in RANKED:
        df = st.average_ranks(df, c, f"r_{c}")
    out = st.correlations(df.select([F.col(f"r_{c}").alias(c) for c in RANKED]), RANK_PAIRS)
    return out.select("x", "y", "n", F.round("pearson", 9).alias("spearman"))


@query(on_view(f"SELECT contest_id, slot, CAST({hashed('site')} % 16 AS DOUBLE) AS site_bucket, CAST({hashed('entity_id')} % 64 AS DOUBLE) AS entity_bucket FROM v"))
def hashed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of many values as numbers of a fixed range."""
    return contest_view(spark, sf_dir).select(*KEY, numbers.hash_bucket(F.col("site"), 16).alias("site_bucket"), numbers.hash_bucket(F.col("entity_id"), 64).alias("entity_bucket"))


@query(on_view("SELECT round(quantile_cont(payout, 0.7), 6) AS payout_q70, round(quantile_cont(payout, 0.5), 6) AS payout_q50, round(quantile_cont(raw_score, 0.7), 6) AS raw_score_q70, round(quantile_cont(raw_score, 0.5), 6) AS raw_score_q50 FROM v"))
def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.quantiles(contest_view(spark, sf_dir), ["payout", "raw_score"], [0.7, 0.5])
    return out.select([F.round(c, 6).alias(c) for c in out.columns])


FORM = "SELECT contest_id, slot, " + guarded("avg", "lead_time", "site", 20, 3) + " AS form FROM v"


def blocked_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over a few sites, cut into blocks of 200 rows that lend their ends."""
    return rolling_history(contest_view(spark, sf_dir), ["site"], ORDER, [Feature("form", "lead_time", 20, 3)], block=200).select(*KEY, "form")


@query(on_view("SELECT contest_id, slot, round(form, 9) AS form FROM fo", fo=FORM))
def blocked_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling windows over few keys by blocks, against windows over whole keys."""
    return blocked_form(spark, sf_dir).select(*KEY, F.round("form", 9).alias("form"))


@query(on_view("SELECT 'form' AS \"column\", count(*) FILTER (contest_id % 7 = 0) AS only_left, CAST(0 AS BIGINT) AS only_right, count(*) FILTER (contest_id % 7 <> 0 AND slot = 2 AND form IS NOT NULL) AS different FROM fo", fo=FORM))
def blocked_history_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by blocks compared row by row with plain ones, of which every seventh contest is left out and slot 2 is changed."""
    plain = rolling_history(contest_view(spark, sf_dir), ["site"], ORDER, [Feature("form", "lead_time", 20, 3)]).where("contest_id % 7 <> 0")
    changed = plain.select(*KEY, F.when(F.col("slot") == 2, F.col("form") + 1).otherwise(F.col("form")).alias("form"))
    return st.table_diff(blocked_form(spark, sf_dir), changed, KEY, ["form"], 1e-9)
