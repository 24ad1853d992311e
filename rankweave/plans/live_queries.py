"""Queries over a day's entries, their history, and the training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankweave.core.contest import contest_view
from rankweave.operators import live, relative
from rankweave.operators.history import Feature, Recent, rolling_history
from rankweave.plans.history_queries import ENTITY, F_SQL, KEY, ORDER, SQL_HOW, flagged, guarded, rounded, with_targets
from rankweave.plans.registry import on_view, query
from rankweave.sources import tables

MONTHS = 36
FAMILIES = [
    live.Family(("entity_id",), (Recent("win30", "is_win", 30), Recent("win5", "is_win", 5), Recent("top3_30", "is_top3", 30), Recent("rank5", "outcome_rank", 5), Recent("rank_best5", "outcome_rank", 5, "min"), Recent("lead30", "lead_time", 30), Recent("lead_std10", "lead_time", 10, "std"), Recent("trial30", "trial_time", 30), Recent("position30", "position", 30))),
    live.Family(("entity_id", "site"), (Recent("site_win", "is_win", 15), Recent("site_lead", "lead_time", 15), Recent("site_trial", "trial_time", 15), Recent("site_position", "position", 15))),
    live.Family(("entity_id", "slot"), (Recent("slot_top3", "is_top3", 30), Recent("slot_lead", "lead_time", 30))),
    live.Family(("machine_a",), (Recent("machine_a_top3", "is_top3", 30),)),
    live.Family(("machine_b",), (Recent("machine_b_top3", "is_top3", 30),)),
    live.Family(("site", "machine_a"), (Recent("site_machine_a_win", "is_win", 30),)),
    live.Family(("site", "machine_b"), (Recent("site_machine_b_win", "is_win", 30),)),
    live.Family(("site", "slot"), (Recent("site_slot_win", "is_win", 200), Recent("site_slot_top2", "is_top2", 200))),
    live.Family(("entity_id", "machine_a"), (Recent("pair_rank", "outcome_rank", 10),)),
]
FILLED = {"lead_time": ("site_lead", "lead30"), "trial_time": ("site_trial", "trial30"), "position": ("site_position", "position30")}
ALIGNED = {**dict.fromkeys([f.out for fam in FAMILIES for f in fam.features], "double"), "starts": "bigint", **dict.fromkeys(FILLED, "double"), "lead_rank": "int", "lead_from_mean": "double", "not_built": "double"}


def _last_day(df: DataFrame):
    return df.agg(F.max("race_date")).head()[0]


def live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of the table's last day, with the history of the three years before it."""
    v = contest_view(spark, sf_dir)
    day = _last_day(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("race_date"), "o_orderkey").join(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"))
    entries = live.entry_columns(v.where(F.col("race_date") == F.lit(day)))
    history = with_targets(live.history_before(v, day, MONTHS))
    rows = live.with_starts(live.with_recent(entries, history, ORDER, FAMILIES), history, "entity_id")
    return rows.withColumns(live.proxies(FILLED))


def _tail_sql(family: live.Family, name: str) -> str:
    keys = ", ".join(family.keys)
    sources = dict.fromkeys(f.source for f in family.features)
    numbers = ", ".join(f"CASE WHEN {s} IS NOT NULL THEN count({s}) OVER (PARTITION BY {keys} ORDER BY race_date DESC, contest_no DESC, slot DESC ROWS UNBOUNDED PRECEDING) END AS n_{s}" for s in sources)
    found = ", ".join(f"{SQL_HOW[f.how]}(CASE WHEN n_{f.source} <= {f.window} THEN {f.source} END) AS {f.out}" for f in family.features)
    return f"LEFT JOIN (SELECT {keys}, {found} FROM (SELECT *, {numbers} FROM h) GROUP BY {keys}) AS {name} USING ({keys})"


HISTORY = f"{F_SQL} WHERE race_date < (SELECT max(race_date) FROM v) AND race_date >= CAST((SELECT max(race_date) FROM v) - INTERVAL {MONTHS} MONTH AS DATE)"
LIVE = (
    "SELECT * EXCLUDE (outcome_rank, position, lead_time, trial_time, style, payout), " + ", ".join(f"coalesce({', '.join(s)}) AS {m}" for m, s in FILLED.items())
    + " FROM (SELECT * FROM v WHERE race_date = (SELECT max(race_date) FROM v)) AS e " + " ".join(_tail_sql(f, f"f{i}") for i, f in enumerate(FAMILIES)) + " LEFT JOIN (SELECT entity_id, count(*) AS starts FROM h GROUP BY entity_id) USING (entity_id)"
)
SHOWN = [c for c, k in ALIGNED.items() if k == "double" and c not in ("not_built", "lead_from_mean")]


@query(on_view("SELECT contest_id, slot, " + ", ".join(f"round({c}, 9) AS {c}" for c in SHOWN) + ", starts, CASE WHEN round(lead_time, 12) IS NOT NULL THEN rank() OVER (PARTITION BY contest_id ORDER BY round(lead_time, 12) NULLS LAST) END AS lead_rank, round(lead_time - avg(lead_time) OVER (PARTITION BY contest_id), 9) AS lead_from_mean, CAST(NULL AS DOUBLE) AS not_built FROM e", h=HISTORY, e=LIVE))
def live_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows of the last day: nine families of recent history, proxies for measures, relatives, a model's columns."""
    rows = live_rows(spark, sf_dir)
    rows = rows.withColumns({"lead_rank": relative.rank_min(F.round("lead_time", 12), ascending=True), "lead_from_mean": relative.from_mean("lead_time")})
    rows = live.aligned(rows, {"contest_id": "bigint", "slot": "int", **ALIGNED})
    return rows.select(*KEY, *[F.round(c, 9).alias(c) if k == "double" else c for c, k in ALIGNED.items()])


@query(on_view("SELECT contest_id, slot, entity_id, round(lead_time, 9) AS expected_lead, round(lead_std10, 9) AS lead_std, starts, row_number() OVER (PARTITION BY contest_id ORDER BY round(lead_time, 12) NULLS LAST, slot) AS expected_place FROM e", h=HISTORY, e=LIVE))
def lead_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lead each entrant of the last day is expected to have, and the order that gives."""
    place = F.row_number().over(Window.partitionBy("contest_id").orderBy(F.round("lead_time", 12).asc_nulls_last(), "slot"))
    return live_rows(spark, sf_dir).select(*KEY, "entity_id", F.round("lead_time", 9).alias("expected_lead"), F.round("lead_std10", 9).alias("lead_std"), "starts", place.alias("expected_place"))


PROXY = [Feature("lead30", "lead_time", 30, 3), Feature("lead5", "lead_time", 5, 2), Feature("trial30", "trial_time", 30, 3)]


@query(on_view("SELECT contest_id, slot, round(lead, 9) AS lead_time, round(trial, 9) AS trial_time, CASE WHEN lead IS NOT NULL THEN rank() OVER (PARTITION BY contest_id ORDER BY lead NULLS LAST) END AS lead_time_rank, round(lead - avg(lead) OVER (PARTITION BY contest_id), 9) AS lead_time_from_mean FROM (SELECT contest_id, slot, round(coalesce(lead5, lead30), 12) AS lead, trial30 AS trial FROM h)", h="SELECT contest_id, slot, " + ", ".join(f"{guarded(SQL_HOW[f.how], f.source, 'entity_id', f.window, f.least)} AS {f.out}" for f in PROXY) + " FROM v"))
def prediction_time_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the contest replaced by what was known before it, and the columns relative to them built again."""
    made = {"lead_time_rank": "lead_time", "lead_time_from_mean": "lead_time"}
    rows = rolling_history(contest_view(spark, sf_dir), ["entity_id"], ORDER, PROXY)
    rows = rows.withColumns({"lead_time_rank": relative.rank_min("lead_time", ascending=True), "lead_time_from_mean": relative.from_mean("lead_time")})
    rows = rows.drop(*live.dropped_relatives(rows.columns, made))
    rows = rows.withColumns({"lead_time": F.round(F.coalesce("lead5", "lead30"), 12), "trial_time": F.col("trial30")})
    rows = rows.withColumns({"lead_time_rank": relative.rank_min("lead_time", ascending=True), "lead_time_from_mean": relative.from_mean("lead_time")})
    return rows.select(*KEY, *[F.round(c, 9).alias(c) for c in ("lead_time", "trial_time", "lead_time_from_mean")], "lead_time_rank")


BEST, WORST = ("lead_best5", "lead_best10", "lead_best30"), ("lead_worst5", "lead_worst10", "lead_worst30")
WINDOWS = [f for f in ENTITY if f.out in (*BEST, *WORST)]


@query(on_view(f"SELECT contest_id, slot, round(least({', '.join(BEST)}), 9) AS window_best, round(greatest({', '.join(WORST)}), 9) AS window_worst, round(greatest({', '.join(WORST)}) - least({', '.join(BEST)}), 9) AS window_range, round(lead_time - least({', '.join(BEST)}), 9) AS from_best FROM h", h="SELECT contest_id, slot, lead_time, " + ", ".join(f"{guarded(SQL_HOW[f.how], f.source, 'entity_id', f.window, f.least)} AS {f.out}" for f in WINDOWS) + " FROM v"))
def lead_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and worst lead over three windows, nulls left out, their range and the distance from the best."""
    rows = rolling_history(contest_view(spark, sf_dir), ["entity_id"], ORDER, WINDOWS)
    rows = rows.withColumns({"window_best": F.least(*BEST), "window_worst": F.greatest(*WORST)})
    return rounded(rows.withColumns({"window_range": F.col("window_worst") - F.col("window_best"), "from_best": F.col("lead_time") - F.col("window_best")}), "window_best", "window_worst", "window_range", "from_best")


TRAIN = [Feature("win30", "is_win", 30, 3), Feature("rank5", "outcome_rank", 5, 2), Feature("trial30", "trial_time", 30, 3)]


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, history and relatives of every row: what a learner reads."""
    rows = rolling_history(flagged(spark, sf_dir), ["entity_id"], ORDER, TRAIN)
    rows = rows.withColumns({"win30": F.round("win30", 12), "rank5": F.round("rank5", 12)})
    return rows.withColumns({"win30_rank": relative.rank_min("win30"), "rank5_from_mean": relative.from_mean("rank5"), "trial_rank": relative.rank_min("trial_time", ascending=True)})


TRAINING = f"""
SELECT *, CASE WHEN win30 IS NOT NULL THEN rank() OVER (PARTITION BY contest_id ORDER BY win30 DESC NULLS LAST) END AS win30_rank, rank5 - avg(rank5) OVER (PARTITION BY contest_id) AS rank5_from_mean, CASE WHEN trial_time IS NOT NULL THEN rank() OVER (PARTITION BY contest_id ORDER BY trial_time NULLS LAST) END AS trial_rank
FROM (SELECT *, round({guarded('avg', 'is_win', 'entity_id', 30, 3)}, 12) AS win30, round({guarded('avg', 'outcome_rank', 'entity_id', 5, 2)}, 12) AS rank5, {guarded('avg', 'trial_time', 'entity_id', 30, 3)} AS trial30 FROM f)
"""


@query(on_view("SELECT contest_id, slot, target_rank, is_win, is_top2, is_top3, round(win30, 9) AS win30, round(rank5, 9) AS rank5, round(trial30, 9) AS trial30, win30_rank, round(rank5_from_mean, 9) AS rank5_from_mean, trial_rank FROM t", f=F_SQL, t=TRAINING))
def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_rows(spark, sf_dir)
    return rows.select(*KEY, "target_rank", "is_win", "is_top2", "is_top3", *[F.round(c, 9).alias(c) for c in ("win30", "rank5", "trial30", "rank5_from_mean")], "win30_rank", "trial_rank")


ROLES = ["position", "entity_id", "machine_a", "machine_b", "site", "lead_time", "trial_time", "raw_score", "win30", "rank5", "trial30", "win30_rank", "rank5_from_mean", "trial_rank"]


@query(on_view("SELECT c AS column, c = 'entity_id' OR (c = 'site' AND (SELECT count(*) FILTER (site IS NOT NULL AND try_cast(site AS DOUBLE) IS NULL) FROM v) > 0) AS categorical, starts_with(c, 'machine') OR ends_with(c, '30') AS in_history_set FROM (VALUES " + ", ".join(f"('{c}')" for c in ROLES) + ") AS r(c)"))
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of a learner: which are categories, and which a named subset takes."""
    rows = training_rows(spark, sf_dir)
    columns = live.feature_columns(rows)
    subset = live.feature_subset(columns, ["machine"], ["30"])
    return live.categorical_columns(rows, columns, always=["entity_id"]).withColumn("in_history_set", F.col("column").isin(subset))


@query(on_view("SELECT count(*) AS rows, count(DISTINCT contest_id) AS contests, min(race_date) AS first_day, max(race_date) AS last_day, count(*) FILTER (win30 IS NOT NULL) AS with_history FROM t", f=F_SQL, t=TRAINING))
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bounds of the training table."""
    return training_rows(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_distinct("contest_id").alias("contests"), F.min("race_date").alias("first_day"), F.max("race_date").alias("last_day"), F.count("win30").alias("with_history"))


@query(on_view("SELECT entity_id, count(*) AS starts, CAST(sum(is_win) AS BIGINT) AS wins, CAST(sum(is_top3) AS BIGINT) AS top3, count(trial_time) AS trials FROM (SELECT entity_id, is_win, is_top3, trial_time FROM f WHERE race_date < DATE '1996-01-01' UNION ALL SELECT entity_id, is_win, is_top3, NULL FROM f WHERE race_date >= DATE '1996-01-01') GROUP BY entity_id", f=F_SQL))
def appended_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old history and new results in one frame: the new rows lack a column, which is null for them."""
    v = contest_view(spark, sf_dir)
    old = with_targets(v.where("race_date < date'1996-01-01'")).select("entity_id", "is_win", "is_top3", "trial_time")
    new = with_targets(v.where("race_date >= date'1996-01-01'")).select("entity_id", "is_win", "is_top3")
    return old.unionByName(new, allowMissingColumns=True).groupBy("entity_id").agg(F.count("*").alias("starts"), F.sum("is_win").cast("bigint").alias("wins"), F.sum("is_top3").cast("bigint").alias("top3"), F.count("trial_time").alias("trials"))


MINUTE = "contest_id % 1440"


@query(on_view(f"SELECT contest_id, race_date, site, {MINUTE} AS deadline FROM v WHERE {MINUTE} >= 720 GROUP BY contest_id, race_date, site"))
def future_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests whose deadline is not over at noon."""
    at = contest_view(spark, sf_dir).withColumn("deadline", F.expr(MINUTE)).where("deadline >= 720")
    return at.select("contest_id", "race_date", "site", "deadline").distinct()


@query(on_view(f"""
SELECT race_date, chosen AS site, coalesce(min(CASE WHEN deadline >= 720 THEN contest_id END), max(contest_id)) AS contest_id, count(*) AS contests
FROM (SELECT *, coalesce(max(CASE WHEN site = '3-MEDIUM' THEN site END) OVER (PARTITION BY race_date), min(site) OVER (PARTITION BY race_date)) AS chosen
      FROM (SELECT DISTINCT contest_id, race_date, site, {MINUTE} AS deadline FROM v)) WHERE site = chosen GROUP BY race_date, chosen
"""))
def default_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each day the preferred site, else the first, and its next contest at noon, else its last."""
    at = contest_view(spark, sf_dir).select("contest_id", "race_date", "site", F.expr(MINUTE).alias("deadline")).distinct()
    day = Window.partitionBy("race_date")
    at = at.withColumn("chosen", F.coalesce(F.max(F.when(F.col("site") == "3-MEDIUM", F.col("site"))).over(day), F.min("site").over(day))).where("site = chosen")
    return at.groupBy("race_date", "site").agg(F.coalesce(F.min(F.when(F.col("deadline") >= 720, F.col("contest_id"))), F.max("contest_id")).alias("contest_id"), F.count("*").alias("contests"))


@query(on_view("SELECT contest_id, slot, entity_id, raw_score FROM v WHERE contains(site, 'MEDIUM') AND contest_no % 100 = 7"))
def picked_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests by a part of the site's name and their number."""
    return contest_view(spark, sf_dir).where(F.col("site").contains("MEDIUM") & (F.col("contest_no") % 100 == 7)).select(*KEY, "entity_id", "raw_score")


@query(on_view("SELECT CAST(d AS DATE) AS day, count(contest_id) AS contests, round(coalesce(sum(payout), 0), 2) AS total, count(contest_id) = 0 AS is_missing FROM (SELECT unnest(generate_series(min(race_date), max(race_date), INTERVAL 1 DAY)) AS d FROM v) AS w LEFT JOIN (SELECT DISTINCT contest_id, race_date, payout FROM v) AS p ON p.race_date = CAST(d AS DATE) GROUP BY 1"))
def payout_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payouts of every day of the calendar, and which days have none."""
    v = contest_view(spark, sf_dir)
    days = tables.calendar_over(v, ("all",)).select("day")
    paid = v.groupBy("contest_id").agg(F.first("race_date").alias("day"), F.first("payout").alias("payout"))
    return days.join(paid, "day", "left").groupBy("day").agg(F.count("contest_id").alias("contests"), F.round(F.coalesce(F.sum("payout"), F.lit(0.0)), 2).alias("total"), (F.count("contest_id") == 0).alias("is_missing"))


@query(on_view("""
SELECT status, count(*) AS n FROM (
    SELECT CASE WHEN max(CAST(whole AS INT)) = 1 THEN 'present' WHEN count(contest_id) > 0 THEN 'skipped' ELSE 'missing' END AS status
    FROM (SELECT unnest(generate_series(min(race_date), max(race_date), INTERVAL 1 DAY)) AS d FROM v) AS w LEFT JOIN (SELECT contest_id, any_value(race_date) AS race_date, count(*) = 6 AS whole FROM v GROUP BY contest_id) AS p ON p.race_date = CAST(d AS DATE) GROUP BY d) GROUP BY status
"""))
def gap_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a complete contest, with incomplete ones only, and with none."""
    v = contest_view(spark, sf_dir)
    days = tables.calendar_over(v, ("all",)).select("day")
    per_contest = v.groupBy("contest_id").agg(F.first("race_date").alias("day"), (F.count("*") == 6).alias("whole"))
    return tables.gap_states(days, per_contest.where("whole").select("day"), per_contest.select("day"), ["day"])
